"""Token alignment, exact search and conversation repair against plain versions."""

import hashlib
import itertools
import random
import re
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from loomtext.llm import alignment, bitsliced, conversations

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# token alignment


def _plain_tokens(text, a, b):
    """(id, bytes) of both tokenizers over the whole text, or none where they do not give it back."""
    if not text:
        return [], []
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(k): k for k in keep} | {chr(256 + n): k for n, k in enumerate(sorted(set(range(256)) - set(keep)))}
    x = [(k, bytes(byte[c] for c in a.id_to_token(k))) for k in a.encode(" " + text, add_special_tokens=False).ids]
    y = [(k, bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode()) for k in b.encode(text)]
    whole = (" " + text).encode()
    return (x, y) if b"".join(t for _, t in x) == whole == b"".join(t for _, t in y) else ([], [])


def _plain_alignment(rows):
    """Byte by byte: which token of each side covers it."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    held, out = defaultdict(set), []
    for number, (id_, text) in enumerate(rows):
        x, y = _plain_tokens(text, a, b)
        over_x, over_y = ([k for k, (_, t) in enumerate(side) for _ in t] for side in (x, y))
        links = [(x[i][0], y[j][0]) for i, j in dict.fromkeys(zip(over_x, over_y, strict=True))]
        groups, at_x, at_y = [], 0, 0
        ends_x, ends_y = (list(itertools.accumulate(len(t) for _, t in side)) for side in (x, y))
        for end in sorted(set(ends_x) & set(ends_y)):
            to_x, to_y = ends_x.index(end, at_x) + 1, ends_y.index(end, at_y) + 1
            groups.append(",".join(str(k) for k, _ in x[at_x:to_x]) + "|" + ",".join(str(k) for k, _ in y[at_y:to_y]))
            at_x, at_y = to_x, to_y
        for pair in set(links):
            held[pair].add(number)
        out.append((id_, len(x), len(y), groups, links))
    best = defaultdict(int)
    for (i, _), where in held.items():
        best[i] = max(best[i], len(where))
    return [(id_, n, m, len(g), len(ls), sum(len(held[p]) == best[p[0]] for p in ls), sum(len(held[p]) for p in ls), hashlib.sha256(";".join(g).encode()).hexdigest() if n else "") for id_, n, m, g, ls in out]


_TEXTS = [
    None, "", " ", "  ", "\n", " a", "a ", "a  b", "a\n\nb", "\n a", "a\r\nb c);\r x", "tab\tseparated\x0bvt \x0c end", "it's we'll <|endoftext|> <s> </s> <unk> <0x41> x", "日本語 のテキスト 👩‍👩‍👧 ok",
    "▁ not given back", "x▁ y ▁z", "nbsp  and em  line", "n0 5 00123 3.14", "ÄÖÜ straße é \u0000 zero", "a" * 700, "repeat repeat repeat", "repeat repeat repeat", "=== ---- ////   ....\t\t\t!",
]


def test_alignment_equals_the_plain_version(spark, rows):
    short = [(i, t and t[:1500]) for i, t, _ in rows]
    draw = random.Random(3)
    mixed = ["".join(draw.choice([" ", "  ", "\n", "\t", "\r", "é", "ab", "The", " the", "9", "'s", ".", "漢", " ", "▁"]) for _ in range(40)) for _ in range(60)]
    given = [*short, *((100 + k, t) for k, t in enumerate([*_TEXTS, *mixed])), (7, "same id"), (None, "null id")]
    frame = spark.createDataFrame([(i, t, "x", 3) for i, t in given], "doc_id long, text string, piece string, block int").repartition(3)
    got = alignment.align(frame, A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(_plain_alignment(given), key=repr)


def test_alignment_is_the_same_over_several_blocks(spark, rows, monkeypatch):
    given = [(i, t and t[:900]) for i, t, _ in rows]
    frame = spark.createDataFrame(given, "doc_id long, text string").coalesce(1)
    whole = sorted(map(tuple, alignment.align(frame, A, B).collect()), key=repr)
    assert whole == sorted(_plain_alignment(given), key=repr)
    monkeypatch.setattr(alignment, "AT_ONCE", 7)
    left, right = (_block(alignment, given)[k] for k in (0, 1))
    assert alignment._texts(left, right).num_rows > 0


def _block(module, given):
    """One block's two tables, with made-up alignments of one token a piece."""
    import pyarrow as pa

    words = {}
    seqs = [np.array([words.setdefault(p, len(words)) for p in (t or "").split()], "<i4").tobytes() for _, t in given]
    n, k = len(given), len(words)
    packed = [pa.compress(x, "zstd", asbytes=True) for x in seqs]
    left = pa.table({"block": pa.array([1] * n, pa.int64()), "row": pa.array(range(n), pa.int32()), "id": [str(i) for i, _ in given], "size": pa.array([len(x) // 4 for x in seqs], pa.int32()), "seq": pa.array(packed, pa.binary())})
    ones = pa.array([1] * k, pa.int64())
    right = pa.table({"number": pa.array(range(k), pa.int32()), "good": [True] * k, "n_a": ones, "n_b": ones, "n_groups": ones, "groups": ["1|1"] * k, "links": pa.array([[j] for j in range(k)], pa.list_(pa.int64()))})
    return left, right


def test_alignment_of_an_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id string, text string")
    assert alignment.align(frame, A, B).collect() == []


@pytest.mark.parametrize("text", [None, "", "▁"])
def test_alignment_of_texts_without_tokens(spark, text):
    frame = spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")
    assert [tuple(r) for r in alignment.align(frame, A, B).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")] * 2


def test_pieces_are_cut_where_both_end(rows):
    both = alignment.Tokenizers(A, B)
    slow = re.compile(rf"(?<=[^\s▁])(?=[{both.breaks}])")
    cut = alignment._cutter(both.breaks)
    for text in [t for _, t, _ in rows if t] + [t for t in _TEXTS if t]:
        pieces = cut(" " + text[:2000])
        assert pieces == slow.split(" " + text[:2000])
        a, b = both.encode(pieces)
        assert sum(a, []) == both.a.encode(" " + text[:2000], add_special_tokens=False).ids
        if "▁" not in text:
            assert sum(b, []) == both.b.encode(text[:2000])


# exact search


def _plain_search(rows, modulo, k):
    def usable(v):
        return v and all(x is not None and np.isfinite(x) and abs(np.floor(256 * x)) < 1 << 23 for x in v)

    held = [(n, i, [int(np.floor(256 * x)) for x in v]) for n, (i, v) in enumerate(rows) if usable(v)]
    out = []
    for n, i, q in held:
        if i is not None and i % modulo == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j is None, j or 0) for m, j, v in held if m != n and len(v) == len(q))
            out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(scored[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_search_equals_sorting(spark, monkeypatch, kind):
    draw = random.Random(8)
    real = lambda d: [draw.choice([draw.uniform(-1, 1), 0.0, 1.0, -1.0]) for _ in range(d)]
    rows = [(k, real(8)) for k in range(230)] + [(300 + k, real(3)) for k in range(20)] + [(400 + k, real(5)) for k in range(3)]
    copy = real(8)
    rows += [(500 + k, copy) for k in range(40)] + [(10, copy), (10, copy), (None, copy), (None, real(8))]
    rows += [(600, None), (610, []), (620, [None] * 8), (630, [float("nan")] * 8), (640, [float("inf")] + [0.0] * 7), (650, [1e9] * 8), (660, [30000.0] * 8), (670, [0.0] * 8)]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], f"vec_id long, embedding array<{kind}>, block int").repartition(4)
    given = [(r[0], r[1]) for r in frame.collect()]
    monkeypatch.setattr(bitsliced, "BROADCAST", 600)  # several parts
    from pyspark.sql import functions as F

    got = bitsliced.search(bitsliced.build_index(frame, F.col("vec_id") % 10 == 0), 5)
    assert sorted(map(tuple, got.collect()), key=repr) == _plain_search(given, 10, 5)


def test_search_without_rows_or_queries(spark):
    from pyspark.sql import functions as F

    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert bitsliced.search(bitsliced.build_index(none, F.col("vec_id") % 50 == 0)).collect() == []
    one = spark.createDataFrame([(1, [1.0]), (50, [2.0])], "vec_id long, embedding array<float>")
    assert bitsliced.search(bitsliced.build_index(one, F.lit(False))).collect() == []
    assert [tuple(r) for r in bitsliced.search(bitsliced.build_index(one, F.col("vec_id") == 50)).collect()] == [(50, 1, 1, 512 * 256)]


def test_sums_and_selection_by_slices():
    draw = np.random.default_rng(5)
    for rows, width, top in ((1, 1, 1), (63, 4, 3), (64, 7, 300), (1000, 16, 8)):
        values, query = draw.integers(-top, top + 1, (rows, width)), draw.integers(-top, top + 1, width)
        low, slices = bitsliced.slices_of(values)
        planes = bitsliced.added(slices, query)
        bits = np.stack([np.unpackbits(p.view(np.uint8), bitorder="little")[:rows].astype(object) for p in planes])
        total = sum(b << k for k, b in enumerate(bits))
        shift = total - values.astype(object) @ query.astype(object)
        assert len(set(shift.tolist())) == 1  # all scores are shifted alike
        for k in (1, 5, rows):
            best = bitsliced.selected(planes, bitsliced._pack(np.ones(rows, bool)), k)
            assert sorted(best) == sorted(np.lexsort((np.arange(rows), -(values @ query)))[:k])


# conversations


def _cheapest(turns):
    """All edit sequences of a short conversation: least (cost, audit), and the repaired lines."""
    best = None
    flags, seen = [], set()
    for _, role, text in turns:
        body = text.strip(" \t\n\x0b\x0c\r")
        flags.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    for inserts in itertools.product(range(3), repeat=len(turns) + 1):
        for edits in itertools.product("KRD", repeat=len(turns)):
            letters = "I" * inserts[0] + "".join(e + "I" * n for e, n in zip(edits, inserts[1:], strict=True))
            rows, lines, cost, ok = iter(zip(turns, flags, strict=True)), [], 0, True
            for x in letters:
                if x == "I":
                    cost += 5
                    lines.append((None, ""))
                    continue
                (_, role, text), flag = next(rows)
                if x == "D":
                    cost += 2
                    continue
                ok = ok and flag not in ("blank", "duplicate")
                cost += (x == "R") + 5 * (flag == "truncated")
                lines.append((role if x == "K" else None, text))
            if not ok or (best and (cost, letters) >= best[:2]):
                continue
            choices = [[r] if r is not None else ["user", "assistant"] for r, _ in lines]
            for roles in itertools.product(*choices):
                if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r in roles)):
                    best = (cost, letters, "\n".join(f"{r}:{t}" for r, (_, t) in zip(roles, lines, strict=True)))
                    break
    return flags, best


def _plain_repair(rows):
    held = defaultdict(list)
    for conv, turn, role, text in rows:
        held[conv].append((turn, " " if role is None else role, " " if text is None else text))
    out = []
    for conv, turns in held.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2][:32].encode(), hashlib.sha256(t[2].encode()).digest()[:16]))
        flags, (cost, letters, text) = _cheapest(turns)
        numbers = {t[0] for t in turns} - {None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        out.append((conv, len(turns), gaps, *(flags.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, letters, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def _repair(frame):
    audits = conversations.audit(frame)
    fixed = conversations.repaired(frame, audits)
    hashes = {r[0]: r[1] for r in conversations.digests(fixed).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    return sorted((*(tuple(r)), hashes.get(r[0], empty)) for r in audits.collect()) if not any(r[0] is None for r in audits.collect()) else sorted(((*tuple(r), hashes.get(r[0], empty)) for r in audits.collect()), key=repr)


@pytest.mark.parametrize("span", [1, 2, 512])
def test_repair_equals_trying_all_edits(spark, monkeypatch, span):
    monkeypatch.setattr(conversations, "SPAN", span)
    draw = random.Random(12)
    role = lambda: draw.choice(["user", "assistant", "system", "user", "assistant", None, "", "usr", "tool"])
    text = lambda: draw.choice(["Yes.", "No!", "Why?", "cut", "", " \n", None, "Yes. \t", "a.b", "é."])
    rows = [(c, draw.choice([None, 0, 1, 2, 3, 9]), role(), text()) for c in range(60) for _ in range(draw.randint(1, 4))]
    rows += [(None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."), *[(70, 5, "user", "Same.")] * 4]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, audit string").repartition(5)
    assert sorted(_repair(frame), key=repr) == _plain_repair(rows)


def test_long_conversations_do_not_depend_on_segments_and_ranges(spark, monkeypatch):
    draw = random.Random(2)
    rows = [(1, k, draw.choice(["user", "assistant", "assistant", "system"]), draw.choice(["One.", "Two", f"Number {k}.", ""])) for k in range(1500)]
    rows += [(c, k, "user" if k % 2 == 0 else "assistant", f"{c} {k}.") for c in range(2, 9) for k in range(4)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = []
    for span, parts in ((512, "1"), (40, "1"), (7, "9")):
        monkeypatch.setattr(conversations, "SPAN", span)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got.append(_repair(frame))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == got[1] == got[2] and got[0][0][1] == 1500 and all(r[7] == 0 for r in got[0][1:])


def test_repaired_turns_follow_the_grammar_and_stand_in_order(spark):
    rows = [("a", 1, "assistant", "Hi."), ("a", 2, "assistant", "Again."), ("b", 1, "system", "Be kind."), ("b", 2, "assistant", "cut"), ("c", 1, "tool", "")]
    frame = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    audits = conversations.audit(frame)
    got = sorted(map(tuple, conversations.repaired(frame, audits).collect()))
    assert got == [("a", 0, "user", "Hi.", "R"), ("a", 1, "assistant", "Again.", "K")]
    assert {r.conv_id: r.audit for r in audits.collect()} == {"a": "RK", "b": "DD", "c": "D"}


def test_damage_and_empty_tables(spark):
    import zlib

    rows = [(c, t, "assistant", "A. b! c?") for c in (1, 2, None) for t in [*range(60), None]]
    got = sorted(map(tuple, conversations.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()), key=repr)
    want = []
    for c, t, r, x in rows:
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        want += [] if fate == 0 else [(c, t, "user" if fate == 4 else r, "" if fate == 1 else "A b c" if fate == 2 else x)] * (2 if fate == 3 else 1)
    assert got == sorted(want, key=repr)
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    audits = conversations.audit(none)
    assert audits.collect() == [] and conversations.repaired(none, audits).collect() == []
