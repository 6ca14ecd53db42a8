"""Operators over texts against plain Python, on the edge cases of conftest.py."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from loomtext.llm import bpe, fingerprints, linededup, minhash, mixing, quality, repeats, sharding, words

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
key = lambda r: repr(r)


def test_word_hashes_follow_the_words(monkeypatch):
    monkeypatch.setattr(words, "SLICE", 64)
    texts = ["a b  c\n", "", " x\x0byy a ", "é à\xa0z", "  ", "long" * 100 + " tail", " ".join("w%d" % k for k in range(200))]
    h, counts = words.word_hashes([t.encode() for t in texts])
    flat = [w for t in texts for w in WORDS.findall(t)]
    assert counts.tolist() == [len(WORDS.findall(t)) for t in texts]
    assert len(set(zip(flat, h.tolist(), strict=True))) == len(set(flat)) == len(set(h.tolist()))


def _remove_repeats(rows, n):
    held = [WORDS.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + n]) for w in held for i in range(len(w) - n + 1))
    out = []
    for (i, _), w in zip(rows, held, strict=True):
        gone = {k for s in range(len(w) - n + 1) if seen[tuple(w[s : s + n])] > 1 for k in range(s, s + n)}
        out.append((i, " ".join(x for k, x in enumerate(w) if k not in gone), len(w), len(gone)))
    return sorted(out, key=key)


@pytest.mark.parametrize("length", [22, 35])
def test_repeats(docs, rows, nothing, length):
    got = repeats.remove_repeats(docs, length=length)
    assert {"source", "_kid", "_c0", "kept_text"} <= set(got.columns)
    found = sorted(((r.doc_id, r.kept_text, r.n_words, r.n_removed) for r in got.collect()), key=key)
    assert found == _remove_repeats([(i, t) for i, t, _ in rows], length)
    assert repeats.remove_repeats(nothing).collect() == []


def _dedup_lines(rows):
    where = defaultdict(set)
    keyed = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(UPPER)
    for i, t in rows:
        for line in (t or "").split("\n"):
            where[keyed(line)].add(-1 if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (len(keyed(x)) >= 20 and len(where[keyed(x)]) >= 3 and max(where[keyed(x)]) != (-1 if i is None else i))]
        out.append((i, "\n".join(stay), len(lines), len(lines) - len(stay)))
    return sorted(out, key=key)


def test_line_dedup(spark, docs, rows, nothing):
    got = linededup.dedup_lines(docs)
    found = sorted(((r.doc_id, r.kept_text, r.n_lines, r.n_dropped) for r in got.collect()), key=key)
    assert found == _dedup_lines([(i, t) for i, t, _ in rows])
    assert sum(r[3] for r in found) > 0
    assert linededup.dedup_lines(nothing).collect() == []
    # one line in most documents, over many ranges: the ends of ranges are settled right
    draw = random.Random(1)
    many = [(k, "\n".join([f"line number {draw.randint(0, 25)} of the corpus", "the most common line of all"][: 1 + (k % 5 > 0)])) for k in range(600)]
    from loomtext.llm.common import setting

    with setting(spark, "spark.sql.adaptive.enabled", "false"), setting(spark, "spark.sql.shuffle.partitions", "23"):
        got = linededup.dedup_lines(spark.createDataFrame(many, "doc_id long, text string"))
        assert sorted(((r.doc_id, r.kept_text, r.n_lines, r.n_dropped) for r in got.collect()), key=key) == _dedup_lines(many)


def _near(rows):
    sets = []
    for _, t in rows:
        w = WORDS.findall((t or "").translate(UPPER))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    label = {i: i for i, _ in rows if i is not None}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, (i, _) in enumerate(rows):
        for b, (j, _) in enumerate(rows[:a]):
            both = len(sets[a] & sets[b])
            if i is not None and j is not None and sets[a] and sets[b] and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(i), find(j)))
                label[y] = x
    return sorted(((i, len(s), None if i is None else find(i), i is None or find(i) == i) for (i, _), s in zip(rows, sets, strict=True)), key=key)


def test_near_duplicates(docs, rows, nothing):
    found = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()), key=key)
    assert found == _near([(i, t) for i, t, _ in rows])
    assert minhash.near_duplicates(nothing).collect() == []


def test_near_duplicates_in_a_large_group(spark):
    """Texts at many distances from one base: buckets are large and hold several components."""
    draw = random.Random(2)
    base = ["w%d" % draw.randint(0, 9999) for _ in range(120)]
    many = []
    for k in range(120):
        w = list(base)
        for _ in range(draw.randint(0, 8)):
            w[draw.randrange(120)] = "n%d" % draw.randint(0, 99999)
        many.append((k, " ".join(w)))
    got = minhash.near_duplicates(spark.createDataFrame(many, "doc_id long, text string"), block=16)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()), key=key) == _near(many)


def test_minhash_recall():
    """Of pairs just over 0.75, banding misses almost none."""
    draw = np.random.default_rng(0)
    family = minhash._family(288, 17)
    pairs = [np.unique(draw.integers(0, 2**64, 115, np.uint64)) for _ in range(300)]
    a = [p[:100] for p in pairs]
    b = [p[14:] for p in pairs]
    assert 86 / 115 < 0.75 <= 87 / 115 and len(a[0]) == 100
    sig = [minhash.signatures(np.concatenate(x), np.array([len(y) for y in x]), family).reshape(len(x), 48, 6) for x in (a, b)]
    assert (sig[0] == sig[1]).all(axis=2).any(axis=1).mean() > 0.99


def test_bpe_matches_the_library(docs, rows, nothing):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.read_ranks(path)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN)
    found = sorted(((r.doc_id, bytes(r.ids), r.n_tokens, bytes(r.decoded)) for r in got.collect()), key=key)
    want = sorted(((i, np.array(x := library.encode_ordinary(t or ""), "<u4").tobytes(), len(x), (t or "").encode()) for i, t, _ in rows), key=key)
    assert found == want
    assert bpe.encode(nothing, path, public_tokenizers.PATTERN).collect() == []
    draw = random.Random(9)
    codec = bpe.Codec(ranks, public_tokenizers.PATTERN)
    odd = ["".join(draw.choice("aábc  \n\t\x1c\x85\u2003zß漢字😀é1٣.,'sll<|endoftext|>") for _ in range(draw.randint(0, 300))) for _ in range(300)] + ["a" * 999, "ab" * 700, "漢" * 400]
    assert codec.encode(odd) == [np.array(library.encode_ordinary(t), "<u4").tobytes() for t in odd]


def test_sharding(docs, rows, nothing):
    got = sharding.shard(docs, shards=4, range_bytes=4000).collect()
    assert len(got) == len(rows) and {r.size for r in got} == {len((t or "").encode()) + 1 for _, t, _ in rows}
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    assert sharding.shard(nothing).collect() == []


def test_shards_are_even_when_a_third_is_one_text(spark):
    draw = random.Random(3)
    many = [(k, "same text " * 20 if k % 3 == 0 else "".join(draw.choice("abc ") for _ in range(draw.randint(1, 400)))) for k in range(3000)]
    got = sharding.shard(spark.createDataFrame(many, "doc_id long, text string"), range_bytes=20_000).groupBy("shard").agg(F.sum("size").alias("s"), F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.max("slot").alias("m")).collect()
    total = sum(r.s for r in got)
    assert len(got) == 8 and all(abs(r.s - total / 8) < 0.02 * total / 8 and r.n == r.d == r.m + 1 for r in got)


def test_mixing(docs, rows, nothing):
    got = mixing.mix(docs).collect()
    size = lambda t: len(WORDS.findall(t or ""))
    total = Counter()
    for _, t, s in rows:
        total[s] += size(t)
    order = sorted(total, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(total.values()), set(order)
    while True:  # the plain form: stop whoever is over, share again
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 2 * total[s]]
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in over:
            target[s] = 2.0 * total[s]
            left -= target[s]
            open_.remove(s)
    taken = Counter()
    for r in got:
        assert r["size"] * 2 >= r.taken >= 0 and r.source_size == total[r.source] and abs(r.target - target[r.source]) < 1e-6
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 2 for s in order)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(3)).collect()))
    assert mixing.mix(nothing).collect() == []


def _fingerprint(text):
    h = lambda b, s=42: xxhash.xxh64_intdigest(b, seed=s)
    w, votes = WORDS.findall(text), [0] * 128
    for a, b in zip(w, [*w[1:], None], strict=False):
        x = h(a.encode())
        x = x if b is None else h(b.encode(), x)
        y = h(x.to_bytes(8, "little"))
        for k in range(64):
            votes[k] += 1 if x >> k & 1 else -1
            votes[64 + k] += 1 if y >> k & 1 else -1
    return "%016x%016x" % tuple(sum(1 << k for k in range(64) if votes[k + o] > 0) for o in (0, 64))


def test_fingerprints(spark, rows, nothing):
    from loomtext.llm.fingerprints import edited_fingerprints, with_neighbours

    table = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    got = with_neighbours(edited_fingerprints(table, ranges=9), F.col("doc_id") % 20 == 0)
    # null ids first, ties by a hash of the text
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    some = sorted(((-(2**63) if i is None else i, signed(xxhash.xxh64_intdigest((t or "").encode(), seed=42)), t or "") for i, t, _ in rows))
    near = lambda a, b: 1 - bin(int(a, 16) ^ int(b, 16)).count("1") / 128
    prints = [_fingerprint(t) for *_, t in some]
    want = []
    for k, (i, _, t) in enumerate(some):
        after, half = some[(k + 1) % len(some)][2], len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        within = sum(near(prints[k], p) >= 1 - 3 / 128 for p in prints) - 1
        want.append((None if i == -(2**63) else i, len(t), hashlib.sha256(edited.encode()).hexdigest(), prints[k], _fingerprint(edited), near(prints[k], _fingerprint(edited)), near(prints[k], prints[(k + 1) % len(some)]), within if i % 20 == 0 and i >= 0 else None))
    found = [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next, r.n_near) for r in got.collect()]
    assert sorted(found, key=repr) == sorted(want, key=repr)


def test_fingerprints_of_odd_tables(docs, rows, nothing):
    got = fingerprints.edited_fingerprints(docs, ranges=4).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _, _ in rows)
    assert fingerprints.edited_fingerprints(nothing).collect() == []


def test_hamming_search(spark):
    draw = random.Random(5)
    base = [(draw.getrandbits(64), draw.getrandbits(64)) for _ in range(60)]
    flip = lambda p, n: tuple(v for v in _flip(p, draw.sample(range(128), n)))
    every = base + [flip(p, n) for p in base for n in (1, 4, 6, 7, 9)]
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    known = spark.createDataFrame([(signed(a), signed(b)) for a, b in every], "f1 long, f2 long")
    asked = spark.createDataFrame([(signed(a), signed(b)) for a, b in base] + [(None, 1)], "f1 long, f2 long")
    got = {(r.f1, r.f2, r.g1, r.g2) for r in fingerprints.search(known, asked).collect()}
    want = {(*map(signed, p), *map(signed, q)) for p in base for q in every if bin(p[0] ^ q[0]).count("1") + bin(p[1] ^ q[1]).count("1") <= 6}
    assert got == want


def _flip(p, bits):
    a, b = p
    for k in bits:
        a, b = (a ^ 1 << k, b) if k < 64 else (a, b ^ 1 << (k - 64))
    return a, b


def test_non_negative_risk():
    """Against the formula spelt out for each text, and the gradient against differences."""
    draw = np.random.default_rng(3)
    seen = set()
    for shift in (-1.0, 6.0):  # the second part above and below 0
        p, u, prior = draw.normal(shift, 1, 30), draw.normal(-shift, 1, 50), 0.6
        loss = lambda v: math.log(1 + math.exp(-v))
        first = prior * sum(map(loss, p)) / len(p)
        second = sum(loss(-v) for v in u) / len(u) - prior * sum(loss(-v) for v in p) / len(p)
        assert np.allclose(quality.nn_risk(p, u, prior), (first, second))
        seen.add(second < 0)
        # below 0 the step goes away from the second part alone
        goal = (lambda x: -quality.nn_risk(x[:30], x[30:], prior)[1]) if second < 0 else (lambda x: sum(quality.nn_risk(x[:30], x[30:], prior)))
        at = np.concatenate([p, u])
        slope = [(goal(at + d) - goal(at - d)) / 2e-5 for d in 1e-5 * np.eye(80)]
        assert np.allclose(quality.nn_gradient(p, u, prior), slope, atol=1e-7)
    assert seen == {True, False}


def test_class_prior():
    draw = np.random.default_rng(4)
    for share in (0.2, 0.5, 0.8):
        n = 4000
        unlabelled = np.concatenate([draw.normal(2, 1, int(n * share)), draw.normal(-3, 1, n - int(n * share))])
        positive = draw.normal(2, 1, 3000)
        # the plain form: the least ratio of tails over all cuts
        plain = min((np.mean(unlabelled >= c) / np.mean(positive >= c)) for c in np.quantile(positive, np.linspace(0, 0.9, 91)))
        assert abs(quality.class_prior(positive, unlabelled, slack=0) - plain) < 0.01 and abs(quality.class_prior(positive, unlabelled) - share) < 0.06


def test_splitters_against_sorting(spark):
    draw = random.Random(9)
    keys = [(draw.choice([5, -7, draw.getrandbits(63)]), draw.getrandbits(63) - 2**62, draw.randint(1, 900)) for _ in range(3000)]
    table = spark.createDataFrame(keys, "_k1 long, _k2 long, _size long")
    total = sum(s for *_, s in keys)
    targets = [total * k / 7 for k in range(1, 7)]
    bounds, size, count = sharding.splitters(table, targets, [0.002 * total] * 6)
    number = lambda a, b: (a + 2**63) << 64 | (b + 2**63)
    for b, s, c, t in zip(bounds, size, count, targets, strict=True):
        below = [r for r in keys if number(r[0], r[1]) < b]
        assert (s, c) == (sum(r[2] for r in below), len(below)) and abs(s - t) <= 0.002 * total


def test_quality(spark, docs, rows, nothing):
    draw = random.Random(6)
    good = lambda: " ".join("".join(draw.choice("aeiou") + draw.choice("bcdfg") for _ in range(draw.randint(1, 4))) for _ in range(60)) + "."
    bad = lambda: " ".join("".join(draw.choice("AEIOU") for _ in range(3)) + "!!" for _ in range(60))
    made = [(k, good() if k % 4 else bad(), int(k % 4 > 0)) for k in range(1200)]
    table = spark.createDataFrame([(k, t) for k, t, _ in made], "doc_id long, text string")
    marks = spark.createDataFrame([(k, q) for k, _, q in made if k % 3 == 0] + [(None, 1), (7, None)], "doc_id long, quality int")
    model = quality.fit(table, marks)
    assert abs(model.prior - 0.75) < 0.15
    got = {r.doc_id: r for r in quality.score(table, model).collect()}
    out = [(got[k].score, q) for k, _, q in made if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, _, _ in made)
    assert min(s for s, q in out if q) > max(s for s, q in out if not q)
    assert np.mean([got[k].predicted == q for k, _, q in made]) > 0.98
    edge = quality.score(docs, model).collect()
    assert len(edge) == len(rows) and all(0 <= r.score <= 1 for r in edge)
    assert quality.score(nothing, model).collect() == []
    # without positives every text gets one half
    blank = quality.fit(nothing, marks)
    assert {r.score for r in quality.score(docs, blank).collect()} == {0.5}
