"""Vectors, URLs, components, ranges and the pipeline."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.llm import components, embeddings, ranges, urlrules


def _near_vectors(rows, t):
    good = {k: np.array(v, float) / np.linalg.norm(v) for k, (i, v) in enumerate(rows) if i is not None and v and None not in v and np.isfinite(v).all() and np.linalg.norm(v) > 0}
    links = {k: {j for j in good if j != k and len(good[j]) == len(good[k]) and good[k] @ good[j] >= t} for k in good}
    out = []
    for k, (i, _) in enumerate(rows):
        seen, todo = {i}, [k]
        done = set()
        while todo:
            x = todo.pop()
            if x in done:
                continue
            done.add(x)
            seen.add(rows[x][0])
            todo += list(links.get(x, ())) + [j for j in good if rows[j][0] == rows[x][0]]
        out.append((i, len(links.get(k, ())), None if i is None else min(seen), i is None or min(seen) == i))
    return sorted(out, key=repr)


def test_near_vectors(spark):
    draw = np.random.default_rng(1)
    centres = draw.normal(size=(12, 8))
    rows = [(k, (centres[k % 12] + draw.normal(size=8) * draw.choice([0.02, 0.15, 0.4])).tolist()) for k in range(300)]
    rows += [(600 + k, (centres[3] + 0.001 * draw.normal(size=8)).tolist()) for k in range(70)]  # a tight group
    rows += [(700, [1.0, 0.0]), (701, [1.0, 0.0]), (702, [1.0, 0.0, 0.0]), (703, [1.0, 0.0, 0.001]), (704, [3.0, 0.1]), (7, [0.0, 1.0, 0.0]), (705, [0.0, 2.0, 0.1])]
    rows += [(400 + k, centres[0].tolist()) for k in range(9)] + [(500, None), (501, [0.0] * 8), (502, [float("nan")] * 8), (503, [1.0, None] * 4), (504, [1.0]), (505, []), (506, [1e-200] * 8), (None, centres[0].tolist()), (None, None)]
    table = spark.createDataFrame([(i, v, "x", 3) for i, v in rows], "vec_id long, embedding array<double>, kept string, n int")
    want = _near_vectors(rows, 0.95)
    for cell, miss in ((10_000, 0), (40, 0), (10, 1e-5)):
        got = embeddings.near_vectors(table, miss=miss, cell=cell, block=40).collect()
        assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=repr) == want
    assert embeddings.near_vectors(table.limit(0)).collect() == []


def test_near_vectors_without_structure(spark):
    """Vectors in all directions with pairs about the threshold: none that is not linked, and of the linked ones none lost."""
    draw = np.random.default_rng(2)
    x = draw.normal(size=(1500, 48)).astype(np.float32)
    unit = lambda v: v / np.linalg.norm(v)
    for k in range(0, 600, 2):
        angle = np.arccos(0.95) * draw.uniform(0.5, 1.1)
        a = unit(x[k].astype(float))
        b = draw.normal(size=48)
        x[k + 1] = np.cos(angle) * a + np.sin(angle) * unit(b - (a @ b) * a)
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    linked = y @ y.T >= 0.95
    np.fill_diagonal(linked, False)
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = embeddings.near_vectors(table, cell=64, block=50).collect()
    assert 200 < linked.any(axis=1).sum() < 600
    assert {r.vec_id: r.n_links for r in got} == dict(enumerate(linked.sum(axis=1).tolist()))
    assert sum(not r.kept for r in got) == sum(linked[k, :k].any() for k in range(1500))


def test_components(spark):
    draw = random.Random(2)
    edges = [(draw.randint(0, 400), draw.randint(0, 400)) for _ in range(260)] + [(k, k + 1) for k in range(500, 560)] + [(7, 7), (None, 3), (1000, 2000)]
    label = {}

    def find(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = sorted((find(a), find(b)))
            label[y] = x
    for few in (0, components.FEW):
        got = {r.u: r.v for r in components.components(spark.createDataFrame(edges, "u long, v long"), few).collect()}
        assert got == {x: find(x) for x in label if find(x) != x}
    assert components.components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_ranges(spark):
    draw = random.Random(3)
    keys = [(draw.choice([-(2**63), 2**63 - 1, 0, draw.randint(-50, 50), draw.randint(-(2**63), 2**63 - 1)]), draw.randint(-3, 3)) for _ in range(500)]
    for bounds in ([], sorted(set(draw.sample(keys, 40))), [(5, 0)]):
        got = ranges.range_column(spark.createDataFrame(keys, "a long, b long"), "a", "b", bounds, "r").collect()
        assert len(got) == len(keys) and all(r.r == sum(x <= (r.a, r.b) for x in bounds) for r in got)


URLS = [
    (1, "http://X.Example.NET/en/a?x#y"), (2, "https://example.com/de/1"), (3, "https://sub.example.com/de/1#f"), (4, "http://a.org/fr/2"), (5, "http://notexample.net.example/en/"), (6, "ftp://www.net"),
    (7, "no scheme"), (8, None), (9, ""), (10, "http://example.com?de/"), (11, "x://example.net/En/"), (12, "http://a.org/fr"), (12, "http://a.org/fr"), (None, "://org/fr/"), (13, "http://a\n.com/p\nq?z"),
]


def _judge(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    at = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:at])
    path = rest[at:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h) + len(p), h + p, v) for h, p, v in urlrules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_url_rules(spark):
    table = spark.createDataFrame([(i, u, "old", 1) for i, u in URLS], "page_id long, url string, verdict string, host int")
    none = spark.createDataFrame([], "tokens array<string>, key string, support double, confidence double")
    got = urlrules.judge(table, none).collect()
    want = [(i, *(x if x is not None else (None if k == 2 else "allow") for k, x in enumerate(_judge(u)))) for i, u in URLS]
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got), key=repr) == sorted(want, key=repr)
    assert urlrules.judge(table.limit(0), none).collect() == []


def test_mined_rules(spark):
    rows, marks = [], []
    for k in range(400):
        spam = k % 5 == 0
        rows.append((k, f"http://h{k % 7}.test/{'cheap/pills' if spam else ('cheap/news' if k % 2 else 'blue/pills')}/{k}"))
        marks.append((k, 0 if spam else 1))
    table, labels = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(marks + [(None, 0), (3, None)], "doc_id long, quality int")
    rules = urlrules.mine(table, labels, "page_id", "url", "doc_id", "quality")
    assert [sorted(r.tokens) for r in rules.collect()] == [["path:cheap", "path:pills"]]
    got = {r.page_id: r.verdict for r in urlrules.judge(table, rules).collect()}
    assert all((got[k] == "block") == (k % 5 == 0) for k in range(400))
    assert urlrules.mine(table.limit(0), labels, "page_id", "url", "doc_id", "quality").collect() == []


def test_mined_rules_against_counting(spark):
    """Every token set of up to three tokens is counted; what mining gives are the sets that are sure and often enough, no longer than needed."""
    draw = random.Random(11)
    words = ["aa", "bb", "cc", "dd", "ee", "ff"]
    rows, bad = [], {}
    for k in range(300):
        path = sorted(draw.sample(words, draw.randint(1, 4)))
        rows.append((k, f"http://h{k % 3}.test/{'/'.join(path)}"))
        bad[k] = ({"aa", "bb"} <= set(path) or "ff" in path) and draw.random() < 0.95
    rules = urlrules.mine(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame([(k, int(not b)) for k, b in bad.items()], "doc_id long, quality int"), "page_id", "url", "doc_id", "quality", support=0.03, confidence=0.85)
    held = {k: {f"path:{w}" for w in u.split("/")[3:]} | {f"host:h{k % 3}.test", "host:test", f"first:h{k % 3}"} for k, u in rows}
    names = sorted(set().union(*held.values()))
    rate = sum(bad.values()) / len(bad)
    share = lambda items: [sum(bad[k] for k in held if items <= held[k]), sum(items <= held[k] for k in held)]
    speaks = [n for n in names if (x := share({n}))[0] >= 9 and x[0] / x[1] > rate and not any(m < n and all((m in h) == (n in h) for h in held.values()) for m in names)]
    sure = {}

    def beyond_chance(hits, n, z=4.0):
        p = hits / n
        return (p + z * z / (2 * n) - z * (p * (1 - p) / n + z * z / (4 * n * n)) ** 0.5) / (1 + z * z / n) > rate

    for size in (1, 2, 3):
        for items in itertools.combinations(speaks, size):
            hits, n = share(set(items))
            if hits >= 9 and hits / n >= 0.85 and beyond_chance(hits, n):
                sure[frozenset(items)] = hits / n
    want = {s for s, c in sure.items() if not any(t < s and sure[t] >= c for t in sure)}
    got = {frozenset(r.tokens): r.confidence for r in rules.collect()}
    assert {s for s in got if len(s) <= 3} == want and all(abs(got[s] - sure[s]) < 1e-9 for s in want) and len(want) > 1


@pytest.mark.parametrize("widest", [1, 2, 12])
def test_confidence_is_counted_over_whole_token_sets(spark, widest):
    """A token of 6 bad URLs and 24 good ones that hold better tokens, too, has a confidence of 0.2, however few tokens a basket keeps."""
    rows, bad = [], {}
    for k in range(600):
        kind = k % 20
        path = "/".join(w for w, here in (("hit", kind < 3 or kind in (5, 6)), ("top", kind in (0, 1, 5)), ("weak", k < 150 and kind in (0, 5, 6, 7, 8)), ("more", kind in (2, 5, 6))) if here) or "none"
        rows.append((k, f"http://h{k % 2}.test/{path}/"))
        bad[k] = kind < 3 or (kind == 5 and k < 100)
    frames = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame([(k, int(not b)) for k, b in bad.items()], "doc_id long, quality int")
    rules = urlrules.mine(*frames, "page_id", "url", "doc_id", "quality", confidence=0.3, widest=widest, sure=2.0).collect()
    held = {k: {f"path:{w}" for w in u.split("/")[3:]} | {f"host:h{k % 2}.test", "host:test", f"first:h{k % 2}"} for k, u in rows}
    rate = sum(bad.values()) / len(bad)
    assert rules
    for r in rules:
        words = set(r.tokens)
        there = [k for k in held if words <= held[k]]
        hits = sum(bad[k] for k in there)
        assert (r.confidence, r.support, r.lift) == pytest.approx((hits / len(there), hits / len(held), hits / len(there) / rate))
        assert hits / len(there) >= 0.3
    got = {x.page_id: x.verdict for x in urlrules.judge(frames[0], spark.createDataFrame(rules)).collect()}
    assert all(got[k] == ("block" if any(set(r.tokens) <= held[k] for r in rules) else "allow") for k in held)
    assert "block" in got.values()


def test_labels_by_chance_give_no_rules(spark):
    draw = random.Random(6)
    rows = [(k, f"http://h{draw.randrange(9)}.test/{draw.choice('abcdef') * 3}/{draw.choice('ghijk') * 3}") for k in range(900)]
    labels = [(k, int(draw.random() > 0.15)) for k in range(900)]
    rules = urlrules.mine(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int"), "page_id", "url", "doc_id", "quality", confidence=0.1)
    assert rules.collect() == []


def test_template_words_do_not_multiply(spark):
    path = "/".join(f"{a}{b}" for a in "abcdefg" for b in "vwxyz")
    rows = [(k, f"http://t.test/{path}/{k}" if k % 2 else f"http://t.test/good/{k}") for k in range(60)]
    rules = urlrules.mine(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame([(k, 1 - k % 2) for k in range(60)], "doc_id long, quality int"), "page_id", "url", "doc_id", "quality")
    assert [r.tokens for r in rules.collect()] == [["path:av"]]


def test_pipeline_stages(spark, tmp_path):
    """Each stage on a small corpus against what its operator must do."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    draw = random.Random(8)
    good = lambda n: " ".join("".join(draw.choice(["ra", "lo", "mi", "ten"]) for _ in range(draw.randint(1, 4))) for _ in range(n)) + "."
    texts = [good(draw.randint(30, 90)) for _ in range(300)]
    texts[10] = texts[11]
    shared = "this line recurs in several documents"
    for k in (20, 21, 22):
        texts[k] = f"{shared}\n{texts[k]}"
    texts[40] = "BUY!! NOW!! " * 30
    rows = [(k, t, "en", f"s{k % 3}", len(t)) for k, t in enumerate(texts)] + [(400, None, None, None, None), (401, "", "en", "s1", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k % 40 != 0)) for k in range(0, 300, 2)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, schema)
    by_name = dict(corpus_pipeline.STAGES)
    lines = {r.doc_id: r for r in by_name["line dedup"](spark, docs, str(tmp_path)).collect()}
    assert shared not in lines[20].text and shared not in lines[21].text and lines[22].text == texts[22]
    assert lines[20].n_chars == len(lines[20].text) and lines[20].source == "s2"
    near = {r.doc_id for r in by_name["MinHash near-dedup"](spark, docs, str(tmp_path)).collect()}
    assert 11 not in near and {10, 400, 401} <= near and len(near) == len(rows) - 1
    mixed = by_name["mixing"](spark, docs, str(tmp_path)).collect()
    size = lambda t: len((t or "").split())
    total = sum(size(t) for _, t, *_ in rows)
    assert abs(sum(size(r.text) for r in mixed) - 1.5 * total) < 10
    whole = {k: t for k, t, *_ in rows}
    assert all(r.text is None or whole[r.doc_id].startswith(r.text) for r in mixed) and sum(r.text != whole[r.doc_id] for r in mixed) <= 3
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 0 and {"doc_id", "ids", "n_tokens", "lang", "source"} <= set(out.columns)
    assert out.where(F.col("n_tokens") * 4 != F.octet_length("ids")).count() == 0


def test_pipeline_stages_on_odd_tables(spark, docs, rows, nothing, tmp_path):
    """Null, empty and long texts, repeated rows, ties and columns called like an operator's own: documents' columns come back as they were."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(30, 60)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    more = docs.withColumn("_cut", F.lit("old")).withColumn("_words", F.lit(9)).withColumn("p0", F.lit("old")).withColumn("n_lines", F.lit(9)).withColumn("kept", F.lit("old")).withColumn("n_chars", F.lit(9).cast("long"))
    other = [c for c in more.columns if c not in ("doc_id", "text", "source", "n_chars")]
    before = {tuple(r[c] for c in other) for r in more.collect()}
    assert len(before) == 1
    ids = lambda got: sorted((r.doc_id for r in got), key=repr)
    every = sorted((i for i, _, _ in rows), key=repr)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, more, str(tmp_path))
        got = out.collect()
        assert stage(spark, more.limit(0), str(tmp_path)).collect() == []
        if name == "byte-level BPE":
            assert ids(got) == every and {r.documents_ids for r in got} == {"old"} and "text" not in out.columns
            assert {tuple(r[c] for c in other if c != "ids") for r in got} == {tuple(v for c, v in zip(other, next(iter(before)), strict=True) if c != "ids")}
            assert all((r.n_tokens == 0) == (not t) for t, r in ((t, r) for i, t, _ in rows for r in got if r.doc_id == i and i not in (None, 21)))
            continue
        assert out.columns == more.columns and out.schema.simpleString() == more.schema.simpleString()
        assert {tuple(r[c] for c in other) for r in got} == before
        texts = {r.doc_id: r.text for r in got}
        if name == "line dedup":
            assert ids(got) == every and texts[1] == texts[2] == "" and len(texts[19]) == len(dict((i, t) for i, t, _ in rows)[19])
            assert {r.n_chars for r in got if r.doc_id == 18} == {5000}
        if name == "MinHash near-dedup":
            left = ids(got)
            # repeated rows once; null ids, null, empty and wordless texts stay; copies do not
            assert left.count(17) == 1 and left.count(None) == 2 and {1, 2, 3, 4, 19, 21} <= set(left) and not {5, 6, 16} & set(left)
        if name == "mixing":
            assert {1, 2, 3} <= set(ids(got)) and ids(got).count(1) == 1


def test_fingerprints_of_ids_beyond_doubles(spark):
    from hashlib import sha256

    from loomtext.llm.fingerprints import edited_fingerprints

    draw = random.Random(7)
    rows = [(draw.choice([-1, 1]) * (2**61 + 997 * k + 1), f"text {k} " * draw.randint(1, 9)) for k in range(300)] + [(2**63 - 1, "the last"), (-(2**63) + 1, "the first")]
    got = edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), ranges=16).collect()
    ordered = sorted(rows)
    want = {k: sha256((t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode()).hexdigest() for (k, t), (_, after) in zip(ordered, ordered[1:] + ordered[:1], strict=True)}
    assert {r.doc_id: r.edited_sha256 for r in got} == want and len(got) == len(rows)
    marks = {r.doc_id: int(r.fingerprint, 16) for r in got}
    near = {k: 1 - (marks[k] ^ marks[n]).bit_count() / 128 for (k, _), (n, _) in zip(ordered, ordered[1:] + ordered[:1], strict=True)}
    assert {r.doc_id: r.near_next for r in got} == near


def test_pipeline_keeps_different_texts_of_one_id(spark):
    import corpus_pipeline

    draw = random.Random(8)
    text = lambda: " ".join("".join(draw.choices("abcdefgh", k=5)) for _ in range(60))
    a, b, c = text(), text(), text()
    rows = [(1, a, "en", "s2", 359), (1, b, "en", "s1", 359), (1, a, "en", "s1", 359), (2, c, "de", "s1", 359), (3, c, "de", "s1", 359), (4, None, "de", "s1", None), (4, None, "de", "s1", None), (None, a, "en", "s1", 359)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(map(tuple, dict(corpus_pipeline.STAGES)["MinHash near-dedup"](spark, docs.repartition(3), "").collect()), key=repr)
    assert got == sorted((rows[k] for k in (1, 2, 3, 5, 7)), key=repr)


def test_wide_urls_keep_all_their_tokens(spark):
    """A rule of two tokens that URLs hold beside twenty of larger share is found; all rules are those of counting every set."""
    draw = random.Random(5)
    rows, bad = [], {}
    for k in range(400):
        kind = k % 8
        pair = ["pp", "qq"] if kind < 2 else ["pp"] if kind == 2 else ["qq"] if kind == 3 else []
        bad[k] = kind < 2 or kind == 4
        # twenty tokens that occur in bad URLs rather, none of them often enough with all others
        noise = [f"n{chr(97 + j)}" for j in range(20) if draw.random() < (0.75 if bad[k] else 0.1)]
        rows.append((k, f"http://t.test/{'/'.join(noise + pair)}"))
    frames = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame([(k, int(not b)) for k, b in bad.items()], "doc_id long, quality int")
    held = {k: {f"path:{w}" for w in u.split("/")[3:] if w} for k, u in rows}
    rate = sum(bad.values()) / len(bad)
    share = lambda items: (sum(bad[k] for k in held if items <= held[k]), sum(items <= held[k] for k in held))
    lower = lambda h, n, z=4.0: (h / n + z * z / (2 * n) - z * (h / n * (1 - h / n) / n + z * z / (4 * n * n)) ** 0.5) / (1 + z * z / n)
    speaks = [w for w in sorted(set().union(*held.values())) if (x := share({w}))[0] >= 5 and x[0] / x[1] > rate]
    sure = {}
    for size in (1, 2):
        for items in map(frozenset, itertools.combinations(speaks, size)):
            h, n = share(items)
            if h >= 5 and h / n >= 0.5 and lower(h, n) > rate:
                sure[items] = h / n
    want = {s for s, c in sure.items() if not any(t < s and sure[t] >= c for t in sure)}
    got = {frozenset(r.tokens) for r in urlrules.mine(*frames, "page_id", "url", "doc_id", "quality", longest=2).collect()}
    assert frozenset(("path:pp", "path:qq")) in want and got == want


@pytest.mark.parametrize("longest", [1, 3, 4])
def test_levels_and_fp_growth_give_the_same_rules(spark, longest):
    draw = random.Random(8)
    words = ["aa", "bb", "cc", "dd", "ee", "ff", "gg"]
    rows, labels = [], []
    for k in range(500):
        path = sorted(draw.sample(words, draw.randint(1, 5)))
        rows.append((k, f"http://h{k % 3}.test/{'/'.join(path)}"))
        labels.append((k, int(not (({"aa", "bb"} <= set(path) or {"cc", "dd", "ee"} <= set(path)) and draw.random() < 0.9))))
    frames = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int")
    one, other = ({(tuple(r.tokens), round(r.confidence, 9)) for r in urlrules.mine(*frames, "page_id", "url", "doc_id", "quality", longest=longest, widest=w, sure=2.0).collect()} for w in (0, 12))
    assert one == other and (longest == 1 or one)
