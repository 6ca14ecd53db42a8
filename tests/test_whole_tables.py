"""Registered queries over small tables against plain Python: no row is left out."""

import math
import random
import re
from collections import Counter

import __spark_entry__ as entry


def run(spark, folder, name, **tables):
    """Rows of a query over tables given as (schema, rows), as sorted tuples."""
    for t, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
    return sorted(map(tuple, entry.queries()[name](spark, str(folder)).collect()), key=repr)


def _cosine(a, b):
    dot = lambda x, y: sum(p * q for p, q in zip(x, y, strict=True))
    norm = math.sqrt(dot(a, a)) * math.sqrt(dot(b, b))
    return dot(a, b) / norm if norm > 0 else 0.0


def test_search_asks_with_every_twentieth_vector_and_whole_passages(spark, tmp_path):
    draw = random.Random(1)
    vectors = [(k, [draw.gauss(0, 1) for _ in range(6)], k % 3) for k in range(70)]
    vectors += [(70 + k, vectors[20][1], 1) for k in range(30)] + [(100, [0.0] * 6, 2)]
    tables = {"embeddings": ("vec_id long, embedding array<double>, label int", vectors)}
    of = {k: (v, g) for k, v, g in vectors}
    ranked = {q: sorted(of, key=lambda k: (-_cosine(of[k][0], of[q][0]), k)) for q in range(0, 101, 20)}
    near = lambda q, k: round(_cosine(of[k][0], of[q][0]), 6)
    got = run(spark, tmp_path, "dense_knn", **tables)
    want = [(q, k, r + 1, near(q, k)) for q, ks in ranked.items() for r, k in enumerate(ks[:20])]
    assert [x[:3] for x in got] == [x[:3] for x in sorted(want, key=repr)] and all(abs(a[3] - b[3]) < 2e-6 for a, b in zip(got, sorted(want, key=repr), strict=True))
    few = {q: [k for g in range(3) for k in [x for x in ks if of[x][1] == g][:8]] for q, ks in ranked.items()}
    assert run(spark, tmp_path, "collections_ask") == sorted(((q, k, n + 1) for q, ks in few.items() for n, k in enumerate(ks)), key=repr)
    best = {(q, g): max(near(q, k) for k in of if of[k][1] == g) for q in ranked for g in range(3)}
    assert all(abs(best.pop((q, g)) - s) < 2e-6 for q, g, s in run(spark, tmp_path, "best_chunk_per_label")) and not best
    assert {(q, k) for q, k, _ in run(spark, tmp_path, "blended_relevance")} == {(q, k) for q, ks in ranked.items() for k in ks[:20]}

    words = [f"w{k}" for k in range(60)]
    docs = [(k, " ".join(draw.choices(words, k=draw.randint(5, 60)))) for k in range(60)]
    asked = [(k, " ".join(draw.choices(words, k=30))) for k in range(25)]
    count = {k: Counter(re.findall(r"\w+", t)) for k, t in docs}
    mean = sum(sum(c.values()) for c in count.values()) / len(count)
    df = Counter(w for c in count.values() for w in c)

    def score(q, k):
        c = count[k]
        return round(sum(math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for w in sorted(set(q.split())) if c[w]), 6)

    listed = {q: [k for s, k in sorted((-score(t, k), k) for k in count) if s][:50] for q, t in asked}
    got = run(spark, tmp_path, "sparse_bm25", documents=("doc_id long, text string", docs), benchmark=("item_id long, text string", asked))
    assert got == sorted(((q, k, r + 1) for q, ks in listed.items() for r, k in enumerate(ks[:5])), key=repr)
    fused = run(spark, tmp_path, "rank_fusion")
    for q in {*ranked, *listed}:
        dense, sparse = {k: r + 1 for r, k in enumerate(ranked.get(q, [])[:50])}, {k: r + 1 for r, k in enumerate(listed.get(q, []))}
        total = {k: sum(1 / (60 + x[k]) for x in (dense, sparse) if k in x) for k in {*dense, *sparse}}
        order = sorted(total, key=lambda k: (-round(total[k], 12), dense.get(k, 999), sparse.get(k, 999), k))[:50]
        assert [k for _, k, _ in sorted((r, k, s) for p, k, r, s in fused if p == q)] == order


def test_knn_across_blocks(spark):
    from pyspark.sql import functions as F

    from loomtext.operators import retrieval as R

    draw = random.Random(2)
    rows = [(k, [float(draw.randint(-2, 2)) for _ in range(3 + (k % 7 == 0))] if k % 11 else None, [None, "a", "b"][k % 3]) for k in range(150)]
    df = spark.createDataFrame(rows, "k int, v array<float>, g string")
    asked = df.where("k < 40").select(F.col("k").alias("query_id"), F.col("v").alias("query"))
    plain = df.crossJoin(asked).select("query_id", "k", "g", R.cosine(F.col("v"), F.col("query")).alias("score")).collect()
    for by in (None, "g"):
        got = sorted(tuple(r) for r in R.knn(df, asked, "k", "v", 5, by, sent=900).select("query_id", "k", "score").collect())
        groups = {}
        for r in plain:
            groups.setdefault((r.query_id, r.g if by else None), []).append((-r.score, r.k))
        assert got == sorted((q, k, -s) for (q, _), held in groups.items() for s, k in sorted(held)[:5])


def test_printed_pages_and_semantic_fill_read_all_rows(spark, tmp_path):
    draw = random.Random(3)
    events = [(k, draw.choice([1, 2, 4, 5, 7])) for k in [*range(40), *range(2980, 3100)]]
    want = []
    for user in {u for _, u in events}:
        ids = sorted(k for k, u in events if u == user)
        printed = {n: n + user % 5 - 3 if k % 4 == 0 else 1 for n, k in enumerate(ids, 1) if k % 4 == 0 or (k % 31 == 1 and user % 7 == 0)}
        pairs = list(zip(sorted(printed.items()), sorted(printed.items())[1:], strict=False))
        rises = all(q > p for (_, p), (_, q) in pairs)
        if len(ids) < 3 or len(printed) < 3 or not rises or sum(q - p == m - n for (n, p), (m, q) in pairs) < max(1, len(pairs) // 2):
            want += [(user, n, n) for n in range(1, len(ids) + 1)]
            continue
        taken = set(printed.values())
        for n in range(1, len(ids) + 1):
            folio = printed.get(n)
            if folio is None:
                at = min(printed, key=lambda a: (abs(a - n), a > n))
                folio = printed[at] + n - at
                folio = folio if folio > 0 and folio not in taken else None
                taken.add(folio)
            want.append((user, n, folio))
    assert any(f is None for *_, f in want) and any(u == 7 for u, *_ in want)
    assert run(spark, tmp_path, "printed_pages", events=("event_id long, user_id long", events)) == sorted(want, key=repr)

    import datetime as dt

    lines = [(k, n, draw.randint(1, 4), dt.datetime(1995, 1, 1) + dt.timedelta(k + n)) for k in (1, 7, 399, 400, 401, 9000) for n in range(1, 8)]
    by = {}
    for hit, idx, page, day in lines:
        by.setdefault(page, []).append((hit, idx, str(day.date())))
    want = [(p, min(h)[0], ",".join(str(i) for i, _ in sorted((i, k) for k, i, _ in h)), min(h)[2]) for p, h in by.items()]
    assert run(spark, tmp_path, "semantic_fill", lineitem=("l_orderkey long, l_linenumber int, l_suppkey long, l_shipdate timestamp", lines)) == sorted(want, key=repr)


def test_keywords_and_folded_words_of_every_document(spark, tmp_path):
    from hashlib import md5

    draw = random.Random(4)
    words = ["with", "Straße", "über", "niño", "façade", "école", "ab", "mañana", "Öffnung", "plain", "text", "x1yz", "ÜBEL", "corazón", "garçon"]
    docs = [(k, " ".join(draw.choices(words, k=n)), lang, 0) for k, (lang, n) in enumerate((a, n) for a in ("en", "de", "fr", "es", None) for n in (0, 3, 40, 2000))]
    docs = [(k, t, lang, len(t)) for k, t, lang, _ in docs] + [(90, None, "en", 0), (91, "with " * 900 + "endlich", "en", 4507)]
    tables = {"documents": ("doc_id long, text string, lang string, n_chars long", docs)}
    kept = lambda t: [w for w in re.findall("[a-zäöüß]{4,}", (t or "").lower()) if w not in ("onent", "that", "this", "with")]
    assert run(spark, tmp_path, "keywords", **tables) == sorted(((k, ",".join([*dict.fromkeys(kept(t))][:12])) for k, t, *_ in docs), key=repr)
    folded = lambda t: t.lower().replace("ä", "ae").replace("ö", "oe").replace("ü", "ue").replace("ß", "ss")
    assert run(spark, tmp_path, "folded_words") == sorted(((k, None if t is None else md5(folded(t).encode()).hexdigest()) for k, t, *_ in docs), key=repr)


def test_orders_and_parts_in_whole_tables(spark, tmp_path):
    draw = random.Random(5)
    orders = [(k, draw.choice([3, 299, 300, 301, 5000]), draw.choice("FO"), f"p{k % 20}") for k in range(1, 400)]
    tables = {"orders": ("o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string", orders)}
    want = []
    for k, c, s, _ in orders:
        found = [e for e, c2, s2, _ in orders if s2 == "F" and c2 == c and str(k % 100) in str(e % 100)]
        if s != "F" and found:
            want.append((k, min(found)))
    assert run(spark, tmp_path, "dispatch_evidence", **tables) == sorted(want, key=repr)
    assert run(spark, tmp_path, "case_numbers") == sorted(((k, f"12K{c}/21") for k, c, *_ in orders), key=repr)
    parts = [(k, " ".join(draw.sample(["red", "blue", "small", "ring", "bolt", "wood", "iron", "oak"], 2 if k < 200 else 4))) for k in range(150, 260)]
    hits = {k: sum(t in "red blue small ring bolt" for t in name.split(" ")) for k, name in parts}
    top = sorted((k for k in hits if hits[k]), key=lambda k: (-hits[k], k))[:10]
    got = run(spark, tmp_path, "tag_matches", part=("p_partkey long, p_name string", parts))
    assert got == sorted(((f"p{n}", k, hits[k]) for n in range(20) for k in top), key=repr)


def test_claims_of_every_page_meet_every_page(spark, tmp_path):
    from hashlib import md5

    draw = random.Random(6)
    text = lambda n: " ".join("".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randint(2, 9))) for _ in range(n))[: n * 5]
    docs = [(k, text(n)) for k, n in ((1, 10), (2, 700), (3, 900), (4, 130), (5, 260), (7, 16))] + [(9, None), (10, "")]
    docs.append((6, (docs[1][1][:1200] + docs[2][1][:600]) * 2))  # its pages stand twice
    pages = {k: [t[i : i + 600] for i in range(0, len(t or ""), 600)] for k, t in docs}
    claims = [(k, n, n if k % 3 == 0 else 1, p[19:79]) for k, ps in pages.items() for n, p in enumerate(ps, 1) if len(p) >= 80]
    assert {k for k, *_ in claims} >= {2, 3, 5, 6} and max(n for _, n, *_ in claims) > 3
    status = []
    for k, n, cited, claim in claims:
        at = [m for m, p in enumerate(pages[k], 1) if claim in p]
        status.append((k, n, "verified" if cited in at else "other_page" if len(at) == 1 else "ambiguous" if at else "not_found"))
    assert run(spark, tmp_path, "citation_status", documents=("doc_id long, text string", docs)) == sorted(status, key=repr)
    tally = Counter(s for *_, s in status)
    assert run(spark, tmp_path, "citation_tally") == [(*(tally[x] for x in ("verified", "other_page", "ambiguous", "not_found")), len(claims))]
    share = lambda a, b: round(len({*a.split()} & {*b.split()}) / len({*a.split()}), 6)
    assert run(spark, tmp_path, "token_matches") == sorted(((k, n, m, share(c, p)) for k, n, _, c in claims for m, p in enumerate(pages[k], 1)), key=repr)
    of = dict(docs)
    outcome = lambda t: None if "the" in t and "der" in t else True if "the" in t else False if "der" in t else None
    norm = lambda t: " ".join(t.lower().split())
    assert run(spark, tmp_path, "quoted_sources") == sorted(((k, n, norm(c) in norm(of[k]), outcome(of[k])) for k, n, _, c in claims), key=repr)
    near = lambda t, c: t[max(0, t.find(c) - 75) :][:150]
    assert run(spark, tmp_path, "page_excerpts") == sorted(((k, n, md5((of[k][:350] + near(of[k], c)).encode()).hexdigest()) for k, n, _, c in claims), key=repr)
    from test_claims import norm, plain_window

    from loomtext.operators.claims import STOP

    def resembles(claim, page):
        claim, page = norm(claim), norm(page)
        wanted = {w for w in claim.split() if len(w) >= 4 and w not in STOP}
        return claim in page or (len(wanted & {*page.split()}) >= 0.35 * len(wanted) and plain_window(claim, page) >= 0.72)

    want = {(k, n, m) for k, n, _, c in claims for m, p in enumerate(pages[k], 1) if resembles(c[:30] + "~" + c[31:], p)}
    assert want == set(run(spark, tmp_path, "fuzzy_matches")) and len(want) > 10


def test_pages_of_texts_without_end(spark, tmp_path):
    text = "ab\n😀\r\u2028ü" * 860_000  # over 10,000 pages
    rows = run(spark, tmp_path, "reassembled_chunks", documents=("doc_id long, text string", [(1, text), (2, "short"), (3, None), (4, "")]))
    assert [r[:3] for r in rows] == [(1, -(-len(text) // 600), len(text)), (2, 1, 5)]
    assert len(run(spark, tmp_path, "page_split")) == -(-len(text) // 600) + 1
