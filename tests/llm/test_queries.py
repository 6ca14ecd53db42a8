"""The registered queries over whole small tables, their columns and what can be recomputed from the tables alone."""

import hashlib
import os
import zlib
from collections import defaultdict

import pyarrow.parquet as pq
import pytest

from loomtext.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows(name, *columns):
    held = pq.read_table(f"{SF}/{name}.parquet", columns=list(columns))
    return list(zip(*(held[c].to_pylist() for c in columns), strict=True))


def run(spark, name, *columns):
    out = QUERIES[name](spark, SF)
    assert set(columns) <= set(out.columns)
    return [tuple(r) for r in out.select(*columns).collect()]


def test_op1(spark):
    docs = sorted((i, t or "") for i, t in rows("documents", "doc_id", "text"))
    got = {r[0]: r[1:] for r in run(spark, "op1_fingerprints", "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")}
    assert sorted(got) == [i for i, _ in docs]
    prints = defaultdict(set)
    for k, (i, text) in enumerate(docs):
        half = len(text) // 2
        edited = text[: len(text) - half] + docs[(k + 1) % len(docs)][1][:half]
        n, sha, own, _, near, following = got[i]
        assert (n, sha) == (len(text), hashlib.sha256(edited.encode()).hexdigest()) and 0 <= near <= 1 and 0 <= following <= 1
        prints[text].add(own)
    assert all(len(p) == 1 for p in prints.values())


def test_op2(spark):
    docs = {i: (t or "").encode() for i, t in rows("documents", "doc_id", "text")}
    got = run(spark, "op2_sharding", "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    assert sorted(r[0] for r in got) == sorted(docs)
    sums, slots = defaultdict(int), defaultdict(list)
    for i, size, crc, law, shard, slot, grown in got:
        assert (size, crc, law, grown) == (len(docs[i]) + 1, zlib.crc32(docs[i]), "bytes", None)
        sums[shard] += size
        slots[shard].append(slot)
    assert set(sums) <= set(range(8)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    share = sum(sums.values()) / 8
    assert all(abs(sums[k] - share) <= max(len(t) + 1 for t in docs.values()) + 0.001 * share for k in range(8))


def test_op3(spark):
    got = run(spark, "op3_quality_classifier", "doc_id", "held_out", "score", "predicted")
    assert sorted(r[0] for r in got) == sorted(i for (i,) in rows("documents", "doc_id"))
    assert all(held == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= score <= 1 and predicted == (score >= 0.3) for i, held, score, predicted in got)


def test_op4(spark):
    def judged(url):
        host, path = "", ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
            host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
            path = rest[cut:][: min([rest[cut:].index(c) for c in "?#" if c in rest[cut:]], default=len(rest))]
        fits = [(len(h + p), h + p, v) for h, p, v in (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")) if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, max(fits)[1] if fits else None), max(fits)[2] if fits else None

    urls = dict(rows("pages", "page_id", "url"))
    got = {r[0]: r[1:] for r in run(spark, "op4_url_filters", "page_id", "host", "path", "rule", "verdict")}
    assert sorted(got) == sorted(urls)
    for i, url in urls.items():
        want, verdict = judged(url)
        assert got[i][:3] == want and got[i][3] in ("allow", "block") and (verdict is None or got[i][3] == verdict)


def test_op5(spark):
    import base64
    import struct

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r[0]: r[1:] for r in run(spark, "op5_byte_bpe", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")}
    for i, text in rows("documents", "doc_id", "text"):
        ids = own.encode_ordinary(text or "")
        assert got[i] == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())


def test_op11(spark):
    from test_round_three import _plain_alignment

    got = run(spark, "op11_token_alignment", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted(got) == sorted(_plain_alignment(rows("documents", "doc_id", "text")))


@pytest.mark.parametrize("name", ["op6_embedding_near_dedup", "op7_line_dedup", "op8_mixing", "op9_substring_dedup", "op10_minhash_near_dedup", "op12_exact_search", "op13_conversation_repair"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    from loomtext.llm.queries import SQL

    con = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    cursor = con.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    plain = lambda row: tuple(f"{v:.9g}" if isinstance(v, float) else v for v in row)
    want = sorted((plain(r) for r in cursor.fetchall()), key=repr)
    assert sorted((plain(r) for r in run(spark, name, *names)), key=repr) == want and want
