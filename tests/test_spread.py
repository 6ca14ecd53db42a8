"""Steps that work long on each row run over several tasks, also where one task reads the whole table."""

from pyspark.sql import functions as F

from loomtext.operators import chunking, claims, inventory, privacy, verification
from loomtext.plans import verify


def tasks(df):
    """How many tasks give rows."""
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def paged(spark):
    """(claims, pages): sixty documents of three pages in one task; claims stand on their first page but for a letter."""
    words = [f"wort{chr(97 + k % 26)}{chr(97 + k // 26)}lang" for k in range(60)]
    pages = [(k, n, " ".join(words[(k + n * 7 + j) % 60] for j in range(20))) for k in range(60) for n in (1, 2, 3)]
    said = [(k, 1, t[:100] + "~" + t[101:200], [1]) for k, n, t in pages if n == 1]
    return spark.createDataFrame(said, "d long, c int, claim string, cited array<int>").coalesce(1), spark.createDataFrame(pages, "d long, p int, t string").coalesce(1)


def test_pages_of_one_row_group(spark, tmp_path):
    spark.createDataFrame([(k, "text " * 300) for k in range(60)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    assert tasks(verify._pages(spark, str(tmp_path))) > 3


def test_resembling_in_several_tasks(spark):
    said, pages = paged(spark)
    found = claims.resembling(said, pages, "d", "c", "p", "claim", "t")
    assert {r.d for r in found.where("p = 1").collect()} == set(range(60)) and tasks(found) > 3


def test_anchored_pairs_in_several_tasks(spark):
    said, pages = paged(spark)
    found = verification.anchored_pairs(said, pages, "d", "c", "p", "claim", "t")
    assert {r.d for r in found.where("p = 1").collect()} == set(range(60)) and tasks(found) > 3


def test_facts_in_several_tasks(spark):
    text = "2024-03-05, am 7. März 2024, 7 March 2024 und 3. Mai, 9.4.2021, 31 Dezember 2022; 99. Juni 2020"
    days = spark.createDataFrame([(text,), (None,)], "t string").select(claims.known_dates(F.col("t")).alias("d")).collect()
    assert sorted(days[0].d) == ["03.05.2020", "03.05.2021", "03.05.2022", "03.05.2024", "05.03.2024", "07.03.2024", "31.12.2022"] and days[1].d == []
    drafts = spark.createDataFrame([(k, "Frist 01.02.2024") for k in range(60)], "k long, draft string").coalesce(1)
    sources = spark.createDataFrame([(k, "am 2. Februar 2024" if k % 2 else "2024-02-01") for k in range(60)], "k long, source string").coalesce(1)
    open_ = claims.unsupported(drafts, sources, "k", "draft", "k", "source")
    assert {r.k for r in open_.collect()} == set(range(1, 60, 2))
    # what patterns find is joined afterwards; both sides are dealt before the search
    assert open_._jdf.queryExecution().toString().count("REPARTITION_BY_NUM") >= 2


def test_finds_in_several_tasks(spark):
    texts = spark.createDataFrame([(k, f"mail a{k}@b.org, geboren am 1.2.1970") for k in range(60)], "k long, t string").coalesce(1)
    for found, kind in ((privacy.recognise(texts, "k", "t"), "email"), (privacy.case_entities(texts, "k", "t"), "birth_date")):
        assert found.where(F.col("type") == kind).count() == 60 and tasks(found) > 3


def test_splits_in_several_tasks(spark):
    texts = spark.createDataFrame([(k, "line\n" * 900) for k in range(60)], "k long, t string").coalesce(1)
    parts = chunking.split_rows(texts, "k", "t", chunking.pack_lines)
    assert parts.select("k").distinct().count() == 60 and tasks(parts) > 3


def test_citations_are_resolved_in_several_tasks(spark):
    cited = spark.createDataFrame([(k, 1, "D1", "", "", None) for k in range(60)], "k long, n int, source_key string, citation string, hint string, pages array<int>").coalesce(1)
    items = spark.createDataFrame([(k, 7, "D1", "Ladung", "akte", "other", 1, 2, [2]) for k in range(60)], "k long, item int, source_key string, label string, category string, role string, page_start int, page_end int, pages array<int>").coalesce(1)
    found = inventory.resolve(cited, items, "k", ["n"])
    assert {(r.k, r.item, r.rule) for r in found.collect()} == {(k, 7, "key") for k in range(60)} and tasks(found) > 3
