"""Queries against their own SQL on rows that the given tables do not have."""

import duckdb

import __spark_entry__ as entry


def both(spark, folder, name, **tables):
    """The sorted rows of a query and those of its SQL over tables given as (schema, rows)."""
    with duckdb.connect() as con:
        for t, (schema, rows) in tables.items():
            spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
        got = entry.queries()[name](spark, str(folder))
        want = con.execute(entry.oracle_sql()[name])
        at = [[d[0] for d in want.description].index(c) for c in got.columns]
        return sorted(map(tuple, got.collect()), key=repr), sorted((tuple(r[k] for k in at) for r in want.fetchall()), key=repr)


PARTS = ("p_partkey long, p_size int", [(k, 1) for k in (*range(1, 41), *range(999_990, 1_000_030), 1_199_999, 1_200_000)])


def test_file_numbers_of_seven_digits_are_none(spark, tmp_path):
    got, want = both(spark, tmp_path, "file_hints", part=PARTS)
    assert got == want and (1_000_001, "") in got and (999_993, "4 K 999993/22") in got and (999_990, "1 K 999990/24") in got


def test_known_sources_of_seven_digits_are_none(spark, tmp_path):
    got, want = both(spark, tmp_path, "known_sources", part=PARTS)
    assert got == want and (1_000_005, False) in got and (5, True) in got


def test_engine_scores_take_years_from_urls_and_know_documents(spark, tmp_path):
    page = lambda k, url, title: (k, url, f"<title>{title}</title>")
    rows = [page(1, "https://a.org/de/1909", ""), page(37, "https://a.org/de/1909", "x"), page(38, "https://a.org/x.PDF", "vom 1.2.2016 und 2020-13-40"), page(39, "https://a.org/2027/2028", None)]
    rows += [(5, None, "<title>der</title>"), (6, "https://a.org/2015", None), page(7, "https://example.net/de/", "Station the la 12.12.1999")]
    got, want = both(spark, tmp_path, "engine_scores", pages=("page_id long, url string, html string", rows))
    assert got == want and len({r[1:] for r in got}) > 5


def test_visible_text_of_all_references(spark, tmp_path):
    texts = ["and&amp</title> x&ampy &lt &AMP;&amp;lt; &amp;amp;", "&#65;&#x42;&#X43 &#0; &#128;&#x9d; &#xD800;&#1114112; &#12345678901; &# &#x; &", "&notit; &notin; &nosuch; &Auml &Auml;&sect3 &NewLine;&Tab;&#39;'", "<!-- &amp; --><p a='&'>&copy&copy;</p>&nbsp;", None, "", "&#10;\n&#160; a"]
    got, want = both(spark, tmp_path, "visible_text", pages=("page_id long, html string", list(enumerate(texts))))
    assert got == want


def test_grouped_documents_keep_every_document(spark, tmp_path):
    rows = [(k, (None, "en", "de", "fr")[k % 4], None if k % 7 == 0 else k * 900) for k in range(40)]
    got, want = both(spark, tmp_path, "grouped_documents", documents=("doc_id long, lang string, n_chars long", rows))
    assert got == want and {r[:2] for r in got} == {(k, lang if lang in ("en", "de") else "other") for k, lang, _ in rows}
