"""The training-data pipeline: five stages over ``documents``, each one operator of loomtext.llm.

Every stage takes (spark, docs, sf_dir) and returns a table with the columns of documents (the last adds its own);
what it decides takes effect in its result. ``run`` writes each stage's result to the shared folder and
reads it back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.bpe import encode
from loomtext.llm.common import SPACE, materialize, table
from loomtext.llm.linededup import dedup_lines
from loomtext.llm.minhash import near_duplicates
from loomtext.llm.mixing import mix
from loomtext.llm.quality import fit, score

#: What the operators read; every other column of documents travels under a name that no operator uses.
READ = ("doc_id", "text", "source")


def _held(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.col(f"`{c}`").alias(c if c in READ else f"p{k}") for k, c in enumerate(docs.columns)))


def _restored(df: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``docs`` from a frame of :func:`_held`; with another text, n_chars, where there is one, counts the new one."""
    new = {"text": F.col(text)} | ({"n_chars": F.length(text).cast("long")} if text != "text" else {})
    return df.select(*(new.get(c, F.col(c if c in READ else f"p{k}")).alias(c) for k, c in enumerate(docs.columns)))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it is trained on the labels in ``sf_dir``.

    Null texts are judged as empty ones, repeated rows alike; without labels of both kinds every text scores 0.5 and stays. An
    empty table gives an empty one.
    """
    model = fit(docs, table(spark, sf_dir, "labels"))
    return _restored(score(_held(docs), model).where("predicted = 1"), docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that recur in three or more of them, except in the one of largest id.

    A null text becomes an empty one. Null ids count as one id, the least; repeated rows lose the same lines. An empty table
    gives an empty one.
    """
    return _restored(dedup_lines(_held(docs)), docs, "kept_text")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of least id; all documents without words, with a null text or a null id.

    Of rows equal in id and text one stays, the least in its other columns; different texts under one id are of one
    group and stay where that id is its least. An empty table gives an empty one.
    """
    kept = near_duplicates(_held(docs)).where("kept")
    names = [c if c in READ else f"p{k}" for k, c in enumerate(docs.columns)]
    named = kept.where("doc_id is not null").groupBy("doc_id", F.sha2("text", 256).alias("_text")).agg(F.min(F.struct(*names)).alias("_one")).select("_one.*")
    return _restored(named.unionByName(kept.where("doc_id is null").select(*names)), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the one at a source's cut ends after the words that are left.

    Documents without words, null and empty texts among them, take none of the budget and stay once. A null source is one
    source, the last. Rows equal in id and text at the cut share what is left. An empty table gives an empty one.
    """
    mixed = mix(_held(docs))
    whole = F.array_repeat(F.col("size"), F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(1).cast("int"))
    part = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(0)
    words = F.concat(whole, F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")))
    each = mixed.withColumn("_words", F.explode(words))
    # a text cut after n words: all but what follows them; a leading space makes one more, empty, piece
    pieces = F.split(F.col("text"), SPACE + "+", (F.col("_words") + F.when(F.col("text").rlike("^" + SPACE), 2).otherwise(1)).cast("int"))
    ended = F.regexp_replace(F.substring(F.col("text"), F.lit(1), F.length("text") - F.length(F.element_at(pieces, -1))), SPACE + "+$", "")
    return _restored(each.withColumn("_cut", F.when(F.col("_words") < F.col("size"), ended).otherwise(F.col("text"))), docs, "_cut")


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their token ids (packed little-endian 32-bit integers) and number of tokens in place of the text.

    Null and empty texts have no ids, repeated rows the same. Columns of documents that are called ``ids`` or ``n_tokens`` come
    back as ``documents_ids`` and ``documents_n_tokens``. An empty table gives an empty one.
    """
    import public_tokenizers

    coded = encode(_held(docs), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    own = ("ids", "n_tokens")
    names = [(c if c in READ else f"p{k}", f"documents_{c}" if c in own else c) for k, c in enumerate(docs.columns) if c != "text"]
    return coded.select(*(F.col(a).alias(b) for a, b in names), *own)


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_lines),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte-level BPE", encode_tokens),
]

#: The classifier cannot be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage{k}")
    return docs
