"""SimHash fingerprints and Hamming search in DataFrame operations only.

A term is a pair of neighbouring words (a last word pairs with nothing). Each occurrence of a term votes with
its 128-bit hash, so a term's weight is its frequency: a bit of the fingerprint is set if more than half of the
votes set it. Two votes share one long, 32 bits each, so 64 sums count 128 bits.

For search, a fingerprint is cut into ``blocks``. Two fingerprints within ``radius`` differ in at most that many
blocks, so they agree on the rest: there is one table for each choice of blocks that stay, keyed by them.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, materialize
from .ranges import LEAST, range_column

_LANE = 0x0000000100000001


def _terms(text: Column) -> Column:
    words = F.filter(F.split(text, SPACE + "+"), lambda w: w != "")
    # the array itself must not occur in the lambda, which would compute it again for every word
    return F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda w, after: F.xxhash64(w, after))


def _lanes(h: Column, name: str) -> list[Column]:
    return [F.sum(F.shiftrightunsigned(h, k).bitwiseAND(F.lit(_LANE))).alias(f"{name}{k}") for k in range(32)]


def _majority(name: str, n: Column) -> Column:
    """The long whose bit is set where more than half of ``n`` votes set it."""
    held = F.array(*(F.col(f"{name}{k}") for k in range(32)))

    def half(pick, at: int) -> Column:
        marks = F.array(*(F.lit(1 << k + at if k + at < 63 else LEAST) for k in range(32)))
        bits = F.zip_with(held, marks, lambda v, m: F.when(pick(v) * 2 > n, m).otherwise(F.lit(0).cast("long")))
        return F.aggregate(bits, F.lit(0).cast("long"), lambda a, v: a.bitwiseOR(v))

    return half(lambda v: v.bitwiseAND(F.lit(0xFFFFFFFF)), 0).bitwiseOR(half(lambda v: F.shiftrightunsigned(v, 32), 32))


def as_hex(a: Column, b: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0")))


def likeness(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Share of bits that two fingerprints have in common."""
    return F.lit(1.0) - (F.bit_count(a1.bitwiseXOR(b1)) + F.bit_count(a2.bitwiseXOR(b2))) / F.lit(128.0)


def fingerprints(texts: DataFrame, keys: list[str], text_cols: list[str]) -> DataFrame:
    """From rows with long columns ``keys`` and texts to one row per key and text column.

    Returns the keys, ``which`` (the number of the text column), ``copies`` (how many rows have these keys), f1 and f2.
    Rows with equal keys must have equal texts. A null text counts as empty; texts without words get the fingerprint 0.
    """
    each = F.inline(F.array(*(F.struct(F.lit(k).alias("which"), _terms(F.coalesce(F.col(c), F.lit(""))).alias("terms")) for k, c in enumerate(text_cols))))
    votes = texts.select(*keys, each).select(*keys, "which", F.posexplode_outer("terms").alias("pos", "h"))
    h2 = F.xxhash64("h")
    summed = votes.withColumn("h2", h2).groupBy(*keys, "which").agg(
        *_lanes(F.col("h"), "x"), *_lanes(F.col("h2"), "y"), F.count("h").alias("n"), F.sum(F.when(F.coalesce("pos", F.lit(0)) == 0, 1).otherwise(0)).alias("copies")
    )
    some = F.col("n") > 0
    return summed.select(*keys, "which", "copies", F.when(some, _majority("x", F.col("n"))).otherwise(0).cast("long").alias("f1"), F.when(some, _majority("y", F.col("n"))).otherwise(0).cast("long").alias("f2"))


def _with_next(df: DataFrame, least: int | None, bounds: list[tuple[int, int]], order: list[str], payload: list[str]) -> DataFrame:
    """``df`` with a struct ``next``: the payload of the next row in the order (whose first two columns are long), after the last the first.

    Rows are dealt into ranges. The first row of each range is found by its bound, which is a key that occurs,
    and is added to the range before as its last row; so no range needs another.
    """
    n = len(bounds) + 1
    dealt = range_column(df.select(*order, *payload), order[0], order[1], bounds, "_range")
    heads = [x for x in {b[0] for b in bounds} | {least} if x is not None]
    # as many values as there are ranges
    first = dealt.where(F.col(order[0]).isin(heads)) if heads else dealt.limit(0)
    first = first.withColumn("_k", F.row_number().over(Window.partitionBy("_range").orderBy(*order))).where("_k = 1").drop("_k")
    first = first.withColumn("_range", F.pmod(F.col("_range") - 1, F.lit(n)))
    both = dealt.withColumn("_end", F.lit(0)).unionByName(first.withColumn("_end", F.lit(1)))
    after = F.lead(F.struct(*order, *payload)).over(Window.partitionBy("_range").orderBy("_end", *order))
    return both.withColumn("next", after).where("_end = 0").drop("_range", "_end")


def _bounds(keys: DataFrame, ranges: int) -> tuple[int | None, list[tuple[int, int]]]:
    """The least id, and ids that occur and cut the order into about equal parts; each opens a range."""
    share = [k / ranges for k in range(1, ranges)]
    cut = keys.agg(F.percentile_approx("_id", F.array(*(F.lit(x) for x in share)), F.lit(10 * ranges)).alias("q"), F.min("_id").alias("least")).first()
    rounded = [(x, LEAST) for x in sorted(set(cut["q"] or []))]
    # percentile_approx works in doubles: beyond 2**53 its ids need not occur; as many rows as there are ranges
    dealt = range_column(keys.withColumn("_th", F.lit(LEAST)), "_id", "_th", rounded, "_range")
    heads = {r["head"] for r in dealt.groupBy("_range").agg(F.min("_id").alias("head")).collect()}
    return cut["least"], [(x, LEAST) for x in sorted(heads - {cut["least"]})]


def _ranges(docs: DataFrame, least: int = 256, most: int = 16_384, size: int = 64 << 20) -> int:
    """Parts of about ``size`` bytes by the planner's estimate."""
    estimate = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(least, min(most, estimate // size))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, a row for each row of ``docs``.

    Returns the id, n_chars, edited_sha256, fingerprint, edited_fingerprint (hexadecimal), near_edited, near_next and the
    fingerprint as two longs, f1 and f2.
    In the edited text the last floor(n_chars / 2) code points give way to the first as many of the next text by
    ascending id (after the last: the first). Null texts count as empty, null ids come first, ties of the id are
    ordered by a hash of the text, and a lone row is its own next. Other columns do not matter. An empty table gives an empty result.
    ``ranges`` is the number of parts that the order is cut into; by default it follows the table's size.
    """
    ranges = ranges or _ranges(docs)
    ident, text = F.col(f"`{id_col}`").cast("long"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(ident, F.lit(LEAST)).alias("_id"), text.alias("_text")).withColumn("_th", F.xxhash64("_text"))
    least, bounds = _bounds(docs.select(F.coalesce(ident, F.lit(LEAST)).alias("_id")), ranges)
    beside = _with_next(rows, least, bounds, ["_id", "_th"], ["_text"])
    size = F.length("_text")
    half = F.floor(size / 2).cast("int")
    edited = F.concat(F.substring(F.col("_text"), F.lit(1), size - half), F.substring(F.col("next._text"), F.lit(1), half))
    beside = beside.select("_id", "_th", F.col("_text"), edited.alias("_edited"), size.alias("_n"), (~((F.col("next._id") == F.col("_id")) & (F.col("next._th") == F.col("_th")))).cast("long").alias("_last"))
    sha = F.sha2("_edited", 256)
    parts = [F.conv(F.substring(sha, 1 + 16 * k, 16), 16, -10).cast("long").alias(f"_s{k}") for k in range(4)]
    held = beside.select("_id", "_th", "_last", F.col("_n").cast("long").alias("_n"), *parts, "_text", "_edited")
    keys = ["_id", "_th", "_last", "_n", "_s0", "_s1", "_s2", "_s3"]
    found = fingerprints(held, keys, ["_text", "_edited"])
    pick = lambda k, c: F.max(F.when(F.col("which") == k, F.col(c))).alias(f"{c}_{k}")
    one = found.groupBy(*keys).agg(pick(0, "f1"), pick(0, "f2"), pick(1, "f1"), pick(1, "f2"), F.max("copies").alias("copies"))
    one = one.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    out = _with_next(materialize(one, "fingerprints"), least, bounds, ["_id", "_th", "_last"], ["_n", "_s0", "_s1", "_s2", "_s3", "f1_0", "f2_0", "f1_1", "f2_1"])
    c = F.col
    return out.select(
        F.when(c("_id") != LEAST, c("_id")).alias(id_col),
        c("_n").alias("n_chars"),
        F.lower(F.concat(*(F.lpad(F.hex(f"_s{k}"), 16, "0") for k in range(4)))).alias("edited_sha256"),
        as_hex(c("f1_0"), c("f2_0")).alias("fingerprint"),
        as_hex(c("f1_1"), c("f2_1")).alias("edited_fingerprint"),
        likeness(c("f1_0"), c("f2_0"), c("f1_1"), c("f2_1")).alias("near_edited"),
        likeness(c("f1_0"), c("f2_0"), c("next.f1_0"), c("next.f2_0")).alias("near_next"),
        c("f1_0").alias("f1"),
        c("f2_0").alias("f2"),
    )


def _tables(df: DataFrame, f1: str, f2: str, blocks: int, radius: int) -> DataFrame:
    """``df`` once for every choice of blocks that stay, with the table's number and a hash of these blocks."""
    width = 128 // blocks
    if 64 % width:
        raise ValueError("blocks must cut each half of a fingerprint evenly")
    cut = [F.shiftrightunsigned(F.col(f1 if k * width < 64 else f2), (k * width) % 64).bitwiseAND(F.lit((1 << width) - 1)) for k in range(blocks)]
    kept = list(combinations(range(blocks), blocks - radius))
    each = F.array(*(F.struct(F.lit(t).alias("t"), F.xxhash64(F.lit(t), *(cut[k] for k in held)).alias("block")) for t, held in enumerate(kept)))
    return df.select("*", F.inline(each))


def search(known: DataFrame, asked: DataFrame, radius: int = 6, blocks: int = 8) -> DataFrame:
    """All fingerprints of ``known`` (f1, f2) within ``radius`` bits of those of ``asked`` (f1, f2): the pairs f1, f2, g1, g2, distance.

    Equal fingerprints are looked up once; the caller joins rows to them. Null fingerprints find nothing.
    """
    if not 0 < radius < blocks:
        raise ValueError("radius must lie between 0 and blocks")
    left = _tables(asked.select("f1", "f2").dropna().distinct(), "f1", "f2", blocks, radius)
    right = _tables(known.select(F.col("f1").alias("g1"), F.col("f2").alias("g2")).dropna().distinct(), "g1", "g2", blocks, radius)
    distance = reduce(lambda a, b: a + b, (F.bit_count(F.col(x).bitwiseXOR(F.col(y))) for x, y in (("f1", "g1"), ("f2", "g2"))))
    return left.join(right, ["t", "block"]).withColumn("distance", distance).where(F.col("distance") <= radius).select("f1", "f2", "g1", "g2", "distance").distinct()


def with_neighbours(prints: DataFrame, asks: Column, radius: int = 3, blocks: int = 4) -> DataFrame:
    """``prints`` (f1, f2, ...) with n_near: how many other rows have a fingerprint within ``radius`` bits, null where ``asks`` does not hold.

    Every row is searched, the rows that ask are the queries; equal fingerprints are looked up once and counted as often as they occur.
    """
    asked = prints.where(asks)
    copies = prints.groupBy(F.col("f1").alias("g1"), F.col("f2").alias("g2")).agg(F.count(F.lit(1)).alias("copies"))
    near = search(prints, asked, radius, blocks).join(copies, ["g1", "g2"]).groupBy("f1", "f2").agg((F.sum("copies") - 1).alias("n_near"))
    return prints.join(near, ["f1", "f2"], "left").withColumn("n_near", F.when(asks, F.col("n_near")))
