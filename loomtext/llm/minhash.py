"""MinHash near-dedup: banded universal hash minima, verified on signatures and then on full shingle sets.

Texts with equal sets are one class, found by a 128-bit digest of the set; only the class's least id goes on.
Large buckets are not expanded into pairs. Every text is first compared with the most central text that it
shares a bucket with (a star), and links are merged to components. Members of one bucket that are still in
different components are then compared with each other: in pairs where the bucket is small, otherwise in
blocks that yield only as many edges as they have members; blocks of one component are not compared. No link between banded candidates is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrow, words
from .common import Carried, discard, materialize
from .components import block_pairs, components, runs, spanning

U = np.uint64
#: Members of a bucket that are expanded into pairs; larger buckets are compared block by block.
_FEW = 4


def _sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and how many each has."""
    h, counts = words.word_hashes(texts, lower=True)
    ends = np.cumsum(counts)
    pos = words.positions(counts)
    starts = np.flatnonzero(pos + k <= np.repeat(counts, counts))
    shingles = words.window_hashes(h, starts, k)
    edge = np.searchsorted(starts, np.concatenate([[0], ends]))
    out = []
    for t, n in enumerate(counts):
        if n >= k:
            out.append(np.unique(shingles[edge[t] : edge[t + 1]]))
        elif n:
            out.append(words.window_hashes(h, ends[t : t + 1] - n, int(n)))
        else:
            out.append(np.empty(0, U))
    return (np.concatenate(out) if out else np.empty(0, U)), np.array([len(x) for x in out], np.int64)


def _family(size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(seed)
    return draw.integers(0, 2**64, size, U) | U(1), draw.integers(0, 2**64, size, U)


def signatures(shingles: np.ndarray, counts: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The least value of each universal hash a * x + b modulo 2**64 over each set, top 32 bits; zeros for empty sets."""
    out = np.zeros((len(counts), len(family[0])), np.uint32)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    first = (np.cumsum(counts) - counts)[full]
    value = np.empty_like(shingles)
    for j, (a, b) in enumerate(zip(*family, strict=True)):
        np.multiply(shingles, a, out=value)
        value += b
        out[full, j] = np.minimum.reduceat(value, first) >> U(32)
    return out


_sketch_schema = "_id long, _kth long, n long, a long, b long, sig binary"


def _sketch(k: int, size: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = _family(size, seed)
        for batch, texts in arrow.parts(batches, limit=1 << 20):
            shingles, counts = _sets(texts, k)
            sig = signatures(shingles, counts, family)
            first = np.minimum(np.cumsum(counts) - counts, max(len(shingles) - 1, 0))
            a = np.add.reduceat(shingles, first) if len(shingles) else np.zeros(len(counts), U)
            b = np.add.reduceat(words.mix(shingles ^ U(0x5851F42D4C957F2D)), first) if len(shingles) else a
            ids = [batch.column(batch.schema.get_field_index(x)) for x in ("_id", "_kth")]
            more = [counts, np.where(counts > 0, a, U(0)).view(np.int64), np.where(counts > 0, b, U(0)).view(np.int64)]
            yield pa.RecordBatch.from_arrays([*ids, *(pa.array(x) for x in more), pa.array([r.tobytes() for r in sig], pa.binary())], names=["_id", "_kth", "n", "a", "b", "sig"])

    return run


def _bands(rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                sig = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint32).reshape(part.num_rows, -1)
                bands = sig.shape[1] // rows
                cut = sig[:, : bands * rows].reshape(-1, rows).astype(U)
                key = words.window_hashes(cut.reshape(-1), np.arange(len(cut)) * rows, rows)
                key = words.mix(key + np.tile(np.arange(1, bands + 1, dtype=U), part.num_rows))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.repeat(part.column(0).to_numpy(), bands))], names=["key", "id"])

    return run


def _agree(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                x, y = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint32).reshape(part.num_rows, -1) for c in (2, 3))
                yield part.select(["u", "v"]).filter(pa.array((x == y).mean(axis=1) >= least))

    return run


def _full_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in arrow.parts(batches, limit=1 << 20):
            shingles, counts = _sets(texts, k)
            ends = np.cumsum(counts)
            packed = [shingles[e - n : e].tobytes() for e, n in zip(ends, counts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("id")), pa.array(packed, pa.binary())], names=["id", "set"])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _blocks(percent: int):
    """Within each pair of blocks, exact sizes of all intersections as products of membership matrices.

    Gives back, for components that links tie together, an edge from each to the least of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs(batches, 3):
            names = part.column("comp").to_numpy()
            sets = [np.frombuffer(x.as_buffer(), U) for chunk in part.column("set").chunks for x in chunk]
            size = np.array([len(x) for x in sets])
            values, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            row = np.repeat(np.arange(len(sets)), size)
            use = times[place] > 1
            row, place = row[use], (np.cumsum(times > 1) - 1)[place[use]]
            order = np.argsort(place, kind="stable")
            row, place = row[order], place[order]
            both = np.zeros((len(sets), len(sets)), np.float32)
            for lo in range(0, int(place[-1]) + 1 if len(place) else 0, 4096):
                a, b = np.searchsorted(place, [lo, lo + 4096])
                held = np.zeros((len(sets), 4096), np.float32)
                held[row[a:b], place[a:b] - lo] = 1
                both += held @ held.T
            both = both.astype(np.int64)
            linked = 100 * both >= percent * (size[:, None] + size[None, :] - both)
            linked |= names[:, None] == names[None, :]
            root = names[spanning(linked)]
            least = np.minimum(names, root)
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(names, root)[names != root]), pa.array(least[names != root])], names=["u", "v"])

    return run


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 75, bands: int = 48, rows: int = 6, seed: int = 17, block: int = 128
) -> DataFrame:
    """All columns of ``docs``, then n_shingles, component_id and kept.

    Words are runs without ASCII white space after lower-casing A-Z. A text's set holds its distinct shingles
    of ``shingle`` words, or its whole word sequence if it has fewer; without words the set is empty and links
    with nothing. Two texts are linked if 100 * |both| >= percent * |either|, judged on full sets of 64-bit
    hashes. component_id is the least id that links reach, and kept says whether that is the row's own.

    Rows with one id are one node. Rows with a null id link with nothing, have a null component_id and are
    kept. Columns of ``docs`` that are called like a result are replaced by it; an empty table gives an empty
    result. Of two texts that are exactly ``percent`` alike, banding misses a share (1 - s**rows)**bands:
    below 1 in 10,000 at 0.75 and the defaults.
    """
    held = Carried(docs, id_col, text_col, {"n_shingles", "component_id", "kept"})
    named = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    keyed = named.withColumn("_kth", F.xxhash64("_id", "text"))
    sketch = materialize(keyed.mapInArrow(_sketch(shingle, bands * rows, seed), _sketch_schema), "sketch")
    classes = materialize(sketch.where("n > 0 and _id is not null").groupBy("a", "b", "n").agg(F.min("_id").alias("id")), "classes")
    same = ["a", "b", "n"]
    firsts = sketch.withColumnRenamed("_id", "id").join(classes, ["a", "b", "n", "id"], "left_semi").dropDuplicates(["a", "b", "n", "id"])
    firsts = materialize(firsts.select("id", "_kth", "sig"), "firsts")

    banded = firsts.select("id", "sig").mapInArrow(_bands(rows), "key long, id long")
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    buckets = materialize(banded.join(shared, "key"), "buckets")

    involved = buckets.select("id").distinct()
    wanted = keyed.withColumnRenamed("_id", "id").join(firsts.select("id", "_kth").join(involved, "id", "left_semi"), ["id", "_kth"], "left_semi")
    sets = materialize(wanted.dropDuplicates(["id", "_kth"]).mapInArrow(_full_sets(shingle), "id long, set binary"), "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Of pairs (u, v), those whose sets are alike."""
        s = firsts.select("id", "sig")
        both = pairs.join(s.select(F.col("id").alias("u"), F.col("sig").alias("x")), "u").join(s.select(F.col("id").alias("v"), F.col("sig").alias("y")), "v")
        # the share of agreeing minima lies within 0.15 of the likeness for all but one pair in 10**8
        likely = both.select("u", "v", "x", "y").mapInArrow(_agree(max(0.0, percent / 100 - 0.15)), "u long, v long")
        full = likely.join(sets.select(F.col("id").alias("u"), F.col("set").alias("x")), "u").join(sets.select(F.col("id").alias("v"), F.col("set").alias("y")), "v")
        return full.select("u", "v", "x", "y").mapInArrow(_confirm(percent), "u long, v long").distinct()

    # first each text with the most central text that it shares a bucket with: that links most of a group of copies
    central = buckets.groupBy("id").agg(F.sum("c").alias("w"))
    heads = buckets.join(central, "id").groupBy("key").agg(F.max(F.struct("w", (-F.col("id")).alias("id"))).alias("head"))
    star = buckets.join(heads, "key").groupBy("id").agg(F.max("head").alias("head")).select(F.col("id").alias("u"), (-F.col("head.id")).alias("v")).where("u <> v")
    # ids with several texts: each of their classes is tied to the id
    several = sketch.where("n > 0 and _id is not null").groupBy("_id").agg(F.min("a").alias("lo"), F.max("a").alias("hi")).where("lo <> hi").select("_id")
    tied = sketch.join(several, "_id", "left_semi").where("n > 0").join(classes, same).select(F.col("_id").alias("u"), F.col("id").alias("v"))
    links = components(confirmed(star).union(tied))

    # then members of one bucket that are in different components: the rest of the candidates
    member = buckets.join(links.select(F.col("u").alias("id"), F.col("v").alias("comp")), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    mixed = member.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("id").alias("least")).where("lo <> hi").select("key", "least")
    member = materialize(member.join(mixed, "key"), "mixed")
    few = member.where(F.col("c") <= _FEW)
    other = few.select("key", F.col("id").alias("v"), F.col("comp").alias("other"))
    rest = few.join(other, "key").where("id > v and comp <> other").select(F.col("id").alias("u"), "v").distinct()
    # large buckets: texts that they tie together are compared block by block
    many = member.where(F.col("c") > _FEW)
    cells = components(many.select(F.col("id").alias("u"), F.col("least").alias("v")))
    placed = many.select("id", "comp").distinct().join(cells.select(F.col("u").alias("id"), F.col("v").alias("cell")), "id", "left").withColumn("cell", F.coalesce("cell", "id"))
    dealt = block_pairs(placed, "cell", "comp", "id", block).join(sets, "id").select("cell", "_i", "_j", "_b", "id", "comp", "set")
    order = ["cell", "_i", "_j"]
    within = dealt.repartition(*order).sortWithinPartitions(*order).mapInArrow(_blocks(percent), "u long, v long")
    found = materialize(confirmed(rest).union(within), "found")
    if not found.isEmpty():
        held_links, links = links, components(links.union(found))
        discard(held_links)

    named = classes.join(links.select(F.col("u").alias("id"), F.col("v").alias("comp")), "id", "left").select(*same, F.coalesce("comp", "id").alias("comp"))
    light = sketch.select(F.coalesce("_id", F.lit(0)).alias("_kid"), "_kth", *same, F.col("_id").isNull().alias("nameless")).distinct()
    found = light.join(named.withColumn("nameless", F.lit(False)), [*same, "nameless"], "left").select("_kid", "_kth", F.col("n").alias("n_shingles"), "comp")
    frame = held.frame.drop("text")
    out = frame.join(found, ["_kid", "_kth"], "left")
    ident = F.col(held.own[held.names.index(id_col)])
    # a row without a link may share its id with one that has some
    return held.restored(
        out.withColumn("component_id", F.coalesce("comp", ident)).withColumn("kept", ident.eqNullSafe(F.col("component_id"))), "n_shingles", "component_id", "kept"
    )

