"""Line dedup over a corpus: sorted hashes are streamed, and keep bitmaps come back instead of text.

Line keys are hashed to 128 bits, dealt out in ranges of (hash, document descending) and sorted by document
and position in each range. One pass over a range sees for every key its largest document first. A key
with enough documents inside its range is settled there; a key that touches an end of a range, where the next
range may hold more of it, is settled by one row that each range says about it: its largest documents there.
Dropped positions are packed to one compressed bitmap per document and joined to the texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrow, words
from .common import Carried, discard, materialize

_NONE = -(2**63)
_BLANK = b" \t\n\x0b\x0c\r"


def line_keys(text: bytes) -> list[bytes]:
    """The key of every line: stripped of ASCII white space at both ends, A-Z lower-cased."""
    return [x.strip(_BLANK) for x in text.translate(words.LOWER).split(b"\n")]


def _lines(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in arrow.parts(batches):
            digests, owner, pos = [], [], []
            for t, text in enumerate(texts):
                for k, key in enumerate(line_keys(text)):
                    # a key of n code points has at least n and at most 4 n bytes
                    if len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least):
                        digests.append(xxhash.xxh3_128_digest(key))
                        owner.append(t)
                        pos.append(k)
            h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            at = pa.array(owner, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), *(batch.column(batch.schema.get_field_index(x)).take(at) for x in ("_id", "_kth")), pa.array(pos, pa.int32())],
                names=["h1", "h2", "_id", "_kth", "pos"],
            )

    return run


def _stream(docs: int):
    """Over rows sorted by (h1, h2, document descending, position): rows to drop (ask false) or to be asked about (ask true).

    A run is one key inside one range. Its first document is its largest, unless it is the range's first run, which
    may have begun in the range before: all its rows are asked about. Of the range's last run the rows of the first
    ``docs`` documents are asked about, as others are surely dropped. For both runs a row without a position
    says in ``tops`` which ``docs`` documents are the largest. Rows are held only until ``docs`` documents of a run are seen.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, begins, top, ids, held, settled = None, False, None, [], [], False

        def rows(part: pa.RecordBatch, ask: bool) -> pa.RecordBatch:
            more = [pa.array(np.full(part.num_rows, ask)), pa.nulls(part.num_rows, pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays([*part.columns, *more], names=[*part.schema.names, "ask", "tops"])

        def summary(like: pa.Schema) -> pa.RecordBatch:
            one = [key[0], key[1], None, 0, -1, True, ids]
            kinds = [*like.types, pa.bool_(), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(one, kinds, strict=True)], names=[*like.names, "ask", "tops"])

        def ids_of(part: pa.RecordBatch) -> np.ndarray:
            return part.column(2).fill_null(_NONE).to_numpy(zero_copy_only=False)

        def feed(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            nonlocal settled, ids
            if len(ids) < docs:
                ids = list(dict.fromkeys([*ids, *ids_of(part).tolist()]))[:docs]
            if begins:
                yield rows(part, True)
            elif settled:
                yield rows(part.filter(pa.array(ids_of(part) != top)), False)
            else:
                held.append(part)
                if len(ids) >= docs:
                    settled = True
                    for x in held:
                        yield rows(x.filter(pa.array(ids_of(x) != top)), False)

        for batch in batches:
            if not batch.num_rows:
                continue
            h = [batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)]
            doc = ids_of(batch)
            new = np.ones(len(doc), bool)
            new[1:] = (h[0][1:] != h[0][:-1]) | (h[1][1:] != h[1][:-1])
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], len(doc))
            lo = 0
            if key == (h[0][0], h[1][0]):  # the open run goes on
                yield from feed(batch.slice(0, ends[0]))
                lo = 1
            if lo == len(starts):
                continue
            only = key is None and len(starts) == 1
            if key is None and len(starts) > 1:  # the range's first run, all of it
                key, begins = (h[0][0], h[1][0]), True
                yield from feed(batch.slice(0, ends[0]))
                lo = 1
            if begins:
                yield summary(batch.schema)
            key = (h[0][-1], h[1][-1])
            inner = slice(lo, len(starts) - 1)
            if lo < len(starts) - 1:
                fresh = new.copy()
                fresh[1:] |= doc[1:] != doc[:-1]
                many = np.add.reduceat(fresh[starts[lo] : ends[-2]].astype(np.int64), starts[inner] - starts[lo]) >= docs
                size = ends[inner] - starts[inner]
                drop = np.repeat(many, size) & (doc[starts[lo] : ends[-2]] != np.repeat(doc[starts[inner]], size))
                yield rows(batch.slice(starts[lo], len(drop)).filter(pa.array(drop)), False)
            begins, top, ids, settled = only, doc[starts[-1]], [], False
            held.clear()
            yield from feed(batch.slice(starts[-1]))
        for x in held:
            yield rows(x, True)
        if key is not None:
            yield summary(batch.schema)

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = []
        for at in batch.column(2):
            at = at.values.to_numpy(zero_copy_only=False)
            keep = np.ones((at.max() // 8 + 1) * 8, np.uint8)
            keep[at] = 0
            packed.append(zlib.compress(np.packbits(keep, bitorder="little").tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["_kid", "_kth", "keep"])


def unpack(bitmap: bytes | None, n_lines: int) -> np.ndarray:
    """Whether each line stays; lines past the end of a bitmap do, and all do without one."""
    keep = np.ones(n_lines, bool)
    if bitmap:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), bitorder="little")[:n_lines]
        keep[: len(bits)] = bits
    return keep


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in arrow.parts(batches):
        kept, total, gone = [], [], []
        for text, bitmap in zip(texts, batch.column(batch.schema.get_field_index("keep")).to_pylist(), strict=True):
            lines = text.split(b"\n")
            stays = unpack(bitmap, len(lines))
            kept.append(text if stays.all() else b"\n".join([lines[k] for k in np.flatnonzero(stays)]))
            total.append(len(lines))
            gone.append(int(len(lines) - stays.sum()))
        own = [n for n in batch.schema.names if n.startswith("_c")]
        more = [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())]
        yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in [*own, "keep"]), *more], names=[*own, "keep_bitmap", "kept_text", "n_lines", "n_dropped"])


def keep_bitmaps(texts: DataFrame, docs: int = 3, least: int = 20) -> DataFrame:
    """From (_id, _kid, _kth, text) to (_kid, _kth, keep) for texts that lose lines: bit k says whether line k stays."""
    lines = materialize(texts.select("_id", "_kth", "text").mapInArrow(_lines(least), "h1 long, h2 long, _id long, _kth long, pos int"), "lines")
    order = ["h1", "h2", F.col("_id").desc_nulls_last(), "pos"]
    told = lines.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_stream(docs), "h1 long, h2 long, _id long, _kth long, pos int, ask boolean, tops array<long>")
    told = materialize(told, "told")
    discard(lines)
    # a row for the first and one for the last key of each range, with at most ``docs`` ids
    ends = told.where("tops is not null").groupBy("h1", "h2").agg(F.array_distinct(F.flatten(F.collect_list("tops"))).alias("tops"))
    ends = ends.where(F.size("tops") >= docs).select("h1", "h2", F.array_max("tops").alias("top"))
    late = told.where("ask and pos >= 0").join(F.broadcast(ends), ["h1", "h2"]).where(F.coalesce("_id", F.lit(_NONE)) != F.col("top"))
    dropped = told.where("not ask").select("_id", "_kth", "pos").union(late.select("_id", "_kth", "pos"))
    by_text = dropped.groupBy(F.coalesce("_id", F.lit(0)).alias("_kid"), "_kth").agg(F.collect_set("pos").alias("at"))
    return by_text.mapInArrow(_pack, "_kid long, _kth long, keep binary")


def dedup_lines(docs_table: DataFrame, id_col: str = "doc_id", text_col: str = "text", docs: int = 3, least: int = 20) -> DataFrame:
    """All columns but the text, then keep_bitmap (null: all lines stay), kept_text, n_lines and n_dropped.

    A text is split at line feeds; a null or empty one is a single empty line. A line's key is the line stripped
    of ASCII white space at both ends with A-Z lower-cased. Keys of at least ``least`` code points that occur
    under at least ``docs`` different ids lose all their lines except those under the largest of these ids. A null
    id counts as one id, the smallest. Rows that share an id keep or lose a key together. Columns that
    are called like a result are replaced by it; an empty table gives an empty result. Keys are
    compared by 128-bit hashes.
    """
    held = Carried(docs_table, id_col, text_col, {text_col, "keep_bitmap", "kept_text", "n_lines", "n_dropped"})
    named = docs_table.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.xxhash64(f"`{id_col}`", f"`{text_col}`").alias("_kth"), F.col(f"`{text_col}`").cast("string").alias("text"))
    joined = held.frame.join(keep_bitmaps(named, docs, least), ["_kid", "_kth"], "left")
    return held.restored(joined.mapInArrow(_apply, held.schema("keep_bitmap binary, kept_text string, n_lines long, n_dropped long")), "keep_bitmap", "kept_text", "n_lines", "n_dropped")
