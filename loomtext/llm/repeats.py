"""Substring dedup: remove every word inside a window of words that starts more than once.

A *window* is ``length`` consecutive words of one text. A window repeats if the same word sequence
starts anywhere else, in the same text or another. Two equal windows need not be aligned, so windows
are found by a difference cover: with the perfect difference set D modulo v, any two positions i and j
have a shift d < v for which both i + d and j + d lie on the cover. Anchors of ``length - v + 1`` words
are hashed on cover positions only, so a repeated window always holds an anchor that repeats too. The
windows around repeated anchors are then hashed in full and judged: the extension.

No pair of places is ever formed. Occurrences are counted by hash; what repeats within one batch is
known there, and only one row of it goes on to be counted, so that a frequent passage reaches the
exchange once per batch and not once per occurrence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import arrow, words
from .common import Carried, materialize

#: A perfect difference set: every residue modulo 21 is a difference of two members.
PERIOD, COVER = 21, (0, 1, 6, 8, 18)
_places = "h long, salt int, _kid long, _kth long, pos int, known boolean"
#: Of the second half of a window's hash.
_BASE = 0xD6E8FEB86659FD93
_kept = "kept_text string, n_words long, n_removed long"


def _emit(hashes: list[np.ndarray], owner: np.ndarray, pos: np.ndarray, kid: np.ndarray, kth: np.ndarray) -> pa.RecordBatch:
    """Rows for places, in their order; of equal hashes (one or two numbers each), all are known to repeat and all but one get a salt.

    In the order of the texts neighbouring rows share their keys, which the exchange compresses.
    """
    order = np.lexsort(hashes[::-1])
    new = np.ones(len(pos), bool)
    new[1:] = np.logical_or.reduce([x[order[1:]] != x[order[:-1]] for x in hashes])
    size = np.diff(np.flatnonzero(new), append=len(pos))
    first, known = np.empty(len(pos), bool), np.empty(len(pos), bool)
    first[order], known[order] = new, np.repeat(size > 1, size)
    # the salt only spreads rows that are decided: it follows from the row, so that a rerun gives the same
    salt = np.where(first, 0, 1 + (kth[owner] & 0x3FFF)).astype(np.int32)
    h, *more = (x.view(np.int64) for x in hashes)
    names = ["h", "salt", "_kid", "_kth", "pos", "known", "g"][: 6 + len(more)]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (h, salt, kid[owner], kth[owner], pos.astype(np.int32), known, *more)], names=names)


def _keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(batch.column(batch.schema.get_field_index(x)).to_numpy(zero_copy_only=False) for x in ("_kid", "_kth"))


def _anchors(length: int):
    span = length - PERIOD + 1
    on_cover = np.zeros(PERIOD, bool)
    on_cover[list(COVER)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in arrow.parts(batches, limit=4 << 20):
            h, counts = words.word_hashes(texts)
            pos = words.positions(counts)
            at = np.flatnonzero(on_cover[pos % PERIOD] & (np.repeat(np.where(counts >= length, counts, 0), counts) >= pos + span))
            yield _emit([words.window_hashes(h, at, span)], np.repeat(np.arange(len(texts)), counts)[at], pos[at], *_keys(batch))

    return run


def _windows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in arrow.parts(batches, limit=4 << 20):
            h, counts = words.word_hashes(texts)
            ends = np.cumsum(counts)
            found = batch.column(batch.schema.get_field_index("at"))
            owner = np.repeat(np.arange(len(texts)), np.diff(found.offsets.to_numpy()))
            anchor = found.flatten().to_numpy(zero_copy_only=False) + (ends - counts)[owner]
            # mark the starts from PERIOD - 1 words before an anchor up to the anchor
            edge = np.zeros(len(h) + 1, np.int32)
            np.add.at(edge, np.maximum(anchor - PERIOD + 1, (ends - counts)[owner]), 1)
            np.add.at(edge, anchor + 1, -1)
            pos = words.positions(counts)
            at = np.flatnonzero((np.cumsum(edge[:-1]) > 0) & (pos + length <= np.repeat(counts, counts)))
            yield _emit([words.window_hashes(h, at, length), words.window_hashes(h, at, length, _BASE)], np.repeat(np.arange(len(texts)), counts)[at], pos[at], *_keys(batch))

    return run


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in arrow.parts(batches):
            kept, total, removed = [], [], []
            for text, starts in zip(texts, batch.column(batch.schema.get_field_index("at")).to_pylist(), strict=True):
                held = text.split()
                total.append(len(held))
                if starts:
                    edge = np.zeros(len(held) + 1, np.int32)
                    starts = np.asarray(starts)
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, starts + length, -1)
                    held = [held[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
                kept.append(b" ".join(held))
                removed.append(total[-1] - len(held))
            own = [n for n in batch.schema.names if n.startswith("_c")]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in own), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64())], names=[*own, "kept_text", "n_words", "n_removed"])

    return run


def _repeated(places: DataFrame, *names: str) -> DataFrame:
    """Per row of the input, the positions whose hash (``names``) occurs more than once."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*names, "salt"))
    return places.withColumn("n", n).where("known or n > 1").groupBy("_kid", "_kth").agg(F.collect_list("pos").alias("at"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 35) -> DataFrame:
    """All columns of ``docs`` but the text, then kept_text, n_words and n_removed.

    Words are maximal runs without ASCII white space, kept unchanged and joined by one space. Windows are
    judged on the input. A null or empty text has no words and an empty kept_text; texts of fewer than
    ``length`` words lose nothing. Rows that repeat (equal id and text) count as separate texts, so their
    windows repeat and all of them lose those words. Null ids are allowed. Columns of ``docs`` that are
    called like a result are replaced by it. An empty table gives an empty result.

    Two windows count as equal when their 128-bit hashes over 64-bit word hashes agree; anchors have 64 bits, as they only choose
    the windows to judge.
    """
    if length <= PERIOD:
        raise ValueError(f"length must be over {PERIOD}")
    held = Carried(docs, id_col, text_col, {text_col, "kept_text", "n_words", "n_removed"})
    texts = held.frame.select("_kid", "_kth", "text")
    anchors = materialize(_repeated(texts.mapInArrow(_anchors(length), _places), "h"), "anchors")
    # with all columns, so that both joins read one exchange of the texts
    windows = _repeated(held.frame.join(anchors, ["_kid", "_kth"]).mapInArrow(_windows(length), f"{_places}, g long"), "h", "g")
    cut = held.frame.join(windows, ["_kid", "_kth"], "left").mapInArrow(_cut(length), held.schema(_kept))
    return held.restored(cut, "kept_text", "n_words", "n_removed")
