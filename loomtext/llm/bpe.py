"""Byte-level BPE encoding and decoding with numpy matrices.

A text is cut by the tokenizer's pattern; pieces are encoded once per batch, however often they occur.
Pieces of similar length are the rows of a padded matrix of token ids. In each round every row merges its
leftmost pair of least rank; ranks of pairs come from an open-addressing table, only the two pairs beside
a merge are looked up again, the row closes its gap, and rows without a pair left are taken out.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from . import arrow
from .common import Carried

_NO = np.int32(2**31 - 1)
#: Longer pieces are merged with a heap: a matrix of them would take time in the square of their length.
WIDEST = 256


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a .tiktoken file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class PairTable:
    """Rank of the token that two neighbouring tokens make, for arrays of pairs."""

    def __init__(self, ranks: dict[bytes, int]):
        found = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                if (a := ranks.get(token[:cut])) is not None and (b := ranks.get(token[cut:])) is not None:
                    found[a << 32 | b] = rank
        self.pairs = found
        bits = max(4, int(len(found) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, _NO, np.int32)
        keys, values = np.fromiter(found, np.int64, len(found)), np.fromiter(found.values(), np.int32, len(found))
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = keys[free]  # of several for a slot, one stays
            won = self.keys[slot] == keys
            self.values[slot[won]] = values[won]
            keys, values, slot = keys[~won], values[~won], (slot[~won] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks, or the largest int where two tokens make none; negative ids are padding."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        out = np.full(keys.shape, _NO, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        keys = keys.reshape(-1)[todo]
        flat, slot = out.reshape(-1), self._slot(keys)
        while len(todo):
            there = self.keys[slot]
            hit = there == keys
            flat[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (there != -1)
            todo, keys, slot = todo[on], keys[on], (slot[on] + 1) & self.mask
        return out


class Codec:
    """Encoder and decoder for one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern)
        self.table = PairTable(ranks)
        self.byte = np.array([ranks[bytes([k])] for k in range(256)], np.int32)
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.cache: dict[str, bytes] = {}

    def _long(self, piece: bytes) -> bytes:
        ids = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        n, pairs = len(ids), self.table.pairs
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, k, ids[k], ids[k + 1]) for k in range(n - 1) if (r := pairs.get(ids[k] << 32 | ids[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, k, a, b = heapq.heappop(heap)
            j = right[k]
            if ids[k] != a or j >= n or ids[j] != b:
                continue
            ids[k], ids[j] = rank, -1
            right[k] = right[j]
            if right[k] < n:
                left[right[k]] = k
            for x, y in ((left[k], k), (k, right[k])):
                if x >= 0 and y < n and (r := pairs.get(ids[x] << 32 | ids[y])) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def _matrix(self, pieces: list[bytes], width: int) -> list[bytes]:
        ids = np.full((len(pieces), width), -1, np.int32)
        lengths = np.array([len(p) for p in pieces])
        ids[np.arange(width) < lengths[:, None]] = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = self.table.rank(ids[:, :-1], ids[:, 1:])
        rows, out, column = np.arange(len(pieces)), [b""] * len(pieces), np.arange(width)
        while len(rows):
            best = ranks.argmin(axis=1)
            value = ranks[np.arange(len(rows)), best]
            done = value == _NO
            if done.any():
                for row, own, n in zip(rows[done].tolist(), ids[done], (ids[done] >= 0).sum(axis=1).tolist(), strict=True):
                    out[row] = own[:n].astype("<u4").tobytes()
                rows, ids, ranks, best, value = rows[~done], ids[~done], ranks[~done], best[~done], value[~done]
                if not len(rows):
                    break
            at = np.arange(len(rows))
            ids[at, best] = value
            move = column + (column > best[:, None])
            move[move == width] = 0
            shifted = np.take_along_axis(ids, move, 1)
            shifted[:, -1] = -1
            ids = shifted
            move = column[:-1] + (column[:-1] >= best[:, None])
            move[move == width - 1] = 0
            ranks = np.take_along_axis(ranks, move, 1)
            ranks[:, -1] = _NO
            for near in (best - 1, best):
                ok = (near >= 0) & (near < width - 1)
                ranks[at[ok], near[ok]] = self.table.rank(ids[at[ok], near[ok]], ids[at[ok], near[ok] + 1])
        return out

    def pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece, packed as little-endian 32-bit integers."""
        out = [b""] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            if (rank := self.ranks.get(piece)) is not None:
                out[k] = rank.to_bytes(4, "little")
            elif len(piece) > WIDEST:
                out[k] = self._long(piece)
            else:
                buckets.setdefault(-(-len(piece) // 4) * 4, []).append(k)
        for width, members in buckets.items():
            step = max(1, (1 << 18) // width)
            for lo in range(0, len(members), step):
                part = members[lo : lo + step]
                for k, ids in zip(part, self._matrix([pieces[k] for k in part], width), strict=True):
                    out[k] = ids
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        cut = [self.split.findall(t) for t in texts]
        new = list(set().union(*cut).difference(self.cache))
        if len(self.cache) + len(new) > 400_000:
            self.cache = {}
            new = list(set().union(*cut))
        self.cache.update(zip(new, self.pieces([p.encode() for p in new]), strict=True))
        return [b"".join(map(self.cache.__getitem__, c)) for c in cut]

    def decode(self, ids: bytes) -> bytes:
        return b"".join([self.tokens[k] for k in np.frombuffer(ids, "<u4").tolist()])


_codecs: dict[int, Codec] = {}


def _codec(shared) -> Codec:
    """One codec for each vocabulary and worker process."""
    if shared.id not in _codecs:
        _codecs.clear()
        _codecs[shared.id] = Codec(*shared.value)
    return _codecs[shared.id]


class _Shared:
    """A broadcast vocabulary with a name that workers can keep a codec under."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        # the ranks are a vocabulary file: its size does not depend on the corpus
        self.broadcast = spark.sparkContext.broadcast((read_ranks(path), pattern))
        self.id = f"{path}:{hash(pattern)}"

    @property
    def value(self):
        return self.broadcast.value


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """All columns of ``docs`` but the text, then ids (packed little-endian 32-bit integers) and n_tokens.

    Each match of ``pattern`` is encoded by itself, special tokens are not looked for. A null or empty text has
    no ids. Repeated rows and null ids are encoded like others. Columns called like a result are replaced by it.
    """
    shared = _Shared(docs.sparkSession, path, pattern)
    held = Carried(docs, id_col, text_col, {text_col, "ids", "n_tokens"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch, texts in arrow.parts(batches, limit=1 << 20):
            ids = codec.encode([t.decode() for t in texts])
            own = [n for n in batch.schema.names if n.startswith("_c")]
            more = [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in own), *more], names=[*own, "ids", "n_tokens"])

    frame = held.frame.drop("_kid", "_kth")
    return held.restored(frame.mapInArrow(run, held.schema("ids binary, n_tokens long")), "ids", "n_tokens")


def decode(encoded: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with a binary column decoded: the bytes that the ids stand for; null ids give none."""
    shared = _Shared(encoded.sparkSession, path, pattern)
    names = [c for c in encoded.columns if c != "decoded"]
    schema = encoded.select(*(f"`{c}`" for c in names)).schema.add("decoded", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch, ids in arrow.parts(batches, text=ids_col, limit=4 << 20):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([codec.decode(x) for x in ids], pa.binary())], names=[*batch.schema.names, "decoded"])

    return encoded.select(*(f"`{c}`" for c in names)).mapInArrow(run, schema)
