"""Alignment of two tokenizers' tokens over the same texts, as a relational job over distinct pieces of text.

A text is cut where neither tokenizer can join what stands on the two sides: before a space or line break that follows a character
other than white space. Such pieces recur, so each different piece of the corpus is tokenized and aligned once:
tokens are exploded with their positions, windows add up their lengths, an outer equi-join on (piece, end) puts the ends of
both tokenizers in one order, a running count of common ends numbers the groups, and the token of either side that covers
a stretch between two ends is the next one that ends at or after it, which gives every link by a window instead of a join of ranges.

Texts keep their pieces as numbers into the dictionary of a block of some megabytes of text, so what travels is a row for
each different piece of a block, not one for each occurrence or token.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import arrow
from .common import discard, materialize, setting

#: Bytes of text of a block; occurrences of pieces that are counted at once; parts of the blocks that are worked on one after the other, so
#: that the dictionaries of all blocks are never on disk together: for alignments, and for the counts of pairs, which are smaller.
BLOCK, AT_ONCE, ROUNDS = 28 << 20, 1 << 17, (4, 2)
_SPACE = "▁"
_cut = "block long, row int, id string, size int, seq binary, number int, piece string"
_tokenized = "piece string, good boolean, a array<int>, a_len array<int>, b array<int>, b_len array<int>"


class Tokenizers:
    """Both tokenizers: a byte-level one from a .json file (A) and a piece model with byte fallback (B)."""

    def __init__(self, byte_level: str, pieces: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        # the byte-level alphabet: printable Latin-1 characters stand for themselves, the others follow from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [k for k in range(256) if k not in plain]
        byte = {chr(k): k for k in plain} | {chr(256 + n): k for n, k in enumerate(others)}
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, k in self.a.get_vocab().items():
            self.a_bytes[k] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        names = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(_SPACE, " ").encode() for k, p in enumerate(names)]
        self.space = self.b.piece_to_id(_SPACE)
        self.lengths = tuple(np.array([len(x) for x in side], np.int32) for side in (self.a_bytes, self.b_bytes))
        shown = [p for k, p in enumerate(names) if not self.b.is_control(k) and not self.b.is_byte(k)]
        self.breaks = self._breaks(shown)

    def _breaks(self, shown: list[str]) -> str:
        """Characters before which a text may be cut: B has no piece that goes on with one; A's pattern ends there for any white space."""
        return "".join(c for c, own in ((" ", _SPACE), ("\n", "\n")) if not any(re.search(f"[^{own}]{own}", p) for p in shown))

    def encode(self, pieces: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both for pieces that begin with a space or line break, each by itself."""
        a = [x.ids for x in self.a.encode_batch(pieces, add_special_tokens=False)]
        # B puts a space before what it is given
        b = self.b.encode([p[1:] if p[:1] == " " else p for p in pieces], num_threads=1)
        return a, [[self.space] if p == " " else x if p[:1] == " " else x[1:] for p, x in zip(pieces, b, strict=True)]

    def run_of(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both for pieces that can follow each other, as one text; none if that text is not given back byte for byte."""
        whole = b"".join(pieces)
        text = whole.decode()
        a = np.array(self.a.encode(text, add_special_tokens=False).ids, np.int32)
        b = np.array(self.b.encode(text[1:]), np.int32)
        same = b"".join([self.a_bytes[k] for k in a.tolist()]) == whole == b"".join([self.b_bytes[k] for k in b.tolist()])
        return (a, b) if same else None


_loaded: dict[tuple[str, str], Tokenizers] = {}


def _tokenizers(paths: tuple[str, str]) -> Tokenizers:
    """One pair for each worker process."""
    if paths not in _loaded:
        _loaded.clear()
        _loaded[paths] = Tokenizers(*paths)
    return _loaded[paths]


def _cutter(breaks: str):
    """A function that cuts a text before each of ``breaks`` that follows another character than white space."""
    slow = re.compile(rf"(?<=[^\s{_SPACE}])(?=[{breaks}])").split
    held = re.compile(rf"(?<=[\s{_SPACE}])\0").sub
    odd = re.compile(rf"[\s{_SPACE}][{breaks}]").search

    def cut(text: str) -> list[str]:
        if "\0" in text:
            return slow(text)
        marked = text
        for c in breaks:
            marked = marked.replace(c, "\0" + c)
        return (held("", marked) if odd(text) else marked).split("\0")[1:]

    return cut if breaks else lambda text: [text]


def _pieces(paths: tuple[str, str]):
    """Blocks of texts as numbers of pieces, each block with its dictionary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = _cutter(_tokenizers(paths).breaks)
        part, block, weight = TaskContext.get().partitionId(), 0, 0
        names = ["block", "row", "id", "size", "seq", "number", "piece"]
        types = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.int32(), pa.string()]

        def fresh() -> defaultdict[str, int]:
            numbers: defaultdict[str, int] = defaultdict()
            numbers.default_factory = numbers.__len__
            return numbers

        def rows() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(held), 2048):
                some = held[at : at + 2048]
                cells = [[part << 32 | block] * len(some), range(at, at + len(some)), *zip(*some, strict=True)]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cells, types, strict=False)), pa.nulls(len(some), types[5]), pa.nulls(len(some), types[6])], names=names)
            words = list(numbers)
            for at in range(0, len(words), 50_000):
                some = words[at : at + 50_000]
                n = len(some)
                yield pa.RecordBatch.from_arrays([pa.array([part << 32 | block] * n, types[0]), *(pa.nulls(n, t) for t in types[1:5]), pa.array(range(at, at + n), types[5]), pa.array(some, types[6])], names=names)

        numbers, held = fresh(), []
        for batch, texts in arrow.parts(batches, limit=1 << 20):
            for id_, text in zip(batch.column(batch.schema.get_field_index("id")).to_pylist(), texts, strict=True):
                seq = np.fromiter(map(numbers.__getitem__, cut(" " + text.decode())), "<i4") if text else np.empty(0, "<i4")
                held.append((id_, len(seq), pa.compress(seq.tobytes(), "zstd", asbytes=True)))
                weight += len(text) + 64
                if weight >= BLOCK:
                    yield from rows()
                    block, weight, numbers, held = block + 1, 0, fresh(), []
        if held:
            yield from rows()

    return run


def _follows(piece: bytes) -> bool:
    """Whether another piece can stand behind this one without being joined to it."""
    return not piece.decode()[-1:].isspace() and not piece.endswith(_SPACE.encode())


def _offsets(piece_ends: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray | None:
    """Where each piece's tokens end, if no token stands in two pieces."""
    ends = np.cumsum(lengths[ids], dtype=np.int64)
    at = np.searchsorted(ends, piece_ends)
    return at + 1 if len(ends) and at[-1] < len(ends) and (ends[at] == piece_ends).all() else None


def _encoded(paths: tuple[str, str]):
    names = ["piece", "good", "a", "a_len", "b", "b_len"]

    def row_lists(offsets: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> list[pa.Array]:
        where = pa.array(np.concatenate([[0], offsets]).astype(np.int32))
        return [pa.ListArray.from_arrays(where, pa.array(x.astype(np.int32))) for x in (ids, lengths[ids])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _tokenizers(paths)

        def together(pieces: list[bytes]) -> pa.RecordBatch | None:
            ends = np.cumsum([len(p) for p in pieces])
            if (sides := both.run_of(pieces)) is None:
                return None
            offsets = [_offsets(ends, ids, n) for ids, n in zip(sides, both.lengths, strict=True)]
            if any(x is None for x in offsets):
                return None
            lists = [x for o, ids, n in zip(offsets, sides, both.lengths, strict=True) for x in row_lists(o, ids, n)]
            return pa.RecordBatch.from_arrays([pa.array([p.decode() for p in pieces]), pa.array([True] * len(pieces)), *lists], names=names)

        def singly(pieces: list[bytes]) -> pa.RecordBatch:
            good, columns = [], ([], [], [], [])
            for text, x, y in zip(pieces, *both.encode([p.decode() for p in pieces]), strict=True):
                good.append(b"".join([both.a_bytes[k] for k in x]) == text == b"".join([both.b_bytes[k] for k in y]))
                cells = (x, both.lengths[0][x].tolist(), y, both.lengths[1][y].tolist()) if good[-1] else ([], [], [], [])
                for column, value in zip(columns, cells, strict=True):
                    column.append(value)
            return pa.RecordBatch.from_arrays([pa.array([p.decode() for p in pieces]), pa.array(good), *(pa.array(c, pa.list_(pa.int32())) for c in columns)], names=names)

        for _, texts in arrow.parts(batches, text="piece", limit=1 << 16):
            # pieces that begin with a space and end with a character are encoded as one text, which gives the same tokens
            run = [t for t in texts if t[:1] == b" " and _follows(t)]
            rest = [t for t in texts if not (t[:1] == b" " and _follows(t))]
            if run:
                yield together(run) or singly(run)
            if rest:
                yield singly(rest)

    return run


def aligned(tokenized: DataFrame) -> DataFrame:
    """cid, n_a, n_b, n_groups, groups and links of rows with cid, a, a_len, b and b_len: ids and lengths in bytes of the tokens of one piece.

    ``groups`` is ``a1,a2|b1;a3|b2``, cut wherever tokens of both end; ``links`` has a number a * 2**32 + b for each pair of token
    occurrences that share bytes. Rows without tokens are left out.
    """
    dealt = tokenized.repartition("cid")

    def ends(side: str) -> DataFrame:
        tokens = dealt.select("cid", F.posexplode(F.arrays_zip(F.col(side).alias("id"), F.col(f"{side}_len").alias("n"))).alias("pos", "t"))
        until = F.sum("t.n").over(Window.partitionBy("cid").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
        return tokens.select("cid", until.alias("end"), F.col("t.id").alias(side))

    # from the last end backwards: a token covers what lies before its end, up to the next one of its side
    back = Window.partitionBy("cid").orderBy(F.desc("end")).rowsBetween(Window.unboundedPreceding, 0)
    covers = lambda side: F.last(side, ignorenulls=True).over(back)
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    stretches = ends("a").join(ends("b"), ["cid", "end"], "full").select("cid", "end", "a", "b", F.sum(both.cast("int")).over(back).alias("back"), (F.shiftleft(covers("a").cast("long"), 32) + covers("b")).alias("link"))

    # one row for each piece: its stretches in order, told apart by the number of the group, which counts from the back
    rows = F.array_sort(F.collect_list(F.struct("end", "back", "a", "b", "link")))
    pieces = stretches.groupBy("cid").agg(F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.max("back").cast("long").alias("n_groups"), rows.alias("rows"))

    def side(c: str, number: int):
        own = F.filter("rows", lambda x: x[c].isNotNull())
        return F.transform(own, lambda x: F.struct((-x["back"]).alias("group"), F.lit(number).alias("side"), x["end"].alias("end"), x[c].alias("id")))

    # the tokens of a group, those of A first; what parts two neighbours follows from where they differ
    tokens = pieces.select("cid", "n_a", "n_b", "n_groups", F.transform("rows", lambda x: x["link"]).alias("links"), F.array_sort(F.concat(side("a", 0), side("b", 1))).alias("tokens"))

    def written(x, k):
        before = F.get("tokens", k - 1)
        parted = F.when(k == 0, "").when(before["group"] != x["group"], ";").when(before["side"] != x["side"], "|").otherwise(",")
        return F.concat(parted, x["id"].cast("string"))

    return tokens.select("cid", "n_a", "n_b", "n_groups", F.array_join(F.transform("tokens", written), "").alias("groups"), "links")


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().to_numpy(zero_copy_only=False)


def _numbers(left: pa.Table) -> list[bytes]:
    """The numbers of the pieces of each text, four bytes each."""
    return [pa.decompress(x, 4 * n, "zstd", asbytes=True) if n else b"" for x, n in zip(left.column("seq").to_pylist(), left.column("size").to_pylist(), strict=True)]


def _slices(seqs: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``AT_ONCE`` occurrences of pieces, one text at least."""
    lo = total = 0
    for k, seq in enumerate(seqs):
        if k > lo and total + len(seq) > 4 * AT_ONCE:
            yield lo, k
            lo, total = k, 0
        total += len(seq)
    if lo < len(seqs):
        yield lo, len(seqs)


def _gathered(seqs: list[bytes], lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the pieces of some texts, and the text of each."""
    seq = np.frombuffer(b"".join(seqs[lo:hi]), "<i4")
    return seq, np.repeat(np.arange(hi - lo), [len(s) // 4 for s in seqs[lo:hi]])


_FIRST = "block long, row int, id string, n_a long, n_b long, n_groups long, n_links long, good boolean, groups_sha256 string, link long, docs long"
_first = pa.schema([("block", pa.int64()), ("row", pa.int32()), ("id", pa.string()), *((n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")), ("good", pa.bool_()), ("groups_sha256", pa.string()), ("link", pa.int64()), ("docs", pa.int64())])


def _texts(left: pa.Table, right: pa.Table) -> pa.Table:
    """Of one block: a row for each text with its sums, and one for each pair of ids with the number of texts that hold it."""
    left = left.sort_by("row")
    seqs = _numbers(left)
    # rows of pieces in the order of their numbers; what they hold stays where it is
    order = np.argsort(_column(right, "number"), kind="stable")
    sums = [_column(right, c)[order] for c in ("n_a", "n_b", "n_groups")]
    links = right.column("links").combine_chunks()
    flat, width = links.flatten().to_numpy(), np.diff(links.offsets.to_numpy()).astype(np.int64)
    pairs, number = np.unique(flat, return_inverse=True)
    starts, width = (np.cumsum(width) - width)[order], width[order]
    held = right.column("groups").to_pylist()
    good, group = _column(right, "good").astype(bool)[order], [held[k] for k in order.tolist()].__getitem__
    docs, out, digest = np.zeros(len(pairs), np.int64), np.zeros((4, len(seqs)), np.int64), []
    fine = np.ones(len(seqs), bool)
    for lo, hi in _slices(seqs):
        seq, text = _gathered(seqs, lo, hi)
        fine[lo:hi] = np.bincount(text, ~good[seq], hi - lo) == 0
        for k, values in enumerate((*sums, width)):
            out[k, lo:hi] = np.bincount(text, values[seq], hi - lo).astype(np.int64) * fine[lo:hi]
        # each piece once for a text, then each pair
        once = np.unique(text[fine[lo + text]] * np.int64(len(width)) + seq[fine[lo + text]])
        owner, piece = once // max(1, len(width)), once % max(1, len(width))
        n = width[piece]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[piece], n)
        there = np.unique(np.repeat(owner, n) * np.int64(max(1, len(pairs))) + number[at]) % max(1, len(pairs))
        docs += np.bincount(there, minlength=len(pairs)).astype(np.int64)
        for k in range(lo, hi):
            own = np.frombuffer(seqs[k], "<i4").tolist() if fine[k] else []
            digest.append(hashlib.sha256(";".join(map(group, own)).encode()).hexdigest() if own else "")
    n, some = len(seqs), np.flatnonzero(docs)
    block = left.column("block").combine_chunks()
    per_text = [block, left.column("row").combine_chunks(), left.column("id").combine_chunks(), *(pa.array(x) for x in out), pa.array(fine), pa.array(digest, pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())]
    per_pair = [*(pa.nulls(len(some), f.type) for f in list(_first)[:9]), pa.array(pairs[some]), pa.array(docs[some])]
    return pa.concat_tables([pa.Table.from_arrays(x, schema=_first) for x in (per_text, per_pair)])


_second = pa.schema([("block", pa.int64()), ("row", pa.int32()), ("n_best", pa.int64()), ("count_sum", pa.int64())])


def _counted(left: pa.Table, right: pa.Table) -> pa.Table:
    """Of one block: for each text the sums of what its pieces count."""
    left = left.sort_by("row")
    seqs = _numbers(left)
    order = np.argsort(_column(right, "number"), kind="stable")
    values = [_column(right, c)[order] for c in ("n_best", "count_sum")]
    out = np.zeros((2, len(seqs)), np.int64)
    for lo, hi in _slices(seqs):
        seq = np.frombuffer(b"".join(seqs[lo:hi]), "<i4")
        n = np.array([len(s) // 4 for s in seqs[lo:hi]])
        full = np.flatnonzero(n)  # sums of neighbours, exact in 64 bits
        if len(full):
            for k in range(2):
                out[k, lo + full] = np.add.reduceat(values[k][seq], (np.cumsum(n) - n)[full])
    return pa.Table.from_arrays([left.column("block").combine_chunks(), left.column("row").combine_chunks(), *(pa.array(x) for x in out)], schema=_second)


def align(docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each text: its id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    A (a byte-level tokenizer's file) encodes a space and the text, B (a piece model) the text, to which it adds the space; special tokens are plain text.
    Tokens of both are cut into groups wherever both end; a link is a pair of tokens, one of each, that share bytes. A pair of ids counts as often as
    texts of the table hold it linked. ``n_best`` are the links whose pair has the largest count of its A id, ties included; ``count_sum`` adds up the
    counts of all links. ``groups_sha256`` is of ``a1,a2|b1;a3|b2``. Texts that are null or empty or hold what one of the two does not give back byte for byte
    have no tokens: zeros and an empty string. Repeated rows and rows that share an id are texts of their own; null ids stay.
    Other columns are left out. An empty table gives an empty result.
    """
    with setting(docs.sparkSession, "spark.sql.parquet.compression.codec", "zstd"):
        return _aligned_texts(docs, (byte_level, pieces), id_col, text_col)


def _aligned_texts(docs: DataFrame, paths: tuple[str, str], id_col: str, text_col: str) -> DataFrame:
    id_type = docs.schema[id_col].dataType
    given = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    cut = materialize(given.mapInArrow(_pieces(paths), _cut), "pieces")
    texts, held = cut.where("row is not null").select("block", "row", "id", "size", "seq"), cut.where("piece is not null").select(F.col("block").alias("home"), "number", "piece")
    tokenized = held.select("piece").distinct().mapInArrow(_encoded(paths), _tokenized)
    tokenized = materialize(tokenized.select(F.monotonically_increasing_id().alias("cid"), "*"), "tokens")
    # a text's pieces are good or bad each by itself: what A and B give back differs only in length where they are bad
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    pieces_ = tokenized.select("cid", "piece", "good").join(aligned(tokenized.select("cid", "a", "a_len", "b", "b_len")), "cid", "left")
    # both sides of the join by ends are dealt by piece already
    with setting(docs.sparkSession, "spark.sql.requireAllClusterKeysForCoPartition", "false"):
        pieces_ = materialize(pieces_.select("cid", "piece", "good", zero("n_a"), zero("n_b"), zero("n_groups"), F.coalesce("groups", F.lit("")).alias("groups"), F.coalesce("links", F.array().cast("array<bigint>")).alias("links")), "aligned")
    discard(tokenized)

    def by_block(values: DataFrame, more: list[str], run, schema: str, rounds: int) -> DataFrame:
        """``run`` for the texts of each block and the rows of ``values`` for its pieces."""
        done = []
        for k in range(rounds):
            of = lambda c: F.pmod(F.xxhash64(c), F.lit(rounds)) == k  # noqa: B023, E731
            known = held.where(of("home")).join(values, "piece").drop("piece")
            done.append(materialize(texts.select("block", "row", "size", "seq", *more).where(of("block")).groupBy("block").cogroup(known.groupBy("home")).applyInArrow(run, schema), "sums"))
        return reduce(DataFrame.unionByName, done)

    first = by_block(pieces_.drop("cid"), ["id"], _texts, _FIRST, ROUNDS[0])
    counts = first.where("link is not null").groupBy("link").agg(F.sum("docs").alias("n"))
    best = F.max("n").over(Window.partitionBy(F.shiftright("link", 32)))  # at most the ids of B beside each id of A
    counts = materialize(counts.select("link", "n", (F.col("n") == best).cast("long").alias("best")), "counts")
    links = pieces_.select("cid", F.explode("links").alias("link")).join(counts, "link").groupBy("cid").agg(F.sum("best").alias("n_best"), F.sum("n").alias("count_sum"))
    valued = materialize(pieces_.select("cid", "piece").join(links, "cid", "left").select("piece", zero("n_best"), zero("count_sum")), "valued")
    discard(pieces_)
    second = by_block(valued, [], _counted, "block long, row int, n_best long, count_sum long", ROUNDS[1])
    done = first.where("row is not null").drop("link", "docs").join(second, ["block", "row"])
    only_good = lambda c: F.when(F.col("good"), F.col(c)).otherwise(0).cast("long").alias(c)
    return done.select(F.col("id").cast(id_type).alias(id_col), "n_a", "n_b", "n_groups", "n_links", only_good("n_best"), only_good("count_sum"), "groups_sha256")
