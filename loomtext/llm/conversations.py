"""Conversation structure repair: the cheapest edits that make a conversation's roles fit ``(s?(ua)+)?``.

A forward Viterbi pass over four states of the grammar (nothing yet, after the system turn, after a user's, after
an assistant's) carries for each state the least (cost, audit string); every turn is a layer, closed by insertions.
Of two paths of equal cost to one state neither audit is a prefix of the other, since a longer one would hold one more
insertion, so the least string so far stays the least however it goes on.

Turns are dealt by ranges of (conversation, turn), and a task cuts them into segments of at most ``SPAN`` turns. A
segment that does not begin its conversation is solved from each of the four states; folding the segments of
a conversation in order then costs a step a segment. So no task reads all turns of a long conversation for its costs; only writing the
repaired turns does, which streams them in order.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, discard, materialize

#: Turns of a segment.
SPAN = 512
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where a kept turn leads, by state and initial of its role; where any user or assistant turn leads.
_KEPT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
_NEXT = (USER, USER, ASSISTANT, USER)
DELETE, REROLE, INSERT, OPEN = 2, 1, 5, 5
_ROLE = {USER: "user", ASSISTANT: "assistant"}
Layer = list[tuple[int, str] | None]


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role and text of ``turns`` with faults put in by crc32 of ``conv_id:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 takes out ``[.!?]``, 3 repeats the row, 4 makes its role ``user``. Null roles and texts
    become one space, and null ids and turns count as one space in the hash; they stay null in the result.
    """
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.regexp_replace(word("text"), "[.!?]", "")).otherwise(word("text"))
    times = F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).cast("int")
    # each occurrence is made from an array, so that none is dropped by a filter that is evaluated twice
    return turns.select("conv_id", "turn", F.when(fate == 4, "user").otherwise(word("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(1), times)).alias("_n")).drop("_n")


def closed(layer: Layer) -> Layer:
    """A layer with every insertion that can pay; two steps reach every state."""
    for _ in range(2):
        for state in range(4):
            if (held := layer[state]) is not None:
                new = (held[0] + INSERT, held[1] + "I")
                if (old := layer[_NEXT[state]]) is None or new < old:
                    layer[_NEXT[state]] = new
    return layer


def advanced(layer: Layer, initial: str, must_go: bool, unended: bool) -> Layer:
    """The layer after one more turn."""
    new: Layer = [None] * 4

    def offer(state: int, cost: int, audit: str) -> None:
        if (old := new[state]) is None or (cost, audit) < old:
            new[state] = (cost, audit)

    more = OPEN if unended else 0
    for state, held in enumerate(layer):
        if held is None:
            continue
        cost, audit = held
        offer(state, cost + DELETE, audit + "D")
        if not must_go:
            if (to := _KEPT[state].get(initial)) is not None:
                offer(to, cost + more, audit + "K")
            offer(_NEXT[state], cost + REROLE + more, audit + "R")
    return closed(new)


def joined(layer: Layer, steps: list[Layer]) -> Layer:
    """The layer after a segment that is solved from each state."""
    new: Layer = [None] * 4
    for held, step in zip(layer, steps, strict=True):
        for state, more in enumerate(step):
            if held is not None and more is not None:
                both = (held[0] + more[0], held[1] + more[1])
                if (old := new[state]) is None or both < old:
                    new[state] = both
    return new


def _first_layer() -> Layer:
    return closed([(0, ""), None, None, None])


class _Segment:
    """What a run of turns of one conversation adds up to."""

    def __init__(self, fresh: bool):
        self.fresh = fresh
        self.layers = [_first_layer()] if fresh else [[(0, "") if k == s else None for k in range(4)] for s in range(4)]
        self.rows = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.first = self.last = None

    def add(self, turn, initial: str, blank: bool, seen: bool, unended: bool) -> None:
        self.rows += 1
        if self.last is None:
            self.first = initial
        else:
            self.illegal += self.last + initial not in ("su", "ua", "au")
        self.last = initial
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn
        self.blank += blank
        self.duplicate += seen and not blank
        unended = unended and not seen and not blank
        self.truncated += unended
        self.layers = [advanced(x, initial, blank or seen, unended) for x in self.layers]


_COUNTS = ("rows", "blank", "duplicate", "truncated", "illegal", "turns")
_SEGMENT = "part long, number long, fresh boolean, rows long, blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, first string, last string, costs array<long>, audits array<string>"
_AUDIT = "rows long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _typed(conv: T.DataType, more: str) -> T.StructType:
    return T.StructType([T.StructField("conv", conv), *T.StructType.fromDDL(more).fields])


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows of all batches in order, a part of a batch at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            yield from zip(*(part.column(part.schema.get_field_index(n)).to_pylist() for n in names), strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 1024) -> Iterator[pa.RecordBatch]:
    """Batches of ``size`` rows, fewer where they hold over 8 MB of text."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= size or weight > 8 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _segments(schema: T.StructType):
    target = _arrow(schema)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        part, number, conv, held = TaskContext.get().partitionId(), 0, None, None

        def row() -> tuple:
            cells = [x for layer in held.layers for x in layer]
            return (conv, part, number, held.fresh, *(getattr(held, k) for k in _COUNTS), held.low, held.high, held.first, held.last, [-1 if x is None else x[0] for x in cells], [None if x is None else x[1] for x in cells])

        for now, turn, initial, blank, seen, unended in _rows(batches, "conv", "turn", "initial", "blank", "seen", "unended"):
            if held is not None and (now != conv or held.rows >= SPAN):
                yield row()
                number += 1
            if held is None or now != conv:
                # the first conversation of a range may have begun in the one before
                held = _Segment(fresh=held is not None)
            elif held.rows >= SPAN:
                held = _Segment(fresh=False)
            conv = now
            held.add(turn, initial, blank, seen, unended)
        if held is not None:
            yield row()

    return lambda batches: _batches(found(batches), target, 128)


def _folded(schema: T.StructType):
    target = _arrow(schema)
    names = ("conv", "fresh", *_COUNTS, "low", "high", "first", "last", "costs", "audits")

    def audits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        open_, conv, layer, sure, n, low, high, last = False, None, None, None, None, None, None, None

        def row() -> tuple:
            cost, audit = min(x for x in (layer[START], layer[ASSISTANT]) if x is not None)
            gaps = 0 if low is None else high - low + 1 - n["turns"]
            return (conv, n["rows"], gaps, n["blank"], n["duplicate"], n["truncated"], n["illegal"], cost, "".join(sure) + audit)

        for now, fresh, *counts, seg_low, seg_high, first, seg_last, costs, strings in _rows(batches, *names):
            if open_ and now != conv:
                yield row()
            cells = [None if c < 0 else (c, a) for c, a in zip(costs, strings, strict=True)]
            steps = [cells[k : k + 4] for k in range(0, len(cells), 4)]
            if not open_ or now != conv:
                open_, conv, sure, n, low, high = True, now, [], dict.fromkeys(_COUNTS, 0), None, None
                layer = steps[0] if fresh else joined(_first_layer(), steps)
            else:
                layer = joined(layer, steps)
                n["illegal"] += last + first not in ("su", "ua", "au")
            for k, v in zip(_COUNTS, counts, strict=True):
                n[k] += v
            if seg_low is not None:
                n["turns"] -= seg_low == high
                low, high = seg_low if low is None else low, seg_high
            last = seg_last
            # paths soon agree: what all of them begin with is put aside, so that strings stay short
            same = len(os.path.commonprefix([x[1] for x in layer if x is not None]))
            sure.append(next(x[1] for x in layer if x is not None)[:same])
            layer = [None if x is None else (x[0], x[1][same:]) for x in layer]
        if open_:
            yield row()

    return lambda batches: _batches(audits(batches), target, 256)


def _order(text: str) -> list:
    """What orders the turns of a conversation beside ``turn``: role, beginning of the text, a hash of all of it."""
    return [F.substring(text, 1, 32).alias("head"), F.unhex(F.substring(F.sha2(F.col(text), 256), 1, 32)).alias("digest")]


def _turns(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    cells = [F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn")]
    return turns.select(*cells, *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))))


def audit(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each conversation: its id, rows, gaps, blank, duplicate, truncated, illegal, cost and audit.

    Turns stand in the order of ``turn``, nulls first; ties by role, then the first 32 characters of the text, then a hash of
    it. A row's first fault counts: *blank* without a character other than ASCII white space, *duplicate* if an earlier row
    has its role and text, *truncated* if its last such character is none of ``.!?``. *gaps* are the missing numbers between the least and
    largest turn, *illegal* the neighbours whose initials are none of su, ua and au. Keeping a turn costs 0, giving it the role
    user or assistant 1, deleting it 2, which blank and duplicate rows need, inserting an empty turn 5; a truncated turn that stays adds 5. ``audit`` has the
    initials of the cheapest edits in order, of equal costs the string that is least in ASCII.

    Null ids are one conversation. Null roles and texts are one space: the text is blank and the role has to be changed or deleted, like an empty
    one. Repeated rows are duplicates. Other columns are left out. An empty table gives an empty result.
    """
    plain = _turns(turns, conv, turn, role, text)
    rows = plain.select(
        "conv", "turn", "role", *_order("text"), F.monotonically_increasing_id().alias("mid"),
        (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"), (~F.col("text").rlike(rf"[.!?]{SPACE}*\z")).alias("unended"),
    )
    rows = materialize(rows, "turns")
    # the first row of each role and text, by the number it got: the join is on a key without repeats
    firsts = rows.groupBy("conv", "role", "digest").agg(F.min(F.struct("turn", "mid")).alias("one")).select(F.col("one.mid").alias("mid"), F.lit(True).alias("new"))
    flagged = rows.join(firsts, "mid", "left").select("conv", "turn", "role", "head", "digest", "mid", F.substring("role", 1, 1).alias("initial"), "blank", F.col("new").isNull().alias("seen"), "unended")
    order = ["conv", "turn", "role", "head", "digest", "mid"]
    ranged = flagged.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "turn", "initial", "blank", "seen", "unended")
    kind = rows.schema["conv"].dataType
    segments = ranged.mapInArrow(_segments(schema := _typed(kind, _SEGMENT)), schema)
    by_conv = segments.repartition("conv").sortWithinPartitions("conv", "part", "number")
    audits = by_conv.mapInArrow(_folded(schema := _typed(kind, _AUDIT)), schema)
    out = materialize(audits.select(F.col("conv").alias(conv), *audits.columns[1:]), "audits")
    discard(rows)
    return out


def repaired(turns: DataFrame, audits: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The turns that the edits in ``audits`` (of :func:`audit` for the same turns) leave: id, place, role, text and edit (K, R or I).

    Places count from 0. The rows of one conversation follow each other in their order, in one partition. Inserted turns have an empty text.
    """
    plain = _turns(turns, conv, turn, role, text).select("conv", F.lit(1).alias("kind"), "turn", "role", *_order("text"), "text", F.lit(None).cast("string").alias("audit"))
    edits = audits.select(F.col(f"`{conv}`").alias("conv"), F.lit(0).alias("kind"), *(F.lit(None).cast(t).alias(n) for n, t in (("turn", "long"), ("role", "string"), ("head", "string"), ("digest", "binary"), ("text", "string"))), "audit")
    order = ["conv", "kind", "turn", "role", "head", "digest"]
    both = edits.unionByName(plain).repartition("conv").sortWithinPartitions(*order).select("conv", "kind", "role", "text", "audit")
    schema = _typed(plain.schema["conv"].dataType, "place long, role string, text string, edit string")
    target = _arrow(schema)

    def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        conv, audit, at, place, state = None, "", 0, 0, START

        def inserted() -> Iterator[tuple]:
            nonlocal at, place, state
            while at < len(audit) and audit[at] == "I":
                state = _NEXT[state]
                yield conv, place, _ROLE[state], "", "I"
                at, place = at + 1, place + 1

        for now, kind, own_role, own_text, edits in _rows(batches, "conv", "kind", "role", "text", "audit"):
            if kind == 0:
                conv, audit, at, place, state = now, edits, 0, 0, START
            else:
                edit, at = audit[at], at + 1
                if edit == "K":
                    state = _KEPT[state][own_role[:1]]
                    yield now, place, own_role, own_text, "K"
                elif edit == "R":
                    state = _NEXT[state]
                    yield now, place, _ROLE[state], own_text, "R"
                place += edit != "D"
            yield from inserted()

    out = both.mapInArrow(lambda batches: _batches(edited(batches), target), schema)
    return out.select(F.col("conv").alias(conv), "place", "role", "text", "edit")


def digests(turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Id and SHA-256 of the ``role:text`` lines of each conversation in a result of :func:`repaired`, read as it streams by."""
    schema = _typed(turns.schema[conv].dataType, "repaired_sha256 string")
    target = _arrow(schema)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        conv, held = None, None
        for now, role, text in _rows(batches, "conv", "role", "text"):
            if held is None or now != conv:
                if held is not None:
                    yield conv, held.hexdigest()
                conv, held = now, hashlib.sha256()
            else:
                held.update(b"\n")
            held.update(f"{role}:{text}".encode())
        if held is not None:
            yield conv, held.hexdigest()

    out = turns.select(F.col(f"`{conv}`").alias("conv"), "role", "text").mapInArrow(lambda batches: _batches(hashed(batches), target), schema)
    return out.select(F.col("conv").alias(conv), "repaired_sha256")
