"""Proposals of change to versioned documents: applied if the version is the expected one, else rebased on what the document has become."""

from __future__ import annotations

import copy
import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Refused(ValueError):
    """An operation that the document does not allow."""


def _place(path: str, lists: Sequence[str], scalars: Sequence[str]) -> tuple[str, str | None]:
    field, *rest = [p for p in (path or "").strip("/").split("/") if p]  or [""]
    if field not in lists and field not in scalars:
        raise Refused(f"not an allowed field: /{field}")
    if len(rest) > 1 or (rest and field not in lists):
        raise Refused(f"not a place in /{field}")
    return field, rest[0] if rest else None


def apply_op(content: dict, op: dict, lists: Sequence[str], scalars: Sequence[str]) -> dict:
    """A copy of ``content`` after one operation: append to a list, set a field or a list's item, remove a list's item."""
    field, at = _place(op.get("path"), lists, scalars)
    kind, value, out = op.get("op"), op.get("value"), copy.deepcopy(content)
    held = out.setdefault(field, []) if field in lists else None
    if kind == "append" and held is not None and at in (None, "-"):
        held.append(value)
    elif kind == "set" and at is None:
        out[field] = value
    elif kind in ("set", "remove") and held is not None and at is not None and at.isdigit() and int(at) < len(held):
        held[int(at) : int(at) + 1] = [value] if kind == "set" else []
    else:
        raise Refused(f"{kind} does not apply at {op.get('path')}")
    return out


def _norm(value) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False).casefold().strip() if not isinstance(value, str) else " ".join(value.casefold().split())


def changed(before: dict, after: dict) -> set[str]:
    """Fields whose value differs."""
    return {f for f in {*before, *after} if _norm(before.get(f)) != _norm(after.get(f))}


def rebase(ops: list[dict], content: dict, fields: set[str], lists: Sequence[str], scalars: Sequence[str]) -> list[dict]:
    """The operations that still say something about ``content``.

    Appends of what is there, sets to what is there, sets of ``fields`` that have just changed, and operations that no longer apply go.
    """
    kept = []
    for op in ops:
        field, value = (op.get("path") or "").strip("/").split("/")[0], _norm(op.get("value"))
        there = content.get(field)
        if op.get("op") == "append" and value in {_norm(x) for x in there or []}:
            continue
        if op.get("op") == "set" and (value == _norm(there) or field in fields):
            continue
        try:
            apply_op(content, op, lists, scalars)
        except Refused:
            continue
        kept.append(op)
    return kept


def settle(targets: DataFrame, proposals: DataFrame, key: str, lists: Sequence[str], scalars: Sequence[str]) -> DataFrame:
    """What becomes of the proposals for each target, accepted in their order.

    ``targets`` has (key, version, content), ``proposals`` (key, id, expected, ops), both JSON. The first proposal whose version is the expected one and
    whose operations all apply is accepted and raises the version; the others are rebased on the new content: "pending" with the operations
    that are left, or "superseded" if none are; with another version from the start "mismatch", with an operation that is
    not allowed "refused". Returns (key, id, status, version, content, ops): content of the accepted, ops of the pending ones.
    Targets are dealt by key; a target's proposals are its review queue, a short list.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, version, content, queue in batch.itertuples(index=False, name=None):
                now, v, taken = json.loads(content or "{}"), int(version), None
                for item in sorted(queue, key=lambda p: p["id"]):
                    ops = json.loads(item["ops"] or "[]")
                    if taken is not None:
                        left = rebase(ops, now, taken, lists, scalars)
                        out.append((k, item["id"], "pending" if left else "superseded", v, None, json.dumps(left, sort_keys=True) if left else None))
                        continue
                    if item["expected"] != v:
                        out.append((k, item["id"], "mismatch", v, None, None))
                        continue
                    try:
                        if not ops:
                            raise Refused("nothing to do")
                        new = now
                        for op in ops:
                            new = apply_op(new, op, lists, scalars)
                    except Refused:
                        out.append((k, item["id"], "refused", v, None, None))
                        continue
                    taken, now, v = changed(now, new), new, v + 1
                    out.append((k, item["id"], "accepted", v, json.dumps(new, sort_keys=True, ensure_ascii=False), None))
            yield pd.DataFrame(out, columns=["key", "id", "status", "version", "content", "ops"])

    queue = proposals.groupBy(key).agg(F.collect_list(F.struct("id", "expected", "ops")).alias("queue"))
    both = targets.select(key, "version", "content").join(queue, key)
    kind = targets.schema[key].dataType.simpleString()
    return both.mapInPandas(run, f"key {kind}, id long, status string, version long, content string, ops string").withColumnRenamed("key", key)


def adopt(jobs: DataFrame, artifacts: DataFrame, job: str, attempts: str, most: int = 3) -> DataFrame:
    """``jobs`` with ``next``: "done" where an artifact with the job's id is there already, "failed" after ``most`` attempts, else "run"; and ``artifact``, the first."""
    first = artifacts.withColumn("_n", F.row_number().over(Window.partitionBy(job).orderBy("artifact"))).where("_n = 1").select(job, "artifact")
    return jobs.join(first, job, "left").withColumn("next", F.when(F.col("artifact").isNotNull(), "done").when(F.col(attempts) >= most, "failed").otherwise("run"))


def _value(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))


def new_ops(ops: DataFrame, current: DataFrame, pending: DataFrame, target: str, position: str, protect: bool = False, per_field: int = 3, per_proposal: int = 8) -> DataFrame:
    """Operations (target, position, op, field, value) that say something new, within the limits of a proposal.

    ``current`` and ``pending`` have (target, field, value). An append must have a value that neither of them has; a set must differ from both, and with
    ``protect`` its field must be empty. Of equal ones the first stays, other operations always stay. Then at most ``per_field`` appends a
    field and ``per_proposal`` operations a target are kept, in order. Values are compared in lower case with single blanks.
    """
    there = current.unionByName(pending).select(target, "field", _value(F.col("value")).alias("_v")).distinct().withColumn("_there", F.lit(True))
    filled = current.where(F.trim("value") != "").select(target, "field").distinct().withColumn("_filled", F.lit(True))
    each = ops.withColumn("_v", _value(F.col("value"))).join(there, [target, "field", "_v"], "left").join(filled, [target, "field"], "left")
    free = F.col("op").isin("append", "set")
    said = F.coalesce(F.col("_there"), F.lit(False)) | ((F.col("op") == "append") & (F.col("_v") == ""))
    # a set of nothing over nothing changes nothing
    said = said | ((F.col("op") == "set") & (F.col("_v") == "") & F.col("_filled").isNull())
    if protect:
        said = said | ((F.col("op") == "set") & F.col("_filled").isNotNull())
    first = F.row_number().over(Window.partitionBy(target, "field", "_v", free).orderBy(position))
    fresh = each.where(~free | ~said).withColumn("_k", first).where(~free | (F.col("_k") == 1))
    append = F.col("op") == "append"
    nth = F.row_number().over(Window.partitionBy(target, "field", append).orderBy(position))
    few = fresh.withColumn("_k", nth).where(~append | (F.col("_k") <= per_field))
    kept = few.withColumn("_k", F.row_number().over(Window.partitionBy(target).orderBy(position))).where(F.col("_k") <= per_proposal)
    return kept.select(*ops.columns)
