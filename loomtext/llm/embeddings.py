"""Near-dedup of vectors: spherical k-means cells, blocked cosine products inside cells.

Centres are fitted on a sample that is bounded; their number grows with the table. Every vector is *at home* in the cell of
its nearest centre and *visits* other cells in which a vector within the threshold may be at home: if x and y are unit
vectors at the threshold's angle or less, y lies on c's side of the border between c and x's home only if x lies no farther
from that border than sin(angle) times the part of y - x that points across it. That part is 1 at worst; in d dimensions
a direction has a part over q with a chance below (1 - q^2)^((d-2)/2). ``miss`` bounds that chance: 0 takes the worst case and is exact.
Of two cells the one of lower number visits the other, so that a pair is compared once.

Angles to the centre say more: members of a cell whose angles add up to the threshold's at most are linked whatever their
directions, so a tight group of copies is counted without a comparison; where angles differ by more than that, nothing is. The
rest is compared in blocks as matrix products. Vectors of different widths are never alike; each width has its own cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialize
from .components import components, runs

_SLACK = 1e-9
#: Rings around a centre: so many inside the threshold's angle, then one for each further such angle; the last is for cells without a centre.
_RINGS, _NOWHERE = 8, 1000


def by_width(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, rows, vectors) of a list column; vectors that are null, empty, zero or not finite are left out."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = pc.fill_null(column.flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    for width in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == width)
        x = flat[(ends[rows] - width)[:, None] + np.arange(width)]
        good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
        if good.any():
            yield width, rows[good], x[good]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of finite, non-zero ``x`` at length one, without overflow on the way."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Unit centres of at most ``k`` cells of the unit vectors ``x``; many cells are fitted in two levels."""
    if k > 256:
        top = spherical_kmeans(x, int(np.sqrt(k)), rounds, seed)
        home = (x @ top.T).argmax(axis=1)
        size = np.bincount(home, minlength=len(top))
        share = np.maximum(1, np.round(k * size / len(x))).astype(int)
        return np.concatenate([spherical_kmeans(x[home == t], int(min(256, share[t])), rounds, seed + 1 + t) for t in range(len(top)) if size[t]])
    draw = np.random.default_rng(seed)
    centres = [x[draw.integers(len(x))]]
    far = 1 - x @ centres[0]
    for _ in range(1, min(k, len(x))):  # k-means++
        p = np.maximum(far, 0) ** 2
        if p.sum() <= 1e-12:
            break
        centres.append(x[draw.choice(len(x), p=p / p.sum())])
        far = np.minimum(far, 1 - x @ centres[-1])
    c = np.array(centres)
    for _ in range(rounds):
        home = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, home, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 0, total / np.maximum(norm, 1e-300), c)
    return c


def crossing(x: np.ndarray, centres: np.ndarray, miss: float) -> float:
    """The part of a direction that points across a border with a chance of ``miss`` at most, for directions spread as those inside the cells."""
    rest = x - centres[(x @ centres.T).argmax(axis=1)]
    spread = rest.T @ rest
    held = (spread * spread).sum()
    d = np.trace(spread) ** 2 / held if held > 0 else 0.0
    return float(np.sqrt(1 - miss ** (2 / (d - 2)))) if miss > 0 and d > 2 else 1.0


def _ring(cosine: np.ndarray, angle: float) -> np.ndarray:
    at = np.arccos(np.clip(cosine, -1, 1)) / angle
    return np.where(at < 1, np.floor(at * _RINGS), _RINGS - 1 + np.floor(at)).astype(np.int32)


def _edge(ring: Column, outer: bool) -> Column:
    """Inner or outer edge of a ring as a multiple of the threshold's angle."""
    k = ring + int(outer)
    edge = F.when(k <= _RINGS, k / F.lit(float(_RINGS))).otherwise(k - _RINGS + 1.0)
    return F.when(ring == _NOWHERE, F.lit(1e9 if outer else 0.0)).otherwise(edge)


def _place(fitted: dict[int, tuple[np.ndarray, float]], threshold: float, kind: type | None = None, chunk: int = 4 << 20):
    """Cells and rings of vectors; with ``kind``, the numbers' type, the vectors as well."""
    angle = float(np.arccos(threshold)) + _SLACK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, h, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2))
            for width, rows, x in by_width(batch.column(3)):
                centres, across = fitted.get(width, (None, 1.0))
                step = len(x) if centres is None else max(1, chunk // len(centres))
                for lo in range(0, len(x), step):
                    part = unit(x[lo : lo + step])
                    if centres is None:  # no vector of this width was sampled
                        row, cell, home = np.arange(len(part)), np.zeros(len(part), np.int64), np.ones(len(part), bool)
                        ring = np.full(len(part), _NOWHERE, np.int32)
                    else:
                        near = part @ centres.T
                        own = near.argmax(axis=1)
                        apart = np.sqrt(np.maximum(0, 2 - 2 * centres[own] @ centres.T))
                        goes = near[np.arange(len(part)), own][:, None] - near <= np.sin(angle) * across * apart + _SLACK
                        goes &= np.arange(len(centres)) > own[:, None]
                        goes[np.arange(len(part)), own] = True
                        row, cell = np.nonzero(goes)
                        home = cell == own[row]
                        ring = _ring(near[row, cell], angle)
                    at = rows[lo + row]
                    columns = {"cell": (cell + (width << 32)).astype(np.int64), "id": ids[at], "h": h[at], "n": n[at], "home": home, "ring": ring}
                    columns = {k: pa.array(v) for k, v in columns.items()}
                    if kind:
                        columns["v"] = pa.array([v.tobytes() for v in x[lo : lo + step].astype(kind)], pa.binary()).take(pa.array(row))
                    yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def linked_roots(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Component labels of the rows and columns of a bipartite graph: each the least row number that links reach."""
    rows, columns = np.arange(linked.shape[0]), np.full(linked.shape[1], linked.shape[0])
    while True:
        new = np.where(linked, rows[:, None], linked.shape[0]).min(axis=0, initial=linked.shape[0])
        again = np.minimum(rows, np.where(linked, new[None, :], linked.shape[0]).min(axis=1, initial=linked.shape[0]))
        if (new == columns).all() and (again == rows).all():
            return rows, columns
        rows, columns = again, new


def _compare(threshold: float, kind: type, chunk: int = 1024):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs(batches, 3):
            ids, h, n, own = (part.column(k).to_numpy() for k in ("id", "h", "n", "own"))
            x = unit(np.frombuffer(b"".join(part.column("v").to_pylist()), kind).reshape(part.num_rows, -1).astype(np.float64))
            i, j = part.column("i")[0].as_py(), part.column("j")[0].as_py()
            a, b = np.flatnonzero(own == i), np.flatnonzero(own == j)
            linked = np.concatenate([x[a[lo : lo + chunk]] @ x[b].T >= threshold for lo in range(0, len(a), chunk)]) if len(a) and len(b) else np.zeros((len(a), len(b)), bool)
            if i == j:
                np.fill_diagonal(linked, False)
            some, other = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
            linked, a, b = linked[np.ix_(some, other)], a[some], b[other]
            # inside one block, a row and a column are the same vector
            from_a, from_b = linked_roots(linked | np.eye(len(a), dtype=bool) if i == j else linked)
            sides = [(a, linked @ n[b], from_a)] + ([] if i == j else [(b, n[a] @ linked, from_b)])
            for side, counts, root in sides:
                if len(side):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[side]), pa.array(h[side]), pa.array(counts.astype(np.int64)), pa.array(ids[a[root]])], names=["id", "h", "n", "root"])

    return run


def _groups(placed: DataFrame, block: int) -> DataFrame:
    """For each (cell, home, ring): its first block and number of blocks, the blocks to compare it with, and what it is linked with for sure.

    A cell has at most two dozen such groups, so their pairs stay few.
    """
    size = placed.groupBy("cell", "home", "ring").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("c"), F.min("id").alias("least"))
    # visitors are compared with residents only, in larger blocks, so that residents are copied less
    size = size.withColumn("blocks", F.ceil(F.col("rows") / F.when(F.col("home"), block).otherwise(4 * block)).cast("int"))
    each = size.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct((~F.col("home")).alias("away"), "ring", "blocks", "c", "least"))).alias("g"))
    first = F.transform("g", lambda x, k: x.withField("first", F.aggregate(F.slice("g", F.lit(1), k), F.lit(0), lambda s, y: s + y["blocks"])))
    each = each.select("cell", first.alias("g"))
    inner, outer = (lambda r: _edge(r, False)), (lambda r: _edge(r, True))

    def others(x: Column, want) -> Column:
        return F.filter("g", lambda y: ~(x["away"] & y["away"]) & want(x, y))

    sure = lambda x, y: outer(x["ring"]) + outer(y["ring"]) <= 1.0
    apart = lambda x, y: F.greatest(inner(x["ring"]) - outer(y["ring"]), inner(y["ring"]) - outer(x["ring"])) > 1.0
    out = each.select("cell", "g", F.explode("g").alias("x"))
    x = F.col("x")
    held = others(x, sure)
    return out.select(
        "cell",
        (~x["away"]).alias("home"),
        x["ring"].alias("ring"),
        x["first"].alias("first"),
        x["blocks"].alias("blocks"),
        F.aggregate(held, F.lit(0).cast("long"), lambda s, y: s + y["c"]).alias("sure"),
        F.array_min(F.transform(F.filter(held, lambda y: ~y["away"]), lambda y: y["least"])).alias("sure_least"),
        (~x["away"] & sure(x, x)).alias("with_own"),
        F.flatten(F.transform(others(x, lambda x, y: ~sure(x, y) & ~apart(x, y)), lambda y: F.sequence(y["first"], y["first"] + y["blocks"] - 1))).alias("meets"),
    )


def fit_cells(drawn: pa.Array, total: int, cell: int, most: int, miss: float) -> dict[int, tuple[np.ndarray, float]]:
    """Per width, centres in number to the share of the sample's vectors that have it, and how far a direction crosses a border."""
    found: dict[int, list[np.ndarray]] = {}
    for width, _, x in by_width(drawn):
        found.setdefault(width, []).append(x)
    out = {}
    for width, parts in found.items():
        x = unit(np.concatenate(parts))
        centres = spherical_kmeans(x, max(1, min(most, round(total * len(x) / len(drawn) / cell))))
        out[width] = centres, crossing(x, centres, miss)
    return out


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, miss: float = 1e-5, cell: int = 2048, most_cells: int = 8192, block: int = 2048
) -> DataFrame:
    """The id, n_links, component_id and kept, a row for each row of ``vectors``.

    Vectors of one width with a cosine of at least ``threshold`` in double precision are linked. n_links counts the other rows
    linked to a row; component_id is the least id that links reach, and kept says whether that is the row's own.
    Vectors that are null, empty, zero, or that hold null or non-finite components link with nothing. Equal vectors are
    compared once and linked with each other. Null ids link with nothing, have a null component_id and are kept; rows
    that share an id are one node. Other columns do not matter; an empty table gives an empty result.

    There is a cell for about ``cell`` vectors, ``most_cells`` at most, and centres are fitted on 16 sampled vectors a cell;
    all vectors are placed and compared. A pair at the threshold on a border is missed with a chance of
    about ``miss``, closer pairs with a far smaller one; with 0 the result is exact and visits more cells.
    """
    if not 0 < threshold < 1:
        raise ValueError("threshold must lie between 0 and 1")
    held = vectors.schema[vector_col].dataType
    kind = np.float32 if isinstance(held, T.ArrayType) and isinstance(held.elementType, T.FloatType) else np.float64
    v = F.col(f"`{vector_col}`").cast("array<float>" if kind is np.float32 else "array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v"))
    rows = rows.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), F.col("v")))
    groups = rows.where("id is not null").groupBy("h1", "h2").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v"))
    groups = materialize(groups, "vectors")
    total = groups.count()
    # a hash picks the sample, so that a rerun fits the same centres; the limit bounds what reaches the driver
    drawn = groups.orderBy("h1", "h2").limit(16 * max(1, min(most_cells, total // cell)) + 64).select("v").toArrow()
    fitted = fit_cells(drawn.column(0).combine_chunks(), total, cell, most_cells, miss) if drawn.num_rows else {}

    kinds = "cell long, id long, h long, n long, home boolean, ring int"
    asked = groups.select("least", "h1", "n", "v")
    placed = materialize(asked.mapInArrow(_place(fitted, threshold), kinds), "placed")
    plan = materialize(_groups(placed, block), "groups")
    key = ["cell", "home", "ring"]
    sure = placed.join(plan.select(*key, "sure", "sure_least", "with_own").where("sure > 0"), key)
    sure = sure.select("id", "h", (F.col("sure") - F.when(F.col("with_own"), F.col("n")).otherwise(0)).alias("n"), F.coalesce("sure_least", "id").alias("root"))
    dealt = asked.mapInArrow(_place(fitted, threshold, kind), f"{kinds}, v binary").join(plan.select(*key, "first", "blocks", "meets").where(F.size("meets") > 0), key)
    dealt = dealt.withColumn("own", F.col("first") + F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("o", F.explode("meets"))
    dealt = dealt.select("cell", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), "own", "id", "h", "n", "v")
    order = ["cell", "i", "j"]
    told = materialize(dealt.repartition(*order).sortWithinPartitions(*order).mapInArrow(_compare(threshold, kind), "id long, h long, n long, root long").union(sure), "told")
    links = components(told.where("id <> root").select(F.col("id").alias("u"), F.col("root").alias("v")).union(_tied(rows, groups)))
    # an id may have several vectors, so a group is named by its least id and a hash
    name = [F.col("id").alias("least"), F.col("h").alias("h1")]
    valid = placed.where("home").select(*name)
    counted = told.groupBy(*name).agg(F.sum("n").alias("others"))
    found = groups.select("least", "h1", "h2", "n").join(valid, ["least", "h1"]).join(counted, ["least", "h1"], "left").join(links.select(F.col("u").alias("least"), F.col("v").alias("comp")), "least", "left")
    found = found.select("h1", "h2", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("comp", "least").alias("comp"))
    # the answers by group are all that is read from here on
    found = materialize(found, "found")
    for used in (groups, placed, plan, told, links):
        discard(used)
    out = rows.drop("v").withColumn("named", F.col("id").isNotNull()).join(found.withColumn("named", F.lit(True)), ["h1", "h2", "named"], "left")
    comp = F.coalesce("comp", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.col("id").eqNullSafe(comp).alias("kept"))


def _tied(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Edges from ids that have several vectors to the groups of these."""
    several = rows.where("id is not null").groupBy("id").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo <> hi").select("id")
    return rows.select("id", "h1", "h2").join(several, "id", "left_semi").join(groups, ["h1", "h2"]).select(F.col("id").alias("u"), F.col("least").alias("v"))
