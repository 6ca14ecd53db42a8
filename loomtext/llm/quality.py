"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled texts train a small network that minimises the non-negative risk of Kiryo et al.
(2017): prior * E_p[l(f)] + max(0, E_u[l(-f)] - prior * E_p[l(-f)]). The class prior is estimated first, as the
least ratio of unlabelled to positive texts above any score of a positive-against-unlabelled model.
Negative labels are not used. Inputs are counts taken from the whole text and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrow, words
from .common import Carried

_upper = np.zeros(256, bool)
_upper[65:91] = True
_lower = np.zeros(256, bool)
_lower[97:123] = True
_digit = np.zeros(256, bool)
_digit[48:58] = True
_mark = np.zeros(256, bool)
_mark[33:127] = True
_mark &= ~(_upper | _lower | _digit)
_MARKS = np.flatnonzero(_mark)


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def features(texts: list[bytes]) -> np.ndarray:
    """A row of numbers for each text, from all of it."""
    n = len(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    joined = np.frombuffer(b"".join(texts), np.uint8)
    owner = np.repeat(np.arange(n), sizes)
    hist = np.bincount(owner * 256 + joined, minlength=n * 256).reshape(n, 256).astype(np.float64)
    hashes, counts = words.word_hashes(texts, lower=True)
    ends = np.cumsum(counts)
    of = np.repeat(np.arange(n), counts)
    pos = words.positions(counts)
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (pos[1:] > 0)
    second = np.zeros(len(hashes), bool)
    second[2:] = (hashes[2:] == hashes[:-2]) & (pos[2:] > 1)
    distinct, pairs, top = np.zeros(n), np.zeros(n), np.zeros(n)
    for k in range(n):
        own = hashes[ends[k] - counts[k] : ends[k]]
        if len(own):
            _, c = np.unique(own, return_counts=True)
            distinct[k], top[k] = len(c), c.max()
            pairs[k] = len(np.unique(own[1:] * words.U(3) + own[:-1])) + 1
    # shares within each line, and their extremes over the lines of a text
    lines = np.array([t.count(b"\n") + 1 for t in texts])
    line_of = np.cumsum(np.concatenate([[0], (joined[:-1] == 10)])) if len(joined) else np.zeros(0, np.int64)
    line_of = line_of + owner if len(joined) else line_of
    total = int(line_of[-1]) + 1 if len(joined) else 0
    length = np.bincount(line_of, minlength=total)
    text_of = np.zeros(total, np.int64)
    text_of[line_of] = owner
    worst = []
    for kind in (_upper, _mark, _digit):
        share = np.where(length >= 20, np.bincount(line_of, weights=kind[joined], minlength=total) / np.maximum(length, 1), 0)
        most = np.zeros(n)
        np.maximum.at(most, text_of, share)
        worst.append(most)
    letters = hist[:, _upper].sum(1) + hist[:, _lower].sum(1) + hist[:, 128:].sum(1)
    parts = [
        np.log1p(sizes), np.log1p(counts), np.log1p(lines), _share(sizes, counts), _share(counts, lines),
        _share(hist[:, _upper].sum(1), letters), _share(hist[:, _digit].sum(1), sizes), _share(hist[:, _mark].sum(1), sizes), _share(hist[:, 128:].sum(1), sizes),
        _share(distinct, counts), _share(distinct, np.sqrt(counts)), _share(pairs, counts), _share(top, counts),
        _share(np.bincount(of, weights=again, minlength=n), counts), _share(np.bincount(of, weights=second, minlength=n), counts), *worst,
    ]
    marks = np.sqrt(hist[:, _MARKS] / np.maximum(sizes, 1)[:, None])
    return np.concatenate([np.stack(parts, 1), marks], 1)


@dataclass
class Model:
    """Standardisation and a network with one hidden layer."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float = 0.5

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -30, 30)))


def nn_risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """Both parts of the non-negative risk of margins under the logistic loss: prior * E_p[l(f)], and E_u[l(-f)] - prior * E_p[l(-f)] before it is cut at 0."""
    loss = lambda v: np.logaddexp(0, -v)
    return float(prior * loss(positive).mean()), float(loss(-unlabelled).mean() - prior * loss(-positive).mean())


def nn_gradient(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> np.ndarray:
    """What to descend along, by margin, positives first: the risk's gradient, or away from a second part that has fallen below 0."""
    p, u = _sigmoid(positive), _sigmoid(unlabelled)
    rest = np.concatenate([-prior * p / len(p), u / len(u)])
    if nn_risk(positive, unlabelled, prior)[1] < 0:  # overfitted: step back from it
        return -rest
    rest[: len(p)] += prior * (p - 1) / len(p)
    return rest


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, hidden: int = 24, epochs: int = 40, seed: int = 3) -> Model:
    """Minimise the non-negative risk with a given prior; without one, the plain risk of telling positive from unlabelled."""
    draw = np.random.default_rng(seed)
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-6
    d = both.shape[1]
    w = [draw.normal(0, 1 / np.sqrt(d), (d, hidden)), np.zeros(hidden), draw.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    m, v, step = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w], 0
    p_all, u_all = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))
    batch = 512
    rounds = max(1, max(len(p_all), len(u_all)) // batch)
    for _ in range(epochs):
        for _ in range(rounds):
            p, u = p_all[draw.integers(len(p_all), size=batch)], u_all[draw.integers(len(u_all), size=batch)]
            x = np.concatenate([p, u])
            h = np.tanh(x @ w[0] + w[1])
            f = h @ w[2] + w[3]
            if prior is None:
                g = np.concatenate([_sigmoid(f[:batch]) - 1, _sigmoid(f[batch:])]) / batch
            else:
                g = nn_gradient(f[:batch], f[batch:], prior)
            back = g[:, None] * w[2] * (1 - h * h)
            grads = [x.T @ back + 1e-4 * w[0], back.sum(0), h.T @ g + 1e-4 * w[2], g.sum(keepdims=True)]
            step += 1
            for k, grad in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                w[k] = w[k] - 0.003 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, w[0], w[1], w[2], float(w[3][0]), prior or 0.5)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, slack: float = 0.25) -> float:
    """Share of positives among unlabelled scores: the least ratio of the two tails, with room for sampling error."""
    cuts = np.quantile(positive, np.linspace(0, 0.9, 91))
    tail = lambda s: 1 - np.searchsorted(np.sort(s), cuts) / len(s)
    error = slack * (np.sqrt(1 / len(positive)) + np.sqrt(1 / len(unlabelled)))
    return float(np.clip(np.min((tail(unlabelled) + error) / tail(positive)), 0.05, 0.95))


_NEUTRAL = Model(np.zeros(1), np.ones(1), np.zeros((1, 1)), np.zeros(1), np.zeros(1), 0.0)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", positives: int = 15_000, unlabelled: int = 25_000, fold: int = 5) -> Model:
    """A model from at most ``positives`` trusted and ``unlabelled`` other texts, drawn by a hash of their id.

    Positives are rows that ``labels`` marks 1 and whose crc32(id as text) modulo ``fold`` is not 0; unlabelled are
    ids without a label. An id with several labels is trusted if one of them is 1. If either is missing, the model gives every text 0.5.
    """
    ident = F.col(f"`{id_col}`").cast("long")
    marks = labels.select(ident.alias("id"), F.col(f"`{label_col}`").alias("y")).where("id is not null").groupBy("id").agg(F.max("y").alias("y"))
    ids = docs.select(ident.alias("id")).where("id is not null").distinct().join(marks, "id", "left")
    learn = F.crc32(F.col("id").cast("string").cast("binary")) % fold != 0
    order = F.xxhash64("id", F.lit(23))
    trusted = ids.where((F.col("y") == 1) & learn).orderBy(order).limit(positives).select("id", F.lit(1).alias("y"))
    other = ids.where(F.col("y").isNull()).orderBy(order).limit(unlabelled).select("id", F.lit(0).alias("y"))
    # at most positives + unlabelled ids
    drawn = docs.select(ident.alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).join(F.broadcast(trusted.union(other)), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in arrow.parts(batches, limit=1 << 20):
            x = features(texts).astype(np.float32)
            at = batch.schema.get_field_index
            yield pa.RecordBatch.from_arrays([batch.column(at("id")), batch.column(at("y")), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "y", "x"])

    got = drawn.mapInArrow(run, "id long, y int, x binary").toArrow().sort_by([("id", "ascending"), ("x", "ascending")])
    y = got.column("y").to_numpy()
    if not len(y) or y.min() == y.max():
        return _NEUTRAL
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float32).reshape(len(y), -1).astype(np.float64)
    p, u = x[y == 1], x[y == 0]
    # half of each finds the prior's model, the other half its scores
    rough = train(p[::2], u[::2], None, epochs=15)
    prior = class_prior(rough.margin(p[1::2] if len(p) > 1 else p), rough.margin(u[1::2] if len(u) > 1 else u))
    return train(p, u, prior)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least: float = 0.3, fold: int = 5) -> DataFrame:
    """All columns of ``docs``, then held_out, score and predicted.

    The score (0 to 1) depends on the whole text only; null texts are scored as empty ones. predicted is 1 from a
    score of ``least``. held_out says that crc32(id as text) modulo ``fold`` is 0 (null ids: false). Repeated rows get equal
    scores. Columns called like a result are replaced by it; an empty table gives an empty result.
    """
    held = Carried(docs, id_col, text_col, {"held_out", "score", "predicted"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in arrow.parts(batches, limit=1 << 20):
            x = features(texts).astype(np.float32).astype(np.float64)
            s = model.score(x if len(model.mean) == x.shape[1] else x[:, :1])
            own = [n for n in batch.schema.names if n.startswith("_c")]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in own), pa.array(s)], names=[*own, "score"])

    out = held.frame.drop("_kid", "_kth").mapInArrow(run, held.schema("score double"))
    own = F.col(held.own[held.names.index(id_col)]).cast("long").cast("string")
    out = out.withColumn("held_out", F.coalesce(F.crc32(own.cast("binary")) % fold == 0, F.lit(False))).withColumn("predicted", (F.col("score") >= least).cast("int"))
    return held.restored(out, "held_out", "score", "predicted")
