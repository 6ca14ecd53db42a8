"""The sticky schedule against a clock that ticks, and claims found by words and anchors against every pair."""

from __future__ import annotations

import random
import re
from difflib import SequenceMatcher

from loomtext.operators import verification as V
from loomtext.streaming import jobs as J


def ticking(requests, services):
    """A worker second by second: what has arrived waits, a free worker takes its own service first."""
    waiting, todo, out, busy, now, t = [], sorted(requests, key=lambda r: (r[1], r[0])), [], 0, None, min(r[1] for r in requests)
    while todo or waiting:
        while todo and todo[0][1] <= t:
            waiting.append(todo.pop(0))
        while waiting and busy <= t:
            own = [r for r in waiting if r[2] == now]
            one = own[0] if own else min(waiting, key=lambda r: (services.index(r[2]), waiting.index(r)))
            waiting.remove(one)
            out.append((one[0], len(out), t, one[2] != now))
            now, busy = one[2], t + one[3]
        t += 1
    return out


def test_schedule_against_a_clock(spark):
    rng = random.Random(3)
    services = ["ocr", "anon", "tag"]
    rows = [(w, w * 100 + i, rng.randrange(60), rng.choice(services), rng.randrange(9)) for w in range(6) for i in range(25)]
    rows += [(7, 700, 5, "none", 1), (7, 701, None, "ocr", 1), (7, 702, 5, "ocr", None), (None, 703, 5, "ocr", 1)]
    df = spark.createDataFrame(rows, "w int, r int, at int, s string, takes int")
    got = {}
    for x in J.schedule(df, "w", "r", "at", "s", "takes", services).orderBy("w", "turn").collect():
        got.setdefault(x.w, []).append((x.request, x.turn, x.starts, x.switch))
    want = {w: ticking([(r, at, s, n) for k, r, at, s, n in rows if k == w], services) for w in range(6)}
    want[7] = [(702, 0, 5, True)]
    assert got == want
    assert J.schedule(df.limit(0), "w", "r", "at", "s", "takes", services).count() == 0


def test_folds_keep_their_state_between_batches(spark):
    rows = [(k, i) for k in range(2) for i in range(50)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        step = lambda state, row: state.append(row.i) or []
        end = lambda state: [(len(state), sum(state))]
        got = J.folded(spark.createDataFrame(rows, "k int, i int"), "k", ["i"], list, step, end, "n long, total long").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert [tuple(r) for r in got] == [(50, 1225)] * 2


def plain_rule(claim, page):
    norm = lambda s: " ".join(re.sub(r"[\W_]+", " ", (s or "").lower()).split())
    p = norm(page)
    on, words = set(p.split()), {w for w in norm(claim).split() if len(w) >= 5}
    like = lambda w: any(len(x) >= 7 and x[:5] == w[:5] and SequenceMatcher(None, w, x).ratio() >= 0.78 for x in on)
    hit = [w for w in words if w in on or len(w) >= 7 and like(w)]
    hard = [norm(a) for a in dict.fromkeys(a for pat in V.ANCHORS for a in re.findall(pat, claim or ""))]
    if not words or not p:
        return False
    share, n = len(hit) / len(words), len(hit)
    if hard:
        there = sum(a in p for a in hard)
        return there / len(hard) >= 0.67 and n >= 2 and share >= 0.25 or there >= 2 and share >= 0.2
    return n >= 4 and share >= 0.55 or n >= 3 and len(words) <= 8 and share >= 0.38 and any(len(w) >= 12 for w in hit)


def test_anchored_pairs_lose_no_match(spark):
    rng = random.Random(11)
    stock = ["Verfolgung", "Verfolgungen", "Antragsteller", "Antragstellerin", "Glaubhaftmachung", "Syrien", "Syriens", "gericht", "kurz", "am", "12.03.2020", "2019", "3,5", "Widerspruch", "Widersprüche", "Bescheid"]
    text = lambda n: " ".join(rng.choice(stock) for _ in range(n))
    pages = [(d, p, text(rng.randrange(0, 14))) for d in range(8) for p in range(6)] + [(1, 99, None)]
    claims = [(d, c, text(rng.randrange(0, 9))) for d in range(8) for c in range(10)] + [(1, 99, None), (77, 1, "Verfolgung Syrien")]
    got = V.anchored_pairs(spark.createDataFrame(claims, "d int, c int, claim string"), spark.createDataFrame(pages, "d int, p int, page string"), "d", "c", "p", "claim", "page").select("d", "c", "p").collect()
    want = sorted((d, c, p) for d, c, claim in claims for e, p, page in pages if d == e and plain_rule(claim, page))
    assert len(want) > 30 and sorted(tuple(r) for r in got) == want
