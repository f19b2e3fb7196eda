"""First crossings, censored medians, volume axes and refills against loops over all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import depth, trades
from tidemark.plans.crossing import first_crossing
from tidemark.plans.survival import censored_median


@pytest.mark.parametrize("width", [7, 60, 1000])
def test_first_crossing(spark, width):
    rng = random.Random(width)
    events = [(i, rng.choice(["hot"] * 8 + ["a", None]), a, a + rng.choice([0, 3, 60]), rng.randrange(-20, 20), rng.choice([1, -1])) for i, a in enumerate(rng.randrange(-30, 400) for _ in range(200))] + [(900, "hot", None, 4, 1, 1), (901, "hot", 3, 60, None, 1)]
    states = [(rng.choice(["hot"] * 8 + ["a", None]), rng.randrange(-30, 450), rng.choice([None, rng.randrange(-25, 25)])) for _ in range(500)]
    ef, sf = spark.createDataFrame(events, "i long, k string, a long, b long, level long, sign int"), spark.createDataFrame(states, "k string, t long, v long")
    out = first_crossing(ef, sf, ["k"], name="i", at="a", until="b", level=F.col("level"), sign=F.col("sign"), state_at="t", value=F.col("v"), width=width)
    want = {}
    for i, k, a, b, level, sign in events:
        if None not in (k, a, level):
            hits = [t for k2, t, v in states if k2 == k and v is not None and a < t <= b and sign * v >= sign * level]
            if hits:
                want[i] = min(hits)
    assert {r.id: r.crossed_us for r in out.collect()} == want and len(want) > 40
    both = first_crossing(ef.withColumn("k2", F.lit(1)), sf.withColumn("k2", F.lit(1)), ["k", "k2"], name="i", at="a", until="b", level=F.col("level"), sign=F.col("sign"), state_at="t", value=F.col("v"), width=width)
    assert {r.id: r.crossed_us for r in both.collect()} == want
    assert first_crossing(ef.limit(0), sf, ["k"], name="i", at="a", until="b", level=F.col("level"), sign=F.col("sign"), state_at="t", value=F.col("v"), width=width).count() == 0


def product_limit(rows):
    alive, least, median = 1.0, 1.0, None
    for t in sorted({t for t, _ in rows}):
        risk = sum(1 for x, _ in rows if x >= t)
        alive *= 1 - sum(1 for x, o in rows if x == t and o) / risk
        least = round(alive, 12)
        median = t if median is None and least <= 0.5 else median
    return median if least < 0.5 else None


@pytest.mark.parametrize("width", [3, 1000])
def test_censored_medians(spark, width):
    rng = random.Random(width)
    rows = [(k, rng.randrange(40), rng.random() < share) for k, share, n in (("half", 0.5, 200), ("most", 0.9, 81), ("few", 0.2, 50), (None, 0.8, 30), ("none", 0, 9), ("all", 2, 1)) for _ in range(n)]
    # all censored at one time, half and one more than half
    rows += [("even", t, True) for t in (5, 1, 9)] + [("even", 20, False)] * 3 + [("odd", t, True) for t in (5, 1, 9, 2)] + [("odd", 20, False)] * 3
    got = {r.k: (r.n, r.censored, r.m) for r in censored_median(spark.createDataFrame([*rows, ("even", None, True)], "k string, t long, o boolean"), ["k"], "t", "o", "m", width).collect()}
    for key in {r[0] for r in rows}:
        own = [(t, o) for k, t, o in rows if k == key]
        assert got[key] == (len(own), sum(not o for _, o in own), product_limit(own))
    assert got["even"][2] is None and got["odd"][2] == 9


def test_queues_of_both_sides(spark):
    rng = random.Random(4)
    quotes = [(i, rng.choice(["hot"] * 6 + ["a"]), rng.randrange(2000), rng.choice([0, 1000, 1000, 2000]), rng.choice([1000, 3000]), rng.randrange(9), rng.randrange(1, 9)) for i in range(60)]
    prints = [(i, rng.choice(["hot"] * 6 + ["a"]), rng.randrange(2000), rng.choice(["yes", "no", ""]), rng.randrange(4), rng.choice([1000, 2000, 7000, 9000])) for i in range(400)]
    orders = [(i, rng.choice(["hot"] * 6 + ["a", "none"]), rng.randrange(2000)) for i in range(150)]
    got = {(r.order_id, r.side): (r.price, r.queue, r.end_us, r.fill_us) for r in trades.queue_clear(
        spark.createDataFrame(orders, "order_id long, ticker string, at_us long"), spark.createDataFrame(quotes, "id long, ticker string, us long, yes_bid long, no_bid long, yes_size long, no_size long"),
        spark.createDataFrame(prints, "id long, ticker string, us long, taker_side string, units long, yes_price long"), 300).collect()}
    want = {}
    for o, ticker, at in orders:
        own = sorted((q[2], q[0], q) for q in quotes if q[1] == ticker)
        now = [q for us, _, q in own if us <= at]
        if not now or min(now[-1][3:]) <= 0:
            continue
        for side, bid, size in (("yes", 3, 5), ("no", 4, 6)):
            price, queue = now[-1][bid], now[-1][size]
            changes = [own[i][0] for i in range(len(own)) if own[i][0] > at and (i == 0 or own[i][2][bid] != own[i - 1][2][bid])]
            end = min([at + 300, *changes])
            gone, fill = 0, None
            for us, _, units in sorted((p[2], p[0], p[4]) for p in prints if p[1] == ticker and p[3] == ("no" if side == "yes" else "yes") and (p[5] if side == "yes" else 10_000 - p[5]) == price and at <= p[2] <= end):
                gone += units
                if gone > queue:
                    fill = us
                    break
            want[o, side] = (price, queue, end, fill)
    assert got == want and sum(w[3] is not None for w in want.values()) > 10


def test_refills_with_half_censored(spark):
    quotes = [(1, "a", 0, 1000, 2000, 100, 50), (2, "a", 10, 1000, 2000, 20, 50), (3, "a", 25, 1000, 2000, 60, 50), (4, "a", 100, 1000, 2000, 60, 9), (5, "a", 140, 1000, 2000, 60, 8), (6, "a", 900, 1000, 2000, 1, 1), (7, "b", 50, 1000, 2000, 5, 5)]
    prints = [(11, "a", 5, 1000), (12, "a", 6, 1000), (13, "a", 30, 8000), (14, "a", 105, 5000), (15, "b", 20, 1000), (16, "b", 60, 1000), (17, "a", 150, 1000), (18, "a", 950, 1000)]
    qf, pf = spark.createDataFrame(quotes, "id long, ticker string, us long, yes_bid long, no_bid long, yes_size long, no_size long"), spark.createDataFrame(prints, "id long, ticker string, us long, yes_price long")
    closes, shut = spark.createDataFrame([("a", 200), ("b", 900)], "ticker string, close_us long"), spark.createDataFrame([(145, 146)], "start_us long, end_us long")
    found = depth.replenishment(pf, qf, closes, shut, 60)
    got = {(r.ticker, r.state_us): (r.status, r.print_id, r.side, r.before, r.after, r.depleted, r.refill_us) for r in found.collect()}
    assert got == {
        ("a", 0): ("matched", 11, "yes", 100, 20, True, 20), ("a", 25): ("matched", 13, "no", 50, 9, True, None), ("a", 100): ("no_match", None, None, None, None, False, None),
        ("b", None): ("no_pre_state", None, None, None, None, False, None), ("b", 50): ("no_post_state", 16, "yes", None, None, False, None),
        ("a", 140): ("past_close", 17, "yes", None, None, False, None), ("a", 900): ("no_post_state", 18, "yes", None, None, False, None),
    }
    late = {(r.ticker, r.state_us): r.status for r in depth.replenishment(pf, qf, closes.withColumn("close_us", F.lit(5000)), shut, 60).collect()}
    assert late["a", 140] == "screened" and late["a", 25] == "matched"
    out = {(r.scope, r.city): r for r in depth.replenishment_readout(found, spark.createDataFrame([("a", "X")], "ticker string, city string"), 60).collect()}
    whole = out["all", "*"]
    assert (whole.groups, whole.matched, whole.events, whole.refilled, whole.fraction, whole.median_us) == (7, 2, 2, 1, 0.5, None)
    assert out["cell", None].no_pre_state == 1 and out["cell", "X"].past_close == 1


def test_a_state_of_thirty_hours_counts_whole(spark):
    hour = 3_600_000_000
    quotes = spark.createDataFrame([(1, "a", 0, 10, 10, 5), (2, "a", 30 * hour, 10, 10, 7), (3, "a", 31 * hour, 10, 0, 7)], "id long, ticker string, us long, yes_bid long, no_bid long, yes_size long")
    cells = depth.depth_cells(quotes)
    assert cells.agg(F.sum("held_us")).first()[0] == 31 * hour
    shut = spark.createDataFrame([(2 * hour + 5, 2 * hour + 6), (30 * hour, 30 * hour)], "start_us long, end_us long")
    assert depth.depth_cells(quotes, shut).agg(F.sum("held_us")).first()[0] == (31 - 3) * hour


def test_leads_by_pair_and_corridor(spark):
    mids = [("a", 0, 1000), ("a", 10, 1300), ("a", 500, 1300), ("b", 0, 500), ("b", 40, 700), ("b", 60, 900), ("b", 600, 900)]
    quotes = spark.createDataFrame([(i, t, us, m) for i, (t, us, m) in enumerate(mids)], "id long, ticker string, us long, mid2 long")
    pairs = spark.createDataFrame([("north", "a", "b")], "corridor string, upstream string, downstream string")
    none = spark.createDataFrame([], "start_us long, end_us long")
    got = {(r.scope, r.reading): (r.leader, r.crossings, r.episodes, r.screened, r.median_lead_us) for r in depth.pair_lead_lag(quotes, pairs, none, 100, 300, 200, 150).collect()}
    assert got["pair", "forward"] == ("a", 1, 1, 0, 30.0) and got["pair", "reverse"] == ("b", 1, 0, 0, None) and got["corridor", "forward"][0] == "*"
    shut = spark.createDataFrame([(5, 6)], "start_us long, end_us long")
    got = {(r.scope, r.reading): (r.episodes, r.screened) for r in depth.pair_lead_lag(quotes, pairs, shut, 100, 300, 200, 150).collect()}
    assert got["pair", "forward"] == (0, 1)
