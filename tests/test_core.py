import math

import numpy as np
import pytest

from tidemark.functions import fee_cents, phi, quantile, weighted_quantile
from tidemark.operators import book, tape
from tidemark.operators.forecast import pool_adjacent
from tidemark.operators.trades import print_net_cents
from tidemark.plans.asof import asof_join
from tidemark.plans.intervals import interval_join, merge_intervals


def test_phi(spark):
    z = [-8.0, -3.1, -1.0, -0.3, 0.0, 0.2, 0.46875 * math.sqrt(2), 0.7, 2.5, 5.0, 8.0]
    got = spark.createDataFrame([(x,) for x in z], "z double").select("z", phi("z").alias("p")).collect()
    assert all(abs(r.p - 0.5 * math.erfc(-r.z / math.sqrt(2))) < 1e-9 for r in got)


# Hundredths of contracts, price in ticks, signed move of the doubled mid -> net cents.
GOLDEN = [(100, 500, 400, 0), (100, 500, 0, -2), (400, 4500, 1000, 6), (400, 4500, -1000, -34), (1000, 5000, 2000, 64), (10_000, 5000, 200, -250), (39, 5000, 2000, 1.9), (124, 5000, 1800, 5.16)]


def test_net_of_fees(spark):
    rows = [(i, u, p, 10_000, 10_000 + m, "yes", "ok") for i, (u, p, m, _) in enumerate(GOLDEN)]
    df = spark.createDataFrame(rows, "id long, units long, yes_price long, mid2_start long, mid2_end long, taker_side string, status string")
    got = {r.id: r.net / 20_000 for r in print_net_cents(df).collect()}
    assert got == pytest.approx({i: g[3] for i, g in enumerate(GOLDEN)})
    fee = spark.createDataFrame([(1000, 5000)], "u long, t long").select(fee_cents("u", "t").alias("a"), fee_cents("u", "t", maker=True).alias("b")).first()
    assert (fee.a, fee.b) == (18, 5)


def test_asof_ties_strictness_and_tolerance(spark):
    left = spark.createDataFrame([("a", 5), ("a", 10), ("a", 1), ("b", 7)], "k string, t long")
    right = spark.createDataFrame([("a", 5, 1), ("a", 5, 2), ("a", 8, 3)], "k string, u long, v long")
    run = lambda **x: sorted(((r.k, r.t, r.v) for r in asof_join(left, right, ["k"], "t", "u", ["v"], tie="v", **x).collect()), key=str)
    assert run() == [("a", 1, None), ("a", 10, 3), ("a", 5, 2), ("b", 7, None)]
    assert run(strict=True) == [("a", 1, None), ("a", 10, 3), ("a", 5, None), ("b", 7, None)]
    assert run(forward=True) == [("a", 1, 1), ("a", 10, None), ("a", 5, 1), ("b", 7, None)]
    assert run(forward=True, strict=True) == [("a", 1, 1), ("a", 10, None), ("a", 5, 3), ("b", 7, None)]
    assert run(tolerance=1) == [("a", 1, None), ("a", 10, None), ("a", 5, 2), ("b", 7, None)]


def test_intervals(spark):
    spans = spark.createDataFrame([(0, 10), (10, 20), (5, 7), (30, 40)], "a long, b long")
    assert sorted(map(tuple, merge_intervals(spans, "a", "b").collect())) == [(0, 20), (30, 40)]
    points = spark.createDataFrame([(i,) for i in (-1, 0, 10, 15, 20, 25, 40)], "t long")
    merged = merge_intervals(spans, "a", "b")
    hit = lambda **x: sorted(r.t for r in interval_join(points, merged, "t", "a", "b", 6, **x).collect())
    assert hit() == [0, 10, 15, 20, 40]
    assert hit(closed=False) == [0, 10, 15]
    assert hit(how="left_anti") == [-1, 25]


def test_quantile_rules(spark):
    df = spark.createDataFrame([("g", v) for v in (1, 2, 3, 4)], "k string, v long")
    got = {rule: quantile(df, ["k"], "v", 0.5, rule, "q").first().q for rule in ("nearest", "even", "up", "floor")}
    assert got == {"nearest": 2, "even": 3, "up": 3, "floor": 2}
    bins = spark.createDataFrame([("g", 1, 1), ("g", 2, 5), ("g", 2, 1), ("g", 9, 3)], "k string, v long, w long")
    assert weighted_quantile(bins, ["k"], "v", "w", 0.7, "q").first().q == 2


def test_isotonic_fit():
    x = np.arange(5.0)
    assert pool_adjacent(x, np.array([1.0, 0, 2, 1, 3]), np.ones(5)).tolist() == [0.5, 0.5, 1.5, 1.5, 3.0]


TAPE = [  # id, ticker, us, seq, side, price, size, is_snapshot
    (1, "A", 0, 1, "yes", 100, 5, False), (2, "A", 1, 2, "yes", 100, 7, True), (3, "A", 1, 2, "yes", 200, 3, True), (4, "A", 1, 2, "no", 300, 1, True), (5, "A", 2, 3, "yes", 200, -3, False),
    (6, "A", 2, 3, "yes", 100, -9, False), (7, "A", 1, 2, "no", 300, 4, True), (8, "A", 3, 9, "no", 50, 2, True), (9, "B", 3, 1, "no", 10, 1, False),
]


def test_book_replay(spark):
    df = spark.createDataFrame(TAPE, "id long, ticker string, us long, seq long, side string, price long, size long, is_snapshot boolean")
    levels = {r.id: (r.epoch, r.level_size, r.violation) for r in book.book_levels(df).collect()}
    assert levels[5] == (1, 0, False) and levels[6] == (1, -2, True) and levels[7] == (1, 4, False) and levels[8][:2] == (2, 2)
    touch = {r.id: (r.yes_bid, r.yes_size, r.no_bid, r.no_size) for r in book.touch_series(df).collect()}
    assert touch[1] == (100, 5, None, None) and touch[3] == (200, 3, None, None) and touch[5] == (100, 7, 300, 1)
    assert touch[6] == (None, None, 300, 1) and touch[8] == (None, None, 50, 2) and touch[9] == (None, None, 10, 1)
    for parts in (1, 9):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        assert {r.id: (r.yes_bid, r.yes_size, r.no_bid, r.no_size) for r in book.touch_series(df).collect()} == touch
    spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_blind_windows_by_ranges_of_any_width(spark):
    rows = [(1, 10, 5, False), (2, 20, 6, False), (3, 30, 1, True), (4, 40, 2, True), (5, 50, 3, False), (6, 60, 1, True), (7, 70, 1, True), (8, 80, 2, False)]
    df = spark.createDataFrame(rows, "id long, us long, seq long, is_snapshot boolean")
    for width in (1, 3, 1000):
        got = sorted((r.boundary_id, r.burst_messages, r.start_us, r.end_us) for r in tape.blind_windows(df, width).collect())
        assert got == [(3, 2, 20, 40), (6, 1, 50, 60), (7, 1, 60, 70)]
