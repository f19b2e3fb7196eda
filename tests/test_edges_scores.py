"""Scores, entries, ladders and gaps on empty tables, nulls, ties and books with more levels than are listed."""

from pyspark.sql import functions as F

from tidemark.operators import depth, forecast, tape, trades


def test_walk_stops_inside_at_the_end_or_beyond_what_is_listed(spark):
    rows = [(1, [99, 98], [10, 10], 2), (2, [99, 98], [10, 10], 7), (3, [99, 90], [10, 10], 2), (4, [], [], 0)]
    df = spark.createDataFrame(rows, "id long, prices array<long>, sizes array<long>, levels long")
    got = {r.id: tuple(r.x) for r in df.select("id", depth.walk_capacity("prices", "sizes", 1, "levels").alias("x")).collect()}
    # third: one more at a gap of 9 fits into the spare of 10 ticks for every 8 beyond one
    assert got == {1: (20, False, True), 2: (20, True, False), 3: (11, False, False), 4: (0, False, True)}


def test_entry_pays_the_fee_of_its_own_price(spark):
    rows = [(1, 0.6, 5000, 100, 1), (2, 0.4, 5000, 100, 1), (3, 0.5, 5000, 100, 1), (4, None, 5000, 100, 0)]
    df = spark.createDataFrame(rows, "leg_id long, p double, price long, units long, won int")
    got = {r.leg_id: (r.side, r.executed, r.net, r.walked_net) for r in forecast.entry_pnl(df).collect()}
    fee = lambda p: -(-7 * 100 * p * (10_000 - p) // 10**10) * 10_000
    assert got[1] == ("yes", 5000, 100 * 4900 - fee(5000), 100 * 4800 - fee(5100))
    assert got[2] == ("no", 5000, -100 * 5100 - fee(5000), -100 * 5200 - fee(5100))
    assert got[3] == ("none", None, None, None) and got[4] == ("none", None, None, None)


def test_empty_bins_and_tables(spark):
    none = spark.createDataFrame([], "p double, o int, grp string, q double, mid double, bucket string, month string, net double")
    assert [(r.n, r.predicted, r.observed) for r in forecast.reliability(none, 4).collect()] == [(0, 0.0, 0.0)] * 4
    assert forecast.brier(none, ["grp"], "q").collect() == []
    filled = spark.createDataFrame([], "filled_strict long, filled_inclusive long")
    assert tuple(trades.execution_bound(filled).first()) == (0, 0, 0, 0.0, 0.0, False, False)


def test_blend_gives_what_rounding_leaves_to_the_largest(spark):
    rows = spark.createDataFrame([(3, 0, 1), (0, 3, 1), (3, 3, 2)], "a long, b long, y long")
    assert sum(r.weight for r in forecast.nnls_blend(rows, ["a", "b"], "y").collect()) == 1
    assert [r.weight for r in forecast.nnls_blend(rows.limit(0), ["a", "b"], "y").collect()] == [0.0, 0.0]


def test_gaps_without_a_window_are_returned(spark):
    gaps = spark.createDataFrame([(1, 5, "x"), (2, 6, "y"), (3, None, "z")], "id long, detected_us long, reason string")
    attached = spark.createDataFrame([(7, 2)], "boundary_id long, gap_id long")
    assert sorted(r.gap_id for r in tape.unmatched_gaps(attached, gaps).collect()) == [1, 3]
    assert tape.unmatched_gaps(attached, gaps.filter(F.lit(False))).collect() == []
