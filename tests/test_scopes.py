"""Event days, runs, splits, windows of evidence, strata, positions and ladders on rows worked out by hand."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import depth, events, ingest, tape, trades

DAY = tape.DAY_US
HOUR = DAY // 24


def test_event_days_by_series(spark):
    rows = [("A", "a", 0), ("A", "b", 10 * HOUR), ("A", "a", DAY + 5), ("B", "c", 2 * HOUR), (None, "d", 3 * HOUR)]
    df = spark.createDataFrame(rows, "series string, ticker string, us long")
    shut = spark.createDataFrame([(9 * HOUR, 11 * HOUR), (9 * HOUR, 10 * HOUR), (DAY + HOUR, DAY + 2 * HOUR)], "start_us long, end_us long")
    got = {(r.series, r.day): (r.tickers, r.n_rows, r.outage_us, r.covered_us, r.evaluable) for r in tape.event_day_inventory(df, shut).collect()}
    assert got == {("A", 0): (2, 2, 2 * HOUR, 9 * HOUR, False), ("A", 1): (1, 1, HOUR, 0, True), ("B", 0): (1, 1, 2 * HOUR, 0, False), (None, 0): (1, 1, 2 * HOUR, 0, False)}
    assert tape.event_day_inventory(df.limit(0), shut).count() == 0


def test_runs_of_days(spark):
    days = [(c, d, True) for c in "xy" for d in (*range(1, 4), *range(10, 38))] + [("x", 4, True), ("y", 4, False)]
    df = spark.createDataFrame(days, "city string, day long, evaluable boolean")
    assert tuple(tape.contiguous_run(df, "city", 14).first()) == (10, 23, None, 28)
    assert tuple(tape.contiguous_run(df, "city", 42).first()) == (None, None, "no_run", 28)
    assert tuple(tape.contiguous_run(df.limit(0), "city", 14).first()) == (None, None, "no_run", 0)
    with pytest.raises(ValueError, match="multiple of 14"):
        tape.contiguous_run(df, "city", 13)


def test_cities_of_a_split_agree(spark):
    same = spark.createDataFrame([(c, d) for c in "xy" for d in range(6)], "city string, day long")
    assert [r.split for r in tape.freeze_split(same).orderBy("day").collect()] == ["discovery"] * 4 + ["holdout"] * 2
    more = same.union(spark.createDataFrame([("y", 9)], same.schema))
    assert [tuple(r) for r in tape.split_disagreements(more).collect()] == [(9, 1, 1)]
    with pytest.raises(ValueError, match="disagree on 1 days"):
        tape.freeze_split(more)


def test_windows_of_evidence(spark):
    rows = [(1, "A", 0, 5, 6), (2, "A", 0, 50, 60), (3, "A", 0, 95, 101), (4, "B", 0, 50, 51), (5, None, 0, 70, 80), (6, "A", 0, 30, 40), (7, "A", 0, 41, 42)]
    windows = spark.createDataFrame(rows, "id long, series string, day long, a_us long, b_us long")
    shut, days = spark.createDataFrame([(20, 30), (60, 65)], "start_us long, end_us long"), spark.createDataFrame([("A", 0, 10, 100), (None, 0, 0, 100)], "series string, day long, start_us long, end_us long")
    got = {r.id: r.status for r in tape.screen_windows(windows, shut, 0, 100, days).collect()}
    assert got == {1: "out_of_window", 2: "excluded", 3: "out_of_scope", 4: "out_of_window", 5: "kept", 6: "excluded", 7: "kept"}
    assert {r.id for r in tape.screen_windows(windows, shut, 0, 100).filter("status = 'kept'").collect()} == {1, 4, 5, 7}


def test_strata_near_events(spark):
    prints = spark.createDataFrame([(1, "a", 100), (2, "a", 900), (3, "b", 100), (4, "c", 100)], "id long, ticker string, us long")
    locks, known = spark.createDataFrame([("a", 150), ("c", 100)], "ticker string, lock_us long"), spark.createDataFrame([("a",), ("b",), ("a",)], "ticker string")
    got = {r.stratum: (r.prints, r.tickers) for r in trades.near_counts(trades.near_events(prints, locks, 60), known).collect()}
    assert got == {"inside": (1, 1), "outside_lock": (1, 1), "no_lock": (1, 1), "off_universe": (1, 1)}


def test_positions(spark):
    held, done = spark.createDataFrame([("a", 3), ("a", 2), ("b", 1), ("d", 0)], "ticker string, units long"), spark.createDataFrame([("a", 5), ("c", 4)], "ticker string, units long")
    assert sorted(tuple(r) for r in trades.position_parity(held, done, "ticker").collect()) == [("b", 1, 0, 1), ("c", 0, 4, -4)]
    shots = spark.createDataFrame([("a", 10, 7), ("a", 4, 1), ("b", 10, 2)], "ticker string, snapshot_us long, realised long")
    orders = spark.createDataFrame([(1, "a", 5, "executed"), (2, "a", 10, "executed"), (3, "a", 10, "rejected"), (4, "a", 10, "executed"), (5, "a", 11, "executed")], "order_id long, ticker string, placed_us long, status string")
    assert sorted((r.ticker, r.snapshot_us, r.order_id) for r in trades.attributed(shots, orders).collect()) == sorted([("a", 10, 4), ("a", 4, None), ("b", 10, None)])


def test_settled_trades_are_not_settled_again(spark):
    rows = spark.createDataFrame([(1, "s", 0, 10, "yes", 2, 4000), (2, "s", 0, 10, "yes", 2, 4000), (None, "s", 0, 999, "no", 1, 1)], "trade_id long, station string, day long, strike long, side string, units long, price long")
    official, before = spark.createDataFrame([("s", 0, 1)], "station string, day long, official long"), spark.createDataFrame([(2,), (2,), (None,)], "trade_id long")
    assert sorted(tuple(r) for r in events.settle_trades(rows, official, before).fillna(0).collect()) == [(0, "won", 9999), (1, "won", 12_000)]


def test_ladders_need_six_markets_that_can_be_read(spark):
    of = lambda day, *strikes: [f"KXA-24JAN{day:02d}-{x}" for x in strikes]
    whole = of(1, "T93", "B90.5", "B88.5", "B86.5", "B84.5", "T84")
    names = whole + of(2, "T93", "B90.5", "B88.5", "B86.5", "T84") + of(3, "T93", "B90.5", "B90.5", "B86.5", "B84.5", "T84") + of(4, "T93", "T94", "B88.5", "B86.5", "B84.5", "T84") + ["nonsense"]
    got = depth.ladder_by_strike(ingest.market_dimension(spark.createDataFrame([(n,) for n in names], "ticker string"))).orderBy("seat").collect()
    assert [(r.ticker, r.seat) for r in got] == [(n, i) for i, n in enumerate(reversed(whole))]
    assert [r.kind for r in got] == ["below", *["bracket"] * 4, "above"] and {r.grp for r in got} == {"KXA-2024-01-01"}
    assert depth.ladder_by_strike(ingest.market_dimension(spark.createDataFrame([], "ticker string"))).filter(F.lit(True)).count() == 0
