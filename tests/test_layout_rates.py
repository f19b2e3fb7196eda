"""Stored tapes with a schema and pruning, exact rates, cohorts and tied deltas."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators import book, events, ingest

DAY = 86_400_000_000


@pytest.fixture
def stored(spark, tmp_path):
    rows = [(i, f"{r}-{i}", r, d * DAY + i) for i, (r, d) in enumerate((r, d) for r in ("007", "KX", "NO") for d in range(5))] + [(99, "x", "KX", None)]
    df = spark.createDataFrame(rows, "id long, ticker string, root string, us long")
    ingest.write_tape(df, str(tmp_path / "tape"), "us", "id")
    return str(tmp_path / "tape"), df


def ids(df):
    return sorted(r.id for r in df.collect())


def test_windows_of_a_stored_tape(spark, stored):
    path, df = stored
    read = lambda *a, **b: ingest.read_window(spark, path, df.schema, "us", *a, **b)
    end = 3 * DAY + 8
    assert ids(read(DAY, end)) == ids(df.filter(F.col("us").between(DAY, end)))
    assert ids(read(DAY, end, half_open=True)) == ids(df.filter(f"us >= {DAY} and us < {end}"))
    assert ids(read(0, end, ["007"], era_start=2 * DAY)) == ids(df.filter(f"us between {2 * DAY} and {end} and root = '007'"))
    assert {r.root for r in read(0, end, ["007"]).collect()} == {"007"}
    assert ids(read(end, DAY)) == []


def test_only_partitions_of_the_window_are_read(spark, stored):
    path, df = stored
    out = ingest.read_window(spark, path, df.schema, "us", DAY, 2 * DAY - 1, ["KX"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters") :].split("\n")[0]
    assert "arrival_date" in filters and "root" in filters and "PushedFilters: [IsNotNull(us)" in plan
    files = out._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().get("numFiles").get()
    out.collect()
    assert files.value() == 1


def test_another_schema_raises(spark, stored):
    path, df = stored
    for other in (df.withColumn("more", F.lit(1)), df.withColumn("us", F.col("us").cast("string")), df.drop("ticker")):
        with pytest.raises(ValueError, match="schema differs in"):
            ingest.read_window(spark, path, other.schema, "us", 0, DAY)
    assert ingest.enforce_schema(df.select("us", "root", "ticker", "id"), df.schema).columns == df.columns
    with pytest.raises(ValueError):
        ingest.enforce_schema(df, StructType([]))


def test_exact_rates(spark):
    flags = spark.createDataFrame([("s", i < 1, i < 2, i < 2) for i in range(3)] + [("t", None, False, True)] + [("u", i < 333_333, i < 333_334, False) for i in range(1_000_000)], "k string, a boolean, b boolean, c boolean")
    rates = events.mechanism_rates(flags, "k", {"a": "0.333334", "b": "0.333334", "c": "0.5"})
    got = {(r.k, r.mechanism): (r.numerator, r.denominator, r.millionths, r.matched) for r in rates.collect()}
    assert got["s", "a"] == (1, 3, 333_333, False) and got["s", "b"] == (2, 3, 666_666, True) and got["u", "b"] == (333_334, 1_000_000, 333_334, True) and got["u", "a"][3] is False
    assert got["t", "a"] == (0, 1, 0, False)
    first = {r.k: r.mechanism for r in events.first_matching(rates, "k").collect()}
    assert first == {"s": "b", "t": "c", "u": "b"}
    published = spark.createDataFrame([("s", 333_333), ("s", 666_666), ("s", 666_667), ("u", 333_333), ("v", 1)], "k string, millionths long")
    found = {(r.k, r.published): (r.mechanism, r.candidates) for r in events.published_mechanism(rates, published, "k").collect()}
    assert found == {("s", 333_333): ("a", 1), ("s", 666_666): ("b", 2), ("s", 666_667): (None, 0), ("u", 333_333): ("a", 1), ("v", 1): (None, 0)}


TAPE = "id long, ticker string, us long, seq long, side string, price long, size long, is_snapshot boolean"


def test_tied_deltas_are_told_apart(spark):
    rows = [(1, "a", 10, 1, "yes", 100, 5, True), (2, "a", 10, 2, "yes", 200, 3, False), (3, "a", 20, 3, "yes", 50, 1, False), (4, "b", 10, 1, "yes", 100, 5, True), (5, "b", 12, 2, "yes", 300, 1, False), (6, "c", 30, 1, "no", 1, 1, True)]
    tape, gaps = spark.createDataFrame(rows, TAPE), spark.createDataFrame([("b", 13)], "ticker string, detected_us long")
    asked = [("a", 15, "interior", "busy"), ("a", 25, "blind", "busy"), ("b", 12, "interior", "quiet"), ("b", 14, "post_gap", "gap"), ("c", 5, "interior", "quiet")]
    points = spark.createDataFrame([(f"{t}{u}", t, u, k, c) for t, u, k, c in asked], "point_id string, ticker string, at_us long, kind string, cohort string")
    late, points2, gaps2 = book.with_later_deltas(tape, points, gaps)
    results = book.parity_results(points, book.touch_series(tape), book.book_state_at(points, tape, gaps), book.book_state_at(points2, late, gaps2), tape, gaps)
    got = {r.point_id: (r.status, r.tied_agreed, r.blind) for r in results.collect()}
    assert got == {"a15": ("excluded_tied_delta", True, False), "a25": ("excluded_tied_delta", True, True), "b12": ("agreed", None, False), "b14": ("agreed_on_raise", None, True), "c5": ("no_anchor", None, False)}
    tally = {(r.scope, r.name): (r.agreed, r.agreed_on_raise, r.excluded_tied_delta, r.tied_agreed, r.no_anchor, r.n) for r in book.replay_parity(results).collect()}
    assert tally["all", "*"] == (1, 1, 2, 2, 1, 5) and tally["kind", "post_gap"] == (0, 1, 0, 0, 0, 1) and tally["cohort", "busy"][2] == 2


def test_cohorts_do_not_overlap_and_say_what_is_missing(spark):
    rows = [(f"{r}{n}", r, n) for r, ns in (("A", range(1, 9)), ("B", range(20, 23))) for n in ns]
    tape = spark.createDataFrame([(i, t, i * 10, i, "yes", 1, 1, i % 3 == 0) for i, t in enumerate(t for t, _, n in rows for _ in range(n))], TAPE)
    ranked = book.ranked_tickers(tape, F.substring("ticker", 1, 1), 4)
    assert [r.ticker for r in ranked.orderBy("place").collect()] == [t for t, _, n in sorted(rows, key=lambda x: (-x[2], x[0]))]
    cohorts = book.sample_cohorts(ranked, 2, 3, 4)
    got = {r.ticker: r.cohort for r in cohorts.collect()}
    assert got == {"B22": "busy", "B21": "busy", "A3": "quiet", "A2": "quiet", "A1": "quiet", "B20": "spread", "A7": "spread", "A5": "spread"}
    gaps = spark.createDataFrame([(1, "", 400), (2, "A8", 5), (3, "B22", 1100)], "id long, ticker string, detected_us long")
    points = book.sample_points(tape, cohorts, ranked, gaps, 3, 2)
    short = {r.cohort: (r.wanted, r.found, r.missing) for r in book.sample_shortfall(points, cohorts, {"busy": 2, "quiet": 3, "spread": 4}).collect()}
    assert short == {"busy": (2, 2, 0), "quiet": (3, 3, 0), "spread": (4, 3, 1)}
    assert points.count() == points.distinct().count() and points.filter("kind = 'interior' and ticker = 'B22'").count() == 3
    assert {r.kind for r in points.filter("cohort = 'gap'").collect()} == {"post_gap", "gap_edge"}
