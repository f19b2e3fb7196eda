"""Running values with a busy key, ties and forced spills, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import tape
from tidemark.plans.intervals import merge_intervals
from tidemark.plans.scan import before, latest, most, running, total


@pytest.fixture(params=[None, 150])
def spills(spark, request):
    """Sorters spill every so many rows, as they do when memory is short."""
    conf, name = spark.sparkContext._jsc.sc().conf(), "spark.shuffle.spill.numElementsForceSpillThreshold"
    if request.param:
        conf.set(name, str(request.param))
    yield request.param
    conf.remove(name)


def union(spans):
    out = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


@pytest.mark.parametrize("aqe", ["true", "false"])
@pytest.mark.parametrize("width", [100_000, 10**9])
def test_unions_of_copies(spark, spills, width, aqe):
    spark.conf.set("spark.sql.adaptive.enabled", aqe)
    try:
        spans = [(i * 1000, i * 1000 + 10) for i in range(300)] * 20
        random.Random(1).shuffle(spans)
        df = spark.createDataFrame([(None if i % 3 else "k", *s) for i, s in enumerate(spans)], "k string, a long, b long")
        assert sorted(map(list, merge_intervals(df, "a", "b", width=width).collect())) == union(spans)
        keyed = merge_intervals(df, "a", "b", ["k"], width).collect()
        assert sorted([r.a, r.b] for r in keyed if r.k is None) == union(s for i, s in enumerate(spans) if i % 3)
        assert sorted([r.a, r.b] for r in keyed if r.k == "k") == union(s for i, s in enumerate(spans) if not i % 3)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.mark.parametrize("width", [1, 40, 10_000])
def test_running_values_of_a_busy_key(spark, spills, width):
    rng = random.Random(width)
    rows = [("hot" if rng.random() < 0.9 else rng.choice([None, "a", "b"]), rng.randrange(400), i, rng.choice([None, -3, 0, 5, rng.randrange(100)])) for i in range(1200)]
    df = spark.createDataFrame(rows, "k string, t long, i long, v long")
    out = running(df, ["k"], ["t", "i"], width, {"s": total(F.col("v")), "s0": total(F.col("v"), through=False), "m": most(F.col("v"), through=False), "l": latest(F.col("v")), "p": before(F.col("v"))})
    got = {r.i: (r.s, r.s0, r.m, r.l, r.p) for r in out.collect()}
    want = {}
    for key in {r[0] for r in rows}:
        s, m, last, prev = 0, None, None, None
        for _, _, i, v in sorted((r for r in rows if r[0] == key), key=lambda r: r[1:3]):
            s0, m0 = s, m
            s, m, last = s + (v or 0), (m if v is None else v if m is None else max(m, v)), last if v is None else v
            want[i] = (s, s0, m0, last, prev)
            prev = v
    assert got == want
    assert running(df.limit(0), ["k"], ["t", "i"], width, {"s": total(F.col("v"))}).count() == 0


def test_a_busy_key_is_many_tasks(spark):
    df = spark.range(20_000).selectExpr("'hot' as k", "id as t")
    out = running(df, ["k"], ["t"], 500, {"s": total(F.lit(1))})
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        spread = out.groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert len(spread) == 4 and max(r["count"] for r in spread) < 0.5 * 20_000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.mark.parametrize("width", [70, 10**6])
def test_covered_time(spark, spills, width):
    rng = random.Random(width)
    intervals = [(a, a + rng.randrange(40)) for a in (rng.randrange(3000) for _ in range(90))] * 3 + [(None, 4), (4, None)]
    spans = [(i, a, a + rng.randrange(900)) for i, a in enumerate(rng.randrange(-50, 3200) for _ in range(80))] + [(90, 0, 9000), (91, None, 3), (92, 9, 5), (93, 100, 100), (90, 0, 10)]
    merged = union(s for s in intervals if None not in s)
    want = {}
    for key, a, b in spans:
        whole = a is not None and b is not None and a <= b
        want[key] = want.get(key, 0) + (sum(max(min(b, y) - max(a, x), 0) for x, y in merged) if whole else 0)
    sf, xf = spark.createDataFrame(spans, "id long, a long, b long"), spark.createDataFrame(intervals, "start_us long, end_us long")
    assert {r.id: r.overlap_us for r in tape.overlap_us(sf, xf, "id", "a", "b", width).collect()} == want
    assert {r.overlap_us for r in tape.overlap_us(sf, xf.limit(0), "id", "a", "b", width).collect()} == {0}


def test_coverage_makes_no_pairs(spark):
    sf, xf = spark.createDataFrame([(1, 0, 9)], "id long, a long, b long"), spark.createDataFrame([(1, 2)], "start_us long, end_us long")
    plan = tape.overlap_us(sf, xf, "id", "a", "b")._jdf.queryExecution().optimizedPlan().toString()
    assert "_day" not in plan and "Join Cross" not in plan


@pytest.mark.parametrize("width", [1, 7, 100_000])
def test_epochs_of_a_busy_ticker(spark, spills, width):
    from tidemark.operators.book import with_epoch

    rng = random.Random(width)
    rows, us = [], 0
    for i in range(900):
        us += rng.random() < 0.4
        rows.append((i, rng.choice(["hot"] * 9 + [None]), us, rng.randrange(3), rng.choice([True, False, False, None])))
    df = spark.createDataFrame(rows, "id long, ticker string, us long, seq long, is_snapshot boolean")
    want = {}
    for ticker in ("hot", None):
        was, n = None, 0
        for i, _, u, q, snap in (r for r in rows if r[1] == ticker):
            if snap:
                n, was = n + (was != (u, q)), (u, q)
            want[i] = n
    assert {r.id: r.epoch for r in with_epoch(df, width).collect()} == want
    assert with_epoch(df.limit(0)).count() == 0
