"""Draws in arrays against their definition, and the bootstrap of a ratio by hand, in ranges, pieces and tiles."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import draw
from tidemark.functions.draws import drawn
from tidemark.operators import resampling


def one(seed, rep, k):
    return int(hashlib.md5(f"{seed}-{rep}-{k}".encode()).hexdigest()[:8], 16)


@pytest.mark.parametrize(("seed", "reps", "n"), [(17, range(8, 12), 30), (-5, range(98, 102), 1001), (7, range(2), 1), (7, range(3), 10), (7, range(3), 11), (123456789, range(9999, 10001), 10001), (3, range(5, 6), 100_002)])
def test_drawn_is_draw(seed, reps, n):
    found = {rep: [] for rep in reps}
    for first, rows in drawn(seed, reps, n):
        for rep, row in enumerate(rows, first):
            found[rep] += row.tolist()
    assert found == {rep: [one(seed, rep, k) for k in range(n)] for rep in reps}


def test_drawn_is_sparks_draw(spark):
    rows = spark.range(40).withColumn("rep", F.lit(12)).select("id", draw(17, "rep", "id").alias("x")).collect()
    ((_, found),) = [x for x in drawn(17, range(12, 13), 10)]
    assert found[0].tolist() == [r.x for r in rows if r.id < 10]


def test_drawn_says_what_fits_no_block():
    with pytest.raises(ValueError):
        list(drawn(10**60, range(1), 1))


def by_hand(clusters, seed, replicates, null, direction, level):
    """clusters in their order: (total, weight)."""
    n, r = len(clusters), []
    for rep in range(replicates):
        picks = [clusters[one(seed, rep, k) % n] for k in range(n)]
        known = [t for t, _ in picks if t is not None]
        if known:
            r.append(sum(known) / sum(w for _, w in picks))
    estimate, r = sum(t for t, _ in clusters if t is not None) / sum(w for _, w in clusters), np.array(r)
    extreme = (r - estimate >= estimate - null - 1e-9) if direction == "greater" else (r - estimate <= estimate - null + 1e-9)
    low, high = np.percentile(r, [50 * (1 - level), 50 * (1 + level)])
    return estimate, n, (1 + int(extreme.sum())) / (replicates + 1), 2 * estimate - high, 2 * estimate - low, r.std()


KINDS = {
    "whole": ([(i * 7919 % 101 - 40, 1 + i % 9) for i in range(57)], "total long, weight long"),
    "small": ([(i % 5 - 1, 1 + i % 3) for i in range(57)], "total int, weight short"),
    "fractions": ([(i * 7919 % 101 / 8 - 4.0, 0.5 + i % 9) for i in range(57)], "total double, weight double"),
    "mixed": ([(i * 7919 % 101 / 8 - 4.0, 1 + i % 9) for i in range(57)], "total double, weight int"),
    "unknown": ([(i if i % 19 == 0 else None, 1 + i % 9) for i in range(57)], "total long, weight long"),
    "wide": ([(2**56 - i * 10**14, 2**50 + i) for i in range(57)], "total long, weight long"),
    "three": ([(None, 2), (None, 1), (5, 4)], "total long, weight long"),
    "one": ([(5, 4)], "total long, weight long"),
}


@pytest.mark.parametrize("width", [5, 1 << 22])
@pytest.mark.parametrize("kind", KINDS)
def test_ratio_by_hand(spark, monkeypatch, kind, width):
    """Clusters come in any order and from several tasks; replicates lie in several tiles, clusters in several pieces and ranges."""
    for name, value in (("PIECE", 3), ("TASK_REPLICATES", 40), ("TASK_DRAWS", 1)):
        monkeypatch.setattr(resampling, name, value)
    clusters, schema = KINDS[kind]
    rows = [(f"M{i:02}", t, w) for i, (t, w) in enumerate(clusters)] + [("M99", 1, type(clusters[0][1])(0))]
    if "double" in schema:
        rows = [(m, float(t), w) for m, t, w in rows]
    df = spark.createDataFrame(rows[::-1], f"ticker string, {schema}").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = resampling.ratio_bootstrap(df, ["ticker"], 17, 103, 0.3, "less", 0.9, width).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = by_hand(clusters, 17, 103, 0.3, "less", 0.9)
    assert len(found) == 1 and tuple(found[0])[:6] == pytest.approx(want, rel=1e-9, abs=1e-12)
    assert found[0].degenerate == (kind == "one")


def shuffled(spark):
    """Rows that stages have shuffled so far."""
    context, jvm = spark.sparkContext, spark.sparkContext._jvm
    context._jsc.sc().listenerBus().waitUntilEmpty()
    none = jvm.java.util.ArrayList()
    stages = context._jsc.sc().statusStore().stageList(none, False, False, context._gateway.new_array(jvm.double, 0), none)
    return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}


def test_draws_are_no_rows(spark):
    """What is shuffled grows with clusters and with replicates, not with their product."""
    df = spark.range(4000).selectExpr("id AS cluster", "id % 7 - 3 AS total", "1 + id % 5 AS weight")
    before = shuffled(spark)
    assert resampling.ratio_bootstrap(df, ["cluster"], 1, 500).first().clusters == 4000
    rows = sum(n for stage, n in shuffled(spark).items() if stage not in before)
    assert 500 <= rows < 10 * (4000 + 500)
