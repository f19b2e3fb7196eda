"""Alarms of silent streams by a timer, stale books by batch and stream, and intervals of medians by walking outwards."""

import random
import time

import numpy as np
import pytest

from tidemark import streaming
from tidemark.functions import draw
from tidemark.operators import tape
from tidemark.operators.resampling import median_interval

BEATS = "stream string, us long, gaps long"


def run(spark, tmp_path, feed, until, **options):
    """Alarms of a live query over files that feed adds; until says when they suffice."""
    (tmp_path / "in").mkdir()
    rows = []
    beats = spark.readStream.schema(BEATS).json(str(tmp_path / "in"))

    def take(batch, number):
        rows.extend(tuple(r) for r in batch.collect())

    query = streaming.stream_silence(beats, **options).writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="300 milliseconds").start()
    try:
        for step in feed:
            staged = tmp_path / f"staged-{time.time_ns()}"
            staged.write_text("".join(f'{{"stream": "{s}", "us": {us}, "gaps": {g}}}\n' for s, us, g in step))
            staged.rename(tmp_path / "in" / f"{time.time_ns()}.json")
            limit = time.time() + 60
            while not until(rows, step) and time.time() < limit:
                time.sleep(0.2)
    finally:
        query.stop()
    return rows


def test_silence_is_noticed_and_cleared(spark, tmp_path):
    def until(rows, step):
        kinds = [r[1] for r in rows]
        return kinds.count("silent") >= 1 if step[0][1] == 100 else "clear" in kinds

    rows = run(spark, tmp_path, [[("a", 90, 0), ("a", 100, 1)], [("a", 300, 9)]], until, silent_ms=1500, most_gaps=2)
    assert rows[0] == ("a", "silent", 100, 1)
    assert ("a", "clear", 300, 9) in rows and ("a", "gaps", 300, 9) in rows
    assert [r[1] for r in rows].index("silent") < [r[1] for r in rows].index("clear")


def test_maintenance_keeps_quiet(spark, tmp_path):
    began = time.time()
    rows = run(spark, tmp_path, [[("a", 100, 0)]], lambda rows, step: rows or time.time() > began + 12, silent_ms=800, maintenance=[(0, 86_400_000)])
    assert rows == []


def test_heartbeats_of_a_day(spark):
    day = tape.DAY_US
    beats = spark.createDataFrame([("a", 0, 0), ("a", 400, 0), ("a", day + 100, 0), ("a", day + 150, 9), ("b", 2 * day, 0)], BEATS)
    alarms = tape.heartbeat_alarms(beats, 100, 2)
    assert sorted((r.us, r.alarm) for r in alarms.collect()) == [(0, "stale"), (400, "stale"), (day + 150, "gaps")]
    assert sorted((r.us, r.alarm) for r in tape.heartbeat_alarms(beats, 100, 2, (50, 200)).collect()) == [(400, "stale"), (day + 150, "gaps")]
    assert sorted((r.day, r.streams, r.beats, r.alarms, r.all_clear) for r in tape.heartbeat_days(beats, alarms).collect()) == [(0, 1, 2, 2, False), (1, 1, 2, 1, False), (2, 1, 1, 0, True)]


def test_beats_at_one_instant_are_in_order_of_their_gaps(spark):
    beats = spark.createDataFrame([("a", 5, g) for g in (9, 0, 4, 6, 2)], BEATS)
    assert [(r.us, r.alarm) for r in tape.heartbeat_alarms(beats, 100, 2).collect()] == [(5, "gaps")]


INTENTS = "series string, as_of long, book_us long"


def test_stale_books_in_batches(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.choice(["x", "y", None]), 10**9, rng.choice([None, 10**9, 10**9 - 240_000_000, 10**9 - 240_000_001])) for _ in range(90)] + [("few", 10**9, None)] * 3
    df = spark.createDataFrame(rows, INTENTS)
    want = {}
    for series in ("x", "y", None, "few"):
        own = [b is None or b < 10**9 - 240_000_000 for s, _, b in rows if s == series]
        want[series, False] = (len(own), sum(own), round(sum(own) / len(own), 9), sum(own) / len(own) > 0.4 and len(own) >= 10)
    every = [b is None or b < 10**9 - 240_000_000 for _, _, b in rows]
    want[None, True] = (93, sum(every), round(sum(every) / 93, 9), True)
    shown = lambda out: {(r.series, r.pooled): (r.seen, r.rejected, r.ratio, r.warns) for r in out.collect()}
    assert shown(streaming.stale_ratios(streaming.stale_intents(df), 0.4)) == want
    for i in range(0, len(rows), 20):
        spark.createDataFrame(rows[i : i + 20], INTENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/part={i:03d}"))
    stream = spark.readStream.schema(INTENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/part=*"))
    assert shown(streaming.stream_stale_books(stream, warn=0.4)) == want
    assert streaming.stale_ratios(streaming.stale_intents(df.limit(0))).count() == 0


def test_stale_books_are_observed(spark, tmp_path):
    spark.createDataFrame([("x", 10**9, None), ("x", 10**9, 10**9)], INTENTS).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(INTENTS).parquet(str(tmp_path / "in"))
    query = streaming.watched_intents(stream, "books").writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    metrics = [p["observedMetrics"]["books"] for p in query.recentProgress if p["observedMetrics"].get("books")]
    assert any((m["seen"], m["rejected"]) == (2, 1) for m in metrics)


def walked(spark, rows, seed, reps, level):
    """The interval by walking outwards over all values, one at a time."""
    blocks = sorted({b for b, _ in rows})
    signs = np.array([[1 if r.d % 2 == 0 else -1 for r in sorted(spark.range(len(blocks)).withColumnRenamed("id", "i").selectExpr("i", f"{rep} as rep").withColumn("d", draw(seed, "rep", "i")).collect(), key=lambda r: r.i)] for rep in range(reps)])
    w = np.array([sum(1 for b, _ in rows if b == k) for k in blocks], float)

    def admits(c, greater):
        s = np.array([sum(1 if v is None else np.sign(v - c) for b, v in rows if b == k) for k in blocks], float)

        def t(f):
            a, b = f @ s, f @ (s * w)
            spread = s @ s - 2 * a / w.sum() * b + (a / w.sum()) ** 2 * (w @ w)
            return a / np.sqrt(spread) if spread > 1e-9 * (s @ s) else None

        seen = t(np.ones(len(blocks)))
        if seen is None:
            return False
        drawn = [t(f) for f in signs]
        return (1 + sum(x is None or (x >= seen - 1e-9 if greater else x <= seen + 1e-9) for x in drawn)) / (reps + 1) > (1 - level) / 2

    values = sorted(v for _, v in rows if v is not None)
    if 2 * len(values) < len(rows) or not rows:
        return None, None, None
    start = values[-(-len(rows) // 2) - 1]
    out = []
    for greater in (True, False):
        last = None
        for c in sorted({v for v in values if (v <= start if greater else v >= start)}, reverse=greater):
            if not admits(c, greater):
                break
            last = c
        out.append(last)
    return start, *out


@pytest.mark.parametrize(("seed", "censored"), [(1, 0.0), (2, 0.2), (3, 0.6)])
def test_median_intervals_by_walking(spark, seed, censored):
    rng = random.Random(seed)
    rows = [(b, None if rng.random() < censored else rng.randrange(-40, 60) + 3 * (b % 3)) for b in range(14) for _ in range(rng.randint(1, 9))]
    df = spark.createDataFrame(rows, "b long, v long")
    got = median_interval(df, ["b"], "v", seed, 40, 0.8, width=7, ways=3).first()
    assert (got.estimate, got.low, got.high) == walked(spark, rows, seed, 40, 0.8)
    assert (got.n, got.censored) == (len(rows), sum(v is None for _, v in rows))


def test_median_intervals_of_little(spark):
    df = spark.createDataFrame([(1, 5)], "b long, v long")
    got = median_interval(df, ["b"], "v", 1, 20).first()
    assert (got.estimate, got.low, got.high, got.n) == (5, None, None, 1)
    assert median_interval(df.limit(0), ["b"], "v", 1, 20).collect() == []
