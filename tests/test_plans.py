"""Joins and unions without a key, by ranges, and books at points."""

import random

import pytest

from tidemark.functions import quantile
from tidemark.operators.book import book_state_at
from tidemark.operators.forecast import depth_screen
from tidemark.plans.asof import asof_join, last_before
from tidemark.plans.intervals import merge_intervals

TAPE = "id long, ticker string, us long, seq long, side string, price long, size long, is_snapshot boolean"
POINTS, GAPS = "point_id long, ticker string, at_us long", "ticker string, detected_us long"


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_unions_without_a_key(spark, width):
    rng = random.Random(width)
    spans = [(a, a + rng.randrange(6)) for a in (rng.randrange(300) for _ in range(60))] + [(50, 95), (None, 3), (4, None), (10, 10), (10, 10)]
    want = []
    for a, b in sorted(s for s in spans if None not in s):
        if want and a <= want[-1][1]:
            want[-1][1] = max(want[-1][1], b)
        else:
            want.append([a, b])
    df = spark.createDataFrame(spans, "a long, b long")
    assert sorted(map(list, merge_intervals(df, "a", "b", width=width).collect())) == want
    assert merge_intervals(df.limit(0), "a", "b", width=width).collect() == []
    keyed = merge_intervals(df.selectExpr("1 as k", "a", "b"), "a", "b", ["k"])
    assert sorted([r.a, r.b] for r in keyed.collect()) == want


def test_last_before_by_ranges(spark):
    rng = random.Random(1)
    left, right = [(i, rng.randrange(200)) for i in range(60)] + [(60, None), (61, 0)], [(rng.randrange(20, 200),) for _ in range(12)] + [(None,)]
    lf, rf = spark.createDataFrame(left, "i long, t long"), spark.createDataFrame(right, "u long")
    want = {i: max((u for (u,) in right if u is not None and t is not None and u <= t), default=None) for i, t in left}
    for width in (3, 50, 10_000):
        assert {r.i: r.last for r in last_before(lf, rf, "t", "u", "last", width).collect()} == want
    assert {r.last for r in last_before(lf, rf.limit(0), "t", "u", "last", 5).collect()} == {None}


def brute_state(points, tape, gaps):
    out = []
    for pid, ticker, at in points:
        snaps = [(us, i, seq) for i, t, us, seq, _, _, _, snap in tape if snap and t == ticker and ticker is not None and at is not None and us <= at]
        if not snaps:
            out.append((pid, "no_anchor", None, None, None, None))
            continue
        us0, _, seq0 = max(snaps)
        if any(g in ("", ticker) and d is not None and us0 <= d <= at for g, d in gaps):
            out.append((pid, "gap", None, None, None, None))
            continue
        levels = {}
        for _, t, us, seq, side, price, size, snap in tape:
            if t == ticker and None not in (side, price, size) and ((snap and (us, seq) == (us0, seq0)) or (not snap and us0 < us <= at)):
                levels[side, price] = levels.get((side, price), 0) + size
        best = [max((p for (s, p), n in levels.items() if s == side and n > 0), default=None) for side in ("yes", "no")]
        out.append((pid, "ok", best[0], levels.get(("yes", best[0])), best[1], levels.get(("no", best[1]))))
    return sorted(out, key=str)


def test_books_at_points(spark):
    rng = random.Random(9)
    tape = [(i, f"t{rng.randrange(3)}", i // 3, rng.randrange(4), rng.choice(["yes", "no"]), rng.randrange(5), rng.randrange(-3, 6), rng.random() < 0.15) for i in range(300)]
    tape += [(300, "t0", 40, 1, None, 3, 4, False), (301, "t1", 41, 1, "yes", None, 4, False), (302, "t1", 42, 1, "no", 2, None, False), (303, None, 5, 1, "no", 2, 1, True)]
    points = [(i, f"t{rng.randrange(4)}", rng.randrange(105)) for i in range(80)] + [(3, "t1", 90), (81, None, 50), (82, "t2", None)]
    gaps = [("t0", 30), ("", 61), ("t2", 80), ("", None), (None, 10)]
    for width in (4, 1000):
        got = book_state_at(spark.createDataFrame(points, POINTS), spark.createDataFrame(tape, TAPE), spark.createDataFrame(gaps, GAPS), width)
        assert sorted(((r.point_id, r.status, r.yes_bid, r.yes_size, r.no_bid, r.no_size) for r in got.collect()), key=str) == brute_state(points, tape, gaps)
    none = book_state_at(spark.createDataFrame([], POINTS), spark.createDataFrame([], TAPE), spark.createDataFrame([], GAPS))
    assert none.collect() == [] and none.columns == ["point_id", "ticker", "at_us", "status", "yes_bid", "yes_size", "no_bid", "no_size"]


def test_quantiles_of_repeated_values(spark):
    values = [1, 1, 1, 2, 5, 5, 9, None, None]
    df = spark.createDataFrame([("k", v) for v in values] + [(None, 4)], "k string, v long")
    for rule, q, want in (("nearest", 0.5, 2), ("floor", 0.5, 2), ("up", 0.75, 5), ("even", 0.25, 1), ("nearest", 1.0, 9), ("floor", 0.0, 1)):
        assert {r.k: r.x for r in quantile(df, ["k"], "v", q, rule, "x").collect()} == {"k": want, None: 4}
    got = depth_screen(df, "v", 2).first()
    assert (got.n, got.kept, got.zeros, got.most, got.p10, got.p50, got.p90) == (10, 5, 0, 9, 1, 2, 5)
    empty = depth_screen(df.limit(0), "v", 2).first()
    assert (empty.n, empty.kept, empty.most, empty.p50) == (0, 0, None, None)


def test_null_times_and_keys_meet_nothing(spark):
    left = spark.createDataFrame([("a", 5, "x"), ("a", None, "x"), (None, 5, "x")], "k string, t long, v string")  # v is on both sides
    right = spark.createDataFrame([("a", None, 1, "p"), (None, 1, 2, "p"), ("a", 9, 3, "p")], "k string, u long, w long, v string")
    for forward in (False, True):
        got = asof_join(left, right, ["k"], "t", "u", ["w"], forward=forward)
        assert sorted(((r.k, r.t, r.w) for r in got.collect()), key=str) == sorted([("a", 5, 3 if forward else None), ("a", None, None), (None, 5, None)], key=str)
        assert got.columns == ["k", "t", "v", "w"] and asof_join(left.limit(0), right, ["k"], "t", "u", ["w"], forward=forward).collect() == []


def test_unions_by_key_across_ranges_and_null_keys(spark):
    import random

    from tidemark.plans.intervals import merge_intervals

    draw = random.Random(5)
    rows = [(draw.choice(["a", "b", None]), a, a + draw.choice([0, 1, 3, 40])) for a in (draw.randrange(300) for _ in range(150))]
    rows += [("a", None, 3), ("a", 4, None), ("c", -25, -5), ("c", -5, 5)]
    want = []
    for key in {r[0] for r in rows}:
        union = []
        for a, b in sorted(r[1:] for r in rows if r[0] == key and None not in r[1:]):
            if union and a <= union[-1][1]:
                union[-1][1] = max(b, union[-1][1])
            else:
                union.append([a, b])
        want += [(str(key), a, b) for a, b in union]
    df = spark.createDataFrame(rows, "key string, a long, b long")
    for width in (10, 1000):
        assert sorted((str(r.key), r.a, r.b) for r in merge_intervals(df, "a", "b", ["key"], width).collect()) == sorted(want)
    assert merge_intervals(df.limit(0), "a", "b", ["key"]).collect() == []
