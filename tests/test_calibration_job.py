import random

import pytest

from tidemark.operators.forecast import calibration_job

SCHEMA = "grp string, day long, p double, o int, n string, key string"  # the last two clash with names in use


def isotonic(pairs):
    """The fit at each distinct p: the largest, over starts up to it, of the least mean of spans that hold it."""
    ps = sorted({p for p, _ in pairs})
    mean = {(a, b): (lambda x: sum(x) / len(x))([o for p, o in pairs if a <= p <= b]) for a in ps for b in ps if a <= b}
    return {p: round(max(min(mean[a, b] for b in ps if b >= p) for a in ps if a <= p), 9) for p in ps}


def mapped(p, fit):
    low, high = max((k for k in fit if k <= p), default=None), min((k for k in fit if k >= p), default=None)
    if low is None or high is None:
        return p
    return round(fit[low] + ((p - low) / (high - low) if high > low else 0) * (fit[high] - fit[low]), 9)


def test_walks_forward(spark):
    rng = random.Random(4)
    rows = [(g, rng.randrange(100, 150), (p := rng.randrange(11) / 10), int(rng.random() < p * p), "x", "y") for g in ("a", "b") for _ in range(260)]
    rows += [("a", 128, 0.33, 1, None, None), ("c", 120, 0.5, 1, None, None), (None, 120, 0.5, 1, "", ""), ("a", None, 0.5, 1, "", ""), ("a", 120, None, 1, "", ""), ("a", 120, 0.5, None, "", "")]
    sound = [r[:4] for r in rows if None not in r[:4]]

    def trained(g, period):
        own = [(p, o) for x, d, p, o in sound if x == g and period * 5 - 15 <= d < period * 5]
        hits = sum(o for _, o in own)
        return own, hits, len(own) >= 60 and hits >= 20

    def score(g, period, held):
        own, _, enough = trained(g, period)
        fit = isotonic(own) if enough else {}
        return sum((mapped(p, fit) - o) ** 2 for p, o in held) / len(held)

    got = {(r.grp, r.period): r for r in calibration_job(spark.createDataFrame(rows, SCHEMA), "grp", 20, 5, 60, 20).collect()}
    assert set(got) == {(g, d // 5) for g, d, _, _ in sound}
    assert {r.fitted for r in got.values()} == {True, False}
    for (g, period), r in got.items():
        held = [(p, o) for x, d, p, o in sound if x == g and d // 5 == period]
        own, hits, enough = trained(g, period)
        assert (r.train_n, r.positives, r.fitted, r.n) == (len(own), hits, enough, len(held))
        assert r.brier_new == pytest.approx(score(g, period, held), abs=2e-9) and r.brier_previous == pytest.approx(score(g, period - 1, held), abs=2e-9)
        rate = sum(o for _, o in held) / len(held)
        assert r.skill is None if rate in (0, 1) else r.skill == pytest.approx(1 - r.brier_new / (rate * (1 - rate)), abs=2e-6)


def test_no_rows(spark):
    assert calibration_job(spark.createDataFrame([], SCHEMA), "grp").collect() == []
