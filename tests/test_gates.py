"""Gates and holdouts at their thresholds."""

import pytest

from tidemark.operators import inference

ROWS = "k string, estimate double, p_value double, clusters long"


def test_gates_at_the_threshold(spark):
    df = spark.createDataFrame([("at", 0.5, 0.01, 30), ("above", 0.6, 0.05, 30), ("few", 0.6, 0.01, 29), ("none", None, 0.01, 30), ("nop", 0.6, None, 30), ("nan", 0.6, float("nan"), 30)], ROWS)
    got = lambda **k: {r.k: (r.economic, r.undecidable, r.significant, r.powered, r.passed) for r in inference.gate(df, 0.5, 0.05, 30, **k).collect()}
    assert got() == {
        "at": (True, False, True, True, True), "above": (True, False, False, True, False), "few": (True, False, True, False, False),
        "none": (False, True, False, True, False), "nop": (False, True, False, True, False), "nan": (False, True, False, True, False),
    }
    assert not got(strict=True)["at"][0] and got(strict=True)["above"][0]
    assert got(direction="less")["at"][0] and not got(direction="less")["above"][0] and not got(direction="less", strict=True)["at"][0]
    with pytest.raises(ValueError):
        inference.gate(df, 0.5, 0.05, 30, "up")


def test_holdouts_replicate_discoveries(spark):
    pairs = {"yes": (2.0, 1.0, 0.01, 16), "sign": (2.0, -2.0, 0.01, 16), "small": (2.0, 0.99, 0.01, 16), "chance": (2.0, 2.0, 0.05, 16), "few": (2.0, 2.0, 0.01, 15), "zero": (0.0, 0.0, 0.01, 16), "nop": (-2.0, -2.0, None, 16), "none": (2.0, None, 0.01, 16)}
    rows = [(g, s, e, p, n) for g, (d, h, p, n) in pairs.items() for s, e in (("discovery", d), ("holdout", h))] + [("alone", "discovery", 1.0, 0.01, 40)]
    out = inference.holdout(spark.createDataFrame(rows, "grp string, split string, estimate double, p_value double, clusters long"), ["grp"], 0.05, 31)
    got = {r.grp: (r.same_sign, r.magnitude, r.significant, r.powered, r.held, r.direction) for r in out.collect()}
    assert got == {
        "yes": (True, True, True, True, True, "greater"), "sign": (False, True, True, True, False, "greater"), "small": (True, False, True, True, False, "greater"), "chance": (True, True, False, True, False, "greater"),
        "few": (True, True, True, False, False, "greater"), "zero": (False, True, True, True, False, None), "nop": (True, True, False, True, False, "less"), "none": (False, False, False, True, False, "greater"),
    }


def test_calibration_cells_at_their_edges(spark):
    from pyspark.sql import functions as F

    from tidemark.operators.forecast import calibration_cell

    rows = [("tails", 0.02, 12), ("tails", 0.03, 13), ("edge", 0.05, 24), ("edge", 0.30, 48), ("edge", 0.31, 49), ("edge", 0.06, None), ("other", 0.06, 0), ("edge", None, 9999)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, strategy string, price double, hours long")
    got = [tuple(r.x) for r in df.select("i", calibration_cell(F.col("strategy"), F.col("price"), F.col("hours")).alias("x")).orderBy("i").collect()]
    assert got == [("tails", 0, 0), ("tails", 1, 1), ("edge", 0, 1), ("edge", 4, 2), ("edge", 5, 2), ("edge", 1, -1), ("other", None, 0), ("edge", None, 2)]
