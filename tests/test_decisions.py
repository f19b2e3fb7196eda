"""Stakes, strategies, gates and resampling on rows worked out by hand, and their edge cases."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import decisions as op
from tidemark.operators import resampling

BASE = {
    "leg_id": 1, "fair": 6000, "yes_bid": 4000, "yes_ask": 4500, "depth": 100, "spread": 1500, "spread_median": 3000, "same_day": False, "blacklisted": False, "divergence": None,
    "minutes_to_close": 90, "event_budget": 10_000, "market_budget": 20_000, "age_hours": 1, "status": "active", "armed": True,
}
SCHEMA = "leg_id long, fair long, yes_bid long, yes_ask long, depth long, spread long, spread_median long, same_day boolean, blacklisted boolean, divergence long, minutes_to_close long, event_budget long, market_budget long, age_hours long, status string, armed boolean"


def rows(spark, *changes):
    df = spark.createDataFrame([tuple({**BASE, "leg_id": i, **c}[k.split()[0]] for k in SCHEMA.split(", ")) for i, c in enumerate(changes)], SCHEMA)
    return df.withColumns({"reason": F.lit("clash"), "contracts": F.lit(-1), "action": F.lit("clash"), "failed": F.lit("clash")})


def decided(df):
    return [(r.action, r.contracts, r.reason) for r in df.orderBy("leg_id").collect()]


def test_edge_reasons_in_order(spark):
    changes = [
        {}, {"fair": None}, {"blacklisted": True, "fair": 4250}, {"fair": 5050}, {"spread": 1000}, {"same_day": True}, {"divergence": 6}, {"divergence": 5}, {"depth": 0}, {"market_budget": 10}, {"fair": 3000}, {"fair": 5051},
        {"depth": 4}, {"event_budget": -5}, {"spread": 6000, "event_budget": 10**9, "market_budget": 10**9, "depth": 10**6}, {"event_budget": None},
    ]
    out = decided(op.edge_decisions(rows(spark, *changes), 1_000_000))
    assert [r for _, _, r in out] == [
        "trade_buy", "no_fair", "blacklisted", "edge_too_small", "spread_too_tight", "same_day", "nbm_diverged", "trade_buy", "depth_zero_clamp", "below_min_size", "trade_sell", "trade_buy", "trade_buy", "below_min_size", "trade_buy", "trade_buy",
    ]
    assert out[0] == ("buy", 50, "trade_buy")  # half of the depth
    assert out[12][1] == 2 and out[10] == ("sell", 50, "trade_sell")
    # a full Kelly of 3/11, halved by the spread, a quarter of it, of 10,000 dollars, at 45 cents
    assert out[14][1] == int(1500 / 5500 * 0.5 * 0.25 * 1_000_000 / 45)


def test_tails_reasons_in_order(spark):
    good = {"fair": 300, "yes_bid": 1100, "yes_ask": 1300}
    changes = [good, {**good, "yes_ask": 1000}, {**good, "yes_ask": 10_000}, {**good, "yes_bid": 900}, {**good, "fair": 700}, {**good, "same_day": True}, {**good, "minutes_to_close": 60}, {**good, "depth": 0}, {**good, "market_budget": 1}, {**good, "fair": None}]
    assert [r for _, _, r in decided(op.tails_decisions(rows(spark, *changes), 1_000_000))] == ["trade", "ask_too_low", "no_no_bid", "no_yes_bid", "fair_too_high", "same_day", "too_close_to_settle", "yes_bid_depth_zero", "below_min_size", "no_fair"]


def gated(spark, *changes):
    base = {"fair": 5000, "age_hours": 6, "spread": 1000, "edge": 500, "price": 5000, "depth": 10, "contracts": 10, "order_cents": 100, "market_existing": 0, "event_existing": 0, "series_existing": 0, "aggregate_existing": 0, "balance": 50, "status": "active", "minutes_to_close": 10, "armed": True}
    types = {"status": "string", "armed": "boolean"}
    df = spark.createDataFrame([(i, *({**base, **c}[k] for k in base)) for i, c in enumerate(changes)], "leg_id long, " + ", ".join(f"{k} {types.get(k, 'long')}" for k in base))
    return op.risk_gates(df.withColumn("failed", F.lit("x")).withColumn("n_failed", F.lit("x")), 100, 100, 100, 100, 50).orderBy("leg_id").collect()


def test_every_gate_alone(spark):
    changes = [
        {"fair": None}, {"age_hours": 7}, {"spread": 999}, {"edge": 249}, {"market_existing": 1}, {"event_existing": 1}, {"series_existing": 1}, {"aggregate_existing": 1}, {"balance": 49}, {"status": "closed"}, {"minutes_to_close": 9}, {"armed": False},
    ]
    names = ["fair_value_sane", "model_fresh", "ensemble_spread_ok", "edge_after_friction", "within_market_cap", "within_event_cap", "within_series_cap", "within_aggregate_cap", "account_cushion", "market_open", "time_to_close", "circuit_breakers_armed"]
    out = gated(spark, *changes, {}, {"fair": 99}, {"fair": 9900}, {"status": None, "armed": None, "edge": None, "depth": 0})
    assert [r.failed for r in out[:12]] == names
    assert all(not r.live_passed and r.paper_passed == (r.failed != "edge_after_friction") for r in out[:12])
    assert out[12].live_passed and out[12].failed == "" and out[12].friction is None and out[12].floor == 250
    assert out[3].friction == "fee_spread" and (out[13].failed, out[14].failed) == ("fair_value_sane", "")
    assert out[15].failed == "edge_after_friction,market_open,circuit_breakers_armed" and out[15].friction == "depth_zero_clamp" and out[15].n_failed == 3
    assert gated(spark, {"contracts": 13})[0].floor == 280 and gated(spark, {"contracts": 1000, "depth": 1})[0].floor == 750


def test_exposures(spark):
    df = spark.createDataFrame([(1, "a", 5, "x"), (1, "b", 7, "x"), (None, "b", 1, "x"), (2, None, 3, "x")], "event long, series string, cents long, event_existing string")
    out = {(r.event, r.series): (r.event_existing, r.series_existing, r.aggregate_existing) for r in op.with_exposures(df, "event", "series", "cents").collect()}
    assert out == {(1, "a"): (12, 5, 16), (1, "b"): (12, 8, 16), (None, "b"): (0, 8, 16), (2, None): (3, 0, 16)}
    assert op.with_exposures(df.limit(0), "event", "series", "cents").count() == 0


def test_no_rows(spark):
    assert op.edge_decisions(rows(spark, {}).limit(0), 1).count() == op.tails_decisions(rows(spark, {}).limit(0), 1).count() == 0


def test_a_planted_effect_is_found_and_none_is_not(spark):
    real = spark.range(40).selectExpr("id AS cluster", "100 + id % 7 AS total", "CAST(50 AS BIGINT) AS weight")
    r = resampling.ratio_bootstrap(real, ["cluster"], 1, 999, null=1.0).first()
    assert r.estimate == pytest.approx(2.06, abs=0.01) and r.p_value == 0.001 and r.low < r.estimate < r.high and not r.degenerate
    assert resampling.ratio_bootstrap(real, ["cluster"], 1, 999, null=1.0, direction="less").first().p_value == 1
    same = spark.range(10).selectExpr("id AS cluster", "CAST(3 AS BIGINT) AS total", "CAST(1 AS BIGINT) AS weight")
    assert resampling.ratio_bootstrap(same, ["cluster"], 1, 99).first().degenerate
    assert resampling.ratio_bootstrap(real.limit(0), ["cluster"], 1, 99).count() == 0
    with pytest.raises(ValueError):
        resampling.ratio_bootstrap(real, ["cluster"], 1, 99, direction="up")


def test_wild_bootstrap_by_hand(spark):
    noise = [3, -2, 5, -4, 1, 2, -3, 4, -1, 0, 2, -5, 3, -1, 4, -3]
    df = spark.createDataFrame([(i // 2, 100 + x, 10) for i, x in enumerate(noise)], "block long, total long, weight long")
    r = resampling.wild_t_bootstrap(df, ["block"], 5, 999, null=0.0).first()
    theta = sum(100 + x for x in noise) / 160
    sums = [sum(100 + noise[i + j] - theta * 10 for j in (0, 1)) for i in range(0, 16, 2)]
    error = sum(s * s for s in sums) ** 0.5 / 160
    assert (r.estimate, r.standard_error, r.t, r.blocks) == (pytest.approx(theta), pytest.approx(error), pytest.approx(theta / error), 8)
    assert r.low < theta < r.high and r.p_value < 0.02
    assert resampling.wild_t_bootstrap(df, ["block"], 5, 999, null=10.0).first().p_value > 0.05
    flat = spark.createDataFrame([(i, 30, 10) for i in range(6)], "block long, total long, weight long")
    assert resampling.wild_t_bootstrap(flat, ["block"], 5, 99, null=0.0).first().t is None
