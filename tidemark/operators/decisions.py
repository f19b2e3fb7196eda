"""Columns over decision tables: stakes, strategies with the first reason that stops them, and risk gates.

Prices and fair values are in ticks (10,000 to a dollar), money in cents, the spread of an ensemble in thousandths of a
degree. Every operator is a projection of its rows, but for exposures, which are sums by event, series and in all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import fee_cents

# Thresholds of the strategies, sizes and gates.
EDGE_LEAST, CUSHION, DIVERGENCE, SPREAD_LEAST = 800, 400, 5, 1000
TAIL_ASK, TAIL_FAIR, TAIL_BID, TAIL_MINUTES = 1000, 700, 950, 60
EDGE_KELLY, TAILS_KELLY, SIGMA_FLOOR, DEPTH_SHARE = 0.25, 0.05, 10, 0.5
FAIR_RANGE, MODEL_HOURS, CLOSE_MINUTES, OPEN = (100, 9900), 6, 10, ("active",)
HALF_TICK, ADVERSE, MOST_ADVERSE = 50, 100.0, 500.0
#: Gates that stop a trade on paper as well.
PAPER_GATES = ("edge_after_friction",)


def stake(side: Column, fair: Column, price: Column, cost: Column, kelly: float, bankroll_cents: int) -> Column:
    """Contracts to take: a part of Kelly, shrunk where the spread is above its median, within budgets and half the depth.

    Reads spread, spread_median, event_budget, market_budget (cents) and depth. side is buy or sell, price that of yes
    and cost what a contract costs, in ticks. 0 where price or cost are out of range, the edge is on the other side, or
    an input is null.
    """
    q, p = fair.cast("double"), price.cast("double")
    full = F.when(side == "buy", (q - p) / (10_000 - p)).otherwise((p - q) / p)
    shrunk = full * F.least(F.lit(1.0), F.col("spread_median") / F.greatest(F.col("spread"), F.lit(SIGMA_FLOOR)).cast("double")) * kelly
    budget = F.greatest(F.lit(0.0), F.least("event_budget", "market_budget").cast("double"))
    cents = F.least(F.least(shrunk * bankroll_cents, budget), DEPTH_SHARE * F.col("depth") * cost / 100)
    usable = (price > 0) & (price < 10_000) & (cost > 0) & (full > 0)
    return F.coalesce(F.when(usable, F.greatest(F.floor(F.round(cents * 100 / cost, 6)), F.lit(0))), F.lit(0)).cast("long")


def edge_decisions(rows: DataFrame, bankroll_cents: int) -> DataFrame:
    """Adds action (buy, sell or skip), contracts and reason of the edge strategy: the first test that fails, in order.

    A null fair value is skipped as no_fair; a null divergence doesn't stop a trade. Rows stay as they are, whatever
    they repeat; columns of these names are replaced.
    """
    fair, bid, ask = F.col("fair"), F.col("yes_bid"), F.col("yes_ask")
    side = F.when(fair > ask + CUSHION, "buy").when(fair < bid - CUSHION, "sell")
    price = F.when(side == "buy", ask).otherwise(bid)
    cost = F.when(side == "buy", ask).otherwise(10_000 - bid)
    rows = rows.withColumn("contracts", stake(side, fair, price, cost, EDGE_KELLY, bankroll_cents))
    reason = (
        F.when(fair.isNull(), "no_fair").when(F.col("blacklisted"), "blacklisted").when(F.abs(2 * fair - bid - ask) <= 2 * EDGE_LEAST, "edge_too_small")
        .when(F.col("spread") <= SPREAD_LEAST, "spread_too_tight").when(F.col("same_day"), "same_day").when(F.col("divergence") > DIVERGENCE, "nbm_diverged")
        .when(side.isNull(), "no_direction").when(F.col("depth") <= 0, "depth_zero_clamp").when(F.col("contracts") < 1, "below_min_size").otherwise(F.concat(F.lit("trade_"), side))
    )
    return _decided(rows.withColumn("reason", reason), side)


def tails_decisions(rows: DataFrame, bankroll_cents: int) -> DataFrame:
    """Adds action (sell or skip), contracts and reason of the strategy that sells unlikely outcomes; as edge_decisions."""
    fair, bid, no_bid = F.col("fair"), F.col("yes_bid"), 10_000 - F.col("yes_ask")
    cost = 10_000 - bid
    rows = rows.withColumn("contracts", stake(F.lit("sell"), fair, bid, cost, TAILS_KELLY, bankroll_cents))
    reason = (
        F.when(fair.isNull(), "no_fair").when(F.col("yes_ask") <= TAIL_ASK, "ask_too_low").when(no_bid <= 0, "no_no_bid").when(bid < TAIL_BID, "no_yes_bid").when(fair >= TAIL_FAIR, "fair_too_high")
        .when(F.col("same_day"), "same_day").when(F.col("minutes_to_close") <= TAIL_MINUTES, "too_close_to_settle").when(10_000 - fair - no_bid <= 0, "negative_edge")
        .when(F.col("depth") <= 0, "yes_bid_depth_zero").when(cost == 10_000, "cost_basis_unusable").when(F.col("contracts") < 1, "below_min_size").otherwise("trade")
    )
    return _decided(rows.withColumn("reason", reason), F.lit("sell"))


def _decided(rows: DataFrame, side: Column) -> DataFrame:
    trades = F.startswith("reason", F.lit("trade"))
    return rows.withColumn("action", F.when(trades, side).otherwise("skip")).withColumn("contracts", F.when(trades, F.col("contracts")).otherwise(0))


def friction_floor(price: str, depth: str, contracts: str) -> Column:
    """The edge in ticks that a trade must reach: fee of one contract, half a tick, and what is lost beyond the depth."""
    beyond = (F.col(contracts) - F.col(depth)).cast("double") / F.greatest(F.col(depth), F.lit(1))
    adverse = F.when(F.col(contracts) <= F.col(depth), F.lit(0.0)).otherwise(F.least(ADVERSE * beyond, F.lit(MOST_ADVERSE)))
    return 100 * fee_cents("100", price) + HALF_TICK + adverse


def with_exposures(rows: DataFrame, event: str, series: str, cents: str) -> DataFrame:
    """Adds event_existing, series_existing and aggregate_existing: the sums of cents over the rows of each.

    A null event or series has no exposure. The sums are joined back by key, so a hot key is split by the join; they
    are aggregates, a row for each key.
    """
    for key, name in ((event, "event_existing"), (series, "series_existing")):
        sums = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.sum(cents).alias(name))
        rows = rows.drop(name).join(sums, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    total = rows.agg(F.coalesce(F.sum(cents), F.lit(0)).alias("aggregate_existing"))
    return rows.drop("aggregate_existing").join(F.broadcast(total))  # one row


def risk_gates(rows: DataFrame, market_cap: int, event_cap: int, series_cap: int, aggregate_cap: int, cushion: int) -> DataFrame:
    """Adds floor (edge needed, ticks), failed (names of the gates that fail, in order), n_failed, friction (why the edge
    is too small), live_passed and paper_passed.

    Reads fair, age_hours, spread, edge, price, depth, contracts, order_cents, market_existing, event_existing,
    series_existing, aggregate_existing, balance, status, minutes_to_close and armed. A null input fails its gate.
    """
    rows = rows.withColumn("floor", friction_floor("price", "depth", "contracts"))
    passes = {
        "fair_value_sane": F.col("fair").between(*FAIR_RANGE),
        "model_fresh": F.col("age_hours") <= MODEL_HOURS,
        "ensemble_spread_ok": F.col("spread") >= SPREAD_LEAST,
        "edge_after_friction": F.col("edge") >= F.col("floor"),
        "within_market_cap": F.col("market_existing") + F.col("order_cents") <= market_cap,
        "within_event_cap": F.col("event_existing") + F.col("order_cents") <= event_cap,
        "within_series_cap": F.col("series_existing") + F.col("order_cents") <= series_cap,
        "within_aggregate_cap": F.col("aggregate_existing") + F.col("order_cents") <= aggregate_cap,
        "account_cushion": F.col("balance") >= cushion,
        "market_open": F.col("status").isin(*OPEN),
        "time_to_close": F.col("minutes_to_close") >= CLOSE_MINUTES,
        "circuit_breakers_armed": F.col("armed"),
    }
    failed = F.filter(F.array(*(F.when(~F.coalesce(test, F.lit(False)), name) for name, test in passes.items())), lambda x: x.isNotNull())
    rows = rows.withColumn("_failed", failed)
    short = F.when(F.array_contains("_failed", "edge_after_friction"), F.when(F.col("depth") <= 0, "depth_zero_clamp").otherwise("fee_spread"))
    blocked = F.arrays_overlap("_failed", F.array(*map(F.lit, PAPER_GATES)))
    out = rows.withColumns({"failed": F.array_join("_failed", ","), "n_failed": F.size("_failed").cast("long"), "friction": short, "live_passed": F.size("_failed") == 0, "paper_passed": ~blocked})
    return out.drop("_failed")
