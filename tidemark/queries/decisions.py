from pyspark.sql import functions as F

from tidemark.operators import decisions as op
from tidemark.queries import query
from tidemark.sources.adapters import view

BANK = 1_000_000
_STAKE = """CASE WHEN {p} > 0 AND {p} < 10000 AND {cost} > 0 AND {full} > 0 THEN coalesce(greatest(floor(round(least(least({full} * least(1.0::DOUBLE, spread_median / greatest(spread, 10)::DOUBLE) * {kelly}::DOUBLE * 1000000,
  greatest(0, least(event_budget, market_budget))::DOUBLE), 0.5::DOUBLE * depth * {cost} / 100) * 100 / {cost}, 6)), 0), 0)::BIGINT ELSE 0 END"""
_EDGE = f"""e AS (SELECT *, CASE WHEN fair > yes_ask + 400 THEN 'buy' WHEN fair < yes_bid - 400 THEN 'sell' END AS side FROM v_decisions),
  s AS (SELECT *, CASE side WHEN 'buy' THEN {_STAKE.format(p="yes_ask", cost="yes_ask", full="((fair - yes_ask) / (10000 - yes_ask)::DOUBLE)", kelly=0.25)} ELSE {_STAKE.format(p="yes_bid", cost="(10000 - yes_bid)", full="((yes_bid - fair) / yes_bid::DOUBLE)", kelly=0.25)} END AS n FROM e),
  d AS (SELECT *, CASE WHEN fair IS NULL THEN 'no_fair' WHEN blacklisted THEN 'blacklisted' WHEN abs(fair - (yes_ask + yes_bid) / 2.0) <= 800 THEN 'edge_too_small' WHEN spread <= 1000 THEN 'spread_too_tight' WHEN same_day THEN 'same_day'
    WHEN divergence > 5 THEN 'nbm_diverged' WHEN side IS NULL THEN 'no_direction' WHEN depth <= 0 THEN 'depth_zero_clamp' WHEN n < 1 THEN 'below_min_size' ELSE 'trade_' || side END AS reason FROM s),
  t AS (SELECT * EXCLUDE (side, n), CASE WHEN reason LIKE 'trade%' THEN side ELSE 'skip' END AS action, CASE WHEN reason LIKE 'trade%' THEN n ELSE 0 END AS contracts FROM d)"""


@query("edge_decisions", f"WITH {_EDGE} SELECT leg_id, action, contracts, reason FROM t")
def edge_decisions(spark, sf_dir):
    return op.edge_decisions(view(spark, sf_dir, "v_decisions"), BANK).select("leg_id", "action", "contracts", "reason")


@query("tails_decisions", f"""WITH s AS (SELECT *, {_STAKE.format(p="yes_bid", cost="(10000 - yes_bid)", full="((yes_bid - fair) / yes_bid::DOUBLE)", kelly=0.05)} AS n FROM v_decisions),
  d AS (SELECT *, CASE WHEN fair IS NULL THEN 'no_fair' WHEN yes_ask <= 1000 THEN 'ask_too_low' WHEN yes_ask >= 10000 THEN 'no_no_bid' WHEN yes_bid < 950 THEN 'no_yes_bid' WHEN fair >= 700 THEN 'fair_too_high' WHEN same_day THEN 'same_day'
    WHEN minutes_to_close <= 60 THEN 'too_close_to_settle' WHEN fair >= yes_ask THEN 'negative_edge' WHEN depth <= 0 THEN 'yes_bid_depth_zero' WHEN yes_bid = 0 THEN 'cost_basis_unusable' WHEN n < 1 THEN 'below_min_size' ELSE 'trade' END AS reason FROM s)
  SELECT leg_id, CASE reason WHEN 'trade' THEN 'sell' ELSE 'skip' END AS action, CASE reason WHEN 'trade' THEN n ELSE 0 END AS contracts, reason FROM d""")
def tails_decisions(spark, sf_dir):
    return op.tails_decisions(view(spark, sf_dir, "v_decisions"), BANK).select("leg_id", "action", "contracts", "reason")


_PRICED = "CASE WHEN fair > yes_ask THEN yes_ask ELSE yes_bid END AS price, abs(fair - CASE WHEN fair > yes_ask THEN yes_ask ELSE yes_bid END) AS edge, 1 + minutes_to_close % 40 AS size"


@query("risk_gates", f"""WITH p AS (SELECT *, {_PRICED} FROM v_decisions), q AS (SELECT *, size * price {{div}} 100 AS order_cents, 100000 - exposure AS balance, sum(exposure) OVER (PARTITION BY event) AS event_sum, sum(exposure) OVER (PARTITION BY series) AS series_sum, sum(exposure) OVER () AS total,
    100 * ((7 * 100 * price * (10000 - price) + 9999999999) {{div}} 10000000000) + 50 + CASE WHEN size <= depth THEN 0 ELSE least(100.0::DOUBLE * ((size - depth)::DOUBLE / greatest(depth, 1)), 500) END AS needed FROM p),
  f AS (SELECT *, list_filter([CASE WHEN fair >= 100 AND fair <= 9900 THEN NULL ELSE 'fair_value_sane' END, CASE WHEN age_hours > 6 THEN 'model_fresh' END, CASE WHEN spread < 1000 THEN 'ensemble_spread_ok' END, CASE WHEN edge >= needed THEN NULL ELSE 'edge_after_friction' END,
    CASE WHEN exposure + order_cents > 70000 THEN 'within_market_cap' END, CASE WHEN event_sum + order_cents > 200000 THEN 'within_event_cap' END, CASE WHEN series_sum + order_cents > 30000000 THEN 'within_series_cap' END, CASE WHEN total + order_cents > 4000000000 THEN 'within_aggregate_cap' END,
    CASE WHEN balance < 40000 THEN 'account_cushion' END, CASE WHEN status <> 'active' THEN 'market_open' END, CASE WHEN minutes_to_close < 10 THEN 'time_to_close' END, CASE WHEN NOT armed THEN 'circuit_breakers_armed' END], lambda x: x IS NOT NULL) AS names FROM q)
  SELECT leg_id, needed::DOUBLE AS floor, coalesce(array_to_string(names, ','), '') AS failed, len(names) AS n_failed, CASE WHEN list_contains(names, 'edge_after_friction') THEN CASE WHEN depth <= 0 THEN 'depth_zero_clamp' ELSE 'fee_spread' END END AS friction,
    len(names) = 0 AS live_passed, NOT list_contains(names, 'edge_after_friction') AS paper_passed FROM f""")
def risk_gates(spark, sf_dir):
    rows = op.with_exposures(_priced(spark, sf_dir), "event", "series", "exposure").withColumn("market_existing", F.col("exposure"))
    out = op.risk_gates(rows, 70_000, 200_000, 30_000_000, 4_000_000_000, 40_000)
    return out.select("leg_id", "floor", "failed", "n_failed", "friction", "live_passed", "paper_passed")


def _priced(spark, sf_dir):
    rows = view(spark, sf_dir, "v_decisions").withColumn("price", F.when(F.col("fair") > F.col("yes_ask"), F.col("yes_ask")).otherwise(F.col("yes_bid")))
    rows = rows.withColumn("edge", F.abs(F.col("fair") - F.col("price"))).withColumn("contracts", 1 + F.col("minutes_to_close") % 40)
    return rows.withColumn("order_cents", F.expr("contracts * price div 100")).withColumn("balance", 100_000 - F.col("exposure"))
