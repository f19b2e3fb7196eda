from pyspark.sql import functions as F

from tidemark.operators import samples as op
from tidemark.operators import tape
from tidemark.queries import query
from tidemark.queries.tape import _DAYS
from tidemark.sources.adapters import table, view

HOUR = 3_600_000_000


@query("probe_event", """WITH et AS (SELECT event_id, concat('M', user_id) AS ticker, us AS t0_us FROM ev WHERE event_type = 'click'),
  u AS (SELECT et.*, least(coalesce((SELECT min(detected_us) FROM v_gaps g WHERE g.ticker = et.ticker AND detected_us > t0_us), 4611686018427387904), t0_us + 86400000001) AS until_us FROM et)
  SELECT event_id, ticker, t0_us, (SELECT arg_max((mid2, 1), (m.us, m.id)) FROM v_mid m WHERE m.ticker = u.ticker AND m.us <= t0_us)[1] AS mid2_0, CASE WHEN t0_us + 21600000000 < until_us THEN (SELECT arg_max((mid2, 1), (m.us, m.id)) FROM v_mid m WHERE m.ticker = u.ticker AND m.us <= t0_us + 21600000000)[1] END AS mid2_1,
    (SELECT min(m.us) FROM v_mid m WHERE m.ticker = u.ticker AND m.us > t0_us AND m.us < until_us AND (mid2 >= 12000 OR mid2 <= 8000)) - t0_us AS band_lag_us FROM u""")
def probe_event(spark, sf_dir):
    events = view(spark, sf_dir, "ev").filter("event_type = 'click'").select("event_id", F.concat(F.lit("M"), "user_id").alias("ticker"), F.col("us").alias("t0_us"))
    return op.probe_event(events, view(spark, sf_dir, "v_mid"), view(spark, sf_dir, "v_gaps"), [0, 6 * HOUR], 8000, 12_000, 24 * HOUR)


@query("build_sample", """WITH c AS (SELECT ticker, max(us) AS close_us FROM v_touch GROUP BY ticker), l AS (SELECT *, close_us - 43200000000 AS as_of, (SELECT arg_max((yes_price, us), (us, id)) FROM v_prints p WHERE p.ticker = c.ticker AND us <= close_us - 43200000000) AS e FROM c),
  k AS (SELECT *, CASE WHEN as_of < 1706500000000000 THEN 'early' ELSE 'late' END AS era FROM l), f AS (SELECT * FROM k WHERE as_of - e[2] <= CASE era WHEN 'early' THEN 86400000000 ELSE 43200000000 END),
  t AS (SELECT f.ticker, count(*) AS n, sum(units)::BIGINT AS u FROM f JOIN v_prints p ON p.ticker = f.ticker AND p.us > as_of - 86400000000 AND p.us <= as_of GROUP BY 1)
  SELECT ticker, close_us, as_of, era, e[1] AS entry_price, as_of - e[2] AS stale_us, coalesce(n, 0) AS trailing_prints, coalesce(u, 0) AS trailing_units FROM f LEFT JOIN t USING (ticker)""")
def build_sample(spark, sf_dir):
    closes = view(spark, sf_dir, "v_touch").groupBy("ticker").agg(F.max("us").alias("close_us"))
    return op.build_sample(closes, view(spark, sf_dir, "v_prints"), 12 * HOUR, 24 * HOUR, 24 * HOUR, 12 * HOUR, 1_706_500_000_000_000)


@query("class_highs", "SELECT concat('S', user_id % 2) AS station, us {div} 86400000000 AS day, count(DISTINCT us {div} 3600000000 % 24) AS n, CASE WHEN count(DISTINCT us {div} 3600000000 % 24) = 24 THEN max(c) END AS high FROM ev GROUP BY 1, 2")
def class_highs(spark, sf_dir):
    hourly = view(spark, sf_dir, "ev").select(F.concat(F.lit("S"), F.col("user_id") % 2).alias("station"), F.expr("us div 86400000000").alias("day"), F.expr("us div 3600000000 % 24").alias("hour"), F.col("c").alias("value"))
    return op.class_highs(hourly, 24)


@query("lead_run", """WITH b AS (SELECT l_orderkey * 10 + l_linenumber AS leg_id, max(o) AS o, max(CASE WHEN lead % 2 = 0 THEN p END) AS a, max(p / 2) AS b, max(CASE WHEN lead % 3 > 0 THEN 1 - p END) AS c FROM v_scored GROUP BY 1),
  u AS (SELECT 'a' AS member, a AS p, o, a IS NOT NULL AND c IS NOT NULL AS whole FROM b UNION ALL SELECT 'b', b, o, a IS NOT NULL AND c IS NOT NULL FROM b UNION ALL SELECT 'c', c, o, a IS NOT NULL AND c IS NOT NULL FROM b UNION ALL SELECT 'blend', a * 0.5 + b * 0.3 + c * 0.2, o, a IS NOT NULL AND c IS NOT NULL FROM b)
  SELECT member, count(p) AS legs, count(*) FILTER (whole) AS blendable, round(avg(CASE WHEN whole THEN (p - o) * (p - o) END), 9) AS brier FROM u GROUP BY member""")
def lead_panel(spark, sf_dir):
    rows = view(spark, sf_dir, "v_scored").withColumn("leg_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    part = lambda m, p: rows.select("leg_id", F.lit(m).alias("member"), p.alias("p")).filter("p is not null")
    forecasts = part("a", F.when(F.col("lead") % 2 == 0, F.col("p"))).unionByName(part("b", F.col("p") / 2)).unionByName(part("c", F.when(F.col("lead") % 3 > 0, 1 - F.col("p"))))
    return op.lead_panel(rows.groupBy("leg_id").agg(F.max("o").alias("o")), forecasts, ["a", "b", "c"], [0.5, 0.3, 0.2])


@query("tick_baseline", """WITH d AS (SELECT concat('M', user_id) AS ticker, us AS as_of, k % 2 AS o FROM ev WHERE event_type = 'view'), x AS (SELECT d.*, (SELECT arg_max(mid2, (m.us, m.id)) FROM v_mid m WHERE m.ticker = d.ticker AND m.us <= as_of AND mid2 IS NOT NULL) AS mid2 FROM d)
  SELECT count(*) AS n, count(*) FILTER (mid2 IS NULL) AS unpriced, round(avg((mid2 / 20000 - o) * (mid2 / 20000 - o)), 9) AS brier FROM x""")
def tick_baseline(spark, sf_dir):
    decisions = view(spark, sf_dir, "ev").filter("event_type = 'view'").select(F.concat(F.lit("M"), "user_id").alias("ticker"), F.col("us").alias("as_of"), (F.col("k") % 2).alias("o"))
    return op.tick_baseline(decisions, view(spark, sf_dir, "v_mid"))


@query("settle_orders", """WITH o AS (SELECT o_orderkey AS order_id, o_custkey AS key, CASE WHEN o_orderkey % 2 = 0 THEN 'yes' ELSE 'no' END AS side, o_orderkey % 50 AS units, 1 + o_orderkey % 98 AS price, o_orderkey % 4 AS fee FROM orders), r AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal > 0 END AS yes FROM customer),
  g AS (SELECT order_id, fee, CASE WHEN yes IS NULL THEN NULL WHEN yes = (side = 'yes') THEN units * (100 - price) ELSE -units * price END AS gross FROM o LEFT JOIN r USING (key)) SELECT order_id, gross, gross - fee AS net FROM g""")
def settle_orders(spark, sf_dir):
    key = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select(key.alias("order_id"), F.col("o_custkey").alias("key"), F.when(key % 2 == 0, "yes").otherwise("no").alias("side"), (key % 50).alias("units"), (1 + key % 98).alias("price"), (key % 4).alias("fee"))
    results = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal") > 0).alias("yes"))
    return op.settle_orders(orders, results)


@query("apply_spans", f"WITH {_DAYS} SELECT day, outage_us AS excluded_us, 86400000000 - outage_us AS span_us FROM d")
def apply_spans(spark, sf_dir):
    days = view(spark, sf_dir, "v_tape").select(F.expr("us div 86400000000").alias("day")).distinct()
    spans = days.select("day", (F.col("day") * tape.DAY_US).alias("a"), ((F.col("day") + 1) * tape.DAY_US - 1).alias("b"))
    return op.apply_spans(days, tape.overlap_us(spans, view(spark, sf_dir, "v_excl"), "day", "a", "b"))
