from pyspark.sql import functions as F

from tidemark.functions import phi_sql, quantile, weighted_quantile
from tidemark.operators import forecast as op
from tidemark.queries import query
from tidemark.sources.adapters import table, view

HOUR = 3_600_000_000
_BUCKET = "CASE WHEN lead IS NULL THEN 'unknown' WHEN lead <= 2 THEN '<=2h' WHEN lead <= 8 THEN '2-8h' WHEN lead <= 24 THEN '8-24h' WHEN lead <= 72 THEN '24-72h' ELSE '>72h' END"
_SCORED = f"sc AS (SELECT *, {_BUCKET} AS bucket, strftime(ship, '%Y-%m') AS month FROM v_scored)"


def _members(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("members"), F.col("label").cast("long").alias("bucket"))


def _sql_cdf(members, at, sigma):
    return f"list_avg(list_transform({members}, lambda m: {phi_sql(f'(({at} - m) / {sigma})')}))"


_EMB = "em AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS members, label::BIGINT AS bucket FROM embeddings)"


def _scored(spark, sf_dir):
    return view(spark, sf_dir, "v_scored").withColumn("bucket", op.lead_bucket(F.col("lead"))).withColumn("month", F.date_format("ship", "yyyy-MM"))


@query("daily_max_members", """SELECT concat('S', user_id % 5) AS station, k % 3 AS member, us {div} 86400000000 AS day, count(DISTINCT us {div} 3600000000 % 24) AS hours, max(c) AS high FROM ev GROUP BY 1, 2, 3 HAVING count(DISTINCT us {div} 3600000000 % 24) >= 12""")
def daily_max_members(spark, sf_dir):
    rows = view(spark, sf_dir, "ev").select(F.concat(F.lit("S"), F.col("user_id") % 5).alias("station"), (F.col("k") % 3).alias("member"), F.expr("us div 86400000000").alias("day"), F.expr("us div 3600000000 % 24").alias("hour"), F.col("c").alias("value"))
    return op.daily_max_members(rows, 12)


@query("latest_forecast_asof", """WITH r AS (SELECT id AS run_id, station, valid_us AS run_us FROM v_obs WHERE valid_us {div} 3600000000 % 24 IN (0, 6, 12, 18)), p AS (SELECT id, station, valid_us AS as_of FROM v_obs),
  x AS (SELECT p.*, (SELECT arg_max((run_id, run_us), (run_us, run_id)) FROM r WHERE r.station = p.station AND run_us <= as_of AND as_of - run_us <= 86400000000) AS f FROM p) SELECT id, station, as_of, f[1] AS run_id, f[2] AS found_us FROM x""")
def latest_forecast_asof(spark, sf_dir):
    obs = view(spark, sf_dir, "v_obs")
    runs = obs.filter("valid_us div 3600000000 % 24 IN (0, 6, 12, 18)").select(F.col("id").alias("run_id"), "station", F.col("valid_us").alias("run_us"))
    return op.latest_forecast_asof(obs.select("id", "station", F.col("valid_us").alias("as_of")), runs, ["station"], 24 * HOUR)


@query("ensemble_cdf", f"WITH {_EMB} SELECT vec_id, round({_sql_cdf('members', 0.05, 0.1)}, 9) AS p FROM em")
def ensemble_cdf(spark, sf_dir):
    return _members(spark, sf_dir).select("vec_id", F.round(op.ensemble_cdf("members", 0.05, 0.1), 9).alias("p"))


_RUNGS = [("below", -0.1, None), ("between", -0.1, 0.0), ("between", 0.0, 0.1), ("above", None, 0.1)]


@query("bracket_probability", f"""WITH {_EMB} SELECT vec_id, round({_sql_cdf('members', -0.1, 0.1)}, 9) AS rung_0, round({_sql_cdf('members', 0.0, 0.1)} - {_sql_cdf('members', -0.1, 0.1)}, 9) AS rung_1,
  round({_sql_cdf('members', 0.1, 0.1)} - {_sql_cdf('members', 0.0, 0.1)}, 9) AS rung_2, round(1 - {_sql_cdf('members', 0.1, 0.1)}, 9) AS rung_3 FROM em""")
def bracket_probability(spark, sf_dir):
    return _members(spark, sf_dir).select("vec_id", *(F.round(op.bracket_probability("members", k, a, b, 0.1), 9).alias(f"rung_{i}") for i, (k, a, b) in enumerate(_RUNGS)))


@query("ladder_sum", "SELECT vec_id, 1.0::DOUBLE AS total, 4::BIGINT AS rungs, 10000 + 400 * (vec_id % 5 - 2) AS price_total, true AS sound, abs(vec_id % 5 - 2) <= 1 AS priced FROM embeddings")
def ladder_sum(spark, sf_dir):
    rows = _members(spark, sf_dir).select("vec_id", F.explode(F.array(*(op.bracket_probability("members", k, a, b, 0.1) for k, a, b in _RUNGS))).alias("p"), (2500 + 100 * (F.col("vec_id") % 5 - 2)).alias("price"))
    return op.ladder_sum(rows, "vec_id").withColumn("total", F.round("total", 9))


@query("brier", """SELECT grp, count(*) AS n, round(avg((p - o) * (p - o)), 6) AS brier, round(avg(o) * (1 - avg(o)), 6) AS baseline, round(CASE WHEN avg(o) * (1 - avg(o)) > 0 THEN 1 - avg((p - o) * (p - o)) / (avg(o) * (1 - avg(o))) END, 6) AS skill,
  round(avg((lead / 50 - o) * (lead / 50 - o)), 6) AS market, round(round(avg((lead / 50 - o) * (lead / 50 - o)), 6) - round(avg((p - o) * (p - o)), 6), 6) AS delta FROM v_scored GROUP BY grp""")
def brier(spark, sf_dir):
    return op.brier(view(spark, sf_dir, "v_scored").withColumn("q", F.col("lead") / 50), ["grp"], "q")


@query("reliability", """WITH b AS (SELECT least(floor(p * 20), 19)::INT AS bin, count(*) AS n, avg(p) AS predicted, avg(o) AS observed FROM v_scored GROUP BY 1)
  SELECT r.bin::INT AS bin, coalesce(n, 0) AS n, coalesce(round(predicted, 9), 0) AS predicted, coalesce(round(observed, 9), 0) AS observed FROM (SELECT unnest(range(0, 20)) AS bin) r LEFT JOIN b ON b.bin = r.bin""")
def reliability(spark, sf_dir):
    return op.reliability(view(spark, sf_dir, "v_scored"), 20)


@query("log_loss_hit_rate", f"""WITH {_SCORED}, l AS (SELECT *, -CASE WHEN o = 1 THEN ln(least(greatest(p, 1e-6), 1 - 1e-6)) ELSE ln(1 - least(greatest(p, 1e-6), 1 - 1e-6)) END AS ll, CASE WHEN (p >= 0.5) = (o = 1) THEN 1 ELSE 0 END AS hit FROM sc)
  SELECT grp, bucket, month, count(*) AS n, round(avg((p - o) * (p - o)), 9) AS brier, round(avg(ll), 9) AS log_loss, round(avg(hit), 9) AS hit_rate,
  round(sum(net), 2) AS net, round(avg((lead / 50 - o) * (lead / 50 - o)), 9) AS baseline, round(avg((p - o) * (p - o)), 9) < round(avg((lead / 50 - o) * (lead / 50 - o)), 9) AS beats_baseline FROM l GROUP BY GROUPING SETS ((grp, bucket, month), (grp))""")
def log_loss_hit_rate(spark, sf_dir):
    return op.log_loss_hit_rate(_scored(spark, sf_dir).withColumn("mid", F.col("lead") / 50))


@query("lead_bucket", f"WITH {_SCORED} SELECT bucket, count(*) AS n FROM sc GROUP BY bucket")
def lead_bucket(spark, sf_dir):
    return _scored(spark, sf_dir).groupBy("bucket").agg(F.count("*").alias("n"))


@query("calibration_cells", """WITH s AS (SELECT CASE WHEN o = 1 THEN 'edge' ELSE 'tails' END AS strategy, CAST(p AS DOUBLE) / 3 AS price, CASE WHEN CAST(lead AS BIGINT) % 7 > 0 THEN CAST(lead AS BIGINT) * 2 END AS hours FROM v_scored)
  SELECT strategy, CASE strategy WHEN 'tails' THEN CASE WHEN price <= 0.02 THEN 0 ELSE 1 END ELSE CASE WHEN price <= 0.05 THEN 0 WHEN price <= 0.10 THEN 1 WHEN price <= 0.15 THEN 2 WHEN price <= 0.20 THEN 3 WHEN price <= 0.30 THEN 4 ELSE 5 END END::BIGINT AS price,
    CASE WHEN hours IS NULL THEN -1 WHEN hours <= 12 THEN 0 WHEN hours <= 24 THEN 1 ELSE 2 END::BIGINT AS lead, count(*) AS n FROM s GROUP BY 1, 2, 3""")
def calibration_cells(spark, sf_dir):
    rows = view(spark, sf_dir, "v_scored")
    hours = F.col("lead").cast("long")
    cell = op.calibration_cell(F.when(F.col("o") == 1, "edge").otherwise("tails"), F.col("p").cast("double") / 3, F.when(hours % 7 > 0, hours * 2))
    return rows.select(cell.alias("x")).select("x.*").groupBy("strategy", "price", "lead").agg(F.count("*").alias("n"))


@query("skip_funnel", "SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY o_orderpriority), 9) AS share FROM orders GROUP BY 1, 2")
def skip_funnel(spark, sf_dir):
    return op.skip_funnel(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus")


@query("depth_table", f"""WITH {_SCORED}, o AS (SELECT l_linenumber % 4 AS series, bucket, count(*) AS n, quantile_cont(net, 0.5) AS own FROM sc GROUP BY 1, 2), w AS (SELECT bucket, quantile_cont(net, 0.5) AS pooled FROM sc GROUP BY 1)
  SELECT series, bucket, n, round(CASE WHEN n >= 700 THEN own ELSE pooled END, 6) AS depth FROM o JOIN w USING (bucket)""")
def depth_table(spark, sf_dir):
    rows = _scored(spark, sf_dir).select((F.col("l_linenumber") % 4).alias("series"), "bucket", F.col("net").alias("depth"))
    return op.depth_table(rows, 700).withColumn("depth", F.round("depth", 6))


@query("sigma_by_lead", f"WITH {_EMB} SELECT bucket, count(*) AS n, round(quantile_cont(list_stddev_pop(members), 0.5), 9) AS median_sigma FROM em GROUP BY bucket")
def sigma_by_lead(spark, sf_dir):
    return op.sigma_by_lead(_members(spark, sf_dir).withColumn("sigma", op.member_spread("members")))


@query("spread_calibration", f"WITH {_EMB}, e AS (SELECT bucket, members[1] AS centre, unnest(members) AS m FROM em) SELECT bucket, count(*) AS points, round(sqrt(avg((m - centre) * (m - centre))), 9) AS sigma FROM e GROUP BY bucket")
def spread_calibration(spark, sf_dir):
    return op.spread_calibration(_members(spark, sf_dir).withColumn("centre", F.get("members", F.lit(0))), "members", "centre")


_KNOTS = """su AS (SELECT grp, p, sum(o)::DOUBLE AS t, count(*)::DOUBLE AS w, row_number() OVER (PARTITION BY grp ORDER BY p) AS i FROM v_scored GROUP BY grp, p), cu AS (SELECT *, sum(t) OVER (PARTITION BY grp ORDER BY i) AS ct, sum(w) OVER (PARTITION BY grp ORDER BY i) AS cw FROM su),
  ab AS (SELECT a.grp, a.i AS a, b.i AS b, (b.ct - a.ct + a.t) / (b.cw - a.cw + a.w) AS m FROM cu a JOIN cu b ON a.grp = b.grp AND a.i <= b.i),
  lo AS (SELECT c.grp, c.i, ab.a, min(m) AS m FROM cu c JOIN ab ON c.grp = ab.grp AND ab.a <= c.i AND ab.b >= c.i GROUP BY ALL), knots AS (SELECT cu.grp, p, w::BIGINT AS n, round(max(m), 9) AS calibrated FROM cu JOIN lo ON cu.grp = lo.grp AND cu.i = lo.i GROUP BY ALL)"""


@query("isotonic_calibration", f"WITH {_KNOTS} SELECT * FROM knots")
def isotonic_calibration(spark, sf_dir):
    return op.isotonic_calibration(view(spark, sf_dir, "v_scored"), "grp")


@query("apply_calibration", f"""WITH {_KNOTS}, d AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'O' ELSE 'F' END AS grp, (o_orderkey % 120) / 100.0::DOUBLE AS p FROM orders),
  j AS (SELECT d.*, (SELECT arg_max((k.p, calibrated), k.p) FROM knots k WHERE k.grp = d.grp AND k.p <= d.p) AS a, (SELECT arg_min((k.p, calibrated), k.p) FROM knots k WHERE k.grp = d.grp AND k.p >= d.p) AS b FROM d)
  SELECT o_orderkey, grp, p, round(CASE WHEN a IS NULL OR b IS NULL THEN p ELSE a[2] + CASE WHEN b[1] > a[1] THEN (p - a[1]) / (b[1] - a[1]) ELSE 0 END * (b[2] - a[2]) END, 9) AS q FROM j""")
def apply_calibration(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "O").otherwise("F").alias("grp"), ((F.col("o_orderkey") % 120) / 100).alias("p"))
    return op.calibrated(rows, isotonic_calibration(spark, sf_dir), "grp")


_JOB = """da AS (SELECT grp, ship - DATE '1970-01-01' AS day, p, sum(o)::DOUBLE AS t, count(*)::DOUBLE AS w FROM v_scored GROUP BY ALL),
  ho AS (SELECT grp, day {div} 7 AS period, p, sum(t) AS t, sum(w) AS w FROM da GROUP BY ALL), tx AS (SELECT *, unnest(range(day {div} 7 + 1, (day + 83) {div} 7 + 1)) AS period FROM da),
  tr AS (SELECT grp, period, p, sum(t) AS t, sum(w) AS w FROM tx GROUP BY ALL), ga AS (SELECT grp, period, sum(w)::BIGINT AS train_n, sum(t)::BIGINT AS positives FROM tr GROUP BY ALL),
  su AS (SELECT concat(period, '|', grp) AS grp, p, t, w, row_number() OVER (PARTITION BY grp, period ORDER BY p) AS i FROM tr JOIN ga USING (grp, period) WHERE train_n >= 300 AND positives >= 30), """ + _KNOTS[_KNOTS.index("cu AS"):] + """,
  ak AS (SELECT ho.*, back, concat(period - back, '|', grp) AS key FROM ho, (SELECT 0 AS back UNION ALL SELECT 1) x),
  jn AS (SELECT ak.*, (SELECT arg_max((k.p, calibrated), k.p) FROM knots k WHERE k.grp = key AND k.p <= ak.p) AS a, (SELECT arg_min((k.p, calibrated), k.p) FROM knots k WHERE k.grp = key AND k.p >= ak.p) AS b FROM ak),
  qs AS (SELECT *, round(CASE WHEN a IS NULL OR b IS NULL THEN p ELSE a[2] + CASE WHEN b[1] > a[1] THEN (p - a[1]) / (b[1] - a[1]) ELSE 0 END * (b[2] - a[2]) END, 9) AS q FROM jn),
  sr AS (SELECT grp, period, back, sum(w) AS n, sum(t) AS hits, round(sum(w * q * q - 2 * q * t + t) / sum(w), 9) AS score FROM qs GROUP BY grp, period, back)"""


@query("calibration_job", f"""WITH {_JOB} SELECT x.grp, x.period, coalesce(train_n, 0) AS train_n, coalesce(positives, 0) AS positives, coalesce(train_n >= 300 AND positives >= 30, false) AS fitted, x.n::BIGINT AS n, x.score AS brier_new, y.score AS brier_previous, x.score < y.score AS improved,
  round(CASE WHEN x.hits > 0 AND x.hits < x.n THEN 1 - x.score / (x.hits / x.n * (1 - x.hits / x.n)) END, 6) AS skill FROM sr x JOIN sr y ON x.grp = y.grp AND x.period = y.period AND x.back = 0 AND y.back = 1 LEFT JOIN ga ON ga.grp = x.grp AND ga.period = x.period""")
def calibration_job(spark, sf_dir):
    return op.calibration_job(view(spark, sf_dir, "v_scored").select("grp", F.unix_date("ship").cast("long").alias("day"), "p", "o"), "grp")


_X = ["a", "b", "c"]


def _panel(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(F.round(F.col("l_discount") * 100).cast("long").alias("a"), F.round(F.col("l_tax") * 100).cast("long").alias("b"), F.col("l_quantity").cast("long").alias("c"), F.when(F.col("l_returnflag") == "R", 50).otherwise(20).cast("long").alias("y"))


_PANEL = "pn AS (SELECT CAST(round(l_discount * 100) AS BIGINT) AS a, CAST(round(l_tax * 100) AS BIGINT) AS b, CAST(l_quantity AS BIGINT) AS c, CASE WHEN l_returnflag = 'R' THEN 50 ELSE 20 END AS y FROM lineitem)"


@query("nnls_gram", f"WITH {_PANEL} SELECT " + ", ".join(f"sum({p} * {q})::BIGINT AS {p}_{q}" for i, p in enumerate(_X) for q in [*_X[i:], "y"]) + " FROM pn")
def nnls_gram(spark, sf_dir):
    return op.gram(_panel(spark, sf_dir), _X, "y")


#: The best of the seven sets of columns by Cramer's rule.
_BLEND = "gr AS (SELECT " + ", ".join(f"sum({p} * {q})::DOUBLE AS {p}{'f' if q == 'y' else q}" for i, p in enumerate(_X) for q in [*_X[i:], "y"]) + """ FROM pn),
  so AS (SELECT gr.*, af / aa AS wa, 0.0::DOUBLE AS wb, 0.0::DOUBLE AS wc FROM gr UNION ALL SELECT gr.*, 0, bf / bb, 0 FROM gr UNION ALL SELECT gr.*, 0, 0, cf / cc FROM gr
    UNION ALL SELECT gr.*, (af * bb - bf * ab) / (aa * bb - ab * ab), (aa * bf - ab * af) / (aa * bb - ab * ab), 0 FROM gr
    UNION ALL SELECT gr.*, (af * cc - cf * ac) / (aa * cc - ac * ac), 0, (aa * cf - ac * af) / (aa * cc - ac * ac) FROM gr
    UNION ALL SELECT gr.*, 0, (bf * cc - cf * bc) / (bb * cc - bc * bc), (bb * cf - bc * bf) / (bb * cc - bc * bc) FROM gr
    UNION ALL SELECT gr.* EXCLUDE d, (af * (bb * cc - bc * bc) - ab * (bf * cc - bc * cf) + ac * (bf * bc - bb * cf)) / d, (aa * (bf * cc - bc * cf) - af * (ab * cc - bc * ac) + ac * (ab * cf - bf * ac)) / d,
      (aa * (bb * cf - bf * bc) - ab * (ab * cf - bf * ac) + af * (ab * bc - bb * ac)) / d FROM (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS d FROM gr) gr),
  be AS (SELECT wa, wb, wc, wa + wb + wc AS w FROM so WHERE wa >= 0 AND wb >= 0 AND wc >= 0 ORDER BY wa * af + wb * bf + wc * cf DESC LIMIT 1)"""


@query("nnls_blend", f"WITH {_PANEL}, {_BLEND} SELECT 'a' AS member, round(wa / w, 9) AS weight FROM be UNION ALL SELECT 'b', round(wb / w, 9) FROM be UNION ALL SELECT 'c', round(wc / w, 9) FROM be")
def nnls_blend(spark, sf_dir):
    return op.nnls_blend(_panel(spark, sf_dir), _X, "y").withColumn("weight", F.round("weight", 9))


@query("decision_snapshot", """WITH c AS (SELECT ticker, max(us) AS close_us FROM v_mid GROUP BY ticker), x AS (SELECT c.*, close_us - 43200000000 AS as_of, (SELECT arg_max((mid2, us), (us, id)) FROM v_mid m WHERE m.ticker = c.ticker AND us <= close_us - 43200000000) AS s FROM c)
  SELECT ticker, close_us, as_of, CASE WHEN as_of - s[2] <= 86400000000 THEN s[1] END AS mid2, CASE WHEN as_of - s[2] <= 86400000000 THEN s[2] END AS snapshot_us FROM x""")
def decision_snapshot(spark, sf_dir):
    mids = view(spark, sf_dir, "v_mid")
    return op.decision_snapshot(mids, mids.groupBy("ticker").agg(F.max("us").alias("close_us")), 12 * HOUR, 24 * HOUR)


@query("depth_screen", """WITH k AS (SELECT units, row_number() OVER (ORDER BY units) - 1 AS i, count(*) OVER () AS m FROM v_prints) SELECT count(*) AS n, count(*) FILTER (units >= 2600) AS kept, count(*) FILTER (units = 0) AS zeros, max(units) AS most,
  (SELECT min(units) FROM k WHERE i = floor((m - 1) * 0.1)) AS p10, (SELECT min(units) FROM k WHERE i = floor((m - 1) * 0.5)) AS p50, (SELECT min(units) FROM k WHERE i = floor((m - 1) * 0.9)) AS p90 FROM v_prints""")
def depth_screen(spark, sf_dir):
    return op.depth_screen(view(spark, sf_dir, "v_prints"), "units", 2600)


_LEGS = "lg AS (SELECT l_orderkey * 10 + l_linenumber AS leg_id, p, 100 * (1 + CAST(lead AS BIGINT) * 2 % 97) AS price, 100 * CAST(lead AS BIGINT) AS units, o AS won, CAST(lead AS BIGINT) AS lead, l_linenumber * 5 - 5 AS depth FROM v_scored)"


def _legs(spark, sf_dir):
    lead = F.col("lead").cast("long")
    return view(spark, sf_dir, "v_scored").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("leg_id"), "p", (100 * (1 + lead * 2 % 97)).alias("price"), (100 * lead).alias("units"), F.col("o").alias("won"), lead.alias("lead"), (F.col("l_linenumber") * 5 - 5).cast("long").alias("depth"))


@query("entry_pnl", f"""WITH {_LEGS}, s AS (SELECT *, CASE WHEN round(p * 10000) > price THEN 'yes' WHEN round(p * 10000) < price THEN 'no' ELSE 'none' END AS side FROM lg), t AS (SELECT *, CASE side WHEN 'yes' THEN price WHEN 'no' THEN 10000 - price END AS x, CASE WHEN (side = 'yes') = (won = 1) THEN 10000 ELSE 0 END AS settled FROM s)
  SELECT leg_id, side, x AS executed, units * (settled - x - 100) - 10000 * ((7 * units * x * (10000 - x) + 9999999999) {{div}} 10000000000) AS net,
    units * (settled - x - 200) - 10000 * ((7 * units * (x + 100) * (9900 - x) + 9999999999) {{div}} 10000000000) AS walked_net FROM t""")
def entry_pnl(spark, sf_dir):
    return op.entry_pnl(_legs(spark, sf_dir))


@query("stake_columns", f"""WITH {_LEGS}, k AS (SELECT leg_id, price, depth, greatest((p - price / 10000.0::DOUBLE) / (1 - price / 10000.0::DOUBLE), 0) AS kelly FROM lg)
  SELECT leg_id, round(kelly, 9) AS kelly, least(floor(round(kelly * 25 / 100 * 10000000 / price, 6)), depth)::BIGINT AS contracts FROM k""")
def stake_columns(spark, sf_dir):
    return op.stake_columns(_legs(spark, sf_dir), 100_000, 25).select("leg_id", "kelly", "contracts")


@query("strategy_columns", f"WITH {_LEGS} SELECT leg_id, CASE WHEN depth <= 0 THEN 'no_depth' WHEN price < 500 THEN 'price_low' WHEN price > 9500 THEN 'price_high' WHEN p * 10000 - price < 300 THEN 'edge' WHEN lead > 40 THEN 'lead' END AS reason FROM lg")
def strategy_columns(spark, sf_dir):
    return op.strategy_columns(_legs(spark, sf_dir)).select("leg_id", "reason")


@query("gate_columns", f"""WITH {_LEGS}, g AS (SELECT leg_id, list_filter([CASE WHEN depth < 10 THEN 'depth' END, CASE WHEN price < 500 OR price > 9500 THEN 'price' END, CASE WHEN p * 10000 - price < 300 THEN 'edge' END, CASE WHEN lead > 40 THEN 'lead' END], lambda x: x IS NOT NULL) AS f FROM lg)
  SELECT leg_id, coalesce(array_to_string(f, ','), '') AS failed, len(f) = 0 AS passed FROM g""")
def gate_columns(spark, sf_dir):
    return op.gate_columns(_legs(spark, sf_dir)).select("leg_id", "failed", "passed")


@query("sigma_band", f"WITH {_EMB}, m AS (SELECT unnest([0.5, 1.0, 2.0]) AS multiplier) " + " UNION ALL ".join(f"SELECT vec_id, {m}::DOUBLE AS multiplier, round(sqrt({m} * {m} * 0.01 + 1), 9) AS effective, round({_sql_cdf('members', 0.05, f'sqrt({m} * {m} * 0.01 + 1)')}, 9) AS p FROM em" for m in (0.5, 1.0, 2.0)))
def sigma_band(spark, sf_dir):
    return op.sigma_band(_members(spark, sf_dir), "members", 0.05, 0.1, [0.5, 1.0, 2.0])


@query("fidelity_bounds", "SELECT grp, o, count(*) AS n, round(quantile_cont(abs(p - lead / 50), 0.5), 9) AS median, round(quantile_cont(abs(p - lead / 50), 0.5), 9) <= 0.34 AS within FROM v_scored GROUP BY grp, o")
def fidelity_bounds(spark, sf_dir):
    return op.fidelity_bounds(view(spark, sf_dir, "v_scored").withColumn("q", F.col("lead") / 50), ["grp", "o"], "p", "q", 0.34)


@query("stop_rules", """WITH r AS (SELECT strftime(ship, '%Y') AS year, grp AS city, CASE WHEN o = 1 THEN 60 ELSE -30 END AS net FROM v_scored), c AS (SELECT year, city, sum(net)::BIGINT AS net FROM r GROUP BY 1, 2),
  w AS (SELECT year, sum(net)::BIGINT AS net, count(*) FILTER (net < 0) AS losing, count(*) AS cities, bool_and(net < 0) AS all_negative FROM c GROUP BY year) SELECT *, CASE WHEN all_negative THEN 'stop' WHEN net < 0 THEN 'watch' ELSE 'go' END AS verdict FROM w""")
def stop_rules(spark, sf_dir):
    rows = view(spark, sf_dir, "v_scored").select(F.date_format("ship", "yyyy").alias("year"), F.col("grp").alias("city"), F.when(F.col("o") == 1, 60).otherwise(-30).cast("long").alias("net"))
    return op.stop_rules(rows, "year", "city", "net")


@query("fills_by_decile", """SELECT least(floor((us % 86400000000) * 10 / 86400000000), 9)::BIGINT AS decile, count(*) FILTER (taker_side = 'yes') AS yes, count(*) FILTER (taker_side = 'no') AS no FROM v_prints GROUP BY 1""")
def fills_by_decile(spark, sf_dir):
    fills = view(spark, sf_dir, "v_prints").select(F.lit(0).cast("long").alias("a"), F.expr("us % 86400000000").alias("at"), F.lit(24 * HOUR).alias("b"), F.col("taker_side").alias("side"))
    return op.fills_by_decile(fills, "a", "at", "b")


@query("quantiles", "WITH k AS (SELECT event_type, c, row_number() OVER (PARTITION BY event_type ORDER BY c) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS m FROM ev) SELECT event_type, " + ", ".join(
    f"(SELECT min(c) FROM k WHERE k.event_type = e.event_type AND i = {place}) AS q_{rule}" for rule, place in (("nearest", "greatest(ceil(m * 0.35) - 1, 0)"), ("even", "round_even((m - 1) * 0.35, 0)"), ("up", "floor((m - 1) * 0.35 + 0.5)"), ("floor", "floor((m - 1) * 0.35)"))) + " FROM ev e GROUP BY event_type")
def quantiles(spark, sf_dir):
    rows, out = view(spark, sf_dir, "ev"), None
    for rule in ("nearest", "even", "up", "floor"):
        one = quantile(rows, ["event_type"], "c", 0.35, rule, f"q_{rule}")
        out = one if out is None else out.join(one, "event_type")
    return out


@query("weighted_quantile", "WITH b AS (SELECT event_type, k, sum(c) AS w FROM ev GROUP BY 1, 2), u AS (SELECT *, sum(w) OVER (PARTITION BY event_type ORDER BY k) AS upto, sum(w) OVER (PARTITION BY event_type) AS tot FROM b) SELECT event_type, min(k) AS q FROM u WHERE upto >= tot * 0.75 GROUP BY event_type")
def weighted(spark, sf_dir):
    return weighted_quantile(view(spark, sf_dir, "ev"), ["event_type"], "k", "c", 0.75, "q")


@query("pseudo_members", """WITH z AS (SELECT [-1.0, -0.5, 0.0, 0.5, 1.0] AS z), s AS (SELECT list_transform(z, lambda x: x / list_stddev_samp(z) * 2.5) AS z FROM z) SELECT l_orderkey, l_linenumber, round(lead + z[1], 9) AS low, round(lead + z[5], 9) AS high FROM v_scored, s""")
def pseudo_members(spark, sf_dir):
    m = op.pseudo_members("lead", 2.5, [-1.0, -0.5, 0.0, 0.5, 1.0])
    return view(spark, sf_dir, "v_scored").select("l_orderkey", "l_linenumber", F.round(F.get(m, F.lit(0)), 9).alias("low"), F.round(F.get(m, F.lit(4)), 9).alias("high"))
