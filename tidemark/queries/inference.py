from pyspark.sql import functions as F

from tidemark.operators import inference as op
from tidemark.queries import query
from tidemark.sources.adapters import table, view

R = 200
_CLUSTERS = "cl AS (SELECT ticker, sum(CASE WHEN taker_side = 'yes' THEN units ELSE -units END)::BIGINT AS total, sum(units)::BIGINT AS weight FROM v_prints GROUP BY ticker HAVING sum(units) > 0)"
_DRAW = "('0x' || substr(md5({seed} || '-' || {rep} || '-' || {i}), 1, 8))::BIGINT"


def _draw(seed, rep, i):
    return _DRAW.format(seed=f"'{seed}'", rep=rep, i=i)


def _clusters(spark, sf_dir):
    rows = view(spark, sf_dir, "v_prints").withColumn("signed", F.when(F.col("taker_side") == "yes", F.col("units")).otherwise(-F.col("units")))
    return op.cluster_builder(rows, ["ticker"], "signed", "units")


@query("cluster_builders", f"WITH {_CLUSTERS} SELECT * FROM cl")
def cluster_builders(spark, sf_dir):
    return _clusters(spark, sf_dir)


@query("cluster_bootstrap", f"""WITH {_CLUSTERS}, nu AS (SELECT *, row_number() OVER (ORDER BY ticker) - 1 AS i, count(*) OVER () AS n FROM cl), dr AS (SELECT rep, {_draw(7, "rep", "i")} % n AS i FROM nu, (SELECT unnest(range(0, {R})) AS rep) x),
  re AS (SELECT rep, sum(total) / sum(weight) AS r FROM dr JOIN nu USING (i) GROUP BY rep), po AS (SELECT sum(total) / sum(weight) AS estimate, count(*) AS clusters FROM cl)
  SELECT round(any_value(estimate), 6) AS estimate, any_value(clusters) AS clusters, round((1 + count(*) FILTER (r - estimate >= estimate)) / {R + 1}.0, 9) AS p_value, round(2 * any_value(estimate) - quantile_disc(r, 0.975), 6) AS low, round(2 * any_value(estimate) - quantile_disc(r, 0.025), 6) AS high, stddev_samp(r) = 0 AS degenerate FROM re, po""")
def cluster_bootstrap(spark, sf_dir):
    return op.cluster_bootstrap(_clusters(spark, sf_dir), ["ticker"], 7, R)


@query("cluster_median_bootstrap", f"""WITH v AS (SELECT ticker, units FROM v_prints), nu AS (SELECT ticker, row_number() OVER (ORDER BY ticker) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT ticker FROM v)),
  dr AS (SELECT rep, {_draw(11, "rep", "i")} % n AS i FROM nu, (SELECT unnest(range(0, 50)) AS rep) x), re AS (SELECT rep, quantile_cont(units, 0.5) AS m FROM dr JOIN nu USING (i) JOIN v USING (ticker) GROUP BY rep), po AS (SELECT quantile_cont(units, 0.5) AS estimate FROM v)
  SELECT any_value(estimate) AS estimate, 2 * any_value(estimate) - quantile_disc(m, 0.975) AS low, 2 * any_value(estimate) - quantile_disc(m, 0.025) AS high FROM re, po""")
def cluster_median_bootstrap(spark, sf_dir):
    return op.cluster_median_bootstrap(view(spark, sf_dir, "v_prints"), "ticker", "units", 11, 50)


_BLOCKS = "db AS (SELECT user_id % 7 AS grp, us {div} 86400000000 AS day, sum(CASE WHEN event_type = 'click' THEN c ELSE -c END)::BIGINT AS total, count(*) AS weight FROM ev GROUP BY 1, 2), bl AS (SELECT *, (dense_rank() OVER (PARTITION BY grp ORDER BY day) - 1) {div} 3 AS block FROM db)"


def _blocks(spark, sf_dir):
    signed = F.when(F.col("event_type") == "click", F.col("c")).otherwise(-F.col("c"))
    days = view(spark, sf_dir, "ev").groupBy((F.col("user_id") % 7).alias("grp"), F.expr("us div 86400000000").alias("day")).agg(F.sum(signed).alias("total"), F.count("*").alias("weight"))
    return op.day_blocks(days)


@query("day_blocks", f"WITH {_BLOCKS} SELECT * FROM bl")
def day_blocks(spark, sf_dir):
    return _blocks(spark, sf_dir)


@query("wild_cluster_bootstrap", f"""WITH {_BLOCKS}, b AS (SELECT grp, block, sum(total)::BIGINT AS total, sum(weight)::BIGINT AS weight FROM bl GROUP BY grp, block), nu AS (SELECT *, row_number() OVER (ORDER BY grp, block) - 1 AS i FROM b),
  re AS (SELECT rep, abs(sum(CASE WHEN {_draw(3, "rep", "i")} % 2 = 0 THEN total ELSE -total END)) AS t FROM nu, (SELECT unnest(range(0, {R})) AS rep) x GROUP BY rep), po AS (SELECT sum(total) / sum(weight) AS estimate, sqrt(sum(total::DOUBLE * total)) AS scale, sum(total) AS s FROM b)
  SELECT round(any_value(estimate), 6) AS estimate, round(any_value(abs(s) / scale), 6) AS t, round((1 + count(*) FILTER (scale = 0 OR t >= abs(s))) / {R + 1}.0, 9) AS p_value FROM re, po""")
def wild_cluster_bootstrap(spark, sf_dir):
    blocks = op.cluster_builder(_blocks(spark, sf_dir), ["grp", "block"], "total", "weight")
    return op.wild_cluster_bootstrap(blocks, ["grp", "block"], 3, R)


_STUDY = "sy AS (SELECT l_shipmode_free AS grp, split, sum(x)::DOUBLE / count(*) AS estimate, count(DISTINCT l_suppkey) AS clusters, (count(*) % 100) / 1000.0 AS p_value FROM (SELECT concat(l_returnflag, l_linestatus) AS l_shipmode_free, l_suppkey, CASE WHEN l_orderkey % 3 < 2 THEN 'discovery' ELSE 'holdout' END AS split, CAST(l_quantity AS BIGINT) - 25 AS x FROM lineitem) GROUP BY 1, 2)"


def _study(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("grp"), "l_suppkey", F.when(F.col("l_orderkey") % 3 < 2, "discovery").otherwise("holdout").alias("split"), (F.col("l_quantity").cast("long") - 25).alias("x"))
    return rows.groupBy("grp", "split").agg((F.sum("x") / F.count("*")).alias("estimate"), F.count_distinct("l_suppkey").alias("clusters"), (F.count("*") % 100 / 1000).alias("p_value"))


_GATED = f"{_STUDY}, ga AS (SELECT *, estimate IS NULL OR p_value IS NULL AS undecidable, estimate >= 0.5 AS economic, p_value < 0.05 AS significant, clusters >= 30 AS powered, estimate >= 0.5 AND p_value < 0.05 AND clusters >= 30 AS passed FROM sy)"


@query("gate", f"WITH {_GATED} SELECT * FROM ga")
def gate(spark, sf_dir):
    return op.gate(_study(spark, sf_dir), 0.5, 0.05, 30)


@query("gate_strict", f"WITH {_STUDY}, gs AS (SELECT grp, split, estimate, clusters, CASE WHEN clusters % 2 = 0 THEN p_value END AS p_value FROM sy) SELECT *, p_value IS NULL AS undecidable, p_value IS NOT NULL AND estimate < 0.6 AS economic, coalesce(p_value < 0.05, false) AS significant, clusters >= 30 AS powered, coalesce(p_value < 0.05, false) AND estimate < 0.6 AND clusters >= 30 AS passed FROM gs")
def gate_strict(spark, sf_dir):
    """Less than the threshold, and not decidable for an odd number of clusters."""
    return op.gate(_study(spark, sf_dir).withColumn("p_value", F.when(F.col("clusters") % 2 == 0, F.col("p_value"))), 0.6, 0.05, 30, "less", strict=True)


@query("holdout", f"""WITH {_STUDY}, bo AS (SELECT d.grp, d.estimate AS discovery_estimate, d.clusters AS discovery_clusters, h.estimate AS holdout_estimate, h.clusters AS holdout_clusters, h.p_value AS holdout_p_value FROM sy d JOIN sy h ON d.grp = h.grp WHERE d.split = 'discovery' AND h.split = 'holdout'),
  hd AS (SELECT *, CASE WHEN discovery_estimate > 0 THEN 'greater' WHEN discovery_estimate < 0 THEN 'less' END AS direction, sign(discovery_estimate) = sign(holdout_estimate) AND holdout_estimate <> 0 AS same_sign, 2 * abs(holdout_estimate) >= abs(discovery_estimate) AS magnitude, holdout_p_value < 0.05 AS significant, holdout_clusters >= 16 AS powered FROM bo)
  SELECT *, same_sign AND magnitude AND significant AND powered AS held FROM hd""")
def holdout(spark, sf_dir):
    return op.holdout(_study(spark, sf_dir), ["grp"], 0.05, 31)


@query("verdict", f"WITH {_GATED} SELECT *, CASE WHEN estimate IS NULL THEN 'UNDECIDABLE' WHEN NOT powered THEN 'UNDERPOWERED' WHEN passed THEN 'PASS' WHEN powered AND NOT passed THEN 'CLOSED' END AS verdict FROM ga")
def verdict(spark, sf_dir):
    return op.verdict(op.gate(_study(spark, sf_dir), 0.5, 0.05, 30), ["UNDECIDABLE", "UNDERPOWERED", "PASS", "CLOSED"])
