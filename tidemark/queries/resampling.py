from pyspark.sql import functions as F

from tidemark.operators import resampling as op
from tidemark.operators.inference import day_blocks
from tidemark.queries import query
from tidemark.queries.inference import _BLOCKS, _CLUSTERS, _blocks, _clusters, _draw
from tidemark.sources.adapters import view

R = 10_000
_EPS = f"{op.EPSILON!r}::DOUBLE"


@query("ratio_bootstrap", f"""WITH {_CLUSTERS}, nu AS (SELECT *, row_number() OVER (ORDER BY ticker) - 1 AS i, count(*) OVER () AS n FROM cl), dr AS (SELECT rep, {_draw(17, "rep", "i")} % n AS i FROM nu, (SELECT unnest(range(0, {R})) AS rep) x),
  re AS (SELECT rep, sum(total) / sum(weight) AS r FROM dr JOIN nu USING (i) GROUP BY rep), po AS (SELECT sum(total) / sum(weight) AS estimate, count(*) AS clusters FROM cl),
  st AS (SELECT any_value(estimate) AS estimate, any_value(clusters) AS clusters, count(*) FILTER (r - estimate <= estimate - 0.01 + 1e-9) AS extreme, quantile_cont(r, 0.05) AS lo, quantile_cont(r, 0.95) AS hi, stddev_pop(r) AS spread, avg(abs(r)) AS scale FROM re, po)
  SELECT round(estimate, 8) AS estimate, clusters, round((1 + extreme) / {R + 1}.0, 9) AS p_value, round(2 * estimate - hi, 8) AS low, round(2 * estimate - lo, 8) AS high, round(spread, 8) AS spread, spread <= {R} * {_EPS} * scale AS degenerate FROM st""")
def ratio_bootstrap(spark, sf_dir):
    out = op.ratio_bootstrap(_clusters(spark, sf_dir), ["ticker"], 17, R, 0.01, "less", 0.9)
    return out.select(*(F.round(c, 9 if c == "p_value" else 8).alias(c) if c not in ("clusters", "degenerate") else c for c in out.columns))


def _side(name, residual, bulk, seed):
    return f"""{name}_f AS (SELECT rep, w, n, {bulk} AS bulk, CASE WHEN {_draw(seed, "rep", "i")} % 2 = 0 THEN {residual} ELSE -{residual} END AS s FROM nu, (SELECT unnest(range(0, {R})) AS rep) x),
  {name}_o AS (SELECT rep, sum(s) / sum(w) AS o FROM {name}_f GROUP BY rep), {name}_e AS (SELECT rep, any_value(o) AS o, sqrt(sum((s - o * w) * (s - o * w))) / sum(w) AS se, sqrt(sum((bulk + abs(o * w)) * (bulk + abs(o * w)))) / sum(w) AS scale, sum(n) AS n FROM {name}_f JOIN {name}_o USING (rep) GROUP BY rep),
  {name}_t AS (SELECT se <= n * {_EPS} * scale AS flat, CASE WHEN se > n * {_EPS} * scale THEN o / se END AS ts FROM {name}_e)"""


@query("wild_t_bootstrap", f"""WITH {_BLOCKS}, po AS (SELECT sum(total) / sum(weight) AS theta FROM bl),
  b AS (SELECT grp, block, sum(weight)::DOUBLE AS w, count(*) AS n, sum(total - 3.0::DOUBLE * weight) AS own, sum(abs(total - 3.0::DOUBLE * weight)) AS own_bulk, sum(total - theta * weight) AS free, sum(abs(total - theta * weight)) AS free_bulk FROM bl, po GROUP BY grp, block),
  nu AS (SELECT *, row_number() OVER (ORDER BY grp, block) - 1 AS i FROM b), er AS (SELECT any_value(theta) AS theta, sqrt(sum(free * free)) / sum(w) AS se, (any_value(theta) - 3.0) / (sqrt(sum(free * free)) / sum(w)) AS t, count(*) AS blocks FROM b, po),
  {_side("own", "own", "own_bulk", 23)}, {_side("fr", "free", "free_bulk", 24)},
  te AS (SELECT count(*) FILTER (flat OR ts >= t - 1e-9) AS extreme, count(*) FILTER (flat) AS flat FROM own_t, er), ci AS (SELECT quantile_cont(ts, 0.025) AS lo, quantile_cont(ts, 0.975) AS hi FROM fr_t)
  SELECT round(theta, 6) AS estimate, round(se, 6) AS standard_error, round(t, 6) AS t, round((1 + extreme) / {R + 1}.0, 9) AS p_value, round(theta - se * hi, 5) AS low, round(theta - se * lo, 5) AS high, blocks, flat FROM er, te, ci""")
def wild_t_bootstrap(spark, sf_dir):
    out = op.wild_t_bootstrap(_blocks(spark, sf_dir), ["grp", "block"], 23, R, 3.0)
    places = {"p_value": 9, "low": 5, "high": 5, "blocks": None, "flat": None}
    return out.select(*(c if places.get(c, 6) is None else F.round(c, places.get(c, 6)).alias(c) for c in out.columns))


_FLIPS, _VALUES = 200, """vd AS (SELECT user_id, user_id % 7 AS grp, us {div} 86400000000 AS day, sum(CASE WHEN event_type = 'click' THEN c ELSE -c END)::BIGINT AS total, count(*) FILTER (event_type = 'error') > 1 AS open FROM ev GROUP BY 1, 2, 3),
  vl AS (SELECT grp, (dense_rank() OVER (PARTITION BY grp ORDER BY day) - 1) {div} 3 AS block, CASE WHEN NOT open THEN total END AS value FROM vd)"""


@query("median_interval", f"""WITH {_VALUES}, vk AS (SELECT grp, block, count(*) AS w, row_number() OVER (ORDER BY grp, block) - 1 AS i FROM vl GROUP BY grp, block),
  cd AS (SELECT DISTINCT value AS c FROM vl WHERE value IS NOT NULL), s AS (SELECT i, c, any_value(w) AS w, sum(CASE WHEN value IS NULL THEN 1 ELSE sign(value - c) END)::BIGINT AS s FROM vl JOIN vk USING (grp, block), cd GROUP BY i, c),
  wh AS (SELECT c, sum(w)::DOUBLE AS W1, sum(w * w)::DOUBLE AS W2, sum(s * s)::DOUBLE AS q, sum(s)::DOUBLE AS a0, sum(s * w)::DOUBLE AS b0 FROM s GROUP BY c), sg AS (SELECT rep, i, CASE WHEN {_draw(5, "rep", "i")} % 2 = 0 THEN 1 ELSE -1 END AS f FROM vk, (SELECT unnest(range(0, {_FLIPS})) AS rep) x),
  re AS (SELECT c, rep, sum(f * s)::DOUBLE AS a, sum(f * s * w)::DOUBLE AS b FROM s JOIN sg USING (i) GROUP BY c, rep),
  ts AS (SELECT c, CASE WHEN q - 2 * (a / W1) * b + (a / W1) * (a / W1) * W2 > 1e-9 * q THEN a / sqrt(q - 2 * (a / W1) * b + (a / W1) * (a / W1) * W2) END AS t,
    CASE WHEN q - 2 * (a0 / W1) * b0 + (a0 / W1) * (a0 / W1) * W2 > 1e-9 * q THEN a0 / sqrt(q - 2 * (a0 / W1) * b0 + (a0 / W1) * (a0 / W1) * W2) END AS o FROM re JOIN wh USING (c)),
  pv AS (SELECT c, any_value(o) IS NOT NULL AND (1 + count(*) FILTER (t IS NULL OR t >= o - 1e-9)) / {_FLIPS + 1}.0 > 0.05 AS g, any_value(o) IS NOT NULL AND (1 + count(*) FILTER (t IS NULL OR t <= o + 1e-9)) / {_FLIPS + 1}.0 > 0.05 AS l FROM ts GROUP BY c),
  nn AS (SELECT count(*) AS n, count(*) - count(value) AS censored FROM vl), es AS (SELECT min(value) AS estimate FROM (SELECT value, row_number() OVER (ORDER BY value NULLS LAST) AS r FROM vl), nn WHERE 2 * r >= n AND value IS NOT NULL)
  SELECT estimate, (SELECT min(c) FROM pv WHERE c <= estimate AND c > coalesce((SELECT max(c) FROM pv WHERE c <= estimate AND NOT g), -9e18)) AS low, (SELECT max(c) FROM pv WHERE c >= estimate AND c < coalesce((SELECT min(c) FROM pv WHERE c >= estimate AND NOT l), 9e18)) AS high, n, censored FROM es, nn""")
def median_interval(spark, sf_dir):
    signed = F.when(F.col("event_type") == "click", F.col("c")).otherwise(-F.col("c"))
    days = view(spark, sf_dir, "ev").groupBy("user_id", (F.col("user_id") % 7).alias("grp"), F.expr("us div 86400000000").alias("day")).agg(F.sum(signed).alias("total"), (F.count_if(F.col("event_type") == "error") > 1).alias("open"))
    rows = day_blocks(days).select("grp", "block", F.when(~F.col("open"), F.col("total")).alias("value"))
    return op.median_interval(rows, ["grp", "block"], "value", 5, _FLIPS, 0.9)
