from pyspark.sql import functions as F

from tidemark.operators import book as op
from tidemark.plans.keep import keep
from tidemark.queries import query
from tidemark.sources.adapters import view

_LEVELS = """t AS (SELECT *, CASE WHEN is_snapshot THEN (us, seq) END AS batch FROM v_tape),
  p AS (SELECT *, last_value(batch IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM t),
  ep AS (SELECT *, sum(CASE WHEN is_snapshot AND (was IS NULL OR was <> batch) THEN 1 ELSE 0 END) OVER (PARTITION BY ticker ORDER BY id) AS epoch FROM p),
  sx AS (SELECT *, last_value(CASE WHEN is_snapshot THEN id END IGNORE NULLS) OVER (PARTITION BY ticker, epoch, side, price ORDER BY id ROWS UNBOUNDED PRECEDING) AS set_id FROM ep),
  lv AS (SELECT id, ticker, us, epoch::BIGINT AS epoch, side, price, sum(size) OVER (PARTITION BY ticker, epoch, side, price, set_id ORDER BY id)::BIGINT AS level_size FROM sx)"""
_VALID = f"{_LEVELS}, va AS (SELECT *, lead(id) OVER (PARTITION BY ticker, epoch, side, price ORDER BY id) AS to_id FROM lv)"
_MET = f"""{_VALID}, mt AS (SELECT r.id, v.side, v.price, v.level_size AS size FROM lv r JOIN va v ON r.ticker = v.ticker AND r.epoch = v.epoch AND v.id <= r.id AND (v.to_id IS NULL OR v.to_id > r.id) WHERE v.level_size > 0),
  touch AS (SELECT lv.id, lv.ticker, lv.us, max(CASE WHEN m.side = 'yes' THEN m.price END) AS yes_bid, arg_max(m.size, m.price) FILTER (m.side = 'yes') AS yes_size, max(CASE WHEN m.side = 'no' THEN m.price END) AS no_bid, arg_max(m.size, m.price) FILTER (m.side = 'no') AS no_size
    FROM lv LEFT JOIN mt m ON lv.id = m.id GROUP BY ALL)"""
_POINTS = "pt AS (SELECT event_id AS point_id, concat('M', user_id) AS ticker, us AS at_us FROM ev)"
_STATES = """an AS (SELECT pt.*, (SELECT arg_max((t.us, t.seq), (t.us, t.id)) FROM v_tape t WHERE t.ticker = pt.ticker AND is_snapshot AND t.us <= at_us) AS snap,
    greatest((SELECT max(detected_us) FROM v_gaps g WHERE g.ticker = pt.ticker AND detected_us <= at_us), (SELECT max(detected_us) FROM v_gaps g WHERE g.ticker = '' AND detected_us <= at_us)) AS gap_us FROM pt),
  st AS (SELECT point_id, ticker, at_us, snap[1] AS snap_us, snap[2] AS snap_seq, CASE WHEN snap IS NULL THEN 'no_anchor' WHEN coalesce(gap_us >= snap[1], false) THEN 'gap' ELSE 'ok' END AS status FROM an),
  bk AS (SELECT point_id, side, price, sum(size) AS size FROM st JOIN v_tape t ON t.ticker = st.ticker AND ((is_snapshot AND t.us = snap_us AND t.seq = snap_seq) OR (NOT is_snapshot AND t.us > snap_us AND t.us <= at_us)) WHERE status = 'ok' GROUP BY ALL HAVING sum(size) > 0),
  state AS (SELECT st.point_id, ticker, at_us, status, max(CASE WHEN side = 'yes' THEN price END) AS yes_bid, (arg_max(size, price) FILTER (side = 'yes'))::BIGINT AS yes_size, max(CASE WHEN side = 'no' THEN price END) AS no_bid, (arg_max(size, price) FILTER (side = 'no'))::BIGINT AS no_size
    FROM st LEFT JOIN bk ON st.point_id = bk.point_id GROUP BY ALL)"""
_STATE = f"{_POINTS}, {_STATES}"


def _state(spark, sf_dir):
    points = view(spark, sf_dir, "ev").select(F.col("event_id").alias("point_id"), F.concat(F.lit("M"), "user_id").alias("ticker"), F.col("us").alias("at_us"))
    return op.book_state_at(points, view(spark, sf_dir, "v_tape"), view(spark, sf_dir, "v_gaps"))


@query("book_levels", f"WITH {_LEVELS} SELECT *, level_size < 0 AS violation FROM lv")
def book_levels(spark, sf_dir):
    return op.book_levels(view(spark, sf_dir, "v_tape"))


@query("touch_series", f"WITH {_MET} SELECT * FROM touch")
def touch_series(spark, sf_dir):
    return op.touch_series(view(spark, sf_dir, "v_tape"))


@query("ladder_series", f"""WITH {_MET}, la AS (SELECT lv.id, lv.ticker, coalesce(list(m.price ORDER BY m.price DESC) FILTER (m.side = 'yes'), []) AS yp, coalesce(list(m.size ORDER BY m.price DESC) FILTER (m.side = 'yes'), []) AS ys,
  coalesce(list(m.price ORDER BY m.price DESC) FILTER (m.side = 'no'), []) AS np, coalesce(list(m.size ORDER BY m.price DESC) FILTER (m.side = 'no'), []) AS ns FROM lv LEFT JOIN mt m ON lv.id = m.id GROUP BY ALL)
  SELECT id, ticker, array_to_string(yp[1:3], ',') AS yes_prices, array_to_string(ys[1:3], ',') AS yes_sizes, array_to_string(np[1:3], ',') AS no_prices, array_to_string(ns[1:3], ',') AS no_sizes, len(yp) AS yes_levels, len(np) AS no_levels FROM la""")
def ladder_series(spark, sf_dir):
    ladder = op.ladder_series(view(spark, sf_dir, "v_tape"), depth=3).drop("us")
    return ladder.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("yes_prices", "yes_sizes", "no_prices", "no_sizes")})


@query("book_state_at", f"WITH {_STATE} SELECT * FROM state")
def book_state_at(spark, sf_dir):
    return _state(spark, sf_dir)


#: Tickers of each cohort, and interior rows and batches of each ticker.
_QUOTAS, _INTERIOR, _BATCHES = {"busy": 2, "quiet": 3, "spread": 5}, 12, 4

_COHORTS = f"""tn AS (SELECT ticker, substr(ticker, 1, 2) AS root, count(*) AS n_rows FROM v_tape GROUP BY ticker), rk AS (SELECT *, row_number() OVER (ORDER BY n_rows DESC, ticker) - 1 AS place, count(*) OVER () AS n FROM tn),
  br AS (SELECT root FROM tn GROUP BY root ORDER BY sum(n_rows) DESC, root LIMIT 1), bz AS (SELECT ticker FROM rk WHERE root IN (SELECT root FROM br) ORDER BY place LIMIT {_QUOTAS["busy"]}),
  co AS (SELECT ticker, n_rows, place, CASE WHEN ticker IN (SELECT ticker FROM bz) THEN 'busy' WHEN place >= n - {_QUOTAS["quiet"]} THEN 'quiet' WHEN place % greatest(n {{div}} {_QUOTAS["spread"]}, 1) = 0 AND place < {_QUOTAS["spread"]} * greatest(n {{div}} {_QUOTAS["spread"]}, 1) THEN 'spread' END AS cohort FROM rk)"""
_SAMPLE = f"""{_COHORTS}, tr AS (SELECT t.*, cohort, n_rows, row_number() OVER (PARTITION BY t.ticker ORDER BY id) - 1 AS i, lag(us) OVER (PARTITION BY t.ticker ORDER BY id) AS prev,
    last_value(CASE WHEN is_snapshot THEN (us, seq) END IGNORE NULLS) OVER (PARTITION BY t.ticker ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM v_tape t JOIN co USING (ticker) WHERE cohort IS NOT NULL),
  bt AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY id) - 1 AS b, count(*) OVER (PARTITION BY ticker) AS m FROM tr WHERE is_snapshot AND (was IS NULL OR was <> (us, seq)) AND prev IS NOT NULL),
  fs AS (SELECT ticker, place, (SELECT min(us) FROM v_tape t WHERE t.ticker = rk.ticker AND is_snapshot) AS first_us FROM rk),
  gt AS (SELECT DISTINCT CASE WHEN ticker = '' THEN (SELECT arg_min(fs.ticker, place) FROM fs WHERE first_us <= detected_us) WHEN (SELECT first_us FROM fs WHERE fs.ticker = g.ticker) <= detected_us THEN ticker END AS ticker, detected_us FROM v_gaps g),
  ge AS (SELECT ticker, detected_us, (SELECT max(us) FROM v_tape t WHERE t.ticker = gt.ticker AND us < detected_us) AS b, (SELECT min(us) FROM v_tape t WHERE t.ticker = gt.ticker AND us >= detected_us) AS a FROM gt WHERE ticker IS NOT NULL),
  sp AS (SELECT ticker, us AS at_us, 'interior' AS kind, cohort FROM tr WHERE list_contains([n_rows * x {{div}} {_INTERIOR + 1} for x in range(1, {_INTERIOR + 1})], i)
    UNION SELECT ticker, unnest([prev, us, us + 1]), 'snapshot', cohort FROM bt WHERE list_contains([m * x {{div}} {_BATCHES} for x in range({_BATCHES})], b)
    UNION SELECT ticker, arg_max(us, id) + 1, 'blind', cohort FROM tr GROUP BY ticker, cohort
    UNION SELECT ticker, detected_us, 'post_gap', 'gap' FROM ge UNION SELECT ticker, x, 'gap_edge', 'gap' FROM (SELECT ticker, unnest([b, a, a + 1]) AS x FROM ge) WHERE x IS NOT NULL)"""


def _sampled(spark, sf_dir):
    tape = view(spark, sf_dir, "v_tape")
    ranked = keep(op.ranked_tickers(tape, F.substring("ticker", 1, 2)))
    cohorts = keep(op.sample_cohorts(ranked, **_QUOTAS))
    return op.sample_points(tape, cohorts, ranked, view(spark, sf_dir, "v_gaps"), _INTERIOR, _BATCHES), cohorts


@query("sample_points", f"WITH {_SAMPLE} SELECT * FROM sp")
def sample_points(spark, sf_dir):
    return _sampled(spark, sf_dir)[0]


@query("sample_shortfall", f"""WITH {_SAMPLE}, wa AS (SELECT unnest({[(c, n) for c, n in _QUOTAS.items()]}) AS x) SELECT x[1] AS cohort, x[2]::BIGINT AS wanted, (SELECT count(*) FROM co WHERE cohort = x[1]) AS found, x[2] - (SELECT count(*) FROM co WHERE cohort = x[1]) AS missing, (SELECT count(*) FROM sp WHERE cohort = x[1]) AS points FROM wa""")
def sample_shortfall(spark, sf_dir):
    return op.sample_shortfall(*_sampled(spark, sf_dir), _QUOTAS)


@query("replay_parity", f"""WITH {_MET}, {_SAMPLE}, pq AS (SELECT *, concat_ws('|', ticker, at_us, kind, cohort) AS point_id FROM sp), pt AS (SELECT point_id, ticker, at_us FROM pq), {_STATES},
  rs AS (SELECT pq.*, s.status AS oracle, s.yes_bid, s.no_bid, (SELECT arg_max((t.yes_bid, t.no_bid), (t.us, t.id)) FROM touch t WHERE t.ticker = pq.ticker AND t.us <= pq.at_us) AS passed, (SELECT max(us) FROM v_tape t WHERE t.ticker = pq.ticker AND is_snapshot AND us <= pq.at_us) AS snap,
    (SELECT max(detected_us) FROM v_gaps g WHERE g.ticker IN (pq.ticker, '') AND detected_us <= pq.at_us) AS gap, (SELECT max(us) FROM v_tape t WHERE t.ticker = pq.ticker) < pq.at_us AS blind FROM pq JOIN state s USING (point_id)),
  rt AS (SELECT *, coalesce(gap >= snap, false) AS raised, EXISTS (SELECT 1 FROM v_tape t WHERE t.ticker = rs.ticker AND NOT is_snapshot AND t.us = snap) AS tied, passed[1] IS NOT DISTINCT FROM yes_bid AND passed[2] IS NOT DISTINCT FROM no_bid AS same FROM rs),
  ru AS (SELECT *, CASE WHEN oracle = 'gap' AND raised THEN 'agreed_on_raise' WHEN (oracle = 'gap') <> raised THEN 'disagreed' WHEN oracle = 'no_anchor' THEN 'no_anchor' WHEN tied THEN 'excluded_tied_delta' WHEN same THEN 'agreed' ELSE 'disagreed' END AS status FROM rt),
  sc AS (SELECT unnest([('kind', kind), ('cohort', cohort), ('all', '*')]) AS x, status, same, blind FROM ru)
  SELECT x[1] AS scope, x[2] AS name, {", ".join(f"count(*) FILTER (status = '{k}') AS {k}" for k in ("agreed", "agreed_on_raise", "disagreed", "excluded_tied_delta", "no_anchor"))}, count(*) FILTER (status = 'excluded_tied_delta' AND same) AS tied_agreed, count(*) FILTER (blind) AS blind, count(*) AS n FROM sc GROUP BY 1, 2""")
def replay_parity(spark, sf_dir):
    tape, gaps = view(spark, sf_dir, "v_tape"), view(spark, sf_dir, "v_gaps")
    points = keep(_sampled(spark, sf_dir)[0].withColumn("point_id", F.concat_ws("|", "ticker", F.col("at_us").cast("string"), "kind", "cohort")))
    asked = points.select("point_id", "ticker", "at_us")
    late, points2, gaps2 = op.with_later_deltas(tape, asked, gaps)
    return op.replay_parity(op.parity_results(points, op.touch_series(tape), op.book_state_at(asked, tape, gaps), op.book_state_at(points2, late, gaps2), tape, gaps))


@query("rest_agreement", f"""WITH {_STATE}, k AS (SELECT t.id % 3 AS series, CASE WHEN status = 'gap' THEN 'gap' WHEN status = 'no_anchor' THEN 'no_coverage' WHEN CASE WHEN t.yes_bid > 0 THEN t.yes_bid END IS NOT DISTINCT FROM s.yes_bid THEN 'agree' ELSE 'disagree' END AS kind FROM v_touch t JOIN state s ON t.id = s.point_id)
  SELECT series, count(*) AS n, count(*) FILTER (kind = 'agree') AS agree, count(*) FILTER (kind = 'disagree') AS disagree, count(*) FILTER (kind = 'no_coverage') AS no_coverage, count(*) FILTER (kind = 'gap') AS gap FROM k GROUP BY ROLLUP (series)""")
def rest_agreement(spark, sf_dir):
    rest = view(spark, sf_dir, "v_touch").select(F.col("id").alias("point_id"), (F.col("id") % 3).alias("series"), F.when(F.col("yes_bid") > 0, F.col("yes_bid")).alias("bid"))
    return op.rest_agreement(rest, _state(spark, sf_dir))


@query("sample_every", "WITH r AS (SELECT id, ticker, us, row_number() OVER (PARTITION BY ticker ORDER BY id) AS rank, count(*) OVER (PARTITION BY ticker) AS n_rows FROM v_tape) SELECT * FROM r WHERE rank % 10 = 0")
def sample_every(spark, sf_dir):
    return op.sample_every(view(spark, sf_dir, "v_tape"), 10)


@query("book_clear_audit", """WITH c AS (SELECT event_id AS clear_id, concat('M', user_id) AS ticker, us AS clear_us FROM ev WHERE event_type = 'error'),
  x AS (SELECT c.*, (SELECT max(us) FROM v_tape t WHERE t.ticker = c.ticker AND is_snapshot AND us <= clear_us) AS anchor_us, (SELECT min(us) FROM v_tape t WHERE t.ticker = c.ticker AND is_snapshot AND us > clear_us) AS next_us, (SELECT max(us) FROM v_tape t WHERE t.ticker = c.ticker) AS last_us FROM c)
  SELECT clear_id, ticker, clear_us, CASE WHEN anchor_us IS NULL THEN 'no_anchor' WHEN last_us <= clear_us THEN 'terminal' ELSE 'mid_life' END AS kind,
    (SELECT count(*) FROM v_tape t WHERE t.ticker = x.ticker AND t.us > clear_us AND (next_us IS NULL OR t.us < next_us)) AS stale_rows, next_us - clear_us AS stale_us FROM x""")
def book_clear_audit(spark, sf_dir):
    clears = view(spark, sf_dir, "ev").filter("event_type = 'error'").select(F.col("event_id").alias("clear_id"), F.concat(F.lit("M"), "user_id").alias("ticker"), F.col("us").alias("clear_us"))
    return op.book_clear_audit(clears, view(spark, sf_dir, "v_tape"))


@query("depth_continuity", """WITH a AS (SELECT *, (SELECT arg_max((b.yes_bid, b.yes_size), (b.us, b.id)) FROM v_touch b WHERE b.ticker = t.ticker AND b.us < t.us) AS x FROM v_touch t)
  SELECT yes_bid > 0 AS present, count(*) AS n, count(*) FILTER (yes_bid = x[1]) AS price_agree, count(*) FILTER (yes_size = x[2]) AS size_agree, count(*) FILTER (abs(yes_size - x[2]) <= 100) AS within_one, quantile_disc(abs(yes_size - x[2]), 0.5) AS p50_difference FROM a WHERE x IS NOT NULL GROUP BY 1""")
def depth_continuity(spark, sf_dir):
    touch = view(spark, sf_dir, "v_touch")
    return op.depth_continuity(touch, touch)


_SIDES = """cx AS (SELECT t.*, (SELECT arg_max((yes_bid, yes_size, no_bid, no_size), (b.us, b.id)) FROM v_touch b WHERE b.ticker = t.ticker AND b.us < t.us) AS x FROM v_touch t),
  cs AS (SELECT id, ticker, us, 'yes' AS side, yes_bid AS price, yes_size AS size, x[1] AS b_price, x[2] AS b_size FROM cx WHERE x IS NOT NULL UNION ALL SELECT id, ticker, us, 'no', no_bid, no_size, x[3], x[4] FROM cx WHERE x IS NOT NULL)"""


@query("continuity_readout", f"""WITH {_SIDES} SELECT side, count(*) AS n, count(*) FILTER (price = b_price) AS price_agree, count(*) FILTER (price = b_price AND size = b_size) AS depth_agree, count(*) FILTER (price = b_price AND size {{div}} 100 = b_size {{div}} 100) AS depth_truncated,
  count(*) FILTER (b_size % 100 <> 0) AS fractional, count(*) FILTER (abs(size - b_size) <= 100) AS within_one, {", ".join(f"quantile_disc(size - b_size, 0.{q}) AS p{q}" for q in (25, 50, 75))} FROM cs GROUP BY side""")
def continuity_readout(spark, sf_dir):
    touch = view(spark, sf_dir, "v_touch")
    return op.continuity_readout(touch, touch)


@query("continuity_sample", f"WITH {_SIDES} SELECT * FROM cs WHERE price <> b_price OR size {{div}} 100 <> b_size {{div}} 100 ORDER BY ticker, us, id, side LIMIT 20")
def continuity_sample(spark, sf_dir):
    touch = view(spark, sf_dir, "v_touch")
    return op.continuity_sample(touch, touch)
