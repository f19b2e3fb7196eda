from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import depth as op
from tidemark.operators.ingest import market_dimension
from tidemark.queries import query
from tidemark.sources.adapters import view

HOUR = 3_600_000_000

_PIECES = """cs AS (SELECT *, lead(us) OVER (PARTITION BY ticker ORDER BY us, id) AS end_us, max(us) OVER (PARTITION BY ticker) AS close_us FROM v_touch),
  sl AS (SELECT *, unnest(range(us {div} 3600000000, (end_us - 1) {div} 3600000000 + 1)) AS slot FROM cs WHERE end_us > us),
  pa AS (SELECT *, greatest(us, slot * 3600000000) AS a, least(end_us, (slot + 1) * 3600000000) AS b FROM sl),
  pieces AS (SELECT *, b - a AS held_us FROM pa WHERE NOT EXISTS (SELECT 1 FROM v_quiet x WHERE x.start_us <= pa.b AND x.end_us >= pa.a))"""
_CELLS = f"{_PIECES}, cells AS (SELECT ticker, slot % 24 AS hour, yes_bid, no_bid, yes_size, held_us FROM pieces)"


def _cells(spark, sf_dir):
    return op.depth_cells(view(spark, sf_dir, "v_touch"), view(spark, sf_dir, "v_quiet"))


@query("depth_cells", f"WITH {_CELLS} SELECT hour, yes_size, sum(held_us)::BIGINT AS held_us FROM cells GROUP BY hour, yes_size")
def depth_cells(spark, sf_dir):
    return op.depth_bins(_cells(spark, sf_dir), ["hour"], "yes_size")

@query("depth_readout", f"""WITH {_CELLS}, al AS (SELECT hour, yes_bid > 0 AND no_bid > 0 AS two, yes_size, held_us FROM cells UNION ALL SELECT -1, yes_bid > 0 AND no_bid > 0, yes_size, held_us FROM cells),
  bn AS (SELECT hour, yes_size, sum(held_us) AS w FROM al GROUP BY ALL), cm AS (SELECT *, sum(w) OVER (PARTITION BY hour ORDER BY yes_size) AS upto, sum(w) OVER (PARTITION BY hour) AS tot FROM bn),
  qu AS (SELECT hour, min(yes_size) AS p50_size FROM cm WHERE upto >= tot * 0.5 GROUP BY hour)
  SELECT hour, sum(held_us)::BIGINT AS kept_us, sum(CASE WHEN two THEN held_us ELSE 0 END)::BIGINT AS two_sided_us, any_value(p50_size) AS p50_size FROM al JOIN qu USING (hour) GROUP BY hour""")
def depth_readout(spark, sf_dir):
    return op.depth_readout(_cells(spark, sf_dir))

#: Three levels below each bid, of which books of an odd id have one more than is listed.
_STEPS, _SLIPPAGE = (0, 300, 800), 450

def _side_sql(side):
    z = f"{side}_size"
    spare = f"({_SLIPPAGE} * {z} + {_SLIPPAGE - 300} * ({z} + 100))"
    room = f"least({z} + 5000, {spare} {{div}} {800 - _SLIPPAGE})"
    return f"SELECT *, '{side}' AS side, {z} AS size, 2 * {z} + 100 AS cum5, 2 * {z} + 100 + {room} AS capacity, {room} = {z} + 5000 AND id % 2 = 1 AS censored FROM pieces"


def _by_scope(value, name, where="true"):
    q = {"spread": [("p50_spread", 0.5)], "capacity WHERE censored": [("p50_censored", 0.5)]}.get(f"{value} WHERE censored" if where == "censored" else value) or [(f"p{round(100 * x)}_{value}", x) for x in (0.25, 0.5, 0.75)]
    picks = ", ".join(f"min(CASE WHEN upto >= tot * {x} THEN {value} END) AS {n}" for n, x in q)
    keys = "scope, city, bucket, hour, side"
    return f"""{name} AS (SELECT {keys}, {picks} FROM (SELECT {keys}, {value}, sum(sum(held_us)) OVER (PARTITION BY {keys} ORDER BY {value}) AS upto, sum(sum(held_us)) OVER (PARTITION BY {keys}) AS tot FROM te WHERE {where} GROUP BY {keys}, {value}) GROUP BY {keys})"""


_CUBE = f"""{_PIECES}, sd AS ({_side_sql("yes")} UNION ALL {_side_sql("no")}),
  tl AS (SELECT concat('G', CAST(substr(ticker, 2) AS BIGINT) % 5) AS city, CASE WHEN close_us {{div}} 3600000000 - slot <= 24 THEN '<=24h' WHEN close_us {{div}} 3600000000 - slot <= 168 THEN '24-168h' ELSE '>168h' END AS bucket, slot % 24 AS hour,
    CASE WHEN yes_bid > 0 AND no_bid > 0 THEN 10000 - yes_bid - no_bid END AS spread, side, size, cum5, capacity, censored, held_us FROM sd),
  te AS (SELECT 'cell' AS scope, * FROM tl UNION ALL SELECT 'city', * REPLACE ('*' AS bucket, -1 AS hour) FROM tl UNION ALL SELECT 'bucket', * REPLACE ('*' AS city, -1 AS hour) FROM tl UNION ALL SELECT 'hour', * REPLACE ('*' AS city, '*' AS bucket) FROM tl),
  {_by_scope("size", "q1")}, {_by_scope("cum5", "q2")}, {_by_scope("capacity", "q3")}, {_by_scope("spread", "q4", "spread IS NOT NULL")}, {_by_scope("capacity", "q5", "censored")},
  su AS (SELECT scope, city, bucket, hour, side, sum(held_us)::BIGINT AS kept_us, sum(CASE WHEN spread IS NOT NULL THEN held_us ELSE 0 END)::BIGINT AS two_sided_us, min(spread) AS least_spread, sum(CASE WHEN censored THEN held_us ELSE 0 END)::BIGINT AS censored_us FROM te GROUP BY ALL)"""


@query("depth_cube", f"WITH {_CUBE} SELECT * FROM su " + " ".join(f"LEFT JOIN q{i} USING (scope, city, bucket, hour, side)" for i in range(1, 6)))
def depth_cube(spark, sf_dir):
    quotes = view(spark, sf_dir, "v_touch").withColumn("_levels", 3 + F.col("id") % 2)
    for side in ("yes", "no"):
        size = F.col(f"{side}_size")
        quotes = quotes.withColumns({"_p": F.array(*(F.col(f"{side}_bid") - d for d in _STEPS)), "_s": F.array(size, size + 100, size + 5000)})
        walked = op.walk_capacity("_p", "_s", _SLIPPAGE, "_levels")
        quotes = quotes.withColumns({f"{side}_cum5": op.cumulative_depth("_p", "_s", 500), f"_{side}": walked})
        quotes = quotes.withColumns({f"{side}_capacity": F.col(f"_{side}.capacity"), f"{side}_censored": F.col(f"_{side}.censored")}).drop("_p", "_s", f"_{side}")
    cities = quotes.select("ticker", F.concat(F.lit("G"), F.substring("ticker", 2, 20).cast("long") % 5).alias("city")).distinct()
    return op.depth_cube(quotes.drop("_levels"), cities, view(spark, sf_dir, "v_quiet"))


_LADDER = "lad AS (SELECT user_id, list(k ORDER BY k DESC)[1:6] AS ps, list(c ORDER BY k DESC)[1:6] AS ss, count(*) AS levels FROM (SELECT user_id, k, min(c) AS c FROM ev GROUP BY user_id, k) GROUP BY user_id)"

def _ladders(spark, sf_dir):
    levels = view(spark, sf_dir, "ev").groupBy("user_id", "k").agg(F.min("c").alias("c"))
    own = Window.partitionBy("user_id")
    top = levels.withColumn("n", F.row_number().over(own.orderBy(F.desc("k")))).withColumn("levels", F.count("*").over(own)).filter("n <= 6")  # six are collected, whatever a user has
    rows = top.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("k", "c")), False).alias("x"), F.max("levels").alias("levels"))
    return rows.select("user_id", "levels", F.col("x.k").alias("prices"), F.col("x.c").alias("sizes"))

@query("cumulative_depth", f"WITH {_LADDER} SELECT user_id, list_sum(list_transform(list_filter(range(1, len(ps) + 1), lambda i: ps[i] >= ps[1] - 5), lambda i: ss[i]))::BIGINT AS depth FROM lad")
def cumulative_depth(spark, sf_dir):
    return _ladders(spark, sf_dir).select("user_id", op.cumulative_depth("prices", "sizes", 5).alias("depth"))

@query("walk_capacity", f"""WITH RECURSIVE {_LADDER}, wk AS (SELECT user_id, levels, ps, ss, 1 AS i, 0::BIGINT AS n, 0::BIGINT AS spare, true AS is_open FROM lad UNION ALL
  SELECT user_id, levels, ps, ss, i + 1, n + room, spare - room * gap, is_open AND room = ss[i] FROM (SELECT *, CASE WHEN NOT is_open THEN 0 WHEN gap <= 0 THEN ss[i] ELSE least(ss[i], spare {{div}} gap) END AS room FROM (SELECT *, ps[1] - ps[i] - 1 AS gap FROM wk WHERE i <= len(ps))))
  SELECT user_id, n AS capacity, is_open AND levels > 6 AS censored, is_open AND levels <= 6 AS exhausted FROM wk WHERE i = len(ps) + 1""")
def walk_capacity(spark, sf_dir):
    return _ladders(spark, sf_dir).select("user_id", op.walk_capacity("prices", "sizes", 1, "levels").alias("x")).select("user_id", "x.*")

@query("depth_at_price", f"WITH {_LADDER} SELECT user_id, coalesce(ss[list_position(ps, 97)], 0) AS size, levels > 6 AS censored FROM lad")
def depth_at_price(spark, sf_dir):
    return _ladders(spark, sf_dir).select("user_id", op.depth_at_price("prices", "sizes", F.lit(97).cast("long")).alias("size"), (F.col("levels") > 6).alias("censored"))

_GROUPS = "(SELECT DISTINCT ticker, CAST(substr(ticker, 2) AS BIGINT) % 20 AS grp FROM v_touch)"

@query("atm_pick", f"""WITH d AS (SELECT ticker, quantile_cont(abs(mid2 - 10000), 0.5) AS distance FROM v_mid WHERE mid2 IS NOT NULL GROUP BY ticker),
  r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY distance, ticker) AS n FROM d JOIN {_GROUPS} USING (ticker)) SELECT ticker, distance, grp FROM r WHERE n = 1""")
def atm_pick(spark, sf_dir):
    quotes = view(spark, sf_dir, "v_mid")
    groups = quotes.select("ticker", (F.substring("ticker", 2, 20).cast("long") % 20).alias("grp")).distinct()
    return op.atm_pick(quotes, groups)

@query("classify_print", """WITH x AS (SELECT p.id, p.ticker, yes_price, (SELECT arg_max((yes_bid, no_bid), (t.us, t.id)) FROM v_touch t WHERE t.ticker = p.ticker AND t.us < p.us) AS s FROM v_prints p)
  SELECT id, ticker, CASE WHEN s IS NULL THEN 'no_state' WHEN yes_price = s[1] THEN 'yes' WHEN 10000 - yes_price = s[2] THEN 'no' ELSE 'no_match' END AS hit FROM x""")
def classify_print(spark, sf_dir):
    return op.classify_print(view(spark, sf_dir, "v_prints"), view(spark, sf_dir, "v_touch"))

_REFILLS = """st AS (SELECT * FROM v_coarse QUALIFY row_number() OVER (PARTITION BY ticker, us ORDER BY id DESC) = 1),
  se AS (SELECT *, lead(us) OVER w AS post_us, lead(yes_size) OVER w AS post_yes, lead(no_size) OVER w AS post_no FROM st WINDOW w AS (PARTITION BY ticker ORDER BY us)), cl AS (SELECT ticker, max(us) AS close_us FROM v_touch GROUP BY ticker),
  pm AS (SELECT p.*, (SELECT max(us) FROM st WHERE st.ticker = p.ticker AND st.us <= p.us) AS state_us FROM v_takes p),
  ph AS (SELECT pm.*, CASE WHEN yes_price = s.yes_bid THEN 'yes' WHEN 10000 - yes_price = s.no_bid THEN 'no' END AS side FROM pm LEFT JOIN se s ON s.ticker = pm.ticker AND s.us = pm.state_us),
  gr AS (SELECT ticker, state_us, count(*) AS prints, min(us) AS first_us, arg_min((us, id, side), (us, id)) FILTER (side IS NOT NULL) AS m FROM ph GROUP BY ticker, state_us),
  g2 AS (SELECT gr.*, close_us, post_us, m[1] + 86400000000 AS deadline_us, CASE WHEN m[3] = 'yes' THEN yes_size ELSE no_size END AS pre, CASE WHEN m[3] = 'yes' THEN post_yes ELSE post_no END AS post FROM gr LEFT JOIN se s ON s.ticker = gr.ticker AND s.us = gr.state_us LEFT JOIN cl ON cl.ticker = gr.ticker),
  g3 AS (SELECT *, CASE WHEN state_us IS NULL THEN 'no_pre_state' WHEN m IS NULL THEN 'no_match' WHEN post_us IS NULL THEN 'no_post_state' WHEN close_us IS NULL OR deadline_us > close_us THEN 'past_close'
    WHEN EXISTS (SELECT 1 FROM v_quiet x WHERE x.start_us <= g2.deadline_us AND x.end_us >= g2.state_us) THEN 'screened' ELSE 'matched' END AS status FROM g2),
  rf AS (SELECT ticker, state_us, status, prints, coalesce(m[1], first_us) AS print_us, close_us, m[2] AS print_id, m[3] AS side, CASE WHEN status = 'matched' THEN pre END AS before, CASE WHEN status = 'matched' THEN post END AS after,
    coalesce(status = 'matched' AND 2 * post < pre, false) AS depleted, deadline_us FROM g3),
  refills AS (SELECT * EXCLUDE (deadline_us), CASE WHEN depleted THEN (SELECT min(t.us) FROM st t WHERE t.ticker = rf.ticker AND t.us > rf.state_us AND t.us <= rf.deadline_us AND 2 * CASE WHEN rf.side = 'yes' THEN t.yes_size ELSE t.no_size END >= rf.before) - print_us END AS refill_us FROM rf)"""


@query("replenishment", f"WITH {_REFILLS} SELECT * FROM refills")
def replenishment(spark, sf_dir):
    closes = view(spark, sf_dir, "v_touch").groupBy("ticker").agg(F.max("us").alias("close_us"))
    return op.replenishment(view(spark, sf_dir, "v_takes"), view(spark, sf_dir, "v_coarse"), closes, view(spark, sf_dir, "v_quiet"), 24 * HOUR)

_STATUSES = ("no_pre_state", "no_match", "no_post_state", "past_close", "screened", "matched")

@query("replenishment_readout", f"""WITH {_REFILLS}, bu AS (SELECT *, CASE WHEN close_us - print_us IS NULL THEN 'none' WHEN close_us - print_us <= 86400000000 THEN '<=24h' WHEN close_us - print_us <= 604800000000 THEN '24-168h' ELSE '>168h' END AS bucket FROM refills),
  sc AS (SELECT 'cell' AS scope, CASE WHEN ticker IN (SELECT ticker FROM v_touch) THEN concat('G', CAST(substr(ticker, 2) AS BIGINT) % 5) END AS city, bucket, status, depleted, refill_us FROM bu UNION ALL SELECT 'all', '*', '*', status, depleted, refill_us FROM bu),
  ct AS (SELECT scope, city, bucket, count(*) AS groups, {", ".join(f"count(*) FILTER (status = '{x}') AS {x}" for x in _STATUSES)}, count(*) FILTER (depleted) AS events, count(refill_us) AS refilled, list_sort(list(refill_us) FILTER (refill_us IS NOT NULL)) AS times FROM sc GROUP BY scope, city, bucket)
  SELECT * EXCLUDE (times), round(CASE WHEN events > 0 THEN refilled / events END, 9) AS fraction, CASE WHEN 2 * refilled > events THEN times[(events + 1) {{div}} 2] END AS median_us FROM ct""")
def replenishment_readout(spark, sf_dir):
    cities = view(spark, sf_dir, "v_touch").select("ticker", F.concat(F.lit("G"), F.substring("ticker", 2, 20).cast("long") % 5).alias("city")).distinct()
    return op.replenishment_readout(replenishment(spark, sf_dir), cities, 24 * HOUR)

#: Ladders of three tickers each, in groups whose number grows with the tickers.
_MATRIX = f"""lg AS (SELECT ticker, grp, row_number() OVER (PARTITION BY grp ORDER BY ticker) - 1 AS seat, count(*) OVER (PARTITION BY grp) AS n FROM {_GROUPS.replace("% 20", "{div} 3")}),
  lt AS (SELECT grp, us, id, seat, yes_bid, yes_size FROM v_touch JOIN lg USING (ticker) WHERE n = 3),
  ma AS (SELECT grp, us, id, {", ".join(f"last_value(CASE WHEN seat = {i} THEN {c} END IGNORE NULLS) OVER w AS {n}_{i}" for n, c in (("bid", "yes_bid"), ("size", "yes_size")) for i in range(3))} FROM lt WINDOW w AS (PARTITION BY grp ORDER BY us, id ROWS UNBOUNDED PRECEDING)),
  mx AS (SELECT * FROM ma WHERE bid_0 IS NOT NULL AND bid_1 IS NOT NULL AND bid_2 IS NOT NULL)"""

def _legs(spark, sf_dir):
    return op.ladder_build(view(spark, sf_dir, "v_touch"), F.expr("CAST(substr(ticker, 2) AS BIGINT) div 3"), 3, exact=True)

def _matrix(spark, sf_dir):
    return op.ladder_state_matrix(view(spark, sf_dir, "v_touch"), _legs(spark, sf_dir), 3)

@query("ladder_build", f"WITH {_MATRIX} SELECT grp, ticker, seat FROM lg WHERE n = 3")
def ladder_build(spark, sf_dir):
    return _legs(spark, sf_dir)

_EVENT = "concat('KX', station, '-', strftime(DATE '1970-01-01' + day::INT, '%y'), upper(strftime(DATE '1970-01-01' + day::INT, '%b')), strftime(DATE '1970-01-01' + day::INT, '%d'))"
_MARKETS = f"""mk AS (SELECT {_EVENT} AS ev, station, day, official, unnest(range(6)) AS n FROM v_days), ml AS (SELECT official, concat(ev, CASE WHEN n IN (0, 5) THEN '-T' ELSE '-B' END, 60 + 5 * n + official % 7, CASE WHEN n IN (0, 5) THEN '' ELSE '.5' END) AS ticker, concat('KX', station) AS series, day, n,
    60 + 5 * n + official % 7 + CASE WHEN n IN (0, 5) THEN 0 ELSE 0.5 END AS strike FROM mk WHERE NOT (n = 3 AND official < 98))"""


def _markets(spark, sf_dir):
    """Six markets of every station-day, but five where the day's official value is below 98."""
    date = F.date_format(F.date_from_unix_date(F.col("day").cast("int")), "yyMMMdd")
    rows = view(spark, sf_dir, "v_days").withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(5)))).filter("not (n = 3 and official < 98)")
    tail = F.col("n").isin(0, 5)
    strike = (60 + 5 * F.col("n") + F.col("official") % 7).cast("string")
    return market_dimension(rows.select(F.concat(F.lit("KX"), "station", F.lit("-"), F.upper(date), F.when(tail, "-T").otherwise("-B"), strike, F.when(tail, "").otherwise(".5")).alias("ticker")))


@query("ladder_by_strike", f"""WITH {_MARKETS} SELECT concat(series, '-', DATE '1970-01-01' + day::INT) AS grp, ticker, CASE n WHEN 0 THEN 'below' WHEN 5 THEN 'above' ELSE 'bracket' END AS kind, strike::DECIMAL(10, 1) AS strike, n::BIGINT AS seat FROM ml WHERE official >= 98""")
def ladder_by_strike(spark, sf_dir):
    return op.ladder_by_strike(_markets(spark, sf_dir))


@query("ladder_state_matrix", f"WITH {_MATRIX} SELECT * FROM mx")
def ladder_state_matrix(spark, sf_dir):
    return _matrix(spark, sf_dir)

_EPISODES = f"""{_MATRIX}, on1 AS (SELECT *, bid_0 + bid_1 + bid_2 - 10000 AS magnitude, least(size_0, size_1, size_2) AS depth, lead(us) OVER (PARTITION BY grp ORDER BY us, id) AS next_us FROM mx),
  on2 AS (SELECT *, magnitude > 0 AND depth > 0 AS is_on FROM on1), on3 AS (SELECT *, lag(is_on) OVER (PARTITION BY grp ORDER BY us, id) AS was FROM on2),
  on4 AS (SELECT *, sum(CASE WHEN is_on AND NOT coalesce(was, false) THEN 1 ELSE 0 END) OVER (PARTITION BY grp ORDER BY us, id ROWS UNBOUNDED PRECEDING) AS island FROM on3),
  ep AS (SELECT grp, min(us) AS start_us, (arg_max((next_us, 1), (us, id)))[1] AS end_us, count(*) AS states, arg_min((magnitude, depth, id), (-magnitude, us, id)) AS w FROM on4 WHERE is_on GROUP BY grp, island),
  epi AS (SELECT grp, start_us, end_us, states, w[1] AS magnitude, w[2] AS depth, w[3] AS state_id FROM ep)"""

def _episodes(spark, sf_dir):
    return op.arb_episodes(_matrix(spark, sf_dir), F.col("bid_0") + F.col("bid_1") + F.col("bid_2") - 10_000, F.least("size_0", "size_1", "size_2"))

@query("arb_episodes", f"WITH {_EPISODES} SELECT * FROM epi")
def arb_episodes(spark, sf_dir):
    return _episodes(spark, sf_dir)

@query("episode_summary", f"WITH {_EPISODES} SELECT count(*) AS found, count(*) FILTER (end_us - start_us >= 3600000000) AS tradeable, count(*) FILTER (end_us IS NULL) AS censored, min(magnitude) AS least, quantile_disc(magnitude, 0.5) AS p50, quantile_disc(magnitude, 0.9) AS p90, max(magnitude) AS most FROM epi")
def episode_summary(spark, sf_dir):
    return op.episode_summary(_episodes(spark, sf_dir), HOUR)

_FEES = " + ".join(f"(7 * depth * bid_{i} * (10000 - bid_{i}) + 9999999999) {{div}} 10000000000" for i in range(3))

@query("worst_state", f"""WITH {_EPISODES}, fe AS (SELECT *, {_FEES} AS fees FROM on4 WHERE is_on), ex AS (SELECT *, CAST(magnitude * depth - 10000 * fees - 300 * depth AS DOUBLE) / CAST(100 * depth AS DOUBLE) AS excess FROM fe),
  wo AS (SELECT grp, min(us) AS start_us, (arg_max((next_us, 1), (us, id)))[1] AS end_us, arg_min((magnitude, depth, fees, id), (excess, us, id)) AS s, min(excess) AS excess FROM ex GROUP BY grp, island)
  SELECT grp, start_us, end_us, s[1] AS magnitude, s[2] AS depth, s[3] AS fees, excess, s[4] AS state_id, coalesce(end_us - start_us >= 3600000000, false) AND excess > 0 AND s[2] >= 1000 AS tradeable FROM wo""")
def worst_state(spark, sf_dir):
    sums = F.col("bid_0") + F.col("bid_1") + F.col("bid_2") - 10_000
    return op.worst_states(_matrix(spark, sf_dir), sums, F.least("size_0", "size_1", "size_2"), ["bid_0", "bid_1", "bid_2"], HOUR, 1_000)

_COLUMNS = (("bid", "yes_bid"), ("size", "yes_size"), ("no", "no_bid"), ("no_size", "no_size"))
_STREAMS = f"""lg AS (SELECT ticker, CAST(substr(ticker, 2) AS BIGINT) {{div}} 3 AS grp, row_number() OVER (PARTITION BY CAST(substr(ticker, 2) AS BIGINT) {{div}} 3 ORDER BY ticker) - 1 AS seat, count(*) OVER (PARTITION BY CAST(substr(ticker, 2) AS BIGINT) {{div}} 3) AS n FROM (SELECT DISTINCT ticker FROM v_touch)),
  ma AS (SELECT grp, us, id, {", ".join(f"last_value(CASE WHEN seat = {i} THEN {c} END IGNORE NULLS) OVER w AS {n}_{i}" for n, c in _COLUMNS for i in range(3))} FROM v_touch JOIN lg USING (ticker) WHERE n = 3 WINDOW w AS (PARTITION BY grp ORDER BY us, id ROWS UNBOUNDED PRECEDING)),
  sr AS (SELECT grp, us, id, 'sum_buy' AS stream, bid_0 + bid_1 + bid_2 + no_0 + no_1 + no_2 IS NOT NULL AS live, no_0 + no_1 + no_2 - 20000 AS magnitude, least(no_size_0, no_size_1, no_size_2) AS depth, [10000 - no_0, 10000 - no_1, 10000 - no_2] AS prices FROM ma
    UNION ALL SELECT grp, us, id, 'sum_sell', bid_0 + bid_1 + bid_2 + no_0 + no_1 + no_2 IS NOT NULL, bid_0 + bid_1 + bid_2 - 10000, least(size_0, size_1, size_2), [bid_0, bid_1, bid_2] FROM ma
    UNION ALL SELECT grp, us, id, 'monotonicity', bid_0 + bid_2 + no_0 + no_2 IS NOT NULL, bid_0 + bid_2 - 10000, least(size_0, size_2), [bid_0, bid_2] FROM ma),
  s1 AS (SELECT *, magnitude > 0 AND depth > 0 AS is_on, lead(us) OVER (PARTITION BY stream, grp ORDER BY us, id) AS next_us FROM sr WHERE live), s2 AS (SELECT *, lag(is_on) OVER (PARTITION BY stream, grp ORDER BY us, id) AS was FROM s1),
  s3 AS (SELECT *, sum(CASE WHEN is_on AND NOT coalesce(was, false) THEN 1 ELSE 0 END) OVER (PARTITION BY stream, grp ORDER BY us, id ROWS UNBOUNDED PRECEDING) AS island FROM s2),
  s4 AS (SELECT *, list_sum(list_transform(prices, lambda p: (7 * depth * p * (10000 - p) + 9999999999) {{div}} 10000000000))::BIGINT AS fees FROM s3 WHERE is_on),
  s5 AS (SELECT *, CAST(magnitude * depth - 10000 * fees - 100 * len(prices) * depth AS DOUBLE) / CAST(100 * depth AS DOUBLE) AS excess FROM s4),
  s6 AS (SELECT stream, grp, min(us) AS start_us, (arg_max((next_us, 1), (us, id)))[1] AS end_us, arg_min((magnitude, depth, fees, id), (excess, us, id)) AS s, min(excess) AS excess FROM s5 GROUP BY stream, grp, island),
  eps AS (SELECT stream, grp, start_us, end_us, s[1] AS magnitude, s[2] AS depth, s[3] AS fees, excess, s[4] AS state_id, coalesce(end_us - start_us >= 3600000000, false) AND excess > 0 AND s[2] >= 1000 AS tradeable FROM s6)"""


def _arb_streams(spark, sf_dir):
    matrix = op.ladder_state_matrix(view(spark, sf_dir, "v_touch"), _legs(spark, sf_dir), 3, op.LEG_VALUES, complete=False)
    return op.arb_streams(matrix, 3)


@query("arb_stream_episodes", f"WITH {_STREAMS} SELECT * FROM eps")
def arb_stream_episodes(spark, sf_dir):
    return op.stream_episodes(_arb_streams(spark, sf_dir), 3, HOUR, 1_000)


@query("arb_stream_summary", f"""WITH {_STREAMS}, de AS (SELECT stream, count(*) FILTER (NOT live) AS incomplete FROM sr GROUP BY stream), kx AS (SELECT *, CASE WHEN end_us IS NOT NULL THEN excess END AS x, end_us - start_us AS held FROM eps),
  fo AS (SELECT stream, count(*) AS found, count(end_us) AS kept, count(*) - count(end_us) AS censored, count(*) FILTER (tradeable) AS tradeable, min(x) AS least, {", ".join(f"quantile_disc(x, 0.{q}) AS p{q}" for q in (25, 50, 75, 90))}, max(x) AS most, quantile_disc(held, 0.5) AS p50_us, quantile_disc(held, 0.9) AS p90_us FROM kx GROUP BY stream)
  SELECT stream, incomplete, coalesce(found, 0) AS found, coalesce(kept, 0) AS kept, coalesce(censored, 0) AS censored, coalesce(tradeable, 0) AS tradeable, least, p25, p50, p75, p90, most, p50_us, p90_us FROM de LEFT JOIN fo USING (stream)""")
def arb_stream_summary(spark, sf_dir):
    streams = _arb_streams(spark, sf_dir)
    return op.stream_summary(streams, op.stream_episodes(streams, 3, HOUR, 1_000))


_CROSSINGS = """rk AS (SELECT ticker, id, us, mid2, row_number() OVER (PARTITION BY ticker ORDER BY us, id) AS n FROM v_mid WHERE mid2 IS NOT NULL),
  pr AS (SELECT a.ticker, a.n AS i, b.n AS j, a.id AS anchor_id, a.us AS anchor_us, b.id AS crossing_id, b.us, CASE WHEN b.mid2 > a.mid2 THEN 1 ELSE -1 END AS direction FROM rk a JOIN rk b ON a.ticker = b.ticker AND b.n > a.n AND b.us - a.us <= 86400000000 AND abs(b.mid2 - a.mid2) >= 2000),
  cr AS (SELECT DISTINCT ticker, 0::BIGINT AS upto, NULL::BIGINT AS anchor_id, NULL::BIGINT AS anchor_us, NULL::BIGINT AS crossing_id, NULL::BIGINT AS us, NULL::INT AS direction FROM rk UNION ALL
    SELECT ticker, x[1], x[2], x[3], x[4], x[5], x[6] FROM (SELECT cr.ticker, arg_min((pr.j, pr.anchor_id, pr.anchor_us, pr.crossing_id, pr.us, pr.direction), (pr.j, pr.i)) AS x FROM cr JOIN pr ON pr.ticker = cr.ticker AND pr.i > cr.upto GROUP BY cr.ticker)),
  crossings AS (SELECT ticker, anchor_id, anchor_us, crossing_id, us, direction FROM cr WHERE anchor_id IS NOT NULL)"""
def _responses_sql(ways):
    return f"""{_CROSSINGS}, wy AS ({ways}), ba AS (SELECT c.ticker, wy.follower, crossing_id, anchor_us, us, direction FROM crossings c JOIN wy ON wy.ticker = c.ticker),
  bs AS (SELECT ba.*, (SELECT arg_max(mid2, (m.us, m.id)) FROM v_mid m WHERE m.ticker = follower AND mid2 IS NOT NULL AND m.us <= ba.us) AS base2 FROM ba),
  responses AS (SELECT ticker, follower, crossing_id, anchor_us, us, direction, (SELECT min(m.us) FROM v_mid m WHERE m.ticker = follower AND m.us > bs.us AND m.us <= bs.us + 172800000000 AND (mid2 - base2) * direction >= 1000) - us AS lead_us FROM bs WHERE base2 IS NOT NULL)"""


_NEXT = "concat('M', CAST(substr(ticker, 2) AS BIGINT) + 1)"
_RESPONSES = _responses_sql(f"SELECT DISTINCT ticker, {_NEXT} AS follower FROM v_mid")
_PAIRS = f"SELECT DISTINCT concat('C', CAST(substr(ticker, 2) AS BIGINT) % 4) AS corridor, ticker AS upstream, {_NEXT} AS downstream FROM v_mid"


@query("leader_crossings", f"WITH RECURSIVE {_CROSSINGS} SELECT * FROM crossings")
def leader_crossings(spark, sf_dir):
    return op.leader_crossings(view(spark, sf_dir, "v_mid"), 24 * HOUR, 2000)

def _pairs(spark, sf_dir):
    tickers = view(spark, sf_dir, "v_mid").select("ticker").distinct()
    return tickers.select("ticker", F.concat(F.lit("M"), F.substring("ticker", 2, 20).cast("long") + 1).alias("follower"))

@query("follower_response", f"WITH RECURSIVE {_RESPONSES} SELECT * FROM responses")
def follower_response(spark, sf_dir):
    quotes = view(spark, sf_dir, "v_mid")
    return op.follower_response(op.leader_crossings(quotes, 24 * HOUR, 2000), quotes, _pairs(spark, sf_dir), 48 * HOUR, 1000)

_LEADS = f"""{_responses_sql(f"SELECT DISTINCT upstream AS ticker, downstream AS follower FROM ({_PAIRS}) UNION SELECT downstream, upstream FROM ({_PAIRS})")},
  wa AS (SELECT corridor, 'forward' AS reading, upstream AS ticker, downstream AS follower FROM ({_PAIRS}) UNION ALL SELECT corridor, 'reverse', downstream, upstream FROM ({_PAIRS})),
  el AS (SELECT r.*, lead_us IS NOT NULL AND EXISTS (SELECT 1 FROM v_quiet x WHERE x.start_us <= r.us + r.lead_us AND x.end_us >= r.anchor_us) AS is_out, us {{div}} 86400000000 AS d, corridor, reading FROM responses r JOIN wa ON wa.ticker = r.ticker AND wa.follower = r.follower),
  es AS (SELECT 'pair' AS scope, reading, corridor, ticker AS leader, follower, (-1)::BIGINT AS day, lead_us, is_out FROM el UNION ALL SELECT 'corridor', reading, corridor, '*', '*', -1, lead_us, is_out FROM el UNION ALL SELECT 'day', reading, corridor, '*', '*', d::BIGINT, lead_us, is_out FROM el)"""


@query("pair_lead_lag", f"""WITH RECURSIVE {_LEADS} SELECT scope, reading, corridor, leader, follower, day, count(*) AS crossings, count(lead_us) FILTER (NOT is_out) AS episodes, count(lead_us) FILTER (is_out) AS screened, quantile_cont(lead_us, 0.5) FILTER (NOT is_out) AS median_lead_us FROM es GROUP BY scope, reading, corridor, leader, follower, day""")
def pair_lead_lag(spark, sf_dir):
    pairs = _pairs(spark, sf_dir).select(F.concat(F.lit("C"), F.substring("ticker", 2, 20).cast("long") % 4).alias("corridor"), F.col("ticker").alias("upstream"), F.col("follower").alias("downstream"))
    return op.pair_lead_lag(view(spark, sf_dir, "v_mid"), pairs, view(spark, sf_dir, "v_quiet"), 24 * HOUR, 2000, 48 * HOUR, 1000)
