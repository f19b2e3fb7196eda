from pyspark.sql import functions as F

from tidemark.operators import events as op
from tidemark.queries import query
from tidemark.sources.adapters import view

HOUR = 3_600_000_000
_RUN = "rx AS (SELECT *, max(tenths) OVER (PARTITION BY station, day ORDER BY valid_us, id ROWS UNBOUNDED PRECEDING) AS extreme FROM v_lst)"
_LOCKED = f"""{_RUN}, m AS (SELECT s.station, s.day, s.strike, s.ticker, r.* EXCLUDE (station, day) FROM v_strikes s LEFT JOIN rx r ON s.station = r.station AND s.day = r.day),
  lk AS (SELECT station, day, strike, ticker, arg_min((seen_us, tenths, id), (valid_us, id)) FILTER (extreme >= strike + 10) AS c, arg_min(id, (valid_us, id)) FILTER (extreme >= strike) AS r FROM m GROUP BY ALL),
  locks AS (SELECT station, day, strike, ticker, CASE WHEN c IS NOT NULL THEN 'clean' WHEN r IS NOT NULL THEN 'ambiguous' ELSE 'none' END AS kind, c[1] AS t0_us, c[2] AS tenths, c[3] AS reading_id FROM lk)"""


_ZONES = ("America/New_York", "America/Chicago", "America/Denver", "America/Los_Angeles")


def _stations(spark, sf_dir):
    zone = F.element_at(F.array(*map(F.lit, _ZONES)), (F.substring("station", 2, 9).cast("int") % 4 + 1))
    return view(spark, sf_dir, "v_obs").select("station", zone.alias("tz")).distinct()


def _readings(spark, sf_dir):
    """Readings by the days of local standard time, from the stations' zones; the SQL has their hours."""
    return op.lst_days(view(spark, sf_dir, "v_obs"), _stations(spark, sf_dir))


def _locks(spark, sf_dir):
    return op.detect_locks(_readings(spark, sf_dir), view(spark, sf_dir, "v_strikes"), 10)


@query("lst_day_window", "SELECT DISTINCT 'America/New_York' AS tz, day, day * 86400000000 + 18000000000 AS start_us, day * 86400000000 + 18000000000 + 86400000000 AS end_us FROM v_days")
def lst_day_window(spark, sf_dir):
    return op.lst_day_window(view(spark, sf_dir, "v_days").select(F.lit("America/New_York").alias("tz"), F.col("day").cast("int")).distinct()).withColumn("day", F.col("day").cast("long"))


@query("wall_clock_window", """WITH d AS (SELECT DISTINCT (CAST(l_shipdate AS DATE) - DATE '1970-01-01')::BIGINT AS day FROM lineitem)
  SELECT 'America/New_York' AS tz, day, epoch_us(timezone('America/New_York', CAST(DATE '1970-01-01' + day::INT AS TIMESTAMP))) AS start_us, epoch_us(timezone('America/New_York', CAST(DATE '1970-01-01' + day::INT + 1 AS TIMESTAMP))) AS end_us FROM d""")
def wall_clock_window(spark, sf_dir):
    from tidemark.sources.adapters import table

    days = table(spark, sf_dir, "lineitem").select(F.lit("America/New_York").alias("tz"), F.unix_date(F.col("l_shipdate").cast("date")).alias("day")).distinct()
    return op.wall_clock_window(days).withColumn("day", F.col("day").cast("long"))


@query("detect_locks", f"WITH {_LOCKED} SELECT * FROM locks")
def detect_locks(spark, sf_dir):
    return _locks(spark, sf_dir)


_LOW = """rn AS (SELECT *, min(tenths) OVER (PARTITION BY station, day ORDER BY valid_us, id ROWS UNBOUNDED PRECEDING) AS extreme FROM v_lst), m AS (SELECT s.station, s.day, s.strike, s.ticker, r.* EXCLUDE (station, day) FROM v_strikes s LEFT JOIN rn r ON s.station = r.station AND s.day = r.day),
  lk AS (SELECT station, day, strike, ticker, arg_min((seen_us, tenths, id), (valid_us, id)) FILTER (extreme < strike - 10) AS c, arg_min(id, (valid_us, id)) FILTER (extreme < strike) AS r FROM m GROUP BY ALL)"""


@query("detect_low_locks", f"WITH {_LOW} SELECT station, day, strike, ticker, CASE WHEN c IS NOT NULL THEN 'clean' WHEN r IS NOT NULL THEN 'ambiguous' ELSE 'none' END AS kind, c[1] AS t0_us, c[2] AS tenths, c[3] AS reading_id FROM lk")
def detect_low_locks(spark, sf_dir):
    return op.detect_locks(_readings(spark, sf_dir), view(spark, sf_dir, "v_strikes"), 10, low=True, strict=True)


@query("lock_supply", f"WITH {_LOCKED} SELECT station, count(*) AS strikes, count(*) FILTER (kind = 'clean') AS clean, count(*) FILTER (kind = 'ambiguous') AS ambiguous FROM locks GROUP BY ROLLUP (station)")
def lock_supply(spark, sf_dir):
    return op.lock_supply(_locks(spark, sf_dir))


_EVENTS = "et AS (SELECT event_id, concat('M', user_id) AS ticker, us AS t0_us, k % 2 = 0 AS won, k FROM ev WHERE event_type = 'error')"
_LAGS = f"""{_EVENTS}, hi AS (SELECT et.*, (SELECT arg_min((us, id), (us, id)) FROM v_mid m WHERE m.ticker = et.ticker AND us > t0_us AND us <= t0_us + 172800000000 AND mid2 >= 9000 AND mid2 <= 11000) AS hit FROM et),
  nm AS (SELECT event_id, count(*) AS no_mid FROM hi JOIN v_mid m ON m.ticker = hi.ticker AND us > t0_us AND us <= t0_us + 172800000000 AND mid2 IS NULL WHERE hit IS NULL OR us < hit[1] OR (us = hit[1] AND id < hit[2]) GROUP BY event_id),
  cd AS (SELECT event_id, us - lag(us) OVER (PARTITION BY event_id ORDER BY us, id) AS gap, count(*) OVER (PARTITION BY event_id) AS m FROM et JOIN v_mid USING (ticker) WHERE us >= t0_us AND us <= t0_us + 86400000000),
  ce AS (SELECT event_id, gap, row_number() OVER (PARTITION BY event_id ORDER BY gap) - 1 AS i, count(*) OVER (PARTITION BY event_id) AS m FROM cd WHERE m >= 3 AND gap IS NOT NULL),
  lags AS (SELECT event_id, hi.ticker, t0_us, won, k, hit[1] - t0_us AS lag_us, coalesce(no_mid, 0) AS no_mid, gap AS cadence_us FROM hi LEFT JOIN nm USING (event_id) LEFT JOIN (SELECT * FROM ce WHERE i = round_even((m - 1) * 0.5, 0)) ce USING (event_id))"""


def _events(spark, sf_dir):
    events = view(spark, sf_dir, "ev").filter("event_type = 'error'")
    return events.select("event_id", F.concat(F.lit("M"), "user_id").alias("ticker"), F.col("us").alias("t0_us"), (F.col("k") % 2 == 0).alias("won"), "k")


def _lags(spark, sf_dir):
    return op.reprice_lag(_events(spark, sf_dir), view(spark, sf_dir, "v_mid"), 9000, 11_000, 48 * HOUR, 24 * HOUR)


def _series():
    return F.concat(F.lit("G"), F.substring("ticker", 2, 20).cast("long") % 5)


_SERIES_SQL = "concat('G', CAST(substr(ticker, 2) AS BIGINT) % 5)"


@query("reprice_lag", f"WITH {_LAGS} SELECT * FROM lags")
def reprice_lag(spark, sf_dir):
    return _lags(spark, sf_dir)


def _ranked(value, q):
    return f"(SELECT min({value}) FROM (SELECT {value}, row_number() OVER (ORDER BY {value}) - 1 AS i, count(*) OVER () AS m FROM s x WHERE x.scope = s.scope AND x.series = s.series AND {value} IS NOT NULL) WHERE i = round_even((m - 1) * {q}, 0))"


_RANKS = ", ".join(f"{_ranked(v, q)} AS {n}" for v, q, n in (("lag_us", 0.25, "p25_us"), ("lag_us", 0.5, "median_us"), ("lag_us", 0.9, "p90_us"), ("cadence_us", 0.5, "cadence_us")))


@query("lag_report", f"""WITH {_LAGS}, rw AS (SELECT lag_us, no_mid, cadence_us, k % 10 = 0 AS mis, k % 7 = 0 AS floored, unnest([{_SERIES_SQL}, 'POOLED']) AS series FROM lags),
  s AS (SELECT 'raw' AS scope, * FROM rw UNION ALL SELECT 'net', * FROM rw WHERE NOT floored),
  rp AS (SELECT scope, series, count(*) AS n, count(*) FILTER (lag_us IS NULL) AS never, sum(no_mid)::BIGINT AS no_mid, count(*) FILTER (mis) AS mislocked, {_RANKS} FROM s GROUP BY scope, series)
  SELECT *, round(mislocked / n, 9) AS mislock_rate, coalesce(2 * median_us <= 3 * cadence_us, false) AS unreliable FROM rp""")
def lag_report(spark, sf_dir):
    return op.lag_report(_lags(spark, sf_dir), _series(), F.col("k") % 10 == 0, F.col("k") % 7 == 0)


_CAPTURES = f"""{_EVENTS}, l AS (SELECT et.*, x.l AS latency_us FROM et, (SELECT unnest([0, 3600000000, 43200000000]) AS l) x),
  q AS (SELECT l.*, (SELECT arg_max((yes_bid, yes_size), (us, id)) FROM v_touch t WHERE t.ticker = l.ticker AND us <= t0_us) AS a, (SELECT arg_min((yes_bid, yes_size), (us, id)) FROM v_touch t WHERE t.ticker = l.ticker AND us >= t0_us + latency_us) AS b FROM l),
  u AS (SELECT event_id, ticker, latency_us, won, a[1] AS price, CASE WHEN a[1] > 0 AND a[1] = b[1] THEN least(a[2], b[2], 50000000 {{div}} nullif(a[1], 0)) ELSE 0 END AS units FROM q),
  ca AS (SELECT event_id, ticker, latency_us, price, units, units * coalesce(price, 0) AS spent, (7 * units * coalesce(price, 0) * (10000 - coalesce(price, 0)) + 9999999999) {{div}} 10000000000 AS fee, units * CASE WHEN won THEN 10000 ELSE 0 END AS payoff FROM u),
  cp AS (SELECT *, payoff - spent - 10000 * fee AS pnl FROM ca)"""


@query("fillable_depth", f"WITH {_CAPTURES} SELECT * FROM cp")
def fillable_depth(spark, sf_dir):
    return op.fillable_depth(_events(spark, sf_dir), view(spark, sf_dir, "v_touch"), [0, HOUR, 12 * HOUR], 5000)


@query("capture_report", f"""WITH {_CAPTURES} SELECT {_SERIES_SQL} AS series, latency_us, count(*) AS events, count(*) FILTER (units > 0) AS filled, {", ".join(f"sum({c})::BIGINT AS {c}" for c in ("units", "spent", "fee", "payoff", "pnl"))} FROM cp GROUP BY ALL""")
def capture_report(spark, sf_dir):
    return op.capture_report(fillable_depth(spark, sf_dir), _series())


_TICKER_LOCKS = "tl AS (SELECT ticker, min(us) + 43200000000 AS lock_us FROM v_touch GROUP BY ticker)"


def _ticker_locks(spark, sf_dir):
    return view(spark, sf_dir, "v_touch").groupBy("ticker").agg((F.min("us") + 12 * HOUR).alias("lock_us"))


_CONVERGED = f"""{_TICKER_LOCKS}, r1 AS (SELECT *, coalesce(mid2 >= 11000, false) AS is_on, lead(us) OVER (PARTITION BY ticker ORDER BY us, id) AS next_us FROM v_mid), r2 AS (SELECT *, lag(is_on) OVER (PARTITION BY ticker ORDER BY us, id) AS was FROM r1),
  r3 AS (SELECT *, sum(CASE WHEN is_on AND NOT coalesce(was, false) THEN 1 ELSE 0 END) OVER (PARTITION BY ticker ORDER BY us, id ROWS UNBOUNDED PRECEDING) AS island FROM r2),
  r4 AS (SELECT ticker, min(us) AS from_us, (arg_max((next_us, 1), (us, id)))[1] AS to_us FROM r3 WHERE is_on GROUP BY ticker, island),
  cg AS (SELECT ticker, lock_us, min(CASE WHEN from_us IS NOT NULL AND (to_us IS NULL OR greatest(from_us, lock_us) + 21600000000 <= to_us) AND greatest(from_us, lock_us) + 21600000000 <= lock_us + 864000000000 THEN greatest(from_us, lock_us) END) - lock_us AS converged_us FROM tl LEFT JOIN r4 USING (ticker) GROUP BY ticker, lock_us)"""


def _converged(spark, sf_dir):
    return op.convergence_time(_ticker_locks(spark, sf_dir), view(spark, sf_dir, "v_mid"), 11_000, 6 * HOUR, 240 * HOUR)


@query("convergence_time", f"WITH {_CONVERGED} SELECT *, coalesce(converged_us, 864000000000) AS half_life_us, converged_us IS NULL AS censored FROM cg")
def convergence_time(spark, sf_dir):
    return op.half_lives(_converged(spark, sf_dir), 240 * HOUR)


@query("convergence_readout", f"""WITH {_CONVERGED}, cs AS (SELECT unnest([{_SERIES_SQL}, 'POOLED']) AS series, converged_us FROM cg), ct AS (SELECT series, count(*) AS n, count(converged_us) AS seen, list_sort(list(converged_us) FILTER (converged_us IS NOT NULL)) AS times FROM cs GROUP BY series)
  SELECT series, n, n - seen AS censored, CASE WHEN 2 * seen > n THEN times[(n + 1) {{div}} 2] END AS median_us FROM ct""")
def convergence_readout(spark, sf_dir):
    return op.convergence_readout(_converged(spark, sf_dir), 240 * HOUR, _series())


_FLOW = f"""{_TICKER_LOCKS}, fw AS (SELECT taker_side, units, CASE taker_side WHEN 'yes' THEN yes_price ELSE 10000 - yes_price END AS price FROM v_prints JOIN tl USING (ticker) WHERE us > lock_us AND taker_side <> ''),
  fl AS (SELECT taker_side, price {{div}} 100 AS cent, count(*) AS fills, sum(units)::BIGINT AS units, sum(units * price)::BIGINT AS notional, sum((7 * units * price * (10000 - price) + 9999999999) {{div}} 10000000000)::BIGINT AS fees FROM fw GROUP BY ALL)"""


@query("post_lock_flow", f"WITH {_FLOW} SELECT taker_side, sum(fills)::BIGINT AS fills, sum(units)::BIGINT AS units, sum(notional)::BIGINT AS notional FROM fl GROUP BY taker_side")
def post_lock_flow(spark, sf_dir):
    return op.post_lock_flow(view(spark, sf_dir, "v_prints"), _ticker_locks(spark, sf_dir))


@query("post_lock_prices", f"WITH {_FLOW} SELECT * FROM fl")
def post_lock_prices(spark, sf_dir):
    return op.post_lock_prices(view(spark, sf_dir, "v_prints"), _ticker_locks(spark, sf_dir))


_QC = """q1 AS (SELECT *, lag(tenths) OVER w AS t, lag(valid_us) OVER w AS u, lead(tenths) OVER w AS t2, lead(valid_us) OVER w AS u2 FROM v_obs WINDOW w AS (PARTITION BY station ORDER BY valid_us, id)),
  q2 AS (SELECT *, CASE WHEN tenths < 420 OR tenths > 980 THEN 'implausible' WHEN abs(tenths - t) * 60000000 > 2 * (valid_us - u) THEN 'needs_confirmation' ELSE 'ok' END AS status FROM q1)"""


def _checked(spark, sf_dir):
    return op.qc_plausible_rate(view(spark, sf_dir, "v_obs"), 420, 980, 2)


@query("qc_plausible_rate", f"WITH {_QC} SELECT id, station, valid_us, tenths, status FROM q2")
def qc_plausible_rate(spark, sf_dir):
    return _checked(spark, sf_dir)


@query("qc_confirm", f"WITH {_QC} SELECT id, station, coalesce(u2 - valid_us <= 7200000000 AND abs(t2 - tenths) <= 100, false) AS confirmed FROM q2 WHERE status = 'needs_confirmation'")
def qc_confirm(spark, sf_dir):
    return op.qc_confirm(_checked(spark, sf_dir), 2 * HOUR, 100)


@query("qc_stuck", """WITH a AS (SELECT station, valid_us, id, tenths {div} 200 AS value FROM v_obs), b AS (SELECT *, lag(value) OVER (PARTITION BY station ORDER BY valid_us, id) AS was FROM a), c AS (SELECT *, sum(CASE WHEN was IS NULL OR was <> value THEN 1 ELSE 0 END) OVER (PARTITION BY station ORDER BY valid_us, id ROWS UNBOUNDED PRECEDING) AS island FROM b)
  SELECT station, value, min(valid_us) AS first_us, max(valid_us) AS last_us, count(*) AS n FROM c GROUP BY station, island, value HAVING max(valid_us) - min(valid_us) >= 14400000000""")
def qc_stuck(spark, sf_dir):
    return op.qc_stuck(view(spark, sf_dir, "v_obs"), F.expr("tenths div 200"), 4 * HOUR)


@query("qc_neighbor", """SELECT id, EXISTS (SELECT 1 FROM v_obs n WHERE n.station = concat('S', (CAST(substr(o.station, 2) AS BIGINT) + 1) % 20) AND abs(n.valid_us - o.valid_us) <= 1800000000 AND abs(n.tenths - o.tenths) <= 50) AS supported FROM v_obs o""")
def qc_neighbor(spark, sf_dir):
    readings = view(spark, sf_dir, "v_obs")
    near = readings.select("station").distinct().select("station", F.concat(F.lit("S"), (F.substring("station", 2, 9).cast("long") + 1) % 20).alias("neighbour"))
    return op.qc_neighbor(readings, near, HOUR // 2, 50)


_BASIS = """hi AS (SELECT station, day, max(tenths) AS high, count(DISTINCT valid_us {div} 60000000) AS minutes FROM v_lst GROUP BY 1, 2 HAVING count(DISTINCT valid_us {div} 60000000) >= 5),
  cp AS (SELECT station, day, high, minutes, official, high - official * 10 AS delta, abs(round_even((high - official * 10) / 10, 0)) <= 1 AS valid FROM hi JOIN v_days USING (station, day))"""


def _compared(spark, sf_dir):
    return op.basis_compare(_readings(spark, sf_dir), view(spark, sf_dir, "v_days"), 5)


@query("basis_compare", f"WITH {_BASIS} SELECT * FROM cp")
def basis_compare(spark, sf_dir):
    return _compared(spark, sf_dir)


@query("basis_summary", f"""WITH {_BASIS}, k AS (SELECT station, delta, row_number() OVER (PARTITION BY station ORDER BY delta) - 1 AS i, count(*) OVER (PARTITION BY station) AS m FROM cp)
  SELECT station, count(*) AS n, count(*) FILTER (NOT valid) AS invalid, {", ".join(f"(SELECT min(delta) FROM k WHERE k.station = cp.station AND i = floor((m - 1) * {q / 100} + 0.5)) AS p{q}" for q in (10, 50, 90))} FROM cp GROUP BY station""")
def basis_summary(spark, sf_dir):
    return op.basis_summary(_compared(spark, sf_dir))


@query("delta_partition", f"WITH {_BASIS} SELECT round_even(delta / 10, 0)::BIGINT AS degrees, count(*) AS n, sum(minutes)::BIGINT AS minutes, abs(round_even(delta / 10, 0)) <= 1 AS within_one FROM cp GROUP BY round_even(delta / 10, 0)")
def delta_partition(spark, sf_dir):
    return op.delta_partition(_compared(spark, sf_dir))


@query("separating_strikes", f"WITH {_BASIS} SELECT station, day, array_to_string(list_filter([900, 950, 970, 980, 990], lambda s: (high > s) <> (official * 10 > s)), ',') AS strikes FROM cp")
def separating_strikes(spark, sf_dir):
    rows = _compared(spark, sf_dir).withColumn("settled", F.col("official") * 10)
    return rows.select("station", "day", F.array_join(op.separating_strikes("high", "settled", [900, 950, 970, 980, 990]).cast("array<string>"), ",").alias("strikes"))


_ENTRY = f"""{_RUN}, nn AS (SELECT rx.*, official, row_number() OVER (PARTITION BY station, day ORDER BY valid_us, id) AS n FROM rx JOIN v_days USING (station, day)),
  e0 AS (SELECT station, day, official, min(valid_us) AS entry_us, CASE WHEN arg_min(n, (valid_us, id)) = 1 THEN 'open' ELSE 'crossing' END AS how FROM nn WHERE extreme > official * 10 GROUP BY station, day, official),
  en AS (SELECT station, day, entry_us, how, (SELECT arg_max(s.ticker, (strike, s.ticker)) FROM v_strikes s WHERE s.station = e0.station AND s.day = e0.day AND strike <= official * 10) AS ticker,
    ((day + 1) * 86400000000 + (5 + CAST(substr(station, 2) AS BIGINT) % 4) * 3600000000 - entry_us) {{div}} 60000000 AS minutes_to_close FROM e0)"""


def _entries(spark, sf_dir):
    official = view(spark, sf_dir, "v_days")
    windows = op.lst_day_window(official.select("station", F.col("day").cast("int").alias("day")).join(_stations(spark, sf_dir), "station"))
    closes = windows.select("station", F.col("day").cast("long").alias("day"), F.col("end_us").alias("close_us"))
    return op.straddle_entry(_readings(spark, sf_dir), official, view(spark, sf_dir, "v_strikes"), closes)


@query("straddle_entry", f"WITH {_ENTRY} SELECT * FROM en")
def straddle_entry(spark, sf_dir):
    return _entries(spark, sf_dir)


@query("straddle_histogram", f"WITH {_ENTRY} SELECT how, minutes_to_close {{div}} 60 * 60 AS from_minute, count(*) AS entries, count(ticker) AS settling FROM en GROUP BY 1, 2")
def straddle_histogram(spark, sf_dir):
    return op.straddle_histogram(_entries(spark, sf_dir))


@query("straddle_price", f"""WITH {_EVENTS}, s AS (SELECT event_id AS entry_id, ticker, t0_us AS at_us, (SELECT arg_max((yes_bid, yes_size, mid2), (us, id)) FROM v_mid m WHERE m.ticker = et.ticker AND us <= t0_us) AS x FROM et)
  SELECT entry_id, ticker, at_us, x[3] AS mid2, CASE WHEN x IS NULL THEN 'no_row' WHEN x[3] IS NULL THEN 'one_sided' WHEN x[2] < 2600 THEN 'censored' ELSE 'ok' END AS status FROM s""")
def straddle_price(spark, sf_dir):
    entries = _events(spark, sf_dir).select(F.col("event_id").alias("entry_id"), "ticker", F.col("t0_us").alias("at_us"))
    return op.straddle_price(entries, view(spark, sf_dir, "v_mid"), 2600)


_RATES = """f AS (SELECT station, tenths > 900 AS hot, tenths < 450 AS cold, seen_us - valid_us > 300000000 AS late FROM v_obs), u AS (SELECT station, 'hot' AS mechanism, 0::BIGINT AS priority, 0.175 AS t, hot::INT AS hit FROM f UNION ALL SELECT station, 'cold', 1, 0.05, cold::INT FROM f UNION ALL SELECT station, 'late', 2, 0.25, late::INT FROM f),
  rt AS (SELECT station, mechanism, priority, sum(hit)::BIGINT AS numerator, count(*) AS denominator, sum(hit)::BIGINT * 1000000 {div} count(*) AS millionths, sum(hit)::DECIMAL(18, 0) >= any_value(t)::DECIMAL(18, 3) * count(*)::DECIMAL(18, 0) AS matched FROM u GROUP BY station, mechanism, priority)"""


def _rates(spark, sf_dir):
    flags = view(spark, sf_dir, "v_obs").select("station", (F.col("tenths") > 900).alias("hot"), (F.col("tenths") < 450).alias("cold"), (F.col("seen_us") - F.col("valid_us") > 300_000_000).alias("late"))
    return op.mechanism_rates(flags, "station", {"hot": "0.175", "cold": "0.05", "late": "0.25"})


@query("mechanism_rates", f"WITH {_RATES} SELECT * FROM rt")
def mechanism_rates(spark, sf_dir):
    return _rates(spark, sf_dir)


@query("mechanism_first", f"WITH {_RATES} SELECT station, arg_min(mechanism, priority) FILTER (matched) AS mechanism, arg_min(numerator, priority) FILTER (matched) AS numerator, arg_min(denominator, priority) FILTER (matched) AS denominator FROM rt GROUP BY station")
def mechanism_first(spark, sf_dir):
    return op.first_matching(_rates(spark, sf_dir), "station")


@query("mechanism_published", f"""WITH {_RATES}, pb AS (SELECT station, max(millionths) AS published FROM rt GROUP BY station)
  SELECT station, published, arg_min(mechanism, priority) FILTER (millionths = published) AS mechanism, count(*) FILTER (millionths = published) AS candidates FROM pb JOIN rt USING (station) GROUP BY station, published""")
def mechanism_published(spark, sf_dir):
    rates = _rates(spark, sf_dir)
    return op.published_mechanism(rates, rates.groupBy("station").agg(F.max("millionths").alias("millionths")), "station")


_TWO = "pb AS (SELECT station, (valid_us + id % 7 {div} 6 * 60000000) {div} 60000000 AS minute, max(tenths) AS value FROM v_obs GROUP BY 1, 2), dc AS (SELECT station, valid_us {div} 60000000 AS minute, max(tenths - tenths % 2) AS value FROM v_obs GROUP BY 1, 2)"


@query("decode_agreement", f"""WITH {_TWO} SELECT coalesce(p.station, d.station) AS station, count(*) FILTER (p.value = d.value) AS same, count(*) FILTER (p.value <> d.value) AS differing, count(*) FILTER (d.value IS NULL) AS absent, count(*) FILTER (p.value IS NULL) AS extra
  FROM pb p FULL JOIN dc d ON p.station = d.station AND p.minute = d.minute GROUP BY 1""")
def decode_agreement(spark, sf_dir):
    """One reading in seven is published a minute late; decoded values are even."""
    side = lambda us, value: view(spark, sf_dir, "v_obs").groupBy("station", F.expr(f"({us}) div 60000000").alias("minute")).agg(F.max(value).alias("value"))
    return op.decode_agreement(side("valid_us + id % 7 div 6 * 60000000", F.col("tenths")), side("valid_us", F.col("tenths") - F.col("tenths") % 2))


@query("window_difference", """WITH a AS (SELECT station, (valid_us - 18000000000) {div} 86400000000 AS day, max(tenths) AS high_a FROM v_obs GROUP BY 1, 2), b AS (SELECT station, (valid_us - 14400000000) {div} 86400000000 AS day, max(tenths) AS high_b FROM v_obs GROUP BY 1, 2),
  d AS (SELECT station, day FROM v_days) SELECT station, day, high_a, high_b FROM d LEFT JOIN a USING (station, day) LEFT JOIN b USING (station, day) WHERE high_a IS DISTINCT FROM high_b""")
def window_difference(spark, sf_dir):
    days = view(spark, sf_dir, "v_days")
    windows = lambda hours: days.select("station", "day", (F.col("day") * op.DAY_US + hours * HOUR).alias("start_us"), ((F.col("day") + 1) * op.DAY_US + hours * HOUR).alias("end_us"))
    return op.window_difference(view(spark, sf_dir, "v_obs"), windows(5), windows(4))


@query("settle_trades", """WITH t AS (SELECT event_id AS trade_id, concat('S', user_id % 20) AS station, us {div} 86400000000 + k % 3 AS day, 900 + k AS strike, CASE WHEN k % 2 = 0 THEN 'yes' ELSE 'no' END AS side, c AS units, 100 * (1 + k % 98) AS price FROM ev WHERE event_type = 'click' AND event_id NOT IN (SELECT trade_id FROM v_prints WHERE units > 5000)),
  j AS (SELECT t.*, official * 10 >= strike AS yes FROM t LEFT JOIN v_days USING (station, day))
  SELECT trade_id, CASE WHEN yes IS NULL THEN 'pending' WHEN yes = (side = 'yes') THEN 'won' ELSE 'lost' END AS outcome, CASE WHEN yes IS NULL THEN NULL WHEN yes = (side = 'yes') THEN units * (10000 - price) ELSE -units * price END AS pnl FROM j""")
def settle_trades(spark, sf_dir):
    ev = view(spark, sf_dir, "ev").filter("event_type = 'click'")
    trades = ev.select(F.col("event_id").alias("trade_id"), F.concat(F.lit("S"), F.col("user_id") % 20).alias("station"), (F.expr("us div 86400000000") + F.col("k") % 3).alias("day"), (900 + F.col("k")).alias("strike"), F.when(F.col("k") % 2 == 0, "yes").otherwise("no").alias("side"), F.col("c").alias("units"), (100 * (1 + F.col("k") % 98)).alias("price"))
    return op.settle_trades(trades, view(spark, sf_dir, "v_days"), view(spark, sf_dir, "v_prints").filter("units > 5000").select("trade_id"))


@query("observation_sidecar", """WITH g AS (SELECT station, day, count(*) AS n, md5(string_agg(concat(id, ':', tenths), ',' ORDER BY valid_us, id)) AS digest, count(DISTINCT valid_us {div} 60000000) AS minutes, min(valid_us) {div} 60000000 AS first_minute, max(valid_us) {div} 60000000 AS last_minute FROM v_lst GROUP BY 1, 2)
  SELECT station, day, n, digest, official IS NULL AS missing, minutes, first_minute, last_minute FROM g LEFT JOIN (SELECT station, day, CASE WHEN official % 3 <> 0 THEN official END AS official FROM v_days) USING (station, day)""")
def observation_sidecar(spark, sf_dir):
    return op.observation_sidecar(_readings(spark, sf_dir), view(spark, sf_dir, "v_days").withColumn("official", F.expr("CASE WHEN official % 3 <> 0 THEN official END")))


@query("arrival_delay", """WITH x AS (SELECT s.station, s.day, s.strike, min(valid_us) AS reached_us, min(seen_us) AS seen_us FROM v_strikes s LEFT JOIN v_lst o ON o.station = s.station AND o.day = s.day AND tenths >= strike GROUP BY ALL)
  SELECT station, day, strike, CASE WHEN reached_us IS NULL THEN 'never' WHEN seen_us > reached_us THEN 'delayed' ELSE 'at_once' END AS kind, seen_us - reached_us AS delay_us FROM x""")
def arrival_delay(spark, sf_dir):
    return op.arrival_delay(_readings(spark, sf_dir), view(spark, sf_dir, "v_strikes"))
