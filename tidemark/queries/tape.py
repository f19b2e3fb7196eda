from pyspark.sql import functions as F

from tidemark.operators import tape as op
from tidemark.plans.intervals import merge_intervals
from tidemark.queries import query
from tidemark.sources.adapters import table, view

#: The scope of the tape in the tests' month.
START, END = 1_704_153_600_000_000, 1_706_400_000_000_000

_MESSAGES = "m AS (SELECT us, seq, min(id) AS id, bool_or(is_snapshot) AS is_snapshot FROM v_tape GROUP BY us, seq), s AS (SELECT *, lag(seq) OVER (ORDER BY id) AS prev_seq, lag(us) OVER (ORDER BY id) AS prev_us, lag(id) OVER (ORDER BY id) AS prev_id FROM m)"
_BLIND = f"""{_MESSAGES}, r AS (SELECT *, sum(CASE WHEN seq <= prev_seq THEN 1 ELSE 0 END) OVER (ORDER BY id) AS run FROM s),
  d AS (SELECT *, min(CASE WHEN NOT is_snapshot THEN id END) OVER (PARTITION BY run) AS delta_id FROM r WHERE run > 0),
  w AS (SELECT min(id) AS boundary_id, arg_min(prev_id, id) AS prev_id, arg_min(prev_seq, id) AS prev_seq, arg_min(seq, id) AS seq, count(*) FILTER (delta_id IS NULL OR id < delta_id) AS burst_messages,
    arg_min(prev_us, id) AS start_us, coalesce(max(us) FILTER (delta_id IS NULL OR id < delta_id), arg_min(us, id)) AS end_us FROM d GROUP BY run),
  b AS (SELECT *, end_us - start_us AS blind_us FROM w)"""
_MERGED = """e AS (SELECT start_us, end_us, max(end_us) OVER (ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM v_excl),
  i AS (SELECT *, sum(CASE WHEN upto IS NULL OR start_us > upto THEN 1 ELSE 0 END) OVER (ORDER BY start_us, end_us) AS run FROM e),
  merged AS (SELECT min(start_us) AS start_us, max(end_us) AS end_us FROM i GROUP BY run)"""


@query("seq_boundaries", f"WITH {_MESSAGES} SELECT id, us, prev_seq, seq, CASE WHEN seq > prev_seq THEN 'skip' ELSE 'resubscribe' END AS kind FROM s WHERE seq <> prev_seq + 1")
def seq_boundaries(spark, sf_dir):
    return op.seq_boundaries(view(spark, sf_dir, "v_tape"), width=2000)


@query("blind_windows", f"WITH {_BLIND} SELECT * FROM b")
def blind_windows(spark, sf_dir):
    return op.blind_windows(view(spark, sf_dir, "v_tape"), width=2000)


_ATTACHED = _BLIND + """, n AS (SELECT boundary_id, start_us, coalesce(lead(start_us) OVER (ORDER BY start_us), start_us + 86400000000) AS next_us FROM b),
  g AS (SELECT boundary_id, v_gaps.id AS gap_id, detected_us, reason, row_number() OVER (PARTITION BY boundary_id ORDER BY detected_us, v_gaps.id) AS rn FROM v_gaps JOIN n ON detected_us >= start_us AND detected_us < next_us)"""


def _blind(spark, sf_dir):
    return op.blind_windows(view(spark, sf_dir, "v_tape"), width=2000)


@query("attach_gaps", f"WITH {_ATTACHED} SELECT boundary_id, gap_id, detected_us, reason FROM g WHERE rn = 1")
def attach_gaps(spark, sf_dir):
    return op.attach_gaps(_blind(spark, sf_dir), view(spark, sf_dir, "v_gaps"))


@query("unmatched_gaps", f"WITH {_ATTACHED} SELECT id AS gap_id, detected_us, reason FROM v_gaps WHERE id NOT IN (SELECT gap_id FROM g WHERE rn = 1)")
def unmatched_gaps(spark, sf_dir):
    return op.unmatched_gaps(attach_gaps(spark, sf_dir), view(spark, sf_dir, "v_gaps"))


@query("blind_summary", f"""WITH {_ATTACHED}, bg AS (SELECT b.*, rn IS NOT NULL AS named FROM b LEFT JOIN (SELECT * FROM g WHERE rn = 1) USING (boundary_id)),
  sc AS (SELECT 'all' AS scope, * FROM bg UNION ALL SELECT 'frozen', * FROM bg WHERE start_us >= {START} AND start_us < {END})
  SELECT scope, count(*) AS windows, count(*) FILTER (named) AS with_gap, count(*) FILTER (NOT named) AS without_gap, sum(blind_us)::BIGINT AS total_us, quantile_disc(blind_us, 0.5) AS p50_us, quantile_disc(blind_us, 0.9) AS p90_us, max(blind_us) AS max_us, sum(burst_messages)::BIGINT AS burst_messages FROM sc GROUP BY scope""")
def blind_summary(spark, sf_dir):
    return op.blind_summary(_blind(spark, sf_dir), attach_gaps(spark, sf_dir), START, END)


@query("gap_exclusion_windows", """SELECT id, ticker, detected_us, (SELECT max(t.us) FROM v_tape t WHERE t.ticker = g.ticker AND t.us < g.detected_us) AS start_us,
  (SELECT min(t.us) FROM v_tape t WHERE t.ticker = g.ticker AND t.us >= g.detected_us) AS end_us, reason FROM v_gaps g WHERE ticker <> ''""")
def gap_exclusion_windows(spark, sf_dir):
    return op.gap_exclusion_windows(view(spark, sf_dir, "v_gaps").filter("ticker <> ''"), view(spark, sf_dir, "v_tape"))


@query("ticker_coverage", "SELECT ticker, count(*) AS n_rows, min(us) AS first_us, max(us) AS last_us FROM v_tape GROUP BY ticker")
def ticker_coverage(spark, sf_dir):
    return op.ticker_coverage(view(spark, sf_dir, "v_tape"))


@query("universe_reconcile", """SELECT coalesce(e.ticker, r.ticker) AS ticker, CASE WHEN e.ticker IS NULL THEN 'unexpected' ELSE 'missing' END AS status
  FROM (SELECT DISTINCT ticker FROM v_prints WHERE units > 40000) e FULL JOIN (SELECT DISTINCT ticker FROM v_gaps) r ON e.ticker = r.ticker WHERE e.ticker IS NULL OR r.ticker IS NULL""")
def universe_reconcile(spark, sf_dir):
    return op.universe_reconcile(view(spark, sf_dir, "v_prints").filter("units > 40000"), view(spark, sf_dir, "v_gaps"), "ticker")


@query("merge_intervals", f"WITH {_MERGED} SELECT * FROM merged")
def merged_exclusions(spark, sf_dir):
    return merge_intervals(view(spark, sf_dir, "v_excl"), "start_us", "end_us")


@query("overlap_us", f"""WITH {_MERGED}, w AS (SELECT id, us AS a, us + 7200000000 AS b FROM v_prints)
  SELECT id, sum(CASE WHEN end_us IS NULL THEN 0 ELSE least(b, end_us) - greatest(a, start_us) END)::BIGINT AS overlap_us FROM w LEFT JOIN merged ON a <= end_us AND b >= start_us GROUP BY id""")
def overlap_us(spark, sf_dir):
    prints = view(spark, sf_dir, "v_prints").select("id", F.col("us").alias("a"), (F.col("us") + 7_200_000_000).alias("b"))
    return op.overlap_us(prints, view(spark, sf_dir, "v_excl"), "id", "a", "b")


@query("classify_exclusions", f"""WITH p AS (SELECT id, class, greatest(start_us - CASE class WHEN 'subscription_wide' THEN 300000000 ELSE 0 END, {START}) AS start_us, least(end_us + CASE class WHEN 'subscription_wide' THEN 300000000 ELSE 0 END, {END}) AS end_us, class = 'subscription_wide' AS padded FROM v_excl)
  SELECT *, end_us - start_us AS duration_us FROM p WHERE start_us <= end_us""")
def classify_exclusions(spark, sf_dir):
    return op.classify_exclusions(view(spark, sf_dir, "v_excl"), START, END)


@query("blind_exclusions", f"""WITH {_BLIND}, n AS (SELECT boundary_id, start_us, coalesce(lead(start_us) OVER (ORDER BY start_us), start_us + 86400000000) AS next_us FROM b),
  g AS (SELECT boundary_id, v_gaps.id AS gap_id, detected_us, reason, row_number() OVER (PARTITION BY boundary_id ORDER BY detected_us, v_gaps.id) AS rn FROM v_gaps JOIN n ON detected_us >= start_us AND detected_us < next_us),
  x AS (SELECT b.boundary_id, gap_id, reason, CASE WHEN gap_id IS NULL THEN 'resubscribe_blind' WHEN reason = 'reconnect' THEN 'subscription_wide' ELSE 'recorded_gap' END AS class,
    coalesce(detected_us {{div}} 1000000 IN (SELECT detected_us {{div}} 1000000 FROM v_gaps WHERE ticker = ''), false) AS padded, start_us, end_us FROM b LEFT JOIN (SELECT * FROM g WHERE rn = 1) g ON g.boundary_id = b.boundary_id),
  p AS (SELECT * REPLACE (CASE WHEN padded THEN start_us - 300000000 ELSE start_us END AS start_us, CASE WHEN padded THEN end_us + 300000000 ELSE end_us END AS end_us) FROM x)
  SELECT boundary_id, gap_id, reason, class, padded, greatest(start_us, {START}) AS start_us, least(end_us, {END}) AS end_us, least(end_us, {END}) - greatest(start_us, {START}) AS duration_us FROM p WHERE end_us >= {START} AND start_us <= {END}""")
def blind_exclusions(spark, sf_dir):
    gaps = view(spark, sf_dir, "v_gaps")
    incidents = gaps.filter("ticker = ''").select(F.expr("detected_us div 1000000").alias("second"))
    return op.blind_exclusions(op.blind_windows(view(spark, sf_dir, "v_tape"), width=2000), gaps, incidents, ("reconnect",), START, END)


@query("quiet_bands", "SELECT DISTINCT us {div} 86400000000 AS day, us {div} 86400000000 * 86400000000 + 25200000000 AS start_us, us {div} 86400000000 * 86400000000 + 32400000000 AS end_us FROM v_tape")
def quiet_bands(spark, sf_dir):
    return op.quiet_bands(view(spark, sf_dir, "v_tape").select(F.floor(F.col("us") / op.DAY_US).alias("day")))


_DAYS = f"""{_MERGED}, t AS (SELECT us {{div}} 86400000000 AS day, count(DISTINCT ticker) AS tickers, count(*) AS n_rows, min(us) AS first_us, max(us) AS last_us FROM v_tape GROUP BY 1),
  o AS (SELECT day, sum(greatest(0, least((day + 1) * 86400000000 - 1, end_us) - greatest(day * 86400000000, start_us)))::BIGINT AS outage_us FROM t, merged GROUP BY day),
  d AS (SELECT t.*, outage_us, outage_us * 100 <= 5 * 86400000000 AS evaluable FROM t JOIN o USING (day))"""


_SERIES = "concat('G', CAST(substr(ticker, 2) AS BIGINT) % 5)"


def _series(rows):
    return rows.withColumn("series", F.concat(F.lit("G"), F.substring("ticker", 2, 20).cast("long") % 5))


@query("event_day_inventory", f"""WITH {_MERGED}, sd AS (SELECT {_SERIES} AS series, us {{div}} 86400000000 AS day, count(DISTINCT ticker) AS tickers, count(*) AS n_rows, min(us) AS first_us, max(us) AS last_us FROM v_tape GROUP BY 1, 2)
  SELECT *, outage_us * 100 <= 5 * 86400000000 AS evaluable, last_us - first_us - coalesce((SELECT sum(least(last_us, end_us) - greatest(first_us, start_us)) FROM merged WHERE start_us <= last_us AND end_us >= first_us), 0)::BIGINT AS covered_us
  FROM (SELECT *, coalesce((SELECT sum(least((day + 1) * 86400000000 - 1, end_us) - greatest(day * 86400000000, start_us)) FROM merged WHERE start_us <= (day + 1) * 86400000000 - 1 AND end_us >= day * 86400000000), 0)::BIGINT AS outage_us FROM sd)""")
def event_day_inventory(spark, sf_dir):
    return op.event_day_inventory(_series(view(spark, sf_dir, "v_tape")), view(spark, sf_dir, "v_excl"))


@query("contiguous_run", """WITH d AS (SELECT DISTINCT station, day FROM v_lst), g AS (SELECT day FROM d GROUP BY day HAVING count(*) = (SELECT count(DISTINCT station) FROM d)),
  r AS (SELECT day, day - row_number() OVER (ORDER BY day) AS run FROM g), f AS (SELECT min(day) AS first_day, count(*) AS n FROM r GROUP BY run), x AS (SELECT min(first_day) FILTER (n >= 14) AS first_day, coalesce(max(n), 0) AS longest FROM f)
  SELECT first_day, first_day + 13 AS last_day, CASE WHEN first_day IS NULL THEN 'no_run' END AS error, longest FROM x""")
def contiguous_run(spark, sf_dir):
    days = view(spark, sf_dir, "v_lst").select("station", "day").distinct()
    return op.contiguous_run(days.withColumn("evaluable", F.lit(True)), "station", 14)


@query("freeze_split", """WITH d AS (SELECT DISTINCT us {div} 86400000000 AS day FROM v_tape), n AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS day_index, count(*) OVER () AS n FROM d)
  SELECT day, day_index, CASE WHEN day_index * 3 < n * 2 THEN 'discovery' ELSE 'holdout' END AS split FROM n""")
def freeze_split(spark, sf_dir):
    return op.freeze_split(view(spark, sf_dir, "v_tape").select(F.floor(F.col("us") / op.DAY_US).alias("day")))


@query("split_disagreements", "WITH d AS (SELECT DISTINCT station, day FROM v_lst WHERE tenths >= 900), c AS (SELECT day, count(*) AS cities, (SELECT count(DISTINCT station) FROM d) - count(*) AS missing FROM d GROUP BY day) SELECT * FROM c WHERE missing > 0")
def split_disagreements(spark, sf_dir):
    """Days on which a station read 90 degrees are those that it has."""
    return op.split_disagreements(view(spark, sf_dir, "v_lst").filter("tenths >= 900").select(F.col("station").alias("city"), "day"))


#: Event days are from 6 to 22 o'clock, and the last series has none on every fifth day.
_SCREENED = f"""{_MERGED}, w AS (SELECT id, {_SERIES} AS series, us {{div}} 86400000000 AS day, us AS a_us, us + 1800000000 AS b_us FROM v_prints),
  sw AS (SELECT *, CASE WHEN a_us < {START} OR b_us > {END} THEN 'out_of_scope' WHEN a_us < day * 86400000000 + 21600000000 OR b_us > day * 86400000000 + 79200000000 OR (series = 'G4' AND day % 5 = 0) THEN 'out_of_window'
    WHEN EXISTS (SELECT 1 FROM merged WHERE a_us <= end_us AND b_us >= start_us) THEN 'excluded' ELSE 'kept' END AS status FROM w)"""


@query("screen_windows", f"WITH {_SCREENED} SELECT * FROM sw")
def screen_windows(spark, sf_dir):
    windows = _series(view(spark, sf_dir, "v_prints")).select("id", "series", F.floor(F.col("us") / op.DAY_US).alias("day"), F.col("us").alias("a_us"), (F.col("us") + 1_800_000_000).alias("b_us"))
    days = windows.select("series", "day").distinct().filter("not (series = 'G4' and day % 5 = 0)")
    days = days.select("series", "day", (F.col("day") * op.DAY_US + 6 * 3_600_000_000).alias("start_us"), (F.col("day") * op.DAY_US + 22 * 3_600_000_000).alias("end_us"))
    return op.screen_windows(windows, view(spark, sf_dir, "v_excl"), START, END, days)


@query("screen_tally", f"""WITH {_SCREENED}, ct AS (SELECT class, count(DISTINCT sw.id) AS n FROM sw JOIN v_excl e ON a_us <= e.end_us AND b_us >= e.start_us WHERE status = 'excluded' GROUP BY class)
  SELECT 'status' AS kind, status AS name, count(*) AS n FROM sw GROUP BY status UNION ALL SELECT 'class', class, coalesce(n, 0) FROM (SELECT DISTINCT class FROM v_excl) LEFT JOIN ct USING (class)""")
def screen_tally(spark, sf_dir):
    return op.screen_tally(screen_windows(spark, sf_dir), view(spark, sf_dir, "v_excl"))


@query("frames_in_windows", f"""WITH {_BLIND}, f AS (SELECT boundary_id, burst_messages, (SELECT count(*) FROM v_tape t WHERE t.us > start_us AND t.us <= end_us) AS frames FROM b)
  SELECT *, CASE WHEN frames = burst_messages THEN 'agreed' WHEN frames > burst_messages THEN 'wider' ELSE 'falsified' END AS verdict FROM f""")
def frames_in_windows(spark, sf_dir):
    tape = view(spark, sf_dir, "v_tape")
    return op.frames_in_windows(tape, op.blind_windows(tape, width=2000))


@query("heartbeat_alarms", """WITH b AS (SELECT ticker AS stream, us, seq % 7 AS gaps FROM v_tape), s AS (SELECT *, lead(us) OVER w - us > 43200000000 AS late, gaps - coalesce(lag(gaps) OVER w, 0) > 2 AS many FROM b WINDOW w AS (PARTITION BY stream ORDER BY us, gaps))
  SELECT stream, us, CASE WHEN late AND many THEN 'both' WHEN late THEN 'stale' ELSE 'gaps' END AS alarm FROM s WHERE late OR many""")
def heartbeat_alarms(spark, sf_dir):
    beats = view(spark, sf_dir, "v_tape").select(F.col("ticker").alias("stream"), "us", (F.col("seq") % 7).alias("gaps"))
    return op.heartbeat_alarms(beats, stale_us=43_200_000_000)


_BEATS = """b AS (SELECT ticker AS stream, us, seq % 7 AS gaps FROM v_tape), s AS (SELECT *, lead(us) OVER w - us > 43200000000 AND NOT ((us + 43200000000) % 86400000000 >= 14400000000 AND (us + 43200000000) % 86400000000 < 50400000000) AS late, gaps - coalesce(lag(gaps) OVER w, 0) > 5 AS many FROM b WINDOW w AS (PARTITION BY stream ORDER BY us, gaps)),
  al AS (SELECT us {div} 86400000000 AS day, count(*) AS alarms FROM s WHERE late OR many GROUP BY 1)"""


@query("heartbeat_days", f"WITH {_BEATS} SELECT us {{div}} 86400000000 AS day, count(DISTINCT stream) AS streams, count(*) AS beats, coalesce(any_value(alarms), 0) AS alarms, coalesce(any_value(alarms), 0) = 0 AS all_clear FROM b LEFT JOIN al ON al.day = us {{div}} 86400000000 GROUP BY 1")
def heartbeat_days(spark, sf_dir):
    beats = view(spark, sf_dir, "v_tape").select(F.col("ticker").alias("stream"), "us", (F.col("seq") % 7).alias("gaps"))
    return op.heartbeat_days(beats, op.heartbeat_alarms(beats, 43_200_000_000, 5, (14_400_000_000, 50_400_000_000)))


@query("manifest_totals", "SELECT source AS kind, count(*) AS objects, sum(n_chars)::BIGINT AS bytes, sum(doc_id % 10)::BIGINT AS n_rows, string_agg(DISTINCT lang, ',' ORDER BY lang) AS roots FROM documents GROUP BY source")
def manifest_totals(spark, sf_dir):
    return op.manifest_totals(table(spark, sf_dir, "documents").select(F.col("source").alias("kind"), F.col("n_chars").alias("bytes"), (F.col("doc_id") % 10).alias("n_rows"), F.col("lang").alias("root")))


@query("latency_floor", """WITH g AS (SELECT us, c AS elapsed_us, us {div} 3600000000 % 24 AS hour FROM ev WHERE event_type <> 'error'), h AS (SELECT hour, count(*) AS n FROM g GROUP BY hour), a AS (SELECT count(*) AS hours, max(n) AS most, sum(n)::BIGINT AS n FROM h)
  SELECT n, hours, n >= 200 AND hours = 24 AND most * 24 <= n * 2 AS adequate, (SELECT quantile_disc(elapsed_us, 0.9) FROM g) AS p90_us, greatest((SELECT quantile_disc(elapsed_us, 0.9) FROM g) * 3, 10000000) AS persist_us FROM a""")
def latency_floor(spark, sf_dir):
    return op.latency_floor(view(spark, sf_dir, "ev").select("us", F.col("c").alias("elapsed_us"), (F.col("event_type") != "error").alias("ok")))


@query("last_at_each", "SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY ticker, us ORDER BY id DESC) AS rn FROM v_tape) WHERE rn = 1")
def last_at_each(spark, sf_dir):
    return op.last_at_each(view(spark, sf_dir, "v_tape"))


@query("scale_census", "SELECT length(regexp_extract(price::VARCHAR, '(0*)$', 1)) AS price_zeros, length(regexp_extract(size::VARCHAR, '(0*)$', 1)) AS size_zeros, count(*) AS n_rows, count(*) FILTER (is_snapshot) AS snapshot_rows FROM v_tape GROUP BY 1, 2")
def scale_census(spark, sf_dir):
    return op.scale_census(view(spark, sf_dir, "v_tape"), "price", "size")


@query("latest_upsert_markets", "SELECT ticker, arg_max(price, (us, id)) AS price, arg_max(side, (us, id)) AS side, max(us) AS us FROM v_tape GROUP BY ticker")
def latest_upsert_markets(spark, sf_dir):
    return op.latest_rows(view(spark, sf_dir, "v_tape"), "ticker", ["us", "id"], ["price", "side", "us"])


@query("upsert_dedupe_log", "SELECT ticker, reason, count(*) AS n, min(detected_us) AS first_us, max(detected_us) AS last_us FROM v_gaps GROUP BY ticker, reason")
def upsert_dedupe_log(spark, sf_dir):
    return op.failure_log(view(spark, sf_dir, "v_gaps"), ["ticker", "reason"], "detected_us")
