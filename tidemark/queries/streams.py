from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import streaming as op
from tidemark.queries import query
from tidemark.queries.book import _MET
from tidemark.sources.adapters import stream_view, view


@query("stream_book", f"WITH {_MET} SELECT * FROM touch")
def stream_book(spark, sf_dir) -> DataFrame:
    return op.stream_book(stream_view(spark, sf_dir, "v_tape"))


@query("stream_gaps", """WITH s AS (SELECT id, ticker AS stream, lag(seq) OVER (PARTITION BY ticker ORDER BY id) AS prev_seq, seq FROM v_tape) SELECT *, CASE WHEN seq > prev_seq THEN 'skip' ELSE 'resubscribe' END AS kind FROM s WHERE seq <> prev_seq + 1""")
def stream_gaps(spark, sf_dir) -> DataFrame:
    return op.stream_gaps(stream_view(spark, sf_dir, "v_tape").select(F.col("ticker").alias("stream"), "id", "seq"))


@query("stream_dedupe_obs", "SELECT DISTINCT station, valid_us {div} 3600000000 AS hour FROM v_obs")
def stream_dedupe_obs(spark, sf_dir) -> DataFrame:
    rows = stream_view(spark, sf_dir, "v_obs").select("station", F.expr("valid_us div 3600000000").alias("hour"), F.timestamp_micros("valid_us").alias("at"))
    return op.run_append(op.stream_dedupe_obs(rows, ["station", "hour"], "at", "60 days")).select("station", "hour")


@query("stream_counts", "SELECT us {div} 3600000000 * 3600000000 AS start_us, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'error') AS error FROM ev GROUP BY 1")
def stream_counts(spark, sf_dir) -> DataFrame:
    rows = stream_view(spark, sf_dir, "ev").select("event_type", F.timestamp_micros("us").alias("at"))
    return op.run_complete(op.stream_counts(rows, "at", "1 hour", "event_type", ["click", "purchase", "error"]))


@query("stream_gate_log", "SELECT ticker, reason, count(*) AS n, max(detected_us) AS last_us FROM v_gaps GROUP BY ticker, reason")
def stream_gate_log(spark, sf_dir) -> DataFrame:
    return op.run_complete(op.stream_gate_log(stream_view(spark, sf_dir, "v_gaps").withColumnRenamed("detected_us", "us"), ["ticker", "reason"]))


@query("late_rows", "WITH d AS (SELECT ticker, ts_ms < max(ts_ms) OVER (PARTITION BY ticker ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS late FROM v_tape WHERE ts_ms IS NOT NULL) SELECT ticker, count(*) AS n_rows, count(*) FILTER (late) AS late FROM d GROUP BY ticker")
def late_rows(spark, sf_dir) -> DataFrame:
    return op.late_rows(stream_view(spark, sf_dir, "v_tape").filter("ts_ms is not null").select("ticker", "id", "ts_ms"))


@query("stream_stale_alarm", """WITH b AS (SELECT ticker AS stream, us, seq % 7 AS gaps FROM v_tape), s AS (SELECT *, us - lag(us) OVER w > 43200000000 AS late, gaps - coalesce(lag(gaps) OVER w, 0) > 2 AS many FROM b WINDOW w AS (PARTITION BY stream ORDER BY us, gaps))
  SELECT stream, us, CASE WHEN late AND many THEN 'both' WHEN late THEN 'stale' ELSE 'gaps' END AS alarm FROM s WHERE late OR many""")
def stream_stale_alarm(spark, sf_dir) -> DataFrame:
    beats = stream_view(spark, sf_dir, "v_tape").select(F.col("ticker").alias("stream"), "us", (F.col("seq") % 7).alias("gaps"))
    return op.stream_stale_alarm(beats, 43_200_000_000, 2)


_STALE = """it AS (SELECT concat('G', user_id % 5) AS series, k % 50 = 0 OR (k % 10) * 60000000 > 240000000 AS stale FROM ev WHERE event_type = 'view'),
  ct AS (SELECT series, false AS pooled, count(*) AS seen, count(*) FILTER (stale) AS rejected FROM it GROUP BY series UNION ALL SELECT NULL, true, count(*), count(*) FILTER (stale) FROM it HAVING count(*) > 0)"""
_RATIOS = f"WITH {_STALE} SELECT series, pooled, seen, rejected, round(rejected / seen, 9) AS ratio, rejected / seen > 0.51 AND (pooled OR seen >= 10) AS warns FROM ct"


def _intents(events):
    book = F.when(F.col("k") % 50 != 0, F.col("us") - F.col("k") % 10 * 60_000_000)
    return events.filter("event_type = 'view'").select(F.concat(F.lit("G"), (F.col("user_id") % 5).cast("string")).alias("series"), F.col("us").alias("as_of"), book.alias("book_us"))


@query("stale_ratios", _RATIOS)
def stale_ratios(spark, sf_dir) -> DataFrame:
    return op.stale_ratios(op.stale_intents(_intents(view(spark, sf_dir, "ev"))), 0.51)


@query("stream_stale_books", _RATIOS)
def stream_stale_books(spark, sf_dir) -> DataFrame:
    return op.stream_stale_books(_intents(stream_view(spark, sf_dir, "ev")), warn=0.51)
