from pyspark.sql import functions as F

from tidemark.operators import ingest as op
from tidemark.queries import query
from tidemark.sources.adapters import table, view
from tidemark.streaming import shared_folder


@query("ingest_markets", "SELECT p_partkey, p_name, CAST(p_size AS DECIMAL(18,2)) / 100 AS p_size FROM part WHERE p_brand LIKE 'Brand#1%' OR p_brand LIKE 'Brand#3%'")
def ingest_markets(spark, sf_dir):
    return op.ingest_markets(table(spark, sf_dir, "part"), "p_brand", ["Brand#1", "Brand#3"], ["p_size"]).select("p_partkey", "p_name", F.col("p_size").cast("double"))


@query("ingest_ticks", "SELECT id, ticker, us, trade_id, taker_side, units, yes_price FROM (SELECT *, row_number() OVER (PARTITION BY trade_id ORDER BY us, id) AS rn FROM v_prints) WHERE rn = 1")
def ingest_ticks(spark, sf_dir):
    return op.ingest_ticks(view(spark, sf_dir, "v_prints"), "trade_id", ["us", "id"])


@query("ingest_settled_json", """SELECT concat('M', event_id) AS ticker, us {div} 1000000 * 1000000 AS close_us, CASE WHEN k % 5 = 0 THEN NULL ELSE k::DOUBLE END AS floor_strike, CASE WHEN k % 7 = 0 THEN NULL ELSE c / 100.0 END AS last_price,
  CASE WHEN k % 3 = 0 THEN NULL ELSE 'yes' END AS result, k % 3 = 0 AS voided FROM ev""")
def ingest_settled_json(spark, sf_dir):
    ev = view(spark, sf_dir, "ev")
    one = F.struct(
        F.concat(F.lit("M"), "event_id").alias("ticker"), F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("close_time"), F.when(F.col("k") % 5 == 0, "").otherwise(F.col("k").cast("string")).alias("floor_strike"),
        F.when(F.col("k") % 3 == 0, "").otherwise("yes").alias("result"), F.when(F.col("k") % 7 == 0, "n/a").otherwise((F.col("c") / 100).cast("string")).alias("last_price_dollars"),
    )
    page = F.expr("event_id div 1000")  # a page holds at most 1,000 markets, as ids don't repeat
    pages = ev.groupBy("user_id", page.alias("n")).agg(F.to_json(F.struct(F.collect_list(one).alias("markets"))).alias("page"))
    rows = op.ingest_settled_json(pages, "page")
    return rows.withColumns({c: F.col(c).cast("double") for c in ("floor_strike", "last_price")})


@query("ingest_station_csv", """SELECT CASE WHEN k % 11 = 0 THEN NULL ELSE concat('S', user_id % 20) END AS station, us {div} 1000000 * 1000000 AS valid_us, CASE WHEN k % 4 = 0 THEN NULL ELSE round((c % 400) / 10.0 * 9 / 5 + 32, 2)::DOUBLE END AS temp_f, k % 11 = 0 AS bad FROM ev""")
def ingest_station_csv(spark, sf_dir):
    station = F.when(F.col("k") % 11 == 0, "").otherwise(F.concat(F.lit("S"), F.col("user_id") % 20))
    value = F.when(F.col("k") % 8 == 0, "M").when(F.col("k") % 4 == 0, " null").otherwise(((F.col("c") % 400) / 10).cast("string"))
    lines = view(spark, sf_dir, "ev").select(F.concat_ws(",", station, F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd HH:mm:ss"), value).alias("line"))
    return op.ingest_station_csv(lines, "line").withColumn("temp_f", F.col("temp_f").cast("double"))


@query("ingest_metar_json", "SELECT event_id AS id, CASE WHEN k % 5 = 0 THEN (k % 40) * 10 ELSE (c % 400) * CASE WHEN k % 2 = 1 THEN -1 ELSE 1 END END AS tenths, k % 9 = 0 AS is_special FROM ev")
def ingest_metar(spark, sf_dir):
    group = F.when(F.col("k") % 5 == 0, "").otherwise(F.concat(F.lit(" T"), (F.col("k") % 2).cast("string"), F.lpad((F.col("c") % 400).cast("string"), 3, "0"), F.lit("0123")))
    raw = F.concat(F.when(F.col("k") % 9 == 0, "SPECI KNYC").otherwise("METAR KNYC"), group, F.lit(" A3001"))
    return op.ingest_metar(view(spark, sf_dir, "ev").select(F.col("event_id").alias("id"), raw.alias("raw"), (F.col("k") % 40).alias("temp")))


@query("ingest_hourly_ensemble", "SELECT vec_id AS id, concat('t', i) AS time, concat('m', j) AS member, round(embedding[4 * j + i + 1]::DOUBLE, 6) AS value FROM embeddings, (SELECT unnest(range(0, 4)) AS i) a, (SELECT unnest(range(0, 3)) AS j) b")
def ingest_hourly_ensemble(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.to_json(F.struct(F.array(*(F.lit(f"t{i}") for i in range(4))).alias("time"), *(F.slice(F.col("embedding").cast("array<double>"), 4 * j + 1, 4).alias(f"m{j}") for j in range(3)))).alias("page"))
    return op.ingest_hourly_ensemble(rows, "page", ["m0", "m1", "m2"]).withColumn("value", F.round("value", 6))


def _frames(spark, sf_dir):
    ev = view(spark, sf_dir, "ev")
    level = F.when(F.col("k") % 3 == 0, F.array().cast("array<array<bigint>>")).otherwise(F.array(F.array(F.col("k"), F.col("c")), F.array(F.col("k") + 1, F.col("c") + 1)))
    kind = F.when(F.col("event_type") == "signup", "snapshot").when(F.col("event_type") == "click", "trade").otherwise("delta")
    msg = F.struct(
        F.concat(F.lit("M"), "user_id").alias("ticker"), F.col("event_id").alias("seq"), F.when(kind == "delta", "yes").alias("side"), F.col("k").alias("price"), F.col("c").alias("delta"), F.when(kind == "snapshot", level).alias("yes"),
        F.when(kind == "trade", F.when(F.col("k") % 2 == 0, "").otherwise("no")).alias("taker_outcome_side"), F.when(kind == "trade", F.when(F.col("k") % 4 == 0, "").otherwise("yes")).alias("taker_side"), F.col("c").alias("count"),
    )
    return ev.select(F.col("event_id").alias("id"), F.to_json(F.struct(kind.alias("type"), msg.alias("msg"))).alias("raw"))


@query("decode_frames", """SELECT event_id AS id, 'snapshot' AS kind, concat('M', user_id) AS ticker, event_id AS seq, 'yes' AS side, k + i AS price, c + i AS size FROM ev, (SELECT unnest([0, 1]) AS i) x WHERE event_type = 'signup' AND k % 3 <> 0
  UNION ALL SELECT event_id, 'delta', concat('M', user_id), event_id, 'yes', k, c FROM ev WHERE event_type NOT IN ('signup', 'click')
  UNION ALL SELECT event_id, 'trade', concat('M', user_id), NULL, CASE WHEN k % 2 = 1 THEN 'no' WHEN k % 4 <> 0 THEN 'yes' ELSE '' END, k, c FROM ev WHERE event_type = 'click'""")
def decode_frames(spark, sf_dir):
    return op.decode_frames(_frames(spark, sf_dir))


@query("clear_frames", "SELECT event_id AS id, concat('M', user_id) AS ticker, event_id AS seq FROM ev WHERE event_type = 'signup' AND k % 3 = 0")
def clear_frames(spark, sf_dir):
    return op.clear_frames(_frames(spark, sf_dir))


@query("decode_tally", """WITH f AS (SELECT CASE event_type WHEN 'signup' THEN 'snapshot' WHEN 'click' THEN 'trade' ELSE 'delta' END AS type, event_type = 'click' AS t, k FROM ev),
  u AS (SELECT type, 'taker_outcome_side' AS key, CASE WHEN NOT t THEN 'absent' WHEN k % 2 = 0 THEN 'empty' ELSE 'present' END AS state FROM f UNION ALL SELECT type, 'taker_side', CASE WHEN NOT t THEN 'absent' WHEN k % 4 = 0 THEN 'empty' ELSE 'present' END FROM f)
  SELECT type, key, state, count(*) AS n FROM u GROUP BY ALL""")
def decode_tally(spark, sf_dir):
    return op.decode_tally(_frames(spark, sf_dir), ["taker_outcome_side", "taker_side"])


_TICKERS = "tk AS (SELECT DISTINCT CASE WHEN k = 7 THEN concat('BAD', user_id % 20) ELSE concat('KXHIGHS', user_id % 20, '-24JAN', CASE WHEN us {div} 86400000000 % 28 < 9 THEN '0' ELSE '' END, us {div} 86400000000 % 28 + 1, CASE WHEN k % 2 = 0 THEN '-T' ELSE '-B' END, 60 + k % 10, CASE WHEN k % 2 = 0 THEN '' ELSE '.5' END) END AS ticker, CASE WHEN k = 7 THEN NULL ELSE us {div} 86400000000 % 28 + 1 END AS d, user_id % 20 AS s, k % 2 = 0 AS t, 60 + k % 10 AS n FROM ev)"


@query("market_dimension", f"""WITH {_TICKERS}, a AS (SELECT *, min(CASE WHEN t AND d IS NOT NULL THEN n END) OVER (PARTITION BY s, d) AS low, count(*) FILTER (t AND d IS NOT NULL) OVER (PARTITION BY s, d) AS m FROM tk)
  SELECT DISTINCT ticker, CASE WHEN d IS NULL THEN '' ELSE concat('KXHIGHS', s) END AS series, CASE WHEN d IS NOT NULL THEN make_date(2024, 1, d) END AS event_date, CASE WHEN d IS NULL THEN NULL WHEN t THEN n::DOUBLE ELSE n + 0.5::DOUBLE END AS strike, d IS NULL AS rejected,
    CASE WHEN d IS NULL THEN NULL WHEN NOT t THEN 'bracket' WHEN m >= 2 AND n = low THEN 'below' ELSE 'above' END AS kind FROM a""")
def market_dimension(spark, sf_dir):
    ev = view(spark, sf_dir, "ev").withColumn("d", F.expr("us div 86400000000 % 28 + 1"))
    name = F.concat(F.lit("KXHIGHS"), F.col("user_id") % 20, F.lit("-24JAN"), F.lpad(F.col("d").cast("string"), 2, "0"), F.when(F.col("k") % 2 == 0, "-T").otherwise("-B"), 60 + F.col("k") % 10, F.when(F.col("k") % 2 == 0, "").otherwise(".5"))
    tickers = ev.select(F.when(F.col("k") == 7, F.concat(F.lit("BAD"), F.col("user_id") % 20)).otherwise(name).alias("ticker")).distinct()
    return op.market_dimension(tickers).withColumn("strike", F.col("strike").cast("double"))


@query("issue_time_guard", "SELECT id, seen_us AS issued_us, valid_us + 120000000 AS as_of, CASE WHEN seen_us > valid_us + 120000000 THEN 'refused' ELSE 'usable' END AS status FROM v_obs")
def issue_time_guard(spark, sf_dir):
    return op.issue_time_guard(view(spark, sf_dir, "v_obs").select("id", F.col("seen_us").alias("issued_us"), (F.col("valid_us") + 120_000_000).alias("as_of")))


@query("freeze_digest", "SELECT count(*) AS n_rows, bit_xor(('0x' || substr(md5(concat_ws('|', id, station, tenths, valid_us)), 1, 15))::BIGINT) AS digest FROM v_obs")
def freeze_digest(spark, sf_dir):
    return op.digest(view(spark, sf_dir, "v_obs").select("id", "station", "valid_us", "tenths"))


def _stored(spark, sf_dir):
    """The tape by root and day of arrival, and its schema."""
    rows, path = view(spark, sf_dir, "v_tape").withColumn("root", F.substring("ticker", 1, 2)), f"{shared_folder(spark)}/tape"
    op.write_tape(rows, path, "us", "id")
    return path, rows.schema


@query("read_window", "SELECT *, substr(ticker, 1, 2) AS root FROM v_tape WHERE us BETWEEN 1705000000000000 AND 1705600000000000 AND substr(ticker, 1, 2) IN ('M1', 'M2', 'M4')")
def read_window(spark, sf_dir):
    path, schema = _stored(spark, sf_dir)
    return op.read_window(spark, path, schema, "us", 1_705_000_000_000_000, 1_705_600_000_000_000, ["M1", "M2", "M4"])


@query("read_window_half_open", "SELECT *, substr(ticker, 1, 2) AS root FROM v_tape WHERE us >= 1705100000000000 AND us < (SELECT max(us) FROM v_tape)")
def read_window_half_open(spark, sf_dir):
    path, schema = _stored(spark, sf_dir)
    end = view(spark, sf_dir, "v_tape").agg(F.max("us")).first()[0]
    return op.read_window(spark, path, schema, "us", 1_700_000_000_000_000, end, half_open=True, era_start=1_705_100_000_000_000)


@query("ingest_mos_csv", """WITH r AS (SELECT concat('R', us {div} 86400000000) AS runtime, concat('F', k % 24) AS ftime, CASE WHEN c % 4 = 0 THEN NULL ELSE (c % 100)::DOUBLE END AS tmp, event_id AS line FROM ev)
  SELECT runtime, ftime, tmp, line FROM (SELECT *, row_number() OVER (PARTITION BY runtime, ftime ORDER BY line) AS rn FROM r) WHERE rn = 1""")
def ingest_mos_csv(spark, sf_dir):
    value = F.when(F.col("c") % 4 == 0, "").otherwise((F.col("c") % 100).cast("string"))
    lines = view(spark, sf_dir, "ev").select(F.col("event_id").alias("line"), F.concat_ws(",", F.concat(F.lit("R"), F.expr("us div 86400000000")), F.concat(F.lit("F"), F.col("k") % 24), value).alias("csv"))
    return op.ingest_mos_csv(lines, "csv", ["runtime", "ftime"], ["tmp"]).withColumn("tmp", F.col("tmp").cast("double"))


@query("partitioned_sink", "SELECT side, count(*) AS n_rows, min(id) AS first_id, sum(size)::BIGINT AS size FROM v_tape GROUP BY side")
def partitioned_sink(spark, sf_dir):
    path = f"{shared_folder(spark)}/tape"
    op.partitioned_sink(view(spark, sf_dir, "v_tape"), path, ["side"], "id")
    return spark.read.parquet(path).groupBy("side").agg(F.count("*").alias("n_rows"), F.min("id").alias("first_id"), F.sum("size").alias("size"))


@query("freeze_parquet", "SELECT count(*) AS n_rows, bit_xor(('0x' || substr(md5(concat_ws('|', id, station, tenths, valid_us)), 1, 15))::BIGINT) AS digest FROM v_obs")
def freeze_parquet(spark, sf_dir):
    rows = view(spark, sf_dir, "v_obs").select("id", "station", "valid_us", "tenths")
    return op.freeze(rows, f"{shared_folder(spark)}/frozen").select("n_rows", "digest")


@query("freeze_jsonl", "SELECT count(*) AS n_rows, bit_xor(('0x' || substr(md5(concat_ws('|', id, station, tenths, valid_us)), 1, 15))::BIGINT) AS digest FROM v_obs")
def freeze_jsonl(spark, sf_dir):
    rows = view(spark, sf_dir, "v_obs").select("id", "station", "valid_us", "tenths")
    return op.freeze_json(rows, f"{shared_folder(spark)}/frozen_lines").select("n_rows", "digest")
