"""Ingestion: raw shards, payloads and feeds to typed rows, with what can't be read kept apart; sinks that write once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def ingest_markets(shards: DataFrame, ticker: str, prefixes: list[str], cents: list[str]) -> DataFrame:
    """Rows whose ticker has one of the prefixes, with prices in cents as decimal dollars. The prefix test reaches the Parquet scan."""
    test = None
    for p in prefixes:
        test = F.col(ticker).startswith(p) if test is None else test | F.col(ticker).startswith(p)
    return shards.filter(test).withColumns({c: (F.col(c).cast("decimal(18,2)") / 100).cast("decimal(18,6)") for c in cents})


def ingest_ticks(shards: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row for each key, the first in a fixed order, whatever shard it came from."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return shards.withColumn("_n", rank).filter("_n = 1").drop("_n")


SETTLED = "struct<markets:array<struct<ticker:string,close_time:string,floor_strike:string,result:string,last_price_dollars:string>>>"


def ingest_settled_json(payloads: DataFrame, column: str) -> DataFrame:
    """Market records of JSON pages: empty or bad decimals are null, times are UTC, voided is whether there is no result."""
    rows = payloads.select(F.explode(F.from_json(column, SETTLED)["markets"]).alias("m"))
    return rows.select(
        F.col("m.ticker").alias("ticker"), F.unix_micros(F.try_to_timestamp("m.close_time")).alias("close_us"), F.expr("try_cast(nullif(m.floor_strike, '') as decimal(10,2))").alias("floor_strike"),
        F.expr("try_cast(nullif(m.last_price_dollars, '') as decimal(10,4))").alias("last_price"), F.nullif(F.col("m.result"), F.lit("")).alias("result"),
    ).withColumn("voided", F.col("result").isNull())


def ingest_station_csv(lines: DataFrame, column: str) -> DataFrame:
    """Lines "station,time,celsius" as readings in Fahrenheit; missing tokens are null, lines without a time or a station are bad."""
    parts = F.split(column, ",")
    celsius = F.when(~F.lower(F.trim(F.get(parts, F.lit(2)))).isin("", "m", "null", "none"), F.trim(F.get(parts, F.lit(2))))
    rows = lines.select(F.nullif(F.trim(F.get(parts, F.lit(0))), F.lit("")).alias("station"), F.unix_micros(F.try_to_timestamp(F.trim(F.get(parts, F.lit(1))))).alias("valid_us"), celsius.alias("_c"))
    rows = rows.withColumn("_d", F.expr("try_cast(_c as decimal(10,2))"))
    return rows.select("station", "valid_us", (F.col("_d") * 9 / 5 + 32).cast("decimal(10,2)").alias("temp_f"), (F.col("station").isNull() | F.col("valid_us").isNull()).alias("bad"))


def ingest_mos_csv(lines: DataFrame, column: str, keys: list[str], values: list[str]) -> DataFrame:
    """CSV lines (line, and the column) with keys and then values: one row for each key, the first line's; empty values are null."""
    parts = F.split(column, ",")
    named = [F.trim(F.get(parts, F.lit(i))).alias(k) for i, k in enumerate(keys)]
    rows = lines.select("line", *named, *(F.nullif(F.trim(F.get(parts, F.lit(len(keys) + i))), F.lit("")).alias(v) for i, v in enumerate(values)))
    rows = rows.withColumns({v: F.expr(f"try_cast({v} as decimal(10,2))") for v in values})
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("line"))
    return rows.withColumn("_n", rank).filter("_n = 1").select(*keys, *values, "line")


def metar_tenths(raw: Column) -> Column:
    """Temperature in tenths of a degree Celsius from a report's T group; null without one."""
    sign, digits = F.regexp_extract(raw, r"\bT([01])(\d{3})[01]\d{3}\b", 1), F.regexp_extract(raw, r"\bT([01])(\d{3})[01]\d{3}\b", 2)
    return F.when(digits != "", digits.cast("long") * F.when(sign == "1", -1).otherwise(1))


def ingest_metar(reports: DataFrame) -> DataFrame:
    """Reports (id, raw, temp) as tenths of Celsius, from the T group or else from temp, and whether they are special."""
    return reports.select("id", F.coalesce(metar_tenths(F.col("raw")), F.col("temp") * 10).alias("tenths"), F.col("raw").startswith("SPECI").alias("is_special"))


def ingest_hourly_ensemble(payloads: DataFrame, column: str, members: list[str]) -> DataFrame:
    """Arrays of a JSON payload, one a member beside one of times, as rows (time, member, value); unequal lengths give no rows."""
    schema = "struct<time:array<string>," + ",".join(f"{m}:array<double>" for m in members) + ">"
    h = payloads.select("id", F.from_json(column, schema).alias("h"))
    sound = None
    for m in members:
        test = F.size(f"h.{m}") == F.size("h.time")
        sound = test if sound is None else sound & test

    def of(m: str) -> Column:
        pairs = F.arrays_zip(F.col("h.time").alias("t"), F.col(f"h.{m}").alias("v"))
        return F.transform(pairs, lambda x: F.struct(x["t"].alias("time"), F.lit(m).alias("member"), x["v"].alias("value")))

    long = F.flatten(F.array(*map(of, members)))
    return h.filter(sound).select("id", F.explode(long).alias("x")).select("id", "x.*").filter("value is not null")


FRAME = "struct<type:string,msg:struct<ticker:string,seq:bigint,side:string,price:bigint,delta:bigint,yes:array<array<bigint>>,no:array<array<bigint>>,taker_outcome_side:string,taker_side:string,count:bigint>>"


def decode_frames(frames: DataFrame) -> DataFrame:
    """Raw JSON frames (id, raw) as tape rows: a row a level of a snapshot, a row a delta, a row a trade; levels explode in order."""
    f = frames.select("id", F.from_json("raw", FRAME).alias("f")).select("id", "f.type", "f.msg.*")
    none = F.array().cast("array<array<bigint>>")

    def of(side: str) -> Column:
        return F.transform(F.coalesce(side, none), lambda x: F.struct(F.lit(side).alias("side"), x[0].alias("price"), x[1].alias("size")))

    levels = F.concat(of("yes"), of("no"))
    snapshots = f.filter("type = 'snapshot'").select("id", "ticker", "seq", F.explode(levels).alias("x")).select("id", F.lit("snapshot").alias("kind"), "ticker", "seq", "x.side", "x.price", "x.size")
    deltas = f.filter("type = 'delta'").select("id", F.lit("delta").alias("kind"), "ticker", "seq", "side", "price", F.col("delta").alias("size"))
    taker = F.coalesce(F.nullif("taker_outcome_side", F.lit("")), F.nullif("taker_side", F.lit("")), F.lit(""))
    trades = f.filter("type = 'trade'").select("id", F.lit("trade").alias("kind"), "ticker", F.lit(None).cast("long").alias("seq"), taker.alias("side"), "price", F.col("count").alias("size"))
    return snapshots.unionByName(deltas).unionByName(trades)


def clear_frames(frames: DataFrame) -> DataFrame:
    """Snapshot frames without any level: the book was cleared."""
    f = frames.filter(F.contains("raw", F.lit("snapshot"))).select("id", F.from_json("raw", FRAME).alias("f")).select("id", "f.type", "f.msg.*")
    return f.filter("type = 'snapshot'").filter((F.coalesce(F.size("yes"), F.lit(0)) <= 0) & (F.coalesce(F.size("no"), F.lit(0)) <= 0)).select("id", "ticker", "seq")


def decode_tally(frames: DataFrame, keys: list[str]) -> DataFrame:
    """How often each of some keys of the message is present, empty or absent, by kind of frame."""
    state = lambda k: F.when(F.get_json_object("raw", f"$.msg.{k}").isNull(), "absent").when(F.get_json_object("raw", f"$.msg.{k}") == "", "empty").otherwise("present")
    each = F.array(*(F.struct(F.lit(k).alias("key"), state(k).alias("state")) for k in keys))
    return frames.select(F.get_json_object("raw", "$.type").alias("type"), F.explode(each).alias("x")).groupBy("type", "x.key", "x.state").agg(F.count("*").alias("n"))


def market_dimension(tickers: DataFrame) -> DataFrame:
    """Parts of a ticker like KXHIGHS7-24JAN05-T93 or -B93.5; rejected where it can't be read.

    Of an event's markets of kind above, the one with the lowest strike is the tail below, if there are two or more.
    """
    part = lambda i: F.regexp_extract("ticker", r"^([A-Z0-9]+)-(\d{2}[A-Z]{3}\d{2})-([BT])(\d+(?:\.\d+)?)$", i)
    rows = tickers.select("ticker", part(1).alias("series"), F.try_to_date(F.initcap(part(2)), "yyMMMdd").alias("event_date"), part(3).alias("letter"), F.expr("try_cast(nullif(regexp_extract(ticker, '-[BT]([0-9.]+)$', 1), '') as decimal(10,1))").alias("strike"))
    rows = rows.withColumn("rejected", (F.col("series") == "") | F.col("event_date").isNull())
    above = (F.col("letter") == "T") & ~F.col("rejected")
    own = Window.partitionBy("series", "event_date")
    lowest, n = F.min(F.when(above, F.col("strike"))).over(own), F.count_if(above).over(own)
    kind = F.when(F.col("rejected"), None).when(F.col("letter") == "B", "bracket").when((n >= 2) & (F.col("strike") == lowest), "below").otherwise("above")
    return rows.withColumn("kind", kind).drop("letter")


def issue_time_guard(forecasts: DataFrame) -> DataFrame:
    """Forecasts (issued_us, as_of) as usable, or refused where they were issued after the decision."""
    return forecasts.withColumn("status", F.when(F.col("issued_us") > F.col("as_of"), "refused").otherwise("usable"))


def digest(df: DataFrame) -> DataFrame:
    """Rows and an order-insensitive digest of a table: the sum and the XOR of 60-bit hashes of its rows."""
    text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in sorted(df.columns)))
    h = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
    return df.select(h.alias("h")).agg(F.count("*").alias("n_rows"), F.bit_xor("h").alias("digest"))


def freeze(df: DataFrame, path: str) -> DataFrame:
    """Writes a table once, refuses to overwrite it, and returns its row count and digest, kept beside it."""
    df.write.mode("errorifexists").parquet(path)
    digest(df.sparkSession.read.parquet(path)).write.mode("errorifexists").json(f"{path}.digest")
    return df.sparkSession.read.json(f"{path}.digest")


def freeze_json(df: DataFrame, path: str) -> DataFrame:
    """Writes a table once as JSON lines, refuses to overwrite it, and returns its row count and digest, kept beside it.

    The digest is that of the rows as they are read again with df's schema; nulls are left out of the lines.
    """
    df.write.mode("errorifexists").json(path)
    digest(df.sparkSession.read.schema(df.schema).json(path)).write.mode("errorifexists").json(f"{path}.digest")
    return df.sparkSession.read.json(f"{path}.digest")


def partitioned_sink(df: DataFrame, path: str, by: list[str], order: str) -> None:
    """Writes by partition columns with rows in order within files; rows of a partition meet in one task first."""
    df.repartition(*by).sortWithinPartitions(*by, order).write.partitionBy(*by).mode("errorifexists").parquet(path)


def enforce_schema(df: DataFrame, schema: StructType) -> DataFrame:
    """df, if it has the columns of schema with their types and no others, in any order; else an error that says what differs."""
    want, have = ({f.name: f.dataType.simpleString() for f in s} for s in (schema, df.schema))
    wrong = [f"{c}: {have.get(c, 'missing')} instead of {want.get(c, 'nothing')}" for c in sorted({*want, *have}) if want.get(c) != have.get(c)]
    if wrong:
        raise ValueError("schema differs in " + "; ".join(wrong))
    return df.select(*(f.name for f in schema))


def arrival_date(us: str) -> Column:
    """The UTC day of a time, as the text that partitions are named by."""
    return F.date_format(F.timestamp_micros(us), "yyyy-MM-dd")


def write_tape(df: DataFrame, path: str, us: str, order: str) -> None:
    """df (with a root) by root and arrival_date, the day of its time, rows in order within files; refuses to overwrite."""
    partitioned_sink(df.withColumn("arrival_date", arrival_date(us)), path, ["root", "arrival_date"], order)


def read_window(spark: SparkSession, path: str, schema: StructType, us: str, start: int, end: int, roots: list[str] | None = None, half_open: bool = False, era_start: int | None = None) -> DataFrame:
    """Rows of [start, end] of a table of write_tape, of half_open [start, end), of some roots or of all; from era_start on, if given.

    schema is what the table is to have, its root among it; another one raises. Filters on the partition columns come
    first, so that only files of these roots and days are listed and read; then the exact time. An end before the start
    gives no rows, and rows without a time are in no window.
    """
    kinds = StructType([*schema.fields, StructField("arrival_date", StringType())])
    # partition values are read as text: a root like 007 stays one
    rows = enforce_schema(spark.read.option("basePath", path).schema(kinds).parquet(path), kinds)
    written = spark.read.parquet(path).schema
    inner = {f.name: f.dataType for f in written if f.name not in ("root", "arrival_date")}
    enforce_schema(spark.createDataFrame([], StructType([StructField(n, t) for n, t in inner.items()])), StructType([f for f in schema if f.name != "root"]))
    start = start if era_start is None else max(start, era_start)
    first, last = (F.date_format(F.timestamp_micros(F.lit(t)), "yyyy-MM-dd") for t in (start, end))
    rows = rows.filter(F.col("arrival_date").between(first, last))
    if roots is not None:
        rows = rows.filter(F.col("root").isin(*roots))
    return rows.filter((F.col(us) >= start) & (F.col(us) < end if half_open else F.col(us) <= end)).drop("arrival_date")
