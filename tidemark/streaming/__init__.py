"""Structured Streaming twins of the batch operators: the same rows whether a tape is read at once or as it grows.

Twins that need the rows of a key in order run batch by batch: what a key carries from one batch to the next is a
table, put before the batch's rows in windows that sort with spill. So a batch may hold any number of rows of one key,
and nothing of it is gathered in memory.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.book import book_levels, touch_series

#: What is carried for each key: (rows of a batch, carried table) to (rows found, carried table after it).
Step = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share.

    Where none is set, a local session gets a temporary one, and a cluster's raises, as its machines share no such folder.
    """
    context = spark.sparkContext
    base = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base}/stream-{uuid.uuid4().hex}"


def run_append(stream: DataFrame) -> DataFrame:
    """Runs an append stream over what is there now, into a table in the shared folder."""
    spark, path = stream.sparkSession, shared_folder(stream.sparkSession)
    stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def run_complete(stream: DataFrame) -> DataFrame:
    """Runs an aggregate in complete mode over what is there now; each batch replaces the table of the one before."""
    spark, path = stream.sparkSession, shared_folder(stream.sparkSession)
    write = lambda batch, _: batch.write.mode("overwrite").parquet(f"{path}/out")
    stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def carry(stream: DataFrame, step: Step, carried: str, path: str) -> tuple[DataStreamWriter, Callable[[], DataFrame]]:
    """A writer that takes step batch by batch, to be given a trigger and started, and a reader of what it found so far.

    carried is the schema of the carried table. Batch n writes its rows under its own number and its carried table
    beside that of batch n - 1, which it reads; so a batch that is taken again replaces what it wrote.
    """
    spark = stream.sparkSession

    def take(batch: DataFrame, number: int, before: DataFrame | None = None) -> None:
        held = spark.read.schema(carried).parquet(f"{path}/carried-{(number - 1) % 2}") if before is None else before
        found, after = step(batch, held)
        found.write.mode("overwrite").parquet(f"{path}/out/batch={number}")
        after.write.mode("overwrite").parquet(f"{path}/carried-{number % 2}")

    none = spark.createDataFrame([], stream.schema), spark.createDataFrame([], carried)
    shape = step(*none)[0].schema

    def start(batch: DataFrame, number: int) -> None:
        take(batch, number, none[1] if number == 0 else None)

    def read() -> DataFrame:
        spark.createDataFrame([], shape).write.mode("overwrite").parquet(f"{path}/out/batch=-1")  # a table even before the first batch
        return spark.read.schema(shape).parquet(f"{path}/out").drop("batch")

    return stream.writeStream.foreachBatch(start).option("checkpointLocation", f"{path}/offsets"), read


def run_carried(stream: DataFrame, step: Step, carried: str) -> DataFrame:
    """Takes step over what is there now: all rows found, of every batch."""
    writer, read = carry(stream, step, carried, shared_folder(stream.sparkSession))
    writer.trigger(availableNow=True).start().awaitTermination()
    return read()


#: The id of carried levels: before that of every row.
_CARRIED = -(2**62)


def _book(batch: DataFrame, carried: DataFrame) -> tuple[DataFrame, DataFrame]:
    tape = ["id", "ticker", "us", "seq", "side", "price", "size", "is_snapshot"]
    held = carried.withColumn("id", F.lit(_CARRIED)).withColumn("is_snapshot", F.col("us").isNotNull())
    rows = held.select(*tape).unionByName(batch.select(*tape))
    found = touch_series(rows).filter(F.col("id") > _CARRIED)
    newest = Window.partitionBy("ticker")
    levels = book_levels(rows).withColumn("_epoch", F.max("epoch").over(newest)).filter("epoch = _epoch")
    levels = levels.groupBy("ticker", "side", "price").agg(F.max_by("level_size", "id").alias("size"), F.max("id").alias("_id"))
    # an empty level is forgotten, but the last touched one of a ticker stays, with the snapshot that its book began with
    levels = levels.withColumn("_last", F.max("_id").over(newest)).filter("size <> 0 or _id = _last")
    batches = rows.filter("is_snapshot").groupBy("ticker").agg(F.max_by(F.struct("us", "seq"), "id").alias("b"))
    return found, levels.join(batches, "ticker", "left").select("ticker", F.col("b.us").alias("us"), F.col("b.seq").alias("seq"), "side", "price", "size")


def stream_book(tape: DataFrame) -> DataFrame:
    """Best prices and sizes after every row of a live tape, as of touch_series, over what is there now.

    Carried are the levels of each ticker and the snapshot that they began with; the rows of a batch follow those of
    the batches before, whatever their ids.
    """
    return run_carried(tape, _book, "ticker string, us long, seq long, side string, price long, size long")


def _skips(batch: DataFrame, carried: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = carried.withColumn("_new", F.lit(False)).unionByName(batch.select("stream", "id", "seq", F.lit(True).alias("_new")))
    seen = rows.withColumn("prev_seq", F.lag("seq").over(Window.partitionBy("stream").orderBy("_new", "id"))).filter("_new and seq <> prev_seq + 1")
    kind = F.when(F.col("seq") > F.col("prev_seq"), "skip").otherwise("resubscribe")
    last = rows.groupBy("stream").agg(F.max_by(F.struct("id", "seq"), F.struct("_new", "id")).alias("r")).select("stream", "r.*")
    return seen.select("id", "stream", "prev_seq", "seq", kind.alias("kind")), last


def stream_gaps(messages: DataFrame) -> DataFrame:
    """Sequence breaks of every stream (stream, id, seq), over what is there now; the last number seen is carried."""
    return run_carried(messages, _skips, "stream string, id long, seq long")


def stream_dedupe_obs(readings: DataFrame, keys: list[str], clock: str, delay: str) -> DataFrame:
    """First sighting of each key; keys are forgotten once the watermark has passed them by delay."""
    return readings.withWatermark(clock, delay).dropDuplicatesWithinWatermark(keys)


def stream_counts(events: DataFrame, clock: str, width: str, kind: str, kinds: list[str]) -> DataFrame:
    """Events of each kind in tumbling windows, as a heartbeat."""
    return events.groupBy(F.window(clock, width).alias("w")).agg(*(F.count_if(F.col(kind) == k).alias(k) for k in kinds)).select(F.unix_micros("w.start").alias("start_us"), *kinds)


def stream_gate_log(failures: DataFrame, keys: list[str]) -> DataFrame:
    """Failures by key: how often, and when last."""
    return failures.groupBy(*keys).agg(F.count("*").alias("n"), F.max("us").alias("last_us"))


def _late(batch: DataFrame, carried: DataFrame) -> tuple[DataFrame, DataFrame]:
    held = carried.select("ticker", F.lit(None).cast("long").alias("id"), F.col("most").alias("ts_ms"), "n_rows", "late")
    none = F.lit(0).cast("long")
    rows = held.unionByName(batch.select("ticker", "id", "ts_ms", none.alias("n_rows"), none.alias("late"))).withColumn("_new", F.col("id").isNotNull())
    before = Window.partitionBy("ticker").orderBy("_new", "id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_behind", F.col("_new") & F.coalesce(F.col("ts_ms") < F.max("ts_ms").over(before), F.lit(False)))
    after = rows.groupBy("ticker").agg(
        F.max("ts_ms").alias("most"), (F.sum("n_rows") + F.count_if("_new")).alias("n_rows"), (F.sum("late") + F.count_if("_behind")).alias("late"), F.bool_or("_new").alias("_met")
    )
    return after.filter("_met").select("ticker", "n_rows", "late"), after.drop("_met")


def late_rows(deltas: DataFrame) -> DataFrame:
    """Per ticker, rows (ticker, id, ts_ms) so far and those stamped before one that had come already, over what is there now."""
    found = run_carried(deltas, _late, "ticker string, most long, n_rows long, late long")
    return found.groupBy("ticker").agg(F.max("n_rows").alias("n_rows"), F.max("late").alias("late"))  # both only grow


def stream_stale_alarm(beats: DataFrame, stale_us: int, most_gaps: int) -> DataFrame:
    """Beats (stream, us, gaps) that come late after the one before, or with too many new gaps, over what is there now."""

    def step(batch: DataFrame, carried: DataFrame) -> tuple[DataFrame, DataFrame]:
        rows = carried.withColumn("_new", F.lit(False)).unionByName(batch.select("stream", "us", "gaps", F.lit(True).alias("_new")))
        own = Window.partitionBy("stream").orderBy("_new", "us", "gaps")
        late = F.coalesce(F.col("us") - F.lag("us").over(own) > stale_us, F.lit(False))
        many = F.col("gaps") - F.coalesce(F.lag("gaps").over(own), F.lit(0)) > most_gaps
        seen = rows.withColumns({"_late": late, "_many": many}).filter("_new and (_late or _many)")
        alarm = F.when(F.col("_late") & F.col("_many"), "both").when(F.col("_late"), "stale").otherwise("gaps")
        last = rows.groupBy("stream").agg(F.max_by(F.struct("us", "gaps"), F.struct("_new", "us", "gaps")).alias("r")).select("stream", "r.*")
        return seen.select("stream", "us", alarm.alias("alarm")), last

    return run_carried(beats, step, "stream string, us long, gaps long")


def _watch(silent_ms: int, most_gaps: int, maintenance: list[tuple[int, int]]):
    day = 86_400_000

    def quiet(at_ms: int) -> int:
        """Milliseconds until a maintenance window that holds the time of day is over; 0 outside of one."""
        return next((b - at_ms % day for a, b in maintenance if a <= at_ms % day < b), 0)

    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, gaps, silent = state.get if state.exists else (None, 0, False)
        now, out = state.getCurrentProcessingTimeMs(), []
        if state.hasTimedOut:
            wait = quiet(now)
            if not wait:
                silent = True
                out.append(("silent", last, gaps))
            state.update((last, gaps, silent))
            state.setTimeoutDuration(wait or silent_ms)
        else:
            for chunk in chunks:
                if not len(chunk):
                    continue
                at = chunk["us"].idxmax()
                us, most = int(chunk["us"].max()), int(chunk["gaps"][at])
                if last is None or us >= last:
                    if silent:
                        silent = False
                        out.append(("clear", us, most))
                    if last is not None and most - gaps > most_gaps:
                        out.append(("gaps", us, most))
                    last, gaps = us, most
            state.update((last, gaps, silent))
            state.setTimeoutDuration(silent_ms)
        yield pd.DataFrame({"stream": [key[0]] * len(out), "alarm": [o[0] for o in out], "last_us": [o[1] for o in out], "gaps": [o[2] for o in out]})

    return step


def stream_silence(beats: DataFrame, silent_ms: int, most_gaps: int = 2, maintenance: list[tuple[int, int]] | None = None) -> DataFrame:
    """Alarms of streams of beats (stream, us, gaps) as they come: silent, clear and gaps, with the last beat and its gaps.

    A timer of the processing time runs for each stream from its last beats on: where none comes for silent_ms the stream
    is silent, and says so again each time that passes; its next beat gives the all-clear. Within maintenance windows,
    (from, to) in milliseconds of the UTC day, the alarm waits for their end. gaps is raised by a batch of beats with more
    than most_gaps new ones. A stream that never had a beat isn't known. State is one row for each stream; beats older
    than the last one, and rows with a null, say nothing.
    """
    rows = beats.select("stream", "us", "gaps").dropna()
    return rows.groupBy("stream").applyInPandasWithState(
        _watch(silent_ms, most_gaps, maintenance or []), "stream string, alarm string, last_us long, gaps long", "last long, gaps long, silent boolean", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def stale_intents(intents: DataFrame, stale_us: int = 240_000_000) -> DataFrame:
    """Intents (series, as_of, book_us) with stale: the book is older than stale_us, or there is none. Works on streams and tables."""
    return intents.withColumn("stale", F.coalesce(F.col("as_of") - F.col("book_us") > stale_us, F.lit(True)))


def _ratios(counts: DataFrame, warn: float, least: int) -> DataFrame:
    each = counts.select("series", "seen", "rejected", F.lit(False).alias("pooled"))
    kind = counts.schema["series"].dataType
    every = counts.agg(F.lit(None).cast(kind).alias("series"), F.sum("seen").alias("seen"), F.sum("rejected").alias("rejected"), F.lit(True).alias("pooled")).filter("seen > 0")
    ratio = F.col("rejected") / F.col("seen")
    return each.unionByName(every).select("series", "pooled", "seen", "rejected", F.round(ratio, 9).alias("ratio"), ((ratio > warn) & (F.col("pooled") | (F.col("seen") >= least))).alias("warns"))


def stale_ratios(intents: DataFrame, warn: float = 0.5, least: int = 10) -> DataFrame:
    """By series, and pooled over all: intents seen, those rejected as stale, their ratio, and whether it warns.

    intents: of stale_intents. A series warns where its ratio is above warn and it has least intents; all together warn
    whatever their number. A null series is one; no intents give no rows.
    """
    return _ratios(intents.groupBy("series").agg(F.count("*").alias("seen"), F.count_if("stale").alias("rejected")), warn, least)


def _stale_counts(batch: DataFrame, carried: DataFrame) -> tuple[DataFrame, DataFrame]:
    new = batch.groupBy("series").agg(F.count("*").alias("seen"), F.count_if("stale").alias("rejected"))
    both = carried.withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True)))
    after = both.groupBy("series").agg(F.sum("seen").alias("seen"), F.sum("rejected").alias("rejected"), F.bool_or("_new").alias("_met"))
    return after.filter("_met").drop("_met"), after.drop("_met")


def watched_intents(intents: DataFrame, name: str, stale_us: int = 240_000_000) -> DataFrame:
    """stale_intents of a stream that reports, with every batch, how many were seen and rejected, as observed metrics under name."""
    rows = stale_intents(intents, stale_us)
    return rows.observe(name, F.count(F.lit(1)).alias("seen"), F.count_if("stale").alias("rejected"))


def stream_stale_books(intents: DataFrame, stale_us: int = 240_000_000, warn: float = 0.5, least: int = 10) -> DataFrame:
    """stale_ratios of a stream of intents (series, as_of, book_us), over what is there now; counts by series are carried."""
    found = run_carried(watched_intents(intents, "stale_books", stale_us).select("series", "stale"), _stale_counts, "series string, seen long, rejected long")
    return _ratios(found.groupBy("series").agg(F.max("seen").alias("seen"), F.max("rejected").alias("rejected")), warn, least)  # both only grow
