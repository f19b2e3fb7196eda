"""The first row after each event that reaches the event's own threshold."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _fold(kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, n = None, 0
        open_: dict[int, list] = {1: [], -1: []}
        for batch in batches:
            ids, times = [], []
            columns = (batch.column(c).to_pylist() for c in ("_key", "_range", "_t", "_id", "_level", "_sign", "_until"))
            for key, part, t, name, level, sign, until in zip(*columns, strict=True):
                if (key, part) != place:
                    place, open_ = (key, part), {1: [], -1: []}
                if until is not None:
                    n += 1
                    heappush(open_[sign], (sign * level, n, until, name))
                    continue
                for s, heap in open_.items():
                    while heap and heap[0][0] <= s * level:
                        _, _, last, found = heappop(heap)
                        if t <= last:
                            ids.append(found)
                            times.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(times, pa.int64())], ["id", "crossed_us"])

    return run


def first_crossing(events: DataFrame, states: DataFrame, by: list[str], *, name: str, at: str, until: str, level: Column, sign: Column, state_at: str, value: Column, width: int) -> DataFrame:
    """(id, crossed_us): for each event the first time, after at and no later than until, of a state of its key at or beyond its level.

    events have an id in the column name, unique; sign is 1 where values are to rise to the level and -1 where they are to
    fall to it. states have the key, a time and a value. Levels and values are whole numbers. Events that nothing reaches
    are left out, as are rows with a null key, time, level or value.

    Rows of a key and range of width of the time are folded in order, with the levels that are still open in a heap: a
    state takes off what it reaches. An event is put into each range that its time touches, so nothing is carried between
    tasks: with a width of the longest time or more into two at most. No event is paired with the states it passes.
    """
    key = F.col(by[0]).cast("string") if len(by) == 1 else F.to_json(F.struct(*by))
    whole = [*by, name, at, until]
    kind = events.schema[name].dataType
    none = F.lit(None)
    opened = events.dropna(subset=whole).select(key.alias("_key"), F.col(name).alias("_id"), F.col(at).cast("long").alias("_at"), F.col(until).cast("long").alias("_until"), level.cast("long").alias("_level"), sign.cast("int").alias("_sign"))
    opened = opened.filter(F.col("_level").isNotNull() & F.col("_sign").isin(1, -1) & (F.col("_until") > F.col("_at")))
    opened = opened.withColumn("_range", F.explode(F.sequence(F.floor(F.col("_at") / width), F.floor(F.col("_until") / width))))
    opened = opened.withColumn("_t", F.greatest(F.col("_at"), F.col("_range") * width - 1))
    seen = states.dropna(subset=[*by, state_at]).select(key.alias("_key"), F.col(state_at).cast("long").alias("_t"), value.cast("long").alias("_level")).filter(F.col("_level").isNotNull())
    seen = seen.withColumns({"_range": F.floor(F.col("_t") / width), "_id": none.cast(kind), "_sign": none.cast("int"), "_until": none.cast("long")})
    columns = ["_key", "_range", "_t", "_id", "_level", "_sign", "_until"]
    # at one time states come first, as an event waits for a later one
    rows = opened.select(*columns, F.lit(1).alias("_side")).unionByName(seen.select(*columns, F.lit(0).alias("_side")))
    rows = rows.repartition("_key", "_range").sortWithinPartitions("_key", "_range", "_t", "_side")
    arrow = {"bigint": pa.int64(), "string": pa.string(), "int": pa.int32()}[kind.simpleString()]
    found = rows.drop("_side").mapInArrow(_fold(arrow), f"id {kind.simpleString()}, crossed_us long")
    return found.groupBy("id").agg(F.min("crossed_us").alias("crossed_us"))
