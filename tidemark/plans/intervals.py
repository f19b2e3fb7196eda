"""Unions of intervals, joins of points and spans with them, and maximal runs of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.keep import keep
from tidemark.plans.scan import most, running


def islands(df: DataFrame, by: list[str], order: list, starts: Column, name: str = "island") -> DataFrame:
    """Numbers maximal runs: a row where starts holds begins the next run of its key."""
    return df.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def merge_intervals(df: DataFrame, start: str, end: str, by: list[str] | None = None, width: int = 86_400_000_000) -> DataFrame:
    """The union of closed intervals by key: disjoint [start, end], touching ones joined. Rows with a null bound go, a null key is a key.

    Of the intervals of one start only the longest counts, so no rows tie in what follows: how far the intervals before
    reach, and from what reaches less far than a row the start of its union. Both run along a key's rows in ranges of
    width of their starts, so that a busy key is many tasks. No rows give no rows.
    """
    by = by or []
    rows = df.filter(F.col(start).isNotNull() & F.col(end).isNotNull()).groupBy(*by, start).agg(F.max(end).alias(end))
    marked = keep(running(rows, by, [start], width, {"_upto": most(F.col(end), through=False)}))  # a row for each start, read twice
    first = F.when(F.col("_upto").isNull() | (F.col(start) > F.col("_upto")), F.col(start))
    runs = running(marked, by, [start], width, {"_island": most(first)})
    return runs.groupBy(*by, "_island").agg(F.max(end).alias(end)).select(*by, F.col("_island").alias(start), end)


def interval_join(points: DataFrame, spans: DataFrame, at: str, start: str, end: str, width: int, by: list[str] | None = None, closed: bool = True, how: str = "inner") -> DataFrame:
    """Points with the spans that hold them; closed includes the span's end. how may be inner, left_semi or left_anti.

    Spans are listed under every time bin of width that they touch, points under their own, and the exact bounds are
    checked on the equal bins. A pair meets in the point's bin only, so none is found twice.
    """
    by = by or []
    first, last = F.floor(F.col(start) / width), F.floor(F.col(end) / width)
    listed = spans.withColumn("_bin", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    renamed = listed.select(*(F.col(c).alias(f"_s_{c}") for c in listed.columns))
    test = (F.floor(F.col(at) / width).cast("long") == F.col("_s__bin")) & (F.col(at) >= F.col(f"_s_{start}"))
    test &= (F.col(at) <= F.col(f"_s_{end}")) if closed else (F.col(at) < F.col(f"_s_{end}"))
    for c in by:
        test &= F.col(c) == F.col(f"_s_{c}")
    joined = points.join(renamed, test, how)
    if how != "inner":
        return joined
    own = [c for c in spans.columns if c not in by and c not in points.columns]
    return joined.select(*points.columns, *(F.col(f"_s_{c}").alias(c) for c in own))
