"""As-of joins: for every left row the nearest right row in time, by key or of all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(
    left: DataFrame, right: DataFrame, by: list[str], left_t: str, right_t: str, take: list[str], *,
    forward: bool = False, strict: bool = False, tolerance: int | None = None, tie: str | None = None,
) -> DataFrame:
    """left with the columns take of the last right row at or before left_t (forward: the first at or after).

    strict leaves out rows at the same instant; beyond tolerance nothing is joined; of rows at one instant the one
    with the largest tie (forward: the smallest) counts. Left rows without a partner get nulls. A null time or key
    has no partner, on either side.

    Both sides are put into one stream per key and the last right row is carried along, so there is one shuffle and
    no pairing of rows. Partitions are by key and sorted by time with spill, so a hot key costs a sort, not memory.
    """
    sign = -1 if forward else 1
    right = right.dropna(subset=[*by, right_t])
    none = F.lit(None)
    carried = [F.col(c) for c in dict.fromkeys([*take, right_t])]
    fields = right.select(F.struct(*carried).alias("_right")).schema["_right"].dataType
    own = left.select(F.struct("*").alias("_left")).schema["_left"].dataType
    l_rows = left.select(*by, (F.col(left_t) * sign).alias("_t"), F.lit(1).alias("_side"), F.lit(0).cast("long").alias("_tie"), F.struct("*").alias("_left"), none.cast(fields).alias("_right"))
    tie_value = (F.col(tie).cast("long") * sign) if tie else F.lit(0).cast("long")
    r_rows = right.select(*by, (F.col(right_t) * sign).alias("_t"), F.lit(2 if strict else 0).alias("_side"), tie_value.alias("_tie"), none.cast(own).alias("_left"), F.struct(*carried).alias("_right"))
    order = Window.partitionBy(*by).orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    found = l_rows.unionByName(r_rows).withColumn("_seen", F.last("_right", ignorenulls=True).over(order)).filter("_side = 1")
    value: Column = F.col("_seen")
    if tolerance is not None:
        value = F.when(F.abs(F.col("_left")[left_t] - F.col("_seen")[right_t]) <= tolerance, F.col("_seen"))
    return found.withColumn("_seen", value).select("_left.*", *(F.col("_seen")[c].alias(c) for c in take))


def last_row_before(left: DataFrame, right: DataFrame, left_t: str, right_t: str, take: list[str], width: int) -> DataFrame:
    """left with the columns take of the last of all right rows at or before left_t, without a key to join by; nulls if there is none.

    Rows meet in ranges of width of the time; what ranges before held comes from a table with one row a range. left is
    read once. Null times meet nothing; of right rows at one time any may be taken. Rows of one range are one task's sort,
    so width is to be short against the whole time.
    """
    right = right.select(F.col(right_t).alias("_time"), F.struct(*take).alias("_taken"), F.floor(F.col(right_t) / width).alias("_range")).filter(F.col("_range").isNotNull())
    held = right.groupBy("_range").agg(F.max_by("_taken", "_time").alias("_held"))
    # what a range holds is carried into those after it, as far as the next that holds some; after the last one, one row serves all
    ahead = held.withColumn("_next", F.lead("_range").over(Window.orderBy("_range"))).filter("_next is not null")
    carried = ahead.select(F.explode(F.sequence(F.col("_range") + 1, F.col("_next"))).alias("_range"), F.col("_held").alias("_carried"))
    end = held.agg(F.max_by("_held", "_range").alias("_last_held"), F.max("_range").alias("_last_range"))
    left = left.withColumn("_range", F.floor(F.col(left_t) / width))
    met = asof_join(left, right, ["_range"], left_t, "_time", ["_taken"]).join(carried, "_range", "left").join(F.broadcast(end))
    met = met.withColumn("_taken", F.coalesce("_taken", "_carried", F.when(F.col("_range") > F.col("_last_range"), F.col("_last_held"))))
    return met.select("*", *(F.col("_taken")[c].alias(c) for c in take)).drop("_range", "_carried", "_taken", "_last_held", "_last_range")


def last_before(left: DataFrame, right: DataFrame, left_t: str, right_t: str, name: str, width: int) -> DataFrame:
    """left with the last right_t of all right rows at or before left_t as name, as in last_row_before."""
    return last_row_before(left, right.select(F.col(right_t).alias(name)), left_t, name, [name], width)
