"""Running values in the order of a key's rows, with a key's rows spread over tasks."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Running(NamedTuple):
    """What runs along a key's rows: kind is sum, max, last (not null) or lag; through includes the row itself."""

    kind: str
    value: Column
    through: bool


def total(value: Column, through: bool = True) -> Running:
    """The sum so far; 0 before the first row, nulls add nothing."""
    return Running("sum", value, through)


def most(value: Column, through: bool = True) -> Running:
    """The largest value so far, null where there is none."""
    return Running("max", value, through)


def latest(value: Column, through: bool = True) -> Running:
    """The last value so far that isn't null."""
    return Running("last", value, through)


def before(value: Column) -> Running:
    """The value of the row before, be it null; null for the first row."""
    return Running("lag", value, False)


def running(df: DataFrame, by: list[str], order: list[str], width: int, columns: dict[str, Running]) -> DataFrame:
    """df with columns that run along the rows of each key in order; without keys, along all rows.

    order begins with a number, whose ranges of width cut a key's rows into parts. Parts are windowed by themselves; one
    row for each part says what it adds, and these rows, few for each key, are what is run through by key. So one key's
    rows are as many tasks as they have ranges. order is to leave no ties, else rows at one place follow in any order.
    Null keys are a key; rows with a null number come first. No rows give no rows.
    """
    part = F.floor(F.col(order[0]) / width)
    rows = df.withColumns({"_part": part, **{f"_v_{n}": c.value for n, c in columns.items()}})
    place = F.struct(*order)
    sums = {
        "sum": lambda v: F.sum(v), "max": lambda v: F.max(v),
        "last": lambda v: F.max_by(F.when(v.isNotNull(), F.struct(v.alias("v"))), F.when(v.isNotNull(), place)), "lag": lambda v: F.max_by(F.struct(v.alias("v")), place),
    }
    parts = rows.groupBy(*by, "_part").agg(*(sums[c.kind](F.col(f"_v_{n}")).alias(n) for n, c in columns.items()))
    upto = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = {"sum": lambda n: F.sum(n).over(upto), "max": lambda n: F.max(n).over(upto)}
    carried = parts.select(
        *(F.col(c).alias(f"_k_{c}") for c in [*by, "_part"]),
        *(carry.get(c.kind, lambda n: F.last(n, ignorenulls=True).over(upto))(n).alias(f"_c_{n}") for n, c in columns.items()),
    )
    same = F.lit(True)
    for c in [*by, "_part"]:
        same &= F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    own = Window.partitionBy(*by, "_part").orderBy(*order)

    def value(name: str, c: Running) -> Column:
        frame = own.rowsBetween(Window.unboundedPreceding, 0 if c.through else -1)
        v, old = F.col(f"_v_{name}"), F.col(f"_c_{name}")
        if c.kind == "sum":
            return F.coalesce(F.sum(v).over(frame), F.lit(0)) + F.coalesce(old, F.lit(0))
        if c.kind == "max":
            return F.greatest(F.max(v).over(frame), old)
        if c.kind == "lag":
            return F.coalesce(F.lag(F.struct(v.alias("v"))).over(own), old)["v"]
        return F.coalesce(F.last(v, ignorenulls=True).over(frame), old["v"])

    return rows.join(carried, same, "left").select(*df.columns, *(value(n, c).alias(n) for n, c in columns.items()))


def following(df: DataFrame, by: list[str], order: list[str], width: int, columns: dict[str, Column]) -> DataFrame:
    """df with columns of the row after each of a key's rows, null for the last; order is of numbers, which leave no ties."""
    back = {f"_b{i}": -F.col(c) for i, c in enumerate(order)}
    return running(df.withColumns(back), by, list(back), width, {n: before(v) for n, v in columns.items()}).drop(*back)
