"""Column functions: exact money, normal probabilities and quantiles by several definitions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ticks of a dollar and units of a contract.
TICKS, UNITS = 10_000, 100


def fee_cents(units: str, ticks: str, maker: bool = False) -> Column:
    """A fee in whole cents, rounded up: 7 % (maker 1.75 %) of contracts * p * (1 - p), from hundredths of contracts and ticks."""
    rate, scale = (175, 10**12) if maker else (7, 10**10)
    return F.expr(f"({rate}L * ({units}) * ({ticks}) * ({TICKS}L - ({ticks})) + {scale - 1}L) div {scale}L")


#: Coefficients of W. J. Cody's rational approximations of erf and erfc.
_ERF_P = (3.16112374387056560e00, 1.13864154151050156e02, 3.77485237685302021e02, 3.20937758913846947e03, 1.85777706184603153e-1)
_ERF_Q = (2.36012909523441209e01, 2.44024637934444173e02, 1.28261652607737228e03, 2.84423683343917062e03)
_ERFC_P = (5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e01, 2.98635138197400131e02, 8.81952221241769090e02, 1.71204761263407058e03, 2.05107837782607147e03, 1.23033935479799725e03, 2.15311535474403846e-8)
_ERFC_Q = (1.57449261107098347e01, 1.17693950891312499e02, 5.37181101862009858e02, 1.62138957456669019e03, 3.29079923573345963e03, 4.36261909014324716e03, 3.43936767414372164e03, 1.23033935480374942e03)


def phi_sql(z: str) -> str:
    """The standard normal distribution function of an expression, as SQL for any engine; absolute error below 1e-9."""
    x = f"(abs({z}) / {math.sqrt(2)!r})"

    def horner(c: tuple, y: str) -> str:
        out = f"{c[0]!r}"
        for v in c[1:]:
            out = f"({out} * {y} + {v!r})"
        return out

    small = f"{x} * {horner((_ERF_P[4], *_ERF_P[:4]), f'({x} * {x})')} / {horner((1.0, *_ERF_Q), f'({x} * {x})')}"
    large = f"exp(-{x} * {x}) * {horner((_ERFC_P[8], *_ERFC_P[:8]), x)} / {horner((1.0, *_ERFC_Q), x)}"
    tail = f"CASE WHEN {x} > 6 THEN 0.0 WHEN {x} > 0.46875 THEN {large} ELSE 1.0 - {small} END"
    return f"(CASE WHEN {z} >= 0 THEN 1.0 - 0.5 * ({tail}) ELSE 0.5 * ({tail}) END)"


def phi(z: str) -> Column:
    return F.expr(phi_sql(z))


def quantile(df: DataFrame, by: list[str], value: str, q: float, rule: str, name: str) -> DataFrame:
    """One quantile of value by key, at a position in its sorted values that rule names.

    nearest: ceil(q n); even: q (n - 1) rounded half to even, from 0; up: the same rounded half up; floor: rounded down.
    Rows are counted by value first, so what is sorted are a key's distinct values. Null values don't count.
    """
    bins = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    own = Window.partitionBy(*by)
    ranked = bins.withColumn("_upto", F.sum("_c").over(own.orderBy(value))).withColumn("_n", F.sum("_c").over(own))
    place = {
        "nearest": F.greatest(F.ceil(F.col("_n") * q) - 1, F.lit(0)),
        "even": F.bround((F.col("_n") - 1) * q),
        "up": F.floor((F.col("_n") - 1) * q + 0.5),
        "floor": F.floor((F.col("_n") - 1) * q),
    }[rule]
    return ranked.filter(F.col("_upto") > place).groupBy(*by).agg(F.min(value).alias(name))


def weighted_quantile(df: DataFrame, by: list[str], value: str, weight: str, q: float, name: str) -> DataFrame:
    """The first value, in order, at which the weights summed so far reach q of all; weights are summed by value first."""
    bins = df.groupBy(*by, value).agg(F.sum(weight).alias("_w"))
    own = Window.partitionBy(*by)
    upto = bins.withColumn("_upto", F.sum("_w").over(own.orderBy(value))).withColumn("_all", F.sum("_w").over(own))
    return upto.filter((F.col("_upto") >= F.col("_all") * q) & (F.col("_all") > 0)).groupBy(*by).agg(F.min(value).alias(name))


def draw(seed: int, *parts: str) -> Column:
    """32 random bits from the seed and the parts, the same on every engine: the start of an MD5."""
    whole = F.concat_ws("-", F.lit(str(seed)), *(F.col(p).cast("string") for p in parts))
    return F.conv(F.substring(F.md5(whole), 1, 8), 16, 10).cast("long")
