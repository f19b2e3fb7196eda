"""Medians of times of which some are only known to be longer than what was seen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.keep import keep
from tidemark.plans.scan import running, total


def time_bins(df: DataFrame, by: list[str], time: str, observed: str) -> DataFrame:
    """(by, time, ended, censored): how many end at each time and how many are seen no longer; bins of parts of df add up. Null times don't count."""
    rows = df.filter(F.col(time).isNotNull()).select(*by, F.col(time).alias("time"), F.coalesce(observed, F.lit(False)).alias("_o"))
    return rows.groupBy(*by, "time").agg(F.count_if("_o").alias("ended"), F.count_if(~F.col("_o")).alias("censored"))


def survival(bins: DataFrame, by: list[str], width: int) -> DataFrame:
    """Bins with at_risk, how many were still going just before each time, and alive, the product-limit share that lasts longer."""
    sizes = F.col("ended") + F.col("censored")
    everyone = bins.groupBy(*by).agg(F.sum(sizes).alias("_all"))
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by]
    rows = running(bins, by, ["time"], width, {"_before": total(sizes, through=False)})
    rows = rows.join(everyone.select(*(F.col(c).alias(f"_k_{c}") for c in by), "_all"), same or None).withColumn("at_risk", F.col("_all") - F.col("_before"))
    left = F.col("at_risk") - F.col("ended")
    # where none is left the share is 0, which no sum of logarithms gives
    rows = rows.withColumn("_log", F.when(left > 0, F.ln(left / F.col("at_risk"))).otherwise(F.lit(-1e6)))
    rows = running(rows.drop("_all", "_before", *(f"_k_{c}" for c in by)), by, ["time"], width, {"_logs": total(F.col("_log"))})
    return rows.withColumn("alive", F.round(F.exp("_logs"), 12)).drop("_log", "_logs")


def censored_median(df: DataFrame, by: list[str], time: str, observed: str, name: str, width: int = 3_600_000_000) -> DataFrame:
    """By key the count n, how many are censored, and the product-limit median of time, null where half or more never end.

    observed says whether time is when something ended, or only for how long it was seen not to. The median is the first
    time at which no more than half last longer, if in the end less than half do. Where all are censored at one time it is
    the rank of the middle among all of them. Distinct times of a key are spread over ranges of width.
    """
    bins = keep(time_bins(df, by, time, observed))
    steps = survival(bins, by, width)
    return steps.groupBy(*by).agg(
        F.sum(F.col("ended") + F.col("censored")).alias("n"), F.sum("censored").alias("censored"),
        F.when(F.min("alive") < 0.5, F.min(F.when(F.col("alive") <= 0.5, F.col("time")))).alias(name),
    )
