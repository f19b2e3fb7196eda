"""Clustered resampling: bootstraps over clusters, sign-flip tests over blocks, gates and verdicts.

Random draws are 32 bits of an MD5 of seed, replicate and place, so any engine makes the same ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import draw


def numbered(clusters: DataFrame, order: list[str]) -> DataFrame:
    """Adds i, the place of each cluster from 0, and n, their number. Clusters are aggregates: a row each."""
    return clusters.withColumn("i", (F.row_number().over(Window.orderBy(*order)) - 1).cast("long")).withColumn("n", F.count("*").over(Window.partitionBy()))


def resampled(clusters: DataFrame, order: list[str], seed: int, replicates: int) -> DataFrame:
    """Clusters as each replicate draws them, with replacement: rep, multiplicity and the cluster's columns."""
    places, n = numbered(clusters, order), clusters.count()
    draws = clusters.sparkSession.range(replicates * n).select(F.expr(f"id div {max(n, 1)}").alias("rep"), (F.col("id") % max(n, 1)).alias("k"), F.lit(n).alias("n"))
    picks = draws.select("rep", (draw(seed, "rep", "k") % F.col("n")).alias("i")).groupBy("rep", "i").agg(F.count("*").alias("times"))
    return picks.join(places.drop("n"), "i")


def cluster_bootstrap(clusters: DataFrame, order: list[str], seed: int, replicates: int) -> DataFrame:
    """Ratio of sums over clusters (total, weight), its pivotal one-sided p-value against 0, and a basic 95 % interval."""
    point = clusters.agg((F.sum("total") / F.sum("weight")).alias("estimate"), F.count("*").alias("clusters"))
    reps = resampled(clusters, order, seed, replicates).groupBy("rep").agg((F.sum(F.col("times") * F.col("total")) / F.sum(F.col("times") * F.col("weight"))).alias("r"))
    rows = reps.join(F.broadcast(point))
    pick = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY r)")
    out = rows.groupBy("estimate", "clusters").agg(F.count_if(F.col("r") - F.col("estimate") >= F.col("estimate")).alias("extreme"), pick(0.025).alias("a"), pick(0.975).alias("b"), F.stddev_samp("r").alias("spread"))
    return out.select(F.round("estimate", 6).alias("estimate"), "clusters", F.round((1 + F.col("extreme")) / F.lit(replicates + 1), 9).alias("p_value"), F.round(2 * F.col("estimate") - F.col("b"), 6).alias("low"), F.round(2 * F.col("estimate") - F.col("a"), 6).alias("high"), (F.col("spread") == 0).alias("degenerate"))


def cluster_median_bootstrap(values: DataFrame, cluster: str, value: str, seed: int, replicates: int) -> DataFrame:
    """Median of all values and a basic 95 % interval, resampling clusters with all that they hold.

    Values are counted by cluster first, so a replicate joins multiplicities and no copies are made.
    """
    counts = values.groupBy(cluster, value).agg(F.count("*").alias("c"))
    clusters = values.select(cluster).distinct()
    picks = resampled(clusters, [cluster], seed, replicates).select("rep", "times", cluster)
    reps = picks.join(counts, cluster).groupBy("rep").agg(F.percentile(value, F.lit(0.5), F.col("c") * F.col("times")).alias("m"))
    point = values.agg(F.percentile(value, F.lit(0.5)).alias("estimate"))
    pick = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY m)")
    out = reps.join(F.broadcast(point)).groupBy("estimate").agg(pick(0.025).alias("a"), pick(0.975).alias("b"))
    return out.select("estimate", (2 * F.col("estimate") - F.col("b")).alias("low"), (2 * F.col("estimate") - F.col("a")).alias("high"))


def day_blocks(clusters: DataFrame, size: int = 3) -> DataFrame:
    """Blocks of a group's days by place: every size days in order, whether or not the calendar has others between."""
    rank = F.dense_rank().over(Window.partitionBy("grp").orderBy("day"))
    return clusters.withColumn("block", F.floor((rank - 1) / size).cast("long"))


def wild_cluster_bootstrap(blocks: DataFrame, order: list[str], seed: int, replicates: int) -> DataFrame:
    """Mean over blocks (total, weight) and its p-value by flipping the signs of whole blocks' residuals under a mean of 0.

    Statistics are studentised by the blocks' own sums of squares; replicates without spread count as extreme.
    """
    rows = numbered(blocks, order)
    point = rows.agg((F.sum("total") / F.sum("weight")).alias("estimate"), F.sqrt(F.sum(F.col("total") * F.col("total"))).alias("scale"), F.sum("total").alias("sum"))
    flips = rows.select("i", "total", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep")).withColumn("sign", F.when(draw(seed, "rep", "i") % 2 == 0, 1).otherwise(-1))
    each = flips.groupBy("rep").agg(F.abs(F.sum(F.col("sign") * F.col("total"))).alias("t"))
    out = each.join(F.broadcast(point)).groupBy("estimate", "scale", "sum").agg(F.count_if((F.col("scale") == 0) | (F.col("t") >= F.abs("sum"))).alias("extreme"))
    return out.select(F.round("estimate", 6).alias("estimate"), F.round(F.when(F.col("scale") > 0, F.abs("sum") / F.col("scale")), 6).alias("t"), F.round((1 + F.col("extreme")) / F.lit(replicates + 1), 9).alias("p_value"))


def gate(rows: DataFrame, threshold: float, alpha: float, least_n: int, direction: str = "greater", strict: bool = False) -> DataFrame:
    """Whether each estimate is worth it, significant, and based on enough: economic, undecidable, significant, powered, passed.

    rows: estimate, p_value, clusters. An estimate that meets the threshold, in the direction greater or less, is economic;
    with strict it is to go beyond it, as with a threshold of zero, where meeting it is no edge. Without an estimate or a
    p-value (or with a NaN for it) a row is undecidable: neither economic nor significant, so it doesn't pass.
    """
    if direction not in ("greater", "less"):
        raise ValueError(f"direction must be greater or less, not {direction!r}")
    x = F.col("estimate")
    met = (x > threshold if strict else x >= threshold) if direction == "greater" else (x < threshold if strict else x <= threshold)
    missing = x.isNull() | F.isnan(x.cast("double")) | F.col("p_value").isNull() | F.isnan(F.col("p_value").cast("double"))
    rows = rows.withColumn("undecidable", missing).withColumn("economic", ~F.col("undecidable") & F.coalesce(met, F.lit(False)))
    rows = rows.withColumn("significant", ~F.col("undecidable") & F.coalesce(F.col("p_value") < alpha, F.lit(False))).withColumn("powered", F.col("clusters") >= least_n)
    return rows.withColumn("passed", F.col("economic") & F.col("significant") & F.col("powered"))


def holdout(rows: DataFrame, by: list[str], alpha: float, least_n: int) -> DataFrame:
    """Whether the holdout of each group replicates its discovery: the same sign, half the size, significant, and half the clusters.

    rows: by, split, estimate, p_value, clusters, a row for each group and split. least_n is what the discovery was to have:
    the holdout is powered with half of it, rounded up. An estimate of zero has no sign. direction is null where the
    discovery is zero or missing, which no holdout can replicate; a missing p-value or estimate isn't significant.
    """
    side = lambda s: rows.filter(F.col("split") == s).select(*by, *(F.col(c).alias(f"{s}_{c}") for c in ("estimate", "clusters", "p_value")))
    both = side("discovery").join(side("holdout"), by)
    a, b, p = F.col("discovery_estimate"), F.col("holdout_estimate"), F.col("holdout_p_value")
    both = both.withColumn("direction", F.when(a > 0, "greater").when(a < 0, "less"))
    sure = lambda c: F.coalesce(c, F.lit(False))
    both = both.withColumns({
        "same_sign": sure((F.signum(a) == F.signum(b)) & (b != 0)), "magnitude": sure(2 * F.abs(b) >= F.abs(a)), "significant": sure((p < alpha) & ~F.isnan(p.cast("double")) & b.isNotNull()),
        "powered": F.col("holdout_clusters") >= (least_n + 1) // 2,
    })
    return both.withColumn("held", F.col("same_sign") & F.col("magnitude") & F.col("significant") & F.col("powered")).drop("discovery_p_value")


def verdict(rows: DataFrame, precedence: list[str]) -> DataFrame:
    """One word for each row with passed, significant and powered, by an order of precedence."""
    tests: dict[str, Column] = {"UNDERPOWERED": ~F.col("powered"), "CLOSED": F.col("powered") & ~F.col("passed"), "PASS": F.col("passed"), "UNDECIDABLE": F.col("estimate").isNull()}
    out = None
    for name in precedence:
        out = F.when(tests[name], name) if out is None else out.when(tests[name], name)
    return rows.withColumn("verdict", out)


def cluster_builder(rows: DataFrame, keys: list[str], total: str, weight: str) -> DataFrame:
    """Clusters by keys: sums of total and weight, with those without weight left out."""
    return rows.groupBy(*keys).agg(F.sum(total).alias("total"), F.sum(weight).alias("weight")).filter("weight > 0")
