"""Forecast verification: ensemble probabilities, scores, calibration, blending and decision tables."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import fee_cents, phi_sql, quantile
from tidemark.plans.asof import asof_join

EPS = 1e-6


def daily_max_members(hourly: DataFrame, least_hours: int) -> DataFrame:
    """Highest value of each member and day with enough hours. hourly: station, member, day, hour, value."""
    return hourly.groupBy("station", "member", "day").agg(F.count_distinct("hour").alias("hours"), F.max("value").alias("high")).filter(F.col("hours") >= least_hours)


def latest_forecast_asof(points: DataFrame, runs: DataFrame, by: list[str], tolerance_us: int | None = None) -> DataFrame:
    """The newest run (run_us, run_id) of each key at or before as_of."""
    rows = runs.select(*by, "run_us", "run_id", F.col("run_us").alias("found_us"))
    return asof_join(points, rows, by, "as_of", "run_us", ["run_id", "found_us"], tie="run_id", tolerance=tolerance_us)


def ensemble_cdf(members: str, at: float, sigma: float) -> Column:
    """Mean over the members of the normal distribution function of (at - member) / sigma."""
    return F.expr(f"aggregate(transform({members}, m -> {phi_sql(f'(({at}D - m) / {sigma}D)')}), 0D, (a, x) -> a + x) / size({members})")


def bracket_probability(members: str, kind: str, low: float, high: float, sigma: float, continuity: float = 0.0) -> Column:
    """Probability of below low, above high, or between, with the bounds moved outwards by continuity."""
    if kind == "below":
        return ensemble_cdf(members, low - continuity, sigma)
    if kind == "above":
        return 1 - ensemble_cdf(members, high + continuity, sigma)
    return ensemble_cdf(members, high + continuity, sigma) - ensemble_cdf(members, low - continuity, sigma)


def ladder_sum(probabilities: DataFrame, key: str, tolerance: float = 1e-9, price_tolerance: int = 500) -> DataFrame:
    """Sums of a key's rung probabilities p and prices in ticks; sound if the first is 1, priced if the other is near 1."""
    sums = probabilities.groupBy(key).agg(F.sum("p").alias("total"), F.count("*").alias("rungs"), F.sum("price").alias("price_total"))
    return sums.withColumns({"sound": F.abs(F.col("total") - 1) <= tolerance, "priced": F.abs(F.col("price_total") - 10_000) <= price_tolerance})


def member_spread(members: str) -> Column:
    """Population standard deviation of an array."""
    mean = f"(aggregate({members}, 0D, (a, x) -> a + x) / size({members}))"
    return F.sqrt(F.expr(f"aggregate(transform({members}, m -> (m - {mean}) * (m - {mean})), 0D, (a, x) -> a + x) / size({members})"))


def brier(scored: DataFrame, by: list[str], market: str) -> DataFrame:
    """Per group: rows, Brier score, that of the group's own rate, the skill over it, that of the market's column, and
    delta, the market's less the own; six decimals. No rows give none.
    """
    rows = scored.groupBy(*by).agg(F.count("*").alias("n"), F.avg((F.col("p") - F.col("o")) * (F.col("p") - F.col("o"))).alias("score"), F.avg("o").alias("rate"), F.round(F.avg((F.col(market) - F.col("o")) * (F.col(market) - F.col("o"))), 6).alias("market"))
    base = F.col("rate") * (1 - F.col("rate"))
    return rows.select(*by, "n", F.round("score", 6).alias("brier"), F.round(base, 6).alias("baseline"), F.round(F.when(base > 0, 1 - F.col("score") / base), 6).alias("skill"), "market", F.round(F.col("market") - F.round("score", 6), 6).alias("delta"))


def reliability(scored: DataFrame, bins: int) -> DataFrame:
    """Rows, mean prediction and observed rate in equal bins of p; the last holds 1, empty bins have zeros."""
    slot = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    rows = scored.groupBy(slot.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("predicted"), F.avg("o").alias("observed"))
    every = scored.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(rows, "bin", "left").select("bin", *(F.coalesce(F.round(c, 9), F.lit(0)).alias(c) for c in ("n", "predicted", "observed")))


def log_loss_hit_rate(scored: DataFrame) -> DataFrame:
    """Brier, log loss, hit rate, net, the Brier of the mid and whether p beats it, by (grp, bucket, month) and by grp."""
    p = F.least(F.greatest("p", F.lit(EPS)), F.lit(1 - EPS))
    rows = scored.withColumn("ll", -F.when(F.col("o") == 1, F.ln(p)).otherwise(F.ln(1 - p))).withColumn("hit", ((F.col("p") >= 0.5) == (F.col("o") == 1)).cast("long"))
    return rows.groupingSets([["grp", "bucket", "month"], ["grp"]], "grp", "bucket", "month").agg(
        F.count("*").alias("n"), F.round(F.avg((F.col("p") - F.col("o")) * (F.col("p") - F.col("o"))), 9).alias("brier"), F.round(F.avg("ll"), 9).alias("log_loss"), F.round(F.avg("hit"), 9).alias("hit_rate"),
        F.round(F.sum("net"), 2).alias("net"), F.round(F.avg((F.col("mid") - F.col("o")) * (F.col("mid") - F.col("o"))), 9).alias("baseline"),
    ).withColumn("beats_baseline", F.col("brier") < F.col("baseline"))


def lead_bucket(hours: Column) -> Column:
    """Lead times in five ranges, upper bounds included."""
    return F.when(hours.isNull(), "unknown").when(hours <= 2, "<=2h").when(hours <= 8, "2-8h").when(hours <= 24, "8-24h").when(hours <= 72, "24-72h").otherwise(">72h")


#: Upper bounds of the prices that each strategy's calibration tells apart, and of its lead times in hours.
PRICE_EDGES = {"tails": (0.02,), "edge": (0.05, 0.10, 0.15, 0.20, 0.30)}
LEAD_EDGES = (12, 24, 48)


def place_in(value: Column, edges: tuple[float, ...], open_end: bool = True) -> Column:
    """The place of the first edge that a value doesn't exceed; beyond the last edge the next place, or without open_end the last. Null for null."""
    out = F.when(value.isNull(), F.lit(None).cast("long"))
    for i, upper in enumerate(edges):
        out = out.when(value <= upper, F.lit(i).cast("long"))
    return out.otherwise(F.lit(len(edges) if open_end else len(edges) - 1).cast("long"))


def calibration_cell(strategy: Column, price: Column, hours: Column) -> Column:
    """The cell of a score: a struct of strategy, price and lead. Prices have the strategy's edges; lead times end at 48 hours, -1 is one that isn't known.

    Of a strategy without edges, or a missing price, the price's place is null.
    """
    place = F.lit(None).cast("long")
    for name, edges in PRICE_EDGES.items():
        place = F.when(strategy == name, place_in(price, edges)).otherwise(place)
    return F.struct(strategy.alias("strategy"), place.alias("price"), F.coalesce(place_in(hours, LEAD_EDGES, open_end=False), F.lit(-1).cast("long")).alias("lead"))


def skip_funnel(rows: DataFrame, by: str, reason: str) -> DataFrame:
    """Rows by group and reason, with the reason's share of the group."""
    counts = rows.groupBy(by, reason).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(by)), 9))


def depth_table(rows: DataFrame, least: int) -> DataFrame:
    """Median depth by (series, bucket), or by bucket alone where a cell has fewer than least rows."""
    own = rows.groupBy("series", "bucket").agg(F.count("*").alias("n"), F.percentile("depth", F.lit(0.5)).alias("own"))
    whole = rows.groupBy("bucket").agg(F.percentile("depth", F.lit(0.5)).alias("pooled"))
    return own.join(whole, "bucket").select("series", "bucket", "n", F.when(F.col("n") >= least, F.col("own")).otherwise(F.col("pooled")).alias("depth"))


def sigma_by_lead(rows: DataFrame) -> DataFrame:
    """Median of the members' spread, and rows, by bucket."""
    return rows.groupBy("bucket").agg(F.count("*").alias("n"), F.round(F.percentile("sigma", F.lit(0.5)), 9).alias("median_sigma"))


def spread_calibration(rows: DataFrame, members: str, centre: str) -> DataFrame:
    """Root mean square of members against a single forecast, by bucket."""
    each = rows.select("bucket", centre, F.explode(members).alias("m"))
    return each.groupBy("bucket").agg(F.count("*").alias("points"), F.round(F.sqrt(F.avg((F.col("m") - F.col(centre)) * (F.col("m") - F.col(centre)))), 9).alias("sigma"))


def pool_adjacent(x: np.ndarray, total: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Isotonic fit of total / weight over sorted x: blocks that would fall are pooled."""
    blocks: list[list] = []
    for t, w in zip(total.tolist(), weight.tolist(), strict=True):
        blocks.append([t, w, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            t, w, n = blocks.pop()
            blocks[-1] = [blocks[-1][0] + t, blocks[-1][1] + w, blocks[-1][2] + n]
    return np.concatenate([np.full(n, t / w) for t, w, n in blocks]) if blocks else np.zeros(0)


def isotonic_calibration(scored: DataFrame, by: str) -> DataFrame:
    """Calibrated probability at each distinct p of a group, by isotonic regression.

    Sums by distinct p come first, so a group has as many rows as distinct predictions (round them before, if need be).
    """
    return _isotonic(scored.groupBy(by, "p").agg(F.sum("o").cast("double").alias("total"), F.count("*").cast("double").alias("weight")), by)


def _isotonic(sums: DataFrame, by: str) -> DataFrame:
    """The fit of each group from its sums by distinct p: by, p, total and weight."""

    def fit(group: pa.Table) -> pa.Table:
        group = group.sort_by("p")
        y = pool_adjacent(group.column("p").to_numpy(), group.column("total").to_numpy(), group.column("weight").to_numpy())
        return pa.table({by: group.column(by), "p": group.column("p"), "n": group.column("weight").cast(pa.int64()), "calibrated": np.round(y, 9)})

    return sums.groupBy(by).applyInArrow(fit, f"{by} string, p double, n long, calibrated double")


def calibrated(rows: DataFrame, knots: DataFrame, by: str) -> DataFrame:
    """p mapped through the fit by linear interpolation between knots; as it is outside of them."""
    k = knots.select(by, F.col("p").alias("kp"), F.col("calibrated").alias("kc"))
    low = k.select(by, F.col("kp").alias("low_p"), F.col("kc").alias("low_c"))
    out = asof_join(rows, low.withColumn("_k", F.col("low_p")), [by], "p", "_k", ["low_p", "low_c"])
    high = k.select(by, F.col("kp").alias("high_p"), F.col("kc").alias("high_c"))
    out = asof_join(out, high.withColumn("_k", F.col("high_p")), [by], "p", "_k", ["high_p", "high_c"], forward=True)
    share = F.when(F.col("high_p") > F.col("low_p"), (F.col("p") - F.col("low_p")) / (F.col("high_p") - F.col("low_p"))).otherwise(0.0)
    value = F.when(F.col("low_p").isNull() | F.col("high_p").isNull(), F.col("p")).otherwise(F.col("low_c") + share * (F.col("high_c") - F.col("low_c")))
    return out.withColumn("q", F.round(value, 9)).drop("low_p", "low_c", "high_p", "high_c")


def calibration_job(scored: DataFrame, by: str, days: int = 90, holdout: int = 7, least: int = 300, least_positive: int = 30) -> DataFrame:
    """Walks forward through scored (by, day, p, o): every period of holdout days is judged by a fit on the days before it.

    day counts from 1970; the training days are the days - holdout before the period starts. A fit is made where they
    hold least rows and least_positive of them with o = 1; without one, and outside of its range, p stays as it is.
    Returns by, period (day div holdout), train_n, positives, fitted, n, brier_new with that fit, brier_previous with
    the fit of the period before, improved (new below previous), and skill, that of the new one over the period's own
    rate (null where all outcomes are alike). Rows with a null by, day, p or o don't count; no rows give none.

    Rows are summed by day and distinct p first; those sums, not rows, are listed under the periods that they train.
    """
    daily = scored.dropna(subset=[by, "day", "p", "o"]).groupBy(by, "day", "p").agg(F.sum("o").cast("double").alias("total"), F.count("*").cast("double").alias("weight"))
    first, last = F.floor(F.col("day") / holdout) + 1, F.floor((F.col("day") + days - holdout) / holdout)
    train = daily.withColumn("period", F.explode(F.sequence(first, last))).groupBy(by, "period", "p").agg(F.sum("total").alias("total"), F.sum("weight").alias("weight"))
    own = Window.partitionBy(by, "period")
    train = train.withColumns({"train_n": F.sum("weight").over(own).cast("long"), "positives": F.sum("total").over(own).cast("long")})
    fitted = (F.col("train_n") >= least) & (F.col("positives") >= least_positive)
    key = lambda back: F.concat_ws("|", F.col("period") - back, F.col(by).cast("string"))
    knots = _isotonic(train.filter(fitted).select(key(0).alias("key"), "p", "total", "weight"), "key")
    gates = train.groupBy(by, "period").agg(F.max("train_n").alias("train_n"), F.max("positives").alias("positives"))

    held = daily.groupBy(by, F.floor(F.col("day") / holdout).alias("period"), "p").agg(F.sum("total").alias("total"), F.sum("weight").alias("weight"))
    asked = held.withColumn("back", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("key", key(F.col("back")))
    loss = F.col("weight") * F.col("q") * F.col("q") - 2 * F.col("q") * F.col("total") + F.col("total")  # of (q - o) squared, as o is 0 or 1
    score = lambda back: F.round(F.sum(F.when(F.col("back") == back, loss)) / F.sum(F.when(F.col("back") == back, F.col("weight"))), 9)
    mine = F.col("back") == 0
    out = calibrated(asked, knots, "key").groupBy(by, "period").agg(
        F.sum(F.when(mine, F.col("weight"))).cast("long").alias("n"), F.sum(F.when(mine, F.col("total"))).alias("hits"), score(0).alias("brier_new"), score(1).alias("brier_previous")
    )
    rate = F.col("hits") / F.col("n")
    base = rate * (1 - rate)
    out = out.join(gates, [by, "period"], "left").fillna(0, ["train_n", "positives"])
    return out.select(by, "period", "train_n", "positives", fitted.alias("fitted"), "n", "brier_new", "brier_previous", (F.col("brier_new") < F.col("brier_previous")).alias("improved"), F.round(F.when(base > 0, 1 - F.col("brier_new") / base), 6).alias("skill"))


def gram(rows: DataFrame, columns: list[str], target: str) -> DataFrame:
    """X'X and X'y as one row: the whole of what a least-squares fit needs."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in [*columns[i:], target]]
    return rows.agg(*(F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a, b in pairs))


def nnls_blend(rows: DataFrame, columns: list[str], target: str) -> DataFrame:
    """Weights of the columns, none negative, that fit the target best, scaled to sum 1: member, weight.

    Spark sums the Gram matrix; its few numbers are solved here over every set of active columns, of six at most.
    Weights have twelve decimals, and the largest takes what rounding leaves; no rows, or no fit, give zeros.
    """
    if len(columns) > 6:
        raise ValueError("at most six columns can be blended")
    g = gram(rows, columns, target).first()
    n = len(columns)
    a = np.array([[g[f"{columns[min(i, j)]}_{columns[max(i, j)]}"] for j in range(n)] for i in range(n)], dtype=float)
    b = np.array([g[f"{c}_{target}"] for c in columns], dtype=float)
    a, b = np.nan_to_num(a), np.nan_to_num(b)  # sums over no rows are null
    best, weights = 0.0, np.zeros(n)
    for mask in range(1, 1 << n):
        own = [i for i in range(n) if mask >> i & 1]
        w = np.linalg.lstsq(a[np.ix_(own, own)], b[own], rcond=None)[0]
        if (w >= 0).all() and (loss := float(w @ a[np.ix_(own, own)] @ w - 2 * w @ b[own])) < best:
            best, weights = loss, np.zeros(n)
            weights[own] = w
    if weights.sum():
        weights = np.round(weights / weights.sum(), 12)
        weights[weights.argmax()] += round(1 - weights.sum(), 12)
    return rows.sparkSession.createDataFrame([(c, float(w)) for c, w in zip(columns, weights, strict=True)], "member string, weight double")


def decision_snapshot(snapshots: DataFrame, closes: DataFrame, lead_us: int, stale_us: int) -> DataFrame:
    """The last snapshot of each ticker at or before its close less the lead, unless it is staler than allowed."""
    points = closes.withColumn("as_of", F.col("close_us") - lead_us)
    rows = snapshots.select("ticker", "us", "id", "mid2", F.col("us").alias("snapshot_us"))
    return asof_join(points, rows, ["ticker"], "as_of", "us", ["mid2", "snapshot_us"], tolerance=stale_us, tie="id")


def depth_screen(rows: DataFrame, value: str, least: int) -> DataFrame:
    """Legs kept and below size, those at zero, and quantiles at floored ranks."""
    own, held = Window.orderBy(value), F.when(F.col(value).isNotNull(), F.col("_c"))
    bins = rows.groupBy(value).agg(F.count("*").alias("_c"))  # what is put in one order is a row a distinct value
    bins = bins.withColumn("_upto", F.sum(held).over(own)).withColumn("_n", F.sum(held).over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    every = lambda test: F.coalesce(F.sum(F.when(test, F.col("_c"))), F.lit(0))
    at = lambda q: F.min(F.when(F.col("_upto") > F.floor((F.col("_n") - 1) * (q / 100)), F.col(value))).alias(f"p{q}")
    return bins.agg(every(F.lit(True)).alias("n"), every(F.col(value) >= least).alias("kept"), every(F.col(value) == 0).alias("zeros"), F.max(value).alias("most"), at(10), at(50), at(90))


def entry_pnl(rows: DataFrame) -> DataFrame:
    """Side, price executed and net of a leg (leg_id, p, price in ticks, units, won), and its net if filled a cent worse.

    The side is that which p makes cheap; a tie is untraded, with nulls. Nets pay the fee of their price and one cent.
    """
    fair = F.round(F.col("p") * 10_000).cast("long")
    side = F.when(fair > F.col("price"), "yes").when(fair < F.col("price"), "no").otherwise("none")
    rows = rows.withColumn("side", side).withColumn("executed", F.when(F.col("side") == "yes", F.col("price")).when(F.col("side") == "no", 10_000 - F.col("price")))
    settled = F.when((F.col("side") == "yes") == (F.col("won") == 1), 10_000).otherwise(0)
    net = lambda worse: F.col("units") * (settled - F.col("executed") - worse - 100) - 10_000 * fee_cents("units", f"executed + {worse}")
    return rows.select("leg_id", "side", "executed", net(0).alias("net"), net(100).alias("walked_net"))


def sigma_band(rows: DataFrame, members: str, at: float, sigma: float, multipliers: list[float]) -> DataFrame:
    """The probability below a bound at several multiples of sigma, each widened by a reading's own error of 1: effective."""
    wide = {m: math.sqrt((sigma * m) ** 2 + 1) for m in multipliers}
    probabilities = F.array(*(F.struct(F.lit(m).alias("multiplier"), F.lit(s).alias("effective"), ensemble_cdf(members, at, s).alias("p")) for m, s in wide.items()))
    return rows.select("vec_id", F.explode(probabilities).alias("x")).select("vec_id", "x.multiplier", F.round("x.effective", 9).alias("effective"), F.round("x.p", 9).alias("p"))


def pseudo_members(centre: str, sigma: float, z: list[float]) -> Column:
    """A point forecast as an ensemble: normal quantiles scaled to a sample standard deviation of sigma."""
    values = np.array(z)
    scaled = values / values.std(ddof=1) * sigma
    return F.transform(F.array(*(F.lit(float(x)) for x in scaled)), lambda x: F.col(centre) + x)


def fills_by_decile(fills: DataFrame, start: str, at: str, end: str) -> DataFrame:
    """Fills by tenth of the time from start to end, split by side."""
    tenth = F.least(F.floor((F.col(at) - F.col(start)) * 10 / (F.col(end) - F.col(start))), F.lit(9)).cast("long")
    return fills.groupBy(tenth.alias("decile")).agg(F.count_if(F.col("side") == "yes").alias("yes"), F.count_if(F.col("side") == "no").alias("no"))


def fidelity_bounds(rows: DataFrame, by: list[str], a: str, b: str, limit: float) -> DataFrame:
    """Median distance of two probabilities by group, and whether it is within the limit."""
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.percentile(F.abs(F.col(a) - F.col(b)), F.lit(0.5)), 9).alias("median"))
    return out.withColumn("within", F.col("median") <= limit)


def stop_rules(rows: DataFrame, window: str, city: str, net: str) -> DataFrame:
    """Per window: total, cities that lost, and the verdict: stop if every city lost, watch if the total did."""
    by_city = rows.groupBy(window, city).agg(F.sum(net).alias("net"))
    out = by_city.groupBy(window).agg(F.sum("net").alias("net"), F.count_if(F.col("net") < 0).alias("losing"), F.count("*").alias("cities"), F.bool_and(F.col("net") < 0).alias("all_negative"))
    return out.withColumn("verdict", F.when(F.col("all_negative"), "stop").when(F.col("net") < 0, "watch").otherwise("go"))


def stake_columns(rows: DataFrame, bankroll_cents: int, percent: int) -> DataFrame:
    """Contracts to buy at a price in ticks given p: a fraction of Kelly, within a budget and the depth."""
    price, p = F.col("price") / 10_000, F.col("p")
    kelly = F.greatest((p - price) / (1 - price), F.lit(0.0))
    wanted = F.floor(F.round(kelly * percent / 100 * bankroll_cents * 100 / F.col("price"), 6))
    return rows.withColumn("kelly", F.round(kelly, 9)).withColumn("contracts", F.least(wanted, F.col("depth")).cast("long"))


def strategy_columns(rows: DataFrame) -> DataFrame:
    """The first reason, in a fixed order, not to trade; null to trade."""
    edge = F.col("p") * 10_000 - F.col("price")
    reason = F.when(F.col("depth") <= 0, "no_depth").when(F.col("price") < 500, "price_low").when(F.col("price") > 9500, "price_high").when(edge < 300, "edge").when(F.col("lead") > 40, "lead")
    return rows.withColumn("reason", reason)


def gate_columns(rows: DataFrame) -> DataFrame:
    """All gates that fail, in order, and whether none does."""
    gates = {"depth": F.col("depth") < 10, "price": (F.col("price") < 500) | (F.col("price") > 9500), "edge": F.col("p") * 10_000 - F.col("price") < 300, "lead": F.col("lead") > 40}
    failed = F.filter(F.array(*(F.when(test, F.lit(name)) for name, test in gates.items())), lambda x: x.isNotNull())
    return rows.withColumn("failed", F.array_join(failed, ",")).withColumn("passed", F.size(failed) == 0)

