"""Decision samples and panels: probes of the book around events, forecast legs, blended panels and settled orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.asof import asof_join
from tidemark.plans.intervals import interval_join

DAY_US = 86_400_000_000


def probe_event(events: DataFrame, quotes: DataFrame, gaps: DataFrame, offsets: list[int], low2: int, high2: int, within_us: int) -> DataFrame:
    """Doubled mids at t0 and some offsets after it, and the first time outside of (low2, high2); nothing counts from the first gap on."""
    rows = asof_join(events, gaps.filter("ticker <> ''").select("ticker", F.col("detected_us").alias("gap_us")), ["ticker"], "t0_us", "gap_us", ["gap_us"], forward=True, strict=True)
    rows = rows.withColumn("until_us", F.least(F.coalesce("gap_us", F.lit(2**62)), F.col("t0_us") + within_us + 1))
    state = quotes.select("ticker", "us", "id", "mid2")
    at = rows.withColumn("offset_us", F.explode(F.array(*(F.lit(o).cast("long") for o in offsets)))).withColumn("at_us", F.col("t0_us") + F.col("offset_us"))
    seen = asof_join(at, state, ["ticker"], "at_us", "us", ["mid2"], tie="id").withColumn("mid2", F.when(F.col("at_us") < F.col("until_us"), F.col("mid2")))
    wide = seen.groupBy("event_id").agg(*(F.max(F.when(F.col("offset_us") == o, F.col("mid2"))).alias(f"mid2_{i}") for i, o in enumerate(offsets)))
    spans = rows.select("event_id", "ticker", (F.col("t0_us") + 1).alias("a"), F.col("until_us").alias("b"))
    out = interval_join(quotes.filter((F.col("mid2") >= high2) | (F.col("mid2") <= low2)), spans, "us", "a", "b", within_us, by=["ticker"], closed=False).groupBy("event_id").agg(F.min("us").alias("band_us"))
    return rows.join(wide, "event_id").join(out, "event_id", "left").select("event_id", "ticker", "t0_us", *(f"mid2_{i}" for i in range(len(offsets))), (F.col("band_us") - F.col("t0_us")).alias("band_lag_us"))


def build_sample(closes: DataFrame, prints: DataFrame, lead_us: int, trail_us: int, stale_early_us: int, stale_late_us: int, era_us: int) -> DataFrame:
    """A leg for each close: the last print at or before close - lead, no staler than its era allows, and the prints and contracts of the time before."""
    legs = closes.withColumn("as_of", F.col("close_us") - lead_us)
    last = prints.select("ticker", "us", "id", F.col("yes_price").alias("entry_price"), F.col("us").alias("entry_us"))
    legs = asof_join(legs, last, ["ticker"], "as_of", "us", ["entry_price", "entry_us"], tie="id").withColumn("era", F.when(F.col("as_of") < era_us, "early").otherwise("late"))
    fresh = F.col("as_of") - F.col("entry_us") <= F.when(F.col("era") == "early", stale_early_us).otherwise(stale_late_us)
    legs = legs.filter(fresh)
    spans = legs.select("ticker", (F.col("as_of") - trail_us + 1).alias("a"), F.col("as_of").alias("b"))
    trail = interval_join(prints.select("ticker", "us", "units"), spans, "us", "a", "b", trail_us, by=["ticker"]).groupBy("ticker").agg(F.count("*").alias("trailing_prints"), F.sum("units").alias("trailing_units"))
    out = legs.join(trail, "ticker", "left")
    return out.select("ticker", "close_us", "as_of", "era", "entry_price", (F.col("as_of") - F.col("entry_us")).alias("stale_us"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("trailing_prints", "trailing_units")))


def class_highs(hourly: DataFrame, hours: int) -> DataFrame:
    """Highest hourly value of each station and day (station, day, hour, value) that has every hour; null otherwise."""
    rows = hourly.groupBy("station", "day").agg(F.count_distinct("hour").alias("n"), F.max("value").alias("most"))
    return rows.select("station", "day", "n", F.when(F.col("n") == hours, F.col("most")).alias("high"))


def lead_panel(legs: DataFrame, forecasts: DataFrame, members: list[str], weights: list[float]) -> DataFrame:
    """Per member and for the blend: legs, those that carry every member, and the Brier score over them.

    legs: leg_id, o. forecasts: leg_id, member, p.
    """
    wide = forecasts.groupBy("leg_id").agg(*(F.max(F.when(F.col("member") == m, F.col("p"))).alias(m) for m in members))
    rows = legs.join(wide, "leg_id", "left")
    blend = None
    for m, w in zip(members, weights, strict=True):
        blend = F.col(m) * w if blend is None else blend + F.col(m) * w
    each = F.array(*(F.struct(F.lit(m).alias("member"), F.col(m).alias("p")) for m in members), F.struct(F.lit("blend").alias("member"), blend.alias("p")))
    long = rows.select("leg_id", "o", blend.isNotNull().alias("whole"), F.explode(each).alias("x")).select("leg_id", "o", "whole", "x.*")
    error = (F.col("p") - F.col("o")) * (F.col("p") - F.col("o"))
    return long.groupBy("member").agg(F.count("p").alias("legs"), F.count_if("whole").alias("blendable"), F.round(F.avg(F.when(F.col("whole"), error)), 9).alias("brier"))


def tick_baseline(decisions: DataFrame, quotes: DataFrame) -> DataFrame:
    """Brier score of the last mid at or before each decision (ticker, as_of, o), and decisions without one."""
    rows = asof_join(decisions, quotes.filter("mid2 is not null").select("ticker", "us", "id", "mid2"), ["ticker"], "as_of", "us", ["mid2"], tie="id")
    p = F.col("mid2") / 20_000
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("mid2").isNull()).alias("unpriced"), F.round(F.avg((p - F.col("o")) * (p - F.col("o"))), 9).alias("brier"))


def settle_orders(orders: DataFrame, results: DataFrame) -> DataFrame:
    """Gross, fee and net cents of orders (order_id, key, side, units, price, fee) with a result (key, yes); open ones have nulls."""
    rows = orders.join(results, "key", "left")
    won = F.col("yes") == (F.col("side") == "yes")
    gross = F.when(won, F.col("units") * (100 - F.col("price"))).when(~won, -F.col("units") * F.col("price"))
    return rows.select("order_id", gross.alias("gross"), (gross - F.col("fee")).alias("net"))


def apply_spans(days: DataFrame, excluded: DataFrame) -> DataFrame:
    """Time of each day that is left once what is excluded is taken off: days (day), excluded (day, overlap_us)."""
    rows = days.join(excluded, "day", "left").withColumn("excluded_us", F.coalesce("overlap_us", F.lit(0)))
    return rows.select("day", "excluded_us", (F.lit(DAY_US) - F.col("excluded_us")).alias("span_us"))
