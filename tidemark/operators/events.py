"""Event studies on observations and settlement: day windows, locks, reprice lags, quality control, reconciliation."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import fee_cents, quantile
from tidemark.plans.asof import asof_join
from tidemark.plans.intervals import interval_join, islands
from tidemark.plans.scan import before, following, running, total
from tidemark.plans.survival import censored_median

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US


def lst_day_window(days: DataFrame) -> DataFrame:
    """Start and end of each (tz, day) in local standard time, whatever the season: the offset of 15 January; days since 1970."""
    noon = F.make_timestamp(F.year(F.date_from_unix_date("day")), F.lit(1), F.lit(15), F.lit(12), F.lit(0), F.lit(0))
    offset = F.unix_micros(F.from_utc_timestamp(noon, F.col("tz"))) - F.unix_micros(noon)
    start = F.col("day").cast("long") * DAY_US - offset
    return days.select("*", start.alias("start_us"), (start + DAY_US).alias("end_us"))


def wall_clock_window(days: DataFrame) -> DataFrame:
    """Start and end of each (tz, day) from midnight to midnight by the clock."""
    midnight = lambda d: F.unix_micros(F.to_utc_timestamp(F.date_from_unix_date(d).cast("timestamp"), F.col("tz")))
    return days.select("*", midnight("day").alias("start_us"), midnight(F.col("day") + 1).alias("end_us"))


def lst_days(readings: DataFrame, stations: DataFrame) -> DataFrame:
    """Readings with the day of local standard time that their valid_us is in, as of lst_day_window; stations: station, tz.

    The offset is that of 15 January of the reading's year, summer or not. Readings of stations without a zone go.
    """
    noon = F.make_timestamp(F.year(F.timestamp_micros("valid_us")), F.lit(1), F.lit(15), F.lit(12), F.lit(0), F.lit(0))
    offset = F.unix_micros(F.from_utc_timestamp(noon, F.col("tz"))) - F.unix_micros(noon)
    return readings.join(stations, "station").withColumn("day", F.floor((F.col("valid_us") + offset) / DAY_US)).drop("tz")


def _with_day(readings: DataFrame, clock: str = "valid_us") -> DataFrame:
    """Readings with a day keep it; others are of the UTC day."""
    return readings if "day" in readings.columns else readings.withColumn("day", F.floor(F.col(clock) / DAY_US))


def running_extreme(readings: DataFrame, clock: str = "valid_us", low: bool = False) -> DataFrame:
    """Adds the extreme of the station's readings of their day so far, and the UTC day to those without a day."""
    rows = _with_day(readings, clock)
    order = Window.partitionBy("station", "day").orderBy(clock, "id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("extreme", (F.min if low else F.max)("tenths").over(order))


def records(rows: DataFrame, clock: str) -> DataFrame:
    """Of rows with station and day those, in order of the clock, that raise the maximum so far: all that a threshold can meet first."""
    order = Window.partitionBy("station", "day").orderBy(clock, "id").rowsBetween(Window.unboundedPreceding, -1)
    best = F.max("tenths").over(order)
    return rows.withColumn("_best", best).filter("tenths > _best or (_best is null and tenths is not null)").drop("_best")


def detect_locks(readings: DataFrame, strikes: DataFrame, margin: int, clock: str = "valid_us", low: bool = False, strict: bool = False) -> DataFrame:
    """Per strike the first reading whose running extreme clears it with a margin; clean, or ambiguous if only without.

    The extreme is the day's maximum, which is to reach the strike, or for a low ladder its minimum, which is to fall to
    it; strict asks for a tenth beyond it. Days are those of the readings (lst_days), else UTC days. t0 is when that
    reading was seen; strikes that no reading reaches are none. Readings without tenths don't count. Strikes meet only
    the readings that move their day's extreme, not all of the day's.
    """
    sign = -1 if low else 1
    rows = records(_with_day(readings, clock).withColumn("tenths", sign * F.col("tenths")), clock)
    bar = sign * F.col("strike") + int(strict)
    met = strikes.join(rows, ["station", "day"], "left").withColumn("cleared", F.col("tenths") >= bar + margin).withColumn("reached", F.col("tenths") >= bar)
    at = F.struct("seen_us", (sign * F.col("tenths")).alias("tenths"), "id")
    order = F.struct(clock, "id")
    out = met.groupBy("station", "day", "strike", "ticker").agg(F.min_by(F.when(F.col("cleared"), at), F.when(F.col("cleared"), order)).alias("c"), F.min_by(F.when(F.col("reached"), at), F.when(F.col("reached"), order)).alias("r"))
    kind = F.when(F.col("c").isNotNull(), "clean").when(F.col("r").isNotNull(), "ambiguous").otherwise("none")
    return out.select("station", "day", "strike", "ticker", kind.alias("kind"), F.col("c.seen_us").alias("t0_us"), F.col("c.tenths").alias("tenths"), F.col("c.id").alias("reading_id"))


def lock_supply(locks: DataFrame) -> DataFrame:
    """Per station and in all: strikes, those that lock clean, and those that stay ambiguous."""
    return locks.rollup("station").agg(F.count("*").alias("strikes"), F.count_if(F.col("kind") == "clean").alias("clean"), F.count_if(F.col("kind") == "ambiguous").alias("ambiguous"))


def reprice_lag(events: DataFrame, quotes: DataFrame, low2: int, high2: int, within_us: int, cadence_us: int = 600_000_000) -> DataFrame:
    """Time from each event (event_id, ticker, t0_us) to the first state after it with its doubled mid in the band.

    Returns the events with lag_us, null if there is none within within_us; no_mid, the states without a mid until then;
    and cadence_us, the median gap of the states in the cadence_us from the event on, null where there are fewer than
    three. Events without a ticker or time have no states: nulls and 0.
    """
    ends = lambda first, last: events.select("event_id", "ticker", (F.col("t0_us") + first).alias("a"), (F.col("t0_us") + last).alias("b")).filter("a is not null and ticker is not null")
    states = quotes.select("ticker", "us", "id", "mid2")
    spans = ends(1, within_us)
    inside = states.filter((F.col("mid2") >= low2) & (F.col("mid2") <= high2))
    first = interval_join(inside, spans, "us", "a", "b", within_us, by=["ticker"]).groupBy("event_id").agg(F.min(F.struct("us", "id")).alias("_hit"))
    until = spans.join(first, "event_id", "left").select("event_id", "ticker", "a", F.coalesce("_hit.us", "b").alias("b"), "_hit")
    before = F.col("_hit").isNull() | (F.struct("us", "id") < F.col("_hit"))
    without = interval_join(states.filter("mid2 is null"), until, "us", "a", "b", within_us, by=["ticker"]).filter(before).groupBy("event_id").agg(F.count("*").alias("no_mid"))
    own = Window.partitionBy("event_id")  # the states of a few minutes
    near = interval_join(states, ends(0, cadence_us), "us", "a", "b", cadence_us, by=["ticker"])
    gaps = near.withColumn("cadence_us", F.col("us") - F.lag("us").over(own.orderBy("us", "id"))).withColumn("n", F.count("*").over(own)).filter("n >= 3")
    out = events.join(first, "event_id", "left").join(without, "event_id", "left").join(quantile(gaps, ["event_id"], "cadence_us", 0.5, "even", "cadence_us"), "event_id", "left")
    return out.select(*events.columns, (F.col("_hit.us") - F.col("t0_us")).alias("lag_us"), F.coalesce("no_mid", F.lit(0)).alias("no_mid"), "cadence_us")


def lag_report(lags: DataFrame, series: Column, mislocked: Column, floored: Column) -> DataFrame:
    """Per series and pooled, of all events (scope raw) and of those not floored (scope net).

    Events, those never repriced, states without a mid, mislocked events and their rate, half-even quartile, median and
    90th percentile of the lags, the median cadence, and unreliable: a median of no more than 1.5 cadences. A null flag
    counts as false; without events there are no rows.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    rows = lags.select("lag_us", "no_mid", "cadence_us", yes(mislocked).alias("mislocked"), F.explode(F.array(series, F.lit("POOLED"))).alias("series"), yes(floored).alias("floored"))
    rows = rows.withColumn("scope", F.explode(F.when(F.col("floored"), F.array(F.lit("raw"))).otherwise(F.array(F.lit("raw"), F.lit("net")))))
    by = ["scope", "series"]
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("lag_us").isNull()).alias("never"), F.sum("no_mid").alias("no_mid"), F.count_if("mislocked").alias("mislocked"))
    for value, q, name in (("lag_us", 0.25, "p25_us"), ("lag_us", 0.5, "median_us"), ("lag_us", 0.9, "p90_us"), ("cadence_us", 0.5, "cadence_us")):
        out = out.join(quantile(rows, by, value, q, "even", name), by, "left")
    unreliable = F.coalesce(2 * F.col("median_us") <= 3 * F.col("cadence_us"), F.lit(False))
    return out.withColumns({"mislock_rate": F.round(F.col("mislocked") / F.col("n"), 9), "unreliable": unreliable})


def fillable_depth(events: DataFrame, quotes: DataFrame, latencies: list[int], cap_cents: int) -> DataFrame:
    """For each latency, contracts still to be had at the price that stood at the event.

    The stale quote is the last at or before t0; it is fillable if the first at or after t0 + latency has the same
    price; contracts are the lesser size, and no more than cap_cents buy. events: event_id, ticker, t0_us, won. Also
    the price, and what the contracts cost, their fee in cents, what they pay and the result, all but the fee in
    units times ticks; zeros where nothing is bought, a null price where none stood.
    """
    rows = events.withColumn("latency_us", F.explode(F.array(*(F.lit(x).cast("long") for x in latencies)))).withColumn("at_us", F.col("t0_us") + F.col("latency_us"))
    stale = quotes.select("ticker", "us", "id", F.col("yes_bid").alias("price"), F.col("yes_size").alias("size"))
    fresh = quotes.select("ticker", "us", "id", F.col("yes_bid").alias("price_then"), F.col("yes_size").alias("size_then"))
    rows = asof_join(rows, stale, ["ticker"], "t0_us", "us", ["price", "size"], tie="id")
    rows = asof_join(rows, fresh, ["ticker"], "at_us", "us", ["price_then", "size_then"], forward=True, tie="id")
    same = (F.col("price") > 0) & (F.col("price") == F.col("price_then"))
    most = F.expr(f"{cap_cents * 100}L * 100 div nullif(price, 0)")
    rows = rows.withColumn("units", F.when(same, F.least("size", "size_then", most)).otherwise(F.lit(0)).cast("long"))
    rows = rows.withColumns({"spent": F.col("units") * F.coalesce("price", F.lit(0)), "fee": fee_cents("units", "coalesce(price, 0)"), "payoff": F.col("units") * F.when(F.col("won"), 10_000).otherwise(0)})
    return rows.select("event_id", "ticker", "latency_us", "price", "units", "spent", "fee", "payoff", (F.col("payoff") - F.col("spent") - 10_000 * F.col("fee")).alias("pnl"))


def capture_report(captures: DataFrame, series: Column) -> DataFrame:
    """Sums of fillable_depth by series and latency: events, those with contracts, units, cost, fees, payoff and result."""
    sums = (F.sum(c).alias(c) for c in ("units", "spent", "fee", "payoff", "pnl"))
    return captures.groupBy(series.alias("series"), "latency_us").agg(F.count("*").alias("events"), F.count_if(F.col("units") > 0).alias("filled"), *sums)


def convergence_time(locks: DataFrame, quotes: DataFrame, low2: int, hold_us: int, window_us: int) -> DataFrame:
    """First instant from each lock on at which the doubled mid is in the band and stays there for hold_us.

    A run of states in the band lasts until the next state out of it; a ticker's last run has no end. Null if that would
    come later than window_us.
    """
    order = Window.partitionBy("ticker").orderBy("us", "id")
    rows = quotes.withColumn("on", F.coalesce(F.col("mid2") >= low2, F.lit(False))).withColumn("was", F.lag("on").over(order)).withColumn("next_us", F.lead("us").over(order))
    runs = islands(rows, ["ticker"], ["us", "id"], F.col("on") & ~F.coalesce("was", F.lit(False))).filter("on")
    runs = runs.groupBy("ticker", "island").agg(F.min("us").alias("from_us"), F.max_by("next_us", F.struct("us", "id")).alias("to_us"))
    long = runs.filter(F.col("to_us").isNull() | (F.col("to_us") - F.col("from_us") >= hold_us)).withColumn("end_us", F.coalesce("to_us", F.lit(2**62)))
    # runs don't overlap, so the last that begins by the lock is the only one it can lie in; else the first after it counts
    met = asof_join(locks.select("ticker", "lock_us").distinct(), long.withColumn("now_us", F.col("end_us")), ["ticker"], "lock_us", "from_us", ["now_us"], tie="end_us")
    met = asof_join(met, long.withColumn("then_us", F.col("from_us")), ["ticker"], "lock_us", "from_us", ["then_us"], forward=True, strict=True)
    at = F.when(F.col("lock_us") + hold_us <= F.col("now_us"), F.col("lock_us")).otherwise(F.col("then_us"))
    return met.withColumn("_at", at).select("ticker", "lock_us", F.when(F.col("_at") + hold_us <= F.col("lock_us") + window_us, F.col("_at") - F.col("lock_us")).alias("converged_us"))


def half_lives(converged: DataFrame, window_us: int) -> DataFrame:
    """Locks with how long each took, half_life_us: up to window_us where it did not converge, and then censored."""
    return converged.select("*", F.coalesce("converged_us", F.lit(window_us).cast("long")).alias("half_life_us"), F.col("converged_us").isNull().alias("censored"))


def convergence_readout(converged: DataFrame, window_us: int, series: Column) -> DataFrame:
    """Per series and POOLED: locks, those censored, and the product-limit median of their half-lives, null where half or more are."""
    rows = half_lives(converged, window_us).withColumn("series", F.explode(F.array(series, F.lit("POOLED")))).withColumn("_seen", ~F.col("censored"))
    return censored_median(rows, ["series"], "half_life_us", "_seen", "median_us")


def arrival_delay(readings: DataFrame, strikes: DataFrame) -> DataFrame:
    """Per strike, the time from when the station's maximum reached it to when a reading that shows it was first seen.

    The first runs on the clock of the readings, the second on that of their arrival; never where none reaches it.
    Strikes meet only the readings that raise the maximum, in order of either clock.
    """
    valid = detect_locks(readings, strikes, 0).select("station", "day", "strike", "reading_id")
    at = readings.select(F.col("id").alias("reading_id"), F.col("valid_us").alias("reached_us"))
    rows = _with_day(readings)
    arrivals = strikes.join(records(rows, "seen_us"), ["station", "day"]).filter(F.col("tenths") >= F.col("strike")).groupBy("station", "day", "strike").agg(F.min("seen_us").alias("seen_us"))
    out = valid.join(at, "reading_id", "left").join(arrivals, ["station", "day", "strike"], "left")
    kind = F.when(F.col("reached_us").isNull(), "never").when(F.col("seen_us") > F.col("reached_us"), "delayed").otherwise("at_once")
    return out.select("station", "day", "strike", kind.alias("kind"), (F.col("seen_us") - F.col("reached_us")).alias("delay_us"))


def _after_locks(prints: DataFrame, locks: DataFrame) -> DataFrame:
    """Prints with a side after a lock of their ticker, with the number of such locks and the price that the taker paid.

    A print after several locks counts for each; it takes their number along instead of meeting them.
    """
    counted = locks.filter("lock_us is not null").groupBy("ticker", "lock_us").agg(F.count("*").alias("n"))
    counted = counted.withColumn("locks", F.sum("n").over(Window.partitionBy("ticker").orderBy("lock_us")))
    rows = asof_join(prints.filter("taker_side <> ''"), counted, ["ticker"], "us", "lock_us", ["locks"], strict=True).filter("locks > 0")
    return rows.withColumn("paid", F.when(F.col("taker_side") == "yes", F.col("yes_price")).otherwise(10_000 - F.col("yes_price")))


def post_lock_flow(prints: DataFrame, locks: DataFrame) -> DataFrame:
    """Prints after their ticker's lock by the taker's side: fills, contracts and notional; once for each lock before."""
    rows = _after_locks(prints, locks)
    return rows.groupBy("taker_side").agg(F.sum("locks").alias("fills"), F.sum(F.col("units") * F.col("locks")).alias("units"), F.sum(F.col("units") * F.col("paid") * F.col("locks")).alias("notional"))


def post_lock_prices(prints: DataFrame, locks: DataFrame) -> DataFrame:
    """The same by the cent that the taker paid as well, rounded down, with the fees in cents."""
    rows = _after_locks(prints, locks).withColumn("fee", fee_cents("units", "paid"))
    sums = F.sum("locks").alias("fills"), F.sum(F.col("units") * F.col("locks")).alias("units"), F.sum(F.col("units") * F.col("paid") * F.col("locks")).alias("notional"), F.sum(F.col("fee") * F.col("locks")).alias("fees")
    return rows.groupBy("taker_side", F.floor(F.col("paid") / 100).alias("cent")).agg(*sums)


def qc_plausible_rate(readings: DataFrame, low: int = -400, high: int = 1400, per_minute: int = 15, width: int = 30 * DAY_US) -> DataFrame:
    """Readings as ok, implausible, or needs_confirmation where they changed faster than per_minute tenths since the one before."""
    rows = running(readings, ["station"], ["valid_us", "id"], width, {"_t": before(F.col("tenths")), "_us": before(F.col("valid_us"))})
    fast = F.abs(F.col("tenths") - F.col("_t")) * 60_000_000 > per_minute * (F.col("valid_us") - F.col("_us"))
    status = F.when((F.col("tenths") < low) | (F.col("tenths") > high), "implausible").when(fast, "needs_confirmation").otherwise("ok")
    return rows.select("id", "station", "valid_us", "tenths", status.alias("status"))


def qc_confirm(checked: DataFrame, within_us: int, apart: int = 10, width: int = 30 * DAY_US) -> DataFrame:
    """Readings that need it, confirmed if the station's next comes soon enough and close enough."""
    rows = following(checked, ["station"], ["valid_us", "id"], width, {"_t": F.col("tenths"), "_us": F.col("valid_us")})
    sure = F.coalesce((F.col("_us") - F.col("valid_us") <= within_us) & (F.abs(F.col("_t") - F.col("tenths")) <= apart), F.lit(False))
    return rows.filter("status = 'needs_confirmation'").select("id", "station", sure.alias("confirmed"))


def qc_stuck(readings: DataFrame, value: Column, least_us: int, width: int = 30 * DAY_US) -> DataFrame:
    """Runs of one value that span least_us or more."""
    order = ["valid_us", "id"]
    rows = running(readings.withColumn("value", value), ["station"], order, width, {"_was": before(F.col("value"))})
    starts = F.col("_was").isNull() | (F.col("_was") != F.col("value"))
    runs = running(rows, ["station"], order, width, {"island": total(F.when(starts, 1).otherwise(0))})
    return runs.groupBy("station", "island", "value").agg(F.min("valid_us").alias("first_us"), F.max("valid_us").alias("last_us"), F.count("*").alias("n")).filter(F.col("last_us") - F.col("first_us") >= least_us).drop("island")


def qc_neighbor(readings: DataFrame, neighbours: DataFrame, within_us: int, apart: int) -> DataFrame:
    """Readings with whether any neighbouring station has one close in time and value. neighbours: station, neighbour."""
    spans = readings.join(neighbours, "station").select("id", F.col("neighbour").alias("station"), "tenths", (F.col("valid_us") - within_us).alias("a"), (F.col("valid_us") + within_us).alias("b"))
    others = readings.select("station", F.col("valid_us").alias("other_us"), F.col("tenths").alias("other"))
    near = interval_join(others, spans, "other_us", "a", "b", within_us, by=["station"]).filter(F.abs(F.col("other") - F.col("tenths")) <= apart).select("id").distinct().withColumn("supported", F.lit(True))
    return readings.select("id").join(near, "id", "left").withColumn("supported", F.coalesce("supported", F.lit(False)))


def basis_compare(readings: DataFrame, official: DataFrame, least_minutes: int) -> DataFrame:
    """Each day's highest reading against the official one, where enough distinct minutes were read; valid within one degree, rounded half to even."""
    rows = _with_day(readings).groupBy("station", "day").agg(F.max("tenths").alias("high"), F.count_distinct(F.expr("valid_us div 60000000")).alias("minutes")).filter(F.col("minutes") >= least_minutes)
    delta = F.col("high") - F.col("official") * 10
    return rows.join(official, ["station", "day"]).withColumn("delta", delta).withColumn("valid", F.abs(F.bround(F.col("delta") / 10)) <= 1)


def basis_summary(compared: DataFrame) -> DataFrame:
    """Per station: days, 10th, 50th and 90th percentile of the difference at half-up ranks, and days that aren't valid."""
    out = compared.groupBy("station").agg(F.count("*").alias("n"), F.count_if(~F.col("valid")).alias("invalid"))
    for q in (10, 50, 90):
        out = out.join(quantile(compared, ["station"], "delta", q / 100, "up", f"p{q}"), "station")
    return out


def separating_strikes(a: str, b: str, strikes: list[int]) -> Column:
    """The strikes that exactly one of two readings is above."""
    return F.filter(F.array(*(F.lit(s).cast("long") for s in strikes)), lambda s: (F.col(a) > s) != (F.col(b) > s))


def straddle_entry(readings: DataFrame, official: DataFrame, strikes: DataFrame, closes: DataFrame) -> DataFrame:
    """Per day the first instant at which the running maximum is above the official value: entry_us, how, ticker, minutes_to_close.

    how is open where it is the day's first reading, else crossing. ticker is the market that settles the day: the one with
    the highest strike (station, day, strike, ticker) that the official value reaches, null if none. closes: station, day,
    close_us. Days are those of the readings (lst_days), else UTC days; days without such an instant have no row.
    """
    rows = running_extreme(readings).join(official, ["station", "day"])
    order = Window.partitionBy("station", "day").orderBy("valid_us", "id")
    over = rows.withColumn("n", F.row_number().over(order)).filter(F.col("extreme") > F.col("official") * 10)
    first = over.groupBy("station", "day").agg(F.min_by(F.struct("valid_us", "n"), F.struct("valid_us", "id")).alias("f"))
    settling = strikes.join(official, ["station", "day"]).filter(F.col("strike") <= F.col("official") * 10).groupBy("station", "day").agg(F.max_by("ticker", F.struct("strike", "ticker")).alias("ticker"))
    out = first.join(settling, ["station", "day"], "left").join(closes, ["station", "day"], "left")
    left = F.floor((F.col("close_us") - F.col("f.valid_us")) / 60_000_000)
    return out.select("station", "day", F.col("f.valid_us").alias("entry_us"), F.when(F.col("f.n") == 1, "open").otherwise("crossing").alias("how"), "ticker", left.alias("minutes_to_close"))


def straddle_histogram(entries: DataFrame, width: int = 60) -> DataFrame:
    """Entries by how they came about and by bins of width minutes to the close, from the bin's least: entries, and how many have a settling market."""
    return entries.groupBy("how", (F.floor(F.col("minutes_to_close") / width) * width).alias("from_minute")).agg(F.count("*").alias("entries"), F.count("ticker").alias("settling"))


def straddle_price(entries: DataFrame, quotes: DataFrame, least_units: int) -> DataFrame:
    """The quote in force at each entry (entry_id, ticker, at_us): ok, no_row, one_sided, or censored for want of size."""
    state = quotes.select("ticker", "us", "id", "yes_bid", "no_bid", "yes_size", "mid2")
    rows = asof_join(entries, state, ["ticker"], "at_us", "us", ["yes_bid", "yes_size", "mid2"], tie="id")
    status = F.when(F.col("yes_bid").isNull(), "no_row").when(F.col("mid2").isNull(), "one_sided").when(F.col("yes_size") < least_units, "censored").otherwise("ok")
    return rows.select("entry_id", "ticker", "at_us", "mid2", status.alias("status"))


def delta_partition(compared: DataFrame) -> DataFrame:
    """Days by the difference in whole degrees, and whether it is within one."""
    degrees = F.bround(F.col("delta") / 10).cast("long")
    return compared.groupBy(degrees.alias("degrees")).agg(F.count("*").alias("n"), F.sum("minutes").alias("minutes")).withColumn("within_one", F.abs("degrees") <= 1)


def mechanism_rates(flags: DataFrame, by: str, thresholds: dict[str, str]) -> DataFrame:
    """Of each key and mechanism the rate of its flag as numerator and denominator, cut off at six decimals, and whether it matches.

    thresholds: decimals as text by mechanism, in order of priority (from 0). A rate matches where numerator >= threshold *
    denominator, multiplied out in whole numbers, so no quotient is rounded. A null flag counts in the denominator alone.
    """
    listed = F.array(*(F.struct(F.lit(c).alias("mechanism"), F.lit(i).cast("long").alias("priority"), F.col(c).cast("long").alias("hit")) for i, c in enumerate(thresholds)))
    long = flags.select(by, F.explode(listed).alias("x")).select(by, "x.*")
    rates = long.groupBy(by, "mechanism", "priority").agg(F.coalesce(F.sum("hit"), F.lit(0)).alias("numerator"), F.count("*").alias("denominator"))
    exact = {c: Decimal(t).as_integer_ratio() for c, t in thresholds.items()}
    whole = lambda x: x.cast("decimal(38,0)")
    matched = F.lit(None).cast("boolean")
    for c, (n, d) in exact.items():
        matched = F.when(F.col("mechanism") == c, whole(F.col("numerator")) * F.lit(d) >= F.lit(n) * whole(F.col("denominator"))).otherwise(matched)
    return rates.withColumn("millionths", F.expr("numerator * 1000000 div denominator")).withColumn("matched", matched)


def first_matching(rates: DataFrame, by: str) -> DataFrame:
    """Of each key the mechanism of the first priority that matches, with its rate; null where none does."""
    found = F.min_by(F.when(F.col("matched"), F.struct("mechanism", "numerator", "denominator")), F.when(F.col("matched"), F.col("priority")))
    return rates.groupBy(by).agg(found.alias("m")).select(by, "m.mechanism", "m.numerator", "m.denominator")


def published_mechanism(rates: DataFrame, published: DataFrame, by: str) -> DataFrame:
    """Published rates (the key and millionths) with the mechanism that gives them, the first by priority; null where none does.

    A rate gives what is published if published <= numerator / denominator < published + a millionth, multiplied out.
    """
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    scaled = whole("numerator") * F.lit(1_000_000)
    met = published.select(by, F.col("millionths").alias("published")).join(rates.drop("millionths"), by, "left")
    gives = (whole("published") * whole("denominator") <= scaled) & (scaled < (whole("published") + 1) * whole("denominator"))
    return met.groupBy(by, "published").agg(F.min_by(F.when(gives, F.col("mechanism")), F.when(gives, F.col("priority"))).alias("mechanism"), F.count_if(gives).alias("candidates"))


def decode_agreement(published: DataFrame, decoded: DataFrame) -> DataFrame:
    """Minutes of two readings of one thing (station, minute, value): same, differing, absent from the second, extra in it."""
    both = published.withColumnRenamed("value", "p").join(decoded.withColumnRenamed("value", "d"), ["station", "minute"], "full")
    kind = F.when(F.col("d").isNull(), "absent").when(F.col("p").isNull(), "extra").when(F.col("p") == F.col("d"), "same").otherwise("differing")
    return both.groupBy("station").agg(*(F.count_if(kind == k).alias(k) for k in ("same", "differing", "absent", "extra")))


def window_difference(readings: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Highest reading of each station-day under two windows (station, day, start_us, end_us), half-open, where they differ."""

    def high(windows: DataFrame, name: str) -> DataFrame:
        spans = windows.select("station", "day", "start_us", "end_us")
        return interval_join(readings.select("station", "valid_us", "tenths"), spans, "valid_us", "start_us", "end_us", DAY_US, by=["station"], closed=False).groupBy("station", "day").agg(F.max("tenths").alias(name))

    return high(a, "high_a").join(high(b, "high_b"), ["station", "day"], "full").filter("not (high_a <=> high_b)")


def settle_trades(trades: DataFrame, official: DataFrame, settled: DataFrame | None = None) -> DataFrame:
    """Trades (trade_id, station, day, strike, side, units, price) with their outcome and profit in units * ticks; pending without an official value.

    Those whose trade_id is among settled are left out: they have been settled before. A null trade_id never is.
    """
    rows = trades if settled is None else trades.join(settled.select("trade_id").distinct(), "trade_id", "left_anti")
    rows = rows.join(official, ["station", "day"], "left").withColumn("yes", F.col("official") * 10 >= F.col("strike"))
    won = F.col("yes") == (F.col("side") == "yes")
    return rows.select("trade_id", F.when(F.col("yes").isNull(), "pending").when(won, "won").otherwise("lost").alias("outcome"), F.when(won, F.col("units") * (10_000 - F.col("price"))).when(~won, -F.col("units") * F.col("price")).alias("pnl"))


def observation_sidecar(readings: DataFrame, official: DataFrame) -> DataFrame:
    """Per station-day the readings in order, as text, with the minutes they are of, and the official value if there is one.

    Returns n, digest, missing (no official value), and of the index of decoded minutes of the UTC clock: minutes (how many),
    first_minute and last_minute. Days are those of the readings (lst_days), else UTC days.
    """
    order = F.array_sort(F.collect_list(F.struct("valid_us", "id", "tenths")))
    minute = F.floor(F.col("valid_us") / 60_000_000)
    rows = _with_day(readings).groupBy("station", "day").agg(order.alias("x"), F.count_distinct(minute).alias("minutes"), F.min(minute).alias("first_minute"), F.max(minute).alias("last_minute"))
    listed = F.array_join(F.transform("x", lambda r: F.concat_ws(":", r["id"].cast("string"), r["tenths"].cast("string"))), ",")
    return rows.join(official, ["station", "day"], "left").select("station", "day", F.size("x").cast("long").alias("n"), F.md5(listed).alias("digest"), F.col("official").isNull().alias("missing"), "minutes", "first_minute", "last_minute")
