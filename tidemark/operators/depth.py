"""Quote studies: time-weighted depth, ladders of legs, arbitrage episodes and lead-lag between series."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import UNITS, fee_cents
from tidemark.operators.tape import touched
from tidemark.plans.asof import asof_join
from tidemark.plans.crossing import first_crossing
from tidemark.plans.intervals import islands
from tidemark.plans.keep import keep
from tidemark.plans.scan import following
from tidemark.plans.survival import censored_median

HOUR_US = 3_600_000_000


def held_pieces(quotes: DataFrame, exclusions: DataFrame | None = None, width: int = 24 * HOUR_US) -> DataFrame:
    """Each state in force until the ticker's next, however long that is, cut at the hours: its columns, slot (the hour) and held_us.

    A ticker's last state has no end and isn't counted. Pieces that touch exclusions (start_us, end_us) go, bounds included.
    """
    cells = following(quotes, ["ticker"], ["us", "id"], width, {"end_us": F.col("us")}).filter("end_us > us")
    cells = cells.withColumn("slot", F.explode(F.sequence(F.floor(F.col("us") / HOUR_US), F.floor((F.col("end_us") - 1) / HOUR_US))))
    cells = cells.withColumns({"_a": F.greatest("us", F.col("slot") * HOUR_US), "_b": F.least("end_us", (F.col("slot") + 1) * HOUR_US)})
    if exclusions is not None:
        cells = touched(cells, exclusions, "_a", "_b", "_out", width).filter("not _out").drop("_out")
    return cells.withColumn("held_us", F.col("_b") - F.col("_a")).drop("_a", "_b", "end_us")


def depth_cells(quotes: DataFrame, exclusions: DataFrame | None = None) -> DataFrame:
    """held_pieces by hour of day: ticker, hour, the quote and microseconds."""
    return held_pieces(quotes, exclusions).select("ticker", (F.col("slot") % 24).alias("hour"), "yes_bid", "no_bid", "yes_size", "held_us")


def depth_bins(cells: DataFrame, by: list[str], value: str) -> DataFrame:
    """Time at each value: mergeable bins from which quantiles over any coarser grouping follow."""
    return cells.groupBy(*by, value).agg(F.sum("held_us").alias("held_us"))


def depth_readout(cells: DataFrame) -> DataFrame:
    """Per hour and in all: time kept, share of it two-sided, and the time-weighted median size at the best bid."""
    two = F.when((F.col("yes_bid") > 0) & (F.col("no_bid") > 0), F.col("held_us")).otherwise(0)
    every = cells.withColumn("hour", F.explode(F.array(F.col("hour"), F.lit(-1).cast("long"))))
    bins = every.groupBy("hour", "yes_size").agg(F.sum("held_us").alias("held_us"), F.sum(two).alias("two_us"))
    own = Window.partitionBy("hour")
    bins = bins.withColumns({"_upto": F.sum("held_us").over(own.orderBy("yes_size")), "_all": F.sum("held_us").over(own)})
    median = F.min(F.when(F.col("_upto") >= F.col("_all") * 0.5, F.col("yes_size")))
    return bins.groupBy("hour").agg(F.sum("held_us").alias("kept_us"), F.sum("two_us").alias("two_sided_us"), median.alias("p50_size"))


def depth_cube(quotes: DataFrame, cities: DataFrame, exclusions: DataFrame, sides: tuple[str, ...] = ("yes", "no")) -> DataFrame:
    """Time-weighted depth of every city, time to close and hour of day, and of each of the three alone, by side.

    quotes: ticker, us, id, yes_bid, no_bid, and for each side its size, cum5, capacity and censored, with the side's name
    before them; cities: ticker, city. A ticker closes with its last state; buckets of the hours left end at 24 and 168.
    Pieces of states that touch an exclusion don't count. Returns scope (cell, city, bucket or hour), the three with '*'
    or -1 where they are summed over, side, kept_us, two_sided_us, the least and the median spread of two-sided states,
    the quartiles of the size at the best bid, of cum5 and of the capacity, the time for which the capacity was censored,
    and its median over that. Quantiles come from time at each value. Tickers without a city don't count.
    """
    rows = held_pieces(quotes, exclusions)
    rows = rows.join(quotes.groupBy("ticker").agg(F.max("us").alias("close_us")), "ticker").join(cities, "ticker")
    left = F.floor(F.col("close_us") / HOUR_US) - F.col("slot")
    bucket = F.when(left <= 24, "<=24h").when(left <= 168, "24-168h").otherwise(">168h")
    two = (F.col("yes_bid") > 0) & (F.col("no_bid") > 0)
    values = ("size", "cum5", "capacity", "censored")
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("side"), *(F.col(f"{s}_{v}").alias(v) for v in values)) for s in sides)))
    rows = rows.select("city", bucket.alias("bucket"), (F.col("slot") % 24).alias("hour"), F.when(two, 10_000 - F.col("yes_bid") - F.col("no_bid")).alias("spread"), "held_us", each.alias("x"))
    # every measure is time at its values, so that all of a cell comes from one table of bins
    measures = F.array(
        F.struct(F.lit("spread").alias("measure"), F.col("spread").alias("value")), *(F.struct(F.lit(v).alias("measure"), F.col(f"x.{v}").alias("value")) for v in ("size", "cum5", "capacity")),
        F.struct(F.lit("censored").alias("measure"), F.when(F.col("x.censored"), F.col("x.capacity")).alias("value")),
    )
    bins = rows.select("city", "bucket", "hour", "x.side", F.explode(measures).alias("m"), "held_us").select("city", "bucket", "hour", "side", "m.*", "held_us").filter("value is not null")
    bins = bins.groupBy("city", "bucket", "hour", "side", "measure", "value").agg(F.sum("held_us").alias("held_us"))
    no, none = F.lit("*"), F.lit(-1).cast("long")
    scopes = ("cell", F.col("city"), F.col("bucket"), F.col("hour")), ("city", F.col("city"), no, none), ("bucket", no, F.col("bucket"), none), ("hour", no, no, F.col("hour"))
    listed = F.array(*(F.struct(F.lit(n).alias("scope"), c.alias("city"), b.alias("bucket"), h.alias("hour")) for n, c, b, h in scopes))
    by = ["scope", "city", "bucket", "hour", "side"]
    every = bins.select(F.explode(listed).alias("y"), "side", "measure", "value", "held_us").select("y.*", "side", "measure", "value", "held_us")
    every = every.groupBy(*by, "measure", "value").agg(F.sum("held_us").alias("held_us"))
    own = Window.partitionBy(*by, "measure")
    every = every.withColumns({"_upto": F.sum("held_us").over(own.orderBy("value")), "_all": F.sum("held_us").over(own)})
    of = lambda m, c="held_us": F.when(F.col("measure") == m, F.col(c))
    at = lambda m, q: F.min(F.when((F.col("measure") == m) & (F.col("_upto") >= F.col("_all") * q), F.col("value")))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return every.groupBy(*by).agg(
        F.sum(of("size")).alias("kept_us"), zero(F.sum(of("spread"))).alias("two_sided_us"), F.min(of("spread", "value")).alias("least_spread"), zero(F.sum(of("censored"))).alias("censored_us"),
        at("spread", 0.5).alias("p50_spread"), at("censored", 0.5).alias("p50_censored"), *(at(v, q).alias(f"p{round(100 * q)}_{v}") for v in ("size", "cum5", "capacity") for q in (0.25, 0.5, 0.75)),
    )


def cumulative_depth(prices: str, sizes: str, ticks: int) -> Column:
    """Size within some ticks of the best, from arrays of prices, best first, and sizes."""
    near = F.filter(F.arrays_zip(F.col(prices).alias("p"), F.col(sizes).alias("s")), lambda x: x["p"] >= F.get(prices, F.lit(0)) - ticks)
    return F.aggregate(near, F.lit(0).cast("long"), lambda a, x: a + x["s"])


def walk_capacity(prices: str, sizes: str, slippage: int, levels: str) -> Column:
    """The most that can be sold into the levels at no more than some ticks of average slippage from the best.

    Down the levels it keeps what was taken and its total slippage; a level that would go beyond is taken in part.
    Returns a struct: capacity; censored, where all listed levels are taken and the book has more of them; and
    exhausted, where it has none. levels is the number of levels of the whole book. An empty book is exhausted at 0.
    """

    def step(a: Column, x: Column) -> Column:
        gap = F.get(prices, F.lit(0)) - x["p"] - slippage
        room = F.when(gap <= 0, x["s"]).otherwise(F.least(x["s"], F.floor(a["spare"] / F.when(gap > 0, gap))))
        room = F.when(a["open"], room).otherwise(F.lit(0).cast("long"))
        return F.struct((a["n"] + room).alias("n"), (a["spare"] - room * gap).alias("spare"), (a["open"] & (room == x["s"])).alias("open"))

    more = F.col(levels) > F.size(prices)
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("spare"), F.lit(True).alias("open"))
    return F.aggregate(F.arrays_zip(F.col(prices).alias("p"), F.col(sizes).alias("s")), start, step, lambda a: F.struct(a["n"].alias("capacity"), (a["open"] & more).alias("censored"), (a["open"] & ~more).alias("exhausted")))


def depth_at_price(prices: str, sizes: str, price: Column) -> Column:
    """Size at exactly a price; 0 where there is no such level."""
    return F.coalesce(F.get(sizes, F.array_position(F.col(prices), price).cast("int") - 1), F.lit(0).cast("long"))


def atm_pick(quotes: DataFrame, groups: DataFrame) -> DataFrame:
    """Of each group's tickers the one whose doubled mid has the least median distance from even; ties to the first name."""
    distance = quotes.filter("mid2 is not null").groupBy("ticker").agg(F.percentile(F.abs(F.col("mid2") - 10_000), F.lit(0.5)).alias("distance"))
    rank = F.row_number().over(Window.partitionBy("grp").orderBy("distance", "ticker"))
    return distance.join(groups, "ticker").withColumn("_n", rank).filter("_n = 1").drop("_n")


def classify_print(prints: DataFrame, quotes: DataFrame) -> DataFrame:
    """The side of the book a print hit: the yes bid, the no bid, or no_match; no_state before the first quote."""
    state = asof_join(prints, quotes.select("ticker", "us", "id", "yes_bid", "no_bid"), ["ticker"], "us", "us", ["yes_bid", "no_bid"], strict=True, tie="id")
    hit = F.when(F.col("yes_bid").isNull(), "no_state").when(F.col("yes_price") == F.col("yes_bid"), "yes").when(10_000 - F.col("yes_price") == F.col("no_bid"), "no").otherwise("no_match")
    return state.select("id", "ticker", hit.alias("hit"))


def replenishment(prints: DataFrame, quotes: DataFrame, closes: DataFrame, exclusions: DataFrame, within_us: int, width: int = 24 * HOUR_US) -> DataFrame:
    """What the prints that met one state of their ticker did to it, one row for each such state, or for none: status and, where depleted, the refill.

    prints: id, ticker, us, yes_price. quotes: ticker, us, id, the bids and the sizes at them; of states at one instant
    the last counts. closes: ticker, close_us. A state is hit on the side of the first of its prints whose price is that of
    a bid. status is the first that holds of no_pre_state, no_match, no_post_state (no state follows), past_close (the
    deadline, within_us after the print, is after the close, or there is none), screened (the time from the state to the
    deadline touches exclusions) and matched. A matched state is depleted if the next one has less than half of its size,
    and refilled at the first state by the deadline that has half of it again; refill_us counts from the print.
    """
    rank = F.row_number().over(Window.partitionBy("ticker", "us").orderBy(F.desc("id")))
    states = quotes.withColumn("_n", rank).filter("_n = 1").select("ticker", "us", "yes_bid", "no_bid", "yes_size", "no_size")
    later = following(states, ["ticker"], ["us"], width, {"post": F.struct("yes_size", "no_size")})
    later = later.withColumn("pre", F.struct(F.col("us").alias("at_us"), "yes_bid", "no_bid", "yes_size", "no_size", "post"))
    met = asof_join(prints.select("id", "ticker", "us", "yes_price"), later, ["ticker"], "us", "us", ["pre"])
    hit = F.when(F.col("yes_price") == F.col("pre.yes_bid"), "yes").when(10_000 - F.col("yes_price") == F.col("pre.no_bid"), "no")
    at = F.struct("us", "id")
    groups = met.withColumn("side", hit).groupBy("ticker", F.col("pre.at_us").alias("state_us")).agg(
        F.first("pre").alias("pre"), F.count("*").alias("prints"), F.min("us").alias("first_us"), F.min_by(F.when(F.col("side").isNotNull(), F.struct("us", "id", "side")), F.when(F.col("side").isNotNull(), at)).alias("m")
    )
    rows = groups.join(closes, "ticker", "left").withColumn("deadline_us", F.col("m.us") + within_us)
    rows = touched(rows, exclusions, "state_us", "deadline_us", "_out", width)
    status = F.when(F.col("state_us").isNull(), "no_pre_state").when(F.col("m").isNull(), "no_match").when(F.col("pre.post").isNull(), "no_post_state")
    status = status.when(F.col("close_us").isNull() | (F.col("deadline_us") > F.col("close_us")), "past_close").when(F.col("_out"), "screened").otherwise("matched")
    of_side = lambda c: F.when(F.col("m.side") == "yes", F.col(f"{c}.yes_size")).otherwise(F.col(f"{c}.no_size"))
    matched = F.col("status") == "matched"
    rows = rows.withColumn("status", status).select(
        "ticker", "state_us", "status", "prints", F.coalesce("m.us", "first_us").alias("print_us"), "close_us", "deadline_us", F.col("m.id").alias("print_id"), F.col("m.side").alias("side"),
        F.when(matched, of_side("pre")).alias("before"), F.when(matched, of_side("pre.post")).alias("after"),
    ).withColumn("depleted", F.coalesce(2 * F.col("after") < F.col("before"), F.lit(False)))
    rows = keep(rows)  # a row for each state that was met, read by the search and by the join with what it finds
    sizes = states.select("ticker", "us", F.explode(F.array(*(F.struct(F.lit(x).alias("side"), F.col(f"{x}_size").alias("size")) for x in ("yes", "no")))).alias("x")).select("ticker", "us", "x.*")
    refills = first_crossing(
        rows.filter("depleted"), sizes, ["ticker", "side"], name="print_id", at="state_us", until="deadline_us", level=F.col("before"), sign=F.lit(1), state_at="us", value=2 * F.col("size"), width=max(width, within_us)
    )
    out = rows.join(refills.withColumnRenamed("id", "print_id"), "print_id", "left")
    return out.select("ticker", "state_us", "status", "prints", "print_us", "close_us", "print_id", "side", "before", "after", "depleted", (F.col("crossed_us") - F.col("print_us")).alias("refill_us"))


def replenishment_readout(found: DataFrame, cities: DataFrame, within_us: int) -> DataFrame:
    """replenishment summed over each city and bucket of hours to the close, and over all: counters, the share refilled and its median time.

    Buckets end at 24 and 168 hours; without a close it is 'none'. Times are censored at within_us: the median is over all
    that were depleted, and null where no more than half were refilled in time. Tickers without a city have null as city.
    """
    left = F.col("close_us") - F.col("print_us")
    bucket = F.when(left.isNull(), "none").when(left <= 24 * HOUR_US, "<=24h").when(left <= 168 * HOUR_US, "24-168h").otherwise(">168h")
    rows = keep(found.join(cities, "ticker", "left").select("city", bucket.alias("bucket"), "status", "depleted", "refill_us"))
    scopes = F.array(F.struct(F.lit("cell").alias("scope"), F.col("city"), F.col("bucket")), F.struct(F.lit("all").alias("scope"), F.lit("*").alias("city"), F.lit("*").alias("bucket")))
    rows = rows.select(F.explode(scopes).alias("x"), "status", "depleted", "refill_us").select("x.*", "status", "depleted", "refill_us")
    by = ["scope", "city", "bucket"]
    counts = rows.groupBy(*by).agg(
        F.count("*").alias("groups"), *(F.count_if(F.col("status") == s).alias(s) for s in ("no_pre_state", "no_match", "no_post_state", "past_close", "screened", "matched")),
        F.count_if("depleted").alias("events"), F.count("refill_us").alias("refilled"),
    ).withColumn("fraction", F.round(F.try_divide("refilled", "events"), 9))
    times = rows.filter("depleted").withColumns({"_time": F.coalesce("refill_us", F.lit(within_us).cast("long")), "_seen": F.col("refill_us").isNotNull()})
    medians = censored_median(times, by, "_time", "_seen", "median_us").select(*(F.col(c).alias(f"_k_{c}") for c in by), "median_us")
    same = F.lit(True)
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return counts.join(medians, same, "left").drop(*(f"_k_{c}" for c in by))


def ladder_state_matrix(quotes: DataFrame, legs: DataFrame, seats: int, values: dict[str, str] | None = None, complete: bool = True) -> DataFrame:
    """Values of a group's legs, one column a seat, carried forward at every instant of any; complete: once all are known.

    legs: grp, ticker, seat from 0. values names the columns to carry: yes_bid as bid and yes_size as size, unless given.
    """
    values = values or {"bid": "yes_bid", "size": "yes_size"}
    rows = quotes.join(legs, "ticker")
    order = Window.partitionBy("grp").orderBy("us", "id").rowsBetween(Window.unboundedPreceding, 0)
    carried = [F.last(F.when(F.col("seat") == i, F.col(c)), ignorenulls=True).over(order).alias(f"{n}_{i}") for n, c in values.items() for i in range(seats)]
    known = rows.select("grp", "us", "id", *carried)
    return known.filter(" and ".join(f"{next(iter(values))}_{i} is not null" for i in range(seats))) if complete else known


def ladder_build(tickers: DataFrame, group: Column, seats: int, exact: bool = False) -> DataFrame:
    """The first seats tickers of every group, by name, of groups that have that many: grp, ticker, seat.

    With exact, only groups of just that many: then no ticker of a group is left out.
    """
    own = Window.partitionBy("grp")
    rows = tickers.select("ticker").distinct().withColumn("grp", group)
    return rows.withColumn("seat", (F.row_number().over(own.orderBy("ticker")) - 1).cast("long")).withColumn("n", F.count("*").over(own)).filter(F.col("n") == seats if exact else (F.col("n") >= seats) & (F.col("seat") < seats)).drop("n")


def ladder_by_strike(markets: DataFrame, legs: int = 6) -> DataFrame:
    """Ladders of events whose markets can all be read: grp, ticker, kind, strike, seat, in order of strikes.

    markets: of market_dimension (ticker, series, event_date, kind, strike, rejected). An event has a ladder if it has
    exactly so many markets, none rejected, of which one is below, one is above and the others are brackets, with no strike
    of a bracket twice. grp is series and date. The market below sits first and the one above last.
    """
    own = Window.partitionBy("series", "event_date")
    rows = markets.filter("series <> ''").withColumns({
        "_n": F.count("*").over(own), "_rejected": F.count_if("rejected").over(own), "_below": F.count_if(F.col("kind") == "below").over(own), "_above": F.count_if(F.col("kind") == "above").over(own),
        "_strikes": F.size(F.collect_set(F.when(F.col("kind") == "bracket", F.col("strike"))).over(own)),
    })
    rows = rows.filter((F.col("_n") == legs) & (F.col("_rejected") == 0) & (F.col("_below") == 1) & (F.col("_above") == 1) & (F.col("_strikes") == legs - 2))
    place = F.when(F.col("kind") == "below", 0).when(F.col("kind") == "above", 2).otherwise(1)
    seat = F.row_number().over(own.orderBy(place, "strike")) - 1
    return rows.select(F.concat_ws("-", "series", F.col("event_date").cast("string")).alias("grp"), "ticker", "kind", "strike", seat.cast("long").alias("seat"))


def arb_episodes(matrix: DataFrame, magnitude: Column, depth: Column) -> DataFrame:
    """Maximal runs of states with a positive magnitude and depth; each ends at the next state, the last is censored if there is none.

    Returns grp, start_us, end_us (null if censored), states, and the state with the largest magnitude, the first if tied.
    """
    runs = _runs(matrix.withColumns({"magnitude": magnitude, "depth": depth}), ["grp"])
    return runs.groupBy("grp", "island").agg(
        F.min("us").alias("start_us"), F.max_by("next_us", F.struct("us", "id")).alias("end_us"), F.count("*").alias("states"),
        F.min_by(F.struct("magnitude", "depth", F.col("id").alias("state_id")), F.struct(-F.col("magnitude"), "us", "id")).alias("w"),
    ).select("grp", "start_us", "end_us", "states", "w.*")


def _runs(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows (by, us, id, magnitude, depth) of positive magnitude and depth, with the run they belong to and when the next state came."""
    order = Window.partitionBy(*by).orderBy("us", "id")
    rows = rows.withColumn("on", (F.col("magnitude") > 0) & (F.col("depth") > 0)).withColumn("next_us", F.lead("us").over(order))
    rows = rows.withColumn("was", F.lag("on").over(order))
    return islands(rows, by, ["us", "id"], F.col("on") & ~F.coalesce("was", F.lit(False))).filter("on")


def _worst(rows: DataFrame, by: list[str], seats: int, persist_us: int, least_depth: int) -> DataFrame:
    """In each run the state of least excess; rows: by, us, id, magnitude, depth, and the array prices, one a leg, of at most seats."""
    legs = F.size("prices").cast("long")
    fees = sum((F.coalesce(fee_cents("depth", f"get(prices, {i})"), F.lit(0)) for i in range(seats)), F.lit(0).cast("long"))
    # one division of exact integers, so equal excesses tie
    excess = (F.col("magnitude") * F.col("depth") - UNITS * 100 * F.col("fees") - 100 * legs * F.col("depth")).cast("double") / (100 * F.col("depth")).cast("double")
    found = _runs(rows, by).withColumn("fees", fees).withColumn("excess", excess).groupBy(*by, "island").agg(
        F.min("us").alias("start_us"), F.max_by("next_us", F.struct("us", "id")).alias("end_us"),
        F.min_by(F.struct("magnitude", "depth", "fees", "excess", F.col("id").alias("state_id")), F.struct("excess", "us", "id")).alias("w"),
    ).select(*by, "start_us", "end_us", "w.*")
    held = F.coalesce(F.col("end_us") - F.col("start_us") >= persist_us, F.lit(False))
    return found.withColumn("tradeable", held & (F.col("excess") > 0) & (F.col("depth") >= least_depth))


def worst_states(matrix: DataFrame, magnitude: Column, depth: Column, prices: list[str], persist_us: int, least_depth: int) -> DataFrame:
    """In each episode, as of arb_episodes, the state with the least excess in cents, the first if tied.

    The excess is the magnitude less the taker fees of all legs at the state's depth and a tick of a cent a leg. An
    episode is tradeable if it lasts persist_us, its excess is positive and its depth there is least_depth; one that is
    censored is not.
    """
    rows = matrix.select("grp", "us", "id", magnitude.alias("magnitude"), depth.alias("depth"), F.array(*prices).alias("prices"))
    return _worst(rows, ["grp"], len(prices), persist_us, least_depth)


#: What is carried for every leg of a ladder so that all three streams can be told.
LEG_VALUES = {"bid": "yes_bid", "size": "yes_size", "no": "no_bid", "no_size": "no_size"}


def arb_streams(matrix: DataFrame, seats: int) -> DataFrame:
    """The three ways in which a ladder's prices disagree, stacked: grp, us, id, stream, live, magnitude, depth, prices.

    matrix: states of LEG_VALUES, complete or not; seats are in order of strike, the first leg below and the last above.
    sum_buy: a whole less all asks, an ask being a whole less the bid for no; sum_sell: all bids less a whole;
    monotonicity: the bids of the two outer legs less a whole. A stream is live where all of its legs are known; where
    it is not, its magnitude and depth are null.
    """
    every = range(seats)
    total = lambda columns: sum(columns[1:], columns[0])
    asks = [10_000 - F.col(f"no_{i}") for i in every]
    bids, sizes = [F.col(f"bid_{i}") for i in every], [F.col(f"size_{i}") for i in every]
    ends = (0, seats - 1)
    kinds = {
        "sum_buy": (10_000 - total(asks), F.least(*(F.col(f"no_size_{i}") for i in every)), asks, every),
        "sum_sell": (total(bids) - 10_000, F.least(*sizes), bids, every),
        "monotonicity": (bids[0] + bids[-1] - 10_000, F.least(sizes[0], sizes[-1]), [bids[0], bids[-1]], ends),
    }
    states = []
    for name, (magnitude, depth, prices, legs) in kinds.items():
        live = F.expr(" and ".join(f"bid_{i} is not null and no_{i} is not null" for i in legs))
        states.append(F.struct(F.lit(name).alias("stream"), live.alias("live"), F.when(live, magnitude).alias("magnitude"), F.when(live, depth).alias("depth"), F.array(*prices).alias("prices")))
    return matrix.select("grp", "us", "id", F.explode(F.array(*states)).alias("s")).select("grp", "us", "id", "s.*")


def stream_episodes(streams: DataFrame, seats: int, persist_us: int, least_depth: int) -> DataFrame:
    """Episodes of every stream of every ladder with their worst states, as of worst_states; states that aren't live are passed over."""
    return _worst(streams.filter("live"), ["stream", "grp"], seats, persist_us, least_depth)


def stream_summary(streams: DataFrame, episodes: DataFrame) -> DataFrame:
    """Per stream: episodes found, kept (those that ended), censored and tradeable, states that aren't live, and nearest ranks of the kept ones' excess and time.

    A stream without episodes has counts of 0 and null ranks.
    """
    dead = streams.groupBy("stream").agg(F.count_if(~F.col("live")).alias("incomplete"))
    kept = F.col("end_us").isNotNull()
    ended = episodes.withColumn("x", F.when(kept, F.col("excess"))).withColumn("held", F.col("end_us") - F.col("start_us"))
    rank = lambda column, q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {column})")
    found = ended.groupBy("stream").agg(
        F.count("*").alias("found"), F.count_if(kept).alias("kept"), F.count_if(~kept).alias("censored"), F.count_if("tradeable").alias("tradeable"), F.min("x").alias("least"),
        *(rank("x", q / 100).alias(f"p{q}") for q in (25, 50, 75, 90)), F.max("x").alias("most"), *(rank("held", q / 100).cast("long").alias(f"p{q}_us") for q in (50, 90)),
    )
    return dead.join(found, "stream", "left").fillna(0, ["found", "kept", "censored", "tradeable"])


def episode_summary(episodes: DataFrame, persist_us: int) -> DataFrame:
    """Episodes found, those that lasted long enough, those censored, and nearest-rank quantiles of the largest magnitude."""
    pick = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY magnitude)").cast("long")
    held = F.col("end_us") - F.col("start_us")
    return episodes.agg(F.count("*").alias("found"), F.count_if(held >= persist_us).alias("tradeable"), F.count_if(F.col("end_us").isNull()).alias("censored"), F.min("magnitude").alias("least"), pick(0.5).alias("p50"), pick(0.9).alias("p90"), F.max("magnitude").alias("most"))


def _crossings(within_us: int, move2: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ticker, seen, low, high = None, deque(), deque(), deque()
        for batch in batches:
            out = []
            for t, i, us, mid2 in zip(*(batch.column(c).to_pylist() for c in ("ticker", "id", "us", "mid2")), strict=True):
                if t != ticker:
                    ticker = t
                    for q in (seen, low, high):
                        q.clear()
                for q in (seen, low, high):
                    while q and us - q[0][1] > within_us:
                        q.popleft()
                # of the open anchors the lowest and the highest say whether any is far enough; the oldest that is counts
                if low and (mid2 - low[0][2] >= move2 or high[0][2] - mid2 >= move2):
                    hit = next(a for a in seen if abs(mid2 - a[2]) >= move2)
                    out.append((t, hit[0], hit[1], i, us, 1 if mid2 > hit[2] else -1))
                    for q in (seen, low, high):
                        q.clear()
                    continue
                anchor = (i, us, mid2)
                seen.append(anchor)
                while low and low[-1][2] >= mid2:
                    low.pop()
                low.append(anchor)
                while high and high[-1][2] <= mid2:
                    high.pop()
                high.append(anchor)
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["ticker", "anchor_id", "anchor_us", "crossing_id", "us", "direction"])

    return run


def leader_crossings(quotes: DataFrame, within_us: int, move2: int) -> DataFrame:
    """Moves of a ticker's doubled mid by move2 within within_us of an earlier state, none overlapping another.

    Greedy in time, so a fold: rows are sorted by ticker and time in their partition, and only the anchors of the last
    within_us are held, with queues of their lowest and highest. The next anchor comes strictly after a crossing.
    """
    rows = quotes.filter("mid2 is not null").select("ticker", "id", "us", "mid2").repartition("ticker").sortWithinPartitions("ticker", "us", "id")
    return rows.mapInArrow(_crossings(within_us, move2), "ticker string, anchor_id long, anchor_us long, crossing_id long, us long, direction int")


def follower_response(crossings: DataFrame, quotes: DataFrame, pairs: DataFrame, within_us: int, move2: int) -> DataFrame:
    """For each crossing of a leader, when its follower first moved as far the same way from where it was, in within_us.

    pairs: ticker, follower, each once. A follower without a two-sided state by the crossing has no row. Each crossing waits with its
    own level, and nothing is paired with the states in between.
    """
    two_sided = quotes.filter("mid2 is not null")
    rows = keep(crossings).join(pairs, "ticker")
    base = two_sided.select(F.col("ticker").alias("follower"), "us", "id", F.col("mid2").alias("base2"))
    rows = asof_join(rows, base, ["follower"], "us", "us", ["base2"], tie="id").filter("base2 is not null")
    rows = rows.withColumns({"_name": F.concat_ws(":", "crossing_id", "follower"), "_until": F.col("us") + within_us})
    later = two_sided.select(F.col("ticker").alias("follower"), F.col("us").alias("later_us"), "mid2")
    first = first_crossing(rows, later, ["follower"], name="_name", at="us", until="_until", level=F.col("base2") + move2 * F.col("direction"), sign=F.col("direction"), state_at="later_us", value=F.col("mid2"), width=within_us)
    out = rows.join(first.withColumnRenamed("id", "_name"), "_name", "left")
    return out.select("ticker", "follower", "crossing_id", "anchor_us", "us", "direction", (F.col("crossed_us") - F.col("us")).alias("lead_us"))


def pair_lead_lag(quotes: DataFrame, pairs: DataFrame, exclusions: DataFrame, within_us: int, move2: int, response_us: int, response2: int) -> DataFrame:
    """How the tickers of each pair lead each other, forward and reverse, by pair, by corridor and by corridor and day.

    pairs: corridor, upstream, downstream, each once. Forward the upstream leads. An episode is a crossing of the leader
    (within_us, move2) with a response (response_us, response2); one whose time from the leader's anchor to the response
    touches exclusions is screened. Returns scope (pair, corridor, day), reading, corridor, leader and follower ('*' but
    for pairs), day (-1 but for days), crossings, episodes, screened and the median lead of the episodes that are kept.
    """
    ways = F.array(*(F.struct(F.lit(r).alias("reading"), F.col(a).alias("ticker"), F.col(b).alias("follower")) for r, a, b in (("forward", "upstream", "downstream"), ("reverse", "downstream", "upstream"))))
    ways = pairs.select("corridor", F.explode(ways).alias("x")).select("corridor", "x.*")
    found = follower_response(leader_crossings(quotes, within_us, move2), quotes, ways.select("ticker", "follower").distinct(), response_us, response2)
    found = touched(found.withColumn("_end", F.col("us") + F.col("lead_us")), exclusions, "anchor_us", "_end", "_out")
    rows = found.join(ways, ["ticker", "follower"]).withColumn("_day", F.floor(F.col("us") / (24 * HOUR_US)))
    any_, none = F.lit("*"), F.lit(-1).cast("long")
    scopes = ("pair", F.col("ticker"), F.col("follower"), none), ("corridor", any_, any_, none), ("day", any_, any_, F.col("_day"))
    listed = F.array(*(F.struct(F.lit(n).alias("scope"), a.alias("leader"), b.alias("follower"), d.alias("day")) for n, a, b, d in scopes))
    rows = rows.select("reading", "corridor", F.explode(listed).alias("y"), "lead_us", "_out").select("reading", "corridor", "y.*", "lead_us", "_out")
    heard = F.col("lead_us").isNotNull()
    return rows.groupBy("scope", "reading", "corridor", "leader", "follower", "day").agg(
        F.count("*").alias("crossings"), F.count_if(heard & ~F.col("_out")).alias("episodes"), F.count_if(heard & F.col("_out")).alias("screened"),
        F.percentile(F.when(~F.col("_out"), F.col("lead_us")), F.lit(0.5)).alias("median_lead_us"),
    )
