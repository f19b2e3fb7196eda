"""Trade prints: hygiene, anchors on the book, horizon mark-outs, queues, fills and exposures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import fee_cents
from tidemark.plans.asof import asof_join
from tidemark.plans.intervals import interval_join, merge_intervals
from tidemark.plans.scan import before, running, total

DAY_US = 86_400_000_000


def first_prints(prints: DataFrame) -> DataFrame:
    """Prints with a side, one for each trade_id: the one with the lowest id."""
    rank = F.row_number().over(Window.partitionBy("trade_id").orderBy("id"))
    return prints.filter("taker_side <> ''").withColumn("_n", rank).filter("_n = 1").drop("_n")


def print_hygiene(prints: DataFrame) -> DataFrame:
    """Counts of rows, of those without a side, of repeats of a trade_id among the rest, and of what is kept."""
    sided = F.col("taker_side") != ""
    return prints.agg(F.count("*").alias("n_rows"), F.count_if(~sided).alias("empty_side"), F.count_distinct(F.when(sided, F.col("trade_id"))).alias("kept")).withColumn("duplicates", F.col("n_rows") - F.col("empty_side") - F.col("kept"))


def count_trades(prints: DataFrame, exclusions: DataFrame, width: int = 3_600_000_000) -> DataFrame:
    """Per side: rows outside of the half-open exclusions, distinct trade ids, and rows that repeat one."""
    merged = merge_intervals(exclusions, "start_us", "end_us")
    kept = interval_join(prints, merged, "us", "start_us", "end_us", width, closed=False, how="left_anti")
    return kept.groupBy("taker_side").agg(F.count("*").alias("n_rows"), F.count_distinct("trade_id").alias("trades")).withColumn("surplus", F.col("n_rows") - F.col("trades"))


def resolve_anchors(prints: DataFrame, tape: DataFrame) -> DataFrame:
    """The first book row that the exchange stamped later than a print.

    Exchange stamps go back now and then, so their running maximum over the ticker's rows is searched. If a snapshot
    lies between the print's arrival and the row found, the first row that arrived after the print is taken instead.
    """
    so_far = Window.partitionBy("ticker").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    book = tape.select("ticker", "id", "us", F.max("ts_ms").over(so_far).alias("stamp"), F.sum(F.col("is_snapshot").cast("long")).over(so_far).alias("snapshots"))
    by_stamp = book.filter("stamp is not null").select("ticker", "stamp", "id", F.struct("id", "us", "snapshots").alias("stamped"))
    by_time = book.select("ticker", "us", "id", F.struct("id", "us").alias("arrived"))
    seen = book.select("ticker", "us", "id", "snapshots")
    rows = prints.withColumn("ms", F.expr("us div 1000"))
    rows = asof_join(rows, by_stamp, ["ticker"], "ms", "stamp", ["stamped"], forward=True, strict=True, tie="id")
    rows = asof_join(rows, by_time, ["ticker"], "us", "us", ["arrived"], forward=True, strict=True, tie="id")
    rows = asof_join(rows, seen, ["ticker"], "us", "us", ["snapshots"], tie="id")
    crossed = F.coalesce(F.col("stamped.snapshots") > F.coalesce("snapshots", F.lit(0)), F.lit(True))
    pick = lambda c: F.when(crossed, F.col(f"arrived.{c}")).otherwise(F.col(f"stamped.{c}"))
    return rows.select(*prints.columns, pick("id").alias("anchor_id"), pick("us").alias("anchor_us"), F.when(pick("id").isNotNull(), crossed).alias("host_clock"))


def horizon_windows(prints: DataFrame, quotes: DataFrame, anchor: str, horizons: list[int]) -> DataFrame:
    """For every horizon the doubled mid in force at the anchor and at its end; status names what is missing.

    No state is in force after a ticker's last row, so an end beyond it is uncovered.
    """
    rows = prints.withColumn("horizon_us", F.explode(F.array(*(F.lit(h).cast("long") for h in horizons)))).withColumn("end_us", F.col(anchor) + F.col("horizon_us"))
    start = quotes.select("ticker", "us", "id", F.col("mid2").alias("mid2_start"))
    end = quotes.select("ticker", "us", "id", F.col("mid2").alias("mid2_end"))
    last = quotes.groupBy("ticker").agg(F.max("us").alias("last_us"))
    anchored = rows.filter(F.col(anchor).isNotNull())
    out = asof_join(anchored, start, ["ticker"], anchor, "us", ["mid2_start"], tie="id")
    out = asof_join(out, end, ["ticker"], "end_us", "us", ["mid2_end"], tie="id").join(last, "ticker", "left")
    status = F.when(F.col("end_us") > F.col("last_us"), "uncovered").when(F.col("mid2_start").isNull() | F.col("mid2_end").isNull(), "one_sided").otherwise("ok")
    out = out.withColumn("status", status).drop("last_us")
    missing = rows.filter(F.col(anchor).isNull()).select("*", *(F.lit(None).cast(t).alias(c) for c, t in out.dtypes if c not in rows.columns and c != "status"), F.lit("unresolved").alias("status"))
    return out.unionByName(missing)


def signed_move2() -> Column:
    """The move of the doubled mid in the taker's favour."""
    return (F.col("mid2_end") - F.col("mid2_start")) * F.when(F.col("taker_side") == "yes", 1).otherwise(-1)


def print_net_cents(windows: DataFrame) -> DataFrame:
    """Net of a print in 1/20000 cent: contracts times half the doubled move, less the fee in and out."""
    gross = F.col("units") * signed_move2()
    price = F.expr("CASE WHEN taker_side = 'yes' THEN yes_price ELSE 10000 - yes_price END")
    fee = fee_cents("units", "price")
    return windows.filter("status = 'ok'").withColumn("price", price).withColumn("fee", fee).withColumn("net", (gross - 2 * 20_000 * F.col("fee")).cast("long"))


def flow_means(nets: DataFrame, splits: DataFrame) -> DataFrame:
    """Contract-weighted mean net of a print in cents, by split and horizon; splits: day, split. Days without a split go."""
    rows = nets.withColumn("day", F.floor(F.col("us") / DAY_US)).join(splits, "day")
    sums = rows.groupBy("split", "horizon_us").agg(F.count("*").alias("prints"), F.sum("units").alias("weight"), F.sum("net").alias("total"))
    return sums.filter("weight > 0").withColumn("mean_cents", F.round(F.col("total") / (200 * F.col("weight")), 9))


def flow_clusters(nets: DataFrame) -> DataFrame:
    """Net and weight of every ticker and horizon; those without weight go."""
    return nets.groupBy("ticker", "horizon_us").agg(F.sum("net").alias("total"), F.sum("units").alias("weight")).filter("weight > 0")


def ts_violations(tape: DataFrame) -> DataFrame:
    """Per ticker, deltas whose exchange stamp is before that of the delta before."""
    back = F.col("ts_ms") < F.lag("ts_ms").over(Window.partitionBy("ticker").orderBy("id"))
    return tape.filter("not is_snapshot").withColumn("_back", back).groupBy("ticker").agg(F.count_if("_back").alias("violations"), F.count("*").alias("deltas"))


def near_events(prints: DataFrame, events: DataFrame, reach: int) -> DataFrame:
    """Prints by where they lie from their ticker's event (ticker, lock_us): inside reach, outside_lock or no_lock."""
    rows = prints.join(events, "ticker", "left")
    where = F.when(F.col("lock_us").isNull(), "no_lock").when(F.abs(F.col("us") - F.col("lock_us")) <= reach, "inside").otherwise("outside_lock")
    return rows.withColumn("stratum", where)


def near_counts(stratum: DataFrame, universe: DataFrame) -> DataFrame:
    """Prints of near_events by where they lie; off_universe where their ticker (of universe) isn't one of the study's, whatever its event."""
    rows = stratum.join(universe.select("ticker", F.lit(True).alias("_in")).distinct(), "ticker", "left")
    where = F.when(F.col("_in").isNull(), "off_universe").otherwise(F.col("stratum"))
    return rows.groupBy(where.alias("stratum")).agg(F.count("*").alias("prints"), F.count_distinct("ticker").alias("tickers"))


def near_flow(prints: DataFrame, events: DataFrame, universe: DataFrame, reach: int, tape: DataFrame, quotes: DataFrame, horizons: list[int]) -> DataFrame:
    """flow_clusters of the prints of the universe's tickers within reach of their ticker's event: anchors, horizons and nets are those prints' alone."""
    inside = near_events(prints.join(universe.select("ticker").distinct(), "ticker", "left_semi"), events, reach).filter("stratum = 'inside'").select(*prints.columns)
    return flow_clusters(print_net_cents(horizon_windows(resolve_anchors(inside, tape), quotes, "anchor_us", horizons)))


def placement_grid(closes: DataFrame, every: int = 900_000_000, hours: int = 24, n: int = 48) -> DataFrame:
    """n instants every so often from some hours before each close, on multiples of the step."""
    first = F.ceil((F.col("close_us") - hours * 3_600_000_000) / every).cast("long")
    return closes.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("at_us", (first + F.col("slot")) * every)


def queue_clear(orders: DataFrame, quotes: DataFrame, prints: DataFrame, rest_us: int) -> DataFrame:
    """When an order that rests at the best bid of either side fills: at the print with which takers of the other side have taken more than the queue.

    orders: order_id, ticker, at_us; each rests once for yes and once for no, at the bid in force then, if both sides are
    live, behind the size at it, until that bid changes, rest_us at most. Takers count at the order's price alone, from
    at_us on. Returns order_id, ticker, side, at_us, price, queue, end_us, fill_us (null if it doesn't fill).

    What takers have taken of a (ticker, side, price) so far is an axis of volume: an order is put on it where it begins,
    and the first print beyond that and its queue is looked up there, so no order meets the prints it waits through.
    """
    sides = ("yes", "no")
    live = (F.col("yes_bid") > 0) & (F.col("no_bid") > 0) & (F.col("yes_size") > 0) & (F.col("no_size") > 0)
    state = quotes.select("ticker", "us", "id", F.when(live, F.struct(*(f"{x}_{v}" for x in sides for v in ("bid", "size")))).alias("state"))
    rest = asof_join(orders, state, ["ticker"], "at_us", "us", ["state"], tie="id").filter("state is not null")
    rest = rest.withColumn("x", F.explode(F.array(*(F.struct(F.lit(x).alias("side"), F.col(f"state.{x}_bid").alias("price"), F.col(f"state.{x}_size").alias("queue")) for x in sides)))).select(*orders.columns, "x.*")
    bids = F.explode(F.array(*(F.struct(F.lit(x).alias("side"), F.col(f"{x}_bid").alias("bid")) for x in sides)))
    moves = running(quotes.select("ticker", "us", "id", bids.alias("x")).select("ticker", "us", "id", "x.*"), ["ticker", "side"], ["us", "id"], 30 * DAY_US, {"_was": before(F.col("bid"))})
    changes = moves.filter(F.col("_was").isNull() | (F.col("_was") != F.col("bid"))).select("ticker", "side", F.col("us").alias("change_us"), "id")
    rest = asof_join(rest, changes, ["ticker", "side"], "at_us", "change_us", ["change_us"], forward=True, strict=True, tie="id")
    rest = rest.withColumn("end_us", F.least(F.col("at_us") + rest_us, F.coalesce("change_us", F.col("at_us") + rest_us)))
    # who takes no hits resting yes, at its price
    taken = prints.filter("taker_side in ('yes', 'no')").select(
        "ticker", "us", "id", "units", F.when(F.col("taker_side") == "no", "yes").otherwise("no").alias("side"), F.when(F.col("taker_side") == "no", F.col("yes_price")).otherwise(10_000 - F.col("yes_price")).alias("price")
    )
    level = ["ticker", "side", "price"]
    axis = running(taken, level, ["us", "id"], 30 * DAY_US, {"volume": total(F.col("units"))})
    upto = axis.select(*level, "us", "id", F.col("volume").alias("gone"))
    placed = asof_join(rest, upto, level, "at_us", "us", ["gone"], strict=True, tie="id").withColumn("_goal", F.coalesce("gone", F.lit(0)) + F.col("queue"))
    met = asof_join(placed, axis.select(*level, "volume", F.col("us").alias("print_us")), level, "_goal", "volume", ["print_us"], forward=True, strict=True, tie="print_us")
    return met.select("order_id", "ticker", "side", "at_us", "price", "queue", "end_us", F.when(F.col("print_us") <= F.col("end_us"), F.col("print_us")).alias("fill_us"))


def maker_edge(fills: DataFrame, quotes: DataFrame, horizons: list[int]) -> DataFrame:
    """Per side and horizon: fills, those without a mid, and the sums of mark-out, in the side's favour, and maker fee of one contract.

    edge is the mean over fills with mids of half a cent and the mark-out less the maker fee, in cents; edge_taker pays
    the taker fee instead. Both are null where no fill has mids.
    """
    rows = fills.filter("fill_us is not null")
    marked = horizon_windows(rows, quotes, "fill_us", horizons)
    fee = fee_cents("100", "price", maker=True)
    marked = marked.withColumn("fee", fee).withColumn("taker", fee_cents("100", "price")).withColumn("move2", F.when(F.col("status") == "ok", (F.col("mid2_end") - F.col("mid2_start")) * F.when(F.col("side") == "yes", 1).otherwise(-1)))
    edge = lambda c: F.round(0.5 + F.sum("move2") / (200 * F.count("move2")) - F.sum(F.when(F.col("move2").isNotNull(), F.col(c))) / F.count("move2"), 9)
    return marked.groupBy("side", "horizon_us").agg(edge("fee").alias("edge"), edge("taker").alias("edge_taker"), F.count("*").alias("fills"), F.count_if(F.col("status") != "ok").alias("no_mid"), F.sum("move2").alias("move2"), F.sum("fee").alias("fees"))


def exposure_rollup(trades: DataFrame, settled: DataFrame, key: str, levels: list[str], loss: str) -> DataFrame:
    """Largest loss of trades not settled yet, by each level, those above it, and in all."""
    return trades.join(settled, key, "left_anti").rollup(*levels).agg(F.sum(loss).alias("max_loss"), F.count("*").alias("trades"))


def fill_reconcile(orders: DataFrame, fills: DataFrame) -> DataFrame:
    """Filled size, fees, last fill price and status of every order; an order without fills keeps its own status."""
    by_order = fills.groupBy("order_id").agg(F.sum("quantity").alias("filled"), F.sum("fee").alias("fees"), F.max_by("price", F.struct("line", "price")).alias("last_price"))
    rows = orders.join(by_order, "order_id", "left").withColumn("filled", F.coalesce("filled", F.lit(0).cast("long")))
    return rows.withColumn("state", F.when(F.col("filled") >= F.col("requested"), "filled").when(F.col("filled") > 0, "partial").otherwise(F.col("status"))).drop("status")


def orphan_positions(positions: DataFrame, trades: DataFrame, key: str) -> DataFrame:
    """Positions that no trade explains."""
    return positions.join(trades, key, "left_anti")


def position_parity(positions: DataFrame, trades: DataFrame, key: str) -> DataFrame:
    """Keys whose position (key, units) is not what their trades (key, units) sum to: key, held, traded, difference; nothing held or traded is 0."""
    of = lambda df, name: df.groupBy(key).agg(F.sum("units").alias(name))
    both = of(positions, "held").join(of(trades, "traded"), key, "full").fillna(0, ["held", "traded"])
    return both.withColumn("difference", F.col("held") - F.col("traded")).filter("difference <> 0")


def attributed(snapshots: DataFrame, orders: DataFrame, eligible: tuple[str, ...] = ("executed",)) -> DataFrame:
    """What tickers have realised (ticker, snapshot_us, realised) with the order that it is put down to: order_id, placed_us.

    That is the latest order of the ticker with an eligible status placed at or before the snapshot, of those placed at
    once the one with the largest id; null where there is none.
    """
    rows = orders.filter(F.col("status").isin(*eligible)).select("ticker", "order_id", "placed_us")
    return asof_join(snapshots, rows, ["ticker"], "snapshot_us", "placed_us", ["order_id", "placed_us"], tie="order_id")


def portfolio_aggregate(positions: DataFrame, by: list[str]) -> DataFrame:
    """Sums of exposure, realised and fees by key, and positions that are open; nulls add nothing, no positions give no rows."""
    return positions.groupBy(*by).agg(F.sum("exposure").alias("exposure"), F.sum("realised").alias("realised"), F.sum("fees").alias("fees"), F.count_if(F.col("exposure") != 0).alias("open_positions"))


def fills_vs_prints(orders: DataFrame, prints: DataFrame, width: int = 3_600_000_000) -> DataFrame:
    """What prints in (as_of, close] would have filled of each order at its limit, strictly better and at least as good."""
    spans = orders.select("order_id", "ticker", "limit_price", (F.col("as_of") + 1).alias("a"), F.col("close_us").alias("b"))
    met = interval_join(prints, spans, "us", "a", "b", width, by=["ticker"]).filter("yes_price <= limit_price")
    sums = met.groupBy("order_id").agg(F.sum(F.when(F.col("yes_price") < F.col("limit_price"), F.col("units")).otherwise(0)).alias("better"), F.sum("units").alias("at_least"))
    rows = orders.join(sums, "order_id", "left")
    fill = lambda c: F.least(F.coalesce(c, F.lit(0).cast("long")), F.col("units_wanted"))
    return rows.select("order_id", fill("better").alias("filled_strict"), fill("at_least").alias("filled_inclusive"))


def execution_bound(filled: DataFrame, most: float = 0.6) -> DataFrame:
    """Orders that prints would not have filled at all, by either rule, their rate, and whether it is above most; no orders: 0."""
    rates = filled.agg(F.count("*").alias("orders"), F.count_if(F.col("filled_strict") == 0).alias("zero_strict"), F.count_if(F.col("filled_inclusive") == 0).alias("zero_inclusive"))
    rate = lambda c: F.round(F.coalesce(F.try_divide(F.col(c), F.col("orders")), F.lit(0.0)), 9)
    rates = rates.withColumns({"rate_strict": rate("zero_strict"), "rate_inclusive": rate("zero_inclusive")})
    return rates.withColumns({"bound_strict": F.col("rate_strict") > most, "bound_inclusive": F.col("rate_inclusive") > most})


def tick_decision(decisions: DataFrame, prints: DataFrame, stale_us: int, depth_us: int) -> DataFrame:
    """The last print within stale_us before each decision, and the prints and contracts of the depth_us before it."""
    last = asof_join(decisions, prints.select("ticker", "us", "id", F.col("yes_price").alias("last_price"), F.col("us").alias("last_us")), ["ticker"], "as_of", "us", ["last_price", "last_us"], tolerance=stale_us, tie="id")
    spans = decisions.select("decision_id", "ticker", (F.col("as_of") - depth_us + 1).alias("a"), F.col("as_of").alias("b"))
    met = interval_join(prints, spans, "us", "a", "b", depth_us, by=["ticker"]).groupBy("decision_id").agg(F.count("*").alias("prints"), F.sum("units").alias("contracts"))
    out = last.join(met, "decision_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("prints", "contracts")})
