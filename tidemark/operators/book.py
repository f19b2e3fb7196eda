"""Order-book state from an event tape of snapshots and deltas.

A snapshot is a batch of rows of one (us, seq), one a level; it clears the book of its ticker and sets the levels.
A delta adds to the size at a side and price; a level of size 0 is gone, and one below 0 is a violation.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import nlargest

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import weighted_quantile
from tidemark.plans.asof import asof_join, last_before, last_row_before
from tidemark.plans.keep import keep
from tidemark.plans.scan import before, latest, most, running, total


def with_epoch(tape: DataFrame, width: int = 1_000_000) -> DataFrame:
    """Adds epoch, the number of snapshots of the ticker so far: a snapshot row whose batch differs from that of the snapshot row before starts one.

    A ticker's rows are windowed in ranges of width of their ids, so that a busy ticker is many tasks. A row for each range
    says how its first and last snapshot batch meet those of the ranges before, and how many it starts besides. Rows
    without an id come first.
    """
    snapshot = F.coalesce("is_snapshot", F.lit(False))
    rows = tape.withColumns({"_part": F.floor(F.col("id") / width), "_batch": F.when(snapshot, F.struct("us", "seq"))})
    own = Window.partitionBy("ticker", "_part").orderBy("id")
    rows = rows.withColumn("_was", F.last("_batch", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("_next", F.coalesce(F.col("_was") != F.col("_batch"), F.lit(False)).cast("long"))
    parts = rows.groupBy("ticker", "_part").agg(F.sum("_next").alias("_n"), F.min_by("_batch", F.when(snapshot, F.col("id"))).alias("_first"), F.max_by("_batch", F.when(snapshot, F.col("id"))).alias("_last"))
    upto = Window.partitionBy("ticker").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    held = F.last("_last", ignorenulls=True).over(upto)
    parts = parts.withColumn("_opens", (F.col("_first").isNotNull() & (held.isNull() | (held != F.col("_first")))).cast("long"))
    parts = parts.select(F.col("ticker").alias("_ticker"), F.col("_part").alias("_range"), "_opens", F.coalesce(F.sum(F.col("_n") + F.col("_opens")).over(upto), F.lit(0)).alias("_before"))
    met = rows.join(parts, F.col("ticker").eqNullSafe(F.col("_ticker")) & F.col("_part").eqNullSafe(F.col("_range")))
    so_far = own.rowsBetween(Window.unboundedPreceding, 0)
    epoch = F.col("_before") + F.sum("_next").over(so_far) + F.when(F.count("_batch").over(so_far) > 0, F.col("_opens")).otherwise(0)
    return met.select(*tape.columns, epoch.alias("epoch"))


def book_levels(tape: DataFrame) -> DataFrame:
    """After every row the size at its side and price; violation where that is below 0.

    Within an epoch it is the last size a snapshot set at that level plus the deltas since; windows only, no fold.
    """
    rows = with_epoch(tape)
    level = Window.partitionBy("ticker", "epoch", "side", "price").orderBy("id")
    upto = level.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_set", F.last(F.when(F.col("is_snapshot"), F.col("size")), ignorenulls=True).over(upto))
    rows = rows.withColumn("_sets", F.count_if("is_snapshot").over(upto))
    since = Window.partitionBy("ticker", "epoch", "side", "price", "_sets").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    added = F.coalesce(F.sum(F.when(~F.col("is_snapshot"), F.col("size"))).over(since), F.lit(0))
    out = rows.withColumn("level_size", F.coalesce("_set", F.lit(0)) + added)
    return out.select("id", "ticker", "us", "epoch", "side", "price", "level_size", (F.col("level_size") < 0).alias("violation"))


def _fold(depth: int):
    """Replays rows sorted by ticker, epoch and id; only the levels of one book are held, whatever the length of the stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, book = None, {"yes": {}, "no": {}}
        tops = {"yes": ([], []), "no": ([], [])}
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("ticker", "epoch", "side", "price", "size", "is_snapshot")]
            out = {s: ([], [], []) for s in ("yes", "no")}
            for ticker, epoch, side, price, size, is_snapshot in zip(*columns, strict=True):
                if (ticker, epoch) != key:
                    key, book, tops = (ticker, epoch), {"yes": {}, "no": {}}, {"yes": ([], []), "no": ([], [])}
                levels = book[side]
                levels[price] = size if is_snapshot else levels.get(price, 0) + size
                if levels[price] == 0:
                    del levels[price]
                best = nlargest(depth, (p for p, n in levels.items() if n > 0))
                tops[side] = (best, [levels[p] for p in best])
                for s in ("yes", "no"):
                    out[s][0].append(tops[s][0])
                    out[s][1].append(tops[s][1])
                    out[s][2].append(sum(n > 0 for n in book[s].values()))
            kinds = (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("ticker"), batch.column("us"), *(pa.array(c, t) for s in ("yes", "no") for c, t in zip(out[s], kinds, strict=True))],
                ["id", "ticker", "us", "yes_prices", "yes_sizes", "yes_levels", "no_prices", "no_sizes", "no_levels"],
            )

    return run


def ladder_series(tape: DataFrame, depth: int = 6) -> DataFrame:
    """After every tape row the best depth prices and sizes of each side, best first, and the number of levels before the cut.

    One shuffle by (ticker, epoch), so that a busy ticker is spread over its snapshots, and a streamed fold in order.
    """
    rows = with_epoch(tape).repartition("ticker", "epoch").sortWithinPartitions("ticker", "epoch", "id")
    schema = "id long, ticker string, us long, yes_prices array<long>, yes_sizes array<long>, yes_levels long, no_prices array<long>, no_sizes array<long>, no_levels long"
    return rows.mapInArrow(_fold(depth), schema)


def touch_series(tape: DataFrame) -> DataFrame:
    """After every tape row the best price and its size on each side, over levels of positive size; null if the side is empty."""
    ladder = ladder_series(tape, 1)
    return ladder.select("id", "ticker", "us", *(F.get(f"{s}_{a}", F.lit(0)).alias(f"{s}_{b}") for s in ("yes", "no") for a, b in (("prices", "bid"), ("sizes", "size"))))


def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best levels at each point of a stream sorted by ticker, snapshot and time; only the sums of one book are held."""
    key, book = None, {"yes": {}, "no": {}}
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("ticker", "snap_us", "is_point", "side", "price", "size")]
        points, out = [], ([], [], [], [])
        for i, (ticker, snap_us, is_point, side, price, size) in enumerate(zip(*columns, strict=True)):
            if (ticker, snap_us) != key:
                key, book = (ticker, snap_us), {"yes": {}, "no": {}}
            if not is_point:
                book[side][price] = book[side].get(price, 0) + size
                continue
            points.append(i)
            for s, levels in enumerate(book.values()):
                best = max((p for p, n in levels.items() if n > 0), default=None)
                out[2 * s].append(best)
                out[2 * s + 1].append(levels.get(best))
        kept = batch.column("point").take(pa.array(points, pa.int64()))
        yield pa.RecordBatch.from_arrays([kept, *(pa.array(c, pa.int64()) for c in out)], ["point", "yes_bid", "yes_size", "no_bid", "no_size"])


def book_state_at(points: DataFrame, tape: DataFrame, gaps: DataFrame, width: int = 3_600_000_000) -> DataFrame:
    """The best levels of the book at (point_id, ticker, at_us), from the last snapshot and the deltas after it.

    status is no_anchor without a snapshot before, gap if one of the ticker or of the whole connection (ticker '') lies
    after it, else ok. Deltas at the very stamp of the snapshot don't count, nor do rows without a side yes or no, a
    price or a size. Each point is judged by itself, also if its id repeats; a null ticker or time has no anchor.

    Points are put among the rows of their ticker and snapshot in order of time, and the stream is folded: no point is
    paired with rows, and a busy ticker is spread over its snapshots. Gaps of the connection meet points in ranges of
    width of the time.
    """
    points = points.select("point_id", "ticker", "at_us")
    snapshots = tape.filter("is_snapshot").select("ticker", "us", "id", F.col("us").alias("snap_us"))
    anchored = asof_join(points, snapshots, ["ticker"], "at_us", "us", ["snap_us"], tie="id")
    own = asof_join(anchored, gaps.filter("ticker <> ''").select("ticker", F.col("detected_us").alias("gap_us")), ["ticker"], "at_us", "gap_us", ["gap_us"])
    wide = last_before(own, gaps.filter("ticker = ''"), "at_us", "detected_us", "wide_us", width)
    gap = F.coalesce(F.greatest("gap_us", "wide_us") >= F.col("snap_us"), F.lit(False))
    none = F.col("snap_us").isNull() | F.col("ticker").isNull()
    state = wide.select("point_id", "ticker", "at_us", "snap_us", F.when(none, "no_anchor").when(gap, "gap").otherwise("ok").alias("status"))

    upto = Window.partitionBy("ticker").orderBy("us").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = tape.filter("side in ('yes', 'no') and price is not null and size is not null").select("ticker", "us", "id", "seq", "side", "price", "size", "is_snapshot")
    # a snapshot's stamp comes from all of its rows, readable levels or not
    marks = tape.filter("is_snapshot").groupBy("ticker", "us").agg(F.max_by("seq", "id").alias("snap_seq"))
    stamped = rows.withColumn("is_mark", F.lit(False)).unionByName(marks.withColumn("is_mark", F.lit(True)), allowMissingColumns=True)
    stamped = stamped.withColumn("a", F.max(F.when(F.col("is_mark"), F.struct("us", "snap_seq"))).over(upto)).filter("not is_mark")
    held = F.when(F.col("is_snapshot"), (F.col("us") == F.col("a.us")) & (F.col("seq") == F.col("a.snap_seq"))).otherwise(F.col("us") > F.col("a.us"))
    book = stamped.filter(held).select("ticker", F.col("a.us").alias("snap_us"), "us", F.lit(False).alias("is_point"), "side", "price", "size")

    asked = state.filter("status = 'ok'").select("ticker", "snap_us", F.col("at_us").alias("us"), F.lit(True).alias("is_point"), F.struct("point_id", "ticker", "at_us", "status").alias("point"))
    kind = asked.schema["point"].dataType
    both = book.unionByName(asked, allowMissingColumns=True).repartition("ticker", "snap_us").sortWithinPartitions("ticker", "snap_us", "us", "is_point")
    found = both.mapInArrow(_tops, f"point {kind.simpleString()}, yes_bid long, yes_size long, no_bid long, no_size long").select("point.*", "yes_bid", "yes_size", "no_bid", "no_size")
    return found.unionByName(state.filter("status <> 'ok'").select("point_id", "ticker", "at_us", "status"), allowMissingColumns=True)


def rest_agreement(rest: DataFrame, state: DataFrame) -> DataFrame:
    """Independent best bids (point_id, series, bid) against the book's, per series and in all."""
    kind = F.when(F.col("status") == "gap", "gap").when(F.col("status") == "no_anchor", "no_coverage").when(F.col("bid").eqNullSafe(F.col("yes_bid")), "agree").otherwise("disagree")
    rows = rest.join(state.select("point_id", "status", "yes_bid"), "point_id").withColumn("kind", kind)
    return rows.rollup("series").agg(F.count("*").alias("n"), *(F.count_if(F.col("kind") == k).alias(k) for k in ("agree", "disagree", "no_coverage", "gap")))


def parity_results(points: DataFrame, touch: DataFrame, state: DataFrame, shifted: DataFrame, tape: DataFrame, gaps: DataFrame, width: int = 86_400_000_000) -> DataFrame:
    """Two reconstructions at sampled points, told apart: points with status, tied_agreed and blind.

    points: point_id, ticker, at_us, kind, cohort. touch: best prices after every row of the tape; the pass takes the last
    one at or before a point, and raises where a gap of the ticker or of the connection lies between its last snapshot and
    the point. state and shifted: book_state_at of the points, which raises by its own rule; in shifted, deltas stamped like
    their snapshot count as after it. agreed_on_raise: both raise; disagreed: one does, or prices differ; no_anchor: no
    snapshot yet; excluded_tied_delta: a delta is stamped like the snapshot in force, so that either state is admissible,
    and tied_agreed says whether the pass has one of the two; agreed else. blind: nothing of the ticker comes after.
    """
    seen = touch.select("ticker", "us", "id", F.struct(F.col("yes_bid").alias("a"), F.col("no_bid").alias("b")).alias("passed"))
    rows = asof_join(points, seen, ["ticker"], "at_us", "us", ["passed"], tie="id")
    snaps = tape.filter("is_snapshot").select("ticker", F.col("us").alias("snap_us")).distinct()
    rows = asof_join(rows, snaps, ["ticker"], "at_us", "snap_us", ["snap_us"])
    rows = asof_join(rows, gaps.filter("ticker <> ''").select("ticker", F.col("detected_us").alias("own_gap")), ["ticker"], "at_us", "own_gap", ["own_gap"])
    rows = last_before(rows, gaps.filter("ticker = ''"), "at_us", "detected_us", "gap_us", width)
    raised = F.coalesce(F.greatest("own_gap", "gap_us") >= F.col("snap_us"), F.lit(False))
    tied = tape.filter("not is_snapshot").select("ticker", F.col("us").alias("snap_us"), F.lit(True).alias("_tied")).distinct()
    rows = rows.join(tied, ["ticker", "snap_us"], "left")
    last = tape.groupBy("ticker").agg(F.max("us").alias("_last"))
    rows = rows.join(last, "ticker", "left").withColumn("blind", F.coalesce(F.col("_last") < F.col("at_us"), F.lit(True)))
    views = lambda df, name: df.select("point_id", F.struct("status", "yes_bid", "no_bid").alias(name))
    rows = rows.join(views(state, "s"), "point_id").join(views(shifted, "z"), "point_id")
    same = lambda v: F.col("passed.a").eqNullSafe(F.col(f"{v}.yes_bid")) & F.col("passed.b").eqNullSafe(F.col(f"{v}.no_bid"))
    oracle = F.col("s.status") == "gap"
    status = F.when(oracle & raised, "agreed_on_raise").when(oracle != raised, "disagreed").when(F.col("s.status") == "no_anchor", "no_anchor")
    status = status.when(F.col("_tied"), "excluded_tied_delta").when(same("s"), "agreed").otherwise("disagreed")
    rows = rows.withColumn("status", status)
    return rows.select(*points.columns, "status", F.when(F.col("status") == "excluded_tied_delta", same("s") | same("z")).alias("tied_agreed"), "blind")


def with_later_deltas(tape: DataFrame, points: DataFrame, gaps: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """tape, points and gaps with stamps twice as fine, snapshots a step earlier: deltas stamped like a snapshot come after it."""
    us = F.col("us") * 2 - F.when(F.col("is_snapshot"), 1).otherwise(0)
    return tape.withColumn("us", us), points.withColumn("at_us", F.col("at_us") * 2), gaps.withColumn("detected_us", F.col("detected_us") * 2)


def replay_parity(results: DataFrame) -> DataFrame:
    """parity_results counted by kind, by cohort and in all: scope, name, each status, tied_agreed, blind and n; statuses that are not there are 0."""
    scopes = F.explode(F.array(*(F.struct(F.lit(s).alias("scope"), n.alias("name")) for s, n in (("kind", F.col("kind")), ("cohort", F.col("cohort")), ("all", F.lit("*"))))))
    rows = results.select(scopes.alias("x"), "status", "tied_agreed", "blind").select("x.*", "status", "tied_agreed", "blind")
    return rows.groupBy("scope", "name").agg(
        *(F.count_if(F.col("status") == k).alias(k) for k in ("agreed", "agreed_on_raise", "disagreed", "excluded_tied_delta", "no_anchor")), F.count_if("tied_agreed").alias("tied_agreed"), F.count_if("blind").alias("blind"), F.count("*").alias("n")
    )


def ranked_tickers(tape: DataFrame, root: Column, width: int = 1_000) -> DataFrame:
    """Tickers by their number of rows, most first, ties by name: ticker, root, n_rows, place from 0."""
    counts = keep(tape.groupBy("ticker").agg(F.count("*").alias("n_rows")).withColumns({"root": root, "_less": -F.col("n_rows")}))
    return running(counts, [], ["_less", "ticker"], width, {"place": total(F.lit(1), through=False)}).select("ticker", "root", "n_rows", F.col("place").cast("long").alias("place"))


def sample_cohorts(ranked: DataFrame, busy: int, quiet: int, spread: int) -> DataFrame:
    """Tickers to sample from, each in one cohort: ticker, cohort, n_rows, place.

    busy: the first of the root with the most rows; quiet: those with the fewest rows; spread: at evenly spaced places
    of all. A ticker that more than one would take goes to the first of these, so a cohort may come out short.
    """
    roots = ranked.groupBy("root").agg(F.sum("n_rows").alias("_rows")).orderBy(F.desc("_rows"), "root").limit(1).select("root")
    n = ranked.agg(F.count("*").alias("_n"))
    rows = ranked.join(F.broadcast(n))
    step = F.greatest(F.floor(F.col("_n") / spread), F.lit(1))
    of = lambda df, name, order: df.withColumns({"cohort": F.lit(name), "_order": F.lit(order)}).select("ticker", "cohort", "n_rows", "place", "_order")
    first = ranked.join(F.broadcast(roots), "root").orderBy("place").limit(busy)
    last = rows.filter(F.col("place") >= F.col("_n") - quiet)
    even = rows.filter((F.col("place") % step == 0) & (F.col("place") < step * spread))
    picked = of(first, "busy", 0).unionByName(of(last, "quiet", 1)).unionByName(of(even, "spread", 2))
    return picked.groupBy("ticker", "n_rows", "place").agg(F.min_by("cohort", "_order").alias("cohort"))


def sample_points(tape: DataFrame, cohorts: DataFrame, ranked: DataFrame, gaps: DataFrame, interior: int, batches: int, width: int = 1_000_000) -> DataFrame:
    """Points at which to compare books, without repeats: ticker, at_us, kind, cohort.

    Of each ticker of cohorts, in order of its ids: interior rows at evenly spaced places; around as many snapshot
    batches, evenly spaced among those with a row before them, the row before, the batch and a microsecond after it; and
    blind, a microsecond after its last row. Of each gap (id, ticker, detected_us), cohort gap: post_gap, when it was
    detected, and gap_edge, the rows before and after it and a microsecond after; a gap of the connection takes the
    busiest ticker with a snapshot before it, and one without such a ticker has no points.
    """
    rows = tape.join(cohorts.select("ticker", "cohort", "n_rows"), "ticker").withColumn("_batch", F.when(F.col("is_snapshot"), F.struct("us", "seq")))
    rows = keep(running(rows, ["ticker"], ["id"], width, {"_i": total(F.lit(1), through=False), "_was": latest(F.col("_batch"), through=False), "_prev": before(F.col("us"))}))
    places = F.array_distinct(F.array(*(F.floor(F.col("n_rows") * (i + 1) / (interior + 1)) for i in range(interior))))
    inner = rows.filter(F.array_contains(places, F.col("_i"))).select("ticker", F.col("us").alias("at_us"), F.lit("interior").alias("kind"), "cohort")
    starts = rows.filter(F.col("is_snapshot") & (F.col("_was").isNull() | (F.col("_was") != F.col("_batch"))) & F.col("_prev").isNotNull())
    starts = running(starts, ["ticker"], ["id"], width, {"_b": total(F.lit(1), through=False)}).withColumn("_n", F.count("*").over(Window.partitionBy("ticker")))
    even = F.array_distinct(F.array(*(F.floor(F.col("_n") * i / batches) for i in range(batches))))
    around = starts.filter(F.array_contains(even, F.col("_b"))).select("ticker", F.explode(F.array(F.col("_prev"), F.col("us"), F.col("us") + 1)).alias("at_us"), F.lit("snapshot").alias("kind"), "cohort")
    blind = rows.groupBy("ticker", "cohort").agg((F.max_by("us", "id") + 1).alias("at_us")).select("ticker", "at_us", F.lit("blind").alias("kind"), "cohort")
    # the busiest ticker with a snapshot by then: the best place so far among first snapshots
    firsts = tape.filter("is_snapshot").groupBy("ticker").agg(F.min("us").alias("first_us")).join(ranked.select("ticker", "place"), "ticker")
    lead = running(firsts, [], ["first_us", "place"], 86_400_000_000, {"_best": most(-F.col("place"))}).join(ranked.select((-F.col("place")).alias("_best"), F.col("ticker").alias("_name")), "_best")
    whole = last_row_before(gaps.filter("ticker = ''"), lead.groupBy("first_us").agg(F.max_by("_name", "_best").alias("_name")), "detected_us", "first_us", ["_name"], 86_400_000_000)
    own = asof_join(gaps.filter("ticker <> ''"), tape.filter("is_snapshot").select("ticker", F.col("us").alias("first_us")), ["ticker"], "detected_us", "first_us", ["first_us"]).filter("first_us is not null")
    found = own.select("ticker", "detected_us").unionByName(whole.filter("_name is not null").select(F.col("_name").alias("ticker"), "detected_us")).distinct()
    stamps = tape.select("ticker", "us", "id")
    found = asof_join(found, stamps.withColumnRenamed("us", "before_us"), ["ticker"], "detected_us", "before_us", ["before_us"], strict=True, tie="id")
    found = asof_join(found, stamps.withColumnRenamed("us", "after_us"), ["ticker"], "detected_us", "after_us", ["after_us"], forward=True, tie="id")
    edge = lambda c, kind: F.struct(c.alias("at_us"), F.lit(kind).alias("kind"))
    edges = F.array(edge(F.col("detected_us"), "post_gap"), edge(F.col("before_us"), "gap_edge"), edge(F.col("after_us"), "gap_edge"), edge(F.col("after_us") + 1, "gap_edge"))
    edges = found.select("ticker", F.explode(edges).alias("x")).select("ticker", "x.at_us", "x.kind", F.lit("gap").alias("cohort")).filter("at_us is not null")
    return inner.unionByName(around).unionByName(blind).unionByName(edges).distinct()


def sample_shortfall(points: DataFrame, cohorts: DataFrame, wanted: dict[str, int]) -> DataFrame:
    """Per cohort of wanted: tickers wanted and found, how many are missing, and points."""
    names = F.explode(F.array(*(F.struct(F.lit(c).alias("cohort"), F.lit(n).cast("long").alias("wanted")) for c, n in wanted.items())))
    asked = cohorts.sparkSession.range(1).select(names.alias("x")).select("x.*")
    tickers = cohorts.groupBy("cohort").agg(F.count("*").alias("found"))
    made = points.groupBy("cohort").agg(F.count("*").alias("points"))
    out = asked.join(tickers, "cohort", "left").join(made, "cohort", "left").fillna(0, ["found", "points"])
    return out.select("cohort", "wanted", "found", (F.col("wanted") - F.col("found")).alias("missing"), "points")


def sample_every(tape: DataFrame, every: int) -> DataFrame:
    """Evenly spaced rows of every ticker, by its row numbers, and the number of rows it has."""
    own = Window.partitionBy("ticker")
    ranked = tape.withColumn("rank", F.row_number().over(own.orderBy("id")).cast("long")).withColumn("n_rows", F.count("*").over(own))
    return ranked.filter(F.col("rank") % every == 0).select("id", "ticker", "us", "rank", "n_rows")


def book_clear_audit(clears: DataFrame, tape: DataFrame) -> DataFrame:
    """Each instant (clear_id, ticker, clear_us) at which a ticker's book was cleared, by what surrounds it.

    no_anchor: no snapshot before; terminal: nothing of the ticker after; mid_life otherwise, with the rows that came
    before the next snapshot and for how long.
    """
    snaps = tape.filter("is_snapshot").select("ticker", "us", "id")
    rows = asof_join(clears, snaps.withColumn("anchor_us", F.col("us")), ["ticker"], "clear_us", "us", ["anchor_us"], tie="id")
    rows = asof_join(rows, snaps.withColumn("next_us", F.col("us")), ["ticker"], "clear_us", "us", ["next_us"], forward=True, strict=True, tie="id")
    counted = tape.select("ticker", "us", "id", F.count("*").over(Window.partitionBy("ticker").orderBy("us", "id").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
    last = counted.groupBy("ticker").agg(F.max("us").alias("last_us"), F.max("upto").alias("all"))
    rows = asof_join(rows, counted, ["ticker"], "clear_us", "us", ["upto"], tie="id").withColumnRenamed("upto", "at_clear")
    rows = rows.withColumn("_until", F.coalesce("next_us", F.lit(2**62)))
    rows = asof_join(rows, counted, ["ticker"], "_until", "us", ["upto"], strict=True, tie="id").join(last, "ticker", "left")
    stale = F.coalesce(F.col("upto") - F.coalesce("at_clear", F.lit(0)), F.lit(0))
    kind = F.when(F.col("anchor_us").isNull(), "no_anchor").when(F.col("last_us") <= F.col("clear_us"), "terminal").otherwise("mid_life")
    return rows.select("clear_id", "ticker", "clear_us", kind.alias("kind"), stale.alias("stale_rows"), (F.col("next_us") - F.col("clear_us")).alias("stale_us"))


def depth_continuity(a: DataFrame, b: DataFrame) -> DataFrame:
    """As-of agreement of quotes a with the states b in force: prices, sizes, and sizes within one contract, by side present."""
    joined = asof_join(a, b.select("ticker", "us", "id", F.col("yes_bid").alias("b_bid"), F.col("yes_size").alias("b_size")), ["ticker"], "us", "us", ["b_bid", "b_size"], strict=True, tie="id")
    seen = joined.filter("b_bid is not null")
    return seen.groupBy((F.col("yes_bid") > 0).alias("present")).agg(
        F.count("*").alias("n"), F.count_if(F.col("yes_bid") == F.col("b_bid")).alias("price_agree"), F.count_if(F.col("yes_size") == F.col("b_size")).alias("size_agree"),
        F.count_if(F.abs(F.col("yes_size") - F.col("b_size")) <= 100).alias("within_one"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY abs(yes_size - b_size))").cast("long").alias("p50_difference"),
    )


def _compared_sides(a: DataFrame, b: DataFrame) -> DataFrame:
    """Each quote of a with the state of b in force before it, a row for each side; quotes without one go."""
    named = {"yes_bid": "b_yes_bid", "no_bid": "b_no_bid", "yes_size": "b_yes_size", "no_size": "b_no_size"}
    joined = asof_join(a, b.select("ticker", "us", "id", *(F.col(c).alias(n) for c, n in named.items())), ["ticker"], "us", "us", list(named.values()), strict=True, tie="id").filter("b_yes_bid is not null")
    side = lambda s: F.struct(F.lit(s).alias("side"), *(F.col(f"{x}{s}_{y}").alias(f"{x}{z}") for x in ("", "b_") for y, z in (("bid", "price"), ("size", "size"))))
    return joined.select("id", "ticker", "us", F.explode(F.array(side("yes"), side("no"))).alias("x")).select("id", "ticker", "us", "x.*")


def continuity_readout(a: DataFrame, b: DataFrame) -> DataFrame:
    """By side, how quotes of a agree with the states of b in force: prices, sizes, whole contracts, and within one.

    fractional counts states whose size isn't whole contracts; p25, p50 and p75 are of size differences, summed by value
    first. Quotes before a ticker's first state don't count; none at all give no rows.
    """
    rows = _compared_sides(a, b).withColumn("difference", F.col("size") - F.col("b_size"))
    priced = F.col("price") == F.col("b_price")
    out = rows.groupBy("side").agg(
        F.count("*").alias("n"), F.count_if(priced).alias("price_agree"), F.count_if(priced & (F.col("size") == F.col("b_size"))).alias("depth_agree"),
        F.count_if(priced & F.expr("size div 100 = b_size div 100")).alias("depth_truncated"), F.count_if(F.col("b_size") % 100 != 0).alias("fractional"), F.count_if(F.abs("difference") <= 100).alias("within_one"),
    )
    for q in (25, 50, 75):
        out = out.join(weighted_quantile(rows.withColumn("_one", F.lit(1)), ["side"], "difference", "_one", q / 100, f"p{q}"), "side", "left")
    return out


def continuity_sample(a: DataFrame, b: DataFrame, most: int = 20) -> DataFrame:
    """The first disagreements in price or whole contracts, most of them, in order of ticker, time, id and side."""
    apart = (F.col("price") != F.col("b_price")) | F.expr("size div 100 <> b_size div 100")
    return _compared_sides(a, b).filter(apart).orderBy("ticker", "us", "id", "side").limit(most)
