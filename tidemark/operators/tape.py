"""Quality of an event tape: sequence breaks, blind windows, gaps, exclusions, coverage and evaluable days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.asof import asof_join, last_row_before
from tidemark.plans.intervals import interval_join, islands, merge_intervals
from tidemark.plans.keep import keep
from tidemark.plans.scan import running, total

DAY_US = 86_400_000_000
MINUTE_US = 60_000_000


def stream_lag(df: DataFrame, order: str, cols: list[str], width: int) -> DataFrame:
    """Adds prev_<col> from the row before in one global order, without gathering it in one task.

    Rows are windowed within ranges of width of the order key; the first of a range takes what the last of the range
    before had, from a table with one row a range.
    """
    df = df.withColumn("_range", F.floor(F.col(order) / width))
    last = df.groupBy("_range").agg(F.max_by(F.struct(*cols), order).alias("_last"))
    carried = last.select("_range", F.lag("_last").over(Window.orderBy("_range")).alias("_carried"))
    own = Window.partitionBy("_range").orderBy(order)
    seen = df.join(carried, "_range").withColumn("_prev", F.coalesce(F.lag(F.struct(*cols)).over(own), F.col("_carried")))
    return seen.select("*", *(F.col("_prev")[c].alias(f"prev_{c}") for c in cols)).drop("_range", "_carried", "_prev")


def stream_sum(df: DataFrame, order: str, value: Column, name: str, width: int) -> DataFrame:
    """Adds the running sum of value in one global order, by ranges as in stream_lag."""
    df = df.withColumn("_range", F.floor(F.col(order) / width)).withColumn("_value", value)
    sums = df.groupBy("_range").agg(F.sum("_value").alias("_sum"))
    before = sums.select("_range", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.join(before, "_range").withColumn(name, F.col("_before") + F.sum("_value").over(own)).drop("_range", "_value", "_before")


def messages(tape: DataFrame) -> DataFrame:
    """One row a message: a snapshot's levels share (us, seq)."""
    return tape.groupBy("us", "seq").agg(F.min("id").alias("id"), F.bool_or("is_snapshot").alias("is_snapshot"))


def seq_boundaries(tape: DataFrame, width: int = 1_000_000) -> DataFrame:
    """Messages that don't follow on: skip if the sequence jumps ahead, resubscribe if it falls back or repeats."""
    seen = stream_lag(messages(tape), "id", ["seq"], width).filter(F.col("seq") != F.col("prev_seq") + 1)
    return seen.select("id", "us", "prev_seq", "seq", F.when(F.col("seq") > F.col("prev_seq"), "skip").otherwise("resubscribe").alias("kind"))


def blind_windows(tape: DataFrame, width: int = 1_000_000) -> DataFrame:
    """From the last message before each resubscription to the end of the snapshots that follow it at once."""
    seen = stream_lag(messages(tape), "id", ["seq", "us", "id"], width).withColumn("boundary", F.coalesce(F.col("seq") <= F.col("prev_seq"), F.lit(False)))
    runs = stream_sum(seen, "id", F.col("boundary").cast("long"), "run", width).filter("run > 0")
    first_delta = runs.filter("not is_snapshot").groupBy("run").agg(F.min("id").alias("delta_id"))
    burst = runs.join(first_delta, "run", "left").withColumn("in_burst", F.col("delta_id").isNull() | (F.col("id") < F.col("delta_id")))
    head = F.struct("prev_id", "prev_us", "prev_seq", "seq", "us")
    out = burst.groupBy("run").agg(
        F.min("id").alias("boundary_id"), F.min_by(head, "id").alias("h"), F.count_if("in_burst").alias("burst_messages"), F.max(F.when(F.col("in_burst"), F.col("us"))).alias("burst_us")
    )
    end = F.coalesce("burst_us", "h.us")
    return out.select("boundary_id", F.col("h.prev_id").alias("prev_id"), F.col("h.prev_seq").alias("prev_seq"), F.col("h.seq").alias("seq"), "burst_messages", F.col("h.prev_us").alias("start_us"), end.alias("end_us"), (end - F.col("h.prev_us")).alias("blind_us"))


def attach_gaps(windows: DataFrame, gaps: DataFrame, width: int = DAY_US) -> DataFrame:
    """Gap rows with the window whose [start, next start) holds them; at most one gap, the first, for each window."""
    following = stream_lead(windows, "start_us", width)
    found = interval_join(gaps, following.select("boundary_id", "start_us", "next_us"), "detected_us", "start_us", "next_us", width, closed=False, how="inner")
    rank = F.row_number().over(Window.partitionBy("boundary_id").orderBy("detected_us", "id"))
    return found.withColumn("_n", rank).filter("_n = 1").select("boundary_id", F.col("id").alias("gap_id"), "detected_us", "reason")


def unmatched_gaps(attached: DataFrame, gaps: DataFrame) -> DataFrame:
    """Gap rows that no window got: those in none, and those after the first of one."""
    return gaps.join(attached.select(F.col("gap_id").alias("id")), "id", "left_anti").select(F.col("id").alias("gap_id"), "detected_us", "reason")


def stream_lead(df: DataFrame, order: str, width: int) -> DataFrame:
    """Adds next_us, the order key of the next row in a global order; the last row's is a day later."""
    turned = stream_lag(df.withColumn("_back", -F.col(order)), "_back", [order], width)
    return turned.withColumn("next_us", F.coalesce(f"prev_{order}", F.col(order) + DAY_US)).drop("_back", f"prev_{order}")


def blind_summary(windows: DataFrame, attached: DataFrame, start_us: int, end_us: int) -> DataFrame:
    """Windows, those with a gap row and without, their total, nearest-rank median and 90th percentile, and the longest.

    A row for all windows and one for those that start in the frozen span from start_us to before end_us; none of them, no row.
    """
    named = attached.select("boundary_id", F.lit(True).alias("named"))
    frozen = F.when((F.col("start_us") >= start_us) & (F.col("start_us") < end_us), F.lit("frozen"))
    windows = windows.join(named, "boundary_id", "left").withColumn("scope", F.explode(F.array_compact(F.array(F.lit("all"), frozen))))
    pick = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY blind_us)").cast("long")
    return windows.groupBy("scope").agg(F.count("*").alias("windows"), F.count("named").alias("with_gap"), (F.count("*") - F.count("named")).alias("without_gap"), F.sum("blind_us").alias("total_us"), pick(0.5).alias("p50_us"), pick(0.9).alias("p90_us"), F.max("blind_us").alias("max_us"), F.sum("burst_messages").alias("burst_messages"))


def gap_exclusion_windows(gaps: DataFrame, tape: DataFrame) -> DataFrame:
    """Each gap with the last row of its ticker before it and the first at or after it; null where there is none."""
    rows = tape.select("ticker", "us", "id")
    before = asof_join(gaps, rows.withColumnRenamed("us", "start_us"), ["ticker"], "detected_us", "start_us", ["start_us"], strict=True, tie="id")
    return asof_join(before, rows.withColumnRenamed("us", "end_us"), ["ticker"], "detected_us", "end_us", ["end_us"], forward=True, tie="id").select("id", "ticker", "detected_us", "start_us", "end_us", "reason")


def ticker_coverage(tape: DataFrame) -> DataFrame:
    return tape.groupBy("ticker").agg(F.count("*").alias("n_rows"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


def universe_reconcile(expected: DataFrame, recorded: DataFrame, key: str) -> DataFrame:
    """Keys of one side only, and on which side they are."""
    left = expected.select(key).distinct().withColumn("e", F.lit(True))
    right = recorded.select(key).distinct().withColumn("r", F.lit(True))
    return left.join(right, key, "full").filter("e is null or r is null").select(key, F.when(F.col("e").isNull(), "unexpected").otherwise("missing").alias("status"))


def covered_before(intervals: DataFrame, width: int = DAY_US) -> DataFrame:
    """The union of intervals (start_us, end_us) with the time that the earlier ones cover: start_us, end_us, before_us."""
    merged = keep(merge_intervals(intervals, "start_us", "end_us", width=width))
    return running(merged, [], ["start_us"], width, {"before_us": total(F.col("end_us") - F.col("start_us"), through=False)})


def overlap_us(spans: DataFrame, intervals: DataFrame, key: str, start: str, end: str, width: int = DAY_US) -> DataFrame:
    """Time of each span [start, end] that the union of intervals (start_us, end_us) covers: key, overlap_us, one row for each key.

    The time covered up to an instant is what the intervals before the last one begun cover, and what is over of that one.
    A span's is the difference between its ends, so two lookups for each span, and no pairs. A key's spans add up; a span
    with a null bound, or one that ends before it starts, covers nothing.
    """
    whole = (F.col(start) <= F.col(end)) & F.col(start).isNotNull() & F.col(end).isNotNull()
    ends = F.array(F.struct(F.col(start).alias("_at"), F.lit(-1).alias("_sign")), F.struct(F.col(end).alias("_at"), F.lit(1).alias("_sign")))
    points = spans.select(key, F.explode(F.when(whole, ends).otherwise(F.array(F.struct(F.lit(None).cast("long").alias("_at"), F.lit(1).alias("_sign"))))).alias("_p")).select(key, "_p.*")
    met = last_row_before(points, keep(covered_before(intervals, width)), "_at", "start_us", ["start_us", "end_us", "before_us"], width)
    covered = F.col("before_us") + F.least("_at", "end_us") - F.col("start_us")
    return met.groupBy(key).agg(F.coalesce(F.sum(F.col("_sign") * covered), F.lit(0)).cast("long").alias("overlap_us"))


def classify_exclusions(windows: DataFrame, scope_start: int, scope_end: int, pad: int = 5 * MINUTE_US) -> DataFrame:
    """Exclusions padded where the whole subscription was affected, and clipped to the scope; empty ones go."""
    wide = F.col("class") == "subscription_wide"
    out = windows.select("id", "class", F.greatest(F.col("start_us") - F.when(wide, pad).otherwise(0), F.lit(scope_start)).alias("start_us"), F.least(F.col("end_us") + F.when(wide, pad).otherwise(0), F.lit(scope_end)).alias("end_us"), wide.alias("padded"))
    return out.filter("start_us <= end_us").withColumn("duration_us", F.col("end_us") - F.col("start_us"))


def blind_exclusions(windows: DataFrame, gaps: DataFrame, incidents: DataFrame, wide: tuple[str, ...], scope_start: int, scope_end: int, pad: int = 5 * MINUTE_US, width: int = DAY_US) -> DataFrame:
    """Exclusions of blind windows, classed by the gap attached to them and clipped to the scope.

    A window without a gap is resubscribe_blind, one whose gap has a reason in wide subscription_wide, others are
    recorded_gap. Windows whose gap was detected in the second of an incident (incidents: second) are padded on both
    sides. Windows that don't touch the scope go; a gap without a reason is a recorded one; no windows give no rows.
    """
    found = windows.select("boundary_id", "start_us", "end_us").join(attach_gaps(windows, gaps, width), "boundary_id", "left")
    hit = incidents.select(F.col("second").alias("_second"), F.lit(True).alias("_padded")).distinct()
    found = found.withColumn("_second", F.expr("detected_us div 1000000")).join(hit, "_second", "left").withColumn("padded", F.coalesce("_padded", F.lit(False)))
    shift = F.when(F.col("padded"), pad).otherwise(0)
    kind = F.when(F.col("gap_id").isNull(), "resubscribe_blind").when(F.col("reason").isin(*wide), "subscription_wide").otherwise("recorded_gap")
    out = found.select("boundary_id", "gap_id", "reason", kind.alias("class"), "padded", (F.col("start_us") - shift).alias("start_us"), (F.col("end_us") + shift).alias("end_us")).filter((F.col("end_us") >= scope_start) & (F.col("start_us") <= scope_end))
    out = out.withColumn("start_us", F.greatest("start_us", F.lit(scope_start))).withColumn("end_us", F.least("end_us", F.lit(scope_end)))
    return out.withColumn("duration_us", F.col("end_us") - F.col("start_us"))


def quiet_bands(days: DataFrame, start_hour: int = 7, end_hour: int = 9) -> DataFrame:
    """One exclusion of the same hours on every day of the scope."""
    hour = 60 * MINUTE_US
    return days.select("day").distinct().select("day", (F.col("day") * DAY_US + start_hour * hour).alias("start_us"), (F.col("day") * DAY_US + end_hour * hour).alias("end_us"))


def event_day_inventory(tape: DataFrame, exclusions: DataFrame, most_percent: int = 5) -> DataFrame:
    """Of every series and event date of a tape (series, ticker, us): tickers, rows, bounds, what they cover, excluded time, evaluable.

    The date is the UTC day. covered_us is the time from the first to the last row that isn't excluded, outage_us what of
    the whole day is; a day is evaluable with no more than most_percent excluded. Null series are one; no rows, no days.
    """
    days = tape.groupBy("series", F.floor(F.col("us") / DAY_US).alias("day")).agg(F.count_distinct("ticker").alias("tickers"), F.count("*").alias("n_rows"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))
    days = keep(days)
    span = lambda whole, a, b: F.struct(F.struct(F.lit(whole).alias("whole"), "series", "day").alias("of"), a.alias("a"), b.alias("b"))
    both = F.array(span(True, F.col("day") * DAY_US, (F.col("day") + 1) * DAY_US - 1), span(False, F.col("first_us"), F.col("last_us")))
    held = overlap_us(days.select(F.explode(both).alias("x")).select("x.*"), exclusions, "of", "a", "b")
    held = held.groupBy(F.col("of.series").alias("_series"), F.col("of.day").alias("_day")).agg(F.max(F.when(F.col("of.whole"), F.col("overlap_us"))).alias("outage_us"), F.max(F.when(~F.col("of.whole"), F.col("overlap_us"))).alias("_out"))
    out = days.join(held, F.col("series").eqNullSafe(F.col("_series")) & F.col("day").eqNullSafe(F.col("_day"))).withColumn("covered_us", F.col("last_us") - F.col("first_us") - F.col("_out"))
    return out.withColumn("evaluable", F.col("outage_us") * 100 <= most_percent * DAY_US).drop("_series", "_day", "_out")


def contiguous_run(days: DataFrame, city: str, length: int, step: int = 14) -> DataFrame:
    """The first run of length consecutive days that are evaluable in every city: first_day, last_day, error, longest; always one row.

    length is to be a multiple of step, else an error is raised. Where no run is as long, the days are null, error is
    no_run, and longest is how long the longest is (0 if no day is evaluable everywhere).
    """
    if length <= 0 or length % step:
        raise ValueError(f"a run of {length} days is not a multiple of {step}")
    cities = days.agg(F.count_distinct(city).alias("all"))
    good = days.filter("evaluable").groupBy("day").agg(F.count_distinct(city).alias("n")).join(F.broadcast(cities), F.col("n") == F.col("all"))
    rows = good.select("day", (F.col("day") - F.row_number().over(Window.orderBy("day"))).alias("run"))  # a row a day
    runs = rows.groupBy("run").agg(F.min("day").alias("first_day"), F.count("*").alias("n"))
    found = runs.agg(F.min(F.when(F.col("n") >= length, F.col("first_day"))).alias("first_day"), F.coalesce(F.max("n"), F.lit(0)).cast("long").alias("longest"))
    return found.select("first_day", (F.col("first_day") + length - 1).alias("last_day"), F.when(F.col("first_day").isNull(), "no_run").alias("error"), "longest")


def split_disagreements(days: DataFrame) -> DataFrame:
    """Days (city, day) that not every city has: day, cities that have it, and how many are missing. A split needs there to be none."""
    rows = days.select("city", "day").distinct()
    return rows.groupBy("day").agg(F.count("*").alias("cities")).join(F.broadcast(rows.agg(F.count_distinct("city").alias("_all")))).select("day", "cities", (F.col("_all") - F.col("cities")).alias("missing")).filter("missing > 0")


def freeze_split(days: DataFrame) -> DataFrame:
    """Two thirds of the days, in order, for discovery and the rest for holdout. Days with a city are to be the same for all cities, else an error is raised."""
    if "city" in days.columns:
        days = keep(days.select("city", "day").distinct())
        wrong = split_disagreements(days).agg(F.count("*"), F.min("day")).first()
        if wrong[0]:
            raise ValueError(f"cities disagree on {wrong[0]} days, the first of them {wrong[1]}")
    index = F.row_number().over(Window.orderBy("day")) - 1  # a row a day
    numbered = days.select("day").distinct().select("day", index.cast("long").alias("day_index"), F.count("*").over(Window.partitionBy()).alias("n"))
    return numbered.select("day", "day_index", F.when(F.col("day_index") * 3 < F.col("n") * 2, "discovery").otherwise("holdout").alias("split"))


def touched(rows: DataFrame, intervals: DataFrame, start: str, end: str, name: str, width: int = DAY_US) -> DataFrame:
    """rows with whether [start, end] touches the union of intervals (start_us, end_us), bounds included; false where either is null.

    Of disjoint intervals only the last that begins by a row's end can reach its start, so each row looks up one.
    """
    merged = keep(merge_intervals(intervals, "start_us", "end_us", width=width).select(F.col("start_us").alias("_x"), F.col("end_us").alias("_y")))
    met = last_row_before(rows, merged, end, "_x", ["_y"], width)
    return met.withColumn(name, F.coalesce(F.col("_y") >= F.col(start), F.lit(False))).drop("_y")


def screen_windows(windows: DataFrame, exclusions: DataFrame, scope_start: int, scope_end: int, days: DataFrame | None = None) -> DataFrame:
    """Evidence windows (id, a_us, b_us) tagged out_of_scope, out_of_window, excluded or kept, the first that holds.

    days: series, day, start_us, end_us of each event day, for windows that have a series and a day: one that isn't inside
    its event day's, or whose event day isn't there, is out_of_window. Exclusion bounds count as excluded. A window with
    a null bound is kept if nothing else holds.
    """
    rows = touched(windows, exclusions, "a_us", "b_us", "_hit")
    outside = F.lit(False)
    if days is not None:
        bounds = days.select(F.col("series").alias("_series"), F.col("day").alias("_day"), F.col("start_us").alias("_from"), F.col("end_us").alias("_to"))
        rows = rows.join(bounds, F.col("series").eqNullSafe(F.col("_series")) & F.col("day").eqNullSafe(F.col("_day")), "left")
        outside = F.coalesce((F.col("a_us") < F.col("_from")) | (F.col("b_us") > F.col("_to")), F.col("_from").isNull())
    tag = F.when((F.col("a_us") < scope_start) | (F.col("b_us") > scope_end), "out_of_scope").when(outside, "out_of_window").when(F.col("_hit"), "excluded").otherwise("kept")
    return rows.withColumn("status", tag).drop("_hit", "_series", "_day", "_from", "_to")


def screen_tally(screened: DataFrame, exclusions: DataFrame, width: int = 60 * MINUTE_US) -> DataFrame:
    """Screened windows by status, and those excluded by each class of exclusions that meets them: kind, name, n.

    Classes overlap, so their counts may sum to more than the excluded; a class that meets none has 0.
    """
    out = screened.filter("status = 'excluded'").select("id", F.col("a_us"), F.col("b_us"))
    merged = merge_intervals(exclusions, "start_us", "end_us", ["class"])
    listed = out.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("a_us") / width), F.floor(F.col("b_us") / width))))
    spans = merged.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start_us") / width), F.floor(F.col("end_us") / width))))
    met = listed.join(spans, "_bin").filter("a_us <= end_us and b_us >= start_us").select("id", "class").distinct().groupBy("class").agg(F.count("*").alias("n"))
    classes = exclusions.select("class").distinct().join(met, "class", "left").select(F.lit("class").alias("kind"), F.col("class").alias("name"), F.coalesce("n", F.lit(0)).alias("n"))
    return screened.groupBy(F.lit("status").alias("kind"), F.col("status").alias("name")).agg(F.count("*").alias("n")).unionByName(classes)


def frames_in_windows(frames: DataFrame, windows: DataFrame, width: int = 60 * MINUTE_US) -> DataFrame:
    """Frames in (start, end] of each blind window, against the size of its burst."""
    inside = interval_join(frames.select("us"), windows.select("boundary_id", (F.col("start_us") + 1).alias("a"), F.col("end_us").alias("b")), "us", "a", "b", width)
    counts = inside.groupBy("boundary_id").agg(F.count("*").alias("frames"))
    out = windows.select("boundary_id", "burst_messages").join(counts, "boundary_id", "left").withColumn("frames", F.coalesce("frames", F.lit(0)))
    verdict = F.when(F.col("frames") == F.col("burst_messages"), "agreed").when(F.col("frames") > F.col("burst_messages"), "wider").otherwise("falsified")
    return out.withColumn("verdict", verdict)


def heartbeat_alarms(beats: DataFrame, stale_us: int = 300_000_000, most_gaps: int = 2, maintenance: tuple[int, int] | None = None) -> DataFrame:
    """Beats after which the next comes late, or with too many new gaps: stream, us, alarm.

    maintenance: from and to, in microseconds of the UTC day; a beat that would have become stale within it raises no
    stale alarm. Beats of a stream at one instant are in order of their gaps.
    """
    order = Window.partitionBy("stream").orderBy("us", "gaps")
    seen = beats.withColumn("next_us", F.lead("us").over(order)).withColumn("new_gaps", F.col("gaps") - F.coalesce(F.lag("gaps").over(order), F.lit(0)))
    late, many = F.col("next_us") - F.col("us") > stale_us, F.col("new_gaps") > most_gaps
    if maintenance:
        due = (F.col("us") + stale_us) % DAY_US
        late &= ~((due >= maintenance[0]) & (due < maintenance[1]))
    return seen.filter(late | many).select("stream", "us", F.when(late & many, "both").when(late, "stale").otherwise("gaps").alias("alarm"))


def heartbeat_days(beats: DataFrame, alarms: DataFrame) -> DataFrame:
    """Each UTC day with beats: streams, beats, alarms, and all_clear, the day's word that there were none."""
    day = F.floor(F.col("us") / DAY_US).alias("day")
    raised = alarms.groupBy(day).agg(F.count("*").alias("alarms"))
    days = beats.groupBy(day).agg(F.count_distinct("stream").alias("streams"), F.count("*").alias("beats")).join(raised, "day", "left")
    return days.withColumn("alarms", F.coalesce("alarms", F.lit(0).cast("long"))).withColumn("all_clear", F.col("alarms") == 0)


def manifest_totals(files: DataFrame) -> DataFrame:
    return files.groupBy("kind").agg(F.count("*").alias("objects"), F.sum("bytes").alias("bytes"), F.sum("n_rows").alias("n_rows"), F.array_join(F.sort_array(F.collect_set("root")), ",").alias("roots"))


def latency_floor(samples: DataFrame, least: int = 200, factor: int = 3, floor_us: int = 10_000_000) -> DataFrame:
    """Whether round trips were sampled often and evenly enough, their nearest-rank 90th percentile and what must persist."""
    good = samples.filter("ok").withColumn("hour", F.floor(F.col("us") / (60 * MINUTE_US)) % 24)
    hours = good.groupBy("hour").agg(F.count("*").alias("n"))
    even = hours.agg(F.count("*").alias("hours"), F.max("n").alias("most"), F.sum("n").alias("n"))
    p90 = good.agg(F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY elapsed_us)").cast("long").alias("p90_us"))
    adequate = (F.col("n") >= least) & (F.col("hours") == 24) & (F.col("most") * 24 <= F.col("n") * 2)
    return even.join(F.broadcast(p90)).select("n", "hours", adequate.alias("adequate"), "p90_us", F.greatest(F.col("p90_us") * factor, F.lit(floor_us)).alias("persist_us"))


def last_at_each(tape: DataFrame) -> DataFrame:
    """The last row of each ticker and instant, by id."""
    rank = F.row_number().over(Window.partitionBy("ticker", "us").orderBy(F.col("id").desc()))
    return tape.withColumn("_n", rank).filter("_n = 1").drop("_n")


def scale_census(rows: DataFrame, price: str, size: str) -> DataFrame:
    """Rows by the number of trailing zeros of price and size, that is by the scale they were quoted at."""
    zeros = lambda c: F.length(F.regexp_extract(F.col(c).cast("string"), "(0*)$", 1))
    return rows.groupBy(zeros(price).cast("long").alias("price_zeros"), zeros(size).cast("long").alias("size_zeros")).agg(F.count("*").alias("n_rows"), F.count_if("is_snapshot").alias("snapshot_rows"))


def latest_rows(rows: DataFrame, key: str, order: list[str], cols: list[str]) -> DataFrame:
    """The newest row of each key, as an upsert by key would leave it."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_r")).select(key, "_r.*")


def failure_log(rows: DataFrame, keys: list[str], us: str) -> DataFrame:
    """Failures by key: how often, and when first and last."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(us).alias("first_us"), F.max(us).alias("last_us"))


def evaluated_runs(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Maximal runs of equal values: key, value, first and last place and length."""
    changed = F.lag(value).over(Window.partitionBy(*by).orderBy(*order))
    runs = islands(df.withColumn("_was", changed), by, order, F.col("_was").isNull() | (F.col("_was") != F.col(value)))
    return runs.groupBy(*by, "island", value).agg(F.min(order[0]).alias("first_us"), F.max(order[0]).alias("last_us"), F.count("*").alias("n")).drop("island")
