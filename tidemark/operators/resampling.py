"""Bootstraps over clusters with a null value, a direction and an interval, and sign flips of whole blocks, studentised.

Draws are those of tidemark.functions.draw, so any engine makes the same ones. What is drawn from is a table of
aggregates, a row for each cluster or block; replicates are rows, spread over tasks by their number.
"""

from __future__ import annotations

import itertools
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import draw
from tidemark.functions.draws import TOGETHER, drawn
from tidemark.operators.inference import numbered
from tidemark.plans.keep import keep
from tidemark.plans.scan import running, total

EPSILON = sys.float_info.epsilon
#: What two statistics that are equal but for rounding may differ by.
ROUNDING = 1e-9
#: Clusters of a piece, which is one row of two arrays, and of a range, of which a task holds one.
PIECE, RANGE = 2**13, 2**22
#: Replicates of a task at least, so that clusters are sent to tasks in proportion to their number; and draws of a task at least.
TASK_REPLICATES, TASK_DRAWS = 100, 2**21


def _beyond(value: Column, observed: Column, direction: str) -> Column:
    if direction not in ("greater", "less"):
        raise ValueError(f"direction must be greater or less, not {direction!r}")
    return value >= observed - ROUNDING if direction == "greater" else value <= observed + ROUNDING


def _interval(df: DataFrame, by: list[str], value: str, level: float) -> list[Column]:
    return [F.percentile(value, F.lit(q)).alias(name) for q, name in (((1 - level) / 2, "at_low"), ((1 + level) / 2, "at_high"))]


def _column(arrays: list[pa.Array]) -> tuple[np.ndarray, np.ndarray | None]:
    """One array with a 0 after it, and which of its values are known, where some aren't. Whole numbers whose sums may not fit 64 bits are Python's."""
    whole = pa.concat_arrays(arrays)
    values = np.append(whole.fill_null(0).to_numpy(), whole.type.to_pandas_dtype()(0))
    if values.dtype.kind == "i" and max(-int(values.min()), int(values.max())) > 2**63 // TOGETHER:
        values = values.astype(object)
    return values, np.append(whole.is_valid().to_numpy(zero_copy_only=False), False) if whole.null_count else None


def _drawn_sums(seed: int, replicates: int, each: int, n: int, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of (tile, range, piece, total, weight), sorted, to the sums of what each replicate of a tile draws from a range of clusters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = ((tile, part, batch, k) for batch in batches for k, (tile, part) in enumerate(zip(batch["tile"].to_pylist(), batch["range"].to_pylist(), strict=True)))
        for (tile, part), rows in itertools.groupby(pieces, lambda x: x[:2]):
            held = [(batch["total"][k].values, batch["weight"][k].values) for _, _, batch, k in rows]
            (total, known), (weight, _) = (_column(list(c)) for c in zip(*held, strict=True))
            low, size = part * width, len(total) - 1
            reps = range(tile * each, min(replicates, (tile + 1) * each))
            sums = [[0, 0, 0] for _ in reps]
            for first, draws in drawn(seed, reps, n):
                at = (draws % np.uint32(n) if n < 2**32 else draws).astype(np.int64)
                if size < n:  # what lies in another range takes the 0 at the end
                    at = np.where((at >= low) & (at < low + size), at - low, size)
                taken = [c.take(at, mode="clip").sum(axis=1).tolist() for c in ((total, weight) if known is None else (total, weight, known))]
                for mine, found in zip(sums[first - reps.start :][: len(draws)], zip(*taken, strict=True), strict=True):
                    for k, x in enumerate(found):
                        mine[k] += x
            counted = [w != 0 if known is None else c > 0 for _, w, c in sums]
            columns = [pa.array(reps, pa.int64()), pa.array([s[0] if c else None for s, c in zip(sums, counted, strict=True)], held[0][0].type), pa.array([s[1] for s in sums], held[0][1].type)]
            yield pa.RecordBatch.from_arrays(columns, names=["rep", "total", "weight"])

    return run


def _ratios(clusters: DataFrame, seed: int, replicates: int, width: int) -> DataFrame:
    """Ratio r of each replicate rep, which draws with replacement as many clusters as there are.

    clusters: _id, total, weight, where the ids of a part of 2 ** 33 are those of one task's rows. A draw's place is a hash of
    its own, so every one is made, but none is a row: a task has some replicates and a range of width clusters as arrays, makes
    its replicates' draws and adds up what they take from the range. So memory is bounded by the range, and shuffles grow
    with the clusters. With more clusters than a range holds, each range makes the draws anew.
    """
    n, kinds = clusters.count(), dict(clusters.dtypes)
    each = min(replicates, max(TASK_REPLICATES, TASK_DRAWS // max(n, 1)))
    tiles, ranges = -(-replicates // each), max(1, -(-n // width))
    placed = running(clusters, [], ["_id"], 2**33, {"i": total(F.lit(1), through=False)})
    place = [F.floor(F.col("i") / width).cast("int").alias("range"), F.floor(F.col("i") % width / PIECE).alias("piece")]
    pieces = placed.groupBy(*place).agg(F.array_sort(F.collect_list(F.struct("i", "total", "weight"))).alias("rows"))
    dealt = pieces.select(F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"), "range", "piece", F.col("rows.total").alias("total"), F.col("rows.weight").alias("weight"))
    dealt = dealt.repartitionById(tiles * ranges, (F.col("tile") * ranges + F.col("range")).cast("int")).sortWithinPartitions("tile", "range", "piece")
    sums = dealt.mapInArrow(_drawn_sums(seed, replicates, each, n, width), f"rep long, total {kinds['total']}, weight {kinds['weight']}")
    return sums.groupBy("rep").agg((F.sum("total") / F.sum("weight")).alias("r"))


def ratio_bootstrap(clusters: DataFrame, order: list[str], seed: int, replicates: int = 10_000, null: float = 0.0, direction: str = "greater", level: float = 0.95, width: int = RANGE) -> DataFrame:
    """Ratio of sums over clusters (total, weight): estimate, clusters, p_value, low, high, spread, degenerate.

    The pivot of replicate less estimate gives the p-value, (1 + those as extreme) / (replicates + 1), and the basic
    interval. degenerate says that replicates differ by rounding alone. Clusters without a positive weight are left
    out; no clusters give no row. width is how many clusters a task holds at most; with more, draws are made more than once.
    """
    whole = {c for c, kind in clusters.dtypes if kind in ("tinyint", "smallint", "int", "bigint")}
    sums = [F.col(c).cast("long" if c in whole else "double").alias(c) for c in ("total", "weight")]
    clusters = keep(clusters.filter("weight > 0").orderBy(*order).select(F.monotonically_increasing_id().alias("_id"), *sums))
    point = clusters.agg((F.sum("total") / F.sum("weight")).alias("estimate"), F.count("*").alias("clusters")).filter("clusters > 0")
    rows = _ratios(clusters, seed, replicates, width).join(F.broadcast(point))
    extreme = F.count_if(_beyond(F.col("r") - F.col("estimate"), F.col("estimate") - null, direction)).alias("extreme")
    out = rows.groupBy("estimate", "clusters").agg(extreme, *_interval(rows, [], "r", level), F.stddev_pop("r").alias("spread"), F.avg(F.abs("r")).alias("scale"))
    return out.select(
        "estimate", "clusters", ((1 + F.col("extreme")) / F.lit(replicates + 1)).alias("p_value"), (2 * F.col("estimate") - F.col("at_high")).alias("low"), (2 * F.col("estimate") - F.col("at_low")).alias("high"),
        "spread", (F.col("spread") <= replicates * EPSILON * F.col("scale")).alias("degenerate"),
    )


def _flipped(blocks: DataFrame, seed: int, replicates: int) -> DataFrame:
    """t of each replicate, and whether it has no spread: blocks of residual and bulk (sum of absolute residuals) with random signs."""
    flips = blocks.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("shifted", F.when(draw(seed, "rep", "i") % 2 == 0, F.col("residual")).otherwise(-F.col("residual")))
    flips = flips.repartition("rep")
    offsets = flips.groupBy("rep").agg((F.sum("shifted") / F.sum("weight")).alias("offset"))
    centred = flips.join(offsets, "rep").withColumn("centre", F.col("offset") * F.col("weight"))
    square = lambda x: F.sqrt(F.sum(x * x)) / F.sum("weight")
    each = centred.groupBy("rep").agg(F.first("offset").alias("offset"), square(F.col("shifted") - F.col("centre")).alias("error"), square(F.col("bulk") + F.abs("centre")).alias("scale"), F.sum("terms").alias("n"))
    flat = F.col("error") <= F.col("n") * EPSILON * F.col("scale")
    return each.select(flat.alias("flat"), F.when(~flat, F.col("offset") / F.col("error")).alias("t"))


def wild_t_bootstrap(rows: DataFrame, block: list[str], seed: int, replicates: int = 10_000, null: float = 0.0, direction: str = "greater", level: float = 0.95) -> DataFrame:
    """Mean of total per weight with errors clustered by block: estimate, standard_error, t, p_value, low, high, blocks, flat.

    The p-value flips the signs of whole blocks' residuals under the null, each replicate studentised by its own
    blocks; replicates without spread (flat, counted) are as extreme as can be. The interval inverts replicates of the
    residuals around the estimate, so it doesn't move with the null. Rows without a positive weight are left out; none
    give no row; without spread in the data the statistics are null.
    """
    rows = rows.filter("weight > 0")
    point = rows.agg((F.sum("total") / F.sum("weight")).alias("estimate"), F.sum("weight").alias("whole")).filter("whole > 0")
    met = rows.join(F.broadcast(point))
    own, free = F.col("total") - F.lit(null) * F.col("weight"), F.col("total") - F.col("estimate") * F.col("weight")
    sums = [F.sum("weight").cast("double").alias("weight"), F.count("*").alias("terms"), F.sum(own).alias("own"), F.sum(F.abs(own)).alias("own_bulk"), F.sum(free).alias("free"), F.sum(F.abs(free)).alias("free_bulk")]
    blocks = numbered(met.groupBy(*block).agg(*sums), block).drop("n")
    error = point.join(blocks.agg((F.sqrt(F.sum(F.col("free") * F.col("free"))) / F.sum("weight")).alias("standard_error"), F.count("*").alias("blocks")))
    error = error.withColumn("standard_error", F.when(F.col("standard_error") > 0, F.col("standard_error"))).withColumn("t", (F.col("estimate") - null) / F.col("standard_error"))
    named = lambda kind: blocks.select("i", "weight", "terms", F.col(kind).alias("residual"), F.col(f"{kind}_bulk").alias("bulk"))
    under = _flipped(named("own"), seed, replicates).withColumnRenamed("t", "flipped").join(F.broadcast(error.select("t")))
    tested = under.agg(F.count_if(F.col("flat") | _beyond(F.col("flipped"), F.col("t"), direction)).alias("extreme"), F.count_if("flat").alias("flat"))
    around = _flipped(named("free"), seed + 1, replicates)
    around = around.agg(*_interval(around, [], "t", level))
    out = error.join(tested).join(around)  # one row each
    bound = lambda at: F.col("estimate") - F.col("standard_error") * F.col(at)
    p = F.when(F.col("t").isNotNull(), (1 + F.col("extreme")) / F.lit(replicates + 1))
    return out.select("estimate", "standard_error", "t", p.alias("p_value"), bound("at_high").alias("low"), bound("at_low").alias("high"), "blocks", "flat")


def _admitted(values: DataFrame, block: list[str], value: str, candidates: list[tuple[int, str]], seed: int, replicates: int, level: float) -> list[bool]:
    """Whether the median may be each of some candidates, tested in the direction beside it: all in one job, one row comes back.

    A block's statistic is its values above the candidate less those below; with random signs for whole blocks it is the
    mean of signs under a median that is the candidate, each replicate studentised by its own blocks.
    """
    sign = lambda c: F.when(F.col(value).isNull(), 1).otherwise(F.signum(F.col(value) - c)).cast("long")
    n = range(len(candidates))
    blocks = values.groupBy(*block).agg(F.count("*").alias("w"), *(F.sum(sign(c)).alias(f"s{k}") for k, (c, _) in enumerate(candidates)))
    blocks = numbered(blocks, block).drop("n")
    whole = blocks.agg(F.sum("w").cast("double").alias("W"), F.sum(F.col("w") * F.col("w")).cast("double").alias("W2"), *(F.sum(F.col(f"s{k}") * F.col(f"s{k}")).cast("double").alias(f"q{k}") for k in n))
    flips = blocks.withColumn("rep", F.explode(F.sequence(F.lit(-1), F.lit(replicates - 1)))).withColumn("f", F.when((F.col("rep") < 0) | (draw(seed, "rep", "i") % 2 == 0), 1).otherwise(-1))
    sums = [F.sum(F.col("f") * F.col(f"s{k}") * x).cast("double").alias(f"{name}{k}") for k in n for name, x in (("a", F.lit(1)), ("b", F.col("w")))]
    reps = flips.groupBy("rep").agg(*sums).join(F.broadcast(whole))

    def t(k: int) -> Column:
        offset = F.col(f"a{k}") / F.col("W")
        spread = F.col(f"q{k}") - 2 * offset * F.col(f"b{k}") + offset * offset * F.col("W2")
        return F.when(spread > ROUNDING * F.col(f"q{k}"), F.col(f"a{k}") / F.sqrt(spread))

    reps = reps.select("rep", *(t(k).alias(f"t{k}") for k in n))
    # replicate -1 has no sign turned: it is what was observed
    seen = reps.filter("rep < 0").select(*(F.col(f"t{k}").alias(f"o{k}") for k in n))
    rows = reps.filter("rep >= 0").join(F.broadcast(seen))
    p = [(1 + F.count_if(F.col(f"t{k}").isNull() | _beyond(F.col(f"t{k}"), F.col(f"o{k}"), d))) / F.lit(replicates + 1) for k, (_, d) in enumerate(candidates)]
    return list(rows.agg(*(F.coalesce(F.first(f"o{k}").isNotNull() & (p[k] > (1 - level) / 2), F.lit(False)).alias(f"p{k}") for k in n)).first())


def median_interval(values: DataFrame, block: list[str], value: str, seed: int, replicates: int = 1_000, level: float = 0.95, width: int = 100_000, ways: int = 16) -> DataFrame:
    """Median of whole numbers with the interval of those that a studentised sign-flip test over blocks doesn't reject: estimate, low, high, n, censored.

    A null value is censored: longer than all others. The estimate is the value of the middle rank. From it on outwards,
    down and up, a bound is the last of the values that is admitted before one is refused. It is looked for by ranks: in
    each round some values between the last admitted and the first refused are tested, in one job for both sides, until
    none lie between; the driver gets their verdicts alone. So a bound is next to a value that is refused, or is the
    outermost. Where half or more are censored, or the estimate itself is refused, bounds are null; no values give no row.
    """
    values = keep(values.select(*block, value))
    size = values.agg(F.count("*").alias("n"), (F.count("*") - F.count(value)).alias("censored")).filter("n > 0")
    n = (size.first() or [0])[0]
    bins = values.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_c"))
    upto = running(bins, [], [value], width, {"_upto": total(F.col("_c"))})
    start = upto.filter(2 * F.col("_upto") >= n).agg(F.min(value)).first()[0] if n else None
    # for each side: the last admitted, the first refused, and whether it is still looked for
    sides = {"low": [start, None, start is not None], "high": [start, None, start is not None]}
    ends = {"low": ("greater", F.max, F.min), "high": ("less", F.min, F.max)}
    if start is not None:
        for side, ok in zip(sides, _admitted(values, block, value, [(start, ends[s][0]) for s in sides], seed, replicates, level), strict=True):
            if not ok:
                sides[side] = [None, start, False]
    while any(s[2] for s in sides.values()):
        asked: list[tuple[int, str]] = []
        owners: list[str] = []
        for side, (last, refused, open_) in sides.items():
            if not open_:
                continue
            outwards = F.col(value) < last if side == "low" else F.col(value) > last
            if refused is not None:
                outwards &= F.col(value) > refused if side == "low" else F.col(value) < refused
            spread = F.percentile_approx(value, [k / (ways + 1) for k in range(1, ways + 1)], 10_000)
            r = values.filter(outwards).agg(ends[side][1](value), ends[side][2](value), spread).first()
            found = sorted({x for x in (r[0], r[1], *(r[2] or [])) if x is not None}, reverse=side == "low")
            if not found:
                sides[side][2] = False
            asked += [(x, ends[side][0]) for x in found]
            owners += [side] * len(found)
        verdicts = _admitted(values, block, value, asked, seed, replicates, level) if asked else []
        for side in sides:
            if not sides[side][2]:
                continue
            for (x, _), ok, owner in zip(asked, verdicts, owners, strict=True):
                if owner != side:
                    continue
                if not ok:
                    sides[side][1] = x
                    break
                sides[side][0] = x
    kind = values.schema[value].dataType
    return size.select(*(F.lit(x).cast(kind).alias(c) for c, x in (("estimate", start), ("low", sides["low"][0]), ("high", sides["high"][0]))), "n", "censored")
