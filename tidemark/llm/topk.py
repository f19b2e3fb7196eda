"""Exact top-k inner products by block-at-a-time pruning.

Candidates are dealt to ranges by their strongest component. Within a range they are split in two along the direction
in which they differ most, and the halves again, down to blocks of near vectors, each with the largest and smallest
value of every component (its term maxima). For a query, a block's bound is the sum over components of the query's
weight times whichever of the two gives more. Blocks are scored through their own rows, highest bound first, until the
bounds fall below the query's k-th score. So that this doesn't start anew in every range, each query first meets a part
of all candidates: its k-th score there is a floor under the k-th of all. Ranges and groups of queries form a grid of
bounded tasks; the k best of each cell are merged by query.

How much is skipped depends on the vectors: most blocks where they lie in clusters, next to none where components are
random, as bounds over 64 independent components are then far above every score.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._spark import keep

#: Vectors of a block and of a range, queries of a group, and one of how many candidates is met first.
BLOCK, RANGE, GROUP, PART = 64, 32_768, 4096, 64
_LONG = (1 << 63) - 1
_LEAST = -(1 << 200)


def scaled_vectors(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id and v = floor(scale * component) as longs; rows that are null or hold null or non-finite components are left out."""
    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    sound = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return whole.filter(F.col("vec_id").isNotNull() & F.col("e").isNotNull()).filter(sound).select("vec_id", F.transform("e", lambda x: F.floor(x * F.lit(float(scale)))).alias("v"))


def _matrix(rows: pa.ListArray, width: int | None = None) -> np.ndarray:
    """Rows of longs, filled up with zeros to one width."""
    values, offsets = rows.values.to_numpy(zero_copy_only=False), rows.offsets.to_numpy()
    sizes = np.diff(offsets)
    width = max(int(sizes.max(initial=0)), width or 0)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    at = np.repeat(np.arange(len(sizes)), sizes)
    out[at, np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], sizes)] = values[offsets[0] : offsets[-1]]
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in exact integers, as floats where those are exact."""
    most = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return a.astype(np.float64) @ b.T.astype(np.float64)
    return a.astype(object) @ b.T.astype(object)


def _padded(a: np.ndarray, width: int) -> np.ndarray:
    return np.pad(a, ((0, 0), (0, width - a.shape[1]))) if a.shape[1] < width else a


def block_order(matrix: np.ndarray, block: int) -> np.ndarray:
    """Rows in an order that puts near ones into the same run of block rows."""
    whole, out, todo = matrix.astype(np.float64), [], [np.arange(len(matrix))]
    while todo:
        own = todo.pop()
        if len(own) <= block:
            out.append(own)
            continue
        apart = whole[own] - whole[own].mean(axis=0)
        along = apart[np.argmax(np.einsum("ij,ij->i", apart, apart))]
        for _ in range(4):  # towards the direction of the greatest spread
            size = np.linalg.norm(along)
            along = apart.T @ (apart @ (along / size)) if size > 0 else along
        order = own[np.argsort(apart @ along, kind="stable")]
        half = max(1, len(own) // (2 * block)) * block
        todo += [order[half:], order[:half]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def search(
    ids: np.ndarray, matrix: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, block: int = BLOCK, floors: np.ndarray | None = None, scored: list[int] | None = None
) -> list[list[tuple[int, int]]]:
    """The k best (score, id) of each query over one range, ties to the smaller id; a query's own id is left out.

    Scores below a query's floor may be left out as well. Each query meets its blocks in turns of 1, 2, 4, ... of the
    highest bounds left, so that queries can share the product with a block. scored gets the blocks that each turn scores.
    """
    width = max(matrix.shape[1], queries.shape[1])
    matrix, queries = _padded(matrix, width), _padded(queries, width)
    order = block_order(matrix, block)
    ids, matrix = ids[order], matrix[order]
    cuts = np.arange(0, len(ids), block)
    most, least = np.maximum.reduceat(matrix, cuts), np.minimum.reduceat(matrix, cuts)
    bounds = _products(np.maximum(queries, 0), most) + _products(np.minimum(queries, 0), least)
    order = np.argsort(-bounds, axis=1, kind="stable")
    best: list[list[tuple[int, int]]] = [[] for _ in query_ids]
    given = [None] * len(query_ids) if floors is None else list(floors)
    # what a score of each query must reach
    under = np.array([_LEAST if f is None else int(f) for f in given], dtype=object if bounds.dtype == object else np.float64)
    active, turn, turns = np.arange(len(query_ids)), 0, 1
    while turn < len(cuts):
        at = order[active, turn : turn + turns]
        go = bounds[active[:, None], at] >= under[active][:, None]
        who, which = np.nonzero(go)
        who, where = active[who], at[who, which]
        active = active[go[:, -1].astype(bool)]  # bounds fall from block to block
        turn, turns = turn + turns, 2 * turns
        if scored is not None:
            scored.append(len(who))
        by_block = np.argsort(where, kind="stable")
        who, where = who[by_block], where[by_block]
        for own, b in zip(np.split(who, np.flatnonzero(np.diff(where)) + 1), where[np.flatnonzero(np.diff(where, prepend=-1))].tolist(), strict=True) if len(who) else ():
            rows = slice(cuts[b], cuts[b] + block)
            scores, names = _products(queries[own], matrix[rows]), ids[rows]
            fits = (scores >= under[own][:, None]).astype(bool) & (names[None, :] != query_ids[own][:, None])
            for i in np.flatnonzero(fits.any(axis=1)).tolist():
                q, s, fit = int(own[i]), scores[i], np.flatnonzero(fits[i])
                if len(fit) > 4 * k and s.dtype != object:
                    fit = fit[s[fit] >= np.partition(s[fit], len(fit) - k)[len(fit) - k]]
                best[q] = sorted(best[q] + [(int(s[j]), int(names[j])) for j in fit.tolist()], key=lambda x: (-x[0], x[1]))[:k]
                if len(best[q]) == k:
                    under[q] = max(under[q], best[q][-1][0])
    return best


def _cells(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int, int]] = []
        if left.num_rows and right.num_rows:
            left, right = left.combine_chunks(), right.combine_chunks()
            ids, rows, names = (t.column(c).chunk(0).to_numpy() for t, c in ((left, "vec_id"), (right, "row"), (right, "query_id")))
            order = np.lexsort((ids, left.column("lead").to_numpy()))
            best = search(ids[order], _matrix(left.column("v").chunk(0))[order], names, _matrix(right.column("q").chunk(0)), k, floors=np.array(right.column("floor").to_pylist(), dtype=object))
            found = [(r, q, i, min(max(s, -_LONG - 1), _LONG)) for r, q, own in zip(rows.tolist(), names.tolist(), best, strict=True) for s, i in own]
        columns = list(zip(*found, strict=True)) if found else [[], [], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["row", "query_id", "vec_id", "score"])

    return run


def top_inner_products(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024) -> DataFrame:
    """Each query's k best rows by integer inner product: query_id, rank, vec_id, score.

    vectors: vec_id, embedding. Queries are the rows whose vec_id is divisible by every, candidates all rows with
    another vec_id; ties go to the smaller vec_id. Rows without id, vector, or with null or non-finite components take
    no part; shorter vectors count as filled up with zeros. A repeated row is a candidate each time and, as a query,
    ranked each time; scaled components and scores beyond a long are cut to it. Other columns are ignored; no rows give no rows.
    """
    rows = scaled_vectors(vectors, scale)
    strongest = F.array_position(F.transform("v", F.abs), F.array_max(F.transform("v", F.abs)))
    rows = rows.withColumn("lead", F.coalesce(F.when(F.get("v", (strongest - 1).cast("int")) < 0, -strongest).otherwise(strongest), F.lit(0)).cast("long"))
    queries = keep(rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")).withColumn("row", F.monotonically_increasing_id()))
    total, asked = rows.count(), queries.count()
    part = rows.filter(F.pmod(F.xxhash64("vec_id", "v"), F.lit(PART)) == 0)
    first = _met(part, queries.withColumn("floor", F.lit(None).cast("long")), max(1, total // PART), asked, k)
    # scores that were cut to a long are no floor for those that weren't
    floor = F.when(F.abs(F.min("score")) < F.lit(_LONG), F.min("score"))
    floors = keep(_ranked(first, k).groupBy("row").agg(F.when(F.count("*") == k, floor).alias("floor")))
    cells = _met(rows, queries.join(floors, "row", "left"), total, asked, k)
    return _ranked(cells, k).select("query_id", "rank", "vec_id", "score")


def _met(rows: DataFrame, queries: DataFrame, total: int, asked: int, k: int) -> DataFrame:
    """The k best of each query (row, query_id, vec_id, score) in each range of rows."""
    ranges, groups = max(1, -(-total // RANGE)), max(1, -(-asked // GROUP))
    dealt = rows.repartitionByRange(ranges, "lead", "vec_id").withColumn("range", F.spark_partition_id().cast("long"))
    dealt = dealt.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<long>")))
    asked_of = queries.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups))).withColumn("range", F.explode(F.sequence(F.lit(0), F.lit(ranges - 1)).cast("array<long>")))
    return dealt.groupBy("range", "group").cogroup(asked_of.groupBy("range", "group")).applyInArrow(_cells(k), "row long, query_id long, vec_id long, score long")


def _ranked(cells: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id"))
    return cells.withColumn("rank", rank).filter(F.col("rank") <= k)
