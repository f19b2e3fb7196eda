"""Hard negatives by cover trees over norm-augmented candidates.

A vector x gets one more component, sqrt(M * M - |x| * |x|), so that all candidates of a tree have the norm M, and an
anchor a gets a zero there: products stay as they are, and what lies near in distance has near products. A tree is built
level by level: a node's centres are chosen farthest first until they cover its vectors within a part of its radius, or
there are FAN of them, and each vector goes to the nearest. A node keeps its centre and the covering radius of all that
lies under it, so a product with anything under it is within |a| * radius of the product with its centre.

Anchors descend together. A node is left out for an anchor whose window of scores lies outside of its bounds; the leaves
that are left are met by each window in the order of their upper bounds, and end where these fall below its k-th score.
Their vectors are scored in exact integers. As in the exact search of this package, random components leave bounds too
wide to skip much; in clusters most nodes are skipped.

Candidates are dealt to ranges by label, strongest component and id, and each cell of ranges and groups of anchors is a
bounded task. Rows in range tables are checkpointed, so a task that runs again meets the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._spark import keep
from tidemark.llm._words import give_back
from tidemark.llm.topk import _matrix, _padded, _products

#: Vectors of a leaf and of a range, centres of a node, and the part of its radius within which they are to cover.
LEAF, RANGE, FAN, COVER = 64, 32_768, 16, 0.5
#: Anchors of a group and of those met at once, and one of how many candidates is met first.
GROUP, SHARE, PART = 4096, 256, 64
_LONG = (1 << 63) - 1


@dataclass
class Node:
    """rows: places of the vectors under a leaf, in order of their ids; children of any other; same: the label, where all have one."""

    centre: np.ndarray
    radius: float
    rows: np.ndarray | None
    children: list[Node]
    same: int | None


def augmented(matrix: np.ndarray) -> np.ndarray:
    """Vectors with one more component that makes their norms equal."""
    wide = matrix.astype(np.float64)
    squares = np.einsum("ij,ij->i", wide, wide)
    return np.column_stack([wide, np.sqrt(np.maximum(squares.max(initial=0.0) - squares, 0))])


def _far(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    apart = points - centre
    return np.sqrt(np.einsum("ij,ij->i", apart, apart))


def cover_tree(points: np.ndarray, labels: np.ndarray, leaf: int = LEAF) -> Node | None:
    """The tree over points, which are in order of their ids; none for no points."""

    def made(rows: np.ndarray) -> Node:
        own = points[rows]
        centre = own.mean(axis=0)
        radius = float(_far(own, centre).max()) * (1 + 1e-9)
        first = int(labels[rows[0]])
        return Node(centre, radius, rows, [], first if (labels[rows] == first).all() else None)

    if not len(points):
        return None
    root = made(np.arange(len(points)))
    todo = [root]
    while todo:
        node = todo.pop()
        rows = node.rows
        if len(rows) <= leaf:
            continue
        own = points[rows]
        nearest = _far(own, own[np.argmax(_far(own, node.centre))])
        which, n = np.zeros(len(rows), np.int64), 1
        while n < FAN and nearest.max() > COVER * node.radius:
            far = _far(own, own[np.argmax(nearest)])
            closer = far < nearest
            which[closer], nearest[closer] = n, far[closer]
            n += 1
        parts = [rows[which == c] for c in range(n)]
        parts = [p for p in parts if len(p)]
        if len(parts) == 1:  # copies of one vector, or as good as that
            parts = np.array_split(rows, min(FAN, -(-len(rows) // leaf)))
        else:
            large = max(range(len(parts)), key=lambda i: len(parts[i]))
            if len(parts[large]) > 0.9 * len(rows):  # all but some outliers: halves, so that the tree stays low
                own = parts.pop(large)
                by_far = own[np.argsort(_far(points[own], points[own].mean(axis=0)), kind="stable")]
                parts += [np.sort(h) for h in np.array_split(by_far, 2)]
        node.children, node.rows = [made(p) for p in parts], None
        todo += node.children
    return root


def _alive(least: np.ndarray, most: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return (most >= low) & (least <= high)


def descend(root: Node, anchors: np.ndarray, low: np.ndarray, high: np.ndarray, own: np.ndarray | None = None, other: np.ndarray | None = None, met: list[int] | None = None) -> tuple[list[Node], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The leaves whose bounds meet the anchors' windows [low, high]: leaves, and for each meeting its leaf, anchor, lower and upper bound.

    own: only vectors of the anchor's label; other: none of it. met gets the number of (anchor, node) bounds computed.
    """
    norm = np.sqrt(np.einsum("ij,ij->i", anchors, anchors))
    wide = np.column_stack([anchors, np.zeros(len(anchors))])
    leaves, which, who, lower, upper = [], [], [], [], []
    everyone = np.arange(len(anchors))
    todo = [(root, everyone, np.full(len(anchors), -np.inf), np.full(len(anchors), np.inf))]
    while todo:
        node, asked, least, most = todo.pop()
        if node.rows is not None:
            which.append(np.full(len(asked), len(leaves)))
            leaves.append(node)
            who.append(asked)
            lower.append(least)
            upper.append(most)
            continue
        centres, radii = np.array([c.centre for c in node.children]), np.array([c.radius for c in node.children])
        mid = wide[asked] @ centres.T
        # room for the rounding of products and radii, so that bounds hold whatever the size of the components
        reach = norm[asked][:, None] * (radii + 1e-9 * (1 + np.sqrt(np.einsum("ij,ij->i", centres, centres)) + radii)) + 1e-6
        if met is not None:
            met.append(mid.size)
        under, over = np.maximum(mid - reach, least[:, None]), np.minimum(mid + reach, most[:, None])
        for c, child in enumerate(node.children):
            go = _alive(under[:, c], over[:, c], low[asked], high[asked])
            if child.same is not None:
                if own is not None:
                    go &= own[asked] == child.same
                if other is not None:
                    go &= other[asked] != child.same
            if go.any():
                todo.append((child, asked[go], under[go, c], over[go, c]))
    join = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
    return leaves, join(which, np.int64), join(who, np.int64), join(lower, np.float64), join(upper, np.float64)


@dataclass
class Found:
    """Scores of some windows, the best first: window, score, id."""

    window: np.ndarray
    score: np.ndarray
    name: np.ndarray

    def best(self, k: int) -> Found:
        place = np.unique(self.score, return_inverse=True)[1]
        order = np.lexsort((self.name, -place, self.window))
        window = self.window[order]
        first = np.searchsorted(window, window)
        order = order[np.arange(len(order)) - first < k]
        return Found(self.window[order], self.score[order], self.name[order])


def search_windows(
    ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray, root: Node, anchor_ids: np.ndarray, anchor_labels: np.ndarray, anchors: np.ndarray,
    window_of: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool, scored: list[int] | None = None,
) -> Found:
    """The k best (score, id) of each window over one tree: scores from low to high, ties to the smaller id.

    window_of: the anchor of each window; low, high: arrays of integers. same: candidates of the anchor's label with another id, else those of another
    label. scored gets the number of (anchor, leaf) products of each turn.
    """
    exact = np.float64 if _safe(anchors, matrix) else object
    low, high = low.astype(exact), high.astype(exact)
    under, over = np.full(len(anchors), np.inf), np.full(len(anchors), -np.inf)
    np.minimum.at(under, window_of, low.astype(np.float64))
    np.maximum.at(over, window_of, high.astype(np.float64))
    wide = anchors.astype(np.float64)
    leaves, which, who, least, most = descend(root, wide, under, over, anchor_labels if same else None, None if same else anchor_labels)
    # meetings of anchors become meetings of their windows
    by_anchor = np.argsort(who, kind="stable")
    begin = np.searchsorted(who[by_anchor], np.arange(len(anchors) + 1))
    sizes = (begin[1:] - begin[:-1])[window_of]
    window = np.repeat(np.arange(len(window_of)), sizes)
    at = by_anchor[np.repeat(begin[:-1][window_of], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)]
    fits = _alive(least[at], most[at], low.astype(np.float64)[window], high.astype(np.float64)[window])
    window, at = window[fits], at[fits]
    order = np.lexsort((-most[at], window))
    window, at = window[order], at[order]
    place = np.arange(len(window)) - np.searchsorted(window, window)
    found = Found(np.zeros(0, np.int64), np.zeros(0, exact), np.zeros(0, np.int64))
    need = low.copy()
    turn, turns = 0, 1
    while len(window):
        now = (place >= turn) & (place < turn + turns) & (most[at] >= need[window].astype(np.float64))
        new_w, new_s, new_n = [found.window], [found.score], [found.name]
        own_window, leaf = window[now], which[at[now]]
        by_leaf = np.argsort(leaf, kind="stable")
        own_window, leaf = own_window[by_leaf], leaf[by_leaf]
        cuts = np.flatnonzero(np.diff(leaf, prepend=-1))
        total = 0
        for asked, l in zip(np.split(own_window, cuts[1:]), leaf[cuts].tolist(), strict=True) if len(leaf) else ():
            rows = leaves[l].rows
            unique, back = np.unique(window_of[asked], return_inverse=True)
            products = _products(anchors[unique], matrix[rows]).astype(exact)
            total += len(unique)
            alike = anchor_labels[unique][:, None] == labels[rows][None, :]
            right = alike & (anchor_ids[unique][:, None] != ids[rows][None, :]) if same else ~alike
            scores = products[back]
            w, c = np.nonzero(((scores >= need[asked][:, None]) & (scores <= high[asked][:, None])).astype(bool) & right[back])
            new_w.append(asked[w])
            new_s.append(scores[w, c])
            new_n.append(ids[rows][c])
        if scored is not None:
            scored.append(total)
        found = Found(np.concatenate(new_w), np.concatenate(new_s), np.concatenate(new_n)).best(k)
        full = np.flatnonzero(np.bincount(found.window, minlength=len(window_of)) >= k)
        if len(full):
            last = np.searchsorted(found.window, full, side="right") - 1
            need[full] = np.maximum(need[full], found.score[last])
        left = (place >= turn + turns) & (most[at] >= need[window].astype(np.float64))
        window, at, place = window[left], at[left], place[left]
        turn, turns = turn + turns, 2 * turns
    return found


def _safe(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether all products are exact as floats."""
    return float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * max(a.shape[1], 1) < 2**53


#: Bounds of a window whose score may be anything.
_OPEN = 1 << 200


def _long(score: object) -> int:
    return min(max(int(score), -_LONG - 1), _LONG)


def _window(w: dict, same: bool, top: int, least: int, most: int) -> tuple[int, int]:
    """The least and the highest whole score of a window: least * positive <= top * score <= most * positive, and its floor."""
    floor = -_OPEN if w["floor"] is None else w["floor"]
    if same:
        return floor, _OPEN
    return max(floor, -(-least * w["positive_score"] // top)), most * w["positive_score"] // top


def _cells(k: int, same: bool, top: int, least: int, most: int):
    """Finds the positives (same) or the negatives of a group of anchors in a range."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ("window", "score", "vec_id")
        out: list[tuple[int, int, int]] = []
        if left.num_rows and right.num_rows:
            left, right = left.combine_chunks(), right.combine_chunks()
            ids = left.column("vec_id").chunk(0).to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, labels, vectors = ids[order], left.column("label").chunk(0).to_numpy()[order], _matrix(left.column("v").chunk(0))[order]
            anchors = _matrix(right.column("q").chunk(0))
            width = max(vectors.shape[1], anchors.shape[1])
            vectors, anchors = _padded(vectors, width), _padded(anchors, width)
            root = cover_tree(augmented(vectors), labels)
            anchor_ids, anchor_labels = right.column("anchor_id").chunk(0).to_numpy(), right.column("anchor_label").chunk(0).to_numpy()
            windows = right.column("windows").to_pylist()
            for share in range(0, len(anchors), SHARE):
                own = slice(share, share + SHARE)
                listed = [(i, w["window"], *_window(w, same, top, least, most)) for i, ws in enumerate(windows[own]) for w in ws]
                listed = [x for x in listed if x[2] <= x[3]]
                if not listed:
                    continue
                of, _, low, high = zip(*listed, strict=True)
                found = search_windows(
                    ids, labels, vectors, root, anchor_ids[own], anchor_labels[own], anchors[own],
                    np.array(of, np.int64), np.array(low, dtype=object), np.array(high, dtype=object), k, same,
                )
                out += [(listed[w][1], _long(s), n) for w, s, n in zip(found.window.tolist(), found.score.tolist(), found.name.tolist(), strict=True)]
        give_back()
        columns = list(zip(*out, strict=True)) if out else [[], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=list(names))

    return run


def labelled_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label and v = floor(scale * component) as longs of the rows that have all of it, finite."""
    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("e"))
    sound = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = whole.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("e").isNotNull()).filter(sound)
    return whole.select("vec_id", "label", F.transform("e", lambda x: F.floor(x * F.lit(float(scale)))).alias("v"))


def hard_negatives(vectors: DataFrame, positives: int = 5, negatives: int = 10, every: int = 100, least: int = 30, most: int = 90, top: int = 100) -> DataFrame:
    """Hard negatives of each anchor's positives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors: vec_id, label, v (array of longs), none of them null. Anchors are the rows whose vec_id is divisible by every. An anchor's
    positives are the rows of its label with another vec_id that have the highest integer inner products with it, ties
    to the smaller vec_id; for each the first negatives rows of another label with least * positive score <= top * score
    <= most * positive score are ranked in the same order. top and positives are above 0.

    Shorter vectors count as filled up with zeros. A repeated row is a candidate each time and, as an anchor, has its own
    rows each time. Scores beyond a long are cut to it. Other columns are ignored; no rows give no rows.
    """
    rows = vectors.select("vec_id", "label", "v")
    sizes = F.transform("v", F.abs)
    strongest = F.array_position(sizes, F.array_max(sizes))
    lead = F.coalesce(F.when(F.get("v", (strongest - 1).cast("int")) < 0, -strongest).otherwise(strongest), F.lit(0)).cast("long")
    total = rows.count()
    ranges = max(1, -(-total // RANGE))
    own_row = F.monotonically_increasing_id()
    rows = rows.withColumn("lead", lead).withColumn("row", own_row).repartitionByRange(ranges, "label", "lead", "vec_id", "row")
    rows = keep(rows.select("vec_id", "label", "v", "row", F.spark_partition_id().cast("long").alias("range")))
    anchors = keep(rows.filter(F.col("vec_id") % every == 0).select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"), "label", "v"))
    asked = anchors.count()
    groups = max(1, -(-asked // GROUP))
    holds = rows.select("label", "range").distinct()
    anchors = anchors.withColumn("group", F.pmod(F.xxhash64("anchor"), F.lit(groups)))

    # positives: each anchor is one window, met only in the ranges that hold its label
    one = F.array(F.struct(F.col("anchor").alias("window"), F.lit(0).cast("long").alias("positive_score"), F.lit(None).cast("long").alias("floor")))
    near = anchors.withColumn("windows", one).join(holds, "label")
    found = _met(rows, near, groups, _cells(positives, True, top, least, most))
    best = keep(_ranked(found, positives).select(F.col("window").alias("anchor"), F.col("rank").alias("nth"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    # windows: what a part of all candidates reaches is a floor under the k-th score of all
    best = best.withColumn("window", F.col("anchor") * positives + F.col("nth") - 1)
    part = rows.filter(F.pmod(F.xxhash64("vec_id", "v"), F.lit(PART)) == 0).withColumn("range", F.expr(f"range div {PART}"))
    first = _met(part, _windowed(anchors, best.withColumn("floor", F.lit(None).cast("long")), _numbers(rows, max(1, -(-ranges // PART)))), groups, _cells(negatives, False, top, least, most))
    floor = F.when(F.abs(F.min("score")) < F.lit(_LONG), F.min("score"))
    floors = _ranked(first, negatives).groupBy("window").agg(F.when(F.count("*") == negatives, floor).alias("floor"))
    whole = _met(rows, _windowed(anchors, best.join(floors, "window", "left"), _numbers(rows, ranges)), groups, _cells(negatives, False, top, least, most))
    ranked = _ranked(whole, negatives).select("window", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = ranked.join(best, "window").join(anchors.select("anchor", "anchor_id"), "anchor")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _numbers(rows: DataFrame, n: int) -> DataFrame:
    return rows.sparkSession.range(n).withColumnRenamed("id", "range")


def _windowed(anchors: DataFrame, best: DataFrame, ranges: DataFrame) -> DataFrame:
    """Anchors with their windows, for each range."""
    listed = best.groupBy("anchor").agg(F.collect_list(F.struct("window", "positive_score", "floor")).alias("windows"))
    n = ranges.count()
    return anchors.join(listed, "anchor").withColumn("range", F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>")))


def _met(rows: DataFrame, asked: DataFrame, groups: int, cells) -> DataFrame:
    """What cells finds (window, score, vec_id) of asked (anchor, anchor_id, label, v, group, range, windows) in each range."""
    dealt = rows.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<long>"))).select("range", "group", "vec_id", "label", "v")
    asked = asked.select("range", "group", "anchor_id", F.col("label").alias("anchor_label"), F.col("v").alias("q"), "windows")
    return dealt.groupBy("range", "group").cogroup(asked.groupBy("range", "group")).applyInArrow(cells, "window long, score long, vec_id long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("window").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def mined_negatives(vectors: DataFrame) -> DataFrame:
    """hard_negatives of a table (vec_id, embedding, label), where every seventh vec_id has the next of ten labels first.

    Rows with a null id, label or vector, or with null or non-finite components, take no part.
    """
    rows = labelled_vectors(vectors)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved))


ORACLE_SQL = """
    WITH v AS (
      SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scored AS (
      SELECT a.r AS anchor, a.vec_id AS anchor_id, a.label AS anchor_label, c.vec_id, c.label, list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * c.e[i]))::BIGINT AS score
      FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0
    ), positive AS (
      SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) AS nth FROM scored WHERE label = anchor_label
    ), ranked AS (
      SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor, p.nth ORDER BY n.score DESC, n.vec_id)::INT AS rank, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
      FROM positive p JOIN scored n ON n.anchor = p.anchor AND n.label <> n.anchor_label AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score WHERE p.nth <= 5
    )
    SELECT * FROM ranked WHERE rank <= 10
"""
