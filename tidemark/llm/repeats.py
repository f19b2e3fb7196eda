"""Repeated passages by a sparse suffix array over word minimisers.

1. Retain: of every WINDOW - K + 1 consecutive K-word grams the one with the smallest hash is retained, so every
   passage of WINDOW words retains exactly one position, chosen by its content alone. A retained position owns the
   windows that chose it.
2. Sort: retained suffixes are range-partitioned and sorted by their first K words and then by the whole of what they
   own, so a hot passage is spread over as many partitions as it needs.
3. Compare neighbours: a suffix whose neighbour owns the same words is repeated as a whole; one that shares only the
   first K words with a neighbour is a place where a repeat begins or ends.
4. Extend: only for those places, window by window to the left and right within what they own, is the match carried
   to its exact ends, again by sorting and comparing neighbours. Overlapping windows then join into maximal spans.

The order is that of two hashes, of the gram and of all the words owned, and equality is that of 64-bit hashes; no common
prefix of neighbours is computed. In an order by the words themselves the neighbour that agrees longest to the right may
agree little to the left, while a passage's other copy, which agrees to the left, lies further off: extending neighbours
alone would miss it (a test shows such texts). Groups of equal hashes meet all copies of what is owned at once, and where
copies differ within that, step 4 compares each window with all others.

The first occurrence, in order of doc_id and place, is kept; later ones may be removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._spark import keep, partitions
from tidemark.llm._words import MULTIPLIERS, _BASE, _INVERSE, _power, mix, pieces, signed, windows, words

#: Words of a gram by which positions are retained.
K = 12
LATER, FIRST, ENDS = 1, 2, 3


def retained(hashes: np.ndarray, first: np.ndarray, window: int, k: int = K) -> tuple[np.ndarray, ...]:
    """Retained positions of some texts: position, first and last window owned, hash of the gram, hash of what is owned.

    hashes holds the words of all texts, text i's at first[i]:first[i + 1]; positions count through all texts.
    """
    n = len(hashes)
    last = np.repeat(first[1:], np.diff(first)) - window  # last window of each word's text
    if n < window:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    grams = windows(hashes, k)
    least, at, span = grams, np.arange(len(grams)), 1
    reach = window - k + 1
    while span < reach:  # least of span grams, doubled
        step = min(span, reach - span)
        left, right = least[: len(least) - step], least[step:]
        take = left <= right
        least, at, span = np.where(take, left, right), np.where(take, at[: len(take)], at[step:]), span + step
    start = np.arange(n - window + 1)
    valid = start <= last[: n - window + 1]
    start, owner = start[valid], at[: n - window + 1][valid]
    new = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
    position, low = owner[new], start[new]
    high = start[np.append(new[1:], len(start)) - 1] if len(new) else low
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(hashes * _power(_BASE, n), out=total[1:])
    owned = mix((total[high + window] - total[low]) * _power(_INVERSE, n + 1)[low] + (position - low).astype(np.uint64) * MULTIPLIERS[30] + (high - low).astype(np.uint64) * MULTIPLIERS[31])
    return position, low, high, grams[position], owned


def _suffixes(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in pieces(batches):
            w = words(data, offsets)
            position, low, high, gram, owned = retained(w.hashes, w.first, window)
            if not len(position):
                continue
            doc = np.searchsorted(w.first, position, side="right") - 1
            doc = pa.array(doc)
            begin = w.first[doc.to_numpy()]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(doc), part.column("row").take(doc), pa.array((low - begin).astype(np.int32)), pa.array((high - begin).astype(np.int32)), signed(gram), signed(owned)],
                ["doc_id", "row", "low", "high", "gram", "owned"],
            )

    return run


def _distinct(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Batches of a sorted stream without rows that repeat the one before in all keys; with the keys as arrays."""
    last = None
    for batch in batches:
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        if not batch.num_rows:
            continue
        new = np.ones(batch.num_rows, dtype=bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
        new[0] = last is None or any(c[0] != x for c, x in zip(cols, last, strict=True))
        last = tuple(c[-1] for c in cols)
        if not new.all():
            batch, cols = batch.filter(pa.array(new)), [c[new] for c in cols]
        if batch.num_rows:
            yield batch, cols


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorts suffixes into whole repeats and places where repeats may end.

    Suffixes that own the same words are a run; of a run the first is the earliest occurrence. What lies beyond the
    partition isn't seen, so its first and last run count as places where repeats may end.
    """
    held = None  # the last run so far: its first row, rows, whether a neighbour shares its gram, gram, owned

    def settle(rows: pa.RecordBatch, size: np.ndarray, shares: np.ndarray) -> Iterator[pa.RecordBatch]:
        for kind, own in ((FIRST, size > 1), (ENDS, shares)):
            if own.any():
                yield _kind(rows.filter(pa.array(own)), kind)

    for batch, (gram, owned, _, _) in _distinct(batches, ["gram", "owned", "row", "low"]):
        new = np.ones(batch.num_rows, dtype=bool)
        new[1:] = (gram[1:] != gram[:-1]) | (owned[1:] != owned[:-1])
        new[0] = held is None or gram[0] != held[3] or owned[0] != held[4]
        start = np.flatnonzero(new)
        if not new.all():
            yield _kind(batch.filter(pa.array(~new)), LATER)
        if held is not None:
            until = start[0] if len(start) else batch.num_rows
            held = (held[0], held[1] + until, held[2], *held[3:])
            if len(start):
                yield from settle(held[0], np.array([held[1]]), np.array([held[2] or gram[start[0]] == held[3]]))
        if not len(start):
            continue
        same = gram[start[1:]] == gram[start[1:] - 1]
        before = np.concatenate([[held is None or gram[start[0]] == held[3]], same])
        yield from settle(batch.take(pa.array(start[:-1])), np.diff(start), before[:-1] | same)
        at = int(start[-1])
        held = (batch.slice(at, 1), batch.num_rows - at, bool(before[-1]), gram[at], owned[at])
    if held is not None:
        yield from settle(held[0], np.array([held[1]]), np.array([True]))


def _kind(rows: pa.RecordBatch, kind: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([rows.column(c) for c in ("doc_id", "row", "low", "high")] + [pa.array(np.full(rows.num_rows, kind, np.int32))], ["doc_id", "row", "low", "high", "kind"])


def _extended(window: int):
    """Hashes of the windows that the listed ranges own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in pieces(batches):
            w = words(data, offsets)
            grams = windows(w.hashes, window)
            for i, ranges in enumerate(part.column("ranges").to_pylist()):
                place = np.unique(np.concatenate([np.arange(r["low"], r["high"] + 1) for r in ranges]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").slice(i, 1).take(pa.array(np.zeros(len(place), np.int64))), pa.array(np.full(len(place), part.column("row")[i].as_py(), np.int64)), pa.array(place.astype(np.int32)), signed(grams[w.first[i] + place])],
                    ["doc_id", "row", "low", "words"],
                )

    return run


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks windows that have an equal neighbour (repeated) or an equal one before them (later).

    The first and the last row of the partition may have neighbours elsewhere and are marked as edges.
    """
    held, first, before = None, True, None

    def out(rows: pa.RecordBatch, repeated: np.ndarray, later: np.ndarray, edge: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([rows.column(c) for c in ("doc_id", "row", "low", "words")] + [pa.array(x) for x in (repeated, later, edge)], ["doc_id", "row", "low", "words", "repeated", "later", "edge"])

    for batch, (key, _, _) in _distinct(batches, ["words", "row", "low"]):
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            key = batch.column("words").to_numpy()
        later = np.concatenate([[before is not None and key[0] == before], key[1:] == key[:-1]])
        repeated = later | np.concatenate([key[1:] == key[:-1], [False]])
        edge = np.zeros(len(key), dtype=bool)
        edge[0], first = first and len(key) > 1, first and len(key) <= 1
        n = len(key) - 1  # the last row waits for the next batch
        if n:
            done = repeated[:n] | edge[:n]
            yield out(batch.slice(0, n).filter(pa.array(done)), repeated[:n][done], later[:n][done], edge[:n][done])
            before = key[n - 1]
        held = batch.slice(n, 1)
    if held is not None:
        later = np.array([before is not None and held.column("words")[0].as_py() == before])
        yield out(held, later, later, np.array([True]))


def _spans(window: int):
    def merged(ranges: list[dict]) -> list[tuple[int, int]]:
        out: list[list[int]] = []
        for a, b in sorted((r["low"], r["high"] + window) for r in ranges):
            if out and a <= out[-1][1]:
                out[-1][1] = max(out[-1][1], b)
            else:
                out.append([a, b])
        return [tuple(x) for x in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.column("ranges").to_pylist():
                every, later = merged(r), merged([x for x in r if x["later"]])
                rows.append((sum(b - a for a, b in every), sum(b - a for a, b in later), *(",".join(f"{a}-{b}" for a, b in x) for x in (every, later))))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))], ["doc_id", "row", "n_repeated", "n_later", "repeated", "later"])

    return run


def _identified(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))


def repeated_passages(docs: DataFrame, window: int = 50) -> DataFrame:
    """Passages of window words or more that occur elsewhere as well, in another document or the same one.

    docs: doc_id, text. Returns a row for each document that has some: doc_id, row (a hash of doc_id and text),
    n_repeated and n_later (words in such passages, and in those with an earlier occurrence), repeated and later (their
    spans as first-last word, end exclusive). Words are compared as they are, whatever white space is between them.

    Null, empty and short texts have none. A row that repeats another in doc_id and text is the same document; rows
    with one doc_id and different texts are different ones; a null doc_id counts as the smallest. Other columns are
    ignored; no rows give no rows.
    """
    if window < K:
        raise ValueError(f"window must be {K} at least")
    parts = partitions(docs)
    docs = _identified(docs)
    where = ["doc_id", "row", "low"]
    suffixes = docs.mapInArrow(_suffixes(window), "doc_id long, row long, low int, high int, gram long, owned long")
    order = ["gram", "owned", *where]
    found = keep(suffixes.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_neighbours, "doc_id long, row long, low int, high int, kind int"))
    ends = found.filter(F.col("kind") == ENDS).groupBy("row").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
    places = docs.join(ends, "row").select("doc_id", "row", "text", "ranges").mapInArrow(_extended(window), "doc_id long, row long, low int, words long")
    order = ["words", *where]
    compared = keep(places.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_compared, "doc_id long, row long, low int, words long, repeated boolean, later boolean, edge boolean"))
    same = Window.partitionBy("words")
    edges = compared.filter("edge").dropDuplicates(["words", "row", "low"]).withColumns({"repeated": F.col("repeated") | (F.count("*").over(same) > 1), "later": F.col("later") | (F.row_number().over(same.orderBy(*where)) > 1)})
    single = compared.filter("not edge").unionByName(edges).filter("repeated").select(*where, F.col("low").alias("high"), "later")
    ranges = found.filter(F.col("kind") != ENDS).select(*where, "high", (F.col("kind") == LATER).alias("later")).unionByName(single)
    return ranges.groupBy("doc_id", "row").agg(F.collect_list(F.struct("low", "high", "later")).alias("ranges")).mapInArrow(_spans(window), "doc_id long, row long, n_repeated long, n_later long, repeated string, later string")


def drop_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id and text of every document without the passages that occur earlier; what is left is cut at words.

    Texts without such passages stay as they are.
    """
    spans = repeated_passages(docs, window).filter("n_later > 0").select("row", "later")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in pieces(batches):
            w, texts = words(data, offsets), []
            for i, later in enumerate(part.column("later").to_pylist()):
                at, out = int(offsets[i]), []
                for a, b in (map(int, s.split("-")) for s in later.split(",")) if later else ():
                    out.append(data[at : w.starts[w.first[i] + a]].tobytes())
                    at = int(w.starts[w.first[i] + b]) if w.first[i] + b < w.first[i + 1] else int(offsets[i + 1])
                texts.append((b"".join(out) + data[at : offsets[i + 1]].tobytes()).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return _identified(docs).join(spans, "row", "left").select("doc_id", "text", "later").mapInArrow(run, "doc_id long, text string")
