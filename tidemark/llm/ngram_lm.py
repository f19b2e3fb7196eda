"""Bigram language model in a log-frequency Bloom filter.

Counting: chunks of documents send their distinct tokens and token pairs, with their counts in training documents, packed
by segment of the hash, to the tasks that own the segments. Storing: a count c becomes the level 1 + floor(log_BASE c),
and an n-gram of level q is put into the segment's filter q times, once for each level up to q. A filter is as large as
its entries ask for, and n-grams of every count are in it. Probing: what is known of an n-gram is the last level before
the first that is missing, and stands for the mean count of what was stored and is found at that level; so the counts of
all tokens sum to what was counted. Scoring: the probability of a token is interpolated between its share of the pairs
after the token before and its smoothed share of all tokens.

fit_model leaves the filters as a table, which score_with probes for any documents: its tasks get keys and a filter, and
no counts. score_documents fits and scores the same documents, and lets the tasks that built a filter probe it at once,
for keys of training and held-out documents alike, which saves sending all keys a second time; the scores are the same.

The token part sums to 1 over the tokens seen and one unknown. The pair part is not normalised by context: levels are
steps of half, so the probabilities after one context may sum to some hundredths more or less than 1.

No task and no broadcast holds the whole model: what a task holds is bounded by the sizes of a chunk and of a segment.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._groups import runs
from tidemark.llm._spark import keep, partitions
from tidemark.llm._words import MULTIPLIERS, mix, pieces, words

BASE = 1.5
#: Weight of the pair model; bits for every n-gram and level; probes of each.
PAIR_WEIGHT, BITS_EACH, PROBES = 0.5, 20, 8
#: Bytes of text in a chunk, and for which a segment is owned, in the mean; least bits of a segment.
CHUNK, SEGMENT, SEGMENT_BITS = 12 << 20, 16 << 20, 10
#: Levels that a count can have.
LEVELS = 110
END = np.uint64(0x6A09E667F3BCC909)
TOKEN, PAIR = 1, 2
_LOG = np.log(BASE)


def level_of(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log_BASE count); 0 for 0."""
    out = np.zeros(len(counts), dtype=np.int64)
    some = counts > 0
    out[some] = 1 + np.floor(np.log(counts[some]) / _LOG + 1e-9).astype(np.int64)
    return out


def count_of(levels: np.ndarray) -> np.ndarray:
    """The middle of the counts that have a level; 0 for level 0."""
    low = np.ceil(BASE ** (levels - 1.0) - 1e-6)
    return np.where(levels > 0, (low + np.maximum(low, np.ceil(BASE**levels - 1e-6) - 1)) / 2, 0.0)


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes with an end after each text, and where each text's begin."""
    w = words(data, offsets, lower=True)
    first = w.first + np.arange(len(w.first))
    out = np.empty(first[-1], dtype=np.uint64)
    out[first[1:] - 1] = END
    ends = np.ones(len(out), dtype=bool)
    ends[first[1:] - 1] = False
    out[ends] = w.hashes
    return out, first


def _pairs(tokens: np.ndarray) -> np.ndarray:
    """Hash of every token with the one before; the first of a text follows an end."""
    before = np.concatenate([[END], tokens[:-1]])
    return mix(before * MULTIPLIERS[7] + tokens * MULTIPLIERS[8])


def _segment(keys: np.ndarray, bits: int) -> np.ndarray:
    if not bits:
        return np.zeros(len(keys), dtype=np.int64)
    return (keys >> np.uint64(64 - bits)).astype(np.int64)


#: A pair's key keeps its segment and this many low bits.
_LOW = np.uint64((1 << 40) - 1)


def _packed(counts: np.ndarray) -> bytes:
    """A byte for each count; those from 255 follow at full width."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<i8").tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<i8", -1, n) if len(data) > n else 0
    return out


def _gaps(keys: np.ndarray, width: int) -> bytes:
    """Sorted keys as gaps, all lowest bytes first: the highest are nearly all 0, which the shuffle's compression takes."""
    return np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _from_gaps(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return np.cumsum(out.view("<u8").ravel(), dtype=np.uint64)


def _chunk(group: pa.Table) -> tuple[list[pa.RecordBatch], np.ndarray, np.ndarray]:
    """Rows of a chunk, their tokens, and how many each row has."""
    rows, tokens, n = [], [], []
    for part, data, offsets in pieces(group.combine_chunks().to_batches()):
        own, first = _tokens(data, offsets)
        rows.append(part)
        tokens.append(own)
        n.append(np.diff(first))
    return rows, np.concatenate(tokens), np.concatenate(n)


def _keys(tokens: np.ndarray, kind: int, bits: int) -> np.ndarray:
    return tokens if kind == TOKEN else _pairs(tokens) & (_LOW | ~np.uint64((1 << (64 - bits)) - 1))


_SENT = "chunk long, kind int, segment int, keys binary, counts binary"


def _sent(bits: int, counted: bool = True):
    """Distinct keys of each chunk by segment, and unless asked for levels alone their counts in training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["chunk"]):
            rows, tokens, n = _chunk(group)
            trains = ~np.concatenate([r.column("held_out").to_numpy(zero_copy_only=False) for r in rows]).astype(bool)
            trains, chunk = np.repeat(trains, n), group.column("chunk")[0].as_py()
            for kind in (TOKEN, PAIR):
                keys, which = np.unique(_keys(tokens, kind, bits), return_inverse=True)
                counts = np.bincount(which[trains], minlength=len(keys))
                cut = np.searchsorted(_segment(keys, bits), np.arange((1 << bits) + 1))
                low, out = keys & _LOW, []
                for s in np.flatnonzero(np.diff(cut)).tolist():
                    a, b = cut[s], cut[s + 1]
                    own = _gaps(keys[a:b], 8) if kind == TOKEN else _gaps(low[a:b], 5)
                    out.append((chunk, kind, s, own, _packed(counts[a:b]) if counted else b""))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["chunk", "kind", "segment", "keys", "counts"])

    return run


_ANSWERS = "chunk long, kind int, segment int, levels binary, counts binary, total long, distinct long"


def _stored(group: pa.Table, kind: int, segment: int, bits: int) -> tuple[Filter, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A segment's filter from what chunks sent of it; the distinct keys, their counts, where each chunk's begin and which key each is."""
    keys, counts = [], []
    for k, c in zip(group.column("keys").to_pylist(), group.column("counts").to_pylist(), strict=True):
        keys.append(_from_sent(k, kind, segment, bits))
        counts.append(_unpacked(c, len(keys[-1])))
    cut = np.cumsum([0, *(len(k) for k in keys)])
    unique, which = np.unique(np.concatenate(keys), return_inverse=True)
    summed = np.bincount(which, np.concatenate(counts), len(unique)).astype(np.int64)
    seen = summed > 0
    stored = level_of(summed[seen])
    size = 64 * (max(64, BITS_EACH * int(stored.sum())) // 64 + 1)
    return Filter(Filter.segment([(kind, unique[seen], stored)], size).reshape(1, -1), 0), unique, summed, cut, which


def _from_sent(data: bytes, kind: int, segment: int, bits: int) -> np.ndarray:
    return _from_gaps(data, 8) if kind == TOKEN else _from_gaps(data, 5) | np.uint64(segment) << np.uint64(64 - bits) if bits else _from_gaps(data, 5)


def _by_level(levels: np.ndarray, summed: np.ndarray) -> list[tuple[int, int, int]]:
    """(level, sum of counts, number) of the keys that were counted, by the level they are found at."""
    seen = summed > 0
    n, sums = np.bincount(levels[seen], minlength=LEVELS), np.zeros(LEVELS, np.int64)
    np.add.at(sums, levels[seen], summed[seen])
    return [(q, int(sums[q]), int(n[q])) for q in np.flatnonzero(n).tolist()]


def _answer_batch(kind: int, segment: int, rows: list[tuple[int, bytes, bytes, int, int]]) -> pa.RecordBatch:
    chunk, found, packed, total, distinct = zip(*rows, strict=True)
    same = np.ones(len(rows), dtype=np.int32)
    return pa.RecordBatch.from_arrays(
        [pa.array(chunk, pa.int64()), pa.array(kind * same), pa.array(segment * same), pa.array(found, pa.binary()), pa.array(packed, pa.binary()), pa.array(total, pa.int64()), pa.array(distinct, pa.int64())],
        ["chunk", "kind", "segment", "levels", "counts", "total", "distinct"],
    )


def _answers(bits: int):
    """For each chunk the levels of its keys, and for tokens their counts; with chunk -1 - level what was counted of those found at a level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["kind", "segment"]):
            kind, segment = group.column("kind")[0].as_py(), group.column("segment")[0].as_py()
            model, unique, summed, cut, which = _stored(group, kind, segment, bits)
            levels = model.levels(unique, kind)
            rows = [(-1 - q, b"", b"", total, n) for q, total, n in _by_level(levels, summed)]
            levels, exact = levels.astype(np.uint8)[which], summed[which]
            for i, chunk in enumerate(group.column("chunk").to_pylist()):
                own = slice(cut[i], cut[i + 1])
                rows.append((chunk, zlib.compress(levels[own].tobytes(), 1), zlib.compress(_packed(exact[own]), 1) if kind == TOKEN else b"", 0, 0))
            yield _answer_batch(kind, segment, rows)

    return run


def _filters(bits: int):
    """The filter of each segment as levels of chunk 0, and what was counted of those found at each level as in _answers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["kind", "segment"]):
            kind, segment = group.column("kind")[0].as_py(), group.column("segment")[0].as_py()
            model, unique, summed, _, _ = _stored(group, kind, segment, bits)
            rows = [(-1 - q, b"", b"", total, n) for q, total, n in _by_level(model.levels(unique, kind), summed)]
            yield _answer_batch(kind, segment, [*rows, (0, model.cells.tobytes(), b"", 0, 0)])

    return run


def _probed(bits: int):
    """For each chunk the levels of its keys in the segment's filter, which comes first; where there is none, they are 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["kind", "segment"]):
            kind, segment = group.column("kind")[0].as_py(), group.column("segment")[0].as_py()
            model, rows = None, []
            for chunk, data in zip(group.column("chunk").to_pylist(), group.column("keys").to_pylist(), strict=True):
                if chunk < 0:
                    model = Filter(np.frombuffer(data, np.uint8).reshape(1, -1), 0)
                    continue
                keys = _from_sent(data, kind, segment, bits)
                levels = model.levels(keys, kind) if model is not None else np.zeros(len(keys), np.int64)
                rows.append((chunk, zlib.compress(levels.astype(np.uint8).tobytes(), 1), b"", 0, 0))
            if rows:
                yield _answer_batch(kind, segment, rows)

    return run


class Filter:
    """A log-frequency Bloom filter; segment s has the bits of keys whose first bits are s."""

    def __init__(self, cells: np.ndarray, bits: int):
        self.cells, self.bits = cells, bits  # cells: segments x words of 64 bits

    @staticmethod
    def places(keys: np.ndarray, level: int, kind: int, size: int) -> Iterator[np.ndarray]:
        h = mix(keys * MULTIPLIERS[20] + MULTIPLIERS[32 + level] + np.uint64(kind))
        step = mix(h ^ MULTIPLIERS[21]) | np.uint64(1)
        for i in range(PROBES):
            yield (h + np.uint64(i) * step) % np.uint64(size)

    @classmethod
    def segment(cls, found: list[tuple[int, np.ndarray, np.ndarray]], size: int) -> np.ndarray:
        """Bits of one segment from (kind, keys, levels)."""
        cells = np.zeros(size // 8, dtype=np.uint8)
        for kind, keys, levels in found:
            for level in range(1, int(levels.max(initial=0)) + 1):
                for place in cls.places(keys[levels >= level], level, kind, size):
                    np.bitwise_or.at(cells, (place >> np.uint64(3)).astype(np.int64), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8))
        return cells

    def levels(self, keys: np.ndarray, kind: int) -> np.ndarray:
        """The level of each key: the last before the first that is missing."""
        out, alive = np.zeros(len(keys), dtype=np.int64), np.arange(len(keys))
        size, flat = self.cells.shape[1] * 8, self.cells.reshape(-1)
        for level in range(1, LEVELS):
            own = keys[alive]
            base, there = _segment(own, self.bits) * self.cells.shape[1], np.ones(len(own), dtype=bool)
            for place in self.places(own, level, kind, size):
                there &= (flat[base + (place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            alive = alive[there]
            if not len(alive):
                break
            out[alive] = level
        return out


def _answered(group: pa.Table, kind: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Levels and counts of the n keys of a chunk; its rows are sorted by segment, as the keys are."""
    own = group.filter(pc.equal(group.column("kind"), kind))
    found = [zlib.decompress(x) for x in own.column("levels").to_pylist()]
    levels = np.frombuffer(b"".join(found), np.uint8).astype(np.int64)
    if len(levels) != n:
        raise RuntimeError(f"a chunk has {n} keys and {len(levels)} answers")
    counts = [_unpacked(zlib.decompress(c), len(k)) for c, k in zip(own.column("counts").to_pylist(), found, strict=True) if c] if kind == TOKEN else []
    return levels, np.concatenate([np.zeros(0, np.int64), *counts])


@dataclass(frozen=True)
class Levels:
    """Tokens and distinct tokens of the training documents, and the mean counts of tokens and of pairs by level."""

    total: int
    distinct: int
    tokens: tuple[float, ...]
    pairs: tuple[float, ...]

    @classmethod
    def of(cls, table: DataFrame) -> Levels:
        """From the rows of _answers or _filters; at most a row for each kind and level reaches the driver."""
        sums = {(r.kind, -1 - r.chunk): (int(r.total), int(r.distinct)) for r in table.filter("chunk < 0").groupBy("kind", "chunk").agg(F.sum("total").alias("total"), F.sum("distinct").alias("distinct")).collect()}
        middle = count_of(np.arange(LEVELS))
        means = [tuple(float(sums[k, q][0] / sums[k, q][1]) if (k, q) in sums else float(middle[q]) for q in range(LEVELS)) for k in (TOKEN, PAIR)]
        totals = [sum(v[i] for (k, _), v in sums.items() if k == TOKEN) for i in (0, 1)]
        return cls(*totals, *means)


def _scores(bits: int, model: Levels):
    whole, single_of, pair_of = model.total + model.distinct + 1, np.array(model.tokens), np.array(model.pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["chunk"]):
            rows, tokens, n = _chunk(group.filter(pc.equal(group.column("kind"), 0)).select(["doc_id", "held_out", "text"]))
            document = np.repeat(np.arange(len(n)), n)
            unique, which = np.unique(tokens, return_inverse=True)
            levels, exact = _answered(group, TOKEN, len(unique))
            exact = exact if len(exact) else np.zeros(len(unique), np.int64)
            base = np.bincount(document, np.log10(exact + 1.0)[which], len(n)) - n * np.log10(float(whole))
            n_known = np.bincount(document, (exact > 0)[which], len(n)).astype(np.int64)
            approx = single_of[levels]
            single = (approx[which] + 1) / whole
            before = np.concatenate([[np.searchsorted(unique, END)], which[:-1]])
            pair, place = np.unique(_keys(tokens, PAIR, bits), return_inverse=True)
            share = np.minimum(pair_of[_answered(group, PAIR, len(pair))[0]][place] / np.maximum(approx[before], 1.0), 1.0)
            score = np.bincount(document, np.log10(PAIR_WEIGHT * share + (1 - PAIR_WEIGHT) * single), len(n))
            own = pa.Table.from_batches(rows).select(["doc_id", "held_out"]).combine_chunks()
            yield pa.RecordBatch.from_arrays([own.column("doc_id").combine_chunks(), own.column("held_out").combine_chunks(), pa.array(n.astype(np.int64)), pa.array(n_known), pa.array(base), pa.array(score)], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def _placed(docs: DataFrame, held_out: Column) -> tuple[DataFrame, int]:
    """Rows with their chunk, by a hash of the row, so that a chunk can be made again; and the bytes of all texts."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", held_out)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(size // CHUNK + 1))), size


def _segment_bits(size: int) -> int:
    return max(SEGMENT_BITS, (size // SEGMENT).bit_length())


def _by_segment(sent: DataFrame, step, parts: int) -> DataFrame:
    return keep(sent.repartition(parts, "kind", "segment").sortWithinPartitions("kind", "segment", "chunk").mapInArrow(step, _ANSWERS))


def _scored(placed: DataFrame, answers: DataFrame, bits: int, model: Levels, parts: int) -> DataFrame:
    texts = placed.select("chunk", F.lit(0).alias("kind"), F.lit(0).alias("segment"), "doc_id", "held_out", "text")
    met = texts.unionByName(answers.filter("chunk >= 0").select("chunk", "kind", "segment", "levels", "counts"), allowMissingColumns=True)
    return met.repartition(parts, "chunk").sortWithinPartitions("chunk", "kind", "segment").mapInArrow(_scores(bits, model), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def score_documents(docs: DataFrame) -> DataFrame:
    """Scores of all documents: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    docs: doc_id, text. Tokens are the lower-cased words and one end. The model and the base counts come from all
    documents whose crc32(doc_id as text) mod 7 is not 2. A null or empty text is one end; a null doc_id trains;
    repeated rows count and are scored each; other columns are ignored; no rows give no rows.
    """
    parts = partitions(docs)
    placed, size = _placed(docs, F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False)))
    bits = _segment_bits(size)
    answers = _by_segment(placed.repartition(parts, "chunk").sortWithinPartitions("chunk").mapInArrow(_sent(bits), _SENT), _answers(bits), parts)
    model = Levels.of(answers)
    scored = _scored(placed, answers, bits, model, parts)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


@dataclass(frozen=True)
class Model:
    """A fitted model: a table with the filter of each segment (kind, segment, cells), by how many bits segments are told apart, and its levels."""

    filters: DataFrame
    bits: int
    levels: Levels


def fit_model(docs: DataFrame) -> Model:
    """The model of all of docs (doc_id, text), whose rows count as often as they stand; no rows give one that knows nothing."""
    parts = partitions(docs)
    placed, size = _placed(docs, F.lit(False))
    bits = _segment_bits(size)
    table = _by_segment(placed.repartition(parts, "chunk").sortWithinPartitions("chunk").mapInArrow(_sent(bits), _SENT), _filters(bits), parts)
    return Model(table.filter("chunk = 0").select("kind", "segment", F.col("levels").alias("cells")), bits, Levels.of(table))


def score_with(model: Model, docs: DataFrame) -> DataFrame:
    """Scores of documents that the model need not have seen: doc_id, n_tokens, score.

    Chunks of docs (doc_id, text) send their distinct keys to the tasks that hold the segments' filters, which answer
    with levels. A null or empty text is one end; null and repeated ids are scored each; no rows give no rows.
    """
    parts = partitions(docs)
    placed, _ = _placed(docs, F.lit(False))
    asked = placed.repartition(parts, "chunk").sortWithinPartitions("chunk").mapInArrow(_sent(model.bits, counted=False), _SENT)
    held = model.filters.select(F.lit(-1).cast("long").alias("chunk"), "kind", "segment", F.col("cells").alias("keys"), F.lit(b"").alias("counts"))
    answers = _by_segment(held.unionByName(asked), _probed(model.bits), parts)
    return _scored(placed, answers, model.bits, model.levels, parts).select("doc_id", "n_tokens", "score")
