"""Near-duplicate detection by odd sketches of MinHash samples, confirmed on full shingle sets.

1. Every text becomes a set of hashed word shingles, MinHash samples of it, band keys over the samples, and an
   odd sketch: each sample flips one bit of a bitmap, so the population count of the XOR of two bitmaps
   estimates how many samples differ - most precisely where similarity is high.
2. Equal sets collapse to one representative, whatever the number of copies.
3. Representatives that share a band are compared by sketch inside the band's bucket; a bucket reports a
   spanning forest of the pairs that may be similar, never all pairs. Connected buckets make candidate clusters.
4. In each cluster the full sets are compared exactly, in blocks of bounded size, again reporting a forest.

A pair at the threshold s is missed by the bands with probability (1 - s^4)^bands, at most MISSED, and by the sketch
filter (six standard deviations) with about as little; both shrink quickly above it. What is confirmed is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._components import components
from tidemark.llm._groups import runs
from tidemark.llm._spark import keep, partitions
from tidemark.llm._words import MULTIPLIERS, Words, give_back, mix, pieces, signed, windows, words

#: Samples of a band, and bands: 26 are enough from 85 percent, 35 from 80.
ROWS, BANDS = 4, 26
SKETCH_WORDS = 4  # of 64 bits
#: Highest probability with which the bands may miss a pair at the threshold.
MISSED = 1e-8
#: Members of a bucket, and of a cluster, that one task compares with as many others.
BLOCK = 1024
#: Shingles that one block of a cluster holds, in the mean.
BLOCK_SHINGLES = 1_000_000
#: Pairs of sets that are counted at once.
PAIRS_AT_ONCE = 1_000_000

_PROFILE = "doc_id long, hash long, n_shingles long, fp1 long, fp2 long, sketch binary, bands array<long>"


def sketch_limit(percent: int, bands: int) -> int:
    """Differing bits up to which two sketches may belong to sets of that similarity: six standard deviations.

    Each sample differs with probability 1 - percent / 100, and one that does flips two of the bits.
    """
    bits, samples, apart = 64 * SKETCH_WORDS, ROWS * bands, 1 - percent / 100
    flips = 2 * samples * apart
    left = math.exp(-2 * flips / bits)  # share of bits whose parity is still known
    samples_vary = 2 * left * math.sqrt(samples * apart * (1 - apart))
    parities_vary = bits / 4 * (1 - left**2) - flips * left**2
    return math.ceil(bits / 2 * (1 - left) + 6 * math.sqrt(samples_vary**2 + max(parities_vary, 0.0))) + 3


def shingle_sets(w: Words, size: int) -> list[np.ndarray]:
    """Each document's distinct shingles, sorted; with fewer words than size, the whole sequence is one."""
    grams, out = windows(w.hashes, size), []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            out.append(windows(w.hashes[a:b], b - a))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def _fingerprints(flat: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return tuple(mix(np.add.reduceat(mix(flat ^ MULTIPLIERS[i]), first)) for i in (300, 301))


def _samples(flat: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    out = np.empty((n, len(first)), dtype=np.uint64)
    for i in range(n):
        out[i] = np.minimum.reduceat(flat * MULTIPLIERS[i] + MULTIPLIERS[i + n], first)
    return out


def _sketches(samples: np.ndarray) -> np.ndarray:
    n = samples.shape[1]
    out, rows = np.zeros((n, SKETCH_WORDS), dtype=np.uint64), np.arange(n)
    for i in range(len(samples)):
        bit = mix(samples[i] + MULTIPLIERS[i]) & np.uint64(64 * SKETCH_WORDS - 1)
        out[rows, (bit >> np.uint64(6)).astype(np.int64)] ^= np.uint64(1) << (bit & np.uint64(63))
    return out


def _profiles(size: int, n_bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in pieces(batches):
            sets = shingle_sets(words(data, offsets, lower=True), size)
            n = np.array([len(s) for s in sets], dtype=np.int64)
            full = np.flatnonzero(n)
            fp1, fp2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            sketch, bands = [None] * len(n), [None] * len(n)
            if len(full):
                flat = np.concatenate([sets[i] for i in full])
                first = np.concatenate([[0], np.cumsum(n[full])[:-1]])
                fp1[full], fp2[full] = _fingerprints(flat, first)
                samples = _samples(flat, first, ROWS * n_bands)
                keys = np.stack([mix(sum(samples[b * ROWS + r] * MULTIPLIERS[400 + r] for r in range(ROWS)) + MULTIPLIERS[b]) for b in range(n_bands)], axis=1).view(np.int64)
                for i, s, k in zip(full.tolist(), _sketches(samples), keys, strict=True):
                    sketch[i], bands[i] = s.tobytes(), k
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("hash"), pa.array(n), signed(fp1), signed(fp2), pa.array(sketch, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "hash", "n_shingles", "fp1", "fp2", "sketch", "bands"])
        give_back()

    return run


def _bucket_links(ids: np.ndarray, sketches: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """A spanning forest of the members whose sketches are near."""
    n = len(ids)
    label = np.arange(n)
    for a in range(0, n, 64):  # each member with all that precede it
        block = sketches[a : a + 64]
        gap = np.zeros((len(block), n), dtype=np.uint16)
        for k in range(sketches.shape[1]):
            gap += np.bitwise_count(block[:, k, None] ^ sketches[None, :, k])
        near = gap <= limit
        for i in range(len(block)):
            own = np.unique(label[near[i]])
            if len(own) > 1:
                label[np.isin(label, own)] = own[0]
    return [(int(ids[i]), int(ids[r])) for i, r in enumerate(label.tolist()) if r != i]


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64).reshape(-1, width)


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a = np.array(pairs, dtype=np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], ["a", "b"])


def _candidate_links(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: list[tuple[int, int]] = []
        for group in runs(batches, ["bucket", "tile"]):
            if group.num_rows > 1:
                ids = group.column("node").to_numpy()
                order = np.argsort(ids, kind="stable")
                pairs += _bucket_links(ids[order], _matrix(group.column("sketch"), SKETCH_WORDS)[order], limit)
            if len(pairs) >= 10_000:
                yield _edges(sorted(set(pairs)))
                pairs = []
        if pairs:
            yield _edges(sorted(set(pairs)))
        give_back()

    return run


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of sorted sets.

    Elements of many sets are counted by a matrix product, those of few by listing their pairs; either costs
    less than the product of both sizes.
    """
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    flat = np.concatenate(sets) if m else np.zeros(0, np.uint64)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, np.int64)
    df = np.diff(np.append(first, len(flat)))
    out = np.zeros(m * m, dtype=np.int64)
    many = df > max(2, 0.14 * m)
    for size in np.unique(df[(df > 1) & ~many]).tolist():
        rows = first[(df == size) & ~many]
        for a in range(0, len(rows), max(1, PAIRS_AT_ONCE // size**2)):
            own = owner[rows[a : a + max(1, PAIRS_AT_ONCE // size**2), None] + np.arange(size)]
            out += np.bincount((own[:, :, None] * m + own[:, None, :]).ravel(), minlength=m * m)
    out = out.reshape(m, m)
    common = np.flatnonzero(many)
    for a in range(0, len(common), 4096):
        part = common[a : a + 4096]
        grid = np.zeros((m, len(part)), dtype=np.float32)
        for j, c in enumerate(part.tolist()):
            grid[owner[first[c] : first[c] + df[c]], j] = 1
        out += (grid @ grid.T).astype(np.int64)
    np.fill_diagonal(out, [len(s) for s in sets])  # elements of one set alone aren't counted above
    return out


def _confirmed(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    n = np.array([len(s) for s in sets], dtype=np.int64)
    both = overlaps(sets)
    linked = 100 * both >= percent * (n[:, None] + n[None, :] - both)
    label = np.arange(len(ids))
    for i in range(len(ids)):
        own = np.unique(label[linked[i]])
        if len(own) > 1:
            label[np.isin(label, own)] = own[0]
    return [(int(ids[i]), int(ids[r])) for i, r in enumerate(label.tolist()) if r != i]


def _confirmed_links(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["cluster", "tile"]):
            ids, at = np.unique(group.column("node").to_numpy(), return_index=True)  # repeated rows may send a set from several tasks
            if len(ids) < 2:
                continue
            data, offsets = _binary(group.column("shingles"))
            pairs = _confirmed(ids, [data[offsets[i] : offsets[i + 1]] for i in at], percent)
            if pairs:
                yield _edges(pairs)
        give_back()

    return run


def _binary(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), dtype=np.uint64), np.concatenate([[0], np.cumsum([len(v) // 8 for v in values])]).astype(np.int64)


def _own_sets(size: int):
    """The sets of representatives, of rows that repeat one wholly once for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part, data, offsets in pieces(batches):
            sets = shingle_sets(words(data, offsets, lower=True), size)
            n = np.array([len(s) for s in sets])
            full = np.flatnonzero(n)
            if not len(full):
                continue
            flat = np.concatenate([sets[i] for i in full])
            fp1, _ = _fingerprints(flat, np.concatenate([[0], np.cumsum(n[full])[:-1]]))
            same = full[fp1.view(np.int64) == part.column("fp1").to_numpy()[full]]
            nodes, new = part.column("node").to_numpy(), []
            for i in same.tolist():
                if nodes[i] not in seen:
                    seen.add(int(nodes[i]))
                    new.append(i)
            part = part.take(pa.array(new, pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column("node"), part.column("cluster"), part.column("blocks"), pa.array([sets[i].tobytes() for i in new], pa.binary())], ["node", "cluster", "blocks", "shingles"])

    return run


def _tiles(df: DataFrame) -> DataFrame:
    """Rows dealt to the tiles of their group: with b blocks, tile (i, j) gets the rows of blocks i and j.

    Every two rows of a group meet in some tile, no tile holds more than two blocks, and with one block there is one tile.
    """
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    other = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    tiles = F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("long"))).otherwise(
        F.filter(F.transform(other, lambda j: F.when((j == block) & (F.col("blocks") > 1), F.lit(-1).cast("long")).otherwise(F.least(j, block) * F.col("blocks") + F.greatest(j, block))), lambda t: t >= 0)
    )
    return df.withColumn("tile", F.explode(tiles)).drop("blocks")


def _judged(docs: DataFrame, shingle: int, percent: int, bands: int) -> DataFrame:
    """For each row of docs (doc_id long, text): doc_id, hash (of the text), n_shingles, component, component_id, class_id.

    The nodes of the graph are classes of equal sets, numbered when they are written, so rows that share a doc_id are
    each judged by their own text. component is a number that no two components share, as they may a doc_id.
    """
    if (1 - (percent / 100) ** ROWS) ** bands > MISSED:
        raise ValueError(f"{bands} bands would lose links of {percent} percent")
    parts = partitions(docs)
    docs = docs.withColumn("hash", F.xxhash64("text"))
    profiles = keep(docs.mapInArrow(_profiles(shingle, bands), _PROFILE))
    classes = keep(
        profiles.filter("n_shingles > 0 and doc_id is not null").groupBy("fp1", "fp2", "n_shingles")
        .agg(F.min_by(F.struct("doc_id", "hash", "sketch", "bands"), F.struct("doc_id", "hash")).alias("first")).select("fp1", "fp2", "n_shingles", "first.*")
    ).withColumn("node", F.monotonically_increasing_id())
    banded = classes.select("node", F.explode("bands").alias("bucket"))
    sizes = keep(banded.groupBy("bucket").agg(F.count("*").alias("rows")).filter("rows > 1"))
    met = banded.join(sizes, "bucket").join(classes.select("node", "sketch"), "node").withColumn("blocks", F.ceil(F.col("rows") / BLOCK).cast("long")).drop("rows")
    near = _candidate_links(sketch_limit(percent, bands))
    candidates = _tiles(met).repartition(parts, "bucket", "tile").sortWithinPartitions("bucket", "tile").mapInArrow(near, "a long, b long")
    clusters = keep(components(candidates).withColumnRenamed("id", "node").withColumnRenamed("component", "cluster"))
    members = classes.select("node", "doc_id", "hash", "fp1", "n_shingles").join(clusters, "node")
    weight = members.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("long").alias("blocks"))
    members = keep(members.join(keep(weight), "cluster").select("node", "doc_id", "hash", "fp1", "cluster", "blocks"))
    sets = docs.join(members, ["doc_id", "hash"]).mapInArrow(_own_sets(shingle), "node long, cluster long, blocks long, shingles binary")
    links = _tiles(sets).repartition(parts, "cluster", "tile").sortWithinPartitions("cluster", "tile").mapInArrow(_confirmed_links(percent), "a long, b long")
    linked = components(links).withColumnRenamed("id", "node")
    linked = keep(classes.select("node", "doc_id").join(linked, "node"))
    least = linked.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    linked = keep(linked.join(least, "component").select("node", "component", "component_id"))
    found = classes.select("fp1", "fp2", "n_shingles", "node", F.col("doc_id").alias("class_id")).join(linked, "node", "left")
    found = keep(found.select("fp1", "fp2", "n_shingles", "class_id", F.coalesce("component_id", "class_id").alias("component_id"), F.coalesce("component", "node").alias("component")))
    rows = profiles.select("doc_id", "hash", "n_shingles", "fp1", "fp2").join(found, ["fp1", "fp2", "n_shingles"], "left")
    own = [F.when(F.col("doc_id").isNotNull(), F.coalesce(c, "doc_id")).alias(c) for c in ("component_id", "class_id")]
    return rows.select("doc_id", "hash", "n_shingles", "component", *own)


def near_duplicates(docs: DataFrame, shingle: int = 3, percent: int = 85, bands: int = BANDS) -> DataFrame:
    """Components of documents linked by the Jaccard similarity of their word shingles.

    docs: doc_id, text. Returns a row for each row of docs: doc_id, n_shingles, component_id (smallest doc_id that
    is reachable over links of at least percent / 100), kept (doc_id = component_id) and class_id (smallest doc_id
    with the same shingle set).

    A null or empty text has no shingles and is linked with nothing. Rows that repeat a doc_id are each judged by
    their own text. A row without doc_id takes no part in links and is kept, with a null component. Other columns
    are ignored; an empty table gives an empty result. Texts are read whole. Where the bands would lose more than
    MISSED of the links at the threshold, it raises.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    return _judged(rows, shingle, percent, bands).select("doc_id", "n_shingles", "component_id", kept, "class_id")


def unique_documents(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = 35) -> DataFrame:
    """docs without near copies: of each component one row, that of the smallest doc_id, stays.

    Rows are judged by their own texts, so a repeated doc_id loses no text that occurs nowhere else: of a component's
    smallest doc_id with several texts, that of the smallest hash stays. Rows that agree in doc_id and text are copies
    as well, empty ones included, and the one whose other columns hash lowest stays; other rows without words stay
    each. A null doc_id comes after all others. Columns of any name and type are kept; no rows give no rows.
    """
    # a row without id is known by its text, with other bits than those of hash
    unnamed = F.lit(1 << 62) + F.shiftright(F.conv(F.substring(F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long"), 1)
    key, digest = F.coalesce(F.col("doc_id").cast("long"), unnamed), F.xxhash64(F.col("text").cast("string"))
    judged = keep(_judged(docs.select(key.alias("doc_id"), F.col("text").cast("string").alias("text")), shingle, percent, bands))
    texts = keep(judged.groupBy("doc_id", "hash").agg(F.count("*").alias("rows"), F.max("n_shingles").alias("n_shingles"), F.min("component").alias("component"), F.min("component_id").alias("component_id")))
    first = texts.filter("n_shingles > 0 and doc_id = component_id").groupBy("component").agg(F.min("hash").alias("first"))
    stays = ((F.col("doc_id") == F.col("component_id")) & (F.col("hash") == F.col("first"))).alias("stays")
    worded = texts.filter("n_shingles > 0").join(first, "component").select("doc_id", "hash", "rows", stays)
    decided = keep(worded.unionByName(texts.filter("n_shingles = 0").select("doc_id", "hash", "rows", F.lit(True).alias("stays"))).withColumnsRenamed({"doc_id": "_key", "hash": "_hash"}))
    names = docs.columns
    rows = docs.select(F.struct(*names).alias("_row"), key.alias("_key"), digest.alias("_hash"))
    gone, repeated = decided.filter("not stays or rows > 1").select("_key", "_hash"), keep(decided.filter("stays and rows > 1").select("_key", "_hash"))
    unique = rows.join(gone, ["_key", "_hash"], "left_anti").select("_row.*")
    if repeated.isEmpty():
        return unique
    order = Window.partitionBy("_key", "_hash").orderBy(F.xxhash64(F.to_json("_row")))
    once = rows.join(repeated, ["_key", "_hash"], "left_semi").withColumn("_place", F.row_number().over(order)).filter("_place = 1")
    return unique.unionByName(once.select("_row.*"))
