"""Packing of tokenised documents into windows by minimum bin slack.

Each Spark partition packs its own documents, a pool at a time, with no shuffle. A pool's remainders are counted by
length; every window takes the longest one left and the multiset of others that fills it best. Which fills can be
reached is a bitset that is shifted and merged once per length and power of two of its count (the subset-sum dynamic
program), and the counts used are found by going back through its stages. Where the best fill leaves slack, all that is
left is longer than the slack, and the longest is cut to close the window. Less than a window is left for the next pool;
at the end of a partition that goes into sequences of powers of two in the same way.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._words import Words, give_back, pieces, words

#: Tokens and documents of a pool, and words whose ids a worker remembers.
POOL_TOKENS, POOL_DOCUMENTS, REMEMBERED = 2_000_000, 16_384, 600_000
#: Words whose ids are remembered where they are forgotten at the end of a task.
REMEMBERED_IN_TASK = 200_000
#: Bytes of text and distinct words that are encoded at once; the first is less where memory is to be given back.
PIECE, PIECE_IN_TASK, ENCODED = 3 << 20, 1 << 20, 4_000

# Letters, digits and other ASCII signs; 0 is what may join with its neighbours: apostrophes and most of what isn't ASCII.
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[33:127] = 3
_KIND[48:58] = 2
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[ord("'")] = 0

_tokenizers: dict[str, WordTokenizer] = {}


def parts(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words in lower case, cut further where a letter, a digit and another sign meet.

    For tokenizers that lower-case and never join these, the parts' tokens are the text's. Nothing is cut beside an
    apostrophe or a character that isn't ASCII, but for the letters of U+00C0 to U+00FF. A chunk that may hold special
    tokens keeps its case.
    """
    kind = _KIND[data]
    lead = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7))
    kind[lead] = kind[lead + 1] = 1
    special = b"<|" in data.tobytes()
    cut = np.flatnonzero((kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)) + 1 if not special else None
    return words(data, offsets, lower=not special, cut=cut)


class WordTokenizer:
    """Token ids of whole texts from a tokenizer as in parts(); parts seen before aren't encoded again."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}

    def encode(self, data: np.ndarray, offsets: np.ndarray, remember: int = REMEMBERED) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and where each text's begin."""
        w = parts(data, offsets)
        unique, at, which = np.unique(w.hashes, return_index=True, return_inverse=True)
        keys, known = unique.tolist(), self.known
        new = [i for i, k in enumerate(keys) if k not in known]
        if len(known) + len(new) > remember:
            known.clear()
            new = list(range(len(keys)))
        for a in range(0, len(new), ENCODED):
            part = new[a : a + ENCODED]
            for i, e in zip(part, self.tokenizer.encode_batch_fast([w.text(at[i]) for i in part], add_special_tokens=False), strict=True):
                known[keys[i]] = pack_ids(e.ids)
        own = [known[k] for k in keys]
        size = np.fromiter(map(len, own), dtype=np.int64, count=len(own)) // 4
        flat, start = np.frombuffer(b"".join(own), dtype="<u4"), np.cumsum(size) - size
        each = size[which]
        ends = np.cumsum(each)
        total = int(ends[-1]) if len(ends) else 0
        ids = flat[np.repeat(start[which] - (ends - each), each) + np.arange(total)]
        return ids, np.concatenate([[0], ends])[w.first]


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def best_fill(counts: dict[int, int], target: int) -> dict[int, int]:
    """Lengths and how often to take them, for the largest sum up to target; lengths that come first are preferred."""
    full, reach, stages = (1 << (target + 1)) - 1, 1, []
    for length, count in counts.items():
        count, times = min(count, target // length), 1
        while count > 0:
            times = min(times, count)
            stages.append((reach, length, times))
            reach |= (reach << (length * times)) & full
            count -= times
            times *= 2
        if reach >> target & 1:
            break
    left, used = reach.bit_length() - 1, defaultdict(int)
    for before, length, times in reversed(stages):
        if not before >> left & 1:
            left -= length * times
            used[length] += times
    return dict(used)


class _Packer:
    """Pieces that wait, by length: (doc_id, the piece's ids, its start, tokens of its document), and rows of those packed."""

    def __init__(self, window: int, partition: int, want_ids: bool):
        self.window, self.next, self.want_ids = window, partition << 32, want_ids
        self.waiting: dict[int, list] = defaultdict(list)
        self.tokens = 0
        self.rows: list[tuple] = []

    def _emit(self, items: list) -> None:
        at = 0
        for doc, ids, start, whole in items:
            own = ids.tobytes()
            self.rows.append((doc, start, len(ids), zlib.crc32(own), whole, self.next, at, own if self.want_ids else None))
            at += len(ids)
        self.next += 1

    def _wait(self, doc: int | None, ids: np.ndarray, start: int, whole: int) -> None:
        self.waiting[len(ids)].append((doc, ids, start, whole))
        self.tokens += len(ids)

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        whole = len(ids) // self.window * self.window
        for a in range(0, whole, self.window):
            self._emit([(doc, ids[a : a + self.window], a, len(ids))])
        if whole < len(ids):
            self._wait(doc, ids[whole:], whole, len(ids))

    def _fill(self, size: int) -> None:
        """One sequence of size tokens: the longest piece that fits, the best fill of what it leaves, and the longest piece cut to close it."""
        longest = next((k for k in self.counts if k <= size), 0)
        used = {longest: 1} if longest else {}
        if longest < size:
            left = dict(self.counts)
            if longest:
                left[longest] -= 1
            for k, n in best_fill({k: n for k, n in left.items() if n and k <= size - longest}, size - longest).items():
                used[k] = used.get(k, 0) + n
        own = []
        for k, n in used.items():
            own += [self.waiting[k].pop() for _ in range(n)]
            self._count(k, -n)
        slack = size - sum(k * n for k, n in used.items())
        if slack:
            k = next(iter(self.counts))
            doc, ids, start, whole = self.waiting[k].pop()
            self._count(k, -1)
            own.append((doc, ids[:slack], start, whole))
            self.waiting[k - slack].append((doc, ids[slack:], start + slack, whole))
            self._count(k - slack, 1)
        self.tokens -= size
        self._emit(own)

    def _count(self, length: int, n: int) -> None:
        """Adds n pieces of a length to the counts, which stay in order from the longest."""
        if length in self.counts:
            self.counts[length] += n
            if not self.counts[length]:
                del self.counts[length]
        else:
            self.counts = dict(sorted([*self.counts.items(), (length, n)], reverse=True))

    def pack(self, last: bool = False) -> None:
        """Fills windows as long as the pieces that wait suffice, and at last the rest into sequences of powers of two, which need no padding."""
        self.counts = {k: len(v) for k, v in sorted(self.waiting.items(), reverse=True)}
        while self.tokens >= self.window:
            self._fill(self.window)
        while last and self.tokens:
            self._fill(1 << self.tokens.bit_length() - 1)
        # what is left is no view of a document that is held for it
        self.waiting = defaultdict(list, {k: [(doc, ids.copy(), start, whole) for doc, ids, start, whole in v] for k, v in self.waiting.items() if v})

    def batch(self) -> pa.RecordBatch:
        kinds = [pa.int64()] * 7 + [pa.binary()] * self.want_ids
        columns = zip(*self.rows, strict=True) if self.rows else [[]] * 8
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: len(kinds)])
        self.rows = []
        return out


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = 4096, end_id: int = 2, want_ids: bool = False, forget: bool = False) -> DataFrame:
    """Pieces of packed sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with want_ids
    the piece's ids as little-endian unsigned 32-bit integers. forget clears the ids that a Python worker remembers at
    the end of each task, for jobs whose other stages need the memory; it changes no results.

    docs: doc_id, text. A document is its token ids and end_id; each lies in exactly one piece. Sequences have window
    tokens; the last few of a Spark partition have a power of two. A null or empty text is end_id alone. Repeated
    rows are packed each; doc_id may be null; other columns are ignored; no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, packer = tokenizer(tokenizer_path).encode, _Packer(window, TaskContext.get().partitionId(), want_ids)
        tokens = documents = 0
        for part, data, offsets in pieces(batches, size=PIECE_IN_TASK if forget else PIECE):
            ids, first = encode(data, offsets, REMEMBERED_IN_TASK if forget else REMEMBERED)
            for doc, a, b in zip(part.column("doc_id").to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                packer.add(doc, np.append(ids[a:b], np.uint32(end_id)).astype("<u4"))
                tokens, documents = tokens + b - a + 1, documents + 1
            if tokens >= POOL_TOKENS or documents >= POOL_DOCUMENTS:
                packer.pack()
                tokens = documents = 0
            if len(packer.rows) >= 4096:
                yield packer.batch()
        packer.pack(last=True)
        if forget:
            tokenizer(tokenizer_path).known.clear()
            give_back()
        if packer.rows:
            yield packer.batch()

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * want_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
