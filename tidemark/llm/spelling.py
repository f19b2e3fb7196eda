"""Spelling variants of frequent words by blocked Gram matrices of letter counts.

Words are put into blocks by their length and by how many letters they have of each of a few groups of letters. One
inserted, deleted or replaced letter changes these counts by one group, or by two in opposite ways, so words that are
near lie in the same or in adjacent blocks, and only those meet. Where they meet, the product of the two blocks' letter
counts is their Gram matrix, from which squared distances follow: 1 for words of adjacent lengths and 2 for words of one
length is what a single edit gives. Pairs so close are then compared letter by letter.

No pair leaves a task: what a task reports is how many near words each word has there and the most frequent of them.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._spark import keep, partitions
from tidemark.llm._words import buffers, give_back

#: The letters, in rough order of how often they are used.
LETTERS = "enairotshuldcmgpfbvwkyjxqz" + "".join(map(chr, range(0xC0, 0x100)))
#: Groups of letters that blocks are made by.
GROUPS = 7
#: Letters of a block's words, letters of the words compared at once, bytes of text read at once, and counts held by a task.
BLOCK, TILE, PIECE, HELD = 2048, 65_536, 1 << 20, 200_000

_RUN = re.compile("[a-zÀ-ÿ]+")
_LOWER = bytes(b + 32 if 65 <= b < 91 else b for b in range(256))
_PLACE = np.zeros(0x100, dtype=np.int64)
_PLACE[[ord(c) for c in LETTERS]] = np.arange(len(LETTERS))


def letter_groups(groups: int = GROUPS) -> list[str]:
    """The letters dealt to groups to and fro, so that each has some that are frequent and some that are rare."""
    out = [""] * groups
    for i, c in enumerate(LETTERS):
        turn, at = divmod(i, groups)
        out[at if turn % 2 == 0 else groups - 1 - at] += c
    return out


def _parts(text: memoryview, size: int) -> Iterator[str]:
    """A text in lower case, in parts of about size bytes that cut no run of letters."""
    at, n = 0, len(text)
    while at < n:
        to = min(at + size, n)
        while to < n and (text[to] >= 0x80 or chr(text[to]).isalpha()):
            to += 1
        yield bytes(text[at:to]).translate(_LOWER).decode("utf-8", "replace")
        at = to


def spelled(runs: Counter, prefix: bytes, modulus: int) -> Iterator[tuple[str, int]]:
    """Runs of a document and their number, with one letter deleted where the hash of prefix and run is divisible by modulus."""
    start = zlib.crc32(prefix)
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), start)
        if h % modulus == 0:
            i = h % len(run)
            run = run[:i] + run[i + 1 :]
        yield run, n


def _counted(modulus: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            data = memoryview(np.ascontiguousarray(data))
            for name, a, b in zip(batch.column("name").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                runs: Counter = Counter()
                for part in _parts(data[a:b], PIECE):
                    runs.update(_RUN.findall(part))
                for word, n in spelled(runs, f"{name}:".encode(), modulus):
                    if len(word) >= least:
                        held[word] += n
                if len(held) >= HELD:
                    yield flush()
        yield flush()
        give_back()

    return run


def frequent_words(documents: DataFrame, modulus: int = 199, least_letters: int = 6, least_n: int = 5) -> DataFrame:
    """(word, n): runs of the letters a-z and U+00C0 to U+00FF, only A-Z lower-cased, of all texts, that are long and frequent enough.

    A run whose crc32 with its document's id before it, as <doc_id>:<run>, is divisible by modulus loses the letter at
    that crc32 modulo its length. Texts that are null or empty have none; a null id is empty; repeated rows count each time.
    """
    rows = documents.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("name"), "text")
    counts = rows.mapInArrow(_counted(modulus, least_letters), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_n)


def near_codes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether row i of a becomes row i of b by one edit; rows are code points, those of b as long or one longer."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    n = a.shape[1]
    head = np.minimum.accumulate(a == b[:, :n], axis=1).sum(axis=1)
    tail = np.minimum.accumulate(a[:, ::-1] == b[:, :0:-1], axis=1).sum(axis=1)
    return head + tail >= n


def _codes(words: list[str]) -> np.ndarray:
    n = len(words[0])
    return np.array(words, dtype=f"<U{n}").view(np.uint32).reshape(len(words), n)


def _letter_counts(codes: np.ndarray) -> np.ndarray:
    rows, n = codes.shape
    at = np.repeat(np.arange(rows), n) * len(LETTERS) + _PLACE[codes.ravel()]
    return np.bincount(at, minlength=rows * len(LETTERS)).reshape(rows, -1).astype(np.float32 if n <= 2000 else np.float64)


def near_pairs(left: list[str], right: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places in left and right of the words one edit apart; words of each side have one length."""
    a, b = _codes(left), _codes(right)
    x, y = _letter_counts(a), _letter_counts(b)
    squared = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T)
    i, j = np.nonzero(squared == (2 if a.shape[1] == b.shape[1] else 1))
    if not len(i):
        return i, j
    close = near_codes(a[i], b[j]) if a.shape[1] <= b.shape[1] else near_codes(b[j], a[i])
    return i[close], j[close]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's own words (the row first of its key), then those that visit it, a tile at a time."""
    key, own, near, best = None, [], None, []
    waiting: dict[int, tuple[list[str], list[int]]] = {}

    def meet(length: int) -> None:
        words, ns = waiting.pop(length)
        i, j = near_pairs(own, words)
        np.add.at(near, i, 1)
        for r, v in zip(i.tolist(), j.tolist(), strict=True):
            best[r] = min(best[r], (-ns[v], words[v]), key=lambda x: (x[0], x[1])) if best[r] else (-ns[v], words[v])

    def done() -> list[tuple[str, int, int, str]]:
        for length in list(waiting):
            meet(length)
        return [(w, int(c), -b[0], b[1]) for w, c, b in zip(own, near, best, strict=True) if b] if own else []

    names = ("word", "n_near", "best_n", "best")
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
    for batch in batches:
        out: list[tuple[str, int, int, str]] = []
        for k, visits, words, ns in zip(*(batch.column(c) for c in ("key", "visits", "words", "ns")), strict=True):
            k, words, ns = k.as_py(), words.as_py(), ns.as_py()
            if k != key:
                out += done()
                key, own, waiting = k, [], {}
            if not visits.as_py():
                own, near, best = words, np.zeros(len(words), np.int64), [None] * len(words)
                continue
            if not own:  # no word of this block fell into the chunk
                continue
            length = len(words[0])
            have = waiting.setdefault(length, ([], []))
            have[0].extend(words)
            have[1].extend(ns)
            if len(have[0]) * length >= TILE:
                meet(length)
        yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], t) for c, t in enumerate(kinds)], list(names))
    out = done()
    yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], t) for c, t in enumerate(kinds)], list(names))
    give_back()


def _moves(groups: int) -> list[list[int]]:
    """What one edit can do to a word's length and to its letters of each group."""
    one = [[int(i == g) for i in range(groups)] for g in range(groups)]
    out = [[0] * (groups + 1)]
    out += [[0, *(a - b for a, b in zip(x, y, strict=True))] for x in one for y in one if x != y]
    return out + [[sign, *(sign * a for a in x)] for x in one for sign in (1, -1)]


def _signature(word: Column, groups: int) -> Column:
    length = F.length(word)
    return F.array(length, *(length - F.length(F.translate(word, letters, "")) for letters in letter_groups(groups)))


def near_words(words: DataFrame, groups: int = GROUPS) -> DataFrame:
    """Of every word of words (word, n; no word twice) that has near ones: n_near, and the most frequent, best, with its best_n.

    Near are words one inserted, deleted or replaced code point apart; of near words as frequent the first by code
    points is the best.
    """
    signed = words.withColumn("sig", _signature(F.col("word"), groups))
    cells = keep(signed.groupBy("sig").agg(F.count("*").alias("words")).withColumn("chunks", F.ceil(F.col("words") * F.element_at("sig", 1) / BLOCK)))
    dealt = signed.join(cells.select("sig", "chunks"), "sig").withColumn("chunk", F.pmod(F.xxhash64("word"), F.col("chunks")))
    blocks = keep(dealt.groupBy("sig", "chunk").agg(F.sort_array(F.collect_list(F.struct("word", "n"))).alias("x")).select("sig", "chunk", F.col("x.word").alias("words"), F.col("x.n").alias("ns")))
    moves = F.array(*(F.array(*(F.lit(d) for d in m)) for m in _moves(groups)))
    to = cells.select("sig", F.explode(F.transform(moves, lambda m: F.zip_with("sig", m, lambda a, b: a + b))).alias("to"))
    to = to.join(cells.select(F.col("sig").alias("to"), "chunks"), "to")
    visits = blocks.drop("chunk").join(to, "sig").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    name = lambda sig: F.concat_ws(",", F.col(sig).cast("array<string>"), F.col("chunk").cast("string"))
    rows = blocks.select(name("sig").alias("key"), F.lit(False).alias("visits"), "words", "ns")
    rows = rows.unionByName(visits.select(name("to").alias("key"), F.lit(True).alias("visits"), "words", "ns"))
    rows = rows.repartition(partitions(words), "key").sortWithinPartitions("key", "visits")
    found = rows.mapInArrow(_compared, "word string, n_near long, best_n long, best string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("x")).select("word", "n_near", (-F.col("x.less")).alias("best_n"), F.col("x.best").alias("best"))


def _roots(forms: DataFrame, most: int = 40) -> DataFrame:
    """(word, root) by following forms (word, form); each round doubles how far roots reach. A form is more frequent than its word, so there is no circle."""
    roots = keep(forms.select("word", F.col("form").alias("root")))
    for _ in range(most):
        up = roots.select(F.col("word").alias("root"), F.col("root").alias("up"))
        roots = keep(roots.join(up, "root", "left").select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")))
        moved = roots.agg(F.count_if("moved")).first()[0]
        roots = roots.drop("moved")
        if not moved:
            return roots
    raise RuntimeError(f"roots did not settle in {most} rounds")


def variant_groups(words: DataFrame, factor: int = 5) -> DataFrame:
    """Each word of words (word, n) with its form and root: word, form, root, n, n_near, form_n.

    A word's form is its most frequent near word, if that is at least factor times as frequent, else null, form_n its
    frequency; the root is where following forms ends, the word itself if it has none. Words are unique and not null,
    factor is above 1; no words give no rows.
    """
    words = keep(words)
    found = words.join(near_words(words), "word", "left")
    enough = F.col("best_n") >= factor * F.col("n")
    found = keep(found.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, F.col("best")).alias("form"), F.when(enough, F.col("best_n")).alias("form_n")))
    roots = _roots(found.filter("form is not null").select("word", "form"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(documents: DataFrame) -> DataFrame:
    """Spelling variants among the words of documents (doc_id, text): word, form, root, n, n_near, form_n.

    Words as of frequent_words, variants as of variant_groups. Null or empty texts add no words, a null id is an empty
    one, repeated rows count each time, words as frequent as each other are taken by code points, other columns are
    ignored, and a table without frequent words gives no rows.
    """
    return variant_groups(frequent_words(documents))


#: crc32 by its table, near words by what is left of them when a letter is taken out.
ORACLE_SQL = r"""
    WITH RECURSIVE docs AS (
      SELECT concat(doc_id, ':') AS pre, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
    ), runs AS (
      SELECT pre, unnest(regexp_extract_all(t, '[a-z\x{00C0}-\x{00FF}]+')) AS run FROM docs
    ), distinct_runs AS (
      SELECT pre, run, count(*) AS n, concat(pre, run) AS named FROM runs GROUP BY ALL
    ), bits AS (
      SELECT i, 0 AS round, i::BIGINT AS c FROM range(256) x(i) UNION ALL
      SELECT i, round + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM bits WHERE round < 8
    ), crcs AS (
      SELECT list(c ORDER BY i) AS tab FROM bits WHERE round = 8
    ), hashed AS (
      SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(named, ''),
        lambda ch: CASE WHEN ord(ch) < 128 THEN [ord(ch)::BIGINT] ELSE [195::BIGINT, ord(ch)::BIGINT - 64] END))),
        lambda a, b: xor(a // 256, tab[xor(a % 256, b) + 1]))) AS h FROM distinct_runs, crcs
    ), spelled AS (
      SELECT n, CASE WHEN h % 199 = 0 THEN concat(substr(run, 1, (h % length(run))::BIGINT), substr(run, (h % length(run))::BIGINT + 2)) ELSE run END AS word FROM hashed
    ), words AS (
      SELECT word, sum(n)::BIGINT AS n FROM spelled WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
    ), less AS (
      SELECT word, n, i, concat(substr(word, 1, i - 1), substr(word, i + 1)) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
    ), near AS (
      SELECT a.word, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
      UNION SELECT l.word, w.word, w.n FROM less l JOIN words w ON l.rest = w.word
      UNION SELECT w.word, l.word, l.n FROM less l JOIN words w ON l.rest = w.word
    ), best AS (
      SELECT word, count(*) AS n_near, arg_min((other, other_n), (-other_n, other)) AS x FROM near GROUP BY word
    ), formed AS (
      SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN x[2] >= 5 * w.n THEN x[1] END AS form, CASE WHEN x[2] >= 5 * w.n THEN x[2] END AS form_n FROM words w LEFT JOIN best USING (word)
    ), climb AS (
      SELECT word, word AS here, 0 AS step FROM formed UNION ALL SELECT c.word, f.form, step + 1 FROM climb c JOIN formed f ON f.word = c.here WHERE f.form IS NOT NULL
    ), roots AS (
      SELECT word, arg_max(here, step) AS root FROM climb GROUP BY word
    )
    SELECT f.word, form, root, n, n_near, form_n FROM formed f JOIN roots USING (word)
"""
