import math
import re
import zlib
from collections import Counter

import numpy as np

from tidemark.llm import ngram_lm
from tidemark.llm.ngram_lm import Filter, count_of, level_of, score_documents

DATA = "/root/testdata/sf0.001"


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def brute(rows):
    counts = Counter(t for d, x in rows if not held(d) for t in tokens(x))
    n, v = sum(counts.values()), len(counts)
    return n, [(d, held(d), len(tokens(x)), sum(counts[t] > 0 for t in tokens(x)), sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens(x))) for d, x in rows]


def check(spark, rows):
    n, want = brute(rows)
    got = score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.train_tokens == n for r in got)
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[4])
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.base_score) for r in got), key=key)
    want = sorted(want, key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert np.allclose([r[4] for r in got], [r[4] for r in want], rtol=1e-9)


def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]


def test_base_scores_match_brute_force(spark):
    check(spark, documents(spark))


def test_edges(spark):
    check(spark, [(1, None), (2, ""), (3, "One one ONE\ttwo"), (3, "One one ONE\ttwo"), (None, "x y"), (4, "zz " * 3000), (5, "É é")])
    assert score_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_the_model_beats_the_base_and_shuffled_text_on_held_out_documents(spark):
    rng = np.random.default_rng(0)
    rows, phrases = [], [[f"w{x}" for x in rng.integers(0, 300, 6)] for _ in range(80)]
    for i in range(400):
        rows.append((i, " ".join(w for p in rng.integers(0, 80, 30) for w in phrases[p])))
    mixed = [(d, " ".join(rng.permutation(t.split(" ")))) if held(d) and d % 2 else (d, t) for d, t in rows]
    got = {r.doc_id: r for r in score_documents(spark.createDataFrame(mixed, "doc_id long, text string")).collect() if r.held_out}
    plain = [r.score / r.n_tokens for d, r in got.items() if not d % 2]
    shuffled = [r.score / r.n_tokens for d, r in got.items() if d % 2]
    base = [r.base_score / r.n_tokens for d, r in got.items() if not d % 2]
    assert min(plain) > max(base) and min(plain) > max(shuffled)


def test_levels():
    c = np.arange(0, 3000)
    levels = level_of(c)
    assert levels[0] == 0 and levels[1] == 1 and (np.diff(levels) >= 0).all()
    assert np.abs(np.log((count_of(levels[1:])) / c[1:])).max() < math.log(ngram_lm.BASE)


def test_filter_never_underestimates():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2)
    levels = rng.integers(1, 9, 5000)
    bits, size = 2, 64 * (int(levels.sum()) * ngram_lm.BITS_EACH // 256)  # as many bits for each as the model has
    cells = np.stack([Filter.segment([(1, keys[own], levels[own])], size) for own in ((keys >> np.uint64(62)).astype(int) == s for s in range(4))])
    got = Filter(cells, bits).levels(keys, 1)
    assert (got >= levels).all() and (got > levels).mean() < 0.1
    assert (Filter(cells, bits).levels(keys + np.uint64(1), 1) > 0).mean() < 0.1
