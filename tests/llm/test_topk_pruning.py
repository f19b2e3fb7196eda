"""How many blocks are skipped, and that skipping loses nothing."""

import numpy as np

from tidemark.llm import topk


def clustered(rng, n, centres=60):
    c = rng.normal(size=(centres, 64))
    v = c[rng.integers(0, centres, n)] + 0.15 * rng.normal(size=(n, 64))
    return np.floor(1024 * v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.int64)


def test_clustered_vectors_skip_most_blocks():
    rng = np.random.default_rng(1)
    m, ids, scored = clustered(rng, 20_000), np.arange(20_000), []
    got = topk.search(ids, m, ids[:50], m[:50], 10, scored=scored)
    products = m[:50] @ m.T
    for q in range(50):
        want = sorted(((-int(products[q, j]), j) for j in range(len(m)) if j != q))[:10]
        assert got[q] == [(-s, i) for s, i in want]
    blocks = -(-20_000 // topk.BLOCK)
    assert sum(scored) / (50 * blocks) < 0.1


def test_a_floor_skips_more_and_loses_nothing():
    rng = np.random.default_rng(2)
    m, ids = clustered(rng, 5_000), np.arange(5_000)
    free, bound = [], []
    exact = topk.search(ids, m, ids[:40], m[:40], 10, scored=free)
    floors = np.array([e[-1][0] for e in exact], dtype=object)
    assert topk.search(ids, m, ids[:40], m[:40], 10, floors=floors, scored=bound) == exact
    assert sum(bound) <= sum(free)


def test_ranges_and_floors_on_spark(spark, monkeypatch):
    monkeypatch.setattr(topk, "RANGE", 300)
    monkeypatch.setattr(topk, "PART", 8)
    rng = np.random.default_rng(3)
    m = clustered(rng, 2_000, 9)
    m[500:520] = m[0]
    df = spark.createDataFrame([(i, [float(x) / 1024 for x in v], "a", "b", "c", "d") for i, v in enumerate(m)], "vec_id long, embedding array<double>, lead string, floor string, range string, row string")
    products = m @ m.T
    want = []
    for q in range(0, 2_000, 100):
        best = sorted(((-int(products[q, j]), j) for j in range(2_000) if j != q))[:10]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_inner_products(df).collect()) == sorted(want)


def test_blocks_hold_every_row_once():
    rng = np.random.default_rng(4)
    for n in (0, 1, 63, 64, 65, 1000):
        order = topk.block_order(rng.integers(-9, 9, (n, 5)), 64)
        assert sorted(order.tolist()) == list(range(n))
    assert len(topk.block_order(np.zeros((300, 4), np.int64), 64)) == 300
