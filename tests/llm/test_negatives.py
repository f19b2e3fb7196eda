"""Hard negatives against brute force over all pairs, and how much the trees skip."""

import math

import numpy as np
import pytest

from tidemark.llm import negatives as hn


def brute(rows, every=100, positives=5, k=10):
    """rows: vec_id, label, vector of integers."""
    out = []
    for a, label, x in rows:
        if a % every:
            continue
        scored = sorted((-sum(int(p) * int(q) for p, q in zip(x, y, strict=False)), i, lab) for i, lab, y in rows if i != a)
        for s, i, _ in [r for r in scored if r[2] == label][:positives]:
            hits = [(n, j) for n, j, lab in scored if lab != label and 30 * -s <= 100 * -n <= 90 * -s][:k]
            out += [(a, i, r + 1, j, -s, -n) for r, (n, j) in enumerate(hits)]
    return sorted(out)


def clustered(rng, n, centres=40, dims=32):
    c = rng.normal(size=(centres, dims))
    v = c[rng.integers(0, centres, n)] + 0.15 * rng.normal(size=(n, dims))
    return np.floor(256 * v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.int64)


def under(node):
    return node.rows.tolist() if node.rows is not None else [r for c in node.children for r in under(c)]


@pytest.mark.parametrize("kind", ["clustered", "random", "copies", "tails"])
def test_trees_hold_every_row_within_its_radius(kind):
    rng = np.random.default_rng(1)
    m = clustered(rng, 3000) if kind == "clustered" else rng.integers(-200, 200, (3000, 32))
    if kind == "copies":
        m[100:2600] = m[0]
    if kind == "tails":
        m = np.floor(m * np.exp(3 * rng.normal(size=(3000, 1)))).astype(np.int64)
    points = hn.augmented(m)
    root = hn.cover_tree(points, rng.integers(0, 5, 3000), 32)
    assert sorted(under(root)) == list(range(3000))
    todo, depth = [(root, 0)], 0
    while todo:
        node, d = todo.pop()
        depth = max(depth, d)
        assert np.linalg.norm(points[under(node)] - node.centre, axis=1).max() <= node.radius + 1e-6
        assert node.rows is None or len(node.rows) <= 32
        todo += [(c, d + 1) for c in node.children]
    assert depth < 40


@pytest.mark.parametrize("scale", [200, 10**10, 10**17])
def test_windows_are_exact_with_ties(scale):
    rng = np.random.default_rng(2)
    m = rng.integers(-scale, scale, (900, 8))
    m[300:420] = m[10]
    ids, labels = np.sort(rng.permutation(2000)[:900]), rng.integers(0, 3, 900)
    root = hn.cover_tree(hn.augmented(m), labels, 16)
    of = np.repeat(np.arange(20), 3)
    products = m[:20].astype(object) @ m.T.astype(object)
    low = np.array([-(1 << 200), -(scale**2), scale**2 // 2] * 20, dtype=object)
    high = np.array([1 << 200, scale**2, 3 * scale**2] * 20, dtype=object)
    for same in (True, False):
        got = hn.search_windows(ids, labels, m, root, ids[:20], labels[:20], m[:20], of, low, high, 7, same)
        for w in range(60):
            a = of[w]
            fits = [(-int(products[a, j]), int(ids[j])) for j in range(900) if (labels[j] == labels[a]) == same and ids[j] != ids[a] and low[w] <= products[a, j] <= high[w]]
            mine = got.window == w
            assert list(zip((-got.score[mine]).tolist(), got.name[mine].tolist(), strict=True)) == sorted(fits)[:7]


def test_clustered_vectors_skip_most_leaves():
    rng = np.random.default_rng(3)
    m, labels, ids = clustered(rng, 20_000), rng.integers(0, 10, 20_000), np.arange(20_000)
    root, scored = hn.cover_tree(hn.augmented(m), labels), []
    best = [int(sorted(m[a] @ m.T)[-3]) for a in range(40)]
    hn.search_windows(ids, labels, m, root, ids[:40], labels[:40], m[:40], np.arange(40), np.array([9 * b // 10 for b in best], dtype=object), np.array(best, dtype=object), 10, False, scored)
    leaves = []
    todo = [root]
    while todo:
        node = todo.pop()
        leaves += [node] if node.rows is not None else []
        todo += node.children
    assert sum(scored) / (40 * len(leaves)) < 0.2


def test_ranges_groups_and_floors_on_spark(spark, monkeypatch):
    for name, value in (("RANGE", 300), ("PART", 8), ("GROUP", 7), ("SHARE", 3), ("LEAF", 16)):
        monkeypatch.setattr(hn, name, value)
    rng = np.random.default_rng(4)
    m = clustered(rng, 1500, 9, 12)
    m[500:1000] = m[0]  # a third of all rows alike
    labels = rng.integers(0, 4, 1500)
    rows = [(i * 4, int(labels[i]), m[i].tolist()) for i in range(1500)]
    rows += rows[75:76] + [(4000, 9, m[3].tolist()), (7, 2, [1, 2]), (9, 2, []), (11, 1, [0] * 12)]
    df = spark.createDataFrame([(*r, "a", "b", 1) for r in rows], "vec_id long, label long, v array<long>, range string, row string, lead int")
    got = sorted(tuple(r) for r in hn.hard_negatives(df).collect())
    assert got == brute(rows) and len(got) > 500


def test_rows_that_take_no_part(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=4)], int(rng.integers(-1, 12))) for i in range(260)]
    rows += [(300, None, 1), (400, [float("nan"), 1.0, 1.0, 1.0], 1), (500, [None, 1.0, 1.0, 1.0], 1), (600, [1.0, 1.0, 1.0, 1.0], None), (None, [9.0, 9.0, 9.0, 9.0], 1), (700, [float("inf"), 0.0, 0.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    # a remainder has the sign of what is divided, in SQL
    moved = lambda i, lab: int(math.fmod(lab + 1, 10)) if i % 7 == 0 else lab
    whole = [(i, moved(i, lab), [math.floor(256 * x) for x in e]) for i, e, lab in rows[:260]]
    got = sorted(tuple(r) for r in hn.mined_negatives(df).collect())
    assert got == brute(whole) and got
    assert hn.mined_negatives(df.limit(0)).count() == 0
