import math

import numpy as np
import pytest

from tidemark.llm.topk import search, top_inner_products


@pytest.mark.parametrize("scale", [5, 10**6, 10**14])
def test_search_is_exact_with_ties(scale):
    rng = np.random.default_rng(4)
    m = rng.integers(-scale, scale, (700, 8))
    m[300:320] = m[10]
    ids = rng.permutation(700).astype(np.int64)
    got = search(ids, m, ids[:30], m[:30], 10, block=16)
    for q in range(30):
        exact = sorted(((-sum(int(a) * int(b) for a, b in zip(m[q], m[j], strict=True)), int(ids[j])) for j in range(700) if ids[j] != ids[q]))[:10]
        assert got[q] == [(-s, i) for s, i in exact]


def test_edges(spark):
    rows = [(0, [0.1, -0.2]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (100, [float("nan"), 1.0]), (200, None), (3, [None, 1.0]), (4, [float("inf"), 0.0]), (None, [1.0, 1.0]), (5, [])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in top_inner_products(df).collect())
    v = {i: [math.floor(1024 * float(np.float32(x))) for x in e] for i, e in ((0, [0.1, -0.2]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (5, []))}
    score = {i: sum(a * b for a, b in zip(v[0], v[i], strict=False)) for i in (1, 2, 5)}
    want = sorted(score, key=lambda i: (-score[i], i))
    assert got == [(0, k + 1, i, score[i]) for k, i in enumerate(want)]
    assert top_inner_products(df.limit(0)).count() == 0
