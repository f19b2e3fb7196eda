import re
from collections import defaultdict

import numpy as np
import pytest

from tidemark.llm.near_dedup import near_duplicates, overlaps

DATA = "/root/testdata/sf0.001"


def shingles(text, size=3):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def brute(rows):
    sets = {d: shingles(t) for d, t in rows}
    comp = {d: d for d in sets}
    by = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            by[x].append(d)
    pairs = {(a, b) for ds in by.values() for a in ds for b in ds if a < b}
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    while True:
        changed = False
        for a, b in links:
            m = min(comp[a], comp[b])
            if comp[a] != m or comp[b] != m:
                comp[a] = comp[b] = m
                changed = True
        if not changed:
            return {d: (len(sets[d]), comp[d]) for d in sets}


def found(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df).collect()}


def test_matches_brute_force_on_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    assert found(spark, rows) == brute(rows)


def test_chains_of_near_copies(spark):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in rng.integers(0, 5000, 200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 60):
        words = rows[rng.integers(0, len(rows))][1].split(" ")
        words[rng.integers(0, 200)] = f"x{i}"
        rows.append((i, " ".join(words)))
    assert found(spark, rows) == brute(rows)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "one  TWO"), (6, "one"), (7, "A " * 3000), (8, "a\x0ba\x0ca"), (9, "é é é"), (9, "other words here")]
    df = spark.createDataFrame([(*r, "x") for r in rows] + [(None, "one two", "y")], "doc_id long, text string, n_shingles string")
    out = sorted(((r.doc_id or -1), r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect())
    assert out == [(-1, 1, None, True), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (7, 1, 7, True), (8, 1, 7, False), (9, 1, 9, True), (9, 1, 9, True)]


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("m", [1, 5, 40])
def test_overlaps(m):
    rng = np.random.default_rng(m)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 50)).astype(np.uint64)) for _ in range(m)]
    assert overlaps(sets).tolist() == [[len(np.intersect1d(a, b)) for b in sets] for a in sets]


def test_a_cluster_larger_than_a_block(spark, monkeypatch):
    from tidemark.llm import near_dedup

    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rng = np.random.default_rng(5)
    rows = [(0, " ".join(f"w{i}" for i in range(150)))]
    for i in range(1, 80):
        words = rows[rng.integers(0, len(rows))][1].split(" ")
        words[rng.integers(0, 150)] = f"y{i}"
        rows.append((i, " ".join(words)))
    assert found(spark, rows) == brute(rows)
