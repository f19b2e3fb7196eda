"""The near-dedup stage: five words, 0.8, and no text lost."""

import numpy as np

import corpus_pipeline
from tests.llm.test_near_dedup import shingles
from tidemark.llm.near_dedup import near_duplicates, unique_documents

SCHEMA = "doc_id long, text string, lang string, hash string, _row string, component_id string"
A = " ".join(f"a{i}" for i in range(80))
B = " ".join(f"b{i}" for i in range(80))
C = " ".join(f"c{i}" for i in range(80))


def stage(spark, rows):
    df = spark.createDataFrame([(*r, "en", "x", "y", "z") for r in rows], SCHEMA)
    out = corpus_pipeline.near_dedup(spark, df, "")
    assert out.columns == df.columns
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=str)


def test_repeated_ids_lose_no_text(spark):
    assert stage(spark, [(1, A), (2, A), (2, B)]) == [(1, A), (2, B)]
    assert stage(spark, [(2, A), (3, A), (2, B), (4, B), (4, C)]) == sorted([(2, A), (2, B), (4, C)], key=str)


def test_of_exact_copies_one_row_stays(spark):
    assert stage(spark, [(3, C), (3, C), (3, C)]) == [(3, C)]
    assert stage(spark, [(3, C), (3, C), (1, C), (1, C)]) == [(1, C)]
    near = A.replace("a40", "x")
    assert len(stage(spark, [(3, A), (3, near), (3, near)])) == 1


def test_rows_without_ids_or_words(spark):
    assert stage(spark, [(None, A), (None, A), (None, B)]) == sorted([(None, A), (None, B)], key=str)
    assert stage(spark, [(None, A), (7, A)]) == [(7, A)]
    assert stage(spark, [(1, None), (2, None), (2, None), (3, ""), (4, " \n")]) == sorted([(1, None), (2, None), (3, ""), (4, " \n")], key=str)
    assert stage(spark, []) == []


def test_very_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    assert stage(spark, [(1, long), (2, long + " end"), (3, A)]) == sorted([(1, long), (3, A)], key=str)


def brute_kept(rows):
    """Smallest id of each component at five words and 0.8."""
    sets = {d: shingles(t, 5) for d, t in rows}
    comp = {d: d for d in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    for _ in rows:
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    return sorted(d for d in comp if comp[d] == d)


def test_five_words_and_four_fifths_by_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(120):
        words = [f"w{j}" for j in rng.integers(0, 4000, 300)] if not rows or rng.random() < 0.3 else rows[rng.integers(0, len(rows))][1].split(" ")
        for j in rng.integers(0, len(words), int(rng.integers(0, 9))):
            words[j] = f"y{i}_{j}"
        if rng.random() < 0.2:
            words = words + [f"z{i}_{j}" for j in range(int(rng.integers(40, 90)))]
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in unique_documents(df).collect()) == brute_kept(rows)
    assert sorted(r.doc_id for r in near_duplicates(df, 5, 80, bands=35).filter("kept").collect()) == brute_kept(rows)
