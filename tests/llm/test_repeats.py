import re

import numpy as np

from tidemark.llm.repeats import drop_repeats, repeated_passages

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def spans(marks):
    out, at = [], None
    for i, m in enumerate([*marks, False]):
        if m and at is None:
            at = i
        if not m and at is not None:
            out.append(f"{at}-{i}")
            at = None
    return ",".join(out)


def brute(rows, window=50):
    """Spans of words inside windows that occur twice, and that occur earlier, of every (doc_id, text)."""
    seen, texts = {}, sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    words = [WORD.findall(t or "") for _, t in texts]
    for i, w in enumerate(words):
        for s in range(len(w) - window + 1):
            seen.setdefault(tuple(w[s : s + window]), []).append((i, s))
    out = {}
    for i, w in enumerate(words):
        every, later = np.zeros(len(w), bool), np.zeros(len(w), bool)
        for s in range(len(w) - window + 1):
            at = seen[tuple(w[s : s + window])]
            every[s : s + window] |= len(at) > 1
            later[s : s + window] |= at[0] != (i, s)
        if every.any():
            out[texts[i][0]] = (spans(every), spans(later))
    return out


def found(spark, rows, parts=4, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        return {r.doc_id: (r.repeated, r.later) for r in repeated_passages(df, **more).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_matches_brute_force_on_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows)
    got = found(spark, rows)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}


def test_planted_passages_over_many_partitions(spark):
    rng = np.random.default_rng(1)
    fresh = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    common, tail = fresh(70), fresh(55)
    rows = []
    for i in range(60):
        text = fresh(rng.integers(0, 40)) + common + fresh(rng.integers(0, 30))
        if i % 3 == 0:
            text += tail[: rng.integers(45, 56)] + fresh(3)
        rows.append((i, " ".join(text)))
    rows += [(100, " ".join(fresh(200))), (101, " ".join(common[:49])), (102, rows[5][1]), (103, rows[5][1])]
    for parts in (1, 7, 40):
        assert found(spark, rows, parts) == brute(rows)


def test_edges(spark):
    long = " ".join(f"v{i % 700}" for i in range(3000))
    rows = [(1, None), (2, ""), (3, "a\tb"), (4, "x " * 300), (5, long), (5, long), (6, "é" * 10), (None, "q " * 60)]
    assert found(spark, rows, window=50) == brute(rows)
    assert found(spark, []) == {}


def test_what_is_left(spark):
    base = " ".join(f"w{i}" for i in range(80))
    rows = [(1, "start " + base + " end"), (2, "other\n" + base + "\nrest of it"), (3, "clean text")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.text for r in drop_repeats(df).collect()}
    assert out == {1: rows[0][1], 2: "other\nrest of it", 3: "clean text"}
