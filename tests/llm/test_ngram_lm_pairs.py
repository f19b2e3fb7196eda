"""The model keeps pairs of every count, whatever the chunks and segments."""

import math
import random
from collections import Counter

import numpy as np

from tests.llm.test_ngram_lm import DATA, documents, held, tokens
from tidemark.llm import ngram_lm
from tidemark.llm.ngram_lm import fit_model, level_of, score_documents, score_with


def quantised(counts):
    """The mean count of those that share a level, by level."""
    levels = level_of(np.array(list(counts.values())))
    values = np.array(list(counts.values()))
    means = {q: values[levels == q].mean() for q in set(levels.tolist())}
    return lambda c: float(means[int(level_of(np.array([c]))[0])]) if c else 0.0


def test_pairs_seen_once_count(spark):
    ids = [d for d in range(100) if held(d)][:2]
    phrase = [f"w{i}" for i in range(200)]
    mixed = random.Random(1).sample(phrase, len(phrase))
    rows = [(next(d for d in range(100) if not held(d)), " ".join(phrase)), (ids[0], " ".join(phrase)), (ids[1], " ".join(mixed))]
    got = {r.doc_id: r.score / r.n_tokens for r in score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[ids[0]] > got[ids[1]] + 1


def test_scores_are_those_of_all_counts(spark, monkeypatch):
    rows = documents(spark)
    train = [tokens(x) for d, x in rows if not held(d)]
    single = Counter(t for x in train for t in x)
    pairs = Counter(p for x in train for p in zip([None, *x], x, strict=False))
    whole = sum(single.values()) + len(single) + 1
    want, of_pair, of_token = {}, quantised(pairs), quantised(single)
    for d, x in rows:
        own = tokens(x)
        p = [0.5 * min(of_pair(pairs[a, b]) / max(of_token(single[a]), 1), 1) + 0.5 * (of_token(single[b]) + 1) / whole for a, b in zip([None, *own], own, strict=False)]
        want[d] = sum(math.log10(v) for v in p) / len(own)
    for chunk, bits in ((1 << 30, 10), (20_000, 2)):
        monkeypatch.setattr(ngram_lm, "CHUNK", chunk)
        monkeypatch.setattr(ngram_lm, "SEGMENT_BITS", bits)
        got = {r.doc_id: r.score / r.n_tokens for r in score_documents(spark.read.parquet(f"{DATA}/documents.parquet")).collect()}
        gap = np.array([got[d] - want[d] for d in want])
        assert np.abs(gap).mean() < 0.002 and np.abs(gap).max() < 0.02


def test_a_fitted_model_scores_documents_it_never_saw(spark, monkeypatch):
    rows = documents(spark)
    df = lambda own: spark.createDataFrame(own, "doc_id long, text string")
    whole = {r.doc_id: r for r in score_documents(df(rows)).collect()}
    for chunk, bits in ((1 << 30, 10), (50_000, 3)):
        monkeypatch.setattr(ngram_lm, "CHUNK", chunk)
        monkeypatch.setattr(ngram_lm, "SEGMENT_BITS", bits)
        model = fit_model(df([r for r in rows if not held(r[0])]))
        got = {r.doc_id: r for r in score_with(model, df(rows)).collect()}
        assert got.keys() == whole.keys() and all(got[d].n_tokens == whole[d].n_tokens for d in got)
        gap = np.array([(got[d].score - whole[d].score) / got[d].n_tokens for d in got])
        # with the same segments the filters are the same; with others, they take other keys for stored ones, a few in a thousand
        assert np.abs(gap).max() < 1e-9 if bits == 10 else np.abs(gap).mean() < 0.02 and np.median(np.abs(gap)) < 0.002
    assert model.filters.columns == ["kind", "segment", "cells"]
    new = {r.doc_id: r.score for r in score_with(model, df([(1, None), (2, "never seen words"), (3, rows[0][1]), (None, "")])).collect()}
    assert new[3] / 50 > new[2] and len(new) == 4 and all(math.isfinite(x) for x in new.values())
    assert score_with(model, df([])).count() == 0
    empty = fit_model(df([]))
    assert [r.score for r in score_with(empty, df([(1, "a b")])).collect()] == [3 * math.log10(0.5)]


def test_token_probabilities_sum_to_one(spark):
    rows = documents(spark)
    train = [tokens(x) for d, x in rows if not held(d)]
    single = Counter(t for x in train for t in x)
    levels = fit_model(spark.createDataFrame([r for r in rows if not held(r[0])], "doc_id long, text string")).levels
    assert (levels.total, levels.distinct) == (sum(single.values()), len(single))
    stored = level_of(np.array(list(single.values())))
    share = sum(levels.tokens[q] + 1 for q in stored.tolist()) / (levels.total + levels.distinct + 1)
    assert abs(share + 1 / (levels.total + levels.distinct + 1) - 1) < 0.01
