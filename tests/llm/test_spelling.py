"""Spelling variants against brute force over all pairs of words, and on rows at the edges."""

import itertools
import random
import re
import zlib
from collections import Counter

from tidemark.llm import spelling


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def words_of(rows):
    out = Counter()
    for doc_id, text in rows:
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for run in re.findall("[a-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            if len(run) >= 6:
                out[run] += 1
    return {w: n for w, n in out.items() if n >= 5}


def groups_of(words):
    near = {w: [] for w in words}
    for a, b in itertools.combinations(words, 2):
        if abs(len(a) - len(b)) <= 1 and one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best and words[best] >= 5 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return sorted(out)


def found(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def test_forms_and_roots_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(spelling, "BLOCK", 64)  # several blocks of one signature, and several tiles
    monkeypatch.setattr(spelling, "TILE", 200)
    rng = random.Random(5)
    words = {}
    for _ in range(60):
        stem = "".join(rng.choice("abcdeéñÿÀ") for _ in range(rng.randint(6, 9)))
        for n in (5000, 900, 100, 10):
            words[stem] = n
            i = rng.randrange(len(stem))
            stem = stem[:i] + rng.choice(["", "b", "é", "xa"]) + stem[i + rng.randint(0, 1) :]
    words |= {"".join(p): rng.randint(5, 60) for p in itertools.product("ab", repeat=7)}
    words = {w: n for w, n in words.items() if len(w) >= 6}
    assert len({w: 0 for w in words}) > 250
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = found(spelling.variant_groups(df))
    assert got == groups_of(words) and any(r[2] != r[1] for r in got if r[1])


def test_texts_by_brute_force(spark):
    rng = random.Random(1)
    stems = ["colour", "Éclairs", "organise", "theatre", "naïveté", "Straße"]
    rows = [(i, " ".join(rng.choice(stems + ["ox-cart", "12fathom"]) for _ in range(300)) + rng.choice([" color", "\nClimbs,climbs", ""])) for i in range(120)]
    rows += [(7, rows[7][1]), (None, "strasse " * 9), (500, None), (501, ""), (502, "z" * 5000 + " " + "é" * 5000), (503, "1 2 3")]
    df = spark.createDataFrame([(*r, 1, "w") for r in rows], "doc_id long, text string, n int, word string")
    assert found(spelling.spelling_variants(df)) == groups_of(words_of(rows))


def test_parts_cut_no_run(monkeypatch):
    text = "Aé " * 50 + "x" * 300 + "Ünfall-é" * 40
    parts = list(spelling._parts(memoryview(text.encode()), 64))
    assert "".join(parts) == text.translate({c: c + 32 for c in range(65, 91)}) and len(parts) > 3
    whole = Counter(spelling._RUN.findall("".join(parts)))
    assert sum((Counter(spelling._RUN.findall(p)) for p in parts), Counter()) == whole


def test_long_words_of_one_length(spark):
    long = ["a" * 3000, "a" * 2999 + "b", "a" * 2999, "a" * 1500 + "b" + "a" * 1500]
    df = spark.createDataFrame([(w, 10) for w in long], "word string, n long")
    assert found(spelling.variant_groups(df)) == groups_of(dict.fromkeys(long, 10))


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert found(spelling.spelling_variants(df)) == []
    assert found(spelling.spelling_variants(spark.createDataFrame([(1, "some words here")], "doc_id long, text string"))) == []
