"""The license scan against brute force over words, rules and pairs of detections, and every rule against its keyword."""

import random
import re
from re import _parser

from tidemark.llm import licenses
from tidemark.llm.license_rules import KINDS, read_rules

RULES = read_rules()


def sample(parsed, rng):
    """A text that a parsed pattern matches."""
    out = ""
    for op, arg in parsed:
        op = str(op)
        if op == "LITERAL":
            out += chr(arg)
        elif op == "NOT_LITERAL":
            out += "x"
        elif op == "IN":
            kind, value = rng.choice(arg)
            out += "x" if str(kind) == "NEGATE" or str(arg[0][0]) == "NEGATE" else chr(value) if str(kind) == "LITERAL" else chr(rng.randint(*value))
        elif op == "MAX_REPEAT":
            low, high, inner = arg
            out += "".join(sample(inner, rng) for _ in range(rng.randint(low, min(high, low + 3))))
        elif op == "SUBPATTERN":
            out += sample(arg[-1], rng)
        elif op == "BRANCH":
            out += sample(rng.choice(arg[1]), rng)
        elif op != "ASSERT":
            raise ValueError(op)
    return out


def test_rules_match_their_samples_and_need_their_keywords():
    assert len(RULES) > 200 and {r.kind for r in RULES} == set(KINDS)
    rng = random.Random(3)
    for rule in RULES:
        for _ in range(20):
            line = f" {sample(_parser.parse(rule.match.pattern), rng)} "
            assert rule.keyword in line, rule
            assert rule.match.search(line), (rule, line)


def brute(text):
    words = re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    places, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        own = phrase.split(" ")
        for i in range(len(words)):
            if words[i : i + len(own)] == own:
                places.append(i)
                labels.add(label)
    line = "".join(f" {w}" for w in words) + " "
    kinds = list(KINDS)
    found = [(m.start(), m.end(), kinds.index(r.kind), r.place, r) for r in RULES for m in r.match.finditer(line)]
    left = []
    for d in found:
        holds = (e for e in found if e is not d and e[0] <= d[0] and e[1] >= d[1])
        if not any(e[2] < d[2] or e[2] == d[2] and (e[1] - e[0] > d[1] - d[0] or e[3] < d[3]) for e in holds):
            left.append((d[4].label, d[4].kind, d[3], line.count(" ", 0, d[0]) - 1, line.count(" ", 0, d[1]) - 1))
    score = max([KINDS[x[1]] for x in left] + [KINDS["name"]] * bool(labels), default=0.0)
    return len(words), len(places), min(places, default=None), max(places, default=None), sorted(labels), sorted(labels | {x[0] for x in left}), score, sorted(left)


def scanned(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, labels string, score int")
    out = licenses.scan_licenses(df).collect()
    return sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score, sorted((d.label, d.kind, d.rule, d.first, d.last) for d in r.detections)) for r in out), key=str)


TEXTS = [
    "Licensed under CC BY-NC 4.0.", "Released under the MIT License, or under the Apache License, Version 2.0!", "the GNU General Public License, version 3", "cc by\nNC cc-by-nc",
    "SPDX-License-Identifier: (MIT OR Apache-2.0)", "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "https://creativecommons.org/licenses/by-nc-sa/4.0/", "GPLv3 and LGPL v2.1", "under the ÀMIT license", "Sie fährt mit der Bahn, submit", "3-clause BSD license", "Copyright (c) 2020 Ann Example. All rights reserved.", "under the mit license under the mit license",
]


def test_whole_texts_by_brute_force(spark):
    rng = random.Random(9)
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    rows += [(100 + i, " ".join(rng.choice([*TEXTS, "some", "words", "licence", "license", "ünder the mit license"]) for _ in range(rng.randint(1, 60)))) for i in range(60)]
    for rule in RULES:
        rows.append((1000 + rule.place, f"Note: {sample(_parser.parse(rule.match.pattern), rng)} {rng.choice(TEXTS)}"))
    rows += [(5, TEXTS[0]), (5, TEXTS[1]), (None, TEXTS[2]), (7, None), (8, ""), (9, " \t\n.,;"), (10, "word " * 200_000 + "cc by nc"), (11, "cc by nc " * 3000)]
    assert scanned(spark, rows) == sorted(((i, *brute(t)) for i, t in rows), key=str)


def test_clean_texts_and_empty_tables(spark):
    rows = [(1, "Der Zug kam mit einer Stunde Verspätung; the public domain name system and a driver without papers."), (2, "An apache dance, by night, no cc.")]
    assert [r[5:] for r in scanned(spark, rows)] == [([], [], 0.0, [])] * 2
    assert scanned(spark, []) == []


def test_surer_kinds_win():
    def found(text):
        return [(d.rule.label, d.rule.kind) for d in licenses.detect(licenses.one_line(text.encode()), RULES, licenses.keyword_gate(RULES))]

    assert found("licensed under the GNU General Public License") == [("gpl", "notice")]
    assert found("the GNU General Public License, version 2") == [("gpl-2", "name")]
    assert found("licensed under CC BY-NC-SA 4.0") == [("cc-by-nc-sa", "notice")]
    assert found("SPDX-License-Identifier: BSD-3-Clause") == [("bsd-3", "tag")]


def test_digest(spark):
    df = spark.createDataFrame([(1, "Released under the MIT License and CC BY-NC 4.0"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.license_digest(licenses.scan_licenses(df)).collect()}
    assert got[1].base_labels == got[1].labels == "cc-by-nc,mit" and got[1].n_detections == 2
    assert (got[2].n_words, got[2].n_base, got[2].first_word, got[2].base_labels, got[2].labels, got[2].score) == (0, 0, None, "", "", 0.0)
