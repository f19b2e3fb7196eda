"""License statements found by ordered signature rules.

A text's words are put into one line in lower case. An automaton of all keywords finds which rules can match at all, and
only those patterns are run. What they find is resolved by the rules' order: a detection that lies within one of a surer
kind, or of the same kind and longer, or as long and earlier in the table, is suppressed. Detections that overlap without
one holding the other stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._words import give_back, pieces
from tidemark.llm.license_rules import KINDS, Rule, read_rules

#: Phrases that are counted wherever they stand, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Bytes of words in lower case: digits, letters and all that isn't ASCII; the rest parts words.
_WORD = bytes(b + 32 if 65 <= b < 91 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_GAPS = re.compile(b" {2,}")
_ORDER = {kind: i for i, kind in enumerate(KINDS)}

SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double, detections array<struct<label: string, kind: string, rule: int, first: long, last: long>>"


class Detection(NamedTuple):
    """A rule's match: the places of its first character and of that after its last."""

    start: int
    end: int
    rule: Rule


def one_line(text: bytes) -> str:
    """The words of a text in lower case, with one space before, between and after them; a space if there are none."""
    return _GAPS.sub(b" ", b" " + text.translate(_WORD) + b" ").decode("utf-8", "replace")


def keyword_gate(rules: list[Rule]) -> ahocorasick.Automaton:
    """An automaton that gives, for every keyword, the places of the rules that need it."""
    gate = ahocorasick.Automaton()
    by_keyword: dict[str, list[int]] = {}
    for i, rule in enumerate(rules):
        by_keyword.setdefault(rule.keyword, []).append(i)
    for keyword, places in by_keyword.items():
        gate.add_word(keyword, tuple(places))
    gate.make_automaton()
    return gate


def resolve(found: list[Detection]) -> list[Detection]:
    """What is left once detections within surer, longer or earlier ones are suppressed, by place."""
    found = sorted(found, key=lambda d: (d.start, -d.end, _ORDER[d.rule.kind], d.rule.place))
    ends, levels = np.array([d.end for d in found], np.int64), np.array([_ORDER[d.rule.kind] for d in found], np.int64)
    stays = np.zeros(len(found), bool)
    for level in np.unique(levels).tolist():
        among = np.flatnonzero(levels <= level)
        before = np.maximum.accumulate(np.concatenate([[-1], ends[among][:-1]]))
        own = levels[among] == level
        stays[among[own]] = before[own] < ends[among[own]]
    return [d for d, s in zip(found, stays.tolist(), strict=True) if s]


def detect(line: str, rules: list[Rule], gate: ahocorasick.Automaton) -> list[Detection]:
    """Detections of the rules in a line of words, resolved."""
    possible: set[int] = set()
    for _, places in gate.iter(line):
        possible.update(places)
    found = [Detection(*m.span(), rules[i]) for i in possible for m in rules[i].match.finditer(line)]
    return resolve(found) if found else []


def phrase_places(line: str, phrases: dict[str, str]) -> dict[str, list[int]]:
    """Where each phrase's words stand: the places of the space before the first."""
    out: dict[str, list[int]] = {}
    for phrase in phrases:
        at = line.find(f" {phrase} ")
        while at >= 0:
            out.setdefault(phrase, []).append(at)
            at = line.find(f" {phrase} ", at + 1)
    return out


def _word_numbers(line: str, places: set[int]) -> dict[int, int]:
    """The number of the word that begins after each of some spaces, in one pass over the line."""
    out, at, n = {}, 0, 0
    for p in sorted(places):
        n += line.count(" ", at, p)
        out[p], at = n, p
    return out


def _scan(rules: list[Rule], phrases: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gate = keyword_gate(rules)
        kinds = pa.struct([("label", pa.string()), ("kind", pa.string()), ("rule", pa.int32()), ("first", pa.int64()), ("last", pa.int64())])
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.float64(), pa.list_(kinds))
        for batch, data, offsets in pieces(batches):
            rows = []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                line = one_line(data[a:b].tobytes())
                n_words = max(line.count(" ") - 1, 0)
                base = phrase_places(line, phrases)
                found = detect(line, rules, gate)
                at = _word_numbers(line, {p for ps in base.values() for p in ps} | {d.start - 1 for d in found} | {d.end for d in found})
                starts = [at[p] for ps in base.values() for p in ps]
                base_labels = {phrases[p] for p in base}
                scores = [KINDS[d.rule.kind] for d in found] + [KINDS["name"]] * bool(base)
                spans = [{"label": d.rule.label, "kind": d.rule.kind, "rule": d.rule.place, "first": at[d.start - 1], "last": at[d.end] - 1} for d in found]
                rows.append((n_words, len(starts), min(starts, default=None), max(starts, default=None), sorted(base_labels), sorted(base_labels | {d.rule.label for d in found}), max(scores, default=0.0), spans))
            columns = [pa.array([r[c] for r in rows], t) for c, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *(s.split()[0] for s in re.split(r", (?=\w+ )", SCHEMA))])
        give_back()

    return run


def scan_licenses(documents: DataFrame, rules: list[Rule] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """What licenses each text of documents (doc_id, text) states, one row for each row.

    Words are runs of digits, a-z and whatever isn't ASCII, in lower case. n_words counts them; n_base counts places
    where the words of one of phrases stand, first_word and last_word are where the first and the last of these begin,
    from 0 (null if none); base_labels are their labels and labels those and the detections' labels, both distinct and
    sorted. score is the worth of the surest detection or phrase (0 if none), and detections lists label, kind, place of
    the rule in the table and first and last word of each detection that is left.

    A text that is null or empty has no words and no labels. Null and repeated ids are kept as they are, each row by its
    own text; other columns are ignored, and an empty table gives no rows. Texts of any length are scanned whole.
    """
    rules, phrases = rules if rules is not None else read_rules(), phrases if phrases is not None else PHRASES
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(_scan(rules, phrases), f"doc_id {kind}, {SCHEMA}")


def license_digest(scanned: DataFrame) -> DataFrame:
    """scan_licenses with its labels as text, joined by commas, and the number of detections."""
    joined = {c: F.array_join(c, ",") for c in ("base_labels", "labels")}
    return scanned.withColumns(joined).withColumn("n_detections", F.size("detections").cast("long")).drop("detections")
