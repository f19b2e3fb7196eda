"""Repeats and near copies against their SQL, on the smallest table and on edge rows."""

import pytest

from tests.llm.test_native import same
from tidemark.llm.near_dedup import near_duplicates
from tidemark.llm.queries import ORACLE_SQL
from tidemark.llm.repeats import repeated_passages

DOCUMENTS = [("doc_id", "BIGINT"), ("text", "VARCHAR")]
LONG = " ".join(f"w{i}" for i in range(120))
EDGES = [
    (1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one  TWO"), (6, LONG), (7, "x " + LONG.upper() + " y"), (8, LONG + " " + LONG), (9, "q " * 200),
    (10, "É Ü " * 40), (11, "é ü " * 40), (12, " ".join(f"w{i}" for i in range(20, 90)) + "\x0bend"), (13, LONG.replace("w50", "new")),
]


@pytest.mark.parametrize("rows", [EDGES, EDGES + EDGES[5:8], [], None])
def test_repeats_match_sql(spark, rows):
    rows = given(spark) if rows is None else rows
    same(repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")), ORACLE_SQL["op1_suffix_array_dedup"], "documents", rows, DOCUMENTS)


@pytest.mark.parametrize("rows", [EDGES, EDGES + EDGES[5:8] + [(None, LONG)], [], None])
def test_near_copies_match_sql(spark, rows):
    rows = given(spark) if rows is None else rows
    same(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")), ORACLE_SQL["op2_minhash_near_dedup"], "documents", rows, DOCUMENTS)


def given(spark):
    return [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
