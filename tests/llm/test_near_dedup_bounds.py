import pytest

from tidemark.llm.near_dedup import near_duplicates


def test_similarities_that_the_bands_would_lose_are_refused(spark):
    rows = spark.createDataFrame([(1, "a b c d"), (2, "a b c d")], "doc_id long, text string")
    assert {r.component_id for r in near_duplicates(rows, percent=90).collect()} == {1}
    with pytest.raises(ValueError):
        near_duplicates(rows, shingle=5, percent=80)
