from tests.llm.test_native import DOCUMENTS, frame, same
from tidemark.llm import mixing


def test_documents_without_words_of_a_full_source_enter_at_most_three_times(spark):
    rows = [(i, "w " * 10 if i % 3 else "", "small" if i < 12 else "large", "en") for i in range(300)]
    df = frame(spark, rows)
    out = mixing.mix_sources(df).collect()
    assert max(r.copies for r in out) == 3 and {r.copies for r in out if r.doc_id < 12} == {3}
    assert mixing.mixed_documents(df).count() == sum(r.copies for r in out)
    same(mixing.mix_sources(df), mixing.ORACLE_SQL, "documents", rows, DOCUMENTS)


def test_no_rows_give_no_rows(spark):
    assert mixing.mixed_documents(frame(spark, [])).count() == 0
