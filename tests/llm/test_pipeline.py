from collections import Counter

import corpus_pipeline
from tests.llm.test_unique_documents import brute_kept
from tidemark.llm import mixing, quality, secrets

DATA = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], DATA).write.parquet(str(tmp_path / str(i)))
        seen.append(spark.read.parquet(str(tmp_path / str(i))))
    first, unique, clean, mixed, packed = seen[1:]
    assert all(x.columns == docs.columns for x in (first, unique, clean, mixed))
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    assert ids(first) == sorted(r.doc_id for r in quality.judge_quality(docs).filter("kept").collect())
    assert ids(unique) == brute_kept([(r.doc_id, r.text) for r in first.collect()])
    assert ids(clean) == ids(unique)
    assert secrets.find_secrets(clean).filter("n_assign + n_access + n_hex > 0").count() == 0
    copies = {r.doc_id: r.copies for r in mixing.mix_sources(clean).collect()}
    assert Counter(ids(mixed)) == Counter({d: n for d, n in copies.items() if n})
    starts = Counter(r.doc_id for r in packed.filter("start = 0").collect())
    assert starts == Counter(ids(mixed))
    assert packed.selectExpr("max(offset + length)").first()[0] <= 4096


def test_run_gives_the_stages_rows(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0
