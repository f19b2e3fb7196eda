import zlib
from collections import defaultdict
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm.packing import best_fill, pack_documents

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(spark, rows, window=4096):
    t = Tokenizer.from_file(PATH)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    pieces = pack_documents(df, PATH, window=window, want_ids=True).collect()
    docs, seqs = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert zlib.crc32(p.ids) == p.ids_crc32 and len(p.ids) == 4 * p.length and p.length > 0
        docs[p.doc_id].append(p)
        seqs[p.sequence_id].append(p)
    assert set(docs) == {d for d, _ in rows}
    for d, text in rows:
        own = sorted(docs[d], key=lambda p: p.start)
        ids = np.frombuffer(b"".join(p.ids for p in own), "<u4").tolist()
        assert ids == [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert all(p.doc_tokens == len(ids) for p in own)
        assert [p.start for p in own] == np.cumsum([0, *(p.length for p in own)])[:-1].tolist()
    padding = 0
    for own in seqs.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == np.cumsum([0, *(p.length for p in own)])[:-1].tolist()
        total = sum(p.length for p in own)
        assert total <= window
        padding += 0 if total & (total - 1) == 0 else window - total
    return padding


def test_round_trip_of_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert check(spark, rows) == 0


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "a " * 9000), (5, "<|endoftext|> don't İstanbul ΑΣ é  x y 中文 1234 !!"), (6, "x" * 5000), (None, "no id")]
    assert check(spark, rows, window=64) == 0
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_repeated_rows_are_packed_each(spark):
    df = spark.createDataFrame([(1, "same text", "x")] * 5, "doc_id long, text string, length string")
    assert sum(r.start == 0 for r in pack_documents(df, PATH).collect()) == 5


@pytest.mark.parametrize("seed", range(20))
def test_best_fill_is_optimal(seed):
    rng = np.random.default_rng(seed)
    counts = {int(k): int(rng.integers(1, 5)) for k in rng.choice(np.arange(1, 40), 5, replace=False)}
    target = int(rng.integers(1, 120))
    got = best_fill(counts, target)
    sums = [sum(k * n for k, n in zip(counts, take, strict=True)) for take in product(*(range(c + 1) for c in counts.values()))]
    assert sum(k * n for k, n in got.items()) == max(s for s in sums if s <= target)
    assert all(n <= counts[k] for k, n in got.items())
