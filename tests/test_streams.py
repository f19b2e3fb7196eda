"""Stream twins in many batches against one batch, and against the batch operators."""

import random

import pytest

from tidemark import streaming
from tidemark.operators.book import touch_series

TAPE = "id long, ticker string, us long, seq long, side string, price long, size long, is_snapshot boolean"


def tape_rows(n=400):
    rng, rows, seq = random.Random(5), [], {}
    for i in range(n):
        ticker = "hot" if rng.random() < 0.6 else f"t{rng.randrange(4)}"
        snapshot = rng.random() < 0.08
        seq[ticker] = seq.get(ticker, 0) + rng.choice([1, 1, 1, 2, -1])
        for _ in range(3 if snapshot else 1):  # the levels of a snapshot share (us, seq), and may fall into two batches
            rows.append((len(rows), ticker, i // 2, seq[ticker], rng.choice(["yes", "no"]), rng.randrange(1, 6), rng.choice([0, 2, 5]) if snapshot else rng.choice([-5, -2, 2, 5]), snapshot))
    return rows


@pytest.fixture
def batches(spark, tmp_path):
    """A stream of one file a batch."""

    def make(rows, schema, each):
        for i in range(0, len(rows), each):
            spark.createDataFrame(rows[i : i + each], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/part={i:06d}"))
        if not rows:
            (tmp_path / "in/part=000000").mkdir(parents=True)
        names = [c.split()[0] for c in schema.split(", ")]
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/part=*")).select(*names)

    return make


def shown(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=str)


def test_book_in_batches(spark, batches):
    rows = tape_rows()
    got = streaming.stream_book(batches(rows, TAPE, 45))
    assert shown(got) == shown(touch_series(spark.createDataFrame(rows, TAPE)))


def test_gaps_in_batches(batches):
    rows = [(r[1], r[0], r[3]) for r in tape_rows()]
    want, last = [], {}
    for stream, i, seq in rows:
        if stream in last and seq != last[stream] + 1:
            want.append((i, "skip" if seq > last[stream] else "resubscribe", last[stream], seq, stream))
        last[stream] = seq
    assert shown(streaming.stream_gaps(batches(rows, "stream string, id long, seq long", 70))) == sorted(want, key=str)


def test_late_rows_in_batches(batches):
    rows = [(r[1], r[0], r[2] - r[0] % 3 * 4) for r in tape_rows()]
    want = {}
    for ticker, _, at in rows:
        n, late, most = want.get(ticker, (0, 0, at))
        want[ticker] = (n + 1, late + (at < most), max(most, at))
    got = streaming.late_rows(batches(rows, "ticker string, id long, ts_ms long", 90))
    assert {r.ticker: (r.n_rows, r.late) for r in got.collect()} == {k: v[:2] for k, v in want.items()}


def test_stale_alarms_in_batches(batches):
    rng, rows, want, last = random.Random(3), [], [], {}
    for i in range(200):
        rows.append((f"s{rng.randrange(3)}", i * 7 + rng.randrange(6), rng.randrange(5)))
    for stream, us, gaps in rows:
        late, many = stream in last and us - last[stream][0] > 30, gaps - last.get(stream, (0, 0))[1] > 2
        if late or many:
            want.append(("both" if late and many else "stale" if late else "gaps", stream, us))
        last[stream] = (us, gaps)
    assert shown(streaming.stream_stale_alarm(batches(rows, "stream string, us long, gaps long", 50), 30, 2)) == sorted(want, key=str)


def test_a_batch_taken_again_replaces_its_rows(spark, tmp_path):
    stream = spark.readStream.schema("stream string, id long, seq long").parquet(str(tmp_path))
    taken = {}

    class Writer:
        def foreachBatch(self, take):  # noqa: N802
            taken["take"] = take
            return self

        def option(self, *_):
            return self

    class Stream:
        sparkSession, schema, writeStream = spark, stream.schema, Writer()  # noqa: N815

    _, read = streaming.carry(Stream(), streaming._skips, "stream string, id long, seq long", str(tmp_path / "x"))
    parts = [[("a", 1, 1), ("a", 2, 5)], [("a", 3, 6), ("a", 4, 9)], [("a", 5, 2)]]
    for number in (0, 0, 1, 1, 2):
        taken["take"](spark.createDataFrame(parts[number], stream.schema), number)
    assert [(r.id, r.prev_seq) for r in read().orderBy("id").collect()] == [(2, 1), (4, 6), (5, 9)]


def test_empty_stream(batches):
    assert streaming.stream_gaps(batches([], "stream string, id long, seq long", 1)).collect() == []
