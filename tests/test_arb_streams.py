from tidemark.operators.depth import arb_streams, stream_episodes, stream_summary

SCHEMA = "grp long, us long, id long, " + ", ".join(f"{n}_{i} long" for n in ("bid", "size", "no", "no_size") for i in range(3))


def state(us, bids, nos, sizes=(2000, 2000, 2000), grp=1):
    return (grp, us, us, *bids, *sizes, *nos, *sizes)


def test_three_streams(spark):
    rows = [
        state(0, (3000, 3000, None), (6000, 6000, None)),  # the outer legs aren't known yet, nor all
        state(1, (6000, 3000, 5500), (3000, 6000, 4000)),  # bids 14,500; outer bids 11,500; asks 17,000
        state(2, (6000, 3000, 5000), (3000, 6000, 4000)),  # bids 14,000; outer bids 11,000
        state(3, (1000, 1000, 1000), (8000, 8000, 8000)),  # asks 6,000
        state(4, (1000, 1000, 1000), (8000, 8000, 8000), (0, 5, 5)),  # nothing rests at the first leg
    ]
    streams = arb_streams(spark.createDataFrame(rows, SCHEMA), 3)
    got = {(r.stream, r.start_us): r for r in stream_episodes(streams, 3, 2, 1000).collect()}
    assert set(got) == {("sum_sell", 1), ("monotonicity", 1), ("sum_buy", 3)}
    sell, tails, buy = got["sum_sell", 1], got["monotonicity", 1], got["sum_buy", 3]
    assert (sell.magnitude, sell.state_id, sell.end_us, sell.tradeable) == (4000, 2, 3, True)
    assert (tails.magnitude, tails.state_id, tails.end_us) == (1000, 2, 3)
    # 20 contracts: 7 % of 20 p (1 - p) in cents, rounded up for each leg
    assert (sell.fees, tails.fees, buy.fees) == (34 + 30 + 35, 34 + 35, 23 * 3)
    assert sell.excess == 40 - (34 + 30 + 35) / 20 - 3
    assert (buy.magnitude, buy.end_us, buy.tradeable) == (4000, 4, False)  # held for 1, below 2
    summary = {r.stream: r for r in stream_summary(streams, stream_episodes(streams, 3, 2, 1000)).collect()}
    assert {s: (r.incomplete, r.found, r.kept, r.censored, r.tradeable) for s, r in summary.items()} == {"sum_buy": (1, 1, 1, 0, 0), "sum_sell": (1, 1, 1, 0, 1), "monotonicity": (1, 1, 1, 0, 1)}


def test_open_and_absent_episodes(spark):
    streams = arb_streams(spark.createDataFrame([state(1, (6000, 3000, 3000), (1, 1, 1)), state(1, (6000, 3000, 3000), (1, 1, 1), grp=2)], SCHEMA), 3)
    episodes = stream_episodes(streams, 3, 0, 0)
    assert [(r.stream, r.end_us, r.tradeable) for r in episodes.collect()] == [("sum_sell", None, False)] * 2
    got = {r.stream: (r.found, r.kept, r.censored, r.p50) for r in stream_summary(streams, episodes).collect()}
    assert got == {"sum_buy": (0, 0, 0, None), "sum_sell": (2, 0, 2, None), "monotonicity": (0, 0, 0, None)}
    assert stream_episodes(streams.limit(0), 3, 0, 0).collect() == []
