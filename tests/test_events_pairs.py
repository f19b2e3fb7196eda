"""Event operators against every pair, on small tables with ties and nulls."""

import random

from tidemark.operators.events import arrival_delay, convergence_time, detect_locks, post_lock_flow

DAY = 86_400_000_000


def test_convergence(spark):
    rng = random.Random(8)
    quotes = [(f"t{rng.randrange(2)}", (i // 2) * 3, i, rng.choice([None, 10, 95, 95, 95])) for i in range(120)]
    locks = [(f"t{rng.randrange(3)}", rng.randrange(190)) for _ in range(30)] + [("t0", 9), ("t0", 9)]
    got = convergence_time(spark.createDataFrame(locks, "ticker string, lock_us long"), spark.createDataFrame(quotes, "ticker string, us long, id long, mid2 long"), 90, 6, 40)
    want = {}
    for ticker, lock in set(locks):
        own, runs = sorted((u, i, m is not None and m >= 90) for t, u, i, m in quotes if t == ticker), []
        for k, (us, _, on) in enumerate(own):
            if on and (k == 0 or not own[k - 1][2]):
                end = next((u for u, _, x in own[k:] if not x), None)
                runs.append((us, end))
        at = [max(a, lock) for a, b in runs if (b is None or max(a, lock) + 6 <= b) and max(a, lock) + 6 <= lock + 40]
        want[ticker, lock] = min(at) - lock if at else None
    rows = got.collect()
    assert len(rows) == len(want) and {(r.ticker, r.lock_us): r.converged_us for r in rows} == want
    assert any(v == 0 for v in want.values()) and any(v for v in want.values()) and None in want.values()


def test_locks_and_arrivals(spark):
    rng = random.Random(2)
    readings = [(i, f"s{rng.randrange(2)}", (i // 40) * DAY + rng.randrange(30), rng.randrange(60), rng.choice([None, *range(10)])) for i in range(160)]
    readings = [(i, s, v, v + d, t) for i, s, v, d, t in readings]
    strikes = [(s, d, k, f"{s}-{d}-{k}") for s in ("s0", "s1", "s9") for d in range(5) for k in (3, 7, 8, 30)]
    r = spark.createDataFrame(readings, "id long, station string, valid_us long, seen_us long, tenths long")
    k = spark.createDataFrame(strikes, "station string, day long, strike long, ticker string")
    locks = {x.ticker: (x.kind, x.t0_us, x.tenths, x.reading_id) for x in detect_locks(r, k, 1).collect()}
    delays = {(x.station, x.day, x.strike): (x.kind, x.delay_us) for x in arrival_delay(r, k).collect()}
    for s, d, strike, ticker in strikes:
        own = sorted((v, i, seen, t) for i, st, v, seen, t in readings if st == s and v // DAY == d and t is not None)
        clean, reached = ([x for x in own if x[3] >= strike + m] for m in (1, 0))
        want = ("none", None, None, None)
        if reached:
            want = ("ambiguous", None, None, None)
        if clean:
            want = ("clean", clean[0][2], clean[0][3], clean[0][1])
        assert locks[ticker] == want
        seen = min((x[2] for x in reached), default=None)
        assert delays[s, d, strike] == (("never", None) if not reached else ("delayed" if seen > reached[0][0] else "at_once", seen - reached[0][0]))


def test_flow_after_locks(spark):
    prints = [("a", 5, "yes", 10, 3000), ("a", 6, "no", 4, 3000), ("a", 9, "yes", 1, 100), ("a", 4, "yes", 7, 1), ("b", 9, "yes", 1, 1), ("a", 9, "", 3, 3), ("a", None, "no", 3, 3), (None, 9, "no", 3, 3), ("a", 9, None, 3, 3)]
    locks = [("a", 5), ("a", 8), ("a", 8), ("c", 1), ("a", None)]
    p = spark.createDataFrame(prints, "ticker string, us long, taker_side string, units long, yes_price long")
    k = spark.createDataFrame(locks, "ticker string, lock_us long")
    assert sorted(map(tuple, post_lock_flow(p, k).collect())) == [("no", 1, 4, 28_000), ("yes", 3, 3, 300)]
    assert post_lock_flow(p, k.limit(0)).collect() == []
