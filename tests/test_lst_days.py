"""Station-days of local standard time: an evening maximum west of Greenwich stays on its day, in summer as well."""

from datetime import UTC, datetime

from pyspark.sql import functions as F

from tidemark.operators import events

HOUR = 3_600_000_000


def us(*at):
    return int(datetime(*at, tzinfo=UTC).timestamp()) * 1_000_000


def day(*at):
    return us(*at) // (24 * HOUR)


def readings(spark, rows):
    df = spark.createDataFrame([(i, s, t, t + 60_000_000, x) for i, (s, t, x) in enumerate(rows)], "id long, station string, valid_us long, seen_us long, tenths long")
    return events.lst_days(df, spark.createDataFrame([("NY", "America/New_York"), ("LA", "America/Los_Angeles"), ("GR", "Europe/London")], "station string, tz string"))


#: 22:30 by the clock of New York in July is 21:30 of its standard time and 02:30 of the next day in UTC.
ROWS = [("NY", us(2024, 7, 4, 16), 800), ("NY", us(2024, 7, 5, 2, 30), 990), ("NY", us(2024, 7, 5, 4, 30), 700), ("NY", us(2024, 7, 5, 5, 30), 650), ("LA", us(2024, 1, 10, 7, 59), 500), ("GR", us(2024, 7, 4, 23, 30), 600), ("XX", us(2024, 7, 4, 12), 1)]


def test_days_of_readings(spark):
    got = {(r.station, r.valid_us): r.day for r in readings(spark, ROWS).collect()}
    assert got == {
        ("NY", us(2024, 7, 4, 16)): day(2024, 7, 4), ("NY", us(2024, 7, 5, 2, 30)): day(2024, 7, 4), ("NY", us(2024, 7, 5, 4, 30)): day(2024, 7, 4), ("NY", us(2024, 7, 5, 5, 30)): day(2024, 7, 5),
        ("LA", us(2024, 1, 10, 7, 59)): day(2024, 1, 9), ("GR", us(2024, 7, 4, 23, 30)): day(2024, 7, 4),
    }
    windows = events.lst_day_window(spark.createDataFrame([("America/New_York", day(2024, 7, 4))], "tz string, day int")).first()
    assert windows.start_us == us(2024, 7, 4, 5) and windows.end_us == us(2024, 7, 5, 5)


def test_an_evening_maximum_counts_for_its_day(spark):
    rows, d = readings(spark, ROWS), day(2024, 7, 4)
    strikes = spark.createDataFrame([("NY", d, 900, "T900"), ("NY", d + 1, 660, "T660"), ("NY", d, 950, "T950")], "station string, day long, strike long, ticker string")
    locks = {(r.day, r.strike): (r.kind, r.t0_us) for r in events.detect_locks(rows, strikes, 10).collect()}
    assert locks[d, 900] == ("clean", us(2024, 7, 5, 2, 31)) and locks[d + 1, 660] == ("none", None)
    official = spark.createDataFrame([("NY", d, 95), ("NY", d + 1, 60)], "station string, day long, official long")
    compared = {r.day: r.high for r in events.basis_compare(rows, official, 1).collect()}
    assert compared == {d: 990, d + 1: 650}
    closes = spark.createDataFrame([("NY", d, us(2024, 7, 5, 5))], "station string, day long, close_us long")
    entry = {r.day: (r.how, r.ticker, r.minutes_to_close) for r in events.straddle_entry(rows, official, strikes, closes).collect()}
    assert entry == {d: ("crossing", "T950", 150), d + 1: ("open", None, None)}
    side = {(r.station, r.day): (r.n, r.minutes, r.missing) for r in events.observation_sidecar(rows, official).collect()}
    assert side["NY", d] == (3, 3, False) and side["GR", d] == (1, 1, True)


def test_low_ladders_and_strict_strikes(spark):
    rows, d = readings(spark, ROWS), day(2024, 7, 4)
    strikes = spark.createDataFrame([("NY", d, x, f"T{x}") for x in (699, 700, 701, 710, 800)], "station string, day long, strike long, ticker string")
    kinds = lambda **k: {r.strike: r.kind for r in events.detect_locks(rows, strikes, 10, low=True, **k).collect()}
    assert kinds() == {699: "none", 700: "ambiguous", 701: "ambiguous", 710: "clean", 800: "clean"}
    assert kinds(strict=True) == {699: "none", 700: "none", 701: "ambiguous", 710: "ambiguous", 800: "clean"}
    high = spark.createDataFrame([("NY", d, x, f"T{x}") for x in (980, 989, 990, 991)], "station string, day long, strike long, ticker string")
    assert {r.strike: r.kind for r in events.detect_locks(rows, high, 0, strict=True).collect()} == {980: "clean", 989: "clean", 990: "none", 991: "none"}
    lows = events.detect_locks(rows, strikes, 10, low=True).filter("strike = 800").first()
    assert lows.tenths == 700 and lows.t0_us == us(2024, 7, 5, 4, 31)


def test_histogram_of_entries(spark):
    entries = spark.createDataFrame([("open", 61, "a"), ("open", 119, None), ("crossing", 0, "b"), ("open", None, None)], "how string, minutes_to_close long, ticker string")
    got = {(r.how, r.from_minute): (r.entries, r.settling) for r in events.straddle_histogram(entries).collect()}
    assert got == {("open", 60): (2, 1), ("crossing", 0): (1, 1), ("open", None): (1, 0)}
    assert events.straddle_histogram(entries.filter(F.lit(False))).count() == 0
