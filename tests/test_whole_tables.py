"""Queries that take part with every row of their table."""

from tests.test_queries import DATA
from tidemark.queries import QUERIES
from tidemark.sources.adapters import view


def test_every_reading_is_a_point(spark):
    got = QUERIES["latest_forecast_asof"](spark, DATA)
    assert sorted(r.id for r in got.select("id").collect()) == sorted(r.id for r in view(spark, DATA, "v_obs").select("id").collect())
    assert got.filter("run_id is not null").count() > 0


def test_every_quote_with_a_state_before_is_compared(spark):
    first = {}
    rows = [(r.ticker, r.us) for r in view(spark, DATA, "v_touch").select("ticker", "us").collect()]
    for ticker, us in rows:
        first[ticker] = min(us, first.get(ticker, us))
    assert sum(r.n for r in QUERIES["depth_continuity"](spark, DATA).collect()) == sum(us > first[t] for t, us in rows)
