"""Ladders that seat every ticker."""

import pytest

from tidemark.queries import QUERIES
from tidemark.sources.adapters import view


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_every_ticker_takes_a_seat(spark, size):
    data = f"/root/testdata/{size}"
    legs = QUERIES["ladder_build"](spark, data).collect()
    tickers = {r.ticker for r in view(spark, data, "v_touch").select("ticker").distinct().collect()}
    assert {r.ticker for r in legs} == tickers and len(legs) == len(tickers)
    assert {r.seat for r in legs} == {0, 1, 2} and len({r.grp for r in legs}) == len(tickers) // 3
