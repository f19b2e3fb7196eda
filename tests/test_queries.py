"""Every query against its SQL on the smallest tables."""

import duckdb
import pytest

from tidemark.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "labels")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def shown(x):
    if x is None or x != x:
        return "~"
    if isinstance(x, (float,)) or type(x).__name__ == "Decimal":
        return f"{float(x) + 0:.7g}"
    return f"{x:.7g}" if isinstance(x, int) and not isinstance(x, bool) and abs(x) < 10**6 else str(x)


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(shown(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, con, name):
    got, want = QUERIES[name](spark, DATA), con.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows([tuple(r) for r in got.collect()], got.columns) == rows(want.fetchall(), want.columns)


def test_blend_weights_leave_no_descent(spark):
    from tidemark.queries.forecast import _X, _panel

    weights = {r.member: r.weight for r in QUERIES["nnls_blend"](spark, DATA).collect()}
    g = QUERIES["nnls_gram"](spark, DATA).first()
    assert abs(sum(weights.values()) - 1) < 1e-6 and min(weights.values()) >= 0
    # weights are scaled to sum 1: at the scale that fits best, no weight has a falling gradient
    quad = sum(weights[a] * weights[b] * g[f"{min(a, b)}_{max(a, b)}"] for a in _X for b in _X)
    scale = sum(weights[a] * g[f"{a}_y"] for a in _X) / quad
    for a in _X:
        slope = scale * sum(weights[b] * g[f"{min(a, b)}_{max(a, b)}"] for b in _X) - g[f"{a}_y"]
        assert slope > -1e-4 * g[f"{a}_y"] and (weights[a] == 0 or abs(slope) < 1e-4 * g[f"{a}_y"])
    assert _panel(spark, DATA).count() > 0
