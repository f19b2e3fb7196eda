"""Views that present the given tables as tapes, quotes, prints, observations and forecasts.

One SQL text serves Spark and the checking engine: {div} is the integer division of either, {us} turns ts into
microseconds, and a name in braces is a table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

DIALECTS = {
    "spark": {"div": "div", "us": "unix_micros(CAST(ts AS TIMESTAMP))", "us_ship": "unix_micros(CAST(l_shipdate AS TIMESTAMP))", "us_order": "unix_micros(CAST(o_orderdate AS TIMESTAMP))"},
    "duckdb": {"div": "//", "us": "epoch_us(ts)", "us_ship": "epoch_us(l_shipdate)", "us_order": "epoch_us(o_orderdate)"},
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "labels")

#: In order: a view may read those before it. Every row of a table, or of an event type, enters the views made of it: sequence
#: numbers break because they skip, not because rows are left out.
VIEWS = {
    "ev": "SELECT event_id, {us} AS us, user_id, event_type, CAST(round(value * 100) AS BIGINT) AS c, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM {events}",
    "v_tape": """SELECT event_id AS id, concat('M', user_id) AS ticker, us, (event_id + event_id {div} 97) % 500 AS seq, CASE WHEN event_type IN ('view', 'signup') THEN 'yes' ELSE 'no' END AS side, 100 * (1 + k % 50) AS price,
        CASE WHEN event_type <> 'signup' AND k % 3 = 0 THEN -c ELSE c END AS size, event_type = 'signup' AS is_snapshot, CASE WHEN event_type <> 'signup' THEN us {div} 1000 - (k % 7) * 60000 END AS ts_ms FROM ev""",
    "v_touch": """SELECT event_id AS id, concat('M', user_id) AS ticker, us, CASE WHEN event_id % 11 = 0 THEN 0 ELSE 100 * (1 + k % 60) END AS yes_bid, CASE WHEN event_id % 11 = 0 THEN 0 ELSE c END AS yes_size,
        100 * (1 + c % 39) AS no_bid, c + k AS no_size FROM ev""",
    "v_mid": "SELECT id, ticker, us, yes_bid, no_bid, yes_size, no_size, CASE WHEN yes_bid > 0 AND no_bid > 0 THEN yes_bid + 10000 - no_bid END AS mid2 FROM v_touch",
    "v_prints": """SELECT event_id AS id, concat('M', user_id) AS ticker, us, CASE WHEN event_id % 10 < 4 THEN event_id - event_id % 4 ELSE event_id END AS trade_id,
        CASE WHEN k % 10 = 0 THEN '' WHEN k % 2 = 0 THEN 'yes' ELSE 'no' END AS taker_side, c AS units, 100 * (1 + k % 98) AS yes_price FROM ev WHERE event_type IN ('purchase', 'click')""",
    "v_coarse": "SELECT id, ticker, us, yes_bid {div} 1000 * 1000 AS yes_bid, no_bid {div} 1000 * 1000 AS no_bid, yes_size, no_size FROM v_touch",
    "v_takes": "SELECT id, ticker, us, taker_side, units, yes_price {div} 1000 * 1000 AS yes_price FROM v_prints",
    "v_gaps": "SELECT event_id AS id, CASE WHEN k % 50 = 0 THEN '' ELSE concat('M', user_id) END AS ticker, us AS detected_us, CASE WHEN k % 3 = 0 THEN 'sequence' ELSE 'reconnect' END AS reason FROM ev WHERE event_type = 'error'",
    "v_excl": "SELECT event_id AS id, CASE k % 3 WHEN 0 THEN 'recorded_gap' WHEN 1 THEN 'subscription_wide' ELSE 'resubscribe_blind' END AS class, us AS start_us, us + (1 + k % 20) * 6000000 AS end_us FROM ev WHERE event_type = 'error'",
    "v_quiet": "SELECT DISTINCT day * 86400000000 + 25200000000 AS start_us, day * 86400000000 + 32400000000 AS end_us FROM (SELECT us {div} 86400000000 AS day FROM ev) d WHERE day % 7 = 3",
    "v_obs": "SELECT event_id AS id, concat('S', user_id % 20) AS station, us AS valid_us, us + (k % 9) * 60000000 AS seen_us, 400 + c % 600 AS tenths FROM ev",
    "v_lst": "SELECT *, (valid_us - (5 + CAST(substr(station, 2) AS BIGINT) % 4) * 3600000000) {div} 86400000000 AS day FROM v_obs",
    "v_days": "SELECT station, day, max(tenths) {div} 10 + day % 3 - 1 AS official FROM v_lst GROUP BY station, day",
    "v_strikes": "SELECT station, day, 300 + 50 * n AS strike, concat('KX', station, '-', day, '-T', 300 + 50 * n) AS ticker FROM v_days CROSS JOIN (SELECT 1 AS n UNION ALL SELECT 6 UNION ALL SELECT 12 UNION ALL SELECT 13) x",
    "v_decisions": """SELECT l_orderkey * 10 + l_linenumber AS leg_id, concat('S', l_suppkey % 20) AS series, l_orderkey AS event, CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(round(l_discount * 100) AS BIGINT) * 950 + l_partkey % 500 END AS fair,
        100 * (1 + l_suppkey % 90) AS yes_bid, 100 * (1 + l_suppkey % 90) + 100 * (1 + l_partkey % 6) AS yes_ask, CAST(l_quantity AS BIGINT) - 5 AS depth, 500 + l_orderkey * 7 % 4000 AS spread, 2000 AS spread_median,
        CAST(round(l_tax * 100) AS BIGINT) AS age_hours, l_partkey % 200 AS minutes_to_close, l_linenumber = 6 AS same_day, l_suppkey % 37 = 0 AS blacklisted, CASE WHEN l_linenumber = 5 THEN NULL ELSE l_partkey % 8 END AS divergence,
        CASE l_linestatus WHEN 'O' THEN 'active' ELSE 'closed' END AS status, l_suppkey % 50 <> 0 AS armed, CAST(round(l_extendedprice) AS BIGINT) AS exposure, 2000 + l_orderkey % 30000 AS event_budget, 1000 + l_partkey % 20000 AS market_budget FROM {lineitem}""",
    "v_scored": "SELECT l_orderkey, l_linenumber, l_discount * 10 AS p, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS o, l_linestatus AS grp, l_quantity AS lead, l_extendedprice AS net, CAST(l_shipdate AS DATE) AS ship FROM {lineitem}",
}


def with_views(names: list[str], dialect: str) -> str:
    """A WITH clause that defines the views and all that they read."""
    need = set(names)
    for name in reversed(VIEWS):
        if name in need:
            need |= {v for v in VIEWS if re.search(rf"\b{v}\b", VIEWS[name]) and v != name}
    marks = DIALECTS[dialect] | ({} if dialect == "spark" else {t: t for t in TABLES})
    texts = {n: re.sub(r"\{(\w+)\}", lambda m: marks.get(m[1], m[0]), VIEWS[n]) for n in VIEWS if n in need}
    return "WITH " + ", ".join(f"{n} AS ({t})" for n, t in texts.items())


def sql(query: str) -> str:
    """A checking query, with the views that it reads defined before it and {div} as the checking engine has it."""
    query = re.sub(r"\{(\w+)\}", lambda m: DIALECTS["duckdb"].get(m[1], m[0]), query)
    names = [v for v in VIEWS if re.search(rf"\b{v}\b", query)]
    if not names:
        return query
    head = with_views(names, "duckdb")
    own = query.strip()
    if own.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head[5:]}, {own[15:]}"
    return f"{head}, {own[5:]}" if own.upper().startswith("WITH ") else f"{head} {own}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = with_views([name], "spark")
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(f"{text} SELECT * FROM {name}", **used)


def stream_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the events as a stream of files; views that aggregate or window are not for streams."""
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")  # a pattern, as streams read no single file
    return spark.sql(f"{with_views([name], 'spark')} SELECT * FROM {name}", events=events)
