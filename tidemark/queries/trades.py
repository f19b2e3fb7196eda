from pyspark.sql import functions as F

from tidemark.operators import tape
from tidemark.operators import trades as op
from tidemark.queries import query
from tidemark.sources.adapters import table, view

HOUR = 3_600_000_000
HORIZONS = [6 * HOUR, 24 * HOUR, 72 * HOUR]

_FIRST = "f AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY trade_id ORDER BY id) AS rn FROM v_prints WHERE taker_side <> '') WHERE rn = 1)"
_MERGED = """e AS (SELECT start_us, end_us, max(end_us) OVER (ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM v_excl),
  i AS (SELECT *, sum(CASE WHEN upto IS NULL OR start_us > upto THEN 1 ELSE 0 END) OVER (ORDER BY start_us, end_us) AS run FROM e), merged AS (SELECT min(start_us) AS start_us, max(end_us) AS end_us FROM i GROUP BY run)"""
_ANCHORS = f"""{_FIRST}, bk AS (SELECT ticker, id, us, max(ts_ms) OVER w AS stamp, sum(is_snapshot::INT) OVER w AS snaps FROM v_tape WINDOW w AS (PARTITION BY ticker ORDER BY id ROWS UNBOUNDED PRECEDING)),
  x AS (SELECT f.*, (SELECT arg_min((b.id, b.us, b.snaps), (b.stamp, b.id)) FROM bk b WHERE b.ticker = f.ticker AND b.stamp > f.us {{div}} 1000) AS st, (SELECT arg_min((b.id, b.us), (b.us, b.id)) FROM bk b WHERE b.ticker = f.ticker AND b.us > f.us) AS ar,
    coalesce((SELECT arg_max(b.snaps, (b.us, b.id)) FROM bk b WHERE b.ticker = f.ticker AND b.us <= f.us), 0) AS seen FROM f),
  y AS (SELECT *, coalesce(st[3] > seen, true) AS crossed FROM x),
  a AS (SELECT id, ticker, us, trade_id, taker_side, units, yes_price, CASE WHEN crossed THEN ar[1] ELSE st[1] END AS anchor_id, CASE WHEN crossed THEN ar[2] ELSE st[2] END AS anchor_us,
    CASE WHEN (CASE WHEN crossed THEN ar[1] ELSE st[1] END) IS NOT NULL THEN crossed END AS host_clock FROM y)"""
_HORIZONS = f"""{_ANCHORS}, h AS (SELECT a.*, x.h AS horizon_us, anchor_us + x.h AS end_us FROM a, (SELECT unnest([{", ".join(map(str, HORIZONS))}]) AS h) x),
  q AS (SELECT h.*, (SELECT arg_max((m.mid2, 1), (m.us, m.id)) FROM v_mid m WHERE m.ticker = h.ticker AND m.us <= h.anchor_us)[1] AS mid2_start, (SELECT arg_max((m.mid2, 1), (m.us, m.id)) FROM v_mid m WHERE m.ticker = h.ticker AND m.us <= h.end_us)[1] AS mid2_end,
    (SELECT max(m.us) FROM v_mid m WHERE m.ticker = h.ticker) AS last_us FROM h),
  w AS (SELECT * EXCLUDE last_us, CASE WHEN anchor_us IS NULL THEN 'unresolved' WHEN end_us > last_us THEN 'uncovered' WHEN mid2_start IS NULL OR mid2_end IS NULL THEN 'one_sided' ELSE 'ok' END AS status FROM q),
  n AS (SELECT *, (7 * units * p * (10000 - p) + 9999999999) {{div}} 10000000000 AS fee FROM (SELECT *, CASE taker_side WHEN 'yes' THEN yes_price ELSE 10000 - yes_price END AS p FROM w WHERE status = 'ok')),
  net AS (SELECT *, units * (mid2_end - mid2_start) * CASE taker_side WHEN 'yes' THEN 1 ELSE -1 END - 40000 * fee AS net FROM n)"""


def _prints(spark, sf_dir):
    return op.first_prints(view(spark, sf_dir, "v_prints"))


def _windows(spark, sf_dir):
    anchored = op.resolve_anchors(_prints(spark, sf_dir), view(spark, sf_dir, "v_tape"))
    return op.horizon_windows(anchored, view(spark, sf_dir, "v_mid"), "anchor_us", HORIZONS)


@query("print_hygiene", """SELECT count(*) AS n_rows, count(*) FILTER (taker_side = '') AS empty_side, count(DISTINCT CASE WHEN taker_side <> '' THEN trade_id END) AS kept,
  count(*) - count(*) FILTER (taker_side = '') - count(DISTINCT CASE WHEN taker_side <> '' THEN trade_id END) AS duplicates FROM v_prints""")
def print_hygiene(spark, sf_dir):
    return op.print_hygiene(view(spark, sf_dir, "v_prints"))


@query("first_prints", f"WITH {_FIRST} SELECT * FROM f")
def first_prints(spark, sf_dir):
    return _prints(spark, sf_dir)


@query("count_trades", f"""WITH {_MERGED} SELECT taker_side, count(*) AS n_rows, count(DISTINCT trade_id) AS trades, count(*) - count(DISTINCT trade_id) AS surplus
  FROM v_prints p WHERE NOT EXISTS (SELECT 1 FROM merged WHERE us >= start_us AND us < end_us) GROUP BY taker_side""")
def count_trades(spark, sf_dir):
    return op.count_trades(view(spark, sf_dir, "v_prints"), view(spark, sf_dir, "v_excl"))


@query("resolve_anchors", f"WITH {_ANCHORS} SELECT * FROM a")
def resolve_anchors(spark, sf_dir):
    return op.resolve_anchors(_prints(spark, sf_dir), view(spark, sf_dir, "v_tape"))


@query("horizon_windows", f"WITH {_HORIZONS} SELECT id, horizon_us, end_us, CASE WHEN status <> 'unresolved' THEN mid2_start END AS mid2_start, CASE WHEN status <> 'unresolved' THEN mid2_end END AS mid2_end, status FROM w")
def horizon_windows(spark, sf_dir):
    return _windows(spark, sf_dir).select("id", "horizon_us", "end_us", "mid2_start", "mid2_end", "status")


@query("print_net_cents", f"WITH {_HORIZONS} SELECT id, horizon_us, fee, net FROM net")
def print_net_cents(spark, sf_dir):
    return op.print_net_cents(_windows(spark, sf_dir)).select("id", "horizon_us", "fee", "net")


@query("flow_clusters", f"WITH {_HORIZONS} SELECT ticker, horizon_us, sum(net)::BIGINT AS total, sum(units)::BIGINT AS weight FROM net GROUP BY ticker, horizon_us HAVING sum(units) > 0")
def flow_clusters(spark, sf_dir):
    return op.flow_clusters(op.print_net_cents(_windows(spark, sf_dir)))


@query("flow_means", f"""WITH {_HORIZONS}, dy AS (SELECT DISTINCT us {{div}} 86400000000 AS day FROM v_tape), sp AS (SELECT day, CASE WHEN (row_number() OVER (ORDER BY day) - 1) * 3 < count(*) OVER () * 2 THEN 'discovery' ELSE 'holdout' END AS split FROM dy),
  mn AS (SELECT split, horizon_us, count(*) AS prints, sum(units)::BIGINT AS weight, sum(net)::BIGINT AS total FROM net JOIN sp ON us {{div}} 86400000000 = day GROUP BY ALL HAVING sum(units) > 0)
  SELECT *, round(total::DOUBLE / (200 * weight), 9) AS mean_cents FROM mn""")
def flow_means(spark, sf_dir):
    splits = tape.freeze_split(view(spark, sf_dir, "v_tape").select(F.floor(F.col("us") / tape.DAY_US).alias("day"))).select("day", "split")
    return op.flow_means(op.print_net_cents(_windows(spark, sf_dir)), splits)


@query("ts_violations", "WITH d AS (SELECT ticker, ts_ms < lag(ts_ms) OVER (PARTITION BY ticker ORDER BY id) AS back FROM v_tape WHERE NOT is_snapshot) SELECT ticker, count(*) FILTER (back) AS violations, count(*) AS deltas FROM d GROUP BY ticker")
def ts_violations(spark, sf_dir):
    return op.ts_violations(view(spark, sf_dir, "v_tape"))


_LOCKS = "SELECT ticker, min(us) + 86400000000 AS lock_us FROM v_touch WHERE yes_bid > 5500 GROUP BY ticker"


def _near_locks(spark, sf_dir):
    return view(spark, sf_dir, "v_touch").filter("yes_bid > 5500").groupBy("ticker").agg((F.min("us") + 24 * HOUR).alias("lock_us"))


def _universe(spark, sf_dir):
    """The tickers that were bid 39 cents for no at some time."""
    return view(spark, sf_dir, "v_touch").filter("no_bid >= 3900").select("ticker").distinct()


_NEAR = f"nl AS ({_LOCKS}), ns AS (SELECT p.*, lock_us, CASE WHEN lock_us IS NULL THEN 'no_lock' WHEN abs(us - lock_us) <= 86400000000 THEN 'inside' ELSE 'outside_lock' END AS stratum, ticker IN (SELECT ticker FROM v_touch WHERE no_bid >= 3900) AS known FROM v_prints p LEFT JOIN nl USING (ticker))"


@query("near_lock_stratum", f"WITH {_NEAR} SELECT id, lock_us, stratum FROM ns")
def near_lock_stratum(spark, sf_dir):
    return op.near_events(view(spark, sf_dir, "v_prints"), _near_locks(spark, sf_dir), 24 * HOUR).select("id", "lock_us", "stratum")


@query("near_lock_counts", f"WITH {_NEAR} SELECT CASE WHEN known THEN stratum ELSE 'off_universe' END AS stratum, count(*) AS prints, count(DISTINCT ticker) AS tickers FROM ns GROUP BY 1")
def near_lock_counts(spark, sf_dir):
    return op.near_counts(op.near_events(view(spark, sf_dir, "v_prints"), _near_locks(spark, sf_dir), 24 * HOUR), _universe(spark, sf_dir))


@query("near_lock_flow", f"WITH {_HORIZONS}, {_NEAR} SELECT net.ticker, horizon_us, sum(net)::BIGINT AS total, sum(net.units)::BIGINT AS weight FROM net JOIN ns ON ns.id = net.id WHERE stratum = 'inside' AND known GROUP BY net.ticker, horizon_us HAVING sum(net.units) > 0")
def near_lock_flow(spark, sf_dir):
    return op.near_flow(_prints(spark, sf_dir), _near_locks(spark, sf_dir), _universe(spark, sf_dir), 24 * HOUR, view(spark, sf_dir, "v_tape"), view(spark, sf_dir, "v_mid"), HORIZONS)


_GRID = "g AS (SELECT ticker, close_us, s.s::INT AS slot, ((close_us - 86400000000 + 899999999) {div} 900000000 + s.s) * 900000000 AS at_us FROM (SELECT ticker, max(us) AS close_us FROM v_touch GROUP BY ticker), (SELECT unnest(range(0, 48)) AS s) s)"


def _closes(spark, sf_dir):
    return view(spark, sf_dir, "v_touch").groupBy("ticker").agg(F.max("us").alias("close_us"))


@query("placement_grid", f"WITH {_GRID} SELECT * FROM g")
def placement_grid(spark, sf_dir):
    return op.placement_grid(_closes(spark, sf_dir))


_QUEUE = """o AS (SELECT event_id AS order_id, concat('M', user_id) AS ticker, us + 60000000 AS at_us FROM ev WHERE event_type = 'view'),
  r AS (SELECT o.*, (SELECT arg_max((t.yes_bid, t.yes_size, t.no_bid, t.no_size), (t.us, t.id)) FROM v_coarse t WHERE t.ticker = o.ticker AND t.us <= o.at_us) AS s FROM o),
  q0 AS (SELECT order_id, ticker, at_us, unnest([('yes', s[1], s[2]), ('no', s[3], s[4])]) AS x FROM r WHERE s[1] > 0 AND s[2] > 0 AND s[3] > 0 AND s[4] > 0),
  q1 AS (SELECT order_id, ticker, at_us, x[1] AS side, x[2] AS price, x[3] AS queue FROM q0),
  c AS (SELECT *, lag(yes_bid) OVER w AS was_yes, lag(no_bid) OVER w AS was_no FROM v_coarse WINDOW w AS (PARTITION BY ticker ORDER BY us, id)),
  q AS (SELECT q1.*, least(at_us + 864000000000, coalesce((SELECT min(us) FROM c WHERE c.ticker = q1.ticker AND c.us > q1.at_us AND CASE WHEN side = 'yes' THEN was_yes IS NULL OR was_yes <> yes_bid ELSE was_no IS NULL OR was_no <> no_bid END), at_us + 864000000000)) AS end_us FROM q1),
  m AS (SELECT q.order_id, q.side, p.us, sum(units) OVER (PARTITION BY q.order_id, q.side ORDER BY p.us, p.id) AS upto, queue FROM q JOIN v_takes p ON p.ticker = q.ticker AND p.us >= at_us AND p.us <= end_us AND ((side = 'yes' AND taker_side = 'no' AND yes_price = price) OR (side = 'no' AND taker_side = 'yes' AND 10000 - yes_price = price))),
  fl AS (SELECT q.*, (SELECT min(us) FROM m WHERE m.order_id = q.order_id AND m.side = q.side AND upto > m.queue) AS fill_us FROM q)"""


def _queue(spark, sf_dir):
    orders = view(spark, sf_dir, "ev").filter("event_type = 'view'").select(F.col("event_id").alias("order_id"), F.concat(F.lit("M"), "user_id").alias("ticker"), (F.col("us") + 60_000_000).alias("at_us"))
    return op.queue_clear(orders, view(spark, sf_dir, "v_coarse"), view(spark, sf_dir, "v_takes"), 240 * HOUR)


@query("queue_clear", f"WITH {_QUEUE} SELECT * FROM fl")
def queue_clear(spark, sf_dir):
    return _queue(spark, sf_dir)


@query("maker_edge", f"""WITH {_QUEUE}, h AS (SELECT fl.*, x.h AS horizon_us, fill_us + x.h AS b FROM fl, (SELECT unnest([{", ".join(map(str, HORIZONS))}]) AS h) x WHERE fill_us IS NOT NULL),
  v AS (SELECT h.*, (SELECT arg_max((m.mid2, 1), (m.us, m.id)) FROM v_mid m WHERE m.ticker = h.ticker AND m.us <= h.fill_us)[1] AS m0, (SELECT arg_max((m.mid2, 1), (m.us, m.id)) FROM v_mid m WHERE m.ticker = h.ticker AND m.us <= h.b)[1] AS m1, (SELECT max(m.us) FROM v_mid m WHERE m.ticker = h.ticker) AS last_us FROM h),
  k AS (SELECT *, CASE WHEN side = 'yes' THEN 1 ELSE -1 END AS sg, b <= last_us AND m0 IS NOT NULL AND m1 IS NOT NULL AS ok, (17500 * price * (10000 - price) + 999999999999) {{div}} 1000000000000 AS fee, (700 * price * (10000 - price) + 9999999999) {{div}} 10000000000 AS taker FROM v)
  SELECT side, horizon_us, count(*) AS fills, count(*) FILTER (NOT ok) AS no_mid, sum(CASE WHEN ok THEN sg * (m1 - m0) END)::BIGINT AS move2, sum(fee)::BIGINT AS fees,
    round(0.5 + sum(CASE WHEN ok THEN sg * (m1 - m0) END) / (200 * count(*) FILTER (ok)) - sum(fee) FILTER (ok) / count(*) FILTER (ok), 9) AS edge, round(0.5 + sum(CASE WHEN ok THEN sg * (m1 - m0) END) / (200 * count(*) FILTER (ok)) - sum(taker) FILTER (ok) / count(*) FILTER (ok), 9) AS edge_taker FROM k GROUP BY side, horizon_us""")
def maker_edge(spark, sf_dir):
    return op.maker_edge(_queue(spark, sf_dir), view(spark, sf_dir, "v_mid"), HORIZONS)


@query("exposure_rollup", """SELECT n_name, c_mktsegment, sum(CAST(round(o_totalprice * 100) AS BIGINT))::BIGINT AS max_loss, count(*) AS trades FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'F') GROUP BY ROLLUP (n_name, c_mktsegment)""")
def exposure_rollup(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    trades = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("o_orderkey").alias("key"), "n_name", "c_mktsegment", F.round(F.col("o_totalprice") * 100).cast("long").alias("loss"))
    return op.exposure_rollup(trades, t("lineitem").filter("l_linestatus = 'F'").select(F.col("l_orderkey").alias("key")), "key", ["n_name", "c_mktsegment"], "loss")


_FILLS = "SELECT l_orderkey AS order_id, CAST(l_quantity AS BIGINT) AS quantity, CAST(round(l_extendedprice * l_tax * 100) AS BIGINT) AS fee, CAST(round(l_extendedprice * 100) AS BIGINT) AS price, l_linenumber AS line FROM {lineitem} WHERE l_returnflag <> 'N'"
_ORDERS = "SELECT o_orderkey AS order_id, 20 + o_orderkey % 100 AS requested, o_orderstatus AS status FROM {orders}"


def _plain(text):
    return text.replace("{lineitem}", "lineitem").replace("{orders}", "orders")


@query("fill_reconcile", f"""WITH f AS ({_plain(_FILLS)}), o AS ({_plain(_ORDERS)}), g AS (SELECT order_id, sum(quantity)::BIGINT AS filled, sum(fee)::BIGINT AS fees, arg_max(price, (line, price)) AS last_price FROM f GROUP BY order_id)
  SELECT order_id, requested, coalesce(filled, 0) AS filled, fees, last_price, CASE WHEN coalesce(filled, 0) >= requested THEN 'filled' WHEN coalesce(filled, 0) > 0 THEN 'partial' ELSE status END AS state FROM o LEFT JOIN g USING (order_id)""")
def fill_reconcile(spark, sf_dir):
    fills = spark.sql(_FILLS, lineitem=table(spark, sf_dir, "lineitem"))
    return op.fill_reconcile(spark.sql(_ORDERS, orders=table(spark, sf_dir, "orders")), fills)


@query("orphan_positions", "SELECT c_custkey, c_acctbal FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'P')")
def orphan_positions(spark, sf_dir):
    """Only urgent orders that are partly filled count as trades, so that some positions have none."""
    trades = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT' and o_orderstatus = 'P'")
    return op.orphan_positions(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), trades.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("position_parity", """WITH h AS (SELECT concat('M', user_id) AS ticker, sum(c)::BIGINT AS held FROM ev WHERE event_type = 'purchase' GROUP BY 1), t AS (SELECT ticker, sum(units)::BIGINT AS traded FROM v_prints WHERE taker_side = 'yes' GROUP BY 1)
  SELECT ticker, coalesce(held, 0) AS held, coalesce(traded, 0) AS traded, coalesce(held, 0) - coalesce(traded, 0) AS difference FROM h FULL JOIN t USING (ticker) WHERE coalesce(held, 0) <> coalesce(traded, 0)""")
def position_parity(spark, sf_dir):
    held = view(spark, sf_dir, "ev").filter("event_type = 'purchase'").select(F.concat(F.lit("M"), "user_id").alias("ticker"), F.col("c").alias("units"))
    return op.position_parity(held, view(spark, sf_dir, "v_prints").filter("taker_side = 'yes'").select("ticker", "units"), "ticker")


@query("portfolio_attribution", """WITH p AS (SELECT event_id AS id, concat('M', user_id) AS ticker, us AS snapshot_us, c AS realised FROM ev WHERE event_type = 'purchase'), o AS (SELECT event_id AS order_id, concat('M', user_id) AS ticker, us AS placed_us FROM ev WHERE event_type = 'click' AND k % 3 > 0),
  x AS (SELECT p.*, (SELECT arg_max((order_id, placed_us), (placed_us, order_id)) FROM o WHERE o.ticker = p.ticker AND placed_us <= snapshot_us) AS m FROM p) SELECT id, ticker, snapshot_us, realised, m[1] AS order_id, m[2] AS placed_us FROM x""")
def portfolio_attribution(spark, sf_dir):
    ev = view(spark, sf_dir, "ev").withColumn("ticker", F.concat(F.lit("M"), "user_id"))
    snapshots = ev.filter("event_type = 'purchase'").select(F.col("event_id").alias("id"), "ticker", F.col("us").alias("snapshot_us"), F.col("c").alias("realised"))
    orders = ev.filter("event_type = 'click'").select("ticker", F.col("event_id").alias("order_id"), F.col("us").alias("placed_us"), F.when(F.col("k") % 3 > 0, "executed").otherwise("rejected").alias("status"))
    return op.attributed(snapshots, orders)


@query("portfolio_aggregate", """SELECT l_linestatus, sum(CASE WHEN l_returnflag = 'N' THEN CAST(l_quantity AS BIGINT) ELSE 0 END)::BIGINT AS exposure, sum(CAST(round(l_extendedprice * 100) AS BIGINT))::BIGINT AS realised, sum(CAST(round(l_tax * 100) AS BIGINT))::BIGINT AS fees,
  count(*) FILTER (l_returnflag = 'N' AND CAST(l_quantity AS BIGINT) <> 0) AS open_positions FROM lineitem GROUP BY l_linestatus""")
def portfolio_aggregate(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_linestatus", F.when(F.col("l_returnflag") == "N", F.col("l_quantity").cast("long")).otherwise(F.lit(0).cast("long")).alias("exposure"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("realised"), F.round(F.col("l_tax") * 100).cast("long").alias("fees"))
    return op.portfolio_aggregate(rows, ["l_linestatus"])


_FILLED = """WITH o AS (SELECT event_id AS order_id, concat('M', user_id) AS ticker, us AS as_of, us + 172800000000 AS close_us, 100 * (1 + k % 98) AS limit_price, c AS wanted FROM ev WHERE event_type = 'view'),
  m AS (SELECT order_id, sum(CASE WHEN yes_price < limit_price THEN units ELSE 0 END)::BIGINT AS better, sum(units)::BIGINT AS at_least FROM o JOIN v_prints p ON p.ticker = o.ticker AND us > as_of AND us <= close_us AND yes_price <= limit_price GROUP BY order_id),
  fi AS (SELECT order_id, least(coalesce(better, 0), wanted) AS filled_strict, least(coalesce(at_least, 0), wanted) AS filled_inclusive FROM o LEFT JOIN m USING (order_id))"""


@query("fills_vs_prints", f"{_FILLED} SELECT * FROM fi")
def fills_vs_prints(spark, sf_dir):
    orders = view(spark, sf_dir, "ev").filter("event_type = 'view'").select(F.col("event_id").alias("order_id"), F.concat(F.lit("M"), "user_id").alias("ticker"), F.col("us").alias("as_of"), (F.col("us") + 48 * HOUR).alias("close_us"), (100 * (1 + F.col("k") % 98)).alias("limit_price"), F.col("c").alias("units_wanted"))
    return op.fills_vs_prints(orders, view(spark, sf_dir, "v_prints"))


@query("execution_bound", f"""{_FILLED}, rt AS (SELECT count(*) AS orders, count(*) FILTER (filled_strict = 0) AS zero_strict, count(*) FILTER (filled_inclusive = 0) AS zero_inclusive FROM fi)
  SELECT *, round(zero_strict / orders, 9) AS rate_strict, round(zero_inclusive / orders, 9) AS rate_inclusive, zero_strict / orders > 0.6 AS bound_strict, zero_inclusive / orders > 0.6 AS bound_inclusive FROM rt""")
def execution_bound(spark, sf_dir):
    return op.execution_bound(fills_vs_prints(spark, sf_dir))


@query("tick_decision", """WITH d AS (SELECT event_id AS decision_id, concat('M', user_id) AS ticker, us AS as_of FROM ev WHERE event_type = 'view'),
  l AS (SELECT d.*, (SELECT arg_max((yes_price, us), (us, id)) FROM v_prints p WHERE p.ticker = d.ticker AND p.us <= as_of AND as_of - p.us <= 43200000000) AS x FROM d),
  m AS (SELECT decision_id, count(*) AS prints, sum(units)::BIGINT AS contracts FROM d JOIN v_prints p ON p.ticker = d.ticker AND us > as_of - 86400000000 AND us <= as_of GROUP BY decision_id)
  SELECT decision_id, ticker, as_of, x[1] AS last_price, x[2] AS last_us, coalesce(prints, 0) AS prints, coalesce(contracts, 0) AS contracts FROM l LEFT JOIN m USING (decision_id)""")
def tick_decision(spark, sf_dir):
    decisions = view(spark, sf_dir, "ev").filter("event_type = 'view'").select(F.col("event_id").alias("decision_id"), F.concat(F.lit("M"), "user_id").alias("ticker"), F.col("us").alias("as_of"))
    return op.tick_decision(decisions, view(spark, sf_dir, "v_prints"), 12 * HOUR, 24 * HOUR)
