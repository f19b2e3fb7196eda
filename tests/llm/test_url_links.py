"""Trust and distrust over links, against SQL and by brute force."""

import numpy as np
import pytest

from tests.llm.test_native import same
from tidemark.llm import url_filter

COLUMNS = [("page_id", "BIGINT"), ("url", "VARCHAR"), ("html", "VARCHAR")]


def page(i, host, *to, path="/x"):
    return (i, f"http://{host}{path}", "".join(f'<a class="b" href="https://{t}/y">t</a>' for t in to))


def verdicts(spark, rows):
    df = spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], "page_id long, url string, html string, site string, ruled string, own string, kind string, host string")
    same(url_filter.judge_urls(df), url_filter.ORACLE_SQL, "pages", rows, COLUMNS)
    return {r.page_id: r.verdict for r in url_filter.judge_urls(df).collect()}


def test_a_popular_blocked_host_blocks_all_that_link_to_it_alone(spark):
    rows = [page(0, "bad.net", path="/de/1"), page(1, "bad.net")] + [page(10 + i, f"h{i}.info", "bad.net") for i in range(50)]
    assert set(verdicts(spark, rows).values()) == {"block"}


def test_one_link_of_many_blocks_nothing(spark):
    rows = [page(0, "bad.net", path="/de/1"), page(1, "many.info", "bad.net", *(f"fine{i}.info" for i in range(9)))]
    assert verdicts(spark, rows) == {0: "block", 1: "allow"}


def test_distrust_fades_along_a_chain(spark):
    rows = [page(0, "bad.net", path="/de/1")] + [page(i, f"c{i}.info", "bad.net" if i == 1 else f"c{i - 1}.info") for i in range(1, 9)]
    out = verdicts(spark, rows)
    assert [out[i] for i in range(6)] == ["block", "block", "block", "block", "allow", "allow"] and out[8] == "allow"


def test_trust_outweighs(spark):
    rows = [page(0, "bad.net", path="/de/1"), page(1, "a.example.com", "good.info", path="/en/7"), page(2, "good.info", "bad.net"), page(3, "a.example.com", "bad.net", path="/q")]
    assert verdicts(spark, rows) == {0: "block", 1: "allow", 2: "allow", 3: "allow"}


def test_cycles_settle_and_hosts_lose_ports_and_users(spark):
    rows = [page(0, "bad.net", "ring1.info", path="/de/1"), page(1, "ring1.info", "ring2.info"), page(2, "ring2.info:8080", "ring3.info"), page(3, "ring3.info", "ring1.info", "u:p@BAD.net:443")]
    assert verdicts(spark, rows)[3] == "block"  # half of its links
    assert verdicts(spark, [(1, "http://a.info", '<a data-href="http://bad.net/">x</a>'), page(0, "bad.net", path="/de/1")]) == {0: "block", 1: "allow"}


@pytest.mark.parametrize("seed", range(1))
def test_shares_by_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    n = 12
    links = sorted({(int(a), int(b)) for a, b in rng.integers(0, n, (30, 2)) if a != b})
    seeds = {("trust", 0), ("trust", 1), ("distrust", 2), ("distrust", 3)}
    got = url_filter.shares(spark.createDataFrame([(f"h{a}", f"h{b}") for a, b in links], "src string, dst string"), spark.createDataFrame([(k, f"h{h}") for k, h in seeds], "kind string, host string"), settled=1e-4)
    got = {(r.kind, r.host): r.share for r in got.collect()}
    for kind in ("trust", "distrust"):
        step = np.zeros((n, n))
        for a, b in links:
            a, b = (a, b) if kind == "trust" else (b, a)
            step[b, a] = 1
        step /= np.maximum(step.sum(axis=0), 1)
        start = np.array([0.15 * ((kind, i) in seeds) for i in range(n)])
        own, every = (np.linalg.solve(np.eye(n) - 0.85 * step, x) for x in (start, np.full(n, 0.15)))
        for i in range(n):
            base = every[i] - 0.15 + start[i]
            assert got.get((kind, f"h{i}"), 0.0) == pytest.approx(own[i] / base if base > 1e-12 else 0.0, abs=2e-3)
