"""The rules of op9's contract, written out on their own, and blocked hosts by rules that block."""

import pytest

from tests.llm.test_native import same
from tests.llm.test_url_links import COLUMNS, page
from tidemark.llm import url_filter
from tidemark.llm.queries import ORACLE_SQL, op9_url_filter

CONTRACT = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
HOSTS = ["com", "net", "org", "example.com", "example.net", "a.example.com", "a.example.net", "b.example.org", "notexample.com", "x.notexample.net", "netx", "example.info"]
PATHS = ["", "/", "/en", "/en/", "/en/7", "/en/71/x", "/en/8", "/de", "/de/", "/de/7", "/de/8", "/de/80", "/es/", "/es/8", "/x/de/"]
ROWS = [(i, f"https://{h}{p}?q=/de/8#f", None) for i, (h, p) in enumerate((h, p) for h in HOSTS for p in PATHS)]


def by_contract(host, path):
    """The longest rule that fits, label by label, and its word."""
    fits = []
    for rule in CONTRACT:
        at, _, start = rule.partition("/")
        labels = at.split(".")
        if host.split(".")[-len(labels):] == labels and path[: len(start) + 1] == "/" + start:
            fits.append(rule)
    rule = max(fits, key=len, default=None)
    return rule, CONTRACT.get(rule)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("url_rules"))
    spark.createDataFrame(ROWS, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return folder


def test_rules_are_those_of_the_contract():
    assert {rule: word for word, rule in url_filter.RULES} == CONTRACT and len(url_filter.RULES) == len(CONTRACT)


def test_ruled_verdicts_are_those_of_the_contract(spark, tables):
    out = {r.page_id: r for r in op9_url_filter(spark, tables).collect()}
    assert len(out) == len(ROWS)
    met = set()
    for (i, _, _), (host, path) in zip(ROWS, ((h, p) for h in HOSTS for p in PATHS), strict=True):
        rule, word = by_contract(host, path)
        assert (out[i].host, out[i].path, out[i].rule) == (host, path, rule)
        assert word is None or out[i].verdict == word, (host, path, rule)
        met.add(rule)
    assert met == {*CONTRACT, None}


def test_sql_has_the_rules_of_the_contract(spark, tables):
    same(op9_url_filter(spark, tables), ORACLE_SQL["op9_url_filter"], "pages", ROWS, COLUMNS)


def judged(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    same(url_filter.judge_urls(df), url_filter.ORACLE_SQL, "pages", rows, COLUMNS)
    return {r.page_id: r.verdict for r in url_filter.judge_urls(df).collect()}


def test_an_allowed_host_blocks_none_that_link_to_it(spark):
    assert judged(spark, [page(0, "fine.net", path="/de/1"), page(1, "fine.net"), page(2, "linker.info", "fine.net")]) == {0: "allow", 1: "allow", 2: "allow"}


def test_a_blocked_host_blocks_all_that_link_to_it_alone(spark):
    rows = [page(0, "bad.org", path="/es/1"), page(1, "bad.org")] + [page(10 + i, f"h{i}.info", "bad.org") for i in range(50)]
    assert set(judged(spark, rows).values()) == {"block"}


def test_one_link_of_many_to_a_blocked_host_blocks_nothing(spark):
    rows = [page(0, "bad.org", path="/es/1"), page(1, "many.info", "bad.org", *(f"fine{i}.info" for i in range(9)))]
    assert judged(spark, rows) == {0: "block", 1: "allow"}


def test_distrust_of_a_blocked_host_fades_along_a_chain(spark):
    rows = [page(0, "bad.org", path="/es/1")] + [page(i, f"c{i}.info", "bad.org" if i == 1 else f"c{i - 1}.info") for i in range(1, 9)]
    out = judged(spark, rows)
    assert [out[i] for i in range(9)] == ["block"] * 4 + ["allow"] * 5


def test_trust_outweighs_and_hosts_lose_ports_and_users(spark):
    rows = [page(0, "bad.org", path="/es/1"), page(1, "a.example.com", "good.info", path="/en/7"), page(2, "good.info", "bad.org"), page(3, "a.example.com", "bad.org", path="/q")]
    assert judged(spark, rows) == {0: "block", 1: "allow", 2: "allow", 3: "allow"}
    rows = [page(0, "bad.org", "ring1.info", path="/es/1"), page(1, "ring1.info", "ring2.info"), page(2, "ring2.info:8080", "ring3.info"), page(3, "ring3.info", "ring1.info", "u:p@BAD.org:443")]
    assert judged(spark, rows)[3] == "block"  # half of its links


def test_forms_of_links_to_a_blocked_host(spark):
    rows = [
        page(0, "bad.org", path="/es/1"), (1, "http://linker.info/a", '<a class=x href="https://bad.org/es/2">t</a><A HREF=//bad.org/1>u</A><a href="/own">v</a>'), (1, "http://linker.info/a", None),
        (2, "http://far.info/", '<a href="http://linker.info/b">l</a>'), (3, None, None), (4, "http://notexample.org/en/7", None), (5, "HTTP://A.Example.COM/en/7x?q#f", "<a href='http://bad.org/x'>b</a>"),
    ]
    assert judged(spark, rows) == {0: "block", 1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow"}
    assert judged(spark, [(1, "http://a.info", '<a data-href="http://bad.org/">x</a>'), page(0, "bad.org", path="/es/1")]) == {0: "block", 1: "allow"}
