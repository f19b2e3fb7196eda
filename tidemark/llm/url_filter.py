"""URL rules, and verdicts for other pages from trust and distrust that spread over links between hosts.

Rules name a host (and with it its subdomains) and the start of a path; the longest that fits decides. Hosts of pages
that rules only allow are trusted seeds, those of pages that rules only block are distrusted seeds. Personalised
PageRank sends trust along the links between hosts and distrust against them. Beside it runs the PageRank that starts
at every host, so that a host's score becomes a share: how much of what could reach it over its links comes from the
seeds. A host is blocked if its share of distrust reaches a limit and is above its share of trust, however popular the
seeds are. Built-in functions only.

Hosts without links pass nothing on. Returning that mass to the seeds, as PageRank may, multiplies all scores of a kind
by one number, which the shares don't depend on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._columns import lower_ascii
from tidemark.llm._spark import keep, small_side

RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Share of a score that is passed on.
DAMPING = 0.85
#: Share of distrust from which a host is blocked: one that links to nothing but a blocked host has 1, one that links to
#: nothing but such a host 0.46 at most, the next 0.28, the next 0.19.
LIMIT = 0.25
#: Rounds stop when none adds more than this to what has reached any host, relative to it.
SETTLED = 1e-3

_LINK = r"""(?i)<a\b[^>]*?[\x20\x09-\x0D"']href[\x20\x09-\x0D]*=[\x20\x09-\x0D]*["']?[\x20\x09-\x0D]*((?:[a-z][a-z0-9+.-]*:)?//[^"'\x20\x09-\x0D>]+)"""
#: User info and port of a host.
_BESIDE = r"^[^@]*@|:[0-9]*$"


def url_host(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...], of: int) -> Column:
    """The verdict (of = 0) or name (of = 1) of the longest rule that fits; null if none does."""
    found = None
    for rule in sorted(rules, key=lambda r: -len(r[1])):
        at, slash, rest = rule[1].partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(rule[of])) if found is None else found.when(fits, F.lit(rule[of]))
    return found if found is not None else F.lit(None).cast("string")


def site(host: Column) -> Column:
    """A host without user info and port."""
    return F.regexp_replace(host, _BESIDE, "")


def host_links(pages: DataFrame) -> DataFrame:
    """Distinct links (src, dst) from page hosts (site) to other hosts, from whole html."""
    links = pages.select("site", F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_LINK), F.lit(1)))).alias("link"))
    return links.select(F.col("site").alias("src"), site(lower_ascii(F.regexp_extract("link", r"//([^/?#]*)", 1))).alias("dst")).filter("src <> dst and src <> '' and dst <> ''").distinct()


def shares(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, settled: float = SETTLED, most: int = 500) -> DataFrame:
    """Shares (kind, host, share) of what reaches hosts by PageRank that comes from seeds (kind, host).

    Trust follows links, distrust goes against them. Seeds start with 1 - damping, and so does every host in the
    PageRank that the seeds' is compared with; what a host other than a seed starts with itself is not counted. What
    is left out of later rounds is the same in both, so a round that adds little to the second adds no more to the
    first. A hot host is one key of a join whose other side is distinct, so skewed partitions split; of each round one
    number reaches the driver. Only hosts that are seeds or are reached are listed.
    """
    both = links.select(F.lit("trust").alias("kind"), "src", "dst").unionByName(links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst")))
    degree = keep(both.groupBy("kind", "src").agg(F.count("*").alias("out")))
    both = keep(both.join(degree, ["kind", "src"]))
    starts = keep(seeds.select("kind", "host").distinct().withColumn("start", F.lit(1 - damping)))
    fresh = degree.select("kind", F.col("src").alias("host")).join(starts, ["kind", "host"], "left")
    fresh = fresh.select("kind", "host", F.coalesce("start", F.lit(0.0)).alias("own"), F.lit(1 - damping).alias("all"))
    reached = None
    for _ in range(most):
        sent = both.join(fresh.withColumnRenamed("host", "src"), ["kind", "src"])
        came = sent.groupBy("kind", F.col("dst").alias("host")).agg(*(F.sum(F.col(c) * damping / F.col("out")).alias(c) for c in ("own", "all")))
        came = came.select("kind", "host", "own", "all", F.col("own").alias("own_now"), F.col("all").alias("all_now"))
        if reached is not None:
            before = reached.select("kind", "host", "own", "all", F.lit(0.0).alias("own_now"), F.lit(0.0).alias("all_now"))
            came = before.unionByName(came).groupBy("kind", "host").agg(*(F.sum(c).alias(c) for c in ("own", "all", "own_now", "all_now")))
        reached = keep(came)
        if (reached.agg(F.max(F.col("all_now") / F.col("all"))).first()[0] or 0.0) < settled:
            met = reached.select("kind", "host", "own", "all").join(starts, ["kind", "host"], "full")
            start = F.coalesce("start", F.lit(0.0))
            return met.select("kind", "host", ((start + F.coalesce("own", F.lit(0.0))) / (start + F.coalesce("all", F.lit(0.0)))).alias("share"))
        fresh = reached.filter("all_now > 0").select("kind", "host", F.col("own_now").alias("own"), F.col("all_now").alias("all"))
    raise RuntimeError(f"PageRank did not settle in {most} rounds")


def judge_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, limit: float = LIMIT) -> DataFrame:
    """Verdicts on pages: page_id, host, path, rule (null if none fits), verdict (allow or block).

    pages: page_id, url, html. A row for each row of pages. A null url, or one without ://, has an empty host and path,
    meets no rule and is allowed; null html has no links; repeated rows have one verdict; other columns are ignored; no
    rows give no rows.
    """
    parsed = pages.select(F.col("page_id").cast("long").alias("page_id"), url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), "html")
    parsed = parsed.withColumn("site", site(F.col("host")))
    ruled = parsed.withColumn("rule", _rule(F.col("host"), F.col("path"), rules, 1)).withColumn("ruled", _rule(F.col("host"), F.col("path"), rules, 0))
    pure = ruled.filter("ruled is not null and site <> ''").groupBy("site").agg(F.min("ruled").alias("least"), F.max("ruled").alias("most")).filter("least = most")
    seeds = pure.select(F.when(F.col("least") == "allow", "trust").otherwise("distrust").alias("kind"), F.col("site").alias("host"))
    by_host = shares(host_links(parsed), seeds).groupBy("host").agg(*(F.coalesce(F.max(F.when(F.col("kind") == k, F.col("share"))), F.lit(0.0)).alias(k) for k in ("trust", "distrust")))
    bad = keep(by_host.filter((F.col("distrust") >= limit) & (F.col("distrust") > F.col("trust"))).select(F.col("host").alias("site"), F.lit("block").alias("judged")))
    rows = ruled.drop("html").join(small_side(bad), "site", "left")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", "judged", F.lit("allow")).alias("verdict"))


def _sql_rule(of: int) -> str:
    cases = []
    for rule in sorted(RULES, key=lambda r: -len(r[1])):
        at, slash, rest = rule[1].partition("/")
        cases.append(f"WHEN (host = '{at}' OR suffix(host, '.{at}')) AND starts_with(path, '{slash + rest}') THEN '{rule[of]}'")
    return "CASE " + " ".join(cases) + " END"


ORACLE_SQL = rf"""
WITH RECURSIVE parsed AS (
  SELECT *, regexp_replace(host, '{_BESIDE}', '', 'g') AS site FROM (
    SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
    FROM pages)
), ruled AS (
  SELECT page_id, html, host, site, path, {_sql_rule(1)} AS rule, {_sql_rule(0)} AS ruled FROM parsed
), links AS (
  SELECT DISTINCT src, dst FROM (
    SELECT site AS src, regexp_replace(translate(regexp_extract(link, '//([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_BESIDE}', '', 'g') AS dst
    FROM (SELECT site, unnest(regexp_extract_all(coalesce(html, ''), '{_LINK.replace("'", "''")}', 1)) AS link FROM parsed)
  ) WHERE src <> dst AND src <> '' AND dst <> ''
), edges AS (
  SELECT *, count(*) OVER (PARTITION BY kind, src) AS outs FROM (SELECT 'trust' AS kind, src, dst FROM links UNION ALL SELECT 'distrust', dst, src FROM links)
), seeds AS (
  SELECT CASE min(ruled) WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, site AS host, {1 - DAMPING} AS start
  FROM ruled WHERE ruled IS NOT NULL AND site <> '' GROUP BY site HAVING min(ruled) = max(ruled)
), walk AS (
  SELECT 0 AS round, edges.kind, src AS host, coalesce(any_value(start), 0)::DOUBLE AS own, {1 - DAMPING}::DOUBLE AS every
  FROM edges LEFT JOIN seeds ON edges.kind = seeds.kind AND edges.src = seeds.host GROUP BY ALL
  UNION ALL
  SELECT round + 1, e.kind, e.dst, sum(own * {DAMPING} / outs), sum(every * {DAMPING} / outs) FROM walk w JOIN edges e ON e.kind = w.kind AND e.src = w.host WHERE round < 60 GROUP BY round, e.kind, e.dst
), reached AS (
  SELECT kind, host, sum(own) AS own, sum(every) AS every FROM walk WHERE round > 0 GROUP BY kind, host
), share AS (
  SELECT kind, host, (coalesce(start, 0) + coalesce(own, 0)) / (coalesce(start, 0) + coalesce(every, 0)) AS share FROM reached FULL JOIN seeds USING (kind, host)
), bad AS (
  SELECT host AS site, 'block' AS judged FROM (SELECT host, coalesce(max(share) FILTER (kind = 'trust'), 0) AS trust, coalesce(max(share) FILTER (kind = 'distrust'), 0) AS distrust FROM share GROUP BY host)
  WHERE distrust >= {LIMIT} AND distrust > trust
)
SELECT page_id, host, path, rule, coalesce(ruled, judged, 'allow') AS verdict FROM ruled LEFT JOIN bad USING (site)
"""
