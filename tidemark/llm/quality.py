"""Quality rules on documents and on their hosts, in built-in functions only.

Rules judge each document by itself. Failures are then summed by host (the column that names a document's origin),
each host's rate is shrunk towards that of all hosts with a beta prior fitted to the spread of rates between hosts,
and a host whose shrunken rate is above a limit loses its other documents as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._columns import BLANK_CLASS, BLANKS, word_list
from tidemark.llm._spark import keep, small_side

SYMBOLS = "#*$%&|<>"
#: Fewest words, and the highest percentage of words in repeated three-word windows.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Shrunken failure rate above which a host is rejected.
HOST_LIMIT = 0.6


def _repeated_words(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words from the word hashes in column w: words in three-word windows that the text holds twice or more."""
    grams = F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.struct(F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)).alias("h"), i.alias("p")))
    df = df.withColumn("grams", F.when(F.size("w") >= 4, F.sort_array(grams)).otherwise(F.array().cast("array<struct<h:bigint,p:int>>"))).drop("w")
    same = F.filter("grams", lambda x, i: (x["h"] == F.get("grams", i - 1)["h"]) | (x["h"] == F.get("grams", i + 1)["h"]))
    df = df.withColumn("places", F.sort_array(F.transform(same, lambda x: x["p"]))).drop("grams")
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate("places", start, lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n")), lambda a: a["n"])
    return df.withColumn("n_repeat_words", covered).drop("places")


def _features(df: DataFrame) -> DataFrame:
    """Adds the rule inputs and base_failed to rows with a column text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    full_lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    df = df.withColumn("w", F.transform(word_list(F.col("text")), lambda x: F.xxhash64(x))).withColumn("lines", full_lines)
    df = df.withColumns({
        "n_words": F.size("w").cast("long"),
        "word_chars": F.length(F.translate(text, BLANKS, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
    }).drop("lines")
    failed: Column = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    found = _repeated_words(df).withColumn("base_failed", failed)
    # A filter on what is found would be pushed down with its whole expression in place of each name, and lambdas would
    # then evaluate the arrays anew for every element. Nothing is pushed through a generator, even of one row.
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    rest = [c for c in found.columns if c not in names]
    return found.select(*rest, F.explode(F.array(F.struct(*names))).alias("_found")).select(*rest, "_found.*")


def host_rates(judged: DataFrame) -> DataFrame:
    """Shrunken failure rates: host, rate; from rows with host and base_failed. A null host has none."""
    hosts = judged.filter("host is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    hosts = keep(hosts)
    mean = F.sum("failed") / F.sum("n")
    total = hosts.agg(mean.alias("mean"), F.sum("n").alias("all"), F.count("*").alias("hosts"), F.sum(F.col("failed") * F.col("failed") / F.col("n")).alias("squares"))
    spread = F.col("squares") / F.col("all") - F.col("mean") * F.col("mean") - F.col("mean") * (1 - F.col("mean")) * F.col("hosts") / F.col("all")
    strength = F.least(F.greatest(F.col("mean") * (1 - F.col("mean")) / F.greatest(spread, F.lit(1e-9)) - 1, F.lit(2.0)), F.lit(1e6))
    prior = total.select("mean", strength.alias("strength")).first()  # two numbers
    if prior["mean"] is None:
        return hosts.select("host", F.lit(0.0).alias("rate"))
    return hosts.select("host", ((F.col("failed") + prior["mean"] * prior["strength"]) / (F.col("n") + prior["strength"])).alias("rate"))


def _with_verdict(judged: DataFrame, rates: DataFrame, limit: float) -> DataFrame:
    """Adds kept. Rows without a host meet no rate; their join keys are spread."""
    key = F.coalesce(F.concat(F.lit("="), "host"), F.concat(F.lit("-"), F.pmod(F.xxhash64("doc_id"), F.lit(1000)).cast("string")))
    bad = keep(rates.filter(F.col("rate") > limit).select(F.concat(F.lit("="), "host").alias("key"), F.lit(True).alias("bad")))
    return judged.withColumn("key", key).join(small_side(bad), "key", "left").withColumn("kept", ~F.col("base_failed") & F.col("bad").isNull()).drop("key", "bad", "host")


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def judge_quality(docs: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """Rule inputs and verdicts: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    docs: doc_id, text and the host column. A row for each row of docs. A null or empty text has no words and fails;
    a document without a host is judged by itself alone; other columns are ignored; no rows give no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col("text").cast("string").alias("text"))
    judged = keep(_features(rows).select(*COLUMNS, "host"))
    return _with_verdict(judged, host_rates(judged), limit)


def quality_filter(docs: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """The documents that pass the rules and come from hosts that pass, with the columns of docs.

    Texts are judged once: rows that pass by themselves are written with their hosts before the hosts are judged. Null
    and empty texts fail; a document without a host is judged by itself alone; repeated rows stay or go together; no
    rows give no rows.
    """
    names = docs.columns
    whole = docs.select(F.struct(*names).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col("text").cast("string").alias("text"))
    judged = keep(_features(whole).select(F.when(~F.col("base_failed"), F.col("row")).alias("row"), "doc_id", "host", "base_failed"))
    return _with_verdict(judged.filter(~F.col("base_failed")), host_rates(judged), limit).filter("kept").select("row.*")


ORACLE_SQL = rf"""
WITH rows AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '{BLANK_CLASS}+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), grams AS (
  SELECT rid, p, w[p + 1] || ' ' || w[p + 2] || ' ' || w[p + 3] AS gram FROM (SELECT rid, w, unnest(range(0, len(w) - 2)) AS p FROM rows WHERE len(w) >= 3)
), repeated AS (
  SELECT rid, count(DISTINCT place) AS n FROM (
    SELECT rid, unnest([p, p + 1, p + 2]) AS place FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, gram) AS found FROM grams) WHERE found > 1
  ) GROUP BY rid
), judged AS (
  SELECT doc_id, source, len(w)::BIGINT AS n_words, length(regexp_replace(text, '{BLANK_CLASS}+', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
         len(w) < {LEAST_WORDS} OR 100 * coalesce(n, 0) > {MOST_REPEATED} * len(w) AS base_failed
  FROM rows LEFT JOIN repeated USING (rid)
), hosts AS (
  SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS failed FROM judged WHERE source IS NOT NULL GROUP BY source
), total AS (
  SELECT sum(failed) / sum(n) AS mean, sum(n) AS n_all, count(*) AS hosts, sum(failed * failed / n) AS squares FROM hosts
), prior AS (
  SELECT mean, least(greatest(mean * (1 - mean) / greatest(squares / n_all - mean * mean - mean * (1 - mean) * hosts / n_all, 1e-9) - 1, 2), 1e6) AS strength FROM total
), rates AS (
  SELECT source, (failed + mean * strength) / (n + strength) AS rate FROM hosts, prior
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(rate, 0) <= {HOST_LIMIT} AS kept
FROM judged LEFT JOIN rates USING (source)
"""
