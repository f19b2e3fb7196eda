"""Mixing of sources to target weights by hash thresholds, without sorting any documents.

Every document gets a 60-bit hash of its id and text. Sizes are summed by source and by the first 12 bits of it;
a source's budget falls into one of these cells, and only that boundary cell is summed again by the next 12 bits,
twice. The threshold so found is a filter on the hash. Budgets are nested: a larger one takes the documents of a
smaller one and more. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._columns import word_count
from tidemark.llm._spark import keep, small_side

#: Bits of the hash, bits that one histogram resolves, and histograms.
BITS, STEP, LEVELS = 60, 12, 3


def document_hash(doc_id: Column, text: Column) -> Column:
    """The first 60 bits of the MD5 of id and text."""
    whole = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(whole), 1, BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], limit: int) -> DataFrame:
    """Targets of sources (key, source, source_size): the whole is shared by weight, none above limit times its size.

    This is water filling: in order of limit * size / weight, the first few sources are full, and the rest share what
    is left. A row per source; the windows run over sources, not documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.get(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))))
    ranked = sizes.withColumn("weight", weight.cast("double")).withColumn("most", limit * F.col("source_size").cast("double"))
    filling = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, whole = filling.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("level", level).withColumn("full", F.col("level") >= F.col("most") / F.col("weight"))
    share = F.coalesce(F.max(F.when(~F.col("full"), F.col("level"))).over(whole), F.lit(float("inf")))
    return ranked.withColumn("target", F.when(F.col("full"), F.col("most")).otherwise(F.least("most", share * F.col("weight")))).select("key", "source", "source_size", "target")


def _base(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("key"), F.col("source"),
        word_count(F.col("text")).alias("size"), document_hash(F.col("doc_id"), F.col("text")).alias("hash"),
    )


def _plan(base: DataFrame, weights: tuple[int, ...], limit: int) -> DataFrame:
    """What each source's documents do: key, source_size, target, rounds, and below, the hash prefix under which they enter once more."""
    cell = F.shiftright("hash", BITS - STEP)
    first = keep(base.groupBy("key", "source", cell.alias("cell")).agg(F.sum("size").alias("words")))
    targets = source_targets(first.groupBy("key", "source").agg(F.sum("words").alias("source_size")), weights, limit)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = keep(targets.withColumn("rounds", F.least(whole, F.lit(limit)).cast("long")).withColumn("left", F.col("target") - F.col("rounds") * F.col("source_size")))
    bound, cells = plan.filter("left > 0").select("key", "left"), first.select("key", "cell", "words")
    for level in range(1, LEVELS + 1):
        if level > 1:
            cells = base.join(small_side(bound).withColumnRenamed("cell", "within"), "key").filter(F.shiftright("hash", BITS - STEP * (level - 1)) == F.col("within"))
            cells = cells.groupBy("key", F.shiftright("hash", BITS - STEP * level).alias("cell")).agg(F.sum("size").alias("words"))
        upto = F.sum("words").over(Window.partitionBy("key").orderBy("cell"))
        found = cells.withColumn("upto", upto).join(bound.select("key", "left"), "key").filter(F.col("upto") > F.col("left"))
        found = found.groupBy("key").agg(F.min_by(F.struct("cell", "words", "upto", "left"), "cell").alias("at")).select("key", "at.*")
        bound = keep(found.withColumn("left", F.col("left") - (F.col("upto") - F.col("words"))).select("key", "cell", "left", "words"))
    # the last boundary cell enters whole if that comes nearer to the budget
    limits = bound.select("key", (F.col("cell") + (F.col("words") - F.col("left") <= F.col("left")).cast("long")).alias("below"))
    return keep(plan.join(limits, "key", "left").select("key", "source_size", "target", "rounds", F.coalesce("below", F.lit(0).cast("long")).alias("below")))


def _copies() -> Column:
    return F.col("rounds") + (F.shiftright("hash", BITS - STEP * LEVELS) < F.col("below")).cast("long")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), limit: int = 3) -> DataFrame:
    """How often each document enters the mixture.

    docs: doc_id, source, text. Returns for each row doc_id, size (words), source_size, target (its source's), copies
    and taken (= copies * size). copies is at most limit, for documents without words as well. Sources weigh by their
    place in code point order, null last. Every document enters floor(target / source_size) times, and, where that
    leaves some of the target, those below the source's hash threshold once more. Sources should be few, as their sums
    are ranked in one task.

    Null text has size 0 and takes nothing; a null source is a source. Fully repeated rows share a hash and so their
    fate. Other columns are ignored; an empty table gives an empty result; reruns agree.
    """
    base = keep(_base(docs))
    return base.join(small_side(_plan(base, weights, limit)), "key").withColumn("copies", _copies()).select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), limit: int = 3) -> DataFrame:
    """The mixture itself: every row of docs as often as mix_sources says, with the columns of docs.

    Only the plan, a row for each source, is joined to the texts.
    """
    names = docs.columns
    plan = _plan(keep(_base(docs).select("doc_id", "key", "source", "size", "hash")), weights, limit)
    rows = docs.select(F.struct(*names).alias("_row"), "doc_id", "source", "text")
    whole = rows.select("_row", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("key"), document_hash(F.col("doc_id"), F.col("text")).alias("hash"))
    copies = whole.join(small_side(plan), "key").select("_row", _copies().alias("n")).filter("n > 0")
    return copies.select("_row", F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int"))).alias("_copy")).select("_row.*")


ORACLE_SQL = r"""
WITH base AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS size,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS hash
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source
), ranked AS (
  SELECT *, 1.0 * (1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3) AS weight, 3.0 * source_size AS most FROM sources
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER before, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level
  FROM ranked
  WINDOW before AS (ORDER BY most / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), shares AS (
  SELECT *, level >= most / weight AS is_full, max(CASE WHEN level >= most / weight THEN NULL ELSE level END) OVER () AS share FROM levels
), targets AS (
  SELECT source, source_size, CAST(CASE WHEN is_full THEN most ELSE least(most, share * weight) END AS DOUBLE) AS target FROM shares
), plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3)::BIGINT ELSE 0 END AS rounds FROM targets
), cells AS (
  SELECT b.source, b.hash >> 24 AS cell, sum(b.size) AS words, any_value(p.target - p.rounds * p.source_size) AS budget
  FROM base b JOIN plan p ON b.source IS NOT DISTINCT FROM p.source GROUP BY b.source, b.hash >> 24
), upto AS (
  SELECT *, sum(words) OVER (PARTITION BY source ORDER BY cell) AS upto FROM cells
), bounds AS (
  SELECT source, arg_min(cell + CASE WHEN upto - budget <= budget - (upto - words) THEN 1 ELSE 0 END, cell) AS below
  FROM upto WHERE budget > 0 AND upto > budget GROUP BY source
)
SELECT b.doc_id, b.size::BIGINT AS size, p.source_size, p.target,
       (p.rounds + CASE WHEN (b.hash >> 24) < coalesce(t.below, 0) THEN 1 ELSE 0 END)::BIGINT AS copies,
       (b.size * (p.rounds + CASE WHEN (b.hash >> 24) < coalesce(t.below, 0) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM base b JOIN plan p ON b.source IS NOT DISTINCT FROM p.source LEFT JOIN bounds t ON b.source IS NOT DISTINCT FROM t.source
"""
