"""Secret scanning with linking of multipart credentials, in built-in functions only.

Strong patterns are reported wherever they match. Weak ones - an account name, a short password, a key of no known
form - are common in clean text, so they are interval-joined within the document: a weak secret is reported only
where an identifier lies within SCOPE code points of it and an endpoint, or a strong identifier, does too, and a weak
identifier only beside such a secret. Scopes never cross documents, so nothing is shuffled: a document's spans are put
into one order by place, and a running maximum over it tells each span how far the others before its scope's end reach.
That takes as long as sorting, whatever the number of spans in one text.

Spark gives matches but no positions; they are running sums of the lengths of the matches and of the pieces between.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def either(word: str) -> str:
    """A pattern for an ASCII word in either case that no engine widens to other alphabets."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_VALUE = r"[A-Za-z0-9+/_.=-]"
_SIGN = r"""["']?\x20*[:=]\x20*["']?"""
ASSIGN = "(" + "|".join(map(either, ("password", "passwd", "secret", "token", "api_?key"))) + ")" + _SIGN + f"({_VALUE}+)"
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
WEAK_ID = "(" + "|".join(map(either, ("username", "user", "login", "account", "client_?id", "key_?id"))) + ")" + _SIGN + r"([A-Za-z0-9+/_.@=-]{3,})"
WEAK_SECRET = "(" + "|".join(map(either, ("password", "passwd", "pass", "pwd", "secret", "token", "auth", "key"))) + ")" + _SIGN + f"({_VALUE}{{6,}})"
ENDPOINT = r"(https?|ftp|sftp|ssh|postgres|postgresql|mysql|mongodb|redis|amqp|jdbc:[a-z]+)://[A-Za-z0-9._-]+"
#: Code points between the ends of two spans up to which they belong together.
SCOPE = 200
#: Shortest value of a strong assignment.
LEAST_VALUE = 8
#: Kinds of spans in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "part_id", "part_secret")
REDACTED = "[REDACTED]"

#: Elements that running values are made of at once, and code points of the chunks in which texts are redacted.
STEP, CHUNK = 256, 1024

_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it occurs there, within lambdas as well."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _last(a: Column) -> Column:
    return F.get(a, F.size(a) - 1)


def running(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Running values of an int array under step, which is null only for nulls, in runs of STEP that are then joined.

    An array can't grow in place, so a single fold would copy all that it has for every element.
    """

    def fold(run: Column) -> Column:
        return F.aggregate(run, F.array().cast("array<int>"), lambda done, x: F.concat(done, F.array(F.coalesce(step(_last(done), x), x, _last(done)))))

    def joined(runs: Column) -> Column:
        before = _let(fold(F.transform(runs, _last)), lambda t: F.concat(F.array(F.lit(None).cast("int")), F.slice(t, 1, F.size(t) - 1)))
        return F.flatten(F.zip_with(runs, before, lambda run, b: F.transform(run, lambda x: F.coalesce(step(b, x), x, b))))

    def cut(v: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1)), F.lit(STEP))
        return _let(F.transform(starts, lambda at: fold(F.slice(v, at, F.lit(STEP)))), joined)

    return _let(values, cut)


def _furthest(points: Column, at: Column) -> Column:
    """For each of the ints at: the largest reach of the points (place, reach) with a place up to it; null for none."""
    none = F.lit(None).cast("int")
    events = F.concat(
        F.transform(points, lambda p: F.struct(p["place"].alias("place"), F.lit(-1).alias("asks"), p["reach"].alias("reach"))),
        F.transform(at, lambda x, i: F.struct(x.alias("place"), i.alias("asks"), none.alias("reach"))),
    )

    def asked(e: Column) -> Column:
        most = running(F.transform(e, lambda x: x["reach"]), F.greatest)
        found = F.filter(F.zip_with(e, most, lambda x, m: F.struct(x["asks"].alias("asks"), m.alias("most"))), lambda x: x["asks"] >= 0)
        return F.transform(F.sort_array(found), lambda x: x["most"])

    return _let(F.sort_array(events), asked)


def _points(spans: Column, place: str, reach: str) -> Column:
    return F.transform(spans, lambda x: F.struct(x[place].alias("place"), x[reach].alias("reach")))


def _meets(spans: Column, others: Column, scope: int) -> Column:
    """Whether each span is within scope of one of others; with scope -1, whether it overlaps one."""
    reach = _furthest(_points(others, "start", "end"), F.transform(spans, lambda s: s["end"] + scope))
    return F.zip_with(spans, reach, lambda s, r: F.coalesce(r >= s["start"] - scope, F.lit(False)))


def _meets_beside(spans: Column, others: Column, scope: int) -> Column:
    """Whether each span is within scope of one of others that it doesn't overlap."""
    before = F.zip_with(spans, _furthest(_points(others, "end", "end"), F.transform(spans, lambda s: s["start"])), lambda s, r: F.coalesce(r >= s["start"] - scope, F.lit(False)))
    after = F.zip_with(spans, _furthest(_points(others, "start", "start"), F.transform(spans, lambda s: s["end"] + scope)), lambda s, r: F.coalesce(r >= s["end"], F.lit(False)))
    return F.zip_with(before, after, lambda a, b: a | b)


def _only(spans: Column, flags: Column) -> Column:
    both = F.zip_with(spans, flags, lambda s, f: F.struct(s.alias("span"), f.alias("flag")))
    return F.transform(F.filter(both, lambda x: x["flag"]), lambda x: x["span"])


def _found(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Spans of the leftmost matches that don't overlap; those whose group is shorter than least are dropped."""

    def placed(size: Column) -> Column:
        gap = F.slice(F.transform(F.split(text, pattern, -1), F.length), 1, F.size(size))
        ends = running(F.zip_with(gap, size, lambda a, b: a + b), lambda a, b: a + b)
        spans = F.zip_with(ends, size, lambda e, n: F.struct((e - n).alias("start"), F.lit(kind).alias("kind"), e.alias("end")))
        if least:
            value = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length)
            spans = _only(spans, F.transform(value, lambda n: n >= least))
        return F.when(F.size(size) > 0, spans).otherwise(F.array().cast(_SPANS))

    return _let(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length), placed)


def _linked(base: Column, ids: Column, secrets: Column, ends: Column) -> Column:
    """The weak spans that link."""

    def with_new(new: Column) -> Column:
        strong = F.filter(base, lambda b: b["kind"] == 1)
        parts = F.zip_with(_meets_beside(new, ids, SCOPE), _meets(new, ends, SCOPE), lambda a, b: a & b)
        return _let(_only(new, F.zip_with(_meets(new, strong, SCOPE), parts, lambda a, b: a | b)), with_secrets)

    def with_secrets(found: Column) -> Column:
        beside = F.zip_with(_meets(ids, found, SCOPE), _meets(ids, ends, SCOPE), lambda a, b: a & b)
        known = _only(ids, F.zip_with(beside, _meets(ids, base, -1), lambda a, b: a & ~b))
        return F.concat(found, F.when(F.size(found) > 0, known).otherwise(F.array().cast(_SPANS)))

    return _let(_only(secrets, F.transform(_meets(secrets, base, -1), lambda x: ~x)), with_new)


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds base, the spans of strong patterns, and spans, those and the weak ones that link; both sorted.

    A span is (start, kind, end) in code points, end exclusive, kind an index into KINDS. Null text has none.
    """
    none = F.array().cast(_SPANS)
    df = df.withColumn("_text", F.coalesce(F.col(text).cast("string"), F.lit("")))
    whole = F.col("_text")
    access = F.when(F.contains(whole, F.lit("AKIA")), _found(whole, ACCESS, 1)).otherwise(none)
    df = df.withColumn("_base", F.sort_array(F.concat(_found(whole, ASSIGN, 0, 2, LEAST_VALUE), access, _found(whole, HEX, 2))))
    # nothing links without an endpoint or a strong identifier, so most texts are not searched for weak parts
    may_link = F.contains("_text", F.lit("://")) | F.contains("_text", F.lit("AKIA"))
    df = df.withColumn("_secrets", F.when(may_link, _found(whole, WEAK_SECRET, 4)).otherwise(none))
    for name, pattern, kind in (("_ids", WEAK_ID, 3), ("_ends", ENDPOINT, 5)):
        df = df.withColumn(name, F.when(F.size("_secrets") > 0, _found(whole, pattern, kind)).otherwise(none))
    weak = _let(F.col("_base"), lambda b: _let(F.col("_ids"), lambda i: _let(F.col("_secrets"), lambda s: _let(F.col("_ends"), lambda e: _linked(b, i, s, e)))))
    df = df.withColumn("_spans", F.when(F.size("_secrets") > 0, F.sort_array(F.concat("_base", weak))).otherwise(F.col("_base")))
    return df.withColumnsRenamed({"_base": "base", "_spans": "spans"}).drop("_text", "_ids", "_secrets", "_ends")


def _listed(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame) -> DataFrame:
    """Spans of secrets in every document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    docs: doc_id, text. A row for each row of docs, in whole texts. A null or empty text has no spans and the digest
    of an empty string; other columns are ignored; no rows give no rows.
    """
    rows = scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")

    return rows.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"))


def redact_secrets(docs: DataFrame) -> DataFrame:
    """docs with every reported span of text replaced by a mark; n_chars, where docs has it, is counted anew.

    Overlapping spans become one mark. Texts without secrets, and nulls, stay as they are.
    """
    names = docs.columns
    rows = scan(docs.select(F.struct(*names).alias("_row"), F.col("text").cast("string").alias("text")))
    rows = rows.withColumn("text", F.when(F.size("spans") > 0, _redacted(F.col("text"), F.col("spans"))).otherwise(F.col("text")))
    fresh = {"text": F.col("text"), "n_chars": F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("_row.n_chars")) if "n_chars" in names else None}
    return rows.select(*(fresh[n].alias(n) if fresh.get(n) is not None else F.col("_row")[n].alias(n) for n in names))


def _redacted(text: Column, spans: Column) -> Column:
    """text with a mark for each run of overlapping spans, chunk by chunk, as taking a piece of a text reads it from its start."""

    def by_gaps(gaps: Column) -> Column:  # what is kept: (start, end), a mark after each but the last
        pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
        first = F.transform(pieces, lambda p, k: k * CHUNK)
        done = _furthest(F.transform(gaps, lambda g, i: F.struct(g["end"].alias("place"), (i + 1).alias("reach"))), F.transform(first, lambda a: a - 1))
        begun = _furthest(F.transform(gaps, lambda g, i: F.struct(g["start"].alias("place"), (i + 1).alias("reach"))), F.transform(first, lambda a: a + CHUNK - 1))
        placed = F.zip_with(pieces, first, lambda p, a: F.struct(p.alias("piece"), a.alias("at")))
        counts = F.zip_with(done, begun, lambda d, b: F.struct(F.coalesce(d, F.lit(0)).alias("done"), F.coalesce(b, F.lit(0)).alias("begun")))
        own = F.zip_with(placed, counts, lambda x, y: F.struct(x["piece"].alias("piece"), x["at"].alias("at"), y["done"].alias("done"), y["begun"].alias("begun")))

        def chunk(c: Column) -> Column:
            kept = F.slice(gaps, c["done"] + 1, F.greatest(c["begun"] - c["done"], F.lit(0)))

            def part(g: Column) -> Column:
                start = F.greatest(g["start"], c["at"])
                left = F.substring(c["piece"], start - c["at"] + 1, F.greatest(g["end"] - start, F.lit(0)))
                return F.when(g["mark"] & (g["end"] >= c["at"]) & (g["end"] < c["at"] + CHUNK), F.concat(left, F.lit(REDACTED))).otherwise(left)

            return F.array_join(F.transform(kept, part), "")

        return F.array_join(F.transform(own, chunk), "")

    def with_reach(reach: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), reach)
        gaps = F.zip_with(spans, F.slice(before, 1, F.size(spans)), lambda s, b: F.struct(b.alias("start"), s["start"].alias("end"), F.lit(True).alias("mark")))
        tail = F.array(F.struct(_last(reach).alias("start"), (F.length(text) + 1).alias("end"), F.lit(False).alias("mark")))
        return _let(F.concat(F.filter(gaps, lambda g: g["start"] <= g["end"]), tail), by_gaps)

    return _let(running(F.transform(spans, lambda s: s["end"]), F.greatest), with_reach)


def _sql_spans(pattern: str, kind: int, group: int = 0, least: int = 0) -> str:
    p = pattern.replace("'", "''")
    return f"""list_transform(list_filter(range(1, len(regexp_extract_all(text, '{p}', 0)) + 1), lambda i: length(regexp_extract_all(text, '{p}', {group})[i]) >= {least}),
      lambda i: struct_pack(s := (list_sum(list_transform(regexp_split_to_array(text, '{p}')[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(regexp_extract_all(text, '{p}', 0)[1:i - 1], lambda x: length(x))), 0))::BIGINT, k := {kind},
                       e := (list_sum(list_transform(regexp_split_to_array(text, '{p}')[1:i], lambda x: length(x))) + list_sum(list_transform(regexp_extract_all(text, '{p}', 0)[1:i], lambda x: length(x))))::BIGINT))"""


def _sql_any(items: str, test: str) -> str:
    return f"len(list_filter({items}, lambda y: {test})) > 0"


_NEAR = f"x.s <= y.e + {SCOPE} AND y.s <= x.e + {SCOPE}"
_OVER = "x.s < y.e AND y.s < x.e"
_LIST = "array_to_string(list_transform({0}, lambda x: [" + ", ".join(f"'{k}'" for k in KINDS) + "][x.k + 1] || ':' || x.s || ':' || x.e), ',')"
ORACLE_SQL = f"""
WITH rows AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), parts AS (
  SELECT doc_id, {_sql_spans(ASSIGN, 0, 2, LEAST_VALUE)} AS a, {_sql_spans(ACCESS, 1)} AS b, {_sql_spans(HEX, 2)} AS c,
         {_sql_spans(WEAK_ID, 3)} AS ids, {_sql_spans(WEAK_SECRET, 4)} AS secrets, {_sql_spans(ENDPOINT, 5)} AS ends
  FROM rows
), based AS (
  SELECT *, list_sort(list_concat(a, b, c)) AS base FROM parts
), weak AS (
  SELECT *, list_filter(secrets, lambda x: NOT ({_sql_any("base", _OVER)}) AND ({_sql_any("b", _NEAR)} OR ({_sql_any("ids", f"{_NEAR} AND NOT ({_OVER})")} AND {_sql_any("ends", _NEAR)}))) AS linked FROM based
), named AS (
  SELECT *, list_filter(ids, lambda x: {_sql_any("linked", _NEAR)} AND {_sql_any("ends", _NEAR)} AND NOT ({_sql_any("base", _OVER)})) AS known FROM weak
)
SELECT doc_id, len(a)::BIGINT AS n_assign, len(b)::BIGINT AS n_access, len(c)::BIGINT AS n_hex,
       sha256(coalesce({_LIST.format("base")}, '')) AS base_sha256,
       coalesce({_LIST.format("list_sort(list_concat(base, known, linked))")}, '') AS spans
FROM named
"""
