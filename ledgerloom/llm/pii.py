"""Personal data by rules, and more of it by bootstrapped contextual extraction; DataFrame operations only.

The rules' finds are the seeds.  The words around identifier-like strings are lexical patterns; a graph links patterns
and strings.  In each round a pattern scores by the share of its strings that are known, and strings that no rule
knows score by their patterns; those of high score are reported too.

Rules that would backtrack or recurse on long inputs are matched on a text of the same length in which the separators
inside a number, or the dots inside a host name, are joined by a private character.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, stored, table
from .secrets import span_digest

KINDS = ["email", "ip", "card", "phone", "found"]
_J, _NOT_J = "\ue000", "\ue001"
_LOCAL = f"A-Za-z0-9._%+{_J}-"
EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++{_J}[A-Za-z0-9{_J}-]++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = rf"(?<![0-9{_J}])[0-9][0-9{_J}]{{13,}}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: An identifier-like string: it has a digit, and stands between other characters.
TOKEN = r"(?<![A-Za-z0-9@._+-])[A-Za-z@._+-]*+[0-9][A-Za-z0-9@._+-]*+"
_SPANS = "array<struct<kind:string,start:int,end:int>>"


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _bits(n: Column) -> Column:
    """0, 1, .. up to the number of bits of n."""
    return F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(n, F.lit(1)) + 1)).cast("int"))


def running(values: Column, add) -> Column:
    """values[0], add(values[0], values[1]), ..: in log(size) passes, as an array that grew would be copied at each step."""

    def step(acc: Column, k: Column) -> Column:
        far = F.pow(F.lit(2), k).cast("int")
        return F.transform(acc, lambda v, i: F.when(i >= far, add(F.get(acc, i - far), v)).otherwise(v))

    return F.aggregate(_bits(F.size(values) - 1), values, step)


def count_below(ordered: Column, x: Column) -> Column:
    """How many of ordered (ascending) are less than x, by halving."""

    def step(at: Column, k: Column) -> Column:
        there = at + F.pow(F.lit(2), k).cast("int")
        return F.when((there <= F.size(ordered)) & (F.get(ordered, there - 1) < x), there).otherwise(at)

    return F.aggregate(F.reverse(_bits(F.size(ordered))), F.lit(0), step)


def regex_hits(text: Column, pattern: str) -> Column:
    """array<struct<start, end, hit, before>> of the leftmost, non-overlapping matches, in code points; before is the text
    up to the match.  The last has no hit.  The pattern must not match the empty string."""
    parts = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda p, h: F.struct(p.alias("p"), h.alias("h")))

    def placed(parts: Column) -> Column:
        ends = running(F.transform(parts, lambda x: F.length(x["p"]) + F.coalesce(F.length(x["h"]), F.lit(0))), lambda a, b: a + b)
        return F.zip_with(parts, ends, lambda x, end: F.struct((end - F.coalesce(F.length(x["h"]), F.lit(0))).alias("start"), end.alias("end"), x["h"].alias("hit"), x["p"].alias("before")))

    return _let(parts, placed)


def _joined(text: Column, between: str, inside: str) -> Column:
    """Each character of ``inside`` that stands between two characters of ``between`` becomes the private one."""
    return F.regexp_replace(F.translate(text, _J, _NOT_J), rf"(?<=[{between}])[{inside}](?=[{between}])", _J)


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)
    values = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substring(back, i, F.lit(1)).try_cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(values, F.lit(0), lambda acc, v: acc + F.when(v > 9, v - 9).otherwise(v)) % 10 == 0


def _is_ip(hit: Column) -> Column:
    short = F.transform(F.split(hit, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(short, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))


def base_spans(text: Column) -> Column:
    """array<struct<kind, start, end>> of the rules' finds by start, then kind."""
    none = F.array().cast("array<struct<start:int,place:int,end:int>>")

    def kind(place: int, source: Column, pattern: str, good) -> Column:
        hits = F.filter(regex_hits(source, pattern), lambda x: x["hit"].isNotNull() & F.coalesce(good(x["hit"]), F.lit(False)))
        return F.transform(hits, lambda x: F.struct(x["start"].alias("start"), F.lit(place).alias("place"), x["end"].alias("end")))

    def count_between(low: int, high: int):
        return lambda h: F.length(_digits(h)).between(low, high)

    found = F.concat(
        F.when(text.contains("@"), kind(0, _joined(text, "A-Za-z0-9-", "."), EMAIL, lambda h: F.lit(True))).otherwise(none),
        F.when(text.rlike(r"[0-9]\.[0-9]"), kind(1, text, IP, _is_ip)).otherwise(none),
        F.when(text.rlike(r"[0-9]{4}|[0-9][\x20-][0-9]"), kind(2, _joined(text, "0-9", r"\x20-"), CARD, lambda h: F.when(count_between(14, 19)(h), _luhn(_digits(h))))).otherwise(none),
        F.when(text.contains("+"), kind(3, text, PHONE, count_between(10, 15))).otherwise(none),
    )
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.transform(F.array_sort(found), lambda x: F.struct(F.element_at(names, x["place"] + 1).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def _occurrences(rows: DataFrame, least: int) -> DataFrame:
    """row, start, end, value, known and pats (patterns) of every identifier-like string of at least ``least`` characters.

    known: a rule's find overlaps it.  Patterns are the two words before, the two after, and the word on either side.
    """
    some = rows.where(F.col("text").rlike("[0-9]")).select("doc_id", "row", base_spans(F.col("text")).alias("spans"), regex_hits(F.col("text"), TOKEN).alias("hits"))
    # spans by start, and the furthest end up to each: a string is known if one that starts before its end goes past its start
    starts, furthest = F.transform("spans", lambda s: s["start"]), running(F.transform("spans", lambda s: s["end"]), F.greatest)
    some = some.select("doc_id", "row", "hits", starts.alias("starts"), furthest.alias("furthest"))

    def described(x: Column, i: Column) -> Column:
        known = F.coalesce(F.get("furthest", count_below(F.col("starts"), x["end"]) - 1) > x["start"], F.lit(False))
        before, after = F.substring(x["before"], -80, 80), F.substring(F.get("hits", i + 1)["before"], 1, 80)
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["hit"].alias("value"), before.alias("before"), after.alias("after"), known.alias("known"))

    each = F.filter(F.transform("hits", described), lambda x: F.length(x["value"]) >= least)
    one = some.select("doc_id", "row", F.explode(each).alias("x")).select("doc_id", "row", "x.*")
    before = F.split(F.trim(F.regexp_replace(F.lower("before"), r"[^\p{L}\p{N}=:]+", " ")), " ")
    after = F.split(F.trim(F.regexp_replace(F.lower("after"), r"[^\p{L}\p{N}=:]+", " ")), " ")
    left1, right1 = F.element_at(before, -1), F.element_at(after, 1)
    pats = F.array(F.concat(F.lit("L "), F.array_join(F.slice(before, F.greatest(F.size(before) - 1, F.lit(1)), 2), " ")), F.concat(F.lit("R "), F.array_join(F.slice(after, 1, 2), " ")), F.concat(F.lit("B "), left1, F.lit(" _ "), right1))
    return one.select("doc_id", "row", "start", "end", F.lower("value").alias("value"), "known", pats.alias("pats"))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 2, min_support: int = 3, min_score: float = 0.8, min_length: int = 6) -> DataFrame:
    """doc_id and spans (array of kind, start, end by start, then kind) of every row.

    rounds: how often patterns and strings are scored; min_support: known strings that a pattern needs; min_score: score
    that a pattern needs to tell of new strings, and a string to be reported; min_length: shortest string considered.
    Spans are code points of the whole text, end exclusive.  Null and empty texts have none; rows are kept as often as
    they occur.
    """
    rows = id_text(docs, id_col, text_col).withColumn("row", F.xxhash64("doc_id", "text"))
    seen = stored(_occurrences(rows, min_length), "occurrences")
    edges = seen.select(F.explode(F.array_distinct("pats")).alias("pattern"), "value", "known").groupBy("pattern", "value").agg(F.max("known").alias("known"))
    scores = seen.groupBy("value").agg(F.max(F.col("known").cast("double")).alias("score"))
    for _ in range(rounds):
        # of the strings a pattern goes with, how many are known: each counts once, and one doubt is always added
        patterns = edges.join(scores, "value").groupBy("pattern").agg((F.sum("score") / (F.count("*") + 1)).alias("weight"), F.sum((F.col("score") >= min_score).cast("int")).alias("support"))
        patterns = patterns.where((F.col("support") >= min_support) & (F.col("weight") >= min_score))
        told = edges.where("NOT known").join(patterns, "pattern").groupBy("value").agg(F.max("weight").alias("told"))
        scores = scores.join(told, "value", "left").select("value", F.greatest("score", F.coalesce("told", F.lit(0.0))).alias("score"))
        scores = stored(scores, "scores")
    new = seen.where("NOT known").join(scores.where(F.col("score") >= min_score), "value")
    new = new.select("doc_id", "row", "start", "end").distinct().groupBy("row", "doc_id").agg(F.collect_list(F.struct("start", F.lit(KINDS.index("found")).alias("place"), "end")).alias("new")).withColumnsRenamed({"row": "n_row", "doc_id": "n_doc_id"})
    base = rows.select("doc_id", "row", base_spans(F.col("text")).alias("spans"))
    both = base.join(new, (base["row"] == new["n_row"]) & base["doc_id"].eqNullSafe(new["n_doc_id"]), "left")
    names = F.array(*(F.lit(k) for k in KINDS))
    placed = F.transform("spans", lambda x: F.struct(x["start"].alias("start"), (F.array_position(names, x["kind"]) - 1).cast("int").alias("place"), x["end"].alias("end")))
    merged = F.array_sort(F.concat(placed, F.coalesce("new", F.array().cast("array<struct<start:int,place:int,end:int>>"))))
    spans = F.transform(merged, lambda x: F.struct(F.element_at(names, x["place"] + 1).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return both.select("doc_id", F.when(F.col("new").isNull(), F.col("spans")).otherwise(spans).alias("spans"))


def op9_pii_of(docs: DataFrame) -> DataFrame:
    """The contract's columns of docs."""
    return span_digest(find_personal_data(docs), ["email", "ip", "card", "phone"])


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents; see ``find_personal_data``."""
    return op9_pii_of(table(spark, sf_dir, "documents"))
