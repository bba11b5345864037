"""URL filtering by a trie over reversed host labels and path segments, with longest-match precedence.

A rule (verdict, host, path) fits its host and all subdomains if the url's path starts with the rule's path.  Of the
fitting rules the one with the longest host + path wins (ties: the longer host, then allow).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, table

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
Rule = tuple[str, str, str]


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def build_trie(rules: Iterable[Rule]) -> dict:
    """Nested dicts: ``kids`` by host label from the right, then ``path`` by whole segments; ``ends`` holds, at each
    path node, the rules that end in the segment begun there, by that segment's required start."""
    root: dict = {"kids": {}, "path": None}
    for verdict, host, path in rules:
        node = root
        for label in reversed(host.split(".")):
            node = node["kids"].setdefault(label, {"kids": {}, "path": None})
        at = node["path"] = node["path"] or {"segs": {}, "ends": {}}
        *whole, last = path.split("/")
        for seg in whole:
            at = at["segs"].setdefault(seg, {"segs": {}, "ends": {}})
        old = at["ends"].get(last)
        if old is None or verdict == "allow":
            at["ends"][last] = (len(host) + len(path), len(host), verdict == "allow", host + path, verdict)
    return root


def match(root: dict, host: str, path: str) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule that fits, or None."""
    best, node, segs = None, root, path.split("/")
    for label in reversed(host.split(".")):
        node = node["kids"].get(label)
        if node is None:
            break
        at = node["path"]
        for seg in segs:
            if at is None:
                break
            for start, found in at["ends"].items():
                if seg.startswith(start) and (best is None or found > best):
                    best = found
            at = at["segs"].get(seg)
    return best and best[3:]


def filter_urls(pages: DataFrame, rules: list[Rule] | DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", max_broadcast_rules: int = 100_000) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages.

    rules: a list, or a DataFrame (verdict, host, path).  Up to ``max_broadcast_rules`` of them are broadcast as a
    trie; more are joined on the host and its parents.  Null urls and urls without ``://`` have an empty host and path
    and get ``default``; rows are kept as often as they occur; null ids stay null.
    """
    spark = pages.sparkSession
    urls = pages.select(pages[id_col].cast("bigint").alias("page_id"), url_host(pages[url_col].cast("string")).alias("host"), url_path(pages[url_col].cast("string")).alias("path"))
    if isinstance(rules, DataFrame):
        some = rules.select("verdict", "host", "path").limit(max_broadcast_rules + 1).collect()
        if len(some) > max_broadcast_rules:
            return _joined(urls, rules, default)
        rules = [tuple(r) for r in some]
    elif len(rules) > max_broadcast_rules:
        return _joined(urls, spark.createDataFrame(rules, "verdict string, host string, path string"), default)
    trie = spark.sparkContext.broadcast(build_trie(rules))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [match(trie.value, h, p) for h, p in zip(b["host"].to_pylist(), b["path"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b["page_id"], b["host"], b["path"], pa.array([f and f[0] for f in found], pa.string()), pa.array([f[1] if f else default for f in found], pa.string())],
                ["page_id", "host", "path", "rule", "verdict"],
            )

    return urls.mapInArrow(judge, "page_id bigint, host string, path string, rule string, verdict string")


def _joined(urls: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """As the trie, by joins: each distinct (host, path) meets the rules of its host and of the host's parents."""
    rules = rules.select("verdict", F.col("host").alias("r_host"), F.col("path").alias("r_path"))
    labels = F.split("host", r"\.")
    keys = urls.select("host", "path").distinct()
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    rank = F.struct((F.length("r_host") + F.length("r_path")).alias("n"), F.length("r_host").alias("h"), (F.col("verdict") == "allow").alias("a"))
    best = (
        keys.withColumn("r_host", F.explode(suffixes))
        .join(rules, "r_host")
        .where(F.col("path").startswith(F.col("r_path")))
        .groupBy("host", "path")
        .agg(F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), "verdict"), rank).alias("m"))
    )
    return urls.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("m.rule").alias("rule"), F.coalesce("m.verdict", F.lit(default)).alias("verdict"))


#: The rules of the query.
QUERY_RULES: list[Rule] = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), QUERY_RULES)


SQL = """
WITH rules(verdict, rhost, rpath) AS (VALUES
  ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
  ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
urls AS (SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
best AS (SELECT host, path, arg_max(struct_pack(rule := rhost || rpath, verdict := verdict), length(rhost) + length(rpath)) AS m
  FROM (SELECT DISTINCT host, path FROM urls) u JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY host, path)
SELECT u.page_id, u.host, u.path, m.rule AS rule, coalesce(m.verdict, 'allow') AS verdict
FROM urls u LEFT JOIN best b ON u.host = b.host AND u.path = b.path
"""
