"""Subscriptions: validation of requests and how their streams end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.ledger import expected, present
from .blocks import watermarks
from .contiguity import GAPS, gap_ranges, next_at_least

#: Status codes of a subscription, and the outcome label of each way to end.
CODES = {"SUCCESS": "completed", "INVALID_START_BLOCK_NUMBER": "invalid_request", "INVALID_END_BLOCK_NUMBER": "invalid_request", "ERROR": "timeout"}


def validate(requests: DataFrame, blocks: DataFrame) -> DataFrame:
    """req_id, first and code of each request (req_id, start, end; null: unbounded).

    A null start means the earliest block, 0 in an empty store.  An end before the start is checked first; then a start
    before the earliest block.  A start after the latest is accepted, and waits.
    """
    asked = requests.join(F.broadcast(watermarks(blocks)), F.lit(True)).withColumn("first", F.coalesce("start", "earliest", F.lit(0)))
    code = F.when(F.col("first") > F.col("end"), "INVALID_END_BLOCK_NUMBER").when(F.col("first") < F.col("earliest"), "INVALID_START_BLOCK_NUMBER").otherwise("OK")
    return asked.select("req_id", "first", "end", code.alias("code"))


def outcome(requests: DataFrame, blocks: DataFrame) -> DataFrame:
    """req_id, n_sent, code and label: a stream sends blocks from its first to its end, waits at the first that is missing,
    and times out there; a bad request sends nothing."""
    valid = validate(requests, blocks)
    latest = watermarks(blocks).select("latest")
    gaps = gap_ranges(blocks).select("gap_start", "gap_end")
    good = valid.where("code = 'OK'")
    ahead = next_at_least(good.select(F.col("first").alias("n")), gaps.select(F.col("gap_end").alias("k"))).join(gaps, F.col("next_key") == F.col("gap_end"))
    holes = ahead.select(F.col("n").alias("first"), F.greatest("gap_start", "n").alias("hole"))
    stop = good.join(holes, "first", "left").join(F.broadcast(latest), F.lit(True))
    last = F.least(F.coalesce(F.col("hole") - 1, "latest"), "end")
    sent = stop.select("req_id", F.greatest(last - F.col("first") + 1, F.lit(0)).alias("n"), (last == F.col("end")).alias("done"))
    code = F.when(F.col("code") != "OK", F.col("code")).when(F.col("done"), "SUCCESS").otherwise("ERROR")
    label = F.create_map(*(F.lit(x) for kv in CODES.items() for x in kv))
    return valid.join(sent, "req_id", "left").select("req_id", F.coalesce("n", F.lit(0)).alias("n_sent"), code.alias("code"), label[code].alias("label"))


def subscriptions(s, d) -> DataFrame:
    n = expected(s, d).select(F.col("block_number").alias("n"))
    ranges = n.select(F.col("n").alias("req_id"), F.when(F.col("n") % 5 != 0, F.col("n")).alias("start"), F.when(F.col("n") % 3 != 0, F.col("n") + F.col("n") % 11 - 2).alias("end"))
    return ranges.unionByName(s.createDataFrame([(-1, -5, None), (-2, -5, -9), (-3, 10**9, None), (-4, 10, 5), (-5, None, None), (-6, 0, 0)], "req_id bigint, start bigint, end bigint"))


QUERIES = {
    "subscribe_validation": lambda s, d: validate(subscriptions(s, d), present(s, d)),
    "subscribe_outcome": lambda s, d: outcome(subscriptions(s, d), present(s, d)),
}
_V = f"""{GAPS}, w AS (SELECT min(n) AS lo, max(n) AS hi FROM p), r AS (
    SELECT o_orderkey AS req_id, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey END AS s, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey + o_orderkey % 11 - 2 END AS e FROM orders
    UNION ALL VALUES (-1, -5, NULL), (-2, -5, -9), (-3, 1000000000, NULL), (-4, 10, 5), (-5, NULL, NULL), (-6, 0, 0)),
    v AS (SELECT req_id, coalesce(s, lo, 0) AS first, e, lo, hi, CASE WHEN coalesce(s, lo, 0) > e THEN 'INVALID_END_BLOCK_NUMBER' WHEN coalesce(s, lo, 0) < lo THEN 'INVALID_START_BLOCK_NUMBER' ELSE 'OK' END AS code FROM r, w)"""
SQL = {
    "subscribe_validation": f'WITH {_V} SELECT req_id, first, e AS "end", code FROM v',
    "subscribe_outcome": f"""WITH {_V}, h AS (SELECT *, (SELECT min(greatest(gap_start, first)) FROM g WHERE gap_end >= first) AS hole FROM v),
        l AS (SELECT *, least(coalesce(hole - 1, hi), e) AS last FROM h)
        SELECT req_id, CASE WHEN code = 'OK' THEN greatest(last - first + 1, 0) ELSE 0 END AS n_sent, CASE WHEN code <> 'OK' THEN code WHEN last = e THEN 'SUCCESS' ELSE 'ERROR' END AS code,
        CASE WHEN code <> 'OK' THEN 'invalid_request' WHEN last = e THEN 'completed' ELSE 'timeout' END AS label FROM l""",
}
#: Second names of the same queries.
QUERIES |= {f"{k}_all": v for k, v in QUERIES.items()}
SQL |= {f"{k}_all": v for k, v in SQL.items()}
