"""Block lookup, tiers, ranges and request outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.ledger import BATCH, HOT_LIMIT, bucket, expected, items, present, tiers
from .contiguity import P

#: Names of block response codes.
SUCCESS, INVALID_REQUEST, NOT_FOUND, NOT_AVAILABLE, UNKNOWN = "SUCCESS", "INVALID_REQUEST", "NOT_FOUND", "NOT_AVAILABLE", "UNKNOWN"


def point_lookup(blocks: DataFrame, n: int) -> DataFrame:
    """The block of number n, or no row; the filter reaches the scan."""
    return blocks.where(F.col("block_number") == n)


def cold_lookup(cold: DataFrame, n: int, batch: int = BATCH) -> DataFrame:
    """As point_lookup on archived blocks; the batch filter prunes their partitions."""
    return cold.where((F.col("batch_start") == n // batch * batch) & (F.col("block_number") == n))


def tiered_read(requests: DataFrame, hot: DataFrame, cold: DataFrame) -> DataFrame:
    """block_number and tier (hot before cold, or none) of each request."""
    h, c = hot.select("block_number", F.lit(True).alias("h")), cold.select("block_number", F.lit(True).alias("c"))
    tier = F.when(F.col("h"), "hot").when(F.col("c"), "cold").otherwise("none")
    return requests.join(h, "block_number", "left").join(c, "block_number", "left").select("block_number", tier.alias("tier"))


def all_blocks(hot: DataFrame, cold: DataFrame) -> DataFrame:
    """Each visible block once, with the tier that answers for it."""
    both = hot.select("block_number", F.lit("hot").alias("tier")).unionByName(cold.select("block_number", F.lit("cold").alias("tier")))
    return both.groupBy("block_number").agg(F.max("tier").alias("tier"))


def strict_batch_read(blocks: DataFrame, start: int, count: int) -> DataFrame:
    """The count blocks from start; fails if any is missing."""
    found = blocks.where((F.col("block_number") >= start) & (F.col("block_number") < start + count))
    n = found.agg(F.count_distinct("block_number").alias("n"))
    checked = n.select(F.assert_true(F.col("n") == count, F.lit(f"batch of {count} from {start} is incomplete")).alias("ok"))
    return found.join(F.broadcast(checked), F.col("ok").isNull()).drop("ok")


def historical_range(blocks: DataFrame, start: int, end: int) -> DataFrame:
    """Blocks of [start, end] in order, up to the first that is missing."""
    inside = blocks.where(F.col("block_number").between(start, end))
    wanted = blocks.sparkSession.range(start, end + 1).select(F.col("id").alias("block_number"))
    hole = wanted.join(inside, "block_number", "left_anti").agg(F.coalesce(F.min("block_number"), F.lit(end + 1)).alias("hole"))
    return inside.join(F.broadcast(hole), F.col("block_number") < F.col("hole")).drop("hole").orderBy("block_number")


def watermarks(blocks: DataFrame) -> DataFrame:
    return blocks.agg(F.min("block_number").alias("earliest"), F.max("block_number").alias("latest"))


def server_status(blocks: DataFrame) -> DataFrame:
    """First and last block, 0 where there is none; only_latest_state is always false."""
    return watermarks(blocks).select(F.coalesce("earliest", F.lit(0)).alias("first_available_block"), F.coalesce("latest", F.lit(0)).alias("last_available_block"), F.lit(False).alias("only_latest_state"))


def block_status(requests: DataFrame, blocks: DataFrame) -> DataFrame:
    """req_id, target and status of each request.

    requests: req_id, block_number (null: not given; -1: latest), retrieve_latest (null: not given).  A latest request on
    an empty store is not found; a number outside the watermarks is not available; a hole inside is not found; a block
    whose payload is empty is unknown (blocks may carry ``payload``).
    """
    asks_latest = (F.col("block_number") == -1) | (F.col("block_number").isNull() & F.col("retrieve_latest"))
    asked = requests.join(F.broadcast(watermarks(blocks)), F.lit(True)).withColumn("target", F.when(asks_latest, F.col("latest")).otherwise(F.col("block_number")))
    held = blocks.select(F.col("block_number").alias("target"), (F.length("payload") > 0 if "payload" in blocks.columns else F.lit(True)).alias("good")).distinct()
    status = (
        F.when(F.col("block_number").isNull() & ~F.coalesce("retrieve_latest", F.lit(False)), INVALID_REQUEST)
        .when(F.col("target").isNull(), NOT_FOUND)
        .when(F.col("good"), SUCCESS)
        .when(~F.col("good"), UNKNOWN)
        .when((F.col("target") < F.col("earliest")) | (F.col("target") > F.col("latest")), NOT_AVAILABLE)
        .otherwise(NOT_FOUND)
    )
    return asked.join(held, "target", "left").select("req_id", "target", status.alias("status"))


def header_number(block_items: DataFrame) -> DataFrame:
    """Per block the number in its header: that of its first item, if that is a header (line 1), else null."""
    first = block_items.groupBy("block_number").agg(F.min("item_order").alias("first"))
    return first.select("block_number", F.when(F.col("first.l_linenumber") == 1, F.col("block_number")).alias("header_number"))


def assemble_blocks(block_items: DataFrame) -> DataFrame:
    """Per block its items' parts in order, how many, and whether header (line 1) and a later item are there."""
    return block_items.groupBy("block_number").agg(
        F.count("*").alias("n_items"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "part"))), lambda x: F.concat_ws(":", x["line"].cast("string"), x["part"].cast("string"))), ",").alias("items"),
        ((F.min("line") == 1) & (F.count("*") > 1)).alias("complete"),
    )


def upsert(writes: DataFrame) -> DataFrame:
    """Last writer wins: per block the part of the latest write (arrival, then the item order)."""
    last = writes.groupBy("block_number").agg(F.max(F.struct("arrival", "item_order")).alias("w"))
    return last.select("block_number", F.col("w.item_order.l_partkey").alias("part"), F.col("w.item_order.l_suppkey").alias("session"))


def requests_for_status(spark: SparkSession, d: str) -> DataFrame:
    """The number of every block, as many past the end, and the other forms of request."""
    n = expected(spark, d)
    numbers = n.select(F.col("block_number").alias("req_id"), "block_number").unionByName(n.select((F.col("block_number") + 1_000_000_000).alias("req_id"), (F.col("block_number") + 1_000_000_000).alias("block_number")))
    rows = [(-1, -1, None), (-2, None, True), (-3, None, False), (-4, None, None)]
    return numbers.withColumn("retrieve_latest", F.lit(None).cast("boolean")).unionByName(spark.createDataFrame(rows, "req_id bigint, block_number bigint, retrieve_latest boolean"))


QUERIES = {
    "block_point_lookup": lambda s, d: point_lookup(expected(s, d), 42),
    "cold_point_lookup": lambda s, d: cold_lookup(tiers(expected(s, d))[1], 123),
    "tiered_read": lambda s, d: tiered_read(expected(s, d).select("block_number"), *tiers(present(s, d))),
    "all_blocks_union": lambda s, d: all_blocks(*tiers(present(s, d))),
    "strict_batch_read": lambda s, d: strict_batch_read(expected(s, d), 100, 10).select("block_number"),
    "historical_range": lambda s, d: historical_range(present(s, d), 2, 180),
    "latest_block": lambda s, d: expected(s, d).orderBy(F.desc("block_number")).limit(1),
    "server_status": lambda s, d: server_status(present(s, d)),
    "get_block_status": lambda s, d: block_status(requests_for_status(s, d), present(s, d)),
    "block_header_number": lambda s, d: header_number(items(s, d)),
    "block_assembly": lambda s, d: assemble_blocks(items(s, d)),
    "hot_upsert": lambda s, d: upsert(items(s, d)),
}
CUT = f"(SELECT (max(n) // {BATCH}) * {BATCH} - {HOT_LIMIT} FROM p)"
SQL = {
    "block_point_lookup": "SELECT o_orderkey AS block_number, o_orderdate AS block_ts FROM orders WHERE o_orderkey = 42",
    "cold_point_lookup": f"WITH p AS (SELECT o_orderkey AS n FROM orders) SELECT n AS block_number, (n // {BATCH}) * {BATCH} AS batch_start FROM p WHERE n = 123 AND n < {CUT}",
    "tiered_read": f"WITH {P} SELECT o_orderkey AS block_number, CASE WHEN o_orderkey NOT IN (SELECT n FROM p) THEN 'none' WHEN o_orderkey >= {CUT} THEN 'hot' ELSE 'cold' END AS tier FROM orders",
    "all_blocks_union": f"WITH {P} SELECT n AS block_number, CASE WHEN n >= {CUT} THEN 'hot' ELSE 'cold' END AS tier FROM p",
    "strict_batch_read": "SELECT o_orderkey AS block_number FROM orders WHERE o_orderkey BETWEEN 100 AND 109",
    "historical_range": f"WITH {P} SELECT n AS block_number FROM p WHERE n BETWEEN 2 AND 180 AND n < coalesce((SELECT min(r) FROM unnest(range(2, 181)) AS u(r) WHERE r NOT IN (SELECT n FROM p)), 181)",
    "latest_block": "SELECT o_orderkey AS block_number, o_orderdate AS block_ts FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders)",
    "server_status": "SELECT coalesce(min(l_orderkey), 0) AS first_available_block, coalesce(max(l_orderkey), 0) AS last_available_block, false AS only_latest_state FROM lineitem",
    "get_block_status": f"""WITH {P}, w AS (SELECT min(n) AS lo, max(n) AS hi FROM p), r AS (
        SELECT o_orderkey AS req_id, o_orderkey AS b, NULL::BOOLEAN AS l FROM orders
        UNION ALL SELECT o_orderkey + 1000000000, o_orderkey + 1000000000, NULL FROM orders
        UNION ALL VALUES (-1, -1, NULL), (-2, NULL, true), (-3, NULL, false), (-4, NULL, NULL)),
        t AS (SELECT *, CASE WHEN b = -1 OR (b IS NULL AND l) THEN hi ELSE b END AS target FROM r, w)
        SELECT req_id, target, CASE WHEN b IS NULL AND NOT coalesce(l, false) THEN 'INVALID_REQUEST' WHEN target IS NULL THEN 'NOT_FOUND' WHEN target IN (SELECT n FROM p) THEN 'SUCCESS'
          WHEN target < lo OR target > hi THEN 'NOT_AVAILABLE' ELSE 'NOT_FOUND' END AS status FROM t""",
    "block_header_number": "SELECT l_orderkey AS block_number, CASE WHEN min(l_linenumber) = 1 THEN l_orderkey END AS header_number FROM lineitem GROUP BY l_orderkey",
    "block_assembly": """SELECT l_orderkey AS block_number, count(*) AS n_items, string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS items,
        min(l_linenumber) = 1 AND count(*) > 1 AS complete FROM lineitem GROUP BY l_orderkey""",
    "hot_upsert": """SELECT l_orderkey AS block_number, l_partkey AS part, l_suppkey AS session FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
        ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC) AS r FROM lineitem) WHERE r = 1""",
}
#: Second names of the same queries.
for _k in ("tiered_read", "get_block_status"):
    QUERIES[f"{_k}_all"], SQL[f"{_k}_all"] = QUERIES[_k], SQL[_k]
