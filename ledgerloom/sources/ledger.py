"""The ledger view: blocks, items, sessions, state changes and entities over the star-schema tables.

=================  ==========================================================================================
blocks expected    orders: block_number = o_orderkey, block_ts = o_orderdate
blocks present     distinct lineitem.l_orderkey
block items        lineitem, ordered by line number, part, supplier and the other columns
publishing         lineitem: session = l_suppkey, arrival = l_shipdate
state changes      events: key = user_id, order (ts, event_id); ``error`` deletes, others update; signup pushes to
                   the receipt queue, purchase pops
metric samples     events: value by event_type over ts
accounts, ...      customer, supplier, part, orders, documents, pages
=================  ==========================================================================================
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Blocks in an archive batch; blocks that stay hot.
BATCH, HOT_LIMIT = 100, 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(c: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {c})")


def expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("block_number"), F.col("o_orderdate").alias("block_ts"))


def present(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("block_number")).distinct()


def bucket(n: Column, size: int = BATCH) -> Column:
    """The first number of n's batch."""
    return (F.floor(n / size) * size).cast("bigint")


def cold_start(blocks: DataFrame, hot_limit: int = HOT_LIMIT, batch: int = BATCH) -> DataFrame:
    """One row: the first hot block, such that at least hot_limit numbers stay hot."""
    return blocks.agg((bucket(F.max("block_number"), batch) - hot_limit).alias("hot_from"))


def tiers(blocks: DataFrame, hot_limit: int = HOT_LIMIT, batch: int = BATCH) -> tuple[DataFrame, DataFrame]:
    """(hot, cold): cold blocks carry their batch_start, by which their files are partitioned."""
    cut = F.broadcast(cold_start(blocks, hot_limit, batch))
    placed = blocks.join(cut, F.lit(True))
    hot = placed.where("block_number >= hot_from").select("block_number")
    cold = placed.where("block_number < hot_from").select("block_number", bucket(F.col("block_number"), batch).alias("batch_start"))
    return hot, cold


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """block_number, session, arrival and a struct that orders a block's items totally (equal rows apart)."""
    li = table(spark, sf_dir, "lineitem")
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    return li.select(F.col("l_orderkey").alias("block_number"), F.col("l_suppkey").alias("session"), F.col("l_shipdate").alias("arrival"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_quantity").alias("quantity"), order.alias("item_order"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("update").alias("op"), "event_type", "value")
