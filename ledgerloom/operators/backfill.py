"""Backfill: which peer fills which gap, gap filling and continuous following."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.ledger import expected, present
from .contiguity import GAPS, containing_ranges, effective_gaps, gap_ranges

#: Attempts at a peer, and the first wait in seconds, doubled for each further attempt.
ATTEMPTS, FIRST_WAIT = 3, 1
#: Peers that are compared with every gap.
MAX_PEERS = 10_000
_PEERS = [("peer-a", 0, 1000, 1), ("peer-b", 500, 10**9, 2), ("peer-c", 0, 10**9, 3)]


def waits(attempts: int = ATTEMPTS, first: int = FIRST_WAIT) -> list[int]:
    return [first * 2**k for k in range(attempts)]


def shuffled_peers(peers: DataFrame, seed: int) -> DataFrame:
    """Peers in a random but repeatable order."""
    return peers.orderBy(F.xxhash64("peer", F.lit(seed)))


def eligible(gaps: DataFrame, peers: DataFrame) -> DataFrame:
    """gap_start, gap_end, peer, peer_order of every peer that says it has all of a gap.

    Peers are compared with each gap by a broadcast while they are at most MAX_PEERS, which is checked; more are refused.
    """
    if len(peers.limit(MAX_PEERS + 1).collect()) > MAX_PEERS:
        raise ValueError(f"more than {MAX_PEERS} peers")
    p = F.broadcast(peers.withColumnRenamed("order", "peer_order"))
    return gaps.join(p, (F.col("first_available") <= F.col("gap_start")) & (F.col("last_available") >= F.col("gap_end"))).select("gap_start", "gap_end", "peer", "peer_order")


def match_peers(gaps: DataFrame, peers: DataFrame) -> DataFrame:
    """Each gap with the first peer, by order, that has all of it (null: none has)."""
    first = eligible(gaps, peers).groupBy("gap_start", "gap_end").agg(F.min_by("peer", "peer_order").alias("peer"))
    return gaps.select("gap_start", "gap_end").join(first, ["gap_start", "gap_end"], "left")


def fail_over(gaps: DataFrame, peers: DataFrame, served: DataFrame, attempts: int = ATTEMPTS) -> DataFrame:
    """gap_start, gap_end, peer and tried: the first eligible peer, by order, that really serves all blocks of a gap
    (served: peer, block_number), and how many attempts it took; a peer that fails is tried attempts times before the
    next.  Null: none serves it; tried then counts all attempts at all peers, or is 0."""
    asked = eligible(gaps, peers)
    blocks = served.select("peer", F.col("block_number").alias("n")).distinct()
    inside = containing_ranges(blocks, gaps.select("gap_start", "gap_end")).groupBy("peer", "gap_start", "gap_end").agg(F.count("*").alias("n"))
    tries = asked.join(inside, ["peer", "gap_start", "gap_end"], "left").withColumn("good", F.coalesce(F.col("n") == F.col("gap_end") - F.col("gap_start") + 1, F.lit(False)))
    order = Window.partitionBy("gap_start", "gap_end").orderBy("peer_order")
    tries = tries.withColumn("failed", F.row_number().over(order) - 1)
    first = tries.groupBy("gap_start", "gap_end").agg(F.min_by(F.when(F.col("good"), F.struct("peer", "failed")), F.when(F.col("good"), F.col("peer_order"))).alias("w"), F.count("*").alias("all"))
    tried = F.when(F.col("w").isNotNull(), F.col("w.failed") * attempts + 1).otherwise(F.coalesce("all", F.lit(0)) * attempts)
    return gaps.select("gap_start", "gap_end").join(first, ["gap_start", "gap_end"], "left").select("gap_start", "gap_end", F.col("w.peer").alias("peer"), tried.cast("bigint").alias("tried"))


def fill_gaps(blocks: DataFrame, peer_blocks: DataFrame, start: int = 0) -> DataFrame:
    """Blocks of the peer that lie in a gap of blocks from start on."""
    gaps = effective_gaps(gap_ranges(blocks), start)
    return containing_ranges(peer_blocks.select(F.col("block_number").alias("n")), gaps).select(F.col("n").alias("block_number"))


def follow(blocks: DataFrame, peer_blocks: DataFrame) -> DataFrame:
    """Blocks of the peer after the latest here; none if the peer lacks the very next."""
    latest = blocks.agg(F.coalesce(F.max("block_number"), F.lit(-1)).alias("latest"))
    new = peer_blocks.join(F.broadcast(latest), F.col("block_number") > F.col("latest"))
    begins = new.agg(F.min(F.col("block_number") - F.col("latest")).alias("d"))
    return new.join(F.broadcast(begins.where("d = 1")), F.lit(True)).select("block_number")


def peers(s: SparkSession) -> DataFrame:
    return s.createDataFrame(_PEERS, "peer string, first_available bigint, last_available bigint, order int")


def _served(s, d) -> DataFrame:
    """What each peer really has: peer-a nothing, peer-b all blocks but those divisible by 1000, peer-c all."""
    n = expected(s, d).select("block_number")
    return n.where("block_number % 1000 <> 0").select(F.lit("peer-b").alias("peer"), "block_number").unionByName(n.select(F.lit("peer-c").alias("peer"), "block_number"))


QUERIES = {
    "gap_fail_over": lambda s, d: fail_over(gap_ranges(present(s, d)).drop("gap_length"), peers(s), _served(s, d)),
    "gap_peer_match": lambda s, d: match_peers(gap_ranges(present(s, d)).drop("gap_length"), peers(s)),
    "backfill_gap_fill": lambda s, d: fill_gaps(present(s, d), expected(s, d), 200),
    "backfill_continuous": lambda s, d: follow(present(s, d).where("block_number < 700").unionByName(s.createDataFrame([(699,)], "block_number bigint")), expected(s, d).select("block_number")),
}
SQL = {
    "gap_fail_over": f"""WITH {GAPS}, pe AS (SELECT * FROM (VALUES ('peer-a', 0, 1000, 1), ('peer-b', 500, 1000000000, 2), ('peer-c', 0, 1000000000, 3)) AS t(peer, lo, hi, o)),
        se AS (SELECT 'peer-b' AS peer, o_orderkey AS n FROM orders WHERE o_orderkey % 1000 <> 0 UNION ALL SELECT 'peer-c', o_orderkey FROM orders),
        el AS (SELECT gap_start, gap_end, peer, o, row_number() OVER (PARTITION BY gap_start, gap_end ORDER BY o) - 1 AS failed FROM g JOIN pe ON lo <= gap_start AND hi >= gap_end),
        ok AS (SELECT el.*, (SELECT count(*) FROM se WHERE se.peer = el.peer AND n BETWEEN gap_start AND gap_end) = gap_end - gap_start + 1 AS good FROM el)
        SELECT gap_start, gap_end, arg_min(peer, o) FILTER (WHERE good) AS peer, (CASE WHEN bool_or(good) THEN min(failed) FILTER (WHERE good) * 3 + 1 ELSE count(*) * 3 END)::BIGINT AS tried FROM ok GROUP BY 1, 2""",
    "gap_peer_match": f"WITH {GAPS} SELECT gap_start, gap_end, CASE WHEN gap_end <= 1000 THEN 'peer-a' WHEN gap_start >= 500 THEN 'peer-b' ELSE 'peer-c' END AS peer FROM g",
    "backfill_gap_fill": f"WITH {GAPS} SELECT o_orderkey AS block_number FROM orders JOIN g ON o_orderkey BETWEEN greatest(gap_start, 200) AND gap_end",
    "backfill_continuous": "SELECT o_orderkey AS block_number FROM orders WHERE o_orderkey >= 700",
}
