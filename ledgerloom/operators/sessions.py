"""A publishing session's whole course: new, primary or behind, acknowledged or timed out, resend to the others.

headers: session, block_number, tick, proof_at (null: cut off before its proof); persisted: block_number, tick.  Times are
whole ticks.  A session that was ended (duplicate, time-out) comes again under a new number, as a new stream does.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.ledger import bucket, table
from ..streaming.jobs import shared_path
from .publish import GROUP_SIZE, GROUPS, fan_out

#: Ticks in a bucket of the running maximum of persisted blocks.
TICKS = 1_000_000


def _stored(df: DataFrame, label: str) -> DataFrame:
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_latest(headers: DataFrame, persisted: DataFrame, width: int = TICKS) -> DataFrame:
    """headers with latest, the largest block persisted strictly before tick (null: none); running maxima in two phases."""
    both = headers.select("tick", F.struct(*headers.columns).alias("h"), F.lit(None).cast("bigint").alias("done")).unionByName(persisted.select("tick", F.col("block_number").alias("done")), allowMissingColumns=True)
    both = both.withColumn("b", bucket(F.col("tick"), width))
    before = both.groupBy("b").agg(F.max("done").alias("m"))
    before = before.select("b", F.max("m").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"))
    here = F.max("done").over(Window.partitionBy("b").orderBy("tick").rangeBetween(Window.unboundedPreceding, -1))
    return both.withColumn("here", here).where("h IS NOT NULL").join(before, "b").select("h.*", F.greatest("here", "earlier").alias("latest"))


def _candidates(open_: DataFrame, persisted: DataFrame, seconds: int) -> DataFrame:
    """What would come of each header if its session became primary there: first proof from then on, acknowledgement
    within seconds after it, else the release of the block."""
    later = Window.partitionBy("block_number", "session").orderBy("tick").rangeBetween(0, Window.unboundedFollowing)
    proofs = open_.select("block_number", "session", "tick", F.min("proof_at").over(later).alias("proof")).distinct()
    p = persisted.select(F.col("block_number").alias("p_block"), F.col("tick").alias("p_at"))
    in_time = (F.col("p_block") == F.col("block_number")) & (F.col("p_at") > F.col("proof")) & (F.col("p_at") <= F.col("proof") + seconds)
    acked = proofs.join(p, in_time, "left").groupBy("block_number", "session", "tick", "proof").agg(F.min("p_at").alias("ack"))
    return acked.withColumn("release", F.when(F.col("ack").isNull(), F.col("proof") + seconds))


def tenures(open_: DataFrame, persisted: DataFrame, seconds: int) -> DataFrame:
    """block_number, winner, start, proof, ack, release of each time that a session was primary for a block.

    The earliest header (ties: the smaller session) wins.  A proof that is not persisted within seconds gives the block
    up: headers from then on elect anew, in a further round over the blocks given up alone.
    """
    left, found = _stored(_candidates(open_, persisted, seconds), "candidates"), []
    while True:
        first = left.groupBy("block_number").agg(F.min(F.struct("tick", "session", "proof", "ack", "release")).alias("w"))
        found.append(_stored(first.select("block_number", F.col("w.session").alias("winner"), F.col("w.tick").alias("start"), "w.proof", "w.ack", "w.release"), "tenures"))
        given_up = found[-1].where("release IS NOT NULL").select("block_number", F.col("release").alias("_from"))
        left = _stored(left.join(given_up, "block_number").where("tick >= _from").drop("_from"), "candidates")
        if left.isEmpty():
            return reduce(DataFrame.unionByName, found)


def session_course(headers: DataFrame, persisted: DataFrame, seconds: int) -> tuple[DataFrame, DataFrame]:
    """(courses, tenures).  courses: each row of headers with state and response.

    A header whose number is not over latest is a duplicate and ends its stream.  Else its session is PRIMARY in its own
    tenure, and BEHIND (SKIP_BLOCK) in another's.  The header whose proof completes the tenure gets ACK or, timed out,
    END_STREAM; a primary header without it has its items dropped and gets nothing.  Null numbers, sessions or times are
    no headers; repeated rows get the same answer.
    """
    whole = headers.select("session", "block_number", "tick", "proof_at").dropna(subset=["session", "block_number", "tick"])
    judged = _stored(with_latest(whole, persisted), "judged").withColumn("duplicate", F.coalesce(F.col("block_number") <= F.col("latest"), F.lit(False)))
    open_ = judged.where("NOT duplicate")
    terms = tenures(open_, persisted, seconds)
    t = terms.withColumnRenamed("block_number", "t_block")
    inside = (F.col("block_number") == F.col("t_block")) & (F.col("tick") >= F.col("start")) & (F.col("release").isNull() | (F.col("tick") < F.col("release")))
    primary = F.col("session") == F.col("winner")
    answered = F.when(~primary, "SKIP_BLOCK").when(F.col("proof_at") == F.col("proof"), F.when(F.col("ack").isNotNull(), "ACK").otherwise("END_STREAM"))
    courses = open_.join(t, inside).select("session", "block_number", "tick", F.when(primary, "PRIMARY").otherwise("BEHIND").alias("state"), answered.alias("response"))
    ended = judged.where("duplicate").select("session", "block_number", "tick", F.lit("DUPLICATE").alias("state"), F.lit("DUPLICATE_BLOCK").alias("response"))
    return courses.unionByName(ended), terms


def resend_to_others(terms: DataFrame, sessions: DataFrame) -> DataFrame:
    """block_number and session of each request to send a timed-out block again: to all of its group (terms: group;
    sessions: session, group) but the one that failed."""
    asked = terms.where("release IS NOT NULL")
    return fan_out(asked, sessions).join(asked.select("block_number", F.col("winner").alias("session")), ["block_number", "session"], "left_anti")


#: The view: offers of neighbouring blocks overlap in time; line 6 has no proof; only items flagged N are persisted.
SECONDS = 5


def _view(s, d):
    rows = table(s, d, "lineitem").select(F.col("l_suppkey").alias("session"), F.col("l_orderkey").alias("block_number"), (F.col("l_orderkey") * 20 + F.col("l_linenumber") * 7).alias("tick"), "l_linenumber", "l_returnflag")
    headers = rows.withColumn("proof_at", F.when(F.col("l_linenumber") != 6, F.col("tick") + 3))
    return headers, headers.where("l_returnflag = 'N' AND proof_at IS NOT NULL").select("block_number", (F.col("proof_at") + 1).alias("tick"))


def _resends(s, d):
    members = table(s, d, "supplier").select(F.col("s_suppkey").alias("session"))
    groups = F.broadcast(members.agg(F.greatest(F.lit(GROUPS), F.expr(f"count(*) DIV {GROUP_SIZE}")).alias("groups")))
    terms = session_course(*_view(s, d), SECONDS)[1].where("release IS NOT NULL")
    placed = (x.join(groups, F.lit(True)).withColumn("group", F.col(n) % F.col("groups")) for x, n in ((terms, "block_number"), (members, "session")))
    return resend_to_others(*placed).distinct()


QUERIES = {
    "session_course": lambda s, d: session_course(*_view(s, d), SECONDS)[0],
    "resend_fanout": _resends,
}
_T = f"""WITH RECURSIVE h AS (SELECT l_suppkey AS session, l_orderkey AS block_number, l_orderkey * 20 + l_linenumber * 7 AS tick, CASE WHEN l_linenumber <> 6 THEN l_orderkey * 20 + l_linenumber * 7 + 3 END AS proof_at, l_returnflag FROM lineitem),
    p AS (SELECT DISTINCT block_number, proof_at + 1 AS tick FROM h WHERE l_returnflag = 'N' AND proof_at IS NOT NULL),
    pm AS (SELECT tick, max(max(block_number)) OVER (ORDER BY tick) AS latest FROM p GROUP BY tick),
    j AS (SELECT h.*, coalesce(h.block_number <= pm.latest, false) AS duplicate FROM h ASOF LEFT JOIN pm ON h.tick > pm.tick),
    c1 AS (SELECT DISTINCT block_number, session, tick, min(proof_at) OVER (PARTITION BY block_number, session ORDER BY tick RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS proof FROM j WHERE NOT duplicate),
    c AS (SELECT c1.block_number, session, c1.tick, proof, min(p.tick) AS ack, CASE WHEN min(p.tick) IS NULL THEN proof + {SECONDS} END AS release FROM c1 LEFT JOIN p ON c1.block_number = p.block_number AND p.tick > proof AND p.tick <= proof + {SECONDS} GROUP BY 1, 2, 3, 4),
    t AS (SELECT block_number, min(row(tick, session, proof, ack, release)) AS w FROM c GROUP BY 1
      UNION ALL SELECT c.block_number, min(row(c.tick, c.session, c.proof, c.ack, c.release)) FROM c JOIN t ON c.block_number = t.block_number AND c.tick >= t.w[5] GROUP BY 1),
    u AS (SELECT block_number, w[1] AS start, w[2] AS winner, w[3] AS proof, w[4] AS ack, w[5] AS release FROM t)"""
SQL = {
    "session_course": f"""{_T} SELECT session, j.block_number, tick, CASE WHEN session = winner THEN 'PRIMARY' ELSE 'BEHIND' END AS state,
        CASE WHEN session <> winner THEN 'SKIP_BLOCK' WHEN proof_at = proof THEN CASE WHEN ack IS NOT NULL THEN 'ACK' ELSE 'END_STREAM' END END AS response
        FROM j JOIN u ON j.block_number = u.block_number AND tick >= start AND (release IS NULL OR tick < release) WHERE NOT duplicate
        UNION ALL SELECT session, block_number, tick, 'DUPLICATE', 'DUPLICATE_BLOCK' FROM j WHERE duplicate""",
    "resend_fanout": f"""{_T}, g AS (SELECT greatest({GROUPS}, count(*) // {GROUP_SIZE}) AS g FROM supplier), f AS (SELECT DISTINCT block_number, winner FROM u WHERE release IS NOT NULL)
        SELECT DISTINCT f.block_number, s_suppkey AS session FROM f, g, supplier WHERE f.block_number % g = s_suppkey % g AND NOT EXISTS (SELECT 1 FROM f AS x WHERE x.block_number = f.block_number AND x.winner = s_suppkey)""",
}
