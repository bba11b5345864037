"""Current state from change logs: last value by key, resuming, and first-in-first-out queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.ledger import changes


def latest_changes(log: DataFrame) -> DataFrame:
    """key, ts, seq, op, value of the last change by (ts, seq) of every key, deletes included: what a later batch needs,
    as a change that comes late must not bring a deleted key back.

    One hash aggregation with partial sums: a hot key sends one row a task.
    """
    return log.groupBy("key").agg(F.max(F.struct("ts", "seq", "op", "value")).alias("c")).select("key", "c.*")


def visible(latest: DataFrame) -> DataFrame:
    """key, ts, seq, value of the keys whose last change is no delete."""
    return latest.where("op <> 'delete'").select("key", "ts", "seq", "value")


def snapshot(log: DataFrame) -> DataFrame:
    """key, ts, seq, value of the last change by (ts, seq) of every key whose last change is no delete."""
    return visible(latest_changes(log))


def resume(latest: DataFrame, log: DataFrame, last_processed: int | None = None) -> DataFrame:
    """latest, the latest changes up to seq last_processed, brought forward by the later ones of log, late ones included;
    without a number, all of log is taken: changes it has already do nothing."""
    new = log.select("key", "ts", "seq", "op", "value")
    return latest_changes(latest.select("key", "ts", "seq", "op", "value").unionByName(new if last_processed is None else new.where(F.col("seq") > last_processed)))


def queue_depths(ops: DataFrame) -> DataFrame:
    """Per queue: pushed, popped and depth after all ops (queue, ts, seq, push) in order; a pop of an empty queue does nothing.

    The depth is the balance of pushes and pops less its running minimum under zero.
    """
    w = Window.partitionBy("queue").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    sums = ops.select("queue", "ts", "seq", "push", F.sum(F.when(F.col("push"), 1).otherwise(-1)).over(w).alias("b"))
    ends = sums.groupBy("queue").agg(F.count_if("push").alias("pushed"), F.max_by("b", F.struct("ts", "seq")).alias("b"), F.least(F.min("b"), F.lit(0)).alias("low"))
    depth = F.col("b") - F.col("low")
    return ends.select("queue", "pushed", (F.col("pushed") - depth).alias("popped"), depth.alias("depth"))


def queue_pops(ops: DataFrame) -> DataFrame:
    """Each pop that finds something, with the push it takes out: the k-th effective pop takes the k-th push."""
    w = Window.partitionBy("queue").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    b = ops.select("*", F.sum(F.when(F.col("push"), 1).otherwise(-1)).over(w).alias("b"))
    b = b.withColumn("low", F.least(F.min("b").over(w), F.lit(0)))
    b = b.withColumn("idle", ~F.col("push") & (F.col("low") < F.coalesce(F.lag("low").over(Window.partitionBy("queue").orderBy("ts", "seq")), F.lit(0))))
    ranked = b.where("NOT idle").withColumn("k", F.row_number().over(Window.partitionBy("queue", "push").orderBy("ts", "seq")))
    pushes, pops = ranked.where("push").select("queue", "k", F.col("seq").alias("push_seq")), ranked.where("NOT push").select("queue", "k", F.col("seq").alias("pop_seq"))
    return pops.join(pushes, ["queue", "k"]).select("queue", "push_seq", "pop_seq")


def _queue(s, d):
    return changes(s, d).where("event_type IN ('signup', 'purchase')").select(F.col("key").alias("queue"), "ts", "seq", (F.col("event_type") == "signup").alias("push"))


QUERIES = {
    "state_snapshot": lambda s, d: snapshot(changes(s, d)),
    "state_resume": lambda s, d: visible(resume(latest_changes(changes(s, d).where("seq <= 5000")), changes(s, d), 5000)),
    "queue_fifo": lambda s, d: queue_depths(_queue(s, d)),
    "queue_pop_matches": lambda s, d: queue_pops(_queue(s, d)),
}
_SNAP = """SELECT user_id AS key, ts, event_id AS seq, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'error'"""
_Q = """o AS (SELECT user_id AS queue, ts, event_id AS seq, event_type = 'signup' AS push FROM events WHERE event_type IN ('signup', 'purchase')),
    b AS (SELECT *, sum(CASE WHEN push THEN 1 ELSE -1 END) OVER w AS b FROM o WINDOW w AS (PARTITION BY queue ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
    m AS (SELECT *, least(0, min(b) OVER (PARTITION BY queue ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)) AS low FROM b)"""
SQL = {
    "state_snapshot": _SNAP,
    "state_resume": _SNAP,
    "queue_fifo": f"""WITH {_Q}, e AS (SELECT queue, count_if(push)::BIGINT AS pushed, arg_max(b, row(ts, seq)) AS b, min(low) AS low FROM m GROUP BY queue)
        SELECT queue, pushed, (pushed - (b - low))::BIGINT AS popped, (b - low)::BIGINT AS depth FROM e""",
    "queue_pop_matches": f"""WITH {_Q}, i AS (SELECT *, NOT push AND low < coalesce(lag(low) OVER (PARTITION BY queue ORDER BY ts, seq), 0) AS idle FROM m),
        k AS (SELECT *, row_number() OVER (PARTITION BY queue, push ORDER BY ts, seq) AS k FROM i WHERE NOT idle)
        SELECT a.queue, b.seq AS push_seq, a.seq AS pop_seq FROM k a JOIN k b ON a.queue = b.queue AND a.k = b.k AND NOT a.push AND b.push""",
}
