"""Publishing: first-writer election, outcomes, acknowledgement, item timing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.ledger import expected, items, micros, table
from .contiguity import WIDTH, bucket

#: How long an acknowledgement may take, and how far behind the latest block winners are remembered.
ACK_SECONDS, RETENTION = 60, 1000
#: Least number of session groups when all blocks are fanned out, and sessions in a group beyond that.
GROUPS, GROUP_SIZE = 5, 10


def race_winners(offers: DataFrame) -> DataFrame:
    """Per block the session whose offer came first (ties: the item order): it publishes, the others skip."""
    first = offers.groupBy("block_number").agg(F.min(F.struct("arrival", "item_order", "session")).alias("w"), F.count_distinct("session").alias("n"))
    return first.select("block_number", F.col("w.session").alias("winner"), (F.col("n") - 1).alias("n_behind"))


def outcomes(headers: DataFrame, width: int = WIDTH) -> DataFrame:
    """seq, block_number, latest and outcome of each header in order of seq.

    A header whose number is not over all earlier ones is DUPLICATE_BLOCK, else ACCEPTED; latest is the largest number
    before it.  The running maximum is taken within buckets of seq, and over the buckets' maxima.
    """
    b = headers.select("seq", "block_number", bucket(F.col("seq"), width).alias("b"))
    before = b.groupBy("b").agg(F.max("block_number").alias("m"))
    before = before.select("b", F.max("m").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)).alias("m_before"))
    inner = b.withColumn("m_in", F.max("block_number").over(Window.partitionBy("b").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)))
    latest = F.greatest("m_in", "m_before")
    return inner.join(before, "b").select("seq", "block_number", latest.alias("latest"), F.when(F.col("block_number") <= latest, "DUPLICATE_BLOCK").otherwise("ACCEPTED").alias("outcome"))


def retained_winners(winners: DataFrame, latest: int | None = None, threshold: int = RETENTION) -> DataFrame:
    """Winners of blocks not more than threshold behind the latest; all, while latest is at most threshold."""
    last = winners.agg(F.max("block_number").alias("latest")) if latest is None else winners.sparkSession.range(1).select(F.lit(latest).alias("latest"))
    return winners.join(F.broadcast(last), (F.col("latest") <= threshold) | (F.col("block_number") >= F.col("latest") - threshold)).drop("latest")


def correlate_acks(sent: DataFrame, persisted: DataFrame, seconds: int = ACK_SECONDS) -> DataFrame:
    """sent (key, id, ts) with the first persisted (key, ts) of its key after it and within seconds; null: resend."""
    p = persisted.select(F.col("key").alias("p_key"), F.col("ts").alias("p_ts"))
    late = F.expr(f"ts + INTERVAL '{seconds}' SECOND")
    both = sent.join(p, (F.col("key") == F.col("p_key")) & (F.col("p_ts") > F.col("ts")) & (F.col("p_ts") <= late), "left")
    return both.groupBy("key", "id").agg(F.min("p_ts").alias("ack_ts")).select("key", "id", "ack_ts", F.when(F.col("ack_ts").isNull(), "RESEND").otherwise("ACK").alias("response"))


def fan_out(acks: DataFrame, sessions: DataFrame) -> DataFrame:
    """Every active session hears of every acknowledged block of its group: (block_number, group) by (session, group)."""
    return acks.join(sessions, "group").select("block_number", "session")


def claim(events: DataFrame, cache: DataFrame) -> DataFrame:
    """Events with the payload their key claims; events whose entry is gone keep a null payload."""
    return events.join(cache, "cache_key", "left")


def header_to_proof(timed: DataFrame) -> DataFrame:
    """Per block the microseconds from its first to its last item."""
    return timed.groupBy("block_number").agg((F.max("at") - F.min("at")).alias("micros"))


def inter_arrival(timed: DataFrame, by: str) -> DataFrame:
    """Per group: how many deltas between neighbours in time, and their mean in microseconds."""
    delta = F.col("at") - F.lag("at").over(Window.partitionBy(by).orderBy("at"))
    return timed.select(by, delta.alias("d")).where("d IS NOT NULL").groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg("d"), 4).alias("mean_micros"))


def _sent(s, d, kind):
    return table(s, d, "events").where(F.col("event_type") == kind).select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), "ts")


def _fan_out_all(s, d):
    """All blocks; the number of groups grows with the sessions, so a block has a bounded number of receivers."""
    sessions = table(s, d, "supplier").select(F.col("s_suppkey").alias("session"))
    groups = F.broadcast(sessions.agg(F.greatest(F.lit(GROUPS), F.expr(f"count(*) DIV {GROUP_SIZE}")).alias("groups")))
    acks, members = (x.join(groups, F.lit(True)).withColumn("group", F.col(n) % F.col("groups")).select(n, "group") for x, n in ((expected(s, d), "block_number"), (sessions, "session")))
    return fan_out(acks, members)


QUERIES = {
    "publish_race_winner": lambda s, d: race_winners(items(s, d)),
    "publish_outcomes": lambda s, d: outcomes(table(s, d, "events").select(F.col("event_id").alias("seq"), F.floor(F.col("event_id") / 2 + F.col("user_id") % 7).alias("block_number"))),
    "winner_retention": lambda s, d: retained_winners(race_winners(items(s, d))),
    "ack_correlation": lambda s, d: correlate_acks(_sent(s, d, "click"), _sent(s, d, "view").drop("id"), 3600),
    "ack_fanout": _fan_out_all,
    "ack_fanout_all": _fan_out_all,
    "claim_check_join": lambda s, d: claim(table(s, d, "events").select("event_id", F.col("user_id").alias("cache_key")), table(s, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("cache_key"), F.col("c_name").alias("payload"))),
    "header_to_proof": lambda s, d: header_to_proof(items(s, d).select("block_number", micros("arrival").alias("at"))),
    "inter_block_time": lambda s, d: inter_arrival(table(s, d, "events").select("user_id", micros("ts").alias("at")), "user_id"),
}
_W = """wn AS (SELECT l_orderkey AS block_number, arg_min(l_suppkey, row(l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)) AS winner, count(DISTINCT l_suppkey) - 1 AS n_behind FROM lineitem GROUP BY 1)"""
SQL = {
    "publish_race_winner": f"WITH {_W} SELECT * FROM wn",
    "publish_outcomes": """WITH h AS (SELECT event_id AS seq, floor(event_id / 2 + user_id % 7)::BIGINT AS block_number FROM events),
        m AS (SELECT *, max(block_number) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM h)
        SELECT seq, block_number, latest, CASE WHEN block_number <= latest THEN 'DUPLICATE_BLOCK' ELSE 'ACCEPTED' END AS outcome FROM m""",
    "winner_retention": f"WITH {_W}, x AS (SELECT max(block_number) AS l FROM wn) SELECT wn.* FROM wn, x WHERE l <= {RETENTION} OR block_number >= l - {RETENTION}",
    "ack_correlation": """SELECT a.user_id AS key, a.event_id AS id, min(b.ts) AS ack_ts, CASE WHEN min(b.ts) IS NULL THEN 'RESEND' ELSE 'ACK' END AS response FROM events a LEFT JOIN events b
        ON b.event_type = 'view' AND a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 3600 SECOND WHERE a.event_type = 'click' GROUP BY 1, 2""",
    "ack_fanout": f"WITH c AS (SELECT greatest({GROUPS}, count(*) // {GROUP_SIZE}) AS g FROM supplier) SELECT o_orderkey AS block_number, s_suppkey AS session FROM c, orders, supplier WHERE o_orderkey % g = s_suppkey % g",
    "claim_check_join": "SELECT user_id AS cache_key, event_id, c_name AS payload FROM events LEFT JOIN customer ON user_id = c_custkey AND c_custkey % 2 = 0",
    "header_to_proof": "SELECT l_orderkey AS block_number, date_diff('microsecond', min(l_shipdate), max(l_shipdate)) AS micros FROM lineitem GROUP BY 1",
    "inter_block_time": """SELECT user_id, count(*) AS n, round(avg(d), 4) AS mean_micros FROM (SELECT user_id, date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts), ts) AS d FROM events)
        WHERE d IS NOT NULL GROUP BY 1""",
}
#: A second name of the same query.
SQL["ack_fanout_all"] = SQL["ack_fanout"]
