"""Structured Streaming forms of the ledger operators.

Each takes a streaming DataFrame and returns one; ``drained`` runs one over all input there is and gives the result as a
table in the shared folder.  State is keyed by block, key or session, and bounded by a watermark where time passes.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.archive import archive_plan
from ..operators.contiguity import gap_ranges, split_intervals
from ..operators.state import latest_changes, resume, visible
from ..sources.ledger import BATCH, HOT_LIMIT, table


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder all executors share (spark.checkpoint.dir); where that is unset, a temporary one if the
    executors are threads of this machine, else an error."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = f"file://{tempfile.mkdtemp(prefix='ledgerloom-')}"
    path = f"{top.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def source(spark: SparkSession, sf_dir: str, name: str, max_files: int = 64) -> DataFrame:
    """A table as a stream of its files; at most max_files a micro-batch keeps batches bounded."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(f"{sf_dir}/{name}.parquet*")


def drained(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """The result of stream over the input there is.  In complete mode each micro-batch replaces the last."""
    spark, path = stream.sparkSession, shared_path(stream.sparkSession, label)
    writer = stream.writeStream.option("checkpointLocation", f"{path}-log").trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        query = writer.format("parquet").option("path", path).start()
    else:
        query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def tail(blocks: DataFrame, start: int) -> DataFrame:
    """Blocks from start on, as they come."""
    return blocks.where(F.col("block_number") >= start)


def deduplicated(events: DataFrame, keys: list[str], ts: str = "ts", delay: str | None = None) -> DataFrame:
    """One event of each key, the first to come, whatever the order and number of micro-batches; the state is the keys.

    With a delay state is kept for that long behind the latest time only, for input that comes in order of time: older
    events are dropped as late, and a key that comes again after its state has gone is given again.
    """
    if delay is None:
        return events.dropDuplicates(keys)
    return events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay).dropDuplicatesWithinWatermark(keys).drop("_ts")


def election(offers: DataFrame) -> DataFrame:
    """Per block the session of the earliest offer (ties: the smaller session), over all micro-batches."""
    first = offers.groupBy("block_number").agg(F.min(F.struct("arrival", "session")).alias("w"))
    return first.select("block_number", F.col("w.session").alias("winner"))


def assembly(items: DataFrame) -> DataFrame:
    """Per block its number of items, and whether the header (line 1) and a later item are there."""
    return items.groupBy("block_number").agg(F.count("*").alias("n_items"), ((F.min("line") == 1) & (F.count("*") > 1)).alias("complete"))


def acknowledged(sent: DataFrame, persisted: DataFrame, seconds: int = 60, delay: str = "10 minutes") -> DataFrame:
    """sent (key, ts) left-joined with persisted (key, ts) after it and within seconds; unmatched ones come with a null
    ack_ts when the watermark has passed them."""
    a = sent.select("key", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", delay)
    b = persisted.select(F.col("key").alias("b_key"), F.col("ts").cast("timestamp").alias("ack_ts")).withWatermark("ack_ts", delay)
    return a.join(b, F.expr(f"key = b_key AND ack_ts > ts AND ack_ts <= ts + INTERVAL {seconds} SECONDS"), "leftOuter").select("key", "ts", "ack_ts")


def session_outcomes(headers: DataFrame) -> DataFrame:
    """session, seq, block_number, outcome: a session's header not over its largest accepted one is DUPLICATE_BLOCK.

    headers: session, seq, block_number; within a micro-batch by seq.  State: one number a session.
    """

    def judge(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        latest = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values("seq")
        numbers = rows["block_number"].to_numpy()
        largest = np.maximum.accumulate(numbers if latest is None else np.append(latest, numbers))
        duplicate = numbers <= (np.append(numbers[0] - 1, largest[:-1]) if latest is None else largest[:-1])
        state.update((int(largest[-1]),))
        yield pd.DataFrame({"session": key[0], "seq": rows["seq"], "block_number": numbers, "outcome": np.where(duplicate, "DUPLICATE_BLOCK", "ACCEPTED")})

    kind = "session bigint, seq bigint, block_number bigint, outcome string"
    return headers.groupBy("session").applyInPandasWithState(judge, kind, "latest bigint", "append", GroupStateTimeout.NoTimeout)


def fold_state(log: DataFrame, path: str) -> DataFrame:
    """Folds a stream of changes (key, ts, seq, op, value) into the latest changes under path, one folder a micro-batch,
    and gives the state that is visible at the end.

    A batch starts from the folder of the one before and overwrites its own, so running it again changes nothing.
    Deletes are kept as changes: an older update that comes in a later batch does not bring the key back.
    """
    spark = log.sparkSession

    def fold(batch: DataFrame, batch_id: int) -> None:
        new = latest_changes(batch) if batch_id == 0 else resume(spark.read.parquet(f"{path}/{batch_id - 1}"), batch)
        new.write.mode("overwrite").parquet(f"{path}/{batch_id}")

    query = log.writeStream.option("checkpointLocation", f"{path}/log").trigger(availableNow=True).foreachBatch(fold).start()
    query.awaitTermination()
    done = query.lastProgress["batchId"] if query.lastProgress else -1
    while done >= 0 and not _there(spark, f"{path}/{done}"):  # a last, empty batch is not folded
        done -= 1
    return visible(spark.read.parquet(f"{path}/{done}")) if done >= 0 else visible(spark.createDataFrame([], log.schema))


def _there(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def live_writer(blocks: DataFrame, path: str, start: int = 0) -> None:
    """Persists a stream of blocks (block_number and more): each micro-batch n writes its blocks, the gaps that are left and
    the watermarks together, as blocks/<n>, gaps/<n> and, last, marks/<n>; a reader takes the last n that has marks.

    Gaps come from those of n - 1 without what has come, and from the holes above the latest block: the blocks before are
    not read.  marks: earliest, latest, highest_contiguous.  Running a micro-batch again changes nothing; blocks that come
    again change no gap; empty micro-batches carry the marks on.
    """
    spark = blocks.sparkSession

    def step(new: DataFrame, n: int) -> None:
        new.dropDuplicates(["block_number"]).write.mode("overwrite").parquet(f"{path}/blocks/{n}")
        written = spark.read.schema(new.schema).parquet(f"{path}/blocks/{n}").select("block_number")
        before = spark.read.parquet(f"{path}/marks/{n - 1}").first() if n else (None, None, start - 1)
        top = start - 1 if before[1] is None else max(before[1], start - 1)
        gaps = gap_ranges(written.where(F.col("block_number") > top), top + 1).select(F.col("gap_start").alias("s"), F.col("gap_end").alias("e"))
        if n:
            gaps = gaps.unionByName(split_intervals(spark.read.parquet(f"{path}/gaps/{n - 1}"), written.select(F.col("block_number").alias("n"))))
        gaps.write.mode("overwrite").parquet(f"{path}/gaps/{n}")
        ends = written.agg(F.least(F.min("block_number"), F.lit(before[0]).cast("bigint")).alias("earliest"), F.greatest(F.max("block_number"), F.lit(before[1]).cast("bigint")).alias("latest"))
        first_gap = spark.read.schema("s bigint, e bigint").parquet(f"{path}/gaps/{n}").agg(F.min("s").alias("s"))
        marks = ends.join(first_gap, F.lit(True)).select("earliest", "latest", F.coalesce(F.col("s") - 1, F.greatest("latest", F.lit(start - 1))).cast("bigint").alias("highest_contiguous"))
        marks.write.mode("overwrite").parquet(f"{path}/marks/{n}")

    blocks.writeStream.option("checkpointLocation", f"{path}/log").trigger(availableNow=True).foreachBatch(step).start().awaitTermination()


def written_state(spark: SparkSession, path: str) -> DataFrame:
    """One row of a live writer's folder: earliest, latest, highest_contiguous, n_gaps, n_missing; no row before the first write."""
    n = 0
    while _there(spark, f"{path}/marks/{n}/_SUCCESS"):
        n += 1
    if not n:
        return spark.createDataFrame([], "earliest bigint, latest bigint, highest_contiguous bigint, n_gaps bigint, n_missing bigint")
    gaps = spark.read.parquet(f"{path}/gaps/{n - 1}").agg(F.count("*").alias("n_gaps"), F.coalesce(F.sum(F.expr("e - s + 1")), F.lit(0)).alias("n_missing"))
    return spark.read.parquet(f"{path}/marks/{n - 1}").join(gaps, F.lit(True))


def archiver(blocks: DataFrame, path: str, hot_limit: int, batch: int) -> None:
    """Persists a stream of blocks (block_number and more) and archives behind it: each micro-batch writes the hot tier
    anew as hot/<n>, without what it moves to cold/<n>, in folders of its own.

    Both folders come from the hot folder before and the micro-batch, so running one again changes nothing; a reader takes
    the last hot folder and all cold ones.  Complete batches move while the span of hot numbers stays over hot_limit.
    """
    spark = blocks.sparkSession

    def step(new: DataFrame, n: int) -> None:
        hot = new if n == 0 else spark.read.parquet(f"{path}/hot/{n - 1}").unionByName(new)
        hot = hot.dropDuplicates(["block_number"])
        if n:  # blocks that come again after they were archived
            hot = hot.join(spark.read.parquet(*(f"{path}/cold/{k}" for k in range(n))).select("block_number"), "block_number", "left_anti")
        plan = archive_plan(hot, hot_limit, batch).select("first_block", F.explode(F.sequence("first_block", "last_block")).alias("block_number"))
        hot.join(plan, "block_number").withColumnRenamed("first_block", "batch_start").repartition("batch_start").sortWithinPartitions("block_number").write.mode("overwrite").parquet(f"{path}/cold/{n}")
        hot.join(plan, "block_number", "left_anti").write.mode("overwrite").parquet(f"{path}/hot/{n}")

    blocks.writeStream.option("checkpointLocation", f"{path}/log").trigger(availableNow=True).foreachBatch(step).start().awaitTermination()


def subscribed(spark: SparkSession, history: DataFrame, live: DataFrame, start: int, label: str = "subscribed") -> DataFrame:
    """Blocks from start on: those of history, then those that the live stream brings after the latest of history.

    The hand-over is by number: what both have comes from history, so nothing is missing or given twice.
    """
    latest = history.agg(F.max("block_number")).first()[0]
    old = history.where(F.col("block_number") >= start)
    new = drained(tail(live, start if latest is None else max(start, latest + 1)).dropDuplicates(["block_number"]), label)
    return old.unionByName(new.select(old.columns))


def _events(s, d):
    return source(s, d, "events").select(F.col("event_id").alias("block_number"), F.col("user_id").alias("session"), "event_type", "ts")


def _items(s, d):
    return source(s, d, "lineitem").select(F.col("l_orderkey").alias("block_number"), F.col("l_suppkey").alias("session"), F.col("l_shipdate").alias("arrival"), F.col("l_linenumber").alias("line"))


def _changes(s, d):
    e = source(s, d, "events")
    return e.select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("update").alias("op"), "value")


def _history_then_live(s, d):
    old = table(s, d, "orders").select(F.col("o_orderkey").alias("block_number"), F.lit("history").alias("source")).where("block_number < 1000")
    return subscribed(s, old, source(s, d, "orders").select(F.col("o_orderkey").alias("block_number"), F.lit("live").alias("source")), 500)


def _archived(s, d):
    path = shared_path(s, "archiver")
    archiver(source(s, d, "orders").select(F.col("o_orderkey").alias("block_number")), path, HOT_LIMIT, BATCH)
    cold = s.read.schema("block_number bigint, batch_start bigint").option("recursiveFileLookup", True).parquet(f"{path}/cold")
    return cold.groupBy("batch_start").agg(F.count("*").alias("n_blocks"), F.min("block_number").alias("first_block"), F.max("block_number").alias("last_block"))


def _written(s, d):
    path = shared_path(s, "live")
    live_writer(source(s, d, "lineitem").select(F.col("l_orderkey").alias("block_number")), path)
    return written_state(s, path)


QUERIES = {
    "stream_live_write": _written,
    "stream_fold_state": lambda s, d: fold_state(_changes(s, d), shared_path(s, "state")),
    "stream_history_then_live": _history_then_live,
    "stream_archiver": _archived,
    "stream_tail": lambda s, d: drained(tail(_events(s, d), 5000), "tail"),
    "stream_dedup": lambda s, d: drained(deduplicated(_events(s, d), ["session", "event_type"]).select("session", "event_type"), "dedup"),
    "stream_election": lambda s, d: drained(election(_items(s, d)), "election", "complete"),
    "stream_block_assembly": lambda s, d: drained(assembly(_items(s, d)), "assembly", "complete"),
    "stream_session_outcomes": lambda s, d: drained(session_outcomes(source(s, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.floor(F.col("event_id") / 2 + F.col("value") % 97).alias("block_number"))), "outcomes"),
}
SQL = {
    "stream_live_write": """WITH p AS (SELECT DISTINCT l_orderkey AS n FROM lineitem), g AS (SELECT n, n - lag(n, 1, -1) OVER (ORDER BY n) - 1 AS hole FROM p)
        SELECT min(n) AS earliest, max(n) AS latest, coalesce((SELECT min(n - hole) FROM g WHERE hole > 0) - 1, max(n)) AS highest_contiguous, count(*) FILTER (hole > 0) AS n_gaps, coalesce(sum(hole), 0)::BIGINT AS n_missing FROM g""",
    "stream_fold_state": "SELECT user_id AS key, ts, event_id AS seq, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'error'",
    "stream_history_then_live": "SELECT o_orderkey AS block_number, CASE WHEN o_orderkey < 1000 THEN 'history' ELSE 'live' END AS source FROM orders WHERE o_orderkey >= 500",
    "stream_archiver": f"""WITH m AS (SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders), b AS (SELECT lo + (o_orderkey - lo) // {BATCH} * {BATCH} AS batch_start, hi, count(*) AS n, min(o_orderkey) AS f, max(o_orderkey) AS l FROM orders, m GROUP BY ALL)
        SELECT batch_start, n AS n_blocks, f AS first_block, l AS last_block FROM b WHERE n = {BATCH} AND hi - batch_start + 1 > {HOT_LIMIT}""",
    "stream_tail": "SELECT event_id AS block_number, user_id AS session, event_type, ts FROM events WHERE event_id >= 5000",
    "stream_dedup": "SELECT DISTINCT user_id AS session, event_type FROM events",
    "stream_election": "SELECT l_orderkey AS block_number, arg_min(l_suppkey, row(l_shipdate, l_suppkey)) AS winner FROM lineitem GROUP BY 1",
    "stream_block_assembly": "SELECT l_orderkey AS block_number, count(*) AS n_items, min(l_linenumber) = 1 AND count(*) > 1 AS complete FROM lineitem GROUP BY 1",
    "stream_session_outcomes": """WITH h AS (SELECT user_id AS session, event_id AS seq, floor(event_id / 2 + value % 97)::BIGINT AS block_number FROM events)
        SELECT session, seq, block_number, CASE WHEN block_number <= max(block_number) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 'DUPLICATE_BLOCK' ELSE 'ACCEPTED' END AS outcome FROM h""",
}
