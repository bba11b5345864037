"""Tiering: archive plan and batches, catalogue of archived files, historical writes, tier sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.ledger import BATCH, HOT_LIMIT, bucket, cold_start, expected, present, table, tiers
from .contiguity import P, highest_contiguous

#: Fixed value: the form of an archive index's name, first and last block in ten digits.
NAME_FORM, NAME_PATTERN = "blocks-%010d-%010d.rbi", r"blocks-(\d{10})-(\d{10})\.rbi"


def archive_name(first, last):
    return F.format_string(NAME_FORM, first, last)


def parse_names(names: DataFrame, col: str = "name") -> DataFrame:
    """first_block and last_block of archive names; rows whose name has another form go."""
    return names.where(F.col(col).rlike(f"^{NAME_PATTERN}$")).select(col, *(F.regexp_extract(col, NAME_PATTERN, i).cast("bigint").alias(a) for i, a in ((1, "first_block"), (2, "last_block"))))


def catalog(cold: DataFrame) -> DataFrame:
    """One row for each archived batch: its name, first and last block, and how many blocks it holds."""
    found = cold.groupBy("batch_start").agg(F.min("block_number").alias("first_block"), F.max("block_number").alias("last_block"), F.count("*").alias("n_blocks"))
    return found.select("batch_start", archive_name("first_block", "last_block").alias("name"), "first_block", "last_block", "n_blocks")


def archive_plan(hot: DataFrame, hot_limit: int = HOT_LIMIT, batch: int = BATCH) -> DataFrame:
    """Batches that archiving moves: from the earliest hot block on, while the span of numbers stays over hot_limit,
    each batch in turn if it is complete; the first incomplete one ends the cycle.  Nothing is ordered in one task: the
    plan only needs the least batch that is incomplete, and the least that is missing."""
    ends = hot.agg(F.min("block_number").alias("lo"), F.max("block_number").alias("hi"))
    number = F.floor((F.col("block_number") - F.col("lo")) / batch).cast("bigint")
    batches = hot.join(F.broadcast(ends), F.lit(True)).groupBy(number.alias("k"), "lo", "hi").agg(F.count_distinct("block_number").alias("n"))
    partial = batches.agg(F.min(F.when(F.col("n") < batch, F.col("k"))).alias("partial"))
    unbroken = highest_contiguous(batches.select(F.col("k").alias("block_number"))).select((F.col("highest_contiguous") + 1).alias("missing"))
    good = batches.join(F.broadcast(partial), F.lit(True)).join(F.broadcast(unbroken), F.lit(True)).where(F.col("k") < F.least("partial", "missing"))
    start = F.col("lo") + F.col("k") * batch
    return good.where(F.col("hi") - start + 1 > hot_limit).select(start.alias("first_block"), (start + batch - 1).alias("last_block"))


def archive_batches(hot: DataFrame, hot_limit: int = HOT_LIMIT, batch: int = BATCH) -> DataFrame:
    """The rows of hot that archiving moves, with the batch and the name of their file."""
    plan = archive_plan(hot, hot_limit, batch).withColumn("block_number", F.explode(F.sequence("first_block", "last_block")))
    return hot.join(plan, "block_number").select("block_number", F.col("first_block").alias("batch_start"), archive_name("first_block", "last_block").alias("name"))


def write_archive(batches: DataFrame, path: str) -> None:
    """Appends archived blocks as zstd Parquet, a folder for each batch; visible when the job commits."""
    if batches.isEmpty():
        raise ValueError("nothing to archive")
    batches.repartition("batch_start").sortWithinPartitions("block_number").write.partitionBy("batch_start").option("compression", "zstd").mode("append").parquet(path)


def tier_block_counts(hot: DataFrame, cold: DataFrame) -> DataFrame:
    """Cold: the sum of the batches' spans; hot: the span of its numbers, holes included."""
    c = cold.groupBy("batch_start").agg((F.max("block_number") - F.min("block_number") + 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("cold_blocks"))
    h = hot.agg(F.coalesce(F.max("block_number") - F.min("block_number") + 1, F.lit(0)).alias("hot_blocks"))
    return h.join(F.broadcast(c), F.lit(True))


def historical_write(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """What a historical batch does to the watermarks: rows written, the earliest block before and after, the latest."""
    before = existing.agg(F.min("block_number").alias("earliest_before"), F.max("block_number").alias("latest"))
    new = batch.agg(F.count("*").alias("n_written"), F.min("block_number").alias("first_written"))
    return before.join(F.broadcast(new), F.lit(True)).select("n_written", "earliest_before", F.least("earliest_before", "first_written").alias("earliest_after"), "latest")


def chunk_of(points: DataFrame, chunks: DataFrame, width: int = 65_536) -> DataFrame:
    """As-of lookup: for each n the chunk of greatest start_block at most n, if n <= end_block (disjoint chunks)."""
    from .contiguity import containing_ranges

    return containing_ranges(points, chunks.select(F.col("start_block").alias("gap_start"), F.col("end_block").alias("gap_end")), width).select("n", F.col("gap_start").alias("start_block"), F.col("gap_end").alias("end_block"))


def expired(entries: DataFrame, ttl_seconds: int = 300) -> DataFrame:
    """Cache entries (key, inserted at ts, removed: marked for removal): whether each is gone at the latest time."""
    now = entries.agg(F.max("ts").alias("now"))
    age = F.expr("timestampdiff(MICROSECOND, ts, now)")
    return entries.join(F.broadcast(now), F.lit(True)).select("key", (F.col("removed") | (age > ttl_seconds * 1_000_000)).alias("evicted"))


def _entries(s, d):
    return table(s, d, "events").select(F.col("event_id").alias("key"), "ts", (F.col("event_type") == "purchase").alias("removed"))


def _history(s, d):
    """All blocks before the first hot one, which is where the live blocks start."""
    return expected(s, d).join(F.broadcast(cold_start(present(s, d))), F.col("block_number") < F.col("hot_from")).select("block_number")


QUERIES = {
    "cold_catalog": lambda s, d: catalog(tiers(present(s, d))[1]),
    "archive_name_parse": lambda s, d: parse_names(catalog(tiers(present(s, d))[1]).select("name").unionByName(s.createDataFrame([("blocks-1-2.rbi",), ("other.txt",)], "name string"))),
    "archive_plan": lambda s, d: archive_plan(expected(s, d).where("block_number <> 4242").select("block_number")),
    "archive_batches": lambda s, d: archive_batches(expected(s, d).where("block_number <> 4242").select("block_number")),
    "tier_block_counts": lambda s, d: tier_block_counts(*tiers(present(s, d))),
    "historical_batch_write": lambda s, d: historical_write(tiers(present(s, d))[0], _history(s, d)),
    "chunk_asof_lookup": lambda s, d: chunk_of(present(s, d).select(F.col("block_number").alias("n")), catalog(tiers(present(s, d))[1]).select(F.col("first_block").alias("start_block"), F.col("last_block").alias("end_block"))),
    "cache_ttl_eviction": lambda s, d: expired(_entries(s, d)),
}
_TIERS = f"{P}, cut AS (SELECT (max(n) // {BATCH}) * {BATCH} - {HOT_LIMIT} AS f FROM p), cold AS (SELECT n, (n // {BATCH}) * {BATCH} AS batch_start FROM p, cut WHERE n < f), cat AS (SELECT batch_start, printf('blocks-%010d-%010d.rbi', min(n), max(n)) AS name, min(n) AS first_block, max(n) AS last_block, count(*) AS n_blocks FROM cold GROUP BY 1)"
_PLAN = f"""h AS (SELECT o_orderkey AS n FROM orders WHERE o_orderkey <> 4242), m AS (SELECT min(n) AS lo, max(n) AS hi FROM h),
    b AS (SELECT (n - lo) // {BATCH} AS k, lo, hi, count(*) AS c FROM h, m GROUP BY ALL), u AS (SELECT *, row_number() OVER (ORDER BY k) - 1 AS r FROM b),
    v AS (SELECT *, min(CASE WHEN c = {BATCH} AND k = r THEN 1 ELSE 0 END) OVER (ORDER BY k) AS ok FROM u),
    pl AS (SELECT lo + k * {BATCH} AS first_block, lo + k * {BATCH} + {BATCH - 1} AS last_block FROM v WHERE ok = 1 AND hi - (lo + k * {BATCH}) + 1 > {HOT_LIMIT})"""
SQL = {
    "cold_catalog": f"WITH {_TIERS} SELECT * FROM cat",
    "archive_name_parse": f"WITH {_TIERS} SELECT name, first_block, last_block FROM cat",
    "archive_plan": f"WITH {_PLAN} SELECT * FROM pl",
    "archive_batches": f"WITH {_PLAN} SELECT n AS block_number, first_block AS batch_start, printf('blocks-%010d-%010d.rbi', first_block, last_block) AS name FROM h JOIN pl ON n BETWEEN first_block AND last_block",
    "tier_block_counts": f"WITH {_TIERS} SELECT (SELECT max(n) - min(n) + 1 FROM p, cut WHERE n >= f) AS hot_blocks, (SELECT coalesce(sum(last_block - first_block + 1), 0)::BIGINT FROM cat) AS cold_blocks",
    "historical_batch_write": f"""WITH {_TIERS}, h AS (SELECT count(*) AS w, min(o_orderkey) AS lo FROM orders, cut WHERE o_orderkey < f)
        SELECT w AS n_written, min(n) AS earliest_before, least(min(n), lo) AS earliest_after, max(n) AS latest FROM p, cut, h WHERE n >= f GROUP BY w, lo""",
    "chunk_asof_lookup": f"WITH {_TIERS} SELECT p.n, c.first_block AS start_block, c.last_block AS end_block FROM p ASOF JOIN cat c ON p.n >= c.first_block WHERE p.n <= c.last_block",
    "cache_ttl_eviction": "SELECT event_id AS key, event_type = 'purchase' OR date_diff('microsecond', ts, (SELECT max(ts) FROM events)) > 300000000 AS evicted FROM events",
}
#: A second name of the same query.
QUERIES["historical_batch_write_all"], SQL["historical_batch_write_all"] = QUERIES["historical_batch_write"], SQL["historical_batch_write"]
