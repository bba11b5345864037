"""Gaps, contiguity and intervals over block numbers.

Global orderings are taken in two phases: within buckets of numbers, in parallel, and then over one summary row for each
bucket, so that no task orders the whole ledger.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.ledger import BATCH, bucket, expected, present, table

#: Numbers in a bucket of the two-phase orderings.
WIDTH = 65_536


def with_next(blocks: DataFrame, width: int = WIDTH) -> DataFrame:
    """block_number and next_number, the next larger one present (null for the last)."""
    b = blocks.select("block_number", bucket(F.col("block_number"), width).alias("b"))
    edges = b.groupBy("b").agg(F.min("block_number").alias("lo"))
    edges = edges.select("b", F.lead("lo").over(Window.orderBy("b")).alias("next_lo"))
    inner = b.withColumn("nx", F.lead("block_number").over(Window.partitionBy("b").orderBy("block_number")))
    return inner.join(edges, "b").select("block_number", F.coalesce("nx", "next_lo").alias("next_number"))


def gap_ranges(blocks: DataFrame, start: int = 0) -> DataFrame:
    """gap_start, gap_end, gap_length of every run of missing numbers from start to the largest present."""
    seeded = blocks.where(F.col("block_number") >= start).unionByName(blocks.sparkSession.range(1).select(F.lit(start - 1).cast("bigint").alias("block_number")))
    return (
        with_next(seeded.distinct())
        .where("next_number - block_number > 1")
        .select((F.col("block_number") + 1).alias("gap_start"), (F.col("next_number") - 1).alias("gap_end"), (F.col("next_number") - F.col("block_number") - 1).alias("gap_length"))
    )


def highest_contiguous(blocks: DataFrame, start: int = 0) -> DataFrame:
    """One row: the last number up to which all from start are present; start - 1 if start is missing."""
    first_gap = gap_ranges(blocks, start).agg(F.min("gap_start").alias("g"))
    latest = blocks.where(F.col("block_number") >= start).agg(F.max("block_number").alias("m"))
    return first_gap.join(F.broadcast(latest), F.lit(True)).select(F.coalesce(F.col("g") - 1, "m", F.lit(start - 1)).cast("bigint").alias("highest_contiguous"))


def missing_blocks(wanted: DataFrame, blocks: DataFrame) -> DataFrame:
    return wanted.select("block_number").join(blocks, "block_number", "left_anti")


def batch_completeness(blocks: DataFrame, batch: int = BATCH) -> DataFrame:
    """Per batch: how many numbers are present, and whether all are."""
    return blocks.groupBy(bucket(F.col("block_number"), batch).alias("batch_start")).agg(F.count_distinct("block_number").alias("n_blocks")).withColumn("complete", F.col("n_blocks") == batch)


def merge_intervals(ranges: DataFrame, key: str | None = None, width: int = WIDTH) -> DataFrame:
    """Unites overlapping and adjacent closed ranges (s, e), per key if given; ranges with e < s are ignored.

    Running maxima and island numbers are taken within buckets of starts, and over one row a bucket.
    """
    by = [key] if key else []
    rows = ranges.where("e >= s").select(*by, "s", "e", bucket(F.col("s"), width).alias("b"))
    w = Window.partitionBy(*by, "b").orderBy("s", "e")
    earlier = Window.partitionBy(*by).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)

    def with_earlier(rows: DataFrame, value: str, total, name: str) -> DataFrame:
        sums = rows.groupBy(*by, "b").agg(total(value).alias("_t")).withColumn(name, total("_t").over(earlier))
        sums = sums.select(*(F.col(c).alias(f"_{c}") for c in [*by, "b"]), name)
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*by, "b"]]
        return rows.join(sums, same).select(*rows.columns, name)

    before = F.greatest(F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)), "far")
    opened = with_earlier(rows, "e", F.max, "far").withColumn("opens", F.when(before.isNull() | (F.col("s") > before + 1), 1).otherwise(0)).drop("far")
    island = F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce("n_before", F.lit(0))
    return with_earlier(opened, "opens", F.sum, "n_before").withColumn("island", island).groupBy(*by, "island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("island")


def split_intervals(ranges: DataFrame, points: DataFrame) -> DataFrame:
    """Takes filled points (n) out of closed, disjoint ranges (s, e): nothing, one or more ranges remain of each."""
    inside = containing_ranges(points.select("n").distinct(), ranges.select(F.col("s").alias("gap_start"), F.col("e").alias("gap_end")))
    cuts = inside.groupBy(F.col("gap_start").alias("s")).agg(F.array_sort(F.collect_list("n")).alias("cuts"))
    all_ = ranges.select("s", "e").join(cuts, "s", "left").withColumn("cuts", F.coalesce("cuts", F.array().cast("array<bigint>")))
    parts = F.zip_with(F.concat(F.array(F.col("s") - 1), "cuts"), F.concat("cuts", F.array(F.col("e") + 1)), lambda a, b: F.struct((a + 1).alias("s"), (b - 1).alias("e")))
    return all_.select(F.explode(F.filter(parts, lambda x: x["e"] >= x["s"])).alias("x")).select("x.s", "x.e")


def containing_ranges(points: DataFrame, ranges: DataFrame, width: int = WIDTH) -> DataFrame:
    """Each row of points (n and more) with the closed, disjoint range (gap_start, gap_end) it lies in.

    The range of greatest start at or before n is the only one that can hold it: it is found within buckets of numbers,
    or is the last of the buckets before, of which there is one row each.
    """
    both = points.select("n", F.struct(*points.columns).alias("p"), F.lit(None).cast("struct<s:bigint,e:bigint>").alias("r")).unionByName(
        ranges.select(F.col("gap_start").alias("n"), F.struct(F.col("gap_start").cast("bigint").alias("s"), F.col("gap_end").cast("bigint").alias("e")).alias("r")), allowMissingColumns=True
    )
    both = both.withColumn("b", bucket(F.col("n"), width))
    before = both.groupBy("b").agg(F.max("r").alias("last"))
    before = before.select("b", F.max("last").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"))
    here = F.max("r").over(Window.partitionBy("b").orderBy("n").rangeBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("here", here).where("p IS NOT NULL").join(before, "b").select("p.*", F.coalesce("here", "earlier").alias("_r"))
    return found.where("n <= _r.e").select(*points.columns, F.col("_r.s").alias("gap_start"), F.col("_r.e").alias("gap_end"))


def next_at_least(points: DataFrame, keys: DataFrame, width: int = WIDTH) -> DataFrame:
    """n and next_key, the least k of keys at or after it (null: none), of each distinct point n."""
    both = points.select("n", F.lit(None).cast("bigint").alias("k")).distinct().unionByName(keys.select(F.col("k").alias("n"), "k"))
    both = both.withColumn("b", bucket(F.col("n"), width))
    ahead = both.groupBy("b").agg(F.min("k").alias("lo"))
    ahead = ahead.select("b", F.min("lo").over(Window.orderBy("b").rowsBetween(1, Window.unboundedFollowing)).alias("later"))
    here = F.min("k").over(Window.partitionBy("b").orderBy(F.desc("n")).rangeBetween(Window.unboundedPreceding, 0))
    return both.withColumn("here", here).where("k IS NULL").join(ahead, "b").select("n", F.coalesce("here", "later").alias("next_key"))


def effective_gaps(gaps: DataFrame, start: int) -> DataFrame:
    """Gaps cut off below start; those wholly below it go."""
    return gaps.select(F.greatest("gap_start", F.lit(start).cast("bigint")).alias("gap_start"), "gap_end").where("gap_start <= gap_end")


def _user_ranges(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("s"), (F.col("event_id") + F.pmod("user_id", F.lit(200))).alias("e"))


QUERIES = {
    "gap_ranges": lambda s, d: gap_ranges(present(s, d)),
    "gap_summary": lambda s, d: gap_ranges(present(s, d)).agg(F.count("*").alias("n_gaps"), F.sum("gap_length").alias("n_missing"), F.max("gap_length").alias("longest")),
    "highest_contiguous": lambda s, d: highest_contiguous(present(s, d)),
    "missing_blocks": lambda s, d: missing_blocks(expected(s, d), present(s, d)),
    "batch_completeness": lambda s, d: batch_completeness(present(s, d)),
    "batch_bucket": lambda s, d: expected(s, d).select("block_number", bucket(F.col("block_number")).alias("batch_start")),
    "interval_merge": lambda s, d: merge_intervals(_user_ranges(s, d), "k"),
    "interval_split": lambda s, d: split_intervals(gap_ranges(present(s, d)).select(F.col("gap_start").alias("s"), F.col("gap_end").alias("e")), expected(s, d).where("block_number % 2 = 0").select(F.col("block_number").alias("n"))),
    "gap_contains": lambda s, d: containing_ranges(expected(s, d).select(F.col("block_number").alias("n")), gap_ranges(present(s, d)).drop("gap_length")),
    "gap_effective": lambda s, d: effective_gaps(gap_ranges(present(s, d)), 500),
}
P = "p AS (SELECT DISTINCT l_orderkey AS n FROM lineitem)"
GAPS = f"{P}, sd AS (SELECT n FROM p WHERE n >= 0 UNION SELECT -1), ld AS (SELECT n, lead(n) OVER (ORDER BY n) AS nx FROM sd), g AS (SELECT n + 1 AS gap_start, nx - 1 AS gap_end, nx - n - 1 AS gap_length FROM ld WHERE nx - n > 1)"
SQL = {
    "gap_ranges": f"WITH {GAPS} SELECT * FROM g",
    "gap_summary": f"WITH {GAPS} SELECT count(*) AS n_gaps, sum(gap_length)::BIGINT AS n_missing, max(gap_length) AS longest FROM g",
    "highest_contiguous": f"WITH {P} SELECT coalesce(max(n), -1)::BIGINT AS highest_contiguous FROM (SELECT n, row_number() OVER (ORDER BY n) - 1 AS r FROM p) WHERE n = r",
    "missing_blocks": "SELECT o_orderkey AS block_number FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
    "batch_completeness": f"WITH {P} SELECT (n // {BATCH}) * {BATCH} AS batch_start, count(*) AS n_blocks, count(*) = {BATCH} AS complete FROM p GROUP BY 1",
    "batch_bucket": f"SELECT o_orderkey AS block_number, (o_orderkey // {BATCH}) * {BATCH} AS batch_start FROM orders",
    "interval_merge": """WITH r AS (SELECT user_id AS k, event_id AS s, event_id + user_id % 200 AS e FROM events),
        o AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS opens FROM r),
        i AS (SELECT *, sum(opens) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM o)
        SELECT k, min(s) AS s, max(e) AS e FROM i GROUP BY k, island""",
    "interval_split": f"""WITH {GAPS}, m AS (SELECT n FROM g, unnest(range(gap_start, gap_end + 1)) AS u(n) WHERE n NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0)),
        i AS (SELECT n, n - row_number() OVER (ORDER BY n) AS island FROM m) SELECT min(n) AS s, max(n) AS e FROM i GROUP BY island""",
    "gap_contains": f"WITH {GAPS} SELECT o_orderkey AS n, gap_start, gap_end FROM orders JOIN g ON o_orderkey BETWEEN gap_start AND gap_end",
    "gap_effective": f"WITH {GAPS} SELECT greatest(gap_start, 500) AS gap_start, gap_end FROM g WHERE gap_end >= 500",
}
#: A second name of the same query.
QUERIES["gap_contains_all"], SQL["gap_contains_all"] = QUERIES["gap_contains"], SQL["gap_contains"]
