"""Late changes after deletes, the archiver and subscriptions over several micro-batches; plans without nested loops."""

import pytest

from ledgerloom.functions import metrics
from ledgerloom.operators import answers, archive, backfill, contiguity
from ledgerloom.plans import inspect
from ledgerloom.streaming import jobs


def files(spark, rows, schema, path):
    """One file for each list of rows, read one a micro-batch in the order of their times."""
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_late_update_after_delete(spark, tmp_path):
    log = files(spark, [[("a", 1, 1, "update", 1.0), ("b", 1, 2, "update", 5.0)], [("a", 5, 3, "delete", None)], [("a", 2, 4, "update", 2.0), ("b", 0, 5, "update", 9.0)]], "key string, ts bigint, seq bigint, op string, value double", f"{tmp_path}/log")
    assert [tuple(r) for r in jobs.fold_state(log, f"{tmp_path}/state").collect()] == [("b", 1, 2, 5.0)]


def test_archiver_over_micro_batches(spark, tmp_path):
    parts = [[(n,) for n in range(a, a + 7) if n != 33] for a in range(0, 56, 7)]
    jobs.archiver(files(spark, [*parts, [(33,), (3,)]], "block_number bigint", f"{tmp_path}/in"), f"{tmp_path}/store", 10, 5)
    read = lambda x: spark.read.option("recursiveFileLookup", True).schema("block_number bigint, batch_start bigint").parquet(f"{tmp_path}/store/{x}")
    last = max(int(p.name) for p in (tmp_path / "store" / "hot").iterdir())
    cold, hot = sorted(r.block_number for r in read("cold").collect()), sorted(r.block_number for r in spark.read.parquet(f"{tmp_path}/store/hot/{last}").collect())
    assert cold == list(range(50)) and hot == list(range(50, 56))


def test_history_then_live(spark, tmp_path):
    live = files(spark, [[(3,), (4,)], [(5,), (4,)], [(6,), (1,)]], "block_number bigint", f"{tmp_path}/live")
    history = spark.createDataFrame([(n,) for n in range(5)], "block_number bigint")
    assert sorted(r.block_number for r in jobs.subscribed(spark, history, live, 2).collect()) == [2, 3, 4, 5, 6]
    again = spark.readStream.schema("block_number bigint").parquet(f"{tmp_path}/live")
    assert sorted(r.block_number for r in jobs.subscribed(spark, history.limit(0), again, 4).collect()) == [4, 5, 6]


def test_ranges_in_two_phases(spark):
    make = lambda *r: spark.createDataFrame(list(r), "s bigint, e bigint")
    got = contiguity.merge_intervals(make((0, 25), (3, 4), (26, 30), (40, 41), (55, 60), (42, 44), (9, 1)), width=10)
    assert sorted(map(tuple, got.collect())) == [(0, 30), (40, 44), (55, 60)]
    points = spark.createDataFrame([(n, f"x{n}") for n in (0, 5, 12, 37, 38, 99)], "n bigint, tag string")
    ranges = spark.createDataFrame([(5, 37), (90, 98)], "gap_start bigint, gap_end bigint")
    assert sorted(tuple(r) for r in contiguity.containing_ranges(points, ranges, width=10).collect()) == [(5, "x5", 5, 37), (12, "x12", 5, 37), (37, "x37", 5, 37)]


def test_plans(spark):
    numbers = spark.range(1000).select("id").withColumnRenamed("id", "block_number")
    points, ranges = numbers.withColumnRenamed("block_number", "n"), contiguity.gap_ranges(numbers.where("block_number % 7 <> 0"))
    for df in (contiguity.containing_ranges(points, ranges), contiguity.split_intervals(ranges.selectExpr("gap_start AS s", "gap_end AS e"), points)):
        assert "NestedLoop" not in inspect.plan_text(df) and "Cartesian" not in inspect.plan_text(df)


def test_increases_cross_buckets(spark):
    rows = [("a", t, t, float(v)) for t, v in enumerate([5, 7, 3, 10, 10, 12, 1])]
    df = spark.createDataFrame([*rows, ("b", 2, 9, 4.0)], "label string, at bigint, seq bigint, value double")
    for width in (1, 2, 100):
        got = metrics.increases(df.selectExpr("label", "timestamp_ntz'1970-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, at) AS ts", "seq", "value"), metrics.F.lit(0), "label", seconds=width)
        assert [tuple(r) for r in got.collect()] == [("a", 0, 2 + 3 + 7 + 0 + 2 + 1.0)]


def test_dispatch_and_guards(spark):
    asks = spark.createDataFrame([("token", "nft_info"), ("token", "file_info"), ("file", None)], "service string, query string")
    assert [r.code for r in answers.dispatch(asks).collect()] == ["OK", "INVALID_ARGUMENT", "INVALID_ARGUMENT"]
    state = spark.createDataFrame([(1, "file", "text"), (2, "token", None)], "file_id bigint, kind string, contents string")
    wanted = lambda i, q="file_content": spark.createDataFrame([(i, q)], "file_id bigint, query string")
    assert [tuple(r) for r in answers.file_content(wanted(1), state.where("file_id = 1"), "file_id", "file", "file_content").collect()] == [(1, "text", "OK")]
    with pytest.raises(Exception, match="INVALID_ARGUMENT"):
        answers.file_content(wanted(1, "token_info"), state.where("file_id = 1"), "file_id", "file", "file_content").collect()
    with pytest.raises(Exception, match="expected file, found token"):
        answers.file_content(wanted(2), state, "file_id", "file", "file_content").collect()


def test_peers_fail_over(spark):
    gaps = spark.createDataFrame([(0, 9), (20, 24), (50, 60)], "gap_start bigint, gap_end bigint")
    peers = spark.createDataFrame([("p", 0, 30, 1), ("q", 0, 100, 2), ("r", 20, 30, 3)], "peer string, first_available bigint, last_available bigint, order int")
    served = spark.createDataFrame([("q", n) for n in range(10)] + [("p", n) for n in range(20, 23)] + [("r", n) for n in range(20, 25)], "peer string, block_number bigint")
    got = {(r.gap_start, r.gap_end): (r.peer, r.tried) for r in backfill.fail_over(gaps, peers, served).collect()}
    assert got == {(0, 9): ("q", 4), (20, 24): ("r", 7), (50, 60): (None, 3)}


def test_archive_plan_needs_no_global_order(spark):
    plan = archive.archive_plan(spark.range(5000).withColumnRenamed("id", "block_number"), 1000, 100)
    assert plan.count() == 40
