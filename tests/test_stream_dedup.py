import datetime
import os

from ledgerloom.streaming import jobs

DAY = datetime.datetime(2024, 1, 1)


def batches_out_of_order(spark, top):
    """A file a micro-batch: late keys after newer ones, and keys that come again after weeks."""
    files = [[(1, 30), (2, 31)], [(3, 2), (1, 3)], [(2, 90), (4, 91)], [(1, 92), (5, 1)], [(3, 120), (6, 4)]]
    for k, rows in enumerate(files):
        part = f"{top}/part-{k}"
        spark.createDataFrame([(s, DAY + datetime.timedelta(days=d)) for s, d in rows], "session bigint, ts timestamp").coalesce(1).write.parquet(part)
        (name,) = [x for x in os.listdir(part) if x.endswith(".parquet")]
        os.makedirs(f"{top}/events.parquet", exist_ok=True)
        os.rename(f"{part}/{name}", f"{top}/events.parquet/{k}.parquet")
        os.utime(f"{top}/events.parquet/{k}.parquet", (1_700_000_000 + 100 * k,) * 2)


def test_one_file_a_batch_out_of_time_order(spark, tmp_path):
    batches_out_of_order(spark, str(tmp_path))
    for max_files in (1, 2, 64):
        stream = jobs.source(spark, str(tmp_path), "events", max_files)
        got = jobs.drained(jobs.deduplicated(stream, ["session"]).select("session"), "dedup-test").collect()
        assert sorted(r.session for r in got) == [1, 2, 3, 4, 5, 6], max_files


def test_watermark_is_an_option(spark, tmp_path):
    batches_out_of_order(spark, str(tmp_path))
    stream = jobs.source(spark, str(tmp_path), "events", 64)
    got = jobs.drained(jobs.deduplicated(stream, ["session"], delay="1 day").select("session"), "dedup-test").collect()
    assert sorted(r.session for r in got) == [1, 2, 3, 4, 5, 6]
