"""Golden scenarios of the ledger operators on small inputs."""

import datetime as dt

import pytest
import zstandard
from pyspark.sql import functions as F

from ledgerloom.functions import metrics
from ledgerloom.operators import archive, backfill, blocks, contiguity, entities, publish, state, subscribe
from ledgerloom.plans import inspect
from ledgerloom.sources import archive_files, ledger
from ledgerloom.streaming import jobs


def numbers(spark, *ns):
    return spark.createDataFrame([(n,) for n in ns], "block_number bigint")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize(
    ("start", "held", "contiguous", "gaps"),
    [
        (100, [100, 102], 100, [(101, 101, 1)]),
        (100, [100, 102, 101], 102, []),
        (1, [1, 2, 5], 2, [(3, 4, 2)]),
        (0, [0, 1, 2, 3, 4, 10, 11, 12, 13, 14], 4, [(5, 9, 5)]),
        (0, [0, 1, 5, 3], 1, [(2, 2, 1), (4, 4, 1)]),
        (0, [3], -1, [(0, 2, 3)]),
        (7, [], 6, []),
    ],
)
def test_contiguity(spark, start, held, contiguous, gaps):
    b = numbers(spark, *held)
    assert contiguity.highest_contiguous(b, start).first()[0] == contiguous
    assert rows(contiguity.gap_ranges(b, start)) == sorted(gaps, key=str)


def test_two_phase_order_crosses_buckets(spark):
    b = numbers(spark, 0, 1, 9, 10, 31, 32)
    assert rows(contiguity.with_next(b, width=10)) == sorted([(0, 1), (1, 9), (9, 10), (10, 31), (31, 32), (32, None)], key=str)


def test_intervals(spark):
    make = lambda *r: spark.createDataFrame(list(r), "s bigint, e bigint")
    assert rows(contiguity.merge_intervals(make((5, 10), (11, 12), (9, 3)))) == [(5, 12)]
    points = lambda *n: spark.createDataFrame([(x,) for x in n], "n bigint")
    assert rows(contiguity.split_intervals(make((5, 12)), points(5))) == [(6, 12)]
    assert rows(contiguity.split_intervals(make((6, 12)), points(8))) == [(6, 7), (9, 12)]
    assert rows(contiguity.merge_intervals(make((6, 7), (9, 12), (7, 9)))) == [(6, 12)]
    assert rows(contiguity.split_intervals(make((4, 4)), points(4))) == []


def test_archive_plan(spark):
    assert rows(archive.archive_plan(numbers(spark, *range(100, 105)), 2, 3)) == [(100, 102)]
    assert rows(archive.archive_plan(numbers(spark, *range(15)), 10, 5)) == [(0, 4)]
    assert rows(archive.archive_plan(numbers(spark, *[n for n in range(40) if n != 7]), 10, 5)) == [(0, 4)]
    assert rows(archive.archive_plan(numbers(spark, *range(5), *range(20, 60)), 5, 5)) == [(0, 4)]


def test_archive_round_trip(spark, tmp_path):
    hot = numbers(spark, *range(15))
    moved = archive.archive_batches(hot, 10, 5)
    archive.write_archive(moved, f"{tmp_path}/cold")
    cold = spark.read.parquet(f"{tmp_path}/cold")
    assert sorted(r.block_number for r in cold.collect()) == [0, 1, 2, 3, 4]
    assert "batch_start" in inspect.plan_text(blocks.cold_lookup(cold, 3, 5))
    with pytest.raises(ValueError):
        archive.write_archive(moved.limit(0), f"{tmp_path}/cold")


def test_packed_archive(spark, tmp_path):
    frames = [zstandard.compress(f"test_block_{n}".encode()) for n in range(3)]
    offsets = [0, len(frames[0]), len(frames[0]) + len(frames[1])]
    index = b"".join(n.to_bytes(8, "big") + o.to_bytes(8, "big") + len(f).to_bytes(4, "big") for n, o, f in zip(range(3), offsets, frames))
    index += (9).to_bytes(8, "big") + (10**6).to_bytes(8, "big") + (5).to_bytes(4, "big")
    (tmp_path / "blocks-0000000000-0000000002.rbi").write_bytes(index)
    (tmp_path / "blocks-0000000000-0000000002.rba").write_bytes(b"".join(frames))
    (tmp_path / "blocks-0000000003-0000000004.rbi").write_bytes(b"broken")
    assert archive_files.read_index(spark, str(tmp_path)).count() == 4
    got = {r.block_number: r.payload and bytes(r.payload) for r in archive_files.read_blocks(spark, str(tmp_path)).collect()}
    assert got == {0: b"test_block_0", 1: b"test_block_1", 2: b"test_block_2", 9: None}


def test_block_status(spark):
    held = spark.createDataFrame([(3, b"x"), (5, b"x"), (6, b"")], "block_number bigint, payload binary")
    asks = spark.createDataFrame([(1, 3, None), (2, 4, None), (3, 2, None), (4, 9, None), (5, -1, None), (6, None, True), (7, None, False), (8, None, None)], "req_id bigint, block_number bigint, retrieve_latest boolean")
    got = {r.req_id: r.status for r in blocks.block_status(asks, held).collect()}
    assert got == {1: "SUCCESS", 2: "NOT_FOUND", 3: "NOT_AVAILABLE", 4: "NOT_AVAILABLE", 5: "UNKNOWN", 6: "UNKNOWN", 7: "INVALID_REQUEST", 8: "INVALID_REQUEST"}
    empty = {r.req_id: r.status for r in blocks.block_status(asks, held.limit(0)).collect()}
    assert (empty[1], empty[5], empty[8]) == ("NOT_FOUND", "NOT_FOUND", "INVALID_REQUEST")


def test_ranges_and_strict_reads(spark):
    held = numbers(spark, *range(21))
    assert blocks.historical_range(held, 5, 10).count() == 6
    assert blocks.historical_range(held.where("block_number <> 8"), 5, 10).count() == 3
    assert blocks.strict_batch_read(held, 3, 4).count() == 4
    with pytest.raises(Exception, match="incomplete"):
        blocks.strict_batch_read(held, 18, 5).collect()
    assert blocks.server_status(held.limit(0)).first() == (0, 0, False)
    assert blocks.server_status(numbers(spark, *range(10), 15)).first() == (0, 15, False)


def test_subscriptions(spark):
    held = numbers(spark, *range(21))
    asks = spark.createDataFrame([(1, 5, 10), (2, 10, 5), (3, 0, None), (4, 30, 40), (5, -1, 3)], "req_id bigint, start bigint, end bigint")
    got = {r.req_id: (r.n_sent, r.code) for r in subscribe.outcome(asks, held).collect()}
    assert got == {1: (6, "SUCCESS"), 2: (0, "INVALID_END_BLOCK_NUMBER"), 3: (21, "ERROR"), 4: (0, "ERROR"), 5: (0, "INVALID_START_BLOCK_NUMBER")}


def test_publishing(spark):
    t = dt.datetime(2024, 1, 1)
    sent = spark.createDataFrame([(1, 1, t), (2, 2, t)], "key bigint, id bigint, ts timestamp_ntz")
    done = spark.createDataFrame([(1, t + dt.timedelta(seconds=60)), (2, t + dt.timedelta(seconds=61))], "key bigint, ts timestamp_ntz")
    assert {r.key: r.response for r in publish.correlate_acks(sent, done).collect()} == {1: "ACK", 2: "RESEND"}
    heads = spark.createDataFrame([(1, 0), (2, 0), (3, 2), (4, 1)], "seq bigint, block_number bigint")
    assert [r.outcome for r in publish.outcomes(heads, width=2).orderBy("seq").collect()] == ["ACCEPTED", "DUPLICATE_BLOCK", "ACCEPTED", "DUPLICATE_BLOCK"]
    wins = spark.createDataFrame([(n, 1) for n in (1, 50, 100)], "block_number bigint, winner bigint")
    assert rows(publish.retained_winners(wins, threshold=50)) == sorted([(50, 1), (100, 1)], key=str)
    assert publish.retained_winners(wins, threshold=100).count() == 3


def test_state_and_queue(spark):
    log = spark.createDataFrame([("a", 1, 1, "update", 1.0), ("a", 2, 2, "delete", None), ("a", 2, 3, "update", 5.0), ("b", 1, 4, "update", 2.0), ("b", 3, 5, "delete", None)], "key string, ts bigint, seq bigint, op string, value double")
    assert rows(state.snapshot(log)) == [("a", 2, 3, 5.0)]
    assert rows(state.visible(state.resume(state.latest_changes(log.where("seq <= 1")), log, 1))) == [("a", 2, 3, 5.0)]
    ops = spark.createDataFrame([(1, 1, 1, False), (1, 2, 2, True), (1, 3, 3, True), (1, 4, 4, False), (1, 5, 5, False), (1, 6, 6, False), (1, 7, 7, True)], "queue int, ts int, seq int, push boolean")
    assert rows(state.queue_depths(ops)) == [(1, 3, 2, 1)]
    assert rows(state.queue_pops(ops)) == [(1, 2, 4), (1, 3, 5)]


def test_entities(spark):
    accounts = spark.createDataFrame([(999, "", 1, 0, "test-memo", True), (1001, "ab", 1001, 5, "balance-test", True), (7, "x", 1, 1, "", False)], "account_id bigint, alias string, balance bigint, expiry bigint, memo string, smart_contract boolean")
    asks = spark.createDataFrame([(999,), (1001,), (7,), (5,)], "account_id bigint")
    got = {r.account_id: r for r in entities.account_info(asks, accounts).collect()}
    assert [got[i].contract_account_id for i in (999, 1001, 7, 5)] == ["0.0.999", "6162", "", None]
    assert (got[999].expiry, got[1001].expiry, got[5].code) == (None, 5, "INVALID_ACCOUNT_ID")
    assert {r.account_id: r.balance for r in entities.account_balance(asks, accounts).collect()} == {999: 1, 1001: 1001, 7: 1, 5: 0}
    assert {r.contract_id: r.code for r in entities.contract_info(asks.withColumnRenamed("account_id", "contract_id"), accounts).collect()}[7] == "INVALID_CONTRACT_ID"
    with pytest.raises(Exception, match="missing account_id"):
        entities.account_info(spark.createDataFrame([(None,)], "account_id bigint"), accounts).collect()
    assert entities.version_info(spark.createDataFrame([], "version string")).first() == (None, None, "OK")
    assert entities.no_records(asks).where("code = 'OK' AND size(records) = 0").count() == 4
    tx = spark.createDataFrame([("t1",)], "transaction_id string")
    assert entities.no_receipt(tx).first().code == "RECEIPT_NOT_FOUND" and entities.no_transaction_record(tx).first() == ("t1", "RECORD_NOT_FOUND")


def test_kind_guard(spark):
    held = spark.createDataFrame([(1, "account"), (2, "token")], "id bigint, kind string")
    assert entities.of_kind(held.where("id = 1"), "account").count() == 1
    with pytest.raises(Exception, match="state inconsistency"):
        entities.of_kind(held, "account").collect()


def test_next_at_least(spark):
    points = spark.createDataFrame([(n,) for n in (0, 5, 9, 10, 31, 99)], "n bigint")
    keys = spark.createDataFrame([(5,), (8,), (40,)], "k bigint")
    assert {r.n: r.next_key for r in contiguity.next_at_least(points, keys, width=10).collect()} == {0: 5, 5: 5, 9: 40, 10: 40, 31: 40, 99: None}


def test_token_walk(spark):
    rel = spark.createDataFrame([(1, 10, 11, True, False), (1, 11, 12, False, True), (1, 12, None, True, True)], "account bigint, token bigint, next_token bigint, kyc_granted boolean, frozen boolean")
    heads = lambda cap, head=10: spark.createDataFrame([(1, head, cap)], "account bigint, head bigint, cap bigint")
    assert rows(entities.token_walk(heads(2), rel)) == [(1, 10, 1, 1, 2, 0), (1, 11, 2, 2, 1, 0)]
    assert entities.token_walk(heads(9), rel).count() == 3
    assert entities.token_walk(heads(0), rel).count() == 0
    with pytest.raises(Exception, match="missing relation"):
        entities.token_walk(heads(3), rel.where("token <> 11")).collect()


def test_backfill(spark):
    mine = numbers(spark, *range(10), *range(16, 21))
    assert rows(backfill.fill_gaps(mine, numbers(spark, *range(21)))) == sorted([(n,) for n in range(10, 16)], key=str)
    assert rows(backfill.follow(numbers(spark, *range(11)), numbers(spark, *range(16)))) == sorted([(n,) for n in range(11, 16)], key=str)
    assert backfill.follow(numbers(spark, *range(11)), numbers(spark, 13, 14)).count() == 0
    assert backfill.waits() == [1, 2, 4]
    assert sorted(r.peer for r in backfill.shuffled_peers(backfill.peers(spark), 3).collect()) == ["peer-a", "peer-b", "peer-c"]


def test_metrics(spark):
    s = spark.createDataFrame([("a", dt.datetime(2024, 1, 1, 0, 0, i), i, v) for i, v in enumerate([1.0, 5.0, 2.0, 4.0])], "label string, ts timestamp_ntz, seq bigint, value double")
    assert metrics.increases(s, F.lit(0), "label").first().increase == 4 + 2 + 2
    assert metrics.quantile(metrics.histogram(s, "label", bounds=[2.0, 4.0]), 0.5, "label").first()[1] == 2.0
    assert metrics.quantile(metrics.histogram(s, "label", bounds=[2.0, 4.0]), 0.99, "label").first()[1] == 4.0
    assert metrics.quantile(metrics.histogram(s.withColumn("value", F.lit(None).cast("double")), "label"), 0.5, "label").first()[1] is None
    assert metrics.error_ratio(s.unionByName(s.withColumn("label", F.lit("ab"))), "a").first().ratio == 50


def test_streams(spark, tmp_path):
    log = spark.createDataFrame([("a", 1, 1, "update", 1.0), ("b", 1, 2, "update", 2.0)], "key string, ts bigint, seq bigint, op string, value double")
    log.coalesce(1).write.parquet(f"{tmp_path}/log")
    spark.createDataFrame([("a", 2, 3, "delete", None), ("c", 2, 4, "update", 3.0)], log.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    folded = jobs.fold_state(spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log"), f"{tmp_path}/state")
    assert {r.key for r in folded.collect()} == {"b", "c"}
    t = dt.datetime(2024, 1, 1)
    kind = "key bigint, ts timestamp_ntz"
    spark.createDataFrame([(1, t), (2, t), (3, t + dt.timedelta(days=1))], kind).write.parquet(f"{tmp_path}/sent")
    spark.createDataFrame([(1, t + dt.timedelta(seconds=5)), (2, t + dt.timedelta(seconds=65)), (9, t + dt.timedelta(days=1))], kind).write.parquet(f"{tmp_path}/done")
    acks = jobs.acknowledged(spark.readStream.schema(kind).parquet(f"{tmp_path}/sent"), spark.readStream.schema(kind).parquet(f"{tmp_path}/done"))
    assert {r.key: r.ack_ts is not None for r in jobs.drained(acks, "acks").collect()} == {1: True, 2: False}


def test_plans(spark):
    looked = blocks.point_lookup(ledger.expected(spark, "/root/testdata/sf0.001"), 42)
    assert "EqualTo(o_orderkey,42)" in inspect.pushed_filters(looked)[0]
    assert "o_totalprice" not in inspect.read_schemas(looked)[0]
    assert inspect.exchanges(state.snapshot(ledger.changes(spark, "/root/testdata/sf0.001"))) == 1
