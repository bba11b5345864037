"""All acknowledgements and all history, against plain Python on the whole small tables."""

import duckdb

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def column(sql):
    return [x for (x,) in duckdb.sql(sql.format(SF)).fetchall()]


ORDERS, PRESENT, SESSIONS = column("SELECT o_orderkey FROM '{}/orders.parquet'"), set(column("SELECT l_orderkey FROM '{}/lineitem.parquet'")), column("SELECT s_suppkey FROM '{}/supplier.parquet'")


def test_every_block_is_acknowledged(spark):
    got = sorted(map(tuple, entry.queries()["ack_fanout_all"](spark, SF).collect()))
    groups = max(5, len(SESSIONS) // 10)
    assert got == sorted((n, s) for n in ORDERS for s in SESSIONS if n % groups == s % groups)
    assert {n for n, _ in got} == set(ORDERS)


def test_all_history_is_written(spark):
    live = max(PRESENT) // 100 * 100 - 1000
    history, hot = [n for n in ORDERS if n < live], [n for n in PRESENT if n >= live]
    (r,) = entry.queries()["historical_batch_write_all"](spark, SF).collect()
    assert (r.n_written, r.earliest_before, r.earliest_after, r.latest) == (len(history), min(hot), min(history), max(hot)) and len(history) > 5
