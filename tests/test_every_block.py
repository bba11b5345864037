"""The queries over every block, against plain Python on the whole small tables."""

from bisect import bisect_left

import duckdb

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
PAST_END = 1_000_000_000


def column(sql):
    return [x for (x,) in duckdb.sql(sql.format(SF)).fetchall()]


ORDERS, PRESENT = column("SELECT o_orderkey FROM '{}/orders.parquet'"), sorted(set(column("SELECT l_orderkey FROM '{}/lineitem.parquet'")))
HELD, LO, HI = set(PRESENT), PRESENT[0], PRESENT[-1]


def rows(spark, name):
    return list(map(tuple, entry.queries()[name](spark, SF).collect()))


def test_status_of_every_block(spark):
    def status(n):
        return "SUCCESS" if n in HELD else "NOT_AVAILABLE" if not LO <= n <= HI else "NOT_FOUND"

    want = [(n, n, status(n)) for x in ORDERS for n in (x, x + PAST_END)]
    want += [(-1, HI, "SUCCESS"), (-2, HI, "SUCCESS"), (-3, None, "INVALID_REQUEST"), (-4, None, "INVALID_REQUEST")]
    got = list(map(tuple, entry.entry(spark).collect()))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert len(got) == 2 * len(ORDERS) + 4


def test_tier_of_every_block(spark):
    cut = HI // 100 * 100 - 1000
    assert sorted(rows(spark, "tiered_read_all")) == sorted((n, "none" if n not in HELD else "hot" if n >= cut else "cold") for n in ORDERS)


def test_gap_of_every_block(spark):
    def hole(n):
        i = bisect_left(PRESENT, n)
        return (n, PRESENT[i - 1] + 1 if i else 0, PRESENT[i] - 1)

    got = sorted(tuple(r[k] for k in ("n", "gap_start", "gap_end")) for r in entry.queries()["gap_contains_all"](spark, SF).collect())
    assert got == sorted(hole(n) for n in ORDERS if n not in HELD and n <= HI)


def test_subscription_from_every_block(spark):
    fixed = [(-1, -5, None), (-2, -5, -9), (-3, 10**9, None), (-4, 10, 5), (-5, None, None), (-6, 0, 0)]
    asked = [(n, n if n % 5 else None, n + n % 11 - 2 if n % 3 else None) for n in ORDERS] + fixed
    valid, ended = [], []
    for i, start, end in asked:
        first = LO if start is None else start
        code = "INVALID_END_BLOCK_NUMBER" if end is not None and first > end else "INVALID_START_BLOCK_NUMBER" if first < LO else "OK"
        valid.append((i, first, end, code))
        if code != "OK":
            ended.append((i, 0, code, "invalid_request"))
            continue
        at = first
        while at in HELD and (end is None or at <= end):
            at += 1
        done = end is not None and at > end
        ended.append((i, at - first, *(("SUCCESS", "completed") if done else ("ERROR", "timeout"))))
    assert sorted(rows(spark, "subscribe_validation_all"), key=str) == sorted(valid, key=str)
    assert sorted(rows(spark, "subscribe_outcome_all"), key=str) == sorted(ended, key=str)
