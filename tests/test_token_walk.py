"""Walks of more rows and more hops than Spark's recursive queries allow."""

import duckdb
import pytest

import __spark_entry__ as entry
from ledgerloom.operators import entities

SF = "/root/testdata/sf0.001"
LIMIT = "spark.sql.cteRecursionRowLimit"


@pytest.fixture
def few_rows(spark):
    """What a million rows are at size."""
    before = spark.conf.get(LIMIT)
    spark.conf.set(LIMIT, "50")
    yield
    spark.conf.set(LIMIT, before)


def same_as_sql(spark, name, folder=SF):
    """Compares a query with its SQL; the number of rows."""
    con = duckdb.connect()
    for t in ("customer", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    df = entry.queries()[name](spark, str(folder))
    got = sorted(map(tuple, df.collect()), key=str)
    want = con.sql(entry.oracle_sql()[name]).select(*(duckdb.ColumnExpression(c) for c in df.columns)).fetchall()
    assert got == sorted(want, key=str)
    return len(want)


def test_walk_of_many_rows(spark, few_rows):
    assert same_as_sql(spark, "token_relationship_walk") > 50


def test_walk_of_many_hops(spark):
    links = [(1, n, n + 1 if n < 300 else None) for n in range(1, 301)] + [(2, 5, 6), (2, 6, 5)] + [(3, 1, 2), (3, 2, None), (3, 8, 8)]
    rel = spark.createDataFrame([(*x, True, False) for x in links], "account bigint, token bigint, next_token bigint, kyc_granted boolean, frozen boolean")
    heads = spark.createDataFrame([(1, 1, 250), (1, 200, 1000), (2, 5, 7), (3, 1, 10**12), (4, None, 3)], "account bigint, head bigint, cap bigint")
    got = sorted((r.account, r.token, r.hop) for r in entities.token_walk(heads, rel).collect())
    want = [(1, n, n) for n in range(1, 251)] + [(1, n, n - 199) for n in range(200, 301)] + [(2, 6 - h % 2, h) for h in range(1, 8)] + [(3, 1, 1), (3, 2, 2)]
    assert got == sorted(want)


@pytest.mark.parametrize("name", ["account_details", "account_details_whole"])
def test_details_of_many_rows(spark, few_rows, name):
    assert same_as_sql(spark, name) > 50


@pytest.fixture(scope="module")
def twice(tmp_path_factory):
    """Tables where the last order of each walk is there twice."""
    folder = tmp_path_factory.mktemp("twice")
    duckdb.sql(f"COPY (FROM '{SF}/customer.parquet') TO '{folder}/customer.parquet'")
    last = f"SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM '{SF}/orders.parquet') WHERE n = o_custkey % 5"
    duckdb.sql(f"COPY (FROM '{SF}/orders.parquet' UNION ALL {last}) TO '{folder}/orders.parquet'")
    return folder


def test_walk_with_relations_twice(spark, twice):
    assert same_as_sql(spark, "token_relationship_walk", twice) > same_as_sql(spark, "token_relationship_walk")


@pytest.mark.parametrize("name", ["account_details", "account_details_whole"])
def test_details_with_relations_twice(spark, twice, name):
    assert same_as_sql(spark, name, twice) > 50
