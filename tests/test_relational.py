"""Relational queries on tables that the shared ones do not resemble."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lintel import catalogue


def test_top_percent_with_an_outlier(spark, tmp_path):
    prices = {k: 1e9 if k == 77 else None if k % 10 == 0 else float(100 + k % 50) for k in range(1, 4502)}
    spark.createDataFrame(list(prices.items()), "o_orderkey long, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    got = [r[0] for r in catalogue.queries()["top_percent"](spark, str(tmp_path)).collect()]
    want = sorted((k for k in prices if prices[k] is not None), key=lambda k: (-prices[k], k))[:5]
    assert sorted(got) == sorted(want)


def tree(spark, folder):
    got = catalogue.queries()["connect_by"](spark, str(folder))
    return got.dtypes, sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("case", ["gaps", "repeats", "deep", "none"])
def test_connect_by_on_odd_keys(spark, tmp_path, case):
    """Gaps, nulls, zero and negative keys, repeated keys, keys beyond what a double holds, roots alone."""
    chain = [(1 << n) + (1 << n) // 3 for n in range(1, 63)]
    keys = {
        "gaps": [None, 0, 1, -1, -2, -5, *(k for k in range(2, 40_000) if k % 11 != 5)],
        "repeats": [*range(2, 40), 2, 2, 5, 5, 20, 21, 21, *((1 << n) + (1 << n) // 2 for n in range(5, 20)), (1 << 16) + (1 << 15), (1 << 19) + (1 << 18)],
        "deep": [*chain, *(k + 1 for k in chain), *(1 << n for n in range(1, 40) if n != 30), (1 << 63) - 1],
        "none": [1, 9, 17],
    }[case]
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").write.parquet(str(tmp_path / "part.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")
    assert tree(spark, tmp_path) == ([("node", "bigint"), ("lvl", "int")], sorted(con.sql(catalogue.oracle_sql()["connect_by"]).fetchall()))


def test_connect_by_over_a_million_parts(spark, tmp_path):
    spark.range(1_100_000).withColumnRenamed("id", "p_partkey").write.parquet(str(tmp_path / "part.parquet"))
    found = catalogue.queries()["connect_by"](spark, str(tmp_path)).groupBy("lvl").agg(F.count("*"), F.countDistinct("node"), F.min("node"), F.max("node"))
    want = [(n, 1 << (n - 1), min(1 << n, 1_100_000) - 1) for n in range(1, 22)]
    assert sorted(map(tuple, found.collect())) == [(n, high - low + 1, high - low + 1, low, high) for n, low, high in want]
