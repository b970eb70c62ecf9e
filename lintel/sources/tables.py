"""Tables of a folder, as DataFrames and as views; the scans of each connector's statement heads."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """`text` over the tables of `sf_dir`; only tables that it names become views."""
    for name in TABLES:
        if re.search(rf"\b{name}\b", text):
            load(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(text)


#: First words of statements that give rows, by engine; other statements give an update count.
ROW_HEADS = {
    "mysql": ["SELECT", "SHOW", "DESCRIBE", "DESC", "EXPLAIN", "WITH"],
    "postgresql": ["SELECT", "SHOW", "DESCRIBE", "DESC", "EXPLAIN", "WITH", "TABLE", "VALUES"],
    "sqlserver": ["SELECT", "SHOW", "DESCRIBE", "DESC", "EXPLAIN", "WITH", "TABLE", "VALUES"],
    "sqlite": ["SELECT", "SHOW", "DESCRIBE", "DESC", "EXPLAIN", "WITH", "PRAGMA", "VALUES"],
}


def jdbc_scan(spark: SparkSession, url: str, query: str, engine: str, partition: dict | None = None, **options: str) -> DataFrame:
    """A database's rows for `query`; `partition` gives column, lower and upper bound and the number of parallel reads.

    With partition bounds Spark reads ranges side by side instead of all rows through one connection.
    """
    head = query.split(None, 1)[0].upper() if query.strip() else ""
    if engine in ROW_HEADS and head not in ROW_HEADS[engine]:
        raise ValueError(f"{head} gives no rows")
    if engine == "oracle" and "LIMIT" in query.upper().split():
        raise ValueError("Oracle has no LIMIT")
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if partition is None:
        return reader.option("query", query).load()
    bounds = {"partitionColumn": partition["column"], "lowerBound": partition["lower"], "upperBound": partition["upper"], "numPartitions": partition["parts"]}
    return reader.option("dbtable", f"({query}) q").options(**bounds).load()
