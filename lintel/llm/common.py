"""What the operators share: table reading, checked broadcasts, ASCII lower case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.sources.shared import Scratch, materialise, shared_dir  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The white space that separates words in every operator on words.
SPACE = r"[\x20\x09-\x0D]+"

#: Largest table, as an estimate in bytes, that an operator broadcasts; larger ones are shuffled.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sized_broadcast(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """`df` marked for broadcast only if `rows` counted rows of about `row_bytes` stay under BROADCAST_BYTES."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
