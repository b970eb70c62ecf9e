"""Streams against their batch twins."""

from pyspark.sql import functions as F

from lintel.functions import rules
from lintel.streaming import windows

EVENTS = "/root/testdata/sf0.001/events.parquet"


def test_tumbling_stream_equals_batch(spark):
    batch = spark.read.parquet(EVENTS)
    stream = spark.readStream.schema(batch.schema).parquet(f"{EVENTS}*")
    windows.tumbling(stream).writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).start().awaitTermination(120)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(spark.table("tumbled")) == key(windows.tumbling(batch)) != []


def test_findings_are_appended(spark, tmp_path):
    statements = spark.createDataFrame([(1, "DELETE FROM t"), (2, "SELECT a FROM t WHERE a = NULL"), (3, "SELECT a FROM t")], "query_id long, text string")
    statements.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(statements.schema).parquet(str(tmp_path / "in"))
    windows.append_findings(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination(120)
    key = lambda df: sorted(map(tuple, df.select(F.col("query_id"), "code").collect()))
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(rules.findings(statements)) != []
