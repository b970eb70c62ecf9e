"""Tables on the way to a result, in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session (as in tests) uses a folder of this machine; a cluster without it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "/tmp/lintel-checkpoint"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends there, and a lost executor loses nothing."""
    return _written(df, f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}")


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that are written on the way to a result and deleted once no later step reads them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.paths = spark, shared_dir(spark), []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.paths.append(f"{self.folder}/{name}-{uuid.uuid4().hex}")
        return _written(df, self.paths[-1])

    def clear(self, but_last: int = 0) -> None:
        """Deletes the tables that were written, all but the last few."""
        gone = self.paths[: len(self.paths) - but_last]
        self.paths = self.paths[len(gone) :]
        for path in gone:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
