"""Tables between steps, under the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, a temporary one, in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="quillon-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Store:
    """Written tables that several later steps read, so that none of them computes what the others need again."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, folder(spark, name)
        atexit.register(self.drop)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self) -> None:
        try:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session may be gone by now
            pass
