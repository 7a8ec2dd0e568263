"""New documents as they land: each content once, then what the corpus build does with a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def landed(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).load(path)


def contents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(sha256, key, source) of each content: its document of the least key. Null texts are empty."""
    rows = docs.select(F.sha2(F.coalesce(text, F.lit("")), 256).alias("sha256"), key, "source")
    return rows.groupBy("sha256").agg(F.min(F.struct(key, "source")).alias("r")).select("sha256", f"r.{key}", "r.source")


def record(batch: DataFrame, no: int, path: str, key: str = "doc_id", text: str = "text") -> None:
    """Writes the contents of micro-batch `no`; a batch that is run again replaces what it wrote, so nothing counts twice.

    The record is a table, not state of the stream: it grows on disk alone.
    """
    contents(batch, key, text).write.mode("overwrite").parquet(f"{path}/batch={no}")


def recorded(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """(sha256, key, source) of each content of all batches, whatever the order they came in."""
    rows = spark.read.parquet(path).groupBy("sha256").agg(F.min(F.struct(key, "source")).alias("r"))
    return rows.select("sha256", f"r.{key}", "r.source")


def unseen(batch: DataFrame, spark: SparkSession, path: str, no: int, text: str = "text") -> DataFrame:
    """Rows of micro-batch `no` whose content no earlier batch recorded."""
    if no == 0:
        return batch
    before = spark.read.parquet(path).where(F.col("batch") < no).select(F.col("sha256").alias("__h")).distinct()
    return batch.join(before, F.sha2(F.coalesce(text, F.lit("")), 256) == F.col("__h"), "left_anti")


def windowed_counts(events: DataFrame, at: str = "ts", width: str = "1 hour", late: str = "10 minutes", by: str = "event_type") -> DataFrame:
    """Counts and sums by tumbling window; events later than `late` are left out."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))


def start(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Runs `each` over micro-batches; a batch that broke off is run again with the same number."""
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
