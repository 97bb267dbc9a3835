"""Validity of raw examples as they arrive: an extension; the batch operators run unchanged on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltwork.operators.validity import is_valid


def example_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def validity_counts(rows: DataFrame) -> DataFrame:
    """Valid and all rows by day and split; works on a stream (complete or update mode) and on a table."""
    return rows.groupBy("batch_day", "split").agg(F.count_if(is_valid()).alias("valid"), F.count("*").alias("n"))


def hourly_counts(rows: DataFrame, late: str = "2 days") -> DataFrame:
    """Rows by hour of loading; a row is counted once by its position, and one later than the watermark is dropped.
    Rows without a load time cannot be placed and are left out."""
    timed = rows.filter("loaded_at is not null").withWatermark("loaded_at", late).dropDuplicatesWithinWatermark(["source_file", "split", "source_index"])
    return timed.groupBy(F.window("loaded_at", "1 hour").alias("hour"), "split").agg(F.count_if(is_valid()).alias("valid"), F.count("*").alias("n"))


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "complete") -> None:
    """Process what is there and stop; each batch replaces (complete) or extends (append) the table at out."""
    if mode == "append":
        stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return
    write = lambda df, _: df.write.mode("overwrite").parquet(out)
    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
