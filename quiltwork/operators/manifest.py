"""Valid-row counts per file and task, reconciled with the manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltwork.functions.text import has_text
from quiltwork.operators.tree import TreeState, tree_aggregate


def valid_rows(rows: DataFrame) -> DataFrame:
    """Rows that are objects with non-blank inputs and targets."""
    return rows.filter(F.coalesce("is_object", F.lit(False)) & has_text(F.col("inputs")) & has_text(F.col("targets")))


def valid_train_counts(rows: DataFrame, fan_in: int = 16) -> DataFrame:
    """(task_id, source_file, valid_train_count): distinct positions of valid train rows.

    The mergeable state of a file is a bitmap of its source_index values, one for each 32,768 positions, so a row
    that was delivered again sets the bit that is set already, one bit a row is shuffled, and the states of a
    task that holds most rows meet only fan_in at a time. Rows whose source_index is null or negative have no
    position to compare, so each of them counts. Null task_id and source_file are groups like any other.
    """
    train = valid_rows(rows).filter(F.col("split") == "train")
    place = F.when(F.col("source_index") >= 0, F.col("source_index"))
    parts = train.select(
        "task_id", "source_file", F.bitmap_bucket_number(place).alias("__bucket"), F.bitmap_bit_position(place).alias("__bit"),
        place.isNull().cast("long").alias("__loose"))
    merged = tree_aggregate(parts, ["task_id", "source_file", "__bucket"], [
        TreeState("__map", F.bitmap_construct_agg("__bit"), F.bitmap_or_agg("__map")),
        TreeState("__rest", F.sum("__loose"), F.sum("__rest")),
    ], fan_in)
    return merged.groupBy("task_id", "source_file").agg(
        F.sum(F.when(F.col("__bucket").isNull(), F.col("__rest")).otherwise(F.bitmap_count("__map"))).alias("valid_train_count"))


def task_counts(rows: DataFrame, fan_in: int = 16) -> DataFrame:
    """(task_id, valid_train_count)."""
    return valid_train_counts(rows, fan_in).groupBy("task_id").agg(F.sum("valid_train_count").alias("valid_train_count"))


def manifest_mismatches(rows: DataFrame, manifest: DataFrame, fan_in: int = 16) -> DataFrame:
    """(source_file): files whose manifest count is null or differs from the counted rows.

    A file without a manifest row has no count (null) and comes out; a file of the manifest without rows counts 0.
    """
    counted = valid_train_counts(rows, fan_in).groupBy("source_file").agg(F.sum("valid_train_count").alias("__counted"))
    stated = manifest.select("source_file", F.col("valid_train_count").alias("__stated"))
    both = counted.join(stated, "source_file", "full_outer")
    bad = F.col("__stated").isNull() | (F.col("__stated") != F.coalesce("__counted", F.lit(0)))
    return both.filter(bad & F.col("source_file").isNotNull()).select("source_file").distinct()
