"""Row validity, quarantine, manifests and inventories of raw examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiltwork.functions.text import has_text, is_blank, preview

# Reasons in the order in which they are reported.
REASONS = ("row_not_object", "inputs_not_string", "inputs_empty", "targets_not_string", "targets_empty")


def is_valid() -> Column:
    """An object whose inputs and targets are texts with at least one visible character."""
    return F.coalesce("is_object", F.lit(False)) & has_text(F.col("inputs")) & has_text(F.col("targets"))


def reasons() -> Column:
    """Why a row is invalid, in fixed order; empty for a valid row. A row that is no object has that reason alone."""
    def of(name: str) -> list[Column]:
        c = F.col(name)
        return [F.when(c.isNull(), F.lit(f"{name}_not_string")), F.when(is_blank(c), F.lit(f"{name}_empty"))]

    parts = F.filter(F.array(*of("inputs"), *of("targets")), lambda x: x.isNotNull())
    return F.when(~F.coalesce("is_object", F.lit(False)), F.array(F.lit("row_not_object"))).otherwise(parts)


def attach_catalog(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """Valid rows with the metadata of their task; source_index stays what it was before filtering."""
    facts = catalog.select("task_id", "task_index", "domain")
    return rows.filter(is_valid()).join(facts, "task_id")


def quarantine(rows: DataFrame, chars: int = 80) -> DataFrame:
    """Invalid rows with their reasons and previews."""
    return rows.withColumn("reasons", reasons()).filter(F.size("reasons") > 0).select(
        "row_id", "source_file", "split", "source_index", F.array_join("reasons", ",").alias("reasons"),
        preview(F.col("inputs"), chars).alias("inputs_preview"), preview(F.col("targets"), chars).alias("targets_preview"))


def manifest(rows: DataFrame) -> DataFrame:
    """One row for each file: source, valid and excluded rows and the count of each reason, for train and validation."""
    marked = rows.withColumn("__reasons", reasons())
    aggs = []
    for s in ("train", "validation"):
        here = F.col("split") == s
        aggs += [F.count_if(here).alias(f"source_{s}_count"), F.count_if(here & (F.size("__reasons") == 0)).alias(f"valid_{s}_count"), F.count_if(here & (F.size("__reasons") > 0)).alias(f"excluded_{s}_count")]
        aggs += [F.count_if(here & F.array_contains("__reasons", r)).alias(f"{s}_{r}_count") for r in REASONS]
    return marked.groupBy("corpus", "task_id", "task_name", "source_file").agg(*aggs)


def reason_counts(rows: DataFrame) -> DataFrame:
    """Count of each reason by task and split, by split, and in all; null where a level is summed up."""
    long = rows.select("task_id", "split", F.explode(reasons()).alias("reason"))
    return long.groupingSets([["task_id", "split", "reason"], ["split", "reason"], ["reason"]], "task_id", "split", "reason").agg(F.count("*").alias("n"))


def empty_audit(rows: DataFrame) -> DataFrame:
    """Empty inputs and targets by task, counted independently; a row that is no object counts in both."""
    empty = lambda c: F.count_if(~has_text(F.col(c)) | ~F.coalesce("is_object", F.lit(False))).alias(f"empty_{c}")
    return rows.groupBy("task_id").agg(F.count("*").alias("n"), empty("inputs"), empty("targets"))


def split_statistics(rows: DataFrame) -> DataFrame:
    """Counts and lengths in code points by task and split; the mean is 0.0 where no text is."""
    aggs = [F.count("*").alias("n"), F.count_if(F.size(reasons()) > 0).alias("invalid")]
    for c in ("inputs", "targets"):
        size = F.length(F.col(c))
        mean = F.when(F.count(c) > 0, F.bround(F.sum(size) / F.count(c), 2)).otherwise(0.0)
        aggs += [F.count_if(F.col(c).isNull()).alias(f"{c}_null"), F.count_if(is_blank(F.col(c))).alias(f"{c}_blank"), F.coalesce(F.max(size), F.lit(0)).alias(f"{c}_max_chars"), F.coalesce(F.sum(size), F.lit(0)).alias(f"{c}_chars"), mean.alias(f"{c}_mean_chars")]
    return rows.groupBy("task_id", "split").agg(*aggs)


def type_histogram(rows: DataFrame) -> DataFrame:
    """Types of the inputs of a task over both splits, as a JSON object with sorted keys."""
    kind = F.when(~F.coalesce("is_object", F.lit(False)), "row_not_object").when(F.col("inputs").isNull(), "null").otherwise("str")
    counted = rows.groupBy("task_id", kind.alias("kind")).agg(F.count("*").alias("n"))
    pairs = F.array_sort(F.collect_list(F.concat(F.lit('"'), "kind", F.lit('": '), F.col("n").cast("string"))))
    return counted.groupBy("task_id").agg(F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}")).alias("types"))


def corpus_rollup(manifest_rows: DataFrame) -> DataFrame:
    """Tasks, rows and the largest task (ties: smaller id) by corpus and in all."""
    tasks = manifest_rows.groupBy("corpus", "task_id").agg(F.sum("source_train_count").alias("train"), F.sum("source_validation_count").alias("validation"))
    largest = F.min(F.struct(-F.col("train"), F.col("task_id")))
    return tasks.rollup("corpus").agg(F.count("*").alias("tasks"), F.sum("train").alias("train"), F.sum("validation").alias("validation"), F.sum(F.col("train") + F.col("validation")).alias("total"), largest.alias("__x")).select("corpus", "tasks", "train", "validation", "total", F.col("__x.task_id").alias("largest_task"))


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number; null keys compare equal."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
