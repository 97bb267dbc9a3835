"""Length audit: token lengths, what truncation leaves to learn from, summaries and eval-safe splits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PERCENTILES = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p999": 0.999}


def white_space_length(c: Column) -> Column:
    """Default tokenizer: runs without white space."""
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda x: x != "")).cast("long")


def with_lengths(rows: DataFrame, limit: int, length: Callable[[Column], Column] = white_space_length, specials: int = 1) -> DataFrame:
    """prompt and full lengths and what is left of them under a limit: retained, masked, supervised, untruncated
    response, lost. A null response is empty."""
    full = length(F.concat(F.coalesce("prompt", F.lit("")), F.lit(" "), F.coalesce("response", F.lit("")))) + specials
    return with_supervision(rows.withColumn("prompt_len", length(F.col("prompt")) + specials).withColumn("full_len", full), limit)


def with_supervision(rows: DataFrame, limit: int) -> DataFrame:
    """The same from length columns prompt_len and full_len, such as those of a tokenizer."""
    out = rows.withColumn("retained", F.least("full_len", F.lit(limit))).withColumn("masked", F.least("prompt_len", F.lit(limit), "retained"))
    out = out.withColumn("supervised", F.col("retained") - F.col("masked")).withColumn("untruncated", F.greatest(F.col("full_len") - F.col("prompt_len"), F.lit(0)))
    return out.withColumn("lost", F.greatest(F.col("untruncated") - F.col("supervised"), F.lit(0)))


def length_summary(sized: DataFrame, keys: list[str], column: str) -> DataFrame:
    """min, mean, exact percentiles (linear interpolation), max and sum by keys."""
    p = F.percentile(column, F.array(*[F.lit(x) for x in PERCENTILES.values()]))
    out = sized.groupBy(*keys).agg(F.count("*").alias("n"), F.min(column).alias("min"), F.round(F.avg(column), 6).alias("mean"), F.max(column).alias("max"), F.sum(column).alias("sum"), p.alias("__p"))
    return out.select(*keys, "n", "min", "mean", *[F.round(F.col("__p")[i], 6).alias(name) for i, name in enumerate(PERCENTILES)], "max", "sum")


def threshold_counts(sized: DataFrame, keys: list[str], limit: int) -> DataFrame:
    c = lambda e, name: F.count_if(F.expr(e)).alias(name)
    out = sized.groupBy(*keys).agg(F.count("*").alias("n"), c(f"full_len > {limit}", "truncated"), c(f"retained = {limit}", "at_limit"), c("lost > 0", "losing"), c("supervised = 0", "zero"), c("supervised < 8", "under_8"), c("supervised < 32", "under_32"))
    return out.withColumn("zero_fraction", F.round(F.col("zero") / F.col("n"), 6))


def retention(sized: DataFrame, keys: list[str]) -> DataFrame:
    """Share of the response kept, over rows that have one; null where none has."""
    r = F.when(F.col("untruncated") > 0, F.col("supervised") / F.col("untruncated"))
    # rows with the same pair of lengths count once, with their number, so the percentile's map holds pairs, not rows
    sized = sized.groupBy(*keys, "supervised", "untruncated").agg(F.count("*").alias("__n"))
    mean = F.sum(r * F.col("__n")) / F.sum(F.when(r.isNotNull(), F.col("__n")))
    return sized.groupBy(*keys).agg(F.round(mean, 6).alias("mean"), F.round(F.percentile(r, 0.01, F.col("__n")), 6).alias("p01"), F.round(F.percentile(r, 0.05, F.col("__n")), 6).alias("p05"), F.round(F.percentile(r, 0.5, F.col("__n")), 6).alias("p50"), F.round(F.min(r), 6).alias("min"))


def zero_supervision(sized: DataFrame, limit: int) -> Column:
    return F.least("prompt_len", F.lit(limit)) >= F.least("full_len", F.lit(limit))


def longest(sized: DataFrame, k: int, column: str = "full_len", key: str = "mix_id") -> DataFrame:
    """The k longest rows; on ties the larger key comes first."""
    return sized.orderBy(F.desc(column), F.desc(key)).limit(k)
