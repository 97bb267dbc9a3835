"""Evaluation results: nested metric maps to wide rows, validity and a leaderboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESULT = "model string, mode string, budget int, results map<string,map<string,double>>, groups map<string,map<string,double>>"


def metric(entry: Column, name: str) -> Column:
    """"name,none", then "name", then the first key whose part before the comma is name."""
    rest = F.map_values(F.map_filter(entry, lambda k, _: F.substring_index(k, ",", 1) == name))
    return F.coalesce(F.try_element_at(entry, F.lit(f"{name},none")), F.try_element_at(entry, F.lit(name)), F.try_element_at(rest, F.lit(1)))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def leaderboard(reports: DataFrame, tasks: dict[str, str]) -> DataFrame:
    """One row a run: a column for each task with its preferred metric (groups before results; null where it is missing
    or not finite), the number of those present, and whether all are."""
    out = reports
    for task, name in tasks.items():
        value = F.coalesce(metric(F.try_element_at("groups", F.lit(task)), name), metric(F.try_element_at("results", F.lit(task)), name))
        out = out.withColumn(task, F.when(finite(value), value))
    present = sum(F.col(t).isNotNull().cast("int") for t in tasks)
    return out.withColumn("present", present).withColumn("status", F.when(F.col("present") == len(tasks), "complete").otherwise("failed")).select("model", "mode", "budget", *tasks, "present", "status")


def result_reasons(reports: DataFrame, tasks: dict[str, str]) -> DataFrame:
    """(model, mode, budget, task, reason): why a run is no valid result, a row for each task: missing_task (in neither map),
    missing_metric, not_finite, out_of_range (outside 0 .. 1 by more than nothing). A valid run has no row."""
    checks = []
    for task, name in tasks.items():
        entry = F.coalesce(F.try_element_at("groups", F.lit(task)), F.try_element_at("results", F.lit(task)))
        value = metric(entry, name)
        why = F.when(entry.isNull(), "missing_task").when(value.isNull(), "missing_metric").when(~finite(value), "not_finite").when((value < 0) | (value > 1), "out_of_range")
        checks.append(F.struct(F.lit(task).alias("task"), why.alias("reason")))
    long = reports.select("model", "mode", "budget", F.explode(F.array(*checks)).alias("x"))
    return long.select("model", "mode", "budget", "x.task", "x.reason").filter("reason is not null")


def run_checks(points: DataFrame, expected: DataFrame, run: str = "run", step: str = "step", rate: str = "lr") -> DataFrame:
    """(run, check): what is wrong with the log of a run: no_points (expected, but nothing logged), not_expected, wrong_last_step,
    repeated_step, rate_not_finite, rate_negative. expected has (run, last_step). A sound run has no row."""
    facts = points.groupBy(run).agg(F.max(step).alias("__last"), (F.count("*") > F.countDistinct(step)).alias("__again"), F.bool_or(~finite(F.col(rate))).alias("__odd"), F.bool_or(F.col(rate) < 0).alias("__low"))
    both = facts.withColumn("__here", F.lit(True)).join(expected.select(run, F.col("last_step").alias("__want")).withColumn("__listed", F.lit(True)), run, "full_outer")
    rules = {"no_points": F.col("__here").isNull(), "not_expected": F.col("__listed").isNull(), "wrong_last_step": F.col("__last") != F.col("__want"), "repeated_step": F.col("__again"), "rate_not_finite": F.col("__odd"), "rate_negative": F.col("__low")}
    found = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return both.select(run, F.explode(found).alias("check"))


def learning_rate_rises(points: DataFrame, step: str = "step", rate: str = "lr", warm_up: int = 0, run: str = "run") -> DataFrame:
    """Points after the warm-up at which the rate rises above the one before by more than 1e-8 of it."""
    from pyspark.sql import Window

    before = F.lag(rate).over(Window.partitionBy(run).orderBy(step))
    return points.filter(F.col(step) > warm_up).withColumn("before", before).filter(F.col(rate) > F.col("before") * (1 + 1e-8))
