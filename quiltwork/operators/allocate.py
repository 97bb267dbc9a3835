"""Gains to exact integer budgets: Taylor weights, floors with cyclic remainders, capacities with cyclic redistribution."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def taylor(gain: Column, temperature: float = 1.0, order: int = 2) -> Column:
    """Taylor polynomial of exp(gain / temperature); an even order keeps it positive."""
    if order % 2:
        raise ValueError("order must be even")
    x = gain / F.lit(temperature)
    return sum((F.pow(x, F.lit(i)) / F.lit(float(math.factorial(i))) for i in range(1, order + 1)), F.lit(1.0))


def _over_tasks(c: Column) -> Column:
    """An aggregate over all tasks: a few hundred rows, one a task."""
    return c.over(Window.partitionBy(F.lit(0)))


def taylor_weights(ranked: DataFrame, temperature: float = 1.0, order: int = 2) -> DataFrame:
    """ranked (rank, ..., marginal_gain) with scaled_gain, taylor_score and weight."""
    scored = ranked.withColumn("scaled_gain", F.col("marginal_gain") / F.lit(temperature)).withColumn("taylor_score", taylor(F.col("marginal_gain"), temperature, order))
    return scored.withColumn("weight", F.col("taylor_score") / _over_tasks(F.sum("taylor_score")))


def floor_remainder(weighted: DataFrame, budget: int) -> DataFrame:
    """raw = weight x budget, its floor, and one more for the first tasks in rank order until the budget is met."""
    out = weighted.withColumn("raw", F.col("weight") * budget).withColumn("floor", F.floor("raw"))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("rank"))
    out = out.withColumn("remainder", (place <= F.lit(budget) - _over_tasks(F.sum("floor"))).cast("long"))
    return out.withColumn("pre_cap", F.col("floor") + F.col("remainder"))


def cap_redistribute(allotted: DataFrame) -> DataFrame:
    """Cap pre_cap at capacity; what overflows is handed out one unit a task a cycle, in rank order, while capacity is
    left. A task's n-th free unit is its slot in cycle n, so the first `overflow` slots by (cycle, rank) are granted;
    instead of listing slots, the last whole cycle is found by bisection over the few tasks' free capacities. A budget
    above the total capacity is an error."""
    capped = allotted.withColumn("overflow", F.greatest(F.col("pre_cap") - F.col("capacity"), F.lit(0))).withColumn("free", F.greatest(F.col("capacity") - F.col("pre_cap"), F.lit(0)))
    facts = capped.select("rank", "overflow", "free").collect()  # one row a task: a few hundred
    todo = sum(r[1] for r in facts)
    if todo > sum(r[2] for r in facts):
        raise ValueError("the budget exceeds the total capacity")
    low, high = 0, max([r[2] for r in facts], default=0)
    while low < high:  # most whole cycles that fit
        middle = (low + high + 1) // 2
        low, high = (middle, high) if sum(min(r[2], middle) for r in facts) <= todo else (low, middle - 1)
    left = todo - sum(min(r[2], low) for r in facts)
    last = sorted(r[0] for r in facts if r[2] > low)[:left]
    extra = F.least("free", F.lit(low)) + F.when(F.col("rank").isin(last), 1).otherwise(0) if last else F.least("free", F.lit(low))
    out = capped.withColumn("redistributed", extra.cast("long"))
    return out.withColumn("final", F.least("pre_cap", "capacity") + F.col("redistributed")).drop("free")


def allocate(ranked: DataFrame, budget: int, temperature: float = 1.0) -> DataFrame:
    """(rank, task, capacity, marginal_gain) -> the same with every step up to `final`, which sums to budget."""
    return cap_redistribute(floor_remainder(taylor_weights(ranked, temperature), budget))


def budget_split(budget: Column, a: Column, b: Column) -> Column:
    """Share of a when budget is split in the ratio a : b: the floor, and the one left over goes to a first."""
    total = a + b
    floor_a, floor_b = F.floor(budget * a / total), F.floor(budget * b / total)
    return F.when(total == 0, F.lit(0)).otherwise(floor_a + F.least(F.lit(1), budget - floor_a - floor_b)).cast("long")


def template_split(counts: DataFrame, budget: str = "budget") -> DataFrame:
    """Budget of a task over its four template types: zero-shot against few-shot by their counts, then with against
    without options in each; an empty side leaves all to the other."""
    n = {t: F.col(f"{t}_count") for t in ("zs_opt", "zs_noopt", "fs_opt", "fs_noopt")}
    zero = F.when(n["fs_opt"] + n["fs_noopt"] == 0, F.col(budget)).otherwise(budget_split(F.col(budget), n["zs_opt"] + n["zs_noopt"], n["fs_opt"] + n["fs_noopt"]))
    out = counts.withColumn("__zero", zero).withColumn("__few", F.col(budget) - F.col("__zero"))
    for side, share in (("zs", "__zero"), ("fs", "__few")):
        out = out.withColumn(f"{side}_opt_budget", F.when(n[f"{side}_noopt"] == 0, F.col(share)).when(n[f"{side}_opt"] == 0, F.lit(0)).otherwise(budget_split(F.col(share), n[f"{side}_opt"], n[f"{side}_noopt"])).cast("long"))
        out = out.withColumn(f"{side}_noopt_budget", F.col(share) - F.col(f"{side}_opt_budget"))
    return out.drop("__zero", "__few")


def required_prefix(wide: DataFrame, budgets: list[str]) -> Column:
    return F.greatest(*[F.col(b) for b in budgets]) if len(budgets) > 1 else F.col(budgets[0])


def monotone(long: DataFrame) -> DataFrame:
    """(task_id, budget, final) -> the steps at which a larger budget gives a task less."""
    before = F.lag("final").over(Window.partitionBy("task_id").orderBy("budget"))
    return long.withColumn("before", before).filter(F.col("final") < F.col("before"))
