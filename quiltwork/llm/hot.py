"""Joins of rows to their group where one group may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FLOOR, CEILING = 1000, 1_000_000


def hot_size(total: int) -> int:
    """Rows from which on a group is hot: a thousandth of all rows, at least FLOOR and at most CEILING. So no task of a hash join
    meets more than a million rows of one group, and at most max(1000, total / 1,000,000) groups are hot."""
    return max(FLOOR, min(CEILING, total // 1000))


def attach(rows: DataFrame, groups: DataFrame, on: list[str], size: str, total: int, limit: int | None = None) -> DataFrame:
    """Inner join of rows with the one row of their group (columns on, size and others; size = number of rows of the group). Hot
    groups are broadcast, so their rows stay where they lie; the rows of all others are joined by hash."""
    limit = hot_size(total) if limit is None else limit
    rest = [c for c in groups.columns if c not in on]
    hot = groups.filter(F.col(size) > limit).select(*on, F.struct(*rest).alias("__hot"))
    cold = groups.filter(F.col(size) <= limit).select(*on, F.struct(*rest).alias("__cold"))
    placed = rows.join(F.broadcast(hot), on, "left")
    own = [c for c in rows.columns]
    warm = placed.filter("__hot is not null").select(*own, "__hot.*")
    return warm.unionByName(placed.filter("__hot is null").drop("__hot").join(cold, on).select(*own, "__cold.*"))
