"""Multi-level tree aggregation for keys that hold most of the rows."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiltwork.session import input_partitions


@dataclass(frozen=True)
class TreeState:
    """One mergeable state: first over input rows, merge over states (by column name), both commutative."""

    name: str
    first: Column
    merge: Column


def fan_in_rounds(chunks: int, fan_in: int) -> int:
    """Rounds until one state is left per key when each round merges fan_in states."""
    return max(1, math.ceil(math.log(max(chunks, 1), fan_in) - 1e-9)) if chunks > 1 else 1


def tree_aggregate(df: DataFrame, keys: list[str], states: list[TreeState], fan_in: int = 16, chunks: int | None = None) -> DataFrame:
    """Aggregate by keys through a tree.

    An input split (a chunk of fixed size) is combined where it is read; its states go to slot ``chunk mod slots``,
    where at most about fan_in of them meet; then slots shrink by fan_in a round until one is left. No task ever
    receives more than fan_in states of one key, however many rows the key has, and what is shuffled is states,
    never rows. Null keys form groups of their own; an empty input gives no rows.
    """
    chunks = chunks or input_partitions(df)
    rounds = fan_in_rounds(chunks, fan_in)
    slots = fan_in ** (rounds - 1)
    slot = "__slot"
    level = df.withColumn(slot, F.pmod(F.spark_partition_id(), F.lit(slots)))
    out = level.groupBy(*keys, slot).agg(*[s.first.alias(s.name) for s in states])
    while slots > 1:
        slots //= fan_in
        out = out.withColumn(slot, F.pmod(F.col(slot), F.lit(slots))).groupBy(*keys, slot).agg(*[s.merge.alias(s.name) for s in states])
    return out.drop(slot)
