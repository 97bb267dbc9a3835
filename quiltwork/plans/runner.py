"""A stage runner: each stage is a Parquet table with a sidecar; a stage whose configuration and inputs are the same as
those it was written with, and whose checks hold, is skipped."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltwork.sources import files


@dataclass
class Stage:
    """build(spark, {name: DataFrame of an earlier stage}) -> DataFrame; checks: name -> condition every row must meet;
    keys: columns that must be unique together."""

    name: str
    build: Callable[[SparkSession, dict[str, DataFrame]], DataFrame]
    config: dict = field(default_factory=dict)
    after: tuple[str, ...] = ()
    checks: dict[str, str] = field(default_factory=dict)
    keys: tuple[str, ...] = ()


def _fingerprint(stage: Stage, upstream: dict[str, str]) -> str:
    return hashlib.sha256(json.dumps([stage.name, stage.config, stage.checks, stage.keys, upstream], sort_keys=True, default=str).encode()).hexdigest()


def validate(df: DataFrame, stage: Stage) -> tuple[bool, str]:
    """(holds, reason): every check over all rows in one aggregate, then uniqueness of the keys."""
    if stage.checks:
        broken = df.agg(*[F.count_if(~F.coalesce(F.expr(c), F.lit(False))).alias(n) for n, c in stage.checks.items()]).first().asDict()
        if bad := {n: k for n, k in broken.items() if k}:
            return False, f"rows that break a check: {bad}"
    if stage.keys and not df.groupBy(*stage.keys).count().filter("count > 1").isEmpty():
        return False, f"{stage.keys} are not unique"
    return True, ""


def run(spark: SparkSession, root: str, stages: list[Stage]) -> dict[str, str]:
    """Run the stages in order; returns name -> "written" or "skipped". A stage starts only if all it comes after are
    verified. A stage's table is replaced as one step and its mark is written last; a failing check stops the run before the mark, so
    the next run builds the stage again."""
    state, done, tables = {}, {}, {}
    for stage in stages:
        if missing := [a for a in stage.after if a not in done]:
            raise ValueError(f"{stage.name} comes after {missing}, which did not run")
        path, mark = f"{root}/{stage.name}", _fingerprint(stage, {a: done[a] for a in stage.after})
        side = f"{root}/_state/{stage.name}"
        table = files.current_table(spark, path) if read_mark(spark, side) == mark else None
        skip = table is not None and validate(table, stage)[0]
        if not skip:
            table = files.replace_table(stage.build(spark, tables), path)
            holds, why = validate(table, stage)
            if not holds:
                raise ValueError(f"{stage.name}: {why}")
            files.write_bytes(spark, side, mark.encode())
        done[stage.name], tables[stage.name], state[stage.name] = mark, table, "skipped" if skip else "written"
    return state


def read_mark(spark: SparkSession, side: str) -> str | None:
    found = files.read_bytes(spark, side)
    return None if found is None else found.decode()


def progress(spark: SparkSession, root: str, stages: list[Stage]) -> int:
    """Number of stages with a completion mark."""
    return sum(read_mark(spark, f"{root}/_state/{s.name}") is not None for s in stages)
