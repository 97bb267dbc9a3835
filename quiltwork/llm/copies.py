"""Records that are identical but for formatting and field order: one record each, with the number of copies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltwork.llm.canonical import signatures_of
from quiltwork.llm.hot import attach
from quiltwork.session import release, spread, staged


ON = ["h1", "h2", "checked"]
_WAY = pa.struct([(c, pa.int64()) for c in ON])


def _columns(pairs: list[tuple[bytes, bytes]]) -> list[pa.Array]:
    wide = np.frombuffer(b"".join(p[0] for p in pairs), ">i8").reshape(-1, 2).astype(np.int64)
    return [pa.array(wide[:, 0]), pa.array(wide[:, 1]), pa.array(np.frombuffer(b"".join(p[1] for p in pairs), ">i8").astype(np.int64))]


def signatures(rows: DataFrame, key: str, inputs: str = "inputs", targets: str = "targets") -> DataFrame:
    """(key, h1, h2, checked, record, ways): both halves of the 128-bit hash of the canonical record and the check hash,
    whether inputs hold a record, and the signatures of all ways to read it, as in signatures_of. Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signed = [signatures_of(a or "", b or "") for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            ends = np.cumsum([0, *[len(s[2]) for s in signed]]).astype(np.int32)
            ways = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(_columns([w for s in signed for w in s[2]]), fields=list(_WAY)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *_columns([s[0] for s in signed]), pa.array([s[1] for s in signed], pa.bool_()), ways], names=[key, *ON, "record", "ways"])

    kind = dict(rows.dtypes)[key]
    return spread(rows.select(F.col(key), F.col(inputs), F.col(targets))).mapInArrow(run, f"`{key}` {kind}, h1 long, h2 long, checked long, record boolean, ways array<struct<h1: long, h2: long, checked: long>>")


def settled(signed: DataFrame, key: str, rows: int) -> DataFrame:
    """(key, h1, h2, checked): of the ways to read a record, the one that most rows can be read in.

    Copies of a record with another last field share one way only, the true one, and those with the same last field share all.
    So the true way has the most rows, or all copies stand alike and need none. Records that stand alike are one class;
    classes vote with their rows, and neither a number of rows nor the size of the table decides what is known. Rows find
    the way of their class as in hot.attach.
    """
    classes = staged(signed.filter("record").groupBy(*ON).agg(F.count("*").alias("n"), F.max("ways").alias("ways")), "classes")
    sure = classes.filter("size(ways) = 0").select(*ON, "n")
    offers = classes.filter("size(ways) > 0").select(F.struct(*ON).alias("own"), "n", F.explode("ways").alias("way")).select("own", "n", "way.*")
    votes = offers.select(*ON, "n").unionByName(sure).groupBy(*ON).agg(F.sum("n").alias("votes"))
    best = offers.join(votes, ON).groupBy("own", "n").agg(F.max(F.struct("votes", *ON)).alias("best"))
    chosen = F.when(F.col("best.votes") > F.col("n"), F.struct(*[F.col(f"best.{c}") for c in ON])).otherwise(F.col("own"))
    plan = staged(best.select("own.*", "n", chosen.alias("chosen")), "chosen")
    several = signed.filter("size(ways) > 0").select(key, *ON)
    one = signed.filter("size(ways) = 0").select(key, *ON)
    return one.unionByName(attach(several, plan, ON, "n", rows).select(key, "chosen.*"))


def copy_groups(signed: DataFrame, key: str) -> DataFrame:
    """(h1, h2, checked, first, copies): one row for each canonical record.

    Partial aggregates are combined where the rows lie, so a record with billions of copies sends one row a task.
    A 128-bit hash under which two check hashes are seen is a collision: its rows are grouped by both.
    """
    by_hash = signed.groupBy("h1", "h2").agg(F.min(key).alias("first"), F.count("*").alias("copies"), F.min("checked").alias("checked"), F.max("checked").alias("__most"))
    clean = by_hash.filter(F.col("checked") == F.col("__most")).drop("__most")
    collided = by_hash.filter(F.col("checked") != F.col("__most")).select("h1", "h2")
    again = signed.join(collided, ["h1", "h2"], "left_semi").groupBy("h1", "h2", "checked").agg(F.min(key).alias("first"), F.count("*").alias("copies"))
    return clean.select("h1", "h2", "checked", "first", "copies").unionByName(again.select("h1", "h2", "checked", "first", "copies"))


def copy_pairs(signed: DataFrame, groups: DataFrame, key: str, rows: int, limit: int | None = None) -> DataFrame:
    """(<key>_a, <key>_b): the smallest key of each set of copies with each other row of the set, joined as in hot.attach."""
    many = groups.filter("copies > 1").select(*ON, F.col("first").alias("__first"), "copies")
    placed = attach(signed.select(key, *ON), many, ON, "copies", rows, limit)
    return placed.filter(F.col("__first") != F.col(key)).select(F.col("__first").alias(f"{key}_a"), F.col(key).alias(f"{key}_b"))


def find_copies(rows: DataFrame, key: str = "row_id", inputs: str = "inputs", targets: str = "targets") -> tuple[DataFrame, DataFrame]:
    """(pairs, groups) over rows with unique keys: pairs as in copy_pairs; groups (first, copies) has one row for each
    canonical record, single ones included. An empty table gives none of either."""
    read = staged(signatures(rows, key, inputs, targets), "read")
    total = read.count()
    signed = staged(settled(read, key, total), "signatures")
    release(read)
    groups = staged(copy_groups(signed, key), "copies")
    return copy_pairs(signed, groups, key, total), groups.select("first", "copies")
