"""Mixture assembly: selected rows, positions, seeded orders, nested budgets, and digests."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiltwork.session import staged

BOUND = 1_000_000  # rows of a budgeted selection that one process may hold as keys


def with_positions(rows: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """0-based global position in the given total order, without one task for all rows: rows are range-partitioned, sorted and
    staged with their partition and place in it, the sizes of the partitions (one number each) give their offsets, and a row's
    position is offset + place. Staging pins the partitions, which sampling may cut differently each time the plan runs. The order must
    be total for the result to be unique."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, *[F.col(c) for c in order]).sortWithinPartitions(*order)
    marked = staged(placed.withColumn("__part", F.spark_partition_id()).withColumn("__in", F.monotonically_increasing_id() - F.shiftleft(F.col("__part").cast("long"), 33)), "positions")
    sizes = marked.groupBy("__part").agg(F.count("*").alias("__n"))
    offsets = sizes.withColumn(name, F.coalesce(F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return marked.join(F.broadcast(offsets.select("__part", name)), "__part").withColumn(name, F.col(name) + F.col("__in")).drop("__part", "__in")


def rank_within(rows: DataFrame, group: str, order: list[str], name: str = "rank") -> DataFrame:
    """1-based rank inside each group, where a group may hold a third of all rows: positions over (group, order), less the
    first position of the group (one number a group). Null is a group like any other."""
    placed = with_positions(rows, [group, *order], "__pos")
    first = placed.groupBy(F.col(group).alias("__g")).agg(F.min("__pos").alias("__first"))
    return placed.join(first, F.col(group).eqNullSafe(F.col("__g"))).withColumn(name, F.col("__pos") - F.col("__first") + 1).drop("__pos", "__first", "__g")


def hash_order(rows: DataFrame, seed: int, position: str = "position", name: str = "final_position") -> DataFrame:
    """final_position by the sha256 of seed and position: a seeded order of any number of rows (see shuffle for NumPy's)."""
    keyed = rows.withColumn("__h", F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(position).cast("string")), 256))
    return with_positions(keyed, ["__h", position], name).drop("__h")


def seeded_permutation(n: int, seed: int) -> np.ndarray:
    """Row at final position p, as NumPy's default generator permutes n rows."""
    return np.random.default_rng(seed).permutation(n)


def seeded_subset(n: int, k: int, seed: int) -> list[int]:
    """First k of the standard library's shuffle of range(n), in shuffled order."""
    order = list(range(n))
    random.Random(seed).shuffle(order)
    return order[:k]


def shuffle(rows: DataFrame, seed: int, n: int, position: str = "position", name: str = "final_position") -> DataFrame:
    """final_position by NumPy's seeded permutation of the n positions of a budgeted mixture, which one process must draw as a
    whole: at most BOUND rows (an error beyond; hash_order has no bound)."""
    if n > BOUND:
        raise ValueError(f"NumPy's order is drawn for at most {BOUND} rows")
    order = seeded_permutation(n, seed)
    where = np.empty(n, np.int64)
    where[order] = np.arange(n)
    spark = rows.sparkSession
    table = spark.createDataFrame(pd.DataFrame({position: np.arange(n), name: where}), f"{position} long, {name} long")
    return rows.join(table, position)


def prefix(selection: DataFrame, budgets: DataFrame, group: str = "task_id", rank: str = "rank", budget: str = "budget") -> DataFrame:
    """First `budget` rows of each ordering."""
    return selection.join(budgets.select(group, budget), group).filter(F.col(rank) <= F.col(budget))


def inclusion_flags(rows: DataFrame, budgets: dict[str, Column], rank: str = "rank") -> DataFrame:
    return rows.withColumns({f"included_in_{name}": F.col(rank) <= k for name, k in budgets.items()})


def membership_digest(rows: DataFrame, group: str, keys: list[str]) -> DataFrame:
    """(group, n, digest): number of rows of each group and the exclusive or of the first 60 bits of each row's sha256, so neither
    the order nor the size of a group matters; partial digests are combined where the rows lie."""
    h = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]), 256)
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.bit_xor(F.conv(F.substring(h, 1, 15), 16, 10).cast("long")).alias("digest"))


def sorted_membership_hash(rows: DataFrame, keys: list[str], bound: int | None = None) -> DataFrame:
    """sha256 over the sorted keys of a budgeted selection of at most BOUND rows (an error beyond; membership_digest has no
    bound)."""
    line = F.concat(F.concat_ws("\x00", *[F.col(k).cast("string") for k in keys]), F.lit("\n"))
    few = rows.select(line.alias("l")).limit((bound or BOUND) + 1)
    too_many = F.raise_error(F.lit("too many rows for one sorted list")).cast("string")
    return few.agg(F.when(F.count("*") > (bound or BOUND), too_many).otherwise(F.sha2(F.array_join(F.array_sort(F.collect_list("l")), ""), 256)).alias("digest"))


def ordered_content_hash(rows: DataFrame, position: str, texts: list[str]) -> str:
    """sha256 over rows in order; rows come to the driver one partition at a time and are not kept."""
    h = hashlib.sha256()
    for r in rows.orderBy(position).select(*texts).toLocalIterator():
        h.update(b"\x00".join((x or "").encode() for x in r) + b"\n")
    return h.hexdigest()


def even_sample(rows: DataFrame, order: list[str], n: int, m: int) -> DataFrame:
    """The rows at positions floor(i n / m), i < m, of n ordered rows."""
    placed = with_positions(rows, order, "__pos")
    i = F.ceil(F.col("__pos") * m / n).cast("long")
    hit = lambda x: (x < m) & (F.floor(x * n / m) == F.col("__pos"))
    return placed.filter(hit(i) | hit(F.greatest(i - 1, F.lit(0)))).drop("__pos")


def first_divergence(a: DataFrame, b: DataFrame, keys: list[str], rank: str, item: str) -> DataFrame:
    """Least rank at which two orderings differ, by keys; null where they agree."""
    both = a.select(*keys, rank, F.col(item).alias("__a")).join(b.select(*keys, rank, F.col(item).alias("__b")), [*keys, rank], "full_outer")
    return both.groupBy(*keys).agg(F.min(F.when(~F.col("__a").eqNullSafe(F.col("__b")), F.col(rank))).alias("first_divergence"))


def reconcile(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of one side only, with the side: missing (in a, not in b) or unexpected (in b, not in a)."""
    x, y = a.select(*keys).distinct(), b.select(*keys).distinct()
    return x.join(y, keys, "left_anti").withColumn("side", F.lit("missing")).unionByName(y.join(x, keys, "left_anti").withColumn("side", F.lit("unexpected")))


def pack_bins(rows: DataFrame, cost: str, key: str, bins: int) -> DataFrame:
    """Longest-processing-time packing of a few hundred items: costliest first, each to the least loaded bin (ties:
    lowest bin). A report; Spark's scheduler does the work itself."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        load = np.zeros(bins)
        pdf = pdf.sort_values(["__cost", "__key"], ascending=[False, True])
        out = []
        for k, c in zip(pdf["__key"], pdf["__cost"]):
            b = int(load.argmin())
            load[b] += c
            out.append((k, b))
        return pd.DataFrame(out, columns=[key, "bin"])

    kind = dict(rows.dtypes)[key]
    few = rows.select(F.col(key).alias("__key"), F.col(cost).cast("double").alias("__cost"), F.lit(0).alias("__all"))
    return few.groupBy("__all").applyInPandas(run, f"{key} {kind}, bin int")


def hash_probe(rows: DataFrame, group: str, keys: list[str], k: int, seed: int = 23) -> DataFrame:
    """The k rows of each group with the lowest sha256 of seed and keys; Spark keeps k rows a task and group before the
    shuffle."""
    score = F.sha2(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in keys]), 256)
    place = F.row_number().over(Window.partitionBy(group).orderBy("__h", *keys))
    return rows.withColumn("__h", score).withColumn("probe", place).filter(F.col("probe") <= k).drop("__h")
