"""Vectors as double arrays: norms, means, similarity, certificates and coverage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalised(a: Column) -> Column:
    """Unit vector; null for a zero vector."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def all_finite(a: Column) -> Column:
    return F.forall(a, lambda x: ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))


def vector_sums(rows: DataFrame, group: str, vector: str = "embedding") -> DataFrame:
    """(group, n, total): component-wise sums in double. A task adds its vectors up as arrays and sends one row a group; the
    partial sums are added up the same way. Vectors of a group have one length; null vectors are left out."""
    kind = dict(rows.dtypes)[group]
    schema = f"`{group}` {kind}, n long, total array<double>"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        own_kind = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
            own_kind, coded = batch.column(0).type, batch.column(0).dictionary_encode(null_encoding="encode")
            codes = coded.indices.to_numpy()
            for c, name in enumerate(coded.dictionary.to_pylist()):
                own = codes == c
                n, total = sums.get(name, (0, 0.0))
                sums[name] = (n + int(own.sum()), total + x[own].sum(axis=0))
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), own_kind), pa.array([n for n, _ in sums.values()], pa.int64()), pa.array([t.tolist() for _, t in sums.values()], pa.list_(pa.float64()))], names=[group, "n", "total"])

    def final(table: pa.Table) -> pa.Table:
        total = np.sum(np.array(table.column("total").to_pylist(), float), axis=0)
        return pa.table({group: table.column(group).slice(0, 1), "n": pa.array([sum(table.column("n").to_pylist())], pa.int64()), "total": pa.array([total.tolist()], pa.list_(pa.float64()))})

    return rows.filter(F.col(vector).isNotNull()).select(group, vector).mapInArrow(partial, schema).groupBy(group).applyInArrow(final, schema)


def mean_vectors(rows: DataFrame, group: str, vector: str = "embedding", digits: int | None = None) -> DataFrame:
    """(group, n, mean): component-wise mean in double, from vector_sums."""
    value = lambda x: F.round(x / F.col("n"), digits) if digits is not None else x / F.col("n")
    return vector_sums(rows, group, vector).select(group, "n", F.transform("total", value).alias("mean"))


def norm_statistics(rows: DataFrame, group: str, vector: str = "embedding") -> DataFrame:
    n = norm(F.col(vector))
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.round(F.min(n), 6).alias("min_norm"), F.round(F.avg(n), 6).alias("mean_norm"), F.round(F.max(n), 6).alias("max_norm"), F.count_if(n == 0).alias("zero"), F.count_if(~all_finite(F.col(vector))).alias("not_finite"))


def kernel(means: DataFrame, key: str, vector: str = "mean", most: int = 10_000) -> DataFrame:
    """(i, j, s): cosine of every pair of a few hundred task vectors, as one product of matrices in one task; more than
    `most` vectors are an error, as the kernel grows with their square. A zero vector has null cosines."""
    kind = dict(means.dtypes)[key]

    def run(table: pa.Table) -> pa.Table:
        n = table.num_rows
        if n > most:
            raise ValueError(f"a kernel of {n} vectors; at most {most}")
        keys = table.column(key).combine_chunks()
        x = np.array(table.column(vector).to_pylist(), float).reshape(n, -1)
        length = np.linalg.norm(x, axis=1)
        with np.errstate(invalid="ignore", divide="ignore"):
            u = x / length[:, None]
        s = u @ u.T
        i, j = np.divmod(np.arange(n * n), n)
        return pa.table({"i": keys.take(pa.array(i)), "j": keys.take(pa.array(j)), "s": pa.array(s.ravel(), from_pandas=True)})

    return means.select(key, vector, F.lit(0).alias("__all")).groupBy("__all").applyInArrow(run, f"i {kind}, j {kind}, s double")


def positivity(rows: DataFrame, group: str, vector: str = "embedding", margin: float = 1e-6) -> DataFrame:
    """Certificate that all cosines of a group are positive: with m the least cosine to the centroid, every pair has at
    least 2 m^2 - 1 (for m > 0)."""
    unit = rows.select(group, normalised(F.col(vector)).alias("u")).filter("u is not null")
    centre = mean_vectors(unit, group, "u").select(group, normalised(F.col("mean")).alias("c"))
    low = unit.join(centre, group).groupBy(group).agg(F.min(dot(F.col("u"), F.col("c"))).alias("m"))
    bound = F.when(F.col("m") > 0, 2 * F.col("m") * F.col("m") - 1).otherwise(-1.0)
    return low.select(group, F.round("m", 6).alias("least_cosine"), F.round(bound, 6).alias("bound"), (bound > margin).alias("certified"))


def coverage(rows: DataFrame, selected: DataFrame, group: str, key: str, vector: str = "embedding", floor: bool = True) -> DataFrame:
    """(group, key, best): for each row its greatest cosine to a selected row of its group, at least 0 with floor. The
    selected rows of a group are few (its budget) and are the build side of the join on group."""
    a = rows.select(group, key, normalised(F.col(vector)).alias("u"))
    b = selected.select(group, normalised(F.col(vector)).alias("v"))
    best = a.join(b, group).groupBy(group, key).agg(F.max(dot(F.col("u"), F.col("v"))).alias("best"))
    return best.withColumn("best", F.greatest("best", F.lit(0.0))) if floor else best


def is_close(a: Column, b: Column, atol: float, rtol: float) -> Column:
    """NumPy's form: relative to b."""
    return F.abs(a - b) <= atol + rtol * F.abs(b)


def is_close_symmetric(a: Column, b: Column, atol: float, rtol: float) -> Column:
    """math.isclose: relative to the larger."""
    return F.abs(a - b) <= F.greatest(rtol * F.greatest(F.abs(a), F.abs(b)), F.lit(atol))
