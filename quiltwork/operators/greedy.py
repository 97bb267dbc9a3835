"""Greedy submodular orders: graph cut over tasks, facility location within a task.

Ties: among candidates whose gain lies within atol + rtol x max(1, |best|) of the best, the smallest index wins. All
arithmetic is in double. Similarities may be negative: coverage starts at 0, and graph cut keeps its whole gain vector
instead of bounds, which negative similarities would invalidate.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOLERANCE = 1e-10


def _pick(gains: np.ndarray, open_: np.ndarray) -> tuple[int, float, int]:
    """(index, gain, number of tied candidates) of the best open candidate."""
    best = gains[open_].max()
    tied = np.flatnonzero(open_ & (gains >= best - (TOLERANCE + TOLERANCE * max(1.0, abs(best)))))
    return int(tied[0]), float(gains[tied[0]]), len(tied)


def graph_cut(s: np.ndarray, budget: int, lam: float = 0.4) -> list[tuple[int, float]]:
    """Order by f(X) = sum of similarities to all minus lam times those within X; negative gains do not stop it."""
    n = len(s)
    gains = s.sum(axis=0) - lam * np.diag(s)
    open_ = np.ones(n, bool)
    out = []
    for _ in range(min(budget, n)):
        j, gain, _ = _pick(gains, open_)
        out.append((j, gain))
        open_[j] = False
        gains = gains - 2 * lam * s[j]
    return out


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    length = np.linalg.norm(x, axis=1)
    if not np.isfinite(x).all() or (length == 0).any():
        raise ValueError("vectors must be finite and not zero")
    return x / length[:, None]


def engine(n: int, d: int) -> str:
    """exact_dense up to 5,000 rows (a kernel of 200 MB), matrix_free while the vectors take at most 2 GiB as float32, then
    distributed."""
    return "exact_dense" if n <= 5000 else "matrix_free" if n * d * 4 <= 2 * 2**30 else "distributed"


def facility_location(x: np.ndarray, budget: int, candidates: np.ndarray | None = None, block: int = 4096, dense: bool = False) -> pd.DataFrame:
    """Order by f(X) = sum over rows of max(0, best cosine to X), lazy; with dense over a kernel of all rows and candidates, else
    matrix-free.

    Matrix-free gains are recomputed from the vectors in blocks of rows; no n x n matrix exists. Stale gains are upper bounds, so
    candidates are taken from a heap and recomputed until the next bound cannot reach the best within the tolerance,
    which certifies the choice. Columns: rank, index, gain, objective, ties, next_bound, evaluations.
    """
    u = unit_rows(x) if len(x) else np.zeros((0, 1))
    pool = np.arange(len(u)) if candidates is None else np.sort(np.asarray(candidates))
    covered = np.zeros(len(u))

    place = np.full(len(u), -1)
    place[pool] = np.arange(len(pool))
    kernel = u[pool] @ u.T if dense else None  # one row a candidate

    def gains(at: np.ndarray) -> np.ndarray:
        if kernel is not None:
            return np.maximum(kernel[place[at]] - covered, 0).sum(axis=1)
        total = np.zeros(len(at))
        for start in range(0, len(u), block):
            part = u[start : start + block]
            total += np.maximum(part @ u[at].T - covered[start : start + block, None], 0).sum(axis=0)
        return total

    heap: list[tuple[float, int, int]] = []
    for start in range(0, len(pool), 256):
        at = pool[start : start + 256]
        heap += [(-g, int(i), 0) for g, i in zip(gains(at), at)]
    heapq.heapify(heap)
    evaluations, objective, rows = len(pool), 0.0, []
    for step in range(min(budget, len(pool))):
        fresh: list[tuple[float, int]] = []
        best = -np.inf
        while heap:
            bound, i, stamp = heap[0]
            if fresh and -bound < best - (TOLERANCE + TOLERANCE * max(1.0, abs(best))):
                break
            heapq.heappop(heap)
            if stamp == step:
                g = -bound
            else:
                g = float(gains(np.array([i]))[0])
                evaluations += 1
            fresh.append((g, i))
            best = max(best, g)
        tied = sorted(i for g, i in fresh if g >= best - (TOLERANCE + TOLERANCE * max(1.0, abs(best))))
        chosen = tied[0]
        gain = next(g for g, i in fresh if i == chosen)
        next_bound = -heap[0][0] if heap else float("-inf")
        for g, i in fresh:
            if i != chosen:
                heapq.heappush(heap, (-g, i, step))
        objective += gain
        covered = np.maximum(covered, np.maximum(kernel[place[chosen]] if kernel is not None else u @ u[chosen], 0))
        rows.append((step + 1, chosen, gain, objective, len(tied), next_bound, evaluations))
    return pd.DataFrame(rows, columns=["rank", "index", "gain", "objective", "ties", "next_bound", "evaluations"])


def seeded_candidates(n: int, count: int, seed: int, group: int) -> np.ndarray:
    """The first count of a seeded permutation, sorted; smaller counts give subsets of larger ones."""
    order = np.random.default_rng(np.random.SeedSequence([seed, group])).permutation(n)
    return np.sort(order[:count])


def order_tasks(means: DataFrame, key: str, budget: int | None = None, lam: float = 0.4) -> DataFrame:
    """Graph-cut order of the task vectors: (rank, key, marginal_gain, cumulative_gain). One group of a few hundred rows;
    the rows are sorted by key inside, so ties do not depend on the order of arrival."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key).reset_index(drop=True)
        u = unit_rows(np.stack(pdf["mean"].to_list()))
        order = graph_cut(u @ u.T, budget or len(u), lam)
        gain = np.array([g for _, g in order])
        return pd.DataFrame({"rank": np.arange(1, len(order) + 1), key: pdf[key].iloc[[j for j, _ in order]].to_numpy(), "marginal_gain": gain, "cumulative_gain": gain.cumsum()})

    kind = dict(means.dtypes)[key]
    return means.select(key, "mean", F.lit(1).alias("__all")).groupBy("__all").applyInPandas(run, f"rank long, {key} {kind}, marginal_gain double, cumulative_gain double")


def order_within(rows: DataFrame, group: str, key: str, budget: int | Callable[[int], int], vector: str = "embedding", candidates: int | None = None, seed: int = 23, dense: bool | None = None, flag: str | None = None) -> DataFrame:
    """Facility-location prefix of each group: (group, rank, key, gain, objective, ties, next_bound, evaluations). With
    candidates only that many seeded rows of a group can be chosen, with flag (a boolean column) those that have it, while all are
    represented. dense is chosen by engine() if not
    given. A group must fit one task (n x d floats; see order_pool for larger ones); it is sorted by key inside."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key).reset_index(drop=True)
        k = budget(len(pdf)) if callable(budget) else budget
        pool = seeded_candidates(len(pdf), candidates, seed, int(pdf[group].iloc[0])) if candidates else np.flatnonzero(pdf[flag].to_numpy(bool)) if flag else None
        x = np.stack(pdf[vector].to_list())
        out = facility_location(x, k, pool, dense=engine(*x.shape) == "exact_dense" if dense is None else dense)
        out.insert(0, group, pdf[group].iloc[0])
        out[key] = pdf[key].iloc[out["index"]].to_numpy()
        return out[[group, "rank", key, "gain", "objective", "ties", "next_bound", "evaluations"]]

    kinds = dict(rows.dtypes)
    return rows.select(group, key, vector, *([flag] if flag else [])).groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, rank long, {key} {kinds[key]}, gain double, objective double, ties long, next_bound double, evaluations long")


def order_pool(rows: DataFrame, key: str, budget: int, vector: str = "embedding", working: int = 2048, batch: int = 64, refresh: int = 16) -> DataFrame:
    """Facility-location prefix of one pool that no task could hold: (rank, key, gain, objective, ties, next_bound, evaluations), as
    order_within gives it.

    The represented rows stay where they lie, each with its coverage. A block of `batch` candidate vectors is sent to all of them,
    and the partial gains of the tasks are summed; first for all candidates in turn (blocks of `working`), which gives every row its bound.
    Then the `working` rows of the largest bounds, with their vectors, are the only ones the driver holds; of these, stale bounds are
    recomputed until the next one cannot reach the best within the tolerance, and if it is the bound of a row outside the working
    set, bounds and coverages are written anew and the next working set is taken. They are also written anew every `refresh` picks.
    What is broadcast is working x d numbers at most. Keys are unique and vectors finite and not zero (an error otherwise).
    """
    from quiltwork.operators.vectors import normalised
    from quiltwork.session import release, spread, staged

    kind = dict(rows.dtypes)[key]
    unit = spread(rows.select(F.col(key), normalised(F.col(vector)).alias("u"))).withColumn("cover", F.lit(0.0))
    state = staged(unit, "pool")
    n, bad = state.agg(F.count("*"), F.count_if(F.col("u").isNull() | F.exists("u", lambda x: F.isnan(x)))).first()
    if bad:
        raise ValueError("vectors must be finite and not zero")

    def matrix(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)

    def gains(vectors: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        """Gains of the candidate vectors over the stored coverage and the picks made since."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(vectors))
            for some in batches:
                for start in range(0, some.num_rows, 4096):
                    part = some.slice(start, 4096)
                    own = matrix(part.column(0))
                    cover = part.column(1).to_numpy()
                    if len(fresh):
                        cover = np.maximum(cover, (own @ fresh.T).max(axis=1))
                    total += np.maximum(own @ vectors.T - cover[:, None], 0).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(vectors))), pa.array(total)], names=["i", "gain"])

        summed = state.select("u", "cover").mapInArrow(run, "i long, gain double").groupBy("i").agg(F.sum("gain").alias("gain"))
        out = np.zeros(len(vectors))
        for i, g in summed.collect():
            out[i] = g
        return out

    def rewritten(fresh: np.ndarray, known: dict, first: bool) -> DataFrame:
        """State with the coverage after the picks so far and the bounds that are known by now."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for some in batches:
                own, cover = matrix(some.column("u")), some.column("cover").to_numpy()
                if len(fresh):
                    cover = np.maximum(cover, (own @ fresh.T).max(axis=1)) if some.num_rows else cover
                old = some.column("bound").to_pylist() if not first else [None] * some.num_rows
                bound = [known.get(k, b) for k, b in zip(some.column(key).to_pylist(), old)]
                yield pa.RecordBatch.from_arrays([some.column(key), some.column("u"), pa.array(cover), pa.array(bound, pa.float64())], names=[key, "u", "cover", "bound"])

        return staged(state.mapInArrow(run, f"`{key}` {kind}, u array<double>, cover double, bound double"), "pool")

    none = np.zeros((0, 1))
    # bounds of all rows, one block of candidates after the other; a block's keys lie between two keys
    bounds: list[DataFrame] = []
    spark, last = rows.sparkSession, None
    while True:
        ahead = state.select(key, "u") if last is None else state.select(key, "u").filter(F.col(key) > F.lit(last))
        block = ahead.orderBy(key).limit(working).collect()
        if not block:
            break
        got = gains(np.array([r.u for r in block]), none)
        bounds.append(spark.createDataFrame([(r[0], float(g)) for r, g in zip(block, got)], f"`{key}` {kind}, bound double"))
        last = block[-1][0]
    if not bounds:
        return spark.createDataFrame([], f"rank long, `{key}` {kind}, gain double, objective double, ties long, next_bound double, evaluations long")
    merged = bounds[0]
    for more in bounds[1:]:
        merged = merged.unionByName(more)
    bounded = staged(state.join(merged, key), "pool")
    release(state)
    state = bounded

    def top() -> tuple[list, np.ndarray, dict, float]:
        found = state.filter("bound is not null").orderBy(F.desc("bound"), key).limit(working + 1).select(key, "u", "bound").collect()
        keep = found[:working]
        return [r[0] for r in keep], np.array([r.u for r in keep]), {r[0]: r.bound for r in keep}, found[working].bound if len(found) > working else float("-inf")

    keys, vectors, bound, floor = top()
    index = {k: i for i, k in enumerate(keys)}
    stamp = dict.fromkeys(keys, 0)
    fresh, out, objective, evaluations = [], [], 0.0, n

    def renew() -> None:
        nonlocal state, keys, vectors, bound, floor, index, stamp, fresh
        done = {r[1] for r in out}
        known = {k: (None if k in done else bound[k]) for k in index} | dict.fromkeys(done)
        newer = rewritten(np.array(fresh) if fresh else none, known, False)
        release(state)
        state, fresh = newer, []
        keys, vectors, bound, floor = top()
        index = {k: i for i, k in enumerate(keys)}
        stamp = dict.fromkeys(keys, -1)

    for step in range(min(budget, n)):
        while True:
            slack = lambda best: TOLERANCE + TOLERANCE * max(1.0, abs(best))
            exact = [bound[k] for k in bound if stamp[k] == step]
            best = max(exact, default=float("-inf"))
            stale = sorted((k for k in bound if stamp[k] != step and (not exact or bound[k] >= best - slack(best))), key=lambda k: (-bound[k], k))[:batch]
            if not stale and (floor < best - slack(best) or floor == float("-inf")):
                break
            if not stale:
                renew()
                if not any(bound[k] >= best - slack(best) for k in bound if stamp[k] != step):
                    floor = float("-inf")
                continue
            got = gains(vectors[[index[k] for k in stale]], np.array(fresh) if fresh else none)
            evaluations += len(stale)
            for k, g in zip(stale, got.tolist()):
                bound[k], stamp[k] = g, step
        tied = sorted(k for k in bound if stamp[k] == step and bound[k] >= best - slack(best))
        chosen, gain = tied[0], bound[tied[0]]
        rest = [b for k, b in bound.items() if stamp[k] != step]
        objective += gain
        out.append((step + 1, chosen, gain, objective, len(tied), max([floor, *rest]), evaluations))
        fresh.append(vectors[index[chosen]])
        del bound[chosen], stamp[chosen]
        if len(fresh) >= refresh or not bound and step + 1 < min(budget, n):
            renew()
    release(state)
    return spark.createDataFrame(out, f"rank long, `{key}` {kind}, gain double, objective double, ties long, next_bound double, evaluations long")
