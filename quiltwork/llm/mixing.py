"""Mixing sources to target shares: Sainte-Laguë apportionment of equal-token blocks, then seeded selection."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiltwork.llm.tokenizer import DEFAULT_PATH, with_token_counts
from quiltwork.session import staged


def sainte_lague(weights: list[float], caps: list[int], total: int) -> list[int]:
    """Seats by the highest quotients weight / (2 seats + 1), none above its cap; ties go to the earlier entry.

    All quotients above a threshold found by bisection are granted at once and the last few one by one, so billions
    of seats take as long as ten. Where the caps sum to less than total, everyone ends at the cap.
    """
    n = len(weights)
    live = [w > 0 and c > 0 for w, c in zip(weights, caps)]
    if not any(live) or total <= 0:
        return [0] * n
    if sum(c for c, ok in zip(caps, live) if ok) <= total:
        return [c if ok else 0 for c, ok in zip(caps, live)]

    def granted(limit: float) -> list[int]:
        return [min(c, math.floor((w / limit + 1) / 2)) if ok else 0 for w, c, ok in zip(weights, caps, live)]

    high = 2 * max(w for w, ok in zip(weights, live) if ok)
    low = min(w for w, ok in zip(weights, live) if ok) / (2 * total + 1) / 2
    for _ in range(200):
        middle = (low * high) ** 0.5
        if sum(granted(middle)) <= total:
            high = middle
        else:
            low = middle
    seats = granted(high)
    while (left := total - sum(seats)) > 0:
        order = sorted((i for i in range(n) if live[i] and seats[i] < caps[i]), key=lambda i: (-weights[i] / (2 * seats[i] + 1), i))
        if not order:
            break
        seats[order[0]] += 1
    return seats


def mix_sources(docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", block_tokens: int = 256,
                max_shards: int = 4096, seed: int = 23, path: str = DEFAULT_PATH) -> tuple[DataFrame, DataFrame]:
    """A mix of the total token size of docs in which each listed source has its target_share as far as max_repeats allows.

    Returns (mix, shares): mix is (key, source, n_tokens, copies) of the records with at least one copy, shares one row
    for each source of targets. Blocks of block_tokens go to the sources by Sainte-Laguë with the cap max_repeats x size;
    what a capped source cannot take goes to the next highest quotients. A source's records lie in shards (by a seeded
    hash of the key; at most max_shards shards altogether, each of about equal size, so a source that holds a third
    of the data is spread over a third of them). A shard gets an integer quota of blocks the same way, and its records
    are taken in seeded order, whole passes first, until the quota is met (a record counts when its middle token is inside).
    Records without a listed source count towards the total size only; records without tokens are never in the mix; a
    listed source without records has size 0. Repeated keys are records of their own. Only the targets' few rows and
    the bounded shard table reach the driver.
    """
    goals = sorted(((r[0], float(r[1] or 0), int(r[2] or 0)) for r in targets.select("source", "target_share", "max_repeats").collect() if r[0] is not None))
    sized = docs.select(F.col(key), F.col(source).alias("source"), F.col(text).alias("__text"))
    sized = staged(with_token_counts(sized, {"n_tokens": "__text"}, path).filter("n_tokens > 0"), "sized")
    names = [g[0] for g in goals]
    listed = F.when(F.col("source").isin(names), F.col("source"))
    sizes = {r[0]: int(r[1]) for r in sized.groupBy(listed.alias("s")).agg(F.sum("n_tokens")).collect()}
    total = sum(sizes.values())
    have = [sizes.get(s, 0) for s in names]
    blocks = [have[i] * goals[i][2] // block_tokens for i in range(len(names))]
    quota = sainte_lague([g[1] for g in goals], blocks, round(total / block_tokens))

    spark = docs.sparkSession
    shard_tokens = max(1, total // max(1, max_shards - len(names)), 64 * block_tokens)
    counts = [-(-x // shard_tokens) or 1 for x in have]
    plan = spark.createDataFrame([(s, int(n), g[2]) for s, n, g in zip(names, counts, goals)] or [("", 1, 0)], "source string, __shards long, __repeats int")
    placed = sized.join(F.broadcast(plan), "source").withColumn("__order", F.xxhash64(F.lit(seed), F.col(key).cast("string"))) \
        .withColumn("__shard", F.pmod(F.xxhash64(F.lit(seed + 1), F.col(key).cast("string")), F.col("__shards")))
    shards = placed.groupBy("source", "__shard").agg(F.sum("n_tokens").alias("size")).collect()
    rows = []
    for i, s in enumerate(names):
        own = sorted((r[1], int(r[2])) for r in shards if r[0] == s)
        repeats = goals[i][2]
        got = sainte_lague([float(x) for _, x in own], [-(-x * repeats // block_tokens) for _, x in own], quota[i])
        rows += [(s, int(k), x, int(q) * block_tokens) for (k, x), q in zip(own, got)]
    quotas = spark.createDataFrame(rows or [("", 0, 0, 0)], "source string, __shard long, __size long, __quota long")

    start = F.sum("n_tokens").over(Window.partitionBy("source", "__shard").orderBy("__order", key, "n_tokens").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    taken = placed.withColumn("__start", start).join(F.broadcast(quotas), ["source", "__shard"])
    passes = F.ceil((F.col("__quota") - F.col("__start") - F.col("n_tokens") / 2) / F.col("__size"))
    copies = F.least(F.greatest(passes, F.lit(0)), F.col("__repeats")).cast("long")
    mix = staged(taken.withColumn("copies", copies).filter("copies > 0").select(key, "source", "n_tokens", "copies"), "mix")
    return mix, _shares(mix, targets, sized)


def _shares(mix: DataFrame, targets: DataFrame, sized: DataFrame) -> DataFrame:
    got = mix.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mix_tokens"), F.sum("copies").alias("mix_records"), F.max("copies").alias("most_copies"))
    have = sized.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"))
    out = targets.select("source", "target_share", "max_repeats").join(have, "source", "left").join(got, "source", "left")
    zero = {c: 0 for c in ("source_tokens", "mix_tokens", "mix_records", "most_copies")}
    out = out.fillna(zero)
    total = mix.agg(F.sum(F.col("n_tokens") * F.col("copies"))).first()[0] or 0
    return out.withColumn("actual_share", F.round(F.col("mix_tokens") / F.lit(max(total, 1)), 6))
