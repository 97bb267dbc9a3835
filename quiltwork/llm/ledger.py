"""Token budgets: a count table keyed by content and tokenizer, and cubes kept up to date through signed deltas."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltwork.llm.hot import attach
from quiltwork.llm.tokenizer import DEFAULT_PATH, vocabulary_hash, with_token_counts
from quiltwork.session import release, staged
from quiltwork.sources.files import read_bytes, replace_table, write_bytes


def content_hash(c: Column) -> Column:
    """128-bit hash of a text; null and empty text share one, as both have no tokens."""
    return F.unhex(F.md5(F.coalesce(c, F.lit(""))))


@dataclass(frozen=True)
class TokenLedger:
    """State after a snapshot.

    counts: (tokenizer, content, n_tokens), one row for each different text ever encoded;
    state: (key, slices, <text>__content, <text>_tokens), one row for each document of the last snapshot;
    cube: (slices, n_records, <text>_tokens, tokens).
    """

    counts: DataFrame
    state: DataFrame
    cube: DataFrame
    key: str
    slices: list[str]
    texts: list[str]
    path: str

    @classmethod
    def start(cls, docs: DataFrame, key: str, texts: list[str], slices: list[str], path: str = DEFAULT_PATH, counts: DataFrame | None = None) -> TokenLedger:
        """First snapshot, with the count table of earlier ones if there is one. Null slices are slices of their
        own, null texts count 0, and a key that occurs twice counts twice."""
        counts, state = _counted(docs, key, texts, slices, path, counts)
        return cls(counts, state, _cube(_signed(state, 1, texts, slices), slices, texts), key, slices, texts, path)

    def update(self, docs: DataFrame) -> TokenLedger:
        """Next snapshot of the same documents (keys must be unique). Only texts whose (tokenizer, content) is not in
        the count table are encoded, each once; the cube changes by the signed rows of new, changed, re-sliced and removed
        documents alone."""
        counts, state = _counted(docs, self.key, self.texts, self.slices, self.path, self.counts)
        same = [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in self.state.columns]
        both = self.state.alias("o").join(state.alias("n"), F.col(f"o.{self.key}") == F.col(f"n.{self.key}"), "full_outer")
        unchanged = F.col(f"o.{self.key}").isNotNull() & F.col(f"n.{self.key}").isNotNull()
        for x in same:
            unchanged = unchanged & x
        moved = both.filter(~unchanged)
        signed = None
        for side, sign in (("o", -1), ("n", 1)):
            rows = moved.filter(F.col(f"{side}.{self.key}").isNotNull()).select(*[F.col(f"{side}.{c}").alias(c) for c in self.state.columns])
            part = _signed(rows, sign, self.texts, self.slices)
            signed = part if signed is None else signed.unionByName(part)
        old = self.cube.drop("tokens")
        cube = _cube(old.unionByName(signed), self.slices, self.texts).filter(F.col("n_records") != 0)
        return TokenLedger(counts, state, cube, self.key, self.slices, self.texts, self.path)

    def save(self, root: str) -> None:
        """Write the ledger in a folder of any file system, so that a later session can go on with it. Each table is
        replaced as one step; the description, written last, names the versions that belong together."""
        spark = self.state.sparkSession
        for name in ("counts", "state", "cube"):
            replace_table(getattr(self, name), f"{root}/{name}")
        versions = {name: read_bytes(spark, f"{root}/{name}/_current").decode().split()[0] for name in ("counts", "state", "cube")}
        write_bytes(spark, f"{root}/ledger.json", json.dumps({"key": self.key, "slices": self.slices, "texts": self.texts, "path": self.path, "versions": versions}).encode())

    @classmethod
    def load(cls, spark: SparkSession, root: str) -> TokenLedger:
        found = read_bytes(spark, f"{root}/ledger.json")
        if found is None:
            raise ValueError(f"no ledger in {root}")
        facts = json.loads(found)
        tables = {name: spark.read.parquet(f"{root}/{name}/{version}") for name, version in facts.pop("versions").items()}
        return cls(**tables, **facts)


def _counted(docs: DataFrame, key: str, texts: list[str], slices: list[str], path: str, counts: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(count table, state) of a snapshot. Contents are told apart by hash where the rows lie, so a text that a third of the
    documents have is encoded once; contents of the count table are not encoded at all. Documents find the count of their
    content as in hot.attach."""
    tokenizer = vocabulary_hash(path)
    pairs = F.explode(F.array(*[F.struct(content_hash(F.col(t)).alias("content"), F.col(t).alias("text")) for t in texts]))
    different = docs.select(pairs.alias("x")).select("x.content", "x.text").dropDuplicates(["content"])
    if counts is not None:
        known = counts.filter(F.col("tokenizer") == tokenizer).select("content")
        different = different.join(known, "content", "left_anti")
    fresh = staged(with_token_counts(different, {"n_tokens": "text"}, path).withColumn("tokenizer", F.lit(tokenizer)).select("tokenizer", "content", "n_tokens"), "counts")
    counts = fresh if counts is None else counts.unionByName(fresh)
    state = staged(docs.select(key, *slices, *[content_hash(F.col(t)).alias(f"{t}__content") for t in texts]), "contents")
    total = state.count()
    mine = counts.filter(F.col("tokenizer") == tokenizer).select("content", "n_tokens")
    for t in texts:
        c = f"{t}__content"
        sized = state.groupBy(c).agg(F.count("*").alias("__rows")).join(mine.withColumnRenamed("content", c), c)
        done, state = state, staged(attach(state, sized.withColumnRenamed("n_tokens", f"{t}_tokens"), [c], "__rows", total).drop("__rows"), "contents")
        release(done)
    order = [key, *slices, *[f"{t}__content" for t in texts], *[f"{t}_tokens" for t in texts]]
    return counts, state.select(*order)


def _signed(state: DataFrame, sign: int, texts: list[str], slices: list[str]) -> DataFrame:
    return state.select(*slices, F.lit(sign).cast("long").alias("n_records"), *[(F.col(f"{t}_tokens") * sign).alias(f"{t}_tokens") for t in texts])


def _cube(rows: DataFrame, slices: list[str], texts: list[str]) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ["n_records", *[f"{t}_tokens" for t in texts]]]
    out = rows.groupBy(*slices).agg(*sums)
    total = sum((F.col(f"{t}_tokens") for t in texts[1:]), F.col(f"{texts[0]}_tokens"))
    return out.withColumn("tokens", total)
