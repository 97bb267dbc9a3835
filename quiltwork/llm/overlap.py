"""Same or nearly same records across splits: similarity-hash fingerprints joined by permuted code blocks.

A fingerprint has S blocks of 32 bits and a sketch of 64 bits over all words. A bit of a similarity hash is the sign of a sum of +1 and
-1 over words (a word that occurs again is a word of its own); block s sums over the m words that come first under permutation s of
the vocabulary. Blocks of two records are equal
if the edits spare those m words, and almost never otherwise, so a block tells records apart at any number of rows, as 32 bits of one sum
over all words would not: a near-same record at one word in eight differs in every fifth bit. Records of which one block is equal and
whose sketches lie within a Hamming radius are candidates; their words are then compared.

m grows with the logarithm of the rows, and S follows from m and the wanted recall.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltwork.llm.canonical import fold
from quiltwork.llm.hot import attach
from quiltwork.session import release, spread, staged

BUCKETS = 1 << 16
RADIUS = 22
RECALL = 0.9999
KEEP = 0.76  # share of edits at one word in eight that spare one word of a block on both sides: (7/8)^2 less what rounding takes
CHUNK = 8192
# Scripts without spaces between words count by character.
_WORD = re.compile(r"\d+(?:[.,]\d+)+|[぀-ヿ一-鿿가-힯]|[^\W_぀-ヿ一-鿿가-힯]+")


def record_words(prompt: str | None, response: str | None) -> list[str]:
    """Words of prompt and response together; case, white space and punctuation are disregarded, null is empty."""
    return _WORD.findall(fold(f"{prompt or ''}\n{response or ''}"))


def bucket_counts(rows: DataFrame, prompt: str, response: str) -> tuple[np.ndarray, int]:
    """(records that have a word of each hash bucket, number of records) over all rows; the table has BUCKETS entries
    whatever the vocabulary, each task sends at most one row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(BUCKETS, np.int64), 0
        memo: dict[str, int] = {}
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = set(record_words(a, b))
                if len(memo) > 1 << 18:
                    memo.clear()
                for w in own.difference(memo):
                    memo[w] = zlib.crc32(w.encode()) % BUCKETS
                at = np.fromiter({memo[w] for w in own}, np.int64)
                total[at] += 1
                n += 1
        if n:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], names=["bucket", "n"])

    counted = rows.select(prompt, response).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    table, n = np.zeros(BUCKETS, np.int64), 0
    for r in counted.collect():
        if r[0] < 0:
            n = r[1]
        else:
            table[r[0]] = r[1]
    return table, n


def plan_blocks(rows: int, recall: float = RECALL) -> tuple[int, int]:
    """(words a block, number of blocks) for a table of so many rows: 4 words up to about 1,000 rows and three more for each factor of
    a hundred, as records of one template share some four words in ten and would meet ever more often otherwise; as many blocks as it takes for one of them to be spared with the wanted probability, each with KEEP ** words."""
    m = max(4, round(1.5 * math.log10(max(rows, 1)) - 0.5))
    return m, math.ceil(math.log(1 - recall) / math.log(1 - KEEP**m))


def _majority(words: np.ndarray) -> np.ndarray:
    """Bits set in more than half of the unsigned numbers along axis 1, counted in bit planes."""
    m = words.shape[1]
    planes = [np.zeros_like(words[:, 0]) for _ in range(m.bit_length())]
    for k in range(m):
        carry = words[:, k]
        for i, plane in enumerate(planes):
            planes[i], carry = plane ^ carry, plane & carry
    least, above, equal = m // 2 + 1, np.zeros_like(planes[0]), ~np.zeros_like(planes[0])
    for i in reversed(range(len(planes))):
        if least >> i & 1:
            equal = equal & planes[i]
        else:
            above, equal = above | equal & planes[i], equal & ~planes[i]
    return above | equal


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint32(16)) * np.uint32(0x85EBCA6B)
    x = (x ^ x >> np.uint32(13)) * np.uint32(0xC2B2AE35)
    return x ^ x >> np.uint32(16)


class Fingerprints:
    """Fingerprints of word lists: for each word its place in each permutation (a 32-bit hash) and its 64 signs in the sketch."""

    def __init__(self, m: int, blocks: int, most: int = 1 << 15):
        self.m, self.blocks, self.most, self.rows = m, blocks, most, {}
        self.places, self.signs = np.zeros((1024, blocks), np.uint32), np.zeros((1024, 64), np.int8)
        self.salts = np.arange(1, blocks + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def _row(self, word: str) -> int:
        at = len(self.rows)
        if at == len(self.places):
            self.places, self.signs = (np.concatenate([x, np.zeros_like(x)]) for x in (self.places, self.signs))
        raw = hashlib.blake2b(word.encode("utf-8", "replace"), digest_size=16).digest()
        self.signs[at] = np.unpackbits(np.frombuffer(raw[:8], np.uint8)).view(np.int8) * 2 - 1
        x = np.frombuffer(raw[8:], "<u8") + self.salts  # one well-mixed number a permutation
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        self.places[at] = (x ^ x >> np.uint64(31)) >> np.uint64(32)
        self.rows[word] = at
        return at

    def __call__(self, records: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(codes, sketches) of records that have words: blocks numbers of 32 bits each, and one of 64 bits. A long record is
        read in chunks of CHUNK words, of which each leaves its first m words."""
        first = np.zeros((len(records), self.m, self.blocks), np.uint32)
        sums = np.zeros((len(records), 64), np.int64)
        for k, words in enumerate(records):
            seen: dict[str, int] = {}
            own = np.zeros((0, self.blocks), np.uint32)
            for start in range(0, len(words), CHUNK):
                if len(self.rows) > self.most:
                    self.rows.clear()
                part = words[start : start + CHUNK]
                if len(words) > CHUNK or len(set(part)) < len(part):
                    for i, w in enumerate(part):
                        again = seen[w] = seen.get(w, 0) + 1
                        if again > 1:
                            part[i] = f"{w}\x00{again}"
                rows = self.rows
                at = [rows[w] if w in rows else self._row(w) for w in part]
                sums[k] += self.signs[at].sum(axis=0, dtype=np.int64)
                own = np.concatenate([own, self.places[at]]) if len(own) else self.places[at]
                if len(own) > self.m:
                    own = np.partition(own, self.m - 1, axis=0)[: self.m]
            first[k, : len(own)] = own
        codes = _majority(_mixed(first))
        return codes.view(np.int32), np.packbits(sums > 0, axis=1).view(">i8").ravel().astype(np.int64)


def word_distance(a: list[str], b: list[str], most: int) -> int:
    """Words to add, drop or replace to get from a to b; most + 1 where it is more than most."""
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    k = 0
    while k < len(a) and k < len(b) and a[k] == b[k]:
        k += 1
    a, b = a[k:], b[k:]
    if abs(len(a) - len(b)) > most:
        return most + 1
    far = most + 1
    if len(a) * (2 * most + 1) > 200_000:
        return _long_distance(a, b, most)
    before = [j if j <= most else far for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        low, high = max(1, i - most), min(len(b), i + most)
        now = [far] * (len(b) + 1)
        if i <= most:
            now[0] = i
        for j in range(low, high + 1):
            now[j] = min(before[j - 1] + (x != b[j - 1]), before[j] + 1, now[j - 1] + 1)
        if min(now) > most:
            return far
        before = now
    return min(before[-1], far)


def _long_distance(a: list[str], b: list[str], most: int) -> int:
    """word_distance of long lists, a row at a time: a row's insertions are a running minimum."""
    ids: dict[str, int] = {}
    x, y = (np.array([ids.setdefault(w, len(ids)) for w in t], np.int64) for t in (a, b))
    steps = np.arange(len(y) + 1)
    before = np.minimum(steps, most + 1)
    for i, w in enumerate(x, 1):
        low, high = max(0, i - most - 1), min(len(y), i + most)
        now = np.full(len(y) + 1, most + 1)
        part = np.minimum(before[low : high + 1] + 1, np.concatenate([[most + 1], before[low:high] + (y[low:high] != w)]))
        if low == 0:
            part[0] = min(i, most + 1)
        now[low : high + 1] = np.minimum(np.minimum.accumulate(part - steps[low : high + 1]) + steps[low : high + 1], most + 1)
        if now[low : high + 1].min() > most:
            return most + 1
        before = now
    return int(min(before[-1], most + 1))


def near(a: list[str], b: list[str], share: float = 0.125) -> bool:
    """At most about one word in eight of the longer record differs."""
    most = math.floor(max(len(a), len(b)) * share + 0.5)
    # a change takes at most one of the words that both have, so this drops no pair
    if max(len(a), len(b)) - most > min(len(a), len(b)) or max(len(a), len(b)) - sum((Counter(a) & Counter(b)).values()) > most:
        return False
    return word_distance(a, b, most) <= most


def fingerprinted(rows: DataFrame, key: str, prompt: str, response: str, split: str, train: str = "train", recall: float = RECALL) -> DataFrame:
    """(key, eval, h1, h2, codes, sketch, n): whether the row lies outside the train split, the 128-bit hash of its words,
    the blocks of its fingerprint (none for a record without words), the sketch, and the number of words."""
    m, blocks = plan_blocks(rows.count(), recall)
    held_out = F.coalesce(F.col(split) != train, F.lit(True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = Fingerprints(m, blocks)
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                own = [record_words(a, b) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
                hashes = b"".join(hashlib.md5("".join(x).encode("utf-8", "replace"), usedforsecurity=False).digest() for x in own)
                wide = np.frombuffer(hashes, ">i8").reshape(-1, 2).astype(np.int64)
                some = np.array([bool(x) for x in own], bool)
                codes, found = prints([x for x in own if x])
                sketches = np.zeros(len(own), np.int64)
                sketches[some] = found
                ends = np.concatenate([[0], np.cumsum(some) * blocks]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(wide[:, 0]), pa.array(wide[:, 1]), pa.ListArray.from_arrays(pa.array(ends), pa.array(codes.ravel())), pa.array(sketches), pa.array([len(x) for x in own], pa.int32())], names=[key, "eval", "h1", "h2", "codes", "sketch", "n"])

    own = spread(rows.select(F.col(key), held_out.alias("eval"), F.col(prompt), F.col(response)))
    return own.mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, eval boolean, h1 long, h2 long, codes array<int>, sketch long, n int")


def block_pairs(heads: DataFrame, signed: DataFrame, key: str) -> DataFrame:
    """(e, t, es, ts, en, tn): a held-out and a train class for each block that they have in common, with sketches and words."""
    codes = heads.filter("held > 0 or trained > 0").join(signed.select(key, "codes", "sketch", "n"), key).select(key, "held", "trained", "sketch", "n", F.posexplode("codes").alias("s", "c"))
    codes = codes.withColumn("code", F.shiftleft(F.col("s").cast("long"), 32) + F.col("c"))
    left = codes.filter("held > 0").select("code", F.col(key).alias("e"), F.col("sketch").alias("es"), F.col("n").alias("en"))
    right = codes.filter("trained > 0").select("code", F.col(key).alias("t"), F.col("sketch").alias("ts"), F.col("n").alias("tn"))
    return left.join(right, "code").filter(F.col("e") != F.col("t")).drop("code")


@dataclass(frozen=True)
class Overlap:
    """What find_overlaps found: members (key, head, eval, held, trained) has every row with the smallest key of its class and the
    class's numbers of held-out and train rows; links (e, t) the heads of a held-out and of a train class whose words are the same or
    nearly so, a class of both splits being linked to itself."""

    members: DataFrame
    links: DataFrame
    key: str


def find_overlaps(rows: DataFrame, key: str = "mix_id", prompt: str = "prompt", response: str = "response", split: str = "split", radius: int = RADIUS, recall: float = RECALL) -> Overlap:
    """Classes of rows with the same words, and the links between classes of the train split and of other splits.

    Classes, not rows, are compared, whatever the number of copies: the blocks of one row of each class are joined, candidates
    within the radius are made distinct, the texts of their keys alone are fetched, and their words are compared.
    Keys are unique; a row whose split is null counts as held out; null and empty texts have no words and are one class; an
    empty table gives no rows.
    """
    signed = staged(fingerprinted(rows, key, prompt, response, split, recall=recall), "fingerprints")
    total = signed.count()
    heads = staged(signed.groupBy("h1", "h2").agg(F.min(key).alias("head"), F.count_if("eval").alias("held"), F.count_if(~F.col("eval")).alias("trained"), F.count("*").alias("size")), "classes")
    pairs = block_pairs(heads.select(F.col("head").alias(key), "held", "trained"), signed, key)
    within = F.bit_count(F.col("es").bitwiseXOR(F.col("ts"))) <= radius
    # near() allows no more words of difference
    alike = F.abs(F.col("en") - F.col("tn")) <= F.floor(F.greatest("en", "tn") * 0.125 + 0.5)
    # a class of both splits meets others from either side; the order of a pair is settled by who is held out
    candidates = staged(pairs.filter(within & alike).select("e", "t").distinct(), "candidates")
    wanted = candidates.select(F.explode(F.array("e", "t")).alias(key)).distinct()
    texts = staged(rows.select(F.col(key), F.col(prompt).alias("p"), F.col(response).alias("r")).join(wanted, key, "left_semi"), "texts")
    held = candidates.join(texts.select(F.col(key).alias("e"), F.col("p").alias("ep"), F.col("r").alias("er")), "e")
    both = held.join(texts.select(F.col(key).alias("t"), F.col("p").alias("tp"), F.col("r").alias("tr")), "t")

    @F.pandas_udf("boolean")
    def is_near(ep: pd.Series, er: pd.Series, tp: pd.Series, tr: pd.Series) -> pd.Series:
        own = lru_cache(maxsize=4096)(record_words)
        return pd.Series([near(own(a, b), own(c, d)) for a, b, c, d in zip(ep, er, tp, tr)], dtype="boolean")

    matched = both.filter(is_near("ep", "er", "tp", "tr")).select("e", "t")
    same = heads.filter("held > 0 and trained > 0").select(F.col("head").alias("e"), F.col("head").alias("t"))
    links = staged(matched.unionByName(same), "links")
    members = staged(attach(signed.select(key, "eval", "h1", "h2"), heads, ["h1", "h2"], "size", total).select(key, "head", "eval", "held", "trained"), "members")
    release(signed, heads, candidates, texts)
    return Overlap(members, links, key)


SLOT = 4096


def overlaps(rows: DataFrame, key: str = "mix_id", prompt: str = "prompt", response: str = "response", split: str = "split", radius: int = RADIUS) -> DataFrame:
    """(<key>_a, <key>_b): every pair of a train row and another split's row with the same or nearly the same words, from the
    classes and links of find_overlaps. The rows of a class are dealt into slots of about SLOT rows and a link is repeated for each
    slot, so no task has to put together all rows of a class that has many."""
    found = find_overlaps(rows, key, prompt, response, split, radius)

    def side(flag: bool, size: str, head: str, row: str) -> DataFrame:
        slots = F.ceil(F.col(size) / SLOT)
        return found.members.filter(F.col("eval") == flag).select(F.col("head").alias(head), F.pmod(F.xxhash64(key), slots).alias(f"{head}s"), F.col(key).alias(row))

    sizes = found.members.select("head", "held", "trained").distinct()
    deal = lambda size: F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(size) / SLOT) - 1))
    links = found.links.join(sizes.select(F.col("head").alias("e"), "held"), "e").join(sizes.select(F.col("head").alias("t"), "trained"), "t")
    dealt = links.select("e", "t", "trained", deal("held").alias("es")).select("e", "t", "es", deal("trained").alias("ts"))
    pairs = dealt.join(side(True, "held", "e", "x"), ["e", "es"]).join(side(False, "trained", "t", "y"), ["t", "ts"])
    return pairs.select(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b"))


def overlap_report(rows: DataFrame, key: str = "mix_id", split: str = "split", source: str = "corpus", **columns: str) -> DataFrame:
    """(split, source, records, pairs): held-out records with an overlap, and their pairs, for each split and source, from
    the links and sizes of classes; pairs are never listed."""
    found = find_overlaps(rows, key, split=split, **columns)
    trained = found.members.select(F.col("head").alias("t"), "trained").distinct()
    met = found.links.join(trained, "t").groupBy(F.col("e").alias("head")).agg(F.sum("trained").alias("pairs"))
    held = found.members.filter("eval").join(rows.select(key, F.col(split), F.col(source)), key)
    by_class = held.groupBy("head", split, source).agg(F.count("*").alias("n"))
    return by_class.join(met, "head").groupBy(split, source).agg(F.sum("n").alias("records"), F.sum(F.col("n") * F.col("pairs")).alias("pairs"))
