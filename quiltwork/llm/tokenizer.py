"""Byte-level BPE of a public vocabulary: contiguous rank arrays over batches of short words.

A word's parts lie in a row of an integer matrix (``parts``) and the rank of every adjacent pair in a second one
(``ranks``). Each round scans the rows for their lowest rank, deletes the boundary it stands for by closing the gap,
and looks up the two pairs that now touch the new part. Rows of similar length are worked on together, so one NumPy
call serves thousands of words. Words repeat, so a bounded memo in each Python worker holds the ids of those seen.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import os
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltwork.session import spread

DEFAULT_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern published with the vocabulary (possessive, which changes no match).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+"

NONE = np.int32(2**31 - 1)
SHORT = 96
MEMO_WORDS = 1 << 18
BATCH_CELLS = 1 << 21


class RankTable:
    """Ranks of adjacent parts: pair of ids -> id of the joined part, as an open-addressed array."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            blob = f.read()
        self.digest = hashlib.md5(blob).hexdigest()
        ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, blob.splitlines())}
        self.byte_ids = np.array([ids[bytes([b])] for b in range(256)], np.int32)
        self.whole = ids
        left, right, joined = [], [], []
        for word, i in ids.items():
            for k in range(1, len(word)):
                a = ids.get(word[:k])
                if a is not None and (b := ids.get(word[k:])) is not None:
                    left.append(a), right.append(b), joined.append(i)
        keys = np.array(left, np.int64) << 20 | np.array(right, np.int64)
        bits = max(4, int(np.ceil(np.log2(len(keys) * 4 + 1))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, NONE, np.int32)
        todo, values = keys, np.array(joined, np.int32)
        at = self._slot(todo)
        while len(todo):
            free = self.keys[at] < 0
            self.keys[at[free]] = todo[free]
            won = self.keys[at] == todo
            self.values[at[won]] = values[won]
            todo, values, at = todo[~won], values[~won], (at[~won] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where it is no part of the vocabulary."""
        keys = a.astype(np.int64) << 20 | b
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], NONE)
        rest = np.flatnonzero((found != keys) & (found >= 0))
        while len(rest):
            at_rest = at[rest] = (at[rest] + 1) & self.mask
            found = self.keys[at_rest]
            hit = found == keys[rest]
            out[rest[hit]] = self.values[at_rest[hit]]
            rest = rest[~hit & (found >= 0)]
        return out


def _encode_rows(table: RankTable, words: list[bytes]) -> list[np.ndarray]:
    """Ids of words of one length."""
    n, size = len(words), len(words[0])
    parts = table.byte_ids[np.frombuffer(b"".join(words), np.uint8).reshape(n, size)]
    ranks = np.full((n, size), NONE, np.int32)
    if size > 1:
        ranks[:, :-1] = table.pair(parts[:, :-1].ravel(), parts[:, 1:].ravel()).reshape(n, size - 1)
    out: list[np.ndarray] = [None] * n  # type: ignore[list-item]
    row = np.arange(n)
    width = size
    while n:
        at = ranks[:, :width].argmin(axis=1)
        low = ranks[np.arange(n), at]
        done = low == NONE
        if done.any():
            for i in np.flatnonzero(done):
                out[row[i]] = parts[i, :width].copy()
            keep = ~done
            parts, ranks, row, at, low = parts[keep], ranks[keep], row[keep], at[keep], low[keep]
            n = len(row)
            if not n:
                break
        lines = np.arange(n)
        parts[lines, at] = low
        if width > 2:  # close the gap: boundary at+1 goes
            behind = np.arange(width - 1) > at[:, None]
            parts[:, : width - 1] = np.where(behind, parts[:, 1:width], parts[:, : width - 1])
            ranks[:, : width - 1] = np.where(behind, ranks[:, 1:width], ranks[:, : width - 1])
        width -= 1
        ranks[:, width - 1] = NONE
        has_right = at < width - 1
        r = np.flatnonzero(has_right)
        ranks[r, at[r]] = table.pair(parts[r, at[r]], parts[r, at[r] + 1])
        left = np.flatnonzero(at > 0)
        ranks[left, at[left] - 1] = table.pair(parts[left, at[left] - 1], parts[left, at[left]])
    return out


def _encode_long(table: RankTable, word: bytes) -> np.ndarray:
    """Ids of one long word: a scan deletes all boundaries of the lowest rank, left to right, so a run of a
    million letters takes as many scans as it has different merges, not one a merge."""
    parts = table.byte_ids[np.frombuffer(word, np.uint8)]
    ranks = table.pair(parts[:-1], parts[1:])
    while len(ranks) and (low := ranks.min()) != NONE:
        at = np.flatnonzero(ranks == low)
        if len(at) > 1:  # of touching pairs every second one is left once its neighbour has merged
            start = np.concatenate([[True], np.diff(at) > 1])
            first = at[start][np.cumsum(start) - 1]
            at = at[(at - first) % 2 == 0]
        parts[at] = low
        keep = np.ones(len(parts), bool)
        keep[at + 1] = False
        parts = parts[keep]
        if len(parts) < 2:
            break
        ranks = np.append(ranks, NONE)[keep][:-1]
        now = at - np.arange(len(at))
        for place in (now - 1, now):
            place = place[(place >= 0) & (place < len(ranks))]
            ranks[place] = table.pair(parts[place], parts[place + 1])
    return parts


class Encoder:
    """Texts to lists of ids; special-token strings are ordinary text."""

    def __init__(self, path: str = DEFAULT_PATH):
        self.table = RankTable(path)
        self.split = regex.compile(PATTERN).findall
        self.memo: dict[str, list[int]] = {}

    def learn(self, words: Iterable[str]) -> None:
        """Encode words that the memo lacks."""
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for word in words:
            raw = word.encode("utf-8", "replace")
            if (whole := self.table.whole.get(raw)) is not None:
                self.memo[word] = [whole]
            elif len(raw) > SHORT:
                self.memo[word] = _encode_long(self.table, raw).tolist()
            else:
                by_size.setdefault(len(raw), []).append((word, raw))
        for size, own in by_size.items():
            step = max(1, BATCH_CELLS // size)
            for i in range(0, len(own), step):
                some = own[i : i + step]
                for (word, _), ids in zip(some, _encode_rows(self.table, [raw for _, raw in some])):
                    self.memo[word] = ids.tolist()

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, start offsets); null and empty texts have no ids."""
        words = [self.split(t) if t else [] for t in texts]
        self.learn(set(chain.from_iterable(words)).difference(self.memo) if len(self.memo) <= MEMO_WORDS else self._fresh(words))
        get = self.memo.__getitem__
        lists = [list(chain.from_iterable(map(get, w))) for w in words]
        offsets = np.zeros(len(texts) + 1, np.int32)
        np.cumsum([len(x) for x in lists], out=offsets[1:])
        return np.fromiter(chain.from_iterable(lists), np.int32, int(offsets[-1])), offsets

    def _fresh(self, words: list[list[str]]) -> set[str]:
        self.memo.clear()
        return set(chain.from_iterable(words))

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """Number of ids of each text."""
        words = [self.split(t) if t else [] for t in texts]
        self.learn(set(chain.from_iterable(words)).difference(self.memo) if len(self.memo) <= MEMO_WORDS else self._fresh(words))
        size = {w: len(self.memo[w]) for w in set(chain.from_iterable(words))}
        return np.array([sum(map(size.__getitem__, w)) for w in words], np.int64)


@functools.lru_cache(maxsize=4)
def encoder(path: str = DEFAULT_PATH) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    return Encoder(path)


@functools.lru_cache(maxsize=4)
def vocabulary_hash(path: str = DEFAULT_PATH) -> str:
    with open(path, "rb") as f:
        return hashlib.md5(f.read()).hexdigest()


def _chunks(texts: pa.Array, chars: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges of about so many bytes, so a batch of very long texts is worked on piece by piece."""
    total, start = 0, 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        total += n or 0
        if total >= chars:
            yield start, i + 1
            total, start = 0, i + 1
    if start < len(texts):
        yield start, len(texts)


def encode(df: DataFrame, key: str, text: str, path: str = DEFAULT_PATH) -> DataFrame:
    """(key, ids): the ids of each text without special tokens, an empty list for null and empty texts.

    Narrow: no shuffle, and only the two columns are read. One row comes out for each row, repeated keys included.
    """
    rows = spread(df.select(F.col(key), F.col(text).alias("__text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for a, b in _chunks(batch.column(1)):
                part = batch.slice(a, b - a)
                flat, offsets = enc.batch(part.column(1).to_pylist())
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[key, "ids"])

    kind = dict(df.dtypes)[key]
    return rows.mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def with_token_counts(df: DataFrame, texts: dict[str, str], path: str = DEFAULT_PATH) -> DataFrame:
    """df with one count column (new name -> text column) for each text; null and empty texts count 0. The text
    columns themselves are dropped, so nothing behind this carries them."""
    names = list(texts)
    rest = [c for c in df.columns if c not in texts.values()]
    rows = spread(df.select(*[F.col(f"`{c}`") for c in rest], *[F.col(f"`{texts[n]}`").alias(f"__{n}") for n in names]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            own = list(batch.columns[: len(rest)])
            for k in range(len(names)):
                column = batch.column(len(rest) + k)
                counts = [enc.counts(column.slice(a, b - a).to_pylist()) for a, b in _chunks(column)]
                own.append(pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays(own, names=[*rest, *names])

    kinds = dict(df.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in rest], *[f"`{n}` bigint" for n in names]])
    return rows.mapInArrow(run, schema)
