"""A varied subset: cluster-feature trees over partitions, merged in rounds, Ward linkage over their leaf entries, and the
record nearest each group centre."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiltwork.llm.overlap import BUCKETS, bucket_counts, record_words
from quiltwork.session import input_partitions, release, spread, staged

DIM = 64
BRANCH = 24


class CFTree:
    """A cluster-feature tree: entries (n, linear sum, square sum) in leaves of at most BRANCH, at most `most` entries.

    A point goes down to the nearest child and is absorbed by the nearest entry if that stays within the radius; a full
    node is split by its two farthest children. Where there are too many entries the tree is built anew from its own
    entries with a larger radius. Entries of other trees are inserted like points.
    """

    def __init__(self, most: int, radius: float = 0.0):
        self.most, self.radius, self.count = most, radius, 0
        self.root = _Node(True)

    def insert(self, n: float, ls: np.ndarray, ss: float) -> None:
        other = self._insert(self.root, n, ls, ss)
        if other is not None:
            root = _Node(False)
            root.add_child(self.root), root.add_child(other)
            self.root = root
        if self.count > self.most:
            self._rebuild()

    def insert_block(self, n: np.ndarray, ls: np.ndarray, ss: np.ndarray) -> None:
        """Insert many points or entries: they go down together, and of those that their nearest entry can absorb all are
        absorbed at once where the entry then still keeps the radius; all others are inserted one by one."""
        left = np.arange(len(n))
        if self.count:
            taken = np.zeros(len(n), bool)
            self._absorb(self.root, left, n, ls, ss, ls / n[:, None], taken)
            left = left[~taken]
        for k in left.tolist():
            self.insert(n[k], ls[k], ss[k])

    def _absorb(self, node: _Node, at: np.ndarray, n: np.ndarray, ls: np.ndarray, ss: np.ndarray, points: np.ndarray, taken: np.ndarray) -> None:
        c = node.centre[: node.size]
        to = (np.einsum("ij,ij->i", c, c)[None] - 2 * (points[at] @ c.T)).argmin(1)
        order = np.argsort(to, kind="stable")
        found, starts = np.unique(to[order], return_index=True)
        for k, own in zip(found.tolist(), np.split(at[order], starts[1:])):
            if not node.leaf:
                self._absorb(node.children[k], own, n, ls, ss, points, taken)
                node.put(k, node.children[k])
                continue
            limit = self.radius * self.radius + 1e-9
            total, line, square = node.n[k] + n[own], node.ls[k] + ls[own], node.ss[k] + ss[own]
            fits = own[square / total - np.einsum("ij,ij->i", line, line) / (total * total) <= limit]
            if len(fits):
                total, line, square = node.n[k] + n[fits].sum(), node.ls[k] + ls[fits].sum(0), node.ss[k] + ss[fits].sum()
                if square / total - (line @ line) / (total * total) <= limit:
                    node.n[k], node.ls[k], node.ss[k], node.centre[k] = total, line, square, line / total
                    taken[fits] = True

    def _insert(self, node: _Node, n: float, ls: np.ndarray, ss: float) -> _Node | None:
        if node.size:
            at = node.nearest(ls / n)
            if node.leaf:
                total, line, square = node.n[at] + n, node.ls[at] + ls, node.ss[at] + ss
                if square / total - (line @ line) / (total * total) <= self.radius * self.radius + 1e-9:
                    node.n[at], node.ls[at], node.ss[at] = total, line, square
                    node.centre[at] = line / total
                    return None
            else:
                child = node.children[at]
                other = self._insert(child, n, ls, ss)
                node.n[at] += n
                node.ls[at] += ls
                node.ss[at] += ss
                if other is None:
                    node.centre[at] = node.ls[at] / node.n[at]
                    return None
                node.put(at, child)
                node.add_child(other)
                return node.split() if node.size > BRANCH else None
        node.add(n, ls, ss)
        self.count += 1
        return node.split() if node.size > BRANCH else None

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        leaves = list(self.root.walk())
        return np.concatenate([x.n[: x.size] for x in leaves]), np.concatenate([x.ls[: x.size] for x in leaves]), np.concatenate([x.ss[: x.size] for x in leaves])

    def _rebuild(self) -> None:
        n, ls, ss = self.entries()
        centre = ls / n[:, None]
        gaps = []
        for leaf in self.root.walk():  # distance of each entry to its nearest neighbour in the leaf
            if leaf.size > 1:
                c = leaf.centre[: leaf.size]
                d = ((c[:, None] - c[None]) ** 2).sum(-1)
                np.fill_diagonal(d, np.inf)
                gaps.append(d.min(1))
        step = float(np.sqrt(np.quantile(np.concatenate(gaps), 0.3))) / 2 if gaps else 0.05
        self.radius = max(self.radius * 1.15 + 1e-3, step)
        self.root, self.count = _Node(True), 0
        for k in np.lexsort(centre.T[:2]):
            other = self._insert(self.root, n[k], ls[k], ss[k])
            if other is not None:
                root = _Node(False)
                root.add_child(self.root), root.add_child(other)
                self.root = root
        if self.count > self.most:
            self._rebuild()


class _Node:
    __slots__ = ("leaf", "size", "n", "ls", "ss", "centre", "children")

    def __init__(self, leaf: bool):
        self.leaf, self.size, self.children = leaf, 0, []
        self.n, self.ss = np.zeros(BRANCH + 1), np.zeros(BRANCH + 1)
        self.ls, self.centre = np.zeros((BRANCH + 1, DIM)), np.zeros((BRANCH + 1, DIM))

    def nearest(self, point: np.ndarray) -> int:
        c = self.centre[: self.size]
        return int((np.einsum("ij,ij->i", c, c) - 2 * (c @ point)).argmin())

    def add(self, n: float, ls: np.ndarray, ss: float) -> None:
        k = self.size
        self.n[k], self.ls[k], self.ss[k], self.centre[k] = n, ls, ss, ls / n
        self.size += 1

    def put(self, k: int, child: _Node) -> None:
        self.n[k], self.ls[k], self.ss[k] = child.n[: child.size].sum(), child.ls[: child.size].sum(0), child.ss[: child.size].sum()
        self.centre[k] = self.ls[k] / self.n[k]

    def add_child(self, child: _Node) -> None:
        self.children.append(child)
        self.size += 1
        self.put(self.size - 1, child)

    def split(self) -> _Node:
        """Half of the children, those nearer to the second of the two farthest; they leave this node."""
        c = self.centre[: self.size].copy()
        d = ((c[:, None] - c[None]) ** 2).sum(-1)
        a, b = np.unravel_index(d.argmax(), d.shape)
        goes = d[b] < d[a]
        goes[b], goes[a] = True, False
        other = _Node(self.leaf)
        n, ls, ss, children = self.n.copy(), self.ls.copy(), self.ss.copy(), self.children
        self.size, self.children = 0, []
        for k in range(len(c)):
            target = other if goes[k] else self
            if self.leaf:
                target.add(n[k], ls[k], ss[k])
            else:
                target.add_child(children[k])
        return other

    def walk(self) -> Iterator[_Node]:
        if self.leaf:
            yield self
        else:
            for child in self.children:
                yield from child.walk()


def ward(n: np.ndarray, ls: np.ndarray, k: int) -> np.ndarray:
    """Number of the group of each entry (n, linear sum), for k groups by Ward linkage: nearest-neighbour chains, then the
    merges in order of their cost; fewer entries than k are groups of their own. Quadratic in the entries."""
    m = len(n)
    if m <= k:
        return np.arange(m)
    size, line = n.astype(float).copy(), ls.astype(float).copy()
    centre = line / size[:, None]
    square = np.einsum("ij,ij->i", centre, centre)
    alive = np.ones(m, bool)
    merges, chain = [], []
    while alive.sum() > 1:
        if not chain:
            chain.append(int(alive.argmax()))
        while True:
            i = chain[-1]
            d = (square + square[i] - 2 * (centre @ centre[i])) * (size * size[i] / (size + size[i]))
            d[~alive] = np.inf
            d[i] = np.inf
            j = int(d.argmin())
            # rounding must not let a chain turn in a circle: what is as near as the one before, to 1e-9, is the one before
            if len(chain) > 1 and d[chain[-2]] <= d[j] + 1e-9 * (1 + d[j]):
                j = chain[-2]
                chain = chain[:-2]
                merges.append((float(d[j]), i, j))
                keep, gone = min(i, j), max(i, j)
                size[keep] += size[gone]
                line[keep] += line[gone]
                centre[keep] = line[keep] / size[keep]
                square[keep] = centre[keep] @ centre[keep]
                alive[gone] = False
                break
            chain.append(j)
    parent = list(range(m))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for _, i, j in sorted(merges)[: m - k]:
        a, b = find(i), find(j)
        parent[max(a, b)] = min(a, b)
    return np.unique([find(x) for x in range(m)], return_inverse=True)[1]


def group_centres(n: np.ndarray, ls: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Mean of the records of each group."""
    total, lines = np.zeros(group.max() + 1), np.zeros((group.max() + 1, DIM))
    np.add.at(total, group, n)
    np.add.at(lines, group, ls)
    return lines / total[:, None]


def vectors(rows: DataFrame, key: str, group: str | None, text: str, facets: list[str], facet_weight: float = 0.3) -> DataFrame:
    """(key, grp, vec): a unit vector of the text's words (signed hashing, a word weighs at most 2 and less the more
    records have it) with small parts for the facets; vec is float16 bytes. Null text has the facets alone."""
    table, n = bucket_counts(rows.select(F.col(text).alias("p"), F.lit(None).cast("string").alias("r")), "p", "r")
    weight = np.minimum(np.log(max(n, 1) / np.maximum(table, 1)), 2.0).clip(0.02)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, np.ndarray] = {}

        def signed(word: str, w: float | None = None) -> np.ndarray:
            found = memo.get(word)
            if found is None:
                if len(memo) > 1 << 16:
                    memo.clear()
                raw = np.unpackbits(np.frombuffer(hashlib.shake_128(word.encode("utf-8", "replace")).digest(DIM // 8), np.uint8))
                scale = weight[zlib.crc32(word.encode("utf-8", "replace")) % BUCKETS] if w is None else w
                found = memo[word] = ((raw * 2.0 - 1) * scale).astype(np.float32)
            return found

        for batch in batches:
            out = []
            columns = [c.to_pylist() for c in batch.columns[3:]]
            for k, t in enumerate(batch.column(2).to_pylist()):
                own = set(record_words(t, None))
                v = np.sum([signed(w) for w in own], axis=0) if own else np.zeros(DIM, np.float32)
                length = float(np.sqrt(v @ v))
                v = v / length if length else v
                for name, c in zip(facets, columns):
                    v = v + signed(f"\x00{name}\x00{c[k]}", facet_weight / np.sqrt(DIM))
                out.append(v.astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=[key, "grp", "vec"])

    grp = F.coalesce(F.col(group).cast("string"), F.lit("")) if group else F.lit("")
    own = rows.select(F.col(key), grp.alias("grp"), F.col(text).alias("__t"), *[F.col(f).cast("string").alias(f"__f{i}") for i, f in enumerate(facets)])
    return spread(own).mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, grp string, vec binary")


_CF = "grp string, slot int, n double, ls binary, ss double"


def _cf_batch(slot: int, trees: dict[str, CFTree]) -> pa.RecordBatch:
    rows: list[tuple] = []
    for g, tree in trees.items():
        n, ls, ss = tree.entries()
        rows += [(g, slot, float(a), b.astype(np.float32).tobytes(), float(c)) for a, b, c in zip(n, ls, ss)]
    cols = list(zip(*rows)) or [(), (), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.binary()), pa.array(cols[4], pa.float64())], names=["grp", "slot", "n", "ls", "ss"])


def _read(column: pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, DIM).astype(float)


_ENTRIES = "grp string, entry int, part int, n double, ls binary, centre binary"
MOST_ENTRIES = 100_000


def _linked(table: pa.Table, k: int) -> pa.Table:
    """Entries of one group of rows -> _ENTRIES: the entries are the observations that Ward linkage joins, each of weight one (so what
    lies within one entry, a crowd of similar records, counts once), cut at k parts; centre is the mean of all records of the part."""
    table = table.sort_by([("ls", "ascending"), ("n", "ascending")])
    n, ls = table.column("n").to_numpy(), _read(table.column("ls").combine_chunks(), np.float32)
    part = ward(np.ones(len(n)), ls / n[:, None], k)
    centre = group_centres(n, ls, part).astype(np.float32)
    entry = table.column("entry") if "entry" in table.column_names else pa.array(np.arange(len(n), dtype=np.int32))
    return pa.table({"grp": table.column("grp"), "entry": entry, "part": pa.array(part.astype(np.int32)), "n": table.column("n"), "ls": table.column("ls"), "centre": pa.array([centre[x].tobytes() for x in part], pa.binary())})


def choose(rows: DataFrame, key: str, sizes: dict[str, int], group: str | None, text: str, facets: list[str], entries: int = 4, least: int = 256, fan_in: int = 8) -> DataFrame:
    """(key, grp): sizes[group] records of each group of rows (group None: one group named ""), or all where there are
    no more.

    Each task keeps one tree a group, of at most max(least, entries x size) leaf entries; trees meet fan_in at a time
    until one is left a group, so no task ever holds more than fan_in trees of it, whatever the number of rows. Ward
    linkage over the entries of the last tree, cut at the wanted number, gives the parts. A second pass gives each record to its
    nearest entry and finds, for each part, the record of its own that is nearest to the part's centre (ties: smaller
    key). Should all entries of a part lie nearer to no record than others do, the entries without a record are left out, the rest is
    linked again, and the pass is made once more; then every part has a record. Where fewer entries than wanted records are
    left (records that are all alike), the next nearest of each entry follow, one an entry at a time, larger entries first.

    Nothing is drawn at random. Trees depend on the order of the rows and on how the table is split, so other partitions
    may choose other records, of about the same mean distance to the rest (tests: within a tenth). Linkage runs in one task,
    quadratic in the entries, and the entries are broadcast (256 bytes each): more than MOST_ENTRIES of a group are an error. Groups
    without a size and empty tables give no rows; keys are unique.
    """
    wanted = {g: int(k) for g, k in sizes.items() if k and k > 0}
    limit = {g: max(least, entries * k) for g, k in wanted.items()}
    if any(x > MOST_ENTRIES for x in limit.values()):
        raise ValueError(f"at most {MOST_ENTRIES // entries} records of a group can be chosen")
    keep = rows.filter(F.coalesce(F.col(group).cast("string"), F.lit("")).isin(list(wanted))) if group else rows if wanted else rows.limit(0)
    vecs = staged(vectors(keep, key, group, text, facets), "vectors")

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        trees: dict[str, CFTree] = {}
        for batch in batches:
            points, groups = _read(batch.column(1), np.float16), np.array(batch.column(0).to_pylist(), object)
            squares = np.einsum("ij,ij->i", points, points)
            for g in dict.fromkeys(groups.tolist()):
                own = np.flatnonzero(groups == g)
                tree = trees.setdefault(g, CFTree(limit[g]))
                for start in range(0, len(own), 1024):
                    some = own[start : start + 1024]
                    tree.insert_block(np.ones(len(some)), points[some], squares[some])
        if trees:
            yield _cf_batch(TaskContext.get().partitionId(), trees)

    def merge_round(table: pa.Table) -> pa.Table:
        g = table.column("grp")[0].as_py()
        table = table.sort_by([("ls", "ascending"), ("n", "ascending")])
        tree = CFTree(limit[g])
        n, ls, ss = table.column("n").to_numpy(), _read(table.column("ls").combine_chunks(), np.float32), table.column("ss").to_numpy()
        order = np.random.default_rng(0).permutation(len(n))  # neighbours apart, so that the tree stays balanced
        for start in range(0, len(n), 1024):
            some = order[start : start + 1024]
            tree.insert_block(n[some], ls[some], ss[some])
        return pa.Table.from_batches([_cf_batch(table.column("slot")[0].as_py(), {g: tree})])

    link = lambda table: _linked(table, wanted[table.column("grp")[0].as_py()])
    summary = vecs.select("grp", "vec").mapInArrow(summarise, _CF)
    slots = input_partitions(vecs)
    while True:
        slots = -(-slots // fan_in)
        summary = summary.withColumn("slot", F.pmod("slot", F.lit(slots))).groupBy("grp", "slot").applyInArrow(merge_round, _CF)
        if slots <= 1:
            break
    linked = staged(summary.groupBy("grp").applyInArrow(link, _ENTRIES), "entries")
    offers = staged(_offers(vecs, linked, key), "offers")
    owned = offers.groupBy("grp", "entry").agg(F.sum("n").alias("owned"))
    parts = linked.join(owned, ["grp", "entry"], "left").groupBy("grp", "part").agg(F.count("owned").alias("alive"))
    if not parts.filter("alive = 0").isEmpty():
        linked = staged(linked.join(owned, ["grp", "entry"], "left_semi").groupBy("grp").applyInArrow(link, _ENTRIES), "entries")
        offers = staged(_offers(vecs, linked, key), "offers")
    picked = offers.groupBy("grp", "part").agg(F.min(F.struct("d", key)).alias("x")).select("grp", F.col(f"x.{key}").alias(key))
    counts = {r[0]: r[1] for r in picked.groupBy("grp").count().collect()}
    have = {r[0]: r[1] for r in offers.groupBy("grp").agg(F.sum("n")).collect()}
    short = {g: min(wanted[g], have[g]) - n for g, n in counts.items() if n < min(wanted[g], have[g])}
    if short:
        more = _offers(vecs.filter(F.col("grp").isin(list(short))), linked, key, short).join(picked, key, "left_anti")
        sizes_of = linked.select("grp", "entry", F.col("n").alias("size"))
        place = F.row_number().over(Window.partitionBy("grp", "entry").orderBy("d", key))
        turn = F.row_number().over(Window.partitionBy("grp").orderBy("place", F.desc("size"), "entry"))
        lack = rows.sparkSession.createDataFrame(list(short.items()), "grp string, __lack long")
        ranked = more.withColumn("place", place).join(F.broadcast(lack), "grp").filter("place <= __lack").join(sizes_of, ["grp", "entry"]).withColumn("turn", turn)
        picked = picked.unionByName(ranked.filter("turn <= __lack").select("grp", key))
    return picked.select(key, "grp")


def _nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centre of each point, squared distance), a block of points at a time."""
    square, to, far = np.einsum("ij,ij->i", centres, centres), [], []
    for start in range(0, len(points), 1024):
        part = points[start : start + 1024]
        d = square[None] - 2 * (part @ centres.T)
        to.append(d.argmin(1))
        far.append(np.maximum(d[np.arange(len(part)), to[-1]] + np.einsum("ij,ij->i", part, part), 0))
    return np.concatenate(to), np.concatenate(far)


def _offers(vecs: DataFrame, linked: DataFrame, key: str, most: dict[str, int] | None = None) -> DataFrame:
    """(grp, entry, part, n, d, key): of each task and entry the number of its records and the one nearest to the centre of its part;
    with most, that many nearest ones (n is then meaningless)."""
    known: dict[str, tuple] = {}
    for r in linked.orderBy("grp", "entry").collect():
        known.setdefault(r.grp, ([], [], [], []))
        for column, x in zip(known[r.grp], (r.entry, r.part, np.frombuffer(r.ls, np.float32) / np.float32(r.n), np.frombuffer(r.centre, np.float32))):
            column.append(x)
    known = {g: tuple(np.array(x) for x in columns) for g, columns in known.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple, list] = {}
        count: dict[tuple, int] = {}
        for batch in batches:
            keys, groups = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), object)
            points = _read(batch.column(2), np.float16).astype(np.float32)
            for g in dict.fromkeys(groups.tolist()):
                at = np.flatnonzero(groups == g)
                number, part, own, centre = known[g]
                to, _ = _nearest(points[at], own)
                away = np.round(((points[at] - centre[to]) ** 2).sum(1), 6)
                for i, j, x in zip(at.tolist(), to.tolist(), away.tolist()):
                    slot = (g, int(number[j]), int(part[j]))
                    count[slot] = count.get(slot, 0) + 1
                    held = best.setdefault(slot, [])
                    held.append((x, keys[i]))
                    if len(held) > 64 + 2 * (most[g] + 1 if most else 1):
                        held.sort()
                        del held[most[g] + 1 if most else 1 :]
        out = [(*slot, count[slot], x, k) for slot, held in best.items() for x, k in sorted(held)[: most[slot[0]] + 1 if most else 1]]
        if out:
            g, e, p, n, x, k = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(e, pa.int32()), pa.array(p, pa.int32()), pa.array(n, pa.int64()), pa.array(x, pa.float64()), pa.array(k)], names=["grp", "entry", "part", "n", "d", key])

    return vecs.mapInArrow(run, f"grp string, entry int, part int, n long, d double, `{key}` {dict(vecs.dtypes)[key]}")


def spread_of(rows: DataFrame, chosen: DataFrame, key: str = "mix_id", text: str = "prompt", facets: tuple[str, ...] = ("task_id", "stage2_method"), seed: int = 23) -> DataFrame:
    """(choice, records, mean_distance, crowded): how well the chosen records, and as many drawn at random (by seeded hash), stand
    for all rows: the mean distance of a row to the nearest of them, and how many of them lie within 0.3 of another one. The chosen
    vectors (256 bytes each) are broadcast. No rows chosen: no line for them."""
    vecs = staged(vectors(rows, key, None, text, list(facets)), "vectors")
    picks = chosen.select(key).distinct()
    n = picks.count()
    drawn = vecs.select(key).orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)
    sets = {}
    for name, ids in (("tree", picks), ("random", drawn)):
        own = [np.frombuffer(r[0], np.float16).astype(np.float32) for r in vecs.join(ids, key, "left_semi").select("vec").collect()]
        if own:
            sets[name] = np.stack(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows_seen = dict.fromkeys(sets, 0.0), 0
        for batch in batches:
            points = _read(batch.column(0), np.float16).astype(np.float32)
            rows_seen += len(points)
            for name, own in sets.items():
                if len(points):
                    total[name] += float(np.sqrt(_nearest(points, own)[1]).sum())
        yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array(list(total.values()), pa.float64()), pa.array([rows_seen] * len(total), pa.int64())], names=["choice", "total", "rows"])

    def crowded(own: np.ndarray) -> int:
        close = 0
        for start in range(0, len(own), 512):
            d = ((own[start : start + 512, None] - own[None]) ** 2).sum(-1)
            d[np.arange(len(d)), start + np.arange(len(d))] = np.inf
            close += int((d.min(1) < 0.09).sum()) if len(own) > 1 else 0
        return close

    facts = rows.sparkSession.createDataFrame([(name, len(own), crowded(own)) for name, own in sets.items()], "choice string, records long, crowded long")
    sums = vecs.select("vec").mapInArrow(run, "choice string, total double, rows long").groupBy("choice").agg(F.round(F.sum("total") / F.sum("rows"), 6).alias("mean_distance"))
    return facts.join(sums, "choice").select("choice", "records", "mean_distance", "crowded")


def choose_k(rows: DataFrame, k: int, key: str = "mix_id", text: str = "prompt", facets: tuple[str, ...] = ("task_id", "stage2_method")) -> DataFrame:
    """k records of all rows."""
    return choose(rows, key, {"": k}, None, text, list(facets)).select(key)


def choose_by_task(rows: DataFrame, allocations: DataFrame, size: str = "final_allocation_25000", key: str = "mix_id", text: str = "prompt", facets: tuple[str, ...] = ("stage2_method",)) -> DataFrame:
    """For each task of the allocation table (a few hundred rows) as many records as it is allotted, capped by the rows
    there are."""
    sizes = {r[0]: r[1] for r in allocations.select("task_id", size).collect() if r[0] is not None}
    return choose(rows, key, sizes, "task_id", text, list(facets), entries=2, least=64).select(key, F.col("grp").alias("task_id"))
