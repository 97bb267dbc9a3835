"""Data sources for task files: one large JSON object {"train": [...], "validation": [...]} a file, and .npy vectors. Paths may name any
file system that pyarrow knows (file, hdfs, s3, gs)."""

from __future__ import annotations

import io
import json
import posixpath
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SPLITS = ("train", "validation")
_DECODER = json.JSONDecoder()


def located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "", 1))


def write_object(path: str, value: object) -> None:
    """A new JSON file."""
    system, where = located(path)
    system.create_dir(posixpath.dirname(where), recursive=True)
    with system.open_output_stream(where) as out:
        out.write(json.dumps(value, ensure_ascii=False).encode())


def _files(path: str, suffix: str) -> list[fs.FileInfo]:
    """Files under a folder (or the one file), by path."""
    system, root = located(path)
    info = system.get_file_info(root)
    found = [info] if info.is_file else [] if info.type == fs.FileType.NotFound else system.get_file_info(fs.FileSelector(root, recursive=True))
    return sorted((x for x in found if x.is_file and x.path.endswith(suffix)), key=lambda x: x.path)


class _Stream:
    """A text stream with a window of what has not been decoded yet."""

    def __init__(self, file, size: int = 1 << 20):
        self.file, self.size, self.text, self.at, self.ended = file, size, "", 0, False

    def more(self) -> bool:
        part = self.file.read(max(self.size, len(self.text) - self.at))
        self.text, self.at = self.text[self.at :] + part, 0
        self.ended = not part
        return bool(part)

    def peek(self) -> str:
        """Next character that is no white space, "" at the end."""
        while True:
            while self.at < len(self.text) and self.text[self.at] in " \t\r\n":
                self.at += 1
            if self.at < len(self.text) or not self.more():
                return self.text[self.at : self.at + 1]

    def take(self, expected: str) -> None:
        if self.peek() != expected:
            raise ValueError(f"expected {expected!r} in a task file")
        self.at += 1

    def value(self):
        """The next JSON value, reading on while it is cut off."""
        self.peek()
        while True:
            try:
                found, end = _DECODER.raw_decode(self.text, self.at)
                if end < len(self.text) or self.ended:
                    self.at = end
                    return found
            except json.JSONDecodeError:
                if self.ended:
                    raise
            self.more()


def iter_rows(file, splits: tuple[str, ...] = SPLITS) -> Iterator[tuple[str, int, object]]:
    """(split, source_index, value) of the wanted arrays, in memory of one value; a missing split has no rows."""
    if not set(splits) <= set(SPLITS):
        raise ValueError(f"splits are {SPLITS}")
    s = _Stream(file)
    s.take("{")
    while s.peek() != "}":
        key = s.value()
        s.take(":")
        if key in splits and s.peek() == "[":
            s.take("[")
            index = 0
            while s.peek() != "]":
                yield key, index, s.value()
                index += 1
                if s.peek() == ",":
                    s.take(",")
            s.take("]")
        else:
            s.value()
        if s.peek() == ",":
            s.take(",")


def top_level_keys(path: str) -> set[str]:
    """Keys of the object, values skipped one by one."""
    keys = set()
    system, where = located(path)
    with io.TextIOWrapper(system.open_input_stream(where), encoding="utf-8") as f:
        s = _Stream(f)
        s.take("{")
        while s.peek() != "}":
            keys.add(s.value())
            s.take(":")
            if s.peek() == "[":
                s.take("[")
                while s.peek() != "]":
                    s.value()
                    if s.peek() == ",":
                        s.take(",")
                s.take("]")
            else:
                s.value()
            if s.peek() == ",":
                s.take(",")
    return keys


def _kind(row: object, name: str) -> str:
    if not isinstance(row, dict):
        return "row_not_object"
    if name not in row:
        return "missing"
    x = row[name]
    return "null" if x is None else {str: "str", bool: "bool", int: "int", float: "float", list: "list", dict: "dict"}[type(x)]


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(tuple(paths))
        self.paths = paths


class _TaskReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.splits = tuple(options.get("splits", ",".join(SPLITS)).split(","))
        self.bytes = int(options.get("bytesperpartition", 32 << 20))

    def partitions(self) -> list[InputPartition]:
        out, size = [[]], 0
        for info in _files(self.root, ".json"):
            if out[-1] and size + info.size > self.bytes:
                out.append([])
                size = 0
            out[-1].append(info.path)
            size += info.size
        return [_Files(paths) for paths in out]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for path in partition.paths:
            yield from self._rows(path)

    def _rows(self, path: str) -> Iterator[tuple]:
        system, root = located(self.root)
        name = posixpath.relpath(path, root)
        with io.TextIOWrapper(system.open_input_stream(path), encoding="utf-8") as f:
            for split, index, row in iter_rows(f, self.splits):
                text = lambda k: row[k] if isinstance(row, dict) and isinstance(row.get(k), str) else None  # noqa: E731, B023
                yield name, split, index, isinstance(row, dict), text("inputs"), text("targets"), _kind(row, "inputs"), _kind(row, "targets")


class TaskJson(DataSource):
    """format("task_json"): rows in file order; small files share a partition of about bytesPerPartition (32 MB), a larger file
    is one partition, read as a stream in the memory of one value (an object can only be read from its start); options path, splits,
    bytesPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "task_json"

    def schema(self) -> str:
        return "source_file string, split string, source_index long, is_object boolean, inputs string, targets string, inputs_type string, targets_type string"

    def reader(self, schema) -> DataSourceReader:
        return _TaskReader(self.options)


class _Rows(InputPartition):
    def __init__(self, path: str, start: int, stop: int, row: int):
        super().__init__((path, start, stop))
        self.path, self.start, self.stop, self.row = path, start, stop, row


def _header(file) -> tuple[tuple[int, ...], np.dtype, int]:
    """(shape, type, place of the first number) of an open .npy file."""
    version = np.lib.format.read_magic(file)
    shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(file)
    if fortran or len(shape) != 2:
        raise ValueError("expected a two-dimensional array in rows")
    return shape, kind, file.tell()


class _NpyReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.rows = options["path"], int(options.get("rowsperpartition", 65536))

    def partitions(self) -> list[InputPartition]:
        system, _ = located(self.path)
        out, before = [], 0
        for info in _files(self.path, ".npy"):
            with system.open_input_file(info.path) as f:
                n = _header(f)[0][0]
            out += [_Rows(info.path, a, min(n, a + self.rows), before + a) for a in range(0, n, self.rows)]
            before += n
        return out or [_Rows("", 0, 0, 0)]

    def read(self, partition: _Rows) -> Iterator[tuple]:
        if not partition.path:
            return
        system, _ = located(self.path)
        with system.open_input_file(partition.path) as f:
            (_, width), kind, start = _header(f)
            f.seek(start + partition.start * width * kind.itemsize)
            block = np.frombuffer(f.read((partition.stop - partition.start) * width * kind.itemsize), kind).reshape(-1, width)
        for i, v in enumerate(block.astype(np.float32).tolist()):
            yield partition.row + i, v


def write_npy(rows: DataFrame, order: str, vector: str, folder: str) -> int:
    """A folder of .npy files, one a task, whose names and rows follow the order column; returns the number of rows. Each task
    writes its own file, so no vector passes the driver; a task without rows writes none."""
    system, root = located(folder)
    system.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        parts = [b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for b in batches if b.num_rows]
        if parts:
            x = np.concatenate(parts).astype(np.float32)
            data = io.BytesIO()
            np.save(data, x)
            system, root = located(folder)
            task = TaskContext.get()
            beside = f"{root}/.{task.partitionId():06d}-{task.taskAttemptId()}"
            with system.open_output_stream(beside) as out:
                out.write(data.getvalue())
            system.move(beside, f"{root}/part-{task.partitionId():06d}.npy")
            yield pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int64())], names=["n"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, order).sortWithinPartitions(order).select(vector)
    return placed.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


class Npy(DataSource):
    """format("npy"): [n, d] arrays of one file or of the files of a folder by name, one partition a row range, of which only
    the bytes are read; options path, rowsPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "row long, vector array<float>"

    def reader(self, schema) -> DataSourceReader:
        return _NpyReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TaskJson)
    spark.dataSource.register(Npy)
