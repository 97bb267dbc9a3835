"""Strict readers of small files, lookups, and sinks that check what they wrote."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiltwork.session import hadoop


def require_schema(df: DataFrame, expected: list[str]) -> DataFrame:
    """df, if its columns are the expected ones in any order; missing and unexpected ones are an error."""
    missing, extra = set(expected) - set(df.columns), set(df.columns) - set(expected)
    if missing or extra:
        raise ValueError(f"missing columns {sorted(missing)}, unexpected columns {sorted(extra)}")
    return df


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """CSV (or TSV) with a header that must have the schema's columns; a value of another type is an error."""
    wanted = T.StructType.fromDDL(schema)
    header = spark.read.option("header", True).option("sep", sep).csv(path).columns
    missing = [f.name for f in wanted.fields if f.name not in header]
    if missing:
        raise ValueError(f"missing columns {missing}")
    full = T.StructType([next((f for f in wanted.fields if f.name == c), T.StructField(c, T.StringType())) for c in header])
    return spark.read.schema(full).option("header", True).option("sep", sep).option("mode", "FAILFAST").option("enforceSchema", False).csv(path).select(*[f.name for f in wanted.fields])


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(optimizer_step, lr) of the log lines that have them."""
    # Fixed value: the form of a progress line.
    pattern = r"optimizer_step=(\d+).*?lr=([0-9.eE+-]+)"
    lines = spark.read.text(path).filter(F.col("value").rlike(pattern))
    return lines.select(F.regexp_extract("value", pattern, 1).cast("long").alias("optimizer_step"), F.regexp_extract("value", pattern, 2).cast("double").alias("lr"))


def list_files(spark: SparkSession, root: str, suffix: str = ".json") -> DataFrame:
    """(folder, files, bytes); only the directory entries are read, not the contents."""
    entries = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", True).load(root).select("path", "length")
    return entries.groupBy(F.element_at(F.split("path", "/"), -2).alias("folder")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def only_row(df: DataFrame) -> Row:
    """The one row of df; none or more than one is an error."""
    found = df.limit(2).collect()
    if len(found) != 1:
        raise ValueError("expected exactly one row, found " + ("none" if not found else "more"))
    return found[0]


def read_reports(spark: SparkSession, pattern: str, schema: str, condition: str) -> Row:
    """The one report (a JSON file) under a glob that meets the condition."""
    return only_row(spark.read.schema(schema).option("multiLine", True).json(pattern).filter(condition))


def write_table(df: DataFrame, path: str, overwrite: bool = False, partition_by: list[str] | None = None) -> None:
    """Parquet through the commit protocol: readers see all or nothing, and _SUCCESS comes last."""
    w = df.write.mode("overwrite" if overwrite else "errorifexists")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file of any file system, atomically: written beside its place, then renamed over it."""
    context = spark.sparkContext
    jvm = context._jvm
    system, where = hadoop(spark, path)
    _, beside = hadoop(spark, f"{path}.{uuid.uuid4().hex}")
    out = system.create(beside, True)
    out.write(bytearray(data))
    out.close()
    options = context._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), context._jsc.hadoopConfiguration()).rename(system.makeQualified(beside), system.makeQualified(where), options)


def read_bytes(spark: SparkSession, path: str) -> bytes | None:
    """What a small file holds; None where there is none."""
    system, where = hadoop(spark, path)
    if not system.exists(where):
        return None
    stream = system.open(where)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def replace_table(df: DataFrame, root: str, partition_by: list[str] | None = None, keep: int = 1) -> DataFrame:
    """Replace the table of a folder as one step: a new version is written beside the old one, then the pointer file _current
    is renamed over the old pointer. A run that breaks off leaves the old table in place; readers that hold the version before go on
    reading it (keep versions are kept, older ones deleted)."""
    spark = df.sparkSession
    name = f"v{uuid.uuid4().hex}"
    write_table(df, f"{root}/{name}", partition_by=partition_by)
    old = (read_bytes(spark, f"{root}/_current") or b"").decode().split()
    write_bytes(spark, f"{root}/_current", " ".join([name, *old[:keep]]).encode())
    for gone in old[keep:]:
        system, where = hadoop(spark, f"{root}/{gone}")
        system.delete(where, True)
    return spark.read.parquet(f"{root}/{name}")


def current_table(spark: SparkSession, root: str) -> DataFrame | None:
    """The table that replace_table last put in place; None where there is none."""
    name = (read_bytes(spark, f"{root}/_current") or b"").decode().split()
    return spark.read.parquet(f"{root}/{name[0]}") if name else None


def write_csv(df: DataFrame, path: str, overwrite: bool = False) -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").option("header", True).csv(path)


def write_jsonl(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """One compact object a line, text as it is."""
    df.write.mode("overwrite" if overwrite else "errorifexists").option("ignoreNullFields", False).json(path)


def write_verified(df: DataFrame, path: str, overwrite: bool = False) -> DataFrame:
    """Write, read again and compare as multisets; a difference is an error."""
    write_table(df, path, overwrite)
    again = df.sparkSession.read.schema(df.schema).parquet(path)
    if not again.exceptAll(df).isEmpty() or not df.exceptAll(again).isEmpty():
        raise ValueError(f"{path}: what was read differs from what was written")
    return again


def write_many(df: DataFrame, outputs: dict[str, str], overwrite: bool = False) -> None:
    """Several filtered tables from one pass over df's plan: path -> condition."""
    df.persist()
    try:
        for path, condition in outputs.items():
            write_table(df.filter(condition), path, overwrite)
    finally:
        df.unpersist()


def markdown(df: DataFrame, title: str, limit: int = 200) -> str:
    """A bounded table as a Markdown page, for reading."""
    rows = df.limit(limit).collect()
    clean = lambda x: ("" if x is None else json.dumps(x, ensure_ascii=False, default=str) if not isinstance(x, str) else x).replace("|", "\\|").replace("\n", " ")
    return "\n".join([f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *["| " + " | ".join(clean(x) for x in r) + " |" for r in rows], ""])
