"""Queries of sources, sinks, the stage runner and the stream: tables are written in the shared folder and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quiltwork.operators import validity as v
from quiltwork.plans import runner
from quiltwork.session import shared_dir
from quiltwork.sources import files, task_json
from quiltwork.sources.tables import table
from quiltwork.streaming import validity as sv


def _folder(spark) -> str:
    return f"{shared_dir(spark).rstrip('/')}/io/{uuid.uuid4().hex}"


def _small(spark, d):
    return table(spark, d, "task_allocations").select("task_id", "corpus", "graph_cut_rank", "valid_train_count", "marginal_gain")


def _task_files(spark, d) -> str:
    """Task files made of the catalog: an object of two arrays a file, with rows of every kind of defect."""
    root = _folder(spark)
    row = lambda r, i: [{"inputs": f"{r.task_id} {i}", "targets": "t"}, None, {"inputs": " ", "targets": 3}, {"targets": "x"}, {"inputs": "a", "targets": None}][i % 5]
    for r in table(spark, d, "task_catalog").select("task_index", "task_id", "corpus").collect():
        task_json.write_object(f"{root}/{r.corpus}/{r.task_index:04d}.json", {"about": {"index": r.task_index}, "train": [row(r, i) for i in range(r.task_index % 7)], "validation": [row(r, i) for i in range(3)]})
    return root


def scan_task_json(spark, d):
    task_json.register(spark)
    rows = spark.read.format("task_json").load(_task_files(spark, d))
    return rows.groupBy("source_file", "split").agg(F.count("*").alias("n"), F.count_if(v.is_valid()).alias("valid"), F.max("source_index").alias("last"))


def scan_npy(spark, d):
    task_json.register(spark)
    path = _folder(spark)
    task_json.write_npy(table(spark, d, "embeddings"), "vec_id", "embedding", path)
    read = spark.read.format("npy").option("rowsPerPartition", 128).load(path)
    return read.select("row", F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double")), 6).alias("total"))


def scan_log(spark, d):
    path = _folder(spark)
    lines = table(spark, d, "events").select(F.concat(F.lit("INFO optimizer_step="), F.col("event_id").cast("string"), F.lit(" loss=1.0 lr="), F.format_string("%.4f", "value")).alias("value"))
    lines.unionByName(spark.createDataFrame([("warm-up",)], "value string")).write.text(path)
    return files.read_log(spark, path)


def sink_csv(spark, d, sep=","):
    path = _folder(spark)
    _small(spark, d).write.option("header", True).option("sep", sep).csv(path)
    return files.read_csv(spark, path, "task_id string, graph_cut_rank int, valid_train_count long, marginal_gain double", sep).select("task_id", "graph_cut_rank", "valid_train_count", F.round("marginal_gain", 6).alias("marginal_gain"))


def sink_jsonl(spark, d):
    path = _folder(spark)
    files.write_jsonl(v.quarantine(table(spark, d, "raw_examples")), path)
    return files.read_jsonl(spark, path, "row_id long, reasons string, inputs_preview string")


def sink_partitioned(spark, d):
    path = _folder(spark)
    files.write_table(table(spark, d, "mixture").select("mix_id", "corpus", "split"), path, partition_by=["corpus", "split"])
    return spark.read.parquet(path).filter("split = 'train'").groupBy("corpus").agg(F.count("*").alias("n"))


def sink_many(spark, d):
    root = _folder(spark)
    files.write_many(table(spark, d, "mixture").select("mix_id", "split", "included_in_25000"), {f"{root}/a": "split = 'train' and included_in_25000", f"{root}/b": "split = 'train'", f"{root}/c": "split <> 'train'"})
    parts = [spark.read.parquet(f"{root}/{x}").select(F.lit(x).alias("part"), "mix_id") for x in "abc"]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("part").agg(F.count("*").alias("n"))


def gate_runner(spark, d):
    """Two runs of a two-stage pipeline: the second skips both stages."""
    root = _folder(spark)
    stages = [
        runner.Stage("valid", lambda s, t: table(s, d, "raw_examples").filter(v.is_valid()).select("row_id", "task_id"), {"rule": 1}, checks={"task": "task_id is not null"}, keys=("row_id",)),
        runner.Stage("counts", lambda s, t: t["valid"].groupBy("task_id").count(), {}, after=("valid",), keys=("task_id",)),
    ]
    first, second = runner.run(spark, root, stages), runner.run(spark, root, stages)
    rows = {s.name: files.current_table(spark, f"{root}/{s.name}").count() for s in stages}
    return spark.createDataFrame([(s.name, first[s.name], second[s.name], runner.progress(spark, root, stages), rows[s.name]) for s in stages], "stage string, first string, second string, done int, rows long")


def stream_validity(spark, d):
    rows = table(spark, d, "raw_examples")
    root = _folder(spark)
    rows.repartition(4).write.parquet(f"{root}/in")
    sv.run_available(sv.validity_counts(sv.example_stream(spark, f"{root}/in", rows.schema, 2)), f"{root}/out", f"{root}/state")
    return spark.read.parquet(f"{root}/out")


def queries():
    return {
        "scan_s1_task_json": scan_task_json,
        "scan_s4_listing": lambda spark, d: files.list_files(spark, _task_files(spark, d)).select("folder", "files"),
        "scan_s5_csv": sink_csv,
        "scan_s6_tsv": lambda spark, d: sink_csv(spark, d, "\t"),
        "scan_s8_npy": scan_npy,
        "scan_s12_lookup": lambda spark, d: spark.createDataFrame([files.only_row(table(spark, d, "task_catalog").filter("task_index = 7").select("task_id", "task_index"))], "task_id string, task_index int"),
        "scan_s13_log": scan_log,
        "sink_k4_jsonl": sink_jsonl,
        "sink_k5_partitioned": sink_partitioned,
        "sink_k7_verified": lambda spark, d: files.write_verified(_small(spark, d), _folder(spark)).select("task_id", "graph_cut_rank"),
        "sink_k8_many": sink_many,
        "gate_o1_runner": gate_runner,
        "stream_validity": stream_validity,
    }


def oracle_sql():
    lines = "SELECT task_id, graph_cut_rank, valid_train_count, round(marginal_gain, 6) AS marginal_gain FROM task_allocations"
    from quiltwork.plans.ingest import _REASONS, _VALID

    return {
        "scan_s1_task_json": "SELECT corpus || '/' || lpad(task_index::VARCHAR, 4, '0') || '.json' AS source_file, split, n, (n > 0)::BIGINT + (n > 5)::BIGINT AS valid, n - 1 AS last FROM (SELECT task_index, corpus, 'train' AS split, task_index % 7 AS n FROM task_catalog UNION ALL SELECT task_index, corpus, 'validation', 3 FROM task_catalog) WHERE n > 0",
        "scan_s4_listing": "SELECT corpus AS folder, count(*) AS files FROM task_catalog GROUP BY corpus",
        "scan_s5_csv": lines,
        "scan_s6_tsv": lines,
        "scan_s8_npy": "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings",
        "scan_s12_lookup": "SELECT task_id, task_index FROM task_catalog WHERE task_index = 7",
        "scan_s13_log": "SELECT event_id AS optimizer_step, round(value, 4) AS lr FROM events",
        "sink_k4_jsonl": f"SELECT row_id, r AS reasons, CASE WHEN length(replace(inputs, chr(10), '\\n')) <= 80 THEN replace(inputs, chr(10), '\\n') ELSE left(replace(inputs, chr(10), '\\n'), 80) || '...[truncated]' END AS inputs_preview FROM (SELECT *, {_REASONS} AS r FROM raw_examples) WHERE r <> ''",
        "sink_k5_partitioned": "SELECT corpus, count(*) AS n FROM mixture WHERE split = 'train' GROUP BY corpus",
        "sink_k7_verified": "SELECT task_id, graph_cut_rank FROM task_allocations",
        "sink_k8_many": "SELECT 'a' AS part, count(*) AS n FROM mixture WHERE split = 'train' AND included_in_25000 UNION ALL SELECT 'b', count(*) FROM mixture WHERE split = 'train' UNION ALL SELECT 'c', count(*) FROM mixture WHERE split <> 'train'",
        "gate_o1_runner": f"SELECT 'valid' AS stage, 'written' AS first, 'skipped' AS second, 2 AS done, count(*) AS rows FROM raw_examples WHERE {_VALID} UNION ALL SELECT 'counts', 'written', 'skipped', 2, count(DISTINCT task_id) FROM raw_examples WHERE {_VALID}",
        "stream_validity": f"SELECT batch_day, split, count_if({_VALID}) AS valid, count(*) AS n FROM raw_examples GROUP BY ALL",
    }
