"""Queries of ingest: scans, validity, quarantine, manifests, inventories."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quiltwork.functions import text as fn
from quiltwork.operators import validity as v
from quiltwork.sources.tables import table

_BLANK = "regexp_full_match({c}, '[\\s\\x0b\\x1c-\\x1f\\x85\\pZ]*')"
_I, _T = _BLANK.format(c="inputs"), _BLANK.format(c="targets")
_VALID = f"(is_object AND inputs IS NOT NULL AND targets IS NOT NULL AND NOT {_I} AND NOT {_T})"
_REASONS = f"""CASE WHEN NOT is_object THEN 'row_not_object' ELSE concat_ws(',', CASE WHEN inputs IS NULL THEN 'inputs_not_string' WHEN {_I} THEN 'inputs_empty' END,
    CASE WHEN targets IS NULL THEN 'targets_not_string' WHEN {_T} THEN 'targets_empty' END) END"""


def _raw(f):
    return lambda spark, d: f(table(spark, d, "raw_examples"))


def _dense_index(spark, d):
    order = Window.orderBy("corpus_position", "task_id")
    return table(spark, d, "task_catalog").select("task_id", (F.row_number().over(order) - 1).alias("dense_index"))


def _label_codes(spark, d):
    code = F.dense_rank().over(Window.partitionBy("corpus").orderBy("task_id")) - 1
    return table(spark, d, "task_catalog").select("corpus", "task_id", code.alias("label"))


def _decoded(spark, d):
    codes = _label_codes(spark, d)
    rows = table(spark, d, "mixture").select("mix_id", "corpus", "task_id").join(codes, ["corpus", "task_id"]).select("mix_id", "corpus", "label")
    return rows.join(codes, ["corpus", "label"]).groupBy("corpus", "task_id").agg(F.count("*").alias("n"))


def queries():
    return {
        "scan_s2_valid_rows": lambda spark, d: v.attach_catalog(table(spark, d, "raw_examples"), table(spark, d, "task_catalog")).groupBy("task_id", "task_index", "split").agg(F.count("*").alias("n"), F.max("source_index").alias("last_index")),
        "filter_f1_validity": _raw(lambda r: r.groupBy("split").agg(F.count_if(v.is_valid()).alias("valid"), F.count("*").alias("n"))),
        "filter_f2_reasons": _raw(lambda r: r.select("row_id", F.array_join(v.reasons(), ",").alias("reasons")).filter("reasons <> ''")),
        "filter_f3_empty_audit": _raw(v.empty_audit),
        "filter_f4_quarantine": _raw(v.quarantine),
        "agg_a1_split_statistics": _raw(v.split_statistics),
        "agg_a2_type_histogram": _raw(v.type_histogram),
        "agg_a3_reason_counts": _raw(v.reason_counts),
        "agg_a4_corpus_rollup": lambda spark, d: v.corpus_rollup(table(spark, d, "clean_manifest")),
        "agg_a5_manifest": _raw(v.manifest),
        "agg_a5_conservation": _raw(lambda r: v.manifest(r).groupBy("corpus").agg(F.sum("source_train_count").alias("source"), F.sum("valid_train_count").alias("valid"), F.sum("excluded_train_count").alias("excluded"), F.bool_and(F.expr("source_train_count = valid_train_count + excluded_train_count")).alias("conserved"))),
        "agg_a6_duplicates": _raw(lambda r: v.duplicates(r, ["source_file", "split", "source_index"])),
        "agg_a24_catalog_totals": lambda spark, d: table(spark, d, "clean_manifest").agg(F.countDistinct("task_id").alias("tasks"), F.sum("valid_train_count").alias("train"), F.sum("valid_validation_count").alias("validation")),
        "proj_p1_task_id": _raw(lambda r: r.select("source_file", F.concat_ws("::", F.split_part("source_file", F.lit("/"), F.lit(1)), F.regexp_extract(F.split_part("source_file", F.lit("/"), F.lit(2)), r"^[^_]+_(.*?)(?:\.\d+)?\.json$", 1)).alias("task_id")).distinct()),
        "proj_p5_label_codes": _label_codes,
        "proj_p6_dense_index": _dense_index,
        "proj_p7_preview": _raw(lambda r: r.select("row_id", fn.preview(F.col("inputs"), 120).alias("preview"), fn.preview(F.col("inputs"), 120, False).alias("plain"))),
        "proj_p8_safe_name": lambda spark, d: table(spark, d, "task_catalog").select("task_id", fn.safe_name(F.col("task_id")).alias("safe"), fn.slug(F.col("task_id")).alias("slug")),
        "join_j9_key_decode": _decoded,
        "fn_c1_strip": _raw(lambda r: r.select("row_id", F.length(fn.strip(F.col("targets"))).alias("n"), fn.is_blank(F.col("targets")).alias("blank"))),
        "fn_c4_hash_score": _raw(lambda r: r.select("row_id", fn.hash_score_hex(F.col("task_id"), F.col("split"), F.col("source_index")).alias("score"))),
    }


def oracle_sql():
    def side(s):
        here = f"split = '{s}'"
        parts = [f"count_if({here}) AS source_{s}_count", f"count_if({here} AND {_VALID}) AS valid_{s}_count", f"count_if({here} AND NOT coalesce({_VALID}, false)) AS excluded_{s}_count"]
        return parts + [f"count_if({here} AND list_contains(string_split(r, ','), '{x}')) AS {s}_{x}_count" for x in v.REASONS]

    marked = f"(SELECT *, {_REASONS} AS r FROM raw_examples)"
    manifest = f"SELECT corpus, task_id, task_name, source_file, {', '.join(side('train') + side('validation'))} FROM {marked} GROUP BY ALL"
    text = lambda c, b: f"count_if({c} IS NULL) AS {c}_null, count_if({b}) AS {c}_blank, coalesce(max(length({c})), 0) AS {c}_max_chars, coalesce(sum(length({c})), 0) AS {c}_chars, CASE WHEN count({c}) > 0 THEN round_even(sum(length({c})) / count({c}), 2) ELSE 0.0 END AS {c}_mean_chars"
    label = "SELECT corpus, task_id, dense_rank() OVER (PARTITION BY corpus ORDER BY task_id) - 1 AS label FROM task_catalog"
    strip = "regexp_replace(targets, '^[\\s\\x0b\\x1c-\\x1f\\x85\\pZ]+|[\\s\\x0b\\x1c-\\x1f\\x85\\pZ]+$', '', 'g')"
    pre = lambda x: f"CASE WHEN length({x}) <= {{n}} THEN {x} ELSE left({x}, {{n}}) || '...[truncated]' END"
    esc = lambda c, n: pre(f"replace({c}, chr(10), '\\n')").format(n=n)
    return {
        "scan_s2_valid_rows": f"SELECT task_id, task_index, split, count(*) AS n, max(source_index) AS last_index FROM raw_examples JOIN (SELECT task_id, task_index FROM task_catalog) USING (task_id) WHERE {_VALID} GROUP BY ALL",
        "filter_f1_validity": f"SELECT split, count_if({_VALID}) AS valid, count(*) AS n FROM raw_examples GROUP BY split",
        "filter_f2_reasons": f"SELECT row_id, r AS reasons FROM {marked} WHERE r <> ''",
        "filter_f3_empty_audit": f"SELECT task_id, count(*) AS n, count_if(NOT is_object OR inputs IS NULL OR {_I}) AS empty_inputs, count_if(NOT is_object OR targets IS NULL OR {_T}) AS empty_targets FROM raw_examples GROUP BY task_id",
        "filter_f4_quarantine": f"SELECT row_id, source_file, split, source_index, r AS reasons, {esc('inputs', 80)} AS inputs_preview, {esc('targets', 80)} AS targets_preview FROM {marked} WHERE r <> ''",
        "agg_a1_split_statistics": f"SELECT task_id, split, count(*) AS n, count_if(r <> '') AS invalid, {text('inputs', _I)}, {text('targets', _T)} FROM {marked} GROUP BY task_id, split",
        "agg_a2_type_histogram": """SELECT task_id, '{' || string_agg('"' || kind || '": ' || n, ', ' ORDER BY kind) || '}' AS types FROM (SELECT task_id, CASE WHEN NOT is_object THEN 'row_not_object' WHEN inputs IS NULL THEN 'null' ELSE 'str' END AS kind, count(*) AS n FROM raw_examples GROUP BY ALL) GROUP BY task_id""",
        "agg_a3_reason_counts": f"SELECT task_id, split, reason, count(*) AS n FROM (SELECT task_id, split, unnest(string_split(r, ',')) AS reason FROM {marked} WHERE r <> '') GROUP BY GROUPING SETS ((task_id, split, reason), (split, reason), (reason))",
        "agg_a4_corpus_rollup": "WITH t AS (SELECT corpus, task_id, sum(source_train_count) AS train, sum(source_validation_count) AS validation FROM clean_manifest GROUP BY ALL) SELECT corpus, count(*) AS tasks, sum(train) AS train, sum(validation) AS validation, sum(train + validation) AS total, first(task_id ORDER BY train DESC, task_id) AS largest_task FROM t GROUP BY ROLLUP (corpus)",
        "agg_a5_manifest": manifest,
        "agg_a5_conservation": f"SELECT corpus, sum(source_train_count) AS source, sum(valid_train_count) AS valid, sum(excluded_train_count) AS excluded, bool_and(source_train_count = valid_train_count + excluded_train_count) AS conserved FROM ({manifest}) GROUP BY corpus",
        "agg_a6_duplicates": "SELECT source_file, split, source_index, count(*) AS n FROM raw_examples GROUP BY ALL HAVING count(*) > 1",
        "agg_a24_catalog_totals": "SELECT count(DISTINCT task_id) AS tasks, sum(valid_train_count) AS train, sum(valid_validation_count) AS validation FROM clean_manifest",
        "proj_p1_task_id": "SELECT DISTINCT source_file, split_part(source_file, '/', 1) || '::' || regexp_extract(split_part(source_file, '/', 2), '^[^_]+_(.*?)(?:\\.\\d+)?\\.json$', 1) AS task_id FROM raw_examples",
        "proj_p5_label_codes": label,
        "proj_p6_dense_index": "SELECT task_id, row_number() OVER (ORDER BY corpus_position, task_id) - 1 AS dense_index FROM task_catalog",
        "proj_p7_preview": f"SELECT row_id, {esc('inputs', 120)} AS preview, {pre('inputs').format(n=120)} AS plain FROM raw_examples",
        "proj_p8_safe_name": "SELECT task_id, regexp_replace(task_id, '[^A-Za-z0-9_.-]+', '__', 'g') AS safe, trim(regexp_replace(replace(task_id, '::', '__'), '[^A-Za-z0-9._-]+', '_', 'g'), '_') AS slug FROM task_catalog",
        "join_j9_key_decode": f"WITH l AS ({label}) SELECT l2.corpus, l2.task_id, count(*) AS n FROM mixture m JOIN l ON m.corpus = l.corpus AND m.task_id = l.task_id JOIN l l2 ON l.corpus = l2.corpus AND l.label = l2.label GROUP BY ALL",
        "fn_c1_strip": f"SELECT row_id, length({strip}) AS n, {_T} AS blank FROM raw_examples",
        "fn_c4_hash_score": "SELECT row_id, left(sha256('23|' || task_id || '|' || split || '|' || source_index), 16) AS score FROM raw_examples",
    }
