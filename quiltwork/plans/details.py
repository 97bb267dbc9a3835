"""Queries of single steps: projections, digests, regular expressions, result and run checks, orderings and the sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from quiltwork.functions import text as fn
from quiltwork.operators import evaluation as ev
from quiltwork.operators import mixture as mx
from quiltwork.operators import templates as tp
from quiltwork.operators import validity as v
from quiltwork.plans import runner
from quiltwork.session import shared_dir
from quiltwork.sources import files, task_json
from quiltwork.sources.tables import table

TASKS = {"authors_exact_dense": "acc", "candidate_restricted": "acc"}


def _folder(spark) -> str:
    return f"{shared_dir(spark).rstrip('/')}/details/{uuid.uuid4().hex}"


def _raw(f):
    return lambda spark, d: f(table(spark, d, "raw_examples"))


def _marked(spark, d):
    return tp.with_template(table(spark, d, "raw_examples").filter("is_object and inputs is not null"), "inputs")


def top_level_keys(spark, d):
    """Keys of task files made of the catalog, one file a corpus."""
    root, rows = _folder(spark), []
    for r in table(spark, d, "task_catalog").groupBy("corpus").agg(F.count("*").alias("n")).collect():
        path = f"{root}/{r.corpus}.json"
        task_json.write_object(path, {"train": [{"inputs": "a"}] * r.n, "about": {"n": r.n}, r.corpus: 1})
        rows += [(r.corpus, key) for key in sorted(task_json.top_level_keys(path))]
    return spark.createDataFrame(rows, "corpus string, key string")


def report_of(spark, d):
    """Reports of all corpora, of which one meets the condition: the corpus with most tasks (ties: last name)."""
    root = _folder(spark)
    counts = table(spark, d, "task_catalog").groupBy("corpus").agg(F.count("*").alias("tasks"))
    best = counts.orderBy(F.desc("tasks"), F.desc("corpus")).first()
    for r in counts.collect():
        task_json.write_object(f"{root}/{r.corpus}/report.json", {"corpus": r.corpus, "tasks": r.tasks})
    found = files.read_reports(spark, f"{root}/*/report.json", "corpus string, tasks long", f"corpus = '{best.corpus}'")
    return spark.createDataFrame([found], "corpus string, tasks long")


def _reports(spark, d):
    """Result maps of the allocations, one a corpus, some of them faulty: a task is missing, a metric is, or is no number."""
    a = table(spark, d, "task_allocations").groupBy("corpus").agg(F.avg("normalized_weight").alias("w"), F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("corpus"))  # one row a corpus
    nan = F.lit(float("nan"))
    entry = F.create_map(F.when(F.col("k") % 4 == 2, "other").otherwise("acc,none"), F.when(F.col("k") % 4 == 3, nan).otherwise(F.col("w")))
    whole = F.create_map(F.lit("authors_exact_dense"), F.create_map(F.lit("acc"), F.col("w")), F.lit("candidate_restricted"), entry)
    part = F.create_map(F.lit("authors_exact_dense"), F.create_map(F.lit("acc"), F.col("w")))
    return a.withColumn("k", place).select(F.col("corpus").alias("model"), F.lit("full").alias("mode"), F.lit(25000).alias("budget"), F.when(F.col("k") % 4 == 1, part).otherwise(whole).alias("results"), F.create_map().cast("map<string,map<string,double>>").alias("groups"))


def run_checks(spark, d):
    """Logs of the events, a run a user; a run is expected to end at its last event, users without events and one step too many
    among the expected ones."""
    e = table(spark, d, "events")
    points = e.select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), F.when(F.col("event_id") % 97 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("lr"))
    last = e.groupBy(F.col("user_id").alias("run")).agg(F.max("event_id").alias("last_step"))
    expected = last.filter("run % 5 <> 1").withColumn("last_step", F.col("last_step") + F.when(F.col("run") % 5 == 2, 1).otherwise(0)).unionByName(spark.createDataFrame([(-1, 5)], "run long, last_step long"))
    return ev.run_checks(points, expected).select("run", "check")


def assembled_orderings(spark, d):
    """Per-corpus orderings of the per-task orders: tasks by position in the corpus, rows by their rank, numbered through."""
    cat = table(spark, d, "task_catalog").select("task_id", "corpus_position", "task_index")
    rows = table(spark, d, "mixture").filter("split = 'train'").select("mix_id", "task_id", "corpus", "selection_rank").join(cat, "task_id")
    return mx.rank_within(rows, "corpus", ["corpus_position", "task_index", "selection_rank", "mix_id"], "corpus_rank").select("corpus", "corpus_rank", "mix_id")


def validation_subset(spark, d):
    """A seeded tenth of the validation rows, in seeded order."""
    rows = table(spark, d, "mixture").filter("split = 'validation'").select("mix_id")
    n = rows.count()
    return mx.hash_order(mx.with_positions(rows, ["mix_id"]), 23).filter(F.col("final_position") < n // 10).select("mix_id", "final_position")


def replaced(spark, d):
    """A table replaced while it exists: what is read behind the pointer, and the completion mark."""
    root = _folder(spark)
    cat = table(spark, d, "task_catalog").select("task_id", "corpus")
    files.replace_table(cat.limit(1), root)
    files.replace_table(cat, root)
    files.write_bytes(spark, f"{root}/done", b"ok")
    marked = files.read_bytes(spark, f"{root}/done") == b"ok"
    return files.current_table(spark, root).groupBy("corpus").agg(F.count("*").alias("n"), F.lit(marked).alias("marked"))


def gates(spark, d):
    """A stage whose check fails stops the run and has no mark; once it is mended the run goes on; a stage before its prerequisite is
    refused."""
    root = _folder(spark)
    build = lambda s, t: table(s, d, "task_catalog").select("task_id", "domain")
    after = runner.Stage("counts", lambda s, t: t["catalog"].groupBy("domain").count(), after=("catalog",))
    strict = [runner.Stage("catalog", build, {"v": 1}, checks={"domain": "domain is not null"}), after]
    loose = [runner.Stage("catalog", build, {"v": 2}, checks={"task": "task_id is not null"}, keys=("task_id",)), after]
    out = []
    for name, stages in (("broken", strict), ("prerequisite", [after]), ("mended", loose)):
        try:
            runner.run(spark, root, stages)
            state = "ran"
        except ValueError:
            state = "stopped"
        out.append((name, state, runner.progress(spark, root, strict)))
    return spark.createDataFrame(out, "run string, state string, done int")


def packet(spark, d):
    """Lines of a Markdown page of the allocations of the largest tasks."""
    rows = table(spark, d, "task_allocations").orderBy(F.desc("valid_train_count"), "task_id").select("task_id", "valid_train_count").limit(10)
    page = files.markdown(rows, "Largest tasks")
    return spark.createDataFrame([(i, line) for i, line in enumerate(page.split("\n")) if line.startswith("| ")], "line int, text string")


def csv_round_trip(spark, d):
    path = _folder(spark)
    files.write_csv(table(spark, d, "task_catalog").select("task_id", "corpus", "task_index"), path)
    return files.read_csv(spark, path, "task_id string, task_index int")


def queries():
    return {
        "scan_s3_top_level_keys": top_level_keys,
        "scan_s11_report": report_of,
        "proj_p3_pruned": _raw(lambda r: r.filter(v.is_valid()).select("task_id", "split", F.col("inputs").alias("prompt"), F.col("targets").alias("response")).groupBy("task_id", "split").agg(F.sum(fn.code_points(F.col("prompt"))).alias("prompt_chars"), F.sum(fn.code_points(F.col("response"))).alias("response_chars"))),
        "proj_p4_constants": lambda spark, d: table(spark, d, "mixture").filter("split = 'validation'").select("mix_id", F.lit(-1).cast("long").alias("pre_shuffle_position"), F.lit(-1).cast("long").alias("mixture_budget"), F.lit(float("nan")).alias("marginal_gain")),
        "proj_p10_safe_ratio": lambda spark, d: table(spark, d, "clean_manifest").select("source_file", fn.safe_ratio(F.col("excluded_train_count"), F.col("source_train_count"), 6).alias("excluded"), fn.safe_ratio(F.col("valid_train_count"), F.col("source_validation_count") - F.col("source_validation_count"), 6).alias("none")),
        "fn_c2_code_points": _raw(lambda r: r.select("row_id", fn.code_points(F.col("inputs")).alias("inputs"), fn.code_points(F.col("targets")).alias("targets"))),
        "fn_c3_sha256": _raw(lambda r: r.select("row_id", F.sha2(F.coalesce("inputs", F.lit("")), 256).alias("digest"))),
        "fn_c6_weak_signals": lambda spark, d: _marked(spark, d).select("row_id", F.col("inputs").rlike(tp.WEAK_OPTION).alias("weak_option"), F.col("inputs").rlike(tp.WEAK_FEWSHOT).alias("weak_fewshot")),
        "fn_c7_few_shot": lambda spark, d: _marked(spark, d).groupBy("task_id").agg(F.count_if(F.col("template_type").startswith("fs")).alias("few"), F.count("*").alias("n")),
        "fn_c8_options": lambda spark, d: _marked(spark, d).groupBy("task_id").agg(F.count_if(F.col("template_type").endswith("_opt")).alias("with_options"), F.count("*").alias("n")),
        "fn_c15_metric": lambda spark, d: _reports(spark, d).select("model", F.round(ev.metric(F.try_element_at("results", F.lit("candidate_restricted")), "acc"), 6).alias("value")),
        "fn_c16_float": lambda spark, d: table(spark, d, "events").select("event_id", F.round(F.try_to_number(F.format_string("%.4f", "value"), F.lit("99999999.9999")).cast("double"), 4).alias("value")),
        "sort_t9_validation_subset": validation_subset,
        "sort_t10_hash_probe": lambda spark, d: mx.hash_probe(table(spark, d, "raw_examples").select("row_id", "task_id", "split", "source_index"), "task_id", ["task_id", "split", "source_index", "row_id"], 5).select("task_id", "probe", "row_id"),
        "sink_k1_replaced": replaced,
        "sink_k3_csv": csv_round_trip,
        "sink_k9_packet": packet,
        "dom_d27_orderings": assembled_orderings,
        "dom_d35_reasons": lambda spark, d: ev.result_reasons(_reports(spark, d), TASKS),
        "gate_o2_validation": gates,
        "gate_o8_run_checks": run_checks,
        "gate_o10_progress": lambda spark, d: gates(spark, d).groupBy("run").agg(F.max("done").alias("done")),
    }


def oracle_sql():
    from quiltwork.plans import texts
    from quiltwork.plans.ingest import _VALID

    kinds = texts.oracle_sql()["fn_c9_template_type"]
    reports = "(SELECT *, row_number() OVER (ORDER BY corpus) AS k FROM (SELECT corpus, avg(normalized_weight) AS w FROM task_allocations GROUP BY corpus))"
    typed = f"(SELECT task_id, template_type FROM ({kinds}) JOIN (SELECT row_id, task_id FROM raw_examples) USING (row_id))"
    weak = lambda p: f"regexp_matches(inputs, '{p}')"
    points = "(SELECT user_id AS run, event_id AS step, CASE WHEN event_id % 97 = 0 THEN 'nan'::DOUBLE ELSE value END AS lr FROM events)"
    facts = f"(SELECT run, max(step) AS last, count(*) > count(DISTINCT step) AS again, bool_or(NOT isfinite(lr)) AS odd, bool_or(lr < 0) AS low FROM {points} GROUP BY run)"
    want = f"(SELECT run, last + (run % 5 = 2)::BIGINT AS want FROM {facts} WHERE run % 5 <> 1 UNION ALL SELECT -1, 5)"
    both = f"(SELECT coalesce(f.run, w.run) AS run, f.run IS NULL AS no_points, w.run IS NULL AS not_expected, last <> want AS wrong_last_step, again AS repeated_step, odd AS rate_not_finite, low AS rate_negative FROM {facts} f FULL JOIN {want} w ON f.run = w.run)"
    checks = " UNION ALL ".join(f"SELECT run, '{c}' AS \"check\" FROM {both} WHERE {c}" for c in ("no_points", "not_expected", "wrong_last_step", "repeated_step", "rate_not_finite", "rate_negative"))
    nulls = "(SELECT count(*) FILTER (WHERE domain IS NULL) = 0 AS fine FROM task_catalog)"
    gate = f"SELECT 'broken' AS run, CASE WHEN fine THEN 'ran' ELSE 'stopped' END AS state, CASE WHEN fine THEN 2 ELSE 0 END AS done FROM {nulls} UNION ALL SELECT 'prerequisite', 'stopped', CASE WHEN fine THEN 2 ELSE 0 END FROM {nulls} UNION ALL SELECT 'mended', 'ran', 2 FROM {nulls}"
    return {
        "scan_s3_top_level_keys": "SELECT corpus, unnest(['train', 'about', corpus]) AS key FROM (SELECT DISTINCT corpus FROM task_catalog)",
        "scan_s11_report": "SELECT corpus, count(*) AS tasks FROM task_catalog GROUP BY corpus ORDER BY tasks DESC, corpus DESC LIMIT 1",
        "proj_p3_pruned": f"SELECT task_id, split, sum(length(inputs)) AS prompt_chars, sum(length(targets)) AS response_chars FROM raw_examples WHERE {_VALID} GROUP BY ALL",
        "proj_p4_constants": "SELECT mix_id, -1::BIGINT AS pre_shuffle_position, -1::BIGINT AS mixture_budget, 'nan'::DOUBLE AS marginal_gain FROM mixture WHERE split = 'validation'",
        "proj_p10_safe_ratio": "SELECT source_file, CASE WHEN source_train_count <> 0 THEN round(excluded_train_count / source_train_count, 6) ELSE 0.0 END AS excluded, 0.0::DOUBLE AS none FROM clean_manifest",
        "fn_c2_code_points": "SELECT row_id, coalesce(length(inputs), 0) AS inputs, coalesce(length(targets), 0) AS targets FROM raw_examples",
        "fn_c3_sha256": "SELECT row_id, sha256(coalesce(inputs, '')) AS digest FROM raw_examples",
        "fn_c6_weak_signals": f"SELECT row_id, {weak(tp.WEAK_OPTION)} AS weak_option, {weak(tp.WEAK_FEWSHOT)} AS weak_fewshot FROM raw_examples WHERE is_object AND inputs IS NOT NULL",
        "fn_c7_few_shot": f"SELECT task_id, count_if(template_type LIKE 'fs%') AS few, count(*) AS n FROM {typed} GROUP BY task_id",
        "fn_c8_options": f"SELECT task_id, count_if(template_type IN ('zs_opt', 'fs_opt')) AS with_options, count(*) AS n FROM {typed} GROUP BY task_id",
        "fn_c15_metric": f"SELECT corpus AS model, CASE WHEN k % 4 = 3 THEN 'nan'::DOUBLE WHEN k % 4 = 0 THEN round(w, 6) END AS value FROM {reports}",
        "fn_c16_float": "SELECT event_id, round(value, 4) AS value FROM events",
        "sort_t9_validation_subset": "SELECT mix_id, f AS final_position FROM (SELECT mix_id, row_number() OVER (ORDER BY sha256('23|' || p), p) - 1 AS f, count(*) OVER () AS n FROM (SELECT mix_id, row_number() OVER (ORDER BY mix_id) - 1 AS p FROM mixture WHERE split = 'validation')) WHERE f < n // 10",
        "sort_t10_hash_probe": "SELECT task_id, row_number() OVER (PARTITION BY task_id ORDER BY sha256('23|' || task_id || '|' || split || '|' || source_index || '|' || row_id)) AS probe, row_id FROM raw_examples QUALIFY probe <= 5",
        "sink_k1_replaced": "SELECT corpus, count(*) AS n, true AS marked FROM task_catalog GROUP BY corpus",
        "sink_k3_csv": "SELECT task_id, task_index FROM task_catalog",
        "sink_k9_packet": "SELECT 2::INT AS line, '| task_id | valid_train_count |' AS text UNION ALL SELECT (3 + row_number() OVER (ORDER BY valid_train_count DESC, task_id))::INT, '| ' || task_id || ' | ' || valid_train_count || ' |' FROM (SELECT * FROM task_allocations ORDER BY valid_train_count DESC, task_id LIMIT 10)",
        "dom_d27_orderings": "SELECT corpus, row_number() OVER (PARTITION BY corpus ORDER BY corpus_position, task_index, selection_rank, mix_id) AS corpus_rank, mix_id FROM (SELECT mix_id, task_id, corpus, selection_rank FROM mixture WHERE split = 'train') JOIN (SELECT task_id, corpus_position, task_index FROM task_catalog) USING (task_id)",
        "dom_d35_reasons": f"SELECT corpus AS model, 'full' AS mode, 25000 AS budget, 'candidate_restricted' AS task, CASE k % 4 WHEN 1 THEN 'missing_task' WHEN 2 THEN 'missing_metric' WHEN 3 THEN 'not_finite' END AS reason FROM {reports} WHERE k % 4 > 0",
        "gate_o2_validation": gate,
        "gate_o8_run_checks": checks,
        "gate_o10_progress": f"SELECT run, max(done) AS done FROM ({gate}) GROUP BY run",
    }
