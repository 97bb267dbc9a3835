"""Queries of joins, windows, sorts, sets, aggregates and mixture assembly."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quiltwork.operators import evaluation as ev
from quiltwork.operators import mixture as mx
from quiltwork.sources.tables import table

BUDGET = 300


def _train(spark, d):
    return table(spark, d, "mixture").filter("split = 'train'")


def _alloc(spark, d):
    return table(spark, d, "task_allocations")


def _source(spark, d):
    """Distinct valid train positions of the raw rows, by task: a selection to probe with."""
    return table(spark, d, "raw_examples").filter("split = 'train' and is_object").select("source_file", "source_index", "task_id", "row_id", "loaded_at")


def _ranked(spark, d):
    """An ordering of the train rows of each task by a seeded hash; one task may hold a tenth of the rows, so ranks come from
    positions."""
    rows = _train(spark, d).select("mix_id", "task_id", "corpus", F.sha2(F.concat_ws("|", F.lit("23"), F.col("mix_id").cast("string")), 256).alias("__h"))
    return mx.rank_within(rows, "task_id", ["__h"]).drop("__h")


def _by_id(spark, d):
    """The train rows of each task by mix_id."""
    return mx.rank_within(_train(spark, d).select("task_id", "mix_id"), "task_id", ["mix_id"])


def _budgets(spark, d):
    return _alloc(spark, d).select("task_id", F.col("final_allocation_25000").alias("budget"), F.col("final_allocation_50000").alias("larger"))


def _assembled(spark, d):
    """Prefix of every pool, concatenated in corpus, task and rank order."""
    cat = table(spark, d, "task_catalog").select("task_id", "corpus_position", "task_index")
    rows = mx.prefix(_ranked(spark, d), _budgets(spark, d)).join(cat, "task_id")
    return mx.with_positions(rows, ["corpus_position", "task_index", "rank"], "position").select("position", "mix_id", "task_id", "rank")


def _shuffled(spark, d):
    return mx.hash_order(_assembled(spark, d), 23)


def _numpy_order(spark, d):
    rows = _assembled(spark, d)
    return mx.shuffle(rows, 23, rows.count())


def _stripes(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))


def _reports(spark, d):
    """Result maps made of the mixture: for each corpus the mean gain of its methods as metrics."""
    m = _train(spark, d).groupBy("corpus", "stage2_method").agg(F.avg("marginal_gain").alias("g"), F.count("*").alias("n"))
    entry = F.create_map(F.lit("acc,none"), F.col("g"), F.lit("size"), F.col("n").cast("double"))
    rows = m.groupBy("corpus").agg(F.map_from_entries(F.collect_list(F.struct("stage2_method", entry.alias("e")))).alias("results"))
    return rows.select(F.col("corpus").alias("model"), F.lit("full").alias("mode"), F.lit(25000).alias("budget"), "results", F.create_map().cast("map<string,map<string,double>>").alias("groups"))


def _multiset(spark, d):
    """Rows of the validation and of the test split that the other has no match for, copies counted."""
    m = table(spark, d, "mixture")
    a, b = (m.filter(F.col("split") == x).select("corpus", "task_id", "lang") for x in ("validation", "test"))
    only = lambda x, y, name: x.exceptAll(y).groupBy("corpus").agg(F.count("*").alias(name))
    return only(a, b, "validation_only").join(only(b, a, "test_only"), "corpus", "full_outer")


def queries():
    return {
        "join_j1_selection_rows": lambda spark, d: _source(spark, d).join(_alloc(spark, d).select("task_id", F.col("graph_cut_rank").cast("long").alias("source_index")), ["task_id", "source_index"]).select("task_id", "source_index", "row_id"),
        "join_j2_allocation_catalog": lambda spark, d: _alloc(spark, d).select("task_id", "task_index", "valid_train_count").join(table(spark, d, "task_catalog").select("task_id", F.col("task_index").alias("catalog_index"), "domain"), "task_id").select("task_id", (F.col("task_index") == F.col("catalog_index")).alias("same_index"), "valid_train_count", "domain"),
        "join_j3_reconcile": lambda spark, d: mx.reconcile(_alloc(spark, d), table(spark, d, "clean_manifest"), ["task_id"]),
        "join_j4_semi": lambda spark, d: _train(spark, d).join(_alloc(spark, d).filter("final_allocation_25000 > 0"), "task_id", "left_semi").select("mix_id", "task_id"),
        "join_j5_anti": lambda spark, d: table(spark, d, "task_catalog").join(_train(spark, d), "task_id", "left_anti").select("task_id"),
        "join_j8_positional": lambda spark, d: _ranked(spark, d).select("task_id", "rank", F.col("mix_id").alias("a")).join(_by_id(spark, d).withColumnRenamed("mix_id", "b"), ["task_id", "rank"]).select("task_id", "rank", "a", "b"),
        "join_j10_subset": lambda spark, d: _train(spark, d).filter("included_in_25000").select("mix_id").join(_train(spark, d).filter("budget >= 25000").select("mix_id"), "mix_id", "left_anti").agg((F.count("*") == 0).alias("contained")),
        "join_j11_outlier_union": lambda spark, d: table(spark, d, "documents").select("doc_id", F.length("text").alias("score")).unionByName(table(spark, d, "documents").select("doc_id", (F.col("n_claims") * 400).cast("int").alias("score"))).groupBy("doc_id").agg(F.max("score").alias("score")).orderBy(F.desc_nulls_last("score"), "doc_id").limit(30),
        "filter_f5_task_subset": lambda spark, d: _train(spark, d).filter(F.col("task_id").isin("weft::osturmar_brief", "parley::torania_label")).groupBy("task_id").agg(F.count("*").alias("n")),
        "filter_f8_kernel_sizes": lambda spark, d: _alloc(spark, d).select((F.col("valid_train_count") * F.col("valid_train_count") * 4 / F.lit(2.0**30)).alias("gib")).agg(*[F.count_if(F.col("gib") > x).alias(f"over_{x}") for x in (16, 32, 64, 128)]),
        "filter_f9_range_buckets": lambda spark, d: _alloc(spark, d).select("task_id", F.col("valid_train_count").alias("n")).join(F.broadcast(spark.createDataFrame([("tiny", 100, 1000), ("small", 1001, 5000), ("medium", 5001, 20000)], "bucket string, low int, high int")), F.col("n").between(F.col("low"), F.col("high"))).select("bucket", "task_id", "n"),
        "proj_p2_rename": lambda spark, d: table(spark, d, "raw_examples").select("row_id", F.col("inputs").alias("prompt"), F.col("targets").alias("response")).groupBy((F.col("row_id") % 10).alias("bucket")).agg(F.count("prompt").alias("prompts"), F.count("response").alias("responses")),
        "proj_p11_kernel_bytes": lambda spark, d: _alloc(spark, d).select("task_id", (F.col("valid_train_count") * F.col("valid_train_count") * 4).alias("dense_bytes"), (F.col("valid_train_count") * 1024 * 4).alias("vector_bytes"), F.round(F.col("valid_train_count") * 1024 * 4 / F.lit(2.0**30), 6).alias("vector_gib")),
        "agg_a16_size_classes": lambda spark, d: _alloc(spark, d).groupBy(F.when(F.col("valid_train_count") <= 1000, "tiny").when(F.col("valid_train_count") <= 5000, "small").when(F.col("valid_train_count") <= 20000, "medium").when(F.col("valid_train_count") <= 100000, "large").otherwise("very_large").alias("size_class")).agg(F.count("*").alias("n")),
        "agg_a17_feasibility": lambda spark, d: _alloc(spark, d).groupBy(F.when(F.col("valid_train_count") <= 5000, "exact_dense_candidate").when(F.col("valid_train_count") <= 50000, "benchmark_required").otherwise("exact_dense_infeasible").alias("feasibility")).agg(F.count("*").alias("n"), F.sum("valid_train_count").alias("rows")),
        "agg_a18_methods": lambda spark, d: table(spark, d, "mixture").groupBy("stage2_method", "candidate_restricted").agg(F.count("*").alias("n")),
        "agg_a19_membership_hash": lambda spark, d: mx.membership_digest(_train(spark, d).filter("included_in_25000"), "task_id", ["task_id", "source_index"]),
        "agg_a20_content_rows": lambda spark, d: _train(spark, d).select(F.sha2(F.concat(F.coalesce("prompt", F.lit("")), F.lit("\x00"), F.coalesce("response", F.lit(""))), 256).alias("h")).groupBy(F.substring("h", 1, 1).alias("nibble")).agg(F.count("*").alias("n"), F.countDistinct("h").alias("kinds"), F.min("h").alias("least")),
        "agg_a21_extremes": lambda spark, d: _alloc(spark, d).groupBy("corpus").agg(F.min_by("task_id", F.struct("marginal_gain", "task_id")).alias("least"), F.max_by("task_id", F.struct("marginal_gain", "task_id")).alias("most"), F.round(F.min("marginal_gain"), 6).alias("low"), F.round(F.max("marginal_gain"), 6).alias("high")),
        "agg_a22_all": lambda spark, d: _alloc(spark, d).groupBy("corpus").agg(F.bool_and(F.col("final_allocation_50000") >= F.col("final_allocation_25000")).alias("monotone"), F.bool_and(F.col("final_allocation_25000") <= F.col("valid_train_count")).alias("within")),
        "win_w1_rank": lambda spark, d: _alloc(spark, d).select("task_id", F.row_number().over(Window.partitionBy("corpus").orderBy(F.desc("marginal_gain"), "task_id")).alias("rank")),
        "win_w2_running_sum": lambda spark, d: _alloc(spark, d).select("task_id", F.round(F.sum("marginal_gain").over(Window.partitionBy("corpus").orderBy("graph_cut_rank").rowsBetween(Window.unboundedPreceding, 0)), 6).alias("cumulative")),
        "win_w3_prefix_flags": lambda spark, d: mx.inclusion_flags(_ranked(spark, d).join(_budgets(spark, d), "task_id"), {"25000": F.col("budget"), "50000": F.col("larger")}).groupBy("task_id").agg(F.count_if("included_in_25000").alias("small"), F.count_if("included_in_50000").alias("large")),
        "win_w4_increasing": lambda spark, d: _source(spark, d).select("source_file", "row_id", "source_index").withColumn("before", F.lag("source_index").over(Window.partitionBy("source_file").orderBy("source_index", "row_id"))).groupBy("source_file").agg(F.bool_and(F.coalesce(F.col("source_index") > F.col("before"), F.lit(True))).alias("strict")),
        "win_w5_contiguous": lambda spark, d: _source(spark, d).groupBy("source_file").agg(F.min("source_index").alias("first"), F.max("source_index").alias("last"), (F.max("source_index") - F.min("source_index") + 1 == F.countDistinct("source_index")).alias("contiguous")),
        "win_w6_interval_cover": lambda spark, d: (x := _alloc(spark, d).select("task_index", F.sum("valid_train_count").over(Window.partitionBy(F.lit(0)).orderBy("task_index")).alias("end"), "valid_train_count")).select("task_index", (F.col("end") - F.col("valid_train_count")).alias("start"), "end").withColumn("abuts", F.coalesce(F.lag("end").over(Window.partitionBy(F.lit(0)).orderBy("task_index")), F.lit(0)) == F.col("start")),
        "win_w7_rank_check": lambda spark, d: _alloc(spark, d).agg((F.min("graph_cut_rank") == 1).alias("from_one"), (F.max("graph_cut_rank") == F.count("*")).alias("to_n"), (F.countDistinct("graph_cut_rank") == F.count("*")).alias("distinct")),
        "win_w9_positions": _assembled,
        "win_w10_first_divergence": lambda spark, d: mx.first_divergence(_ranked(spark, d), _by_id(spark, d), ["task_id"], "rank", "mix_id"),
        "win_w11_rises": lambda spark, d: ev.learning_rate_rises(table(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), F.col("value").alias("lr"))).select("run", "step"),
        "win_w13_even_sample": lambda spark, d: mx.even_sample((c := table(spark, d, "customer").select("c_custkey")), ["c_custkey"], c.count(), 37),
        "sort_t1_multi_key": lambda spark, d: _alloc(spark, d).orderBy(F.desc("valid_train_count"), "task_id").limit(15).select("task_id", "valid_train_count"),
        "sort_t2_top_k": lambda spark, d: table(spark, d, "clean_manifest").groupBy("task_id").agg(F.sum("source_train_count").alias("n")).orderBy(F.desc("n"), "task_id").limit(20),
        "sort_t4_closest": lambda spark, d: _alloc(spark, d).select("task_id", F.when(F.col("valid_train_count") <= 5000, 2500).otherwise(20000).alias("middle"), F.col("valid_train_count").alias("n")).withColumn("place", F.row_number().over(Window.partitionBy("middle").orderBy(F.abs(F.col("n") - F.col("middle")), "task_id"))).filter("place <= 5"),
        "sort_t5_fill": lambda spark, d: table(spark, d, "part").select(F.col("p_partkey").alias("k")).join(table(spark, d, "lineitem").filter("l_quantity >= 49").groupBy(F.col("l_partkey").alias("k")).agg(F.count("*").alias("score")), "k", "left").orderBy(F.desc_nulls_last("score"), "k").limit(50),
        "sort_t6_prefix": lambda spark, d: mx.prefix(_ranked(spark, d), _budgets(spark, d)).select("task_id", "rank", "mix_id"),
        "sort_t8_shuffle": _numpy_order,
        "sort_t8_hash_order": _shuffled,
        "sort_t11_first_per_category": lambda spark, d: _source(spark, d).withColumn("place", F.row_number().over(Window.partitionBy("task_id").orderBy("source_index", "row_id"))).filter("place <= 2").select("task_id", "place", "row_id"),
        "sort_t12_bins": lambda spark, d: mx.pack_bins(_alloc(spark, d), "valid_train_count", "task_id", 4).groupBy("bin").agg(F.count("*").alias("tasks")),
        "sort_t13_shards": lambda spark, d: table(spark, d, "raw_examples").groupBy(F.floor(F.col("row_id") / 2500).alias("shard")).agg(F.count("*").alias("n"), F.min("row_id").alias("first"), F.max("row_id").alias("last")),
        "set_u1_union": lambda spark, d: table(spark, d, "mixture").filter("split = 'test'").select("mix_id", F.lit(1).alias("part")).unionByName(table(spark, d, "mixture").filter("split = 'validation'").select("mix_id", F.lit(2).alias("part"))),
        "set_u3_difference": lambda spark, d: table(spark, d, "task_catalog").select("task_id").exceptAll(_train(spark, d).select("task_id").distinct()),
        "set_u4_intersection": lambda spark, d: mx.prefix(_ranked(spark, d), _budgets(spark, d)).select("mix_id").join(_train(spark, d).filter("included_in_25000").select("mix_id"), "mix_id").agg(F.count("*").alias("overlap")),
        "set_u5_prefix_equality": lambda spark, d: (p := mx.prefix(_ranked(spark, d), _budgets(spark, d))).select("task_id", "rank", F.col("mix_id").alias("a")).join(mx.prefix(_ranked(spark, d), _budgets(spark, d).select("task_id", F.col("larger").alias("budget"))).select("task_id", "rank", F.col("mix_id").alias("b")), ["task_id", "rank"], "left").groupBy("task_id").agg(F.bool_and(F.col("a").eqNullSafe(F.col("b"))).alias("nested")),
        "set_u6_multiset": lambda spark, d: _multiset(spark, d),
        "dom_d28_task_counts": lambda spark, d: _shuffled(spark, d).groupBy("task_id").agg(F.count("*").alias("n")),
        "dom_d30_permutation": lambda spark, d: _shuffled(spark, d).agg(F.count("*").alias("n"), (F.countDistinct("final_position") == F.count("*")).alias("distinct"), (F.min("final_position") == 0).alias("from_zero"), (F.max("final_position") == F.count("*") - 1).alias("to_n")),
        "dom_d29_validation": lambda spark, d: mx.with_positions(table(spark, d, "mixture").filter("split = 'validation'").join(table(spark, d, "task_catalog").select("task_id", "corpus_position", "task_index"), "task_id"), ["corpus_position", "task_index", "mix_id"]).select("position", "mix_id"),
        "dom_d34_leaderboard": lambda spark, d: ev.leaderboard(_reports(spark, d), {"authors_exact_dense": "acc", "candidate_restricted": "acc"}).select("model", "mode", "budget", F.round("authors_exact_dense", 6).alias("authors_exact_dense"), F.round("candidate_restricted", 6).alias("candidate_restricted"), "present", "status"),
        "gate_o7_manifest": lambda spark, d: table(spark, d, "task_catalog").select("corpus").distinct().join(F.broadcast(spark.createDataFrame([(25000,), (50000,)], "budget int")), F.lit(True)).join(_train(spark, d).filter("budget > 0").groupBy("corpus", "budget").agg(F.count("*").alias("n")), ["corpus", "budget"], "left").select("corpus", "budget", F.when(F.col("n") > 0, "valid").otherwise("missing").alias("state")),
    }


def oracle_sql():
    train = "(SELECT * FROM mixture WHERE split = 'train')"
    src = "(SELECT source_file, source_index, task_id, row_id FROM raw_examples WHERE split = 'train' AND is_object)"
    ranked = f"(SELECT mix_id, task_id, corpus, row_number() OVER (PARTITION BY task_id ORDER BY sha256('23|' || mix_id)) AS rank FROM {train})"
    budgets = "(SELECT task_id, final_allocation_25000 AS budget, final_allocation_50000 AS larger FROM task_allocations)"
    by_id = f"(SELECT task_id, mix_id, row_number() OVER (PARTITION BY task_id ORDER BY mix_id) AS rank FROM {train})"
    assembled = f"SELECT row_number() OVER (ORDER BY corpus_position, task_index, rank) - 1 AS position, mix_id, task_id, rank FROM {ranked} r JOIN {budgets} b USING (task_id) JOIN (SELECT task_id, corpus_position, task_index FROM task_catalog) USING (task_id) WHERE rank <= budget"
    size = "CASE WHEN valid_train_count <= 1000 THEN 'tiny' WHEN valid_train_count <= 5000 THEN 'small' WHEN valid_train_count <= 20000 THEN 'medium' WHEN valid_train_count <= 100000 THEN 'large' ELSE 'very_large' END"
    feas = "CASE WHEN valid_train_count <= 5000 THEN 'exact_dense_candidate' WHEN valid_train_count <= 50000 THEN 'benchmark_required' ELSE 'exact_dense_infeasible' END"
    gib = "valid_train_count * valid_train_count * 4 / power(2, 30)"
    return {
        "join_j1_selection_rows": f"SELECT s.task_id, s.source_index, row_id FROM {src} s JOIN task_allocations a ON s.task_id = a.task_id AND s.source_index = a.graph_cut_rank",
        "join_j2_allocation_catalog": "SELECT a.task_id, a.task_index = c.task_index AS same_index, valid_train_count, domain FROM task_allocations a JOIN task_catalog c ON a.task_id = c.task_id",
        "join_j3_reconcile": "(SELECT task_id, 'missing' AS side FROM task_allocations WHERE task_id NOT IN (SELECT task_id FROM clean_manifest)) UNION ALL (SELECT DISTINCT task_id, 'unexpected' FROM clean_manifest WHERE task_id NOT IN (SELECT task_id FROM task_allocations))",
        "join_j4_semi": f"SELECT mix_id, task_id FROM {train} WHERE task_id IN (SELECT task_id FROM task_allocations WHERE final_allocation_25000 > 0)",
        "join_j5_anti": f"SELECT task_id FROM task_catalog WHERE task_id NOT IN (SELECT task_id FROM {train})",
        "join_j8_positional": f"SELECT r.task_id, r.rank, r.mix_id AS a, b.mix_id AS b FROM {ranked} r JOIN {by_id} b ON r.task_id = b.task_id AND r.rank = b.rank",
        "join_j10_subset": f"SELECT count(*) = 0 AS contained FROM {train} WHERE included_in_25000 AND mix_id NOT IN (SELECT mix_id FROM {train} WHERE budget >= 25000)",
        "join_j11_outlier_union": "SELECT doc_id, max(score) AS score FROM (SELECT doc_id, length(text) AS score FROM documents UNION ALL SELECT doc_id, n_claims * 400 FROM documents) GROUP BY doc_id ORDER BY score DESC NULLS LAST, doc_id LIMIT 30",
        "filter_f5_task_subset": f"SELECT task_id, count(*) AS n FROM {train} WHERE task_id IN ('weft::osturmar_brief', 'parley::torania_label') GROUP BY task_id",
        "filter_f8_kernel_sizes": f"SELECT {', '.join(f'count_if({gib} > {x}) AS over_{x}' for x in (16, 32, 64, 128))} FROM task_allocations",
        "filter_f9_range_buckets": "SELECT bucket, task_id, valid_train_count AS n FROM task_allocations JOIN (VALUES ('tiny', 100, 1000), ('small', 1001, 5000), ('medium', 5001, 20000)) b(bucket, low, high) ON valid_train_count BETWEEN low AND high",
        "proj_p2_rename": "SELECT row_id % 10 AS bucket, count(inputs) AS prompts, count(targets) AS responses FROM raw_examples GROUP BY 1",
        "proj_p11_kernel_bytes": "SELECT task_id, valid_train_count * valid_train_count * 4 AS dense_bytes, valid_train_count * 1024 * 4 AS vector_bytes, round(valid_train_count * 1024 * 4 / power(2, 30), 6) AS vector_gib FROM task_allocations",
        "agg_a16_size_classes": f"SELECT {size} AS size_class, count(*) AS n FROM task_allocations GROUP BY 1",
        "agg_a17_feasibility": f"SELECT {feas} AS feasibility, count(*) AS n, sum(valid_train_count) AS rows FROM task_allocations GROUP BY 1",
        "agg_a18_methods": "SELECT stage2_method, candidate_restricted, count(*) AS n FROM mixture GROUP BY ALL",
        "agg_a19_membership_hash": f"SELECT task_id, count(*) AS n, bit_xor(('0x' || left(sha256(task_id || '|' || source_index), 15))::BIGINT) AS digest FROM {train} WHERE included_in_25000 GROUP BY task_id",
        "agg_a20_content_rows": f"SELECT left(h, 1) AS nibble, count(*) AS n, count(DISTINCT h) AS kinds, min(h) AS least FROM (SELECT sha256(coalesce(prompt, '') || chr(0) || coalesce(response, '')) AS h FROM {train}) GROUP BY 1",
        "agg_a21_extremes": "SELECT corpus, first(task_id ORDER BY marginal_gain, task_id) AS least, first(task_id ORDER BY marginal_gain DESC, task_id DESC) AS most, round(min(marginal_gain), 6) AS low, round(max(marginal_gain), 6) AS high FROM task_allocations GROUP BY corpus",
        "agg_a22_all": "SELECT corpus, bool_and(final_allocation_50000 >= final_allocation_25000) AS monotone, bool_and(final_allocation_25000 <= valid_train_count) AS within FROM task_allocations GROUP BY corpus",
        "win_w1_rank": "SELECT task_id, row_number() OVER (PARTITION BY corpus ORDER BY marginal_gain DESC, task_id) AS rank FROM task_allocations",
        "win_w2_running_sum": "SELECT task_id, round(sum(marginal_gain) OVER (PARTITION BY corpus ORDER BY graph_cut_rank ROWS UNBOUNDED PRECEDING), 6) AS cumulative FROM task_allocations",
        "win_w3_prefix_flags": f"SELECT task_id, count_if(rank <= budget) AS small, count_if(rank <= larger) AS large FROM {ranked} JOIN {budgets} USING (task_id) GROUP BY task_id",
        "win_w4_increasing": f"SELECT source_file, bool_and(coalesce(source_index > before, true)) AS strict FROM (SELECT source_file, source_index, lag(source_index) OVER (PARTITION BY source_file ORDER BY source_index, row_id) AS before FROM {src}) GROUP BY source_file",
        "win_w5_contiguous": f"SELECT source_file, min(source_index) AS first, max(source_index) AS last, max(source_index) - min(source_index) + 1 = count(DISTINCT source_index) AS contiguous FROM {src} GROUP BY source_file",
        "win_w6_interval_cover": 'SELECT task_index, start, "end", coalesce(lag("end") OVER (ORDER BY task_index), 0) = start AS abuts FROM (SELECT task_index, sum(valid_train_count) OVER (ORDER BY task_index) - valid_train_count AS start, sum(valid_train_count) OVER (ORDER BY task_index) AS "end" FROM task_allocations)',
        "win_w7_rank_check": 'SELECT min(graph_cut_rank) = 1 AS from_one, max(graph_cut_rank) = count(*) AS to_n, count(DISTINCT graph_cut_rank) = count(*) AS "distinct" FROM task_allocations',
        "win_w9_positions": assembled,
        "win_w10_first_divergence": f"SELECT coalesce(a.task_id, b.task_id) AS task_id, min(CASE WHEN a.mix_id IS DISTINCT FROM b.mix_id THEN coalesce(a.rank, b.rank) END) AS first_divergence FROM {ranked} a FULL JOIN {by_id} b ON a.task_id = b.task_id AND a.rank = b.rank GROUP BY 1",
        "win_w11_rises": "SELECT run, step FROM (SELECT user_id AS run, event_id AS step, value AS lr, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events WHERE event_id > 0) WHERE lr > before * (1 + 1e-8)",
        "win_w13_even_sample": "SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS p, count(*) OVER () AS n FROM customer) WHERE p IN (SELECT floor(i * (SELECT count(*) FROM customer) / 37)::BIGINT FROM range(37) t(i))",
        "sort_t1_multi_key": "SELECT task_id, valid_train_count FROM task_allocations ORDER BY valid_train_count DESC, task_id LIMIT 15",
        "sort_t2_top_k": "SELECT task_id, sum(source_train_count) AS n FROM clean_manifest GROUP BY task_id ORDER BY n DESC, task_id LIMIT 20",
        "sort_t4_closest": "SELECT task_id, middle, n, row_number() OVER (PARTITION BY middle ORDER BY abs(n - middle), task_id) AS place FROM (SELECT task_id, CASE WHEN valid_train_count <= 5000 THEN 2500 ELSE 20000 END AS middle, valid_train_count AS n FROM task_allocations) QUALIFY place <= 5",
        "sort_t5_fill": "SELECT p_partkey AS k, score FROM part LEFT JOIN (SELECT l_partkey, count(*) AS score FROM lineitem WHERE l_quantity >= 49 GROUP BY 1) ON p_partkey = l_partkey ORDER BY score DESC NULLS LAST, k LIMIT 50",
        "sort_t6_prefix": f"SELECT task_id, rank, mix_id FROM {ranked} JOIN {budgets} USING (task_id) WHERE rank <= budget",
        "sort_t8_hash_order": f"SELECT position, mix_id, task_id, rank, row_number() OVER (ORDER BY sha256('23|' || position), position) - 1 AS final_position FROM ({assembled})",
        "sort_t12_bins": "WITH RECURSIVE o AS (SELECT valid_train_count::DOUBLE AS c, row_number() OVER (ORDER BY valid_train_count DESC, task_id) AS k FROM task_allocations), r AS (SELECT 0::BIGINT AS k, [0.0, 0.0, 0.0, 0.0]::DOUBLE[] AS load, 0 AS b UNION ALL SELECT k + 1, list_transform(range(1, 5), lambda i: load[i] + CASE WHEN i = p THEN c ELSE 0 END), p FROM (SELECT r.k, r.load, o.c, list_position(r.load, list_min(r.load)) AS p FROM r JOIN o ON o.k = r.k + 1)) SELECT (b - 1)::INT AS bin, count(*) AS tasks FROM r WHERE k > 0 GROUP BY 1",
        "sort_t11_first_per_category": f"SELECT task_id, row_number() OVER (PARTITION BY task_id ORDER BY source_index, row_id) AS place, row_id FROM {src} QUALIFY place <= 2",
        "sort_t13_shards": "SELECT row_id // 2500 AS shard, count(*) AS n, min(row_id) AS first, max(row_id) AS last FROM raw_examples GROUP BY 1",
        "set_u1_union": "SELECT mix_id, 1 AS part FROM mixture WHERE split = 'test' UNION ALL SELECT mix_id, 2 FROM mixture WHERE split = 'validation'",
        "set_u3_difference": f"SELECT task_id FROM task_catalog EXCEPT ALL SELECT DISTINCT task_id FROM {train}",
        "set_u4_intersection": f"SELECT count(*) AS overlap FROM {ranked} r JOIN {train} t ON r.mix_id = t.mix_id JOIN {budgets} b ON b.task_id = r.task_id WHERE rank <= b.budget AND included_in_25000",
        "set_u5_prefix_equality": f"SELECT task_id, true AS nested FROM {ranked} JOIN {budgets} USING (task_id) WHERE rank <= budget GROUP BY task_id",
        "set_u6_multiset": "WITH v AS (SELECT corpus, task_id, lang FROM mixture WHERE split = 'validation'), t AS (SELECT corpus, task_id, lang FROM mixture WHERE split = 'test'), a AS (SELECT corpus, count(*) AS n FROM (SELECT * FROM v EXCEPT ALL SELECT * FROM t) GROUP BY corpus), b AS (SELECT corpus, count(*) AS n FROM (SELECT * FROM t EXCEPT ALL SELECT * FROM v) GROUP BY corpus) SELECT coalesce(a.corpus, b.corpus) AS corpus, a.n AS validation_only, b.n AS test_only FROM a FULL JOIN b ON a.corpus = b.corpus",
        "dom_d28_task_counts": f"SELECT task_id, count(*) AS n FROM ({assembled}) GROUP BY task_id",
        "dom_d30_permutation": f'WITH a AS ({assembled}) SELECT count(*) AS n, count(DISTINCT position) = count(*) AS "distinct", min(position) = 0 AS from_zero, max(position) = count(*) - 1 AS to_n FROM a',
        "dom_d29_validation": "SELECT row_number() OVER (ORDER BY corpus_position, task_index, mix_id) - 1 AS position, mix_id FROM mixture JOIN (SELECT task_id, corpus_position, task_index FROM task_catalog) USING (task_id) WHERE split = 'validation'",
        "dom_d34_leaderboard": f"SELECT model, 'full' AS mode, 25000 AS budget, round(a, 6) AS authors_exact_dense, round(c, 6) AS candidate_restricted, (a IS NOT NULL)::INT + (c IS NOT NULL)::INT AS present, CASE WHEN a IS NOT NULL AND c IS NOT NULL THEN 'complete' ELSE 'failed' END AS status FROM (SELECT corpus AS model, avg(marginal_gain) FILTER (WHERE stage2_method = 'authors_exact_dense') AS a, avg(marginal_gain) FILTER (WHERE stage2_method = 'candidate_restricted') AS c FROM {train} GROUP BY corpus)",
        "gate_o7_manifest": f"SELECT c.corpus, b.budget, CASE WHEN n > 0 THEN 'valid' ELSE 'missing' END AS state FROM (SELECT DISTINCT corpus FROM task_catalog) c, (VALUES (25000), (50000)) b(budget) LEFT JOIN (SELECT corpus, budget, count(*) AS n FROM {train} WHERE budget > 0 GROUP BY ALL) t ON t.corpus = c.corpus AND t.budget = b.budget",
    }
