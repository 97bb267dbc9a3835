"""Queries of vectors, greedy orders and allocations on the embeddings table: label = task, vec_id = source index."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quiltwork.operators import allocate as al
from quiltwork.operators import greedy as gr
from quiltwork.operators import mixture as mx
from quiltwork.operators import vectors as vc
from quiltwork.sources.tables import table

PICKS = 10
CHECKPOINTS = (1, 5, 10)
CANDIDATES = 20
LAM = 0.4


def _emb(spark, d):
    return table(spark, d, "embeddings").withColumn("label", F.col("label").cast("int"))


def _means(spark, d):
    return vc.mean_vectors(_emb(spark, d), "label")


def _ranked(spark, d):
    """Graph-cut order of the labels with their sizes as capacities."""
    m = _means(spark, d)
    return gr.order_tasks(m, "label", lam=LAM).join(m.select("label", F.col("n").alias("capacity")), "label")


def allocations(spark, d, budget):
    out = al.allocate(_ranked(spark, d), budget)
    return out.select("rank", "label", "capacity", F.round("marginal_gain", 6).alias("marginal_gain"), F.round("weight", 6).alias("weight"), "floor", "remainder", "pre_cap", "overflow", "redistributed", "final")


def _selected(spark, d):
    e = _emb(spark, d)
    return gr.order_within(e, "label", "vec_id", PICKS)


def _with_candidates(spark, d):
    """Embeddings with a flag on the CANDIDATES rows of each label that a seeded hash puts first."""
    e = _emb(spark, d)
    chosen = mx.hash_probe(e.select("label", "vec_id"), "label", ["label", "vec_id"], CANDIDATES).select("vec_id", F.lit(True).alias("__hit"))
    return e.join(chosen, "vec_id", "left").withColumn("candidate", F.coalesce("__hit", F.lit(False))).drop("__hit")


def _restricted(spark, d):
    return gr.order_within(_with_candidates(spark, d), "label", "vec_id", PICKS, flag="candidate")


def _coverage(spark, d, floor=True):
    chosen = _selected(spark, d).select("label", "vec_id").join(_emb(spark, d), ["label", "vec_id"])
    return vc.coverage(_emb(spark, d), chosen, "label", "vec_id", floor=floor)


def _replay(spark, d):
    """Every gain recomputed from pairs and a running maximum, apart from the greedy code."""
    e = _emb(spark, d).select("label", "vec_id", vc.normalised(F.col("embedding")).alias("u"))
    chosen = _selected(spark, d).select("label", "rank", "vec_id", "gain")
    picked = chosen.join(e, ["label", "vec_id"]).select("label", "rank", "gain", F.col("u").alias("v"))
    sims = e.join(picked, "label").select("label", "rank", "gain", "vec_id", vc.dot(F.col("u"), F.col("v")).alias("s"))
    w = Window.partitionBy("label", "vec_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    step = F.greatest(F.greatest("s", F.lit(0.0)) - F.coalesce(F.greatest(F.max("s").over(w), F.lit(0.0)), F.lit(0.0)), F.lit(0.0))
    out = sims.withColumn("step", step).groupBy("label", "rank").agg(F.max("gain").alias("gain"), F.sum("step").alias("replayed"))
    return out.select("label", "rank", F.round("replayed", 6).alias("replayed"), vc.is_close(F.col("gain"), F.col("replayed"), 1e-8, 1e-10).alias("agrees"))


def _candidates_compared(spark, d):
    e = _emb(spark, d)
    exact = gr.order_within(e, "label", "vec_id", PICKS)
    some = _restricted(spark, d)
    every = lambda x, name: x.groupBy("label").agg(F.max("objective").alias(name))
    overlap = exact.select("label", "vec_id").join(some.select("label", "vec_id"), ["label", "vec_id"]).groupBy("label").agg(F.count("*").alias("overlap"))
    both = every(exact, "exact").join(every(some, "restricted"), "label").join(overlap, "label", "left")
    return both.select("label", F.round(F.col("restricted") / F.col("exact"), 6).alias("ratio"), F.round(F.col("exact") - F.col("restricted"), 6).alias("regret"), F.coalesce("overlap", F.lit(0)).alias("overlap"))


def _divergence(spark, d):
    """First rank at which the whole-pool and the candidate order of a label differ, and what kind of difference it is;
    up to there both have the same prefix, so their recorded gains are gains over it."""
    e = _emb(spark, d)
    a = gr.order_within(e, "label", "vec_id", PICKS).select("label", "rank", F.col("vec_id").alias("a"), F.col("gain").alias("ga"))
    b = _restricted(spark, d).select("label", "rank", F.col("vec_id").alias("b"), F.col("gain").alias("gb"))
    first = a.join(b, ["label", "rank"]).filter("a <> b").groupBy("label").agg(F.min_by(F.struct("rank", "ga", "gb"), "rank").alias("x"))
    gap = F.abs(F.col("x.ga") - F.col("x.gb"))
    kind = F.when(F.col("x").isNull(), "index_match").when(gap == 0, "exact_tie").when(gap <= 1e-10 + 1e-10 * F.greatest(F.lit(1.0), F.abs("x.ga")), "numerical_tie").otherwise("true_mismatch")
    return e.select("label").distinct().join(first, "label", "left").select("label", F.col("x.rank").alias("first_rank"), kind.alias("kind"), F.round(F.col("x.ga") - F.col("x.gb"), 6).alias("gap"))


def _checkpoints(spark, d):
    """Objective, mean and least coverage after 1, 5 and 10 picks, recomputed from pairs, against the recorded objective."""
    e = _emb(spark, d).select("label", "vec_id", vc.normalised(F.col("embedding")).alias("u"))
    chosen = _selected(spark, d).select("label", "rank", "vec_id", "objective")
    picked = chosen.join(e, ["label", "vec_id"]).select("label", "rank", "objective", F.col("u").alias("v"))
    w = Window.partitionBy("label", "vec_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    run = e.join(picked, "label").select("label", "rank", "objective", "vec_id", vc.dot(F.col("u"), F.col("v")).alias("s")).withColumn("best", F.greatest(F.max("s").over(w), F.lit(0.0)))
    out = run.filter(F.col("rank").isin(*CHECKPOINTS)).groupBy("label", "rank").agg(F.max("objective").alias("recorded"), F.sum("best").alias("total"), F.avg("best").alias("mean"), F.min("best").alias("least"))
    return out.select("label", "rank", F.round("total", 6).alias("objective"), F.round("mean", 6).alias("mean"), F.round("least", 6).alias("least"), vc.is_close_symmetric(F.col("recorded"), F.col("total"), 0.0, 1e-7).alias("agrees"))


def _ordering_checks(spark, d):
    """Length, ranks, uniqueness and finite gains of each label's ordering."""
    o = _selected(spark, d)
    return o.groupBy("label").agg((F.count("*") == PICKS).alias("length"), ((F.min("rank") == 1) & (F.max("rank") == F.count("*"))).alias("ranks"), (F.countDistinct("vec_id") == F.count("*")).alias("unique"), F.bool_and(~F.isnan("gain") & (F.abs("gain") < float("inf"))).alias("finite"))


def _template_budgets(spark, d):
    from quiltwork.operators import templates as tp

    counts = tp.template_counts(tp.with_template(table(spark, d, "raw_examples").filter("is_object and inputs is not null and split = 'train'"), "inputs"), ["task_id"])
    budgets = table(spark, d, "task_allocations").select("task_id", F.col("final_allocation_25000").alias("budget"))
    return al.template_split(counts.join(budgets, "task_id")).select("task_id", "budget", *[f"{t}_budget" for t in tp.TYPES])


def _twin_order(spark, d):
    """Every vector twice, under its own key and under key + 1,000,000: of two that tie the smaller key is taken."""
    e = _emb(spark, d).select("label", "vec_id", "embedding")
    both = e.unionByName(e.withColumn("vec_id", F.col("vec_id") + 1_000_000))
    return gr.order_within(both, "label", "vec_id", 1).select("label", "vec_id", (F.col("ties") >= 2).alias("tied"))


def _cosines(spark, d):
    """Cosine of each vector to the mean of its label."""
    return _emb(spark, d).join(_means(spark, d).select("label", "mean"), "label").select("vec_id", F.round(vc.cosine(F.col("embedding"), F.col("mean")), 6).alias("cosine"))


def queries():
    return {
        "dom_d15_fallback": lambda spark, d: gr.order_within(_emb(spark, d), "label", "vec_id", 1).select("label", "vec_id", F.round("gain", 6).alias("gain")),
        "dom_d19_divergence": _divergence,
        "dom_d20_checkpoints": _checkpoints,
        "dom_d24_template_split": _template_budgets,
        "dom_d26_engine": lambda spark, d: table(spark, d, "task_allocations").select("task_id", F.when(F.col("valid_train_count") <= 5000, "exact_dense").when(F.col("valid_train_count") * 1024 * 4 <= 2 * 2**30, "matrix_free").otherwise("distributed").alias("engine")),
        "sort_t7_candidates": lambda spark, d: _with_candidates(spark, d).filter("candidate").select("label", "vec_id"),
        "dom_d8_dense": lambda spark, d: gr.order_within(_emb(spark, d), "label", "vec_id", PICKS, dense=True).select("label", "rank", "vec_id", F.round("gain", 6).alias("gain"), F.round("objective", 6).alias("objective")),
        "dom_d10_one_pool": lambda spark, d: gr.order_pool(_emb(spark, d), "vec_id", PICKS).select("rank", "vec_id", F.round("gain", 6).alias("gain"), F.round("objective", 6).alias("objective")),
        "dom_d11_ties": lambda spark, d: _twin_order(spark, d),
        "dom_d5_full_budget": lambda spark, d: gr.order_tasks(_means(spark, d), "label", budget=None, lam=LAM).agg(F.count("*").alias("n"), F.countDistinct("label").alias("labels"), F.max("rank").alias("last"), F.round(F.sum("marginal_gain"), 4).alias("total")),
        "agg_a8_vector_sums": lambda spark, d: vc.vector_sums(_emb(spark, d), "label").select("label", "n", F.posexplode("total").alias("p", "x")).select("label", "n", (F.col("p") + 1).alias("p"), F.round("x", 6).alias("total")),
        "fn_c13_cosine": lambda spark, d: _cosines(spark, d),
        "dom_d27_ordering_checks": _ordering_checks,
        "join_j6_similar_pairs": lambda spark, d: (u := _emb(spark, d).select("label", "vec_id", vc.normalised(F.col("embedding")).alias("u"))).select("label", F.col("vec_id").alias("i"), F.col("u").alias("a")).join(u.select("label", F.col("vec_id").alias("j"), F.col("u").alias("b")), "label").filter("i < j").select("i", "j", vc.dot(F.col("a"), F.col("b")).alias("s")).filter("s >= 0.3").select("i", "j", F.round("s", 6).alias("s")),
        "join_j7_rectangular": lambda spark, d: (u := _emb(spark, d).select("label", "vec_id", vc.normalised(F.col("embedding")).alias("u"))).join(u.filter("vec_id % 50 = 0").select("label", F.col("vec_id").alias("j"), F.col("u").alias("v")), "label").groupBy("vec_id").agg(F.round(F.max(vc.dot(F.col("u"), F.col("v"))), 6).alias("best"), F.count("*").alias("n")),
        "fn_c12_normalise": lambda spark, d: _emb(spark, d).select("vec_id", F.round(vc.norm(vc.normalised(F.transform("embedding", lambda x: x * 3))), 6).alias("norm"), vc.all_finite(F.col("embedding")).alias("finite")),
        "fn_c14_close": lambda spark, d: table(spark, d, "task_allocations").select("task_id", vc.is_close(F.col("raw_allocation_25000"), F.col("normalized_weight") * 25000, 1e-8, 1e-10).alias("numpy"), vc.is_close_symmetric(F.col("raw_allocation_25000"), F.col("final_allocation_25000").cast("double"), 0.5, 1e-3).alias("math")),
        "fn_c17_json_access": lambda spark, d: table(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").alias("k")).groupBy("event_type").agg(F.count("k").alias("present"), F.countDistinct("k").alias("kinds")),
        "entry_allocation": lambda spark, d: allocations(spark, d, 50),
        "agg_a7_mean_vectors": lambda spark, d: vc.mean_vectors(_emb(spark, d), "label", digits=6).select("label", "n", F.explode("mean").alias("m")).groupBy("label", "n").agg(F.round(F.sum("m"), 4).alias("total"), F.count("*").alias("dims")),
        "agg_a9_norms": lambda spark, d: vc.norm_statistics(_emb(spark, d), "label"),
        "dom_d3_kernel": lambda spark, d: vc.kernel(_means(spark, d), "label").select("i", "j", F.round("s", 6).alias("s")),
        "dom_d3_kernel_checks": lambda spark, d: (k := vc.kernel(_means(spark, d), "label")).alias("a").join(k.alias("b"), (F.col("a.i") == F.col("b.j")) & (F.col("a.j") == F.col("b.i"))).agg(F.round(F.max(F.abs(F.col("a.s") - F.col("b.s"))), 6).alias("asymmetry"), F.round(F.max(F.when(F.col("a.i") == F.col("a.j"), F.abs(F.col("a.s") - 1))), 6).alias("diagonal")),
        "dom_d4_graph_cut": lambda spark, d: gr.order_tasks(_means(spark, d), "label", lam=LAM).select("rank", "label", F.round("marginal_gain", 6).alias("gain"), F.round("cumulative_gain", 6).alias("cumulative")),
        "dom_d7_facility_location": lambda spark, d: _selected(spark, d).select("label", "rank", "vec_id", F.round("gain", 6).alias("gain"), F.round("objective", 6).alias("objective")),
        "dom_d9_candidates": lambda spark, d: _restricted(spark, d).select("label", "rank", "vec_id", F.round("gain", 6).alias("gain")),
        "dom_d12_certificate": lambda spark, d: _selected(spark, d).select("label", "rank", (F.col("next_bound") <= F.col("gain") + 2e-9).alias("certified")),
        "dom_d13_singletons": lambda spark, d: (u := _emb(spark, d).select("label", "vec_id", vc.normalised(F.col("embedding")).alias("u"))).join(vc.vector_sums(u, "label", "u").select("label", "total"), "label").select("vec_id", F.round(vc.dot(F.col("u"), F.col("total")), 6).alias("gain")),
        "dom_d14_positivity": lambda spark, d: vc.positivity(_emb(spark, d), "label"),
        "dom_d16_replay": _replay,
        "dom_d17_coverage": lambda spark, d: _coverage(spark, d).groupBy("label").agg(F.round(F.sum("best"), 6).alias("objective"), F.round(F.avg("best"), 6).alias("mean"), F.round(F.min("best"), 6).alias("least")),
        "agg_a13_coverage_statistics": lambda spark, d: _coverage(spark, d, False).groupBy("label").agg(F.round(F.sum("best"), 6).alias("sum"), F.round(F.avg("best"), 6).alias("mean"), F.round(F.min("best"), 6).alias("min"), F.round(F.percentile("best", 0.05), 6).alias("p05"), F.round(F.percentile("best", 0.5), 6).alias("p50"), F.round(F.max("best"), 6).alias("max")),
        "dom_d18_candidates_compared": _candidates_compared,
        "dom_d21_taylor": lambda spark, d: al.taylor_weights(table(spark, d, "task_allocations").select(F.col("graph_cut_rank").alias("rank"), "task_id", "marginal_gain"), 250.0).select("task_id", F.round("scaled_gain", 6).alias("scaled_gain"), F.round("taylor_score", 6).alias("taylor_score"), F.round("weight", 9).alias("weight")),
        "dom_d22_floor_remainder": lambda spark, d: al.floor_remainder(table(spark, d, "task_allocations").select(F.col("graph_cut_rank").alias("rank"), "task_id", F.col("normalized_weight").alias("weight")), 25000).select("task_id", "floor", "remainder", "pre_cap"),
        "dom_d23_redistribution": lambda spark, d: al.cap_redistribute(table(spark, d, "task_allocations").select(F.col("graph_cut_rank").alias("rank"), "task_id", F.col("pre_cap_allocation_50000").alias("pre_cap"), F.col("valid_train_count").alias("capacity"))).select("task_id", "overflow", "redistributed", "final"),
        "dom_d25_required_prefix": lambda spark, d: table(spark, d, "task_allocations").select("task_id", al.required_prefix(None, ["final_allocation_25000", "final_allocation_50000"]).alias("prefix")),
        "win_w8_budget_monotone": lambda spark, d: al.monotone(table(spark, d, "task_allocations").select("task_id", F.expr("stack(2, 25000, final_allocation_25000, 50000, final_allocation_50000) as (budget, final)"))).select("task_id", "budget", "final", "before"),
    }


def _template_sql():
    from quiltwork.plans import texts

    counts = texts.oracle_sql()["agg_a14_template_counts"]
    n = {t: f"{t}_count" for t in ("zs_opt", "zs_noopt", "fs_opt", "fs_noopt")}
    half = lambda budget, a, b: f"CASE WHEN {a} + {b} = 0 THEN 0 ELSE {budget} * ({a}) // ({a} + {b}) + least(1, {budget} - {budget} * ({a}) // ({a} + {b}) - {budget} * ({b}) // ({a} + {b})) END"
    zero = f"CASE WHEN {n['fs_opt']} + {n['fs_noopt']} = 0 THEN budget ELSE {half('budget', n['zs_opt'] + ' + ' + n['zs_noopt'], n['fs_opt'] + ' + ' + n['fs_noopt'])} END"
    side = lambda x, share: f"CASE WHEN {x}_noopt_count = 0 THEN {share} WHEN {x}_opt_count = 0 THEN 0 ELSE {half(share, f'{x}_opt_count', f'{x}_noopt_count')} END"
    return f"""WITH c AS (SELECT * FROM ({counts}) WHERE split = 'train'), z AS (SELECT c.*, budget, {zero} AS zero FROM c JOIN (SELECT task_id, final_allocation_25000 AS budget FROM task_allocations) USING (task_id)),
        s AS (SELECT *, budget - zero AS few FROM z), o AS (SELECT task_id, budget, zero, few, {side('zs', 'zero')} AS a, {side('fs', 'few')} AS b FROM s)
        SELECT task_id, budget, a::BIGINT AS zs_opt_budget, (zero - a)::BIGINT AS zs_noopt_budget, b::BIGINT AS fs_opt_budget, (few - b)::BIGINT AS fs_noopt_budget FROM o"""


def oracle_sql():
    emb = "(SELECT label::INT AS label, vec_id, embedding FROM embeddings)"
    parts = f"(SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS p FROM {emb})"
    unit = f"(SELECT label, vec_id, list(x / n ORDER BY p) AS u FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS n FROM {parts}) GROUP BY ALL)"
    mean = f"(SELECT label, list(m ORDER BY p) AS m, max(n) AS n FROM (SELECT label, p, avg(x) AS m, count(*) AS n FROM {parts} GROUP BY ALL) GROUP BY label)"
    kern = f"(SELECT a.label AS i, b.label AS j, list_cosine_similarity(a.m, b.m) AS s FROM {mean} a, {mean} b)"
    sims = f"(SELECT a.label, a.vec_id AS i, b.vec_id AS j, list_dot_product(a.u, b.u) AS s FROM {unit} a JOIN {unit} b ON a.label = b.label)"
    cut = f"""k AS MATERIALIZED {kern}, r AS (SELECT j, sum(s) AS total FROM k GROUP BY j), d AS (SELECT i AS j, s FROM k WHERE i = j),
      g AS (SELECT 0 AS rank, []::INT[] AS chosen, NULL::INT AS label, 0.0::DOUBLE AS gain UNION ALL
        SELECT rank + 1, list_append(chosen, j), j, gain FROM (SELECT g.rank, g.chosen, r.j, r.total - {LAM} * d.s - 2 * {LAM} * coalesce((SELECT sum(k.s) FROM k WHERE k.j = r.j AND list_contains(g.chosen, k.i)), 0) AS gain
          FROM g, r JOIN d ON r.j = d.j WHERE NOT list_contains(g.chosen, r.j)) QUALIFY row_number() OVER (ORDER BY round(gain, 9) DESC, j) = 1)"""
    w = "1 + gain + gain * gain / 2"
    alloc = f"""WITH RECURSIVE {cut}, c AS (SELECT g.rank, g.label, m.n AS capacity, gain FROM g JOIN {mean} m ON g.label = m.label WHERE rank > 0),
      f AS (SELECT *, floor(weight * 50)::BIGINT AS floor FROM (SELECT *, ({w}) / sum({w}) OVER () AS weight FROM c)), p AS (SELECT *, (rank <= 50 - sum(floor) OVER ())::BIGINT AS remainder FROM f), q AS (SELECT *, floor + remainder AS pre_cap FROM p),
      o AS (SELECT *, greatest(pre_cap - capacity, 0) AS overflow, greatest(capacity - pre_cap, 0) AS free FROM q),
      s AS (SELECT rank, count(*) AS got FROM (SELECT rank, row_number() OVER (ORDER BY slot, rank) AS k FROM (SELECT rank, unnest(range(free)) AS slot FROM o)) WHERE k <= (SELECT sum(overflow) FROM o) GROUP BY rank)
      SELECT o.rank, label, capacity, round(gain, 6) AS marginal_gain, round(weight, 6) AS weight, floor, remainder, pre_cap, overflow, coalesce(got, 0) AS redistributed, least(pre_cap, capacity) + coalesce(got, 0) AS final FROM o LEFT JOIN s ON o.rank = s.rank"""
    fl = f"""WITH RECURSIVE s AS MATERIALIZED {sims}, labels AS (SELECT DISTINCT label FROM s),
      f AS (SELECT label, 0 AS rank, []::BIGINT[] AS chosen, NULL::BIGINT AS vec_id, 0.0::DOUBLE AS gain, 0.0::DOUBLE AS objective FROM labels UNION ALL
        SELECT label, rank + 1, list_append(chosen, j), j, gain, objective + gain FROM (
          SELECT f.label, f.rank, f.chosen, f.objective, s.j, sum(greatest(greatest(s.s, 0) - coalesce(c.cov, 0), 0)) AS gain FROM f JOIN s ON f.label = s.label AND NOT list_contains(f.chosen, s.j)
          LEFT JOIN (SELECT f2.label, s2.i, max(greatest(s2.s, 0)) AS cov FROM f f2 JOIN s s2 ON f2.label = s2.label AND list_contains(f2.chosen, s2.j) GROUP BY ALL) c ON c.label = s.label AND c.i = s.i
          WHERE f.rank < {PICKS} GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY label ORDER BY round(gain, 9) DESC, j) = 1)"""
    cand = f"(SELECT vec_id FROM (SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY sha256('23|' || label || '|' || vec_id), label, vec_id) AS k FROM {emb}) WHERE k <= {CANDIDATES})"
    few = fl.replace("labels AS (SELECT", f"cands AS MATERIALIZED {cand}, labels AS (SELECT").replace("NOT list_contains(f.chosen, s.j)\n", "NOT list_contains(f.chosen, s.j) AND s.j IN (SELECT vec_id FROM cands)\n")
    inner = few[few.index("      f AS (") :].strip()
    two = f"{fl}, cands AS MATERIALIZED {cand}, {inner.replace('f AS (SELECT label, 0', 'g AS (SELECT label, 0', 1).replace('FROM f JOIN s ON f.label', 'FROM g f JOIN s ON f.label', 1).replace('FROM f f2', 'FROM g f2', 1)}"
    pool = fl.replace(sims, f"(SELECT 0 AS label, a.vec_id AS i, b.vec_id AS j, list_dot_product(a.u, b.u) AS s FROM {unit} a, {unit} b)")
    best = "(SELECT s.label, s.i, max(s.s) AS best FROM s JOIN f ON f.label = s.label AND f.rank > 0 AND f.vec_id = s.j GROUP BY ALL)"
    return {
        "entry_allocation": alloc,
        "agg_a7_mean_vectors": f"SELECT label, n, round(sum(round(m, 6)), 4) AS total, count(*) AS dims FROM (SELECT label, p, avg(x) AS m, count(*) AS n FROM {parts} GROUP BY ALL) GROUP BY label, n",
        "agg_a9_norms": f"SELECT label, count(*) AS n, round(min(z), 6) AS min_norm, round(avg(z), 6) AS mean_norm, round(max(z), 6) AS max_norm, count_if(z = 0) AS zero, count_if(NOT isfinite(z)) AS not_finite FROM (SELECT label, vec_id, sqrt(sum(x * x)) AS z FROM {parts} GROUP BY ALL) GROUP BY label",
        "dom_d3_kernel": f"SELECT i, j, round(s, 6) AS s FROM {kern}",
        "dom_d3_kernel_checks": f"WITH k AS {kern} SELECT round(max(abs(a.s - b.s)), 6) AS asymmetry, round(max(CASE WHEN a.i = a.j THEN abs(a.s - 1) END), 6) AS diagonal FROM k a JOIN k b ON a.i = b.j AND a.j = b.i",
        "dom_d4_graph_cut": f"WITH RECURSIVE {cut} SELECT rank, label, round(gain, 6) AS gain, round(sum(gain) OVER (ORDER BY rank), 6) AS cumulative FROM g WHERE rank > 0",
        "dom_d7_facility_location": f"{fl} SELECT label, rank, vec_id, round(gain, 6) AS gain, round(objective, 6) AS objective FROM f WHERE rank > 0",
        "sort_t7_candidates": f"SELECT label, vec_id FROM {emb} WHERE vec_id IN {cand}",
        "dom_d8_dense": f"{fl} SELECT label, rank, vec_id, round(gain, 6) AS gain, round(objective, 6) AS objective FROM f WHERE rank > 0",
        "dom_d10_one_pool": f"{pool} SELECT rank, vec_id, round(gain, 6) AS gain, round(objective, 6) AS objective FROM f WHERE rank > 0",
        "dom_d11_ties": f"SELECT label, vec_id, true AS tied FROM (SELECT label, j AS vec_id, sum(greatest(s, 0)) AS gain FROM {sims} GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY label ORDER BY round(gain, 9) DESC, vec_id) = 1",
        "dom_d5_full_budget": f"WITH RECURSIVE {cut} SELECT count(*) AS n, count(DISTINCT label) AS labels, max(rank) AS last, round(sum(gain), 4) AS total FROM g WHERE rank > 0",
        "agg_a8_vector_sums": f"SELECT label, count(*) AS n, p, round(sum(x), 6) AS total FROM {parts} GROUP BY label, p",
        "fn_c13_cosine": f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], m), 6) AS cosine FROM {emb} e JOIN {mean} m ON e.label = m.label",
        "dom_d9_candidates": f"{few} SELECT label, rank, vec_id, round(gain, 6) AS gain FROM f WHERE rank > 0",
        "dom_d18_candidates_compared": f"{two} SELECT e.label, round(b / a, 6) AS ratio, round(a - b, 6) AS regret, coalesce(o, 0) AS overlap FROM (SELECT label, max(objective) AS a FROM f GROUP BY label) e JOIN (SELECT label, max(objective) AS b FROM g GROUP BY label) r ON e.label = r.label LEFT JOIN (SELECT f.label, count(*) AS o FROM f JOIN g ON f.label = g.label AND f.vec_id = g.vec_id WHERE f.rank > 0 AND g.rank > 0 GROUP BY f.label) x ON x.label = e.label",
        "dom_d19_divergence": f"{two} SELECT l.label, x.rank AS first_rank, CASE WHEN x.rank IS NULL THEN 'index_match' WHEN abs(ga - gb) <= 1e-9 THEN 'numerical_tie' ELSE 'true_mismatch' END AS kind, round(ga - gb, 6) AS gap FROM labels l LEFT JOIN (SELECT f.label, f.rank, f.gain AS ga, g.gain AS gb FROM f JOIN g ON f.label = g.label AND f.rank = g.rank AND f.vec_id <> g.vec_id WHERE f.rank > 0 QUALIFY row_number() OVER (PARTITION BY f.label ORDER BY f.rank) = 1) x ON x.label = l.label",
        "dom_d24_template_split": _template_sql(),
        "dom_d15_fallback": f"{fl} SELECT label, vec_id, round(gain, 6) AS gain FROM f WHERE rank = 1",
        "dom_d20_checkpoints": f"{fl} SELECT label, rank, round(sum(b), 6) AS objective, round(avg(b), 6) AS mean, round(min(b), 6) AS least, abs(max(o) - sum(b)) <= 1e-7 * greatest(abs(max(o)), abs(sum(b))) AS agrees FROM (SELECT f.label, f.rank, max(f.objective) AS o, s.i, greatest(max(s.s), 0) AS b FROM f JOIN s ON f.label = s.label AND list_contains(f.chosen, s.j) WHERE f.rank IN {CHECKPOINTS} GROUP BY ALL) GROUP BY label, rank",
        "dom_d26_engine": "SELECT task_id, CASE WHEN valid_train_count <= 5000 THEN 'exact_dense' WHEN valid_train_count * 1024 * 4 <= 2147483648 THEN 'matrix_free' ELSE 'distributed' END AS engine FROM task_allocations",
        "dom_d27_ordering_checks": f'{fl} SELECT label, count(*) = {PICKS} AS length, min(rank) = 1 AND max(rank) = count(*) AS ranks, count(DISTINCT vec_id) = count(*) AS "unique", bool_and(isfinite(gain)) AS finite FROM f WHERE rank > 0 GROUP BY label',
        "join_j6_similar_pairs": f"SELECT i, j, round(s, 6) AS s FROM {sims} WHERE i < j AND s >= 0.3",
        "join_j7_rectangular": f"SELECT i AS vec_id, round(max(s), 6) AS best, count(*) AS n FROM {sims} WHERE j % 50 = 0 GROUP BY i",
        "fn_c12_normalise": f"SELECT vec_id, round(sqrt(list_dot_product(u, u)), 6) AS norm, len(list_filter(u, lambda x: NOT isfinite(x))) = 0 AS finite FROM {unit}",
        "fn_c14_close": "SELECT task_id, abs(raw_allocation_25000 - normalized_weight * 25000) <= 1e-8 + 1e-10 * abs(normalized_weight * 25000) AS numpy, abs(raw_allocation_25000 - final_allocation_25000) <= greatest(1e-3 * greatest(abs(raw_allocation_25000), abs(final_allocation_25000)), 0.5) AS math FROM task_allocations",
        "fn_c17_json_access": "SELECT event_type, count(k) AS present, count(DISTINCT k) AS kinds FROM (SELECT event_type, json_extract_string(props, '$.k') AS k FROM events) GROUP BY event_type",
        "dom_d12_certificate": f"{fl} SELECT label, rank, true AS certified FROM f WHERE rank > 0",
        "dom_d13_singletons": f"SELECT j AS vec_id, round(sum(s), 6) AS gain FROM {sims} GROUP BY j",
        "dom_d14_positivity": f"WITH u AS MATERIALIZED {unit}, c AS (SELECT label, list(m ORDER BY p) AS c FROM (SELECT label, p, avg(x) AS m FROM (SELECT label, unnest(u) AS x, generate_subscripts(u, 1) AS p FROM u) GROUP BY ALL) GROUP BY label), m AS (SELECT u.label, min(list_cosine_similarity(u.u, c.c)) AS m FROM u JOIN c ON u.label = c.label GROUP BY u.label) SELECT label, round(m, 6) AS least_cosine, round(CASE WHEN m > 0 THEN 2 * m * m - 1 ELSE -1.0 END, 6) AS bound, (m > 0 AND 2 * m * m - 1 > 1e-6) AS certified FROM m",
        "dom_d16_replay": f"{fl} SELECT label, rank, round(gain, 6) AS replayed, true AS agrees FROM f WHERE rank > 0",
        "dom_d17_coverage": f"{fl} SELECT label, round(sum(greatest(best, 0)), 6) AS objective, round(avg(greatest(best, 0)), 6) AS mean, round(min(greatest(best, 0)), 6) AS least FROM {best} GROUP BY label",
        "agg_a13_coverage_statistics": f"{fl} SELECT label, round(sum(best), 6) AS sum, round(avg(best), 6) AS mean, round(min(best), 6) AS min, round(quantile_cont(best, 0.05), 6) AS p05, round(quantile_cont(best, 0.5), 6) AS p50, round(max(best), 6) AS max FROM {best} GROUP BY label",
        "dom_d21_taylor": "SELECT task_id, round(x, 6) AS scaled_gain, round(1 + x + x * x / 2, 6) AS taylor_score, round((1 + x + x * x / 2) / sum(1 + x + x * x / 2) OVER (), 9) AS weight FROM (SELECT task_id, marginal_gain / 250.0 AS x FROM task_allocations)",
        "dom_d22_floor_remainder": "SELECT task_id, f AS floor, r AS remainder, f + r AS pre_cap FROM (SELECT *, (row_number() OVER (ORDER BY graph_cut_rank) <= 25000 - sum(f) OVER ())::BIGINT AS r FROM (SELECT *, floor(normalized_weight * 25000)::BIGINT AS f FROM task_allocations))",
        "dom_d23_redistribution": "SELECT task_id, overflow_50000 AS overflow, redistribution_addition_50000 AS redistributed, final_allocation_50000 AS final FROM task_allocations",
        "dom_d25_required_prefix": "SELECT task_id, greatest(final_allocation_25000, final_allocation_50000) AS prefix FROM task_allocations",
        "win_w8_budget_monotone": "SELECT task_id, 50000 AS budget, final_allocation_50000 AS final, final_allocation_25000 AS before FROM task_allocations WHERE final_allocation_50000 < final_allocation_25000",
    }
