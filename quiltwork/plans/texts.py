"""Queries of templates and of the length audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from quiltwork.operators import lengths as ln
from quiltwork.operators import templates as tp
from quiltwork.sources.tables import table

LIMIT = 64


def _marked(spark, d):
    return tp.with_template(table(spark, d, "raw_examples").filter("is_object and inputs is not null"), "inputs")


def _sized(spark, d):
    return ln.with_lengths(table(spark, d, "mixture"), LIMIT)


def _union_zero(spark, d):
    """Rows without supervision under either of two tokenizers, as the union of their sets."""
    rows = table(spark, d, "mixture").filter("split <> 'train'")
    chars = lambda c: F.ceil(F.length(F.coalesce(c, F.lit(""))) / 6).cast("long")
    sets = [x.filter(ln.zero_supervision(x, LIMIT)).select("mix_id") for x in (ln.with_lengths(rows, LIMIT), ln.with_lengths(rows, LIMIT, chars))]
    return sets[0].union(sets[1]).distinct()


def _eval_safe(spark, d):
    return table(spark, d, "mixture").filter("split <> 'train'").select("mix_id", "split").join(_union_zero(spark, d), "mix_id", "left_anti")


def queries():
    return {
        "fn_c5_marker_counts": lambda spark, d: _marked(spark, d).select("row_id", *[f"{n}_count" for n in tp.COUNTED]),
        "fn_c9_template_type": lambda spark, d: _marked(spark, d).select("row_id", F.col("template_type"), "ambiguous"),
        "agg_a14_template_counts": lambda spark, d: tp.template_counts(_marked(spark, d), ["task_id", "split"]),
        "agg_a15_stability": lambda spark, d: tp.stability(tp.template_counts(_marked(spark, d).filter("split = 'train'"), ["task_id"])),
        "filter_f6_review": lambda spark, d: tp.stability(tp.template_counts(_marked(spark, d).filter("split = 'train'"), ["task_id"])).filter("n >= 10 and (dominant_fraction >= 0.95 or ambiguous_fraction >= 0.25)").select("task_id", "dominant", "dominant_fraction"),
        "win_w12_hash_sample": lambda spark, d: tp.hash_sample(_marked(spark, d), 3, F.col("row_id")).select("task_id", "split", "template_type", "ambiguous", "bucket_rank", "row_id"),
        "fn_c11_supervision": lambda spark, d: _sized(spark, d).select("mix_id", "prompt_len", "full_len", "retained", "masked", "supervised", "untruncated", "lost"),
        "agg_a10_length_summary": lambda spark, d: ln.length_summary(_sized(spark, d), ["split"], "full_len"),
        "agg_a11_thresholds": lambda spark, d: ln.threshold_counts(_sized(spark, d), ["split", "corpus"], LIMIT),
        "agg_a12_retention": lambda spark, d: ln.retention(_sized(spark, d), ["split"]),
        "agg_a23_token_probe": lambda spark, d: _sized(spark, d).groupBy("corpus").agg(F.min("prompt_len").alias("min"), F.round(F.avg("prompt_len"), 6).alias("mean"), F.max("prompt_len").alias("max"), F.count_if(F.col("prompt_len") > LIMIT).alias("over")),
        "filter_f7_zero_supervision": lambda spark, d: (x := _sized(spark, d)).filter(~ln.zero_supervision(x, LIMIT)).groupBy("split").agg(F.count("*").alias("kept")),
        "set_u2_zero_union": _union_zero,
        "dom_d33_eval_safe": _eval_safe,
        "sort_t3_longest": lambda spark, d: ln.longest(_sized(spark, d), 25).select("mix_id", "full_len"),
        "proj_p9_concat": lambda spark, d: table(spark, d, "mixture").select("mix_id", F.length(F.concat("prompt", F.lit(" "), "response")).alias("n")),
        "dom_d32_audit": lambda spark, d: ln.threshold_counts(_sized(spark, d), ["split"], LIMIT).join(ln.retention(_sized(spark, d), ["split"]).select("split", F.col("mean").alias("kept_mean")), "split"),
    }


def oracle_sql():
    n = {k: f"len(regexp_extract_all(t, '{p}'))" for k, p in tp.COUNTED.items()}
    counted = f"(SELECT *, {', '.join(f'{x} AS {k}_count' for k, x in n.items())} FROM (SELECT row_id, task_id, split, inputs AS t FROM raw_examples WHERE is_object AND inputs IS NOT NULL))"
    few = "(answer_count >= 2 OR example_count >= 2 OR answer_count >= 1 AND question_count >= 2 OR example_count >= 1 AND answer_count >= 1)"
    m = "greatest(lettered_count, inline_count)"
    opt = f"({m} >= 2 OR true_false_count >= 1 OR header_count >= 1 AND numbered_count >= 2 OR header_count >= 1 AND {m} >= 1)"
    marked = f"""(SELECT *, CASE WHEN {few} THEN 'fs' ELSE 'zs' END || CASE WHEN {opt} THEN '_opt' ELSE '_noopt' END AS template_type,
        (NOT {few} AND (regexp_matches(t, '{tp.WEAK_FEWSHOT}') OR example_count = 1 OR answer_count >= 1 AND question_count >= 1)) OR (NOT {opt} AND (regexp_matches(t, '{tp.WEAK_OPTION}') OR header_count >= 1 OR {m} = 1)) AS ambiguous FROM {counted})"""
    types = ", ".join(f"count_if(template_type = '{t}') AS {t}_count" for t in tp.TYPES)
    top = f"greatest({', '.join(f'{t}_count' for t in tp.TYPES)})"
    stab = f"""(SELECT task_id, n, CASE {' '.join(f"WHEN {t}_count = {top} THEN '{t}'" for t in tp.TYPES)} END AS dominant, {top} AS dominant_count, round({top} / n, 6) AS dominant_fraction,
        {' + '.join(f'({t}_count > 0)::INT' for t in tp.TYPES)} AS active_types, round(ambiguous_count / n, 6) AS ambiguous_fraction FROM (SELECT task_id, {types}, count_if(ambiguous) AS ambiguous_count, count(*) AS n FROM {marked} WHERE split = 'train' GROUP BY task_id))"""
    ws = lambda x: f"len(regexp_extract_all(coalesce({x}, ''), '[^\\s\\x0b]+'))"

    def sized(where="true", size=ws):
        joined = "coalesce(prompt, '') || ' ' || coalesce(response, '')"
        return f"""(SELECT *, greatest(untruncated - supervised, 0) AS lost FROM (SELECT *, retained - masked AS supervised, greatest(full_len - prompt_len, 0) AS untruncated FROM (SELECT *, least(prompt_len, {LIMIT}, retained) AS masked FROM
            (SELECT *, least(full_len, {LIMIT}) AS retained FROM (SELECT *, {size('prompt')} + 1 AS prompt_len, {size(f'({joined})')} + 1 AS full_len FROM mixture WHERE {where})))))"""

    zero = f"least(prompt_len, {LIMIT}) >= least(full_len, {LIMIT})"
    chars = lambda x: f"ceil(length(coalesce({x}, '')) / 6)::BIGINT"
    ev = "split <> 'train'"
    union = f"SELECT mix_id FROM {sized(ev)} WHERE {zero} UNION SELECT mix_id FROM {sized(ev, chars)} WHERE {zero}"
    q = ", ".join(f"round(quantile_cont(full_len, {x}), 6) AS {k}" for k, x in ln.PERCENTILES.items())
    th = f"count(*) AS n, count_if(full_len > {LIMIT}) AS truncated, count_if(retained = {LIMIT}) AS at_limit, count_if(lost > 0) AS losing, count_if(supervised = 0) AS zero, count_if(supervised < 8) AS under_8, count_if(supervised < 32) AS under_32, round(count_if(supervised = 0) / count(*), 6) AS zero_fraction"
    r = "CASE WHEN untruncated > 0 THEN supervised / untruncated END"
    return {
        "fn_c5_marker_counts": f"SELECT row_id, {', '.join(f'{k}_count' for k in n)} FROM {counted}",
        "fn_c9_template_type": f"SELECT row_id, template_type, ambiguous FROM {marked}",
        "agg_a14_template_counts": f"SELECT task_id, split, {types}, count_if(ambiguous) AS ambiguous_count, count(*) AS n FROM {marked} GROUP BY ALL",
        "agg_a15_stability": f"SELECT * FROM {stab}",
        "filter_f6_review": f"SELECT task_id, dominant, dominant_fraction FROM {stab} WHERE n >= 10 AND (dominant_fraction >= 0.95 OR ambiguous_fraction >= 0.25)",
        "win_w12_hash_sample": f"SELECT task_id, split, template_type, ambiguous, row_number() OVER (PARTITION BY task_id, split, template_type, ambiguous ORDER BY left(sha256('23|' || task_id || '|' || split || '|' || row_id || '|' || template_type || '|' || ambiguous::INT), 16), row_id) AS bucket_rank, row_id FROM {marked} QUALIFY bucket_rank <= 3",
        "fn_c11_supervision": f"SELECT mix_id, prompt_len, full_len, retained, masked, supervised, untruncated, lost FROM {sized()}",
        "agg_a10_length_summary": f"SELECT split, count(*) AS n, min(full_len) AS min, round(avg(full_len), 6) AS mean, {q}, max(full_len) AS max, sum(full_len) AS sum FROM {sized()} GROUP BY split",
        "agg_a11_thresholds": f"SELECT split, corpus, {th} FROM {sized()} GROUP BY ALL",
        "agg_a12_retention": f"SELECT split, round(avg({r}), 6) AS mean, round(quantile_cont({r}, 0.01), 6) AS p01, round(quantile_cont({r}, 0.05), 6) AS p05, round(quantile_cont({r}, 0.5), 6) AS p50, round(min({r}), 6) AS min FROM {sized()} GROUP BY split",
        "agg_a23_token_probe": f"SELECT corpus, min(prompt_len) AS min, round(avg(prompt_len), 6) AS mean, max(prompt_len) AS max, count_if(prompt_len > {LIMIT}) AS over FROM {sized()} GROUP BY corpus",
        "filter_f7_zero_supervision": f"SELECT split, count(*) AS kept FROM {sized()} WHERE NOT ({zero}) GROUP BY split",
        "set_u2_zero_union": union,
        "dom_d33_eval_safe": f"SELECT mix_id, split FROM mixture WHERE {ev} AND mix_id NOT IN ({union})",
        "sort_t3_longest": f"SELECT mix_id, full_len FROM {sized()} ORDER BY full_len DESC, mix_id DESC LIMIT 25",
        "proj_p9_concat": "SELECT mix_id, length(prompt || ' ' || response) AS n FROM mixture",
        "dom_d32_audit": f"SELECT split, {th}, round(avg({r}), 6) AS kept_mean FROM {sized()} GROUP BY split",
    }
