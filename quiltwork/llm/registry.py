"""Queries of the training-text operators and the SQL of those that SQL can express."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quiltwork.functions.text import tidy_lang
from quiltwork.llm import copies, defects, ledger, mixing, overlap, residue, subset, tokenizer
from quiltwork.operators import lengths
from quiltwork.operators.manifest import valid_rows
from quiltwork.session import shared_dir
from quiltwork.sources.tables import table


def _ledger_docs(spark, d):
    domains = table(spark, d, "task_catalog").select("task_id", "domain")
    rows = table(spark, d, "mixture").select("mix_id", "prompt", "response", "corpus", tidy_lang(F.col("lang")).alias("lang"), "task_id", "included_in_25000", "split")
    return rows.join(domains, "task_id", "left")


def _ledger(docs):
    return ledger.TokenLedger.start(docs, "mix_id", ["prompt", "response"], ["corpus", "lang", "domain"])


def p3_token_totals(spark, d):
    return _ledger(_ledger_docs(spark, d)).cube


def p3_updated_totals(spark, d):
    """The totals of the whole table by way of three snapshots: without its test rows, then with them but without the validation
    rows (which are removed), then whole. Each is saved and loaded."""
    docs = _ledger_docs(spark, d)
    root = f"{shared_dir(spark).rstrip('/')}/ledger/{uuid.uuid4().hex}"
    _ledger(docs.filter("split <> 'test'")).save(root)
    ledger.TokenLedger.load(spark, root).update(docs.filter("split <> 'validation'")).save(root)
    return ledger.TokenLedger.load(spark, root).update(docs).cube


def p3_counts(spark, d):
    """The count table: a row for each different prompt or response, by hash of content and tokenizer."""
    return _ledger(_ledger_docs(spark, d)).counts.select("tokenizer", F.hex("content").alias("content"), "n_tokens")


def _mix(spark, d):
    return mixing.mix_sources(table(spark, d, "documents"), table(spark, d, "source_targets"))


def _copies(spark, d):
    return copies.find_copies(valid_rows(table(spark, d, "raw_examples")))


def p2_records(spark, d):
    """One record for each set of copies: its first row, and how many rows it stands for."""
    first = _copies(spark, d)[1].withColumnRenamed("first", "row_id")
    return table(spark, d, "raw_examples").select("row_id", "corpus", "task_id", "inputs", "targets").join(first, "row_id")


def p9_found(spark, d):
    docs = table(spark, d, "documents")
    return residue.find_residue(docs, residue.fit(docs)[0])


def p9_validation(spark, d):
    """One row: how the classifier does on hosts it has not seen, against the weak labels."""
    report = residue.fit(table(spark, d, "documents"))[1]
    return spark.createDataFrame([tuple(report.values())], "train_segments long, train_positive long, unseen_segments long, unseen_positive long, precision double, recall double")


def token_audit(spark, d, limit=128):
    """The length audit under byte_bpe_50k: prompt and prompt with response in tokens of the vocabulary, not in words."""
    text = F.concat(F.coalesce("prompt", F.lit("")), F.lit(" "), F.coalesce("response", F.lit("")))
    rows = table(spark, d, "mixture").select("mix_id", "split", F.col("prompt").alias("__p"), text.alias("__f"))
    sized = lengths.with_supervision(tokenizer.with_token_counts(rows, {"prompt_len": "__p", "full_len": "__f"}), limit)
    counts = lengths.threshold_counts(sized, ["split"], limit)
    return counts.join(lengths.retention(sized, ["split"]).select("split", F.col("mean").alias("kept_mean")), "split")


def _train(spark, d):
    return table(spark, d, "mixture").filter("split = 'train'").select("mix_id", "prompt", "task_id", "stage2_method")


def queries():
    return {
        "p2_found": lambda spark, d: _copies(spark, d)[0],
        "p2_records": p2_records,
        "p3_token_totals": p3_token_totals,
        "p3_updated_totals": p3_updated_totals,
        "p3_counts": p3_counts,
        "dom_d32_token_audit": token_audit,
        "p4_found": lambda spark, d: defects.find_defects(table(spark, d, "raw_examples")),
        "p5_subset": lambda spark, d: subset.choose_k(_train(spark, d), 1000),
        "p5_by_task": lambda spark, d: subset.choose_by_task(_train(spark, d), table(spark, d, "task_allocations")),
        "p5_spread": lambda spark, d: subset.spread_of(_train(spark, d), subset.choose_k(_train(spark, d), 1000)),
        "p6_found": lambda spark, d: overlap.overlaps(table(spark, d, "mixture")),
        "p6_report": lambda spark, d: overlap.overlap_report(table(spark, d, "mixture")),
        "p7_ids": lambda spark, d: tokenizer.encode(table(spark, d, "documents"), "doc_id", "text"),
        "p8_mix": lambda spark, d: _mix(spark, d)[0],
        "p8_shares": lambda spark, d: _mix(spark, d)[1],
        "p9_found": p9_found,
        "p9_validation": p9_validation,
    }


def oracle_sql():
    return {}
