"""Queries of the skewed per-key counts (problem 1) and their SQL."""

from __future__ import annotations

from quiltwork.operators import manifest
from quiltwork.sources.tables import table

_VALID = """
    SELECT DISTINCT task_id, source_file, source_index FROM raw_examples
    WHERE is_object AND split = 'train' AND inputs IS NOT NULL AND targets IS NOT NULL
      AND NOT regexp_full_match(inputs, '[\\s\\x0b\\x1c-\\x1f\\x85\\pZ]*') AND NOT regexp_full_match(targets, '[\\s\\x0b\\x1c-\\x1f\\x85\\pZ]*')"""


def queries():
    return {
        "p1_found": lambda spark, d: manifest.manifest_mismatches(table(spark, d, "raw_examples"), table(spark, d, "clean_manifest")),
        "p1_task_counts": lambda spark, d: manifest.task_counts(table(spark, d, "raw_examples")),
        "p1_file_counts": lambda spark, d: manifest.valid_train_counts(table(spark, d, "raw_examples")),
    }


def oracle_sql():
    return {
        "p1_found": f"""WITH v AS ({_VALID}), c AS (SELECT source_file, count(*) AS n FROM v GROUP BY source_file)
            SELECT DISTINCT coalesce(m.source_file, c.source_file) AS source_file FROM clean_manifest m
            FULL JOIN c ON m.source_file = c.source_file
            WHERE m.valid_train_count IS NULL OR m.valid_train_count <> coalesce(c.n, 0)""",
        "p1_task_counts": f"WITH v AS ({_VALID}) SELECT task_id, count(*) AS valid_train_count FROM v GROUP BY task_id",
        "p1_file_counts": f"WITH v AS ({_VALID}) SELECT task_id, source_file, count(*) AS valid_train_count FROM v GROUP BY ALL",
    }
