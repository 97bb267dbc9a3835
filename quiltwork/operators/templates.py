"""Prompt templates: marker counts, few-shot and option evidence, template type, stability and review samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiltwork.functions.text import hash_score_hex

# The four template types in their order, and the patterns of the markers.
TYPES = ("zs_opt", "zs_noopt", "fs_opt", "fs_noopt")
COUNTED = {
    "question": r"(?im)^\s*(?:Q(?:uestion)?|Input|Problem|Prompt)\s*[:\-]",
    "answer": r"(?im)^\s*(?:A(?:nswer)?|Output|Response|Label)\s*[:\-]\s*\S",
    "example": r"(?im)^\s*(?:example|demonstration|demo)\s*(?:\d+)?\s*[:\-]",
    "lettered": r"(?im)^\s*(?:\(([A-H])\)|([A-H])[.)])\s+\S",
    "inline": r"(?i)(?:^|\s)(?:\([A-H]\)|[A-H][.)])\s+\S",
    "numbered": r"(?m)^\s*\d{1,2}[.)]\s+\S",
    "header": r"(?im)^\s*(?:answer\s+choices?|choices?|options?|possible\s+answers?)\s*[:\-]",
    "true_false": r"(?i)\b(?:true\s*(?:/|or)\s*false|false\s*(?:/|or)\s*true)\b",
}
WEAK_OPTION = r"(?i)\b(?:choose\s+(?:one|the\s+best|from)|select\s+(?:one|the\s+best)|which\s+of\s+the\s+following|multiple[\s-]?choice|answer\s+choice)\b"
WEAK_FEWSHOT = r"(?i)\b(?:few[\s-]?shot|worked\s+example|here\s+are\s+some\s+examples|following\s+examples|use\s+the\s+examples)\b"


def _unix(pattern: str) -> str:
    """Only a line feed ends a line: without this a carriage return would, too."""
    return pattern.replace("(?", "(?d", 1) if "m" in pattern[:5] else pattern


def with_template(rows: DataFrame, prompt: str = "prompt") -> DataFrame:
    """rows with the eight counts (<marker>_count), template_type and ambiguous. Null prompts have no markers."""
    text = F.coalesce(F.col(prompt), F.lit(""))
    out = rows.withColumns({f"{name}_count": F.regexp_count(text, F.lit(_unix(p))).cast("long") for name, p in COUNTED.items()})
    n = lambda name: F.col(f"{name}_count")
    marks = F.greatest(n("lettered"), n("inline"))
    few = (n("answer") >= 2) | (n("example") >= 2) | (n("answer") >= 1) & (n("question") >= 2) | (n("example") >= 1) & (n("answer") >= 1)
    few_weak = ~few & (text.rlike(WEAK_FEWSHOT) | (n("example") == 1) | (n("answer") >= 1) & (n("question") >= 1))
    options = (marks >= 2) | (n("true_false") >= 1) | (n("header") >= 1) & (n("numbered") >= 2) | (n("header") >= 1) & (marks >= 1)
    options_weak = ~options & (text.rlike(WEAK_OPTION) | (n("header") >= 1) | (marks == 1))
    kind = F.concat(F.when(few, F.lit("fs")).otherwise(F.lit("zs")), F.when(options, F.lit("_opt")).otherwise(F.lit("_noopt")))
    return out.withColumn("template_type", kind).withColumn("ambiguous", few_weak | options_weak)


def template_counts(marked: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of each type and ambiguous rows by keys; types are known, so the pivot needs no pass of its own."""
    return marked.groupBy(*keys).agg(*[F.count_if(F.col("template_type") == t).alias(f"{t}_count") for t in TYPES], F.count_if("ambiguous").alias("ambiguous_count"), F.count("*").alias("n"))


def stability(counts: DataFrame) -> DataFrame:
    """Dominant type (ties: first in order), its share, number of types present and share of ambiguous rows; shares of
    an empty task are 0."""
    cols = [F.col(f"{t}_count") for t in TYPES]
    top = F.greatest(*cols)
    dominant = F.coalesce(*[F.when(c == top, F.lit(t)) for t, c in zip(TYPES, cols)])
    share = lambda c: F.when(F.col("n") > 0, F.round(c / F.col("n"), 6)).otherwise(0.0)
    return counts.select("task_id", "n", dominant.alias("dominant"), top.alias("dominant_count"), share(top).alias("dominant_fraction"),
                         sum((c > 0).cast("int") for c in cols).alias("active_types"), share(F.col("ambiguous_count")).alias("ambiguous_fraction"))


def hash_sample(marked: DataFrame, per_bucket: int, key: Column) -> DataFrame:
    """The per_bucket rows of lowest hash score of each (task, split, type, ambiguous). The window keeps a bounded
    number of rows a bucket, which Spark prunes before the shuffle."""
    score = hash_score_hex(F.col("task_id"), F.col("split"), key, F.col("template_type"), F.col("ambiguous").cast("int"))
    w = Window.partitionBy("task_id", "split", "template_type", "ambiguous").orderBy("score", key)
    return marked.withColumn("score", score).withColumn("bucket_rank", F.row_number().over(w)).filter(F.col("bucket_rank") <= per_bucket)
