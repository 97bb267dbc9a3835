"""Scalar text functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the code points Python's str.strip removes, as a Java regex class.
BLANK_PATTERN = "^[\\s\\x1c-\\x1f\\x85\\p{Z}]*$"


def is_blank(c: Column) -> Column:
    """True for empty text and text of Unicode white space only; null for null."""
    return c.rlike(BLANK_PATTERN)


def has_text(c: Column) -> Column:
    """True for a non-null, non-blank text, false otherwise (never null)."""
    return c.isNotNull() & ~F.coalesce(is_blank(c), F.lit(True))


def strip(c: Column) -> Column:
    """Python's str.strip: all Unicode white space, not only blanks."""
    return F.regexp_replace(c, "^[\\s\\x1c-\\x1f\\x85\\p{Z}]+|[\\s\\x1c-\\x1f\\x85\\p{Z}]+$", "")


def preview(c: Column, n: int, escape_newlines: bool = True) -> Column:
    """First n code points, marked when cut; line feeds are escaped on request."""
    x = F.replace(c, F.lit("\n"), F.lit("\\n")) if escape_newlines else c
    return F.when(F.length(x) <= n, x).otherwise(F.concat(F.substring(x, 1, n), F.lit("...[truncated]")))


def safe_name(c: Column) -> Column:
    """File-safe name: runs of other characters become two underscores."""
    return F.regexp_replace(c, "[^A-Za-z0-9_.-]+", "__")


def slug(c: Column) -> Column:
    """Slug with the corpus separator kept apart and outer underscores removed."""
    x = F.regexp_replace(F.replace(c, F.lit("::"), F.lit("__")), "[^A-Za-z0-9._-]+", "_")
    return F.btrim(x, F.lit("_"))


def hash_score_hex(*parts: Column, seed: int = 23) -> Column:
    """First 8 digest bytes of sha256(seed|part|part...) as 16 hex digits: the order of the hex strings is the
    order of the unsigned numbers, which do not fit a long."""
    payload = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.substring(F.sha2(payload, 256), 1, 16)


def safe_ratio(a: Column, b: Column, digits: int | None = None) -> Column:
    """a / b, 0.0 where b is 0 or null."""
    x = F.when(b != 0, a / b).otherwise(F.lit(0.0))
    return x if digits is None else F.round(x, digits)


def code_points(c: Column) -> Column:
    """Length in code points; 0 for null."""
    return F.coalesce(F.length(c), F.lit(0))


def tidy_lang(c: Column) -> Column:
    """Two-letter language: case, region and three-letter codes are folded; null, blank and und give 'und'."""
    # ISO 639-2 codes and their ISO 639-1 form.
    codes = {"eng": "en", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "rus": "ru", "zho": "zh",
             "chi": "zh", "ita": "it", "por": "pt", "nld": "nl", "dut": "nl", "jpn": "ja", "kor": "ko"}
    primary = F.regexp_extract(F.lower(strip(c)), "^([a-z]{2,3})(?:[-_].*)?$", 1)
    table = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    tidy = F.coalesce(F.try_element_at(table, primary), primary)
    return F.when(c.isNull() | tidy.isin("", "und"), F.lit("und")).otherwise(tidy)
