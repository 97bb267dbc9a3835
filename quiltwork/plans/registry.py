"""All core queries and their SQL, module by module."""

from __future__ import annotations

from quiltwork.plans import assembly, details, ingest, io, selection, skew, texts

MODULES = (skew, ingest, texts, selection, assembly, io, details)
FLAGSHIP = "entry_allocation"


def queries():
    return {name: f for m in MODULES for name, f in m.queries().items()}


def oracle_sql():
    return {name: sql for m in MODULES for name, sql in m.oracle_sql().items()}
