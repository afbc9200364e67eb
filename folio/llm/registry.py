"""The queries of this subpackage and, where SQL can express them, the SQL they must agree with."""

from __future__ import annotations

from importlib import import_module

MODULES = ("p1_quality", "p2_forms", "p3_pieces", "p4_sentences", "p5_encoding", "p6_tokens", "p7_leaks", "p8_spans")


def queries() -> dict:
    return {name: f for m in MODULES for name, f in import_module(f"folio.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in import_module(f"folio.llm.{m}").ORACLE.items()}
