"""All named queries over evaluation data and their SQL."""

from __future__ import annotations

from gaugeleaf.plans import atom_queries, graph_queries, reasoning_queries, result_queries, support_queries, task_queries, text_queries

MODULES = (atom_queries, text_queries, support_queries, task_queries, graph_queries, reasoning_queries, result_queries)


def queries() -> dict:
    return {k: q for m in MODULES for k, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in m.SQL.items()}
