"""The query catalogue: every registered query and its DuckDB oracle."""

from __future__ import annotations

from careerloom.plans import model_queries, posting_queries, protocol_queries, rating_queries, text_queries

MODULES: tuple = (rating_queries, posting_queries, text_queries, protocol_queries, model_queries)


def queries() -> dict:
    return {name: run for module in MODULES for name, run in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
