"""Registered queries over the given tables, each with its SQL counterpart where SQL can say it."""

from __future__ import annotations


def _load() -> None:
    from sparkloom.catalog import chain_queries, graph_queries, ledger_queries, more_queries, resolution_queries, retrieval_queries, text_queries  # noqa: F401  they register themselves


def queries() -> dict:
    from sparkloom.catalog.base import QUERIES

    _load()
    return QUERIES


def oracle_sql() -> dict:
    from sparkloom.catalog.base import ORACLE_SQL

    _load()
    return ORACLE_SQL
