"""Registered queries of the engine's own operators, each with SQL where SQL can express it."""

from __future__ import annotations


def _modules() -> list:
    from sparkloom.plans import catalogue, class_queries, text_queries

    return [catalogue, class_queries, text_queries]


def queries() -> dict:
    return {name: q for m in _modules() for name, q in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in _modules() for name, q in m.oracle_sql().items()}
