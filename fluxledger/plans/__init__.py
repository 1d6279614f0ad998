"""Registered queries with their oracle SQL, by area."""

from . import admin, cdc, groups, incident, log_queries, maintenance, mappings, share, topics, transactions

MODULES = (incident, log_queries, transactions, maintenance, cdc, groups, share, admin, topics, mappings)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
