"""Registry of the engine's queries and of the SQL that checks them."""

from __future__ import annotations

from sequent.plans import q_features, q_metrics, q_models, q_more, q_sequences, q_sources, q_tables

MODULES = (q_metrics, q_sequences, q_tables, q_models, q_features, q_sources, q_more)


def queries() -> dict:
    return {name: f for module in MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
