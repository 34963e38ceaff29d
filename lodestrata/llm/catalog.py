"""Every registered query of the subpackage with its SQL counterpart."""

from __future__ import annotations

from lodestrata.llm import problems

MODULES = [problems]


def queries():
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql():
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}
