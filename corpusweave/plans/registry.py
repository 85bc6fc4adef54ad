"""Registered queries of the engine's own operators and their SQL."""

from __future__ import annotations

from corpusweave.functions import authored, canonical
from corpusweave.operators import aggregate, graphs, jobs, joined, relational, sampling, textual, windows
from corpusweave.plans.sql import queries as bound
from corpusweave.streaming import ledger_queries

MODULES = (relational, aggregate, windows, sampling, textual, jobs)  # hold statements
BUILT = (joined, graphs, authored, canonical, ledger_queries)  # hold functions and SQL of their own


def statements() -> dict:
    out: dict = {}
    for m in MODULES:
        out |= m.STATEMENTS
    return out


def queries() -> dict:
    out = bound(statements())
    for m in (*MODULES, *BUILT):
        out |= getattr(m, "QUERIES", {})
    return out


def oracle_sql() -> dict:
    out = {name: s.oracle() for name, s in statements().items()}
    for m in (*MODULES, *BUILT):
        out |= getattr(m, "ORACLES", {})
    return out
