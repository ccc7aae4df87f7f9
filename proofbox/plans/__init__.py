"""Registered query plans: each (spark, sf_dir) -> DataFrame, with DuckDB oracle text."""

from __future__ import annotations

from proofbox.plans import decide_queries, forecast_queries, ledger_queries, legacy_queries, lifecycle_queries, shop_queries, stream_queries

_MODULES = [ledger_queries, decide_queries, legacy_queries, shop_queries, forecast_queries, lifecycle_queries, stream_queries]


def all_queries():
    out = {}
    for m in _MODULES:
        out.update(m.QUERIES)
    return out


def all_oracles():
    out = {}
    for m in _MODULES:
        out.update(getattr(m, "ORACLE", {}))
    return out
