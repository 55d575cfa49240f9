"""All registered queries and their SQL, gathered from the modules of this folder."""

from __future__ import annotations

from atriaflow.plans import exports, meshes, studies, tables

MODULES: list = [meshes, tables, exports, studies]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: s for m in MODULES for name, s in m.SQL.items()}
