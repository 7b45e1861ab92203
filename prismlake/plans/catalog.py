"""All queries over the reference operators, and their SQL."""

from __future__ import annotations

from . import codec_queries, lookup_queries, misc_queries, raster_queries

MODULES = [raster_queries, lookup_queries, codec_queries, misc_queries]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
