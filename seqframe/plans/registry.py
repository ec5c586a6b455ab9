"""Registry of named queries over the driver tables with their DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass


@dataclass
class Entry:
    name: str
    build: Callable  # (spark, sf_dir) -> DataFrame
    sql: str | None
    ops: str


QUERIES: dict[str, Entry] = {}


def query(name: str, ops: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Entry(name, fn, sql.strip() if sql else None, ops)
        return fn

    return deco
