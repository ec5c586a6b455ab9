"""All registered queries (name -> builder) and their DuckDB oracle SQL."""

from __future__ import annotations

from . import catalog_corpus, catalog_io, catalog_vectors  # noqa: F401  (registration)
from .registry import QUERIES


def queries():
    return {name: e.build for name, e in QUERIES.items()}


def oracle_sql():
    return {name: e.sql for name, e in QUERIES.items() if e.sql}
