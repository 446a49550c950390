"""Named queries over the test tables and their DuckDB twins."""

from __future__ import annotations

from . import deltas, episodes, families, frames, pairs, points, streams, vectors

MODULES = (families, vectors, deltas, pairs, streams, episodes, points, frames)


def all_queries() -> dict:
    return {name: fn for m in MODULES for name, fn in m.QUERIES.items()}


def all_oracles() -> dict:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
