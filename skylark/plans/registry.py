"""The register of queries: a function (spark, sf_dir) -> DataFrame under its name, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, also: Sequence[str] = ()) -> Callable:
    """Register a function under its name and under those it had before; without SQL it is held against a plain version in the tests."""

    def add(f: Callable) -> Callable:
        for name in (f.__name__, *also):
            QUERIES[name] = f
            if sql:
                SQL[name] = sql
        return f

    return add
