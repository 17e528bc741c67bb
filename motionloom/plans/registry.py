"""Registry of the named queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, uses: str = ""):
    """Register a query; ``uses`` names the common table expressions its SQL twin starts from."""

    def add(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            from .views import CTE

            names, seen = uses.split(), []
            for n in names:
                seen.append(f"{n} AS ({CTE[n]})")
            text = sql.strip()
            head = "WITH " + ",\n".join(seen) if seen else ""
            if text.startswith(","):
                text = (head + text) if seen else "WITH " + text[1:]
            elif seen:
                text = head + "\n" + text
            ORACLE[name] = text
        return fn

    return add
