"""Registry of runnable queries: name -> (Spark builder, DuckDB oracle SQL or None).

Each query module calls ``register`` at import; ``__spark_entry__`` exposes
the collected builders and oracle strings to the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, tuple[Builder, str | None]] = {}


def register(name: str, sql: str | None = None):
    """Decorator: register a (spark, sf_dir) -> DataFrame builder with its oracle SQL."""
    def deco(fn: Builder) -> Builder:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = (fn, sql)
        return fn
    return deco


def all_queries() -> dict[str, tuple[Builder, str | None]]:
    from . import catalog  # noqa: F401  (imports every query module)
    return dict(_QUERIES)
