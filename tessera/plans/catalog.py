"""Registry of named queries over the driver tables.

``register(name, oracle)`` records a builder ``(spark, sf_dir) -> DataFrame``
and, when the operator is SQL-expressible, the DuckDB oracle text.  Query
modules under :mod:`tessera.plans` register themselves on import.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def load_all() -> None:
    # Import side effects populate the registry.
    from tessera.plans import (q_retrieval, q_quality, q_reports, q_transcripts,  # noqa: F401
                               q_streaming, q_surface)
