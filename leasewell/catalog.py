"""Every query of the queue model by name, with its DuckDB equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leasewell.plans import oracle, state_queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Queries by name; each takes (spark, sf_dir)."""
    return dict(state_queries.QUERIES)


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name."""
    return dict(oracle.SQL)
