"""Registration of queries with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    """Registers a function under its own name."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return put


def rounded(c: Column | str, places: int = 4) -> Column:
    """Rounded off the ties that two engines sum to different sides of; zero has no sign."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c + 1e-9, places) + F.lit(0.0)
