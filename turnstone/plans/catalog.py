"""Named queries over the given tables, each with DuckDB SQL of the same columns where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE[name or f.__name__] = sql
        return f

    return add


def tidy(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """The named columns (all if none) as text, bigint, boolean and rounded doubles."""
    out = []
    for name, kind in df.select(*columns).dtypes if columns else df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("int", "smallint", "tinyint"):
            c = c.cast("bigint")
        elif kind in ("double", "float") or kind.startswith("decimal"):
            c = F.round(c.cast("double"), digits)
        out.append(c.alias(name))
    return df.select(*out)
