"""Registry of runnable queries: a Spark callable and, where SQL can say it, the equivalent SQL text."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .oracle_views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)``; ``sql`` may name any view of ``oracle_views``."""
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn
    return register


def tidy(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Select ``cols`` (all if none) with doubles rounded, so engines that add in another order agree."""
    cols = cols or tuple(df.columns)
    kind = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*[(F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if isinstance(kind[c], (T.DoubleType, T.FloatType)) else F.col(c)
                       for c in cols])


def rounded(cols: Sequence[str] | str, digits: int = 6) -> str:
    """The SQL counterpart of ``tidy``."""
    names = cols.split() if isinstance(cols, str) else cols
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in names)
