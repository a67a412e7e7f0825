"""Attaching a one-row aggregate to every row of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row frame as uncorrelated scalar subqueries: computed once, never joined."""
    return df.withColumns({c: one_row.select(c).scalar() for c in one_row.columns})
