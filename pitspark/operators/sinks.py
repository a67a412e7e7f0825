"""Merge-and-dedupe writes, replaced slices, invariants, exports.

Each merge returns the frame to store; writing goes to a new folder and the caller swaps it in, so a
lost executor never leaves half a table behind the readers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .asof import latest_per_key


def merge_keep_last(existing: DataFrame | None, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Union of stored and new rows, one per key (nulls match nulls); a new row replaces a stored one.

    Inside a batch the last by ``batch_row`` wins where the batch numbers its rows.
    """
    old = new.limit(0) if existing is None else existing
    order = "batch_row" if "batch_row" in new.columns else None
    tag = lambda df, n: df.withColumn("_batch", F.lit(n)).withColumn("_row", F.col(order) if order and order in df.columns else F.lit(0))
    both = tag(old, 0).unionByName(tag(new, 1), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (*key, "_batch", "_row")]
    return latest_per_key(both, list(key), ["_batch", "_row", *rest[:1]]).drop("_batch", "_row")


SIGNAL_KEY = ("chunk_id", "signal_type", "evidence")
MENTION_KEY = ("chunk_id", "company_name", "theme", "evidence")


def replace_slice(existing: DataFrame, new: DataFrame, key: Sequence[str] = ("institution", "report_type")) -> DataFrame:
    """Drop the stored rows of every slice the new rows refresh, then append the new rows."""
    touched = new.select(*key).distinct()
    return existing.join(touched, list(key), "left_anti").unionByName(new, allowMissingColumns=True)


def chunk_violations(chunks: DataFrame) -> DataFrame:
    """(severity, key, rows): duplicate chunk ids are errors, duplicate contents are warnings."""
    dup = lambda col, sev: chunks.groupBy(col).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select(
        F.lit(sev).alias("severity"), F.col(col).cast("string").alias("key"), "rows")
    return dup("chunk_id", "error").unionByName(dup("content_hash", "warning"))


def save_chunks(chunks: DataFrame, path: str) -> None:
    """Write a chunk table after checking that it is not empty and its ids are unique."""
    if chunks.limit(1).count() == 0:
        raise ValueError("the chunk table is empty")
    bad = chunk_violations(chunks).filter(F.col("severity") == "error").limit(5).collect()
    if bad:
        raise ValueError(f"duplicate chunk ids: {[r['key'] for r in bad]}")
    chunks.write.mode("overwrite").parquet(path)


def export_json(df: DataFrame, path: str) -> None:
    """A table as JSON lines with sorted columns, in as many files as it has partitions."""
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)


def save_ranking(ranking: DataFrame, path: str, horizon_days: int, day, universe_version: str) -> None:
    """Ranking cache partitioned by horizon, day and universe version."""
    out = ranking.withColumns({"horizon": F.lit(horizon_days), "day": F.lit(str(day)), "universe": F.lit(universe_version)})
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("horizon", "day", "universe").parquet(path)


def load_ranking(spark, path: str, horizon_days: int, day, universe_version: str) -> DataFrame:
    """The cached ranking of one key: a partition-pruned read, empty when absent."""
    return spark.read.parquet(path).filter((F.col("horizon") == horizon_days) & (F.col("day") == str(day)) & (F.col("universe") == universe_version)) \
                .drop("horizon", "day", "universe")
