"""Session defaults and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "pitspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on.

    A cluster's own master, shuffle width and checkpoint folder are left alone; AQE sizes the
    reduce side and splits skewed join partitions.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named by ``spark.checkpoint.dir``; only a local test session makes its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="pitspark-ckpt-", dir=os.environ.get("TMPDIR", "/tmp")))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


_STAGED: dict = {}


def stage(df_of, spark: SparkSession, key: str, rebuild: bool = False) -> DataFrame:
    """Compute ``df_of()`` once per application, keep it as Parquet in the shared folder, read it back.

    A table several steps of a study share (bars, a panel, a book history) is otherwise recomputed by
    every branch that reads it. The written copy survives lost executors and gives the planner real
    sizes.
    """
    slot = (spark.sparkContext.applicationId, key)
    if rebuild or slot not in _STAGED:
        _STAGED[slot] = _written(df_of())
    path, schema = _STAGED[slot]
    return spark.read.schema(schema).parquet(path)


def _written(df: DataFrame) -> tuple:
    """Path and schema of ``df``, written as Parquet under the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    root = df.sparkSession.sparkContext.getCheckpointDir().rstrip("/")
    path = f"{root}/staged/{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return path, df.schema


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back from there.

    Compressed columns take a fraction of a checkpoint's rows, and the planner sees the real size: a table of
    folds or means is broadcast instead of shuffling what it is joined with.
    """
    path, schema = _written(df)
    return df.sparkSession.read.schema(schema).parquet(path)
