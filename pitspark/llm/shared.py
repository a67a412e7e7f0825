"""Small helpers of the operators: tables, shared staging, keys of documents."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitspark.session import ensure_checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder of ``spark.checkpoint.dir`` and read it back.

    Cuts lineage at a table that every executor can read, so a lost executor costs a re-read.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/llm/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more: what came of them has been written itself."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def held_out(doc_id: Column, parts: int) -> Column:
    """The documents a model may not learn from: crc32 of the id as text, divisible by ``parts``. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == 0, F.lit(False))


def fields(df: DataFrame, *names: str) -> T.StructType:
    """The named columns of ``df`` as a schema, for functions that take these columns alone."""
    return T.StructType([T.StructField(n, df.schema[n].dataType) for n in names])


def commonest(table: DataFrame, most: int) -> int:
    """The least power of two such that at most ``most`` words occur at least so often."""
    rows = table.groupBy(F.floor(F.log2("n") + 1e-9).cast("int").alias("k")).agg(F.count("*").alias("words")).orderBy(F.desc("k")).collect()
    so_far, least = 0, None
    for r in rows:
        so_far += r["words"]
        if so_far > most:
            break
        least = 1 << r["k"]
    return least if least is not None else (2 << rows[0]["k"] if rows else 1)
