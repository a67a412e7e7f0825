"""Research protocol: holdout guard, append-only registry, promotion, one-look gates.

Registry, promotions and looks are Parquet folders written in append mode, read back before any
decision; a look is logged before its runner starts, so a crashed run still counts. A run number and a look are
claimed by creating a marker file that must not exist yet, which the file system lets one writer do; a run's
trial row is written last and commits it, so returns without a trial are those of a crashed or running writer and do not count.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.schemas import REGISTRY
from .stats import common_dates, monthly_perf, selection_stats

MIN_DSR, MAX_PBO = 0.95, 0.20


class HoldoutViolation(RuntimeError):
    """A development step touched the holdout, or a second look was asked for."""


def assert_dev(df: DataFrame, date: str, holdout_start, what: str = "date") -> DataFrame:
    """Raise if any date lies in the holdout (one pushed-down maximum)."""
    latest = df.agg(F.max(date).cast("string")).first()[0]
    if latest is not None and latest >= str(holdout_start):
        raise HoldoutViolation(f"{what} {latest} is in the holdout (from {holdout_start})")
    return df


def variant_base(family: str, params: dict) -> str:
    return f"{family}:{hashlib.sha1(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()[:10]}"


def variant_ids(runs: DataFrame) -> DataFrame:
    """(family, params JSON with sorted keys, run_no) to variant ids, as columns."""
    return runs.withColumn("variant_id", F.concat_ws(":", "family", F.substring(F.sha1("params"), 1, 10), F.col("run_no").cast("string")))


class Registry:
    """Append-only trials under one folder: ``trials``, ``returns``, ``promotions``, ``looks``."""

    def __init__(self, spark: SparkSession, root: str, holdout_start) -> None:
        self.spark, self.root, self.holdout_start = spark, root.rstrip("/"), holdout_start

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def _claim(self, name: str) -> bool:
        """Create the marker ``name``; false if another writer has it."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/claims/{hashlib.sha1(name.encode()).hexdigest()}")
        try:
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(path, False).close()
        except Py4JJavaError as e:
            if "Exist" in type(e).__name__ + str(e.java_exception.getClass().getName()) or "exist" in str(e.java_exception.getMessage()):
                return False
            raise
        return True

    def trials(self) -> DataFrame:
        return self._read("trials", REGISTRY)

    def returns(self) -> DataFrame:
        """Returns of the runs whose trial is written."""
        return self._read("returns", "variant_id string, date date, ret double").join(self.trials().select("variant_id").distinct(), "variant_id", "left_semi")

    def promotions(self) -> DataFrame:
        return self._read("promotions", "candidate string, dsr double, pbo double, promoted boolean, timestamp timestamp")

    def looks(self) -> DataFrame:
        return self._read("looks", "test_id string, started timestamp, run int, forced boolean, state string, summary string")

    def register(self, family: str, description: str, params: dict, returns: DataFrame, mean_rank_ic: float | None = None, ic_tstat: float | None = None) -> str:
        """Append one run; the same parameters again get the next run number that no writer has claimed."""
        r = assert_dev(returns.filter(F.col("ret").isNotNull()).select("date", "ret"), "date", self.holdout_start, "registered return")
        base = variant_base(family, params)
        run = self.trials().filter(F.col("variant_id").startswith(base + ":")).count()
        while not self._claim(f"run {base}:{run}"):
            run += 1
        vid = f"{base}:{run}"
        perf = monthly_perf(r).select("sharpe", "annualized")
        span = r.agg(F.min("date").alias("dev_start"), F.max("date").alias("dev_end"), F.count(F.lit(1)).alias("months"))
        opt = lambda v: F.lit(v).cast("double")
        row = span.select(F.lit(vid).alias("variant_id"), F.lit(family).alias("family"), F.lit(description).alias("description"),
                          F.lit(json.dumps(params, sort_keys=True, default=str)).alias("params"), "dev_start", "dev_end", "months",
                          opt(mean_rank_ic).alias("mean_rank_ic"), opt(ic_tstat).alias("ic_tstat"), perf.select("sharpe").scalar().alias("sharpe"),
                          perf.select("annualized").scalar().alias("annualized"), F.current_timestamp().alias("timestamp"))
        r.select(F.lit(vid).alias("variant_id"), "date", "ret").write.mode("append").parquet(f"{self.root}/returns")
        row.write.mode("append").parquet(f"{self.root}/trials")
        return vid

    def return_matrix(self) -> DataFrame:
        """Long returns of all variants on their common dates."""
        return common_dates(self.returns())

    def promote(self, candidate: str) -> bool:
        """Record whether the candidate clears the selection-bias bars; appended either way."""
        n = self.trials().count()
        stats = selection_stats(self.returns(), n).filter(F.col("variant_id") == candidate)
        row = stats.select(F.col("variant_id").alias("candidate"), "dsr", "pbo",
                           F.coalesce((F.col("dsr") > MIN_DSR) & (F.col("pbo") < MAX_PBO), F.lit(False)).alias("promoted"), F.current_timestamp().alias("timestamp"))
        row.write.mode("append").parquet(f"{self.root}/promotions")
        return bool(self.promotions().filter(F.col("candidate") == candidate).orderBy(F.col("timestamp").desc()).first()["promoted"])

    def _log(self, test_id: str, run: int, forced: bool, state: str, summary: dict | None = None) -> None:
        row = self.spark.range(1).select(F.lit(test_id).alias("test_id"), F.current_timestamp().alias("started"), F.lit(run).alias("run"), F.lit(forced).alias("forced"),
                                         F.lit(state).alias("state"), F.lit(json.dumps(summary or {}, default=str)).alias("summary"))
        row.write.mode("append").parquet(f"{self.root}/looks")

    def one_look(self, test_id: str, runner: Callable[[], dict], force: bool = False) -> dict:
        """Run a holdout test once. The look is logged before it runs; a second one needs ``force`` and is marked."""
        before = self.looks().filter((F.col("test_id") == test_id) & (F.col("state") == "started")).count()
        while (before and not force) or not self._claim(f"look {test_id}:{before}"):
            if not force:
                raise HoldoutViolation(f"{test_id} already had its one holdout look")
            before += 1
        self._log(test_id, before + 1, bool(before), "started")
        result = runner()
        self._log(test_id, before + 1, bool(before), "finished", result.get("summary"))
        return {**result, "looks": before + 1}

    def final_test(self, candidate: str, runner: Callable[[], dict]) -> dict:
        """The one look of a promoted strategy."""
        if self.promotions().filter((F.col("candidate") == candidate) & F.col("promoted")).limit(1).count() == 0:
            raise HoldoutViolation(f"{candidate} was not promoted")
        return self.one_look(f"final:{candidate}", runner)
