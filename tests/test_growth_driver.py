"""What a study keeps in the driver does not grow with its parts or with the size of its pools."""

import datetime as dt

from pitspark.operators import resample as rs
from pitspark.plans import q_studies as qs

plan = lambda df: df._jdf.queryExecution().executedPlan().toString()


def test_pools_are_not_sent_to_the_driver(spark):
    day = lambda i: dt.date(2020, 1, 1) + dt.timedelta(i)
    members = spark.createDataFrame([(day(0), f"t{k}") for k in range(5)], "date date, ticker string")
    trades = spark.createDataFrame([(day(p), p, f"t{p}") for p in range(1, 4)], "signal_date date, pos int, ticker string")
    drawn = rs.random_events(trades, members, 7)
    assert "SortMergeJoin [snapshot" in plan(drawn)
    got = drawn.collect()
    assert len(got) == 21 and {r["ticker"] for r in got} <= {f"t{k}" for k in range(5)}


def test_targets_and_studies_are_jobs_of_their_own(spark, monkeypatch):
    joined = lambda c: spark.range(1).select(F.lit(0.5).alias(c), "id").join(spark.range(2), "id").drop("id")
    from pyspark.sql import functions as F

    verdict = spark.createDataFrame([(True,), (False,), (True,)], "ok boolean")
    monkeypatch.setattr(qs, "_survival", lambda spark, sf, target: {"scores": joined("concordance"), "verdict": verdict})
    a8 = qs.a8(spark, "none")
    assert "Join" not in plan(a8) and [(r["concordance"], r["checks"], r["target"]) for r in a8.collect()] == [(0.5, 2, t) for t in qs.SURVIVAL_TARGETS]
    monkeypatch.setattr(qs, "a7", lambda spark, sf: joined("random_pct").withColumns({"period": F.lit("holdout"), "passed": F.lit(True)}))
    monkeypatch.setattr(qs, "a6", lambda spark, sf: joined("percentile").withColumns({"exit": F.lit("trail"), "verdict": F.lit("NOT PROVEN")}))
    a10 = qs.a10(spark, "none")
    assert "Join" not in plan(a10) and {(r["study"], r["name"], r["verdict"]) for r in a10.collect()} == {("events", "holdout", "PASS"), ("exits", "trail", "NOT PROVEN")}
