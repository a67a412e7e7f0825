"""What must not grow faster than the input: exchanges of a plan, rows of one task, repeated joins."""

import datetime as dt
import random

from pyspark.sql import functions as F

from pitspark.operators import holdings as hd


def test_books_are_joined_once_for_medians_and_changes(spark):
    rng = random.Random(9)
    rows = [(c, f"a{c}{q}", dt.date(2020, 3 * q, 28), f"c{k}", f"n{k}", "COM", float(rng.randint(1, 9)), float(rng.randint(1, 90))) for c in range(3) for q in range(1, 5) for k in rng.sample(range(9), 6)]
    h = spark.createDataFrame(rows, "cik long, accession string, report_date date, cusip string, name_of_issuer string, title_of_class string, shares double, value double")
    h = h.withColumn("filing_date", F.date_add("report_date", 40))
    out = hd.compare_quarters(h, h.select("cik", "accession", "filing_date", "report_date").distinct())
    assert "FullOuter" not in out._jdf.queryExecution().executedPlan().toString()


def test_rint_rounds_a_ratio_as_bround_does(spark):
    x = spark.createDataFrame([(v,) for v in (0.5, 1.5, 2.5, 0.49999999999999994, 2.4999999999999996, 3.2, 7.0, 1e-9, 1e15)], "v double")
    assert x.filter(F.rint("v") != F.bround("v")).count() == 0
