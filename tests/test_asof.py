import datetime as dt

import numpy as np
import pandas as pd
import pytest

from pitspark.operators import asof


def day(n):
    return dt.date(2020, 1, 1) + dt.timedelta(days=int(n))


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(0)
    build = pd.DataFrame({"k": rng.integers(0, 4, 300), "d": [day(x) for x in rng.integers(0, 400, 300)]}).drop_duplicates()
    build["v"] = rng.normal(size=len(build))
    probe = pd.DataFrame({"id": range(500), "k": np.where(rng.random(500) < 0.6, 0, rng.integers(0, 5, 500)), "t": [day(x) for x in rng.integers(0, 400, 500)]})
    return build, probe, spark.createDataFrame(build), spark.createDataFrame(probe)


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("max_age", [None, 10])
@pytest.mark.parametrize("unique", [False, True])
def test_asof_join_equals_pandas(tables, strict, forward, max_age, unique):
    build, probe, b, p = tables
    if unique:
        probe = probe.drop_duplicates(["k", "t"])
        p = p.sparkSession.createDataFrame(probe)
    got = asof.asof_join(p, b, ["k"], "t", "d", ["v"], max_age=max_age, strict=strict, forward=forward, probe_unique=unique).toPandas().set_index("id").sort_index()
    left = probe.assign(t=pd.to_datetime(probe["t"])).sort_values("t")
    right = build.assign(d=pd.to_datetime(build["d"])).sort_values("d")
    want = pd.merge_asof(left, right, left_on="t", right_on="d", by="k", direction="forward" if forward else "backward", allow_exact_matches=not strict,
                         tolerance=None if max_age is None else pd.Timedelta(days=max_age)).set_index("id").sort_index()
    assert np.allclose(got["v"].astype(float), want["v"].astype(float), equal_nan=True)


def test_empty_build_and_null_probe_time(spark):
    b = spark.createDataFrame([], "k int, d date, v double")
    p = spark.createDataFrame([(1, day(3)), (2, None)], "k int, t date")
    assert [r["v"] for r in asof.asof_join(p, b, ["k"], "t", "d", ["v"]).collect()] == [None, None]


def test_latest_filing_is_dropped_after_max_age_and_when_superseded(spark):
    f = spark.createDataFrame([(1, "a", day(0)), (1, "b", day(100))], "cik long, accession string, filing_date date")
    dates = spark.createDataFrame([(day(x),) for x in (0, 99, 100, 300, 301)], "date date")
    got = {(r["date"], r["accession"]) for r in asof.latest_filings(f, dates).collect()}
    assert got == {(day(0), "a"), (day(99), "a"), (day(100), "b"), (day(300), "b")}


def test_membership_uses_the_latest_snapshot_only(spark):
    m = spark.createDataFrame([(day(0), "A"), (day(30), "B")], "date date, ticker string")
    s = spark.createDataFrame([(day(29), "A"), (day(30), "A"), (day(40), "B"), (day(-1), "A")], "signal_date date, ticker string")
    assert {(r["signal_date"], r["ticker"]) for r in asof.eligible(s, m).collect()} == {(day(29), "A"), (day(40), "B")}


def test_year_ago_filing_bands(spark):
    rows = [(1, "k0", "10-K", day(0), None), (1, "k1", "10-K", day(365), None), (1, "k2", "10-K", day(365 + 431), None),
            (1, "q0", "10-Q", day(0), day(-40)), (1, "q1", "10-Q", day(395), day(325)), (1, "q2", "10-Q", day(800), None)]
    f = spark.createDataFrame(rows, "cik long, accession string, form string, filing_date date, report_date date")
    got = {r["accession"]: r["prior_accession"] for r in asof.year_ago_filing(f).collect()}
    assert got == {"k0": None, "k1": "k0", "k2": None, "q0": None, "q1": "q0", "q2": None}


def test_month_changes_need_the_exact_month(spark):
    p = spark.createDataFrame([("A", dt.date(2020, 1, 31), 1.0), ("A", dt.date(2020, 4, 30), 4.0), ("A", dt.date(2020, 6, 30), 9.0)], "ticker string, date date, x double")
    assert [r["x_chg3m"] for r in asof.month_changes(p, ["x"], 3).orderBy("date").collect()] == [None, 3.0, None]


def test_filled_closes_stop_after_the_limit(spark):
    g = spark.createDataFrame([("A", i, 1.0 if i == 0 else None) for i in range(8)], "ticker string, pos int, close double")
    got = [r["close_filled"] for r in asof.filled_closes(g, 5).orderBy("pos").collect()]
    assert got == [1.0] * 6 + [None, None]


def test_raw_close_undoes_only_later_splits(spark):
    b = spark.createDataFrame([("A", day(0), 10.0, 0.0), ("A", day(1), 11.0, 4.0), ("A", day(2), 12.0, 0.0)], "ticker string, date date, close_split_adj double, split double")
    assert [r["raw_close"] for r in asof.raw_close(b).orderBy("date").collect()] == [40.0, 11.0, 12.0]


def test_year_ago_filing_sees_earlier_filings_only(spark):
    d = dt.date
    rows = [("late", d(2019, 3, 31), d(2020, 9, 1)), ("now", d(2020, 3, 31), d(2020, 5, 10)), ("old", d(2019, 3, 31), d(2019, 5, 12)), ("amended", d(2019, 3, 30), d(2019, 7, 1)), ("same_day", d(2019, 3, 31), d(2020, 5, 10))]
    f = spark.createDataFrame([(1, "10-Q", a, r, x) for a, r, x in rows], "cik long, form string, accession string, report_date date, filing_date date")
    got = {r["accession"]: r["prior_accession"] for r in asof.year_ago_filing(f).collect()}
    assert got["now"] == "amended"           # filed last among those filed before, though its period ends earlier
    only = {r["accession"]: r["prior_accession"] for r in asof.year_ago_filing(f.filter("accession IN ('late', 'now')")).collect()}
    assert only["now"] is None
