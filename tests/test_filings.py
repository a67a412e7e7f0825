import datetime as dt

import pytest
from pyspark.sql import functions as F

from pitspark.operators import facts as fx, holdings as hd, insider as ins, rules as ru, sinks as sk, universe as un


def day(n):
    return dt.date(2020, 1, 1) + dt.timedelta(days=int(n))


TX = "accession string, filing_date date, trans_date date, issuer_cik long, owner_cik long, trans_code string, shares double, price double, value double"


def tx_rows(spark, rows):
    return spark.createDataFrame([(a, d, d, i, o, c, s, 10.0, s * 10.0) for a, d, i, o, c, s in rows], TX)


@pytest.fixture
def issuers(spark):
    return spark.createDataFrame([("A", 1), ("B", 2)], "ticker string, issuer_cik long")


def test_window_edges_distinct_buyers_and_joint_filing(spark, issuers):
    tx = tx_rows(spark, [("x", day(10), 1, 7, "P", 5.0), ("x", day(10), 1, 8, "P", 5.0), ("y", day(50), 1, 7, "P", 2.0), ("z", day(60), 1, 9, "S", 1.0)])
    keys = spark.createDataFrame([("A", day(x), 0.0) for x in (9, 10, 99, 100, 139, 140, 160)] + [("B", day(20), 0.0), ("C", day(20), 0.0)], "ticker string, date date, log_market_cap double")
    got = {(r["ticker"], r["date"]): (r["insider_buyers_90d"], r["insider_net_buy_value_90d_mcap"]) for r in ins.insider_features(keys, tx, issuers, coverage_end=day(150)).collect()}
    assert got[("A", day(9))] == (0.0, 0.0)
    assert got[("A", day(10))] == (2.0, 50.0)            # the joint filing's value counts once
    assert got[("A", day(99))] == (2.0, 60.0)
    assert got[("A", day(100))] == (1.0, 10.0)           # (d - 90, d]: day 10 has left
    assert got[("A", day(139))] == (1.0, 10.0) and got[("A", day(140))] == (0.0, -10.0)
    assert got[("A", day(160))] == (None, None)          # past coverage
    assert got[("B", day(20))] == (0.0, 0.0) and got[("C", day(20))] == (None, None)


def test_buyers_equal_brute_force(spark, issuers):
    import random

    rng = random.Random(5)
    rows = [(f"a{i}", day(rng.randrange(200)), rng.choice([1, 1, 1, 2]), rng.randrange(12), rng.choice("PPS"), 1.0) for i in range(200)]
    keys = spark.createDataFrame([(t, day(d)) for t in "AB" for d in range(0, 320, 7)], "ticker string, date date")
    got = {(r["ticker"], r["date"]): r["insider_buyers_90d"] for r in ins.insider_features(keys, tx_rows(spark, rows), issuers).collect()}
    for (t, d), n in got.items():
        i = {"A": 1, "B": 2}[t]
        want = {o for _, f, iss, o, c, _ in rows if iss == i and c == "P" and f <= d and (d - f).days < 90}
        assert n == len(want)


def test_cluster_cooldown_counts_from_the_last_kept_signal(spark, issuers):
    rows = [(f"{d}-{o}", day(d), 1, o, "P", 1.0) for d in (0, 60, 90, 91, 150, 182) for o in range(3)]
    got = sorted(r["signal_date"] for r in ins.insider_cluster_events(tx_rows(spark, rows), issuers).collect())
    assert got == [day(0), day(91), day(182)]


def test_year_to_date_facts_become_quarters(spark):
    def f(tag, start, end, val, filed):
        return (1, "us-gaap", tag, dt.date.fromisoformat(start), dt.date.fromisoformat(end), val, dt.date.fromisoformat(filed), "10-Q")
    rows = [f("Revenues", "2020-01-01", "2020-03-31", 10.0, "2020-05-01"), f("SalesRevenueNet", "2020-01-01", "2020-03-31", 99.0, "2021-05-01"),
            f("NetCashProvidedByUsedInOperatingActivities", "2020-01-01", "2020-03-31", 3.0, "2020-05-01"),
            f("NetCashProvidedByUsedInOperatingActivities", "2020-01-01", "2020-06-30", 8.0, "2020-08-01"),
            f("NetCashProvidedByUsedInOperatingActivities", "2020-01-01", "2020-12-31", 20.0, "2021-02-01")]
    raw = spark.createDataFrame(rows, "cik long, ns string, tag string, start date, end date, val double, filed date, form string")
    q = {(r["field"], r["end"].isoformat()): (r["val"], r["filed"].isoformat(), r["derived"]) for r in fx.discrete_quarters(fx.duration_facts(raw)).collect()}
    assert q == {("revenue", "2020-03-31"): (10.0, "2020-05-01", False), ("ocf", "2020-03-31"): (3.0, "2020-05-01", False), ("ocf", "2020-06-30"): (5.0, "2020-08-01", True)}


def test_snapshot_sees_only_filed_facts_and_debt_fallback(spark):
    ends = [dt.date(2020, 3, 31), dt.date(2020, 6, 30), dt.date(2020, 9, 30), dt.date(2020, 12, 31)]
    rows = [(1, "q", "revenue", e, 10.0 + i, e + dt.timedelta(days=40), False) for i, e in enumerate(ends)]
    rows += [(1, "i", "cash", ends[3], 5.0, ends[3] + dt.timedelta(days=40), False), (1, "i", "assets", ends[3], 50.0, ends[3] + dt.timedelta(days=40), False)]
    t = spark.createDataFrame(rows, "cik long, kind string, field string, end date, val double, filed date, derived boolean")
    s = {r["state_date"]: r for r in fx.snapshots(t).collect()}
    assert s[ends[2] + dt.timedelta(days=40)]["revenue_ttm"] is None
    last = s[ends[3] + dt.timedelta(days=40)]
    assert last["revenue_ttm"] == 46.0 and last["debt"] == 0.0 and last["net_debt"] == -5.0 and last["fcf_ttm"] is None


def test_split_and_flow_adjusted_change(spark):
    def book(acc, rows):
        return [(1, acc, c, c, "COM", s, v) for c, s, v in rows]
    h = spark.createDataFrame(book("p", [("a", 100.0, 1000.0), ("b", 100.0, 1000.0), ("c", 100.0, 1000.0), ("d", 50.0, 500.0)])
                              + book("q", [("a", 400.0, 1000.0), ("b", 100.0, 1000.0), ("c", 200.0, 2000.0), ("e", 10.0, 100.0)]),
                              "cik long, accession string, cusip string, name_of_issuer string, title_of_class string, shares double, value double")
    f = spark.createDataFrame([(1, "p", day(45), day(0)), (1, "q", day(135), day(90))], "cik long, accession string, filing_date date, report_date date")
    got = {r["cusip"]: (r["status"], r["split_factor"]) for r in hd.compare_quarters(h, f).filter("accession = 'q'").collect()}
    assert got == {"a": ("UNCHANGED", 4.0), "b": ("UNCHANGED", 1.0), "c": ("ADDED", 1.0), "d": ("EXITED", 1.0), "e": ("NEW", 1.0)}
    assert {r["status"] for r in hd.compare_quarters(h, f).filter("accession = 'p'").collect()} == {"NO_PRIOR"}


def test_active_features_null_without_a_live_filing(spark):
    p = spark.createDataFrame([(1, "a", day(0), "T", "NEW", 0.3)], "cik long, accession string, filing_date date, ticker string, status string, weight double")
    keys = spark.createDataFrame([("T", day(10)), ("U", day(10)), ("T", day(201))], "ticker string, date date")
    got = {(r["ticker"], r["date"]): (r["active_new_or_add"], r["active_weight_max"]) for r in hd.active_manager_features(keys, p).collect()}
    assert got == {("T", day(10)): (1.0, 0.3), ("U", day(10)): (0.0, 0.0), ("T", day(201)): (None, None)}


@pytest.mark.parametrize("fan", [6, 256])
def test_trailing_percentile_equals_numpy(spark, fan):
    import numpy as np

    rng = np.random.default_rng(2)
    d, v = rng.integers(0, 120, 1500), np.round(rng.normal(size=1500), 2)
    df = spark.createDataFrame([(day(a), float(b)) for a, b in zip(d, v)], "d date, v double")
    got = {r["d"]: (r["n"], r["threshold"]) for r in ru.trailing_percentile(df, "d", "v", 0.9, 30, fan).collect()}
    for a in sorted(set(d)):
        w = v[(d < a) & (d >= a - 30)]
        if len(w):
            assert got[day(a)][0] == len(w) and got[day(a)][1] == pytest.approx(np.quantile(w, 0.9))
        else:
            assert day(a) not in got


def test_merge_keeps_the_last_and_matches_null_keys(spark):
    old = spark.createDataFrame([("c1", None, 1), ("c2", "t", 2)], "chunk_id string, theme string, x int")
    new = spark.createDataFrame([("c1", None, 9)], "chunk_id string, theme string, x int")
    assert sorted((r["chunk_id"], r["x"]) for r in sk.merge_keep_last(old, new, ["chunk_id", "theme"]).collect()) == [("c1", 9), ("c2", 2)]


def test_chunk_table_refuses_duplicates_and_empty(spark, tmp_path):
    bad = spark.createDataFrame([("a", "h1"), ("a", "h2")], "chunk_id string, content_hash string")
    with pytest.raises(ValueError):
        sk.save_chunks(bad, str(tmp_path / "x"))
    with pytest.raises(ValueError):
        sk.save_chunks(bad.limit(0), str(tmp_path / "y"))


def test_candidate_pick_prefers_the_composite(spark):
    c = spark.createDataFrame([("i", "LN", "x", "n", "t", 0), ("i", "UN", "brk/b", "n", "t", 1), ("i", "US", "brk/b", "n", "t", 2), ("j", "LN", "x", "n", "t", 0)],
                              "identifier string, exch_code string, ticker string, name string, security_type string, input_order int")
    got = {r["identifier"]: (r["ticker"], r["exch_code"], r["confidence"]) for r in un.pick_candidate(c).collect()}
    assert got == {"i": ("BRK-B", "US", "high"), "j": ("x", "LN", "best_effort")}
    assert [r["identifier"] for r in un.pick_candidate(c, us_only=True).collect()] == ["i"]


def test_fall_halfway_between_two_roundings(spark):
    from pitspark.plans.q_filings import _fall

    got = spark.createDataFrame([(408.65, 640.0), (640.0, 640.0), (None, 1.0)], "c double, h double").select(F.round(_fall(F.col("c"), F.col("h")), 8).alias("d")).collect()
    assert [r["d"] for r in got] == [0.36148438, 0.0, None]
