import datetime as dt
import itertools
import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitspark.functions import classify as cl, score as sc
from pitspark.operators import portfolio as pf, resample as rs, stats as st


def day(n):
    return dt.date(2020, 1, 1) + dt.timedelta(days=int(n))


def test_normal_functions(spark):
    z = [-9.0, -3.2, -1.0, 0.0, 0.3, 2.5, 7.5]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in z], "z double").select(cl.normal_cdf("z")).collect()]
    assert np.allclose(got, [NormalDist().cdf(x) for x in z], atol=1e-14)
    p = [1e-9, 0.01, 0.2, 0.5, 0.9, 0.999999]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in p], "p double").select(cl.normal_ppf("p")).collect()]
    assert np.allclose(got, [NormalDist().inv_cdf(x) for x in p], rtol=1e-12, atol=1e-12)


def nw(x, lags):
    n, d = len(x), x - x.mean()
    v = d @ d / n + sum(2 * (1 - k / (lags + 1)) * (d[k:] @ d[:-k]) / n for k in range(1, min(lags, n - 1) + 1))
    return x.mean() / math.sqrt(v / n)


@pytest.mark.parametrize("n,lags", [(40, 0), (40, 3), (5, 8)])
def test_newey_west(spark, n, lags):
    x = np.random.default_rng(n + lags).normal(0.3, 1, n)
    df = spark.createDataFrame([("s", day(i), float(v)) for i, v in enumerate(x)], "s string, d date, v double")
    assert st.newey_west(df, ["s"], "d", "v", lags).first()["t"] == pytest.approx(nw(x, lags))
    assert st.newey_west(df.limit(2), ["s"], "d", "v", 1).first()["t"] is None


def brute_concordance(rows):
    num = den = 0
    for (t1, e1, p1), (t2, e2, p2) in itertools.permutations(rows, 2):
        if e1 and (t1 < t2 or (t1 == t2 and not e2)):
            den += 1
            num += 1 if p1 < p2 else 0.5 if p1 == p2 else 0
    return num / den, den


@pytest.mark.parametrize("n", [2, 7, 60, 150])
def test_concordance_counts_pairs_without_forming_them(spark, n):
    rng = np.random.default_rng(n)
    rows = [(int(t), int(e), float(p)) for t, e, p in zip(rng.integers(1, 15, n), rng.integers(0, 2, n), np.round(rng.normal(size=n), 1))]
    rows[0] = (1, 1, rows[0][2])
    got = st.concordance(spark.createDataFrame(rows, "t int, e int, p double"), "t", "e", "p").first()
    want, pairs = brute_concordance(rows)
    assert got["pairs"] == pairs and got["concordance"] == pytest.approx(want)


def test_concordance_across_ranges_of_positions(spark, monkeypatch):
    import random

    rng = random.Random(4)
    rows = [(rng.randint(1, 30), rng.randint(0, 1), 0.5 if rng.random() < 0.3 else round(rng.random(), 2), g) for g in ("a", "b") for _ in range(400)]
    df = spark.createDataFrame(rows, "t int, e int, p double, g string")
    monkeypatch.setattr(st, "LEAST_BLOCK", 7)
    got = {r["g"]: r for r in st.concordance(df, "t", "e", "p", ["g"]).collect()}
    for g in ("a", "b"):
        want, pairs = brute_concordance([r[:3] for r in rows if r[3] == g])
        assert got[g]["pairs"] == pairs and got[g]["concordance"] == pytest.approx(want)


def test_auc_with_ties(spark):
    rows = [(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1)]
    assert st.auc(spark.createDataFrame(rows, "y int, p double"), "y", "p").first()["auc"] == pytest.approx(0.875)
    assert st.auc(spark.createDataFrame([(1, 0.3)], "y int, p double"), "y", "p").first()["auc"] is None


def test_moments_match_pandas(spark):
    x = np.random.default_rng(0).gamma(2, size=30)
    r = st.sample_moments(spark.createDataFrame([("a", float(v)) for v in x], "k string, v double"), ["k"], "v").first()
    assert r["skew"] == pytest.approx(pd.Series(x).skew()) and r["kurtosis"] == pytest.approx(pd.Series(x).kurt() + 3)


def test_deflated_sharpe_falls_with_more_trials(spark):
    rng = np.random.default_rng(1)
    data = [(f"v{k}", day(30 * i), float(rng.normal(0.02 if k == 0 else 0, 0.05))) for k in range(8) for i in range(60)]
    df = spark.createDataFrame(data, "variant_id string, date date, ret double")
    few, many = (st.deflated_sharpe(df, trials=t).filter("variant_id = 'v0'").first()["dsr"] for t in (2, 500))
    assert few > many


def test_pbo_low_for_a_real_edge_and_high_for_noise(spark):
    rng = np.random.default_rng(3)
    def build(edge):
        return spark.createDataFrame([(f"v{k}", day(i), float(rng.normal(edge if k == 0 else 0, 1))) for k in range(6) for i in range(64)], "variant_id string, date date, ret double")
    real, noise = (st.pbo_cscv(build(e), blocks=8).first() for e in (1.0, 0.0))
    assert real["combinations"] == 70 and real["pbo"] < 0.05 < noise["pbo"]


def test_holm(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "v string, p double")
    got = {r["v"]: r["holm_p"] for r in st.holm_adjust(df, "p", "v").collect()}
    assert got == pytest.approx({"a": 0.03, "c": 0.06, "b": 0.06})


def test_bootstrap_brackets_the_mean(spark):
    rng = np.random.default_rng(0)
    rows = [(day(30 * (i // 20)), float(rng.normal(0.02, 0.1))) for i in range(500)]
    df = spark.createDataFrame(rows, "m date, x double")
    r = rs.bootstrap_ratio(df, "m", "x", 500).first()
    mean = np.mean([x for _, x in rows])
    assert r["ci_low"] < mean < r["ci_high"]


def test_random_events_draw_members_only_and_repeat(spark):
    m = spark.createDataFrame([(day(0), t) for t in "ABCD"] + [(day(10), "Z")], "date date, ticker string")
    t = spark.createDataFrame([("A", day(5), 3), ("B", day(12), 9)], "ticker string, signal_date date, pos int")
    a = sorted(map(tuple, rs.random_events(t, m, 30).collect()))
    assert a == sorted(map(tuple, rs.random_events(t.repartition(3), m, 30).collect())) and len(a) == 60
    assert {r[3] for r in a if r[1] == day(12)} == {"Z"} and {r[3] for r in a if r[1] == day(5)} <= set("ABCD")


def test_monthly_portfolio_turnover_drifts(spark):
    rows = [(day(0), "A", 2.0, 1.0), (day(0), "B", 1.0, 0.0), (day(0), "C", 0.0, 0.0), (day(0), "D", -1.0, 0.0),
            (day(30), "A", 2.0, 0.0), (day(30), "B", 1.0, 0.0), (day(30), "C", 0.0, 0.0), (day(30), "D", -1.0, 0.0)]
    df = spark.createDataFrame(rows, "date date, ticker string, s double, next_return double")
    got = pf.monthly_portfolio(df, "s", top_quantile=0.5, max_weight=1.0, cost=0.01).orderBy("date").collect()
    assert got[0]["turnover"] == pytest.approx(1.0) and got[0]["gross"] == pytest.approx(0.5)
    assert got[1]["turnover"] == pytest.approx(2 / 3 - 0.5 + 0.5 - 1 / 3)


def test_kaplan_meier(spark):
    df = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, 1)], "duration int, event int")
    assert [r["s"] for r in st.kaplan_meier(df).orderBy("t").collect()] == pytest.approx([0.75, 0.5, 0.0])


def test_weight_profiles_and_groups():
    for days, anchor in ((1, 1), (30, 30), (365, 365), (3650, 3650), (7300, 3650)):
        assert sc.weight_profile(days) == sc.ANCHORS[anchor]
    mid = sc.weight_profile(104)["market_features"]
    assert 0 < mid["return_1m"] < 1 and 0 < mid["return_3m"] < 0.5
    for w in sc.PROFILE_WEIGHTS.values():
        assert sum(w.values()) == pytest.approx(1.0)


def test_missing_groups_do_not_lower_the_score(spark):
    df = spark.createDataFrame([(0.1, None), (0.1, 0.2)], "price_vs_ma50 double, net_margin double")
    a, b = sc.with_weighted_view(df, 91).collect()
    assert a["score"] == pytest.approx(0.5) and a["fundamental_weight"] == 0 and b["score"] > 0.5
    assert b["dominant_factors"] == ["fundamental_profitability", "technical_trend"]


def test_variants_in_one_plan_equal_single_runs(spark):
    import random

    rng = random.Random(8)
    rows = [(f"2020-{m:02d}-28", f"t{i:02d}", rng.random(), rng.choice([None, rng.random()]), rng.uniform(-0.1, 0.1)) for m in range(1, 9) for i in range(25)]
    df = spark.createDataFrame(rows, "date string, ticker string, a double, b double, r double").withColumn("date", F.to_date("date"))
    long = df.unpivot(["date", "ticker", "r"], ["a", "b"], "variant", "_s")
    for run in (lambda d, s, by=(): pf.decile_spread(d, s, "r", 0.2, 0.001, by), lambda d, s, by=(): pf.monthly_portfolio(d, s, "r", 0.2, 0.4, 0.001, by)):
        together = run(long, "_s", ["variant"])
        for v in ("a", "b"):
            key = lambda x: [tuple(round(c, 9) if isinstance(c, float) else c for c in r) for r in sorted(x.collect())]
            assert key(together.filter(F.col("variant") == v).drop("variant")) == key(run(df, v))


def test_themes_as_rows(spark):
    from pitspark.operators import universe as un

    m = spark.createDataFrame([("ai", "A", "x"), ("ai", "A", "y"), ("ai", "", "y"), ("ai", "B", "y"), (None, "C", "x")], "theme string, ticker string, institution string")
    assert [tuple(r) for r in un.theme_summary(m).collect()] == [("ai", 2, 4, 2, "A")]
    assert sorted(tuple(r) for r in un.theme_companies(m).collect()) == [("ai", "A"), ("ai", "B")]
