import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitspark.operators import models as mo, protocol as pr, stats as st


def day(n):
    return dt.date(2015, 1, 1) + dt.timedelta(days=int(n))


def planted(spark, edge, dates=30, names=60):
    rng = np.random.default_rng(4)
    rows = []
    for d in range(dates):
        x = rng.normal(size=(names, 2))
        y = edge * x[:, 0] + rng.normal(size=names)
        rows += [(day(30 * d), f"t{i:03d}", float(x[i, 0]), float(x[i, 1]), float(y[i])) for i in range(names)]
    return spark.createDataFrame(rows, "date date, ticker string, roe double, net_margin double, fwd_excess double")


def test_folds_expand_and_keep_the_embargo(spark):
    d = spark.createDataFrame([(day(i),) for i in range(20)], "date date")
    f = mo.walk_forward_splits(d, 8, 3, 2).collect()
    for fold in {r["fold"] for r in f}:
        train = sorted(r["date"] for r in f if r["fold"] == fold and r["role"] == "train")
        test = sorted(r["date"] for r in f if r["fold"] == fold and r["role"] == "test")
        assert train == [day(i) for i in range(8 + 3 * fold)] and test == [day(i) for i in range(10 + 3 * fold, min(13 + 3 * fold, 20))]
    assert {r["fold"] for r in f} == {0, 1, 2, 3}


def test_ridge_equals_the_closed_form(spark):
    p = planted(spark, 1.0).toPandas()
    x, y = p[["roe", "net_margin"]].to_numpy(), p["fwd_excess"].to_numpy()
    xc = x - x.mean(axis=0)
    coef = np.linalg.solve(xc.T @ xc + np.eye(2), xc.T @ (y - y.mean()))
    got = mo.ridge_fit(spark.createDataFrame(p), ["roe", "net_margin"], "fwd_excess")
    assert np.allclose(got[1:], coef) and got[0] == pytest.approx(y.mean() - x.mean(axis=0) @ coef)


def test_planted_signal_is_found_out_of_sample(spark):
    p = planted(spark, 1.0)
    x = mo.design(p, ["roe", "net_margin"])
    folds = mo.walk_forward_splits(p, 12, 9, 1)
    preds, top = mo.walk_forward_predict(x, folds, ["roe", "net_margin"], params={"maxIter": 5})
    assert top.first()["feature"] == "roe"
    rank = mo.walk_forward_rank(x, folds, ["roe", "net_margin"])
    j = preds.join(rank.select("date", "ticker", "score_rank_model"), ["date", "ticker"]).join(p, ["date", "ticker"])
    ic = {r["signal"]: r["mean_rank_ic"] for r in st.evaluate_signals(j, ["score_ml", "score_linear", "score_rank_model"], 1, 1).collect()}
    assert min(ic.values()) > 0.4
    test_dates = {r["date"] for r in folds.filter("role = 'test'").select("date").distinct().collect()}
    assert {r["date"] for r in preds.select("date").distinct().collect()} == test_dates


def test_test_labels_never_reach_the_scores(spark):
    p = planted(spark, 1.0, dates=16)
    folds = mo.walk_forward_splits(p, 10, 6, 0)
    last = day(30 * 10)
    changed = p.withColumn("fwd_excess", F.when(F.col("date") >= last, -F.col("fwd_excess")).otherwise(F.col("fwd_excess")))
    out = [mo.walk_forward_predict(mo.design(q, ["roe"]), folds, ["roe"], params={"maxIter": 2})[0].orderBy("date", "ticker").collect() for q in (p, changed)]
    assert [r["score_linear"] for r in out[0]] == pytest.approx([r["score_linear"] for r in out[1]])


def test_registry_is_append_only_and_gives_one_look(spark, tmp_path):
    reg = pr.Registry(spark, str(tmp_path / "reg"), "2020-01-01")
    r = spark.createDataFrame([(day(30 * i), 0.01 * (i % 5)) for i in range(40)], "date date, ret double")
    a, b = (reg.register("fam", "d", {"x": 1}, r) for _ in range(2))
    assert a.endswith(":0") and b.endswith(":1") and a[:-2] == b[:-2] and reg.trials().count() == 2
    with pytest.raises(pr.HoldoutViolation):
        reg.register("fam", "d", {"x": 2}, spark.createDataFrame([(dt.date(2020, 1, 1), 0.1)], "date date, ret double"))
    with pytest.raises(pr.HoldoutViolation):
        reg.final_test(a, lambda: {})
    with pytest.raises(RuntimeError, match="boom"):
        reg.one_look("t", lambda: (_ for _ in ()).throw(RuntimeError("boom")))
    with pytest.raises(pr.HoldoutViolation):          # the crashed run counted as a look
        reg.one_look("t", lambda: {})
    assert reg.one_look("t", lambda: {"summary": {}}, force=True)["looks"] == 2


def test_two_writers_never_share_a_run_or_a_look(spark, tmp_path, monkeypatch):
    """Both read the registry before either writes: the count they see is the same."""
    root = str(tmp_path / "reg")
    a, b = (pr.Registry(spark, root, "2020-01-01") for _ in range(2))
    r = spark.createDataFrame([(day(30 * i), 0.01 * (i % 5)) for i in range(10)], "date date, ret double")
    seen = a.trials()
    monkeypatch.setattr(b, "trials", lambda: seen.limit(0))
    no_looks = spark.createDataFrame([], a.looks().schema)
    monkeypatch.setattr(b, "looks", lambda: no_looks)
    ids = [w.register("fam", "d", {"x": 1}, r) for w in (a, b, a, b)]
    assert sorted(i[-2:] for i in ids) == [":0", ":1", ":2", ":3"] and a.trials().count() == 4 and a.returns().count() == 40
    a.one_look("t", lambda: {})
    with pytest.raises(pr.HoldoutViolation):
        b.one_look("t", lambda: {})
    assert b.one_look("t", lambda: {}, force=True)["looks"] == 2


def test_a_run_without_its_trial_does_not_count(spark, tmp_path):
    reg = pr.Registry(spark, str(tmp_path / "reg"), "2020-01-01")
    r = spark.createDataFrame([(day(30 * i), 0.01 * (i % 5)) for i in range(10)], "date date, ret double")
    reg._claim(f"run {pr.variant_base('fam', {'x': 1})}:0")          # a writer that crashed after its returns
    r.selectExpr("'fam:crashed:0' AS variant_id", "date", "ret").write.parquet(f"{reg.root}/returns")
    assert reg.register("fam", "d", {"x": 1}, r).endswith(":1") and reg.returns().select("variant_id").distinct().count() == 1


def test_inner_split_is_purged_and_a_leak_is_refused(spark):
    dates = [(0, day(i)) for i in range(20)] + [(0, day(3))] + [(1, day(i)) for i in range(4)]
    got = {(r["fold"], r["date"]): r["part"] for r in mo.inner_split(spark.createDataFrame(dates, "fold int, date date"), 0.25, 3).collect()}
    assert [got[0, day(i)] for i in range(20)] == ["fit"] * 12 + ["purged"] * 3 + ["check"] * 5
    assert [got[1, day(i)] for i in range(4)] == ["fit", "purged", "purged", "check"]
    fit, check = (spark.createDataFrame([(a, b)], "signal_pos int, exit_pos int") for a, b in ((1, 9), (9, 12)))
    with pytest.raises(mo.Leak):
        mo.assert_purged(fit, check)
    mo.assert_purged(fit.withColumn("exit_pos", F.lit(8)), check)


def test_brier_of_a_model_with_a_curve_per_row(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    n, grid = 300, [2, 5, 9, 14]
    dur, ev, scale = rng.integers(1, 20, n), rng.integers(0, 2, n), rng.uniform(3, 20, n)
    curve = np.exp(-np.array(grid)[None, :] / scale[:, None])
    order = np.unique(dur)
    at_risk = np.array([(dur >= t).sum() for t in order])
    g = np.cumprod(1 - np.array([((dur == t) & (ev == 0)).sum() for t in order]) / at_risk)
    cens = lambda t: max(g[order <= t][-1], 1e-3) if (order <= t).any() else 1.0
    want = [np.mean([s * s / cens(d) if d <= t and e else (1 - s) ** 2 / cens(t) if d > t else 0 for d, e, s in zip(dur, ev, curve[:, i])]) for i, t in enumerate(grid)]
    df = spark.createDataFrame([(int(a), int(b), [float(x) for x in c]) for a, b, c in zip(dur, ev, curve)], "duration int, event int, curve array<double>")
    got = st.model_brier(df, df, "curve", grid).first()["integrated_brier"]
    assert got == pytest.approx(np.trapezoid(want, grid) / (grid[-1] - grid[0]))


def test_threshold_takes_all_unless_a_cut_is_better(spark):
    rows = [(float(i) / 200, 1.0 if i > 150 else -0.5) for i in range(200)]
    df = spark.createDataFrame(rows, "p_target double, r_multiple double")
    assert mo.choose_threshold(df, min_trades=30) >= 0.7
    assert mo.choose_threshold(df.withColumn("r_multiple", F.lit(0.5)), min_trades=30) == 0.0


def test_overlap_lags_and_embargo():
    assert [st.overlap_lags(63, 21), st.overlap_lags(20, 21), st.overlap_lags(64, 21)] == [2, 0, 3]
    assert [st.embargo_dates(10, 5), st.embargo_dates(11, 5)] == [3, 4]


def test_folds_with_too_few_rows_keep_their_test_rows(spark):
    p = planted(spark, 1.0, dates=16)
    folds = mo.walk_forward_splits(p, 10, 6, 0)
    x = mo.design(p, ["roe"])
    for got, score in ((mo.walk_forward_predict(x, folds, ["roe"], min_rows=10_000)[0], "score_ml"), (mo.walk_forward_rank(x, folds, ["roe"], min_rows=10_000), "score_rank_model")):
        rows = got.collect()
        assert len(rows) == 360 and all(r[score] is None and r["reason"] == "fewer than 10000 training rows" for r in rows)


def test_probabilities_without_enough_rows_are_null_with_a_reason(spark):
    c = planted(spark, 1.0, dates=16).withColumn("signal_pos", F.datediff("date", F.lit(day(0)))).select(
        "date", "ticker", "signal_pos", F.lit("time").alias("outcome"), (F.col("signal_pos") + 1).alias("exit_pos"), (F.col("fwd_excess") > 0).cast("int").alias("y"), F.col("fwd_excess").alias("r_multiple"), "roe")
    folds = mo.walk_forward_splits(c, 10, 6, 0)
    none = mo.walk_forward_probabilities(c, folds, ["roe"], min_rows=10_000).collect()
    assert len(none) == 360 and all(r["p_target"] is None and r["threshold"] is None and r["reason"] == "fewer than 10000 training rows" for r in none)
    part = mo.walk_forward_probabilities(c, folds, ["roe"], min_rows=590).collect()
    assert len(part) == 360 and all(r["p_target"] is not None and r["threshold"] is None and r["reason"].startswith("no threshold") for r in part)


def test_importances_are_those_of_the_registered_model(spark, sf, monkeypatch):
    from pitspark.plans import q_models as qm

    fits = []

    def fit(x, folds, features, **kw):
        fits.append(kw)
        preds = spark.createDataFrame([(day(1), "t", 0, 0.5, 0.4, None)], "date date, ticker string, fold int, score_ml double, score_linear double, reason string")
        return preds, spark.createDataFrame([("a", 0.25), ("b", 0.75)], "feature string, mean_gain double")

    monkeypatch.setattr(qm.mo, "walk_forward_predict", fit)
    monkeypatch.setattr(qm, "design_table", lambda *_: None)
    monkeypatch.setattr(qm, "_folds", lambda *_: None)
    where = sf + "/importances_of_one_fit"
    assert [tuple(r) for r in qm.m14(spark, where).collect()] == [("b", 0.75), ("a", 0.25)]
    assert [r["score_ml"] for r in qm.m2(spark, where).collect()] == [0.5]
    assert fits == [{}]


def test_cut_tables_show_the_planner_their_size(spark):
    from pitspark.session import cut_lineage

    few = cut_lineage(spark.range(10 ** 7).filter("id < 3"))
    assert few.count() == 3 and few._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 10 ** 6


def test_rows_of_a_fold_and_contrasts_do_not_move(spark):
    from pitspark.session import cut_lineage

    x = cut_lineage(spark.range(2000).selectExpr("date_add(date'2020-01-01', int(id % 20)) AS date", "concat('T', id) AS ticker", "rand(1) AS f", "(id % 100) / 100D AS target_rank"))
    folds = cut_lineage(mo.walk_forward_splits(x, 5, 3, 1))
    train, test = mo._parts(x, folds, 0, "target_rank")
    for df in (train, test, mo.grade_contrasts(train, ["f"])):
        df.count()
        assert "SortMergeJoin" not in df._jdf.queryExecution().executedPlan().toString()
