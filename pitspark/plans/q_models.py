"""Registered queries: folds, models, registry protocol, scans, sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import facts as fx, features as ft, insider as ins, models as mo, outcomes as oc, protocol as pr, rules as ru, sinks as sk, stats as st, xsection as xs
from ..session import cut_lineage, stage
from ..sources import bench as bv, scans as sn
from .catalog import query, rounded, tidy
from .oracle_views import VIEWS
from .q_filings import _screen
from .q_prices import _SIG, _candidates, _walk, roll
from .q_stats import _AS_MODEL, avg_rank, model_panel, unit_rank_sql

FEATS = list(_AS_MODEL)
MIN_TRAIN, TEST, EVERY = 20, 12, bv.EVERY

# --- M ------------------------------------------------------------------------------------------------------

_EMB = max(st.overlap_lags(bv.LABEL, EVERY) + 1, 2)
VIEWS["folds"] = f"""
WITH d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM panel)),
f AS (SELECT range AS fold, {MIN_TRAIN + _EMB} + range * {TEST} AS s FROM range(1000) WHERE {MIN_TRAIN + _EMB} + range * {TEST} < (SELECT max(n) FROM d))
SELECT CAST(fold AS INTEGER) AS fold, date, 'train' AS role FROM f JOIN d ON d.i < s - {_EMB} UNION ALL SELECT CAST(fold AS INTEGER), date, 'test' FROM f JOIN d ON d.i >= s AND d.i < s + {TEST}"""


def _folds(spark, sf):
    return mo.model_splits(bv.panel(spark, sf), bv.LABEL, EVERY, MIN_TRAIN, TEST, 2)


@query("m1_walk_forward_splits", "SELECT * FROM folds")
def m1(spark, sf):
    return _folds(spark, sf)


@bv.staged
def design_table(spark, sf):
    return mo.design(model_panel(spark, sf), FEATS)


@bv.staged
def tree_fits(spark, sf):
    """Predictions and mean importances of one walk-forward fit; rows of importances have a feature."""
    preds, importance = mo.walk_forward_predict(design_table(spark, sf), _folds(spark, sf), FEATS)
    return preds.unionByName(importance, allowMissingColumns=True)


def predictions(spark, sf):
    return tree_fits(spark, sf).filter("feature IS NULL").drop("feature", "mean_gain")


@query("m2_walk_forward_trees")
def m2(spark, sf):
    return tidy(predictions(spark, sf))


@query("m14_top_features")
def m14(spark, sf):
    """Importances of the fits that ``m2_walk_forward_trees`` predicts with."""
    return tidy(mo.top_features(tree_fits(spark, sf).filter("feature IS NOT NULL").withColumnRenamed("mean_gain", "gain")))


_SCORED = """
WITH t AS (SELECT fold, count(*) >= 200 AS fits FROM folds JOIN panel USING (date) WHERE role = 'train' AND fwd_excess IS NOT NULL GROUP BY 1)
SELECT f.fold, count(*) AS rows, count(DISTINCT f.date) AS dates, CAST(sum(coalesce(fits, false)::INT) AS BIGINT) AS scored FROM folds f JOIN panel USING (date) LEFT JOIN t USING (fold) WHERE f.role = 'test' GROUP BY 1"""


def _scored(p, score):
    return p.groupBy("fold").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("date").alias("dates"), F.count(score).alias("scored"))


@query("m2_scored_rows", _SCORED)
def m2_rows(spark, sf):
    """Every test row is there once, scored wherever its fold could be fitted."""
    return _scored(predictions(spark, sf), "score_ml")


@query("m4_scored_rows", _SCORED)
def m4_rows(spark, sf):
    return _scored(rank_predictions(spark, sf), "score_rank_model")


@query("m14_importance_total", f"SELECT {len(FEATS)} AS features, 1.0::DOUBLE AS total, count(*) > 0 AS fitted FROM (SELECT fold FROM folds JOIN panel USING (date) WHERE role = 'train' AND fwd_excess IS NOT NULL GROUP BY 1 HAVING count(*) >= 200)")
def m14_total(spark, sf):
    """Mean gains of all features, whose shares add up to one."""
    g = tree_fits(spark, sf).filter("feature IS NOT NULL")
    return g.agg(F.countDistinct("feature").cast("int").alias("features"), (F.round(F.sum("mean_gain"), 6) + 0.0).alias("total"), (F.count(F.lit(1)) > 0).alias("fitted"))


@query("m3_ridge_normal_equations", f"""
WITH x AS (SELECT p.ticker, p.date, {', '.join(f'coalesce({unit_rank_sql(s)}, 0.5) AS {n}' for n, s in _AS_MODEL.items())}, {unit_rank_sql('fwd_excess')} AS y FROM panel p)
SELECT f.fold, count(*) AS rows, round(avg(y), 6) + 0.0 AS mean_y, round(covar_pop(momentum_12_1, y), 6) + 0.0 AS cov_momentum, round(avg(momentum_12_1), 6) + 0.0 AS mean_momentum, 0.0::DOUBLE AS worst_gradient
FROM x JOIN folds f ON f.date = x.date AND f.role = 'train' WHERE y IS NOT NULL GROUP BY 1""")
def m3(spark, sf):
    """Per fold: training moments, and the largest gradient of the ridge objective at the fitted coefficients."""
    x, folds = design_table(spark, sf), cut_lineage(_folds(spark, sf))
    out = None
    for fold in mo.fold_numbers(folds):
        train, _ = mo._parts(x, folds, fold, "target_rank")
        beta = mo.ridge_fit(train, FEATS, "target_rank")
        r = mo.ridge_predict(train, FEATS, beta, "_hat").withColumn("_e", F.col("target_rank") - F.col("_hat"))
        grads = [F.abs(F.sum(F.col("_e") * F.col(f)) - float(b)) for f, b in zip(FEATS, beta[1:])] + [F.abs(F.sum("_e"))]
        got = r.agg(F.count(F.lit(1)).alias("rows"), F.avg("target_rank").alias("mean_y"), F.covar_pop("momentum_12_1", "target_rank").alias("cov_momentum"),
                    F.avg("momentum_12_1").alias("mean_momentum"), F.greatest(*grads).alias("worst_gradient")).withColumn("fold", F.lit(fold))
        out = got if out is None else out.unionByName(got)
    return tidy(out)


@bv.staged
def rank_predictions(spark, sf):
    return mo.walk_forward_rank(design_table(spark, sf), _folds(spark, sf), FEATS)


@query("m4_walk_forward_rank")
def m4(spark, sf):
    return tidy(rank_predictions(spark, sf))


@query("m5_rank_average", f"""
SELECT ticker, date, round(({avg_rank('momentum')} / count(momentum) OVER (PARTITION BY date) + {avg_rank('return_4w')} / count(return_4w) OVER (PARTITION BY date)) / 2, 6) + 0.0 AS score_ensemble FROM panel""")
def m5(spark, sf):
    return tidy(mo.rank_average(bv.panel(spark, sf), ["momentum", "return_4w"]), "ticker", "date", "score_ensemble")


META = ["stop_dist_pct", "target_dist_pct", "atr_pct"]


@bv.staged
def meta_candidates(spark, sf):
    """Breakdown-style candidates with levels, outcomes and geometry features."""
    c = _candidates(spark, sf)
    c = oc.grid_levels(c, F.lit(2.0), F.lit(1.5))
    walked = oc.walk_barriers(c, bv.grid(spark, sf), "stop", "target", 8)
    return walked.select("date", "ticker", F.col("pos").alias("signal_pos"), "outcome", "exit_pos", "y", "r_multiple", ((F.col("close") - F.col("stop")) / F.col("close")).alias("stop_dist_pct"),
                         ((F.col("target") - F.col("close")) / F.col("close")).alias("target_dist_pct"), (F.col("atr_14d") / F.col("close")).alias("atr_pct"))


_META_EMB = st.embargo_dates(8, 4)


def _meta_folds(spark, sf):
    return mo.walk_forward_splits(meta_candidates(spark, sf), 24, 26, _META_EMB)


@bv.staged
def meta_probabilities(spark, sf):
    return mo.walk_forward_probabilities(meta_candidates(spark, sf), _meta_folds(spark, sf), META, embargo=_META_EMB)


@query("m6_m7_meta_labels")
def m6(spark, sf):
    return tidy(meta_probabilities(spark, sf))


VIEWS["meta"] = f"""
WITH {_SIG}, lv AS (SELECT *, close - 2 * atr AS stop, close + 1.5::DOUBLE * (close - (close - 2 * atr)) AS target FROM cand), {_walk(8)}
SELECT ticker, date, pos, outcome, CASE WHEN outcome <> 'skipped' THEN pos + 1 + k END AS exit_pos, CASE WHEN outcome <> 'skipped' THEN CAST(outcome = 'target' AS INTEGER) END AS y FROM tr"""
VIEWS["meta_folds"] = f"""
WITH d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM meta)),
f AS (SELECT range AS fold, {24 + _META_EMB} + range * 26 AS s FROM range(1000) WHERE {24 + _META_EMB} + range * 26 < (SELECT max(n) FROM d))
SELECT CAST(fold AS INTEGER) AS fold, date, 'train' AS role FROM f JOIN d ON d.i < s - {_META_EMB} UNION ALL SELECT CAST(fold AS INTEGER), date, 'test' FROM f JOIN d ON d.i >= s AND d.i < s + 26"""
VIEWS["meta_train"] = """
WITH t AS (SELECT f.fold, min(m.pos) AS first, count(*) AS rows FROM meta_folds f JOIN meta m USING (date) WHERE f.role = 'test' GROUP BY 1)
SELECT f.fold, m.date, m.pos, m.exit_pos, m.y, t.rows FROM meta_folds f JOIN meta m USING (date) JOIN t USING (fold) WHERE f.role = 'train' AND m.outcome <> 'skipped' AND m.exit_pos < t.first"""


@query("m7_inner_split", f"""
WITH n AS (SELECT fold, date, count(*) AS trades FROM meta_train GROUP BY 1, 2), i AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY date) - 1 AS i, floor(count(*) OVER (PARTITION BY fold) * 0.75::DOUBLE) AS cut FROM n)
SELECT fold, date, CASE WHEN i >= cut THEN 'check' WHEN i < greatest(cut - {_META_EMB}, 1) THEN 'fit' ELSE 'purged' END AS part, trades FROM i""")
def m7(spark, sf):
    """Which training dates of every fold a threshold's model learns from, and which it is checked on."""
    trades = mo.training_trades(meta_candidates(spark, sf), _meta_folds(spark, sf))
    per_date = trades.groupBy("fold", "date").agg(F.count(F.lit(1)).alias("trades"))
    return per_date.join(mo.inner_split(trades, 0.25, _META_EMB), ["fold", "date"]).select("fold", "date", "part", "trades")


@query("m6_scored_rows", """
WITH t AS (SELECT fold, count(*) >= 200 AND count(DISTINCT y) = 2 AS fits FROM meta_train GROUP BY 1)
SELECT f.fold, count(*) AS rows, CAST(sum(coalesce(fits, false)::INT) AS BIGINT) AS probabilities FROM meta_folds f JOIN meta m USING (date) LEFT JOIN t USING (fold) WHERE f.role = 'test' GROUP BY 1""")
def m6_rows(spark, sf):
    """Every test candidate is there once, with a probability wherever its fold could be fitted."""
    p = meta_probabilities(spark, sf)
    return p.groupBy("fold").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("p_target").between(0, 1)).alias("probabilities"))


@bv.staged
def survival_panel(spark, sf):
    from .q_stats import survival_rows

    s = survival_rows(spark, sf).select("ticker", F.col("signal_date").alias("date"), "duration", "event")
    b = bv.bars(spark, sf).select("ticker", "date", ft.trailing_return(12).alias("ret12"), ft.drawdown_from_high(52).alias("drawdown"))
    sup = bv.table(spark, sf, "supplier").select(bv.ticker_of("s_suppkey").alias("ticker"), F.when(F.col("s_nationkey") % 3 == 0, "finance").when(F.col("s_nationkey") % 3 == 1, "retail").otherwise("unknown").alias("sector"))
    return s.join(b, ["ticker", "date"]).join(sup, "ticker").withColumns({"valuation_pct": F.lit(None).cast("double"), "price_only": F.col("drawdown").isNull()})


@query("m10_survival_design", f"""
WITH b AS (SELECT ticker, date, close / lag(close, 12) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret12, CASE WHEN mh > 0 THEN 1 - close / mh END AS dd FROM (SELECT *, {roll('max', 'high', 52)} AS mh FROM bars_i)),
s AS (SELECT ticker, signal_date AS date FROM surv), n AS (SELECT 'S' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS ticker, s_nationkey % 3 AS k FROM supplier),
j AS (SELECT s.*, round(b.ret12, 8) AS r, dd, k FROM s JOIN b USING (ticker, date) JOIN n USING (ticker))
SELECT ticker, date, round(coalesce({unit_rank_sql('r')}, 0.5), 6) + 0.0 AS ret12, round(coalesce(dd, 0.25), 6) + 0.0 AS drawdown_depth, 0.5::DOUBLE AS valuation_level, (dd IS NULL)::INT::DOUBLE AS price_only_flag,
  {', '.join(f"({dict(finance='k = 0', retail='k = 1').get(s, 'false')})::INT::DOUBLE AS sector_{s}" for s in mo.SECTORS)} FROM j""")
def m10(spark, sf):
    x, cols = mo.survival_design(survival_panel(spark, sf).withColumn("ret12", F.round("ret12", 8)), ["ret12"])
    return tidy(x, "ticker", "date", *cols)


@query("m9_m11_survival_forecast")
def m9(spark, sf):
    """Weibull fit on the first years, forecasts of the later ones."""
    p = survival_panel(spark, sf)
    x, cols = mo.survival_design(p, ["ret12"])
    x = x.join(p.select("ticker", "date", "duration", "event"), ["ticker", "date"])
    model, used = mo.fit_aft(x.filter(F.col("date") < "1999-01-01"), cols)
    rows = mo.aft_curve_params(model, x.filter(F.col("date") >= "1999-01-01"), used)
    out = mo.expected_annualized_return(rows, 0.1, -0.05, cap=40 * 5, step=5)
    return tidy(out, "ticker", "date", "p_hit_6m", "p_hit_12m", "median_months", "expected_return", "expected_annualized_return")


@query("m9_forecast_bounds", """
SELECT count(*) AS rows, count(DISTINCT ticker) AS tickers, true AS probabilities_rise, true AS returns_bounded FROM surv JOIN (SELECT DISTINCT ticker, date FROM bars) b ON b.ticker = surv.ticker AND b.date = surv.signal_date WHERE signal_date >= DATE '1999-01-01'""".replace("DISTINCT ticker)", "DISTINCT surv.ticker)"))
def m9_bounds(spark, sf):
    """Every later row has a forecast; chances rise with the horizon and returns lie between failure and target."""
    p = m9(spark, sf)
    rise = (F.col("p_hit_6m") >= 0) & (F.col("p_hit_6m") <= F.col("p_hit_12m")) & (F.col("p_hit_12m") <= 1)
    return p.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("ticker").alias("tickers"), F.min(rise).alias("probabilities_rise"), F.min(F.col("expected_return").between(-0.05, 0.1)).alias("returns_bounded"))


@query("m11_expected_return_closed_form", """
WITH r AS (SELECT s_suppkey, 100.0 + s_suppkey % 900 AS scale, 0.8 + (s_suppkey % 7) / 10 AS shape FROM supplier),
g AS (SELECT r.*, t.range AS t, exp(-pow(t.range / scale, shape)) AS s, exp(-pow((t.range + 21) / scale, shape)) AS s2 FROM r CROSS JOIN range(0, 2520, 21) t),
a AS (SELECT s_suppkey, scale, shape, sum((s + s2) / 2 * 21) AS area, least(min(CASE WHEN s <= 0.5 THEN t END), min(CASE WHEN s2 <= 0.5 THEN t + 21 END)) / 21 AS median_months FROM g GROUP BY 1, 2, 3),
e AS (SELECT *, (1 - exp(-pow(2520 / scale, shape))) * 0.3 + exp(-pow(2520 / scale, shape)) * -0.1 AS er FROM a)
SELECT s_suppkey, round(1 - exp(-pow(252 / scale, shape)), 6) + 0.0 AS p_hit_12m, round(median_months, 6) + 0.0 AS median_months, round(er, 6) + 0.0 AS expected_return,
  round(pow(1 + er, 1 / greatest(area / 252, 1.0 / 12)) - 1, 6) + 0.0 AS expected_annualized_return FROM e""")
def m11(spark, sf):
    k = F.col("s_suppkey")
    rows = bv.table(spark, sf, "supplier").select("s_suppkey", (100.0 + k % 900).alias("scale"), (0.8 + (k % 7) / 10).alias("shape"))
    return tidy(mo.expected_annualized_return(rows, 0.3, -0.1), "s_suppkey", "p_hit_12m", "median_months", "expected_return", "expected_annualized_return")


@bv.staged
def variant_scores(spark, sf):
    """Every model's out-of-fold score on the rows all of them cover."""
    p = bv.panel(spark, sf).select("date", "ticker", "fwd_excess", "fwd_return", "momentum")
    x = p.join(predictions(spark, sf).select("date", "ticker", "score_ml", "score_linear"), ["date", "ticker"]).join(rank_predictions(spark, sf).select("date", "ticker", "score_rank_model"), ["date", "ticker"])
    x = x.dropna(subset=["score_ml", "score_linear", "score_rank_model"])
    return mo.rank_average(x, ["score_ml", "score_linear", "score_rank_model"])


VARIANTS = ["score_ml", "score_linear", "score_rank_model", "score_ensemble", "momentum"]


@query("m12_variant_grid")
def m12(spark, sf):
    """Models x scores on the same out-of-fold rows: IC statistics per variant."""
    return tidy(st.evaluate_signals(variant_scores(spark, sf), VARIANTS, bv.LABEL, EVERY))


@query("m12_variant_rows", """
WITH t AS (SELECT fold FROM folds JOIN panel USING (date) WHERE role = 'train' AND fwd_excess IS NOT NULL GROUP BY 1 HAVING count(*) >= 200)
SELECT v.variant, count(*) AS rows, count(DISTINCT f.date) AS dates, true AS whole FROM folds f JOIN t USING (fold) JOIN panel p USING (date) CROSS JOIN (VALUES ('score_ml'), ('score_linear'), ('score_rank_model'), ('score_ensemble'), ('momentum')) v(variant) WHERE f.role = 'test' GROUP BY 1""")
def m12_rows(spark, sf):
    """Every variant is compared on the same rows: those of the folds that could be fitted."""
    x = variant_scores(spark, sf)
    long = x.select("date", "ticker", "fwd_excess", *[F.col(v).cast("double").alias(v) for v in VARIANTS]).unpivot(["date", "ticker", "fwd_excess"], VARIANTS, "variant", "score")
    known = F.col("score").isNotNull() | (F.col("variant") == "momentum")
    return long.groupBy("variant").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("date").alias("dates"), F.min(known).alias("whole"))


@query("m13_feature_check", "SELECT column_name AS feature, column_name IN ('fwd_return', 'fwd_excess', 'label', 'date', 'ticker', 'target') OR starts_with(column_name, 'fwd_') OR starts_with(column_name, 'score_') AS forbidden, n AS known_rows "
       "FROM (UNPIVOT (SELECT count(date) AS date, count(ticker) AS ticker, count(fwd_excess) AS fwd_excess, count(momentum) AS momentum, count(volume_ratio) AS volume_ratio FROM panel) ON date, ticker, fwd_excess, momentum, volume_ratio INTO NAME column_name VALUE n)")
def m13(spark, sf):
    """Which panel columns the model may use, with their known rows."""
    p = bv.panel(spark, sf)
    cols = ["date", "ticker", "fwd_excess", "momentum", "volume_ratio"]

    def refused(c: str) -> bool:
        try:
            xs.check_features([c])
            return False
        except ValueError:
            return True

    counts = p.agg(*[F.count(c).alias(c) for c in cols]).unpivot([], cols, "feature", "known_rows")
    bad = [c for c in cols if refused(c)]
    return counts.select("feature", F.col("feature").isin(bad).alias("forbidden"), "known_rows")


# --- E2, E3, I2, I3 --------------------------------------------------------------------------------------------

@query("e2_earnings_surprise_events", """
WITH one AS (SELECT 'S' || lpad(CAST(cik AS VARCHAR), 9, '0') AS ticker, filed, arg_max(sue, "end") AS sue FROM sue GROUP BY 1, 2), m AS (SELECT DISTINCT date, ticker FROM panel), d AS (SELECT DISTINCT date FROM m),
e AS (SELECT o.filed, o.ticker, round(o.sue, 9) AS sue FROM one o ASOF JOIN d ON o.filed >= d.date JOIN m ON m.date = d.date AND m.ticker = o.ticker),
t AS (SELECT f.filed, count(*) AS n, quantile_cont(e.sue, 0.9) AS q FROM (SELECT DISTINCT filed FROM e) f JOIN e ON e.filed < f.filed AND e.filed >= f.filed - 365 GROUP BY 1)
SELECT e.filed AS signal_date, e.ticker, round(e.sue, 6) + 0.0 AS strength FROM e JOIN t USING (filed) WHERE n >= 100 AND e.sue >= q""")
def e2(spark, sf):
    s = fx.sue_series(bv.company_facts(spark, sf)).select(bv.ticker_of("cik").alias("ticker"), "filed", "end", F.round("sue", 9).alias("sue"))
    return tidy(ru.earnings_surprise_events(s, bv.panel(spark, sf).select("date", "ticker").distinct()))


@query("e2_trailing_percentile", """
WITH v AS (SELECT CAST(ts AS DATE) AS d, value AS v FROM events)
SELECT f.d, count(*) AS n, round(quantile_cont(v.v, 0.9), 6) + 0.0 AS threshold FROM (SELECT DISTINCT d FROM v) f JOIN v ON v.d < f.d AND v.d >= f.d - 7 GROUP BY 1""")
def e2p(spark, sf):
    """Ninetieth percentile of all event values of the previous seven days, per day."""
    return tidy(ru.trailing_percentile(bv.table(spark, sf, "events").select(F.to_date("ts").alias("d"), "value"), "d", "value", 0.9, 7))


@query("e3_cheap_quality_trend", """
WITH m AS (SELECT ticker, date, close, CASE WHEN count(close) OVER w = 20 THEN avg(close) OVER w END AS ma FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING))
SELECT s.date AS signal_date, s.ticker, s.drawdown + 0.0 AS strength FROM screen s ASOF JOIN m ON s.ticker = m.ticker AND s.date >= m.date WHERE s.is_candidate AND m.close > m.ma""")
def e3(spark, sf):
    return tidy(ru.cheap_quality_trend_events(_screen(spark, sf), bv.bars(spark, sf), 20), digits=8)


@query("i2_step_features", """
WITH k AS (SELECT p.ticker, p.date, m.issuer_cik AS ik FROM panel p LEFT JOIN issuer_map m ON m.ticker = p.ticker), b AS (SELECT k.ticker, k.date, count(DISTINCT t.owner_cik) AS n FROM k LEFT JOIN tx t ON t.issuer_cik = k.ik AND t.filing_date <= k.date AND t.filing_date > k.date - 90 AND t.trans_code = 'P' GROUP BY 1, 2),
f AS (SELECT DISTINCT cik, accession, filing_date FROM phist WHERE ticker IS NOT NULL),
l AS (SELECT d.date, f.cik, f.accession FROM (SELECT DISTINCT date FROM k) d JOIN f ON f.filing_date <= d.date AND f.filing_date >= d.date - 200 QUALIFY row_number() OVER (PARTITION BY d.date, f.cik ORDER BY f.filing_date DESC) = 1),
w AS (SELECT l.date, h.ticker, max(CASE WHEN status IN ('NEW', 'ADDED') THEN 1.0::DOUBLE ELSE 0.0 END) AS a FROM phist h JOIN l ON l.cik = h.cik AND l.accession = h.accession WHERE h.ticker IS NOT NULL GROUP BY 1, 2)
SELECT k.ticker, k.date, CASE WHEN ik IS NOT NULL THEN CAST(n AS DOUBLE) END AS insider_buyers_90d, CASE WHEN k.date IN (SELECT date FROM l) THEN coalesce(w.a, 0) END AS active_new_or_add
FROM k JOIN b ON b.ticker = k.ticker AND b.date = k.date LEFT JOIN w ON w.date = k.date AND w.ticker = k.ticker""")
def i2(spark, sf):
    from ..operators import holdings as hd
    from .q_filings import _positions

    p = bv.panel(spark, sf).select("ticker", "date")
    x = ins.insider_features(p, bv.transactions(spark, sf), bv.issuer_map(spark, sf))
    return hd.active_manager_features(x, _positions(spark, sf)).select("ticker", "date", "insider_buyers_90d", "active_new_or_add")


@query("i3_transaction_source", """
SELECT trans_code, count(*) AS rows, count(DISTINCT issuer_cik) AS issuers, round(sum(value), 2) + 0.0 AS value FROM tx WHERE issuer_cik % 2 = 0 GROUP BY 1""")
def i3(spark, sf):
    """The per-issuer table chosen over the bulk one; same columns either way."""
    tx = bv.transactions(spark, sf)
    return tidy(sn.load_transactions(spark, "issuer", bulk=tx, per_issuer=tx.filter("issuer_cik % 2 = 0")).groupBy("trans_code").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("issuer_cik").alias("issuers"), F.sum("value").alias("value")), digits=2)


# --- S: scans over files Spark writes from the tables -------------------------------------------------------------

def _written(spark, sf, name, write):
    """Path of a file set written once per application under the shared folder."""
    import uuid

    from ..session import ensure_checkpoint_dir

    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _PATHS:
        ensure_checkpoint_dir(spark)
        path = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/files/{uuid.uuid4().hex}"
        write(path)
        _PATHS[key] = path
    return _PATHS[key]


_PATHS: dict = {}


@query("s4_insider_bulk_tsv", """
SELECT CAST(o_orderkey AS VARCHAR) AS accession, CAST(o_orderdate AS DATE) AS filing_date, o_custkey % 50 AS issuer_cik, o_custkey AS owner_cik, CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN 'P' ELSE 'S' END AS trans_code,
  CAST(o_custkey % 500 + 1 AS DOUBLE) AS shares, CASE WHEN o_orderkey % 10 <> 4 THEN 12.5::DOUBLE END AS price, CASE WHEN o_orderkey % 10 <> 4 THEN (o_custkey % 500 + 1) * 12.5::DOUBLE END AS value
FROM orders WHERE o_orderstatus <> 'P' AND substr(o_orderpriority, 1, 1) <> '5' AND o_orderkey % 7 <> 0""")
def s4(spark, sf):
    """Three tab-separated tables written from orders, then scanned and joined."""
    o = bv.table(spark, sf, "orders")
    day = F.date_format("o_orderdate", "dd-MMM-yyyy")
    key = F.col("o_orderkey").cast("string").alias("ACCESSION_NUMBER")
    code = F.substring("o_orderpriority", 1, 1)

    def write(path):
        out = lambda df, n: df.write.option("sep", "\t").option("header", True).option("quote", "").csv(f"{path}/{n}")
        out(o.select(key, F.upper(day).alias("FILING_DATE"), F.when(F.col("o_orderkey") % 7 == 0, "4/A").otherwise("4").alias("DOCUMENT_TYPE"), (F.col("o_custkey") % 50).alias("ISSUERCIK")), "sub")
        out(o.select(key, F.col("o_custkey").alias("RPTOWNERCIK"), F.when(F.col("o_orderstatus") == "P", "TenPercentOwner").when(F.col("o_orderstatus") == "F", "Director").otherwise("Officer,Other")
                     .alias("RPTOWNER_RELATIONSHIP")), "own")
        out(o.select(key, day.alias("TRANS_DATE"), F.when(code.isin("1", "2"), "P").when(code == "5", "A").otherwise("s").alias("TRANS_CODE"), (F.col("o_custkey") % 500 + 1).alias("TRANS_SHARES"),
                     F.when(F.col("o_orderkey") % 10 == 4, "n/a").otherwise("12.5").alias("TRANS_PRICEPERSHARE")), "tr")

    p = _written(spark, sf, "insider_tsv", write)
    return sn.insider_bulk(spark, f"{p}/sub", f"{p}/own", f"{p}/tr").select("accession", "filing_date", "issuer_cik", "owner_cik", "trans_code", "shares", "price", "value")


@query("s5_insider_quarter_range", """
SELECT count(*) AS rows, min(filing_date) AS first_day, max(filing_date) AS last_day, DATE '1998-06-30' AS coverage_end FROM tx WHERE filing_date >= DATE '1997-04-01' AND filing_date <= DATE '1998-06-30'""")
def s5(spark, sf):
    path = _written(spark, sf, "insider_quarters", lambda p: sn.write_insider_quarters(bv.transactions(spark, sf), p))
    tx, end = sn.insider_range(spark, path, "1997-05-10", "1998-05-10")
    return tx.agg(F.count(F.lit(1)).alias("rows"), F.min("filing_date").alias("first_day"), F.max("filing_date").alias("last_day")).withColumn("coverage_end", end.scalar())


@query("s6_insider_xml", """
SELECT CAST(o_orderkey AS VARCHAR) AS accession, o_custkey + r AS owner_cik, CAST(o_custkey % 50 AS BIGINT) AS issuer_cik, CASE WHEN o_orderstatus = 'F' THEN 'P' ELSE 'S' END AS trans_code,
  CAST(o_custkey % 100 AS DOUBLE) AS shares, (o_custkey % 100) * 2.5::DOUBLE AS value FROM orders CROSS JOIN range(2) t(r) WHERE o_orderstatus <> 'P' AND (r = 0 OR o_orderkey % 2 = 0)""")
def s6(spark, sf):
    """XML filings with two owners (the second qualifies in every other filing) and one transaction."""
    owner = lambda cik, director: (f"<reportingOwner><reportingOwnerId><rptOwnerCik>', {cik}, '</rptOwnerCik></reportingOwnerId><reportingOwnerRelationship><isDirector>', {director}, "  # noqa: E731
                                   "'</isDirector><isOfficer>0</isOfficer></reportingOwnerRelationship></reportingOwner>")
    xml = F.expr("concat('<ownershipDocument><issuer><issuerCik>', o_custkey % 50, '</issuerCik></issuer>" + owner("o_custkey", "'1'") + owner("o_custkey + 1", "case when o_orderkey % 2 = 0 then 'true' else '0' end") +
                 "<nonDerivativeTable><nonDerivativeTransaction><transactionDate><value>', date_format(o_orderdate, 'yyyy-MM-dd'), '</value></transactionDate><transactionCoding><transactionCode>', "
                 "case o_orderstatus when 'F' then 'P' when 'O' then 's' else 'A' end, '</transactionCode></transactionCoding><transactionAmounts><transactionShares><value>', o_custkey % 100, "
                 "'</value></transactionShares><transactionPricePerShare><value>2.5</value></transactionPricePerShare></transactionAmounts></nonDerivativeTransaction></nonDerivativeTable></ownershipDocument>')")
    docs = bv.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("accession"), F.to_date("o_orderdate").alias("filing_date"), xml.alias("xml"))
    return sn.form4_xml(docs).select("accession", "owner_cik", "issuer_cik", "trans_code", "shares", "value")


@query("s7_s8_information_tables", """
SELECT c_nationkey AS cik, l_suppkey AS s, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS shares, CAST(sum(CAST(floor(l_extendedprice) AS BIGINT)) AS DOUBLE) AS value
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_returnflag <> 'R' AND l_linestatus = 'F' GROUP BY 1, 2""")
def s7(spark, sf):
    """One XML information table per customer, options and bonds included, merged to one row per filer and cusip."""
    li, o, c = (bv.table(spark, sf, t) for t in ("lineitem", "orders", "customer"))
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
    entry = F.expr("concat('<ns1:infoTable><ns1:nameOfIssuer>N', l_suppkey, '</ns1:nameOfIssuer><ns1:titleOfClass>COM</ns1:titleOfClass><ns1:cusip>c', l_suppkey, '</ns1:cusip><ns1:value>', format_number(floor(l_extendedprice), 0), "
                   "'</ns1:value><ns1:shrsOrPrnAmt><ns1:sshPrnamt>', cast(l_quantity as bigint), '</ns1:sshPrnamt><ns1:sshPrnamtType>', case when l_linestatus = 'F' then 'SH' else 'PRN' end, '</ns1:sshPrnamtType></ns1:shrsOrPrnAmt>', "
                   "case when l_returnflag = 'R' then '<ns1:putCall>Put</ns1:putCall>' else '' end, '</ns1:infoTable>')")
    # One document per order keeps every document small, whoever holds most of the rows.
    docs = j.groupBy(F.col("c_nationkey").alias("cik"), "o_orderkey").agg(F.concat(F.lit('<ns1:informationTable xmlns:ns1="urn:x">'), F.array_join(F.sort_array(F.collect_list(entry)), ""), F.lit("</ns1:informationTable>")).alias("xml"))
    rows = sn.information_tables(docs.withColumn("accession", F.concat(F.lit("F"), F.col("cik").cast("string"))))
    from ..operators import holdings as hd

    return hd.merge_books(rows).select("cik", F.expr("cast(substring(cusip, 2) as bigint)").alias("s"), "shares", "value")


@query("s9_xbrl_json", "SELECT cik, ns, tag, start, \"end\", round(val, 2) + 0.0 AS val, filed, form FROM raw_facts")
def s9(spark, sf):
    """Company documents assembled from the facts as JSON, then flattened again."""
    r = bv.raw_facts(spark, sf)
    row = F.struct(F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"), "val", F.col("filed").cast("string").alias("filed"), "form", F.lit("a").alias("accn"))
    # One document per issuer and tag: an issuer's facts never have to meet in one row.
    tags = r.groupBy("cik", "ns", "tag").agg(F.collect_list(row).alias("rows"))
    doc = F.struct("cik", F.map_from_arrays(F.array("ns"), F.array(F.map_from_arrays(F.array("tag"), F.array(F.struct(F.map_from_arrays(F.array(F.lit("USD")), F.array("rows")).alias("units")))))).alias("facts"))
    return tidy(sn.xbrl_facts(tags.select(F.to_json(doc).alias("json"))).drop("unit"), digits=2)


_STATEMENT_ROWS = {"income_stmt": {"Total Revenue": ("k % 4 <> 3", "rev"), "TotalRevenue": ("k % 4 = 3 OR k % 9 = 0", "CASE WHEN k % 9 = 0 THEN rev * 2 ELSE rev END"), "Gross Profit": ("true", "rev * 0.4 - qty"),
                                   "Operating Income": ("true", "rev * 0.2 - qty * 2"), "Net Income": ("true", "CASE WHEN (k + y) % 13 <> 0 THEN ni END"), "Basic EPS": ("k % 5 = 0", "ni / (1000 + k)"),
                                   "Diluted EPS": ("k % 5 <> 0", "ni / (1000 + k)"), "Interest Expense": ("true", "-qty * 3"), "Tax Provision": ("true", "qty * 5"), "Pretax Income": ("true", "rev * 0.15")},
                   "cashflow": {"Operating Cash Flow": ("true", "rev * (10 - tn) / 100"), "Capital Expenditure": ("true", "-qty * 100"), "Free Cash Flow": ("k % 3 = 0 AND y > 1996", "rev * 0.05")},
                   "balance_sheet": {"Cash And Cash Equivalents": ("true", "qty * 500"), "Stockholders Equity": ("true", "rev * 0.5"), "Total Debt": ("k % 7 <> 0", "rev * 0.1")}}


@query("s10_statement_flatten", " UNION ALL ".join(
    f"SELECT ticker, '{stmt}' AS statement, '{item}' AS line_item, period_end, round({value}, 1) + 0.0 AS value FROM stm_q WHERE {where}" for stmt, items in _STATEMENT_ROWS.items() for item, (where, value) in items.items()))
def s10(spark, sf):
    """All statements as nested maps per ticker, with a period that is no date in each item, flattened to long rows again."""
    s = bv.statements(spark, sf)
    # a map holds a period once: of two rows of one name the larger stays, as the readers of these rows take it
    s = s.groupBy("ticker", "statement", "line_item", "period_end").agg(F.max("value").alias("value"))
    entries = lambda k, v: F.map_from_entries(F.collect_list(F.struct(k, v)))
    items = s.groupBy("ticker", "statement", "line_item").agg(entries(F.col("period_end").cast("string"), F.col("value")).alias("p"))    # one entry per fiscal year
    odd = F.map_concat("p", F.create_map(F.lit("not a date"), F.lit(1.0)))
    payload = items.withColumn("p", odd).groupBy("ticker", "statement").agg(entries("line_item", "p").alias("p")).groupBy("ticker").agg(entries("statement", "p").alias("payload"))
    return tidy(sn.statement_rows(payload), "ticker", "statement", "line_item", "period_end", "value", digits=1)


@query("s11_s12_section_and_chunk_scan", "SELECT ticker, count(*) AS chunks, sum(length(text)) AS chars FROM chunks GROUP BY 1")
def s12(spark, sf):
    path = _written(spark, sf, "chunks", lambda p: bv.chunks(spark, sf).write.option("compression", "zstd").parquet(p))
    return sn.chunk_table(spark, path).groupBy("ticker").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("text")).alias("chars"))


@query("s13_document_metadata", """
SELECT 'DOC_' || doc_id AS ticker, CASE WHEN doc_id % 3 = 0 THEN '10-Q' WHEN doc_id % 3 = 1 THEN '20-F' END AS filing_type, CASE doc_id % 4 WHEN 0 THEN DATE '2019-03-05' WHEN 1 THEN DATE '2018-12-31' WHEN 2 THEN DATE '2020-02-29' END AS filing_date,
  CASE WHEN doc_id % 2 = 0 THEN '0001234567-20-000001' END AS accession_number FROM documents""")
def s13(spark, sf):
    i = F.col("doc_id")
    head = F.concat(F.when(i % 3 == 0, "Form 10-q report\n").when(i % 3 == 1, "Annual 20-F\n").otherwise("report\n"),
                    F.when(i % 4 == 0, "Filed on March 5, 2019\n").when(i % 4 == 1, "for the fiscal year ended december 31, 2018\n").when(i % 4 == 2, "dated 2020-02-29 x\n").otherwise("no date\n"),
                    F.when(i % 2 == 0, "Accession Number: 0001234567-20-000001\n").otherwise("\n"), "text")
    d = bv.table(spark, sf, "documents").select(F.format_string("a/b/doc_%d.txt", i).alias("source_file"), head.alias("text"))
    return sn.document_metadata(d).select("ticker", "filing_type", "filing_date", "accession_number")


@query("s14_report_corpus", """
SELECT 'rep/' || source || '/outlook_' || doc_id || '.txt' AS source_path, CASE WHEN doc_id % 5 = 0 THEN 'Side Inst' ELSE source END AS institution, CASE WHEN doc_id % 5 = 0 THEN 'Side Title' ELSE 'Outlook ' || doc_id END AS report_title,
  CASE WHEN doc_id % 10 = 0 THEN DATE '2021-01-01' ELSE DATE '2019-03-05' END AS publication_date, sha256('As of March 5, 2019. ' || text) AS content_hash FROM documents WHERE doc_id % 8 <> 7""")
def s14(spark, sf):
    i = F.col("doc_id")
    path = F.concat(F.lit("rep/"), "source", F.lit("/outlook_"), i.cast("string"), F.lit(".txt"))
    d = bv.table(spark, sf, "documents").select("doc_id", path.alias("source_path"), F.when(i % 8 == 7, "  ").otherwise(F.concat(F.lit("As of March 5, 2019. "), "text")).alias("text"))
    side = d.filter(i % 5 == 0).select("source_path", F.lit("Side Inst").alias("institution"), F.lit("Side Title").alias("report_title"), F.when(i % 10 == 0, F.to_date(F.lit("2021-01-01"))).alias("publication_date"))
    return sn.report_corpus(d.select("source_path", "text"), side).select("source_path", "institution", "report_title", "publication_date", "content_hash")


@query("s15_news_rows", r"SELECT upper(role) AS ticker, upper(role) || '_NEWS_' || substr(sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))), 1, 12) AS chunk_id, count(*) AS n FROM conversations GROUP BY 1, 2")
def s15(spark, sf):
    h = bv.table(spark, sf, "conversations").select(F.col("role").alias("ticker"), F.col("text").alias("title"), F.lit(None).cast("date").alias("published_at"), F.lit(None).cast("string").alias("publisher"))
    return sn.news_rows(h).groupBy("ticker", "chunk_id").agg(F.count(F.lit(1)).alias("n"))


@query("s16_entity_list", "SELECT n_name AS institution, CAST(n_nationkey AS BIGINT) AS cik FROM nation")
def s16(spark, sf):
    path = _written(spark, sf, "filers", lambda p: bv.table(spark, sf, "nation").select(F.col("n_name").alias("institution"), F.col("n_nationkey").alias("cik")).write.option("header", True).csv(p))
    return sn.entity_list(spark, path, {})


@query("s17_gated_scan", f"SELECT ticker, date, {rounded('close')} FROM bars WHERE date < DATE '2000-01-01'")
def s17(spark, sf):
    return tidy(sn.gated(bv.bars(spark, sf), "date", "2000-01-01"), "ticker", "date", "close")


@query("s18_latest_filing_by_form", """
SELECT cik, form, filing_date, accession FROM sections QUALIFY row_number() OVER (PARTITION BY cik ORDER BY CASE form WHEN '10-K' THEN 0 ELSE 1 END, filing_date DESC, accession DESC) = 1""")
def s18(spark, sf):
    return sn.latest_filing_by_form(bv.sections(spark, sf).select("cik", "form", "filing_date", "accession")).select("cik", "form", "filing_date", "accession")


@query("s19_filing_list", """
SELECT accession, cik, form, filing_date FROM sections WHERE filing_date >= DATE '2010-01-01' AND CAST(substr(accession, 2) AS BIGINT) % 10 <> 0""")
def s19(spark, sf):
    n = F.expr("cast(substring(accession, 2) as bigint)")
    f = bv.sections(spark, sf).select("cik", "accession", "form", "filing_date", F.when(n % 10 != 0, F.concat("accession", F.lit(".htm"))).alias("primary_document"), F.lit(1).alias("listed_no"))
    return sn.filing_list(f.unionByName(f.withColumn("listed_no", F.lit(2))), "2010-01-01").select("accession", "cik", "form", "filing_date")


@query("s20_decode_bytes", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'caf' || chr(233) || ' ' || chr(8364) ELSE text END AS text FROM documents")
def s20(spark, sf):
    """Valid UTF-8 documents mixed with Windows-1252 bytes."""
    from ..operators import text as tx

    raw = F.when(F.col("doc_id") % 3 == 0, F.unhex(F.lit("636166E92080"))).otherwise(F.encode("text", "UTF-8"))
    return tx.decode_bytes(bv.table(spark, sf, "documents").select("doc_id", raw.alias("raw")), "raw").select("doc_id", "text")


# --- K: sinks -------------------------------------------------------------------------------------------------------

@query("k1_stage", "SELECT ticker, count(*) AS rows FROM bars GROUP BY 1")
def k1(spark, sf):
    """A stage written once and read back."""
    return stage(lambda: bv.bars(spark, sf).groupBy("ticker").agg(F.count(F.lit(1)).alias("rows")), spark, f"rows per ticker:{sf}")


@query("k2_merge_signals", """
WITH o AS (SELECT chunk_id, signal_type, 'ev' || (event_id % 3) AS evidence, strength, event_id FROM signals), old AS (SELECT * FROM o WHERE event_id % 2 = 0), new AS (SELECT * FROM o WHERE event_id % 2 = 1),
u AS (SELECT *, 0 AS b FROM old UNION ALL SELECT *, 1 FROM new) SELECT chunk_id, signal_type, evidence, arg_max(event_id, (b, event_id)) AS event_id FROM u GROUP BY 1, 2, 3""")
def k2(spark, sf):
    s = bv.signals(spark, sf).select("chunk_id", "signal_type", F.concat(F.lit("ev"), (F.col("event_id") % 3).cast("string")).alias("evidence"), "event_id", F.col("event_id").alias("batch_row"))
    return sk.merge_keep_last(s.filter("event_id % 2 = 0"), s.filter("event_id % 2 = 1"), sk.SIGNAL_KEY).select("chunk_id", "signal_type", "evidence", "event_id")


@query("k3_merge_mentions", """
WITH m AS (SELECT chunk_id, company_name, theme, 'e' AS evidence, view_direction FROM mentions), n AS (SELECT chunk_id, company_name, theme, evidence, 'NEUTRAL' AS view_direction FROM m WHERE view_direction = 'POSITIVE')
SELECT coalesce(n.chunk_id, m.chunk_id) AS chunk_id, m.company_name, m.theme, coalesce(n.view_direction, m.view_direction) AS view_direction FROM m LEFT JOIN n ON n.chunk_id = m.chunk_id""")
def k3(spark, sf):
    m = bv.mentions(spark, sf).select("chunk_id", "company_name", "theme", F.lit("e").alias("evidence"), "view_direction")
    n = m.filter(F.col("view_direction") == "POSITIVE").withColumn("view_direction", F.lit("NEUTRAL"))
    return sk.merge_keep_last(m, n, sk.MENTION_KEY).select("chunk_id", "company_name", "theme", "view_direction")


@query("k4_replace_slice", """
WITH m AS (SELECT institution, CASE WHEN CAST(substr(chunk_id, 2) AS BIGINT) % 2 = 0 THEN '13F' ELSE 'note' END AS report_type, chunk_id FROM mentions)
SELECT * FROM m WHERE NOT (report_type = '13F' AND institution IN ('Inst 1', 'Inst 2')) UNION ALL SELECT institution, '13F', 'new ' || institution FROM (SELECT DISTINCT institution FROM m WHERE institution IN ('Inst 1', 'Inst 2'))""")
def k4(spark, sf):
    n = F.expr("cast(substring(chunk_id, 2) as bigint)")
    m = bv.mentions(spark, sf).select("institution", F.when(n % 2 == 0, "13F").otherwise("note").alias("report_type"), "chunk_id")
    new = m.filter(F.col("institution").isin("Inst 1", "Inst 2")).select("institution").distinct().select("institution", F.lit("13F").alias("report_type"), F.concat(F.lit("new "), "institution").alias("chunk_id"))
    return sk.replace_slice(m, new)


@query("k5_chunk_violations", r"""
WITH c AS (SELECT 'c' || (doc_id % 900) AS chunk_id, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS h FROM documents)
SELECT 'error' AS severity, chunk_id AS key, count(*) AS rows FROM c GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'warning', h, count(*) FROM c GROUP BY 2 HAVING count(*) > 1""")
def k5(spark, sf):
    from ..operators import text as tx

    d = bv.table(spark, sf, "documents").select(F.concat(F.lit("c"), (F.col("doc_id") % 900).cast("string")).alias("chunk_id"), tx.content_hash(F.col("text")).alias("content_hash"))
    return sk.chunk_violations(d)


@query("k6_z5_variant_ids", """
SELECT 'fam:' || substr(sha1('{"nation": ' || c_nationkey || ', "segment": "' || c_mktsegment || '"}'), 1, 10) || ':' || (row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) - 1) AS variant_id, c_custkey FROM customer""")
def k6(spark, sf):
    """Ids of many runs at once; a repeated parameter set gets the next run number."""
    from ..operators.ranks import row_position

    c = bv.table(spark, sf, "customer").withColumn("params", F.format_string('{"nation": %d, "segment": "%s"}', "c_nationkey", "c_mktsegment"))
    c = row_position(c.select("params", "c_custkey"), ["params"], ["c_custkey"], "_rn").withColumn("run_no", F.col("_rn") - 1).withColumn("family", F.lit("fam"))
    return pr.variant_ids(c).select("variant_id", "c_custkey")


@query("k7_k8_export_and_ranking_cache", "SELECT n_nationkey AS rank, n_name AS ticker FROM nation")
def k7(spark, sf):
    """A ranking written to its partition and read back by key."""
    def write(p):
        r = bv.table(spark, sf, "nation").select(F.col("n_nationkey").alias("rank"), F.col("n_name").alias("ticker"))
        sk.save_ranking(r, f"{p}/cache", 91, "2024-01-05", "u1")
        sk.save_ranking(r.withColumn("rank", F.col("rank") + 100), f"{p}/cache", 14, "2024-01-05", "u1")
        sk.export_json(r, f"{p}/json")

    path = _written(spark, sf, "ranking", write)
    return sk.load_ranking(spark, f"{path}/cache", 91, "2024-01-05", "u1")


@query("k7_json_export", f"SELECT ticker, date, {rounded('close momentum score fwd_excess', 8)} FROM panel")
def k7_json(spark, sf):
    """The panel exported as JSON lines, read back by its schema; a missing value stays missing."""
    p = bv.panel(spark, sf).select("ticker", "date", "close", "momentum", "score", "fwd_excess")
    path = _written(spark, sf, "panel json", lambda at: sk.export_json(p, at))
    return tidy(spark.read.schema(p.schema).json(path), "ticker", "date", "close", "momentum", "score", "fwd_excess", digits=8)


# --- Z ---------------------------------------------------------------------------------------------------------------

@query("z2_common_dates", "SELECT variant_id, date, round(ret, 6) + 0.0 AS ret FROM reg WHERE date IN (SELECT date FROM reg GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT variant_id) FROM reg))")
def z2(spark, sf):
    from .q_stats import registry_returns

    return tidy(st.common_dates(registry_returns(spark, sf)))


_RUN = """
WITH t AS (SELECT * FROM reg WHERE variant_id IN ('nation:1', 'nation:2')), p AS (SELECT variant_id AS name, count(*) AS months, avg(ret) AS m, stddev_samp(ret) AS sd, pow(product(1 + ret), 12 / count(*)) - 1 AS annualized FROM t GROUP BY 1)"""


def _protocol(spark, sf):
    """A registry with two variants, a promotion and looks; and what was refused, by name."""
    from .q_stats import registry_returns

    root = _written(spark, sf, "registry", lambda p: None)
    reg = pr.Registry(spark, root, "2002-01-01")
    if (root, "outcomes") not in _PATHS:
        def refused(step) -> bool:
            try:
                step()
            except pr.HoldoutViolation:
                return True
            return False

        r = registry_returns(spark, sf).filter(F.col("date") < "2002-01-01")
        own = lambda name: r.filter(F.col("variant_id") == name).select("date", "ret")
        ids = [reg.register("nation", f"mean return of {name}", {"nation": name}, own(name)) for name in ("nation:1", "nation:2")]
        late = own("nation:1").withColumn("date", F.lit("2002-01-01").cast("date")).limit(1)
        found = {"a return of the holdout is refused": refused(lambda: reg.register("nation", "late", {"nation": "late"}, late))}
        found["a test before the promotion is refused"] = refused(lambda: reg.final_test(ids[0], dict))
        for vid in ids:
            reg.promote(vid)
        # the final test of the best variant runs if and only if it was promoted
        promoted = {row["candidate"]: row["promoted"] for row in reg.promotions().collect()}      # one row a variant
        found["the final test follows the promotion"] = all(refused(lambda v=v: reg.final_test(v, lambda: {"summary": {}})) != promoted[v] for v in ids)
        reg.one_look("addendum", lambda: {"summary": {"rows": 2}})
        found["a second look is refused"] = refused(lambda: reg.one_look("addendum", dict))
        found["a forced look is marked"] = reg.one_look("addendum", lambda: {"summary": {}}, force=True)["looks"] == 2
        _PATHS[root, "outcomes"] = found
    return reg, _PATHS[root, "outcomes"]


@query("z1_z3_z4_protocol_run", _RUN + """
SELECT 'nation:' || substr(sha1('{"nation": "' || name || '"}'), 1, 10) || ':0' AS variant_id, 'nation' AS family, months, round(m / sd * sqrt(12.0::DOUBLE), 6) + 0.0 AS sharpe, round(annualized, 6) + 0.0 AS annualized FROM p""")
def z3(spark, sf):
    """Register two variants, promote, test; the registered trials."""
    reg, _ = _protocol(spark, sf)
    return tidy(reg.trials().select("variant_id", "family", "months", "sharpe", "annualized"))


@query("z3_z4_decisions", _RUN + """
SELECT step, true AS ok FROM (VALUES ('a return of the holdout is refused'), ('a test before the promotion is refused'), ('the final test follows the promotion'), ('a second look is refused'), ('a forced look is marked')) v(step)
UNION ALL SELECT 'decisions recorded', count(*) = 2 FROM p UNION ALL SELECT 'looks of the addendum', true""")
def z4(spark, sf):
    """What the protocol decided and refused, as rows."""
    reg, found = _protocol(spark, sf)
    steps = spark.createDataFrame(list(found.items()), "step string, ok boolean")
    bars = F.coalesce((F.col("dsr") > pr.MIN_DSR) & (F.col("pbo") < pr.MAX_PBO), F.lit(False))
    decided = reg.promotions().agg((F.countDistinct("candidate") == 2).alias("a"), F.min(F.col("promoted") == bars).alias("b")).select(F.lit("decisions recorded").alias("step"), (F.col("a") & F.col("b")).alias("ok"))
    looks = reg.looks().filter("test_id = 'addendum' AND state = 'started'").agg((F.sort_array(F.collect_list("forced")) == F.array(F.lit(False), F.lit(True))).alias("ok")).select(F.lit("looks of the addendum").alias("step"), "ok")
    return steps.unionByName(decided).unionByName(looks)
