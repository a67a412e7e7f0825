"""Registered queries: cross-sections, evaluation statistics, resampling, portfolio series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asof, outcomes as oc, portfolio as pf, resample as rs, stats as st, xsection as xs
from ..operators.ranks import equal_count_bucket, percent_rank_average
from ..sources import bench as bv
from .catalog import ORACLES, query, rounded, tidy
from .oracle_views import VIEWS
from .q_prices import _TARGETS, _TRADES, _target_outcomes, breakout_trades

SIGNALS = ["momentum", "return_4w", "price_vs_ma20", "score"]
PANEL_FEATURES = ["return_4w", "return_12w", "return_52w", "volatility_12w", "volume_ratio", "price_vs_ma20", "momentum"]


def avg_rank(col: str, part: str = "date") -> str:
    return (f"CASE WHEN {col} IS NOT NULL THEN rank() OVER (PARTITION BY {part}, {col} IS NULL ORDER BY {col}) + "
            f"(count(*) OVER (PARTITION BY {part}, {col}) - 1) / 2.0::DOUBLE END")


def unit_rank_sql(col: str, part: str = "date") -> str:
    n = f"count({col}) OVER (PARTITION BY {part})"
    return f"CASE WHEN {col} IS NULL THEN NULL WHEN {n} = 1 THEN 0.5::DOUBLE ELSE ({avg_rank(col, part)} - 1) / ({n} - 1) END"


def bucket_sql(rn: str, n: str, q: int) -> str:
    return f"CAST(CASE WHEN {n} = 1 THEN 0 ELSE greatest(0, ceil(({rn} - 1) * {q} / ({n} - 1)) - 1) END AS INTEGER)"


def phi(z: str) -> str:
    """Normal distribution function by its all-positive series, accurate for the |z| met here."""
    return (f"CASE WHEN ({z}) > 8 THEN 1.0::DOUBLE WHEN ({z}) < -8 THEN 0.0::DOUBLE ELSE 0.5 + sign({z}) * exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * "
            f"list_sum(list_transform(range(0, 160), lambda k: exp((2 * k + 1) * ln(greatest(abs({z}), 1e-12)) - (k + 1) * ln(2) - lgamma(k + 1.5) + 0.5 * ln(pi())))) END")


def ppf(p: str) -> str:
    """Normal quantile by halving [-8, 8] sixty times."""
    half = "(a[1] + a[2]) / 2"
    return f"list_reduce(list_prepend([-8.0::DOUBLE, 8.0::DOUBLE], list_transform(range(0, 60), lambda i: [0.0::DOUBLE, 0.0::DOUBLE])), lambda a, b: CASE WHEN {phi(half)} < {p} THEN [{half}, a[2]] ELSE [a[1], {half}] END)[1]"


# --- Q ------------------------------------------------------------------------------------------------------

@query("q1_cross_sectional_rank", "SELECT ticker, date, " + ", ".join(f"round({unit_rank_sql(c)}, 6) + 0.0 AS {c}" for c in PANEL_FEATURES) + " FROM panel")
def q1(spark, sf):
    return tidy(xs.cross_sectional_rank(bv.panel(spark, sf), PANEL_FEATURES))


@query("q2_per_date_rank", f"SELECT ticker, date, round({avg_rank('score')} / count(score) OVER (PARTITION BY date), 6) + 0.0 AS pct FROM panel")
def q2(spark, sf):
    return tidy(percent_rank_average(bv.panel(spark, sf), ["date"], "score", "pct"), "ticker", "date", "pct")


_AS_MODEL = {"return_20d": "return_4w", "return_60d": "return_12w", "return_252d": "return_52w", "volatility_60d": "volatility_12w",
             "volume_ratio": "volume_ratio", "price_vs_ma50": "price_vs_ma20", "momentum_12_1": "momentum"}


def model_panel(spark, sf):
    """The panel under the model's feature names."""
    p = bv.panel(spark, sf)
    return p.select("date", "ticker", "fwd_return", "fwd_excess", "score", *[F.col(src).alias(name) for name, src in _AS_MODEL.items()])


@query("q3_q4_feature_matrix", "SELECT ticker, date, " + ", ".join(f"round({unit_rank_sql(src)}, 6) + 0.0 AS {name}" for name, src in _AS_MODEL.items())
       + f", CAST(NULL AS DOUBLE) AS roe, round({unit_rank_sql('fwd_excess')}, 6) + 0.0 AS target_rank FROM panel")
def q3(spark, sf):
    p = model_panel(spark, sf)
    x = xs.feature_matrix(p, [*_AS_MODEL, "roe"])
    return tidy(x.join(xs.target_rank(p), ["date", "ticker"]))


@query("q5_industry_relative", """
WITH p AS (SELECT p.*, n.s_nationkey % 5 AS ind FROM panel p JOIN supplier n ON p.ticker = 'S' || lpad(CAST(n.s_suppkey AS VARCHAR), 9, '0'))
SELECT ticker, date, round(CASE WHEN count(momentum) OVER w >= 3 THEN momentum - median(momentum) OVER w END, 9) + 0.0 AS momentum_ind,
  round(CASE WHEN count(volume_ratio) OVER w >= 3 THEN volume_ratio - median(volume_ratio) OVER w END, 9) + 0.0 AS volume_ratio_ind FROM p WINDOW w AS (PARTITION BY date, ind)""")
def q5(spark, sf):
    s = bv.table(spark, sf, "supplier").select(bv.ticker_of("s_suppkey").alias("ticker"), (F.col("s_nationkey") % 5).alias("ind"))
    return tidy(xs.industry_relative(bv.panel(spark, sf).join(s, "ticker"), ["momentum", "volume_ratio"], "ind"), digits=9)


@query("q6_relevance_grade", f"SELECT ticker, date, CAST(floor(least(greatest(r, 0), 0.999999) * 10) AS INTEGER) AS grade FROM (SELECT ticker, date, round({unit_rank_sql('fwd_excess')}, 9) AS r FROM panel)")
def q6(spark, sf):
    r = xs.target_rank(bv.panel(spark, sf))
    return r.select("ticker", "date", xs.relevance_grade(F.round("target_rank", 9)).alias("grade"))


@query("q7_prefilter_and_filters", """
SELECT date, cusip, holders, v / 0.2 BETWEEN 3e10 AND 9e10 AS in_band, v / 0.2 BETWEEN 2e10 AND 1e11 AND holders * 4e5 > 1e6 AND holders / 5 > 3 AS passes
FROM (SELECT date, cusip, holders, round(total_13f_value, 2) AS v FROM books)""")
def q7(spark, sf):
    from ..operators import holdings as hd

    h = bv.holdings(spark, sf)
    b = hd.book_values(h, bv.filings(h), bv.month_end_dates(spark, sf)).withColumn("rough_mcap", F.round("total_13f_value", 2) / 0.2)
    band = hd.in_cap_band(b, 3e10, 9e10).select("date", "cusip", F.lit(True).alias("in_band"))
    x = b.withColumns({"market_cap": F.col("rough_mcap"), "dollar_volume_20d": F.col("holders") * 4e5, "raw_price": F.col("holders") / 5})
    return x.join(band, ["date", "cusip"], "left").select("date", "cusip", "holders", F.coalesce("in_band", F.lit(False)).alias("in_band"),
                                                          hd.passes_filters(2e10, 1e11).alias("passes"))


@query("q8_equal_count_buckets", f"""
WITH r AS (SELECT ticker, date, row_number() OVER (PARTITION BY date ORDER BY score, ticker) AS rn, count(*) OVER (PARTITION BY date) AS n FROM panel WHERE score IS NOT NULL)
SELECT ticker, date, {bucket_sql('rn', 'n', 5)} AS quintile, {bucket_sql('rn', 'n', 10)} AS decile FROM r""")
def q8(spark, sf):
    p = bv.panel(spark, sf).filter(F.col("score").isNotNull()).select("ticker", "date", "score")
    a = equal_count_bucket(p, ["date"], "score", ["ticker"], 5, "quintile")
    return equal_count_bucket(a, ["date"], "score", ["ticker"], 10, "decile").select("ticker", "date", "quintile", "decile")


# --- V ------------------------------------------------------------------------------------------------------

VIEWS["per_date"] = f"""
WITH l AS ({' UNION ALL '.join(f"SELECT '{s}' AS signal, date, ticker, {s} AS x, fwd_excess AS y FROM panel WHERE {s} IS NOT NULL AND fwd_excess IS NOT NULL" for s in SIGNALS)}),
r AS (SELECT *, {avg_rank('x', 'signal, date')} AS rx, {avg_rank('y', 'signal, date')} AS ry, row_number() OVER (PARTITION BY signal, date ORDER BY x, ticker) AS rn,
  count(*) OVER (PARTITION BY signal, date) AS n FROM l),
b AS (SELECT *, {bucket_sql('rn', 'n', 5)} AS bk FROM r)
SELECT signal, date, count(*) AS n, corr(rx, ry) AS rank_ic, corr(x, y) AS ic, avg(y) FILTER (bk = 4) AS top_mean, avg(y) FILTER (bk = 0) AS bottom_mean,
  avg((y > 0)::INT) FILTER (bk = 4) AS top_hit_rate, avg(y) FILTER (bk = 4) - avg(y) FILTER (bk = 0) AS spread FROM b GROUP BY 1, 2 HAVING count(*) >= 10 AND min(x) < max(x)"""


def nw_sql(src: str, by: str, order: str, value: str, lags: int) -> str:
    """Statement giving (by, n, mean, t) for a table expression."""
    b = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    terms = " + ".join(f"CASE WHEN {k} <= n - 1 THEN 2 * {1 - k / (lags + 1)!r}::DOUBLE * coalesce(s{k}, 0) / n ELSE 0 END" for k in range(1, lags + 1)) or "0"
    prods = "".join(f", sum(d * l{k}) AS s{k}" for k in range(1, lags + 1))
    lagc = "".join(f", lag(d, {k}) OVER (ORDER BY {order})" .replace("OVER (", f"OVER ({part}") + f" AS l{k}" for k in range(1, lags + 1))
    return f"""SELECT {b}n, mean, CASE WHEN n >= 3 AND s0 / n + {terms} > 0 THEN mean / sqrt((s0 / n + {terms}) / n) END AS t FROM (
  SELECT {b}count(*) AS n, any_value(m) AS mean, sum(d * d) AS s0{prods} FROM (SELECT *{lagc} FROM (
    SELECT *, {value} - avg({value}) OVER ({part}) AS d, avg({value}) OVER ({part}) AS m FROM {src} WHERE {value} IS NOT NULL)) {'GROUP BY ' + by if by else ''})"""


def _per_date(spark, sf):
    return st.per_date_metrics(bv.panel(spark, sf), SIGNALS)


@bv.staged
def per_date_table(spark, sf):
    return _per_date(spark, sf)


@query("v1_per_date_metrics", f"SELECT signal, date, n, {rounded('rank_ic ic spread top_mean bottom_mean top_hit_rate')} FROM per_date")
def v1(spark, sf):
    return tidy(_per_date(spark, sf))


@query("v2_newey_west", f"SELECT signal, n, round(mean, 6) + 0.0 AS mean, round(t, 5) + 0.0 AS t FROM ({nw_sql('per_date', 'signal', 'date', 'rank_ic', 3)})")
def v2(spark, sf):
    x = st.newey_west(per_date_table(spark, sf), ["signal"], "date", "rank_ic", 3)
    return tidy(x.withColumn("t", F.round("t", 5)))


@query("v3_evaluate_signals", f"""
WITH a AS (SELECT signal, count(*) AS dates, round(avg(n), 1) + 0.0 AS avg_names, avg(rank_ic) AS mean_rank_ic, avg((rank_ic > 0)::INT) AS pct_dates_ic_pos, avg(ic) AS mean_ic,
  avg(spread) AS mean_spread, avg(top_hit_rate) AS top_hit_rate FROM per_date GROUP BY 1),
i AS ({nw_sql('per_date', 'signal', 'date', 'rank_ic', 1)}), s AS ({nw_sql('per_date', 'signal', 'date', 'spread', 1)})
SELECT a.signal, dates, avg_names, {rounded('mean_rank_ic pct_dates_ic_pos mean_ic mean_spread top_hit_rate')}, round(i.t, 5) + 0.0 AS rank_ic_tstat_nw, round(s.t, 5) + 0.0 AS spread_tstat_nw
FROM a JOIN i ON a.signal = i.signal JOIN s ON a.signal = s.signal""")
def v3(spark, sf):
    x = st.evaluate_signals(bv.panel(spark, sf), SIGNALS, bv.LABEL, bv.EVERY)
    return tidy(x.withColumn("rank_ic_tstat_nw", F.round("rank_ic_tstat_nw", 5)).withColumn("spread_tstat_nw", F.round("spread_tstat_nw", 5)))


_BUCKETS = "count(*) AS count, round(avg(fwd_excess), 6) + 0.0 AS mean_fwd_excess, round(median(fwd_excess), 9) + 0.0 AS median_fwd_excess, round(avg((fwd_excess > 0)::INT), 6) + 0.0 AS share_beating_benchmark"


def _buckets(df):
    return tidy(df.withColumn("mean_fwd_excess", F.round("mean_fwd_excess", 6)).withColumn("share_beating_benchmark", F.round("share_beating_benchmark", 6)), digits=9)


@query("v4_label_buckets", f"""
SELECT CASE WHEN score IS NULL THEN 'Insufficient data' WHEN score >= 0.3 THEN 'Strong' WHEN score >= 0.1 THEN 'Favorable' WHEN score <= -0.1 THEN 'Unfavorable' ELSE 'Neutral' END AS bucket,
  {_BUCKETS} FROM panel WHERE fwd_excess IS NOT NULL GROUP BY 1""")
def v4(spark, sf):
    return _buckets(st.label_buckets(bv.panel(spark, sf), "score"))


@query("v5_ic_by_year", f"SELECT signal, CAST(year(date) AS INTEGER) AS year, count(*) AS dates, round(avg(rank_ic), 6) + 0.0 AS mean_rank_ic, round(avg(spread), 6) + 0.0 AS mean_spread FROM per_date GROUP BY 1, 2")
def v5(spark, sf):
    return tidy(st.ic_by_year(per_date_table(spark, sf)))


_DIFF = "(SELECT a.date, a.rank_ic - b.rank_ic AS diff FROM per_date a JOIN per_date b ON a.date = b.date WHERE a.signal = 'score' AND b.signal = '{}')"


@query("v7_ic_difference", f"SELECT 'score' AS signal, 'momentum' AS baseline, n, round(mean, 6) + 0.0 AS mean, round(t, 5) + 0.0 AS t FROM ({nw_sql(_DIFF.format('momentum'), '', 'date', 'diff', 2)})")
def v7(spark, sf):
    x = st.ic_difference(per_date_table(spark, sf), "score", "momentum", 2)
    return tidy(x.withColumn("t", F.round("t", 5)))


@query("v8_promotion_check", f"""
SELECT 'beats momentum' AS "check", coalesce(mean > 0 AND t > 2, false) AS ok FROM ({nw_sql(_DIFF.format('momentum'), '', 'date', 'diff', 2)})
UNION ALL SELECT 'beats return_4w', coalesce(mean > 0 AND t > 2, false) FROM ({nw_sql(_DIFF.format('return_4w'), '', 'date', 'diff', 2)})
UNION ALL SELECT 'positive years', count(*) >= 4 AND count(*) FILTER (m > 0) >= 4 FROM (SELECT year(date), avg(rank_ic) AS m FROM per_date WHERE signal = 'score' GROUP BY 1)""")
def v8(spark, sf):
    return st.promotion_check(per_date_table(spark, sf), "score", ["momentum", "return_4w"], 2)


@query("v9_score_quintiles", f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score, ticker) AS rn, count(*) OVER (PARTITION BY date) AS n FROM panel WHERE score IS NOT NULL AND fwd_excess IS NOT NULL),
b AS (SELECT *, {bucket_sql('rn', 'n', 5)} + 1 AS quintile FROM r WHERE n >= 5) SELECT quintile, {_BUCKETS} FROM b GROUP BY 1""")
def v9(spark, sf):
    return _buckets(st.score_quintiles(bv.panel(spark, sf), "score"))


@query("v10_universe_drift", """
WITH d AS (SELECT date, avg(fwd_excess) AS m FROM panel WHERE fwd_excess IS NOT NULL GROUP BY 1)
SELECT CAST(year(date) AS INTEGER) AS year, count(*) AS dates, round(avg(m), 6) + 0.0 AS mean_fwd_excess, abs((SELECT avg(m) FROM d)) > 0.015 AS drift_warning FROM d GROUP BY 1""")
def v10(spark, sf):
    return tidy(st.universe_drift(bv.panel(spark, sf)))


VIEWS["yp"] = "SELECT ticker, date, fwd_excess, CASE WHEN fwd_excess > 0 THEN 1 ELSE 0 END AS y, round(score, 3) AS p FROM panel WHERE fwd_excess IS NOT NULL AND score IS NOT NULL"


def _yp(spark, sf):
    return bv.panel(spark, sf).filter(F.col("fwd_excess").isNotNull() & F.col("score").isNotNull()).select(
        "ticker", "date", F.when(F.col("fwd_excess") > 0, 1).otherwise(0).alias("y"), F.round("score", 3).alias("p"))


@query("v11_auc", f"""
WITH r AS (SELECT y, {avg_rank('p', '1 = 1')} AS rk FROM yp), s AS (SELECT CAST(sum(rk) FILTER (y = 1) AS DOUBLE) AS s, CAST(count(*) FILTER (y = 1) AS DOUBLE) AS a, count(*) FILTER (y = 0) AS b FROM r)
SELECT round((s - a * (a + 1) / 2) / (a * b), 6) + 0.0 AS auc FROM s""")
def v11(spark, sf):
    return tidy(st.auc(_yp(spark, sf), "y", "p"))


@query("v12_calibration_table", f"""
WITH r AS (SELECT *, row_number() OVER (ORDER BY p, ticker, date) AS rn, count(*) OVER () AS n FROM yp)
SELECT {bucket_sql('rn', 'n', 10)} + 1 AS decile, count(*) AS trades, round(avg(p), 6) + 0.0 AS mean_predicted, round(avg(y), 6) + 0.0 AS actual_hit_rate FROM r GROUP BY 1""")
def v12(spark, sf):
    return tidy(st.calibration_table(_yp(spark, sf), "y", "p", ["ticker", "date"]))


_OUT20 = _TARGETS + ", z AS (SELECT ticker, signal_date, CAST(reason = 'target' AS INTEGER) AS event, CAST(xp - f + 1 AS INTEGER) AS duration, (hash_p % 1000) / 1000 AS p FROM (SELECT *, CAST('0x' || substr(md5(ticker || signal_date), 1, 8) AS BIGINT) AS hash_p FROM y WHERE tg = 0.1))"


def _survival_rows(spark, sf):
    out, _ = _target_outcomes(spark, sf, targets=(0.1,))
    h = F.conv(F.substring(F.md5(F.concat("ticker", F.col("signal_date").cast("string"))), 1, 8), 16, 10).cast("long")
    return out.select("ticker", "signal_date", "event", "duration", ((h % 1000) / 1000).alias("p"))


@bv.staged
def survival_rows(spark, sf):
    return _survival_rows(spark, sf)


@query("v12_calibration_12m", f"""{_OUT20}, k AS (SELECT *, CASE WHEN event = 1 AND duration <= 20 THEN 1 ELSE 0 END AS hit FROM z WHERE event = 1 OR duration >= 20),
r AS (SELECT *, row_number() OVER (ORDER BY p, ticker, signal_date) AS rn, count(*) OVER () AS n FROM k)
SELECT {bucket_sql('rn', 'n', 10)} + 1 AS decile, count(*) AS rows, round(avg(p), 6) + 0.0 AS predicted, round(avg(hit), 6) + 0.0 AS actual FROM r GROUP BY 1""")
def v12b(spark, sf):
    return tidy(st.calibration_at_horizon(survival_rows(spark, sf), "p", ["ticker", "signal_date"], 20))


@bv.staged
def trades_table(spark, sf):
    return breakout_trades(spark, sf)


@query("v13_monthly_excess", f"WITH {_TRADES} SELECT CAST(date_trunc('month', entry_date) AS DATE) AS month, round(avg(excess), 6) + 0.0 AS excess FROM trades GROUP BY 1")
def v13(spark, sf):
    return tidy(st.monthly_excess(trades_table(spark, sf)))


@query("v13_trade_tstat", f"WITH {_TRADES}, m AS (SELECT date_trunc('month', entry_date) AS month, avg(excess) AS excess FROM trades GROUP BY 1) "
       f"SELECT n, round(mean, 6) + 0.0 AS mean, round(t, 5) + 0.0 AS t FROM ({nw_sql('m', '', 'month', 'excess', 2)})")
def v13b(spark, sf):
    return tidy(st.trade_tstat(trades_table(spark, sf), 42).withColumn("t", F.round("t", 5)))


_TESTS = f"SELECT signal AS variant, mean AS mean_rank_ic, round(t, 6) AS ic_t FROM ({nw_sql('per_date', 'signal', 'date', 'rank_ic', 1)})"


def _tests(spark, sf):
    pd = per_date_table(spark, sf)
    t = st.newey_west(pd, ["signal"], "date", "rank_ic", 1)
    s = pd.groupBy("signal").agg(F.avg("spread").alias("spread_mean"))
    return t.join(s, "signal").select(F.col("signal").alias("variant"), F.col("mean").alias("mean_rank_ic"), F.round("t", 6).alias("ic_t"), "spread_mean")


VIEWS["holm"] = f"""
WITH t AS ({_TESTS}), p AS (SELECT *, round(2 * (1 - ({phi('abs(ic_t)')})), 12) AS p FROM t),
r AS (SELECT *, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p, variant) + 1) * p) AS raw FROM p)
SELECT variant, ic_t, mean_rank_ic, p, max(raw) OVER (ORDER BY p, variant ROWS UNBOUNDED PRECEDING) AS holm_p FROM r"""


@query("v15_holm", "SELECT variant, round(p, 6) + 0.0 AS p, round(holm_p, 6) + 0.0 AS holm_p FROM holm")
def v15(spark, sf):
    x = _tests(spark, sf).withColumn("p", F.round(st.two_sided_p(F.col("ic_t")), 12))
    return tidy(st.holm_adjust(x, "p", "variant"), "variant", "p", "holm_p")


@query("v16_variant_verdicts", """
WITH s AS (SELECT signal AS variant, avg(spread) AS sm FROM per_date GROUP BY 1), c AS (SELECT h.variant, coalesce(ic_t > 0 AND holm_p < 0.0455002638963584, false) AS a, mean_rank_ic > 0 AS b, sm > 0 AS c FROM holm h JOIN s USING (variant))
SELECT variant, a AS holm_t_above_2, b AS mean_ic_positive, c AS spread_positive, a AND b AND c AS passed FROM c""")
def v16(spark, sf):
    return st.variant_verdicts(_tests(spark, sf)).select("variant", "holm_t_above_2", "mean_ic_positive", "spread_positive", "passed")


@query("v16_text_adds", """
WITH s AS (SELECT signal AS variant, avg(spread) AS sm FROM per_date GROUP BY 1),
v AS (SELECT h.variant, mean_rank_ic, coalesce(ic_t > 0 AND holm_p < 0.0455002638963584, false) AND mean_rank_ic > 0 AND sm > 0 AS passed FROM holm h JOIN s USING (variant))
SELECT a.m AS model, v.passed AS text_passes, round(v.mean_rank_ic, 6) + 0.0 AS ic_text, round(w.mean_rank_ic, 6) + 0.0 AS ic_without_text, v.mean_rank_ic > w.mean_rank_ic AS text_adds,
  CASE WHEN v.passed AND v.mean_rank_ic > w.mean_rank_ic THEN 'PASSED' ELSE 'FAILED' END AS verdict
FROM (VALUES ('trend', 'momentum', 'return_4w'), ('mixed', 'score', 'price_vs_ma20')) a(m, t, b) JOIN v ON v.variant = a.t JOIN v w ON w.variant = a.b""")
def v16b(spark, sf):
    v = st.variant_verdicts(_tests(spark, sf))
    s = F.col("variant")
    v = v.withColumn("model", F.when(s.isin("momentum", "return_4w"), "trend").otherwise("mixed")) \
         .withColumn("features", F.when(s.isin("momentum", "score"), "base+text").otherwise("base"))
    return tidy(st.text_adds_verdict(v, "base+text", "base"))


# Registry returns: one variant per nation, the mean four-week return of its suppliers.
VIEWS["reg"] = """
SELECT 'nation:' || s.s_nationkey AS variant_id, p.date, avg(p.return_4w) AS ret FROM panel p JOIN supplier s ON p.ticker = 'S' || lpad(CAST(s.s_suppkey AS VARCHAR), 9, '0')
WHERE p.return_4w IS NOT NULL GROUP BY 1, 2"""


@bv.staged
def registry_returns(spark, sf):
    s = bv.table(spark, sf, "supplier").select(bv.ticker_of("s_suppkey").alias("ticker"), "s_nationkey")
    return (bv.panel(spark, sf).filter(F.col("return_4w").isNotNull()).join(s, "ticker")
            .groupBy(F.concat(F.lit("nation:"), F.col("s_nationkey").cast("string")).alias("variant_id"), "date").agg(F.avg("return_4w").alias("ret")))


@query("v18_sample_moments", """
SELECT variant_id, count(*) AS months, round(avg(ret) / stddev_samp(ret), 6) + 0.0 AS sharpe, round(skewness(ret), 5) + 0.0 AS skew, round(kurtosis(ret) + 3, 5) + 0.0 AS kurtosis FROM reg GROUP BY 1""")
def v18(spark, sf):
    x = st.sample_moments(registry_returns(spark, sf), ["variant_id"], "ret")
    return tidy(x.withColumn("skew", F.round("skew", 5)).withColumn("kurtosis", F.round("kurtosis", 5)))


_DEFLATED = f"""
WITH m AS (SELECT variant_id, count(*) AS months, avg(ret) / stddev_samp(ret) AS sharpe, skewness(ret) AS skew, kurtosis(ret) + 3 AS kurtosis FROM reg GROUP BY 1), l AS (SELECT count(*) AS k, var_samp(sharpe) AS v FROM m),
q AS (SELECT k, v, 1 - 1 / k AS p1, 1 - 1 / (k * exp(1)) AS p2 FROM l), b AS (SELECT k, sqrt(v) * ((1 - {st.EULER_GAMMA!r}::DOUBLE) * {ppf('p1')} + {st.EULER_GAMMA!r}::DOUBLE * {ppf('p2')}) AS bench FROM q),
z AS (SELECT *, (sharpe - bench) * sqrt(months - 1) / sqrt(greatest(1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe, 1e-12)) AS z FROM m, b)
SELECT variant_id, months, round(sharpe, 5) + 0.0 AS sharpe, round(skew, 5) + 0.0 AS skew, round(kurtosis, 5) + 0.0 AS kurtosis, round(bench, 5) + 0.0 AS benchmark_sharpe, round({phi('z')}, 5) + 0.0 AS dsr, CAST(k AS BIGINT) AS n_trials FROM z"""


@query("v18_deflated_sharpe", _DEFLATED)
def v18b(spark, sf):
    return tidy(st.deflated_sharpe(registry_returns(spark, sf)), digits=5)


@query("v19_pbo_cscv", """
WITH n AS (SELECT count(DISTINCT variant_id) AS n FROM reg), d AS (SELECT date FROM reg GROUP BY 1 HAVING count(*) = (SELECT n FROM n)),
p AS (SELECT date, row_number() OVER (ORDER BY date DESC) - 1 AS i, count(*) OVER () AS t FROM d),
b AS (SELECT date, 15 - i // (t // 16) AS blk FROM p WHERE i < (t // 16) * 16),
s AS (SELECT variant_id, blk, count(*) AS n, sum(ret) AS s, sum(ret * ret) AS ss FROM reg JOIN b USING (date) GROUP BY 1, 2),
m AS (SELECT range AS split FROM range(65536) WHERE bit_count(CAST(range AS BIGINT)) = 8),
g AS (SELECT m.split, s.variant_id, (m.split >> s.blk) & 1 AS side, sum(n) AS n, sum(s) AS s, sum(ss) AS ss FROM m CROSS JOIN s GROUP BY 1, 2, 3),
h AS (SELECT split, variant_id, side, round(CASE WHEN (ss - s * s / n) / (n - 1) > 1e-18 THEN s / n / sqrt((ss - s * s / n) / (n - 1)) ELSE -1e300 END, 12) AS sh FROM g),
w AS (SELECT a.split, a.variant_id, a.sh AS si, o.sh AS so FROM h a JOIN h o ON a.split = o.split AND a.variant_id = o.variant_id WHERE a.side = 1 AND o.side = 0),
bst AS (SELECT split, arg_min(so, (-si, variant_id)) AS bo, count(*) AS nv FROM w GROUP BY 1),
rk AS (SELECT w.split, nv, bo, count(*) FILTER (so < bo) + 0.5 * (count(*) FILTER (so = bo) - 1) + 1 AS r FROM w JOIN bst USING (split) GROUP BY 1, 2, 3),
lg AS (SELECT *, ln((r / (nv + 1)) / (1 - r / (nv + 1))) AS logit FROM rk)
SELECT round(avg((logit <= 0)::INT), 6) + 0.0 AS pbo, count(*) AS combinations, max(nv) AS variants, round(median(logit), 6) + 0.0 AS median_logit, round(avg((bo < 0)::INT), 6) + 0.0 AS p_oos_best_negative FROM lg""")
def v19(spark, sf):
    return tidy(st.pbo_cscv(registry_returns(spark, sf)))


@query("v20_selection_stats", f"SELECT d.*, p.* REPLACE (round(p.pbo, 5) + 0.0 AS pbo, round(p.median_logit, 5) + 0.0 AS median_logit, round(p.p_oos_best_negative, 5) + 0.0 AS p_oos_best_negative) FROM ({_DEFLATED}) d, ({ORACLES['v19_pbo_cscv']}) p")
def v20(spark, sf):
    x = st.selection_stats(registry_returns(spark, sf))
    return tidy(x.withColumns({c: F.round(c, 6) for c in ("pbo", "median_logit", "p_oos_best_negative")}), digits=5)


VIEWS["km_t"] = "SELECT duration AS t, count(*) FILTER (event = 1) AS d, count(*) AS c FROM surv GROUP BY 1"
VIEWS["surv"] = _OUT20 + " SELECT ticker, signal_date, event, duration, p FROM z"
VIEWS["km"] = """
SELECT t, at_risk, d AS deaths, product(1 - d / at_risk) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM
  (SELECT *, CAST(sum(c) OVER (ORDER BY t DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS at_risk FROM km_t)"""


@query("m8_kaplan_meier", "SELECT t, at_risk, deaths, round(s, 6) + 0.0 AS s FROM km")
def m8(spark, sf):
    return tidy(st.kaplan_meier(survival_rows(spark, sf)))


@query("v21_integrated_brier", """
WITH cg AS (SELECT duration AS t, count(*) FILTER (event = 0) AS d, count(*) AS c FROM surv GROUP BY 1),
ck AS (SELECT t, product(1 - d / ar) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, sum(c) OVER (ORDER BY t DESC ROWS UNBOUNDED PRECEDING) AS ar FROM cg)),
tt AS (SELECT x.ta, coalesce(k.s, 1) AS s, coalesce(c.g, 1) AS g FROM (VALUES (4), (8), (12), (20), (28), (36)) x(ta) ASOF LEFT JOIN km k ON x.ta >= k.t ASOF LEFT JOIN ck c ON x.ta >= c.t),
r AS (SELECT s.duration, s.event, coalesce(c.g, 1) AS gd FROM surv s ASOF LEFT JOIN ck c ON s.duration >= c.t),
b AS (SELECT ta, avg(CASE WHEN duration <= ta AND event = 1 THEN s * s / greatest(gd, 1e-3) WHEN duration > ta THEN (1 - s) * (1 - s) / greatest(g, 1e-3) ELSE 0 END) AS b FROM r CROSS JOIN tt GROUP BY 1)
SELECT round(sum((b + nb) / 2 * (nt - ta)) / 32, 6) + 0.0 AS integrated_brier FROM (SELECT ta, b, lead(b) OVER (ORDER BY ta) AS nb, lead(ta) OVER (ORDER BY ta) AS nt FROM b)""")
def v21(spark, sf):
    s = survival_rows(spark, sf)
    return tidy(st.integrated_brier(s, s, st.kaplan_meier(s), [4, 8, 12, 20, 28, 36]))


@query("v21_model_brier", """
WITH cg AS (SELECT duration AS t, count(*) FILTER (event = 0) AS d, count(*) AS c FROM surv GROUP BY 1),
ck AS (SELECT t, product(1 - d / ar) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, sum(c) OVER (ORDER BY t DESC ROWS UNBOUNDED PRECEDING) AS ar FROM cg)),
tt AS (SELECT x.ta, coalesce(c.g, 1) AS g FROM (VALUES (4), (8), (12), (20), (28), (36)) x(ta) ASOF LEFT JOIN ck c ON x.ta >= c.t),
r AS (SELECT s.duration, s.event, s.p, coalesce(c.g, 1) AS gd FROM surv s ASOF LEFT JOIN ck c ON s.duration >= c.t),
x AS (SELECT r.*, ta, g, exp(-pow(ta / (10 + 30 * p), 1.2::DOUBLE)) AS s FROM r CROSS JOIN tt),
b AS (SELECT ta, avg(CASE WHEN duration <= ta AND event = 1 THEN s * s / greatest(gd, 1e-3) WHEN duration > ta THEN (1 - s) * (1 - s) / greatest(g, 1e-3) ELSE 0 END) AS b FROM x GROUP BY 1)
SELECT round(sum((b + nb) / 2 * (nt - ta)) / 32, 6) + 0.0 AS integrated_brier FROM (SELECT ta, b, lead(b) OVER (ORDER BY ta) AS nb, lead(ta) OVER (ORDER BY ta) AS nt FROM b)""")
def v21b(spark, sf):
    """A Weibull curve for every row, its scale from the row's prediction."""
    s, times = survival_rows(spark, sf), [4, 8, 12, 20, 28, 36]
    curve = F.transform(F.array(*[F.lit(float(t)) for t in times]), lambda t: F.exp(-F.pow(t / (10 + 30 * F.col("p")), F.lit(1.2))))
    return tidy(st.model_brier(s.withColumn("curve", curve), s, "curve", times))


@query("v22_concordance", """
WITH c AS (SELECT year(signal_date) AS g, 2 * duration + (1 - event) AS tau, event, p FROM surv),
a AS (SELECT g, tau, event, p, count(*) AS n FROM c GROUP BY 1, 2, 3, 4)
SELECT CAST(i.g AS INTEGER) AS year, round(sum(i.n * j.n * CASE WHEN j.p > i.p THEN 1.0::DOUBLE WHEN j.p = i.p THEN 0.5::DOUBLE ELSE 0 END) / sum(i.n * j.n), 6) + 0.0 AS concordance,
  CAST(sum(i.n * j.n) AS BIGINT) AS pairs FROM a i JOIN a j ON i.g = j.g AND j.tau > i.tau WHERE i.event = 1 GROUP BY 1""")
def v22(spark, sf):
    s = survival_rows(spark, sf).withColumn("year", F.year("signal_date"))
    return tidy(st.concordance(s, "duration", "event", "p", ["year"]))


_PERF = """
SELECT ticker, arg_max(close, date) / arg_min(close, date) - 1 AS total_return, min(dd) AS max_drawdown, avg(r) AS m, stddev_samp(r) AS sd, count(*) AS n, max(date) - min(date) AS days
FROM (SELECT *, close / lag(close) OVER w - 1 AS r, close / max(close) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)) GROUP BY 1"""


@query("v23_v24_portfolio_metrics", f"""
SELECT ticker, round(total_return, 6) + 0.0 AS total_return, round(pow(1 + total_return, 365.25 / days) - 1, 6) + 0.0 AS cagr, round(max_drawdown, 6) + 0.0 AS max_drawdown,
  round(m / sd * sqrt(252.0::DOUBLE), 6) + 0.0 AS sharpe FROM ({_PERF})""")
def v23(spark, sf):
    """Every ticker's close as an equity curve."""
    return tidy(st.portfolio_metrics(bv.bars(spark, sf), ["ticker"], "date", "close"))


@query("v24_trade_metrics", f"WITH {_TRADES} SELECT CAST(year(signal_date) AS INTEGER) AS year, count(*) AS trades, round(avg((ret > 0)::INT), 6) + 0.0 AS win_rate, round(avg(ret) FILTER (ret > 0), 6) + 0.0 AS avg_win, "
       "round(avg(ret) FILTER (ret <= 0), 6) + 0.0 AS avg_loss, round(CASE WHEN -sum(ret) FILTER (ret <= 0) > 0 THEN sum(ret) FILTER (ret > 0) / -sum(ret) FILTER (ret <= 0) END, 6) + 0.0 AS profit_factor FROM trades GROUP BY 1")
def v24(spark, sf):
    t = trades_table(spark, sf).withColumns({"r_multiple": F.lit(None).cast("double"), "year": F.year("signal_date")})
    return tidy(st.trade_metrics(t, ["year"], "ret"), "year", "trades", "win_rate", "avg_win", "avg_loss", "profit_factor")


@query("v24_monthly_perf", """
WITH e AS (SELECT *, product(1 + ret) OVER (PARTITION BY variant_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS eq FROM reg),
d AS (SELECT *, eq / max(eq) OVER (PARTITION BY variant_id ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM e)
SELECT variant_id, count(*) AS months, round(pow(product(1 + ret), 12 / count(*)) - 1, 6) + 0.0 AS annualized, round(stddev_samp(ret) * sqrt(12.0::DOUBLE), 6) + 0.0 AS vol,
  round(avg(ret) / stddev_samp(ret) * sqrt(12.0::DOUBLE), 6) + 0.0 AS sharpe, round(min(dd), 6) + 0.0 AS max_drawdown FROM d GROUP BY 1""")
def v24b(spark, sf):
    return tidy(st.monthly_perf(registry_returns(spark, sf), ["variant_id"]))


@query("v25_equity_by_year", """
WITH y AS (SELECT ticker, CAST(year(date) AS INTEGER) AS year, arg_min(close, date) AS f, arg_max(close, date) AS l FROM bars GROUP BY 1, 2)
SELECT ticker, year, round(l / coalesce(lag(l) OVER (PARTITION BY ticker ORDER BY year), f) - 1, 6) + 0.0 AS "return" FROM y""")
def v25(spark, sf):
    return tidy(st.equity_by_year(bv.bars(spark, sf), ["ticker"], "close"))


@query("v26_buy_and_hold", f"""
SELECT ticker, round(total_return, 6) + 0.0 AS total_return, round(pow(1 + total_return, 365.25 / days) - 1, 6) + 0.0 AS cagr, round(max_drawdown, 6) + 0.0 AS max_drawdown,
  round(m / sd * sqrt((n - 1) / (days / 365.25)), 6) + 0.0 AS sharpe FROM ({_PERF.replace('FROM bars WINDOW', "FROM bars WHERE date BETWEEN DATE '1997-01-01' AND DATE '2000-12-31' WINDOW")})""")
def v26(spark, sf):
    return tidy(st.buy_and_hold(bv.bars(spark, sf), "1997-01-01", "2000-12-31", ["ticker"]))


@query("v27_exposure_matched_benchmark", """
WITH e AS (SELECT date, count(*) / (SELECT count(DISTINCT ticker) FROM bars) AS x FROM bars WHERE date >= DATE '1996-01-01' GROUP BY 1), a AS (SELECT avg(x) AS ax, min(date) AS d0, max(date) AS d1 FROM e),
b AS (SELECT date, coalesce(close / lag(close) OVER (ORDER BY date) - 1, 0) AS r FROM bench, a WHERE date BETWEEN d0 AND d1),
q AS (SELECT date, product(1 + ax * r) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS eq, ax FROM b, a),
z AS (SELECT *, eq / lag(eq) OVER (ORDER BY date) - 1 AS dr, eq / max(eq) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM q)
SELECT round(any_value(ax), 6) + 0.0 AS avg_exposure, round(arg_max(eq, date) - 1, 6) + 0.0 AS total_return, round(pow(arg_max(eq, date), 365.25 / (max(date) - min(date))) - 1, 6) + 0.0 AS cagr,
  round(min(dd), 6) + 0.0 AS max_drawdown, round(avg(dr) / stddev_samp(dr) * sqrt(252.0::DOUBLE), 6) + 0.0 AS sharpe FROM z""")
def v27(spark, sf):
    b = bv.bars(spark, sf)
    n = b.agg(F.countDistinct("ticker").alias("_n"))
    from ..operators.scalars import with_scalars

    e = b.filter(F.col("date") >= "1996-01-01").groupBy("date").agg(F.count(F.lit(1)).alias("_k")).transform(with_scalars, n) \
         .select("date", (F.col("_k") / F.col("_n")).alias("exposure"))
    return tidy(st.exposure_matched_benchmark(bv.benchmark_bars(b), e))


# --- B ------------------------------------------------------------------------------------------------------

def _boot_sql(rows: str, group: str, value: str, reps: int) -> str:
    return f"""g AS (SELECT {group} AS grp, sum({value}) AS s, count(*) AS c FROM {rows} WHERE {value} IS NOT NULL GROUP BY 1),
i AS (SELECT *, row_number() OVER (ORDER BY grp) - 1 AS i, count(*) OVER () AS m FROM g),
d AS (SELECT r.range AS rep, CAST('0x' || substr(md5('0|' || r.range || '|' || i.i), 1, 8) AS BIGINT) % i.m AS k FROM i CROSS JOIN range({reps}) r),
q AS (SELECT rep, sum(s) / sum(c) AS mean FROM d JOIN i ON d.k = i.i GROUP BY 1)
SELECT round(quantile_cont(mean, 0.025), 6) + 0.0 AS ci_low, round(quantile_cont(mean, 0.975), 6) + 0.0 AS ci_high FROM q"""


@query("b1_bootstrap_ci", f"WITH {_TRADES}, {_boot_sql('trades', 'date_trunc(chr(109) || chr(111) || chr(110) || chr(116) || chr(104), entry_date)', 'excess', 2000)}")
def b1(spark, sf):
    t = trades_table(spark, sf).withColumn("month", F.trunc("entry_date", "month"))
    return tidy(rs.bootstrap_ratio(t, "month", "excess"))


@query("b2_bootstrap_by_week", f"WITH {_TRADES}, {_boot_sql('trades', 'signal_date', 'ret', 500)}")
def b2(spark, sf):
    return tidy(rs.bootstrap_ratio(trades_table(spark, sf), "signal_date", "ret", 500))


VIEWS["pools"] = """
SELECT date AS snapshot, ticker, row_number() OVER (PARTITION BY date ORDER BY ticker) - 1 AS idx, count(*) OVER (PARTITION BY date) AS pool FROM (SELECT DISTINCT date, ticker FROM panel)"""
_DRAWS = f"""{_TRADES}, sn AS (SELECT DISTINCT snapshot, pool FROM pools), tt AS (SELECT t.ticker AS own, t.signal_date, t.pos, s.snapshot, s.pool FROM trades t ASOF JOIN sn s ON t.signal_date >= s.snapshot),
dr AS (SELECT r.range AS seed, tt.*, CAST('0x' || substr(md5(r.range || '|' || signal_date || '|' || own), 1, 8) AS BIGINT) % pool AS idx FROM tt CROSS JOIN range(200) r),
ev2 AS (SELECT d.seed, d.signal_date, d.pos, p.ticker, d.own FROM dr d JOIN pools p ON p.snapshot = d.snapshot AND p.idx = d.idx)"""


def _membership(spark, sf):
    return bv.panel(spark, sf).select("date", "ticker").distinct()


@query("b3_random_events", f"WITH {_DRAWS} SELECT CAST(seed AS INTEGER) AS seed, signal_date, ticker, own FROM ev2")
def b3(spark, sf):
    return rs.random_events(trades_table(spark, sf), _membership(spark, sf), 200).select("seed", "signal_date", "ticker", F.col("_drawn_for").alias("own"))


_ALL_OUT = """,
ap AS (SELECT g.ticker, g.pos, e.open AS entry FROM grid g JOIN grid e ON e.ticker = g.ticker AND e.pos = g.pos + 1 AND e.open IS NOT NULL),
ax AS (SELECT a.ticker, a.pos, a.entry, min(b.pos) FILTER (b.close IS NULL) AS gone, max(b.pos) AS lastp FROM ap a JOIN grid b ON b.ticker = a.ticker AND b.pos BETWEEN a.pos + 1 AND a.pos + 8 GROUP BY 1, 2, 3),
ay AS (SELECT *, CASE WHEN gone IS NOT NULL THEN greatest(gone - 1, pos + 1) ELSE lastp END AS xp FROM ax),
az AS (SELECT y.ticker, y.pos, g.close * (1 - 0.0015) / (y.entry * (1 + 0.0015)) - 1 - (bc.close / bo.open - 1) AS excess FROM ay y JOIN grid g ON g.ticker = y.ticker AND g.pos = y.xp AND g.close IS NOT NULL
  JOIN bench bo ON bo.pos = y.pos + 1 JOIN bench bc ON bc.pos = y.xp)"""


@bv.staged
def outcome_table(spark, sf):
    return oc.barrier_outcome_table(bv.grid(spark, sf), bv.bench_grid(spark, sf), 8)


@query("b4_random_baseline", f"WITH {_DRAWS}{_ALL_OUT} SELECT CAST(seed AS INTEGER) AS seed, count(*) AS trades, round(avg(excess), 6) + 0.0 AS mean_excess FROM ev2 JOIN az USING (ticker, pos) GROUP BY 1")
def b4(spark, sf):
    return tidy(rs.random_baseline(trades_table(spark, sf), _membership(spark, sf), outcome_table(spark, sf), 200))


@query("v14_percentile_of_random", f"""WITH {_DRAWS}{_ALL_OUT}, rb AS (SELECT seed, round(avg(excess), 9) AS m FROM ev2 JOIN az USING (ticker, pos) GROUP BY 1)
SELECT 'all' AS scope, round(avg((m < (SELECT round(avg(excess), 9) FROM trades))::INT) * 100, 4) + 0.0 AS percentile FROM rb""")
def v14(spark, sf):
    t = trades_table(spark, sf)
    dist = rs.random_baseline(t, _membership(spark, sf), outcome_table(spark, sf), 200).select(F.lit("all").alias("scope"), F.round("mean_excess", 9).alias("m"))
    return tidy(st.percentile_of(t.groupBy(F.lit("all").alias("scope")).agg(F.round(F.avg("excess"), 9).alias("v")), dist, ["scope"], "v", "m"), digits=4)


@query("b5_random_picks", """
WITH RECURSIVE pool AS (SELECT date, ticker, row_number() OVER (PARTITION BY date ORDER BY ticker) - 1 AS i FROM (SELECT DISTINCT date, ticker FROM panel)),
d AS (SELECT date, count(*) AS n, unnest(range(20)) AS seed FROM pool GROUP BY 1),
s AS (SELECT date, seed, n, greatest(n - 5, 0) AS j, CAST([] AS BIGINT[]) AS taken FROM d
  UNION ALL SELECT date, seed, n, j + 1, list_append(taken, CASE WHEN list_contains(taken, h) THEN j ELSE h END) FROM (SELECT *, ('0x' || substr(md5(seed || '|' || date || '|' || j), 1, 8))::BIGINT % (j + 1) AS h FROM s WHERE j < n) q),
p AS (SELECT date, seed, unnest(taken) AS i, generate_subscripts(taken, 1) AS pick FROM s WHERE j = n)
SELECT CAST(p.seed AS INTEGER) AS seed, p.date, CAST(pick AS INTEGER) AS pick, ticker FROM p JOIN pool ON pool.date = p.date AND pool.i = p.i""")
def b5(spark, sf):
    return rs.random_picks(bv.panel(spark, sf), 5, 20)


# --- P ------------------------------------------------------------------------------------------------------

def _port_sql(name: str, score: str, frac: float, cap: float, cost: float, ret: str = "fwd_return") -> str:
    return f"""{name}_t AS (SELECT date, ticker, coalesce({ret}, 0) AS r, row_number() OVER (PARTITION BY date ORDER BY {score} DESC, ticker) AS rn, count(*) OVER (PARTITION BY date) AS n FROM panel WHERE {score} IS NOT NULL),
{name}_h AS (SELECT *, least(1 / greatest(floor(n * {frac}), 1), {cap}) AS w, greatest(floor(n * {frac}), 1) AS names FROM {name}_t WHERE rn <= greatest(floor(n * {frac}), 1)),
{name}_s AS (SELECT date, sum(w) AS sw, sum(w * (1 + r)) AS g, sum(w * r) AS gross, CAST(max(names) AS BIGINT) AS names FROM {name}_h GROUP BY 1),
{name}_d AS (SELECT date, lead(date) OVER (ORDER BY date) AS nd FROM {name}_s),
{name}_p AS (SELECT d.nd AS date, h.ticker, h.w * (1 + h.r) / s.g * s.sw AS pw FROM {name}_h h JOIN {name}_s s USING (date) JOIN {name}_d d USING (date) WHERE d.nd IS NOT NULL),
{name}_u AS (SELECT coalesce(h.date, p.date) AS date, sum(abs(coalesce(h.w, 0) - coalesce(p.pw, 0))) AS turnover FROM {name}_h h FULL JOIN {name}_p p ON h.date = p.date AND h.ticker = p.ticker GROUP BY 1),
{name} AS (SELECT s.date, gross, turnover, gross - turnover * {cost} AS net, names FROM {name}_s s JOIN {name}_u u USING (date))"""


@query("p1_monthly_portfolio", f"WITH {_port_sql('m1', 'score', 0.1, 0.05, 0.003)} SELECT date, names, {rounded('gross turnover net')} FROM m1")
def p1(spark, sf):
    return tidy(pf.monthly_portfolio(bv.panel(spark, sf), "score", "fwd_return"), "date", "names", "gross", "turnover", "net")


@query("p2_decile_spread", f"WITH {_port_sql('m1', 'score', 0.1, 1.0, 0.0015)}, {_port_sql('m2', '(-score)', 0.1, 1.0, 0.0015)} SELECT date, round(m1.net - m2.gross - m2.turnover * 0.0015, 6) + 0.0 AS spread_net FROM m1 JOIN m2 USING (date)")
def p2(spark, sf):
    return tidy(pf.decile_spread(bv.panel(spark, sf), "score", "fwd_return"))


@bv.staged
def top_decile(spark, sf):
    return pf.monthly_portfolio(bv.panel(spark, sf), "score", "fwd_return", 0.10, 1.0, 0.0015).select("date", F.col("net").alias("ret"))


@query("p3_p4_vol_targeted", f"""WITH {_port_sql('m1', 'score', 0.1, 1.0, 0.0015)},
c AS (SELECT *, CASE WHEN count(net) OVER w >= 6 THEN stddev_samp(net) OVER w END * sqrt(12.0::DOUBLE) AS sd FROM m1 WINDOW w AS (ORDER BY date ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING))
SELECT date, round(net, 6) + 0.0 AS ret, round(coalesce(least(0.15 / sd, 1.5), 1), 6) + 0.0 AS exposure,
  round(coalesce(least(0.15 / sd, 1.5), 1) * net + (1 - coalesce(least(0.15 / sd, 1.5), 1)) * (month(date) / 1000), 6) + 0.0 AS targeted FROM c""")
def p4(spark, sf):
    net = top_decile(spark, sf)
    cash = net.select("date", (F.month("date") / 1000).alias("cash"))
    return tidy(pf.vol_targeted(net, cash))


@query("p5_equal_weight_universe", """
WITH m AS (SELECT DISTINCT date, ticker FROM panel), s AS (SELECT date, lead(date) OVER (ORDER BY date) AS nd FROM (SELECT DISTINCT date FROM m)),
r AS (SELECT s.nd AS date, coalesce(avg(b.close_filled / a.close_filled - 1), 0) AS ret FROM m JOIN s USING (date) LEFT JOIN filled a ON a.ticker = m.ticker AND a.date = m.date LEFT JOIN filled b ON b.ticker = m.ticker AND b.date = s.nd
  WHERE s.nd IS NOT NULL GROUP BY 1)
SELECT date, round(ret, 6) + 0.0 AS ret, round(product(1 + ret) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING), 6) + 0.0 AS equity FROM r""")
def p5(spark, sf):
    closes = asof.filled_closes(bv.grid(spark, sf), 5).select("ticker", "date", F.col("close_filled").alias("close"))
    return tidy(pf.equal_weight_universe(_membership(spark, sf), closes))


@query("p6_survivorship_adjusted", f"""WITH {_port_sql('m1', 'score', 0.1, 1.0, 0.0015)}, u AS (SELECT date, 1 - count(fwd_return) / 100.0::DOUBLE AS us FROM panel GROUP BY 1)
SELECT date, round((1 - greatest(0, least(1, coalesce(us, 0)))) * net + greatest(0, least(1, coalesce(us, 0))) * (pow(0.5, 21.0 / 63.0) - 1), 6) + 0.0 AS adjusted FROM m1 LEFT JOIN u USING (date)""")
def p6(spark, sf):
    u = bv.panel(spark, sf).groupBy("date").agg((1 - F.count("fwd_return") / 100.0).alias("unpriced_share"))
    return tidy(pf.survivorship_adjusted(top_decile(spark, sf), u, 0.5), "date", "adjusted")


@query("p7_monthly_points", """
WITH e AS (SELECT date, sum(CAST(round(close * 100) AS BIGINT)) / count(*) AS s FROM bars WHERE volume > 100 GROUP BY 1),
j AS (SELECT coalesce(e.date, b.date) AS date, s, b.close AS b FROM e FULL JOIN bench b ON e.date = b.date),
f AS (SELECT date, last_value(s IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS s, last_value(b IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS b FROM j),
m AS (SELECT last_day(date) AS month_end, arg_max(s, date) AS s, arg_max(b, date) AS b FROM f WHERE s IS NOT NULL AND b IS NOT NULL GROUP BY 1)
SELECT month_end, round(s / first_value(s) OVER (ORDER BY month_end), 4) + 0.0 AS strategy, round(b / first_value(b) OVER (ORDER BY month_end), 4) + 0.0 AS benchmark FROM m""")
def p7(spark, sf):
    b = bv.bars(spark, sf)
    e = b.filter(F.col("volume") > 100).groupBy("date").agg((F.sum(bv.cents("close")) / F.count(F.lit(1))).alias("equity"))
    return tidy(pf.monthly_points(e, bv.benchmark_bars(b)), digits=4)


@query("p8_monthly_benchmark", """
WITH m AS (SELECT max(date) AS date, arg_max(close, date) AS c FROM bench GROUP BY date_trunc('month', date)),
r AS (SELECT date, lead(c) OVER (ORDER BY date) / c - 1 AS bench_return FROM m) SELECT date, round(bench_return, 6) + 0.0 AS bench_return FROM r WHERE bench_return IS NOT NULL""")
def p8(spark, sf):
    return tidy(pf.monthly_benchmark(bv.benchmark_bars(bv.bars(spark, sf))))


_CTP = f"""{_TRADES}, tk AS (SELECT * FROM trades QUALIFY row_number() OVER (PARTITION BY entry_pos ORDER BY strength DESC, ticker) <= 3),
fc AS (SELECT ticker, pos, last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY pos ROWS UNBOUNDED PRECEDING) AS c FROM grid),
dd AS (SELECT k.*, p.pos AS dp, a.c AS c1, b.c AS c0 FROM tk k JOIN cal p ON p.pos BETWEEN k.entry_pos AND k.exit_pos LEFT JOIN fc a ON a.ticker = k.ticker AND a.pos = p.pos LEFT JOIN fc b ON b.ticker = k.ticker AND b.pos = p.pos - 1),
dr AS (SELECT dp, CASE WHEN dp = exit_pos THEN exit_price * (1 - 0.0015) ELSE c1 END / CASE WHEN dp = entry_pos THEN entry_price * (1 + 0.0015) ELSE c0 END - 1 AS r FROM dd),
pd AS (SELECT dp, sum(r) / greatest(10, count(*)) AS ret, count(*) AS n, least(count(*) / 10, 1) AS x FROM dr GROUP BY 1),
fl AS (SELECT c.date, c.pos, coalesce(ret, 0) AS ret, coalesce(n, 0) AS n, coalesce(x, 0) AS x FROM cal c LEFT JOIN pd ON pd.dp = c.pos WHERE c.pos BETWEEN (SELECT min(dp) FROM pd) AND (SELECT max(dp) FROM pd)),
ctp AS (SELECT date, pos, ret, n, x, product(1 + ret) OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING) AS equity FROM fl)"""


@query("p9_calendar_time_portfolio", f"WITH {_CTP} SELECT date, round(ret, 6) + 0.0 AS ret, round(equity, 6) + 0.0 AS equity, round(x, 6) + 0.0 AS exposure, n AS open_trades FROM ctp")
def p9(spark, sf):
    t = trades_table(spark, sf).withColumn("scenario", F.lit("breakout"))
    return tidy(pf.calendar_time_portfolio(t, bv.grid(spark, sf), bv.calendar(spark, sf), 3, 10), "date", "ret", "equity", "exposure", "open_trades")


@query("v17_evaluate_period", f"""WITH {_CTP}, st AS (SELECT round(avg(excess), 9) AS mean_excess FROM trades),
bnx AS (SELECT pow(arg_max(close, date) / arg_min(close, date), 365.25 / (max(date) - min(date))) - 1 AS bc FROM bench WHERE pos BETWEEN (SELECT min(pos) FROM ctp) AND (SELECT max(pos) FROM ctp)),
pfx AS (SELECT pow(arg_max(equity, date) / arg_min(equity, date), 365.25 / (max(date) - min(date))) - 1 AS pc FROM ctp),
t AS (SELECT t FROM ({nw_sql('(SELECT date_trunc(chr(109) || chr(111) || chr(110) || chr(116) || chr(104), entry_date) AS month, avg(excess) AS excess FROM trades GROUP BY 1)', '', 'month', 'excess', 1)}))
SELECT mean_excess > 0 AS mean_excess_positive, coalesce(t >= 2.4, false) AS t_at_least_bar, pc > bc AS portfolio_beats_benchmark FROM st, bnx, pfx, t""")
def v17(spark, sf):
    tr = trades_table(spark, sf)
    eq = pf.calendar_time_portfolio(tr.withColumn("scenario", F.lit("x")), bv.grid(spark, sf), bv.calendar(spark, sf), 3, 10)
    return st.evaluate_period(_period_stats(spark, sf, tr, eq)).select("mean_excess_positive", "t_at_least_bar", "portfolio_beats_benchmark")


def _period_stats(spark, sf, tr, eq):
    from ..operators.scalars import with_scalars

    span = eq.agg(F.min("pos").alias("_a"), F.max("pos").alias("_z"))
    bench = bv.bench_grid(spark, sf).transform(with_scalars, span).filter(F.col("pos").between(F.col("_a"), F.col("_z")))
    parts = tr.agg(F.round(F.avg("excess"), 9).alias("mean_excess"))
    parts = parts.transform(with_scalars, st.trade_tstat(tr, 8).select(F.col("t").alias("nw_t")))
    parts = parts.transform(with_scalars, rs.bootstrap_ratio(tr.withColumn("m", F.trunc("entry_date", "month")), "m", "excess", 500).select("ci_low", "ci_high"))
    parts = parts.transform(with_scalars, st.portfolio_metrics(eq).select("cagr"))
    parts = parts.transform(with_scalars, st.portfolio_metrics(bench, value="close").select(F.col("cagr").alias("bench_cagr")))
    return parts.withColumn("random_pct", F.lit(None).cast("double"))


@query("v28_portfolio_verdict", f"""
WITH {_CTP}, sp AS (SELECT min(date) AS a, max(date) AS z FROM ctp), b AS (SELECT 's' AS who, date, equity FROM ctp UNION ALL SELECT 'b', date, close FROM bench),
c AS (SELECT who, date, equity, a + CAST(floor((z - a) / 2) AS INTEGER) AS mid FROM b, sp WHERE date BETWEEN a AND z),
h AS (SELECT who, date, equity, 'full' AS span FROM c UNION ALL SELECT who, date, equity, 'first' FROM c WHERE date <= mid UNION ALL SELECT who, date, equity, 'second' FROM c WHERE date >= mid),
m AS (SELECT who, span, pow(arg_max(equity, date) / arg_min(equity, date), 365.25 / (max(date) - min(date))) - 1 AS cagr, avg(r) / stddev_samp(r) * sqrt(252.0::DOUBLE) AS sharpe
  FROM (SELECT *, equity / lag(equity) OVER (PARTITION BY who, span ORDER BY date) - 1 AS r FROM h) GROUP BY 1, 2),
f AS (SELECT max(cagr) FILTER (who = 's') AS s, max(sharpe) FILTER (who = 's') AS ss, max(sharpe) FILTER (who = 'b') AS bs FROM m WHERE span = 'full'),
l AS (SELECT avg((a < (SELECT s FROM f))::INT) AS p FROM (SELECT ticker, pow(arg_max(close, date) / arg_min(close, date), 365.25 / (max(date) - min(date))) - 1 AS a FROM bars GROUP BY 1))
SELECT 'annualized > benchmark, ' || span AS "check", max(cagr) FILTER (who = 's') > max(cagr) FILTER (who = 'b') AS ok FROM m GROUP BY span
UNION ALL SELECT 'sharpe >= benchmark', ss >= bs FROM f UNION ALL SELECT '>= 95% of random portfolios', p * 100 >= 95 FROM l""")
def v28(spark, sf):
    tr = trades_table(spark, sf)
    eq = pf.calendar_time_portfolio(tr.withColumn("scenario", F.lit("x")), bv.grid(spark, sf), bv.calendar(spark, sf), 3, 10)
    rand = st.portfolio_metrics(bv.bars(spark, sf), ["ticker"], "date", "close").select(F.col("cagr").alias("annualized"))
    return st.portfolio_verdict(eq, bv.bench_grid(spark, sf), rand)
