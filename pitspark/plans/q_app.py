"""Registered queries: statement fundamentals, horizon scores, risk and reward, ranking and picks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify as cl, score as sc
from ..operators import asof, features as ft, fundamentals as fu, ranking as rk
from ..sources import bench as bv
from .catalog import query, rounded, tidy
from .oracle_views import VIEWS
from .q_prices import ATR14, PVMA, RET, RSI14, VOL, VRATIO, W, pk, roll, wk

# --- U ------------------------------------------------------------------------------------------------------

_ITEMS = "revenue gross_profit operating_income net_income eps interest_expense cash equity debt"


@query("u1_line_items", f"SELECT ticker, period_end, {rounded(_ITEMS)} FROM fund_items")
def u1(spark, sf):
    """The first line-item name a ticker reports is used for all its periods."""
    return tidy(fu.line_items(bv.statements(spark, sf)), "ticker", "period_end", *_ITEMS.split())


_METRICS = "revenue_growth eps_growth operating_income_growth fcf_growth gross_margin operating_margin net_margin fcf_margin roe interest_coverage tax_rate"


@query("u2_u4_ratios_and_growth", f"SELECT ticker, period_end, {rounded(_METRICS)} FROM fund_m")
def u2(spark, sf):
    return tidy(fu.with_metrics(fu.line_items(bv.statements(spark, sf))), "ticker", "period_end", *_METRICS.split())


def _latest(c: str) -> str:
    return f"arg_max({c}, period_end) FILTER ({c} IS NOT NULL) AS {c}"


def _trend(c: str, out: str) -> str:
    s = f"list({c} ORDER BY period_end) FILTER ({c} IS NOT NULL)"
    mean, last = f"(({s})[-1] - ({s})[1]) / (len({s}) - 1)", f"(({s})[-1] - ({s})[-2])"
    return (f"CASE WHEN coalesce(len({s}), 0) < 2 THEN 'INSUFFICIENT_DATA' WHEN {mean} > 0.02 AND {last} >= -0.02 THEN 'IMPROVING' "
            f"WHEN {mean} < -0.02 AND {last} <= 0.02 THEN 'DETERIORATING' ELSE 'STABLE' END AS {out}")


_U5 = "revenue_growth eps_growth gross_margin operating_margin operating_income_growth net_margin roe fcf_margin fcf_growth cash equity interest_coverage"


@query("u5_compute_fundamentals", f"""
WITH m AS (SELECT f.*, i.total_debt, CASE WHEN i.total_debt + equity - cash > 0 THEN operating_income * (1 - tax_rate) / (i.total_debt + equity - cash) END AS roic FROM fund_m f LEFT JOIN company_info i USING (ticker)),
g AS (SELECT ticker, {', '.join(_latest(c) for c in _U5.split())}, {_latest('roic')}, {_latest('fcf')}, max(period_end) AS observation_date, {_trend('revenue_growth', 'revenue_growth_trend')},
  {_trend('eps_growth', 'eps_growth_trend')}, {_trend('net_margin', 'net_margin_trend')}, {_trend('fcf_growth', 'fcf_trend')}, {_trend('cash', 'balance_sheet_trend')} FROM m GROUP BY 1)
SELECT g.ticker, {rounded(_U5 + ' roic')}, round(g.fcf, 6) + 0.0 AS free_cash_flow, observation_date, revenue_growth_trend, eps_growth_trend, net_margin_trend, fcf_trend, balance_sheet_trend,
  round(i.total_debt - cash, 4) + 0.0 AS net_debt, round(i.total_debt / equity, 6) + 0.0 AS leverage, round(g.fcf / i.market_cap, 6) + 0.0 AS fcf_yield,
  CASE WHEN pe IS NULL OR forward_pe IS NULL OR pe <= 0 THEN 'INSUFFICIENT_DATA' WHEN (forward_pe - pe) / pe <= -0.05 THEN 'IMPROVING' WHEN (forward_pe - pe) / pe >= 0.05 THEN 'DETERIORATING' ELSE 'STABLE' END AS valuation_context
FROM g LEFT JOIN company_info i USING (ticker)""")
def u5(spark, sf):
    x = fu.compute_fundamentals(bv.statements(spark, sf), bv.company_info(spark, sf)).withColumn("net_debt", F.round("net_debt", 4))
    return tidy(x, "ticker", *_U5.split(), "roic", "free_cash_flow", "observation_date", "revenue_growth_trend", "eps_growth_trend", "net_margin_trend", "fcf_trend", "balance_sheet_trend",
                "net_debt", "leverage", "fcf_yield", "valuation_context")


VIEWS["pit_fund"] = f"""
WITH k AS (SELECT p.ticker, p.date, p.close, l.c AS price_now FROM panel p JOIN (SELECT ticker, arg_max(close, date) AS c FROM bars GROUP BY 1) l USING (ticker)),
s AS (SELECT ticker, period_end + 90 AS known_on, {', '.join(f'last_value({c} IGNORE NULLS) OVER w AS {c}' for c in 'revenue_growth eps_growth net_margin roe fcf_margin fcf_growth fcf debt cash'.split())},
  period_end AS fundamentals_period_end FROM fund_m WINDOW w AS (PARTITION BY ticker ORDER BY period_end ROWS UNBOUNDED PRECEDING)),
j AS (SELECT k.*, s.* EXCLUDE (ticker, known_on), i.market_cap * k.close / k.price_now AS market_cap FROM k ASOF LEFT JOIN s ON k.ticker = s.ticker AND k.date >= s.known_on LEFT JOIN company_info i ON i.ticker = k.ticker)
SELECT *, fcf / market_cap AS fcf_yield, debt - cash AS net_debt FROM j"""
_PIT = "revenue_growth eps_growth net_margin roe fcf_margin fcf_growth market_cap fcf_yield net_debt"


def pit_fund(spark, sf):
    now = bv.bars(spark, sf).groupBy("ticker").agg(F.max_by("close", "date").alias("price_now"))
    keys = bv.panel(spark, sf).select("ticker", "date", "close").join(now, "ticker")
    return fu.pit_fundamentals(keys, bv.statements(spark, sf), bv.company_info(spark, sf))


@query("u6_pit_fundamentals", f"SELECT ticker, date, fundamentals_period_end, {rounded(_PIT)} FROM pit_fund")
def u6(spark, sf):
    return tidy(pit_fund(spark, sf), "ticker", "date", "fundamentals_period_end", *_PIT.split())


_OBS = {"revenue": "raw", "revenue_growth": "growth", "gross_margin": "margin", "operating_margin": "margin", "net_margin": "margin", "eps_growth": "growth", "fcf": "raw",
        "fcf_growth": "growth", "fcf_margin": "margin", "cash": "raw", "equity": "raw", "roe": "ratio", "interest_coverage": "coverage"}


@query("u7_u8_observation_flags", f"""
WITH o AS ({' UNION ALL '.join(f"SELECT ticker, period_end, '{m}' AS metric, '{k}' AS kind, {m} * CASE WHEN CAST(substr(ticker, 2) AS BIGINT) % 10 = 2 AND year(period_end) = 1998 THEN 30 ELSE 1 END AS value FROM fund_m WHERE {m} IS NOT NULL" for m, k in _OBS.items())}),
d AS (SELECT *, 'FY' || year(period_end) AS period FROM o UNION ALL SELECT *, 'FY' || year(period_end) FROM o WHERE CAST(substr(ticker, 2) AS BIGINT) % 10 = 4 AND year(period_end) = 1999),
x AS (SELECT *, count(*) OVER (PARTITION BY ticker, metric, period) AS c, list_sort(list(abs(value)) OVER (PARTITION BY ticker, metric)) AS s FROM d)
SELECT ticker, metric, kind, round(value, 6) + 0.0 AS value, period, period_end, concat_ws(',', CASE WHEN period_end - DATE '2000-06-30' > 3 THEN 'future_dated_period' END, CASE WHEN c > 1 THEN 'duplicate_period' END,
  CASE WHEN kind = 'margin' AND (value > 1.5 OR value < -5) THEN 'impossible_margin' END, CASE WHEN kind = 'ratio' AND abs(value) > 10 THEN 'implausible_ratio' END,
  CASE WHEN kind = 'coverage' AND abs(value) > 200 THEN 'implausible_coverage' END, CASE WHEN kind = 'growth' AND abs(value) > 3 THEN 'extreme_growth_value' END,
  CASE WHEN len(s) >= 3 AND s[len(s) // 2 + 1] >= 1e-9 AND abs(value) > s[len(s) // 2 + 1] * 20 THEN 'outlier_vs_series_median' END) AS flags FROM x""")
def u7(spark, sf):
    """Observations with planted outliers and repeated periods."""
    k = F.expr("cast(substring(ticker, 2) as bigint)")
    o = fu.to_observations(bv.statements(spark, sf))
    o = o.withColumn("value", F.when((k % 10 == 2) & (F.year("period_end") == 1998), F.col("value") * 30).otherwise(F.col("value")))
    o = o.unionByName(o.filter((k % 10 == 4) & (F.year("period_end") == 1999)))
    v = fu.validate_observations(o, F.to_date(F.lit("2000-06-30")))
    return tidy(v.withColumn("flags", F.concat_ws(",", "quality_flags")), "ticker", "metric", "kind", "value", "period", "period_end", "flags")


# --- the scored panel -----------------------------------------------------------------------------------------

# Weekly bars stand in for days: the field names keep the daily horizons.
_FIELDS = {"return_20d": "return_4w", "return_60d": "return_12w", "return_252d": "return_52w", "volatility_60d": "volatility_12w", "volume_ratio": "volume_ratio",
           "price_vs_ma50": "price_vs_ma20"}
VIEWS["score_in"] = f"""
SELECT p.ticker, p.date, p.close, {', '.join(f'p.{v} AS {k}' for k, v in _FIELDS.items())}, p.fwd_return, p.fwd_excess, {', '.join(f'round(f.{c}, 8) AS {c}' for c in 'revenue_growth eps_growth net_margin roe fcf_margin fcf_growth fcf_yield'.split())},
  round(f.net_debt, 4) AS net_debt, round(f.market_cap, 2) AS market_cap FROM panel p LEFT JOIN pit_fund f ON f.ticker = p.ticker AND f.date = p.date"""


@bv.staged
def score_input(spark, sf):
    f = pit_fund(spark, sf).select("ticker", "date", *[F.round(c, 8).alias(c) for c in "revenue_growth eps_growth net_margin roe fcf_margin fcf_growth fcf_yield".split()],
                                   F.round("net_debt", 4).alias("net_debt"), F.round("market_cap", 2).alias("market_cap"))
    p = bv.panel(spark, sf).select("ticker", "date", "close", *[F.col(v).alias(k) for k, v in _FIELDS.items()], "fwd_return", "fwd_excess")
    return p.join(f, ["ticker", "date"], "left")


def _clip(x: str) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN greatest(-1.0::DOUBLE, least(1.0::DOUBLE, {x})) END"


def _r(x: str, d: int = 4) -> str:
    return f"round(({x}) + sign({x}) * 1e-10, {d})"


_NORM = {"price_vs_ma50": "price_vs_ma50 * 5", "return_20d": "return_20d * 6", "return_60d": "return_60d * 4", "return_252d": "return_252d * 2", "volatility_60d": "(volatility_60d - 0.3) * -2",
         "volume_ratio": "volume_ratio - 1.0", "revenue_growth": "revenue_growth * 5", "eps_growth": "eps_growth * 5", "net_margin": "net_margin * 4", "roe": "roe * 4", "fcf_margin": "fcf_margin * 5",
         "fcf_growth": "fcf_growth * 5", "fcf_yield": "fcf_yield * 12", "ndm": "net_debt / nullif(market_cap, 0) * -2"}
_GROUP_SQL = {"technical_trend": ["price_vs_ma50"], "technical_momentum": ["return_20d", "return_60d", "return_252d"], "technical_volatility": ["volatility_60d"], "technical_volume": ["volume_ratio"],
              "technical_relative_strength": [], "fundamental_growth": ["revenue_growth", "eps_growth"], "fundamental_profitability": ["net_margin", "roe"],
              "fundamental_cash_flow": ["fcf_margin", "fcf_growth"], "fundamental_balance_sheet": ["ndm"], "fundamental_valuation": ["fcf_yield"]}
VIEWS["normed"] = "SELECT ticker, date, close, fwd_excess, " + ", ".join(f"{_clip(e)} AS n_{n}" for n, e in _NORM.items()) + " FROM score_in"


def _mean_sql(fields: list[str]) -> str:
    if not fields:
        return "CAST(NULL AS DOUBLE)"
    n = " + ".join(f"(n_{f} IS NOT NULL)::INT" for f in fields)
    s = " + ".join(f"coalesce(n_{f}, 0)" for f in fields)
    return f"CASE WHEN {n} > 0 THEN {_r(f'({s}) / ({n})')} END"


VIEWS["groups"] = "SELECT ticker, date, close, fwd_excess, " + ", ".join(f"{_mean_sql(f)} AS {g}" for g, f in _GROUP_SQL.items()) + " FROM normed"


# The weights as the SQL has them, written out in the order of the groups above.
_SQL_WEIGHTS = {"VERY_SHORT": [0.2, 0.25, 0.15, 0.15, 0.1, 0.03, 0.03, 0.03, 0.03, 0.03], "SHORT": [0.18, 0.2, 0.12, 0.1, 0.1, 0.08, 0.07, 0.03, 0.02, 0.1],
                "MEDIUM": [0.13, 0.14, 0.06, 0.04, 0.13, 0.14, 0.12, 0.08, 0.04, 0.12], "LONG": [0.08, 0.07, 0.02, 0.01, 0.07, 0.18, 0.16, 0.16, 0.1, 0.15],
                "VERY_LONG": [0.03, 0.03, 0.01, 0.01, 0.02, 0.22, 0.2, 0.2, 0.12, 0.16]}


def _weights(profile: str) -> dict[str, float]:
    return dict(zip(_GROUP_SQL, _SQL_WEIGHTS[profile]))


def view_sql(profile: str, kind: str = "") -> str:
    w = _weights(profile)
    gs = [g for g in _GROUP_SQL if g.startswith(kind)]
    num = " + ".join(f"coalesce({_r(f'{g} * {w[g]}')}, 0)" for g in gs)
    den = " + ".join(f"CASE WHEN {g} IS NOT NULL THEN {w[g]}::DOUBLE ELSE 0 END" for g in gs)
    return f"CASE WHEN {den} > 0 THEN {_r(f'({num}) / ({den})')} END"


def _part(profile: str, kind: str) -> str:
    w = _weights(profile)
    return "round(" + " + ".join(f"coalesce({_r(f'{g} * {w[g]}')}, 0)" for g in _GROUP_SQL if g.startswith(kind)) + ", 4) + 0.0"


@query("r1_r2_normalised_fields", "SELECT ticker, date, " + ", ".join(f"round(n_{n}, 8) + 0.0 AS {n}" for n in _NORM) + " FROM normed")
def r1(spark, sf):
    x = score_input(spark, sf)
    cols = {n: (sc.normalize_market(n, F.col(n)) if n in _FIELDS else sc.normalize_fundamental(n, F.col(n))) for n in _NORM if n != "ndm"}
    cols["ndm"] = sc.normalize_fundamental("net_debt_to_market_cap", F.col("net_debt") / F.expr("nullif(market_cap, 0)"))
    return tidy(x.select("ticker", "date", *[c.alias(n) for n, c in cols.items()]), digits=8)


# Anchor weights of the fields the table has, at 1, 30, 365 and 3650 days, written out.
_SQL_ANCHORS = {"volume_ratio": (0.7, 0.4, 0, 0), "return_20d": (0, 0.6, 0, 0), "price_vs_ma50": (0, 0, 0.3, 0), "revenue_growth": (0, 0, 0.6, 0.8), "net_margin": (0, 0, 0.3, 0),
                "fcf_growth": (0, 0, 0, 0.7), "roe": (0, 0, 0, 0.6), "fcf_margin": (0, 0, 0, 0.6), "ndm": (0, 0, 0, -0.4), "fcf_yield": (0, 0, 0, 0.5)}


def _fit_sql(days: int) -> str:
    marks = (1, 30, 365, 3650)
    i = max(k for k, m in enumerate(marks[:-1]) if m <= days)
    share = f"(ln({days}) - ln({marks[i]})) / (ln({marks[i + 1]}) - ln({marks[i]}))"
    terms = [(f"n_{n}", f"({a[i]}::DOUBLE + ({a[i + 1]}::DOUBLE - {a[i]}::DOUBLE) * {share})") for n, a in _SQL_ANCHORS.items() if a[i] or a[i + 1]]
    den = " + ".join(f"CASE WHEN {v} IS NOT NULL AND abs({x}) > 1e-15 THEN abs({x}) ELSE 0 END" for v, x in terms)
    num = " + ".join(f"coalesce({v} * {x}, 0)" for v, x in terms)
    return f"CASE WHEN {den} > 0 THEN {_r(f'({num}) / ({den})')} END"


@query("r3_r4_horizon_fit", "SELECT ticker, date, " + ", ".join(f"{_fit_sql(d)} + 0.0 AS fit_{d}" for d in (14, 91, 365, 2000)) + " FROM normed")
def r4(spark, sf):
    x = score_input(spark, sf)
    have = set(x.columns)
    return tidy(x.select("ticker", "date", *[sc.horizon_fit(d, have).alias(f"fit_{d}") for d in (14, 91, 365, 2000)]))


@query("r5_group_scores", "SELECT ticker, date, " + ", ".join(f"{g} + 0.0 AS {g}" for g in _GROUP_SQL) + " FROM groups")
def r5(spark, sf):
    x = score_input(spark, sf)
    return tidy(x.select("ticker", "date", *[c.alias(g) for g, c in sc.group_scores(set(x.columns)).items()]))


@query("r6_weighted_view", f"""
WITH v AS (SELECT *, {view_sql('MEDIUM')} + 0.0 AS score, {_part('MEDIUM', 'technical_')} AS technical_contribution, {_part('MEDIUM', 'fundamental_')} AS fundamental_contribution FROM groups),
u AS ({' UNION ALL '.join(f"SELECT ticker, date, '{g}' AS g, {i} AS i, {_r(f'{g} * {_weights('MEDIUM')[g]}')} AS c FROM groups" for i, g in enumerate(_GROUP_SQL))}),
t AS (SELECT ticker, date, string_agg(g, ',' ORDER BY abs(c) DESC, i) AS dominant FROM (SELECT * FROM u WHERE c IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ticker, date ORDER BY abs(c) DESC, i) <= 3) GROUP BY 1, 2)
SELECT v.ticker, v.date, score, technical_contribution, fundamental_contribution, coalesce(dominant, '') AS dominant FROM v LEFT JOIN t ON t.ticker = v.ticker AND t.date = v.date""")
def r6(spark, sf):
    v = sc.with_weighted_view(score_input(spark, sf), 91)
    return tidy(v.select("ticker", "date", "score", "technical_contribution", "fundamental_contribution", F.array_join("dominant_factors", ",").alias("dominant")))


@query("r18_profile_weights", """
WITH d AS (SELECT l_shipdate::DATE - DATE '1995-06-01' AS days FROM lineitem),
p AS (SELECT CASE WHEN days <= 3 THEN 'VERY_SHORT' WHEN days <= 14 THEN 'SHORT' WHEN days <= 182 THEN 'MEDIUM' WHEN days <= 730 THEN 'LONG' ELSE 'VERY_LONG' END AS profile FROM d)
SELECT p.profile, count(*) AS horizons, round(any_value(technical), 4) + 0.0 AS technical, round(any_value(fundamental), 4) + 0.0 AS fundamental, round(sum(technical), 4) + 0.0 AS technical_total, round(sum(fundamental), 4) + 0.0 AS fundamental_total
FROM p JOIN (VALUES ('VERY_SHORT', 0.85::DOUBLE, 0.15::DOUBLE), ('SHORT', 0.7, 0.3), ('MEDIUM', 0.5, 0.5), ('LONG', 0.25, 0.75), ('VERY_LONG', 0.1, 0.9)) w(profile, technical, fundamental) ON w.profile = p.profile GROUP BY 1""")
def r18(spark, sf):
    """Technical and fundamental weight of every horizon of the line items (days from a fixed date to shipping), per profile."""
    days = F.datediff("l_shipdate", F.lit("1995-06-01").cast("date"))
    x = sc.with_profile_weights(bv.table(spark, sf, "lineitem").select(days.alias("days")), "days")
    return tidy(x.groupBy("profile").agg(F.count(F.lit(1)).alias("horizons"), F.round(F.max("technical"), 4).alias("technical"), F.round(F.max("fundamental"), 4).alias("fundamental"),
                                         F.sum("technical").alias("technical_total"), F.sum("fundamental").alias("fundamental_total")), digits=4)


VIEWS["levels"] = f"""
SELECT ticker, date, close, round({ATR14}, 6) AS atr, {roll('min', 'low', 60)} AS sup, {roll('max', 'high', 60)} AS res FROM bars_i"""


def _rr_sql(cat: str) -> str:
    k = sc.ATR_MULTIPLE.get(cat, 2.5)
    stop = f"CASE WHEN coalesce(atr, 0) <> 0 THEN CASE WHEN close > sup AND sup > close - {k} * atr THEN sup ELSE close - {k} * atr END WHEN sup < close THEN sup END"
    return f"""SELECT *, CASE WHEN res > close THEN {_r('res', 2)} WHEN close > stop_loss THEN {_r('close + 2 * (close - stop_loss)', 2)} END AS take_profit FROM
  (SELECT *, {_r(stop, 2)} AS stop_loss, CASE WHEN coalesce(atr, 0) <> 0 AND close > sup AND sup > close - {k} * atr THEN 'swing low' WHEN coalesce(atr, 0) <> 0 THEN 'ATR' WHEN sup < close THEN 'swing low (no ATR)' END AS stop_method FROM levels)"""


@query("r8_l8_risk_reward", f"""
SELECT ticker, date, stop_loss + 0.0 AS stop_loss, stop_method, take_profit + 0.0 AS take_profit,
  CASE WHEN close - stop_loss > 0 AND take_profit - close <> 0 THEN {_r('(take_profit - close) / (close - stop_loss)', 2)} + 0.0 END AS risk_reward_ratio FROM ({_rr_sql('short_term')})""")
def r8(spark, sf):
    return tidy(rk.with_levels(ft.level_inputs(bv.bars(spark, sf)).withColumn("atr_14d", F.round("atr_14d", 6)), 14), "ticker", "date", "stop_loss", "stop_method", "take_profit", "risk_reward_ratio")


# --- ranking ----------------------------------------------------------------------------------------------------

VIEWS["uni"] = """
SELECT ticker, any_value(k) AS k, arg_min(sector, (-n, sector)) AS sector FROM (SELECT ticker, sector, count(*) AS n, 1 AS k FROM mentions WHERE ticker IS NOT NULL GROUP BY 1, 2) GROUP BY 1"""
VIEWS["ranked"] = f"""
WITH latest AS (SELECT * FROM groups QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1),
n AS (SELECT * FROM normed QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1),
u AS (SELECT ticker, count(DISTINCT institution) AS institutions, round(coalesce(avg(CASE view_direction WHEN 'POSITIVE' THEN 1.0::DOUBLE WHEN 'NEGATIVE' THEN -1.0::DOUBLE ELSE 0.0 END), 0), 4) AS inst,
  CASE WHEN avg(CASE view_direction WHEN 'POSITIVE' THEN 1.0::DOUBLE WHEN 'NEGATIVE' THEN -1.0::DOUBLE ELSE 0.0 END) > 0.25 THEN 'POSITIVE' WHEN avg(CASE view_direction WHEN 'POSITIVE' THEN 1.0::DOUBLE WHEN 'NEGATIVE' THEN -1.0::DOUBLE ELSE 0.0 END) < -0.25 THEN 'NEGATIVE'
    WHEN bool_or(view_direction IN ('POSITIVE', 'NEGATIVE')) THEN 'NEUTRAL' ELSE 'MENTIONED' END AS iview, max(publication_date) AS idate FROM mentions WHERE ticker IS NOT NULL GROUP BY 1),
lv AS (SELECT * FROM ({_rr_sql('medium_term')}) QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1),
a AS (SELECT u.ticker, u.institutions, u.inst, u.iview, l.date, {view_sql('MEDIUM')} AS hs, lv.close AS current_price, lv.stop_loss, lv.take_profit,
  CASE WHEN lv.close - stop_loss > 0 AND take_profit - lv.close <> 0 THEN {_r('(take_profit - lv.close) / (lv.close - stop_loss)', 2)} END AS rr, u.idate, lv.date AS pdate, pf.fundamentals_period_end AS fdate, coalesce(sg.n, 0) AS sigs
  FROM u LEFT JOIN latest l ON l.ticker = u.ticker LEFT JOIN lv ON lv.ticker = u.ticker LEFT JOIN pit_fund pf ON pf.ticker = l.ticker AND pf.date = l.date
  LEFT JOIN (SELECT 'S' || lpad(substr(ticker, 2), 9, '0') AS ticker, count(*) AS n FROM signals GROUP BY 1) sg ON sg.ticker = u.ticker),
m AS (SELECT a.*, CASE WHEN hs IS NOT NULL THEN {_r('hs + 0.1 * inst')} END AS rank_score, (coalesce(n.n_price_vs_ma50, 0) + coalesce(n.n_return_60d, 0)) / nullif((n.n_price_vs_ma50 IS NOT NULL)::INT + (n.n_return_60d IS NOT NULL)::INT, 0) AS tv,
  (coalesce(n.n_revenue_growth, 0) + coalesce(n.n_net_margin, 0) + coalesce(n.n_fcf_margin, 0)) / nullif((n.n_revenue_growth IS NOT NULL)::INT + (n.n_net_margin IS NOT NULL)::INT + (n.n_fcf_margin IS NOT NULL)::INT, 0) AS fv FROM a LEFT JOIN n ON n.ticker = a.ticker),
v AS (SELECT *, CASE WHEN tv IS NULL THEN 'INSUFFICIENT_EVIDENCE' WHEN tv > 0.15 THEN 'POSITIVE' WHEN tv < -0.15 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS technical_view,
  CASE WHEN fv IS NULL THEN 'INSUFFICIENT_EVIDENCE' WHEN fv > 0.15 THEN 'POSITIVE' WHEN fv < -0.15 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS fundamental_view,
  CASE WHEN rank_score IS NULL THEN 'Insufficient data' WHEN rank_score >= 0.3 THEN 'Strong' WHEN rank_score >= 0.1 THEN 'Favorable' WHEN rank_score <= -0.1 THEN 'Unfavorable' ELSE 'Neutral' END AS label,
  CASE WHEN DATE '2001-07-10' - fdate > 200 OR DATE '2001-07-10' - idate > 400 THEN 'STALE' ELSE 'OK' END AS data_status FROM m),
c AS (SELECT *, (fundamental_view <> 'INSUFFICIENT_EVIDENCE')::INT + (technical_view <> 'INSUFFICIENT_EVIDENCE')::INT + 1 AS known,
  len(list_distinct(list_filter([fundamental_view, technical_view, iview], lambda x: x IN ('POSITIVE', 'NEGATIVE')))) <= 1 AS agrees FROM v),
f AS (SELECT *, CASE WHEN known >= 2 AND agrees AND sigs >= 5 THEN 'High' WHEN known = 1 THEN 'Low' ELSE 'Medium' END AS confidence FROM c)
SELECT *, label IN ('Strong', 'Favorable') AND data_status = 'OK' AND confidence <> 'Insufficient evidence' AS shortlisted,
  CAST(row_number() OVER (ORDER BY rank_score DESC NULLS LAST, institutions DESC, ticker) AS INTEGER) AS rank FROM f"""
_RANK_COLS = "rank ticker label technical_view fundamental_view institutional_view institutions signal_count confidence data_status shortlisted"


def ranking(spark, sf):
    """Universe of the mentions, scored at three months on the latest panel row of each ticker."""
    from ..operators import universe as un

    uni = un.build_universe(bv.mentions(spark, sf))
    x = score_input(spark, sf)
    known = pit_fund(spark, sf).select("ticker", "date", F.col("fundamentals_period_end").alias("fundamentals_date"))
    latest = asof.latest_per_key(x, ["ticker"], ["date"]).join(known, ["ticker", "date"], "left")
    read = _signals(spark, sf).groupBy("ticker").agg(F.count(F.lit(1)).alias("signal_count"))
    lv = asof.latest_per_key(ft.level_inputs(bv.bars(spark, sf)).withColumn("atr_14d", F.round("atr_14d", 6)).select(
        "ticker", F.col("date").alias("price_date"), F.col("close").alias("current_price"), "atr_14d", "support_60d", "resistance_60d"), ["ticker"], ["price_date"])
    return rk.rank_universe(uni, latest, lv, read, horizon_days=91, now=F.to_date(F.lit("2001-07-10")))


def _signals(spark, sf):
    """Text signals under the tickers of the price tables."""
    return bv.signals(spark, sf).withColumn("ticker", F.concat(F.lit("S"), F.lpad(F.expr("substring(ticker, 2)"), 9, "0")))


@query("r7_r12_rank_universe", "SELECT rank, ticker, label, technical_view, fundamental_view, iview AS institutional_view, institutions, sigs AS signal_count, confidence, data_status, shortlisted, round(hs, 4) + 0.0 AS horizon_score, "
       "round(rank_score, 4) + 0.0 AS rank_score, current_price, stop_loss + 0.0 AS stop_loss, take_profit + 0.0 AS take_profit, rr + 0.0 AS risk_reward_ratio FROM ranked")
def r12(spark, sf):
    return tidy(ranking(spark, sf), *_RANK_COLS.split(), "horizon_score", "rank_score", "current_price", "stop_loss", "take_profit", "risk_reward_ratio")


@query("r13_r14_quick_picks", """
WITH b AS (SELECT * FROM ranked WHERE shortlisted AND (rr IS NULL OR rr >= 1) ORDER BY rank_score DESC, ticker LIMIT 10), nb AS (SELECT count(*) AS n FROM b),
s AS (SELECT * FROM ranked WHERE label = 'Unfavorable' ORDER BY rank_score, ticker LIMIT 10)
SELECT 'BUY' AS action, ticker, label, current_price AS price, CAST(floor(CASE WHEN stop_loss > 0 AND stop_loss < current_price THEN least(100 / (current_price - stop_loss), 2000 / current_price)
  ELSE least(10000 / greatest((SELECT n FROM nb), 1) / current_price, 2000 / current_price) END) AS BIGINT) AS shares, round(take_profit / current_price - 1, 6) + 0.0 AS upside, round(stop_loss / current_price - 1, 6) + 0.0 AS downside FROM b
UNION ALL SELECT 'SELL', ticker, label, current_price, NULL, round(take_profit / current_price - 1, 6) + 0.0, round(stop_loss / current_price - 1, 6) + 0.0 FROM s""")
def r13(spark, sf):
    buys, sells = rk.quick_picks(ranking(spark, sf))
    cols = ["action", "ticker", "label", "price", "shares", "upside", "downside"]
    return tidy(buys.select(*cols).unionByName(sells.select(*cols)))


_CANDP = f"""cp AS (SELECT p.ticker, p.date, p.score, p.momentum, p.return_4w, l.close, l.stop_loss, l.take_profit, CASE WHEN l.close - stop_loss > 0 THEN (take_profit - l.close) / (l.close - stop_loss) END AS rr,
  l.close > h.ph AS brk FROM panel p JOIN ({_rr_sql('short_term')}) l ON l.ticker = p.ticker AND l.date = p.date JOIN (SELECT ticker, date, CASE WHEN count(high) OVER {pk(20)} = 20 THEN max(high) OVER {pk(20)} END AS ph FROM bars) h
  ON h.ticker = p.ticker AND h.date = p.date)"""


@query("r15_r16_l12_weekly_picks", f"""
WITH {_CANDP}, u AS (SELECT 'score_rank' AS rule, date, ticker, score AS v FROM cp WHERE score >= 0.1 AND rr >= 1 UNION ALL SELECT 'momentum_12_1', date, ticker, momentum FROM cp WHERE momentum IS NOT NULL
  UNION ALL SELECT 'breakout_20d', date, ticker, return_4w FROM cp WHERE brk)
SELECT rule, date, ticker, CAST(row_number() OVER (PARTITION BY rule, date ORDER BY v DESC NULLS LAST, ticker) AS INTEGER) AS pick FROM u QUALIFY pick <= 5""")
def r15(spark, sf):
    b = bv.bars(spark, sf)
    p = bv.panel(spark, sf).select("ticker", "date", F.col("score").alias("score_rank"), F.col("momentum").alias("momentum_12_1"), F.col("return_4w").alias("return_20d"))
    lv = ft.level_inputs(b.withColumn("prior_high_20d", ft.prior_high(20))).withColumn("atr_14d", F.round("atr_14d", 6)) \
        .select("ticker", "date", "close", "atr_14d", "support_60d", "resistance_60d", "prior_high_20d")
    cand = rk.build_candidates(p, lv, bv.calendar(spark, sf), 14)
    out = None
    for rule in ("score_rank", "momentum_12_1", "breakout_20d"):
        got = rk.weekly_picks(cand, rule, 5).select(F.lit(rule).alias("rule"), "date", "ticker", "pick")
        out = got if out is None else out.unionByName(got)
    return out


@query("r17_monthly_top3", "SELECT date, ticker, CAST(row_number() OVER (PARTITION BY date ORDER BY momentum DESC, ticker) AS INTEGER) AS pick FROM panel WHERE momentum IS NOT NULL QUALIFY pick <= 3")
def r17(spark, sf):
    return rk.top_per_date(bv.panel(spark, sf).filter(F.col("momentum").isNotNull()), [F.col("momentum").desc(), F.col("ticker")], 3).select("date", "ticker", "pick")


@query("r9_r10_views_and_confidence", "SELECT ticker, technical_view, fundamental_view, iview AS institutional_view, confidence FROM ranked")
def r9(spark, sf):
    return ranking(spark, sf).select("ticker", "technical_view", "fundamental_view", "institutional_view", "confidence")


@query("r11_extended_research")
def r11(spark, sf):
    """One row per ticker with views, levels, score structure, research score and top evidence."""
    from ..operators import universe as un

    by_type, per = un.company_research(_signals(spark, sf))
    return rk.extended_research(ranking(spark, sf), by_type, per)


# --- F19: one technical row per ticker -------------------------------------------------------------------------------

_F19 = {"return_1d": RET(1), "return_5d": RET(5), "return_20d": RET(20), "return_60d": RET(60), "return_120d": RET(120), "return_252d": RET(252), "moving_average_20d": roll("avg", "close", 20),
        "moving_average_50d": roll("avg", "close", 50), "moving_average_100d": roll("avg", "close", 100), "moving_average_200d": roll("avg", "close", 200), "price_vs_ma20": PVMA(20),
        "ma20_vs_ma50": f"({roll('avg', 'close', 20)}) / ({roll('avg', 'close', 50)}) - 1", "ma50_vs_ma200": f"({roll('avg', 'close', 50)}) / ({roll('avg', 'close', 200)}) - 1",
        "rsi_14d": RSI14, "volatility_20d": VOL(20), "volatility_60d": VOL(60), "atr_14d_pct": f"({ATR14}) / close", "volume_ratio": VRATIO(21),
        "volume_vs_average_20d": f"volume / ({roll('avg', 'volume', 20)})", "distance_to_support_pct": f"close / ({roll('min', 'low', 60)}) - 1", "distance_to_resistance_pct": f"({roll('max', 'high', 60)}) / close - 1"}


@query("f19_technical_row", f"""
WITH x AS (SELECT ticker, date, close, {', '.join(f'{e} AS {n}' for n, e in _F19.items())}, CASE WHEN count(delta) OVER {wk(14)} = 14 THEN 1 END AS has_rsi FROM bars_i {W}),
l AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1)
SELECT ticker, date AS as_of, close AS current_price, {', '.join(f'round({n}, 6) + 0.0 AS {n}' for n in _F19)},
  CASE WHEN rsi_14d IS NULL THEN 'INSUFFICIENT_DATA' WHEN rsi_14d >= 70 THEN 'OVERBOUGHT' WHEN rsi_14d <= 30 THEN 'OVERSOLD' ELSE 'NEUTRAL' END AS rsi_state,
  CASE WHEN moving_average_50d IS NULL OR moving_average_200d IS NULL THEN 'INSUFFICIENT_DATA' WHEN close > moving_average_50d AND close > moving_average_200d AND moving_average_50d > moving_average_200d THEN 'BULLISH'
    WHEN close <= moving_average_50d AND close <= moving_average_200d AND moving_average_50d <= moving_average_200d THEN 'BEARISH' ELSE 'MIXED' END AS trend FROM l""")
def f19(spark, sf):
    return tidy(rk.technical_rows(bv.bars(spark, sf)), "ticker", "as_of", "current_price", *_F19, "rsi_state", "trend")
