"""Registered queries: bars, rolling features, calendar alignment, first-touch outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify as cl
from ..operators import asof, features as ft, outcomes as oc
from ..operators.scalars import with_scalars
from ..sources import bench as bv
from .catalog import query, rounded, tidy

W = "WINDOW w AS (PARTITION BY ticker ORDER BY date)"


def wk(k: int) -> str:
    return f"(PARTITION BY ticker ORDER BY date ROWS {k - 1} PRECEDING)"


def pk(k: int) -> str:
    return f"(PARTITION BY ticker ORDER BY date ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"


def roll(fn: str, col: str, k: int, need: int | None = None) -> str:
    return f"CASE WHEN count({col}) OVER {wk(k)} >= {need or k} THEN {fn}({col}) OVER {wk(k)} END"


RSI14 = (f"CASE WHEN count(delta) OVER {wk(14)} = 14 THEN CASE WHEN avg(greatest(-delta, 0.0)) OVER {wk(14)} = 0 THEN 100.0::DOUBLE ELSE "
         f"100 - 100 / (1 + avg(greatest(delta, 0.0)) OVER {wk(14)} / avg(greatest(-delta, 0.0)) OVER {wk(14)}) END END")
ATR14 = f"CASE WHEN rn > 14 THEN {roll('avg', 'tr', 14)} END"
VOL = lambda k: f"{roll('stddev_samp', 'ret', k)} * sqrt(252.0::DOUBLE)"
VRATIO = lambda k: f"CASE WHEN count(*) OVER {pk(k)} = {k} AND avg(volume) OVER {pk(k)} <> 0 THEN volume / avg(volume) OVER {pk(k)} END"
RET = lambda k: f"close / lag(close, {k}) OVER w - 1"
PVMA = lambda k: f"close / ({roll('avg', 'close', k)}) - 1"


# --- S: price scans ------------------------------------------------------------------------------------

@query("s1_bars_scan", "SELECT ticker, date, open, high, low, close, volume, close_split_adj, split FROM bars")
def s1(spark, sf):
    return bv.bars(spark, sf)


@query("s2_long_history_scan", f"SELECT ticker, date, {rounded('close volume')} FROM bars WHERE date >= DATE '1996-01-01'")
def s2(spark, sf):
    return tidy(bv.bars(spark, sf).filter(F.col("date") >= "1996-01-01"), "ticker", "date", "close", "volume")


@query("s3_app_bars_scan", "SELECT * FROM daily")
def s3(spark, sf):
    return bv.daily_bars(spark, sf)


# --- F: rolling features ---------------------------------------------------------------------------------

@query("f1_f7_returns_volatility_averages",
       f"SELECT ticker, date, round({RET(20)}, 6) + 0.0 AS r20, round({VOL(20)}, 6) + 0.0 AS vol20, round({roll('avg', 'close', 50)}, 6) + 0.0 AS ma50, "
       f"round({RSI14}, 6) + 0.0 AS rsi14, round({VRATIO(21)}, 6) + 0.0 AS vr, round({ATR14}, 6) + 0.0 AS atr14, round({PVMA(50)}, 6) + 0.0 AS pma50 "
       f"FROM bars_i {W}")
def f1_f7(spark, sf):
    b = ft.with_bar_inputs(bv.bars(spark, sf))
    return tidy(b.select("ticker", "date", ft.trailing_return(20).alias("r20"), ft.volatility(20).alias("vol20"),
                         ft.moving_average(50).alias("ma50"), ft.rsi(14).alias("rsi14"), ft.volume_ratio(21).alias("vr"),
                         ft.atr(14).alias("atr14"), ft.price_vs_ma(50).alias("pma50")))


@query("f8_swing_levels", f"SELECT ticker, date, {roll('min', 'low', 60)} AS support, {roll('max', 'high', 60)} AS resistance FROM bars_i")
def f8(spark, sf):
    return bv.bars(spark, sf).select("ticker", "date", ft.swing_low(60).alias("support"), ft.swing_high(60).alias("resistance"))


_BUNDLE = {"return_1d": RET(1), "return_5d": RET(5), "return_20d": RET(20), "return_60d": RET(60), "return_1m": RET(21), "return_3m": RET(63),
           "return_6m": RET(126), "return_1y": RET(252), "volatility_1m": VOL(21), "atr_14d": ATR14, "moving_average_20d": roll("avg", "close", 20),
           "moving_average_50d": roll("avg", "close", 50), "moving_average_200d": roll("avg", "close", 200), "price_vs_ma50": PVMA(50),
           "price_vs_ma200": PVMA(200), "rsi_14d": RSI14, "volume_ratio": VRATIO(21), "support_60d": roll("min", "low", 60),
           "resistance_60d": roll("max", "high", 60)}


@query("f9_feature_bundle", "SELECT ticker, date, " + ", ".join(f"round({e}, 6) + 0.0 AS {n}" for n, e in _BUNDLE.items()) + f" FROM bars_i {W}")
def f9(spark, sf):
    return tidy(ft.feature_bundle(bv.bars(spark, sf)), "ticker", "date", *_BUNDLE)


@query("f10_level_inputs", f"SELECT ticker, date, close, round({ATR14}, 6) + 0.0 AS atr_14d, {_BUNDLE['support_60d']} AS support_60d, "
       f"{_BUNDLE['resistance_60d']} AS resistance_60d FROM bars_i")
def f10(spark, sf):
    return tidy(ft.level_inputs(bv.bars(spark, sf)), "ticker", "date", "close", "atr_14d", "support_60d", "resistance_60d")


_TECH = {"return_20d": RET(20), "return_60d": RET(60), "return_252d": RET(252), "volatility_20d": VOL(20), "volatility_60d": VOL(60),
         "volume_ratio": VRATIO(21), "price_vs_ma50": PVMA(50), "price_vs_ma200": PVMA(200),
         "momentum_12_1": "lag(close, 21) OVER w / lag(close, 252) OVER w - 1"}
_TECH_SQL = ", ".join(f"{e} AS {n}" for n, e in _TECH.items())


@query("f11_f13_pit_technicals", f"""
WITH t AS (SELECT ticker, date, close, {_TECH_SQL} FROM bars_i {W}),
b AS (SELECT date, close / lag(close, 20) OVER (ORDER BY date) - 1 AS b20, close / lag(close, 60) OVER (ORDER BY date) - 1 AS b60,
      close / lag(close, 252) OVER (ORDER BY date) - 1 AS b252 FROM bench),
k AS (SELECT g.ticker, g.date + 3 AS date FROM grid g WHERE pos >= 60 AND (pos - 60) % 4 = 0)
SELECT k.ticker, k.date, round(t.close, 6) + 0.0 AS adj_close, {', '.join(f'round(t.{n}, 6) + 0.0 AS {n}' for n in _TECH)},
       round(return_20d - b20, 6) + 0.0 AS relative_return_20d, round(return_60d - b60, 6) + 0.0 AS relative_return_60d,
       round(return_252d - b252, 6) + 0.0 AS relative_return_252d
FROM k ASOF JOIN t ON k.ticker = t.ticker AND k.date >= t.date ASOF JOIN b ON k.date >= b.date WHERE k.date - t.date <= 7""")
def f11(spark, sf):
    b = bv.bars(spark, sf)
    at = asof.rebalance_dates(bv.calendar(spark, sf), 4, 60).select("pos")
    keys = bv.grid(spark, sf).join(at, "pos").select("ticker", F.date_add("date", 3).alias("date"))
    return tidy(ft.pit_technicals(keys, b, bv.benchmark_bars(b)))


@query("f14_f15_drawdown_breakout",
       f"SELECT ticker, date, round(1 - close / ({roll('max', 'high', 252)}), 6) + 0.0 AS drawdown, "
       f"CASE WHEN count(high) OVER {pk(20)} = 20 THEN max(high) OVER {pk(20)} END AS prior_high_20d, "
       f"close > CASE WHEN count(high) OVER {pk(20)} = 20 THEN max(high) OVER {pk(20)} END AS breakout_20d FROM bars_i")
def f14(spark, sf):
    b = bv.bars(spark, sf).withColumn("prior_high_20d", ft.prior_high(20))
    return tidy(b.select("ticker", "date", ft.drawdown_from_high(252).alias("drawdown"), "prior_high_20d",
                         (F.col("close") > F.col("prior_high_20d")).alias("breakout_20d")))


@query("f16_dollar_volume", f"SELECT ticker, date, round({roll('avg', '(close_split_adj * volume)', 20, 15)}, 6) + 0.0 AS dollar_volume_20d FROM bars_i")
def f16(spark, sf):
    return tidy(bv.bars(spark, sf).select("ticker", "date", ft.dollar_volume(20, 15).alias("dollar_volume_20d")))


@query("f17_return_observations", """
WITH h AS (SELECT * FROM (VALUES ('1d', 1), ('5d', 5), ('20d', 20), ('60d', 60), ('120d', 120), ('252d', 252)) v(horizon, k)),
l AS (SELECT ticker, date, close, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS back FROM bars)
SELECT a.ticker, h.horizon, z.date AS start_date, CASE WHEN z.date IS NOT NULL THEN a.date END AS end_date, round(a.close / z.close - 1, 6) + 0.0 AS value,
       z.date IS NOT NULL AS complete
FROM l a CROSS JOIN h LEFT JOIN l z ON z.ticker = a.ticker AND z.back = h.k + 1 WHERE a.back = 1""")
def f17(spark, sf):
    return tidy(ft.return_observations(bv.bars(spark, sf)))


_HIST = {"close": "close", "sma_20": roll("avg", "close", 20), "sma_50": roll("avg", "close", 50), "rsi_14": RSI14, "atr_14": ATR14,
         "volatility_20d": VOL(20), "volume": "volume"}


@query("f18_indicator_history", f"""
WITH x AS (SELECT ticker, date, rn, max(rn) OVER (PARTITION BY ticker) AS last_rn, {', '.join(f'{e} AS m_{n}' for n, e in _HIST.items())} FROM bars_i),
u AS ({' UNION ALL '.join(f"SELECT ticker, date, '{n}' AS metric, m_{n} AS value FROM x WHERE last_rn - rn < 60" for n in _HIST)})
SELECT ticker, date, metric, round(value, 6) + 0.0 AS value FROM u""")
def f18(spark, sf):
    return tidy(ft.indicator_history(bv.bars(spark, sf), 60))


@query("f20_chart_indicators", f"SELECT ticker, date, round({roll('avg', 'close', 20)}, 6) + 0.0 AS sma_20, round({roll('avg', 'close', 50)}, 6) + 0.0 AS sma_50, "
       f"round({roll('avg', 'close', 200)}, 6) + 0.0 AS sma_200, round({RSI14}, 6) + 0.0 AS rsi_14 FROM bars_i")
def f20(spark, sf):
    return tidy(ft.chart_indicators(bv.bars(spark, sf)), "ticker", "date", "sma_20", "sma_50", "sma_200", "rsi_14")


_FLAGS = """
dup AS (SELECT ticker, date, 'INVALID_DATA:dates:duplicate_date' AS flag FROM r GROUP BY ticker, date HAVING count(*) > 1),
short AS (SELECT ticker, CAST(NULL AS DATE), 'INSUFFICIENT_HISTORY:only_' || count(*) || '_rows' FROM r GROUP BY ticker HAVING count(*) < 20),
rowf AS (SELECT ticker, date, 'INVALID_DATA:price:negative_price' FROM r WHERE close < 0
  UNION ALL SELECT ticker, date, 'INVALID_DATA:price:missing_close' FROM r WHERE close IS NULL
  UNION ALL SELECT ticker, date, 'INVALID_DATA:ohlc:high_less_than_low' FROM r WHERE high < low
  UNION ALL SELECT ticker, date, 'INVALID_DATA:ohlc:close_above_high' FROM r WHERE close > high
  UNION ALL SELECT ticker, date, 'INVALID_DATA:ohlc:close_below_low' FROM r WHERE close < low
  UNION ALL SELECT ticker, date, 'INVALID_DATA:volume:negative_volume' FROM r WHERE volume < 0
  UNION ALL SELECT ticker, date, 'SUSPICIOUS_DATA:volume:zero_volume' FROM r WHERE volume = 0),
one AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY ticker, date ORDER BY close DESC NULLS LAST, volume DESC) = 1),
mv AS (SELECT ticker, date, close / lag(close) OVER w - 1 AS ret, volume,
       CASE WHEN count(*) OVER p = 20 THEN avg(volume) OVER p END AS base
       FROM one WINDOW w AS (PARTITION BY ticker ORDER BY date), p AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
ext AS (SELECT ticker, date, CASE WHEN base <> 0 AND volume / base >= 1.5 THEN 'VALID_EXTREME_MARKET_MOVE:returns' ELSE 'SUSPICIOUS_DATA:returns' END
        FROM mv WHERE abs(ret) > 0.20 AND ticker IN (SELECT ticker FROM r GROUP BY ticker HAVING count(*) >= 21))
SELECT * FROM dup UNION ALL SELECT * FROM short UNION ALL SELECT * FROM rowf UNION ALL SELECT * FROM ext"""


@query("f21_ohlcv_quality_flags", f"""
WITH r AS (SELECT ticker, date, CASE WHEN ticker % 10 = 3 AND day(date) = 5 THEN high * 2 WHEN ticker % 10 = 4 AND day(date) = 7 THEN NULL ELSE close END AS close,
  high, CASE WHEN ticker % 10 = 5 AND day(date) = 9 THEN high + 1 ELSE low END AS low, CASE WHEN ticker % 10 = 6 AND day(date) = 11 THEN 0 ELSE volume END AS volume
  FROM daily WHERE ticker % 10 <> 7 OR day(date) < 12
  UNION ALL SELECT ticker, date, close, high, low, volume FROM daily WHERE ticker % 10 = 8 AND day(date) = 3), {_FLAGS}""")
def f21(spark, sf):
    """Daily bars with planted defects in a few tickers."""
    d, t, day = bv.daily_bars(spark, sf), F.col("ticker") % 10, F.dayofmonth("date")
    dirty = (d.filter((t != 7) | (day < 12))
             .withColumn("close", F.when((t == 3) & (day == 5), F.col("high") * 2).when((t == 4) & (day == 7), None).otherwise(F.col("close")))
             .withColumn("low", F.when((t == 5) & (day == 9), F.col("high") + 1).otherwise(F.col("low")))
             .withColumn("volume", F.when((t == 6) & (day == 11), 0.0).otherwise(F.col("volume"))))
    return ft.ohlcv_flags(dirty.unionByName(d.filter((t == 8) & (day == 3))))


@query("f22_indicator_bounds", f"""
WITH x AS (SELECT ticker, date, {RSI14} - CASE WHEN day(date) = 1 THEN 200 ELSE 0 END AS rsi, {ATR14} AS atr, -({VOL(20)}) AS vol FROM bars_i)
SELECT ticker, date, concat_ws(';', CASE WHEN NOT (rsi BETWEEN 0 AND 100) THEN 'INVALID_DATA:rsi:out_of_range' END,
  CASE WHEN atr < 0 THEN 'INVALID_DATA:atr:negative' END, CASE WHEN vol < 0 THEN 'INVALID_DATA:vol:negative' END) AS flags FROM x""")
def f22(spark, sf):
    b = ft.with_bar_inputs(bv.bars(spark, sf))
    x = b.select("ticker", "date", (ft.rsi(14) - F.when(F.dayofmonth("date") == 1, 200).otherwise(0)).alias("rsi"), ft.atr(14).alias("atr"),
                 (-ft.volatility(20)).alias("vol"))
    return ft.indicator_bound_flags(x, "rsi", ["atr", "vol"]).select("ticker", "date", F.concat_ws(";", "bound_flags").alias("flags"))


# --- C: states -------------------------------------------------------------------------------------------

_LAST = f"""
WITH x AS (SELECT *, round({roll('avg', 'close', 50)}, 6) AS ma50, round({roll('avg', 'close', 200)}, 6) AS ma200, {RET(20)} AS r20, {RET(60)} AS r60,
  {RET(252)} AS r252, round({RSI14}, 6) AS rsi, round({VOL(20)}, 8) AS vol20 FROM bars_i {W})"""


@query("c1_c3_price_states", _LAST + """
SELECT ticker, date,
  CASE WHEN ma50 IS NULL OR ma200 IS NULL THEN 'INSUFFICIENT_DATA' WHEN close > ma50 AND close > ma200 AND ma50 > ma200 THEN 'BULLISH'
       WHEN NOT close > ma50 AND NOT close > ma200 AND NOT ma50 > ma200 THEN 'BEARISH' ELSE 'MIXED' END AS trend,
  CASE WHEN coalesce(r20, r60, r252) IS NULL THEN 'INSUFFICIENT_DATA'
       WHEN least(coalesce(r20, 1), coalesce(r60, 1), coalesce(r252, 1)) > 0 THEN 'BULLISH'
       WHEN greatest(coalesce(r20, -1), coalesce(r60, -1), coalesce(r252, -1)) < 0 THEN 'BEARISH' ELSE 'MIXED' END AS momentum_state,
  CASE WHEN rsi IS NULL THEN 'INSUFFICIENT_DATA' WHEN rsi >= 70 THEN 'OVERBOUGHT' WHEN rsi <= 30 THEN 'OVERSOLD' ELSE 'NEUTRAL' END AS rsi_state FROM x""")
def c1(spark, sf):
    x = ft.with_bar_inputs(bv.bars(spark, sf)).withColumns({
        "ma50": F.round(ft.moving_average(50), 6), "ma200": F.round(ft.moving_average(200), 6), "r20": ft.trailing_return(20),
        "r60": ft.trailing_return(60), "r252": ft.trailing_return(252), "rsi": F.round(ft.rsi(14), 6)})
    return x.select("ticker", "date", cl.price_trend("close", "ma50", "ma200").alias("trend"),
                    cl.momentum_state("r20", "r60", "r252").alias("momentum_state"), cl.rsi_state("rsi").alias("rsi_state"))


@query("c4_volatility_regime", _LAST + f""",
h AS (SELECT ticker, date, vol20, list(vol20) FILTER (vol20 IS NOT NULL) OVER {wk(60)} AS hist FROM x),
s AS (SELECT ticker, date, vol20, list_sort(hist) AS h, coalesce(len(hist), 0) AS n FROM h)
SELECT ticker, date, CASE WHEN vol20 IS NULL OR n < 10 THEN 'INSUFFICIENT_DATA' WHEN vol20 <= h[n // 3 + 1] THEN 'LOW'
  WHEN vol20 >= h[2 * n // 3 + 1] THEN 'HIGH' ELSE 'NORMAL' END AS regime FROM s""")
def c4(spark, sf):
    x = ft.with_bar_inputs(bv.bars(spark, sf)).withColumn("vol20", F.round(ft.volatility(20), 8))
    x = x.withColumn("hist", F.collect_list("vol20").over(ft.last_rows(60)))
    return x.select("ticker", "date", cl.volatility_regime("vol20", "hist").alias("regime"))


@query("c5_c6_trend_states", f"""
WITH h AS (SELECT ticker, date, list(volume) OVER {wk(60)} AS v, list(close) OVER {wk(8)} AS c FROM bars_i),
s AS (SELECT *, (v[len(v)] - v[1]) / (len(v) - 1) AS vm, v[len(v)] - v[len(v) - 1] AS vl, -(c[len(c)] - c[1]) / (len(c) - 1) AS cm,
      -(c[len(c)] - c[len(c) - 1]) AS cl FROM h)
SELECT ticker, date, CASE WHEN len(v) < 2 THEN 'INSUFFICIENT_DATA' WHEN vm > 0.02 AND vl >= -0.02 THEN 'INCREASING'
  WHEN vm < -0.02 AND vl <= 0.02 THEN 'DECREASING' ELSE 'STABLE' END AS volume_trend,
  CASE WHEN len(c) < 2 THEN 'INSUFFICIENT_DATA' WHEN cm > 0.02 AND cl >= -0.02 THEN 'IMPROVING'
  WHEN cm < -0.02 AND cl <= 0.02 THEN 'DETERIORATING' ELSE 'STABLE' END AS falling_close FROM s""")
def c5(spark, sf):
    x = bv.bars(spark, sf).withColumn("v", F.collect_list("volume").over(ft.last_rows(60))) \
                          .withColumn("c", F.collect_list("close").over(ft.last_rows(8)))
    return x.select("ticker", "date", cl.volume_trend("v").alias("volume_trend"), cl.trend_state("c", higher_is_better=False).alias("falling_close"))


@query("c7_c10_valuation_horizon_labels", """
WITH x AS (SELECT o_orderkey, CASE WHEN o_custkey % 7 <> 0 THEN o_totalprice / 10000 - 5 END AS pe,
  CASE WHEN o_custkey % 5 <> 0 THEN round(o_totalprice / 10000 * (0.8 + (o_custkey % 40) / 100), 6) END AS fpe,
  o_custkey % 3000 - 10 AS days, CASE WHEN o_custkey % 11 <> 0 THEN round(o_totalprice / 500000 - 0.5, 4) END AS score FROM orders)
SELECT o_orderkey, CASE WHEN pe IS NULL OR fpe IS NULL OR pe <= 0 THEN 'INSUFFICIENT_DATA' WHEN (fpe - pe) / pe <= -0.05 THEN 'IMPROVING'
    WHEN (fpe - pe) / pe >= 0.05 THEN 'DETERIORATING' ELSE 'STABLE' END AS valuation,
  CASE WHEN days <= 5 THEN 'very_short_term' WHEN days <= 90 THEN 'short_term' WHEN days <= 730 THEN 'medium_term' ELSE 'long_term' END AS category,
  CASE WHEN days <= 3 THEN 'VERY_SHORT' WHEN days <= 14 THEN 'SHORT' WHEN days <= 182 THEN 'MEDIUM' WHEN days <= 730 THEN 'LONG' ELSE 'VERY_LONG' END AS profile,
  CASE WHEN score IS NULL THEN 'Insufficient data' WHEN score >= 0.3 THEN 'Strong' WHEN score >= 0.1 THEN 'Favorable' WHEN score <= -0.1 THEN 'Unfavorable' ELSE 'Neutral' END AS label,
  CASE WHEN score IS NULL THEN 'INSUFFICIENT_EVIDENCE' WHEN score > 0.15 THEN 'POSITIVE' WHEN score < -0.15 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS view FROM x""")
def c7(spark, sf):
    c, p = F.col("o_custkey"), F.col("o_totalprice")
    x = bv.table(spark, sf, "orders").select(
        "o_orderkey", F.when(c % 7 != 0, p / 10000 - 5).alias("pe"), F.when(c % 5 != 0, F.round(p / 10000 * (0.8 + (c % 40) / 100), 6)).alias("fpe"),
        (c % 3000 - 10).alias("days"), F.when(c % 11 != 0, F.round(p / 500000 - 0.5, 4)).alias("score"))
    return x.select("o_orderkey", cl.valuation_context("pe", "fpe").alias("valuation"), cl.horizon_category("days").alias("category"),
                    cl.horizon_profile("days").alias("profile"), cl.score_label("score").alias("label"), cl.view_label("score").alias("view"))


@query("c11_c12_sector_region", """
SELECT s_suppkey, CASE WHEN sic IS NULL THEN 'unknown' WHEN sic <= 999 THEN 'agriculture' WHEN sic <= 1499 THEN 'mining' WHEN sic <= 1799 THEN 'construction'
  WHEN sic <= 3999 THEN 'manufacturing' WHEN sic <= 4999 THEN 'transport_utilities' WHEN sic <= 5199 THEN 'wholesale' WHEN sic <= 5999 THEN 'retail'
  WHEN sic <= 6799 THEN 'finance' WHEN sic <= 8999 THEN 'services' ELSE 'public_admin' END AS sector,
  CASE country WHEN 'Canada' THEN 'North America' WHEN 'United States' THEN 'North America' WHEN 'Germany' THEN 'Europe' WHEN 'France' THEN 'Europe'
  WHEN 'United Kingdom' THEN 'Europe' WHEN 'Japan' THEN 'Asia' WHEN 'China' THEN 'Asia' WHEN 'India' THEN 'Asia' WHEN 'Argentina' THEN 'Latin America'
  WHEN 'Brazil' THEN 'Latin America' WHEN '' THEN NULL ELSE 'Other' END AS region
FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 23 <> 0 THEN s_suppkey * 97 % 9999 END AS sic,
  CASE WHEN n_name IN ('KENYA') THEN '' ELSE array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') END AS country
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)""")
def c11(spark, sf):
    s, n = bv.table(spark, sf, "supplier"), bv.table(spark, sf, "nation")
    k = F.col("s_suppkey")
    x = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).select(   # nation: a fixed code list
        "s_suppkey", F.when(k % 23 != 0, k * 97 % 9999).alias("sic"), F.when(F.col("n_name") == "KENYA", "").otherwise(F.initcap("n_name")).alias("country"))
    return x.select("s_suppkey", cl.sic_division("sic").alias("sector"), cl.region_of_country("country").alias("region"))


@query("c13_data_freshness", """
WITH x AS (SELECT o_orderkey, DATE '2001-09-01' AS now, CAST(o_orderdate AS DATE) AS p, CASE WHEN o_custkey % 3 <> 0 THEN CAST(o_orderdate AS DATE) + 500 END AS f,
  CAST(o_orderdate AS DATE) + 900 AS i, CASE o_custkey % 4 WHEN 0 THEN 'very_short_term' WHEN 1 THEN 'short_term' WHEN 2 THEN 'medium_term' ELSE 'long_term' END AS cat FROM orders),
y AS (SELECT *, now - p > CASE cat WHEN 'very_short_term' THEN 1 WHEN 'short_term' THEN 5 WHEN 'medium_term' THEN 20 ELSE 90 END AS ps,
  coalesce(now - f > CASE WHEN cat = 'long_term' THEN 400 ELSE 200 END, false) AS fs, now - i > CASE WHEN cat = 'long_term' THEN 800 ELSE 400 END AS ist FROM x)
SELECT o_orderkey, ps AS price_stale, fs AS fundamentals_stale, ist AS institutional_stale,
  CASE WHEN (cat IN ('very_short_term', 'short_term') AND ps) OR (cat NOT IN ('very_short_term', 'short_term') AND (fs OR ist)) THEN 'STALE' ELSE 'OK' END AS status FROM y""")
def c13(spark, sf):
    d, c = F.to_date("o_orderdate"), F.col("o_custkey")
    x = bv.table(spark, sf, "orders").select(
        "o_orderkey", F.to_date(F.lit("2001-09-01")).alias("now"), d.alias("p"), F.when(c % 3 != 0, F.date_add(d, 500)).alias("f"), F.date_add(d, 900).alias("i"),
        F.when(c % 4 == 0, "very_short_term").when(c % 4 == 1, "short_term").when(c % 4 == 2, "medium_term").otherwise("long_term").alias("cat"))
    return x.select("o_orderkey", cl.freshness("cat", "now", "p", "f", "i").alias("s")).select("o_orderkey", "s.*")


@query("c14_horizon_bars", """
SELECT user_id, time_bucket(INTERVAL 30 MINUTE, ts) AS bar_start, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
  arg_max(value, (ts, event_id)) AS close, count(*) AS volume FROM events GROUP BY 1, 2""")
def c14(spark, sf):
    """Bars at the width the two-week horizon asks for."""
    return ft.resample_bars(bv.table(spark, sf, "events"), "30 minutes", "user_id", "ts", "value", ["ts", "event_id"])


# --- T: alignment ------------------------------------------------------------------------------------------

@query("t7_calendar_positions", """
WITH e AS (SELECT event_id, CAST(o.o_orderdate AS DATE) AS signal_date FROM (SELECT o_orderkey AS event_id, o_orderdate FROM orders) o)
SELECT e.event_id, e.signal_date, c.pos FROM e ASOF JOIN cal c ON e.signal_date >= c.date""")
def t7(spark, sf):
    e = bv.table(spark, sf, "orders").select(F.col("o_orderkey").alias("event_id"), F.to_date("o_orderdate").alias("signal_date"))
    return asof.signal_positions(e, bv.calendar(spark, sf))


@query("t8_aligned_ohlc", "SELECT ticker, date, pos, open, high, low, close FROM grid")
def t8(spark, sf):
    return bv.grid(spark, sf)


@query("t9_t10_filled_closes", """
SELECT ticker, date, last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY pos ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS filled5,
  last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY pos ROWS UNBOUNDED PRECEDING) AS filled FROM grid""")
def t9(spark, sf):
    g = bv.grid(spark, sf)
    return asof.filled_closes(asof.filled_closes(g, 5, "filled5"), None, "filled").select("ticker", "date", "filled5", "filled")


@query("t11_rebalance_dates", "SELECT date, pos FROM cal WHERE pos >= 52 AND (pos - 52) % 4 = 0 AND date >= DATE '1997-01-01' AND date <= DATE '2001-01-01'")
def t11(spark, sf):
    return asof.rebalance_dates(bv.calendar(spark, sf), 4, 52, "1997-01-01", "2001-01-01")


@query("t12_month_ends", "SELECT CAST(date_trunc('month', date) AS DATE) AS month, max(date) AS date, max(pos) AS pos FROM cal WHERE date >= DATE '1996-01-01' GROUP BY 1")
def t12(spark, sf):
    return asof.month_ends(bv.calendar(spark, sf), "1996-01-01")


@query("t15_month_changes", """
WITH m AS (SELECT ticker, date, close, volume FROM bars QUALIFY row_number() OVER (PARTITION BY ticker, year(date), month(date) ORDER BY date DESC) = 1)
SELECT a.ticker, a.date, round(a.close - b.close, 6) + 0.0 AS close_chg3m, a.volume - b.volume AS volume_chg3m FROM m a LEFT JOIN m b
ON a.ticker = b.ticker AND year(a.date) * 12 + month(a.date) - 3 = year(b.date) * 12 + month(b.date)""")
def t15(spark, sf):
    b = bv.bars(spark, sf).withColumn("_m", F.trunc("date", "month"))
    m = asof.latest_per_key(b.select("ticker", "_m", "date", "close", "volume"), ["ticker", "_m"], ["date"]).drop("_m")
    return tidy(asof.month_changes(m, ["close", "volume"], 3), "ticker", "date", "close_chg3m", "volume_chg3m")


@query("t16_raw_close", """
SELECT ticker, date, round(close_split_adj * coalesce(product(CASE WHEN split > 0 THEN split ELSE 1 END) OVER
  (PARTITION BY ticker ORDER BY date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1), 6) + 0.0 AS raw_close FROM bars""")
def t16(spark, sf):
    return tidy(asof.raw_close(bv.bars(spark, sf)), "ticker", "date", "raw_close")


# --- L: labels and outcomes ----------------------------------------------------------------------------------

@query("l1_forward_returns", f"SELECT ticker, date, {rounded('fwd_return fwd_excess')} FROM fwd8")
def l1(spark, sf):
    b = bv.bars(spark, sf)
    return tidy(oc.forward_returns(asof.filled_closes(bv.grid(spark, sf), 5), bv.bench_grid(spark, sf), 8), "ticker", "date", "fwd_return", "fwd_excess")


@query("l2_next_open_returns", """
WITH r AS MATERIALIZED (SELECT date, pos, lead(pos) OVER (ORDER BY pos) AS npos FROM cal WHERE pos >= 52 AND (pos - 52) % 4 = 0),
f AS MATERIALIZED (SELECT ticker, date, pos, open, last_value(close IGNORE NULLS) OVER w AS lastc, last_value(CASE WHEN close IS NOT NULL THEN pos END IGNORE NULLS) OVER w AS lastp
  FROM grid WINDOW w AS (PARTITION BY ticker ORDER BY pos ROWS UNBOUNDED PRECEDING)),
k AS (SELECT f.ticker, r.date, r.pos + 1 AS a, r.npos + 1 AS b FROM f JOIN r ON f.pos = r.pos)
SELECT k.ticker, k.date, round(CASE WHEN e.open > 0 THEN coalesce(z.open, CASE WHEN z.lastp >= k.a THEN z.lastc END) / e.open - 1 END, 6) + 0.0 AS next_return
FROM k LEFT JOIN f e ON e.ticker = k.ticker AND e.pos = k.a LEFT JOIN f z ON z.ticker = k.ticker AND z.pos = k.b""")
def l2(spark, sf):
    b = bv.bars(spark, sf)
    at = asof.rebalance_dates(bv.calendar(spark, sf), 4, 52)
    g = bv.grid(spark, sf)
    keys = g.select("ticker", "date", "pos").join(at.select("date"), "date")
    return tidy(oc.next_open_returns(keys, g), "ticker", "date", "next_return")


@query("l3_next_month_returns", """
WITH r AS (SELECT date, lead(date) OVER (ORDER BY date) AS nd FROM cal WHERE pos >= 52 AND (pos - 52) % 4 = 0),
k AS (SELECT t.ticker, r.date, r.nd FROM (SELECT DISTINCT ticker FROM bars) t CROSS JOIN r),
a AS (SELECT k.*, b.open AS o0 FROM k ASOF LEFT JOIN bars b ON k.ticker = b.ticker AND k.date < b.date)
SELECT a.ticker, a.date, z.date AS exit_date, round(z.open / o0 - 1, 6) + 0.0 AS next_return FROM a ASOF LEFT JOIN bars z ON a.ticker = z.ticker AND a.nd < z.date""")
def l3(spark, sf):
    b = bv.bars(spark, sf)
    at = asof.rebalance_dates(bv.calendar(spark, sf), 4, 52).select("date")
    keys = bv.grid(spark, sf).select("ticker", "date").join(at, "date")
    return tidy(oc.next_month_returns(keys, b), "ticker", "date", "exit_date", "next_return")


@query("l4_benchmark_period_returns", """
WITH o AS (SELECT date, pos, lead(open) OVER (ORDER BY pos) AS o FROM bench),
s AS (SELECT * FROM o WHERE pos >= 52 AND (pos - 52) % 4 = 0) SELECT date, round(lead(o) OVER (ORDER BY pos) / o - 1, 6) + 0.0 AS bench_return FROM s""")
def l4(spark, sf):
    b = bv.bars(spark, sf)
    return tidy(oc.benchmark_period_returns(bv.bench_grid(spark, sf), asof.rebalance_dates(bv.calendar(spark, sf), 4, 52)))


# Every fourth bar is a signal; levels are rounded so that both engines test the same price.
_SIG = f"""
sig AS (SELECT ticker, date, pos, close, round({ATR14}, 6) AS atr FROM bars_i i JOIN cal c USING (date)),
cand AS (SELECT * FROM sig WHERE pos % 4 = 0 AND atr IS NOT NULL)"""


def _walk(hold: int, keys: str = "ticker, pos", src: str = "lv") -> str:
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    return f"""
ent AS (SELECT s.*, g.open AS entry FROM {src} s LEFT JOIN grid g ON g.ticker = s.ticker AND g.pos = s.pos + 1),
bx AS (SELECT s.*, b.pos - s.pos - 1 AS k, b.open AS o, b.high AS h, b.low AS l, b.close AS c FROM ent s JOIN grid b ON b.ticker = s.ticker AND b.pos BETWEEN s.pos + 1 AND s.pos + {hold}),
ev AS (SELECT {keys}, min(k) FILTER ((k > 0 AND o <= stop) OR l <= stop) AS ks, min(k) FILTER ((k > 0 AND o >= target) OR h >= target) AS kt,
  coalesce(min(k) FILTER (c IS NULL), count(*)) AS km FROM bx GROUP BY {keys}),
dec AS (SELECT a.*, CASE WHEN NOT coalesce(stop > 0 AND entry > stop AND entry < target, false) THEN 'skipped'
  WHEN ks < km AND (kt IS NULL OR ks <= kt) THEN 'stop' WHEN kt < km AND (ks IS NULL OR kt < ks) THEN 'target' WHEN km < {hold} THEN 'data_end' ELSE 'time' END AS outcome, ks, kt, km
  FROM ent a LEFT JOIN ev b ON {on}),
fin AS (SELECT *, CASE outcome WHEN 'stop' THEN ks WHEN 'target' THEN kt WHEN 'data_end' THEN greatest(km - 1, 0) WHEN 'time' THEN {hold} - 1 END AS k FROM dec),
px AS (SELECT f.*, CASE outcome WHEN 'target' THEN target WHEN 'stop' THEN CASE WHEN k > 0 AND g.open <= stop THEN g.open ELSE stop END ELSE g.close END AS exit_price
  FROM fin f LEFT JOIN grid g ON g.ticker = f.ticker AND g.pos = f.pos + 1 + f.k),
tr AS (SELECT *, CASE WHEN outcome <> 'skipped' THEN exit_price * (1 - 0.0015) / (entry * (1 + 0.0015)) - 1 END AS ret FROM px)"""


def _candidates(spark, sf, b=None):
    b = bv.bars(spark, sf) if b is None else b
    lv = ft.level_inputs(b).select("ticker", "date", "close", F.round("atr_14d", 6).alias("atr_14d"))
    return lv.join(bv.calendar(spark, sf), "date").filter((F.col("pos") % 4 == 0) & F.col("atr_14d").isNotNull())


@query("l5_net_return", "SELECT ticker, date, round(close * (1 - 0.0015) / (open * (1 + 0.0015)) - 1, 6) + 0.0 AS net FROM bars")
def l5(spark, sf):
    return tidy(bv.bars(spark, sf).select("ticker", "date", oc.net_return(F.col("open"), F.col("close")).alias("net")))


@query("l6_walk_barriers", f"""
WITH {_SIG}, lv AS (SELECT *, round(close - 2 * atr, 6) AS stop, round(close + 4 * atr, 6) AS target FROM cand), {_walk(10)}
SELECT ticker, pos, outcome, CASE WHEN outcome <> 'skipped' THEN CAST(pos + 1 + k AS INTEGER) END AS exit_pos, round(exit_price, 6) + 0.0 AS exit_price,
  CASE WHEN outcome <> 'skipped' THEN CAST(k + 1 AS INTEGER) END AS days_held, round(ret, 6) + 0.0 AS ret,
  round(CASE WHEN outcome <> 'skipped' THEN ret / ((entry - stop) / entry) END, 6) + 0.0 AS r_multiple,
  CASE WHEN outcome <> 'skipped' THEN CASE WHEN outcome = 'target' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS y FROM tr""")
def l6(spark, sf):
    b = bv.bars(spark, sf)
    lv = _candidates(spark, sf, b).withColumn("stop", F.round(F.col("close") - 2 * F.col("atr_14d"), 6)) \
                                  .withColumn("target", F.round(F.col("close") + 4 * F.col("atr_14d"), 6))
    walked = oc.walk_barriers(lv, bv.grid(spark, sf), "stop", "target", 10)
    return tidy(walked, "ticker", "pos", "outcome", "exit_pos", "exit_price", "days_held", "ret", "r_multiple", "y")


@query("l7_walk_trailing_stop", f"""
WITH {_SIG}, gm AS MATERIALIZED (SELECT * FROM grid), ent AS MATERIALIZED (SELECT s.ticker, s.pos, s.atr, s.close - 2 * atr AS stop0, g.open AS entry FROM cand s LEFT JOIN gm g ON g.ticker = s.ticker AND g.pos = s.pos + 1),
bx AS MATERIALIZED (SELECT s.ticker, s.pos, b.pos - s.pos - 1 AS k, b.open AS o, b.low AS l, b.close AS c,
  greatest(s.stop0, max(b.high) OVER (PARTITION BY s.ticker, s.pos ORDER BY b.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 2 * s.atr) AS st
  FROM (SELECT *, pos + unnest(range(1, 13)) AS at_pos FROM ent) s JOIN gm b ON b.ticker = s.ticker AND b.pos = s.at_pos),
ev AS (SELECT ticker, pos, min(k) FILTER ((k > 0 AND o <= st + 1e-9) OR l <= st + 1e-9) AS ks, coalesce(min(k) FILTER (c IS NULL), count(*)) AS km FROM bx GROUP BY 1, 2),
dec AS (SELECT a.*, ks, km, CASE WHEN NOT coalesce(stop0 > 0 AND entry > stop0, false) THEN 'skipped' WHEN ks < km THEN 'stop' WHEN km < 12 THEN 'data_end' ELSE 'time' END AS outcome
  FROM ent a LEFT JOIN ev b ON a.ticker = b.ticker AND a.pos = b.pos),
fin AS MATERIALIZED (SELECT *, CASE outcome WHEN 'stop' THEN ks WHEN 'data_end' THEN greatest(km - 1, 0) WHEN 'time' THEN 11 END AS kk FROM dec),
px AS (SELECT f.*, CASE outcome WHEN 'stop' THEN CASE WHEN kk > 0 AND x.o <= x.st THEN x.o ELSE x.st END
  WHEN 'data_end' THEN CASE WHEN km = 0 THEN entry ELSE x.c END WHEN 'time' THEN x.c END AS exit_price
  FROM fin f LEFT JOIN bx x ON x.ticker = f.ticker AND x.pos = f.pos AND x.k = f.kk)
SELECT ticker, pos, outcome, CAST(kk + 1 AS INTEGER) AS days_held, round(exit_price, 6) + 0.0 AS exit_price,
  round(exit_price * (1 - 0.0015) / (entry * (1 + 0.0015)) - 1, 6) + 0.0 AS ret FROM px""")
def l7(spark, sf):
    b = bv.bars(spark, sf)
    walked = oc.walk_trailing_stop(_candidates(spark, sf, b), bv.grid(spark, sf), "atr_14d", 2.0, 12)
    return tidy(walked, "ticker", "pos", "outcome", "days_held", "exit_price", "ret")


@query("l9_geometry_grid", f"""
WITH {_SIG}, lv AS (SELECT c.*, s, t, round(close - s * atr, 6) AS stop, round(close + t * (close - (close - s * atr)), 6) AS target FROM cand c
  CROSS JOIN (VALUES (1.5::DOUBLE), (2.0::DOUBLE), (3.0::DOUBLE)) a(s) CROSS JOIN (VALUES (1.5::DOUBLE), (2.0::DOUBLE), (3.0::DOUBLE)) z(t)), {_walk(10, 'ticker, pos, s, t')}
SELECT s AS stop_atr, t AS target_r, outcome, count(*) AS n, round(avg(ret), 6) + 0.0 AS mean_ret FROM tr GROUP BY 1, 2, 3""")
def l9(spark, sf):
    """Nine stop x target cells at one holding period, summarised per outcome."""
    b = bv.bars(spark, sf)
    base = _candidates(spark, sf, b)
    cells = base.withColumn("_g", F.explode(oc.geometry_grid(holds=(10,)))).select(*base.columns, "_g.*")
    lv = oc.grid_levels(cells, F.col("stop_atr"), F.col("target_r")).withColumn("stop", F.round("stop", 6)).withColumn("target", F.round("target", 6))
    walked = oc.walk_barriers(lv, bv.grid(spark, sf), "stop", "target", 10)
    return tidy(walked.groupBy("stop_atr", "target_r", "outcome").agg(F.count(F.lit(1)).alias("n"), F.avg("ret").alias("mean_ret")))


@query("l9_geometry_grid_27", f"""
WITH {_SIG}, gm AS MATERIALIZED (SELECT * FROM grid), lv AS MATERIALIZED (SELECT c.ticker, c.pos, s, t, c.close - s * atr AS stop, c.close + t * (c.close - (c.close - s * atr)) AS target, g.open AS entry FROM cand c
  CROSS JOIN (VALUES (1.5::DOUBLE), (2.0::DOUBLE), (3.0::DOUBLE)) a(s) CROSS JOIN (VALUES (1.5::DOUBLE), (2.0::DOUBLE), (3.0::DOUBLE)) z(t) LEFT JOIN gm g ON g.ticker = c.ticker AND g.pos = c.pos + 1),
bx AS (SELECT v.*, b.pos - v.pos - 1 AS k, b.open AS o, b.high AS h, b.low AS l, b.close AS c FROM (SELECT *, pos + unnest(range(1, 21)) AS at_pos FROM lv) v JOIN gm b ON b.ticker = v.ticker AND b.pos = v.at_pos),
ev AS (SELECT ticker, pos, s, t, any_value(stop) AS stop, any_value(target) AS target, any_value(entry) AS entry, min(k) FILTER ((k > 0 AND o <= stop) OR l <= stop) AS ks, min(k) FILTER ((k > 0 AND o >= target) OR h >= target) AS kt,
  coalesce(min(k) FILTER (c IS NULL), count(*)) AS km FROM bx GROUP BY 1, 2, 3, 4),
dec AS (SELECT e.*, hold, CASE WHEN NOT coalesce(stop > 0 AND entry > stop AND entry < target, false) THEN 'skipped'
  WHEN ks < least(km, hold) AND (kt IS NULL OR ks <= kt) THEN 'stop' WHEN kt < least(km, hold) AND (ks IS NULL OR kt < ks) THEN 'target' WHEN km < hold THEN 'data_end' ELSE 'time' END AS outcome FROM ev e CROSS JOIN (VALUES (5), (10), (20)) y(hold)),
fin AS (SELECT *, CASE outcome WHEN 'stop' THEN ks WHEN 'target' THEN kt WHEN 'data_end' THEN greatest(km - 1, 0) WHEN 'time' THEN hold - 1 END AS k FROM dec),
px AS (SELECT f.*, CASE outcome WHEN 'target' THEN target WHEN 'stop' THEN CASE WHEN k > 0 AND g.open <= stop THEN g.open ELSE stop END WHEN 'skipped' THEN NULL ELSE g.close END AS exit_price
  FROM fin f LEFT JOIN gm g ON g.ticker = f.ticker AND g.pos = f.pos + 1 + f.k),
r AS (SELECT s, t, hold, avg((exit_price * (1 - 0.0015) / (entry * (1 + 0.0015)) - 1) / ((entry - stop) / entry)) AS r FROM px GROUP BY 1, 2, 3)
SELECT s AS stop_atr, t AS target_r, round(any_value(r) FILTER (hold = 5), 6) + 0.0 AS hold_5, round(any_value(r) FILTER (hold = 10), 6) + 0.0 AS hold_10, round(any_value(r) FILTER (hold = 20), 6) + 0.0 AS hold_20 FROM r GROUP BY 1, 2""")
def l9_full(spark, sf):
    """The whole 27-cell grid (stop x target x hold), pivoted by holding period."""
    b = bv.bars(spark, sf)
    walked = oc.grid_outcomes(_candidates(spark, sf, b), bv.grid(spark, sf))
    return tidy(walked.groupBy("stop_atr", "target_r").pivot("hold", [5, 10, 20]).agg(F.avg("r_multiple").alias("r"))
                .toDF("stop_atr", "target_r", "hold_5", "hold_10", "hold_20"))


_TARGETS = f"""
WITH {_SIG}, brk AS (SELECT ticker, date AS break_date FROM bars_i WHERE ret < -0.06),
s0 AS (SELECT c.ticker, c.date AS signal_date, c.pos, e.date AS entry_date, e.open AS entry FROM cand c JOIN grid e ON e.ticker = c.ticker AND e.pos = c.pos + 1 AND e.open IS NOT NULL),
mx AS (SELECT max(pos) AS m FROM cal),
s1 AS (SELECT s0.*, pos + 1 AS f, least(pos + 40, m) AS t FROM s0, mx),
lastp AS (SELECT s1.ticker, s1.pos, max(g.pos) AS lp FROM s1 JOIN grid g ON g.ticker = s1.ticker AND g.pos BETWEEN s1.f AND s1.t AND g.close IS NOT NULL GROUP BY 1, 2),
s2 AS (SELECT s1.*, lp FROM s1 JOIN lastp l ON l.ticker = s1.ticker AND l.pos = s1.pos),
s3 AS (SELECT s2.*, b.break_date FROM s2 ASOF LEFT JOIN brk b ON b.ticker = s2.ticker AND s2.entry_date <= b.break_date),
s4 AS (SELECT s3.*, CASE WHEN c.pos <= t THEN c.pos END AS bp FROM s3 ASOF LEFT JOIN cal c ON s3.break_date < c.date),
s5 AS (SELECT s4.*, tg, entry * (1 + tg) AS lvl FROM s4 CROSS JOIN (VALUES (0.05::DOUBLE), (0.1::DOUBLE), (0.2::DOUBLE)) v(tg)),
hit AS (SELECT s5.ticker, s5.pos, s5.tg, min(g.pos) AS hp FROM s5 JOIN grid g ON g.ticker = s5.ticker AND g.pos BETWEEN s5.f AND s5.lp AND g.high >= s5.lvl GROUP BY 1, 2, 3),
o AS (SELECT s5.*, hp, CASE WHEN hp IS NOT NULL AND (bp IS NULL OR hp < bp) THEN 'target' WHEN bp <= lp THEN 'thesis_break' WHEN lp - f >= 39 THEN 'cap' ELSE 'data_end' END AS reason
  FROM s5 LEFT JOIN hit h ON h.ticker = s5.ticker AND h.pos = s5.pos AND h.tg = s5.tg),
x AS (SELECT *, CASE reason WHEN 'target' THEN hp WHEN 'thesis_break' THEN bp ELSE lp END AS xp FROM o),
y AS (SELECT x.*, CASE reason WHEN 'target' THEN lvl WHEN 'thesis_break' THEN g.open ELSE g.close END AS exit_price, c.date AS exit_date
  FROM x JOIN cal c ON c.pos = x.xp LEFT JOIN grid g ON g.ticker = x.ticker AND g.pos = x.xp)"""


def _target_outcomes(spark, sf, targets=(0.05, 0.1, 0.2), cap=40):
    b = bv.bars(spark, sf)
    g, cal = bv.grid(spark, sf), bv.calendar(spark, sf)
    sig = _candidates(spark, sf, b).select("ticker", F.col("date").alias("signal_date"), "pos")
    brk = b.withColumn("ret", ft.daily_return()).filter(F.col("ret") < -0.06).select("ticker", F.col("date").alias("break_date"))
    return oc.target_outcomes(sig, g, cal, brk, targets, cap=cap, block=16), cal


@query("l10_target_outcomes", _TARGETS + """
SELECT ticker, signal_date, tg AS target, entry_date, CAST(reason = 'target' AS INTEGER) AS event, CAST(xp - f + 1 AS INTEGER) AS duration, reason, exit_date,
  round(exit_price, 6) + 0.0 AS exit_price, round(exit_price * (1 - 0.0015) / (entry * (1 + 0.0015)) - 1, 6) + 0.0 AS ret FROM y""")
def l10(spark, sf):
    out, _ = _target_outcomes(spark, sf)
    return tidy(out, "ticker", "signal_date", "target", "entry_date", "event", "duration", "reason", "exit_date", "exit_price", "ret")


@query("l11_censor_at", _TARGETS + """
, cut AS (SELECT max(pos) AS cp FROM cal WHERE date <= DATE '1999-06-30')
SELECT ticker, signal_date, tg AS target, CAST(CASE WHEN exit_date > DATE '1999-06-30' THEN 0 ELSE reason = 'target' END AS INTEGER) AS event,
  CAST(CASE WHEN exit_date > DATE '1999-06-30' THEN greatest(cp - f + 1, 1) ELSE xp - f + 1 END AS INTEGER) AS duration,
  CASE WHEN exit_date > DATE '1999-06-30' THEN 'open_at_cutoff' ELSE reason END AS reason FROM y, cut WHERE entry_date <= DATE '1999-06-30'""")
def l11(spark, sf):
    out, cal = _target_outcomes(spark, sf)
    return oc.censor_at(out, cal, "1999-06-30").select("ticker", "signal_date", "target", "event", "duration", "reason")


_EVENTS = f"""
px0 AS (SELECT *, round({ATR14}, 6) AS atr, CASE WHEN count(high) OVER {pk(20)} = 20 THEN max(high) OVER {pk(20)} END AS ph FROM bars_i i JOIN cal c USING (date)),
brkout AS (SELECT ticker, date, pos, close, atr, round((close / ph - 1), 6) AS strength FROM px0 WHERE close > ph AND atr IS NOT NULL)"""


def _breakouts(spark, sf, b):
    x = ft.level_inputs(b.withColumn("ph", ft.prior_high(20))).select("ticker", "date", "close", "ph", F.round("atr_14d", 6).alias("atr_14d"))
    return (x.filter((F.col("close") > F.col("ph")) & F.col("atr_14d").isNotNull()).join(bv.calendar(spark, sf), "date")
            .select("ticker", F.col("date").alias("signal_date"), "pos", F.round(F.col("close") / F.col("ph") - 1, 6).alias("strength"), "close", "atr_14d"))


@query("a0_breakout_study", f"""
WITH {_EVENTS}, lv AS (SELECT *, round(close - 2 * atr, 6) AS stop, round(close + 4 * atr, 6) AS target FROM brkout), {_walk(10)},
ex AS (SELECT t.*, ret - (bc.close / bo.open - 1) AS excess FROM tr t LEFT JOIN bench bo ON bo.pos = t.pos + 1 LEFT JOIN bench bc ON bc.pos = t.pos + 1 + t.k)
SELECT CAST(year(date) AS INTEGER) AS year, outcome, count(*) AS trades, round(avg(ret), 6) + 0.0 AS mean_ret, round(avg(excess), 6) + 0.0 AS mean_excess FROM ex GROUP BY 1, 2""")
def a0(spark, sf):
    """Breakout trades: two-ATR stop, two-R target, ten bars; outcome, net return and excess by year."""
    b = bv.bars(spark, sf)
    lv = _breakouts(spark, sf, b).withColumn("stop", F.round(F.col("close") - 2 * F.col("atr_14d"), 6)) \
                                 .withColumn("target", F.round(F.col("close") + 4 * F.col("atr_14d"), 6))
    walked = oc.walk_barriers(lv, bv.grid(spark, sf), "stop", "target", 10)
    bg = bv.bench_grid(spark, sf)
    x = (walked.join(bg.select(F.col("pos").alias("entry_pos"), F.col("open").alias("bo")), "entry_pos", "left")
         .join(bg.select(F.col("pos").alias("exit_pos"), F.col("close").alias("bc")), "exit_pos", "left")
         .withColumn("excess", F.col("ret") - (F.col("bc") / F.col("bo") - 1)))
    return tidy(x.groupBy(F.year("signal_date").alias("year"), "outcome").agg(
        F.count(F.lit(1)).alias("trades"), F.avg("ret").alias("mean_ret"), F.avg("excess").alias("mean_excess")))


# Trades of the breakout events with no stop and no target (pure time exit).
_TRADES = f"""
{_EVENTS}, lv AS (SELECT *, 1e-12::DOUBLE AS stop, 1e12::DOUBLE AS target FROM brkout), {_walk(8)},
trades AS (SELECT t.ticker, t.date AS signal_date, t.strength, t.pos, t.pos + 1 AS entry_pos, t.pos + 1 + t.k AS exit_pos, bo.date AS entry_date, bc.date AS exit_date,
  t.entry AS entry_price, t.exit_price, t.outcome, t.ret, bc.close / bo.open - 1 AS bench_ret, t.ret - (bc.close / bo.open - 1) AS excess
  FROM tr t JOIN bench bo ON bo.pos = t.pos + 1 JOIN bench bc ON bc.pos = t.pos + 1 + t.k WHERE outcome <> 'skipped' AND ret IS NOT NULL)"""


def breakout_trades(spark, sf, b=None, hold=8):
    b = bv.bars(spark, sf) if b is None else b
    events = _breakouts(spark, sf, b).select("ticker", "signal_date", "pos", "strength")
    return oc.build_trades(events, oc.barrier_outcome_table(bv.grid(spark, sf), bv.bench_grid(spark, sf), hold, entries=events))


@query("l13_build_trades", f"WITH {_TRADES} SELECT ticker, signal_date, entry_date, exit_date, outcome, {rounded('strength ret bench_ret excess')} FROM trades")
def l13(spark, sf):
    return tidy(breakout_trades(spark, sf), "ticker", "signal_date", "entry_date", "exit_date", "outcome", "strength", "ret", "bench_ret", "excess")


@query("l14_l15_period_trades", f"""
WITH {_TRADES}, p AS (SELECT *, CASE WHEN signal_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' AND exit_date <= DATE '1999-12-31' THEN 'development'
  WHEN signal_date >= DATE '2000-01-01' THEN 'holdout' END AS period FROM trades)
SELECT period, CASE WHEN outcome <> 'data_end' THEN 'closed' WHEN exit_date >= (SELECT max(date) FROM cal) THEN 'still_open' ELSE 'prices_stopped' END AS end_state,
  count(*) AS trades, round(avg(excess), 6) + 0.0 AS mean_excess FROM p WHERE period IS NOT NULL GROUP BY 1, 2""")
def l14(spark, sf):
    b = bv.bars(spark, sf)
    t = breakout_trades(spark, sf, b)
    split = [oc.period_trades(t, "1996-01-01", "1999-12-31", "2000-01-01", p).withColumn("period", F.lit(p)) for p in ("development", "holdout")]
    last = bv.calendar(spark, sf).agg(F.max("date").alias("last_date"))
    x = oc.open_or_delisted(split[0].unionByName(split[1]).transform(with_scalars, last), F.col("last_date"))   # one row
    return tidy(x.groupBy("period", "end_state").agg(F.count(F.lit(1)).alias("trades"), F.avg("excess").alias("mean_excess")))
