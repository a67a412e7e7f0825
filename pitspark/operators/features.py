"""Rolling price features over one shared window per ticker.

All windows of a ticker share the partitioning and the sort, so a whole bundle is one shuffle. A
ticker's partition holds one row per trading day (``latest_per_key`` enforces it), so its size is
bounded by the calendar, not by the data volume.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asof import asof_join, latest_per_key

TRADING_DAYS = 252


def by_ticker():
    return Window.partitionBy("ticker").orderBy("date")



def last_rows(k: int):
    return by_ticker().rowsBetween(-(k - 1), 0)


def rolling(fn, value: Column, k: int, min_rows: int | None = None) -> Column:
    """``fn(value)`` over the last k rows, null until they hold k (or ``min_rows``) non-null values."""
    need = k if min_rows is None else min_rows
    return F.when(F.count(value).over(last_rows(k)) >= need, fn(value).over(last_rows(k)))


def one_bar_per_day(bars: DataFrame, tiebreak: Sequence[str] = ("close",)) -> DataFrame:
    return latest_per_key(bars, ["ticker", "date"], list(tiebreak))


# --- single features --------------------------------------------------------------------------------

def trailing_return(k: int, close: str = "close") -> Column:
    """Return over k rows; from a price of zero it is infinite, and from zero to zero not a number."""
    was = F.lag(close, k).over(by_ticker())
    return F.when(was == 0, F.col(close) * F.lit(float("inf"))).otherwise(F.col(close) / was) - 1


def daily_return(close: str = "close") -> Column:
    return trailing_return(1, close)


def volatility(k: int, ret: str = "_ret") -> Column:
    """Sample deviation of the last k one-bar returns, annualised. ``ret`` is ``daily_return``."""
    return rolling(F.stddev_samp, F.col(ret), k) * F.sqrt(F.lit(float(TRADING_DAYS)))


def moving_average(k: int, value: str = "close") -> Column:
    return rolling(F.avg, F.col(value), k)


def price_vs_ma(k: int, close: str = "close") -> Column:
    ma = moving_average(k, close)
    return F.when(ma != 0, F.col(close) / ma - 1)


def rsi(k: int = 14, delta: str = "_delta") -> Column:
    """Relative strength from simple means of the last k gains and losses; no loss at all reads 100."""
    gain = rolling(F.avg, F.greatest(F.col(delta), F.lit(0.0)), k)
    loss = rolling(F.avg, F.greatest(-F.col(delta), F.lit(0.0)), k)
    enough = F.count(F.col(delta)).over(last_rows(k)) == k
    return F.when(enough, F.when(loss == 0, 100.0).otherwise(100 - 100 / (1 + gain / loss)))


def volume_ratio(k: int = 21, volume: str = "volume") -> Column:
    """Volume over the mean of the previous k bars."""
    prev = by_ticker().rowsBetween(-k, -1)
    mean = F.when(F.count(F.lit(1)).over(prev) == k, F.avg(volume).over(prev))
    return F.when(mean != 0, F.col(volume) / mean)


def true_range() -> Column:
    prev = F.lag("close", 1).over(by_ticker())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))


def atr(k: int = 14, tr: str = "_tr") -> Column:
    """Simple mean of the last k true ranges; the first k rows of a ticker have none."""
    return F.when(F.row_number().over(by_ticker()) > k, rolling(F.avg, F.col(tr), k))


def swing_low(k: int = 60, low: str = "low") -> Column:
    return rolling(F.min, F.col(low), k)


def swing_high(k: int = 60, high: str = "high") -> Column:
    return rolling(F.max, F.col(high), k)


def momentum(skip: int = 21, back: int = 252, close: str = "close") -> Column:
    """Return from ``back`` bars ago to ``skip`` bars ago."""
    return F.lag(close, skip).over(by_ticker()) / F.lag(close, back).over(by_ticker()) - 1


def drawdown_from_high(k: int = 252) -> Column:
    high = rolling(F.max, F.col("high"), k)
    return F.when(high > 0, 1 - F.col("close") / high)


def prior_high(k: int = 20) -> Column:
    """Highest high of the k bars before this one."""
    prev = by_ticker().rowsBetween(-k, -1)
    return F.when(F.count("high").over(prev) == k, F.max("high").over(prev))


def dollar_volume(k: int = 20, min_rows: int = 15, price: str = "close_split_adj") -> Column:
    return rolling(F.avg, F.col(price) * F.col("volume"), k, min_rows)


# --- bundles ----------------------------------------------------------------------------------------

def with_bar_inputs(bars: DataFrame) -> DataFrame:
    """The per-bar intermediates several features share."""
    return (bars.withColumn("_ret", daily_return())
            .withColumn("_delta", F.col("close") - F.lag("close", 1).over(by_ticker()))
            .withColumn("_tr", true_range()))


def _clean(df: DataFrame) -> DataFrame:
    return df.drop("_ret", "_delta", "_tr")


def feature_bundle(bars: DataFrame) -> DataFrame:
    """The nineteen app features of every bar."""
    returns = {"return_1d": 1, "return_5d": 5, "return_20d": 20, "return_60d": 60, "return_1m": 21,
               "return_3m": 63, "return_6m": 126, "return_1y": 252}
    cols = {name: trailing_return(k) for name, k in returns.items()}
    cols |= {"volatility_1m": volatility(21), "atr_14d": atr(14),
             "moving_average_20d": moving_average(20), "moving_average_50d": moving_average(50),
             "moving_average_200d": moving_average(200),
             "price_vs_ma50": price_vs_ma(50), "price_vs_ma200": price_vs_ma(200),
             "rsi_14d": rsi(14), "volume_ratio": volume_ratio(21),
             "support_60d": swing_low(60), "resistance_60d": swing_high(60)}
    return _clean(with_bar_inputs(bars).withColumns(cols))


def level_inputs(bars: DataFrame, atr_window: int = 14, swing_window: int = 60) -> DataFrame:
    return _clean(with_bar_inputs(bars).withColumns({
        f"atr_{atr_window}d": atr(atr_window), f"support_{swing_window}d": swing_low(swing_window),
        f"resistance_{swing_window}d": swing_high(swing_window)}))


RETURN_WINDOWS = {"20d": 20, "60d": 60, "252d": 252}


def technical_history(bars: DataFrame) -> DataFrame:
    """Point-in-time technical fields of every bar, before the as-of pick."""
    cols = {f"return_{label}": trailing_return(k) for label, k in RETURN_WINDOWS.items()}
    cols |= {"volatility_20d": volatility(20), "volatility_60d": volatility(60), "volume_ratio": volume_ratio(21),
             "price_vs_ma50": price_vs_ma(50), "price_vs_ma200": price_vs_ma(200),
             "momentum_12_1": momentum(21, 252), "adj_close": F.col("close")}
    return (_clean(with_bar_inputs(bars).withColumns(cols))
            .select("ticker", F.col("date").alias("bar_date"), *cols.keys()))


def pit_technicals(keys: DataFrame, bars: DataFrame, benchmark: DataFrame | None = None, max_stale_days: int = 7,
                   keys_unique: bool = True) -> DataFrame:
    """Technical fields known at each (ticker, date) key; a key whose last bar is too old is dropped."""
    hist = technical_history(bars)
    fields = [c for c in hist.columns if c not in ("ticker", "bar_date")]
    out = asof_join(keys, hist, ["ticker"], "date", "bar_date", fields, max_age=max_stale_days, probe_unique=keys_unique)
    out = out.filter(F.col("bar_date").isNotNull()).drop("bar_date")
    if benchmark is None:
        return out
    bench = benchmark.withColumn("ticker", F.lit("_bench"))
    bench = bench.select(F.col("date").alias("b_date"), *[trailing_return(k).alias(f"_b_{label}") for label, k in RETURN_WINDOWS.items()])
    on_date = asof_join(keys.select("date").distinct(), bench, [], "date", "b_date",
                        [f"_b_{label}" for label in RETURN_WINDOWS], probe_unique=True).drop("b_date")
    out = out.join(on_date, "date", "left")
    for label in RETURN_WINDOWS:
        out = out.withColumn(f"relative_return_{label}", F.col(f"return_{label}") - F.col(f"_b_{label}"))
    return out.drop(*[f"_b_{label}" for label in RETURN_WINDOWS])


def return_observations(bars: DataFrame) -> DataFrame:
    """Six return horizons per ticker as of its last bar: value, start and end date, completeness."""
    windows = {"1d": 1, "5d": 5, "20d": 20, "60d": 60, "120d": 120, "252d": 252}
    obs = F.array(*[F.struct(F.lit(label).alias("horizon"), F.lag("date", k).over(by_ticker()).alias("start_date"),
                             F.col("date").alias("end_date"), trailing_return(k).alias("value"))
                    for label, k in windows.items()])
    last = bars.withColumn("obs", obs).groupBy("ticker").agg(F.max_by("obs", "date").alias("obs"))
    row = last.select("ticker", F.explode("obs").alias("o"))
    complete = F.col("o.start_date").isNotNull()
    return row.select("ticker", "o.horizon", "o.start_date", F.when(complete, F.col("o.end_date")).alias("end_date"),
                      "o.value", complete.alias("complete"))


def indicator_history(bars: DataFrame, keep: int = 60) -> DataFrame:
    """Last ``keep`` dated values of seven indicators, long form (ticker, metric, date, value)."""
    metrics = {"close": F.col("close"), "sma_20": moving_average(20), "sma_50": moving_average(50), "rsi_14": rsi(14),
               "atr_14": atr(14), "volatility_20d": volatility(20), "volume": F.col("volume").cast("double")}
    back = Window.partitionBy("ticker").orderBy(F.col("date").desc())
    wide = (with_bar_inputs(bars).withColumns({f"m_{n}": c for n, c in metrics.items()})
            .withColumn("_rn", F.row_number().over(back)).filter(F.col("_rn") <= keep))
    return wide.unpivot(["ticker", "date"], [f"m_{n}" for n in metrics], "metric", "value") \
               .withColumn("metric", F.expr("substring(metric, 3)"))


def chart_indicators(bars: DataFrame) -> DataFrame:
    return _clean(with_bar_inputs(bars).withColumns({
        "sma_20": moving_average(20), "sma_50": moving_average(50), "sma_200": moving_average(200), "rsi_14": rsi(14)}))


def resample_bars(ticks: DataFrame, width: str, key: str, ts: str, value: str, order: Sequence[str]) -> DataFrame:
    """Open/high/low/close/volume bars of a tick table on fixed time windows."""
    rank = F.struct(*order)
    return (ticks.groupBy(key, F.window(ts, width).alias("w"))
            .agg(F.min_by(value, rank).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"),
                 F.max_by(value, rank).alias("close"), F.count(F.lit(1)).alias("volume"))
            .select(key, F.col("w.start").alias("bar_start"), "open", "high", "low", "close", "volume"))


# --- quality ----------------------------------------------------------------------------------------

EXTREME_MOVE = 0.20
VOLUME_CONFIRMS = 1.5


def ohlcv_flags(bars: DataFrame) -> DataFrame:
    """Quality flags (ticker, date, flag); nothing is dropped from the bars.

    Duplicate dates are counted before ordering, so a table with many copies of one bar costs an
    aggregate, not a window. Any move from a price of zero is extreme.
    """
    per_day = bars.groupBy("ticker", "date").agg(F.count(F.lit(1)).alias("copies"))
    dup = (per_day.filter("copies > 1").select("ticker", "date", F.lit("INVALID_DATA:dates:duplicate_date").alias("flag")))
    size = bars.groupBy("ticker").agg(F.count(F.lit(1)).alias("rows"))
    short = (size.filter("rows < 20").select("ticker", F.lit(None).cast("date").alias("date"),
                                             F.format_string("INSUFFICIENT_HISTORY:only_%d_rows", "rows").alias("flag")))
    c, h, low, v = (F.col(x) for x in ("close", "high", "low", "volume"))
    row_rules = [(c < 0, "INVALID_DATA:price:negative_price"), (c.isNull(), "INVALID_DATA:price:missing_close"),
                 (h < low, "INVALID_DATA:ohlc:high_less_than_low"), (c > h, "INVALID_DATA:ohlc:close_above_high"),
                 (c < low, "INVALID_DATA:ohlc:close_below_low"), (v < 0, "INVALID_DATA:volume:negative_volume"),
                 (v == 0, "SUSPICIOUS_DATA:volume:zero_volume")]
    per_row = bars.select("ticker", "date", F.explode(F.array_compact(F.array(
        *[F.when(cond, F.lit(name)) for cond, name in row_rules]))).alias("flag"))

    prev20 = by_ticker().rowsBetween(-20, -1)
    daily = one_bar_per_day(bars, ["close", "volume"])
    moves = (daily.withColumn("_ret", daily_return())
             .withColumn("_base", F.when(F.count(F.lit(1)).over(prev20) == 20, F.avg("volume").over(prev20)))
             .join(size.filter("rows >= 21").select("ticker"), "ticker", "left_semi")
             .filter(F.abs("_ret") > EXTREME_MOVE))
    confirmed = F.coalesce((F.col("_base") != 0) & (F.col("volume") / F.col("_base") >= VOLUME_CONFIRMS), F.lit(False))
    extreme = moves.select("ticker", "date", F.when(confirmed, "VALID_EXTREME_MARKET_MOVE:returns")
                           .otherwise("SUSPICIOUS_DATA:returns").alias("flag"))
    return dup.unionByName(short).unionByName(per_row).unionByName(extreme)


def indicator_bound_flags(row: DataFrame, rsi_col: str, nonnegative: Sequence[str]) -> DataFrame:
    flags = [F.when(~F.col(rsi_col).between(0, 100), F.lit(f"INVALID_DATA:{rsi_col}:out_of_range"))]
    flags += [F.when(F.col(n) < 0, F.lit(f"INVALID_DATA:{n}:negative")) for n in nonnegative]
    return row.withColumn("bound_flags", F.array_compact(F.array(*flags)))
