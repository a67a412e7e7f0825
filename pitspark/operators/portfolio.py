"""Portfolio return series as set operations: no running cash ledger, no day-by-day loop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .asof import next_in_order
from .ranks import row_position


def top_fraction(panel: DataFrame, score: str, fraction: float, by: Sequence[str] = ()) -> DataFrame:
    """The best floor(n x fraction) names per date (at least one) of every series ``by``, ties by ticker; adds ``names``."""
    rows = panel.filter(F.col(score).isNotNull()).withColumn("_neg", -F.col(score))
    r = row_position(rows, [*by, "date"], ["_neg", "ticker"], "_rn")
    n = F.greatest(F.floor(F.col("_rn_n") * fraction), F.lit(1))
    return r.withColumn("names", n).filter(F.col("_rn") <= F.col("names")).drop("_neg", "_rn", "_rn_n")


def monthly_portfolio(panel: DataFrame, score: str, ret: str = "next_return", top_quantile: float = 0.10, max_weight: float = 0.05, cost: float = 0.0030, by: Sequence[str] = ()) -> DataFrame:
    """Per series ``by`` and date: gross return, turnover against the previous weights drifted by their returns, net return.

    The weights carried into a date depend on the previous date alone, so this is one self-join, for any number of
    series (variants of a score in long form) at once.
    """
    by = list(by)
    top = top_fraction(panel.select(*by, "date", "ticker", score, ret), score, top_quantile, by)
    w = F.least(1 / F.col("names"), F.lit(max_weight))
    held = top.select(*by, "date", "ticker", "names", w.alias("w"), F.coalesce(F.when(~F.isnan(ret), F.col(ret)), F.lit(0.0)).alias("r"))
    sums = held.groupBy(*by, "date").agg(F.sum("w").alias("_w"), F.sum(F.col("w") * (1 + F.col("r"))).alias("_grown"), F.sum(F.col("w") * F.col("r")).alias("gross"),
                                         F.max("names").alias("names"))
    steps = next_in_order(held, "date", "_next", by).filter(F.col("_next").isNotNull())
    grown = F.col("w") * (1 + F.col("r"))
    drifted = held.join(sums.select(*by, "date", "_w", "_grown"), [*by, "date"]).join(steps, [*by, "date"]).select(
        *by, F.col("_next").alias("date"), "ticker", F.when(F.col("_grown") > 0, grown / F.col("_grown") * F.col("_w")).otherwise(grown).alias("_prev"))
    turn = held.select(*by, "date", "ticker", "w").join(drifted, [*by, "date", "ticker"], "full").groupBy(*by, "date").agg(
        F.sum(F.abs(F.coalesce("w", F.lit(0.0)) - F.coalesce("_prev", F.lit(0.0)))).alias("turnover"))
    return sums.join(turn, [*by, "date"]).select(*by, "date", "gross", "turnover", (F.col("gross") - F.col("turnover") * cost).alias("net"), "names")


def decile_spread(panel: DataFrame, score: str, ret: str = "next_return", decile: float = 0.10, cost: float = 0.0015, by: Sequence[str] = ()) -> DataFrame:
    """Top minus bottom decile after the costs of both legs, which are two series of one plan."""
    sides = panel.select(*by, "date", "ticker", ret, F.explode(F.array(F.struct(F.lit(True).alias("_up"), F.col(score).alias("_s")), F.struct(F.lit(False).alias("_up"), (-F.col(score)).alias("_s")))).alias("_x"))
    legs = monthly_portfolio(sides.select(*by, "date", "ticker", ret, "_x._up", "_x._s"), "_s", ret, decile, 1.0, cost, [*by, "_up"])
    leg = lambda up, c: F.max(F.when(F.col("_up") == F.lit(up), c))
    both = legs.groupBy(*by, "date").agg(leg(True, F.col("net")).alias("_top"), leg(False, F.col("gross") + F.col("turnover") * cost).alias("_low"))
    return both.filter(F.col("_top").isNotNull() & F.col("_low").isNotNull()).select(*by, "date", (F.col("_top") - F.col("_low")).alias("spread_net"))


def vol_targeted(net: DataFrame, cash: DataFrame, target: float = 0.15, cap: float = 1.5, window: int = 12, min_rows: int = 6) -> DataFrame:
    """Monthly exposure that aims at ``target`` volatility from the previous months; the rest earns cash."""
    w = Window.orderBy("date").rowsBetween(-window, -1)            # one row per month
    sd = F.when(F.count("ret").over(w) >= min_rows, F.stddev_samp("ret").over(w)) * F.sqrt(F.lit(12.0))
    x = net.join(cash.select("date", F.col("cash")), "date", "left").withColumn("exposure", F.coalesce(F.least(target / sd, F.lit(cap)), F.lit(1.0)))
    return x.withColumn("targeted", F.col("exposure") * F.col("ret") + (1 - F.col("exposure")) * F.coalesce("cash", F.lit(0.0))).drop("cash")


def equal_weight_universe(members: DataFrame, closes: DataFrame) -> DataFrame:
    """Equal weight in every member, rebalanced on each signal date; ``closes``: (ticker, date, close) filled."""
    steps = next_in_order(members, "date", "_next").filter(F.col("_next").isNotNull())
    c0 = closes.select("ticker", "date", F.col("close").alias("_c0"))
    c1 = closes.select("ticker", F.col("date").alias("_next"), F.col("close").alias("_c1"))
    r = members.select("date", "ticker").join(steps, "date").join(c0, ["ticker", "date"], "left").join(c1, ["ticker", "_next"], "left")
    per = r.groupBy("_next").agg(F.coalesce(F.avg(F.col("_c1") / F.col("_c0") - 1), F.lit(0.0)).alias("ret"))
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return per.select(F.col("_next").alias("date"), "ret").withColumn("equity", F.product(1 + F.col("ret")).over(w))


def survivorship_adjusted(returns: DataFrame, unpriced: DataFrame, loss: float, period_days: int = 21, label_days: int = 63) -> DataFrame:
    """Returns had the portfolio also held the unpriced members at their share, each losing ``loss`` per label period."""
    per = -1.0 if loss >= 1 else (1 - loss) ** (period_days / label_days) - 1
    u = F.least(F.greatest(F.coalesce("unpriced_share", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return returns.join(unpriced, "date", "left").withColumn("adjusted", (1 - u) * F.col("ret") + u * per)


def monthly_points(equity: DataFrame, bench: DataFrame) -> DataFrame:
    """Month-end values of two series on common months, both rebased to 1 at the first month."""
    e = equity.select("date", F.col("equity").alias("s")).join(bench.select("date", F.col("close").alias("b")), "date", "full")
    fill = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    e = e.select("date", F.last("s", True).over(fill).alias("s"), F.last("b", True).over(fill).alias("b")).dropna()
    m = e.groupBy(F.last_day("date").alias("month_end")).agg(F.max_by(F.struct("s", "b"), "date").alias("v")).select("month_end", "v.s", "v.b")
    first = Window.orderBy("month_end").rowsBetween(Window.unboundedPreceding, 0)
    return m.select("month_end", F.round(F.col("s") / F.first("s").over(first), 4).alias("strategy"), F.round(F.col("b") / F.first("b").over(first), 4).alias("benchmark"))


def monthly_benchmark(bench: DataFrame) -> DataFrame:
    """Next-month return from each month's last trading day."""
    m = bench.groupBy(F.trunc("date", "month").alias("_m")).agg(F.max("date").alias("date"), F.max_by("close", "date").alias("_c"))
    w = Window.orderBy("date")
    return m.withColumn("bench_return", F.lead("_c").over(w) / F.col("_c") - 1).filter(F.col("bench_return").isNotNull()).select("date", "bench_return")


def held_closes(closes: DataFrame) -> DataFrame:
    """(ticker, pos, _c, _pc): forward-filled close and the close before, which several portfolios over the same grid can share."""
    own = Window.partitionBy("ticker").orderBy("pos")
    return closes.withColumn("_c", F.last("close", True).over(own.rowsBetween(Window.unboundedPreceding, 0))) \
                 .withColumn("_pc", F.lag("_c").over(own)).select("ticker", "pos", "_c", "_pc")


def calendar_time_portfolio(trades: DataFrame, closes: DataFrame, cal: DataFrame, max_entries: int | None = None, slots: int | None = None, cost: float = 0.0015,
                            scenario: str = "scenario") -> DataFrame:
    """Daily return, equity and exposure of the trades open each day, per scenario.

    With ``max_entries``, only so many trades enter per day, by strength then ticker. Open trades weigh equally, or
    1/slots each with the rest in cash. A trade earns entry price to close on its first day, close to
    close after, close to exit price on its last; costs fall on the first and the last day. ``closes`` may be ``held_closes`` already.
    """
    taken = trades
    if max_entries is not None:
        order = Window.partitionBy(scenario, "entry_pos").orderBy(F.col("strength").desc(), "ticker")
        taken = trades.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= max_entries).drop("_rn")
    days = taken.select(scenario, "ticker", "entry_pos", "exit_pos", "entry_price", "exit_price", F.explode(F.sequence("entry_pos", "exit_pos")).alias("pos"))
    c = closes if {"_c", "_pc"} <= set(closes.columns) else held_closes(closes)
    d = days.join(c, ["ticker", "pos"], "left")
    opened, closed = F.col("pos") == F.col("entry_pos"), F.col("pos") == F.col("exit_pos")
    start = F.when(opened, F.col("entry_price") * (1 + cost)).otherwise(F.col("_pc"))
    end = F.when(closed, F.col("exit_price") * (1 - cost)).otherwise(F.col("_c"))
    per = d.groupBy(scenario, "pos").agg(F.sum(end / start - 1).alias("_sum"), F.count(F.lit(1)).alias("open_trades"))
    ret = F.col("_sum") / F.col("open_trades") if slots is None else F.col("_sum") / F.greatest(F.lit(slots), F.col("open_trades"))
    exposure = F.lit(1.0) if slots is None else F.least(F.col("open_trades") / F.lit(slots), F.lit(1.0))
    # Days without an open trade inside a scenario's life earn nothing.
    life = per.groupBy(scenario).agg(F.min("pos").alias("_a"), F.max("pos").alias("_z")).select(scenario, F.explode(F.sequence("_a", "_z")).alias("pos"))
    w = Window.partitionBy(scenario).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    full = life.join(per.withColumns({"ret": ret, "exposure": exposure}), [scenario, "pos"], "left").fillna({"ret": 0.0, "exposure": 0.0, "open_trades": 0})
    return full.withColumn("equity", F.product(1 + F.col("ret")).over(w)).join(cal.select("pos", "date"), "pos") \
               .select(scenario, "date", "pos", "ret", "equity", "exposure", "open_trades")
