"""Event rules: earnings surprises against a trailing percentile, and cheap quality in an uptrend."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .asof import asof_join, eligible, latest_per_key
from .features import moving_average
from .ranks import positions


#: Children of a node of the tree over values, at most.
FAN = 256


def trailing_percentile(values: DataFrame, date: str, value: str, q: float, lookback_days: int, fan: int = FAN) -> DataFrame:
    """(date, n, threshold): linear quantile of all values dated in [date - lookback, date), for every date.

    The window has no partition key, so the order statistics are found by descending a tree over the values: a
    value's code is its position among all values, a node is a range of codes, its children equal parts of it.
    Per level, the daily counts of the children of the nodes that are asked for become window counts (a count
    enters the day after and leaves after the lookback), every date reads its children's counts as of itself, and
    goes on in the child that holds its position. What meets under one key are the days of one child, however
    many values it has; ``fan`` changes the work, not the answer.
    """
    v = values.select(F.unix_date(F.col(date)).alias("d"), F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull() & F.col("d").isNotNull())
    counts = v.groupBy("d", "v").agg(F.count(F.lit(1)).alias("n"))
    codes = positions(v.select("v"), [], ["v"]).select("v", F.col("lo").alias("code"))
    coded = cut_lineage(counts.join(codes, "v").select("d", "v", "code", "n"))
    rows = coded.agg(F.sum("n").alias("n")).first()["n"] or 1
    depth = max(1, math.ceil(math.log(max(rows, 2)) / math.log(fan)))
    fan = max(2, math.ceil(rows ** (1 / depth)))
    while fan ** depth < rows:
        fan += 1

    def window_counts(daily: DataFrame) -> DataFrame:
        """``node, t, n``: the count of a node in the window of day t, from the day it changes."""
        moves = daily.select("node", (F.col("d") + 1).alias("t"), "n").unionByName(daily.select("node", (F.col("d") + lookback_days + 1).alias("t"), (-F.col("n")).alias("n")))
        run = Window.partitionBy("node").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
        return moves.groupBy("node", "t").agg(F.sum("n").alias("n")).withColumn("n", F.sum("n").over(run))

    def read(asks: DataFrame, daily: DataFrame) -> DataFrame:
        """``asks`` with ``n``, the count of their node in their window."""
        found = window_counts(daily).withColumnRenamed("t", "_at").withColumnRenamed("n", "_n")
        return asof_join(asks, found, ["node"], "t", "_at", ["_n"]).withColumn("n", F.coalesce("_n", F.lit(0))).drop("_n", "_at")

    asked = coded.select(F.col("d").alias("t"), F.lit(0).cast("long").alias("node")).distinct()
    whole = read(asked, coded.groupBy("d").agg(F.sum("n").alias("n")).withColumn("node", F.lit(0).cast("long"))).filter("n > 0").withColumnRenamed("n", "total")
    h = (F.col("total") - 1) * F.lit(float(q))
    asks = whole.select("t", "total", "node", F.explode(F.array_distinct(F.array(F.floor(h), F.ceil(h)))).alias("k"), F.lit(0).cast("long").alias("before"))
    for level in reversed(range(depth)):
        part = fan ** level
        daily = coded.withColumn("node", F.floor(F.col("code") / part)).groupBy("d", "node").agg(F.sum("n").alias("n"))
        wanted = asks.select(F.col("node").alias("_parent")).distinct()
        daily = daily.join(wanted, F.floor(daily["node"] / fan) == wanted["_parent"], "left_semi")
        children = asks.select("t", "total", "k", "before", F.explode(F.sequence(F.col("node") * fan, F.col("node") * fan + fan - 1)).alias("node"))
        up = Window.partitionBy("t", "k").orderBy("node").rowsBetween(Window.unboundedPreceding, 0)
        upto = read(children, daily).filter("n > 0").withColumn("_upto", F.col("before") + F.sum("n").over(up))
        asks = cut_lineage(upto.filter((F.col("k") < F.col("_upto")) & (F.col("k") >= F.col("_upto") - F.col("n")))
                           .select("t", "total", "node", "k", (F.col("_upto") - F.col("n")).alias("before")))
    at = asks.join(coded.select(F.col("code").alias("node"), "v").distinct(), "node")
    frac = (F.col("total") - 1) * F.lit(float(q)) - F.floor((F.col("total") - 1) * F.lit(float(q)))
    out = at.groupBy("t", "total").agg(F.min_by("v", "k").alias("lo"), F.max_by("v", "k").alias("hi"))
    return out.select(F.date_from_unix_date("t").alias(date), F.col("total").alias("n"), (F.col("lo") + (F.col("hi") - F.col("lo")) * frac).alias("threshold"))


def earnings_surprise_events(sue: DataFrame, membership: DataFrame, percentile: float = 0.90, lookback_days: int = 365, min_history: int = 100) -> DataFrame:
    """(signal_date, ticker, strength): members whose surprise reaches the trailing percentile of all members'.

    ``sue``: (ticker, end, filed, sue). One value per filing: that of its latest period end.
    """
    one = latest_per_key(sue.filter(F.col("sue").isNotNull()).select("ticker", "filed", "end", "sue"), ["ticker", "filed"], ["end"])
    members = eligible(one, membership, "filed").select("filed", "ticker", "sue")
    bar = trailing_percentile(members, "filed", "sue", percentile, lookback_days).filter(F.col("n") >= min_history)
    return members.join(bar.select("filed", "threshold"), "filed").filter(F.col("sue") >= F.col("threshold")) \
                  .select(F.col("filed").alias("signal_date"), "ticker", F.col("sue").alias("strength"))


def cheap_quality_trend_events(screen: DataFrame, bars: DataFrame, ma_days: int = 200) -> DataFrame:
    """(signal_date, ticker, strength): screen candidates whose last close is above its moving average."""
    ma = bars.select("ticker", F.col("date").alias("bar_date"), F.col("close").alias("_c"), moving_average(ma_days).alias("_ma"))
    cand = screen.filter("is_candidate").select("ticker", "date", "drawdown")
    at = asof_join(cand, ma, ["ticker"], "date", "bar_date", ["_c", "_ma"], probe_unique=True)
    return at.filter(F.col("_c") > F.col("_ma")).select(F.col("date").alias("signal_date"), "ticker", F.col("drawdown").alias("strength"))
