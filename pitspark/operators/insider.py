"""Insider trades: trailing distinct buyers, net value, cluster events.

"Distinct buyers in the last w days" is counted without collecting anybody's trades: each owner's
filing days are merged into covered intervals, an interval adds one at its start and takes one away
after its end, and a running sum over the issuer's days gives the count. Windows hold one row per
(issuer, owner, day) or (issuer, day).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLUSTER_MIN_BUYERS = 3


def day_number(d: Column | str) -> Column:
    return F.unix_date(F.col(d) if isinstance(d, str) else d)


def buyer_steps(tx: DataFrame, window_days: int) -> DataFrame:
    """(issuer_cik, day, step): changes of the number of distinct buyers active in the trailing window."""
    days = (tx.filter((F.col("trans_code") == "P") & F.col("issuer_cik").isNotNull() & F.col("owner_cik").isNotNull() & F.col("filing_date").isNotNull())
            .select("issuer_cik", "owner_cik", day_number("filing_date").alias("day")).distinct())
    w = Window.partitionBy("issuer_cik", "owner_cik").orderBy("day")
    gaps = days.withColumns({"_before": F.col("day") - F.lag("day").over(w), "_after": F.lead("day").over(w) - F.col("day")})
    opens = F.coalesce(F.col("_before") >= window_days, F.lit(True))
    closes = F.coalesce(F.col("_after") >= window_days, F.lit(True))
    edges = F.array_compact(F.array(
        F.when(opens, F.struct(F.col("day").alias("day"), F.lit(1).alias("step"))),
        F.when(closes, F.struct((F.col("day") + window_days).alias("day"), F.lit(-1).alias("step")))))
    return (gaps.select("issuer_cik", F.explode(edges).alias("e")).select("issuer_cik", "e.day", "e.step")
            .groupBy("issuer_cik", "day").agg(F.sum("step").alias("step")))


def _values_once(tx: DataFrame, keys: list[str]) -> DataFrame:
    """One row per transaction however many owners filed it jointly."""
    return tx.groupBy(*keys).agg(F.min("issuer_cik").alias("issuer_cik"), F.min("filing_date").alias("filing_date"), F.max("value").alias("value"))


def trailing_activity(tx: DataFrame, at: DataFrame, window_days: int, signed_value: DataFrame) -> DataFrame:
    """Buyers and summed value in (day - window, day] for each (issuer_cik, day) of ``at``.

    ``signed_value``: (issuer_cik, day, value) already summed per day. Everything meets in one window
    per issuer, ordered by day.
    """
    none = F.lit(None)
    rows = (buyer_steps(tx, window_days).select("issuer_cik", "day", "step", none.cast("double").alias("value"), F.lit(False).alias("asked"))
            .unionByName(signed_value.select("issuer_cik", "day", none.cast("long").alias("step"), "value", F.lit(False).alias("asked")))
            .unionByName(at.select("issuer_cik", "day").distinct().select(
                "issuer_cik", "day", none.cast("long").alias("step"), none.cast("double").alias("value"), F.lit(True).alias("asked"))))
    upto = Window.partitionBy("issuer_cik").orderBy("day").rangeBetween(Window.unboundedPreceding, 0)
    span = Window.partitionBy("issuer_cik").orderBy("day").rangeBetween(-(window_days - 1), 0)
    return (rows.withColumns({"buyers": F.coalesce(F.sum("step").over(upto), F.lit(0)), "window_value": F.coalesce(F.sum("value").over(span), F.lit(0.0))})
            .filter("asked").select("issuer_cik", "day", "buyers", "window_value"))


def insider_features(keys: DataFrame, tx: DataFrame, issuers: DataFrame, coverage_end=None, window_days: int = 90) -> DataFrame:
    """Per (date, ticker): distinct buyers, net bought value over market cap, cluster flag.

    Null where the ticker has no issuer or the date is past ``coverage_end``; 0 where nothing was filed.
    ``keys`` may carry ``log_market_cap``.
    """
    sign = F.when(F.col("trans_code") == "P", F.col("value")).when(F.col("trans_code") == "S", -F.col("value"))
    once = _values_once(tx, ["accession", "trans_code", "trans_date", "shares", "price"])
    daily = once.groupBy("issuer_cik", day_number("filing_date").alias("day")).agg(F.sum(sign).alias("value"))
    k = keys.join(issuers.select("ticker", "issuer_cik"), "ticker", "left").withColumn("day", day_number("date"))
    if coverage_end is not None:
        k = k.withColumn("issuer_cik", F.when(F.col("date") <= F.to_date(F.lit(coverage_end)), F.col("issuer_cik")))
    act = trailing_activity(tx, k.filter(F.col("issuer_cik").isNotNull()), window_days, daily)
    out = k.join(act, ["issuer_cik", "day"], "left")
    cap = F.exp("log_market_cap") if "log_market_cap" in keys.columns else F.lit(None).cast("double")
    return out.withColumns({
        "insider_buyers_90d": F.col("buyers").cast("double"),
        "insider_net_buy_value_90d_mcap": F.when(cap > 0, F.col("window_value") / cap),
        "insider_cluster_buy": (F.col("buyers") >= CLUSTER_MIN_BUYERS).cast("double")}).select(
        *keys.columns, "insider_buyers_90d", "insider_net_buy_value_90d_mcap", "insider_cluster_buy")


def cooled_down(candidates: DataFrame, key: str, day: str, cooldown_days: int) -> DataFrame:
    """Keep a candidate only if the key's previous *kept* one is more than ``cooldown_days`` older.

    A greedy fold over the sorted candidate days of one key (at most one per calendar day).
    """
    days = candidates.select(key, day).distinct().groupBy(key).agg(F.array_sort(F.collect_list(day)).alias("_days"))
    kept = F.aggregate("_days", F.array().cast("array<int>"), lambda acc, d: F.when(
        (F.size(acc) == 0) | (d - F.element_at(acc, -1) > cooldown_days), F.concat(acc, F.array(d))).otherwise(acc))
    days = days.filter(F.size("_days") > 0).select(key, F.explode(kept).alias(day))
    return candidates.join(days, [key, day], "left_semi")


def insider_cluster_events(tx: DataFrame, issuers: DataFrame, window_days: int = 30, min_buyers: int = 3, cooldown_days: int = 90) -> DataFrame:
    """(signal_date, ticker, strength) when enough distinct buyers filed within the window, with a cooldown."""
    buys = tx.filter((F.col("trans_code") == "P") & F.col("filing_date").isNotNull() & F.col("issuer_cik").isNotNull() & F.col("owner_cik").isNotNull())
    once = _values_once(buys, ["accession", "trans_date", "shares", "price"])
    daily = once.groupBy("issuer_cik", day_number("filing_date").alias("day")).agg(F.sum("value").alias("value"))
    at = buys.select("issuer_cik", day_number("filing_date").alias("day")).distinct()
    act = trailing_activity(buys, at, window_days, daily).filter(F.col("buyers") >= min_buyers)
    kept = cooled_down(act, "issuer_cik", "day", cooldown_days)
    return kept.join(issuers.select("ticker", "issuer_cik"), "issuer_cik").select(
        F.date_from_unix_date("day").alias("signal_date"), "ticker", (F.col("buyers") + F.col("window_value") / 1e10).alias("strength"))
