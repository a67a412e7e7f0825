"""Universe and text-signal aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .holdings import aggregate_direction


def modal_value(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Most frequent non-null value per group, the smallest on ties; counted per value before grouping."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*by).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(value))


def filled(col: str) -> Column:
    return F.col(col).isNotNull() & (F.trim(col) != "")


def build_universe(mentions: DataFrame, market: DataFrame | None = None) -> DataFrame:
    """One row per ticker: modal name, sector and region, themes, institution counts, direction, last mention.

    ``market`` (ticker, country, region, sector, industry, market_cap) takes precedence where present.
    """
    m = mentions.filter(filled("ticker"))
    score, label = aggregate_direction()
    out = m.groupBy("ticker").agg(
        F.array_sort(F.collect_set(F.when(F.col("theme") != "", F.col("theme")))).alias("themes"),
        F.countDistinct("institution").alias("institution_count"), F.count(F.lit(1)).alias("institutional_mentions"),
        label.alias("institutional_direction"), score.alias("institutional_direction_score"), F.max("publication_date").alias("latest_mention_date"))
    for col in ("company_name", "sector", "region"):
        out = out.join(modal_value(m, ["ticker"], col), "ticker", "left")
    if market is not None:
        extra = market.select("ticker", "country", F.col("region").alias("_r"), F.col("sector").alias("_s"), "industry", "market_cap")
        out = (out.join(extra, "ticker", "left").withColumn("region", F.coalesce("_r", "region")).withColumn("sector", F.coalesce("_s", "sector"))
               .drop("_r", "_s"))
    return out.orderBy(F.col("institution_count").desc(), F.col("institutional_mentions").desc(), "ticker")


def theme_companies(mentions: DataFrame) -> DataFrame:
    """(theme, ticker): the companies of every theme, a row each; a theme may name any number of them."""
    return mentions.filter(filled("theme") & (F.col("ticker") != "")).select("theme", "ticker").distinct()


def theme_summary(mentions: DataFrame) -> DataFrame:
    """Per theme: institutions, mentions and companies, and the first company by name; ``theme_companies`` has all of them."""
    t = mentions.filter(filled("theme"))
    company = F.when(F.col("ticker") != "", F.col("ticker"))
    return t.groupBy("theme").agg(F.countDistinct("institution").alias("institution_count"), F.count(F.lit(1)).alias("mention_count"),
                                  F.countDistinct(company).alias("companies"), F.min(company).alias("first_company")) \
        .orderBy(F.col("institution_count").desc(), F.col("mention_count").desc(), "theme")


def why_in_universe(mentions: DataFrame, ticker: str) -> DataFrame:
    return mentions.filter(F.upper("ticker") == ticker.upper()).orderBy(F.col("publication_date").desc(), "chunk_id")


def signal_score() -> Column:
    """Strength-weighted mean direction; 0 if every weight is 0, null without signals."""
    w = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("strength")))
    d = F.when(F.col("direction") == "positive", 1).when(F.col("direction") == "negative", -1).when(F.col("direction") == "neutral", 0)
    total = F.sum(w)
    return F.when(F.count(F.lit(1)) > 0, F.when(total == 0, 0.0).otherwise(F.coalesce(F.sum(d * w), F.lit(0.0)) / total))


def _strongest(signals: DataFrame, keep: Column, k: int, out: str) -> DataFrame:
    w = Window.partitionBy("ticker").orderBy(F.col("strength").desc(), F.col("evidence"))
    top = signals.filter(keep).select("ticker", "strength", "evidence").withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k)
    return top.groupBy("ticker").agg(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "evidence"))), lambda x: x["evidence"]).alias(out))


def company_research(signals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per ticker and type: count, mean strength, score), (per ticker: score, five risks, five catalysts, freshness)."""
    by_type = signals.groupBy("ticker", "signal_type").agg(F.count(F.lit(1)).alias("count"), F.avg("strength").alias("avg_strength"), signal_score().alias("score"))
    head = signals.groupBy("ticker").agg(F.count(F.lit(1)).alias("signal_count"), signal_score().alias("research_score"), F.max("filing_date").alias("data_freshness"))
    risks = _strongest(signals, F.col("signal_type") == "risk", 5, "risks")
    cats = _strongest(signals, (F.col("direction") == "positive") & (F.col("strength") >= 0.6), 5, "catalysts")
    empty = F.array().cast("array<string>")
    per = head.join(risks, "ticker", "left").join(cats, "ticker", "left")
    return by_type, per.withColumn("risks", F.coalesce("risks", empty)).withColumn("catalysts", F.coalesce("catalysts", empty))


def universe_coverage(membership: DataFrame, panel: DataFrame, label: str = "fwd_excess") -> DataFrame:
    """Per year: how many point-in-time members had a ticker, a price and a label."""
    flags = panel.groupBy("date", "ticker").agg(F.lit(True).alias("_p"), F.max(F.col(label).isNotNull()).alias("_l"))
    m = (membership.join(flags, ["date", "ticker"], "left")
         .withColumns({"_t": F.col("ticker").isNotNull(), "_p": F.coalesce("_p", F.lit(False)), "_l": F.coalesce("_l", F.lit(False)), "year": F.year("date")}))
    share = lambda c: F.avg(F.col(c).cast("double"))
    year = m.groupBy("year").agg(F.countDistinct("date").alias("dates"), F.count(F.lit(1)).alias("_members"), share("_t").alias("pct_with_ticker"),
                                 share("_p").alias("pct_priced"), share("_l").alias("pct_labelled"), F.countDistinct("ticker").alias("tickers"))
    never = (m.filter("_t").groupBy("year", "ticker").agg(F.max("_p").alias("_ever")).groupBy("year")
             .agg(F.count_if(~F.col("_ever")).alias("tickers_never_priced")))
    return year.join(never, "year", "left").withColumn("avg_members_per_date", F.col("_members") / F.col("dates")).drop("_members")


def usage_summary(calls: DataFrame) -> DataFrame:
    return calls.agg(F.count(F.lit(1)).alias("rows"), F.count_if("cache_hit").alias("cache_hits"), F.count_if(~F.col("cache_hit")).alias("calls"),
                     F.coalesce(F.sum("cost"), F.lit(0.0)).alias("known_cost"))


def call_cost(calls: DataFrame, rates: DataFrame, local: Sequence[str] = ("ollama",)) -> DataFrame:
    """Cost per call from a rate table (provider, model, input_rate, output_rate per 1,000 tokens); null if unknown."""
    j = calls.join(rates, ["provider", "model"], "left")
    known = F.col("input_tokens").isNotNull() & F.col("output_tokens").isNotNull()
    cost = F.round(F.col("input_tokens") / 1000 * F.col("input_rate") + F.col("output_tokens") / 1000 * F.col("output_rate"), 6)
    return j.withColumn("cost", F.when(known & F.col("provider").isin(*local), 0.0).when(known, cost)).drop("input_rate", "output_rate")


# Exchange codes of US listings; the composite code comes first.
US_EXCHANGES = ["US", "UN", "UW", "UQ", "UR", "UA"]


def pick_candidate(candidates: DataFrame, us_only: bool = False) -> DataFrame:
    """One listing per identifier: the US composite, then another US line, then the first of any."""
    us = F.col("exch_code").isin(US_EXCHANGES)
    rank = F.struct(F.when(F.col("exch_code") == "US", 0).when(us, 1).otherwise(2).alias("a"), F.col("input_order").alias("b"))
    src = candidates.filter(us) if us_only else candidates
    row = F.struct(F.when(us, F.regexp_replace(F.upper(F.trim("ticker")), "/", "-")).otherwise(F.col("ticker")).alias("ticker"), "name", "exch_code",
                   "security_type", F.when(us, "high").otherwise("best_effort").alias("confidence"))
    return src.groupBy("identifier").agg(F.min_by(row, rank).alias("_c")).select("identifier", "_c.*")


def universe_tickers(universe: DataFrame) -> DataFrame:
    return universe.filter(filled("ticker")).select(F.upper("ticker").alias("ticker")).distinct().orderBy("ticker")
