"""Cross-sectional transforms: per-date ranks, industry-relative values, buckets, model matrix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import exact_quantiles, unit_rank

# The model's whitelist and the names that may never be a feature.
TECHNICAL_FEATURES = [
    "return_20d", "return_60d", "return_252d", "relative_return_20d", "relative_return_60d", "relative_return_252d",
    "volatility_20d", "volatility_60d", "volume_ratio", "price_vs_ma50", "price_vs_ma200", "momentum_12_1",
]
FUNDAMENTAL_FEATURES = ["revenue_growth", "eps_growth", "fcf_growth", "net_margin", "fcf_margin", "roe", "fcf_yield", "net_debt"]
INSTITUTIONAL_FEATURES = ["institutional_direction_score", "institution_count"]
INSIDER_FEATURES = ["insider_buyers_90d", "insider_net_buy_value_90d_mcap", "insider_cluster_buy"]
ACTIVE_FEATURES = ["active_new_or_add", "active_weight_max"]
SIZE_FEATURES = ["log_market_cap"]
FEATURES = TECHNICAL_FEATURES + FUNDAMENTAL_FEATURES + INSTITUTIONAL_FEATURES + INSIDER_FEATURES + ACTIVE_FEATURES + SIZE_FEATURES
FORBIDDEN = {"fwd_return", "fwd_excess", "label", "date", "ticker", "target"}
FORBIDDEN_PREFIXES = ("fwd_", "score_")


def check_features(features: Sequence[str]) -> list[str]:
    """Refuse labels, scores and identifiers as model features."""
    bad = [f for f in features if f in FORBIDDEN or f.startswith(FORBIDDEN_PREFIXES)]
    if bad:
        raise ValueError(f"not allowed as features: {bad}")
    return list(features)


def require_pit_panel(panel: DataFrame) -> None:
    missing = {"score_rank", "institutional_direction_score"} - set(panel.columns)
    if missing:
        raise ValueError(f"the model needs the point-in-time panel; missing {sorted(missing)}")


def cross_sectional_rank(panel: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("date", "ticker"), by: Sequence[str] = ("date",)) -> DataFrame:
    """Each column ranked to [0, 1] within its date; null stays null.

    All columns go through one ranking pass in long form, whatever their number.
    """
    keys, by = list(keys), list(by)
    long = panel.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(keys, list(columns), "_feature", "_v")
    long = long.withColumn("_v", F.when(~F.isnan("_v"), F.col("_v")))
    ranked = unit_rank(long, [*by, "_feature"], "_v", "_r")
    return ranked.groupBy(*keys).pivot("_feature", list(columns)).agg(F.max("_r"))


def feature_matrix(panel: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """(date, ticker, ranked features): whitelist only, a missing column is all null."""
    features = check_features(features or FEATURES)
    src = panel
    for f in features:
        if f not in panel.columns:
            src = src.withColumn(f, F.lit(None).cast("double"))
    return cross_sectional_rank(src, features)


def target_rank(panel: DataFrame, target: str = "fwd_excess") -> DataFrame:
    return cross_sectional_rank(panel, [target]).withColumnRenamed(target, "target_rank")


def industry_relative(panel: DataFrame, features: Sequence[str], industry: str, min_names: int = 3) -> DataFrame:
    """value - median of its (date, industry); null where fewer than ``min_names`` have a value."""
    long = panel.select("date", "ticker", industry, *[F.col(f).cast("double").alias(f) for f in features]) \
                .unpivot(["date", "ticker", industry], list(features), "_feature", "_v")
    med = exact_quantiles(long.filter(F.col(industry).isNotNull()), ["date", industry, "_feature"], "_v", {"_med": 0.5})
    rel = long.join(med, ["date", industry, "_feature"], "left").withColumn("_rel", F.when(F.col("n") >= min_names, F.col("_v") - F.col("_med")))
    wide = rel.groupBy("date", "ticker").pivot("_feature", list(features)).agg(F.max("_rel"))
    return wide.select("date", "ticker", *[F.col(f).alias(f"{f}_ind") for f in features])


def relevance_grade(rank: Column, levels: int = 10) -> Column:
    """Grade 0..levels-1 of a [0, 1] rank."""
    return F.floor(F.least(F.greatest(rank, F.lit(0.0)), F.lit(0.999999)) * levels).cast("int")
