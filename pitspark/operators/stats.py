"""Evaluation statistics.

Cross-sections are ranked by ``ranks`` (safe for a date that holds most of the rows). What windows
remain run over one value per date, month, bucket or trial.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import normal_cdf, normal_ppf, score_label
from ..session import cut_lineage
from .ranks import SPLIT_ABOVE, average_rank, equal_count_bucket, exact_quantiles, fits_tasks, positions, row_position
from .scalars import with_scalars


def ranked_pairs(df: DataFrame, by: Sequence[str], x: str, y: str, ident: str, split_above: int = SPLIT_ABOVE) -> DataFrame:
    """Average ranks and first-come positions of x and y within each group, in one ranking pass.

    While every group fits a task, its rows are shuffled once and sorted there by x and by y. A larger group is ranked in ranges.
    """
    by = list(by)
    src = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, ident, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    if by and fits_tasks(src, by, split_above):
        def ranked(rows: DataFrame, c: str) -> DataFrame:
            """The mean of the first and the last rank of each value's ties; NaN has none."""
            group = Window.partitionBy(*by, F.isnan(c))
            upto = F.count(F.lit(1)).over(group.orderBy(c).rangeBetween(Window.unboundedPreceding, Window.currentRow))
            found = {f"rank_{c}": (F.rank().over(group.orderBy(c)) + upto) / 2}
            if c == "x":
                found |= {"first_x": F.row_number().over(group.orderBy("x", ident)).cast("long"), "n": F.count(F.lit(1)).over(group)}
            return rows.withColumns({name: F.when(~F.isnan(c), value) for name, value in found.items()})

        return ranked(ranked(src.repartition(*by), "x"), "y").select(*by, ident, "x", "y", "rank_x", "rank_y", "first_x", "n")
    long = src.unpivot([*by, ident], ["x", "y"], "_w", "_v")
    placed = row_position(long, [*by, "_w"], ["_v", ident], "_rn", split_above=split_above)
    ties = placed.groupBy(*by, "_w", "_v").agg(((F.min("_rn") + F.max("_rn")) / 2).alias("_rank"))
    pick = lambda w, c: F.max(F.when(F.col("_w") == w, F.col(c)))
    return placed.join(ties, [*by, "_w", "_v"]).groupBy(*by, ident).agg(
        pick("x", "_v").alias("x"), pick("y", "_v").alias("y"), pick("x", "_rank").alias("rank_x"), pick("y", "_rank").alias("rank_y"),
        pick("x", "_rn").alias("first_x"), pick("x", "_rn_n").alias("n"))


def bucket_of(first: Column, n: Column, q: int) -> Column:
    return F.when(n == 1, 0).otherwise(F.greatest(F.lit(0), F.ceil((first - 1) * q / (n - 1)) - 1)).cast("int")


def per_date_metrics(panel: DataFrame, signals: Sequence[str], label: str = "fwd_excess", quantiles: int = 5, min_names: int = 10,
                     ident: str = "ticker") -> DataFrame:
    """Per (signal, date): rank and linear correlation with the label, quantile means, spread and top hit rate.

    Signals are evaluated together in long form; dates with too few names or a constant signal drop.
    """
    long = panel.select("date", ident, F.col(label).alias("_label"), *[F.col(s).cast("double").alias(s) for s in signals]) \
                .unpivot(["date", ident, "_label"], list(signals), "signal", "_x")
    r = ranked_pairs(long, ["signal", "date"], "_x", "_label", ident).withColumn("_b", bucket_of(F.col("first_x"), F.col("n"), quantiles))
    top, bottom = F.col("_b") == quantiles - 1, F.col("_b") == 0
    out = r.groupBy("signal", "date").agg(
        F.count(F.lit(1)).alias("n"), F.corr("rank_x", "rank_y").alias("rank_ic"), F.corr("x", "y").alias("ic"),
        F.avg(F.when(top, F.col("y"))).alias("top_mean"), F.avg(F.when(bottom, F.col("y"))).alias("bottom_mean"),
        F.avg(F.when(top, (F.col("y") > 0).cast("double"))).alias("top_hit_rate"), F.min("x").alias("_lo"), F.max("x").alias("_hi"))
    return (out.filter((F.col("n") >= max(min_names, 2 * quantiles)) & (F.col("_lo") < F.col("_hi"))).drop("_lo", "_hi")
            .withColumn("spread", F.col("top_mean") - F.col("bottom_mean")))


def newey_west(series: DataFrame, by: Sequence[str], order: str, value: str, lags: int, prefix: str = "") -> DataFrame:
    """(by, n, mean, t): mean over its Bartlett-weighted standard error; null under 3 values or a variance <= 0."""
    by = list(by)
    grp = by or ["_all"]
    s = series.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    s = s if by else s.withColumn("_all", F.lit(0))
    d = s.withColumn("_d", F.col(value) - F.avg(value).over(Window.partitionBy(*grp)))
    w = Window.partitionBy(*grp).orderBy(order)
    d = d.withColumns({"_p0": F.col("_d") * F.col("_d"), **{f"_p{k}": F.col("_d") * F.lag("_d", k).over(w) for k in range(1, lags + 1)}})
    g = d.groupBy(*grp).agg(F.count(F.lit(1)).alias("_n"), F.avg(value).alias("_mean"), *[F.sum(f"_p{k}").alias(f"_s{k}") for k in range(lags + 1)])
    # Fewer lags are usable on a short series; the weights keep the requested lag count.
    use = F.least(F.lit(lags), F.col("_n") - 1)
    var = F.col("_s0") / F.col("_n")
    for k in range(1, lags + 1):
        var = var + F.when(F.lit(k) <= use, 2 * F.lit(1 - k / (lags + 1)) * F.coalesce(F.col(f"_s{k}"), F.lit(0.0)) / F.col("_n")).otherwise(0.0)
    t = F.when((F.col("_n") >= 3) & (var > 0), F.col("_mean") / F.sqrt(var / F.col("_n")))
    return g.select(*by, F.col("_n").alias(f"{prefix}n"), F.col("_mean").alias(f"{prefix}mean"), t.alias(f"{prefix}t"))


def summarize(per_date: DataFrame, lags: int, by: Sequence[str] = ("signal",)) -> DataFrame:
    by = list(by)
    base = per_date.groupBy(*by).agg(
        F.count(F.lit(1)).alias("dates"), F.round(F.avg("n"), 1).alias("avg_names"), F.avg("rank_ic").alias("mean_rank_ic"),
        F.avg((F.col("rank_ic") > 0).cast("double")).alias("pct_dates_ic_pos"), F.avg("ic").alias("mean_ic"), F.avg("spread").alias("mean_spread"),
        F.avg("top_hit_rate").alias("top_hit_rate"))
    ic = newey_west(per_date, by, "date", "rank_ic", lags).select(*by, F.col("t").alias("rank_ic_tstat_nw"))
    sp = newey_west(per_date, by, "date", "spread", lags).select(*by, F.col("t").alias("spread_tstat_nw"))
    return base.join(ic, by, "left").join(sp, by, "left")


def overlap_lags(label_days: int, every: int) -> int:
    return max(0, -(-label_days // every) - 1)


def embargo_dates(hold: int, every: int) -> int:
    return -(-hold // every) + 1


def evaluate_signals(panel: DataFrame, signals: Sequence[str], label_days: int, every: int, label: str = "fwd_excess") -> DataFrame:
    per_date = cut_lineage(per_date_metrics(panel, [s for s in signals if s in panel.columns], label))     # one row per signal and date
    return summarize(per_date, overlap_lags(label_days, every))


def _spread_of_values(df: DataFrame, by: str, label: str) -> DataFrame:
    base = df.groupBy(by).agg(F.count(F.lit(1)).alias("count"), F.avg(label).alias("mean_fwd_excess"),
                              F.avg((F.col(label) > 0).cast("double")).alias("share_beating_benchmark"))
    med = exact_quantiles(df, [by], label, {"median_fwd_excess": 0.5}).drop("n")
    return base.join(med, by)


def label_buckets(panel: DataFrame, score: str, label: str = "fwd_excess") -> DataFrame:
    """Label counts, means, medians and hit shares per score label."""
    return _spread_of_values(panel.filter(F.col(label).isNotNull()).withColumn("bucket", score_label(score)), "bucket", label)


def score_quintiles(panel: DataFrame, score: str, label: str = "fwd_excess", q: int = 5) -> DataFrame:
    rows = panel.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    b = equal_count_bucket(rows, ["date"], score, ["ticker"], q, "_b").filter(F.col("_b_n") >= q).withColumn("quintile", F.col("_b") + 1)
    return _spread_of_values(b, "quintile", label)


def ic_by_year(per_date: DataFrame) -> DataFrame:
    return per_date.groupBy("signal", F.year("date").alias("year")).agg(
        F.count(F.lit(1)).alias("dates"), F.avg("rank_ic").alias("mean_rank_ic"), F.avg("spread").alias("mean_spread"))


def ic_difference(per_date: DataFrame, a: str, b: str, lags: int) -> DataFrame:
    """Newey-West test of the rank-IC difference of two signals on their common dates."""
    one = lambda s, c: per_date.filter(F.col("signal") == s).select("date", F.col("rank_ic").alias(c))
    d = one(a, "_a").join(one(b, "_b"), "date").withColumn("diff", F.col("_a") - F.col("_b"))
    return newey_west(d, [], "date", "diff", lags).select(F.lit(a).alias("signal"), F.lit(b).alias("baseline"), "n", "mean", "t")


def promotion_check(per_date: DataFrame, model: str, baselines: Sequence[str], lags: int, min_years: int = 4, bar: float = 2.0) -> DataFrame:
    """Rows (check, ok): better than each baseline at t > 2, and positive in enough years."""
    out = None
    for b in baselines:
        r = ic_difference(per_date, model, b, lags).select(F.lit(f"beats {b}").alias("check"), F.coalesce((F.col("mean") > 0) & (F.col("t") > bar), F.lit(False)).alias("ok"))
        out = r if out is None else out.unionByName(r)
    years = per_date.filter(F.col("signal") == model).groupBy(F.year("date").alias("y")).agg(F.avg("rank_ic").alias("m"))
    ok = years.agg((F.count(F.lit(1)) >= min_years).alias("a"), (F.count_if(F.col("m") > 0) >= min_years).alias("b"))
    return out.unionByName(ok.select(F.lit("positive years").alias("check"), (F.col("a") & F.col("b")).alias("ok")))


def universe_drift(panel: DataFrame, label: str = "fwd_excess", warn: float = 0.015) -> DataFrame:
    """Mean label of the whole universe per year (dates weigh the same), with a warning flag on the overall mean."""
    daily = panel.filter(F.col(label).isNotNull()).groupBy("date").agg(F.avg(label).alias("m"))
    overall = daily.agg(F.avg("m").alias("overall"))
    year = daily.groupBy(F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("dates"), F.avg("m").alias("mean_fwd_excess"))
    return year.transform(with_scalars, overall).withColumn("drift_warning", F.abs("overall") > warn).drop("overall")


def auc(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """Mann-Whitney area under the curve with tied ranks averaged; null without both classes."""
    by = list(by)
    r = average_rank(df.filter(F.col(y).isNotNull() & F.col(p).isNotNull()), by, p, "_r")
    g = r.groupBy(*by).agg(F.sum(F.when(F.col(y) == 1, F.col("_r"))).alias("_s"), F.count_if(F.col(y) == 1).alias("_p"), F.count_if(F.col(y) == 0).alias("_q"))
    val = (F.col("_s") - F.col("_p") * (F.col("_p") + 1) / 2) / (F.col("_p") * F.col("_q"))
    return g.select(*by, F.when((F.col("_p") > 0) & (F.col("_q") > 0), val).alias("auc"))


def calibration_table(df: DataFrame, y: str, p: str, tiebreak: Sequence[str], bins: int = 10) -> DataFrame:
    b = equal_count_bucket(df.filter(F.col(y).isNotNull() & F.col(p).isNotNull()), [], p, tiebreak, bins, "_b")
    return b.groupBy((F.col("_b") + 1).alias("decile")).agg(F.count(F.lit(1)).alias("trades"), F.avg(p).alias("mean_predicted"), F.avg(F.col(y).cast("double")).alias("actual_hit_rate"))


def calibration_at_horizon(df: DataFrame, p: str, tiebreak: Sequence[str], horizon: int = 252, min_rows: int = 20) -> DataFrame:
    """Deciles of the predicted hit probability on rows whose outcome at ``horizon`` is known."""
    known = df.filter((F.col("event") == 1) | (F.col("duration") >= horizon)) \
              .withColumn("_hit", ((F.col("event") == 1) & (F.col("duration") <= horizon)).cast("double"))
    b = equal_count_bucket(known, [], p, tiebreak, 10, "_b").filter(F.col("_b_n") >= min_rows)
    return b.groupBy((F.col("_b") + 1).alias("decile")).agg(F.count(F.lit(1)).alias("rows"), F.avg(p).alias("predicted"), F.avg("_hit").alias("actual"))


# --- trades -------------------------------------------------------------------------------------------

def monthly_excess(trades: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return trades.groupBy(*by, F.trunc("entry_date", "month").alias("month")).agg(F.avg("excess").alias("excess"))


def trade_tstat(trades: DataFrame, hold: int, by: Sequence[str] = ()) -> DataFrame:
    return newey_west(monthly_excess(trades, by), by, "month", "excess", max(1, -(-hold // 21)))


def percentile_of(value: DataFrame, distribution: DataFrame, by: Sequence[str], value_col: str, dist_col: str) -> DataFrame:
    """Share (x100) of the distribution strictly below the value, per ``by``."""
    d = distribution.filter(F.col(dist_col).isNotNull() & ~F.isnan(dist_col))
    return d.join(value, list(by)).groupBy(*by).agg((F.avg((F.col(dist_col) < F.col(value_col)).cast("double")) * 100).alias("percentile"))


def evaluate_period(stats: DataFrame, t_bar: float = 2.4, pct_bar: float = 95.0) -> DataFrame:
    """Five checks of one period from a row of mean_excess, nw_t, ci_low, random_pct, cagr, bench_cagr."""
    ok = lambda c: F.coalesce(c, F.lit(False))
    out = stats.withColumns({
        "mean_excess_positive": ok(F.col("mean_excess") > 0), "t_at_least_bar": ok(F.col("nw_t") >= t_bar), "ci_above_zero": ok(F.col("ci_low") > 0),
        "beats_95pct_random": ok(F.col("random_pct") >= pct_bar), "portfolio_beats_benchmark": ok(F.col("cagr") > F.col("bench_cagr"))})
    return out.withColumn("passed", F.col("mean_excess_positive") & F.col("t_at_least_bar") & F.col("ci_above_zero") & F.col("beats_95pct_random")
                          & F.col("portfolio_beats_benchmark"))


def event_verdict(periods: DataFrame) -> DataFrame:
    """PASS only if both the development and the holdout row pass."""
    g = periods.agg(F.count_if(F.col("period") == "holdout").alias("h"), F.bool_and("passed").alias("p"))
    return g.select(F.when(F.col("h") == 0, "DEVELOPMENT ONLY (holdout not run)").when(F.col("p"), "PASS").otherwise("NOT PROVEN").alias("verdict"))


# --- multiple testing ----------------------------------------------------------------------------------

def two_sided_p(t: Column) -> Column:
    return F.when(t.isNull() | F.isnan(t), 1.0).otherwise(2 * (1 - normal_cdf(F.abs(t))))


def holm_adjust(tests: DataFrame, p: str, ident: str, by: Sequence[str] = (), out: str = "holm_p") -> DataFrame:
    """Step-down adjusted p-values; one row per hypothesis, so the window is the family."""
    part = list(by) or [F.lit(0)]
    order = Window.partitionBy(*part).orderBy(p, ident)
    raw = F.least(F.lit(1.0), (F.count(F.lit(1)).over(Window.partitionBy(*part)) - F.row_number().over(order) + 1) * F.col(p))
    return tests.withColumn("_raw", raw).withColumn(out, F.max("_raw").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_raw")


def variant_verdicts(tests: DataFrame, alpha: float = 0.0455002638963584) -> DataFrame:
    """Checks per variant from mean_rank_ic, ic_t, spread_mean: Holm t, positive IC, positive spread."""
    x = holm_adjust(tests.withColumn("_p", two_sided_p(F.col("ic_t"))), "_p", "variant")
    ok = lambda c: F.coalesce(c, F.lit(False))
    x = x.withColumns({"holm_t_above_2": ok((F.col("ic_t") > 0) & (F.col("holm_p") < alpha)), "mean_ic_positive": ok(F.col("mean_rank_ic") > 0),
                       "spread_positive": ok(F.col("spread_mean") > 0)})
    return x.withColumn("passed", F.col("holm_t_above_2") & F.col("mean_ic_positive") & F.col("spread_positive")).drop("_p")


def text_adds_verdict(verdicts: DataFrame, with_text: str, without_text: str) -> DataFrame:
    """Per model: the text variant passes and its IC is above the same model's without text."""
    a = verdicts.filter(F.col("features") == with_text).select("model", F.col("passed").alias("text_passes"), F.col("mean_rank_ic").alias("ic_text"))
    b = verdicts.filter(F.col("features") == without_text).select("model", F.col("mean_rank_ic").alias("ic_without_text"))
    return a.join(b, "model").withColumn("text_adds", F.col("ic_text") > F.col("ic_without_text")) \
            .withColumn("verdict", F.when(F.col("text_passes") & F.col("text_adds"), "PASSED").otherwise("FAILED"))


EULER_GAMMA = 0.5772156649


def sample_moments(returns: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Per series: count, per-period Sharpe, bias-corrected skew and kurtosis (normal = 3)."""
    n, g1, g2 = F.col("months"), F.col("_g1"), F.col("_g2")
    g = returns.filter(F.col(value).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("months"), (F.avg(value) / F.stddev_samp(value)).alias("sharpe"), F.skewness(value).alias("_g1"), F.kurtosis(value).alias("_g2"))
    return g.withColumns({"skew": g1 * F.sqrt(n * (n - 1)) / (n - 2),
                          "kurtosis": (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6) + 3}).drop("_g1", "_g2")


def expected_max_sharpe(n: Column, variance: Column) -> Column:
    best = (1 - EULER_GAMMA) * normal_ppf(1 - 1 / n) + EULER_GAMMA * normal_ppf(1 - 1 / (n * F.exp(F.lit(1.0))))
    return F.when((n <= 1) | (variance <= 0) | variance.isNull(), 0.0).otherwise(F.sqrt(variance) * best)


def deflated_sharpe(returns: DataFrame, variant: str = "variant_id", value: str = "ret", trials: int | None = None) -> DataFrame:
    """Probability that each variant's Sharpe exceeds what the best of all trials would show by luck."""
    m = sample_moments(returns, [variant], value)
    luck = m.filter(F.col("sharpe").isNotNull() & ~F.isnan("sharpe")).agg(F.count(F.lit(1)).alias("_k"), F.var_samp("sharpe").alias("_v"))
    n = F.col("_k") if trials is None else F.lit(trials)
    x = m.transform(with_scalars, luck).withColumn("benchmark_sharpe", expected_max_sharpe(n.cast("double"), F.col("_v")))   
    sr, sk, ku = F.col("sharpe"), F.col("skew"), F.col("kurtosis")
    denom = F.sqrt(F.greatest(1 - sk * sr + (ku - 1) / 4 * sr * sr, F.lit(1e-12)))
    return x.withColumn("dsr", normal_cdf((sr - F.col("benchmark_sharpe")) * F.sqrt(F.col("months") - 1) / denom)) \
            .withColumn("n_trials", n).drop("_k", "_v")


def common_dates(returns: DataFrame, variant: str = "variant_id", date: str = "date") -> DataFrame:
    """Rows on the dates every variant has."""
    r = returns.filter(F.col("ret").isNotNull())
    n = r.agg(F.countDistinct(variant).alias("_n"))
    keep = r.groupBy(date).agg(F.countDistinct(variant).alias("_k")).transform(with_scalars, n).filter("_k = _n").select(date)
    return r.join(keep, date, "left_semi")


def pbo_cscv(returns: DataFrame, blocks: int = 16, variant: str = "variant_id", date: str = "date") -> DataFrame:
    """Probability of backtest overfitting over every half split of contiguous time blocks.

    A split only needs count, sum and sum of squares per (block, variant), so the series is reduced to
    blocks x variants rows before the splits multiply it. Splits are the bit masks with half their bits set.
    """
    r = common_dates(returns, variant, date)
    n_blocks = blocks
    pos = r.select(date).distinct().withColumn("_i", F.row_number().over(Window.orderBy(F.col(date).desc())) - 1) \
           .withColumn("_t", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))                # one row per date
    size = F.floor(F.col("_t") / n_blocks)
    pos = pos.filter((F.col("_i") < size * n_blocks) & (F.col("_t") >= n_blocks)).withColumn("block", (n_blocks - 1 - F.floor(F.col("_i") / size)).cast("int"))
    stat = r.join(pos.select(date, "block"), date).groupBy("block", variant).agg(
        F.count(F.lit(1)).alias("n"), F.sum("ret").alias("s"), F.sum(F.col("ret") * F.col("ret")).alias("ss"))
    masks = F.filter(F.sequence(F.lit(0), F.lit(2 ** blocks - 1)), lambda m: F.bit_count(m) == blocks // 2)
    per = (stat.groupBy(variant).agg(F.collect_list(F.struct("block", "n", "s", "ss")).alias("_blocks"))      # at most `blocks` entries
           .withColumn("split", F.explode(masks)))

    def side(inside: int) -> Column:
        part = F.filter("_blocks", lambda b: F.getbit(F.col("split"), b["block"]) == inside)
        add = F.aggregate(part, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("ss")),
                          lambda a, b: F.struct((a["n"] + b["n"]).alias("n"), (a["s"] + b["s"]).alias("s"), (a["ss"] + b["ss"]).alias("ss")))
        var = (add["ss"] - add["s"] * add["s"] / add["n"]) / (add["n"] - 1)
        return F.when(var > 1e-18, add["s"] / add["n"] / F.sqrt(var)).otherwise(F.lit(float("-inf")))

    sh = per.select("split", variant, F.round(side(1), 12).alias("s_in"), F.round(side(0), 12).alias("s_out"))
    best = sh.groupBy("split").agg(F.min_by(F.struct(variant, "s_out"), F.struct(-F.col("s_in"), F.col(variant))).alias("_b"),
                                   F.count(F.lit(1)).alias("variants"))
    rank = (sh.join(best.select("split", F.col("_b.s_out").alias("_bo"), "variants"), "split").groupBy("split", "variants", "_bo")
            .agg((F.count_if(F.col("s_out") < F.col("_bo")) + 0.5 * (F.count_if(F.col("s_out") == F.col("_bo")) - 1) + 1).alias("_rank")))
    omega = F.col("_rank") / (F.col("variants") + 1)
    logits = rank.withColumn("logit", F.log(omega / (1 - omega)))
    return logits.agg(F.avg((F.col("logit") <= 0).cast("double")).alias("pbo"), F.count(F.lit(1)).alias("combinations"), F.max("variants").alias("variants"),
                      F.median("logit").alias("median_logit"), F.avg((F.col("_bo") < 0).cast("double")).alias("p_oos_best_negative"))


def selection_stats(returns: DataFrame, registered: int | None = None) -> DataFrame:
    """Deflated Sharpe of every variant against the whole registry, next to the registry's overfitting probability."""
    return deflated_sharpe(returns, trials=registered).transform(with_scalars, pbo_cscv(returns))


# --- survival scores -----------------------------------------------------------------------------------

#: Ranges of positions that a group's predictions are cut into, and positions of the smallest range.
BLOCKS, LEAST_BLOCK = 256, 20_000


def _later_pairs(node: np.ndarray, tau: np.ndarray, deaths: np.ndarray, others: np.ndarray) -> int:
    """Pairs of a death and another row of its node with a strictly later time."""
    order = np.lexsort((-tau, node))
    node, tau, deaths = node[order], tau[order], deaths[order]
    before = np.concatenate(([0], np.cumsum(others[order])))
    at = np.arange(len(node))
    new_node = np.concatenate(([True], node[1:] != node[:-1]))
    new_time = new_node | np.concatenate(([True], tau[1:] != tau[:-1]))
    first = lambda new: np.maximum.accumulate(np.where(new, at, 0))
    return int((deaths * (before[first(new_time)] - before[first(new_node)])).sum())


def _block_pairs(rows: pd.DataFrame) -> tuple[int, int]:
    """Well ordered and tied pairs inside one range of positions: two positions differ first at one binary digit."""
    tau, c, d = (rows[n].to_numpy() for n in ("_tau", "_c", "_d"))
    r = np.unique(rows["_r"].to_numpy(), return_inverse=True)[1]
    good = sum(_later_pairs(r >> (level + 1), tau, np.where(r >> level & 1, 0, d), np.where(r >> level & 1, c, 0)) for level in range(int(r.max()).bit_length()))
    return good, _later_pairs(r, tau, d, c)


def concordance(df: DataFrame, duration: str, event: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Share of comparable pairs the prediction orders correctly (ties one half), without forming pairs.

    Predictions become positions, cut into at most ``BLOCKS`` ranges a group. Pairs inside a range are counted by
    its task; pairs of two ranges from the counts per range and time alone, going through the ranges from the top
    with the later rows of those above. So every row is shuffled once, as a count per (position, time), and what
    a group brings together is one number per range and distinct time.
    """
    by = list(by)
    src = df.filter(F.col(predicted).isNotNull())
    src = src if by else src.withColumn("_all", F.lit(0))
    grp = by or ["_all"]
    # Deaths sort before censored rows of the same time, which are known to have lived longer.
    src = src.withColumn("_tau", 2 * F.col(duration).cast("long") + F.when(F.col(event) == 1, 0).otherwise(1))
    pos = positions(src, grp, [predicted]).select(*grp, predicted, F.col("lo").alias("_r"), F.col("total").alias("_n"))
    small = src.groupBy(*grp, predicted, "_tau").agg(F.count(F.lit(1)).alias("_c"), F.count_if(F.col(event) == 1).alias("_d"))
    width = F.greatest(F.ceil(F.col("_n") / BLOCKS), F.lit(LEAST_BLOCK))
    small = small.join(pos, [*grp, predicted]).withColumn("_block", F.floor(F.col("_r") / width)).select(*grp, "_block", "_r", "_tau", "_c", "_d")
    keys = ", ".join(f"`{g}` {small.schema[g].dataType.simpleString()}" for g in grp)
    out_schema = f"{keys}, _good long, _tied long, _total long"

    def inside(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        good, tied = _block_pairs(rows)
        return pd.DataFrame([(*key[:-1], good, tied, 0)], columns=[*grp, "_good", "_tied", "_total"])

    def across(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        times, at = np.unique(rows["_tau"].to_numpy(), return_inverse=True)
        above, good, total = np.zeros(len(times), np.int64), 0, 0
        later = lambda n: np.cumsum(n[::-1])[::-1] - n  # noqa: E731  rows of strictly later times
        c, d, block = (rows[n].to_numpy() for n in ("_c", "_d", "_block"))
        order = np.argsort(-block, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
            good += int((d[part] * later(above)[at[part]]).sum())
            above[at[part]] += c[part]
        deaths = np.bincount(at, d, minlength=len(times)).astype(np.int64)
        total = int((deaths * later(above)).sum())
        return pd.DataFrame([(*key, good, 0, total)], columns=[*grp, "_good", "_tied", "_total"])

    cells = small.groupBy(*grp, "_block", "_tau").agg(F.sum("_c").alias("_c"), F.sum("_d").alias("_d"))
    pairs = small.groupBy(*grp, "_block").applyInPandas(inside, out_schema).unionByName(cells.groupBy(*grp).applyInPandas(across, out_schema))
    out = pairs.groupBy(*grp).agg(*[F.sum(c).alias(c) for c in ("_good", "_tied", "_total")])
    return out.select(*by, F.when(F.col("_total") > 0, (F.col("_good") + 0.5 * F.col("_tied")) / F.col("_total")).alias("concordance"), F.col("_total").alias("pairs"))


def kaplan_meier(df: DataFrame, duration: str = "duration", event: str = "event", by: Sequence[str] = ()) -> DataFrame:
    """(by, t, at_risk, deaths, s): product-limit curve over the distinct durations."""
    by = list(by)
    part = by or [F.lit(0)]
    t = df.groupBy(*by, F.col(duration).alias("t")).agg(F.count_if(F.col(event) == 1).alias("deaths"), F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*part).orderBy(F.col("t").desc()).rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy(*part).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("at_risk", F.sum("_c").over(w))
    return t.withColumn("s", F.product(1 - F.col("deaths") / F.col("at_risk")).over(up)).drop("_c")


def curve_at(curve: DataFrame, points: DataFrame, at: str, out: str, value: str = "s", start: float = 1.0) -> DataFrame:
    """Step-function value of a curve at each point (1.0 before its first time)."""
    from .asof import asof_join

    got = asof_join(points, curve.select(F.col("t").alias("_t"), F.col(value).alias(out)), [], at, "_t", [out])
    return got.withColumn(out, F.coalesce(out, F.lit(start))).drop("_t")


def integrated_brier(test: DataFrame, train: DataFrame, curve: DataFrame, grid: Sequence[int]) -> DataFrame:
    """Censoring-weighted Brier score of one population curve, averaged over a time grid by trapezoid.

    Rows are reduced to counts per (duration, event) before the grid multiplies them.
    """
    times = curve_at(curve, _times(test, grid), "t_at", "_s")
    rows = test.groupBy("duration", "event").agg(F.count(F.lit(1)).alias("_c")).withColumn("t_at", F.explode(F.array(*[F.lit(int(t)) for t in grid])))
    return _brier(rows.join(times, "t_at"), train, grid)


def model_brier(test: DataFrame, train: DataFrame, survival: str, grid: Sequence[int]) -> DataFrame:
    """The same score of a model that gives every row a curve of its own: ``survival`` is an array of the row's
    survival probabilities at the times of ``grid``. Rows of equal curve, duration and event count once."""
    at = F.posexplode(F.zip_with(F.array(*[F.lit(int(t)) for t in grid]), survival, lambda t, s: F.struct(t.alias("t_at"), s.alias("_s"))))
    same = test.groupBy("duration", "event", survival).agg(F.count(F.lit(1)).alias("_c"))
    return _brier(same.select("duration", "event", "_c", at.alias("_", "_x")).select("duration", "event", "_c", "_x.*"), train, grid)


def _times(df: DataFrame, grid: Sequence[int]) -> DataFrame:
    return df.sparkSession.createDataFrame([(int(t),) for t in grid], "t_at int")


def _brier(rows: DataFrame, train: DataFrame, grid: Sequence[int]) -> DataFrame:
    """``rows``: duration, event, t_at, _s (survival at t_at), _c (how many). Each row is weighted by the censoring
    curve of the training rows at its own time or at the time of the grid."""
    cens = kaplan_meier(train.withColumn("_ce", 1 - F.col("event")), "duration", "_ce")
    own = curve_at(cens, rows.select("duration").distinct(), "duration", "_gd")
    x = rows.join(own, "duration").join(curve_at(cens, _times(rows, grid), "t_at", "_gt"), "t_at")
    floor = lambda c: F.greatest(F.col(c), F.lit(1e-3))
    died = (F.col("duration") <= F.col("t_at")) & (F.col("event") == 1)
    score = F.when(died, F.col("_s") * F.col("_s") / floor("_gd")).when(F.col("duration") > F.col("t_at"), (1 - F.col("_s")) * (1 - F.col("_s")) / floor("_gt")).otherwise(0.0)
    b = x.groupBy("t_at").agg((F.sum(score * F.col("_c")) / F.sum("_c")).alias("_b"))
    w = Window.orderBy("t_at")                                    # one row per time of the grid
    area = (F.lead("_b").over(w) + F.col("_b")) / 2 * (F.lead("t_at").over(w) - F.col("t_at"))
    return b.withColumn("_a", area).agg((F.sum("_a") / (F.max("t_at") - F.min("t_at"))).alias("integrated_brier"))


# --- equity series --------------------------------------------------------------------------------------

def drawdown_and_moments(equity: DataFrame, by: Sequence[str], date: str = "date", value: str = "equity") -> DataFrame:
    """Per series: first, last, days, total return, max drawdown, mean and deviation of period returns."""
    by = list(by)
    part = by or [F.lit(0)]
    w = Window.partitionBy(*part).orderBy(date)
    x = equity.filter(F.col(value).isNotNull()).withColumns({
        "_r": F.col(value) / F.lag(value).over(w) - 1, "_dd": F.col(value) / F.max(value).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1})
    return x.groupBy(*by).agg(
        F.count(F.lit(1)).alias("periods"), F.datediff(F.max(date), F.min(date)).alias("days"),
        (F.max_by(value, date) / F.min_by(value, date) - 1).alias("total_return"), F.min("_dd").alias("max_drawdown"),
        F.avg("_r").alias("mean_ret"), F.stddev_samp("_r").alias("std_ret"))


def portfolio_metrics(equity: DataFrame, by: Sequence[str] = (), date: str = "date", value: str = "equity", periods_per_year: float | None = 252) -> DataFrame:
    """total_return, cagr, max_drawdown, sharpe; ``periods_per_year=None`` annualises by the series' own frequency."""
    m = drawdown_and_moments(equity, by, date, value).filter("periods >= 2")
    years = F.col("days") / 365.25
    scale = F.sqrt((F.col("periods") - 1) / years) if periods_per_year is None else F.sqrt(F.lit(float(periods_per_year)))
    return m.select(*by, "total_return", F.when(years > 0, F.pow(1 + F.col("total_return"), 1 / years) - 1).alias("cagr"), "max_drawdown",
                    F.when(F.col("std_ret") > 0, F.col("mean_ret") / F.col("std_ret") * scale).alias("sharpe"))


def buy_and_hold(prices: DataFrame, start, end, by: Sequence[str] = (), value: str = "close") -> DataFrame:
    cut = prices.filter(F.col("date").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))
    return portfolio_metrics(cut, by, "date", value, None)


def monthly_perf(returns: DataFrame, by: Sequence[str] = (), value: str = "ret", date: str = "date") -> DataFrame:
    """months, annualised return, volatility, Sharpe and drawdown of monthly returns."""
    by = list(by)
    part = by or [F.lit(0)]
    r = returns.filter(F.col(value).isNotNull())
    w = Window.partitionBy(*part).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    x = r.withColumn("_eq", F.product(1 + F.col(value)).over(w)).withColumn("_dd", F.col("_eq") / F.max("_eq").over(w) - 1)
    g = x.groupBy(*by).agg(F.count(F.lit(1)).alias("months"), F.product(1 + F.col(value)).alias("_g"), F.stddev_samp(value).alias("_sd"), F.avg(value).alias("_m"),
                           F.min("_dd").alias("max_drawdown")).filter("months >= 2")
    annual = F.sqrt(F.lit(12.0))
    return g.select(*by, "months", F.when(F.col("_g") > 0, F.pow("_g", 12 / F.col("months")) - 1).otherwise(-1.0).alias("annualized"), (F.col("_sd") * annual).alias("vol"),
                    F.when(F.col("_sd") > 0, F.col("_m") / F.col("_sd") * annual).alias("sharpe"), "max_drawdown")


def trade_metrics(trades: DataFrame, by: Sequence[str] = (), pnl: str = "pnl") -> DataFrame:
    """Win rate, mean win and loss, expectancy, profit factor and exit shares."""
    win = F.col("ret") > 0
    share = lambda o: F.avg((F.col("outcome") == o).cast("double"))
    gain, loss = F.sum(F.when(win, F.col(pnl))), -F.sum(F.when(~win, F.col(pnl)))
    return trades.groupBy(*by).agg(
        F.count(F.lit(1)).alias("trades"), F.avg(win.cast("double")).alias("win_rate"), F.avg(F.when(win, F.col("ret"))).alias("avg_win"),
        F.avg(F.when(~win, F.col("ret"))).alias("avg_loss"), F.avg("r_multiple").alias("expectancy_r"), F.when(loss > 0, gain / loss).alias("profit_factor"),
        share("target").alias("target_share"), share("stop").alias("stop_share"))


def equity_by_year(equity: DataFrame, by: Sequence[str] = (), value: str = "equity") -> DataFrame:
    """Return per calendar year over the previous year's last value (the first year: its own first)."""
    by = list(by)
    y = equity.groupBy(*by, F.year("date").alias("year")).agg(F.min_by(value, "date").alias("_f"), F.max_by(value, "date").alias("_l"))
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("year")
    return y.withColumn("return", F.col("_l") / F.coalesce(F.lag("_l").over(w), F.col("_f")) - 1).drop("_f", "_l")


def exposure_matched_benchmark(bench: DataFrame, exposure: DataFrame) -> DataFrame:
    """The benchmark held at the strategy's mean exposure over the same dates."""
    e = exposure.agg(F.avg("exposure").alias("avg_exposure"), F.min("date").alias("_a"), F.max("date").alias("_z"))
    w = Window.orderBy("date")
    b = bench.transform(with_scalars, e).filter(F.col("date").between(F.col("_a"), F.col("_z")) & F.col("close").isNotNull()) 
    b = b.withColumn("_r", F.coalesce(F.col("close") / F.lag("close").over(w) - 1, F.lit(0.0)))
    eq = b.withColumn("equity", F.product(1 + F.col("avg_exposure") * F.col("_r")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    total = portfolio_metrics_from_one(eq)
    return total.transform(with_scalars, e.select("avg_exposure"))  


def portfolio_metrics_from_one(eq: DataFrame) -> DataFrame:
    """Metrics of a compounded series whose implicit starting value is 1."""
    m = drawdown_and_moments(eq, []).filter("periods >= 2")
    last = eq.agg(F.max_by("equity", "date").alias("_last"))
    years = F.col("days") / 365.25
    x = m.transform(with_scalars, last).withColumn("total_return", F.col("_last") - 1)   
    return x.select("total_return", (F.pow(1 + F.col("total_return"), 1 / years) - 1).alias("cagr"), "max_drawdown",
                    F.when(F.col("std_ret") > 0, F.col("mean_ret") / F.col("std_ret") * F.sqrt(F.lit(252.0))).alias("sharpe"))


def portfolio_verdict(strategy: DataFrame, bench: DataFrame, random_annualized: DataFrame) -> DataFrame:
    """Beats the benchmark in full and in each half, at least 95% of random portfolios, and its Sharpe."""
    span = strategy.agg(F.min("date").alias("_a"), F.max("date").alias("_z"))
    mid = F.date_add("_a", F.floor(F.datediff("_z", "_a") / 2).cast("int"))
    both = strategy.select(F.lit("s").alias("who"), "date", "equity").unionByName(bench.select(F.lit("b").alias("who"), "date", F.col("close").alias("equity")))
    cut = both.transform(with_scalars, span).filter(F.col("date").between(F.col("_a"), F.col("_z"))) \
              .withColumn("span", F.explode(F.array_compact(F.array(F.lit("full"), F.when(F.col("date") <= mid, "first"), F.when(F.col("date") >= mid, "second")))))
    m = portfolio_metrics(cut, ["who", "span"])
    g = m.groupBy("span").agg(F.max(F.when(F.col("who") == "s", F.col("cagr"))).alias("s"), F.max(F.when(F.col("who") == "b", F.col("cagr"))).alias("b"),
                              F.max(F.when(F.col("who") == "s", F.col("sharpe"))).alias("ss"), F.max(F.when(F.col("who") == "b", F.col("sharpe"))).alias("bs"))
    halves = g.select(F.concat(F.lit("annualized > benchmark, "), "span").alias("check"), (F.col("s") > F.col("b")).alias("ok"))
    full = g.filter("span = 'full'")
    sharpe = full.select(F.lit("sharpe >= benchmark").alias("check"), (F.col("ss") >= F.col("bs")).alias("ok"))
    pct = random_annualized.transform(with_scalars, full.select("s")).agg(F.avg((F.col("annualized") < F.col("s")).cast("double")).alias("_p"))
    luck = pct.select(F.lit(">= 95% of random portfolios").alias("check"), (F.col("_p") * 100 >= 95).alias("ok"))
    return halves.unionByName(sharpe).unionByName(luck)
