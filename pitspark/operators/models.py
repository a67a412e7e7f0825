"""Walk-forward models on Spark ML: folds, boosted trees, ridge, ranking, meta-labels, survival.

Folds are a table (fold, date, role) joined to one ranked panel that is written once; the only driver
loop is over folds, and it launches distributed fits. Missing ranks are filled with 0.5 because
Spark's trees do not route nulls.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import AFTSurvivalRegression, GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import stats as st
from .ranks import exact_quantiles, percent_rank_average
from .scalars import with_scalars
from .xsection import check_features, feature_matrix, relevance_grade, target_rank

TREES = {"maxIter": 20, "maxDepth": 3, "stepSize": 0.1, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "minInstancesPerNode": 20, "seed": 0}


# --- folds ------------------------------------------------------------------------------------------------

def walk_forward_splits(dates: DataFrame, min_train: int, test_size: int, embargo: int) -> DataFrame:
    """(fold, date, role): expanding train dates, ``embargo`` dates dropped, then a block of test dates.

    Built from the ranked distinct dates; a date's folds are a sequence, so nothing is cross joined.
    """
    w = Window.orderBy("date")
    d = dates.select("date").distinct().withColumn("_i", (F.row_number().over(w) - 1).cast("int"))
    n = d.agg(F.count(F.lit(1)).alias("_n"))
    first = min_train + embargo
    d = d.transform(with_scalars, n).withColumn("_folds", F.greatest(F.ceil((F.col("_n") - first) / test_size), F.lit(0)).cast("int")).filter("_folds > 0")
    own = F.when(F.col("_i") >= first, F.floor((F.col("_i") - first) / test_size).cast("int"))
    test = d.filter(own.isNotNull()).select(own.alias("fold"), "date", F.lit("test").alias("role"))
    # Trained on by every fold whose test block starts more than ``embargo`` dates later.
    start = F.greatest(F.floor((F.col("_i") + embargo - first) / test_size) + 1, F.lit(0)).cast("int")
    train = d.filter(start < F.col("_folds")).select(F.explode(F.sequence(start, F.col("_folds") - 1)).alias("fold"), "date", F.lit("train").alias("role"))
    return train.unionByName(test)


def model_splits(dates: DataFrame, label_days: int, every: int, min_train: int = 36, test_size: int = 6, embargo: int | None = None) -> DataFrame:
    """Folds whose embargo covers the label overlap plus one date."""
    least = st.overlap_lags(label_days, every) + 1
    return walk_forward_splits(dates, min_train, test_size, least if embargo is None else max(embargo, least))


def fold_numbers(folds: DataFrame) -> list[int]:
    """The fold ids: one small number per test block."""
    return [r["fold"] for r in folds.filter(F.col("role") == "test").select("fold").distinct().orderBy("fold").collect()]


def design(panel: DataFrame, features: Sequence[str], target: str = "fwd_excess") -> DataFrame:
    """(date, ticker, ranked features with 0.5 for unknown, target_rank), written once."""
    check_features(features)
    x = feature_matrix(panel, features).fillna(0.5, subset=list(features))
    return cut_lineage(x.join(target_rank(panel, target), ["date", "ticker"]))


def _assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(df)


def _parts(x: DataFrame, folds: DataFrame, fold: int, label: str) -> tuple[DataFrame, DataFrame]:
    f = folds.filter(F.col("fold") == fold)
    pick = lambda role: x.join(f.filter(F.col("role") == role).select("date"), "date", "left_semi")
    return pick("train").filter(F.col(label).isNotNull()), pick("test")


def _unscored(test: DataFrame, fold: int, scores: Sequence[str], reason: str) -> DataFrame:
    """The test rows of a fold that cannot be fitted, with null scores and the reason."""
    return test.select("date", "ticker", F.lit(fold).alias("fold"), *[F.lit(None).cast("double").alias(s) for s in scores], F.lit(reason).alias("reason"))


# --- regression and ridge -----------------------------------------------------------------------------------

def ridge_fit(train: DataFrame, features: Sequence[str], target: str, alpha: float = 1.0) -> np.ndarray:
    """Closed-form ridge with a free intercept: one aggregate of means and products, one k x k solve."""
    cols = [*features, target]
    k = len(cols)
    arr = F.array(*[F.col(c).cast("double") for c in cols])
    aggs = [F.count(F.lit(1)).alias("n")] + [F.sum(F.get(arr, F.lit(i))).alias(f"s{i}") for i in range(k)]
    aggs += [F.sum(F.get(arr, F.lit(i)) * F.get(arr, F.lit(j))).alias(f"p{i}_{j}") for i in range(k) for j in range(i, k)]
    row = train.agg(*aggs).first()
    n = row["n"]
    mean = np.array([row[f"s{i}"] / n for i in range(k)])
    gram = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            gram[i, j] = gram[j, i] = row[f"p{i}_{j}"] - n * mean[i] * mean[j]
    beta = np.linalg.solve(gram[:-1, :-1] + alpha * np.eye(k - 1), gram[:-1, -1])
    return np.concatenate([[mean[-1] - mean[:-1] @ beta], beta])


def ridge_predict(df: DataFrame, features: Sequence[str], beta: np.ndarray, out: str) -> DataFrame:
    score = F.lit(float(beta[0]))
    for f, b in zip(features, beta[1:]):
        score = score + F.col(f) * float(b)
    return df.withColumn(out, score)


def walk_forward_predict(x: DataFrame, folds: DataFrame, features: Sequence[str], min_rows: int = 200, params: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold ``score_ml`` (boosted trees) and ``score_linear`` (ridge); mean importance per feature.

    ``x``: ``design`` output. The test rows of a fold with too few labelled training rows have null scores and a ``reason``.
    """
    check_features(features)
    spark = x.sparkSession
    folds = cut_lineage(folds)
    out, gains = None, []
    for fold in fold_numbers(folds):
        train, test = _parts(x, folds, fold, "target_rank")
        if train.limit(min_rows).count() < min_rows:
            got = _unscored(test, fold, ["score_ml", "score_linear"], f"fewer than {min_rows} training rows")
            out = got if out is None else out.unionByName(got)
            continue
        model = GBTRegressor(featuresCol="features", labelCol="target_rank", predictionCol="score_ml", **{**TREES, **(params or {})}).fit(_assembled(train, features))
        gains += [(fold, f, float(g)) for f, g in zip(features, model.featureImportances.toArray())]
        beta = ridge_fit(train, features, "target_rank")
        got = ridge_predict(model.transform(_assembled(test, features)), features, beta, "score_linear").select("date", "ticker", F.lit(fold).alias("fold"), "score_ml", "score_linear", F.lit(None).cast("string").alias("reason"))
        out = got if out is None else out.unionByName(got)
    schema = "date date, ticker string, fold int, score_ml double, score_linear double, reason string"
    preds = spark.createDataFrame([], schema) if out is None else out
    importance = spark.createDataFrame(gains, "fold int, feature string, gain double")
    return preds, top_features(importance)


def top_features(importance: DataFrame) -> DataFrame:
    return importance.groupBy("feature").agg(F.avg("gain").alias("mean_gain")).orderBy(F.col("mean_gain").desc(), "feature")


# --- ranking ------------------------------------------------------------------------------------------------

def grade_contrasts(train: DataFrame, features: Sequence[str], levels: int = 10) -> DataFrame:
    """Rows against the mean of every other grade of their date: (feature differences, 1 if the row's grade is higher).

    Pairing each row with at most ``levels`` - 1 grade means keeps the training set linear in the rows;
    no pairs of names are formed.
    """
    g = train.withColumn("grade", relevance_grade(F.col("target_rank"), levels))
    means = g.groupBy("date", F.col("grade").alias("_other")).agg(*[F.avg(f).alias(f"_m_{f}") for f in features], F.count(F.lit(1)).alias("_w"))
    others = g.withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))).filter(F.col("_other") != F.col("grade"))
    j = others.join(cut_lineage(means), ["date", "_other"])     # its size is known then, so the rows do not move
    return j.select("date", *[(F.col(f) - F.col(f"_m_{f}")).alias(f) for f in features], (F.col("grade") > F.col("_other")).cast("double").alias("label"), F.col("_w").cast("double").alias("weight"))


def walk_forward_rank(x: DataFrame, folds: DataFrame, features: Sequence[str], min_rows: int = 200) -> DataFrame:
    """Out-of-fold ranking score: a linear scorer trained to order names of one date by grade; null with a ``reason`` where a fold has too few training rows."""
    check_features(features)
    folds = cut_lineage(folds)
    out = None
    for fold in fold_numbers(folds):
        train, test = _parts(x, folds, fold, "target_rank")
        if train.limit(min_rows).count() < min_rows:
            got = _unscored(test, fold, ["score_rank_model"], f"fewer than {min_rows} training rows")
            out = got if out is None else out.unionByName(got)
            continue
        fit = LogisticRegression(fitIntercept=False, regParam=1e-3, weightCol="weight", maxIter=30).fit(_assembled(grade_contrasts(train, features), features))
        beta = np.concatenate([[0.0], fit.coefficients.toArray()])
        got = ridge_predict(test, features, beta, "score_rank_model").select("date", "ticker", F.lit(fold).alias("fold"), "score_rank_model", F.lit(None).cast("string").alias("reason"))
        out = got if out is None else out.unionByName(got)
    return x.sparkSession.createDataFrame([], "date date, ticker string, fold int, score_rank_model double, reason string") if out is None else out


def rank_average(preds: DataFrame, scores: Sequence[str], out: str = "score_ensemble") -> DataFrame:
    """Mean of the per-date ranks of several scores, ranked together in one pass; null if any score is."""
    long = preds.select("date", "ticker", *[F.col(s).cast("double").alias(s) for s in scores]).unpivot(["date", "ticker"], list(scores), "_s", "_v")
    wide = percent_rank_average(long, ["date", "_s"], "_v", "_q").groupBy("date", "ticker").pivot("_s", list(scores)).agg(F.max("_q"))
    total = sum((F.col(s) for s in scores[1:]), F.col(scores[0]))
    return preds.join(wide.select("date", "ticker", (total / len(scores)).alias(out)), ["date", "ticker"])


# --- meta-labels -----------------------------------------------------------------------------------------------

THRESHOLD_QUANTILES = (0.5, 0.6, 0.7, 0.8, 0.9)


def _classifier(train: DataFrame, features: Sequence[str], label: str):
    pos = train.agg(F.avg(F.col(label).cast("double")).alias("p")).first()["p"]
    if not pos or pos >= 1:
        return None
    w = F.when(F.col(label) == 1, (1 - pos) / pos).otherwise(1.0)
    return GBTClassifier(featuresCol="features", labelCol=label, weightCol="_w", **TREES).fit(_assembled(train.withColumn("_w", w), features))


def _probability(model, df: DataFrame, features: Sequence[str], out: str = "p_target") -> DataFrame:
    return model.transform(_assembled(df, features)).withColumn(out, F.get(vector_to_array("probability"), F.lit(1))).drop("features", "rawPrediction", "probability", "prediction")


def choose_threshold(scored: DataFrame, r: str = "r_multiple", p: str = "p_target", min_trades: int = 50) -> float:
    """The probability cut-off with the best mean R among fixed quantiles; 0 (take all) unless one beats it."""
    cuts = exact_quantiles(scored, [], p, {f"q{i}": q for i, q in enumerate(THRESHOLD_QUANTILES)}).first()
    overall = scored.agg(F.avg(r).alias("all")).first()["all"]
    rows = scored.agg(*[F.avg(F.when(F.col(p) >= cuts[f"q{i}"], F.col(r))).alias(f"m{i}") for i in range(len(THRESHOLD_QUANTILES))],
                      *[F.count_if(F.col(p) >= cuts[f"q{i}"]).alias(f"n{i}") for i in range(len(THRESHOLD_QUANTILES))]).first()
    best, level = overall, 0.0
    for i in range(len(THRESHOLD_QUANTILES)):
        if rows[f"n{i}"] >= min_trades and rows[f"m{i}"] is not None and rows[f"m{i}"] > best:
            best, level = rows[f"m{i}"], float(cuts[f"q{i}"])
    return level


def training_trades(candidates: DataFrame, folds: DataFrame) -> DataFrame:
    """``candidates`` with the ``fold`` they may be learnt from: entered trades that exited before the fold's first test signal."""
    by_date = folds.join(candidates.select("date", "signal_pos"), "date").filter(F.col("role") == "test")
    first = by_date.groupBy("fold").agg(F.min("signal_pos").alias("_first"))
    rows = folds.filter(F.col("role") == "train").select("fold", "date").join(candidates, "date").join(first, "fold")
    return rows.filter((F.col("outcome") != "skipped") & (F.col("exit_pos") < F.col("_first")) & F.col("y").isNotNull()).drop("_first")


def inner_split(train: DataFrame, share: float = 0.25, embargo: int = 0) -> DataFrame:
    """(fold, date, part): every fold's unique training dates, the last ``share`` to check a threshold on.

    ``train``: (fold, date). The ``embargo`` dates before the first 'check' date are 'purged', the others 'fit' (one at
    least). A window holds a fold's dates, which a calendar bounds.
    """
    w = Window.partitionBy("fold").orderBy("date")
    d = train.select("fold", "date").distinct().withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy("fold"))})
    cut = F.floor(F.col("_n") * (1 - share))
    part = F.when(F.col("_i") >= cut, "check").when(F.col("_i") < F.greatest(cut - embargo, F.lit(1)), "fit").otherwise("purged")
    return d.select("fold", "date", part.alias("part"))


class Leak(RuntimeError):
    """A trade that a threshold's model learns from is still open when the threshold is checked."""


def assert_purged(fit: DataFrame, check: DataFrame) -> None:
    last, first = fit.agg(F.max("exit_pos").alias("m")).first()["m"], check.agg(F.min("signal_pos").alias("m")).first()["m"]
    if last is not None and first is not None and last >= first:
        raise Leak(f"a trade of the inner fit exits at {last}, the check begins at {first}; take a longer embargo")


def walk_forward_probabilities(candidates: DataFrame, folds: DataFrame, features: Sequence[str], min_rows: int = 200, inner_share: float = 0.25, embargo: int = 0) -> DataFrame:
    """Out-of-fold P(target first) of every candidate and the fold's own cut-off.

    ``candidates``: date, ticker, signal_pos, outcome, exit_pos, y, r_multiple and the features. Training
    rows are entered trades that exited before the first test signal; every test candidate is scored,
    because whether its entry gaps is next-day information. The cut-off is chosen on the last ``inner_share`` of the
    unique training dates by a model of the dates before them, less ``embargo`` dates; an embargo under which
    a trade of that model overlaps the check is refused. Without enough rows of both classes for a fold's model the
    probabilities are null, and without enough for the inner fit or its check the cut-off is null; ``reason`` says so.
    """
    folds, c = cut_lineage(folds), cut_lineage(candidates)
    trades = training_trades(c, folds)
    trades = cut_lineage(trades.join(inner_split(trades, inner_share, embargo), ["fold", "date"]))
    out = None
    for fold in fold_numbers(folds):
        _, test = _parts(c.withColumn("_one", F.lit(1)), folds, fold, "_one")
        if not test.limit(1).count():
            continue  # a fold without a test row
        train = trades.filter(F.col("fold") == fold).drop("fold")
        enough = train.limit(min_rows).count() >= min_rows
        model = _classifier(train, features, "y") if enough else None
        if model is None:
            got = _unscored(test, fold, ["p_target", "threshold"], "training rows of one class" if enough else f"fewer than {min_rows} training rows")
            out = got if out is None else out.unionByName(got)
            continue
        inner_fit, inner_val = train.filter(F.col("part") == "fit"), train.filter(F.col("part") == "check")
        assert_purged(inner_fit, inner_val)
        level, reason = None, None
        if inner_fit.limit(min_rows).count() < min_rows:
            reason = f"no threshold: fewer than {min_rows} rows of the inner fit"
        elif inner_val.limit(50).count() < 50:
            reason = "no threshold: fewer than 50 rows to choose it on"
        elif (inner := _classifier(inner_fit, features, "y")) is None:
            reason = "no threshold: rows of the inner fit of one class"
        else:
            level = choose_threshold(_probability(inner, inner_val, features))
        got = _probability(model, test, features).select("date", "ticker", F.lit(fold).alias("fold"), "p_target", F.lit(level).cast("double").alias("threshold"), F.lit(reason).cast("string").alias("reason"))
        out = got if out is None else out.unionByName(got)
    return c.sparkSession.createDataFrame([], "date date, ticker string, fold int, p_target double, threshold double, reason string") if out is None else out


# --- survival ------------------------------------------------------------------------------------------------------

SECTORS = ["manufacturing", "services", "finance", "retail", "transport_utilities", "mining", "wholesale", "construction", "agriculture", "public_admin"]


def survival_design(frame: DataFrame, rank_features: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Per-date ranks of the features, raw drawdown and valuation, and sector dummies ('unknown' is the base)."""
    from .xsection import cross_sectional_rank

    ranked = cross_sectional_rank(frame, rank_features).fillna(0.5)
    raw = frame.select("date", "ticker", F.coalesce("drawdown", F.lit(0.25)).alias("drawdown_depth"), F.coalesce("valuation_pct", F.lit(0.5)).alias("valuation_level"),
                       F.coalesce(F.col("price_only").cast("double"), F.lit(0.0)).alias("price_only_flag"),
                       *[(F.coalesce(F.col("sector") == s, F.lit(False))).cast("double").alias(f"sector_{s}") for s in SECTORS])
    return ranked.join(raw, ["date", "ticker"]), [*rank_features, "drawdown_depth", "valuation_level", "price_only_flag", *[f"sector_{s}" for s in SECTORS]]


def fit_aft(train: DataFrame, features: Sequence[str]):
    """Accelerated failure time model of (duration, event); constant columns drop."""
    spread = train.agg(*[F.stddev_samp(f).alias(f) for f in features]).first()
    used = [f for f in features if spread[f] and spread[f] > 0]
    rows = _assembled(train.withColumn("_label", F.greatest(F.col("duration").cast("double"), F.lit(1.0))).withColumn("_event", F.col("event").cast("double")), used)
    return AFTSurvivalRegression(featuresCol="features", labelCol="_label", censorCol="_event", predictionCol="_scale", maxIter=50).fit(rows), used


def aft_curve_params(model, test: DataFrame, used: Sequence[str]) -> DataFrame:
    """Weibull scale per row and the shape 1 / sigma: S(t) = exp(-(t / scale) ** shape)."""
    return model.transform(_assembled(test, used)).withColumn("shape", F.lit(1.0 / float(model.scale))).withColumnRenamed("_scale", "scale").drop("features")


def expected_annualized_return(rows: DataFrame, target: float, fail_return: float, cap: int = 2520, step: int = 21, horizons: Sequence[int] = (6, 12, 24)) -> DataFrame:
    """P(hit) at the horizons, median months, expected return and its annual rate from per-row Weibull curves.

    The month grid lives inside the row as an array, so nothing is exploded.
    """
    s = lambda t: F.exp(-F.pow(F.greatest(t.cast("double"), F.lit(0.0)) / F.col("scale"), F.col("shape")))
    return _annualize(rows, s, target, fail_return, cap, step, horizons)


def _annualize(rows: DataFrame, s, target: float, fail_return: float, cap: int, step: int, horizons: Sequence[int]) -> DataFrame:
    grid = F.sequence(F.lit(0), F.lit(cap), F.lit(step))
    last = (cap // step) * step
    x = rows.withColumn("_curve", F.transform(grid, lambda t: s(t)))
    n = F.size("_curve")
    area = F.aggregate(F.sequence(F.lit(0), n - 2), F.lit(0.0), lambda a, i: a + (F.get("_curve", i) + F.get("_curve", i + 1)) / 2 * step)
    half = F.array_position(F.transform("_curve", lambda v: v <= 0.5), True)
    p_cap = 1 - s(F.lit(last))
    x = x.withColumns({**{f"p_hit_{m}m": 1 - s(F.lit(m * 21)) for m in horizons}, "median_months": F.when(half > 0, (half - 1) * step / 21.0),
                       "expected_return": p_cap * target + (1 - p_cap) * fail_return, "_years": F.greatest(area / 252, F.lit(1 / 12))})
    g = 1 + F.col("expected_return")
    return x.withColumn("expected_annualized_return", F.signum(g) * F.pow(F.abs(g), 1 / F.col("_years")) - 1).drop("_curve", "_years")
