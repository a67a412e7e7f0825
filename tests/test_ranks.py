import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitspark.operators import ranks, xsection


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows, one value holds a third of it."""
    rng = random.Random(3)
    data = [("hot", f"t{i:05d}", 0.0 if i % 3 == 0 else round(rng.uniform(-5, 5), 2)) for i in range(3000)]
    data += [("cold", f"t{i:05d}", float(i % 4)) for i in range(9)] + [("one", "t0", 7.0)]
    return pd.DataFrame(data, columns=["g", "id", "v"]), spark.createDataFrame(data, "g string, id string, v double")


@pytest.mark.parametrize("split", [10**9, 50])
def test_average_rank_equals_pandas_with_and_without_splitting(skewed, split):
    pdf, df = skewed
    got = ranks.average_rank(df, ["g"], "v", "r", split_above=split, cuts=16).toPandas()
    want = pdf.assign(r=pdf.groupby("g")["v"].rank())
    m = got.merge(want, on=["g", "id"])
    assert np.allclose(m["r_x"], m["r_y"])


def test_large_groups_are_really_split(skewed):
    _, df = skewed
    parts = ranks.positions(df, ["g"], ["v"], split_above=50, cuts=16)
    assert "_range" in parts._jdf.queryExecution().toString()


@pytest.mark.parametrize("split", [10**9, 50])
def test_unit_rank_quantiles_and_positions(skewed, split):
    pdf, df = skewed
    u = ranks.unit_rank(df, ["g"], "v", "u", split_above=split, cuts=16).toPandas().set_index(["g", "id"])["u"]
    assert u["one", "t0"] == 0.5
    q = ranks.exact_quantiles(df, ["g"], "v", {"a": 0.1, "m": 0.5}, split_above=split, cuts=16).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        assert np.isclose(q.loc[g, "m"], part["v"].median()) and np.isclose(q.loc[g, "a"], np.quantile(part["v"], 0.1))
    rn = ranks.row_position(df, ["g"], ["v", "id"], "rn", split_above=split, cuts=16).toPandas()
    want = pdf.sort_values(["v", "id"]).groupby("g").cumcount() + 1
    m = rn.merge(pdf.assign(want=want), on=["g", "id"])
    assert (m["rn"] == m["want"]).all()


@pytest.mark.parametrize("n", [1, 5, 10, 11, 23, 57])
@pytest.mark.parametrize("q", [5, 10])
def test_buckets_equal_qcut_of_first_ranks(spark, n, q):
    if n < q:
        return
    rng = np.random.default_rng(n)
    pdf = pd.DataFrame({"d": 1, "id": [f"{i:03d}" for i in range(n)], "v": rng.integers(0, 6, n).astype(float)})
    got = ranks.equal_count_bucket(spark.createDataFrame(pdf), ["d"], "v", ["id"], q).toPandas().set_index("id")["bucket"]
    want = pd.qcut(pdf["v"].rank(method="first"), q, labels=False)
    assert got.reindex(pdf["id"]).tolist() == want.tolist()


def test_cross_sectional_rank_keeps_null_and_ranks_all_columns(spark):
    df = spark.createDataFrame([("d", "a", 1.0, 5.0), ("d", "b", 2.0, None), ("d", "c", 2.0, 1.0)], "date string, ticker string, x double, y double")
    got = {r["ticker"]: (r["x"], r["y"]) for r in xsection.cross_sectional_rank(df, ["x", "y"]).collect()}
    assert got == {"a": (0.0, 1.0), "b": (0.75, None), "c": (0.75, 0.0)}


def test_forbidden_features_are_refused():
    with pytest.raises(ValueError):
        xsection.check_features(["momentum_12_1", "fwd_return"])
    assert xsection.check_features(["roe"]) == ["roe"] and len(xsection.FEATURES) == 28


def test_range_of_a_key_by_halving(spark):
    for n in (0, 1, 5, 511, 700):
        points = [2 * i for i in range(n)]
        df = spark.range(-1, 2 * n + 2).select("id", F.array(*[F.lit(p) for p in points]).cast("array<bigint>").alias("c"))
        got = {r["id"]: r["at"] for r in df.select("id", ranks._below(F.col("c"), F.col("id"), 512).alias("at")).collect()}
        assert got == {k: sum(p < k for p in points) for k in got}
