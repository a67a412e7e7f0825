"""What must not grow faster than the input: exchanges of a plan, rows of one task, repeated joins."""

import random

import pytest

from pitspark.operators import ranks, stats as st


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.fixture(scope="module")
def cross_sections(spark):
    rng = random.Random(5)
    rows = [(d, f"t{i:03d}", rng.choice([None, float("nan"), -0.0, 0.0, *map(float, range(5))]), rng.choice([None, *map(float, range(4))])) for d in range(3) for i in range(60)]
    return spark.createDataFrame(rows, "d int, id string, x double, y double")


def test_ranked_pairs_shuffle_once_and_equal_the_ranges(cross_sections):
    one = st.ranked_pairs(cross_sections, ["d"], "x", "y", "id")
    assert exchanges(one) == 1
    cut = st.ranked_pairs(cross_sections, ["d"], "x", "y", "id", split_above=5)
    cols = ["d", "id", "rank_x", "rank_y", "first_x", "n"]
    show = lambda df: sorted(map(str, df.select(*cols).collect()))
    assert show(one) == show(cut) and one.count() == cross_sections.filter("x IS NOT NULL AND y IS NOT NULL").count()


def test_groups_that_fit_a_task_are_ranked_in_one_shuffle(cross_sections):
    one = ranks.average_rank(cross_sections, ["d"], "x", "r")
    assert exchanges(one) == 1
    cut = ranks.average_rank(cross_sections, ["d"], "x", "r", split_above=5, cuts=4)
    assert one.columns == cut.columns and one.schema.simpleString() == cut.schema.simpleString()
    show = lambda df: sorted(map(str, df.select("d", "id", "r", "r_n").collect()))
    assert show(one) == show(cut) and one.count() == cross_sections.count()
