"""Exact ranks, quantiles and buckets that survive a group holding most of the rows.

A window over ``PARTITION BY date`` puts a whole cross-section into one task. These helpers count
the rows per distinct key first (map-side combine), cut only the groups that are too large into
value ranges, and rank inside each range. The answer is exact whatever the cut points are: a cut
point only decides which task ranks a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPLIT_ABOVE = 500_000   # distinct keys one task may rank
CUTS_PER_GROUP = 512    # ranges a larger group is cut into (about)


def positions(df: DataFrame, by: Sequence[str], order: Sequence[str], split_above: int = SPLIT_ABOVE,
              cuts: int = CUTS_PER_GROUP) -> DataFrame:
    """One row per distinct (by, order) key: ``n`` rows, ``lo`` rows of the group before it, ``total``.

    Order columns sort ascending and must not be null. Cut points come from a hash of the key, so a
    recomputed task after an executor loss sees the same ones.
    """
    by, order = list(by), list(order)
    group = by or ["_all"]
    src = df if by else df.withColumn("_all", F.lit(0))
    keys = src.groupBy(*group, *order).agg(F.count(F.lit(1)).alias("n"))
    key = F.struct(*order)

    heavy = keys.groupBy(*group).agg(F.count(F.lit(1)).alias("_d")).filter(F.col("_d") > split_above)
    sample = (keys.join(heavy, group)
              .filter(F.pmod(F.xxhash64(*order), F.ceil(F.col("_d") / cuts)) == 0)
              .groupBy(*group).agg(F.array_sort(F.collect_list(key)).alias("_cuts")))
    ranged = (keys.join(sample, group, "left")
              .withColumn("_range", F.when(F.col("_cuts").isNull(), 0).otherwise(_below(F.col("_cuts"), key, cuts)))
              .drop("_cuts"))

    across = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (ranged.groupBy(*group, "_range").agg(F.sum("n").alias("_n"))
               .withColumn("_before", F.coalesce(F.sum("_n").over(across), F.lit(0)))
               .withColumn("total", F.sum("_n").over(Window.partitionBy(*group)))
               .drop("_n"))
    inside = Window.partitionBy(*group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = (ranged.join(offsets, [*group, "_range"])
           .withColumn("lo", F.col("_before") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
           .select(*by, *order, "n", "lo", "total"))
    return out


def _below(cut_points: Column, key: Column, cuts: int) -> Column:
    """Number of sorted ``cut_points`` below ``key``, by halving; a row is not compared with all of them."""
    steps = F.array(*[F.lit(2 ** i) for i in range((4 * cuts).bit_length(), -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(cut_points, at + s - 1) < key, at + s).otherwise(at))


def fits_tasks(df: DataFrame, by: Sequence[str], split_above: int = SPLIT_ABOVE) -> bool:
    """No group of ``df`` has more rows than one task may rank; counted map-side."""
    rows = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_d"))
    return not rows.filter(F.col("_d") > split_above).limit(1).count()


def _attach(df: DataFrame, by: Sequence[str], order: Sequence[str], where: Column | None = None, split_above: int = SPLIT_ABOVE, **kw) -> DataFrame:
    """``df`` with ``n``, ``lo`` and ``total`` of every row's key, null where a key column is null (or, as for ``dropna``, NaN).

    Groups that fit a task are ranked where one shuffle brings their rows; keys are only set apart, cut into
    ranges and joined back when a group is larger than that.
    """
    by, order = list(by), list(order)
    known = F.lit(True)
    real = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    for c in [*by, *order]:
        known = known & F.col(c).isNotNull()
        if c in order and c in real:
            known = known & ~F.isnan(c)
    if where is None and by:
        marked = df.withColumn("_known", known)
        if fits_tasks(marked, [*by, "_known"], split_above):
            group = Window.partitionBy(*by, "_known")
            run = group.orderBy(*order)
            out = marked.withColumn("lo", (F.rank().over(run) - 1).cast("long")) \
                        .withColumn("n", F.count(F.lit(1)).over(run.rangeBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("lo")) \
                        .withColumn("total", F.count(F.lit(1)).over(group))
            keys = [*by, *order]
            return out.select(*keys, *[c for c in df.columns if c not in keys], *[F.when(F.col("_known"), F.col(c)).alias(c) for c in ("n", "lo", "total")])
    src = df if where is None else df.filter(where)
    pos = positions(src.dropna(subset=order), by, order, split_above=split_above, **kw)
    return df.join(pos, [*by, *order], "left")


def average_rank(df: DataFrame, by: Sequence[str], value: str, out: str = "rank", **kw) -> DataFrame:
    """Rank from 1 with ties averaged; also leaves ``<out>_n``, the non-null count of the group."""
    return (_attach(df, by, [value], **kw)
            .withColumn(out, F.col("lo") + (F.col("n") + 1) / 2.0)
            .withColumnRenamed("total", f"{out}_n").drop("lo", "n"))


def row_position(df: DataFrame, by: Sequence[str], order: Sequence[str], out: str = "rn", **kw) -> DataFrame:
    """Row number from 1 under a total order (``order`` must be unique within the group)."""
    return (_attach(df, by, order, **kw)
            .withColumn(out, F.col("lo") + 1)
            .withColumnRenamed("total", f"{out}_n").drop("lo", "n"))


def unit_rank(df: DataFrame, by: Sequence[str], value: str, out: str, **kw) -> DataFrame:
    """(average rank - 1) / (n - 1); a lone value gets 0.5 and null stays null."""
    ranked = average_rank(df, by, value, "_unit", **kw)
    return (ranked.withColumn(out, F.when(F.col(value).isNull(), None)
                              .when(F.col("_unit_n") == 1, 0.5)
                              .otherwise((F.col("_unit") - 1) / (F.col("_unit_n") - 1)))
            .drop("_unit", "_unit_n"))


def percent_rank_average(df: DataFrame, by: Sequence[str], value: str, out: str, **kw) -> DataFrame:
    """average rank / n, null for null values."""
    return average_rank(df, by, value, "_r", **kw).withColumn(out, F.col("_r") / F.col("_r_n")).drop("_r", "_r_n")


def equal_count_bucket(df: DataFrame, by: Sequence[str], value: str, tiebreak: Sequence[str], buckets: int,
                       out: str = "bucket", **kw) -> DataFrame:
    """Buckets 0..q-1 of (nearly) equal count over first-come ranks; bucket edges are linear quantiles."""
    q = buckets
    return (row_position(df, by, [value, *tiebreak], "_rn", **kw)
            .withColumn(out, F.when(F.col("_rn_n") == 1, 0).otherwise(
                F.greatest(F.lit(0), F.ceil((F.col("_rn") - 1) * q / (F.col("_rn_n") - 1)) - 1)).cast("int"))
            .drop("_rn").withColumnRenamed("_rn_n", f"{out}_n"))


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, quantiles: dict[str, float], **kw) -> DataFrame:
    """Linear-interpolated quantiles per group, one column per name, from exact order statistics."""
    pos = positions(df.dropna(subset=[value]), by, [value], **kw)
    aggs = [F.max("total").alias("n")]
    for name, q in quantiles.items():
        h = (F.col("total") - 1) * F.lit(float(q))
        covers = lambda i: F.max(F.when((F.col("lo") <= i) & (i < F.col("lo") + F.col("n")), F.col(value)))
        low, high = covers(F.floor(h)), covers(F.ceil(h))
        frac = F.max(h - F.floor(h))
        aggs.append((low + (high - low) * frac).alias(name))
    return pos.groupBy(*by).agg(*aggs)
