"""Time alignment: as-of joins, calendar grids, filing intervals and month arithmetic.

Every as-of join is one union, one shuffle and one sorted window; never an inequality join. The
window of one key holds at most one row per distinct date on each side, so a hot key costs a
calendar's worth of rows however many probe rows it has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scalars import with_scalars

def latest_per_key(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], keep: str = "last") -> DataFrame:
    """One whole row per key, the last (or first) under ``order``; partial aggregation, no window."""
    rest = [c for c in df.columns if c not in by]
    pick = F.max_by if keep == "last" else F.min_by
    rank = F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(f"o{i}") for i, c in enumerate(order)])
    row = F.struct(*rest)
    picked = df.groupBy(*by).agg(pick(row, rank).alias("_row"))
    return picked.select(*by, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def asof_join(probe: DataFrame, build: DataFrame, by: Sequence[str], probe_ts: str, build_ts: str,
              values: Sequence[str] | None = None, tiebreak: Sequence[str] = (), max_age: int | None = None,
              strict: bool = False, forward: bool = False, probe_unique: bool = False) -> DataFrame:
    """Latest build row at or before (``strict``: before) each probe time, per key.

    ``forward`` looks for the first build row at or after (strict: after) instead. ``max_age`` in
    days nulls older matches. Several build rows on one time keep the last by ``tiebreak``. Result:
    probe columns + ``build_ts`` + ``values``; unmatched probes keep nulls. ``probe_unique`` says
    (by, probe_ts) is unique in the probe, which saves resolving distinct times and joining back.
    """
    by = list(by)
    values = list(values if values is not None else [c for c in build.columns if c not in {*by, build_ts}])
    order = [*tiebreak] or values
    state = F.struct(F.col(build_ts).alias("ts"), *[F.col(v) for v in values])
    known = (build.filter(F.col(build_ts).isNotNull())
             .groupBy(*by, F.col(build_ts).alias("_ts"))
             .agg(F.max_by(state, F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])).alias("_state")))
    if probe_unique:
        asked = probe.select(*by, F.col(probe_ts).alias("_ts"), F.struct(*probe.columns).alias("_probe"))
    else:
        asked = (probe.select(*by, F.col(probe_ts).alias("_ts")).distinct()
                 .withColumn("_probe", F.struct(F.col("_ts").alias("t"))))
    stacked = (known.withColumn("_side", F.lit(1)).unionByName(asked.withColumn("_side", F.lit(2)), allowMissingColumns=True))
    # The build row must sort before the probe of the same time unless the match is strict.
    side = F.when(F.col("_side") == 1, F.lit(1 if strict else 0)).otherwise(F.lit(0 if strict else 1))
    ts = F.col("_ts").desc() if forward else F.col("_ts").asc()
    frame = (Window.partitionBy(*by, *([] if by else [F.lit(0)])).orderBy(ts, side)
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = (stacked.withColumn("_state", F.last("_state", ignorenulls=True).over(frame))
             .filter(F.col("_side") == 2))
    if max_age is not None:
        fresh = F.abs(F.datediff(F.col("_ts"), F.col("_state.ts"))) <= max_age
        found = found.withColumn("_state", F.when(fresh, F.col("_state")))
    got = [F.col("_state.ts").alias(build_ts), *[F.col(f"_state.{v}").alias(v) for v in values]]
    if probe_unique:
        return found.select(*[F.col(f"_probe.{c}").alias(c) for c in probe.columns], *got)
    resolved = found.select(*by, F.col("_ts").alias(probe_ts), *got)
    return probe.join(resolved, [*by, probe_ts], "left")


# --- trading calendar -----------------------------------------------------------------------------

def calendar(dates: DataFrame, date: str = "date") -> DataFrame:
    """(date, pos) with pos 0, 1, ...; one row per trading day, so the single ordered window stays small."""
    return (dates.select(F.col(date).alias("date")).filter(F.col("date").isNotNull()).distinct()
            .withColumn("pos", (F.row_number().over(Window.orderBy("date")) - 1).cast("int")))


def signal_positions(signals: DataFrame, cal: DataFrame, date: str = "signal_date") -> DataFrame:
    """Last trading day at or before the signal (``pos``); signals before the calendar are dropped."""
    return (asof_join(signals, cal.withColumnRenamed("date", "cal_date"), [], date, "cal_date", ["pos"])
            .drop("cal_date").filter(F.col("pos").isNotNull()))


def aligned_ohlc(bars: DataFrame, cal: DataFrame, tiebreak: Sequence[str] = ()) -> DataFrame:
    """Every (ticker, trading day) with open/high/low/close, null where the ticker did not trade.

    The grid is bounded by tickers x calendar; duplicates keep the last by ``tiebreak``.
    """
    cols = ["open", "high", "low", "close"]
    one = latest_per_key(bars.select("ticker", "date", *cols, *[c for c in tiebreak if c not in cols]),
                         ["ticker", "date"], [*tiebreak] or cols)
    days = cal.agg(F.array_sort(F.collect_list(F.struct("pos", "date"))).alias("_days"))
    grid = (bars.select("ticker").distinct().transform(with_scalars, days)      # one row: the calendar itself
            .select("ticker", F.explode("_days").alias("_d")).select("ticker", "_d.pos", "_d.date"))
    return grid.join(one, ["ticker", "date"], "left").select("ticker", "date", "pos", *cols)


def filled_closes(grid: DataFrame, limit: int | None = 5, out: str = "close_filled") -> DataFrame:
    """Forward fill of ``close`` along the calendar, at most ``limit`` rows (None: without limit)."""
    start = Window.unboundedPreceding if limit is None else -limit
    frame = Window.partitionBy("ticker").orderBy("pos").rowsBetween(start, 0)
    return grid.withColumn(out, F.last("close", ignorenulls=True).over(frame))


def rebalance_dates(cal: DataFrame, every: int, warmup: int = 252, start=None, end=None) -> DataFrame:
    out = cal.filter((F.col("pos") >= warmup) & ((F.col("pos") - warmup) % every == 0))
    if start is not None:
        out = out.filter(F.col("date") >= F.to_date(F.lit(start)))
    if end is not None:
        out = out.filter(F.col("date") <= F.to_date(F.lit(end)))
    return out


def month_ends(cal: DataFrame, start=None) -> DataFrame:
    """Last trading day of each calendar month."""
    src = cal if start is None else cal.filter(F.col("date") >= F.to_date(F.lit(start)))
    return src.groupBy(F.trunc("date", "month").alias("month")).agg(F.max_by(F.struct("date", "pos"), "date").alias("d")) \
              .select("month", "d.date", "d.pos")


def next_in_order(dates: DataFrame, date: str = "date", out: str = "next_date", by: Sequence[str] = ()) -> DataFrame:
    """Distinct dates of every series ``by`` with the one that follows (a calendar-sized window)."""
    w = Window.partitionBy(*by).orderBy(date)
    return dates.select(*by, date).distinct().withColumn(out, F.lead(date).over(w))


def eligible(signals: DataFrame, membership: DataFrame, date: str = "signal_date") -> DataFrame:
    """Signals whose ticker belongs to the latest membership snapshot on or before the signal."""
    m = membership.filter(F.col("ticker").isNotNull()).select(F.col("date").alias("snapshot"), "ticker").distinct()
    at = asof_join(signals.select(date).distinct(), m.select("snapshot").distinct(), [], date, "snapshot", [], tiebreak=["snapshot"], probe_unique=True)
    return signals.join(at, date).join(m, ["snapshot", "ticker"], "left_semi")


# --- filings --------------------------------------------------------------------------------------

def filing_intervals(filings: DataFrame, by: str = "cik", filed: str = "filing_date", max_age: int = 200,
                     tiebreak: str = "accession") -> DataFrame:
    """The days on which each filing is its filer's latest: [filed, least(next filing - 1, filed + max_age)].

    One filing per (filer, day) is kept (the last accession), so the window holds one row per day.
    """
    one = latest_per_key(filings, [by, filed], [tiebreak])
    nxt = F.lead(filed).over(Window.partitionBy(by).orderBy(filed))
    stale = F.date_add(F.col(filed), max_age)
    return (one.withColumn("live_from", F.col(filed))
            .withColumn("live_to", F.least(F.date_sub(nxt, 1), stale)))


def latest_filings(filings: DataFrame, dates: DataFrame, by: str = "cik", filed: str = "filing_date", max_age: int = 200,
                   tiebreak: str = "accession") -> DataFrame:
    """(date, filing) pairs: each filer's latest filing no older than ``max_age`` days on each date.

    The dates ride along as one sorted array of rebalance dates, so each filing is expanded only to
    the few dates inside its own interval; no inequality join and no pairs outside the answer.
    """
    live = filing_intervals(filings, by, filed, max_age, tiebreak)
    days = dates.select("date").distinct().agg(F.array_sort(F.collect_list("date")).alias("_days"))
    return (live.transform(with_scalars, days)                                   # one row: the rebalance dates
            .withColumn("date", F.explode(F.filter("_days", lambda d: d.between(F.col("live_from"), F.col("live_to")))))
            .drop("_days"))


def statement_lag_gate(rows: DataFrame, as_of: Column, lag_days: int = 90, period: str = "period_end") -> DataFrame:
    """Statement rows whose period ended at least ``lag_days`` before ``as_of``; unparsable dates drop."""
    ended = F.try_to_date(F.col(period).cast("string"))
    return rows.filter(ended <= F.date_sub(as_of, lag_days))


def year_ago_filing(filings: DataFrame, by: Sequence[str] = ("cik", "form")) -> DataFrame:
    """``prior_accession``: the comparable filing of a year earlier, as known when the filing was made.

    Annual reports look 300-430 days back by filing date. Quarterly reports look 350-380 days back
    by period end, else 330-400 days back by filing date. Of the matches filed on an earlier day, the last one
    filed counts (of equal days the larger accession); a filing made on the same day or later is never taken.
    """
    by = list(by)
    base = filings.withColumn("_id", F.col("accession"))

    def band(ask: str, near: int, far: int, out: str) -> DataFrame:
        probe = base.filter(F.col(ask).isNotNull()).select(*by, "_id", F.date_sub(F.col(ask), near).alias("_at"))
        build = base.select(*by, F.col(ask).alias("_when"), F.col("filing_date").alias("_filed"), F.col("accession").alias(out))
        hit = asof_join(probe, build, by, "_at", "_when", ["_filed", out], tiebreak=["_filed", out], max_age=far - near)
        return hit.select("_id", out)

    def by_period(near: int, far: int, out: str) -> DataFrame:
        """Two bounds: the period end in its band, the filing date before the asking one.

        Blocks of as many days as the band is wide make the join an equality; a block holds one row per
        filer, period end and filing date, which the calendar bounds.
        """
        width = far - near + 1
        block = lambda d: F.floor(F.datediff(d, F.lit("1970-01-01").cast("date")) / width)
        known = base.filter("report_date IS NOT NULL")
        asked = known.select(*by, "_id", "filing_date", F.date_sub("report_date", far).alias("_lo"), F.date_sub("report_date", near).alias("_hi"))
        asked = asked.withColumn("_block", F.explode(F.array_distinct(F.array(block(F.col("_lo")), block(F.col("_hi"))))))
        build = known.groupBy(*by, F.col("report_date").alias("_when"), F.col("filing_date").alias("_filed")).agg(F.max("accession").alias(out)).withColumn("_block", block(F.col("_when")))
        met = asked.join(build, [*by, "_block"]).filter(F.col("_when").between(F.col("_lo"), F.col("_hi")) & (F.col("_filed") < F.col("filing_date")))
        return met.groupBy("_id").agg(F.max_by(out, F.struct("_filed", out)).alias(out))

    annual = band("filing_date", 300, 430, "_annual")
    by_filed = band("filing_date", 330, 400, "_by_filed")
    return (base.join(annual, "_id", "left").join(by_period(350, 380, "_by_period"), "_id", "left").join(by_filed, "_id", "left")
            .withColumn("prior_accession", F.when(F.col("form") == "10-K", F.col("_annual"))
                        .otherwise(F.coalesce("_by_period", "_by_filed")))
            .drop("_id", "_annual", "_by_period", "_by_filed"))


# --- months and splits ----------------------------------------------------------------------------

def month_index(d: Column | str) -> Column:
    d = F.col(d) if isinstance(d, str) else d
    return F.year(d) * 12 + F.month(d)


def month_changes(panel: DataFrame, features: Sequence[str], months: int, key: str = "ticker") -> DataFrame:
    """value(t) - value(t - months) on exact calendar months; a missing month gives null."""
    cur = panel.withColumn("_m", month_index("date"))
    past = cur.select(key, (F.col("_m") + months).alias("_m"), *[F.col(f).alias(f"_{f}_past") for f in features])
    out = cur.join(past, [key, "_m"], "left")
    for f in features:
        out = out.withColumn(f"{f}_chg{months}m", F.col(f) - F.col(f"_{f}_past"))
    return out.drop("_m", *[f"_{f}_past" for f in features])


def raw_close(bars: DataFrame) -> DataFrame:
    """Undo later splits: split-adjusted close x the product of the splits strictly after the day."""
    after = Window.partitionBy("ticker").orderBy("date").rowsBetween(1, Window.unboundedFollowing)
    later = F.coalesce(F.product(F.when(F.col("split") > 0, F.col("split")).otherwise(1.0)).over(after), F.lit(1.0))
    return bars.withColumn("raw_close", F.col("close_split_adj") * later)
