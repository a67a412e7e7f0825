"""Labels and trade outcomes: forward returns, first-touch exits, targets, trades.

First touch never ships the bars of a trade: extremes of blocks of 1, 4, 16, ... bars are laid over the ticker's
calendar grid by ``lead`` windows, and a trade descends to the bar that ends it, a level per equi-join of flat rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asof import asof_join
from .scalars import with_scalars

COST_PER_SIDE = 0.0010
SLIPPAGE_PER_SIDE = 0.0005
SIDE_COST = COST_PER_SIDE + SLIPPAGE_PER_SIDE
FAR_TARGET = 1e12
NO_STOP = 1e-12


def by_pos():
    return Window.partitionBy("ticker").orderBy("pos")



def net_return(entry: Column, exit_: Column, cost: float = SIDE_COST) -> Column:
    return exit_ * (1 - cost) / (entry * (1 + cost)) - 1


# --- forward returns --------------------------------------------------------------------------------

def forward_returns(grid: DataFrame, bench_grid: DataFrame, days: int, close: str = "close_filled") -> DataFrame:
    """Return and excess from the close after the signal to the close ``days`` later, for every grid row."""
    b = Window.orderBy("pos")                                 # the benchmark: one row per trading day
    bench = bench_grid.select("pos", F.lead("close", 1).over(b).alias("_b0"), F.lead("close", 1 + days).over(b).alias("_b1"))
    out = (grid.withColumn("_s0", F.lead(close, 1).over(by_pos())).withColumn("_s1", F.lead(close, 1 + days).over(by_pos()))
           .join(bench, "pos", "left"))
    ok = (F.col("_s0") != 0) & (F.col("_s1") != 0) & (F.col("_b0") != 0) & (F.col("_b1") != 0)
    ret = F.when(ok, F.col("_s1") / F.col("_s0") - 1)
    return (out.withColumn("fwd_return", ret).withColumn("fwd_excess", ret - (F.col("_b1") / F.col("_b0") - 1))
            .drop("_s0", "_s1", "_b0", "_b1"))


def next_open_returns(keys: DataFrame, grid: DataFrame) -> DataFrame:
    """From the next open after each key date to the next open after the following key date.

    Keys carry (ticker, date, pos). A missing exit open falls back to the last close in between.
    """
    steps = (keys.select("date", "pos").distinct().withColumn("next_pos", F.lead("pos").over(Window.orderBy("pos")))
             .select("date", "next_pos"))                     # one row per rebalance date
    filled = grid.withColumn("_last", F.last("close", ignorenulls=True).over(by_pos().rowsBetween(Window.unboundedPreceding, 0))) \
                 .withColumn("_last_pos", F.last(F.when(F.col("close").isNotNull(), F.col("pos")), ignorenulls=True)
                             .over(by_pos().rowsBetween(Window.unboundedPreceding, 0)))
    k = keys.join(steps, "date").withColumn("_a", F.col("pos") + 1).withColumn("_b", F.col("next_pos") + 1)
    start = grid.select("ticker", F.col("pos").alias("_a"), F.col("open").alias("_entry"))
    end = filled.select("ticker", F.col("pos").alias("_b"), F.col("open").alias("_exit_open"), "_last", "_last_pos")
    out = k.join(start, ["ticker", "_a"], "left").join(end, ["ticker", "_b"], "left")
    exit_ = F.coalesce(F.col("_exit_open"), F.when(F.col("_last_pos") >= F.col("_a"), F.col("_last")))
    return (out.withColumn("next_return", F.when(F.col("_entry") > 0, exit_ / F.col("_entry") - 1))
            .drop("_a", "_b", "_entry", "_exit_open", "_last", "_last_pos", "next_pos"))


def next_month_returns(keys: DataFrame, bars: DataFrame) -> DataFrame:
    """As ``next_open_returns`` on the ticker's own non-null opens; also the exit date."""
    steps = keys.select("date").distinct().withColumn("_next", F.lead("date").over(Window.orderBy("date")))
    opens = bars.filter(F.col("open").isNotNull()).select("ticker", F.col("date").alias("open_date"), "open")
    k = keys.join(steps, "date", "left")
    first = asof_join(k, opens.withColumnsRenamed({"open_date": "_ad", "open": "_a"}), ["ticker"], "date", "_ad", ["_a"],
                      strict=True, forward=True)
    second = asof_join(first, opens.withColumnsRenamed({"open_date": "exit_date", "open": "_z"}), ["ticker"], "_next", "exit_date",
                       ["_z"], strict=True, forward=True)
    return second.withColumn("next_return", F.col("_z") / F.col("_a") - 1).drop("_ad", "_a", "_z", "_next")


def benchmark_period_returns(bench: DataFrame, dates: DataFrame) -> DataFrame:
    """Benchmark open to open, from the day after each date to the day after the next one."""
    w = Window.orderBy("pos")
    opens = bench.select("date", "pos", F.lead("open", 1).over(w).alias("_o"))
    at = opens.join(dates.select("date").distinct(), "date")
    return at.withColumn("bench_return", F.lead("_o").over(w) / F.col("_o") - 1).select("date", "bench_return")


# --- first touch ---------------------------------------------------------------------------------------

def once(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns behind a one-row generator, so an array expression is evaluated once per row and not
    copied into every later expression that reads it."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


#: Blocks of one level that make a block of the next.
RADIX = 4
#: How near a price counts as at a trailing level; both sides of the comparison are sums of rounded prices.
HAIR = 1e-9
GONE = float("-inf")


def _levels(hold: int) -> int:
    n = 1
    while RADIX ** n < hold:
        n += 1
    return n


def touch_blocks(grid: DataFrame, level: int, trailing: bool = False) -> DataFrame:
    """Per grid row the extremes of the next ``m * RADIX ** level`` bars, the row's own first, for m = 1..RADIX.

    ``lo{m}`` is the lowest price that can touch a stop, ``hi{m}`` the highest that can touch a target (with
    ``trailing`` the highest high, and ``dd{m}`` the deepest fall from a high to a later low). A bar without a close,
    and every bar past the end, has the low ``-inf``: it ends every trade. Each level is made of the one below by
    ``lead`` over the ticker's calendar, so all levels take one shuffle by ticker.
    """
    high = F.col("high") if trailing else F.greatest("open", "high")
    x = grid.select("ticker", "pos", "open", F.when(F.col("close").isNull(), GONE).otherwise(F.least("open", "low")).alias("lo1"), high.alias("hi1"))
    if trailing:
        x = x.withColumn("dd1", F.lit(None).cast("double"))
    names = ["lo", "hi", "dd"] if trailing else ["lo", "hi"]
    for j in range(level + 1):
        if j:
            x = x.select("ticker", "pos", "open", *[F.col(f"{n}{RADIX}").alias(f"{n}1") for n in names])
        nth = {f"_{n}{m}": F.lead(f"{n}1", m * RADIX ** j, *([GONE] if n == "lo" else [])).over(by_pos()) for n in names for m in range(1, RADIX)}
        x = x.withColumns(nth)
        for m in range(1, RADIX):
            if trailing:
                x = x.withColumn(f"dd{m + 1}", F.greatest(f"dd{m}", f"_dd{m}", F.col(f"hi{m}") - F.col(f"_lo{m}")))
            x = x.withColumns({f"lo{m + 1}": F.least(f"lo{m}", f"_lo{m}"), f"hi{m + 1}": F.greatest(f"hi{m}", f"_hi{m}")})
        x = x.drop(*nth)
    return x


def _entries(df: DataFrame, grid: DataFrame, hold: int, trailing: bool) -> DataFrame:
    """``df`` with the open of the bar after ``pos`` as ``_entry`` and the extremes of the top level from that bar on."""
    top = touch_blocks(grid, _levels(hold) - 1, trailing)
    extremes = [c for c in top.columns if c not in ("ticker", "pos", "open")]
    top = top.select("ticker", (F.col("pos") - 1).alias("pos"), F.col("open").alias("_entry"), *[F.col(c).alias(f"_{c}") for c in extremes])
    return df.join(top, ["ticker", "pos"], "left")


def _descend(df: DataFrame, grid: DataFrame, hold: int, valid: Column, touched, trailing: bool = False) -> DataFrame:
    """Add ``_k``, the bars from the entry to the first one that ends the trade (null if none does within ``hold``), and ``_gone``, whether that one has no close.

    ``df`` comes from ``_entries``; ``touched(lo, hi or top, dd)`` says whether a run of bars ends the trade. The first
    of the blocks of a level that does is opened on the level below, found by an equi-join on its first bar. Only
    trades that end by a touch within reach go down at all. With ``trailing``, ``_top`` is the highest high before that bar.
    """
    parts = ["lo", "hi", "dd"] if trailing else ["lo", "hi"]

    def step(x: DataFrame, width: int, opened: Column) -> DataFrame:
        hit = [F.coalesce(touched(*[F.col(f"_{n}{m}") for n in parts]), F.lit(False)) for m in range(1, RADIX + 1)]
        digit = F.when(~opened, None)
        low = F.when(~opened, None)
        for m, h in enumerate(hit, 1):
            digit, low = digit.when(h, m - 1), low.when(h, F.col(f"_lo{m}") == GONE)
        x = x.withColumns({"_d": digit, "_g": low})
        if trailing:
            x = x.withColumn("_top", F.greatest("_top", F.when(F.col("_d") == 1, F.col("_hi1")).when(F.col("_d") == 2, F.col("_hi2")).when(F.col("_d") == 3, F.col("_hi3"))))
        return x.withColumns({"_cur": F.col("_cur") + F.col("_d") * width, "_gone": F.col("_g")}).drop("_d", "_g", *[f"_{n}{m}" for n in parts for m in range(1, RADIX + 1)])

    x = df.withColumn("_cur", F.col("pos") + 1)
    if trailing:
        x = x.withColumn("_top", F.lit(None).cast("double"))
    level = _levels(hold) - 1
    x = step(x, RADIX ** level, valid)
    for j in reversed(range(level)):
        below = touch_blocks(grid, j, trailing).drop("open")
        below = below.select("ticker", F.col("pos").alias("_cur"), *[F.col(c).alias(f"_{c}") for c in below.columns if c not in ("ticker", "pos")])
        x = x.join(below, ["ticker", "_cur"], "left")
        # past the last bar there is no row; the trade ends there
        x = x.withColumn("_lo1", F.when(F.col("_cur").isNotNull(), F.coalesce("_lo1", F.lit(GONE))))
        x = step(x, RADIX ** j, F.col("_cur").isNotNull())
    k = F.col("_cur") - F.col("pos") - 1
    return x.withColumn("_k", F.when(k < hold, k)).withColumn("_gone", F.when(k < hold, F.col("_gone"))).drop("_cur")


def _at_exit(df: DataFrame, grid: DataFrame) -> DataFrame:
    """Join the open, low and close of the exit bar, ``_k`` bars after the entry."""
    bar = grid.select("ticker", F.col("pos").alias("_x"), F.col("open").alias("_xo"), F.col("low").alias("_xl"), F.col("close").alias("_xc"))
    return df.withColumn("_x", F.when(F.col("outcome") != "skipped", F.col("pos") + 1 + F.col("_k"))).join(bar, ["ticker", "_x"], "left").drop("_x")


def walk_barriers(df: DataFrame, grid: DataFrame, stop: str, target: str, hold: int | str, cost: float = SIDE_COST, most: int | None = None) -> DataFrame:
    """Stop, target or time exit, whichever the bars after ``pos`` touch first; the stop wins inside one bar.

    Adds outcome, entry/exit position and price, days_held, ret (net), r_multiple, y. A gap through
    the stop fills at the open; the entry bar cannot gap. A missing close ends the trade at the last
    close before it. ``hold`` may be a column of holding periods of at most ``most`` bars.

    The first bar that touches either level is searched for at once, by a descent over block extremes
    (``touch_blocks``): the work is a few equi-joins of flat rows, one more for every fourfold of the holding period.
    """
    most = most or hold
    held = F.lit(hold) if isinstance(hold, int) else F.col(hold)
    return _walked(_entries(df, grid, most, False), grid, stop, target, held, most, cost)


def _walked(entered: DataFrame, grid: DataFrame, stop: str, target: str, held: Column, most: int, cost: float) -> DataFrame:
    s, t = F.col(stop), F.col(target)
    valid = F.coalesce((s > 0) & (F.col("_entry") > s) & (F.col("_entry") < t), F.lit(False))
    x = _descend(entered, grid, most, valid, lambda lo, hi: (lo <= s) | (hi >= t))
    return _barrier_exit(x, grid, s, t, valid, held, cost)


def _barrier_exit(x: DataFrame, grid: DataFrame, s: Column, t: Column, valid: Column, held: Column, cost: float) -> DataFrame:
    x = x.withColumn("_hit", F.when(F.col("_k") < held, F.col("_k")))
    state = F.when(~valid, "skipped").when(F.col("_hit").isNull(), "time").when(F.col("_gone"), "data_end").otherwise("touch")
    last = F.when(state == "time", held - 1).when(state == "data_end", F.greatest(F.col("_hit") - 1, F.lit(0))).otherwise(F.col("_hit"))
    x = _at_exit(x.withColumn("outcome", state).withColumn("_k", last.cast("int")), grid)
    stopped = F.coalesce(F.least("_xo", "_xl") <= s, F.lit(False))
    x = x.withColumn("outcome", F.when(F.col("outcome") != "touch", F.col("outcome")).when(stopped, "stop").otherwise("target"))
    price = (F.when(F.col("outcome") == "stop", F.when(F.col("_xo") <= s, F.col("_xo")).otherwise(s))
             .when(F.col("outcome") == "target", t).when(F.col("outcome") != "skipped", F.col("_xc")))
    return _trade_columns(x, price, s, F.when(F.col("outcome") == "target", 1.0).otherwise(0.0), cost, ["_hit", "_gone", "_xo", "_xl", "_xc"])


def _trade_columns(df: DataFrame, price: Column, stop: Column, y: Column, cost: float, drop: Sequence[str]) -> DataFrame:
    live, entry, k = F.col("outcome") != "skipped", F.col("_entry"), F.col("_k")
    df = df.withColumns({"entry_price": entry, "exit_price": price, "entry_pos": F.col("pos") + 1,
                         "exit_pos": F.when(live, F.col("pos") + 1 + k), "days_held": F.when(live, k + 1)})
    df = df.withColumn("ret", F.when(live, net_return(entry, F.col("exit_price"), cost)))
    return df.withColumns({"r_multiple": F.when(live, F.col("ret") / ((entry - stop) / entry)), "y": F.when(live, y)}) \
             .drop("_entry", "_k", *drop)


def walk_trailing_stop(df: DataFrame, grid: DataFrame, atr: str, stop_atr: float | Column, hold: int, cost: float = SIDE_COST, close: str = "close") -> DataFrame:
    """Chandelier exit: the stop on a bar is the larger of the initial stop and the highest high of the
    completed bars minus k ATR. Same entry, gap and missing-close rules as ``walk_barriers``.

    A run of bars touches the stop if its low reaches the initial stop, lies k ATR below the highest high
    before the run, or below an earlier high inside it; the highest high is carried down the levels. Prices within
    ``HAIR`` of the stop touch it.
    """
    k = stop_atr if isinstance(stop_atr, Column) else F.lit(float(stop_atr))
    x = _entries(df, grid, hold, True).withColumn("_width", k * F.col(atr)).withColumn("_stop0", F.col(close) - F.col("_width"))
    valid = F.coalesce((F.col("_stop0") > 0) & (F.col("_entry") > F.col("_stop0")), F.lit(False))
    far, s = F.col("_width") - HAIR, F.col("_stop0") + HAIR
    no = F.lit(False)
    touched = lambda lo, hi, dd: (lo <= s) | F.coalesce(F.col("_top") - lo >= far, no) | F.coalesce(dd >= far, no)
    x = _descend(x, grid, hold, valid, touched, trailing=True).withColumn("_hit", F.col("_k"))
    x = x.withColumn("outcome", F.when(~valid, "skipped").when(F.col("_hit").isNull(), "time").when(F.col("_gone"), "data_end").otherwise("stop"))
    x = x.withColumn("_k", F.when(F.col("outcome") == "time", hold - 1).when(F.col("outcome") == "data_end", F.greatest(F.col("_hit") - 1, F.lit(0)))
                     .otherwise(F.col("_hit")).cast("int"))
    x = _at_exit(x, grid)
    level = F.greatest("_stop0", F.col("_top") - F.col("_width"))
    price = (F.when(F.col("outcome") == "stop", F.when(F.col("_xo") <= level, F.col("_xo")).otherwise(level))
             .when((F.col("outcome") == "data_end") & (F.col("_hit") == 0), F.col("_entry"))
             .when(F.col("outcome") != "skipped", F.col("_xc")))
    out = _trade_columns(x, price, F.col("_stop0"), F.when(F.col("ret") > 0, 1.0).otherwise(0.0), cost, ["_hit", "_gone", "_top", "_width", "_xo", "_xl", "_xc"])
    return out.withColumnRenamed("_stop0", "stop")


# --- levels and geometries ---------------------------------------------------------------------------

def grid_levels(df: DataFrame, stop_atr: Column, target_r: Column, atr: str = "atr_14d") -> DataFrame:
    stop = F.col("close") - stop_atr * F.col(atr)
    return df.withColumn("stop", stop).withColumn("target", F.col("close") + target_r * (F.col("close") - F.col("stop")))


def geometry_grid(stops: Sequence[float] = (1.5, 2.0, 3.0), targets: Sequence[float] = (1.5, 2.0, 3.0),
                  holds: Sequence[int] = (5, 10, 20)) -> Column:
    """Array of (geometry, stop_atr, target_r, hold) cells to explode next to each candidate."""
    return F.array(*[F.struct(F.lit(f"atr{s:g}_r{t:g}_hold{h}").alias("geometry"), F.lit(float(s)).alias("stop_atr"),
                              F.lit(float(t)).alias("target_r"), F.lit(h).alias("hold"))
                     for h in holds for s in stops for t in targets])


def grid_outcomes(candidates: DataFrame, grid: DataFrame, stops=(1.5, 2.0, 3.0), targets=(1.5, 2.0, 3.0), holds=(5, 10, 20),
                  atr: str = "atr_14d", cost: float = SIDE_COST) -> DataFrame:
    """Every candidate under every stop x target x hold cell.

    The first bar that ends a trade does not depend on how long it may be held, so each stop x target pair is
    searched once, over the longest hold; the holds only choose between that bar and the time exit.
    """
    most = max(holds)
    entered = _entries(candidates, grid, most, False)
    pairs = F.array(*[F.struct(F.lit(float(s)).alias("stop_atr"), F.lit(float(t)).alias("target_r")) for s in stops for t in targets])
    cells = grid_levels(entered.withColumn("_g", F.explode(pairs)).select(*entered.columns, "_g.*"), F.col("stop_atr"), F.col("target_r"), atr)
    s, t = F.col("stop"), F.col("target")
    valid = F.coalesce((s > 0) & (F.col("_entry") > s) & (F.col("_entry") < t), F.lit(False))
    found = _descend(cells, grid, most, valid, lambda lo, hi: (lo <= s) | (hi >= t))
    found = found.withColumn("hold", F.explode(F.array(*[F.lit(h) for h in holds])))
    name = F.format_string("atr%s_r%s_hold%d", _short("stop_atr"), _short("target_r"), F.col("hold"))
    return _barrier_exit(found.withColumn("geometry", name), grid, s, t, valid, F.col("hold"), cost)


def _short(c: str) -> Column:
    """A number without a trailing ``.0``, as in the names of the cells."""
    return F.regexp_replace(F.col(c).cast("string"), r"\.0$", "")


# --- target / thesis break / cap / data end -----------------------------------------------------------

def target_outcomes(signals: DataFrame, grid: DataFrame, cal: DataFrame, breaks: DataFrame | None = None,
                    targets: Sequence[float] = (0.20, 0.30, 0.50), cap: int = 2520, cost: float = SIDE_COST,
                    block: int = 64) -> DataFrame:
    """Entry at the next open; exit at the target, the open after a thesis break, the cap, or the data end.

    ``signals``: (ticker, signal_date, pos, ...). Long holds are searched in two steps: block maxima
    of the high say which block holds the first touch, and only that block is opened bar by bar, so a
    2520-day cap costs about 2520 / block + 2 * block rows per trade rather than 2520.
    """
    key = ["ticker", "signal_date"]
    entry = grid.select("ticker", (F.col("pos") - 1).alias("pos"), F.col("date").alias("entry_date"), F.col("open").alias("entry_price"))
    end_of = grid.groupBy("ticker").agg(F.max("pos").alias("_grid_end"))
    t = (signals.join(entry, ["ticker", "pos"]).filter(F.col("entry_price").isNotNull())
         .join(end_of, "ticker").withColumn("_from", F.col("pos") + 1)
         .withColumn("_to", F.least(F.col("pos") + cap, F.col("_grid_end"))))

    # Last traded day of the holding window: as-of the window's end on the ticker's traded days.
    traded = grid.filter(F.col("close").isNotNull()).select("ticker", F.col("pos").alias("_last_pos"), F.col("close").alias("_last_close"))
    t = _asof_pos(t, traded, "_to", "_last_pos", ["_last_close"])
    t = t.filter(F.col("_last_pos") >= F.col("_from"))

    if breaks is not None:
        b = breaks.select("ticker", F.col("break_date"))
        t = asof_join(t, b, ["ticker"], "entry_date", "break_date", [], tiebreak=["break_date"], forward=True)
        nxt = asof_join(t.select("break_date").filter(F.col("break_date").isNotNull()).distinct(),
                        cal.select(F.col("date").alias("_cal_date"), F.col("pos").alias("_brk")), [], "break_date", "_cal_date", ["_brk"],
                        strict=True, forward=True, probe_unique=True).select("break_date", "_brk")
        t = t.join(nxt, "break_date", "left").withColumn("_brk", F.when(F.col("_brk") <= F.col("_to"), F.col("_brk")))
    else:
        t = t.withColumn("_brk", F.lit(None).cast("int"))
    brk_open = grid.select("ticker", F.col("pos").alias("_brk"), F.col("open").alias("_brk_open"))
    t = t.join(brk_open, ["ticker", "_brk"], "left")
    t = t.withColumn("target", F.explode(F.array(*[F.lit(float(x)) for x in targets]))) \
         .withColumn("_level", F.col("entry_price") * (1 + F.col("target")))

    high = grid.select("ticker", F.col("pos").alias("_p"), "high")
    blocks = high.groupBy("ticker", F.floor(F.col("_p") / block).alias("_blk")).agg(F.max("high").alias("_bmax"))
    first, last = F.floor(F.col("_from") / block), F.floor(F.col("_last_pos") / block)
    ident = [*key, "target"]
    spans = t.select(*ident, "_level", "_from", "_last_pos", F.explode(F.sequence(first, last)).alias("_blk"))
    # The first block may hold the touch before the entry, so it is always opened; of the later ones
    # only the first whose maximum reaches the level.
    reach = (spans.join(blocks, ["ticker", "_blk"]).filter((F.col("_blk") > F.floor(F.col("_from") / block)) & (F.col("_bmax") >= F.col("_level")))
             .groupBy(*ident).agg(F.min("_blk").alias("_hit_blk")))
    opened = t.join(reach, ident, "left").select(
        *ident, "_level", "_from", "_last_pos",
        F.explode(F.array_distinct(F.array_compact(F.array(first, F.col("_hit_blk"))))).alias("_blk"))
    bars = (opened.withColumn("_p", F.explode(F.sequence(F.greatest(F.col("_blk") * block, F.col("_from")),
                                                         F.least((F.col("_blk") + 1) * block - 1, F.greatest(F.col("_blk") * block, F.col("_last_pos"))))))
            .filter((F.col("_p") >= F.col("_from")) & (F.col("_p") <= F.col("_last_pos"))))
    hits = (bars.withColumn("_p", F.col("_p").cast("int")).join(high, ["ticker", "_p"]).filter(F.col("high") >= F.col("_level"))
            .groupBy(*ident).agg(F.min("_p").alias("_hit")))
    t = t.join(hits, ident, "left")

    reason = (F.when(F.col("_hit").isNotNull() & (F.col("_brk").isNull() | (F.col("_hit") < F.col("_brk"))), "target")
              .when(F.col("_brk") <= F.col("_last_pos"), "thesis_break")
              .when(F.col("_last_pos") - F.col("_from") >= cap - 1, "cap").otherwise("data_end"))
    t = t.withColumn("reason", reason)
    exit_pos = F.when(F.col("reason") == "target", F.col("_hit")).when(F.col("reason") == "thesis_break", F.col("_brk")).otherwise(F.col("_last_pos"))
    price = (F.when(F.col("reason") == "target", F.col("_level")).when(F.col("reason") == "thesis_break", F.col("_brk_open"))
             .otherwise(F.col("_last_close")))
    t = (t.withColumn("event", (F.col("reason") == "target").cast("int")).withColumn("exit_pos", exit_pos.cast("int"))
         .withColumn("exit_price", price).withColumn("duration", F.col("exit_pos") - F.col("_from") + 1)
         .withColumn("entry_pos", F.col("_from")).withColumn("ret", net_return(F.col("entry_price"), F.col("exit_price"), cost)))
    t = t.join(cal.select(F.col("pos").alias("exit_pos"), F.col("date").alias("exit_date")), "exit_pos", "left")
    return t.select(*signals.columns, "target", "entry_date", "entry_pos", "entry_price", "event", "duration", "reason", "exit_date",
                    "exit_pos", "exit_price", "ret")


def _asof_pos(probe: DataFrame, build: DataFrame, at: str, build_pos: str, values: Sequence[str]) -> DataFrame:
    return asof_join(probe, build, ["ticker"], at, build_pos, values)


def censor_at(outcomes: DataFrame, cal: DataFrame, cutoff) -> DataFrame:
    """Outcomes as known at ``cutoff``: a later exit becomes an open position with the duration so far."""
    cut = F.to_date(F.lit(cutoff))
    last = cal.filter(F.col("date") <= cut).agg(F.max("pos").alias("_cut_pos"))
    late = F.col("exit_date") > cut
    out = outcomes.filter(F.col("entry_date") <= cut).transform(with_scalars, last)     
    return (out.withColumn("duration", F.when(late, F.greatest(F.col("_cut_pos") - F.col("entry_pos") + 1, F.lit(1))).otherwise(F.col("duration")))
            .withColumn("event", F.when(late, 0).otherwise(F.col("event")))
            .withColumn("reason", F.when(late, "open_at_cutoff").otherwise(F.col("reason"))).drop("_cut_pos"))


# --- trades ------------------------------------------------------------------------------------------

def add_excess(trades: DataFrame, bench_grid: DataFrame) -> DataFrame:
    """Benchmark return from the entry day's open to the exit day's close, and the excess over it."""
    b = bench_grid.select("pos", "date", "open", "close")
    out = (trades.join(b.select(F.col("pos").alias("entry_pos"), F.col("date").alias("entry_date"), F.col("open").alias("_bo")), "entry_pos", "left")
           .join(b.select(F.col("pos").alias("exit_pos"), F.col("date").alias("exit_date"), F.col("close").alias("_bc")), "exit_pos", "left")
           .withColumn("bench_ret", F.col("_bc") / F.col("_bo") - 1).withColumn("excess", F.col("ret") - F.col("bench_ret")))
    return out.drop("_bo", "_bc").filter(F.col("excess").isNotNull())


def barrier_outcome_table(grid: DataFrame, bench_grid: DataFrame, hold: int, stop_atr: float | None = None, levels: DataFrame | None = None,
                          cost: float = SIDE_COST, entries: DataFrame | None = None) -> DataFrame:
    """The trade every (ticker, pos), or those of ``entries``, would give under one exit rule.

    Real events and all random draws then need only an equi-join on (ticker, pos).
    """
    rows = grid.select("ticker", "date", "pos")
    if entries is not None:
        rows = rows.join(entries.select("ticker", "pos").distinct(), ["ticker", "pos"], "left_semi")
    if stop_atr is None:
        rows = rows.withColumn("stop", F.lit(NO_STOP))
    else:
        lv = levels.select("ticker", "date", F.col("close").alias("_lc"), F.col("atr_14d").alias("_la"))
        rows = rows.join(lv, ["ticker", "date"], "left").withColumn("stop", F.col("_lc") - stop_atr * F.col("_la")).drop("_lc", "_la")
    walked = walk_barriers(rows.withColumn("target", F.lit(FAR_TARGET)), grid, "stop", "target", hold, cost)
    keep = walked.filter((F.col("outcome") != "skipped") & F.col("ret").isNotNull())
    return add_excess(keep.select("ticker", "pos", "entry_pos", "exit_pos", "entry_price", "exit_price", "outcome", "ret"), bench_grid)


def build_trades(events: DataFrame, outcome_table: DataFrame) -> DataFrame:
    """Events (ticker, signal_date, pos, strength, ...) with the trade each one gives; skipped entries drop."""
    return events.join(outcome_table, ["ticker", "pos"])


def period_trades(trades: DataFrame, dev_start, dev_end, holdout_start, period: str) -> DataFrame:
    d = lambda v: F.to_date(F.lit(v))
    if period == "development":
        return trades.filter(F.col("signal_date").between(d(dev_start), d(dev_end)) & (F.col("exit_date") <= d(dev_end)))
    if period == "holdout":
        return trades.filter(F.col("signal_date") >= d(holdout_start))
    raise ValueError(period)


def period_events(events: DataFrame, dev_start, dev_end, holdout_start, period: str) -> DataFrame:
    d = lambda v: F.to_date(F.lit(v))
    if period == "development":
        return events.filter(F.col("signal_date").between(d(dev_start), d(dev_end)))
    if period == "holdout":
        return events.filter(F.col("signal_date") >= d(holdout_start))
    raise ValueError(period)


def open_or_delisted(trades: DataFrame, last_date: Column) -> DataFrame:
    """Split ``data_end`` trades into those still open on the last date and those whose prices stopped earlier."""
    return trades.withColumn("end_state", F.when(F.col("outcome") != "data_end", "closed")
                             .when(F.col("exit_date") >= last_date, "still_open").otherwise("prices_stopped"))
