import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitspark.operators import features as ft, outcomes as oc

D0 = dt.date(2024, 1, 1)


def day(n):
    return D0 + dt.timedelta(days=int(n))


@pytest.fixture(scope="module")
def walk(spark):
    rng = np.random.default_rng(1)
    out = []
    for t in ("A", "B"):
        c = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 300)))
        for i, x in enumerate(c):
            out.append((t, day(i), float(c[i - 1]) if i else 100.0, float(max(x, c[i - 1] if i else 100) * 1.01), float(min(x, c[i - 1] if i else 100) * 0.99), float(x), float(1000 + i % 17)))
    pdf = pd.DataFrame(out, columns=["ticker", "date", "open", "high", "low", "close", "volume"])
    return pdf, spark.createDataFrame(pdf)


def test_features_match_hand_computation(walk):
    pdf, df = walk
    a = pdf[pdf.ticker == "A"].reset_index(drop=True)
    got = ft.feature_bundle(df).filter("ticker = 'A'").orderBy("date").toPandas()
    c = a["close"]
    assert np.allclose(got["return_20d"], c / c.shift(20) - 1, equal_nan=True)
    assert np.allclose(got["volatility_1m"], c.pct_change().rolling(21).std() * np.sqrt(252), equal_nan=True)
    assert np.allclose(got["moving_average_50d"], c.rolling(50).mean(), equal_nan=True)
    d = c.diff()
    rs = d.clip(lower=0).rolling(14).mean() / (-d.clip(upper=0)).rolling(14).mean()
    assert np.allclose(got["rsi_14d"], 100 - 100 / (1 + rs), equal_nan=True)
    tr = pd.concat([a.high - a.low, (a.high - c.shift()).abs(), (a.low - c.shift()).abs()], axis=1).max(axis=1)
    atr = tr.rolling(14).mean()
    atr[:14] = np.nan
    assert np.allclose(got["atr_14d"], atr, equal_nan=True)
    assert np.allclose(got["volume_ratio"], a.volume / a.volume.shift().rolling(21).mean(), equal_nan=True)


def test_cutting_the_future_changes_no_past_feature(walk):
    _, df = walk
    cut = day(200)
    cols = ["ticker", "date", "return_60d", "rsi_14d", "atr_14d", "support_60d", "price_vs_ma200"]
    full = ft.feature_bundle(df).filter(F.col("date") <= cut).select(*cols)
    part = ft.feature_bundle(df.filter(F.col("date") <= cut)).select(*cols)
    assert full.exceptAll(part).count() == 0 and part.exceptAll(full).count() == 0


def test_pit_technicals_drop_stale_keys(walk, spark):
    _, df = walk
    keys = spark.createDataFrame([("A", day(299 + 7)), ("B", day(299 + 8))], "ticker string, date date")
    assert [r["ticker"] for r in ft.pit_technicals(keys, df).collect()] == ["A"]


def path_case(spark, bars, stop, target, hold=4):
    rows = [("A", i, *b) for i, b in enumerate([(100.0, 100.0, 100.0, 100.0), *bars])]
    grid = spark.createDataFrame(rows, "ticker string, pos int, open double, high double, low double, close double")
    df = grid.filter("pos = 0").withColumns({"stop": F.lit(stop), "target": F.lit(target)})
    r = oc.walk_barriers(df, grid, "stop", "target", hold, cost=0.0).first()
    return r["outcome"], r["exit_pos"], r["exit_price"]


N = (None, None, None, None)
CASES = [
    ("target on the second bar", [(100, 105, 99, 104), (104, 111, 103, 109)], ("target", 2, 110.0)),
    ("stop wins inside one bar", [(100, 111, 89, 100)], ("stop", 1, 90.0)),
    ("entry bar can be stopped but not gapped", [(100, 101, 90, 95)], ("stop", 1, 90.0)),
    ("gap through the stop fills at the open", [(100, 101, 99, 100), (85, 86, 80, 84)], ("stop", 2, 85.0)),
    ("missing close ends the trade", [(100, 101, 99, 100.5), N, (120, 130, 119, 125)], ("data_end", 1, 100.5)),
    ("time exit", [(100, 101, 99, 100), (100, 101, 99, 101), (101, 102, 100, 102), (102, 103, 101, 103)], ("time", 4, 103.0)),
    ("calendar ends first", [(100, 101, 99, 100)], ("data_end", 1, 100.0)),
    ("entry above target is skipped", [(111, 112, 110, 111)], ("skipped", None, None)),
    ("no entry price is skipped", [N], ("skipped", None, None)),
]


@pytest.mark.parametrize("name,bars,want", CASES, ids=[c[0] for c in CASES])
def test_first_touch_cases(spark, name, bars, want):
    bars = [tuple(None if x is None else float(x) for x in b) for b in bars]
    assert path_case(spark, bars, 90.0, 110.0) == want


def test_trailing_stop_uses_completed_bars_only(spark):
    rows = [("A", 0, 100.0, 100.0, 100.0, 100.0, 5.0), ("A", 1, 100.0, 120.0, 99.0, 118.0, 5.0), ("A", 2, 118.0, 119.0, 109.0, 110.0, 5.0), ("A", 3, 108.0, 109.0, 100.0, 101.0, 5.0)]
    grid = spark.createDataFrame(rows, "ticker string, pos int, open double, high double, low double, close double, atr double")
    r = oc.walk_trailing_stop(grid.filter("pos = 0"), grid, "atr", 2.0, 3, cost=0.0).first()
    # The high of bar 1 lifts the stop to 110 for bar 2, whose low of 109 touches it.
    assert (r["outcome"], r["exit_pos"], r["exit_price"]) == ("stop", 2, 110.0)


def brute(highs, opens, closes, entry_i, target, brk, cap):
    entry = opens[entry_i]
    last = min(entry_i + cap - 1, len(closes) - 1)
    ok = [i for i in range(entry_i, last + 1) if closes[i] is not None]
    if entry is None or not ok:
        return None
    end = ok[-1]
    hit = next((i for i in range(entry_i, end + 1) if highs[i] is not None and highs[i] >= entry * (1 + target)), None)
    b = None if brk is None or brk > last else brk
    if hit is not None and (b is None or hit < b):
        return "target", hit
    if b is not None and b <= end:
        return "thesis_break", b
    return ("cap", end) if end - entry_i >= cap - 1 else ("data_end", end)


@pytest.mark.parametrize("block", [4, 16, 64])
def test_target_outcomes_equal_brute_force(spark, block):
    rng = np.random.default_rng(7)
    n, cap = 120, 30
    c = 100 * np.exp(np.cumsum(rng.normal(0, 0.03, n)))
    gone = set(rng.choice(n, 12, replace=False)) - {0}
    rows, o, h, cl = [], [], [], []
    for i in range(n):
        miss = i in gone or i > 110
        o.append(None if miss else float(c[i] * 0.995))
        h.append(None if miss else float(c[i] * 1.02))
        cl.append(None if miss else float(c[i]))
        rows.append(("A", day(i), i, o[i], h[i], None if miss else float(c[i] * 0.98), cl[i]))
    grid = spark.createDataFrame(rows, "ticker string, date date, pos int, open double, high double, low double, close double")
    cal = grid.select("date", "pos")
    sig = [("A", day(i), i) for i in range(0, 112, 3)]
    breaks = spark.createDataFrame([("A", day(40)), ("A", day(90))], "ticker string, break_date date")
    out = oc.target_outcomes(spark.createDataFrame(sig, "ticker string, signal_date date, pos int"), grid, cal, breaks, (0.05, 0.2), cap=cap, block=block)
    got = {(r["pos"], r["target"]): (r["reason"], r["exit_pos"]) for r in out.collect()}
    want = {}
    for _, _, p in sig:
        brk = next((b + 1 for b in (40, 90) if b >= p + 1), None)
        for t in (0.05, 0.2):
            w = brute(h, o, cl, p + 1, t, brk, cap) if p + 1 < n else None
            if w is not None:
                want[(p, t)] = w
    assert got == want


def test_forward_return_needs_both_ends(spark):
    g = spark.createDataFrame([("A", day(i), i, 100.0 + i) for i in range(6)], "ticker string, date date, pos int, close_filled double")
    b = spark.createDataFrame([(day(i), i, 50.0) for i in range(6)], "date date, pos int, close double")
    got = [r["fwd_return"] for r in oc.forward_returns(g, b, 3).orderBy("pos").collect()]
    assert got[0] == pytest.approx(104 / 101 - 1) and got[1] == pytest.approx(105 / 102 - 1) and got[2:] == [None] * 4


def test_quality_flags(spark):
    rows = [("A", day(i), 10.0, 9.0, 9.5, 100.0) for i in range(25)]
    rows += [("A", day(3), 10.0, 9.0, 9.5, 100.0), ("A", day(30), 9.0, 10.0, 9.5, 0.0), ("A", day(31), 30.0, 9.0, 20.0, 1000.0)]
    b = spark.createDataFrame(rows, "ticker string, date date, high double, low double, close double, volume double")
    flags = {(r["date"], r["flag"]) for r in ft.ohlcv_flags(b).collect()}
    assert (day(3), "INVALID_DATA:dates:duplicate_date") in flags
    assert (day(30), "INVALID_DATA:ohlc:high_less_than_low") in flags and (day(30), "SUSPICIOUS_DATA:volume:zero_volume") in flags
    assert (day(31), "VALID_EXTREME_MARKET_MOVE:returns") in flags


def test_a_close_of_zero_does_not_stop_the_quality_flags(spark):
    rows = [("A", day(i), 10.0, 0.0, 0.0 if i in (22, 23) else 9.5, 100.0) for i in range(26)]
    b = spark.createDataFrame(rows, "ticker string, date date, high double, low double, close double, volume double")
    assert {(r["date"], r["flag"]) for r in ft.ohlcv_flags(b).collect()} == {(day(i), "SUSPICIOUS_DATA:returns") for i in (22, 23, 24)}


# --- first touch against a walk bar by bar ---------------------------------------------------------------

def random_grid(seed, tickers=4, n=90):
    rng = np.random.default_rng(seed)
    rows = []
    for t in range(tickers):
        c = 100.0
        for i in range(n - int(rng.integers(0, 25))):
            o = round(c * float(np.exp(rng.normal(0, 0.01))), 2)
            c = round(o * float(np.exp(rng.normal(0, 0.03))), 2)
            h, low = round(max(o, c) * (1 + abs(float(rng.normal(0, 0.01)))), 2), round(min(o, c) * (1 - abs(float(rng.normal(0, 0.01)))), 2)
            gone = rng.random()
            bar = (None,) * 4 if gone < 0.04 else (o, h, low, None) if gone < 0.05 else (o, h, low, c)
            rows.append((f"T{t}", i, *bar, round(0.5 + 3 * float(rng.random()), 2)))
    return rows


def bar_by_bar(bars, stop, target, hold, hair=0.0):
    """Outcome, bars to the exit and exit price; ``stop(i)`` is the stop on bar i."""
    if not bars or bars[0][0] is None or not (stop(0) > 0 and stop(0) < bars[0][0] < target):
        return "skipped", None, None
    for i, (o, h, low, c) in enumerate(bars[:hold]):
        if c is None:
            return "data_end", max(i - 1, 0), bars[i - 1][3] if i else None
        if i and o <= stop(i) + hair or low <= stop(i) + hair:
            return "stop", i, o if i and o <= stop(i) else stop(i)
        if i and o >= target or h >= target:
            return "target", i, target
    if len(bars) < hold:
        return "data_end", len(bars) - 1, bars[-1][3]
    return "time", hold - 1, bars[hold - 1][3]


@pytest.mark.parametrize("hold", [1, 3, 4, 5, 16, 17, 70])
def test_first_touch_equals_a_walk(spark, hold):
    rows = random_grid(hold)
    grid = spark.createDataFrame(rows, "ticker string, pos int, open double, high double, low double, close double, atr double")
    entries = grid.filter("close IS NOT NULL").withColumns({"stop": F.round(F.col("close") - 2 * F.col("atr"), 2), "target": F.round(F.col("close") + 3 * F.col("atr"), 2)})
    fixed = {(r["ticker"], r["pos"]): r for r in oc.walk_barriers(entries, grid, "stop", "target", hold).collect()}
    trailing = {(r["ticker"], r["pos"]): r for r in oc.walk_trailing_stop(entries.drop("stop", "target"), grid, "atr", 2.0, hold).collect()}
    bars = {}
    for t, i, o, h, low, c, atr in rows:
        bars.setdefault(t, []).append((o, h, low, c, atr))
    n = 0
    for t, all_ in bars.items():
        for i, (_, _, _, c, atr) in enumerate(all_):
            if c is None:
                continue
            n += 1
            after = [b[:4] for b in all_[i + 1: i + 1 + hold]]
            stop, target = round(c - 2 * atr, 2), round(c + 3 * atr, 2)
            r = fixed[t, i]
            got = r["outcome"], r["days_held"] and r["days_held"] - 1, r["exit_price"]
            assert got == pytest.approx(bar_by_bar(after, lambda _: stop, target, hold)), (t, i)
            top = lambda k: max([c - 2 * atr, *(b[1] - 2 * atr for b in after[:k] if b[1] is not None)])
            r, want = trailing[t, i], bar_by_bar(after, top, float("inf"), hold, oc.HAIR)
            want = (*want[:2], after[0][0] if want[0] == "data_end" and after[0][3] is None else want[2])
            assert (r["outcome"], r["days_held"] and r["days_held"] - 1) == want[:2] and r["exit_price"] == pytest.approx(want[2], abs=1e-6), (t, i)
    assert n == len(fixed) == len(trailing)


def test_grid_of_geometries_equals_single_walks(spark):
    grid = spark.createDataFrame(random_grid(2, 2, 60), "ticker string, pos int, open double, high double, low double, close double, atr_14d double")
    cand = grid.filter("close IS NOT NULL")
    cells = oc.grid_outcomes(cand, grid, (1.0, 2.0), (1.0,), (2, 9)).select("geometry", "ticker", "pos", "outcome", "exit_price")
    for s, h in ((1.0, 2), (1.0, 9), (2.0, 9)):
        one = oc.walk_barriers(oc.grid_levels(cand, F.lit(s), F.lit(1.0)), grid, "stop", "target", h).select("ticker", "pos", "outcome", "exit_price")
        mine = cells.filter(F.col("geometry") == f"atr{s:g}_r1_hold{h}").drop("geometry")
        assert mine.exceptAll(one).count() == one.exceptAll(mine).count() == 0


def test_no_array_crosses_the_network(spark):
    grid = spark.createDataFrame(random_grid(1, 1, 30), "ticker string, pos int, open double, high double, low double, close double, atr_14d double")
    lv = oc.grid_levels(grid, F.lit(2.0), F.lit(2.0))
    for df in (oc.walk_barriers(lv, grid, "stop", "target", 20), oc.walk_trailing_stop(grid, grid, "atr_14d", 2.0, 20), oc.grid_outcomes(grid, grid)):
        exchanges = _exchanges(df._jdf.queryExecution().executedPlan().initialPlan())
        assert exchanges and all("array" not in kinds for kinds in exchanges)


def _exchanges(node):
    """The column types of every exchange of a plan."""
    out = [[node.output().apply(i).dataType().typeName() for i in range(node.output().length())]] if node.nodeName() == "Exchange" else []
    for i in range(node.children().length()):
        out += _exchanges(node.children().apply(i))
    return out
