"""Composed studies: panels, event study, value survival, model addendum, report tables.

Each study is a chain of the operators with a written stage wherever several later steps read the
same table. Random baselines and parameter grids are columns of one plan, never loops over data.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify as cl, score as sc
from ..operators import asof, facts as fx, features as ft, fundamentals as fu, holdings as hd, insider as ins, models as mo, outcomes as oc, portfolio as pf, resample as rs, stats as st, text as tx, xsection as xs
from ..operators.scalars import with_scalars
from ..session import cut_lineage


# --- panels -----------------------------------------------------------------------------------------------

def build_panel(membership: DataFrame, bars: DataFrame, benchmark: DataFrame, grid: DataFrame, bench_grid: DataFrame, statements: DataFrame | None, info: DataFrame | None,
                horizon_days: int = 91, label_days: int = 63, lag_days: int = 90) -> DataFrame:
    """One row per (date, member) with a fresh price: technicals, fundamentals, scores, labels.

    ``membership``: date, ticker, institution_count, institutional_direction_score (null tickers drop).
    """
    m = membership.filter(F.col("ticker").isNotNull()).select("date", "ticker", "institution_count", "institutional_direction_score")
    x = ft.pit_technicals(m, bars, benchmark)
    if statements is not None:
        now = bars.groupBy("ticker").agg(F.max_by("close", "date").alias("price_now"))
        x = fu.pit_fundamentals(x.withColumn("close", F.col("adj_close")).join(now, "ticker", "left"), statements, info, lag_days).drop("close", "price_now")
    x = cut_lineage(x)
    fund = [c for c in ("revenue_growth", "eps_growth", "net_margin", "roe", "fcf_margin", "fcf_growth", "fcf_yield") if c in x.columns]
    known = F.lit(False)
    for c in fund:
        known = known | F.col(c).isNotNull()
    labels = oc.forward_returns(asof.filled_closes(grid, 5), bench_grid, label_days).select("ticker", "date", "fwd_return", "fwd_excess")
    full = sc.with_weighted_view(x, horizon_days).withColumnRenamed("score", "score_full").drop("technical_weight", "fundamental_weight", "technical_contribution", "fundamental_contribution", "dominant_factors")
    tech = sc.with_weighted_view(x.select("date", "ticker", *[c for c in x.columns if c in _TECHNICAL]), horizon_days, fundamentals=False).select("date", "ticker", F.col("score").alias("score_technical"))
    inst = F.coalesce("institutional_direction_score", F.lit(0.0))
    out = full.join(tech, ["date", "ticker"]).join(labels, ["date", "ticker"], "left")
    rank = sc.rank_score(F.col("score_full"), inst, None)
    cap = F.log(F.when(F.col("market_cap") > 0, F.col("market_cap"))) if "market_cap" in x.columns else F.lit(None).cast("double")
    return out.withColumns({"has_fundamentals": known, "log_market_cap": cap, "low_volatility": -F.col("volatility_60d"), "institutional_direction_score": inst, "score_rank": rank,
                            "label": cl.score_label(rank)})


_TECHNICAL = {f for g, fs in sc.GROUP_FIELDS.items() if g.startswith("technical_") for f in fs}


def smallcap_panel(holdings: DataFrame, filings: DataFrame, dates: DataFrame, cusips: DataFrame, bars: DataFrame, tx: DataFrame, issuers: DataFrame, facts: DataFrame, cik_of: DataFrame, grid: DataFrame,
                   cal: DataFrame, band: tuple[float, float], label_days: int, bench_grid: DataFrame) -> DataFrame:
    """Members from full books inside a rough cap band, with price, insider, surprise and breadth features and returns."""
    books = hd.in_cap_band(hd.book_values(holdings, filings, dates), *band)
    m = hd.resolve(books, cusips).filter(F.col("ticker").isNotNull()).groupBy("date", "ticker").agg(F.sum("total_13f_value").alias("total_13f_value"), F.max("holders").alias("holders"))
    m = cut_lineage(hd.ownership_breadth_change(m).join(cal, "date"))
    k = m.select("date", "ticker")
    tech = ft.pit_technicals(k, bars)
    insiders = ins.insider_features(k, tx, issuers)
    sue = fx.add_sue(k.join(cik_of, "ticker"), fx.sue_series(facts), facts).select("date", "ticker", "sue", "days_since_filing")
    labels = oc.forward_returns(asof.filled_closes(grid, 5), bench_grid, label_days).select("ticker", "date", "fwd_excess")
    nxt = oc.next_open_returns(m.select("ticker", "date", "pos"), grid).select("ticker", "date", "next_return")
    return m.join(tech, ["date", "ticker"]).join(insiders, ["date", "ticker"], "left").join(sue, ["date", "ticker"], "left").join(labels, ["ticker", "date"], "left").join(nxt, ["ticker", "date"], "left")


def text_panel(panel: DataFrame, facts: DataFrame, cik_of: DataFrame, filing_features: DataFrame, industry: DataFrame, base: Sequence[str], bars: DataFrame, months: int = 3) -> DataFrame:
    """Panel plus surprise, text similarity, industry-relative values, month changes and the next month's return."""
    k = panel.select("date", "ticker")
    sue = fx.add_sue(k.join(cik_of, "ticker"), fx.sue_series(facts), facts).select("date", "ticker", "sue", "days_since_filing")
    text = tx.monthly_text_features(filing_features, k, cik_of).drop("filing_date")
    rel = xs.industry_relative(panel.join(industry, "ticker"), base, "industry")
    chg = asof.month_changes(panel.select("date", "ticker", *base), base, months).drop(*base)
    nxt = oc.next_month_returns(k, bars).select("date", "ticker", "next_return", "exit_date")
    out = panel
    for part in (sue, text, rel, chg, nxt):
        out = out.join(part, ["date", "ticker"], "left")
    return out


# --- event study ----------------------------------------------------------------------------------------------

def event_study(events: DataFrame, membership: DataFrame, outcome_table: DataFrame, grid: DataFrame, bench_grid: DataFrame, cal: DataFrame, hold: int, periods: tuple, seeds: int = 200,
                max_open: int = 20, cost: float = 0.0015) -> DataFrame:
    """One row per period: trade statistics, random percentile, portfolio against benchmark, five checks.

    ``periods``: (development start, development end, holdout start).
    """
    ev = asof.signal_positions(asof.eligible(events, membership), cal)
    trades = cut_lineage(oc.build_trades(ev, outcome_table))
    members = membership.select("date", "ticker")
    both = [oc.period_trades(trades, *periods, p).withColumn("period", F.lit(p)) for p in ("development", "holdout")]
    t = cut_lineage(both[0].unionByName(both[1]))
    draws = rs.random_events(t, members, seeds).join(t.select("signal_date", F.col("ticker").alias("_drawn_for"), "period"), ["signal_date", "_drawn_for"]).join(outcome_table, ["ticker", "pos"])
    # Each part of the verdict, a row per period or seed, is a job of its own: the driver never holds the plans and broadcasts of all at once.
    # The exit of a random development trade must lie in the development period too.
    late = (F.col("period") == "development") & (F.col("exit_date") > F.to_date(F.lit(periods[1])))
    random = cut_lineage(draws.filter(~late).groupBy("period", "seed").agg(F.avg("excess").alias("random_mean")))
    stats = t.groupBy("period").agg(F.count(F.lit(1)).alias("trades"), F.avg("ret").alias("mean_return"), F.avg("excess").alias("mean_excess"), F.avg((F.col("ret") > 0).cast("double")).alias("win_rate"))
    nw = st.trade_tstat(t, hold, ["period"]).select("period", F.col("n").alias("months"), F.col("t").alias("nw_t"))
    ci = rs.bootstrap_ratio(t.withColumn("month", F.trunc("entry_date", "month")), "month", "excess", by=["period"])
    pct = st.percentile_of(stats, random, ["period"], "mean_excess", "random_mean").withColumnRenamed("percentile", "random_pct")
    eq = cut_lineage(pf.calendar_time_portfolio(t.withColumn("scenario", F.col("period")), grid, cal, max_open, max_open, cost))
    port = st.portfolio_metrics(eq, ["scenario"]).select(F.col("scenario").alias("period"), "cagr", "sharpe", "max_drawdown")
    spans = eq.groupBy("scenario").agg(F.avg("exposure").alias("_x"), F.min("pos").alias("_a"), F.max("pos").alias("_z"))
    b = spans.select("*", F.explode(F.sequence("_a", "_z")).alias("pos")).join(bench_grid.select("pos", "date", "close"), "pos")
    w = Window.partitionBy("scenario").orderBy("pos")
    b = b.withColumn("_r", F.coalesce(F.col("close") / F.lag("close").over(w) - 1, F.lit(0.0))) \
         .withColumn("equity", F.product(1 + F.col("_x") * F.col("_r")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    bench = st.portfolio_metrics(b, ["scenario"]).select(F.col("scenario").alias("period"), F.col("cagr").alias("bench_cagr"))
    out = stats
    for part in (nw, ci, pct, port, bench):
        out = out.join(cut_lineage(part), "period", "left")
    return st.evaluate_period(out)


# --- value survival ---------------------------------------------------------------------------------------------

def survival_outcomes(candidates: DataFrame, grid: DataFrame, cal: DataFrame, breaks: DataFrame, targets: Sequence[float], cap: int, cost: float = 0.0015) -> DataFrame:
    """Outcomes of every candidate at every target, in one pass over the grid."""
    sig = candidates.withColumnRenamed("date", "signal_date").select("ticker", "signal_date", "pos")
    return oc.target_outcomes(sig, grid, cal, breaks, tuple(targets), cap=cap, cost=cost)


def value_survival(candidates: DataFrame, grid: DataFrame, cal: DataFrame, breaks: DataFrame, bench_grid: DataFrame, cutoff, target: float, cap: int, rank_features: Sequence[str], per_month: int = 3,
                   slots: int = 15, cost: float = 0.0015, outcomes: DataFrame | None = None, design: DataFrame | None = None, held: DataFrame | None = None) -> dict[str, DataFrame]:
    """Outcomes, censored training, Kaplan-Meier and Weibull fits, forecasts, scores and the monthly portfolio.

    ``candidates``: date, ticker, pos, sector, drawdown, valuation_pct, price_only and the rank features. Studies at several
    targets share what does not depend on the target: ``outcomes`` of all targets, the ``design`` and the ``held`` closes.
    """
    if outcomes is None:
        outcomes = cut_lineage(survival_outcomes(candidates, grid, cal, breaks, (target,), cap, cost))
    out = outcomes.filter(F.col("target") == F.lit(float(target)))
    x, cols = mo.survival_design(candidates, rank_features)
    x = x if design is None else design
    held = cut_lineage(pf.held_closes(grid)) if held is None else held
    x = cut_lineage(x.withColumnRenamed("date", "signal_date").join(out, ["ticker", "signal_date"]).withColumnRenamed("signal_date", "date"))
    train = cut_lineage(oc.censor_at(x.filter(F.col("date") < F.lit(cutoff).cast("date")), cal, cutoff))
    test = x.filter(F.col("date") >= F.lit(cutoff).cast("date"))
    model, used = mo.fit_aft(train, cols)
    failed = train.filter(F.col("reason").isin("thesis_break", "cap")).agg(F.avg("ret").alias("m")).first()["m"] or 0.0
    forecast = cut_lineage(mo.expected_annualized_return(mo.aft_curve_params(model, test, used), target, float(failed), cap=cap, step=max(1, cap // 40)))
    km = st.kaplan_meier(train)
    grid_points = list(range(max(1, cap // 10), cap, max(1, cap // 10)))
    curve = F.transform(F.array(*[F.lit(float(g)) for g in grid_points]), lambda g: F.exp(-F.pow(g / F.col("scale"), F.col("shape"))))
    brier = st.model_brier(forecast.select("duration", "event", curve.alias("_curve")), train, "_curve", grid_points).withColumnRenamed("integrated_brier", "model_brier")
    scores = st.concordance(forecast, "duration", "event", "scale").transform(with_scalars, st.integrated_brier(test, train, km, grid_points)).transform(with_scalars, brier)
    from ..operators.ranking import top_per_date

    picks = top_per_date(forecast, [F.col("expected_annualized_return").desc(), F.col("ticker")], per_month)
    trades = picks.select(F.lit("survival").alias("scenario"), "ticker", "entry_pos", "exit_pos", "entry_price", "exit_price", F.col("expected_annualized_return").alias("strength"))
    eq = cut_lineage(pf.calendar_time_portfolio(trades, held, cal, per_month, slots, cost))
    rand = rs.random_picks(forecast, per_month, 50).join(forecast.select("date", "ticker", "entry_pos", "exit_pos", "entry_price", "exit_price"), ["date", "ticker"]) \
             .select(F.col("seed").cast("string").alias("scenario"), "ticker", "entry_pos", "exit_pos", "entry_price", "exit_price", F.lit(0.0).alias("strength"))
    random = st.portfolio_metrics(pf.calendar_time_portfolio(rand, held, cal, per_month, slots, cost), ["scenario"]).select(F.col("cagr").alias("annualized"))
    return {"outcomes": out, "forecast": forecast, "km": km, "scores": scores, "equity": eq, "random": random,
            "verdict": st.portfolio_verdict(eq, bench_grid, random)}


# --- reports --------------------------------------------------------------------------------------------------------

def backtest_report(panel: DataFrame, signals: Sequence[str], score: str, label_days: int, every: int, label: str = "fwd_excess") -> dict[str, DataFrame]:
    """The tables of the ranking report: signals, buckets, quintiles, yearly IC, universe drift."""
    per_date = cut_lineage(st.per_date_metrics(panel, signals, label))
    lags = st.overlap_lags(label_days, every)
    return {"signals": st.summarize(per_date, lags), "buckets": st.label_buckets(panel, score, label), "quintiles": st.score_quintiles(panel, score, label),
            "by_year": st.ic_by_year(per_date), "drift": st.universe_drift(panel, label)}


def report_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """The tables as one long frame (section, row as JSON), for export."""
    out = None
    for name, df in tables.items():
        rows = df.select(F.lit(name).alias("section"), F.to_json(F.struct(*sorted(df.columns))).alias("row"))
        out = rows if out is None else out.unionByName(rows)
    return out


def is_it_luck(trades: DataFrame, random_returns: DataFrame, robust_share: float, ci_reps: int = 500, percentile_bar: float = 95.0, share_bar: float = 2 / 3) -> DataFrame:
    """Per exit rule: expectancy, its interval by week, the random percentile and the verdict.

    ``trades``: exit, signal_date, r_multiple, ret; ``random_returns``: exit, seed, mean_ret.
    """
    ci = rs.bootstrap_ratio(trades, "signal_date", "r_multiple", ci_reps, by=["exit"])
    base = trades.groupBy("exit").agg(F.count(F.lit(1)).alias("trades"), F.avg("r_multiple").alias("expectancy_r"), F.avg("ret").alias("mean_ret"))
    pct = st.percentile_of(base, random_returns.withColumnRenamed("mean_ret", "_random"), ["exit"], "mean_ret", "_random")
    x = base.join(ci, "exit").join(pct, "exit", "left")
    ok = (F.col("ci_low") > 0) & (F.col("percentile") >= percentile_bar) & F.lit(robust_share >= share_bar)
    return x.withColumn("verdict", F.when(F.coalesce(ok, F.lit(False)), "TRADEABLE").otherwise("NOT PROVEN"))


def exit_comparison(candidates: DataFrame, picks: DataFrame, grid: DataFrame, hold: int = 20, seeds: int = 20, k: int = 5, atr: str = "atr_14d") -> DataFrame:
    """Two trailing stops and one fixed geometry for the same picks, against random picks with the same exits."""
    base = cut_lineage(candidates)
    keep = ["date", "ticker", "outcome", "ret", "r_multiple"]
    tables = [oc.walk_trailing_stop(base, grid, atr, m, hold).select(*keep, F.lit(f"trail {m:g} ATR").alias("exit")) for m in (2.0, 3.0)]
    fixed = base.withColumns({"stop": F.col("close") - 1.5 * F.col(atr), "target": F.col("close") + 3.0 * F.col(atr)})
    tables.append(oc.walk_barriers(fixed, grid, "stop", "target", hold).select(*keep, F.lit("1.5 ATR stop, 2R target").alias("exit")))
    every = tables[0].unionByName(tables[1]).unionByName(tables[2]).filter((F.col("outcome") != "skipped") & F.col("ret").isNotNull())
    every = cut_lineage(every)
    own = cut_lineage(every.join(picks.select("date", "ticker"), ["date", "ticker"]).withColumnRenamed("date", "signal_date"))
    rand = rs.random_picks(candidates, k, seeds).join(every, ["date", "ticker"]).groupBy("exit", "seed").agg(F.avg("ret").alias("mean_ret"))
    share = own.groupBy("exit").agg(F.avg("r_multiple").alias("e")).agg(F.avg((F.col("e") > 0).cast("double")).alias("s")).first()["s"] or 0.0
    return is_it_luck(own, rand, float(share))


def addendum(scores: DataFrame, variants: Sequence[str], label: str = "fwd_return", cost: float = 0.0015) -> DataFrame:
    """Holdout statistics and Holm verdict of every variant, with the top decile's annual return.

    The variant is a key of the long table throughout, so the plan is the same for any number of them.
    """
    per_date = cut_lineage(st.per_date_metrics(scores, variants, label))
    tests = st.newey_west(per_date, ["signal"], "date", "rank_ic", 1).select(F.col("signal").alias("variant"), F.col("n").alias("months"), F.col("mean").alias("mean_rank_ic"), F.col("t").alias("ic_t"))
    long = scores.select("date", "ticker", label, *[F.col(v).cast("double").alias(v) for v in variants]).unpivot(["date", "ticker", label], list(variants), "variant", "_score")
    spread = pf.decile_spread(long, "_score", label, 0.10, cost, ["variant"]).groupBy("variant").agg(F.avg("spread_net").alias("spread_mean"))
    net = pf.monthly_portfolio(long, "_score", label, 0.10, 1.0, cost, ["variant"]).select("variant", "date", F.col("net").alias("ret"))
    top = st.monthly_perf(net, ["variant"]).select("variant", F.col("annualized").alias("top_decile_annualized"))
    return st.variant_verdicts(tests.join(spread, "variant").join(top, "variant", "left"))


def evaluate_and_register(registry, scores: DataFrame, score: str, family: str, description: str, params: dict, label: str = "fwd_return") -> str:
    """IC statistics and top-decile returns of a development score, appended to the registry."""
    per_date = st.per_date_metrics(scores, [score], label)
    ic = st.newey_west(per_date, [], "date", "rank_ic", 0).first()
    net = pf.monthly_portfolio(scores, score, label, 0.10, 1.0, 0.0015).select("date", F.col("net").alias("ret"))
    return registry.register(family, description, params, net, ic["mean"], ic["t"])


def holdout_runner(scores: DataFrame, variants: Sequence[str], start, label: str = "fwd_return") -> Callable[[], dict]:
    """A runner over rows from the holdout start on, for ``Registry.one_look``."""
    def run() -> dict:
        rows = addendum(scores.filter(F.col("date") >= F.lit(start).cast("date")), variants, label).select("variant", "mean_rank_ic", "passed").collect()
        return {"summary": {r["variant"]: bool(r["passed"]) for r in rows}}
    return run


def rebuild_check(saved: DataFrame, rebuilt: DataFrame, key: Sequence[str], value: str, tolerance: float = 1e-9) -> DataFrame:
    """Keys whose rebuilt value is missing on one side or differs by more than the tolerance; must be empty."""
    a = saved.select(*key, F.col(value).alias("saved"))
    b = rebuilt.select(*key, F.col(value).alias("rebuilt"))
    gap = F.abs(F.col("saved") - F.col("rebuilt"))
    return a.join(b, list(key), "full").filter(F.col("saved").isNull() | F.col("rebuilt").isNull() | (gap > tolerance))
