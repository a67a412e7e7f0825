"""Registered queries: the composed studies on the benchmark views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asof, facts as fx, insider as ins, models as mo, portfolio as pf, protocol as pr, ranking as rk
from ..session import cut_lineage
from ..sources import bench as bv
from . import studies as sd
from .catalog import ORACLES, query, tidy
from .oracle_views import VIEWS
from .q_filings import _screen
from .q_models import VARIANTS, variant_scores
from .q_prices import _TECH_SQL, W, _candidates
from .q_stats import SIGNALS, _port_sql, nw_sql, outcome_table

PERIODS = ("1996-01-01", "1999-12-31", "2000-01-01")


def _pit_members(spark, sf, every=4):
    """Point-in-time members on every fourth week."""
    from ..operators import holdings as hd

    dates = asof.rebalance_dates(bv.calendar(spark, sf), every, bv.WARMUP).select("date")
    return hd.pit_universe(bv.universe_history(spark, sf), dates)


@bv.staged
def study_panel(spark, sf):
    b = bv.bars(spark, sf)
    return sd.build_panel(_pit_members(spark, sf), b, bv.benchmark_bars(b), bv.grid(spark, sf), bv.bench_grid(spark, sf), bv.statements(spark, sf), bv.company_info(spark, sf), label_days=8)


VIEWS["members4"] = """
WITH d AS (SELECT date FROM cal WHERE pos >= 60 AND (pos - 60) % 4 = 0), l AS (SELECT d.date, f.cik, f.accession FROM d JOIN filings f ON f.filing_date <= d.date AND f.filing_date >= d.date - 200
  QUALIFY row_number() OVER (PARTITION BY d.date, f.cik ORDER BY f.filing_date DESC) = 1)
SELECT l.date, h.ticker, count(DISTINCT h.cik) AS institution_count, round(coalesce(avg(CASE view_direction WHEN 'POSITIVE' THEN 1.0::DOUBLE WHEN 'NEGATIVE' THEN -1.0::DOUBLE ELSE 0.0 END), 0), 4) AS inst
FROM uhist h JOIN l ON l.cik = h.cik AND l.accession = h.accession WHERE h.ticker IS NOT NULL GROUP BY 1, 2"""


@query("a1_build_panel", f"""
WITH t AS (SELECT ticker, date AS bar_date, close, {_TECH_SQL} FROM bars_i {W}),
x AS (SELECT m.*, t.* EXCLUDE (ticker) FROM members4 m ASOF JOIN t ON m.ticker = t.ticker AND m.date >= t.bar_date WHERE m.date - t.bar_date <= 7),
s AS (SELECT ticker, period_end + 90 AS known_on, last_value(net_margin IGNORE NULLS) OVER w AS net_margin, last_value(fcf_margin IGNORE NULLS) OVER w AS fcf_margin FROM fund_m
  WINDOW w AS (PARTITION BY ticker ORDER BY period_end ROWS UNBOUNDED PRECEDING))
SELECT x.date, x.ticker, x.institution_count, inst + 0.0 AS institutional_direction_score, round(return_20d, 6) + 0.0 AS return_20d, round(return_60d, 6) + 0.0 AS return_60d, round(volatility_60d, 6) + 0.0 AS volatility_60d,
  round(s.net_margin, 6) + 0.0 AS net_margin, round(s.fcf_margin, 6) + 0.0 AS fcf_margin, round(f.fwd_excess, 6) + 0.0 AS fwd_excess
FROM x ASOF LEFT JOIN s ON x.ticker = s.ticker AND x.date >= s.known_on LEFT JOIN fwd8 f ON f.ticker = x.ticker AND f.date = x.date""")
def a1(spark, sf):
    return tidy(study_panel(spark, sf), "date", "ticker", "institution_count", "institutional_direction_score", "return_20d", "return_60d", "volatility_60d", "net_margin", "fcf_margin", "fwd_excess")


@query("a1_panel_scores")
def a1b(spark, sf):
    return tidy(study_panel(spark, sf), "date", "ticker", "score_full", "score_technical", "score_rank", "label", "has_fundamentals", "log_market_cap", "low_volatility")


@query("a2_smallcap_panel")
def a2(spark, sf):
    h = bv.holdings(spark, sf)
    cik = bv.table(spark, sf, "supplier").select(bv.ticker_of("s_suppkey").alias("ticker"), F.col("s_suppkey").alias("cik"))
    x = sd.smallcap_panel(h, bv.filings(h), bv.month_end_dates(spark, sf), bv.cusip_map(spark, sf), bv.bars(spark, sf), bv.transactions(spark, sf), bv.issuer_map(spark, sf), bv.company_facts(spark, sf), cik,
                          bv.grid(spark, sf), bv.calendar(spark, sf), (1e9, 1e12), 8, bv.bench_grid(spark, sf))
    return tidy(x, "date", "ticker", "holders", "breadth_change", "return_20d", "insider_buyers_90d", "sue", "days_since_filing", "fwd_excess", "next_return")


@query("a3_text_panel")
def a3(spark, sf):
    from .q_text import filing_feature_table

    p = bv.panel(spark, sf).select("date", "ticker", "momentum", "volume_ratio")
    # One row per calendar month: the last rebalance date of the month.
    p = asof.latest_per_key(p.withColumn("_m", F.trunc("date", "month")), ["ticker", "_m"], ["date"]).drop("_m")
    s = bv.table(spark, sf, "supplier")
    cik = s.select(bv.ticker_of("s_suppkey").alias("ticker"), F.col("s_suppkey").alias("cik"))
    industry = s.select(bv.ticker_of("s_suppkey").alias("ticker"), (F.col("s_nationkey") % 5).alias("industry"))
    text = filing_feature_table(spark, sf).withColumn("filing_date", F.date_sub("filing_date", 4500))
    return tidy(sd.text_panel(p, bv.company_facts(spark, sf), cik, text, industry, ["momentum", "volume_ratio"], bv.bars(spark, sf)),
                "date", "ticker", "momentum", "sue", "days_since_filing", "sim_tfidf_rf", "momentum_ind", "momentum_chg3m", "next_return")


@bv.staged
def weekly_panel(spark, sf):
    """The panel on every second week, scored at the two-week horizon."""
    b = bv.bars(spark, sf)
    return sd.build_panel(_pit_members(spark, sf, 2), b, bv.benchmark_bars(b), bv.grid(spark, sf), bv.bench_grid(spark, sf), None, None, horizon_days=14, label_days=2)


@query("a4_weekly_panel")
def a4(spark, sf):
    return tidy(weekly_panel(spark, sf), "date", "ticker", "return_20d", "score_full", "score_rank", "fwd_excess")


VIEWS["members2"] = VIEWS["members4"].replace("(pos - 60) % 4 = 0", "(pos - 60) % 2 = 0")
VIEWS["fwd2"] = VIEWS["fwd8"].replace("lead(close_filled, 9)", "lead(close_filled, 3)").replace("lead(close, 9)", "lead(close, 3)")


@query("a4_weekly_inputs", f"""
WITH t AS (SELECT ticker, date AS bar_date, close, {_TECH_SQL} FROM bars_i {W}),
x AS (SELECT m.*, t.* EXCLUDE (ticker) FROM members2 m ASOF JOIN t ON m.ticker = t.ticker AND m.date >= t.bar_date WHERE m.date - t.bar_date <= 7)
SELECT x.date, x.ticker, x.institution_count, inst + 0.0 AS institutional_direction_score, round(return_20d, 6) + 0.0 AS return_20d, round(return_60d, 6) + 0.0 AS return_60d, round(volatility_60d, 6) + 0.0 AS volatility_60d,
  round(-volatility_60d, 6) + 0.0 AS low_volatility, round(f.fwd_return, 6) + 0.0 AS fwd_return, round(f.fwd_excess, 6) + 0.0 AS fwd_excess FROM x LEFT JOIN fwd2 f ON f.ticker = x.ticker AND f.date = x.date""")
def a4b(spark, sf):
    """What the weekly scores are made of: members, technicals, labels."""
    return tidy(weekly_panel(spark, sf), "date", "ticker", "institution_count", "institutional_direction_score", "return_20d", "return_60d", "volatility_60d", "low_volatility", "fwd_return", "fwd_excess")


@query("a5_report_tables")
def a5(spark, sf):
    p = bv.panel(spark, sf)
    return sd.report_rows(sd.backtest_report(p, SIGNALS, "score", bv.LABEL, bv.EVERY))


#: Of each table of the report, the query with its SQL and the columns that name a row.
_REPORT = {"signals": ("v3_evaluate_signals", ["signal"]), "buckets": ("v4_label_buckets", ["bucket"]), "quintiles": ("v9_score_quintiles", ["quintile"]),
           "by_year": ("v5_ic_by_year", ["signal", "year"]), "drift": ("v10_universe_drift", ["year"])}


@query("a5_report_measures", " UNION ALL ".join(
    f"SELECT '{section}' AS section, concat_ws(' ', {', '.join(key)}) AS key, measure, round(value, 4) + 0.0 AS value "
    f"FROM (UNPIVOT (SELECT {', '.join(key)}, CAST(COLUMNS(* EXCLUDE ({', '.join(key)})) AS DOUBLE) FROM ({ORACLES[name]})) ON COLUMNS(* EXCLUDE ({', '.join(key)})) INTO NAME measure VALUE value)" for section, (name, key) in _REPORT.items()))
def a5c(spark, sf):
    """All five tables of the report, a row per measure."""
    tables = sd.backtest_report(bv.panel(spark, sf), SIGNALS, "score", bv.LABEL, bv.EVERY)
    out = None
    for section, (_, key) in _REPORT.items():
        df = tables[section]
        measures = [c for c in df.columns if c not in key]
        rows = df.select(F.lit(section).alias("section"), F.concat_ws(" ", *[F.col(k).cast("string") for k in key]).alias("key"), *[F.col(c).cast("double").alias(c) for c in measures])
        rows = rows.unpivot(["section", "key"], measures, "measure", "value").filter(F.col("value").isNotNull())
        # as the queries of the single tables round them
        rows = rows.withColumn("value", F.when(F.col("measure").contains("tstat"), F.round("value", 5)).when(F.col("measure").contains("median"), F.round("value", 9)).otherwise(F.round("value", 6)))
        out = rows if out is None else out.unionByName(rows)
    return tidy(out, digits=4)


@query("a5_report_drift_and_ic", """
SELECT 'drift' AS section, CAST(year(date) AS INTEGER) AS year, count(*) AS dates, round(avg(m), 6) + 0.0 AS value FROM (SELECT date, avg(fwd_excess) AS m FROM panel WHERE fwd_excess IS NOT NULL GROUP BY 1) GROUP BY 2
UNION ALL SELECT 'ic ' || signal, CAST(year(date) AS INTEGER), count(*), round(avg(rank_ic), 6) + 0.0 FROM per_date GROUP BY signal, 2""")
def a5b(spark, sf):
    t = sd.backtest_report(bv.panel(spark, sf), SIGNALS, "score", bv.LABEL, bv.EVERY)
    d = t["drift"].select(F.lit("drift").alias("section"), "year", "dates", F.col("mean_fwd_excess").alias("value"))
    i = t["by_year"].select(F.concat(F.lit("ic "), "signal").alias("section"), "year", "dates", F.col("mean_rank_ic").alias("value"))
    return tidy(d.unionByName(i))


def _exit_inputs(spark, sf):
    c = _candidates(spark, sf)
    p = bv.panel(spark, sf).select("date", "ticker", "momentum")
    cand = c.join(p, ["date", "ticker"])
    return cand, rk.top_per_date(cand.filter(F.col("momentum").isNotNull()), [F.col("momentum").desc(), F.col("ticker")], 5)


@query("a6_is_it_luck")
def a6(spark, sf):
    cand, picks = _exit_inputs(spark, sf)
    return tidy(sd.exit_comparison(cand, picks, bv.grid(spark, sf), 12, 20))


@query("a7_event_study")
def a7(spark, sf):
    """Insider clusters from signal to verdict, in both periods."""
    ev = ins.insider_cluster_events(bv.transactions(spark, sf), bv.issuer_map(spark, sf))
    m = bv.panel(spark, sf).select("date", "ticker").distinct()
    return tidy(sd.event_study(ev, m, outcome_table(spark, sf), bv.grid(spark, sf), bv.bench_grid(spark, sf), bv.calendar(spark, sf), 40, PERIODS))


@bv.staged
def survival_candidates(spark, sf):
    s = _screen(spark, sf).filter("is_candidate").select("date", "ticker", "drawdown", "valuation_pct", "price_only", "net_margin", "fcf_yield", "revenue_growth")
    sec = bv.table(spark, sf, "supplier").select(bv.ticker_of("s_suppkey").alias("ticker"), F.when(F.col("s_nationkey") % 2 == 0, "finance").otherwise("retail").alias("sector"))
    return s.join(sec, "ticker").join(bv.calendar(spark, sf), "date")


SURVIVAL_TARGETS, SURVIVAL_CAP, SURVIVAL_RANKS = (0.05, 0.1, 0.2), 40, ["net_margin", "fcf_yield", "revenue_growth"]


def _breaks(spark, sf):
    return fx.thesis_break_dates(bv.company_facts(spark, sf)).select(bv.ticker_of("cik").alias("ticker"), "break_date")


@bv.staged
def survival_outcomes(spark, sf):
    return sd.survival_outcomes(survival_candidates(spark, sf), bv.grid(spark, sf), bv.calendar(spark, sf), _breaks(spark, sf), SURVIVAL_TARGETS, SURVIVAL_CAP)


@bv.staged
def survival_design(spark, sf):
    return mo.survival_design(survival_candidates(spark, sf), SURVIVAL_RANKS)[0]


@bv.staged
def held_closes(spark, sf):
    return pf.held_closes(bv.grid(spark, sf))


def _survival(spark, sf, target=0.1):
    return sd.value_survival(survival_candidates(spark, sf), bv.grid(spark, sf), bv.calendar(spark, sf), _breaks(spark, sf), bv.bench_grid(spark, sf), "1999-06-30", target, SURVIVAL_CAP, SURVIVAL_RANKS,
                             outcomes=survival_outcomes(spark, sf), design=survival_design(spark, sf), held=held_closes(spark, sf))


@query("a8_value_survival")
def a8(spark, sf):
    """Scores and verdict of the study at three targets."""
    out = None
    for target in SURVIVAL_TARGETS:
        r = _survival(spark, sf, target)
        # one target at a time, and the scores apart from the verdict: the driver holds the plan and the broadcasts of one
        checks = cut_lineage(r["verdict"].agg(F.count_if("ok").alias("n")))
        row = cut_lineage(tidy(r["scores"])).withColumn("checks", checks.scalar()).withColumn("target", F.lit(target))
        out = row if out is None else out.unionByName(row)
    return out


@query("a9_addendum")
def a9(spark, sf):
    return tidy(sd.addendum(variant_scores(spark, sf), VARIANTS), "variant", "months", "mean_rank_ic", "ic_t", "holm_p", "spread_mean", "top_decile_annualized", "passed")


@query("a9_addendum_signals", f"""
WITH {', '.join(f"{_port_sql(f'u_{s}', s, 0.1, 1.0, 0.0015, 'fwd_excess')}, {_port_sql(f'd_{s}', f'(-{s})', 0.1, 1.0, 0.0015, 'fwd_excess')}" for s in SIGNALS)},
spread AS ({' UNION ALL '.join(f"SELECT '{s}' AS variant, avg(u.net - d.gross - d.turnover * 0.0015) AS sm FROM u_{s} u JOIN d_{s} d USING (date)" for s in SIGNALS)}),
perf AS ({' UNION ALL '.join(f"SELECT '{s}' AS variant, pow(product(1 + net), 12 / count(*)) - 1 AS ann FROM u_{s}" for s in SIGNALS)}),
ic AS ({nw_sql('per_date', 'signal', 'date', 'rank_ic', 1)})
SELECT variant, ic.n AS months, round(mean, 6) + 0.0 AS mean_rank_ic, round(ic.t, 5) + 0.0 AS ic_t, round(holm_p, 4) + 0.0 AS holm_p, round(sm, 6) + 0.0 AS spread_mean, round(ann, 6) + 0.0 AS top_decile_annualized,
  coalesce(h.ic_t > 0 AND holm_p < 0.0455002638963584, false) AND mean > 0 AND sm > 0 AS passed
FROM holm h JOIN ic ON ic.signal = h.variant JOIN spread USING (variant) JOIN perf USING (variant)""")
def a9b(spark, sf):
    """The addendum over the panel's own signals, all in one plan."""
    x = sd.addendum(bv.panel(spark, sf), SIGNALS, "fwd_excess").withColumns({"ic_t": F.round("ic_t", 5), "holm_p": F.round("holm_p", 4)})
    return tidy(x, "variant", "months", "mean_rank_ic", "ic_t", "holm_p", "spread_mean", "top_decile_annualized", "passed")


@query("r11_extended_research_fields", f"""
WITH g AS (SELECT 'S' || lpad(substr(ticker, 2), 9, '0') AS ticker, research_score, signal_count, risks, catalysts, data_freshness FROM ({ORACLES['g5_company_research']}))
SELECT r.ticker, round(hs, 4) + 0.0 AS horizon_score, stop_loss + 0.0 AS stop_loss, take_profit + 0.0 AS take_profit, rr + 0.0 AS risk_reward_ratio, technical_view, fundamental_view, iview AS institutional_view, confidence,
  round(research_score, 6) + 0.0 AS research_score, signal_count, coalesce(risks, '') AS risks, coalesce(catalysts, '') AS catalysts, data_freshness FROM ranked r LEFT JOIN g USING (ticker)""")
def r11_fields(spark, sf):
    """The nested research rows as plain columns."""
    from .q_app import r11

    x = r11(spark, sf).select("ticker", "horizon_view.horizon_score", "risk_reward.stop_loss", "risk_reward.take_profit", "risk_reward.risk_reward_ratio", "views.*", "research.research_score", "research.signal_count",
                              F.concat_ws("|", "research.risks").alias("risks"), F.concat_ws("|", "research.catalysts").alias("catalysts"), "research.data_freshness")
    return tidy(x)


@query("a10_result_tables")
def a10(spark, sf):
    """Result rows of the event and exit studies under one shape."""
    ev = a7(spark, sf).select(F.lit("events").alias("study"), F.col("period").alias("name"), F.col("random_pct").alias("percentile"), F.when(F.col("passed"), "PASS").otherwise("NOT PROVEN").alias("verdict"))
    ex = a6(spark, sf).select(F.lit("exits").alias("study"), F.col("exit").alias("name"), "percentile", "verdict")
    return cut_lineage(ev).unionByName(cut_lineage(ex)).withColumn("bar", F.lit(95.0))


@query("a11_rebuild_check", f"WITH {_port_sql('m1', 'score', 0.1, 1.0, 0.0015)} SELECT count(*) AS rows, 0 AS differing, round(sum(net), 6) + 0.0 AS total FROM m1")
def a11(spark, sf):
    """A stored top-decile series recomputed from the stored panel: no row may differ."""
    from .q_stats import top_decile

    saved = top_decile(spark, sf)
    again = pf.monthly_portfolio(bv.panel(spark, sf), "score", "fwd_return", 0.10, 1.0, 0.0015).select("date", F.col("net").alias("ret"))
    bad = sd.rebuild_check(saved, again, ["date"], "ret").agg(F.count(F.lit(1)).alias("n"))
    return tidy(saved.agg(F.count(F.lit(1)).alias("rows"), F.sum("ret").alias("total")).withColumn("differing", bad.scalar()))


@query("a12_evaluate_and_register", f"""
WITH {', '.join(_port_sql(f'u_{s}', s, 0.1, 1.0, 0.0015).replace('FROM panel', "FROM (SELECT * FROM panel WHERE date < DATE '2001-01-01')") for s in ('score', 'momentum'))},
n AS (SELECT 'score' AS s, net FROM u_score UNION ALL SELECT 'momentum', net FROM u_momentum), ic AS (SELECT signal AS s, avg(rank_ic) AS ic FROM per_date WHERE date < DATE '2001-01-01' GROUP BY 1)
SELECT 'signal:' || substr(sha1('{{"score": "' || s || '"}}'), 1, 10) || ':0' AS variant_id, 'signal' AS family, count(*) AS months, round(any_value(ic), 6) + 0.0 AS mean_rank_ic,
  round(avg(net) / stddev_samp(net) * sqrt(12.0::DOUBLE), 6) + 0.0 AS sharpe, round(pow(product(1 + net), 12 / count(*)) - 1, 6) + 0.0 AS annualized FROM n JOIN ic USING (s) GROUP BY s""")
def a12(spark, sf):
    """Two scores evaluated and registered, one promoted or not, the holdout looked at once."""
    from .q_models import _written

    reg = pr.Registry(spark, _written(spark, sf, "study registry", lambda p: None), "2001-01-01")
    dev = bv.panel(spark, sf).filter(F.col("date") < "2001-01-01")
    if reg.trials().limit(1).count() == 0:
        for s in ("score", "momentum"):
            sd.evaluate_and_register(reg, dev, s, "signal", f"top decile by {s}", {"score": s})
        reg.promote(reg.trials().orderBy("variant_id").first()["variant_id"])
        reg.one_look("signals", sd.holdout_runner(bv.panel(spark, sf), ["score", "momentum"], "2001-01-01"))
    return tidy(reg.trials().select("variant_id", "family", "months", "mean_rank_ic", "sharpe", "annualized"))
