"""Registered queries: as-of joins, bi-temporal facts, 13F books, insiders, universe."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asof, facts as fx, features as ft, holdings as hd, insider as ins, universe as un
from ..sources import bench as bv
from .catalog import query, rounded, tidy
from .oracle_views import VIEWS

# --- shared SQL: the company table ----------------------------------------------------------------------

_CASE = {f: t for f, t in fx.DURATION_FIELDS.items()}
VIEWS["dur"] = f"""
WITH m AS (SELECT * FROM (VALUES {', '.join(f"('{f}', '{t}', {i})" for f, ts in fx.DURATION_FIELDS.items() for i, t in enumerate(ts))}) v(field, tag, tag_rank))
SELECT cik, field, start, "end", "end" - start AS days, val, filed, form FROM raw_facts JOIN m USING (tag) WHERE ns = 'us-gaap' AND start IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY cik, field, start, "end" ORDER BY filed, tag_rank) = 1"""
VIEWS["inst"] = f"""
WITH m AS (SELECT * FROM (VALUES {', '.join(f"('{f}', '{t}', {i})" for f, ts in fx.INSTANT_FIELDS.items() for i, t in enumerate(ts))}) v(field, tag, tag_rank))
SELECT cik, field, "end", val, filed FROM raw_facts r JOIN m ON r.ns || ':' || r.tag = m.tag WHERE start IS NULL
QUALIFY row_number() OVER (PARTITION BY cik, field, "end" ORDER BY filed, tag_rank) = 1"""
VIEWS["quarters"] = """
WITH rep AS (SELECT cik, field, "end", val, filed, false AS derived, start FROM dur WHERE days BETWEEN 80 AND 100
  QUALIFY row_number() OVER (PARTITION BY cik, field, "end" ORDER BY filed DESC, start DESC) = 1),
st AS (SELECT cik, field, "end", start, val - lag(val) OVER w AS val, greatest(filed, lag(filed) OVER w) AS filed, "end" - lag("end") OVER w AS gap
  FROM dur WHERE days >= 80 WINDOW w AS (PARTITION BY cik, field, start ORDER BY "end")),
der AS (SELECT cik, field, "end", val, filed, true AS derived, start FROM st WHERE gap BETWEEN 80 AND 100)
SELECT cik, field, "end", val, filed, derived FROM (SELECT * FROM rep UNION ALL SELECT * FROM der)
QUALIFY row_number() OVER (PARTITION BY cik, field, "end" ORDER BY derived, start) = 1"""
VIEWS["facts_t"] = """
SELECT cik, 'q' AS kind, field, "end", val, filed, derived FROM quarters UNION ALL SELECT cik, 'i', field, "end", val, filed, false FROM inst"""
VIEWS["fcfq"] = """
SELECT a.cik, a."end", a.val - b.val AS val, greatest(a.filed, b.filed) AS filed FROM quarters a JOIN quarters b ON a.cik = b.cik AND a."end" = b."end"
WHERE a.field = 'ocf' AND b.field = 'capex'"""


def _ttm_sql(name: str, src: str, skip: int = 0) -> str:
    return f"""{name} AS (SELECT cik, sd, CASE WHEN max(rk) = {skip + 4} AND max("end") - min("end") BETWEEN 250 AND 300 THEN sum(val) END AS v FROM
  (SELECT d.cik, d.sd, q."end", q.val, row_number() OVER (PARTITION BY d.cik, d.sd ORDER BY q."end" DESC) AS rk FROM days d JOIN ({src}) q ON q.cik = d.cik AND q.filed <= d.sd)
  WHERE rk > {skip} AND rk <= {skip + 4} GROUP BY 1, 2)"""


def _inst_sql(f: str) -> str:
    return f"""i_{f} AS (SELECT d.cik, d.sd, CASE WHEN d.sd - max(q."end") <= 400 THEN arg_max(q.val, q."end") END AS v FROM days d JOIN inst q
  ON q.cik = d.cik AND q.filed <= d.sd AND q.field = '{f}' GROUP BY 1, 2)"""


_Q = lambda f: f"SELECT cik, \"end\", val, filed FROM quarters WHERE field = '{f}'"
VIEWS["snap"] = f"""
WITH days AS (SELECT DISTINCT cik, filed AS sd FROM facts_t),
{_ttm_sql('t_rev', _Q('revenue'))}, {_ttm_sql('t_ni', _Q('net_income'))}, {_ttm_sql('t_fcf', 'SELECT * FROM fcfq')}, {_ttm_sql('t_prior', _Q('revenue'), 4)},
{', '.join(_inst_sql(f) for f in fx.INSTANT_FIELDS)},
x AS (SELECT d.cik, d.sd AS state_date, t_rev.v AS revenue_ttm, t_ni.v AS net_income_ttm, t_fcf.v AS fcf_ttm, t_prior.v AS revenue_ttm_prior, i_shares.v AS shares,
  i_cash.v AS cash, i_equity.v AS equity, coalesce(i_debt_total.v, CASE WHEN i_debt_noncurrent.v IS NOT NULL OR i_debt_current.v IS NOT NULL THEN
    coalesce(i_debt_noncurrent.v, 0) + coalesce(i_debt_current.v, 0) END, CASE WHEN i_assets.v IS NOT NULL THEN 0 END) + coalesce(i_short_borrowings.v, 0) AS debt
  FROM days d {' '.join(f'LEFT JOIN {t} ON {t}.cik = d.cik AND {t}.sd = d.sd' for t in ['t_rev', 't_ni', 't_fcf', 't_prior', *['i_' + f for f in fx.INSTANT_FIELDS]])})
SELECT *, debt - cash AS net_debt FROM x"""
_SNAP = "revenue_ttm net_income_ttm fcf_ttm revenue_ttm_prior shares cash equity debt net_debt"


# --- T1-T6, T13, T14: as-of joins -------------------------------------------------------------------------

@query("t1_asof_join", """
SELECT o.o_orderkey, o.d AS asked, b.date AS bar_date, b.close FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d,
  'S' || lpad(CAST(o_custkey % (SELECT count(*) FROM supplier) AS VARCHAR), 9, '0') AS ticker FROM orders) o ASOF LEFT JOIN bars b ON o.ticker = b.ticker AND o.d >= b.date""")
def t1(spark, sf):
    """Price known on each order day (many orders share a ticker and a day)."""
    n = bv.table(spark, sf, "supplier").count()
    o = bv.table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("asked"),
                                             F.concat(F.lit("S"), F.lpad((F.col("o_custkey") % n).cast("string"), 9, "0")).alias("ticker"))
    b = bv.bars(spark, sf).select("ticker", F.col("date").alias("bar_date"), "close")
    return asof.asof_join(o, b, ["ticker"], "asked", "bar_date", ["close"]).select("o_orderkey", "asked", "bar_date", "close")


@query("t2_t4_asof_max_age", """
WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, 'S' || lpad(CAST(o_custkey % (SELECT count(*) FROM supplier) AS VARCHAR), 9, '0') AS ticker FROM orders)
SELECT o.o_orderkey, CASE WHEN o.d - b.date <= 7 THEN b.close END AS fresh_close, CASE WHEN o.d - b.date <= 7 THEN b.date END AS bar_date,
  z.date AS next_date FROM o ASOF LEFT JOIN bars b ON o.ticker = b.ticker AND o.d > b.date ASOF LEFT JOIN bars z ON o.ticker = z.ticker AND o.d <= z.date""")
def t2(spark, sf):
    """Strict as-of with a seven-day limit, and the first bar on or after the day."""
    n = bv.table(spark, sf, "supplier").count()
    o = bv.table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("asked"),
                                             F.concat(F.lit("S"), F.lpad((F.col("o_custkey") % n).cast("string"), 9, "0")).alias("ticker"))
    b = bv.bars(spark, sf).select("ticker", F.col("date").alias("bar_date"), F.col("close").alias("fresh_close"))
    x = asof.asof_join(o, b, ["ticker"], "asked", "bar_date", ["fresh_close"], max_age=7, strict=True)
    x = asof.asof_join(x, b.select("ticker", F.col("bar_date").alias("next_date")), ["ticker"], "asked", "next_date", [], tiebreak=["next_date"], forward=True)
    return x.select("o_orderkey", "fresh_close", "bar_date", "next_date")


_ME = "SELECT max(date) AS date FROM cal WHERE date >= DATE '1996-01-01' GROUP BY date_trunc('month', date)"
VIEWS["month_end_dates"] = _ME
VIEWS["live"] = """
SELECT d.date, f.cik, f.accession, f.filing_date FROM month_end_dates d JOIN filings f ON f.filing_date <= d.date AND f.filing_date >= d.date - 200
QUALIFY row_number() OVER (PARTITION BY d.date, f.cik ORDER BY f.filing_date DESC, f.accession DESC) = 1"""


@query("t5_latest_filings", "SELECT date, cik, accession FROM live")
def t5(spark, sf):
    f = bv.filings(bv.holdings(spark, sf))
    return asof.latest_filings(f, bv.month_end_dates(spark, sf)).select("date", "cik", "accession")


@query("t6_eligibility", """
WITH m AS (SELECT DISTINCT date, ticker FROM panel WHERE volume >= 100), d AS (SELECT DISTINCT date FROM m),
o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS signal_date, 'S' || lpad(CAST(o_custkey % (SELECT count(*) FROM supplier) AS VARCHAR), 9, '0') AS ticker FROM orders)
SELECT o.o_orderkey, o.signal_date, o.ticker FROM o ASOF JOIN d ON o.signal_date >= d.date JOIN m ON m.date = d.date AND m.ticker = o.ticker""")
def t6(spark, sf):
    """Orders whose ticker was a member in the latest membership snapshot."""
    n = bv.table(spark, sf, "supplier").count()
    o = bv.table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("signal_date"),
                                             F.concat(F.lit("S"), F.lpad((F.col("o_custkey") % n).cast("string"), 9, "0")).alias("ticker"))
    members = bv.panel(spark, sf).filter(F.col("volume") >= 100).select("date", "ticker").distinct()
    return asof.eligible(o, members).select("o_orderkey", "signal_date", "ticker")


@query("t13_statement_lag", """
SELECT cik, "end", count(*) AS known FROM dur WHERE "end" <= filed - 40 GROUP BY 1, 2""")
def t13(spark, sf):
    d = fx.duration_facts(bv.raw_facts(spark, sf))
    return asof.statement_lag_gate(d, F.col("filed"), 40, "end").groupBy("cik", "end").agg(F.count(F.lit(1)).alias("known"))


@query("t14_year_ago_filing", """
WITH c AS (SELECT a.accession, b.accession AS p, b.filing_date AS pf, CASE WHEN a.form = '10-K' THEN a.filing_date - b.filing_date BETWEEN 300 AND 430 END AS ann,
  CASE WHEN a.form <> '10-K' THEN a.report_date - b.report_date BETWEEN 350 AND 380 END AS per,
  CASE WHEN a.form <> '10-K' THEN a.filing_date - b.filing_date BETWEEN 330 AND 400 END AS fil
  FROM sections a JOIN sections b ON a.cik = b.cik AND a.form = b.form AND b.filing_date < a.filing_date),
x AS (SELECT accession, arg_max(p, (pf, p)) FILTER (ann) AS a, arg_max(p, (pf, p)) FILTER (per) AS q, arg_max(p, (pf, p)) FILTER (fil) AS f FROM c GROUP BY 1)
SELECT s.accession, s.form, CASE WHEN s.form = '10-K' THEN a ELSE coalesce(q, f) END AS prior_accession FROM sections s LEFT JOIN x USING (accession)""")
def t14(spark, sf):
    s = bv.sections(spark, sf).select("cik", "accession", "form", "filing_date", "report_date")
    return asof.year_ago_filing(s).select("accession", "form", "prior_accession")


# --- X: facts -----------------------------------------------------------------------------------------------

@query("x1_x2_first_filed_facts", """
SELECT cik, field, start, "end", round(val, 4) + 0.0 AS val, filed FROM dur UNION ALL SELECT cik, field, NULL, "end", round(val, 4) + 0.0, filed FROM inst""")
def x1(spark, sf):
    raw = bv.raw_facts(spark, sf)
    d = fx.duration_facts(raw).select("cik", "field", "start", "end", "val", "filed")
    i = fx.instant_facts(raw).select("cik", "field", F.lit(None).cast("date").alias("start"), "end", "val", "filed")
    return tidy(d.unionByName(i), digits=4)


@query("x3_x4_company_table", 'SELECT cik, kind, field, "end", round(val, 4) + 0.0 AS val, filed, derived FROM facts_t')
def x4(spark, sf):
    return tidy(fx.company_table(bv.raw_facts(spark, sf)), digits=4)


@query("x5_visible_quarters", "SELECT cik, \"end\", round(val, 4) + 0.0 AS val, filed FROM quarters WHERE field = 'revenue' AND filed <= DATE '1999-06-30'")
def x5(spark, sf):
    return tidy(fx.quarterly_series(bv.company_facts(spark, sf), "revenue", F.to_date(F.lit("1999-06-30"))), digits=4)


@query("x6_x8_snapshots", f"SELECT cik, state_date, {rounded(_SNAP, 2)} FROM snap")
def x8(spark, sf):
    return tidy(fx.snapshots(bv.company_facts(spark, sf)), digits=2)


@query("x8_monthly_fundamentals", f"""
SELECT k.cik, k.date, s.state_date, {', '.join(f'round(s.{c}, 2) + 0.0 AS {c}' for c in _SNAP.split())}
FROM (SELECT c.cik, d.date FROM (SELECT DISTINCT cik FROM facts_t) c CROSS JOIN month_end_dates d) k ASOF LEFT JOIN snap s ON k.cik = s.cik AND k.date >= s.state_date""")
def x8m(spark, sf):
    b, cal = bv.bars(spark, sf), bv.month_end_dates(spark, sf)
    keys = bv.grid(spark, sf).join(cal, "date").select(F.substring("ticker", 2, 9).cast("long").alias("cik"), "date")
    return tidy(fx.monthly_fundamentals(bv.company_facts(spark, sf), keys), "cik", "date", "state_date", *_SNAP.split(), digits=2)


VIEWS["thesis_breaks"] = """
WITH q AS (SELECT r.cik, r."end", r.val AS rev, f.val AS fcf, greatest(r.filed, f.filed) AS filed FROM quarters r JOIN fcfq f ON r.cik = f.cik AND r."end" = f."end" WHERE r.field = 'revenue'),
p AS (SELECT q.*, (SELECT arg_max(z.rev, z."end") FROM q z WHERE z.cik = q.cik AND q."end" - z."end" BETWEEN 350 AND 380) AS prior FROM q),
b AS (SELECT *, coalesce(fcf < 0 AND rev < prior, false) AS bad FROM p),
l AS (SELECT *, lag(bad) OVER w AS pb, "end" - lag("end") OVER w AS gap FROM b WINDOW w AS (PARTITION BY cik ORDER BY "end"))
SELECT cik, filed AS break_date FROM l WHERE bad AND pb AND gap BETWEEN 80 AND 100"""
VIEWS["sue"] = """
WITH e AS (SELECT cik, "end", val, filed, count(*) OVER (PARTITION BY cik) AS n FROM quarters WHERE field = 'eps'),
p AS (SELECT e.*, (SELECT arg_max(z.val, z."end") FROM e z WHERE z.cik = e.cik AND e."end" - z."end" BETWEEN 350 AND 380) AS prior FROM e WHERE n >= 13),
c AS (SELECT *, val - prior AS ch FROM p WHERE prior IS NOT NULL),
s AS (SELECT *, count(*) OVER w AS k, stddev_samp(ch) OVER w AS sd FROM c WINDOW w AS (PARTITION BY cik ORDER BY "end" ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING))
SELECT cik, "end", filed, ch / sd AS sue FROM s WHERE k = 8 AND sd > 0"""


@query("x9_thesis_breaks", "SELECT * FROM thesis_breaks")
def x9(spark, sf):
    return fx.thesis_break_dates(bv.company_facts(spark, sf))


@query("x10_sue_series", 'SELECT cik, "end", filed, round(sue, 5) + 0.0 AS sue FROM sue')
def x10(spark, sf):
    return tidy(fx.sue_series(bv.company_facts(spark, sf)), digits=5)


@query("x11_add_sue", """
WITH k AS (SELECT c.cik, d.date FROM (SELECT DISTINCT cik FROM facts_t) c CROSS JOIN month_end_dates d),
s AS (SELECT cik, filed, arg_max(sue, "end") AS sue FROM sue GROUP BY 1, 2), f AS (SELECT DISTINCT cik, filed AS lf FROM facts_t)
SELECT k.cik, k.date, round(s.sue, 5) + 0.0 AS sue, CAST(k.date - f.lf AS INTEGER) AS days_since_filing FROM k
ASOF LEFT JOIN s ON k.cik = s.cik AND k.date >= s.filed ASOF LEFT JOIN f ON k.cik = f.cik AND k.date >= f.lf""")
def x11(spark, sf):
    t = bv.company_facts(spark, sf)
    keys = bv.grid(spark, sf).join(bv.month_end_dates(spark, sf), "date").select(F.substring("ticker", 2, 9).cast("long").alias("cik"), "date")
    return tidy(fx.add_sue(keys, fx.sue_series(t), t), "cik", "date", "sue", "days_since_filing", digits=5)


def _fall(close, high):
    """1 - close / high of prices in cents, from whole numbers: what lies halfway between two roundings stays there."""
    c, h = F.round(close * 100).cast("long"), F.round(high * 100).cast("long")
    return F.when(h != 0, (h - c) / h)


def _screen(spark, sf):
    """Monthly screen rows: last bar within a week, market cap from reported shares, P/S history, ratios."""
    b = bv.bars(spark, sf).withColumn("high_52", ft.rolling(F.max, F.col("high"), 52))
    dates = bv.month_end_dates(spark, sf)
    keys = bv.grid(spark, sf).join(dates, "date").select("ticker", "date", F.substring("ticker", 2, 9).cast("long").alias("cik"))
    px = b.select("ticker", F.col("date").alias("bar_date"), "close", "high_52")
    x = asof.asof_join(keys, px, ["ticker"], "date", "bar_date", ["close", "high_52"], max_age=7, probe_unique=True)
    x = asof.asof_join(x, fx.snapshots(bv.company_facts(spark, sf)), ["cik"], "date", "state_date", probe_unique=True)
    x = x.withColumn("market_cap", F.round(F.col("close") * F.col("shares"), 4)).withColumn("drawdown", F.round(_fall(F.col("close"), F.col("high_52")), 8))
    x = fx.ratios(x).withColumn("ps", F.round("ps", 8))
    return fx.cheap_quality_screen(fx.valuation_percentile(x, "ps", 60), 0.02, 12, 5000.0)


VIEWS["screen"] = """
WITH k AS (SELECT t.ticker, d.date, CAST(substr(t.ticker, 2) AS BIGINT) AS cik FROM (SELECT DISTINCT ticker FROM bars) t CROSS JOIN month_end_dates d),
h AS (SELECT ticker, date AS bar_date, close, CASE WHEN count(high) OVER w = 52 THEN max(high) OVER w END AS high_52 FROM bars
  WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 51 PRECEDING)),
a AS (SELECT k.*, CASE WHEN k.date - h.bar_date <= 7 THEN h.close END AS close, CASE WHEN k.date - h.bar_date <= 7 THEN h.high_52 END AS high_52
  FROM k ASOF LEFT JOIN h ON k.ticker = h.ticker AND k.date >= h.bar_date),
s AS (SELECT a.*, n.* EXCLUDE (cik) FROM a ASOF LEFT JOIN snap n ON a.cik = n.cik AND a.date >= n.state_date),
m AS (SELECT *, round(close * shares, 4) AS market_cap, round(1 - close / high_52, 8) AS drawdown FROM s),
p AS (SELECT *, CASE WHEN revenue_ttm <> 0 AND market_cap / revenue_ttm > 0 THEN round(market_cap / revenue_ttm, 8) END AS ps,
  CASE WHEN revenue_ttm > 0 THEN net_income_ttm / revenue_ttm END AS net_margin, CASE WHEN revenue_ttm > 0 THEN fcf_ttm / revenue_ttm END AS fcf_margin,
  CASE WHEN market_cap <> 0 THEN net_debt / market_cap END AS net_debt_to_mcap, CASE WHEN market_cap <> 0 THEN fcf_ttm / market_cap END AS fcf_yield FROM m),
v AS (SELECT p.ticker, p.date, count(z.ps) AS n, avg(CASE WHEN z.ps < p.ps THEN 1.0::DOUBLE ELSE 0.0 END) FILTER (z.ps IS NOT NULL) AS pct, median(z.ps) AS med
  FROM p LEFT JOIN p z ON z.ticker = p.ticker AND z.date < p.date AND z.date >= p.date - INTERVAL 60 MONTH GROUP BY 1, 2)
SELECT p.*, v.n AS valuation_history, CASE WHEN v.n > 0 AND ps IS NOT NULL THEN pct END AS valuation_pct, CASE WHEN v.n > 0 AND ps IS NOT NULL THEN med END AS valuation_median,
  coalesce(drawdown >= 0.02, false) AND (v.n < 12 OR coalesce(ps < med, false)) AND coalesce(net_margin > 0 AND fcf_margin > 0 AND net_debt_to_mcap < 5000, false) AS is_candidate
FROM p JOIN v ON v.ticker = p.ticker AND v.date = p.date"""


@query("x12_valuation_percentile", "SELECT ticker, date, CAST(valuation_history AS INTEGER) AS valuation_history, round(valuation_pct, 6) + 0.0 AS valuation_pct, round(valuation_median, 9) + 0.0 AS valuation_median FROM screen")
def x12(spark, sf):
    s = _screen(spark, sf).withColumn("valuation_pct", F.round("valuation_pct", 6))
    return tidy(s, "ticker", "date", "valuation_history", "valuation_pct", "valuation_median", digits=9)


@query("x13_cheap_quality_screen", f"SELECT ticker, date, is_candidate, {rounded('net_margin fcf_margin fcf_yield')}, drawdown, round(net_debt_to_mcap, 3) + 0.0 AS net_debt_to_mcap FROM screen WHERE close IS NOT NULL")
def x13(spark, sf):
    s = _screen(spark, sf).filter(F.col("close").isNotNull()).withColumn("net_debt_to_mcap", F.round("net_debt_to_mcap", 3) + F.lit(0.0))
    for c in ("net_margin", "fcf_margin", "fcf_yield"):
        s = s.withColumn(c, F.round(c, 6) + F.lit(0.0))
    return s.select("ticker", "date", "is_candidate", "drawdown", "net_margin", "fcf_margin", "fcf_yield", "net_debt_to_mcap")


# --- H: 13F --------------------------------------------------------------------------------------------------

VIEWS["changes"] = """
WITH ch AS (SELECT cik, accession, filing_date, report_date, lag(accession) OVER (PARTITION BY cik ORDER BY report_date, filing_date) AS pa FROM filings),
cur AS (SELECT h.*, sum(value) OVER (PARTITION BY h.cik, h.accession) AS tot FROM holdings h),
j AS (SELECT c.cik, c.accession, c.filing_date, c.report_date, c.pa, coalesce(a.cusip, p.cusip) AS cusip, coalesce(a.name_of_issuer, p.name_of_issuer) AS name_of_issuer,
  coalesce(a.title_of_class, p.title_of_class) AS title_of_class, a.shares, a.value, p.shares AS prev_shares, p.value AS prev_value, a.tot FROM ch c
  JOIN (SELECT accession, cusip FROM holdings UNION SELECT x.accession, h.cusip FROM ch x JOIN holdings h ON h.accession = x.pa) u ON u.accession = c.accession
  LEFT JOIN cur a ON a.accession = c.accession AND a.cusip = u.cusip LEFT JOIN holdings p ON p.accession = c.pa AND p.cusip = u.cusip),
r AS (SELECT *, shares > 0 AND prev_shares > 0 AS both_, CASE WHEN prev_shares > 0 THEN shares / prev_shares END AS sr,
  CASE WHEN shares > 0 AND prev_value > 0 THEN (value / shares) / (prev_value / prev_shares) END AS pr FROM j),
k AS (SELECT *, round_even(1 / pr, 0) AS kf, round_even(pr, 0) AS kr FROM r),
s AS (SELECT *, CASE WHEN both_ AND pr > 0 AND sr > 0 AND kf >= 2 AND abs(1 / pr - kf) / kf < 0.15 AND sr / kf > 0.6 AND sr / kf < 1.6 THEN kf
  WHEN both_ AND pr > 0 AND sr > 0 AND kr >= 2 AND abs(pr - kr) / kr < 0.15 AND sr * kr > 0.6 AND sr * kr < 1.6 THEN 1 / kr ELSE 1.0::DOUBLE END AS split_factor FROM k),
m AS (SELECT *, median(CASE WHEN both_ THEN sr / split_factor END) OVER (PARTITION BY cik, accession) AS med FROM s),
c AS (SELECT *, sr / split_factor / coalesce(med, 1) - 1 AS adj FROM m),
t AS (SELECT *, CASE WHEN pa IS NULL THEN 'NO_PRIOR' WHEN coalesce(shares, 0) = 0 THEN 'EXITED' WHEN coalesce(prev_shares, 0) = 0 THEN 'NEW'
  WHEN adj > 0.1 THEN 'ADDED' WHEN adj < -0.1 THEN 'REDUCED' ELSE 'UNCHANGED' END AS status FROM c)
SELECT cik, accession, filing_date, report_date, cusip, name_of_issuer, title_of_class, coalesce(shares, 0) AS shares, coalesce(value, 0) AS value, prev_shares, prev_value,
  coalesce(value / tot, 0) AS weight, CASE WHEN pa IS NOT NULL THEN sr - 1 END AS share_change, CASE WHEN status IN ('ADDED', 'REDUCED', 'UNCHANGED') THEN adj END AS adjusted_change,
  split_factor, status FROM t"""
def _selected(held: str, add: str, cut: str) -> str:
    """Positions picked in one pass over the changes: ranks among the rows that count for each kind."""
    rank = lambda which, order: f"row_number() OVER (PARTITION BY cik, accession, {which} ORDER BY {order})"
    return f"""
WITH p AS (SELECT *, {rank("status <> 'EXITED'", "value DESC, cusip")} AS vr, {rank("prev_value IS NOT NULL", "prev_value DESC, cusip")} AS pr FROM changes),
f AS (SELECT *, status <> 'EXITED' {held} AS h, status IN ('NEW', 'ADDED') {add} AS a, (status = 'EXITED' AND prev_value IS NOT NULL {cut}) OR (status = 'REDUCED' {add}) AS c FROM p),
r AS (SELECT *, {rank("a", "adjusted_change DESC NULLS FIRST, value DESC, cusip")} AS ar, {rank("c", "adjusted_change ASC NULLS FIRST, prev_value DESC, cusip")} AS cr FROM f)
SELECT * EXCLUDE (vr, pr, h, a, c, ar, cr) FROM r WHERE h AND vr <= 30 OR a AND ar <= 10 OR c AND cr <= 10"""


VIEWS["selected"] = _selected("", "", "")
VIEWS["selected_among_300"] = _selected("AND vr <= 300", "AND vr <= 300", "AND pr <= 300")
_FUNDS = ", ".join(f"'{t}'" for t in hd.FUND_TYPES)
_DIR = "CASE status WHEN 'NEW' THEN 'POSITIVE' WHEN 'ADDED' THEN 'POSITIVE' WHEN 'REDUCED' THEN 'NEGATIVE' WHEN 'EXITED' THEN 'NEGATIVE' ELSE 'MENTIONED' END"
_CONF = "CASE status WHEN 'NEW' THEN 'High' WHEN 'EXITED' THEN 'High' WHEN 'ADDED' THEN 'Medium' WHEN 'REDUCED' THEN 'Medium' ELSE 'Low' END"
VIEWS["uhist"] = f"""
SELECT s.filing_date, s.report_date, s.cik, s.accession, s.cusip, m.ticker, s.status, s.value, s.weight, s.adjusted_change, s.name_of_issuer AS company_name,
  {_DIR} AS view_direction, {_CONF} AS confidence FROM selected s LEFT JOIN cusip_map m ON m.cusip = s.cusip WHERE coalesce(m.security_type NOT IN ({_FUNDS}), true)"""
_SCORE = "round(coalesce(avg(CASE view_direction WHEN 'POSITIVE' THEN 1.0::DOUBLE WHEN 'NEGATIVE' THEN -1.0::DOUBLE WHEN 'NEUTRAL' THEN 0.0 WHEN 'MENTIONED' THEN 0.0 END), 0), 4) + 0.0"


def _label(agg: str = "avg(CASE view_direction WHEN 'POSITIVE' THEN 1.0::DOUBLE WHEN 'NEGATIVE' THEN -1.0::DOUBLE WHEN 'NEUTRAL' THEN 0.0 WHEN 'MENTIONED' THEN 0.0 END)") -> str:
    return f"CASE WHEN {agg} > 0.25 THEN 'POSITIVE' WHEN {agg} < -0.25 THEN 'NEGATIVE' WHEN bool_or(view_direction IN ('POSITIVE', 'NEGATIVE')) THEN 'NEUTRAL' ELSE 'MENTIONED' END"


@query("h1_original_filings", "SELECT cik, report_date, max(filing_date) AS filing_date, arg_max(accession, filing_date) AS accession FROM "
       "(SELECT * FROM filings UNION ALL SELECT cik, accession || '-L', filing_date + 9, report_date FROM filings WHERE cik % 2 = 0) GROUP BY 1, 2")
def h1(spark, sf):
    f = bv.filings(bv.holdings(spark, sf))
    late = f.filter(F.col("cik") % 2 == 0).withColumn("accession", F.concat("accession", F.lit("-L"))).withColumn("filing_date", F.date_add("filing_date", 9))
    return hd.original_filings(f.unionByName(late)).select("cik", "report_date", "filing_date", "accession")


@query("h2_split_factor", """
WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity / 5 AS sr, 5 / l_quantity * (0.9 + l_tax) AS pr FROM lineitem),
k AS (SELECT *, round_even(1 / pr, 0) AS kf, round_even(pr, 0) AS kr FROM x)
SELECT sr, pr, count(*) AS n, round(CASE WHEN kf >= 2 AND abs(1 / pr - kf) / kf < 0.15 AND sr / kf > 0.6 AND sr / kf < 1.6 THEN kf
  WHEN kr >= 2 AND abs(pr - kr) / kr < 0.15 AND sr * kr > 0.6 AND sr * kr < 1.6 THEN 1 / kr ELSE 1 END, 6) + 0.0 AS factor FROM
  (SELECT round(sr, 6) AS sr, round(pr, 6) AS pr, round_even(1 / round(pr, 6), 0) AS kf, round_even(round(pr, 6), 0) AS kr FROM x) GROUP BY sr, pr, kf, kr""")
def h2(spark, sf):
    q = F.col("l_quantity")
    x = bv.table(spark, sf, "lineitem").select(F.round(q / 5, 6).alias("sr"), F.round(5 / q * (0.9 + F.col("l_tax")), 6).alias("pr"))
    return tidy(x.groupBy("sr", "pr").agg(F.count(F.lit(1)).alias("n")).withColumn("factor", hd.split_factor(F.col("sr"), F.col("pr"))))


@query("h3_compare_quarters", f"SELECT cik, accession, cusip, name_of_issuer, status, shares, prev_shares, {rounded('value weight share_change adjusted_change split_factor')} FROM changes")
def h3(spark, sf):
    h = bv.holdings(spark, sf)
    return tidy(hd.compare_quarters(h, bv.filings(h)), "cik", "accession", "cusip", "name_of_issuer", "status", "shares", "prev_shares", "value", "weight", "share_change",
                "adjusted_change", "split_factor")


@query("h4_select_positions", "SELECT cik, accession, cusip, status, round(value, 2) + 0.0 AS value FROM selected")
def h4(spark, sf):
    return tidy(hd.select_positions(bv.book_changes(spark, sf)), "cik", "accession", "cusip", "status", "value", digits=2)


@query("h4_select_among_300", "SELECT cik, accession, cusip, status, round(value, 2) + 0.0 AS value FROM selected_among_300")
def h4_pool(spark, sf):
    """The variant that takes positions beyond the 300 largest of a filing for noise."""
    return tidy(hd.select_positions(bv.book_changes(spark, sf), pool=300), "cik", "accession", "cusip", "status", "value", digits=2)


@query("h5_build_mentions", f"""
SELECT 'Filer ' || s.cik AS institution, s.filing_date AS publication_date, '13F-HR holdings as of ' || s.report_date || ' (filed ' || s.filing_date || ')' AS report_title, m.ticker,
  s.name_of_issuer AS company_name, {_DIR} AS view_direction, {_CONF} AS confidence, '13F information table, CUSIP ' || s.cusip || ' (COM), status ' || status AS evidence,
  '13F:' || s.cik || ':' || s.accession || ':' || s.cusip AS chunk_id FROM selected s LEFT JOIN cusip_map m ON m.cusip = s.cusip WHERE coalesce(m.security_type NOT IN ({_FUNDS}), true)""")
def h5(spark, sf):
    return _mentions13f(spark, sf).select("institution", "publication_date", "report_title", "ticker", "company_name", "view_direction", "confidence", "evidence", "chunk_id")


@query("h5_mention_texts")
def h5_text(spark, sf):
    return _mentions13f(spark, sf).select("chunk_id", "institutional_view")


def _mentions13f(spark, sf):
    ch = bv.book_changes(spark, sf)
    who = bv.filings(bv.holdings(spark, sf)).select("cik").distinct().withColumn("institution", F.concat(F.lit("Filer "), F.col("cik").cast("string")))
    return hd.build_mentions(ch, hd.select_positions(ch), bv.cusip_map(spark, sf), who)


@query("h6_universe_history", f"SELECT filing_date, report_date, cik, accession, cusip, ticker, status, view_direction, confidence, {rounded('value weight adjusted_change')} FROM uhist")
def h6(spark, sf):
    h = bv.holdings(spark, sf)
    return tidy(hd.universe_history(h, bv.filings(h), bv.cusip_map(spark, sf)).drop("company_name"))


VIEWS["phist"] = f"""
SELECT s.filing_date, s.report_date, s.cik, s.accession, s.cusip, m.ticker, s.status, s.value, s.weight, s.adjusted_change FROM changes s LEFT JOIN cusip_map m ON m.cusip = s.cusip
WHERE s.cik < 5 AND coalesce(m.security_type NOT IN ({_FUNDS}), true)"""


def _positions(spark, sf):
    h = bv.holdings(spark, sf)
    return hd.position_history(h, bv.filings(h), bv.cusip_map(spark, sf), h.filter(F.col("cik") < 5).select("cik"))


@query("h7_position_history", f"SELECT filing_date, report_date, cik, accession, cusip, ticker, status, {rounded('value weight adjusted_change')} FROM phist")
def h7(spark, sf):
    return tidy(_positions(spark, sf))


@query("h8_pit_universe", f"""
WITH r AS (SELECT l.date, h.* FROM uhist h JOIN live l ON l.cik = h.cik AND l.accession = h.accession)
SELECT date, ticker, min(cusip) AS cusip, count(DISTINCT cik) AS institution_count, {_SCORE} AS institutional_direction_score FROM r WHERE ticker IS NOT NULL GROUP BY date, ticker
UNION ALL SELECT date, NULL, cusip, count(DISTINCT cik), NULL FROM r WHERE ticker IS NULL GROUP BY date, cusip""")
def h8(spark, sf):
    return tidy(hd.pit_universe(bv.universe_history(spark, sf), bv.month_end_dates(spark, sf)))


VIEWS["books"] = """
SELECT l.date, h.cusip, sum(h.value * 1000) AS total_13f_value, count(DISTINCT h.cik) AS holders FROM holdings h JOIN live l ON l.cik = h.cik AND l.accession = h.accession GROUP BY 1, 2"""
VIEWS["broad"] = f"""
WITH c AS (SELECT *, round(total_13f_value, 2) AS v FROM books),
n AS (SELECT c.*, m.ticker, coalesce(m.ticker, 'CUSIP:' || c.cusip) AS key FROM c LEFT JOIN cusip_map m USING (cusip) WHERE coalesce(m.security_type NOT IN ({_FUNDS}), true)),
g AS (SELECT date, key, any_value(ticker) AS ticker, arg_max(cusip, v) AS cusip, round(sum(v), 2) AS total_13f_value, max(holders) AS institution_count FROM n GROUP BY 1, 2),
t AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY date ORDER BY total_13f_value DESC, key) <= 40),
d AS (SELECT l.date, h.ticker, {_SCORE} AS score FROM uhist h JOIN live l ON l.cik = h.cik AND l.accession = h.accession WHERE h.ticker IS NOT NULL GROUP BY 1, 2)
SELECT t.date, t.ticker, t.cusip, t.institution_count, CASE WHEN t.ticker IS NOT NULL THEN coalesce(d.score, 0) END AS institutional_direction_score, t.total_13f_value
FROM t LEFT JOIN d ON d.date = t.date AND d.ticker = t.ticker"""


@query("h9_pit_broad_universe", "SELECT date, ticker, cusip, institution_count, institutional_direction_score + 0.0 AS institutional_direction_score, round(total_13f_value, 0) + 0.0 AS total_13f_value FROM broad")
def h9(spark, sf):
    h = bv.holdings(spark, sf)
    return tidy(hd.pit_broad_universe(h, bv.universe_history(spark, sf), bv.filings(h), bv.month_end_dates(spark, sf), bv.cusip_map(spark, sf), 40)
                .withColumn("total_13f_value", F.round("total_13f_value", 0)))


@query("h10_book_values", "SELECT date, cusip, round(total_13f_value, 0) + 0.0 AS total_13f_value, holders, round(total_13f_value / 0.2, -1) + 0.0 AS rough_mcap FROM books")
def h10(spark, sf):
    h = bv.holdings(spark, sf)
    x = hd.book_values(h, bv.filings(h), bv.month_end_dates(spark, sf))
    return x.select("date", "cusip", (F.round("total_13f_value", 0) + F.lit(0.0)).alias("total_13f_value"), "holders", (F.round("rough_mcap", -1) + F.lit(0.0)).alias("rough_mcap"))


@query("h11_active_manager_features", """
WITH k AS (SELECT ticker, date FROM panel), f AS (SELECT DISTINCT cik, accession, filing_date FROM phist WHERE ticker IS NOT NULL),
l AS (SELECT d.date, f.cik, f.accession FROM (SELECT DISTINCT date FROM k) d JOIN f ON f.filing_date <= d.date AND f.filing_date >= d.date - 200
  QUALIFY row_number() OVER (PARTITION BY d.date, f.cik ORDER BY f.filing_date DESC) = 1),
p AS (SELECT l.date, h.ticker, max(CASE WHEN status IN ('NEW', 'ADDED') THEN 1.0::DOUBLE ELSE 0.0 END) AS a, max(weight) AS w FROM phist h JOIN l ON l.cik = h.cik AND l.accession = h.accession
  WHERE h.ticker IS NOT NULL GROUP BY 1, 2)
SELECT k.ticker, k.date, CASE WHEN k.date IN (SELECT date FROM l) THEN coalesce(a, 0) END AS active_new_or_add, round(CASE WHEN k.date IN (SELECT date FROM l) THEN coalesce(w, 0) END, 6) + 0.0 AS active_weight_max
FROM k LEFT JOIN p ON p.date = k.date AND p.ticker = k.ticker""")
def h11(spark, sf):
    return tidy(hd.active_manager_features(bv.panel(spark, sf).select("ticker", "date"), _positions(spark, sf)))


@query("h12_ownership_breadth", """
WITH m AS (SELECT b.date, 'S' || substr(b.cusip, 2) AS ticker, holders FROM books b)
SELECT date, ticker, holders, holders - lag(holders, 3) OVER (PARTITION BY ticker ORDER BY date) AS breadth_change FROM m""")
def h12(spark, sf):
    h = bv.holdings(spark, sf)
    m = hd.book_values(h, bv.filings(h), bv.month_end_dates(spark, sf)).select("date", F.concat(F.lit("S"), F.expr("substring(cusip, 2)")).alias("ticker"), "holders")
    return hd.ownership_breadth_change(m, 3)


@query("h13_direction", f"SELECT ticker, {_SCORE} AS score, {_label()} AS label FROM mentions GROUP BY ticker")
def h13(spark, sf):
    score, label = hd.aggregate_direction()
    return tidy(bv.mentions(spark, sf).groupBy("ticker").agg(score.alias("score"), label.alias("label")))


@query("h14_institution_count", f"""
SELECT p.ticker, p.date, u.n AS institution_count FROM panel p LEFT JOIN (SELECT l.date, h.ticker, count(DISTINCT h.cik) AS n FROM uhist h JOIN
  (SELECT d.date, f.cik, f.accession FROM (SELECT DISTINCT date FROM panel) d JOIN filings f ON f.filing_date <= d.date AND f.filing_date >= d.date - 200
   QUALIFY row_number() OVER (PARTITION BY d.date, f.cik ORDER BY f.filing_date DESC) = 1) l ON l.cik = h.cik AND l.accession = h.accession WHERE h.ticker IS NOT NULL GROUP BY 1, 2) u
ON u.date = p.date AND u.ticker = p.ticker""")
def h14(spark, sf):
    p = bv.panel(spark, sf).select("ticker", "date")
    return hd.with_institution_count(p, hd.pit_universe(bv.universe_history(spark, sf), p.select("date").distinct()))


@query("h15_refresh_summary", f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY report_date DESC) AS q FROM filings)
SELECT u.cik, u.accession, count(*) AS mentions, count(*) FILTER (status = 'NEW') AS "new", count(*) FILTER (status = 'EXITED') AS exited, count(*) FILTER (u.ticker IS NULL) AS unresolved
FROM uhist u JOIN r ON r.cik = u.cik AND r.accession = u.accession AND r.q = 1 GROUP BY 1, 2""")
def h15(spark, sf):
    h = bv.holdings(spark, sf)
    return hd.refresh_summary(h, bv.filings(h), bv.cusip_map(spark, sf))[1]


# --- I, E1: insiders --------------------------------------------------------------------------------------------

VIEWS["txv"] = "SELECT accession, trans_code, trans_date, shares, price, min(issuer_cik) AS issuer_cik, min(filing_date) AS filing_date, max(value) AS value FROM tx GROUP BY 1, 2, 3, 4, 5"


@query("i1_insider_features", """
WITH k AS (SELECT p.ticker, p.date, CASE WHEN p.date <= DATE '2000-12-31' THEN m.issuer_cik END AS ik, ln(p.close * 1e6) AS lm FROM panel p LEFT JOIN issuer_map m ON m.ticker = p.ticker),
b AS (SELECT k.ticker, k.date, count(DISTINCT t.owner_cik) AS n FROM k LEFT JOIN tx t ON t.issuer_cik = k.ik AND t.filing_date <= k.date AND t.filing_date > k.date - 90 AND t.trans_code = 'P' GROUP BY 1, 2),
v AS (SELECT k.ticker, k.date, coalesce(sum(CASE trans_code WHEN 'P' THEN value WHEN 'S' THEN -value END), 0) AS net FROM k LEFT JOIN txv t ON t.issuer_cik = k.ik AND t.filing_date <= k.date AND t.filing_date > k.date - 90 GROUP BY 1, 2)
SELECT k.ticker, k.date, CASE WHEN ik IS NOT NULL THEN CAST(n AS DOUBLE) END AS insider_buyers_90d, round(CASE WHEN ik IS NOT NULL THEN net / exp(lm) END, 6) + 0.0 AS insider_net_buy_value_90d_mcap,
  CASE WHEN ik IS NOT NULL THEN CASE WHEN n >= 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS insider_cluster_buy
FROM k JOIN b ON b.ticker = k.ticker AND b.date = k.date JOIN v ON v.ticker = k.ticker AND v.date = k.date""")
def i1(spark, sf):
    keys = bv.panel(spark, sf).select("ticker", "date", F.log(F.col("close") * 1e6).alias("log_market_cap"))
    return tidy(ins.insider_features(keys, bv.transactions(spark, sf), bv.issuer_map(spark, sf), "2000-12-31").drop("log_market_cap"))


VIEWS["e1_days"] = """
WITH d AS (SELECT DISTINCT issuer_cik, filing_date FROM tx WHERE trans_code = 'P'),
b AS (SELECT d.issuer_cik, d.filing_date, count(DISTINCT t.owner_cik) AS n FROM d JOIN tx t ON t.issuer_cik = d.issuer_cik AND t.trans_code = 'P' AND t.filing_date <= d.filing_date AND t.filing_date > d.filing_date - 30 GROUP BY 1, 2),
p AS (SELECT accession, trans_date, shares, price, min(issuer_cik) AS issuer_cik, min(filing_date) AS filing_date, max(value) AS value FROM tx WHERE trans_code = 'P' GROUP BY 1, 2, 3, 4)
SELECT b.issuer_cik, b.filing_date AS day, b.n, (SELECT sum(value) FROM p WHERE p.issuer_cik = b.issuer_cik AND p.filing_date <= b.filing_date AND p.filing_date > b.filing_date - 30) AS v FROM b WHERE n >= 3"""


@query("e1_insider_cluster_events", """
WITH RECURSIVE c AS (SELECT *, row_number() OVER (PARTITION BY issuer_cik ORDER BY day) AS rn FROM e1_days),
f AS (SELECT issuer_cik, day, rn, day AS last_kept, true AS kept FROM c WHERE rn = 1
  UNION ALL SELECT c.issuer_cik, c.day, c.rn, CASE WHEN c.day - f.last_kept > 90 THEN c.day ELSE f.last_kept END, c.day - f.last_kept > 90 FROM f JOIN c ON c.issuer_cik = f.issuer_cik AND c.rn = f.rn + 1)
SELECT f.day AS signal_date, m.ticker, round(e.n + e.v / 1e10, 6) + 0.0 AS strength FROM f JOIN e1_days e ON e.issuer_cik = f.issuer_cik AND e.day = f.day JOIN issuer_map m ON m.issuer_cik = f.issuer_cik WHERE kept""")
def e1(spark, sf):
    return tidy(ins.insider_cluster_events(bv.transactions(spark, sf), bv.issuer_map(spark, sf)))


# --- G: universe ------------------------------------------------------------------------------------------------

def _mode(col: str) -> str:
    return f"(SELECT {col} FROM mentions z WHERE z.ticker = m.ticker AND {col} IS NOT NULL GROUP BY {col} ORDER BY count(*) DESC, {col} LIMIT 1)"


@query("g1_build_universe", f"""
WITH u AS (SELECT ticker, array_to_string(list_sort(list(DISTINCT theme) FILTER (theme <> '')), '|') AS themes, count(DISTINCT institution) AS institution_count, count(*) AS institutional_mentions,
  {_label()} AS institutional_direction, {_SCORE} AS institutional_direction_score, max(publication_date) AS latest_mention_date FROM mentions WHERE ticker IS NOT NULL GROUP BY ticker),
c AS (SELECT ticker, arg_min(company_name, (-n, company_name)) AS company_name FROM (SELECT ticker, company_name, count(*) AS n FROM mentions GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT ticker, arg_min(sector, (-n, sector)) AS sector FROM (SELECT ticker, sector, count(*) AS n FROM mentions GROUP BY 1, 2) GROUP BY 1),
r AS (SELECT ticker, arg_min(region, (-n, region)) AS region FROM (SELECT ticker, region, count(*) AS n FROM mentions GROUP BY 1, 2) GROUP BY 1)
SELECT u.*, c.company_name, s.sector, r.region FROM u JOIN c USING (ticker) JOIN s USING (ticker) JOIN r USING (ticker)""")
def g1(spark, sf):
    return tidy(un.build_universe(bv.mentions(spark, sf)).withColumn("themes", F.concat_ws("|", "themes")))


@query("g2_theme_summary", """
SELECT theme, count(DISTINCT institution) AS institution_count, count(*) AS mention_count, len(list(DISTINCT ticker) FILTER (ticker <> '')) AS companies,
  list_sort(list(DISTINCT ticker) FILTER (ticker <> ''))[1] AS first_company FROM mentions WHERE theme IS NOT NULL GROUP BY theme""")
def g2(spark, sf):
    return un.theme_summary(bv.mentions(spark, sf))


@query("g2_theme_companies", "SELECT DISTINCT theme, ticker FROM mentions WHERE theme IS NOT NULL AND ticker <> ''")
def g2b(spark, sf):
    return un.theme_companies(bv.mentions(spark, sf))


@query("g3_why_in_universe", "SELECT institution, report_title, publication_date, theme, view_direction, chunk_id FROM mentions WHERE ticker = 'S000000007'")
def g3(spark, sf):
    return un.why_in_universe(bv.mentions(spark, sf), "s000000007").select("institution", "report_title", "publication_date", "theme", "view_direction", "chunk_id")


_SS = "CASE WHEN sum(strength) = 0 THEN 0 ELSE sum(CASE direction WHEN 'positive' THEN strength WHEN 'negative' THEN -strength ELSE 0 END) / sum(strength) END"


@query("g4_signal_scores", f"SELECT ticker, signal_type, count(*) AS count, round(avg(strength), 6) + 0.0 AS avg_strength, round({_SS}, 6) + 0.0 AS score FROM signals GROUP BY 1, 2")
def g4(spark, sf):
    return tidy(un.company_research(bv.signals(spark, sf))[0])


@query("g5_company_research", f"""
WITH h AS (SELECT ticker, count(*) AS signal_count, round({_SS}, 6) + 0.0 AS research_score, max(filing_date) AS data_freshness FROM signals GROUP BY 1),
r AS (SELECT ticker, string_agg(evidence, '|' ORDER BY strength DESC, evidence) AS risks FROM (SELECT * FROM signals WHERE signal_type = 'risk'
  QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY strength DESC, evidence) <= 5) GROUP BY 1),
c AS (SELECT ticker, string_agg(evidence, '|' ORDER BY strength DESC, evidence) AS catalysts FROM (SELECT * FROM signals WHERE direction = 'positive' AND strength >= 0.6
  QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY strength DESC, evidence) <= 5) GROUP BY 1)
SELECT h.*, coalesce(risks, '') AS risks, coalesce(catalysts, '') AS catalysts FROM h LEFT JOIN r USING (ticker) LEFT JOIN c USING (ticker)""")
def g5(spark, sf):
    x = un.company_research(bv.signals(spark, sf))[1]
    return tidy(x.withColumn("risks", F.concat_ws("|", "risks")).withColumn("catalysts", F.concat_ws("|", "catalysts")))


@query("g6_universe_coverage", """
WITH m AS (SELECT b.date, CASE WHEN c.ticker IS NOT NULL THEN 'S' || substr(b.cusip, 2) END AS ticker FROM books b LEFT JOIN cusip_map c USING (cusip)),
p AS (SELECT date, ticker, fwd_excess FROM panel), j AS (SELECT m.*, p.ticker IS NOT NULL AS pr, p.fwd_excess IS NOT NULL AS lb, year(m.date) AS year FROM m LEFT JOIN p ON p.date = m.date AND p.ticker = m.ticker),
n AS (SELECT year, count(*) AS k FROM (SELECT year, ticker, bool_or(pr) AS e FROM j WHERE ticker IS NOT NULL GROUP BY 1, 2) WHERE NOT e GROUP BY 1)
SELECT CAST(j.year AS INTEGER) AS year, count(DISTINCT date) AS dates, round(avg((ticker IS NOT NULL)::INT), 6) + 0.0 AS pct_with_ticker, round(avg(pr::INT), 6) + 0.0 AS pct_priced,
  round(avg(lb::INT), 6) + 0.0 AS pct_labelled, count(DISTINCT ticker) AS tickers, coalesce(any_value(n.k), 0) AS tickers_never_priced, round(count(*) / count(DISTINCT date), 6) + 0.0 AS avg_members_per_date
FROM j LEFT JOIN n ON n.year = j.year GROUP BY j.year""")
def g6(spark, sf):
    h = bv.holdings(spark, sf)
    m = hd.book_values(h, bv.filings(h), bv.month_end_dates(spark, sf)).join(bv.cusip_map(spark, sf).select("cusip", F.col("ticker").alias("_t")), "cusip", "left")
    m = m.select("date", F.when(F.col("_t").isNotNull(), F.concat(F.lit("S"), F.expr("substring(cusip, 2)"))).alias("ticker"))
    return tidy(un.universe_coverage(m, bv.panel(spark, sf)).withColumn("tickers_never_priced", F.coalesce("tickers_never_priced", F.lit(0))))


_CALLS = """calls AS (SELECT event_id, CASE user_id % 4 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' WHEN 2 THEN 'ollama' ELSE 'other' END AS provider, 'm' || (user_id % 3) AS model,
  event_type = 'view' AS cache_hit, CASE WHEN event_id % 9 <> 0 THEN CAST(floor(value * 100) AS BIGINT) END AS input_tokens, CAST(floor(value * 10) AS BIGINT) AS output_tokens FROM events),
rates AS (SELECT * FROM (VALUES ('alpha', 'm0', 0.5::DOUBLE, 1.5::DOUBLE), ('alpha', 'm1', 0.25::DOUBLE, 1.0::DOUBLE), ('beta', 'm2', 2.0::DOUBLE, 8.0::DOUBLE)) v(provider, model, ri, ro)),
costed AS (SELECT c.*, CASE WHEN input_tokens IS NULL THEN NULL WHEN c.provider = 'ollama' THEN 0 ELSE round(input_tokens / 1000 * ri + output_tokens / 1000 * ro, 6) END AS cost FROM calls c LEFT JOIN rates USING (provider, model))"""


def _calls(spark, sf):
    u = F.col("user_id")
    calls = bv.table(spark, sf, "events").select(
        "event_id", F.when(u % 4 == 0, "alpha").when(u % 4 == 1, "beta").when(u % 4 == 2, "ollama").otherwise("other").alias("provider"),
        F.concat(F.lit("m"), (u % 3).cast("string")).alias("model"), (F.col("event_type") == "view").alias("cache_hit"),
        F.when(F.col("event_id") % 9 != 0, F.floor(F.col("value") * 100)).alias("input_tokens"), F.floor(F.col("value") * 10).alias("output_tokens"))
    rates = spark.createDataFrame([("alpha", "m0", 0.5, 1.5), ("alpha", "m1", 0.25, 1.0), ("beta", "m2", 2.0, 8.0)], "provider string, model string, input_rate double, output_rate double")
    return un.call_cost(calls, rates)


@query("g7_g9_usage_and_cost", f"WITH {_CALLS} SELECT provider, count(*) AS rows, count(*) FILTER (cache_hit) AS cache_hits, count(*) FILTER (NOT cache_hit) AS calls, "
       "round(coalesce(sum(cost), 0), 6) + 0.0 AS known_cost FROM costed GROUP BY provider")
def g7(spark, sf):
    c = _calls(spark, sf)
    parts = [un.usage_summary(c.filter(F.col("provider") == p)).withColumn("provider", F.lit(p)) for p in ("alpha", "beta", "ollama", "other")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return tidy(out)


@query("g8_candidate_pick", """
WITH c AS (SELECT o_custkey AS identifier, CASE o_orderkey % 6 WHEN 0 THEN 'US' WHEN 1 THEN 'UN' WHEN 2 THEN 'UW' ELSE 'LN' END AS exch_code, 'tk/' || (o_orderkey % 50) AS ticker, o_orderkey FROM orders)
SELECT identifier, arg_min(exch_code, (r, o_orderkey)) AS exch_code, arg_min(CASE WHEN r < 2 THEN replace(upper(ticker), '/', '-') ELSE ticker END, (r, o_orderkey)) AS ticker,
  CASE WHEN min(r) < 2 THEN 'high' ELSE 'best_effort' END AS confidence FROM (SELECT *, CASE WHEN exch_code = 'US' THEN 0 WHEN exch_code IN ('UN', 'UW') THEN 1 ELSE 2 END AS r FROM c) GROUP BY 1""")
def g8(spark, sf):
    k = F.col("o_orderkey")
    c = bv.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("identifier"), F.when(k % 6 == 0, "US").when(k % 6 == 1, "UN").when(k % 6 == 2, "UW").otherwise("LN").alias("exch_code"),
        F.concat(F.lit("tk/"), (k % 50).cast("string")).alias("ticker"), F.lit("n").alias("name"), F.lit("Common Stock").alias("security_type"), k.alias("input_order"))
    return un.pick_candidate(c).select("identifier", "exch_code", "ticker", "confidence")


@query("g10_universe_tickers", "SELECT DISTINCT upper(ticker) AS ticker FROM mentions WHERE ticker IS NOT NULL AND trim(ticker) <> ''")
def g10(spark, sf):
    return un.universe_tickers(bv.mentions(spark, sf))
