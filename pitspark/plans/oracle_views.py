"""SQL text of the benchmark views (the counterpart of ``sources.bench``) and of shared intermediates.

``with_views`` puts the views a statement names, and the views those name, in front of it.
"""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {}

VIEWS["bars_wk"] = """
SELECT l_suppkey AS k, CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
       CAST(sum(CAST(floor(l_extendedprice / l_quantity * 100) AS BIGINT)) AS DOUBLE) AS s, count(*) AS n,
       min(CAST(floor(l_extendedprice / l_quantity * 100) AS BIGINT)) AS lo,
       max(CAST(floor(l_extendedprice / l_quantity * 100) AS BIGINT)) AS hi,
       CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS volume
FROM lineitem WHERE l_quantity > 0 GROUP BY 1, 2"""
VIEWS["bars_z"] = """
SELECT *, sum(s) OVER (PARTITION BY k) / sum(n) OVER (PARTITION BY k) AS m,
       s / n / (sum(s) OVER (PARTITION BY k) / sum(n) OVER (PARTITION BY k)) - 1 AS z FROM bars_wk"""
VIEWS["bars_c"] = """
SELECT *, round(100 * exp(0.05 * sum(z) OVER (PARTITION BY k ORDER BY date ROWS UNBOUNDED PRECEDING)), 2) AS close,
       greatest(abs(hi / m - 1), abs(lo / m - 1)) AS shock FROM bars_z"""
VIEWS["bars_o"] = """
SELECT *, coalesce(lag(close) OVER (PARTITION BY k ORDER BY date), 100.0) AS open FROM bars_c"""
VIEWS["bars"] = """
SELECT 'S' || lpad(CAST(k AS VARCHAR), 9, '0') AS ticker, date, open,
       round(greatest(open, close) * (1 + 0.01 * shock), 2) AS high, round(least(open, close) * (1 - 0.01 * shock), 2) AS low,
       close, volume, close AS close_split_adj,
       CASE WHEN (k + weekofyear(date)) % 97 = 0 THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END AS split FROM bars_o"""
VIEWS["cal"] = "SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS pos FROM (SELECT DISTINCT date FROM bars)"
VIEWS["bench"] = """
SELECT b.date, c.pos, sum(CAST(round(open * 100) AS BIGINT)) / count(*) / 100 AS open, sum(CAST(round(high * 100) AS BIGINT)) / count(*) / 100 AS high,
       sum(CAST(round(low * 100) AS BIGINT)) / count(*) / 100 AS low, sum(CAST(round(close * 100) AS BIGINT)) / count(*) / 100 AS close,
       sum(volume) AS volume
FROM bars b JOIN cal c ON b.date = c.date GROUP BY b.date, c.pos"""
VIEWS["grid"] = """
SELECT t.ticker, c.date, c.pos, b.open, b.high, b.low, b.close
FROM (SELECT DISTINCT ticker FROM bars) t CROSS JOIN cal c LEFT JOIN bars b ON b.ticker = t.ticker AND b.date = c.date"""
VIEWS["bars_i"] = """
SELECT *, close / lag(close) OVER w - 1 AS ret, close - lag(close) OVER w AS delta,
       greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr,
       row_number() OVER w AS rn
FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)"""
VIEWS["daily"] = """
SELECT user_id AS ticker, CAST(ts AS DATE) AS date, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
       arg_max(value, (ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2"""
VIEWS["filled"] = """
SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY pos ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS close_filled FROM grid"""
VIEWS["fwd8"] = """
SELECT f.ticker, f.date, f.pos, CASE WHEN s0 <> 0 AND s1 <> 0 AND b0 <> 0 AND b1 <> 0 THEN s1 / s0 - 1 END AS fwd_return,
       CASE WHEN s0 <> 0 AND s1 <> 0 AND b0 <> 0 AND b1 <> 0 THEN (s1 / s0 - 1) - (b1 / b0 - 1) END AS fwd_excess
FROM (SELECT ticker, date, pos, lead(close_filled, 1) OVER w AS s0, lead(close_filled, 9) OVER w AS s1 FROM filled
      WINDOW w AS (PARTITION BY ticker ORDER BY pos)) f
LEFT JOIN (SELECT pos, lead(close, 1) OVER (ORDER BY pos) AS b0, lead(close, 9) OVER (ORDER BY pos) AS b1 FROM bench) b ON f.pos = b.pos"""
VIEWS["panel0"] = """
SELECT ticker, date, close, volume, close / lag(close, 4) OVER w - 1 AS return_4w, close / lag(close, 12) OVER w - 1 AS return_12w,
       close / lag(close, 52) OVER w - 1 AS return_52w,
       CASE WHEN count(ret) OVER w12 = 12 THEN stddev_samp(ret) OVER w12 * sqrt(252.0::DOUBLE) END AS volatility_12w,
       CASE WHEN count(*) OVER p12 = 12 THEN volume / avg(volume) OVER p12 END AS volume_ratio,
       CASE WHEN count(close) OVER w20 = 20 THEN close / avg(close) OVER w20 - 1 END AS price_vs_ma20,
       lag(close, 4) OVER w / lag(close, 52) OVER w - 1 AS momentum
FROM bars_i WINDOW w AS (PARTITION BY ticker ORDER BY date), w12 AS (PARTITION BY ticker ORDER BY date ROWS 11 PRECEDING),
     p12 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING),
     w20 AS (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING)"""
VIEWS["panel"] = """
SELECT p.ticker, p.date, p.close, p.volume, round(return_4w, 8) AS return_4w, round(return_12w, 8) AS return_12w, round(return_52w, 8) AS return_52w,
       round(volatility_12w, 8) AS volatility_12w, round(volume_ratio, 8) AS volume_ratio, round(price_vs_ma20, 8) AS price_vs_ma20,
       round(momentum, 8) AS momentum, f.pos, round(fwd_return, 8) AS fwd_return, round(fwd_excess, 8) AS fwd_excess,
       round(0.5 * momentum - return_4w, 8) AS score
FROM panel0 p JOIN (SELECT date FROM cal WHERE pos >= 60 AND (pos - 60) % 4 = 0) r ON p.date = r.date
LEFT JOIN fwd8 f ON f.ticker = p.ticker AND f.date = p.date"""
VIEWS["holdings"] = """
SELECT cik, report_date, '13F-' || cik || '-' || strftime(report_date, '%Y%m%d') AS accession,
       report_date + CAST(20 + cik AS INTEGER) AS filing_date, 'C' || lpad(CAST(s AS VARCHAR), 9, '0') AS cusip,
       'Issuer ' || s AS name_of_issuer, 'COM' AS title_of_class, CAST(sh AS DOUBLE) AS shares, CAST(v AS DOUBLE) / 100 AS value
FROM (SELECT CAST(c_nationkey AS BIGINT) AS cik, last_day(CAST(date_trunc('quarter', o_orderdate) AS DATE) + INTERVAL 2 MONTH) AS report_date,
             l_suppkey AS s, sum(CAST(l_quantity AS BIGINT)) AS sh, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS v
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3)"""
VIEWS["filings"] = "SELECT DISTINCT cik, accession, filing_date, report_date FROM holdings"
VIEWS["cusip_map"] = """
SELECT 'C' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS cusip,
       CASE WHEN s_suppkey % 11 <> 0 THEN 'S' || lpad(CAST(CASE WHEN s_suppkey % 17 = 0 THEN s_suppkey + 1 ELSE s_suppkey END AS VARCHAR), 9, '0') END AS ticker,
       CASE WHEN s_suppkey % 13 = 0 THEN 'ETP' ELSE 'Common Stock' END AS security_type FROM supplier"""
VIEWS["tx"] = """
SELECT CAST(o_orderkey - o_orderkey % 2 AS VARCHAR) AS accession, CAST(o_orderdate AS DATE) AS filing_date,
       CAST(o_orderdate AS DATE) - 2 AS trans_date, o_custkey % (SELECT count(*) FROM supplier) AS issuer_cik, o_custkey AS owner_cik,
       o_orderstatus = 'F' AS is_director, o_orderstatus <> 'F' AS is_officer,
       CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN 'P' ELSE 'S' END AS trans_code, CAST(o_custkey % 500 + 1 AS DOUBLE) AS shares,
       CAST(round(o_totalprice * 100) AS BIGINT) / 100 / (o_custkey % 500 + 1) AS price, CAST(round(o_totalprice * 100) AS BIGINT) / 100 AS value
FROM orders"""
VIEWS["issuer_map"] = """
SELECT 'S' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS ticker, s_suppkey AS issuer_cik FROM supplier WHERE s_suppkey % 19 <> 18"""
VIEWS["facts_q"] = """
SELECT *, date_trunc('quarter', "end")::DATE AS q0, date_trunc('year', "end")::DATE AS y0, "end" + CAST(30 + cik % 20 AS INTEGER) AS filed,
       CASE WHEN month("end") = 12 THEN '10-K' ELSE '10-Q' END AS form,
       sum(ocf) OVER ytd AS ocf_ytd, sum(qty * 1000.0::DOUBLE) OVER ytd AS capex_ytd
FROM (SELECT *, rev * (8 - disc / n) / 100 AS ni, rev * (10 - disc / n - tax / n) / 100 AS ocf
      FROM (SELECT l_suppkey AS cik, last_day(CAST(date_trunc('quarter', o_orderdate) AS DATE) + INTERVAL 2 MONTH) AS "end",
                   CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) AS rev, CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) AS disc,
                   CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) AS tax, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS qty, count(*) AS n
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2))
WINDOW ytd AS (PARTITION BY cik, year("end") ORDER BY "end" ROWS UNBOUNDED PRECEDING)"""
VIEWS["raw_facts"] = """
SELECT cik, ns, tag, start, "end", floor(val * 100) / 100 AS val, filed, form FROM (
  SELECT cik, form, "end", 'us-gaap' AS ns, 'Revenues' AS tag, q0 AS start, rev / 100 AS val, filed FROM facts_q
  UNION ALL SELECT cik, form, "end", 'us-gaap', 'SalesRevenueNet', q0, rev / 100 * 1.01::DOUBLE, filed + 365 FROM facts_q
  UNION ALL SELECT cik, form, "end", 'us-gaap', 'NetIncomeLoss', q0, ni / 100, filed FROM facts_q
  UNION ALL SELECT cik, form, "end", 'us-gaap', 'NetCashProvidedByUsedInOperatingActivities', y0, ocf_ytd / 100, filed FROM facts_q
  UNION ALL SELECT cik, form, "end", 'us-gaap', 'PaymentsToAcquirePropertyPlantAndEquipment', y0, capex_ytd / 100, filed FROM facts_q
  UNION ALL SELECT cik, form, "end", 'us-gaap', 'EarningsPerShareDiluted', q0, ni / 100 / (1000 + cik), filed FROM facts_q
  UNION ALL SELECT cik, form, "end", 'dei', 'EntityCommonStockSharesOutstanding', NULL, (1000 + cik) * 1000.0::DOUBLE, filed FROM facts_q
  UNION ALL SELECT cik, form, "end", 'us-gaap', 'CashAndCashEquivalentsAtCarryingValue', NULL, qty * 500.0::DOUBLE, filed FROM facts_q
  UNION ALL SELECT cik, form, "end", 'us-gaap', 'StockholdersEquity', NULL, rev / 50, filed FROM facts_q
  UNION ALL SELECT cik, form, "end", 'us-gaap', 'Assets', NULL, rev / 20, filed FROM facts_q
  UNION ALL SELECT cik, form, "end", 'us-gaap', 'LongTermDebt', NULL, rev / 400, filed FROM facts_q WHERE cik % 3 = 0
  UNION ALL SELECT cik, form, "end", 'us-gaap', 'LongTermDebtNoncurrent', NULL, rev / 500, filed FROM facts_q WHERE cik % 3 = 1
  UNION ALL SELECT cik, form, "end", 'us-gaap', 'ShortTermBorrowings', NULL, rev / 900, filed FROM facts_q WHERE cik % 2 = 1)"""
VIEWS["mentions"] = """
SELECT 'Inst ' || (o_custkey % 25) AS institution, 'Report ' || o_orderkey AS report_title, CAST(o_orderdate AS DATE) AS publication_date,
       CASE WHEN o_orderkey % 5 <> 0 THEN substr(o_orderpriority, 3, 20) END AS theme, c_mktsegment AS sector, 'R' || (c_nationkey % 5) AS region,
       'Company ' || (o_custkey % 300) AS company_name,
       CASE WHEN o_orderkey % 7 <> 0 THEN 'S' || lpad(CAST(o_custkey % 300 AS VARCHAR), 9, '0') END AS ticker,
       CASE o_orderstatus WHEN 'F' THEN 'POSITIVE' WHEN 'O' THEN 'NEGATIVE' ELSE 'MENTIONED' END AS view_direction,
       'M' || o_orderkey AS chunk_id, 'evidence ' || (o_orderkey % 1000) AS evidence
FROM orders JOIN customer ON o_custkey = c_custkey"""
VIEWS["signals"] = """
SELECT 'U' || user_id AS ticker, event_id, CAST(ts AS DATE) AS filing_date,
       CASE event_type WHEN 'error' THEN 'risk' WHEN 'purchase' THEN 'earnings' WHEN 'signup' THEN 'demand' WHEN 'view' THEN 'guidance' ELSE 'margins' END AS signal_type,
       CASE WHEN value > 60 THEN 'positive' WHEN value < 25 THEN 'negative' ELSE 'neutral' END AS direction,
       least(1.0::DOUBLE, floor(value) / 100) AS strength, 'chunk ' || (event_id // 20) AS chunk_id, 'e' || event_id AS evidence FROM events"""
VIEWS["sections"] = """
SELECT CAST(regexp_extract(source, '([0-9]+)', 1) AS BIGINT) AS cik, 'A' || doc_id AS accession,
       CASE WHEN (doc_id // 20) % 4 = 3 THEN '10-K' ELSE '10-Q' END AS form,
       DATE '2008-01-15' + CAST((doc_id // 20) % 40 * 91 + doc_id % 20 % 3 + CASE WHEN doc_id % 23 = 7 THEN 130 ELSE 0 END AS INTEGER) AS filing_date,
       CASE WHEN doc_id % 9 <> 0 THEN DATE '2008-01-15' + CAST((doc_id // 20) % 40 * 91 + doc_id % 20 % 3 AS INTEGER) - 40 END AS report_date,
       text AS risk_factors, CASE WHEN doc_id % 6 <> 0 THEN reverse(text) END AS mdna
FROM documents"""

VIEWS["stm_q"] = """
SELECT 'S' || lpad(CAST(k AS VARCHAR), 9, '0') AS ticker, k, y, make_date(y, 12, 31) AS period_end, rev / 100 AS rev, disc / n AS dn, tax / n AS tn, qty, rev / 100 * (8 - disc / n) / 100 AS ni
FROM (SELECT l_suppkey AS k, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) AS rev, CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) AS disc,
  CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) AS tax, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS qty, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""
# Fields as the first-present rule resolves them; a name reported twice for a period counts with the larger value.
VIEWS["fund_items"] = """
SELECT ticker, k, period_end, CASE WHEN k % 9 = 0 AND k % 4 = 3 THEN greatest(rev, rev * 2) ELSE rev END AS revenue, rev * 0.4 - qty AS gross_profit, rev * 0.2 - qty * 2 AS operating_income, CASE WHEN (k + y) % 13 <> 0 THEN ni END AS net_income, ni / (1000 + k) AS eps,
  -qty * 3 AS interest_expense, qty * 5 AS tax_provision, rev * 0.15 AS pretax_income, rev * (10 - tn) / 100 AS ocf, -qty * 100 AS capex, CASE WHEN k % 3 = 0 AND y > 1996 THEN rev * 0.05 END AS own_fcf,
  qty * 500 AS cash, rev * 0.5 AS equity, CASE WHEN k % 7 <> 0 THEN rev * 0.1 END AS debt FROM stm_q"""
VIEWS["fund_m"] = """
SELECT *, (revenue - lag(revenue) OVER w) / abs(lag(revenue) OVER w) AS revenue_growth, (eps - lag(eps) OVER w) / abs(lag(eps) OVER w) AS eps_growth,
  (operating_income - lag(operating_income) OVER w) / abs(lag(operating_income) OVER w) AS operating_income_growth,
  CASE WHEN own THEN (own_fcf - last_value(own_fcf IGNORE NULLS) OVER wp) / abs(last_value(own_fcf IGNORE NULLS) OVER wp) ELSE (fsum - lag(fsum) OVER w) / abs(lag(fsum) OVER w) END AS fcf_growth,
  gross_profit / revenue AS gross_margin, operating_income / revenue AS operating_margin, net_income / revenue AS net_margin, fcf / revenue AS fcf_margin, net_income / equity AS roe,
  operating_income / abs(interest_expense) AS interest_coverage, tax_provision / pretax_income AS tax_rate
FROM (SELECT *, ocf + capex AS fsum, CASE WHEN own THEN own_fcf ELSE ocf + capex END AS fcf FROM
  (SELECT *, count(own_fcf) OVER (PARTITION BY ticker ORDER BY period_end ROWS UNBOUNDED PRECEDING) > 0 AS own FROM fund_items))
WINDOW w AS (PARTITION BY ticker ORDER BY period_end), wp AS (PARTITION BY ticker ORDER BY period_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
VIEWS["company_info"] = """
SELECT 'S' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS ticker, CASE WHEN s_suppkey % 6 <> 5 THEN (s_suppkey + 1) * 1e6 END AS market_cap, CASE WHEN s_suppkey % 8 <> 7 THEN (s_suppkey + 1) * 1e4 END AS total_debt,
  CASE WHEN s_suppkey % 5 <> 4 THEN s_acctbal / 300 END AS pe, CASE WHEN s_suppkey % 4 <> 3 THEN s_acctbal / 310 END AS forward_pe FROM supplier"""
VIEWS["filing_texts"] = """
SELECT doc_id, upper(source) AS ticker, CASE WHEN doc_id % 4 = 0 THEN '10-K' ELSE '10-Q' END AS filing_type, 'doc_' || doc_id || '.txt' AS source_file, 'A' || doc_id AS accession_number,
  CASE WHEN doc_id % 3 = 0 THEN text ELSE 'CONTENTS' || chr(10) || 'Item 1. Business' || chr(10) || '3' || chr(10) || 'Risk Factors' || chr(10) || chr(10) || '17' || chr(10) || 'Business' || chr(10) || text
    || chr(10) || 'Item 1A. Risk Factors' || chr(10) || text || chr(10) || 'Item 7. Management''s Discussion and Analysis' || chr(10) || text || chr(10) || 'Item 8. Financial Statements' || chr(10) || text END AS text
FROM documents"""
VIEWS["chunks"] = """
SELECT source AS ticker, '10-K' AS filing_type, DATE '2015-01-01' + CAST(doc_id % 400 AS INTEGER) AS filing_date,
  ['Risk Factors', 'Business', 'MD&A', 'Properties', 'News', 'Market Risk', ' Financial Statements '][doc_id % 7 + 1] AS section, 'c' || lpad(CAST(doc_id AS VARCHAR), 6, '0') AS chunk_id, 0 AS chunk_index, text,
  'doc_' || doc_id || '.txt' AS source_file FROM documents"""

_NAME = re.compile(r"[A-Za-z_][A-Za-z_0-9]*")


def with_views(sql: str) -> str:
    """Prefix ``sql`` (a SELECT, or WITH ... SELECT) with the views it needs, in dependency order."""
    order: list[str] = []

    def need(text: str, own: set[str]) -> None:
        for name in dict.fromkeys(_NAME.findall(text)):
            if name in VIEWS and name not in order and name not in own:
                need(VIEWS[name], own | {name})
                order.append(name)

    need(sql, set())
    if not order:
        return sql.strip()
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in order)
    body = sql.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
