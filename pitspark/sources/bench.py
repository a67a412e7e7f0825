"""Research-shaped views over the benchmark tables.

The star schema stands in for the research inputs: suppliers are tickers and issuers, nations are
13F filers, customers are insiders, documents are filings. Everything is derived by Spark from the
given Parquet tables, so it grows with them. Prices and amounts are summed as whole cents, which
makes every sum independent of the order rows arrive in.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import asof, outcomes
from ..session import stage


def staged(fn):
    """Materialise a view once per application and benchmark directory."""
    @functools.wraps(fn)
    def view(spark: SparkSession, sf: str) -> DataFrame:
        return stage(lambda: fn(spark, sf), spark, f"{fn.__name__}:{sf.rstrip('/')}")
    return view


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


#: Parts that documents are dealt out to when the work on each is heavy.
TEXT_PARTS = 64


def spread(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Deal rows that are heavy to work on out by their key."""
    return df.repartition(TEXT_PARTS, key)


def ticker_of(key: str):
    return F.concat(F.lit("S"), F.lpad(F.col(key).cast("string"), 9, "0"))


def cents(col: str):
    return F.round(F.col(col) * 100).cast("long")


# --- prices -------------------------------------------------------------------------------------------

@staged
def bars(spark: SparkSession, sf: str) -> DataFrame:
    """Weekly OHLCV per supplier: a price path driven by the weekly mean unit price against the supplier's mean."""
    unit = F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100).cast("long")
    weekly = (table(spark, sf, "lineitem").filter(F.col("l_quantity") > 0)
              .select(F.col("l_suppkey").alias("k"), F.date_trunc("week", "l_shipdate").cast("date").alias("date"),
                      unit.alias("u"), F.col("l_quantity").cast("long").alias("q"))
              .groupBy("k", "date").agg(F.sum("u").alias("s"), F.count(F.lit(1)).alias("n"), F.min("u").alias("lo"),
                                        F.max("u").alias("hi"), F.sum("q").alias("volume")))
    whole = Window.partitionBy("k")
    run = Window.partitionBy("k").orderBy("date")
    z = (weekly.withColumn("m", F.sum("s").over(whole) / F.sum("n").over(whole))
         .withColumn("z", F.col("s") / F.col("n") / F.col("m") - 1))
    c = (z.withColumn("close", F.round(100 * F.exp(0.05 * F.sum("z").over(run.rowsBetween(Window.unboundedPreceding, 0))), 2))
         .withColumn("open", F.coalesce(F.lag("close").over(run), F.lit(100.0)))
         .withColumn("shock", F.greatest(F.abs(F.col("hi") / F.col("m") - 1), F.abs(F.col("lo") / F.col("m") - 1))))
    return c.select(ticker_of("k").alias("ticker"), "date", "open",
                    F.round(F.greatest("open", "close") * (1 + 0.01 * F.col("shock")), 2).alias("high"),
                    F.round(F.least("open", "close") * (1 - 0.01 * F.col("shock")), 2).alias("low"),
                    "close", F.col("volume").cast("double").alias("volume"),
                    F.col("close").alias("close_split_adj"),
                    F.when((F.col("k") + F.weekofyear("date")) % 97 == 0, 2.0).otherwise(0.0).alias("split"))


def benchmark_bars(b: DataFrame) -> DataFrame:
    """Equal-weight mean bar of all tickers per week."""
    mean = lambda c: (F.sum(cents(c)) / F.count(F.lit(1)) / 100).alias(c)
    return b.groupBy("date").agg(mean("open"), mean("high"), mean("low"), mean("close"), F.sum("volume").alias("volume"))


@staged
def calendar(spark: SparkSession, sf: str) -> DataFrame:
    return asof.calendar(bars(spark, sf))


@staged
def bench_grid(spark: SparkSession, sf: str) -> DataFrame:
    return benchmark_bars(bars(spark, sf)).join(calendar(spark, sf), "date").select("date", "pos", "open", "high", "low", "close")


@staged
def grid(spark: SparkSession, sf: str) -> DataFrame:
    return asof.aligned_ohlc(bars(spark, sf), calendar(spark, sf))


def daily_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Daily OHLCV of the event values per user."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("ticker"), F.to_date("ts").alias("date"), "ts", "event_id", "value")
    rank = F.struct("ts", "event_id")
    return e.groupBy("ticker", "date").agg(F.min_by("value", rank).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
                                           F.max_by("value", rank).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))


# --- panel --------------------------------------------------------------------------------------------

WARMUP, EVERY, LABEL = 60, 4, 8


@staged
def panel(spark: SparkSession, sf: str) -> DataFrame:
    """(date, ticker) cross-sections every four weeks: technical features, score, labels; rounded to 8 digits."""
    from ..operators import features as ft

    b, cal, g = bars(spark, sf), calendar(spark, sf), grid(spark, sf)
    cols = {"return_4w": ft.trailing_return(4), "return_12w": ft.trailing_return(12), "return_52w": ft.trailing_return(52),
            "volatility_12w": ft.volatility(12), "volume_ratio": ft.volume_ratio(12), "price_vs_ma20": ft.price_vs_ma(20),
            "momentum": ft.momentum(4, 52)}
    hist = ft.with_bar_inputs(b).withColumns(cols).select("ticker", "date", "close", "volume", *cols)
    labels = outcomes.forward_returns(asof.filled_closes(g, 5), bench_grid(spark, sf), LABEL).select("ticker", "date", "pos", "fwd_return", "fwd_excess")
    at = asof.rebalance_dates(cal, EVERY, WARMUP).select("date")
    out = hist.join(at, "date").join(labels, ["ticker", "date"], "left")
    out = out.withColumn("score", 0.5 * F.col("momentum") - F.col("return_4w"))
    for c in [*cols, "score", "fwd_return", "fwd_excess"]:
        out = out.withColumn(c, F.round(c, 8))
    return out


# --- 13F ----------------------------------------------------------------------------------------------

def quarter_end(d):
    return F.last_day(F.add_months(F.trunc(d, "quarter"), 2))


@staged
def holdings(spark: SparkSession, sf: str) -> DataFrame:
    """Quarterly books: filer = nation of the customer, cusip = supplier."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("d"))
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
    return (j.groupBy(F.col("c_nationkey").cast("long").alias("cik"), quarter_end("d").alias("report_date"), F.col("l_suppkey").alias("s"))
            .agg(F.sum(F.col("l_quantity").cast("long")).alias("sh"), F.sum(cents("l_extendedprice")).alias("v"))
            .select("cik", "report_date", accession("cik", "report_date").alias("accession"),
                    F.date_add("report_date", (20 + F.col("cik")).cast("int")).alias("filing_date"),
                    F.concat(F.lit("C"), F.lpad(F.col("s").cast("string"), 9, "0")).alias("cusip"),
                    F.concat(F.lit("Issuer "), F.col("s").cast("string")).alias("name_of_issuer"), F.lit("COM").alias("title_of_class"),
                    F.col("sh").cast("double").alias("shares"), (F.col("v") / 100).alias("value")))


def accession(cik: str, period: str):
    return F.concat(F.lit("13F-"), F.col(cik).cast("string"), F.lit("-"), F.date_format(period, "yyyyMMdd"))


def filings(h: DataFrame) -> DataFrame:
    return h.select("cik", "accession", "filing_date", "report_date").distinct()


def cusip_map(spark: SparkSession, sf: str) -> DataFrame:
    """cusip -> ticker, security type; every 11th unresolved, every 13th a fund, every 17th shares its neighbour's ticker."""
    k = F.col("s_suppkey")
    own = F.when(k % 17 == 0, k + 1).otherwise(k)
    return table(spark, sf, "supplier").select(
        F.concat(F.lit("C"), F.lpad(k.cast("string"), 9, "0")).alias("cusip"),
        F.when(k % 11 != 0, F.concat(F.lit("S"), F.lpad(own.cast("string"), 9, "0"))).alias("ticker"),
        F.when(k % 13 == 0, "ETP").otherwise("Common Stock").alias("security_type"))


# --- insiders -----------------------------------------------------------------------------------------

def transactions(spark: SparkSession, sf: str) -> DataFrame:
    """Officer trades from orders: issuer = customer modulo the number of suppliers, purchase if priority 1 or 2."""
    issuers = table(spark, sf, "supplier").count()
    return table(spark, sf, "orders").select(
        (F.col("o_orderkey") - F.col("o_orderkey") % 2).cast("string").alias("accession"),
        F.to_date("o_orderdate").alias("filing_date"), F.date_sub(F.to_date("o_orderdate"), 2).alias("trans_date"),
        (F.col("o_custkey") % issuers).alias("issuer_cik"), F.col("o_custkey").alias("owner_cik"),
        (F.col("o_orderstatus") == "F").alias("is_director"), (F.col("o_orderstatus") != "F").alias("is_officer"),
        F.when(F.substring("o_orderpriority", 1, 1).isin("1", "2"), "P").otherwise("S").alias("trans_code"),
        (F.col("o_custkey") % 500 + 1).cast("double").alias("shares"),
        (cents("o_totalprice") / 100 / (F.col("o_custkey") % 500 + 1)).alias("price"),
        (cents("o_totalprice") / 100).alias("value"))


def issuer_map(spark: SparkSession, sf: str) -> DataFrame:
    """ticker -> issuer_cik; every 19th supplier has none."""
    return table(spark, sf, "supplier").filter(F.col("s_suppkey") % 19 != 18).select(
        ticker_of("s_suppkey").alias("ticker"), F.col("s_suppkey").alias("issuer_cik"))


# --- XBRL-like facts ----------------------------------------------------------------------------------

@staged
def raw_facts(spark: SparkSession, sf: str) -> DataFrame:
    """(cik, tag, start, end, val, filed, form): explicit quarters, year-to-date cash flows, restatements, instants."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    o = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    q = (li.join(o, li.l_orderkey == o.o_orderkey)
         .groupBy(F.col("l_suppkey").alias("cik"), quarter_end("d").alias("end"))
         .agg(F.sum(cents("l_extendedprice")).alias("rev"), F.sum(cents("l_discount")).alias("disc"), F.sum(cents("l_tax")).alias("tax"),
              F.sum(F.col("l_quantity").cast("long")).alias("qty"), F.count(F.lit(1)).alias("n")))
    ytd = Window.partitionBy("cik", F.year("end")).orderBy("end").rowsBetween(Window.unboundedPreceding, 0)
    q = (q.withColumn("ni", F.col("rev") * (8 - F.col("disc") / F.col("n")) / 100)
         .withColumn("ocf", F.col("rev") * (10 - F.col("disc") / F.col("n") - F.col("tax") / F.col("n")) / 100)
         .withColumn("ocf_ytd", F.sum("ocf").over(ytd))
         .withColumn("capex_ytd", F.sum(F.col("qty") * 1000.0).over(ytd))
         .withColumn("q0", F.trunc("end", "quarter")).withColumn("y0", F.trunc("end", "year"))
         .withColumn("filed", F.date_add("end", (30 + F.col("cik") % 20).cast("int")))
         .withColumn("form", F.when(F.month("end") == 12, "10-K").otherwise("10-Q")))
    fact = lambda ns, tag, start, val, filed=F.col("filed"): F.struct(
        F.lit(ns).alias("ns"), F.lit(tag).alias("tag"), start.cast("date").alias("start"), (F.floor(val.cast("double") * 100) / 100).alias("val"), filed.alias("filed"))
    none = F.lit(None)
    rows = F.array(
        fact("us-gaap", "Revenues", F.col("q0"), F.col("rev") / 100),
        fact("us-gaap", "SalesRevenueNet", F.col("q0"), F.col("rev") / 100 * 1.01, F.date_add("filed", 365)),
        fact("us-gaap", "NetIncomeLoss", F.col("q0"), F.col("ni") / 100),
        fact("us-gaap", "NetCashProvidedByUsedInOperatingActivities", F.col("y0"), F.col("ocf_ytd") / 100),
        fact("us-gaap", "PaymentsToAcquirePropertyPlantAndEquipment", F.col("y0"), F.col("capex_ytd") / 100),
        fact("us-gaap", "EarningsPerShareDiluted", F.col("q0"), F.col("ni") / 100 / (1000 + F.col("cik"))),
        fact("dei", "EntityCommonStockSharesOutstanding", none, (1000 + F.col("cik")) * 1000.0),
        fact("us-gaap", "CashAndCashEquivalentsAtCarryingValue", none, F.col("qty") * 500.0),
        fact("us-gaap", "StockholdersEquity", none, F.col("rev") / 50),
        fact("us-gaap", "Assets", none, F.col("rev") / 20),
        F.when(F.col("cik") % 3 == 0, fact("us-gaap", "LongTermDebt", none, F.col("rev") / 400)),
        F.when(F.col("cik") % 3 == 1, fact("us-gaap", "LongTermDebtNoncurrent", none, F.col("rev") / 500)),
        F.when(F.col("cik") % 2 == 1, fact("us-gaap", "ShortTermBorrowings", none, F.col("rev") / 900)))
    return q.select("cik", "end", "form", F.explode(F.array_compact(rows)).alias("f")).select(
        "cik", "f.ns", "f.tag", "f.start", "end", "f.val", "f.filed", "form")


# --- mentions and signals -----------------------------------------------------------------------------

def mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Institution views from orders joined to their customer."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    k = F.col("o_custkey")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.concat(F.lit("Inst "), (k % 25).cast("string")).alias("institution"),
        F.concat(F.lit("Report "), F.col("o_orderkey").cast("string")).alias("report_title"),
        F.to_date("o_orderdate").alias("publication_date"),
        F.when(F.col("o_orderkey") % 5 != 0, F.substring("o_orderpriority", 3, 20)).alias("theme"),
        F.col("c_mktsegment").alias("sector"), F.concat(F.lit("R"), (F.col("c_nationkey") % 5).cast("string")).alias("region"),
        F.concat(F.lit("Company "), (k % 300).cast("string")).alias("company_name"),
        F.when(F.col("o_orderkey") % 7 != 0, F.concat(F.lit("S"), F.lpad((k % 300).cast("string"), 9, "0"))).alias("ticker"),
        F.when(F.col("o_orderstatus") == "F", "POSITIVE").when(F.col("o_orderstatus") == "O", "NEGATIVE").otherwise("MENTIONED").alias("view_direction"),
        F.concat(F.lit("M"), F.col("o_orderkey").cast("string")).alias("chunk_id"),
        F.concat(F.lit("evidence "), (F.col("o_orderkey") % 1000).cast("string")).alias("evidence"))


def signals(spark: SparkSession, sf: str) -> DataFrame:
    """Text-signal records from events: direction by value band, strength = value / 100 clipped."""
    v = F.col("value")
    kind = (F.when(F.col("event_type") == "error", "risk").when(F.col("event_type") == "purchase", "earnings")
            .when(F.col("event_type") == "signup", "demand").when(F.col("event_type") == "view", "guidance").otherwise("margins"))
    return table(spark, sf, "events").select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("ticker"), F.col("event_id"), F.to_date("ts").alias("filing_date"),
        kind.alias("signal_type"), F.when(v > 60, "positive").when(v < 25, "negative").otherwise("neutral").alias("direction"),
        F.least(F.lit(1.0), F.floor(v) / 100).alias("strength"),
        F.concat(F.lit("chunk "), F.floor(F.col("event_id") / 20).cast("string")).alias("chunk_id"),
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("evidence"))


# --- filings text -------------------------------------------------------------------------------------

def sections(spark: SparkSession, sf: str) -> DataFrame:
    """Filings from documents: issuer = source, three quarterlies then one annual every four documents, 91 days
    apart; one in 23 is filed 130 days late for the same period."""
    src = F.regexp_extract("source", r"(\d+)", 1).cast("long")
    named = table(spark, sf, "documents").withColumn("accession", F.concat(F.lit("A"), F.col("doc_id").cast("string")))
    i = F.col("doc_id")
    step = (i / 20).cast("int")
    due = F.date_add(F.lit("2008-01-15").cast("date"), (step % 40 * 91 + i % 20 % 3).cast("int"))
    filed = F.when(i % 23 == 7, F.date_add(due, 130)).otherwise(due)
    return spread(named, "accession").select(
        src.alias("cik"), "accession",
        F.when(step % 4 == 3, "10-K").otherwise("10-Q").alias("form"), filed.alias("filing_date"),
        F.when(i % 9 != 0, F.date_sub(due, 40)).alias("report_date"),
        F.col("text").alias("risk_factors"), F.when(i % 6 != 0, F.reverse("text")).alias("mdna"))


@staged
def company_facts(spark: SparkSession, sf: str) -> DataFrame:
    """The per-company point-in-time table of ``facts.company_table``."""
    from ..operators import facts

    return facts.company_table(raw_facts(spark, sf))


@staged
def book_changes(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import holdings as hd

    h = holdings(spark, sf)
    return hd.compare_quarters(h, filings(h))


@staged
def universe_history(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import holdings as hd

    sel = hd.resolve(hd.select_positions(book_changes(spark, sf)), cusip_map(spark, sf))
    return sel.select(*hd.HISTORY, F.col("name_of_issuer").alias("company_name"), hd.status_view(F.col("status"), 0).alias("view_direction"),
                      hd.status_view(F.col("status"), 1).alias("confidence"))


def month_end_dates(spark: SparkSession, sf: str) -> DataFrame:
    return asof.month_ends(calendar(spark, sf), "1996-01-01").select("date")


# --- statements ---------------------------------------------------------------------------------------

@staged
def statements(spark: SparkSession, sf: str) -> DataFrame:
    """Annual statement rows per supplier from its yearly revenue, quantity, discount and tax."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    o = table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"))
    q = (li.join(o, li.l_orderkey == o.o_orderkey).groupBy(F.col("l_suppkey").alias("k"), "y")
         .agg(F.sum(cents("l_extendedprice")).alias("rev"), F.sum(cents("l_discount")).alias("disc"), F.sum(cents("l_tax")).alias("tax"),
              F.sum(F.col("l_quantity").cast("long")).alias("qty"), F.count(F.lit(1)).alias("n")))
    rev, qty, n, k = F.col("rev") / 100, F.col("qty"), F.col("n"), F.col("k")
    ni = rev * (8 - F.col("disc") / n) / 100
    item = lambda stmt, name, v: F.struct(F.lit(stmt).alias("statement"), name.alias("line_item"), v.cast("double").alias("value"))
    lit = F.lit
    rows = F.array(
        item("income_stmt", F.when(k % 4 == 3, "TotalRevenue").otherwise("Total Revenue"), rev),
        F.when(k % 9 == 0, item("income_stmt", lit("TotalRevenue"), rev * 2)),
        item("income_stmt", lit("Gross Profit"), rev * 0.4 - qty), item("income_stmt", lit("Operating Income"), rev * 0.2 - qty * 2),
        item("income_stmt", lit("Net Income"), F.when((k + F.col("y")) % 13 != 0, ni)),
        item("income_stmt", F.when(k % 5 == 0, "Basic EPS").otherwise("Diluted EPS"), ni / (1000 + k)),
        item("income_stmt", lit("Interest Expense"), -qty * 3), item("income_stmt", lit("Tax Provision"), qty * 5), item("income_stmt", lit("Pretax Income"), rev * 0.15),
        item("cashflow", lit("Operating Cash Flow"), rev * (10 - F.col("tax") / n) / 100), item("cashflow", lit("Capital Expenditure"), -qty * 100),
        F.when((k % 3 == 0) & (F.col("y") > 1996), item("cashflow", lit("Free Cash Flow"), rev * 0.05)),
        item("balance_sheet", lit("Cash And Cash Equivalents"), qty * 500), item("balance_sheet", lit("Stockholders Equity"), rev * 0.5),
        F.when(k % 7 != 0, item("balance_sheet", lit("Total Debt"), rev * 0.1)))
    return q.select(ticker_of("k").alias("ticker"), F.make_date("y", lit(12), lit(31)).alias("period_end"), F.explode(F.array_compact(rows)).alias("r")) \
            .select("ticker", "r.statement", "r.line_item", "period_end", "r.value")


def company_info(spark: SparkSession, sf: str) -> DataFrame:
    k, a = F.col("s_suppkey"), F.col("s_acctbal")
    return table(spark, sf, "supplier").select(
        ticker_of("s_suppkey").alias("ticker"), F.when(k % 6 != 5, (k + 1) * 1e6).alias("market_cap"), F.when(k % 8 != 7, (k + 1) * 1e4).alias("total_debt"),
        F.when(k % 5 != 4, a / 300).alias("pe"), F.when(k % 4 != 3, a / 310).alias("forward_pe"))


# --- filing texts -------------------------------------------------------------------------------------

def filing_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents dressed as filings: a table of contents and four headed sections in two of three."""
    i, t = F.col("doc_id"), F.col("text")
    headed = F.concat(F.lit("CONTENTS\nItem 1. Business\n3\nRisk Factors\n\n17\nBusiness\n"), t, F.lit("\nItem 1A. Risk Factors\n"), t,
                      F.lit("\nItem 7. Management's Discussion and Analysis\n"), t, F.lit("\nItem 8. Financial Statements\n"), t)
    return spread(table(spark, sf, "documents")).select(
        "doc_id", F.upper("source").alias("ticker"), F.when(i % 4 == 0, "10-K").otherwise("10-Q").alias("filing_type"), F.lit("2020-01-31").alias("filing_date"),
        F.format_string("doc_%d.txt", i).alias("source_file"), F.format_string("A%d", i).alias("accession_number"), F.when(i % 3 == 0, t).otherwise(headed).alias("text"))


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunk-shaped rows straight from the documents (one chunk each)."""
    i = F.col("doc_id")
    sec = F.array(*[F.lit(s) for s in ["Risk Factors", "Business", "MD&A", "Properties", "News", "Market Risk", " Financial Statements "]])
    return spread(table(spark, sf, "documents")).select(
        F.col("source").alias("ticker"), F.lit("10-K").alias("filing_type"), F.date_add(F.lit("2015-01-01").cast("date"), (i % 400).cast("int")).alias("filing_date"),
        F.get(sec, (i % 7).cast("int")).alias("section"), F.format_string("c%06d", i).alias("chunk_id"), F.lit(0).alias("chunk_index"), "text",
        F.format_string("doc_%d.txt", i).alias("source_file"))
