"""Bi-temporal filing facts: what was reported for a period, and from which day it was known.

A company's facts are one row per (field, period end) after ``first_filed``, so a company's history is
a few hundred rows whatever the raw volume; the per-company arrays below rest on that bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asof import asof_join, latest_per_key, month_index
from .outcomes import once

# Annual and quarterly forms, tag names per field in order of preference.
FORMS = ["10-K", "10-Q", "10-K/A", "10-Q/A", "20-F", "40-F", "10-KT", "10-QT"]
DURATION_FIELDS = {
    "revenue": ["Revenues", "RevenueFromContractWithCustomerExcludingAssessedTax", "SalesRevenueNet",
                "RevenueFromContractWithCustomerIncludingAssessedTax", "SalesRevenueGoodsNet", "RevenuesNetOfInterestExpense"],
    "net_income": ["NetIncomeLoss", "ProfitLoss", "NetIncomeLossAvailableToCommonStockholdersBasic"],
    "ocf": ["NetCashProvidedByUsedInOperatingActivities", "NetCashProvidedByUsedInOperatingActivitiesContinuingOperations"],
    "capex": ["PaymentsToAcquirePropertyPlantAndEquipment", "PaymentsToAcquireProductiveAssets"],
    "eps": ["EarningsPerShareDiluted", "EarningsPerShareBasic", "EarningsPerShareBasicAndDiluted"],
}
INSTANT_FIELDS = {
    "shares": ["dei:EntityCommonStockSharesOutstanding", "us-gaap:CommonStockSharesOutstanding"],
    "cash": ["us-gaap:CashAndCashEquivalentsAtCarryingValue",
             "us-gaap:CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents", "us-gaap:Cash"],
    "debt_total": ["us-gaap:LongTermDebt", "us-gaap:DebtLongtermAndShorttermCombinedAmount"],
    "debt_noncurrent": ["us-gaap:LongTermDebtNoncurrent"],
    "debt_current": ["us-gaap:LongTermDebtCurrent", "us-gaap:DebtCurrent"],
    "short_borrowings": ["us-gaap:ShortTermBorrowings"],
    "assets": ["us-gaap:Assets"],
    "equity": ["us-gaap:StockholdersEquity", "us-gaap:StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest"],
}


def _tagged(raw: DataFrame, fields: dict[str, list[str]], name: Column) -> DataFrame:
    """Rows of the listed tags with their field and preference rank."""
    pairs = []
    for field, tags in fields.items():
        for rank, tag in enumerate(tags):
            pairs += [F.lit(tag), F.struct(F.lit(field).alias("field"), F.lit(rank).alias("tag_rank"))]
    known = raw.filter(F.col("form").isin(FORMS)).withColumn("_tag", F.try_element_at(F.create_map(*pairs), name))
    return known.filter(F.col("_tag").isNotNull()).select("*", "_tag.field", "_tag.tag_rank").drop("_tag")


def duration_facts(raw: DataFrame) -> DataFrame:
    """(cik, field, start, end, days, val, filed, form): the earliest-filed value of each period, whatever its tag."""
    src = _tagged(raw.filter((F.col("ns") == "us-gaap") & F.col("start").isNotNull()), DURATION_FIELDS, F.col("tag"))
    one = latest_per_key(src.select("cik", "field", "start", "end", "val", "filed", "form", "tag_rank"),
                         ["cik", "field", "start", "end"], ["filed", "tag_rank", "val"], keep="first")
    return one.withColumn("days", F.datediff("end", "start")).drop("tag_rank")


def instant_facts(raw: DataFrame) -> DataFrame:
    src = _tagged(raw.filter(F.col("start").isNull()), INSTANT_FIELDS, F.concat_ws(":", "ns", "tag"))
    return latest_per_key(src.select("cik", "field", "end", "val", "filed", "tag_rank"),
                          ["cik", "field", "end"], ["filed", "tag_rank", "val"], keep="first").drop("tag_rank")


def discrete_quarters(durations: DataFrame) -> DataFrame:
    """(cik, field, end, val, filed, derived): reported quarters, else differences of year-to-date facts."""
    reported = latest_per_key(durations.filter(F.col("days").between(80, 100)).select("cik", "field", "end", "val", "filed", "start"),
                              ["cik", "field", "end"], ["filed", "start"])
    w = Window.partitionBy("cik", "field", "start").orderBy("end")
    step = (durations.filter(F.col("days") >= 80)
            .withColumns({"_pv": F.lag("val").over(w), "_pe": F.lag("end").over(w), "_pf": F.lag("filed").over(w)})
            .filter(F.datediff("end", "_pe").between(80, 100))
            .select("cik", "field", "end", (F.col("val") - F.col("_pv")).alias("val"), F.greatest("filed", "_pf").alias("filed"), "start"))
    both = (reported.withColumn("derived", F.lit(False)).unionByName(step.withColumn("derived", F.lit(True))))
    return latest_per_key(both, ["cik", "field", "end"], ["derived", "start"], keep="first").drop("start")


def company_table(raw: DataFrame) -> DataFrame:
    """kind ('q' quarter, 'i' instant), field, end, val, filed, derived per company."""
    q = discrete_quarters(duration_facts(raw)).withColumn("kind", F.lit("q"))
    i = instant_facts(raw).withColumn("derived", F.lit(False)).withColumn("kind", F.lit("i"))
    cols = ["cik", "kind", "field", "end", "val", "filed", "derived"]
    return q.select(*cols).unionByName(i.select(*cols))


def quarterly_series(table: DataFrame, field: str, as_of: Column) -> DataFrame:
    """Quarter values of one field known on ``as_of``."""
    return table.filter((F.col("kind") == "q") & (F.col("field") == field) & (F.col("filed") <= as_of)).select("cik", "end", "val", "filed")


# --- snapshots ----------------------------------------------------------------------------------------

def _quarter(table: DataFrame, field: str) -> DataFrame:
    return table.filter((F.col("kind") == "q") & (F.col("field") == field)).select("cik", "end", F.col("val").alias(field), F.col("filed").alias(f"{field}_filed"))


def _with_free_cash_flow(table: DataFrame) -> DataFrame:
    """Add a quarterly field ``fcf`` = ocf - capex, known when both are."""
    fcf = _quarter(table, "ocf").join(_quarter(table, "capex"), ["cik", "end"]).select(
        "cik", F.lit("q").alias("kind"), F.lit("fcf").alias("field"), "end", (F.col("ocf") - F.col("capex")).alias("val"),
        F.greatest("ocf_filed", "capex_filed").alias("filed"), F.lit(True).alias("derived"))
    return table.unionByName(fcf)


def _ttm(quarters: Column) -> Column:
    """Sum of the last four quarters of an end-sorted array if they span about a year."""
    n = F.size(quarters)
    last = F.slice(quarters, F.greatest(n - 3, F.lit(1)), 4)
    span = F.datediff(F.get(last, F.lit(3))["end"], F.get(last, F.lit(0))["end"])
    return F.when((n >= 4) & span.between(250, 300), F.aggregate(last, F.lit(0.0), lambda a, x: a + x["val"]))


QUARTERLY = ("revenue", "net_income", "fcf")
INSTANTS = ("shares", "cash", "equity", "debt_total", "debt_noncurrent", "debt_current", "short_borrowings", "assets")


def snapshots(table: DataFrame, max_instant_age: int = 400) -> DataFrame:
    """The company state on each of its filing days: trailing sums, latest balances, debt and net debt."""
    facts = _with_free_cash_flow(table)
    point = F.struct("end", "val", "filed")
    gather = [F.array_sort(F.collect_list(F.when((F.col("kind") == ("q" if f in QUARTERLY else "i")) & (F.col("field") == f), point))).alias(f"_{f}")
              for f in (*QUARTERLY, *INSTANTS)]
    # State days come from the reported table only: the derived fcf rows are filed on days it already has.
    per = facts.groupBy("cik").agg(F.array_sort(F.collect_set("filed")).alias("_days"), *gather)
    st = per.select("*", F.explode("_days").alias("state_date")).drop("_days")
    seen = lambda f: F.filter(F.col(f"_{f}"), lambda x: x["filed"] <= F.col("state_date"))
    st = once(st, **{f"v_{f}": seen(f) for f in QUARTERLY})

    def latest(f: str) -> Column:
        last = F.try_element_at(seen(f), F.lit(-1))
        return F.when(F.datediff("state_date", last["end"]) <= max_instant_age, last["val"])

    rev = F.col("v_revenue")
    prior = F.slice(rev, 1, F.greatest(F.size(rev) - 4, F.lit(0)))
    st = once(st.withColumn("_prior", prior), revenue_ttm=_ttm(rev), net_income_ttm=_ttm(F.col("v_net_income")), fcf_ttm=_ttm(F.col("v_fcf")),
              revenue_ttm_prior=F.when(F.size(rev) >= 8, _ttm(F.col("_prior"))), **{f: latest(f) for f in INSTANTS})
    parts = F.when(F.col("debt_noncurrent").isNotNull() | F.col("debt_current").isNotNull(),
                   F.coalesce("debt_noncurrent", F.lit(0.0)) + F.coalesce("debt_current", F.lit(0.0)))
    total = F.coalesce(F.col("debt_total"), parts, F.when(F.col("assets").isNotNull(), 0.0))
    st = st.withColumn("debt", total + F.coalesce("short_borrowings", F.lit(0.0)))
    return st.select("cik", "state_date", "revenue_ttm", "net_income_ttm", "fcf_ttm", "revenue_ttm_prior", "shares", "cash", "equity", "debt",
                     (F.col("debt") - F.col("cash")).alias("net_debt"))


def monthly_fundamentals(table: DataFrame, keys: DataFrame) -> DataFrame:
    """Company state known at each (cik, date) key; the state changes only on filing days."""
    return asof_join(keys, snapshots(table), ["cik"], "date", "state_date", probe_unique=False)


# --- derived events -----------------------------------------------------------------------------------

def _year_ago(rows: DataFrame, value: str, out: str) -> DataFrame:
    """The value whose period ended 350-380 days earlier (the latest such period)."""
    probe = rows.withColumn("_at", F.date_sub("end", 350))
    build = rows.select("cik", F.col("end").alias("_prior_end"), F.col(value).alias(out))
    return asof_join(probe, build, ["cik"], "_at", "_prior_end", [out], max_age=30, probe_unique=True).drop("_at", "_prior_end")


def thesis_break_dates(table: DataFrame) -> DataFrame:
    """(cik, break_date): the filing day of the second of two consecutive quarters with negative free cash
    flow and revenue below the year before."""
    q = (_quarter(table, "revenue").join(_quarter(table, "ocf"), ["cik", "end"]).join(_quarter(table, "capex"), ["cik", "end"])
         .select("cik", "end", "revenue", (F.col("ocf") - F.col("capex")).alias("fcf"),
                 F.greatest("revenue_filed", "ocf_filed", "capex_filed").alias("filed")))
    q = _year_ago(q, "revenue", "prior_revenue")
    w = Window.partitionBy("cik").orderBy("end")
    bad = F.coalesce((F.col("fcf") < 0) & (F.col("revenue") < F.col("prior_revenue")), F.lit(False))
    q = q.withColumn("bad", bad).withColumns({"_pb": F.lag("bad").over(w), "_pe": F.lag("end").over(w)})
    return q.filter(F.col("bad") & F.col("_pb") & F.datediff("end", "_pe").between(80, 100)).select("cik", F.col("filed").alias("break_date"))


def sue_series(table: DataFrame, min_history: int = 8) -> DataFrame:
    """(cik, end, filed, sue): year-on-year change of quarterly earnings over the deviation of the changes before it."""
    eps = _quarter(table, "eps").withColumnRenamed("eps_filed", "filed")
    eps = eps.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("cik"))).filter(F.col("_n") >= min_history + 5)
    ch = _year_ago(eps, "eps", "prior").filter(F.col("prior").isNotNull()).withColumn("change", F.col("eps") - F.col("prior"))
    before = Window.partitionBy("cik").orderBy("end").rowsBetween(-min_history, -1)
    ch = ch.withColumn("sd", F.when(F.count("change").over(before) == min_history, F.stddev_samp("change").over(before)))
    return ch.filter(F.col("sd") > 0).select("cik", "end", "filed", (F.col("change") / F.col("sd")).alias("sue"))


def add_sue(keys: DataFrame, sue: DataFrame, table: DataFrame) -> DataFrame:
    """Latest surprise known at each (cik, date) key and the days since the company's last filing."""
    out = asof_join(keys, sue.select("cik", F.col("filed").alias("sue_filed"), "end", "sue"), ["cik"], "date", "sue_filed", ["sue", "end"],
                    tiebreak=["end"]).drop("end", "sue_filed")
    filed = table.select("cik", F.col("filed").alias("last_filed")).distinct()
    out = asof_join(out, filed, ["cik"], "date", "last_filed", [], tiebreak=["last_filed"])
    return out.withColumn("days_since_filing", F.datediff("date", "last_filed")).drop("last_filed")


# --- valuation and the cheap-quality screen -----------------------------------------------------------

def valuation_percentile(monthly: DataFrame, value: str = "ps", months: int = 60, by: str = "ticker") -> DataFrame:
    """Share of the earlier ``months`` of points below today's, their median and their count."""
    w = Window.partitionBy(by).orderBy("_m").rangeBetween(-months, -1)
    x = monthly.withColumn("_m", month_index("date")).withColumn(
        "_hist", F.collect_list(F.when(F.col(value).isNotNull(), F.struct("date", F.col(value).alias("v")))).over(w))
    x = once(x, _h=F.array_sort(F.transform(F.filter("_hist", lambda p: p["date"] >= F.add_months("date", -months)), lambda p: p["v"])))
    n = F.size("_h")
    mid = (F.get("_h", F.floor((n - 1) / 2).cast("int")) + F.get("_h", F.floor(n / 2).cast("int"))) / 2
    known = (n > 0) & F.col(value).isNotNull()
    below = F.size(F.filter("_h", lambda v: v < F.col(value)))
    return x.withColumns({"valuation_pct": F.when(known, below / n), "valuation_median": F.when(known, mid), "valuation_history": n}) \
            .drop("_m", "_hist", "_h")


def ratios(df: DataFrame) -> DataFrame:
    """Screen inputs from a snapshot row with ``market_cap`` and ``close``/``high_52w``."""
    rev, cap = F.col("revenue_ttm"), F.col("market_cap")
    pos = lambda c: F.when(c > 0, c)
    nz = lambda c: F.when(c != 0, c)
    return df.withColumns({
        "net_margin": F.col("net_income_ttm") / pos(rev), "fcf_margin": F.col("fcf_ttm") / pos(rev),
        "net_debt_to_mcap": F.col("net_debt") / nz(cap), "fcf_yield": F.col("fcf_ttm") / nz(cap),
        "roe": F.col("net_income_ttm") / pos(F.col("equity")), "revenue_growth": nz(rev) / nz(F.col("revenue_ttm_prior")) - 1,
        "log_market_cap": F.log(pos(cap)), "ps": pos(cap / nz(rev))})


def cheap_quality_screen(df: DataFrame, drawdown_min: float = 0.25, min_history: int = 36, max_debt: float = 1.0) -> DataFrame:
    """``is_candidate``: fallen, cheap against its own history (or too short a history), and of known quality."""
    price_only = F.col("valuation_history") < min_history
    cheap = price_only | F.coalesce(F.col("ps") < F.col("valuation_median"), F.lit(False))
    quality = (F.col("net_margin") > 0) & (F.col("fcf_margin") > 0) & (F.col("net_debt_to_mcap") < max_debt)
    return df.withColumn("price_only", price_only).withColumn(
        "is_candidate", F.coalesce(F.col("drawdown") >= drawdown_min, F.lit(False)) & cheap & F.coalesce(quality, F.lit(False)))
