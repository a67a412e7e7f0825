"""Statement fundamentals from long line-item rows (ticker, statement, line_item, period_end, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import trend_state, valuation_context
from .asof import asof_join

# Accepted line-item names per field, first present name wins.
LINE_ITEMS = {
    "revenue": ("income_stmt", ["Total Revenue", "TotalRevenue"]),
    "gross_profit": ("income_stmt", ["Gross Profit", "GrossProfit"]),
    "operating_income": ("income_stmt", ["Operating Income", "OperatingIncome"]),
    "net_income": ("income_stmt", ["Net Income", "NetIncome"]),
    "eps": ("income_stmt", ["Diluted EPS", "DilutedEPS", "Basic EPS"]),
    "interest_expense": ("income_stmt", ["Interest Expense", "InterestExpense"]),
    "tax_provision": ("income_stmt", ["Tax Provision", "TaxProvision"]),
    "pretax_income": ("income_stmt", ["Pretax Income", "PretaxIncome"]),
    "operating_cash_flow": ("cashflow", ["Operating Cash Flow", "Total Cash From Operating Activities"]),
    "capital_expenditure": ("cashflow", ["Capital Expenditure", "CapitalExpenditure"]),
    "free_cash_flow_row": ("cashflow", ["Free Cash Flow", "FreeCashFlow"]),
    "cash": ("balance_sheet", ["Cash And Cash Equivalents", "CashAndCashEquivalents", "Cash"]),
    "equity": ("balance_sheet", ["Stockholders Equity", "Total Stockholder Equity", "TotalStockholderEquity"]),
    "debt": ("balance_sheet", ["Total Debt", "TotalDebt"]),
}


def line_items(statements: DataFrame) -> DataFrame:
    """(ticker, period_end, one column per field): the first alias a ticker reports is used for all its periods."""
    pairs = []
    for field, (stmt, names) in LINE_ITEMS.items():
        for i, n in enumerate(names):
            pairs += [F.lit(f"{stmt}|{n}"), F.struct(F.lit(field).alias("field"), F.lit(i).alias("rank"))]
    known = statements.withColumn("_k", F.try_element_at(F.create_map(*pairs), F.concat_ws("|", "statement", "line_item"))) \
                      .filter(F.col("_k").isNotNull()).select("ticker", "period_end", "value", "_k.field", "_k.rank")
    best = known.groupBy("ticker", "field").agg(F.min("rank").alias("rank"))
    return known.join(best, ["ticker", "field", "rank"], "left_semi") \
                .groupBy("ticker", "period_end").pivot("field", list(LINE_ITEMS)).agg(F.max("value"))


def _by_period(until: int = 0):
    return Window.partitionBy("ticker").orderBy("period_end").rowsBetween(Window.unboundedPreceding, until)


def ratio(num: Column, den: Column) -> Column:
    return num / F.when(den != 0, den)


def growth(col: str) -> Column:
    """Change over the previous known value, relative to its size."""
    prev = F.last(col, ignorenulls=True).over(_by_period(-1))
    return ratio(F.col(col) - prev, F.abs(prev))


def with_metrics(items: DataFrame) -> DataFrame:
    """Per period: margins, growth, free cash flow (own row if the ticker reports one, else cash flow plus capex)."""
    has_own = F.count("free_cash_flow_row").over(_by_period()) > 0
    x = items.withColumn("_own", has_own).withColumn("_sum", F.col("operating_cash_flow") + F.col("capital_expenditure"))
    x = x.withColumn("fcf", F.when(F.col("_own"), F.col("free_cash_flow_row")).otherwise(F.col("_sum")))
    return x.withColumns({
        "revenue_growth": growth("revenue"), "eps_growth": growth("eps"), "operating_income_growth": growth("operating_income"),
        "fcf_growth": F.when(F.col("_own"), growth("free_cash_flow_row")).otherwise(growth("_sum")),
        "gross_margin": ratio(F.col("gross_profit"), F.col("revenue")), "operating_margin": ratio(F.col("operating_income"), F.col("revenue")),
        "net_margin": ratio(F.col("net_income"), F.col("revenue")), "fcf_margin": ratio(F.col("fcf"), F.col("revenue")),
        "roe": ratio(F.col("net_income"), F.col("equity")), "interest_coverage": ratio(F.col("operating_income"), F.abs("interest_expense")),
        "tax_rate": ratio(F.col("tax_provision"), F.col("pretax_income"))}).drop("_own", "_sum")


def _latest(col: str) -> Column:
    return F.max_by(col, F.when(F.col(col).isNotNull(), F.col("period_end")))


def _series(col: str) -> Column:
    pairs = F.array_sort(F.collect_list(F.when(F.col(col).isNotNull(), F.struct("period_end", F.col(col).alias("v")))))
    return F.transform(pairs, lambda x: x["v"])


def compute_fundamentals(statements: DataFrame, info: DataFrame) -> DataFrame:
    """One row per ticker: latest metrics, trends, leverage and yields.

    ``info``: ticker, market_cap, total_debt, pe, forward_pe. Debt is a current figure, so net debt,
    leverage and invested capital use it as such.
    """
    m = with_metrics(line_items(statements)).join(info.select("ticker", "total_debt"), "ticker", "left")
    invested = F.col("total_debt") + F.col("equity") - F.col("cash")
    m = m.withColumn("roic", F.when(invested > 0, F.col("operating_income") * (1 - F.col("tax_rate")) / invested))
    latest = ["revenue_growth", "eps_growth", "gross_margin", "operating_margin", "operating_income_growth", "net_margin", "roe", "roic", "fcf_margin",
              "fcf_growth", "cash", "equity", "interest_coverage"]
    seen = F.when(F.col("revenue").isNotNull() | F.col("fcf").isNotNull() | F.col("cash").isNotNull(), F.col("period_end"))
    g = m.groupBy("ticker").agg(
        *[_latest(c).alias(c) for c in latest], _latest("fcf").alias("free_cash_flow"), F.max(seen).alias("observation_date"),
        *[_series(c).alias(f"_s_{c}") for c in ("revenue_growth", "eps_growth", "operating_margin", "net_margin", "fcf_growth", "cash")])
    g = g.join(info, "ticker", "left")
    trends = {f"{c}_trend": trend_state(f"_s_{c}") for c in ("revenue_growth", "eps_growth", "operating_margin", "net_margin")}
    nz = lambda c: F.when(F.col(c) != 0, F.col(c))
    return g.withColumns({**trends, "fcf_trend": trend_state("_s_fcf_growth"), "balance_sheet_trend": trend_state("_s_cash"),
                          "net_debt": F.col("total_debt") - F.col("cash"), "leverage": F.col("total_debt") / nz("equity"),
                          "fcf_yield": nz("free_cash_flow") / nz("market_cap"), "valuation_context": valuation_context("pe", "forward_pe")}) \
            .drop(*[f"_s_{c}" for c in ("revenue_growth", "eps_growth", "operating_margin", "net_margin", "fcf_growth", "cash")])


def pit_fundamentals(keys: DataFrame, statements: DataFrame, info: DataFrame, lag_days: int = 90) -> DataFrame:
    """Fundamentals known at each (ticker, date) key with ``close`` and ``price_now``.

    A statement counts ``lag_days`` after its period ends. The state can only change on those days, so it
    is carried per period and picked by one as-of join.
    """
    m = with_metrics(line_items(statements.filter(F.try_to_date(F.col("period_end").cast("string")).isNotNull())))
    keep = lambda c: F.last(c, ignorenulls=True).over(_by_period())
    cols = ["revenue_growth", "eps_growth", "net_margin", "roe", "fcf_margin", "fcf_growth", "fcf", "debt", "cash"]
    st = m.select("ticker", F.date_add("period_end", lag_days).alias("known_on"), *[keep(c).alias(c) for c in cols],
                  F.last(F.when(F.col("revenue").isNotNull(), F.col("period_end")), ignorenulls=True).over(_by_period()).alias("fundamentals_period_end"))
    out = asof_join(keys, st, ["ticker"], "date", "known_on", probe_unique=True).drop("known_on")
    out = out.join(info.select("ticker", F.col("market_cap").alias("_cap_now")), "ticker", "left")
    nz = lambda c: F.when(c != 0, c)
    out = out.withColumn("market_cap", nz(F.col("_cap_now")) * nz(F.col("close")) / nz(F.col("price_now")))
    return out.withColumns({"fcf_yield": F.col("fcf") / nz(F.col("market_cap")), "net_debt": F.col("debt") - F.col("cash"),
                            "forward_pe": F.lit(None).cast("double")}).drop("_cap_now", "fcf", "debt", "cash")


# --- observations and their quality -------------------------------------------------------------------

METRIC_KIND = {"revenue": "raw", "revenue_growth": "growth", "gross_margin": "margin", "operating_margin": "margin", "net_margin": "margin", "eps_growth": "growth",
               "fcf": "raw", "fcf_growth": "growth", "fcf_margin": "margin", "cash": "raw", "equity": "raw", "roe": "ratio", "interest_coverage": "coverage"}
# Bounds per kind (low, high) and the flag they raise.
BOUNDS = {"margin": (-5.0, 1.5, "impossible_margin"), "ratio": (-10.0, 10.0, "implausible_ratio"), "coverage": (-200.0, 200.0, "implausible_coverage"),
          "growth": (-3.0, 3.0, "extreme_growth_value")}


def to_observations(statements: DataFrame, source: str = "statements") -> DataFrame:
    """Long observations with provenance: metric, kind, value, period label, type and end, source."""
    m = with_metrics(line_items(statements))
    long = m.select("ticker", "period_end", *[F.col(c).cast("double").alias(c) for c in METRIC_KIND]).unpivot(["ticker", "period_end"], list(METRIC_KIND), "metric", "value")
    kinds = F.create_map(*[x for k, v in METRIC_KIND.items() for x in (F.lit(k), F.lit(v))])
    return long.filter(F.col("value").isNotNull()).select(
        "ticker", "metric", kinds[F.col("metric")].alias("kind"), "value", F.format_string("FY%d", F.year("period_end")).alias("period"),
        F.lit("annual").alias("period_type"), "period_end", F.lit(False).alias("is_estimate"), F.lit(source).alias("source"))


def validate_observations(obs: DataFrame, now: Column, tolerance_days: int = 3) -> DataFrame:
    """Add ``quality_flags``; nothing is removed or altered. A series is one ticker's metric, a value per period."""
    series = Window.partitionBy("ticker", "metric")
    twice = F.count(F.lit(1)).over(Window.partitionBy("ticker", "metric", "period")) > 1
    sizes = F.array_sort(F.collect_list(F.abs("value")).over(series))
    n = F.size("_sizes")
    x = obs.withColumns({"_twice": twice, "_sizes": sizes})
    x = x.withColumn("_mid", F.when(n >= 3, F.get("_sizes", F.floor(n / 2).cast("int"))))
    flags = [F.when(F.col("period_end").isNull(), "invalid_date"),
             F.when(F.datediff("period_end", now) > tolerance_days, "future_dated_period"), F.when(F.col("_twice"), "duplicate_period")]
    for kind, (low, high, name) in BOUNDS.items():
        flags.append(F.when((F.col("kind") == kind) & ((F.col("value") > high) | (F.col("value") < low)), name))
    flags.append(F.when((F.col("_mid") >= 1e-9) & (F.abs("value") > F.col("_mid") * 20), "outlier_vs_series_median"))
    return x.withColumn("quality_flags", F.array_compact(F.array(*flags))).drop("_twice", "_sizes", "_mid")
