"""13F books: quarter-over-quarter change, selection, histories, point-in-time universes.

All filers and quarters run in one plan keyed by (cik, accession, cusip). Totals and medians are
aggregates joined back, and every top-k is a limit per group that Spark applies before its shuffle,
so a filer holding most of the rows is never one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import direction_label, direction_value
from ..session import cut_lineage
from .asof import latest_filings, latest_per_key
from .ranks import exact_quantiles

CHANGE_THRESHOLD = 0.10
# Security types that are funds, and status to (direction, confidence).
FUND_TYPES = ["ETP", "Open-End Fund", "Closed-End Fund", "Mutual Fund", "Unit"]
STATUS_VIEW = {
    "NEW": ("POSITIVE", "High"), "ADDED": ("POSITIVE", "Medium"), "REDUCED": ("NEGATIVE", "Medium"),
    "EXITED": ("NEGATIVE", "High"), "UNCHANGED": ("MENTIONED", "Low"), "NO_PRIOR": ("MENTIONED", "Low"),
}
DOLLAR_VALUES_FROM = "2023-01-03"
BOOK = ["cik", "accession"]


def original_filings(filings: DataFrame, form: str = "13F-HR") -> DataFrame:
    """The latest-filed original of each (filer, report quarter)."""
    src = filings.filter(F.col("form") == form) if "form" in filings.columns else filings
    return latest_per_key(src, ["cik", "report_date"], ["filing_date", "accession"])


def merge_books(rows: DataFrame, order: str = "row_no") -> DataFrame:
    """One row per (filing, cusip): shares and value summed over rows and files, the first names kept."""
    return rows.groupBy(*BOOK, "cusip").agg(
        F.min_by("name_of_issuer", order).alias("name_of_issuer"), F.min_by("title_of_class", order).alias("title_of_class"),
        F.sum("shares").alias("shares"), F.sum("value").alias("value"))


def split_factor(share_ratio: Column, price_ratio: Column) -> Column:
    """Factor a stock split explains, from share and implied-price ratios; 1.0 when none is plausible."""
    fwd, rev = 1 / price_ratio, price_ratio
    kf, kr = F.rint(fwd), F.rint(rev)      # half to even, without decimals
    is_fwd = (kf >= 2) & (F.abs(fwd - kf) / kf < 0.15) & (share_ratio / kf > 0.6) & (share_ratio / kf < 1.6)
    is_rev = (kr >= 2) & (F.abs(rev - kr) / kr < 0.15) & (share_ratio * kr > 0.6) & (share_ratio * kr < 1.6)
    usable = (price_ratio > 0) & (share_ratio > 0)
    return F.when(usable & is_fwd, kf).when(usable & is_rev, 1 / kr).otherwise(1.0)


def previous_filing(filings: DataFrame) -> DataFrame:
    """(cik, accession, prev_accession) in report order; one row per filing."""
    w = Window.partitionBy("cik").orderBy("report_date", "filing_date")
    return filings.select(*BOOK, "filing_date", "report_date", F.lag("accession").over(w).alias("prev_accession"))


def compare_quarters(holdings: DataFrame, filings: DataFrame) -> DataFrame:
    """Every position of every filing against the filer's previous filing.

    weight, raw share change, change relative to the filer's median (split-corrected), and a status:
    NEW, ADDED, REDUCED, UNCHANGED, EXITED or NO_PRIOR.
    """
    chain = previous_filing(filings)
    base = ["cusip", "name_of_issuer", "title_of_class", "shares", "value"]
    cur = holdings.select(*BOOK, *base)
    total = cur.groupBy(*BOOK).agg(F.sum("value").alias("_total"))
    prev = (holdings.select("cik", F.col("accession").alias("prev_accession"), "cusip", F.col("name_of_issuer").alias("_pn"),
                            F.col("title_of_class").alias("_pc"), F.col("shares").alias("prev_shares"), F.col("value").alias("prev_value"))
            .join(chain.filter(F.col("prev_accession").isNotNull()).select(*BOOK, "prev_accession"), ["cik", "prev_accession"])
            .drop("prev_accession"))
    both = (F.col("shares") > 0) & (F.col("prev_shares") > 0)
    ratio = F.when(F.col("prev_shares") > 0, F.col("shares") / F.col("prev_shares"))
    implied = (F.col("value") / F.when(F.col("shares") > 0, F.col("shares"))) / F.expr("nullif(prev_value / nullif(prev_shares, 0), 0)")
    # Written once with the two ratios: the medians below and the result read it. The full join is not repeated for each, and the
    # factor, which names the ratios twenty times over, stays short enough for the JVM to compile.
    j = cur.join(prev, [*BOOK, "cusip"], "full").join(chain, BOOK).join(total, BOOK, "left")
    j = cut_lineage(j.withColumn("_ratio", ratio).withColumn("_implied", F.when(both, implied)))
    first = F.col("prev_accession").isNull()
    j = j.withColumn("split_factor", F.when(both, split_factor(F.col("_ratio"), F.col("_implied"))).otherwise(1.0)) \
         .withColumn("_adj", F.when(both, F.col("_ratio") / F.col("split_factor")))
    med = exact_quantiles(j.filter(F.col("_adj").isNotNull()), BOOK, "_adj", {"_median": 0.5}).drop("n")
    j = j.join(med, BOOK, "left")
    change = F.col("_ratio") / F.col("split_factor") / F.coalesce("_median", F.lit(1.0)) - 1
    exited = F.coalesce(F.col("shares"), F.lit(0.0)) == 0
    status = (F.when(first, "NO_PRIOR").when(exited, "EXITED").when(F.coalesce(F.col("prev_shares"), F.lit(0.0)) == 0, "NEW")
              .when(change > CHANGE_THRESHOLD, "ADDED").when(change < -CHANGE_THRESHOLD, "REDUCED").otherwise("UNCHANGED"))
    gone = status == "EXITED"
    out = j.withColumns({
        "status": status, "adjusted_change": F.when(status.isin("ADDED", "REDUCED", "UNCHANGED"), change),
        "share_change": F.when(~first, F.col("_ratio") - 1),
        "weight": F.when(gone, 0.0).otherwise(F.coalesce(F.col("value") / F.expr("nullif(_total, 0)"), F.lit(0.0))),
        "name_of_issuer": F.when(gone, F.col("_pn")).otherwise(F.col("name_of_issuer")),
        "title_of_class": F.when(gone, F.col("_pc")).otherwise(F.col("title_of_class"))})
    return out.select(*BOOK, "filing_date", "report_date", "cusip", "name_of_issuer", "title_of_class",
                      F.when(F.col("status") == "EXITED", 0.0).otherwise(F.col("shares")).alias("shares"),
                      F.when(F.col("status") == "EXITED", 0.0).otherwise(F.col("value")).alias("value"),
                      "prev_shares", "prev_value", "weight", "share_change", "adjusted_change", "split_factor", "status")


def _top(df: DataFrame, by: list[str], order: list[Column], k: int, out: str = "_rn") -> DataFrame:
    """First k rows per group; the optimizer limits each group before the shuffle."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(out) <= k)


def select_positions(changes: DataFrame, top: int = 30, movers: int = 10, pool: int | None = None) -> DataFrame:
    """Largest positions, biggest adds (new first) and biggest cuts (exits first) of every filing.

    ``pool`` limits adds and cuts to positions among so many largest of a filing, by their value or, for
    exits, their previous one: smaller ones are then taken for noise. Without it every position counts.
    """
    by_value = [F.col("value").desc(), F.col("cusip")]
    held, known = changes.filter(F.col("status") != "EXITED"), changes.filter(F.col("prev_value").isNotNull())
    pooled, prev_pool = held, known
    if pool is not None:
        pooled = _top(held, BOOK, by_value, pool).drop("_rn")
        prev_pool = _top(known, BOOK, [F.col("prev_value").desc(), F.col("cusip")], pool).drop("_rn")
    largest = _top(held, BOOK, by_value, top if pool is None else min(top, pool)).drop("_rn")
    adds = _top(pooled.filter(F.col("status").isin("NEW", "ADDED")), BOOK, [F.col("adjusted_change").desc_nulls_first(), *by_value], movers).drop("_rn")
    cuts = _top(prev_pool.filter(F.col("status") == "EXITED").unionByName(pooled.filter(F.col("status") == "REDUCED")), BOOK,
                [F.col("adjusted_change").asc_nulls_first(), F.col("prev_value").desc(), F.col("cusip")], movers).drop("_rn")
    return latest_per_key(largest.unionByName(adds).unionByName(cuts), [*BOOK, "cusip"], ["status"])


def status_view(status: Column, slot: int) -> Column:
    out = F.lit(None).cast("string")
    for name, view in STATUS_VIEW.items():
        out = F.when(status == name, view[slot]).otherwise(out)
    return out


def resolve(positions: DataFrame, cusips: DataFrame) -> DataFrame:
    """Attach ticker and drop funds; unresolved cusips stay with a null ticker."""
    j = positions.join(cusips.select("cusip", "ticker", "security_type"), "cusip", "left")
    return j.filter(~F.coalesce(F.col("security_type").isin(FUND_TYPES), F.lit(False))).drop("security_type")


def money(value: Column) -> Column:
    a = F.abs(value)
    return (F.when(a >= 1e9, F.format_string("$%,.1fB", value / 1e9)).when(a >= 1e6, F.format_string("$%,.1fM", value / 1e6))
            .when(a >= 1e3, F.format_string("$%,.1fK", value / 1e3)).otherwise(F.format_string("$%,.0f", value)))


def describe(status: Column, rank: Column) -> Column:
    base = F.concat(F.format_string("Holds %,.0f shares (", "shares"), money(F.col("value")),
                    F.format_string(", %.2f%% of reported 13F portfolio", F.col("weight") * 100),
                    F.when(rank.isNotNull(), F.format_string(", #%d by value", rank)).otherwise(""), F.lit(")."))
    moved = F.concat(F.format_string(" Shares %+.1f%% vs prior quarter (%+.1f%% relative to the filer's median change",
                                     F.col("share_change") * 100, F.col("adjusted_change") * 100),
                     F.when(F.col("split_factor") != 1.0, F.concat(F.lit(", split-adjusted x"), F.expr(
                         "regexp_replace(format_string('%.6f', split_factor), '\\\\.?0+$', '')"))).otherwise(""), F.lit(")."))
    return (F.when(status == "EXITED", F.format_string("Exited the position (held %,.0f shares last quarter).", "prev_shares"))
            .when(status == "NEW", F.concat(base, F.lit(" New position this quarter.")))
            .when(status == "NO_PRIOR", F.concat(base, F.lit(" No prior quarter available to compare.")))
            .otherwise(F.concat(base, moved)))


def build_mentions(changes: DataFrame, selected: DataFrame, cusips: DataFrame, institutions: DataFrame) -> DataFrame:
    """Mention rows of the selected positions: view, confidence, description with the rank by value, evidence."""
    by_value = Window.partitionBy(*BOOK).orderBy(F.col("value").desc(), F.col("cusip"))      # one filing's book
    ranked = changes.filter(F.col("status") != "EXITED").select(*BOOK, "cusip", F.row_number().over(by_value).alias("value_rank"))
    s = F.col("status")
    rows = resolve(selected, cusips).join(ranked, [*BOOK, "cusip"], "left").join(institutions, "cik", "left")
    return rows.select(
        "institution", "cik", "accession", F.col("filing_date").alias("publication_date"), F.lit("13F").alias("report_type"),
        F.format_string("13F-HR holdings as of %s (filed %s)", F.col("report_date").cast("string"), F.col("filing_date").cast("string")).alias("report_title"),
        "ticker", F.col("name_of_issuer").alias("company_name"), describe(s, F.col("value_rank")).alias("institutional_view"),
        status_view(s, 0).alias("view_direction"), status_view(s, 1).alias("confidence"),
        F.format_string("13F information table, CUSIP %s (%s), status %s", "cusip", "title_of_class", "status").alias("evidence"),
        F.concat_ws(":", F.lit("13F"), "cik", "accession", "cusip").alias("chunk_id"))


HISTORY = ["filing_date", "report_date", "cik", "accession", "cusip", "ticker", "status", "value", "weight", "adjusted_change"]


def universe_history(holdings: DataFrame, filings: DataFrame, cusips: DataFrame) -> DataFrame:
    """Selected positions of every filer and quarter with direction and confidence."""
    changes = cut_lineage(compare_quarters(holdings, filings))      # read three times below
    sel = resolve(select_positions(changes), cusips)
    s = F.col("status")
    return sel.select(*HISTORY, F.col("name_of_issuer").alias("company_name"), status_view(s, 0).alias("view_direction"),
                      status_view(s, 1).alias("confidence"))


def position_history(holdings: DataFrame, filings: DataFrame, cusips: DataFrame, managers: DataFrame) -> DataFrame:
    """Every position of the listed managers, quarter by quarter."""
    mine = lambda df: df.join(managers.select("cik").distinct(), "cik", "left_semi")
    return resolve(compare_quarters(mine(holdings), mine(filings)), cusips).select(*HISTORY)


def refresh_summary(holdings: DataFrame, filings: DataFrame, cusips: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Live variant: only each filer's latest two quarters; mentions of the latest one and a row per filer."""
    recent = _top(original_filings(filings), ["cik"], [F.col("report_date").desc()], 2, "_q")
    books = holdings.join(recent.select(*BOOK), BOOK, "left_semi")
    sel = resolve(select_positions(cut_lineage(compare_quarters(books, recent.drop("_q")))), cusips) \
        .join(recent.filter("_q = 1").select(*BOOK), BOOK, "left_semi")
    count = lambda c: F.count_if(c)
    summary = sel.groupBy(*BOOK).agg(
        F.count(F.lit(1)).alias("mentions"), count(F.col("status") == "NEW").alias("new"), count(F.col("status") == "EXITED").alias("exited"),
        count(F.col("ticker").isNull()).alias("unresolved"))
    return sel, summary


# --- universes ----------------------------------------------------------------------------------------

def aggregate_direction() -> tuple[Column, Column]:
    """(score, label) aggregates over ``view_direction``."""
    mean = F.coalesce(F.avg(direction_value("view_direction")), F.lit(0.0))
    directional = F.coalesce(F.max(F.col("view_direction").isin("POSITIVE", "NEGATIVE")), F.lit(False))
    return F.round(mean, 4), direction_label(mean, directional)


def _has_ticker() -> Column:
    return F.col("ticker").isNotNull() & (F.trim("ticker") != "")


def pit_universe(history: DataFrame, dates: DataFrame, max_age: int = 200) -> DataFrame:
    """(date, member) rows from each filer's latest filing; unresolved members keep a null ticker."""
    filings = history.select("cik", "accession", "filing_date").distinct()
    live = latest_filings(filings, dates, max_age=max_age).select("date", *BOOK)
    rows = history.join(live, BOOK)
    score, _ = aggregate_direction()
    named = (rows.filter(_has_ticker()).groupBy("date", F.upper("ticker").alias("ticker"))
             .agg(F.min("cusip").alias("cusip"), F.countDistinct("cik").alias("institution_count"), score.alias("institutional_direction_score")))
    unnamed = (rows.filter(~_has_ticker()).groupBy("date", "cusip")
               .agg(F.countDistinct("cik").alias("institution_count"))
               .select("date", F.lit(None).cast("string").alias("ticker"), "cusip", "institution_count",
                       F.lit(None).cast("double").alias("institutional_direction_score")))
    return named.unionByName(unnamed)


def book_values(holdings: DataFrame, filings: DataFrame, dates: DataFrame, max_age: int = 200, ownership: float = 0.20) -> DataFrame:
    """(date, cusip): value across the filers' latest books, holders, and a rough market cap.

    Each book is summed once per (filing, cusip) and only then repeated for the dates it is live on.
    """
    live = latest_filings(filings, dates, max_age=max_age).select("date", *BOOK, "filing_date")
    unit = F.when(F.col("filing_date") < F.lit(DOLLAR_VALUES_FROM).cast("date"), 1000.0).otherwise(1.0)
    return (holdings.select(*BOOK, "cusip", "value").join(live, BOOK)
            .groupBy("date", "cusip").agg(F.sum(F.col("value") * unit).alias("total_13f_value"), F.countDistinct("cik").alias("holders"))
            .withColumn("rough_mcap", F.col("total_13f_value") / ownership))


def pit_broad_universe(holdings: DataFrame, history: DataFrame, filings: DataFrame, dates: DataFrame, cusips: DataFrame, top_n: int = 500,
                       max_age: int = 200) -> DataFrame:
    """The largest ``top_n`` stocks per date by summed 13F value, funds removed, cusips merged to tickers."""
    books = book_values(holdings, filings, dates, max_age)
    named = resolve(books, cusips).withColumn("_key", F.coalesce("ticker", F.concat(F.lit("CUSIP:"), "cusip")))
    best = F.struct(-F.col("total_13f_value"), F.col("cusip"))
    members = named.groupBy("date", "_key").agg(
        F.first("ticker").alias("ticker"), F.min_by("cusip", best).alias("cusip"), F.sum("total_13f_value").alias("total_13f_value"),
        F.max("holders").alias("institution_count"))
    members = _top(members, ["date"], [F.col("total_13f_value").desc(), F.col("_key")], top_n).drop("_rn", "_key")
    live = latest_filings(filings, dates, max_age=max_age).select("date", *BOOK)
    score, _ = aggregate_direction()
    views = (history.filter(_has_ticker()).join(live, BOOK).groupBy("date", F.upper("ticker").alias("ticker"))
             .agg(score.alias("_score")))
    out = members.withColumn("ticker", F.upper("ticker")).join(views, ["date", "ticker"], "left")
    return out.select("date", "ticker", "cusip", "institution_count",
                      F.when(F.col("ticker").isNotNull(), F.coalesce("_score", F.lit(0.0))).alias("institutional_direction_score"), "total_13f_value")


def active_manager_features(keys: DataFrame, positions: DataFrame, max_age: int = 200) -> DataFrame:
    """Did a listed manager open or add, and the largest weight; 0 if not held, null if no manager has a live filing."""
    ph = positions.filter(F.col("ticker").isNotNull()).withColumn("ticker", F.upper("ticker"))
    live = latest_filings(ph.select("cik", "accession", "filing_date").distinct(), keys, max_age=max_age).select("date", *BOOK)
    per = ph.join(live, BOOK).groupBy("date", "ticker").agg(
        F.max(F.col("status").isin("NEW", "ADDED").cast("double")).alias("_add"), F.max("weight").alias("_weight"))
    covered = live.select("date").distinct().withColumn("_live", F.lit(True))
    out = keys.join(covered, "date", "left").join(per, ["date", "ticker"], "left")
    fill = lambda c: F.when(F.col("_live"), F.coalesce(F.col(c), F.lit(0.0)))
    return out.withColumn("active_new_or_add", fill("_add")).withColumn("active_weight_max", fill("_weight")).drop("_add", "_weight", "_live")


def ownership_breadth_change(members: DataFrame, rows: int = 3) -> DataFrame:
    """Holders now minus holders ``rows`` membership dates earlier (one row per ticker and date)."""
    w = Window.partitionBy("ticker").orderBy("date")
    return members.withColumn("breadth_change", F.col("holders") - F.lag("holders", rows).over(w))


def with_institution_count(panel: DataFrame, membership: DataFrame) -> DataFrame:
    if "institution_count" in panel.columns:
        return panel
    counts = membership.filter(F.col("ticker").isNotNull()).select("date", "ticker", "institution_count")
    return panel.join(counts, ["date", "ticker"], "left")


def in_cap_band(books: DataFrame, low: float = 50e6, high: float = 4e9) -> DataFrame:
    """Cheap band on the rough market cap before identifiers are resolved."""
    return books.filter(F.col("rough_mcap").between(low, high))


def passes_filters(cap_min: float = 200e6, cap_max: float = 2e9, min_volume: float = 1e6, min_price: float = 3.0) -> Column:
    return F.coalesce(F.col("market_cap").between(cap_min, cap_max) & (F.col("dollar_volume_20d") > min_volume) & (F.col("raw_price") > min_price),
                      F.lit(False))
