"""Readers: prices, insider tables and XML, 13F XML, XBRL JSON, filings, texts, entity lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.asof import latest_per_key
from ..operators.text import content_hash
from . import schemas as sm

# --- prices and tables ------------------------------------------------------------------------------------


def bars(spark: SparkSession, path: str, start=None, extended: bool = False) -> DataFrame:
    """OHLCV rows of a Parquet directory; the date cut is a pushed-down filter, NaN becomes null."""
    df = spark.read.schema(sm.EXTENDED_BARS if extended else sm.BARS).parquet(path)
    df = df.filter(F.col("close").isNotNull())
    if start is not None:
        df = df.filter(F.col("date") >= F.lit(start).cast("date"))
    return sm.nan_to_null(df)


def adjusted_bars(raw: DataFrame) -> DataFrame:
    """Vendor rows (open, high, low, close, adj_close, volume, split) with open/high/low scaled by adj_close / close."""
    ratio = F.col("adj_close") / F.col("close")
    return raw.filter(F.col("close").isNotNull() & F.col("adj_close").isNotNull()).select(
        "ticker", "date", *[(F.col(c) * ratio).alias(c) for c in ("open", "high", "low")], F.col("adj_close").alias("close"), "volume",
        F.col("close").alias("close_split_adj"), F.coalesce("split", F.lit(0.0)).alias("split"))


def gated(df: DataFrame, date: str, holdout_start, end=None, open_holdout: bool = False) -> DataFrame:
    """A development read: nothing from the holdout on. Asking for a later end raises."""
    start = F.lit(holdout_start).cast("date")
    if open_holdout:
        return df if end is None else df.filter(F.col(date) <= F.lit(end).cast("date"))
    if end is not None:
        if str(end) >= str(holdout_start):
            raise PermissionError(f"end {end} lies in the holdout (from {holdout_start})")
        return df.filter(F.col(date) <= F.lit(end).cast("date"))
    return df.filter(F.col(date) < start)


def chunk_table(spark: SparkSession, path: str) -> DataFrame:
    return sm.require_columns(spark.read.parquet(path), sm.CHUNK_COLUMNS)


def news_rows(headlines: DataFrame) -> DataFrame:
    """Headlines (ticker, title, published_at, publisher) shaped as chunk rows."""
    t = F.upper("ticker")
    return headlines.select(t.alias("ticker"), F.lit("NEWS").alias("filing_type"), F.col("published_at").alias("filing_date"), F.lit("News").alias("section"),
                            F.concat_ws("_", t, F.lit("NEWS"), F.substring(content_hash(F.col("title")), 1, 12)).alias("chunk_id"), F.lit(0).alias("chunk_index"),
                            F.col("title").alias("text"), F.coalesce("publisher", F.lit("unknown")).alias("source_file"))


def entity_list(spark: SparkSession, path: str | None, default: dict[str, int]) -> DataFrame:
    """(institution, cik) from a CSV with those columns, else the defaults."""
    if path is None:
        return spark.createDataFrame(sorted(default.items()), "institution string, cik long")
    df = spark.read.option("header", True).csv(path)
    return sm.require_columns(df, ["institution", "cik"]).select(F.trim("institution").alias("institution"), F.col("cik").cast("long").alias("cik")).dropna()


# --- insider trades ------------------------------------------------------------------------------------------

KEPT_CODES = ["P", "S"]


def number(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.try_cast("double")


def insider_bulk(spark: SparkSession, submissions: str, owners: str, transactions: str) -> DataFrame:
    """Original Form 4 purchases and sales by officers or directors from the three tab-separated tables."""
    read = lambda path, cols: spark.read.option("sep", "\t").option("header", True).option("quote", "").option("mode", "DROPMALFORMED").csv(path).select(*cols)
    s = read(submissions, ["ACCESSION_NUMBER", "FILING_DATE", "DOCUMENT_TYPE", "ISSUERCIK"]).filter(F.col("DOCUMENT_TYPE") == "4")
    o = read(owners, ["ACCESSION_NUMBER", "RPTOWNERCIK", "RPTOWNER_RELATIONSHIP"])
    t = read(transactions, ["ACCESSION_NUMBER", "TRANS_DATE", "TRANS_CODE", "TRANS_SHARES", "TRANS_PRICEPERSHARE"]).filter(F.upper("TRANS_CODE").isin(KEPT_CODES))
    role = F.coalesce("RPTOWNER_RELATIONSHIP", F.lit(""))
    o = o.withColumns({"is_director": role.contains("Director"), "is_officer": role.contains("Officer")}).filter("is_director or is_officer")
    shares, price = number("TRANS_SHARES"), number("TRANS_PRICEPERSHARE")
    day = lambda c: F.coalesce(F.try_to_date(c, "dd-MMM-yyyy"), F.try_to_date(F.initcap(c), "dd-MMM-yyyy"))
    return t.join(s, "ACCESSION_NUMBER").join(o, "ACCESSION_NUMBER").select(
        F.col("ACCESSION_NUMBER").alias("accession"), day(F.col("FILING_DATE")).alias("filing_date"), F.col("ISSUERCIK").try_cast("long").alias("issuer_cik"),
        F.col("RPTOWNERCIK").try_cast("long").alias("owner_cik"), "is_director", "is_officer", F.upper("TRANS_CODE").alias("trans_code"), day(F.col("TRANS_DATE")).alias("trans_date"),
        shares.alias("shares"), price.alias("price"), (shares * price).alias("value"))


def write_insider_quarters(tx: DataFrame, path: str) -> None:
    """Transactions partitioned by filing quarter, so a date range reads only its quarters."""
    tx.withColumn("quarter", F.year("filing_date") * 10 + F.quarter("filing_date")).write.mode("overwrite").partitionBy("quarter").parquet(path)


def insider_range(spark: SparkSession, path: str, start, end) -> tuple[DataFrame, DataFrame]:
    """(transactions filed in the quarters of [start, end], one-row coverage_end: last day of the last stored quarter)."""
    code = lambda d: (F.year(d) * 10 + F.quarter(d))
    lo, hi = F.to_date(F.lit(start)), F.to_date(F.lit(end))
    df = spark.read.parquet(path).filter(F.col("quarter").between(code(lo), code(hi)))
    q = df.agg(F.max("quarter").alias("q"))
    last = F.last_day(F.make_date(F.floor(F.col("q") / 10).cast("int"), (F.col("q") % 10 * 3).cast("int"), F.lit(1)))
    return df.drop("quarter"), q.select(last.alias("coverage_end"))


FORM4_SCHEMA = ("issuer struct<issuerCik:string>, "
                "reportingOwner array<struct<reportingOwnerId:struct<rptOwnerCik:string>, reportingOwnerRelationship:struct<isDirector:string, isOfficer:string>>>, "
                "nonDerivativeTable struct<nonDerivativeTransaction:array<struct<transactionDate:struct<value:string>, transactionCoding:struct<transactionCode:string>, "
                "transactionAmounts:struct<transactionShares:struct<value:string>, transactionPricePerShare:struct<value:string>>>>>")


def form4_xml(docs: DataFrame, xml: str = "xml") -> DataFrame:
    """Filings (accession, filing_date, xml text) to one row per (transaction, qualifying owner)."""
    flag = lambda c: F.lower(F.trim(F.coalesce(c, F.lit("")))).isin("1", "true")
    d = docs.withColumn("_x", F.from_xml(F.col(xml), FORM4_SCHEMA, {"ignoreNamespace": "true"}))
    d = d.select("accession", "filing_date", F.col("_x.issuer.issuerCik").try_cast("long").alias("issuer_cik"), F.col("_x.reportingOwner").alias("_owners"),
                 F.explode("_x.nonDerivativeTable.nonDerivativeTransaction").alias("t"))
    d = d.select("accession", "filing_date", "issuer_cik", "t", F.explode("_owners").alias("o"))
    rel = "o.reportingOwnerRelationship"
    d = d.withColumns({"is_director": flag(F.col(f"{rel}.isDirector")), "is_officer": flag(F.col(f"{rel}.isOfficer")), "trans_code": F.upper("t.transactionCoding.transactionCode")})
    shares, price = number("t.transactionAmounts.transactionShares.value"), number("t.transactionAmounts.transactionPricePerShare.value")
    return d.filter((F.col("is_director") | F.col("is_officer")) & F.col("trans_code").isin(KEPT_CODES)).select(
        "accession", "filing_date", "issuer_cik", F.col("o.reportingOwnerId.rptOwnerCik").try_cast("long").alias("owner_cik"), "is_director", "is_officer", "trans_code",
        F.try_to_date("t.transactionDate.value").alias("trans_date"), shares.alias("shares"), price.alias("price"), (shares * price).alias("value"))


def load_transactions(spark: SparkSession, source: str, bulk: DataFrame | None = None, per_issuer: DataFrame | None = None) -> DataFrame:
    """The bulk table or the per-issuer table, same columns either way."""
    chosen = {"bulk": bulk, "issuer": per_issuer}.get(source)
    if chosen is None:
        raise ValueError(f"no insider table for source {source!r}")
    return chosen.select("accession", "filing_date", "issuer_cik", "owner_cik", "is_director", "is_officer", "trans_code", "trans_date", "shares", "price", "value")


# --- 13F -------------------------------------------------------------------------------------------------------

INFO_TABLE_SCHEMA = ("infoTable array<struct<nameOfIssuer:string, titleOfClass:string, cusip:string, value:string, "
                     "shrsOrPrnAmt:struct<sshPrnamt:string, sshPrnamtType:string>, putCall:string>>")


def information_tables(docs: DataFrame, xml: str = "xml") -> DataFrame:
    """Filings (cik, accession, xml) to position rows: no options, no principal amounts, numbers cleaned; row order kept."""
    d = docs.withColumn("_x", F.from_xml(F.col(xml), INFO_TABLE_SCHEMA, {"ignoreNamespace": "true"}))
    d = d.select("cik", "accession", F.posexplode("_x.infoTable").alias("row_no", "r"))
    clean = lambda c: number(F.regexp_replace(F.coalesce(F.col(c), F.lit("0")), ",", ""))
    out = d.filter((F.coalesce("r.putCall", F.lit("")) == "") & (F.upper(F.coalesce("r.shrsOrPrnAmt.sshPrnamtType", F.lit("SH"))) == "SH")).select(
        "cik", "accession", "row_no", F.upper("r.cusip").alias("cusip"), F.col("r.nameOfIssuer").alias("name_of_issuer"), F.col("r.titleOfClass").alias("title_of_class"),
        clean("r.shrsOrPrnAmt.sshPrnamt").alias("shares"), clean("r.value").alias("value"))
    return out.filter((F.coalesce("cusip", F.lit("")) != "") & F.col("shares").isNotNull() & F.col("value").isNotNull())


# --- XBRL ---------------------------------------------------------------------------------------------------------

XBRL_SCHEMA = "cik long, facts map<string, map<string, struct<units:map<string, array<struct<start:string, end:string, val:double, filed:string, form:string, accn:string>>>>>>"


def xbrl_facts(docs: DataFrame, json: str = "json") -> DataFrame:
    """Company documents (JSON text) to (cik, ns, tag, unit, start, end, val, filed, form) rows of the kept forms."""
    from ..operators.facts import FORMS

    d = docs.select(F.from_json(json, XBRL_SCHEMA).alias("d")).select(F.col("d.cik").alias("cik"), F.explode("d.facts").alias("ns", "tags"))
    d = d.select("cik", "ns", F.explode("tags").alias("tag", "body")).select("cik", "ns", "tag", F.explode("body.units").alias("unit", "rows"))
    d = d.select("cik", "ns", "tag", "unit", F.inline("rows"))
    return d.filter(F.col("form").isin(FORMS)).select("cik", "ns", "tag", "unit", F.try_to_date("start").alias("start"), F.try_to_date("end").alias("end"), "val",
                                                      F.try_to_date("filed").alias("filed"), "form")


def statement_rows(payloads: DataFrame) -> DataFrame:
    """(ticker, payload map<statement, map<line item, map<period, value>>>) to long statement rows; bad periods drop."""
    d = payloads.select("ticker", F.explode("payload").alias("statement", "items")).select("ticker", "statement", F.explode("items").alias("line_item", "periods"))
    d = d.select("ticker", "statement", "line_item", F.explode("periods").alias("period", "value"))
    return d.select("ticker", "statement", "line_item", F.try_to_date("period").alias("period_end"), F.when(~F.isnan("value"), F.col("value")).alias("value")) \
            .filter(F.col("period_end").isNotNull())


# --- filings and texts -----------------------------------------------------------------------------------------------

def latest_filing_by_form(filings: DataFrame, forms: Sequence[str] = ("10-K", "10-Q", "20-F")) -> DataFrame:
    """The newest filing of the first form in ``forms`` an issuer has."""
    rank = F.array_position(F.array(*[F.lit(f) for f in forms]), F.col("form"))
    return latest_per_key(filings.filter(rank > 0), ["cik"], [-rank, F.col("filing_date"), F.col("accession")])


def filing_list(filings: DataFrame, since, forms: Sequence[str] = ("10-K", "10-Q")) -> DataFrame:
    """Original filings since a date that name a document, one row per accession (the last listed), oldest first."""
    f = filings.filter(F.col("form").isin(list(forms)) & (F.col("filing_date") >= F.lit(since).cast("date")) & (F.coalesce("primary_document", F.lit("")) != ""))
    return latest_per_key(f, ["accession"], ["listed_no"]).orderBy("filing_date", "accession")


# Date phrases in the order they are tried.
DATE_PHRASES = [
    r"(?i)filed\s+on\s+([A-Z][a-z]+\s+\d{1,2},\s+\d{4})",
    r"(?i)for\s+the\s+fiscal\s+year\s+ended\s+([A-Z][a-z]+\s+\d{1,2},\s+\d{4})",
    r"(?i)quarter\s+ended\s+([A-Z][a-z]+\s+\d{1,2},\s+\d{4})",
    r"(?i)as\s+of\s+([A-Z][a-z]+\s+\d{1,2},\s+\d{4})",
    r"\b(\d{4}-\d{2}-\d{2})\b",
]


def first_date(text: Column) -> Column:
    found = [F.regexp_extract(text, p, 1) for p in DATE_PHRASES]
    tidy = lambda c: F.regexp_replace(F.initcap(c), r"\s+", " ")
    return F.coalesce(*[F.coalesce(F.try_to_date(tidy(c), "MMMM d, yyyy"), F.try_to_date(tidy(c), "MMM d, yyyy"), F.try_to_date(c, "yyyy-MM-dd")) for c in found])


def document_metadata(docs: DataFrame) -> DataFrame:
    """Files (source_file, text) with ticker, filing type, date and accession number where the text states them."""
    t = F.col("text")
    some = lambda c: F.nullif(c, F.lit(""))
    return docs.select(
        F.upper(F.regexp_replace(F.regexp_extract("source_file", r"([^/]+)$", 1), r"\.txt$", "")).alias("ticker"),
        some(F.upper(F.regexp_extract(t, r"(?i)\b(10-Q|10-K|20-F)\b", 1))).alias("filing_type"), first_date(t).alias("filing_date"),
        F.coalesce(some(F.regexp_extract(t, r"(?i)accession\s+number\s*[:\-]?\s*([0-9]{10}-[0-9]{2}-[0-9]{6})", 1)),
                   some(F.regexp_extract(t, r"\b([0-9]{10}-[0-9]{2}-[0-9]{6})\b", 1))).alias("accession_number"), "source_file", "text")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("source_file"), F.col("value").alias("text"))


def report_corpus(files: DataFrame, sidecars: DataFrame | None = None) -> DataFrame:
    """Report files (source_path, text): institution = folder, title and date guessed unless a side-car row states them; empty files drop."""
    r = files.filter(F.trim("text") != "").select(
        "source_path", "text", F.regexp_extract("source_path", r"([^/]+)/[^/]+$", 1).alias("institution"),
        F.initcap(F.regexp_replace(F.regexp_extract("source_path", r"([^/]+)\.[^./]+$", 1), r"[_\-]+", " ")).alias("_title"), first_date(F.col("text")).alias("_date"),
        F.sha2(F.col("text"), 256).alias("content_hash"), F.length("text").alias("char_count"))
    if sidecars is None:
        return r.withColumnsRenamed({"_title": "report_title", "_date": "publication_date"})
    s = sidecars.select("source_path", F.col("institution").alias("_si"), F.col("report_title").alias("_st"), F.col("publication_date").alias("_sd"))
    return r.join(s, "source_path", "left").select(
        "source_path", "text", F.coalesce("_si", "institution").alias("institution"), F.coalesce(F.nullif(F.col("_st"), F.lit("")), F.col("_title")).alias("report_title"),
        F.coalesce("_sd", "_date").alias("publication_date"), "content_hash", "char_count")
