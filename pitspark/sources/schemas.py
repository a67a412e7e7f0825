"""Column contracts of the tables the library reads and writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BARS = "ticker string, date date, open double, high double, low double, close double, volume double"
EXTENDED_BARS = BARS + ", close_split_adj double, split double"
HOLDINGS = "cik long, accession string, cusip string, name_of_issuer string, title_of_class string, shares double, value double"
FILINGS = "cik long, accession string, filing_date date, report_date date"
TRANSACTIONS = ("accession string, filing_date date, issuer_cik long, owner_cik long, is_director boolean, is_officer boolean, trans_code string, "
                "trans_date date, shares double, price double, value double")
FACTS = "cik long, kind string, field string, end date, filed date, val double, derived boolean"
SECTIONS = "cik long, accession string, form string, filing_date date, report_date date, risk_factors string, mdna string, status string"
CHUNK_COLUMNS = ["ticker", "filing_type", "filing_date", "section", "chunk_id", "chunk_index", "text", "source_file"]
MEMBERSHIP = "date date, ticker string, cusip string, institution_count long, institutional_direction_score double"
EVENTS = "signal_date date, ticker string, strength double"
REGISTRY = ("variant_id string, family string, description string, params string, dev_start date, dev_end date, months long, mean_rank_ic double, ic_tstat double, "
            "sharpe double, annualized double, timestamp timestamp")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing numbers are null from the scan on; Spark would sort NaN above everything and call it equal to itself."""
    return df.select(*[F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
                       for f in df.schema.fields])


def require_columns(df: DataFrame, columns) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df
