"""Staging views over raw responses: JSON items as typed columns. What does not fit its type is null."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as n
from . import schemas
from .raw import exploded, latest_disclosures

_COMPANY = {c: (f"$.{c}", "string") for c in ("edinet_code", "security_code", "security_name", "industry")}
_AMOUNTS = "revenue gross_profit selling_general_admin_expenses operating_income ordinary_income net_income total_assets equity operating_cash_flow investing_cash_flow financing_cash_flow cash_equivalents".split()
_ACTUAL = {
    **{c: (f"$.{c}", "string") for c in ("edinet_code", "document_id", "reporting_scope", "accounting_standard", "submit_date")},
    "fiscal_year": ("$.fiscal_year", "int"),
    **{c: (f"$.{c}", "decimal(38,9)") for c in _AMOUNTS},
}
_HEAD = {
    "jpx_code": "Code", "disclosure_number": "DiscNo", "_date": "DiscDate", "disclosed_time": "DiscTime", "document_type": "DocType", "fiscal_period_type": "CurPerType",
    "_ps": "CurPerSt", "_pe": "CurPerEn", "_fs": "CurFYSt", "_fe": "CurFYEn",
}
_FIGURES = [f"{p}{m}" for p in ("", "forecast_", "next_forecast_") for m in ("revenue", "operating_income", "net_income")]


def security_master(responses: DataFrame) -> DataFrame:
    return exploded(responses, "data", _COMPANY).select(*_COMPANY, "ingestion_run_id")


def financial_actual(responses: DataFrame) -> DataFrame:
    """Annual reports; submit_date is a Tokyo minute, available_at the same moment in UTC."""
    rows = exploded(responses, "data", _ACTUAL)
    moment = F.to_utc_timestamp(F.try_to_timestamp("submit_date", F.lit("yyyy-MM-dd HH:mm")), "Asia/Tokyo")
    return rows.withColumn("available_at", moment).drop("payload_json")


def financial_disclosure(responses: DataFrame) -> DataFrame:
    """Disclosures, one for each code and number: of the latest run. Any document type of three parts names scope and standard here."""
    fields = {c: (f"$.{f}", "string") for c, f in _HEAD.items()}
    for c in _FIGURES:
        both, alone = schemas.AMOUNTS[c]
        fields |= {f"_{c}": (f"$.{both}", "string"), f"_nc_{c}": (f"$.{alone}", "string")}
    standard, scope = n.reporting(F.col("document_type"), strict=False)
    rows = exploded(responses, "data", fields).withColumns({"accounting_standard": standard, "reporting_scope": F.coalesce(scope, F.lit("consolidated"))})
    figure = lambda c: n.text(n.scoped(F.col("reporting_scope"), F.col(f"_{c}"), F.col(f"_nc_{c}"))).try_cast("decimal(38,9)")
    rows = rows.select(
        F.concat(F.substring("jpx_code", 1, 4), F.lit(".T")).alias("security_key"),
        "jpx_code",
        "disclosure_number",
        n.day(F.col("_date")).alias("disclosed_date"),
        n.text(F.col("disclosed_time")).alias("disclosed_time"),
        n.available_at(n.day(F.col("_date")), F.col("disclosed_time")).alias("available_at"),
        "document_type",
        "fiscal_period_type",
        *(n.day(F.col(f)).alias(c) for c, f in {"period_start": "_ps", "period_end": "_pe", "fiscal_year_start": "_fs", "fiscal_year_end": "_fe"}.items()),
        "accounting_standard",
        "reporting_scope",
        *(figure(c).alias(c) for c in _FIGURES),
        "ingestion_run_id",
        "fetched_at",
        "raw_uri",
        "response_sha256",
        "source_record_hash",
    )
    return latest_disclosures(rows)
