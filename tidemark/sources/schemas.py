"""Schemas of the stored datasets. They are declared, never inferred; year exists as a partition only."""

from __future__ import annotations

PRICE = """
target_key string, jpx_code string, source_key string, obs_date date,
raw_open_price double, raw_high_price double, raw_low_price double, raw_close_price double,
raw_volume double, turnover_value double,
open_price double, high_price double, low_price double, close_price double, volume double,
price_basis string, adjustment_factor double, market_cap_million_yen double, ex_rights_type string,
upper_limit_flag boolean, lower_limit_flag boolean, ingestion_run_id bigint, built_at timestamp
"""

#: The provider's field for each amount: consolidated, and of the company alone where that has its own.
AMOUNTS = {
    "revenue": ("Sales", "NCSales"),
    "operating_income": ("OP", "NCOP"),
    "ordinary_income": ("OdP", "NCOdP"),
    "net_income": ("NP", "NCNP"),
    "total_assets": ("TA", "NCTA"),
    "equity": ("Eq", "NCEq"),
    "forecast_revenue": ("FSales", "FNCSales"),
    "forecast_operating_income": ("FOP", "FNCOP"),
    "forecast_ordinary_income": ("FOdP", "FNCOdP"),
    "forecast_net_income": ("FNP", "FNCNP"),
    "next_forecast_revenue": ("NxFSales", "NxFNCSales"),
    "next_forecast_operating_income": ("NxFOP", "NxFNCOP"),
    "next_forecast_ordinary_income": ("NxFOdP", "NxFNCOdP"),
    "next_forecast_net_income": ("NxFNp", "NxFNCNP"),
    "operating_cash_flow": ("CFO", "CFO"),
    "investing_cash_flow": ("CFI", "CFI"),
    "financing_cash_flow": ("CFF", "CFF"),
    "cash_equivalents": ("CashEq", "CashEq"),
    "shares_outstanding": ("ShOutFY", "ShOutFY"),
    "treasury_shares": ("TrShFY", "TrShFY"),
    "average_shares": ("AvgSh", "AvgSh"),
}
PER_SHARE = {
    "eps": ("EPS", "NCEPS"),
    "bps": ("BPS", "NCBPS"),
    "forecast_eps": ("FEPS", "FNCEPS"),
    "next_forecast_eps": ("NxFEPS", "NxFNCEPS"),
    "annual_dividend_per_share": ("DivAnn", "DivAnn"),
    "forecast_annual_dividend_per_share": ("FDivAnn", "FDivAnn"),
    "distribution_per_unit": ("DivUnit", "DivUnit"),
    "next_forecast_distribution_per_unit": ("NxFDivUnit", "NxFDivUnit"),
}
FINANCIAL_HEAD = """
jpx_code string, target_key string, source_key string, disclosure_number string,
disclosed_date date, disclosed_time string, document_type string, fiscal_period_type string,
period_start date, period_end date, fiscal_year_start date, fiscal_year_end date,
accounting_standard string, reporting_scope string, source_record_hash string,
ingestion_run_id bigint, built_at timestamp
"""
FINANCIAL = ", ".join([FINANCIAL_HEAD, *(f"{c} bigint" for c in sorted(AMOUNTS)), *(f"{c} double" for c in sorted(PER_SHARE))])

MASTER = """
security_key string, jpx_code string, target_key string, company_name string, company_name_english string,
product_category_code string, market_code string, market_name string, sector_17_code string, sector_17_name string,
sector_33_code string, sector_33_name string, scale_category string, source_key string,
source_date date, ingestion_run_id bigint, built_at timestamp
"""

RAW_PRICE = ", ".join(f"{c} string" for c in "Date Code O H L C Vo Va AdjFactor MktCap ExRT UL LL AdjO AdjH AdjL AdjC AdjVo".split())
RAW_FINANCIAL = ", ".join(
    f"{c} string"
    for c in dict.fromkeys([*"Code DiscNo DiscDate DiscTime DocType CurPerType CurPerSt CurPerEn CurFYSt CurFYEn".split(), *(f for pair in [*AMOUNTS.values(), *PER_SHARE.values()] for f in pair)])
)
RESPONSE = """
raw_object_key string, source string, endpoint string, unit_key string, snapshot_date date,
request_url string, fetched_at timestamp, http_status int, record_count bigint, response_sha256 string, raw_uri string,
ingestion_run_id bigint, payload_json string
"""
