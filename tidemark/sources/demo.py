"""A small lake of invented securities, the same in each run."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import security_key
from . import schemas, sinks
from .lake import Lake

END, DAYS, CODES = dt.date(2026, 9, 18), 500, ("90010", "90020", "90030", "90040")


def _filled(df: DataFrame, schema: str) -> DataFrame:
    spark = df.sparkSession
    return spark.createDataFrame([], schema).unionByName(df, allowMissingColumns=True)


def prices(spark: SparkSession) -> DataFrame:
    """Business days back from END; a close is a smooth function of security and day, with one split of two."""
    codes = spark.createDataFrame([(c, i) for i, c in enumerate(CODES)], "jpx_code string, i int")
    days = spark.range(DAYS * 7 // 5 + 7).select(F.date_sub(F.lit(END), F.col("id").cast("int")).alias("obs_date")).filter(F.dayofweek("obs_date").between(2, 6))
    rows = codes.crossJoin(F.broadcast(days))  # four rows by some hundred
    raw = F.round(1000 + 300 * F.col("i") + 80 * F.sin(F.datediff("obs_date", F.lit("2024-01-01").cast("date")) / 40.0 + F.col("i")), 1)
    split = F.when((F.col("i") == 1) & (F.col("obs_date") == "2026-04-01"), 0.5).otherwise(1.0)
    rows = rows.select(
        "jpx_code", F.concat(F.substring("jpx_code", 1, 4), F.lit(".T")).alias("target_key"), F.lit("jpx").alias("source_key"), "obs_date",
        *(raw.alias(f"raw_{c}_price") for c in ("open", "high", "low", "close")), *(raw.alias(f"{c}_price") for c in ("open", "high", "low", "close")),
        F.lit(1000.0).alias("volume"), F.lit("adjusted").alias("price_basis"), split.alias("adjustment_factor"), F.lit(1).cast("long").alias("ingestion_run_id"),
    )
    return _filled(rows, schemas.PRICE)


def disclosures(spark: SparkSession) -> DataFrame:
    """Quarters and years of fiscal 2025 and 2026 of all but the last security, which is a fund."""
    quarters = [("1Q", 0.23, 4), ("2Q", 0.48, 7), ("3Q", 0.72, 10), ("FY", 1.0, 13)]
    rows = []
    for i, code in enumerate(CODES[:-1]):
        for year in (2025, 2026):
            whole = 100_000 * (i + 1) * (1 + 0.05 * (year - 2025))
            for name, share, month in quarters:
                day = dt.date(year - 1 + (3 + month) // 12, (3 + month) % 12 + 1, 10 + i)
                if day <= END:
                    rows.append((code, f"{code[:4]}.T", "jpx", f"{year}{name}{code}", day, "15:00:00", "FYFinancialStatements_Consolidated_JP", name, dt.date(year - 1, 4, 1), dt.date(year, 3, 31), day.replace(day=1), "JP", "consolidated", 1, int(whole * share), int(whole * share * 0.1), int(whole * 0.11), int(whole * 0.12), 500.0 + 100 * i))
    schema = "jpx_code string, target_key string, source_key string, disclosure_number string, disclosed_date date, disclosed_time string, document_type string, fiscal_period_type string, fiscal_year_start date, fiscal_year_end date, period_end date, accounting_standard string, reporting_scope string, ingestion_run_id bigint, revenue bigint, operating_income bigint, forecast_operating_income bigint, next_forecast_operating_income bigint, bps double"
    return _filled(spark.createDataFrame(rows, schema), schemas.FINANCIAL)


def build(spark: SparkSession, root: str) -> Lake:
    master = spark.createDataFrame([(c, c, f"{c[:4]}.T", f"Invented {i}") for i, c in enumerate(CODES)], "security_key string, jpx_code string, target_key string, company_name string")
    sinks.write_by_year(prices(spark).withColumn("security_key", security_key()), f"{root}/observed/market_price", "obs_date")
    sinks.write_by_year(disclosures(spark).withColumn("security_key", security_key()), f"{root}/observed/financial_summary", "disclosed_date")
    sinks.write_reference(_filled(master, schemas.MASTER), f"{root}/reference/security_master")
    return Lake(spark, root)
