"""Forecasts: from when to when each was the one known, and how well they did."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.columns import any_present, next_year, pick_first, valid_on
from .valuation import same_day_order


def point_in_time_forecast(disclosures: DataFrame) -> DataFrame:
    """Forecasts of each fiscal year with the days on which they were the visible one: [as_of_date, superseded_at).

    Quarters bring the current year's forecast, a year's end that of the next year. One a day; visible from the day after.
    """
    quarter = F.col("fiscal_period_type").isin("1Q", "2Q", "3Q")
    annual = F.col("fiscal_period_type") == "FY"
    # One scan: a disclosure is of one kind, so both sides of the union are a choice of columns.
    value = F.when(quarter, F.col("forecast_operating_income")).when(annual, F.col("next_forecast_operating_income"))
    year = F.when(quarter, F.col("fiscal_year_end")).when(annual, next_year(F.col("fiscal_year_end")))
    rows = disclosures.withColumns({"forecast_operating_income": value, "fiscal_year_end": year}).filter(F.col("forecast_operating_income").isNotNull())
    rows = rows.repartition("security_key", "fiscal_year_end")  # the one shuffle of both windows
    rows = pick_first(rows, ["security_key", "fiscal_year_end", "disclosed_date"], same_day_order())
    by = W.partitionBy("security_key", "fiscal_year_end").orderBy("disclosed_date", "disclosure_number")
    return rows.withColumn("as_of_date", F.date_add("disclosed_date", 1)).withColumns({"superseded_at": F.lead("as_of_date").over(by), "forecast_seq": F.row_number().over(by).cast("long")})


def forecast_at(forecasts: DataFrame, day: Column) -> DataFrame:
    """The one forecast of each security and fiscal year that was visible on a day."""
    return forecasts.filter(valid_on(day, "as_of_date", "superseded_at"))


def forecast_accuracy(forecasts: DataFrame, disclosures: DataFrame) -> DataFrame:
    """Each forecast visible before the first release of its year's actual against that actual, as shares of its revenue."""
    actual = disclosures.filter((F.col("fiscal_period_type") == "FY") & F.col("operating_income").isNotNull())
    actual = pick_first(actual, ["security_key", "fiscal_year_end"], [F.col("disclosed_date").asc_nulls_last(), F.col("disclosure_number").asc_nulls_last()])
    actual = actual.select(
        "security_key",
        "fiscal_year_end",
        F.col("operating_income").alias("actual_operating_income"),
        F.col("revenue").alias("actual_revenue"),
        F.col("accounting_standard").alias("actual_accounting_standard"),
        F.col("reporting_scope").alias("actual_reporting_scope"),
        F.col("disclosed_date").alias("actual_disclosed_date"),
        F.col("disclosure_number").alias("actual_disclosure_number"),
    )
    made = forecasts.select(
        "security_key",
        "fiscal_year_end",
        "forecast_seq",
        "as_of_date",
        "superseded_at",
        "forecast_operating_income",
        F.col("accounting_standard").alias("forecast_accounting_standard"),
        F.col("reporting_scope").alias("forecast_reporting_scope"),
        F.col("disclosed_date").alias("forecast_disclosed_date"),
        F.col("disclosure_number").alias("forecast_disclosure_number"),
    )
    rows = made.join(actual, ["security_key", "fiscal_year_end"]).filter(F.col("as_of_date") <= F.col("actual_disclosed_date"))
    latest = F.row_number().over(W.partitionBy("security_key", "fiscal_year_end").orderBy(F.desc("forecast_seq"))) == 1
    error = F.col("actual_operating_income") - F.col("forecast_operating_income")
    status = (
        F.when(~F.coalesce(F.col("actual_revenue") > 0, F.lit(False)), "revenue_unavailable")
        .when(~F.col("actual_accounting_standard").eqNullSafe(F.col("forecast_accounting_standard")), "accounting_standard_mismatch")
        .when(~F.col("actual_reporting_scope").eqNullSafe(F.col("forecast_reporting_scope")), "reporting_scope_mismatch")
        .otherwise("ok")
    )
    rows = rows.withColumns({"is_latest_forecast": latest, "error_amount": error, "comparison_status": status})
    share = F.when(F.col("comparison_status") == "ok", F.col("error_amount") / F.col("actual_revenue").cast("double") * 100)
    outcome = F.when(error > 0, "beat").when(error < 0, "miss").otherwise("in_line")
    return rows.withColumns({"error_pct_of_revenue": share, "abs_error_pct_of_revenue": F.abs(share), "outcome": outcome})


def with_any(disclosures: DataFrame, columns: Sequence[str], limit: int | None = None) -> DataFrame:
    """Disclosures that carry any of the columns, the newest first."""
    rows = disclosures.filter(any_present(columns)).orderBy(*_newest())
    return rows if limit is None else rows.limit(limit)


def with_any_of_each(disclosures: DataFrame, columns: Sequence[str], limit: int) -> DataFrame:
    """The same for all securities: the `limit` newest of each. The rank cuts rows down before the shuffle."""
    rank = F.row_number().over(W.partitionBy("security_key").orderBy(*_newest()))
    return disclosures.filter(any_present(columns)).withColumn("_rank", rank).filter(F.col("_rank") <= limit).drop("_rank")


def _newest() -> list:
    return [F.col("disclosed_date").desc_nulls_last(), F.col("disclosed_time").desc_nulls_last(), F.col("disclosure_number").desc_nulls_last()]


def revisions(disclosures: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds for each column its change from the disclosure before; null if either is missing."""
    by = W.partitionBy("security_key").orderBy("disclosed_date", F.col("disclosed_time").asc_nulls_first(), "disclosure_number")
    return disclosures.withColumns({f"{c}_change": F.col(c) - F.lag(c).over(by) for c in columns})


def latest_parts(disclosures: DataFrame, parts: dict[str, Sequence[str]]) -> DataFrame:
    """For each security the newest disclosure that carries any of a part's columns, for all parts in one aggregation.

    parts: name to columns. Gives one struct column for each part with disclosed_date, disclosure_number and the columns.
    """
    newest = F.struct("disclosed_date", F.coalesce("disclosed_time", F.lit("")), "disclosure_number")
    found = [F.max_by(F.when(any_present(c), F.struct("disclosed_date", "disclosure_number", *c)), F.when(any_present(c), newest)).alias(name) for name, c in parts.items()]
    return disclosures.groupBy("security_key").agg(*found)
