"""Price to book as it could be known on each day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scan
from ..functions.columns import pick_first


#: Prices of a security from which on its years are scanned apart.
HOT = 1_000_000


def _curve(rows: DataFrame, day: Column, counts: Column, by_year: bool = True) -> DataFrame:
    """The curve over rows in the order of a day; only those that count move it, and they come first on their day."""
    valid = F.coalesce(F.col("adjustment_factor") > 0, F.lit(False))
    wanted = {
        "factor_coverage_start": ("min", F.when(counts, day)),
        "invalid_factor_count": ("sum", F.when(valid | ~counts, 0).otherwise(1)),
        "_log_factor": ("sum", F.ln(F.when(valid & counts, F.col("adjustment_factor")).otherwise(1.0))),
    }
    rows = scan.running(rows.withColumn("_part", scan.year_of(day)), "security_key", "_part", [day, F.when(counts, 0).otherwise(1)], wanted, by_year)
    return rows.withColumn("cumulative_adjustment_factor", F.exp("_log_factor")).drop("_log_factor", "_part")


def factor_curve(prices: DataFrame) -> DataFrame:
    """Adds the running adjustment factor (invalid ones count as 1), how many were invalid so far, and where the curve begins."""
    return _curve(prices, F.col("obs_date"), F.lit(True))


def same_day_order() -> list:
    """Of one day's disclosures: consolidated first, then the latest time, then the highest number."""
    return [F.when(F.col("reporting_scope") == "consolidated", 0).otherwise(1), F.col("disclosed_time").desc_nulls_last(), F.col("disclosure_number").desc_nulls_last()]


def point_in_time_pbr(prices: DataFrame, disclosures: DataFrame, sources: Sequence[str], by_year: bool | None = None) -> DataFrame:
    """Price to book of each day from the latest disclosure strictly before it, with the book value moved by splits since its period.

    prices: preferred prices, of which only those of `sources` are used. calculation_status says what the first obstacle was.
    Prices and disclosures of a security are united once; two running scans do the curve and both as-of steps. by_year: whether they run by
    (security, year), so that a security's whole past is never one task's; None counts the rows of securities first and does so if
    one has more than HOT. Either way gives the same rows.
    """
    kept = prices.filter(F.col("source_key").isin(list(sources)))
    if by_year is None:
        most = kept.groupBy("security_key").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first().n
        by_year = (most or 0) > HOT
    dated = disclosures.filter(F.col("bps").isNotNull() & F.col("security_key").isNotNull() & F.col("disclosed_date").isNotNull())
    facts = pick_first(dated, ["security_key", "disclosed_date"], same_day_order())
    fields = {
        "disclosure_number": "disclosure_number",
        "financial_disclosed_date": "disclosed_date",
        "financial_disclosed_time": "disclosed_time",
        "financial_period_end": "period_end",
        "accounting_standard": "accounting_standard",
        "reporting_scope": "reporting_scope",
        "reported_bps": "bps",
        "financial_ingestion_run_id": "ingestion_run_id",
    }
    facts = facts.select("security_key", F.struct(*(F.col(c).alias(name) for name, c in fields.items())).alias("_fact"))
    rows = kept.withColumn("_side", F.lit(0)).unionByName(facts.withColumn("_side", F.lit(1)), allowMissingColumns=True)

    # A disclosure stands in the curve at its period's end, after that day's price, and adds nothing to it: so it gets the curve's values there.
    rows = _curve(rows, F.coalesce("obs_date", "_fact.financial_period_end"), F.col("_side") == 0, by_year)
    placed = F.col("_fact.financial_period_end").isNotNull() & F.col("factor_coverage_start").isNotNull()
    at_end = F.struct(F.when(placed, F.col("cumulative_adjustment_factor")).alias("factor"), F.when(placed, F.col("invalid_factor_count")).alias("invalid"))
    rows = rows.withColumn("_known", F.when(F.col("_side") == 1, F.struct("_fact.*", at_end.alias("end"))))
    # Then it stands at its day, after that day's price: so each price has the latest one strictly before it.
    seen = F.coalesce("obs_date", "_fact.financial_disclosed_date")
    rows = scan.running(rows.withColumn("_part", scan.year_of(seen)), "security_key", "_part", [seen, F.col("_side")], {"_latest": ("last", F.col("_known"))}, by_year).filter("_side = 0")
    rows = rows.drop("_known").withColumnRenamed("_latest", "_known")
    rows = rows.select(*(c for c in rows.columns if c not in ("_side", "_fact", "_known", "_part")), *(F.col("_known")[c].alias(c) for c in fields), F.col("_known.end.factor").alias("_end_factor"), F.col("_known.end.invalid").alias("_end_invalid"))

    unmoved = F.col("_end_factor").isNotNull() & (F.col("invalid_factor_count") <= F.col("_end_invalid"))
    book = F.col("reported_bps") > 0
    close = F.col("raw_close_price") > 0
    adjusted = F.col("reported_bps") * F.col("cumulative_adjustment_factor") / F.col("_end_factor")
    status = (
        F.when(~F.coalesce(close, F.lit(False)), "invalid_raw_close")
        .when(F.col("disclosure_number").isNull(), "financial_not_available")
        .when(~book, "non_positive_bps")
        .when(F.col("financial_period_end").isNull(), "financial_period_end_missing")
        .when((F.col("factor_coverage_start") > F.col("financial_period_end")) | F.col("_end_factor").isNull(), "insufficient_factor_history")
        .when(F.col("invalid_factor_count") > F.col("_end_invalid"), "invalid_adjustment_factor")
        .otherwise("ok")
    )
    rows = rows.withColumns(
        {
            "bps_adjustment_factor": F.when(unmoved, F.col("cumulative_adjustment_factor") / F.col("_end_factor")),
            "adjusted_bps": F.when(book & unmoved, adjusted),
            "pbr": F.when(close & book & unmoved, F.col("raw_close_price") / adjusted),
            "calculation_status": status,
        }
    )
    rows = rows.withColumn("is_below_book_value", F.col("pbr") < 1)
    return rows.withColumnRenamed("obs_date", "as_of_date").withColumnRenamed("close_price", "adjusted_close_price").withColumnRenamed("source_key", "price_source_key").drop("_end_factor", "_end_invalid")


def latest_below_book(pbr: DataFrame) -> DataFrame:
    """Of each security's latest day those below book value: the latest first, then the filter."""
    latest = pick_first(pbr, ["security_key"], [F.desc("as_of_date")])
    return latest.filter((F.col("calculation_status") == "ok") & F.col("is_below_book_value"))
