"""Diagnostics over the comparison fact."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.columns import next_year, ratio


def _ok(fact: DataFrame, metric: str, kind: str) -> DataFrame:
    return fact.filter((F.col("metric_key") == metric) & (F.col("comparison_type") == kind) & (F.col("comparison_status") == "ok"))


def availability(fact: DataFrame, metric: str = "operating_income", kind: str = "forecast_variance") -> DataFrame:
    """Rows, securities and share of each status, the most rows first. The window runs over one row for each status."""
    rows = fact.filter((F.col("metric_key") == metric) & (F.col("comparison_type") == kind))
    counted = rows.groupBy("comparison_status").agg(F.count(F.lit(1)).alias("row_count"), F.count_distinct("security_key").alias("security_count"))
    return counted.withColumn("row_rate", ratio(F.col("row_count"), F.sum("row_count").over(W.partitionBy()))).orderBy(F.desc("row_count"), "comparison_status")


def _grid(df: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Each row once for each threshold, without a join."""
    return df.withColumn("threshold", F.explode(F.array(*(F.lit(float(t)) for t in thresholds))))


def calibration(fact: DataFrame, thresholds: Sequence[float] = (-5, -10, -20, -30, -50), lineage: Sequence[str] = ("raw_uri", "response_sha256", "source_record_hash")) -> DataFrame:
    """How many comparisons would fire at each threshold in each fiscal year, years in order and thresholds from the highest.

    The distinct count expands each row once more; both parts are combined before they move.
    """
    fired = F.col("observed_value") <= F.col("threshold")
    traced = F.lit(True)
    for c in lineage:
        traced = traced & F.col(c).isNotNull()
    rows = _grid(_ok(fact, "operating_income", "forecast_variance"), thresholds).withColumn("fiscal_year", F.year("fiscal_year_end"))
    out = rows.groupBy("fiscal_year", "threshold").agg(
        F.count(F.lit(1)).alias("evaluable"),
        F.count_if(fired).alias("fired"),
        F.count_distinct(F.when(fired, F.col("security_key"))).alias("fired_securities"),
        F.count_if(fired & traced).alias("fired_with_complete_lineage"),
    )
    return out.withColumn("fired_rate", ratio(F.col("fired"), F.col("evaluable"))).orderBy("fiscal_year", F.desc("threshold"))


def followup(fact: DataFrame, thresholds: Sequence[float] = (-10, -20, -30, -50)) -> DataFrame:
    """The next year's growth of those that fired and of those that did not."""
    now = _ok(fact, "operating_income", "forecast_variance").select("security_key", "fiscal_year_end", F.col("observed_value").alias("variance"))
    later = _ok(fact, "operating_income", "yoy").select("security_key", F.col("fiscal_year_end").alias("_next"), F.col("observed_value").alias("yoy"))
    later = later.withColumnRenamed("security_key", "_s")
    paired = now.join(later, (F.col("security_key") == F.col("_s")) & (next_year(F.col("fiscal_year_end")) == F.col("_next")), "left")
    fired = F.col("variance") <= F.col("threshold")
    return _grid(paired, thresholds).groupBy("threshold").agg(
        F.count_if(fired).alias("fired"),
        F.count_if(fired & F.col("yoy").isNotNull()).alias("fired_with_next_year"),
        F.avg(F.when(fired, F.col("yoy"))).alias("fired_next_year_yoy_mean"),
        F.avg(F.when(F.col("variance") > F.col("threshold"), F.col("yoy"))).alias("not_fired_next_year_yoy_mean"),
    )


def fired_cases(fact: DataFrame, reports: DataFrame, master: DataFrame, threshold: float = -20.0) -> DataFrame:
    """Fired comparisons with the annual report of the same company and year, and whether it was out by then.

    reports: edinet_code, fiscal_year, available_at and figures. master: edinet_code, security_code, security_name.
    """
    fired = _ok(fact, "operating_income", "forecast_variance").filter(F.col("observed_value") <= threshold)
    fired = fired.select(F.replace("security_key", F.lit(".T"), F.lit("")).alias("code4"), F.year("fiscal_year_end").alias("fiscal_year"), "security_key", F.col("observed_value").alias("forecast_variance_pct"), F.col("current_available_at").alias("trigger_evidence_available_at"))
    names = master.select("edinet_code", F.substring("security_code", 1, 4).alias("code4"), "security_name").distinct()
    by = W.partitionBy("edinet_code").orderBy("fiscal_year")
    figures = ("revenue", "gross_profit", "operating_income", "net_income", "operating_cash_flow")
    annual = reports.filter(F.col("reporting_scope") == "consolidated").withColumns({f"previous_{c}": F.lag(c).over(by) for c in figures})
    rows = annual.join(names, "edinet_code").join(fired, ["code4", "fiscal_year"])
    pct = lambda a, b: 100 * ratio(a, b)
    col, was = F.col, lambda c: F.col(f"previous_{c}")
    return rows.select(
        "security_name",
        "security_key",
        "edinet_code",
        "fiscal_year",
        "forecast_variance_pct",
        pct(col("revenue") - was("revenue"), was("revenue")).alias("revenue_yoy_pct"),
        pct(col("gross_profit"), col("revenue")).alias("gross_margin_pct"),
        pct(was("gross_profit"), was("revenue")).alias("previous_gross_margin_pct"),
        pct(col("selling_general_admin_expenses"), col("revenue")).alias("sga_ratio_pct"),
        pct(col("operating_income"), col("revenue")).alias("operating_margin_pct"),
        pct(was("operating_income"), was("revenue")).alias("previous_operating_margin_pct"),
        pct(col("operating_income") - was("operating_income"), was("operating_income")).alias("operating_income_yoy_pct"),
        pct(col("net_income") - was("net_income"), F.abs(was("net_income"))).alias("net_income_change_pct"),
        pct(col("operating_cash_flow") - was("operating_cash_flow"), F.abs(was("operating_cash_flow"))).alias("operating_cash_flow_change_pct"),
        (col("operating_cash_flow") + col("investing_cash_flow")).alias("free_cash_flow"),
        (col("available_at") <= col("trigger_evidence_available_at")).alias("available_at_trigger_time"),
    )
