"""A year's figures against forecast, the year before and zero: one core with two variants.

lake: releases ordered by date, time, number; usable from the day after; a prior year must be disclosed on an earlier date; its
forecast comes from the same row, and its number stays on rows without a reference.
warehouse: releases ordered by the moment they became available; the prior year and the forecast must be available before;
a forecast that is missing names no disclosure; rows have a key, and decimals are exact until the fact.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import next_year, pick_first

METRICS = ("revenue", "operating_income", "net_income")
KINDS = ("forecast_variance", "yoy", "absolute", "sign_transition")
BASIS = ("security_key", "fiscal_year_end", "reporting_scope", "accounting_standard")


def first_releases(disclosures: DataFrame, order: list[Column]) -> DataFrame:
    rows = disclosures.filter((F.col("fiscal_period_type") == "FY") & F.col("fiscal_year_end").isNotNull())
    return pick_first(rows, BASIS, order)


def input_status(current: Column, reference: Column, kind: Column) -> Column:
    """The first obstacle to comparing, else ok."""
    return (
        F.when(F.col("reporting_scope").isNull() | F.col("accounting_standard").isNull(), "basis_unknown")
        .when(F.col("fiscal_year_start").isNull(), "period_unknown")
        .when(~F.datediff("fiscal_year_end", "fiscal_year_start").between(350, 380), "unsupported_period")
        .when(current.isNull(), "current_missing")
        .when((kind != "absolute") & reference.isNull(), "reference_missing")
        .when(kind.isin("forecast_variance", "yoy") & (reference <= 0), "reference_nonpositive")
        .otherwise("ok")
    )


def select_facts(facts: DataFrame, metrics: Sequence[str], kinds: Sequence[str], securities: Sequence[str] | None = None, until: dt.date | None = None) -> DataFrame:
    """One scan for all conditions of a rule: facts of these metrics and kinds, of these securities, available until a day."""
    rows = facts.filter(F.col("metric_key").isin(list(metrics)) & F.col("comparison_type").isin(list(kinds)))
    if securities is not None:
        rows = rows.filter(F.col("security_key").isin(list(securities)))
    return rows if until is None else rows.filter(F.col("available_on") <= F.lit(until))


def _with_prior(first: DataFrame, before: Column, keep: dict[str, str]) -> DataFrame:
    """Left join with the release of the year before on the same basis, if `before` holds. keep: new names of its columns.

    The sides differ in the year of their keys, so each is shuffled once; first releases are few beside the disclosures they come from."""
    prior = first.select(
        F.col("security_key").alias("_s"), next_year(F.col("fiscal_year_end")).alias("_y"), F.col("reporting_scope").alias("_r"), F.col("accounting_standard").alias("_a"), *(F.col(c).alias(n) for c, n in keep.items())
    )
    match = (F.col("security_key") == F.col("_s")) & (F.col("fiscal_year_end") == F.col("_y")) & (F.col("reporting_scope") == F.col("_r")) & (F.col("accounting_standard") == F.col("_a"))
    return first.join(prior, match & before, "left").drop("_s", "_y", "_r", "_a")


def _compared(rows: DataFrame) -> DataFrame:
    """Twelve rows of each: metrics and kinds, from one scan instead of a union of twelve. Adds metric_key, comparison_type, current, prior, forecast."""
    metric = F.explode(F.array(*(F.struct(F.lit(m).alias("metric_key"), F.col(m).alias("current"), F.col(f"prior_{m}").alias("prior"), F.col(f"forecast_{m}_ref").alias("forecast")) for m in METRICS)))
    return rows.withColumn("_m", metric).select("*", "_m.*").drop("_m").withColumn("comparison_type", F.explode(F.array(*map(F.lit, KINDS))))


def metric_comparison_input(disclosures: DataFrame) -> DataFrame:
    """The lake's variant."""
    order = [F.col("disclosed_date").asc_nulls_last(), F.col("disclosed_time").asc_nulls_last(), F.col("disclosure_number").asc_nulls_last()]
    first = first_releases(disclosures.filter(F.col("disclosed_date").isNotNull()), order)
    keep = {"disclosed_date": "prior_disclosed_date", "disclosure_number": "prior_disclosure_number"}
    keep |= {m: f"prior_{m}" for m in METRICS} | {f"next_forecast_{m}": f"forecast_{m}_ref" for m in METRICS}
    rows = _compared(_with_prior(first, F.col("prior_disclosed_date") < F.col("disclosed_date"), keep))
    kind = F.col("comparison_type")
    reference = F.when(kind == "forecast_variance", F.col("forecast")).when(kind != "absolute", F.col("prior"))
    rows = rows.withColumn("reference", reference)
    change = F.when(F.col("reference") > 0, (F.col("current") - F.col("reference")) / F.col("reference").cast("double") * 100)
    observed = F.when(kind.isin("absolute", "sign_transition"), F.col("current").cast("double")).otherwise(change)
    return rows.select(
        "security_key",
        "fiscal_year_end",
        "fiscal_year_start",
        F.col("disclosed_date").alias("actual_disclosed_date"),
        F.date_add("disclosed_date", 1).alias("available_on"),
        F.col("disclosure_number").alias("actual_disclosure_number"),
        "reporting_scope",
        "accounting_standard",
        "prior_disclosed_date",
        "prior_disclosure_number",
        "metric_key",
        "comparison_type",
        F.col("reference").cast("double").alias("reference_value"),
        F.col("current").cast("double").alias("current_value"),
        observed.alias("observed_value"),
        input_status(F.col("current"), F.col("reference"), kind).alias("input_status"),
    )


def metric_comparison_fact(disclosures: DataFrame, lineage: tuple[str, ...] = ("raw_uri", "response_sha256", "source_record_hash")) -> DataFrame:
    """The warehouse's variant. disclosures carry available_at (timestamp)."""
    first = first_releases(disclosures, [F.col("available_at").asc_nulls_first(), F.col("disclosure_number").asc_nulls_first()])
    keep = {"available_at": "prior_available_at", "disclosure_number": "prior_number"}
    keep |= {m: f"prior_{m}" for m in METRICS} | {f"next_forecast_{m}": f"forecast_{m}_ref" for m in METRICS}
    rows = _compared(_with_prior(first, F.col("prior_available_at") < F.col("available_at"), keep))
    kind = F.col("comparison_type")
    by_forecast = (kind == "forecast_variance") & F.col("forecast").isNotNull()
    by_prior = kind.isin("yoy", "sign_transition")
    rows = rows.withColumn("reference", F.when(by_forecast, F.col("forecast")).when(by_prior, F.col("prior")).cast("decimal(38,9)"))
    rows = rows.withColumn("exact", F.col("current").cast("decimal(38,9)"))
    rate = F.when(F.col("reference") > 0, ((F.col("exact") - F.col("reference")).cast("double") / F.col("reference").cast("double")) * 100)
    observed = F.when(kind.isin("absolute", "sign_transition"), F.col("exact").cast("double")).otherwise(rate)
    unknown = lambda c: F.coalesce(c, F.lit("__unknown__"))
    key = F.concat_ws("|", "security_key", F.col("fiscal_year_end").cast("string"), "metric_key", kind, unknown("reporting_scope"), unknown("accounting_standard"))
    return rows.select(
        F.sha2(key, 256).alias("comparison_key"),
        "security_key",
        "fiscal_year_start",
        "fiscal_year_end",
        F.lit("FY").alias("period_type"),
        "metric_key",
        "comparison_type",
        F.col("reference").cast("double").alias("reference_value"),
        F.col("exact").cast("double").alias("current_value"),
        (F.col("exact") - F.col("reference")).cast("double").alias("change_amount"),
        observed.alias("change_rate"),
        observed.alias("observed_value"),
        F.when(by_forecast | by_prior, F.col("prior_available_at")).alias("reference_available_at"),
        F.col("available_at").alias("current_available_at"),
        input_status(F.col("exact"), F.col("reference"), kind).alias("comparison_status"),
        "reporting_scope",
        "accounting_standard",
        F.col("disclosure_number").alias("current_disclosure_number"),
        F.when(by_forecast | by_prior, F.col("prior_number")).alias("reference_disclosure_number"),
        *(c for c in lineage if c in disclosures.columns),
    )
