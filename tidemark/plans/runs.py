"""A gated run: marts are built as a new version, checked as they were written, and only then made current and evaluated."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks, comparisons, rules
from ..sources.sinks import append_version

#: What is stored: marts are tables, all before them stays a definition that is computed with them.
MATERIALIZED = {"staging": "view", "intermediate": "view", "marts": "table"}


def fact_checks(fact: DataFrame) -> dict[str, DataFrame]:
    """What a comparison fact promises."""
    return {
        "key_missing": checks.not_null(fact, "comparison_key"),
        "key_twice": checks.unique(fact, ["comparison_key"]),
        "metric_unknown": checks.accepted(fact, "metric_key", ["revenue", "operating_income", "net_income"]),
        "comparison_unknown": checks.accepted(fact, "comparison_type", ["forecast_variance", "yoy", "absolute", "sign_transition"]),
        "reference_not_before": checks.reference_not_before(fact),
        "ok_without_basis": checks.ok_without_basis(fact),
    }


@dataclass(frozen=True)
class Marts:
    """Versions of stored tables under one root, and which of each is current."""

    spark: SparkSession
    root: str

    def _folder(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def publish(self, name: str, rows: DataFrame, version: str, tests: Callable[[DataFrame], dict[str, DataFrame]]) -> DataFrame:
        """Writes a version and checks it as written; a violation raises, and what was current stays so."""
        written = self.spark.read.schema(rows.schema).parquet(append_version(rows, self._folder(name), version))
        checks.gate(tests(written))
        mark = self.spark.createDataFrame([(version, dt.datetime.now(dt.UTC))], "version string, published_at timestamp")
        mark.coalesce(1).write.mode("append").parquet(f"{self._folder(name)}-published")
        return written

    def current(self, name: str) -> DataFrame:
        """The version that was published last."""
        try:
            marks = self.spark.read.schema("version string, published_at timestamp").parquet(f"{self._folder(name)}-published")
        except AnalysisException as e:
            raise KeyError(f"no version of {name} is published") from e
        last = marks.orderBy(F.desc("published_at"), F.desc("version")).first()["version"]
        return self.spark.read.parquet(f"{self._folder(name)}/version={last}")


def build_test_evaluate(marts: Marts, disclosures: DataFrame, version: str, conditions: DataFrame, scope: DataFrame, as_of, log: DataFrame | None = None, mode: str = "live") -> DataFrame:
    """The comparison fact, its checks, then the rules: the new events. Nothing is evaluated if a check fails.

    The fact is stored as a mart; rules read comparisons in the lake's form, of the same disclosures.
    """
    marts.publish("metric_comparison_fact", comparisons.metric_comparison_fact(disclosures), version, fact_checks)
    return rules.evaluate_rule(comparisons.metric_comparison_input(disclosures), conditions, scope, as_of, mode, log)


def new_runs(runs: DataFrame, loaded: DataFrame) -> DataFrame:
    """Successful runs after the last one loaded, by one value; an empty result means that what comes after may be skipped."""
    last = loaded.agg(F.max("ingestion_run_id").alias("_last"))
    rows = runs.filter((F.col("status") == "succeeded") & F.col("raw_path").isNotNull())
    return rows.crossJoin(F.broadcast(last)).filter(F.col("_last").isNull() | (F.col("ingestion_run_id") > F.col("_last"))).drop("_last")
