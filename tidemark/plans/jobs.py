"""python -m tidemark.plans.jobs replay|check|build|reconcile: jobs over a lake. The exit code says how it went: 0 well, 1 violations, 99 nothing new."""

from __future__ import annotations

import argparse
import datetime as dt
import json
import sys
import uuid
from collections.abc import Mapping
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import security_key
from ..operators import checks, comparisons, ingest, rules
from ..sources import arrays, raw, schemas
from ..sources.lake import Lake
from ..sources.snapshots import Dataset, Snapshot

NOTHING_NEW = 99
METRICS = ("revenue", "operating_income", "net_income")
KINDS = ("forecast_variance", "yoy", "absolute", "sign_transition")


def replay(lake: Lake, security: str, metric: str, kind: str, operator: str, threshold: str | None, as_of: dt.date) -> DataFrame:
    """One condition over one security's facts that could be seen on a day, all of its past."""
    facts = comparisons.select_facts(lake.run("metric_comparison_input"), [metric], [kind], [security], as_of)
    return rules.evaluate(facts.withColumns({"operator": F.lit(operator), "threshold_value": F.lit(threshold).cast("decimal(20,4)")}), F.lit(as_of))


def structure(lake: Lake) -> DataFrame:
    """(check_name, violations) of the lake's prices."""
    rows = lake.observations()
    return checks.counts({"duplicate_price": checks.unique(rows, ingest.PRICE_KEYS), "price_issue": checks.price_violations(rows), "thin_day": checks.thin_days(rows)})


PRICE = schemas.PRICE.rstrip() + ", security_key string"


def price_dataset(lake: Lake) -> Dataset:
    return Dataset(lake.spark, f"{lake.root.rstrip('/')}/observed/market_price", ingest.PRICE_KEYS)


def _adopted(data: Dataset) -> None:
    """A dataset that was written as one folder of years becomes the first snapshot. Its runs count for all jobs of their source."""
    try:
        rows = data.spark.read.schema(schemas.PRICE + ", year int").parquet(data.root).drop("year")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return
    rows = rows.withColumn("security_key", security_key())
    tops = {f"source:{r.source_key}": r.top for r in rows.groupBy("source_key").agg(F.max("ingestion_run_id").alias("top")).collect()}
    if tops:
        data.commit(Snapshot(), data.write(rows, f"adopted-{uuid.uuid4().hex}"), tops)  # if another build was first, its snapshot stands


def build(lake: Lake, runs: DataFrame, sources: Mapping[str, str], full: bool = False, raw_root: str | None = None) -> list[dict] | None:
    """Builds the lake's prices from the raw files of jobs, each of a source: in one commit what came after each job's highest run, or all.

    Only years that have new rows are written; rows of other sources stay, with `full` too. Gives for each job what it made of its input,
    counted while it was written; None if nothing is new. raw_root: the folder of all raw files; with it they are met by a join and read
    item by item, without it the paths of a load go through the driver.
    """
    data, spark, counts = price_dataset(lake), lake.spark, {}
    if not data.numbers():
        _adopted(data)

    def fresh(base: Snapshot) -> tuple[DataFrame, dict[str, int]] | None:
        counts.clear()
        tops, rows = {}, []
        for job, source in sources.items():
            last = base.watermarks.get(job, base.watermarks.get(f"source:{source}"))
            found = raw.locations(runs, job)
            if last is not None and not full:
                found = found.filter(F.col("ingestion_run_id") > last)
            top = found.agg(F.max("ingestion_run_id").alias("top")).first().top
            if top is None:
                continue
            tops[job], counts[job] = top, (Observation(), Observation())
            read = raw.read_arrays(spark, found, schemas.RAW_PRICE) if raw_root is None else arrays.records(spark, found, raw_root, schemas.RAW_PRICE)
            records = read.observe(counts[job][0], F.count(F.lit(1)).alias("records"), F.count_if(ingest.is_rejected()).alias("rejected"))
            built = ingest.build_prices(records, source).withColumn("built_at", F.current_timestamp())
            rows.append(built.observe(counts[job][1], F.count(F.lit(1)).alias("rows"), F.count_if(F.col("target_key").isNull()).alias("unmapped")))
        if not rows:
            return None
        empty = spark.createDataFrame([], PRICE)
        return ingest.keep_last(reduce(DataFrame.unionByName, (empty.unionByName(r, allowMissingColumns=True) for r in rows)), ingest.PRICE_KEYS), tops

    if data.build(sorted(set(sources.values())), PRICE, fresh, full) is None:
        return None
    return [{"job": job, "source": sources[job]} | a.get | b.get | {"replaced": a.get["records"] - a.get["rejected"] - b.get["rows"]} for job, (a, b) in counts.items()]


def reconcile(lake: Lake, threshold: float = -20.0) -> DataFrame:
    """How many keys of the two variants of comparisons are of each class."""
    filed = lake.disclosures()
    stamped = filed.withColumn("available_at", F.to_utc_timestamp(F.to_timestamp(F.concat_ws(" ", F.col("disclosed_date").cast("string"), F.coalesce("disclosed_time", F.lit("23:59:59")))), "Asia/Tokyo"))
    keys = ["security_key", "fiscal_year_end", "metric_key", "reporting_scope", "accounting_standard"]
    ours = comparisons.metric_comparison_input(filed).filter("comparison_type = 'yoy' and input_status = 'ok'").withColumnRenamed("actual_disclosure_number", "number")
    theirs = comparisons.metric_comparison_fact(stamped).filter("comparison_type = 'yoy' and comparison_status = 'ok'").withColumnRenamed("current_disclosure_number", "number")
    return checks.reconcile(ours, theirs, keys, "observed_value", ["number"], threshold).groupBy("class").agg(F.count(F.lit(1)).alias("n")).orderBy("class")


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    jobs = p.add_subparsers(dest="job", required=True)
    for name in ("replay", "check", "build", "reconcile"):
        j = jobs.add_parser(name)
        j.add_argument("--lake", required=True)
        if name == "replay":
            j.add_argument("--security", required=True)
            j.add_argument("--metric", choices=METRICS, required=True)
            j.add_argument("--comparison", choices=KINDS, required=True)
            j.add_argument("--operator", choices=rules.OPERATORS, required=True)
            j.add_argument("--threshold")
            j.add_argument("--as-of", type=dt.date.fromisoformat, default=dt.date.today())
        if name == "build":
            j.add_argument("--runs", required=True, help="Parquet of runs: ingestion_run_id, job_type, status, raw_path")
            j.add_argument("--job", dest="sources", nargs=2, action="append", required=True, metavar=("JOB_TYPE", "SOURCE"), help="once for each job type")
            j.add_argument("--full", action="store_true")
            j.add_argument("--raw-root", help="the folder of all raw files, for large loads")
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = _parser()
    a = p.parse_args(args)
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    lake = Lake(spark, a.lake)
    if a.job == "replay":
        crossing = a.operator.startswith("crosses_")
        if (a.comparison == "sign_transition") != crossing or crossing != (a.threshold is None):
            p.error("sign_transition takes a crossing and no threshold, all others a comparison with one")
        rows = replay(lake, a.security, a.metric, a.comparison, a.operator, a.threshold, a.as_of)
        for line in rows.orderBy("actual_disclosed_date").toJSON().toLocalIterator():
            print(line)
        return 0
    if a.job == "build":
        made = build(lake, spark.read.parquet(a.runs), dict(a.sources), a.full, a.raw_root)
        if made is None:
            return NOTHING_NEW
        for line in made:
            print(json.dumps(line))
        return 0
    rows = structure(lake) if a.job == "check" else reconcile(lake)
    found = [r.asDict() for r in rows.collect()]  # a few lines
    print(json.dumps(found))
    bad = {"duplicate_price", "price_issue"}
    return int(a.job == "check" and any(r["violations"] and r["check_name"] in bad for r in found))


if __name__ == "__main__":
    sys.exit(main())
