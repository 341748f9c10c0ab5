import datetime as dt
import gzip
import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import normalize
from tidemark.operators import prices
from tidemark.plans.cli import shown
from tidemark.sources import demo, raw, staging
from tidemark.sources.lake import DEFINITIONS, Lake


def test_demo_lake(spark, tmp_path):
    lake = demo.build(spark, str(tmp_path))
    lake.bind()
    assert spark.sql("select count(distinct security_key) n from preferred_price").first().n == 4
    assert all(lake.run(name).count() > 0 for name in DEFINITIONS)
    latest = shown(lake, "point_in_time_pbr", latest=True)
    assert latest.count() == 4 and {r.as_of_date for r in latest.collect()} == {demo.END}
    one = shown(lake, "daily_return", target="90010", limit=3).collect()
    assert len(one) == 3 and one[0].obs_date == demo.END
    ok = {r.security_key: r.calculation_status for r in latest.collect()}
    assert ok["90040"] == "financial_not_available"


def test_plans(spark, tmp_path):
    """Filters and columns reach the scan; a query's windows share one shuffle; comparisons scan once."""
    lake = demo.build(spark, str(tmp_path))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    one = plan(prices.price_history(lake.observations(), "90010", demo.END, 30).select("obs_date", "cumulative_return"))
    assert "PushedFilters" in one and "isnull(jpx_code" in one and "turnover_value" not in one and one.count("hashpartitioning") == 1
    assert plan(lake.run("daily_return")).count("hashpartitioning") == 1
    assert plan(lake.run("point_in_time_forecast")).count("hashpartitioning") == 1
    pbr = plan(lake.run("point_in_time_pbr"))
    assert pbr.count("MapIn") == 0 and "CartesianProduct" not in pbr and "BroadcastNestedLoopJoin" not in pbr
    assert "WindowGroupLimit" in plan(prices.latest_prices(lake.observations(), ["90010"]))
    year = plan(lake.spark.read.parquet(f"{tmp_path}/observed/market_price").filter("year = 2026"))
    assert "PartitionFilters: [isnotnull(year" in year
    assert plan(lake.run("metric_comparison_input")).count("Union") == 0


def test_staging(spark, tmp_path):
    items = [{"Code": "41230", "DiscNo": "1", "DiscDate": "2026-05-08", "DiscTime": "", "DocType": "FYFinancialStatements_Consolidated_IFRS", "CurPerType": "FY", "Sales": "10", "NCSales": "3", "OP": "x"}]
    for run in (1, 2):
        (tmp_path / f"run-{run}.json.gz").write_bytes(gzip.compress(json.dumps(items).encode()))
    runs = spark.createDataFrame(
        [(i, "fin", "succeeded", str(tmp_path / f"run-{i}.json.gz"), None, dt.datetime(2026, 5, 9, i)) for i in (1, 2)],
        "ingestion_run_id long, job_type string, status string, raw_path string, snapshot_date date, fetched_at timestamp",
    )
    rows = raw.responses_of_runs(runs, "fin", "s", "e")
    (r,) = staging.financial_disclosure(rows).collect()
    assert (r.ingestion_run_id, r.security_key, r.accounting_standard, r.reporting_scope, float(r.revenue), r.operating_income) == (2, "4123.T", "IFRS", "consolidated", 10.0, None)
    assert str(r.available_at) == "2026-05-08 14:59:59"
    assert {str(x.snapshot_date) for x in rows.collect()} == {"2026-05-09"}
    lost = raw.without_lost(spark.createDataFrame([(1, str(tmp_path / "gone")), (2, "gs://bucket/x"), (3, str(tmp_path))], "ingestion_run_id long, location string"))
    assert [x.ingestion_run_id for x in lost.collect()] == [2, 3]


def test_annual_reports(spark):
    payload = json.dumps({"data": [{"edinet_code": "E1", "fiscal_year": 2025, "submit_date": "2026-06-25 09:30", "operating_income": 12.5}, {"edinet_code": "E1", "fiscal_year": "bad"}]})
    rows = spark.createDataFrame([("k", 1, payload)], "raw_object_key string, ingestion_run_id long, payload_json string")
    got = sorted(((r.fiscal_year or 0, r.operating_income and float(r.operating_income), r.available_at and str(r.available_at)) for r in staging.financial_actual(rows).collect()), key=str)
    assert got == [(0, None, None), (2025, 12.5, "2026-06-25 00:30:00")]
    years = raw.response_years(staging.financial_actual(rows)).first()
    assert (years.record_count, years.min_fiscal_year, years.max_fiscal_year) == (2, 2025, 2025)


def test_one_dataset_is_bound_without_the_others(spark, tmp_path):
    lake = demo.build(spark, str(tmp_path))
    other = Lake(spark, str(tmp_path / "none"))
    with pytest.raises(KeyError, match="market_price"):
        other.bind("prices")
    lake.bind("security_master")
    assert spark.sql("select * from security_master").count() == 4
    lake.bind_files("some_years", "observed/market_price/year=*")
    assert spark.sql("select * from some_years").count() == lake.observations().count()


def test_a_manifest_is_an_object(spark, tmp_path):
    for name, text in (("a", '{"run_id": "1", "http_status": 200}'), ("b", '[{"run_id": "1"}]')):
        (tmp_path / f"{name}/endpoint=e").mkdir(parents=True)
        (tmp_path / f"{name}/endpoint=e/unit=u.json").write_text(text)
    assert [(r.run_id, r.http_status) for r in raw.read_manifests(spark, str(tmp_path / "a")).collect()] == [("1", 200)]
    with pytest.raises(Exception, match="no manifest"):
        raw.read_manifests(spark, str(tmp_path / "b")).collect()


def test_a_null_field_is_told_from_none(spark):
    row = spark.sql("select cast(null as string) as a, 'x' as b").select(normalize.record_hash(F.col("a"), F.col("b")).alias("with"), normalize.record_hash(F.col("b")).alias("without")).first()
    assert row["with"] != row["without"]
