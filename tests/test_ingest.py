import datetime as dt
import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import calendar
from tidemark.functions import normalize as n
from tidemark.operators import control, ingest
from tidemark.sources import raw, schemas, sinks
from tidemark.sources.lake import Lake
from tidemark.streaming import incremental
from tests.helpers import make, prices


def test_codes_and_document_types(spark):
    rows = spark.createDataFrame([(c,) for c in ("41230", "408A0", "13010", "25935", "94346", "7203", "412300")], "c string")
    assert [r[0] for r in rows.select(n.ticker_of(F.col("c"))).collect()] == ["4123.T", "408A.T", "1301.T", None, None, None, None]
    standard, scope = n.reporting(F.col("t"))
    kinds = spark.createDataFrame([(t,) for t in ("FYFinancialStatements_Consolidated_JP", "1QFinancialStatements_NonConsolidated_IFRS", "EarnForecastRevision", "REITEarnForecastRevision", None)], "t string")
    assert [tuple(r) for r in kinds.select(standard, scope).collect()] == [("JP", "consolidated"), ("IFRS", "non_consolidated"), (None, None), (None, "non_consolidated"), (None, None)]


def test_numbers(spark):
    rows = spark.createDataFrame([("2.5",), ("3.5",), ("-2.5",), ("",), (None,), ("x",)], "v string")
    assert [r[0] for r in rows.select(n.whole(F.col("v"))).collect()] == [2, 4, -2, None, None, None]


def quote(day, close, run, code="41230", **more):
    return {"Date": day, "Code": code, "C": close, "AdjC": close, "UL": "0", "LL": "1", "ingestion_run_id": run} | more


def raw_prices(spark, rows):
    return make(spark, schemas.RAW_PRICE + ", ingestion_run_id bigint", rows)


def test_price_build_and_lake(spark, tmp_path):
    rows = [quote("2026-07-01", "100", 1), quote("2026-07-01", "101", 2), quote("2025-07-01", "", 1), quote("2026-07-02", "5", 1, code="25935"), quote("2026-07-03", "9", 1, UL="maybe")]
    records = raw_prices(spark, rows)
    built = ingest.build_prices(records, "jpx")
    got = {(r.jpx_code, str(r.obs_date)): (r.close_price, r.target_key, r.upper_limit_flag, r.lower_limit_flag) for r in built.collect()}
    assert got == {("41230", "2026-07-01"): (101.0, "4123.T", False, True), ("41230", "2025-07-01"): (None, "4123.T", False, True), ("25935", "2026-07-02"): (5.0, None, False, True)}
    assert ingest.rejected_prices(records).count() == 1
    assert ingest.source_counts(records, built, ingest.PRICE_KEYS).first()["unmapped"] == 1

    root = str(tmp_path)
    whole = make(spark, schemas.PRICE, []).unionByName(built.drop("security_key"), allowMissingColumns=True).withColumn("security_key", F.coalesce("jpx_code", "target_key"))
    sinks.write_by_year(whole, f"{root}/observed/market_price", "obs_date")
    assert sorted(p.name for p in (tmp_path / "observed/market_price").glob("year=*")) == ["year=2025", "year=2026"]
    lake = Lake(spark, root)
    assert lake.run("daily_return").count() == 3 and "year" not in lake.observations().columns
    with pytest.raises(KeyError, match="preferred_price"):
        lake.run("nothing")


def test_financial_build(spark):
    one = {"Code": "41230", "DiscNo": "1", "DiscDate": "2026-05-01", "DocType": "FYFinancialStatements_NonConsolidated_JP", "CurPerType": "FY", "Sales": "10", "NCSales": "7.5", "BPS": "1", "NCBPS": "2.25", "DivAnn": "3", "ingestion_run_id": 1}
    rows = make(spark, schemas.RAW_FINANCIAL + ", ingestion_run_id bigint", [one, one | {"ingestion_run_id": 2}, one | {"DiscNo": "2", "DocType": "FYFinancialStatements_Consolidated_JP"}])
    got = {r.disclosure_number: r for r in ingest.build_financials(rows, "jpx").collect()}
    assert (got["1"].revenue, got["1"].bps, got["1"].ingestion_run_id, got["1"].reporting_scope) == (8, 2.25, 2, "non_consolidated")
    assert (got["2"].revenue, got["2"].bps, got["2"].annual_dividend_per_share) == (10, 1.0, 3.0)


def test_incremental_equals_full(spark):
    rows = spark.createDataFrame([(k % 5, run, run * k) for run in range(1, 6) for k in range(7)], "k long, ingestion_run_id long, v long")
    base = ingest.keep_last(rows.filter("ingestion_run_id <= 3"), ["k"])
    a, b = ingest.incremental(base, rows, ["k"]), ingest.keep_last(rows, ["k"])
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0
    assert ingest.incremental(base.limit(0), rows, ["k"]).exceptAll(b).count() == 0
    once = ingest.insert_only_merge(rows.filter("k = 1").limit(1), rows, "k")
    assert once.count() == 5 and once.filter("k = 1").first()["ingestion_run_id"] == 1


def test_raw_files_never_change(spark, tmp_path):
    path = sinks.raw_path(str(tmp_path), "jpx", "prices", dt.date(2026, 7, 1), 3)
    first = sinks.put_raw(spark, [{"Code": "41230", "C": "1"}], path)
    assert sinks.put_raw(spark, [{"Code": "41230", "C": "1"}], path) == first
    with pytest.raises(ValueError):
        sinks.put_raw(spark, [{"Code": "41230", "C": "2"}], path)
    runs = spark.createDataFrame([(3, "prices", "succeeded", path), (4, "prices", "failed", path), (5, "prices", "succeeded", None)], "ingestion_run_id long, job_type string, status string, raw_path string")
    found = raw.read_arrays(spark, raw.locations(runs, "prices"), schemas.RAW_PRICE).collect()
    assert [(r.Code, r.C, r.ingestion_run_id) for r in found] == [("41230", "1", 3)]
    assert raw.locations(runs, "prices", after_run_id=3).count() == 0


def test_manifests_and_payloads(spark, tmp_path):
    body = json.dumps({"data": [{"code": "E1", "year": 2025, "v": 1.5}, {"code": "E2", "year": "x", "v": None}]}).encode()
    folder = tmp_path / "endpoint=financials"
    folder.mkdir()
    (folder / "a.json.gz").write_bytes(gzip.compress(body))
    manifest = {"run_id": "1", "source": "s", "endpoint": "financials", "unit_key": "E1", "status": "succeeded", "local_raw_path": str(folder / "a.json.gz"), "response_sha256": hashlib.sha256(body).hexdigest()}
    (folder / "a.json").write_text(json.dumps(manifest))
    rows = raw.responses(raw.read_manifests(spark, str(tmp_path)), str(tmp_path))
    items = raw.exploded(rows.select("raw_object_key", "payload_json"), "data", {"code": ("$.code", "string"), "year": ("$.year", "int")}).orderBy("code").collect()
    assert [(r.code, r.year) for r in items] == [("E1", 2025), ("E2", None)] and len({r.source_record_hash for r in items}) == 2
    (folder / "a.json").write_text(json.dumps(manifest | {"response_sha256": "0"}))
    with pytest.raises(Exception, match="hash differs"):
        raw.responses(raw.read_manifests(spark, str(tmp_path)), str(tmp_path)).collect()


def test_code_list(spark, tmp_path):
    (tmp_path / "list.csv").write_text("jpx_code,industry\n41230 ,Cars\n13010,Food\n41230,Cars\n", encoding="utf-8-sig")
    assert [r.code for r in raw.read_codes(spark, str(tmp_path / "list.csv"), "Cars").collect()] == ["41230"]
    (tmp_path / "bad.csv").write_text("code\n1\n")
    with pytest.raises(ValueError, match="industry"):
        raw.read_codes(spark, str(tmp_path / "bad.csv"))


def test_stream_of_files(spark, tmp_path):
    source = tmp_path / "raw"
    source.mkdir()
    put = lambda name, rows: (source / name).write_text(json.dumps(rows))
    run = lambda: incremental.follow(spark, str(source), "k long, ingestion_run_id long, v long", lambda b: b, ["k"], F.col("k") % 2, str(tmp_path / "out"), str(tmp_path / "marks")).awaitTermination()
    put("1.json", [{"k": 1, "ingestion_run_id": 1, "v": 5}, {"k": 2, "ingestion_run_id": 1, "v": 6}])
    run()
    put("2.json", [{"k": 1, "ingestion_run_id": 2, "v": 7}])
    run()
    now = lambda: sorted((r.k, r.v) for r in incremental.current(spark, str(tmp_path / "out")).collect())
    assert now() == [(1, 7), (2, 6)]
    assert [p.name for p in sorted((tmp_path / "out/rows/batch=1").glob("part=*"))] == ["part=1"]  # the other part is not written again
    incremental.current(spark, str(tmp_path / "out")).selectExpr("k", "ingestion_run_id", "-1L as v", "'1' as part").write.partitionBy("part").parquet(str(tmp_path / "out/rows/batch=9"))
    assert now() == [(1, 7), (2, 6)]  # without its commit a batch does not count


def test_membership(spark):
    codes = lambda *x: spark.createDataFrame([(c,) for c in x], "code string")
    changes = lambda mode: {r.code: r.change for r in control.membership_changes(codes("A", "B"), codes("B", "C"), mode).collect()}
    assert changes("append") == {"B": "unchanged", "C": "added"} and changes("replace") == {"A": "removed", "B": "unchanged", "C": "added"}
    members = spark.createDataFrame([(1, "A", dt.date(2020, 1, 1), None), (1, "B", dt.date(2020, 1, 1), None)], "theme_id long, code string, valid_from date, valid_to date")
    after = control.apply_membership(members, control.membership_changes(codes("A", "B"), codes("B", "C"), "replace"), 1, F.lit("2026-07-01").cast("date"))
    assert {r.code: (str(r.valid_from), r.valid_to and str(r.valid_to)) for r in after.collect()} == {"A": ("2020-01-01", "2026-07-01"), "B": ("2020-01-01", None), "C": ("2026-07-01", None)}


def test_new_versions_of_mandates(spark):
    versions = spark.createDataFrame([(1, 10, 1, 0.5, None, None)], "mandate_id long, mandate_version_id long, version_no int, allocation_weight double, effective_from timestamp, effective_until timestamp")
    assigned = spark.createDataFrame([(10, 7, 0.4, "active", None), (10, 8, 0.1, "active", dt.datetime(2020, 1, 1))], "mandate_version_id long, target_id long, target_weight double, status string, effective_until timestamp")
    changed = spark.createDataFrame([(1, 11, 0.6)], "mandate_id long, mandate_version_id long, allocation_weight double")
    v, a = control.roll_version(versions, assigned, changed, F.lit("2026-07-01").cast("timestamp"))
    assert sorted((r.mandate_version_id, r.version_no, r.effective_until is None) for r in v.collect()) == [(10, 1, False), (11, 2, True)]
    assert sorted((r.mandate_version_id, r.target_id, r.effective_until is None) for r in a.collect()) == [(10, 7, False), (10, 8, False), (11, 7, True)]
    assert control.overallocated(v, a).count() == 0
    assert control.upsert(versions, versions.withColumn("allocation_weight", F.lit(0.9)), ["mandate_id"]).first()["allocation_weight"] == 0.9
    assert control.insert_only(versions, versions, ["mandate_id"]).count() == 1


def test_days():
    assert calendar.plan_window(dt.date(2026, 9, 12), 84, 2) == (dt.date(2024, 6, 20), dt.date(2026, 6, 20))
    assert calendar.add_years(dt.date(2024, 2, 29), -1) == dt.date(2023, 2, 28) and calendar.add_months(dt.date(2024, 1, 31), 1) == dt.date(2024, 2, 29)
    assert calendar.weekdays(dt.date(2026, 7, 3), dt.date(2026, 7, 6)) == [dt.date(2026, 7, 3), dt.date(2026, 7, 6)]
    window = (dt.date(2026, 7, 1), dt.date(2026, 7, 3))
    assert calendar.catch_up(dt.date(2026, 7, 2), window) == [dt.date(2026, 7, 3)] and len(calendar.catch_up(None, window)) == 3 and calendar.catch_up(dt.date(2026, 7, 3), window) == []
    assert calendar.clamp(dt.date(2026, 6, 1), dt.date(2026, 7, 2), window) == (dt.date(2026, 7, 1), dt.date(2026, 7, 2)) and calendar.clamp(dt.date(2026, 8, 1), dt.date(2026, 8, 2), window) is None
    assert calendar.fetch_start(dt.date(2026, 7, 9), dt.date(2020, 1, 1)) == dt.date(2026, 7, 6)


def test_search(spark):
    rows = [("13010", "1301.T", "Kyoku", None), ("41230", "4123.T", "Car 13010", "Car"), ("99990", None, None, "x_%y")]
    master = make(spark, schemas.MASTER, [dict(zip(("security_key", "target_key", "company_name", "company_name_english"), r, strict=True)) for r in rows])
    found = lambda t: [r.security_key for r in control.search_securities(master, t).collect()]
    assert found("13010") == ["13010", "41230"] and found("CAR") == ["41230"] and found("_%") == ["99990"]


def test_price_issues(spark):
    from tidemark.operators import checks

    rows = prices(spark, [{"obs_date": dt.date(2026, 7, 1), "open_price": 1.0, "high_price": 3.0, "low_price": 2.0, "close_price": -1.0, "volume": -5.0}, {"obs_date": dt.date(2026, 7, 2), "open_price": 1.0}, {"obs_date": dt.date(2026, 7, 3)}])
    got = sorted((r.obs_date.day, r.issue) for r in checks.price_violations(rows).collect())
    assert got == [(1, "low_too_high"), (1, "price_not_positive"), (1, "volume_negative"), (2, "ohlc_partial"), (3, "ohlc_missing")]
