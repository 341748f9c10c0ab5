import datetime as dt
import gzip
import json

import pytest
from pyspark.sql import functions as F

from tests.helpers import disclosures
from tidemark.operators import comparisons, control, rules
from tidemark.plans import jobs, runs
from tidemark.sources import demo, publish, raw, sinks

RUN = "ingestion_run_id long, job_type string, status string, raw_path string"


def put(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(gzip.compress(json.dumps(rows).encode()))
    return str(path)


def test_publication_moves_paths_that_nobody_else_moved(spark, tmp_path):
    there = put(tmp_path / "raw/a/run-1.json.gz", [{"v": 1}])
    rows = spark.createDataFrame([(1, "j", "succeeded", there), (2, "j", "succeeded", str(tmp_path / "raw/gone.json.gz")), (3, "j", "succeeded", None)], RUN)
    moved, counts = publish.publish_pending(rows, str(tmp_path / "raw"), str(tmp_path / "out"))
    assert counts == {"uploaded": 1, "missing": 1}
    after = publish.moved_paths(rows, moved)
    assert {r.ingestion_run_id: r.raw_path for r in after.collect()}[1] == f"{tmp_path}/out/a/run-1.json.gz"
    assert [r.ingestion_run_id for r in raw.pending(after, str(tmp_path / "out")).collect()] == [2]
    with pytest.raises(Exception, match="changed while publishing"):
        publish.moved_paths(rows.withColumn("raw_path", F.lit("elsewhere")), moved).collect()
    put(tmp_path / "raw/a/run-1.json.gz", [{"v": 2}])
    with pytest.raises(ValueError, match="holds another"):
        publish.publish_pending(rows, str(tmp_path / "raw"), str(tmp_path / "out"))


def test_archive_resumes_by_manifests(spark, tmp_path):
    day = dt.date(2026, 7, 1)
    kept = publish.store(spark, str(tmp_path), "s", "reports", "E1", day, json.dumps({"data": [{"fiscal_year": 2024}, {"fiscal_year": 2025}]}).encode(), run_id="1")
    assert (kept["record_count"], kept["min_fiscal_year"], kept["max_fiscal_year"]) == (2, 2024, 2025)
    assert publish.store(spark, str(tmp_path), "s", "reports", "E1", day, json.dumps({"data": [{"fiscal_year": 2024}, {"fiscal_year": 2025}]}).encode(), run_id="1") == kept
    with pytest.raises(ValueError):
        publish.store(spark, str(tmp_path), "s", "reports", "E1", day, b"[]", run_id="1")
    found = raw.read_manifests(spark, str(tmp_path))
    units = spark.createDataFrame([("reports", "E1", day), ("reports", "E2", day)], "endpoint string, unit_key string, snapshot_date date")
    assert [r.unit_key for r in publish.remaining(units, found).collect()] == ["E2"]
    assert raw.responses(found, str(tmp_path)).select("unit_key", "record_count").collect() == [("E1", 2)]


def test_a_response_must_be_an_array_of_objects(spark, tmp_path):
    rows = lambda *paths: spark.createDataFrame([(i, "j", "succeeded", p, None, dt.datetime(2026, 7, 1)) for i, p in enumerate(paths)], RUN + ", snapshot_date date, started_at timestamp")
    good, empty, bad = put(tmp_path / "a.json.gz", [{"v": 1}, {"w": "x"}]), put(tmp_path / "b.json.gz", []), put(tmp_path / "c.json.gz", [1, {"v": 1}])
    assert sorted(r.payload_json for r in raw.responses_of_runs(rows(good, empty), "j", "s", "e").collect()) == ['{"data":[]}', '{"data":[{"v": 1}, {"w": "x"}]}']
    with pytest.raises(Exception, match="no array of objects"):
        raw.responses_of_runs(rows(bad), "j", "s", "e").collect()


def test_a_mart_that_fails_its_checks_is_not_made_current(spark, tmp_path):
    marts = runs.Marts(spark, str(tmp_path))
    with pytest.raises(KeyError):
        marts.current("metric_comparison_fact")
    filed = disclosures(spark, [{"disclosed_date": dt.date(2026, 5, 8), "operating_income": 10}]).withColumn("available_at", F.lit("2026-05-08 03:00:00").cast("timestamp"))
    fact = comparisons.metric_comparison_fact(filed)
    marts.publish("metric_comparison_fact", fact, "1", runs.fact_checks)
    n = marts.current("metric_comparison_fact").count()
    with pytest.raises(ValueError, match="key_twice"):
        marts.publish("metric_comparison_fact", fact.union(fact), "2", runs.fact_checks)
    assert marts.current("metric_comparison_fact").count() == n > 0
    one = spark.createDataFrame([(7, "all", 1, "operating_income", "absolute", "lt", "20", dt.datetime(2026, 1, 1))], "rule_id long, logic string, position int, metric_key string, comparison_type string, operator string, threshold_value string, created_at timestamp")
    scope = spark.createDataFrame([(7, "41230")], "rule_id long, security_key string")
    events = runs.build_test_evaluate(marts, filed, "3", one, scope, F.lit("2026-07-01").cast("date"))
    assert [(r.rule_id, r.status, r.mode) for r in events.collect()] == [(7, "fired", "live")]
    again = runs.build_test_evaluate(marts, filed, "4", one, scope, F.lit("2026-07-01").cast("date"), log=events)
    assert again.count() == 0


def test_jobs_over_a_lake(spark, tmp_path, capsys):
    root = str(tmp_path / "lake")
    demo.build(spark, root)
    assert jobs.main(["check", "--lake", root], spark) in (0, 1) and "duplicate_price" in capsys.readouterr().out
    assert jobs.main(["reconcile", "--lake", root], spark) == 0
    out = json.loads(capsys.readouterr().out)
    assert all(r["n"] > 0 for r in out)
    assert jobs.main(["replay", "--lake", root, "--security", "90010", "--metric", "revenue", "--comparison", "absolute", "--operator", "gt", "--threshold", "0"], spark) == 0
    assert all(json.loads(line)["status"] in ("fired", "not_fired", "unavailable") for line in capsys.readouterr().out.splitlines())
    with pytest.raises(SystemExit):
        jobs.main(["replay", "--lake", root, "--security", "90010", "--metric", "revenue", "--comparison", "yoy", "--operator", "crosses_below"], spark)


def test_build_takes_only_what_is_new(spark, tmp_path):
    quote = lambda day, close: {"Date": day, "Code": "52340", "C": close, "AdjC": close, "UL": "0", "LL": "0"}
    paths = [put(tmp_path / f"raw/{i}.json.gz", [quote("2026-07-0%d" % min(i, 2), str(i))]) for i in (1, 2, 3)]
    table = lambda n: spark.createDataFrame([(i + 1, "prices", "succeeded", p) for i, p in enumerate(paths[:n])], RUN).write.mode("overwrite").parquet(str(tmp_path / "runs"))
    args = ["build", "--lake", str(tmp_path / "lake"), "--runs", str(tmp_path / "runs"), "--job", "prices", "jpx"]
    closes = lambda: sorted((str(r.obs_date), r.close_price) for r in jobs.Lake(spark, str(tmp_path / "lake")).observations().collect())
    table(1)
    assert jobs.main(args, spark) == 0 and jobs.main(args, spark) == jobs.NOTHING_NEW
    table(3)
    assert jobs.main(args, spark) == 0
    step = closes()
    assert jobs.main([*args, "--full"], spark) == 0 and closes() == step == [("2026-07-01", 1.0), ("2026-07-02", 3.0)]


def test_queue_takes_days_from_the_evidence(spark):
    found = spark.createDataFrame([(1, "fired", "live", '{"actual_disclosed_date":"2026-05-01"}'), (2, "fired", "live", '{"actual_disclosed_date":"soon"}'), (3, "fired", "live", '{"actual_disclosed_date":"2026-06-01"}')], "evaluation_id long, status string, mode string, evidence string")
    none = spark.createDataFrame([], "response_id long, evaluation_id long, disposition string, next_review_on date")
    assert [r.evaluation_id for r in rules.work_queue(found, none, F.lit("2026-07-01").cast("date")).collect()] == [3, 1, 2]


def test_names(spark):
    rows = spark.createDataFrame([(1, " Robots", True), (2, "robots ", True), (3, "ROBOTS", False), (4, "Ships", True), (5, None, True), (6, None, True)], "theme_id long, theme_name string, is_active boolean")
    assert sorted(r.theme_id for r in control.name_clashes(rows).collect()) == [1, 2]
    assert rows.select(control.same_name(F.lit(" A"), F.lit("a "))).first()[0]


def test_writers_of_one_file(spark, tmp_path):
    sinks.put_plain(spark, b"x", str(tmp_path / "f"))
    assert sinks.put_plain(spark, b"x", str(tmp_path / "f")) == b"x"
    with pytest.raises(ValueError):
        sinks.put_plain(spark, b"y", str(tmp_path / "f"))
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["f"]
