"""Builds that lose nothing: several jobs, builds that are stopped at each step, builds at once."""

import datetime as dt
import gzip
import json
import threading

import pytest
from pyspark.sql import functions as F

from tidemark.plans import jobs
from tidemark.sources import sinks
from tidemark.sources.lake import Lake
from tidemark.sources.snapshots import Dataset

RUN = "ingestion_run_id long, job_type string, status string, raw_path string"
ROW = "security_key string, source_key string, obs_date date, close double, ingestion_run_id long"
KEYS = ("security_key", "obs_date", "source_key")


def put(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(gzip.compress(json.dumps(rows).encode()))
    return str(path)


def quote(day, code, close, flag="0"):
    return {"Date": day, "Code": code, "C": str(close), "AdjC": str(close), "UL": flag, "LL": "0"}


@pytest.fixture
def runs(spark, tmp_path):
    rows = [
        (10, "a", "succeeded", put(tmp_path / "raw/10.gz", [quote("2024-12-30", "11110", 1), quote("2025-01-06", "11110", 2), quote("2025-01-06", "11115", 7, "?")])),
        (5, "b", "succeeded", put(tmp_path / "raw/5.gz", [quote("2025-01-06", "11110", 3), quote("2025-01-06", "22225", 4)])),
        (12, "a", "succeeded", put(tmp_path / "raw/12.gz", [quote("2025-01-06", "11110", 5), quote("2025-01-06", "11110", 6)])),
        (6, "b", "failed", None),
    ]
    return lambda *ids: spark.createDataFrame([r for r in rows if r[0] in ids], RUN)


def closes(lake):
    return sorted((r.source_key, str(r.obs_date), r.security_key, r.close_price) for r in lake.observations().collect())


A1, B, A2 = ("A", "2024-12-30", "11110", 1.0), [("B", "2025-01-06", "11110", 3.0), ("B", "2025-01-06", "22225", 4.0)], ("A", "2025-01-06", "11110", 6.0)


@pytest.mark.parametrize("order", [("a", "b"), ("b", "a")])
def test_jobs_in_any_order(spark, tmp_path, runs, order):
    lake, sources = Lake(spark, str(tmp_path / "lake")), {"a": "A", "b": "B"}
    for job in order:
        assert jobs.build(lake, runs(10, 5, 6), {job: sources[job]})
    assert closes(lake) == [A1, ("A", "2025-01-06", "11110", 2.0), *B]
    assert jobs.build(lake, runs(10, 5, 6), sources) is None
    made = jobs.build(lake, runs(10, 5, 12), sources)
    assert made == [{"job": "a", "source": "A", "records": 2, "rejected": 0, "rows": 1, "unmapped": 0, "replaced": 1}]
    assert closes(lake) == [A1, A2, *B]
    made = jobs.build(lake, runs(10, 5, 12), {"a": "A"}, full=True)
    assert made[0]["records"] == 5 and made[0]["rejected"] == 1 and made[0]["rows"] == 2
    assert closes(lake) == [A1, A2, *B]  # the other source stays


def test_two_jobs_of_one_source_have_their_own_watermarks(spark, tmp_path, runs):
    lake = Lake(spark, str(tmp_path / "lake"))
    assert jobs.build(lake, runs(10), {"a": "A"})
    assert jobs.build(lake, runs(10, 5), {"a": "A", "b": "A"})[0]["rows"] == 2
    assert ("A", "2025-01-06", "22225", 4.0) in closes(lake) and ("A", "2025-01-06", "11110", 2.0) in closes(lake)


def test_all_jobs_in_one_run_are_one_commit(spark, tmp_path, runs):
    lake = Lake(spark, str(tmp_path / "lake"))
    assert [x["unmapped"] for x in jobs.build(lake, runs(10, 5, 12), {"a": "A", "b": "B"})] == [0, 1]
    assert closes(lake) == [A1, A2, *B] and jobs.price_dataset(lake).numbers() == [1]


def test_only_touched_years_are_written(spark, tmp_path, runs):
    lake = Lake(spark, str(tmp_path / "lake"))
    jobs.build(lake, runs(10, 5), {"a": "A", "b": "B"})
    before = jobs.price_dataset(lake).head().parts
    jobs.build(lake, runs(10, 5, 12), {"a": "A"})
    after = jobs.price_dataset(lake).head().parts
    assert {k for k in after if after[k] != before[k]} == {("A", "2025")}


def test_a_dataset_of_years_is_adopted(spark, tmp_path, runs):
    lake = Lake(spark, str(tmp_path / "lake"))
    jobs.build(lake, runs(10, 5), {"a": "A", "b": "B"})
    old = closes(lake)
    plain = Lake(spark, str(tmp_path / "plain"))
    sinks.write_by_year(lake.observations(), str(tmp_path / "plain/observed/market_price"), "obs_date")
    assert closes(plain) == old
    assert jobs.build(plain, runs(10, 5), {"a": "A"}) is None and closes(plain) == old
    assert jobs.build(plain, runs(10, 5, 12), {"a": "A"}) and closes(plain) == [A1, A2, *B]


@pytest.mark.parametrize("step", ["write", "merge", "before commit", "after commit"])
def test_a_build_that_is_stopped_loses_nothing(spark, tmp_path, runs, monkeypatch, step):
    lake = Lake(spark, str(tmp_path / "lake"))
    jobs.build(lake, runs(10, 5), {"a": "A", "b": "B"})
    old = closes(lake)
    write, commit = Dataset.write, Dataset.commit

    def stopped_write(self, rows, name):
        found = write(self, rows, name)
        if step == ("merge" if name.endswith("-merged") else "write"):
            raise KeyboardInterrupt
        return found

    def stopped_commit(self, *a):
        if step == "after commit":
            commit(self, *a)
        if step.endswith("commit"):
            raise KeyboardInterrupt
        return commit(self, *a)

    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(Dataset, "write", stopped_write)
        m.setattr(Dataset, "commit", stopped_commit)
        jobs.build(lake, runs(10, 5, 12), {"a": "A"})
    assert closes(lake) == ([A1, A2, *B] if step == "after commit" else old)
    again = jobs.build(lake, runs(10, 5, 12), {"a": "A"})
    assert (again is None) == (step == "after commit") and closes(lake) == [A1, A2, *B]
    data = jobs.price_dataset(lake)
    assert data.vacuum(3600) == []
    assert len(data.vacuum(-10)) > 0 and closes(lake) == [A1, A2, *B] and len(data.numbers()) == 1


def rows(spark, *values):
    return spark.createDataFrame([(k, s, dt.date(y, 1, 5), float(n), n) for k, s, y, n in values], ROW)


def test_builds_at_once_lose_none(spark, tmp_path):
    data = Dataset(spark, str(tmp_path / "d"), KEYS)
    errors = []

    def one(i):
        try:
            source = f"s{i % 3}"
            data.build([source], ROW, lambda base: (rows(spark, (f"k{i}", source, 2020, i), ("shared", source, 2021, i)), {source: i}))
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=one, args=(i,)) for i in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    found = data.read(ROW).collect()
    assert not errors and data.numbers() == list(range(1, 7))
    assert sorted(r.security_key for r in found if r.security_key != "shared") == [f"k{i}" for i in range(6)]
    assert sorted((r.source_key, r.ingestion_run_id) for r in found if r.security_key == "shared") == [("s0", 3), ("s1", 4), ("s2", 5)]


def test_one_of_many_writers_creates_a_file(spark, tmp_path):
    won = []
    threads = [threading.Thread(target=lambda i=i: won.append(sinks.put_new(spark, str(i).encode() * 1000, str(tmp_path / "f")))) for i in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sum(won) == 1 and len(set((tmp_path / "f").read_bytes())) == 1
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["f"]


def test_reads_of_parts_and_of_earlier_snapshots(spark, tmp_path):
    data = Dataset(spark, str(tmp_path / "d"), KEYS)
    assert data.read(ROW).count() == 0 and data.head().number == 0
    data.build(["x y/z"], ROW, lambda base: (rows(spark, ("a", "x y/z", 2020, 1), ("a", "x y/z", 2021, 1)).union(rows(spark, ("b", "x y/z", 2020, 1)).withColumn("obs_date", F.lit(None).cast("date"))), {"j": 1}))
    data.build(["x y/z"], ROW, lambda base: (rows(spark, ("a", "x y/z", 2020, 2)), {"j": 2}))
    assert sorted(data.head().parts) == [("x y/z", "2020"), ("x y/z", "2021"), ("x y/z", "none")]
    assert [r.close for r in data.read(ROW, years=["2020"]).collect()] == [2.0] and data.read(ROW, data.at(1)).filter("close = 1").count() == 3
    assert data.read(ROW, sources=["other"]).count() == 0
    with pytest.raises(KeyError):
        data.at(7)
