import threading

from pyspark.sql import functions as F

from tidemark.sources.eventlog import EventLog

SCHEMA = "rule_id long, event_key string, mode string, status string"


def events(spark, *rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_each_event_is_added_once(spark, tmp_path):
    log = EventLog(spark, "log_once", str(tmp_path / "log"), SCHEMA, buckets=4).create()
    first = events(spark, (1, "a", "live", "fired"), (1, "a", "live", "fired"), (1, "b", "live", "fired"), (None, "x", "live", "fired"), (1, "a", "replay", "fired"))
    log.add(first, "r1")
    log.add(first.union(events(spark, (2, "a", "live", "not_fired"), (1, "a", "live", "changed"))), "r2")
    assert sorted((r.rule_id, r.event_key, r.mode, r.status) for r in log.rows().collect()) == [(1, "a", "live", "fired"), (1, "a", "replay", "fired"), (1, "b", "live", "fired"), (2, "a", "live", "not_fired")]
    again = EventLog(spark, "log_again", str(tmp_path / "log"), SCHEMA, buckets=4).create()  # another session finds the files
    assert again.events().count() == 4 and again.lacking(first).filter("rule_id is not null").count() == 0


def test_the_log_is_not_dealt_again(spark, tmp_path):
    log = EventLog(spark, "log_plan", str(tmp_path / "log"), SCHEMA, buckets=4).create()
    log.add(events(spark, (1, "a", "live", "fired")), "r1")
    plan = log.lacking(events(spark, (1, "a", "live", "fired")))._jdf.queryExecution().executedPlan().toString()
    side = plan[plan.index("SortMergeJoin") :].split("\n")
    scan = next(i for i, x in enumerate(side) if "FileScan parquet" in x)
    depth = side[scan].index("FileScan")
    above = [x for i, x in enumerate(side[:scan]) if "Exchange" in x and x.index("Exchange") < depth and all(y[: x.index("Exchange")].strip(" :*()0123456789") == "" or y.index("+") > x.index("Exchange") for y in side[i + 1 : scan + 1] if "+" in y)]
    assert not above and "Bucketed: true" in side[scan]
    assert "Exchange" not in log.events()._jdf.queryExecution().executedPlan().toString()


def test_two_runs_at_once_add_each_event_once(spark, tmp_path):
    log = EventLog(spark, "log_both", str(tmp_path / "log"), SCHEMA, buckets=4).create()
    threads = [threading.Thread(target=lambda i=i: log.add(spark.range(50).select(F.lit(1).cast("long").alias("rule_id"), F.concat(F.lit("e"), F.col("id") + 25 * i).alias("event_key"), F.lit("live").alias("mode"), F.lit(f"s{i}").alias("status")), f"r{i}")) for i in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    found = log.events().collect()
    assert sorted(r.event_key for r in found) == sorted(f"e{i}" for i in range(100))
