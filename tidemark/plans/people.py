"""python -m tidemark.plans.people evaluate|queue|import-members: what people keep, under one folder of Parquet tables.

rules: rule_id, version_no, enabled, logic, created_at and conditions in either form (see rules.conditions_of); scopes, mandates and watchlist as for
rules.scopes_in_force; targets: target_id, security_key; responses: response_id, evaluation_id, disposition, next_review_on. members are
versions with a current one: theme_id, code, valid_from, valid_to. events is the log. The exit code is 0, or 99 if there is nothing new.
"""

from __future__ import annotations

import argparse
import datetime as dt
import hashlib
import json
import sys
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import valid_on
from ..operators import checks, control, rules
from ..sources import raw, sinks
from ..sources.eventlog import EventLog
from ..sources.lake import Lake
from .jobs import NOTHING_NEW
from .runs import Marts

EVENTS = "rule_id long, event_key string, mode string, status string, reason string, security_key string, fiscal_year_end date, actual_disclosed_date date, observed_value double, evidence string, evidence_hash string, definition_version string"
MEMBERS = "theme_id long, code string, valid_from date, valid_to date"
IMPORTS = "theme_id long, sha256 string"


@dataclass(frozen=True)
class Control:
    spark: SparkSession
    root: str

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def table_or_empty(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(self.path(name))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def members(self) -> DataFrame:
        try:
            return Marts(self.spark, self.root).current("members")
        except KeyError:
            return self.spark.createDataFrame([], MEMBERS)

    def log(self) -> EventLog:
        name = "events_" + hashlib.sha256(self.root.encode()).hexdigest()[:12]
        return EventLog(self.spark, name, self.path("events"), EVENTS).create()


def evaluate(lake: Lake, kept: Control, as_of: dt.date, run: str, rule_id: int | None = None, mode: str = "live") -> DataFrame:
    """Evaluates the stored rules that are switched on, or one of them, and adds their events to the log: (rule_id, status, n) of those added."""
    day = F.lit(as_of)
    stored = rules.current_versions(kept.table("rules"), "rule_id").filter("enabled")
    stored = stored if rule_id is None else stored.filter(F.col("rule_id") == rule_id)
    conditions = rules.conditions_of(stored).join(stored.select("rule_id", "logic", "created_at"), "rule_id")
    members = kept.members().join(kept.table("targets").withColumnRenamed("security_key", "code"), "code").select("theme_id", "target_id", "valid_from", "valid_to")
    scopes = rules.scopes_in_force(kept.table("scopes"), members, kept.table("mandates"), kept.table("watchlist")).filter(valid_on(day, "valid_from", "valid_until"))
    scope = scopes.join(kept.table("targets"), "target_id").select("rule_id", "security_key").distinct()
    found = rules.evaluate_rule(lake.run("metric_comparison_input"), conditions, scope, day, mode)
    log = kept.log()
    log.add(found.select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in EVENTS.split(", "))), run)
    return log.rows().filter(F.col("added_by").startswith(f"{run}-")).groupBy("rule_id", "status").agg(F.count(F.lit(1)).alias("n")).orderBy("rule_id", "status")


def queue(kept: Control, today: dt.date) -> dict[str, int]:
    """How many live events wait for somebody, and how many were never answered."""
    events = kept.log().events().withColumn("evaluation_id", F.xxhash64("rule_id", "event_key", "mode"))
    answers = kept.table_or_empty("responses", "response_id long, evaluation_id long, disposition string, next_review_on date")
    return {state: rules.work_queue(events, answers, F.lit(today), state, limit=2**31 - 1).count() for state in ("actionable", "unhandled")}


def import_members(kept: Control, path: str, theme_id: int, mode: str, day: dt.date, industry: str | None = None) -> dict[str, int] | None:
    """Takes a list of codes as the members of a theme from a day on: counts of changes, or None if a file of that content was taken before."""
    body = sinks.read_bytes(kept.spark, path)
    if body is None:
        raise FileNotFoundError(path)
    sha = hashlib.sha256(body).hexdigest()
    if not control.import_once(kept.table_or_empty("imports", IMPORTS), theme_id, sha):
        return None
    members = kept.members()
    open_ = members.filter((F.col("theme_id") == theme_id) & F.col("valid_to").isNull()).select("code")
    changes = control.membership_changes(open_, raw.read_codes(kept.spark, path, industry), mode)
    after = control.apply_membership(members, changes, theme_id, F.lit(day))
    Marts(kept.spark, kept.root).publish("members", after, f"{day}-{theme_id}-{sha[:16]}", lambda m: {"member_twice": checks.unique(m, ["theme_id", "code", "valid_from"])})
    kept.spark.createDataFrame([(theme_id, sha)], IMPORTS).coalesce(1).write.mode("append").parquet(kept.path("imports"))
    return {r["change"]: r["count"] for r in changes.groupBy("change").count().collect()}  # three kinds at most


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    jobs = p.add_subparsers(dest="job", required=True)
    for name in ("evaluate", "queue", "import-members"):
        j = jobs.add_parser(name)
        j.add_argument("--control", required=True, help="the folder of the tables")
        j.add_argument("--as-of", type=dt.date.fromisoformat, default=dt.date.today())
        if name == "evaluate":
            j.add_argument("--lake", required=True)
            j.add_argument("--rule-id", type=int)
            j.add_argument("--mode", choices=("live", "replay"), default="live")
            j.add_argument("--run", required=True, help="names this run in the log")
        if name == "import-members":
            j.add_argument("--list", required=True)
            j.add_argument("--theme", type=int, required=True)
            j.add_argument("--mode", choices=("append", "replace"), required=True)
            j.add_argument("--industry")
    a = p.parse_args(args)
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    kept = Control(spark, a.control)
    if a.job == "evaluate":
        for line in evaluate(Lake(spark, a.lake), kept, a.as_of, a.run, a.rule_id, a.mode).toJSON().toLocalIterator():
            print(line)
        return 0
    made = queue(kept, a.as_of) if a.job == "queue" else import_members(kept, a.list, a.theme, a.mode, a.as_of, a.industry)
    if made is None:
        return NOTHING_NEW
    print(json.dumps(made, sort_keys=True))
    return 0


if __name__ == "__main__":
    sys.exit(main())
