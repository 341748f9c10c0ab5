import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import analyses, checks, rules
from tidemark.operators import comparisons as c
from tests.helpers import day, disclosures

AS_OF = dt.date(2033, 1, 1)


def years(spark, current, prior, **more):
    now = {"disclosed_date": day(10), "disclosure_number": "2"} | current | more
    before = {"disclosed_date": dt.date(2030, 2, 20), "fiscal_year_end": dt.date(2029, 12, 31), "fiscal_year_start": dt.date(2029, 1, 1)} | prior
    return disclosures(spark, [now, before])


def facts(df):
    found = c.metric_comparison_input(df).filter("fiscal_year_end = '2030-12-31'").collect()
    return {(r.metric_key, r.comparison_type): r for r in found}


def test_input(spark):
    got = facts(years(spark, {"operating_income": 85}, {"operating_income": 80, "next_forecast_operating_income": 100}))
    value = lambda k: got["operating_income", k].observed_value
    assert (value("forecast_variance"), value("yoy"), value("absolute")) == (-15.0, 6.25, 85.0)
    assert got["revenue", "yoy"].input_status == "current_missing" and len(got) == 12
    lone = facts(disclosures(spark, [{"disclosed_date": day(1), "operating_income": 1}]))
    assert lone["operating_income", "yoy"].input_status == "reference_missing" and lone["operating_income", "absolute"].input_status == "ok"
    odd = facts(years(spark, {"operating_income": 1, "fiscal_year_start": dt.date(2030, 4, 1)}, {}))
    assert odd["operating_income", "absolute"].input_status == "unsupported_period"


def judged(spark, df, conditions, as_of=AS_OF):
    columns = "rule_id long, logic string, position int, metric_key string, comparison_type string, operator string, threshold_value decimal(20,4)"
    from decimal import Decimal

    made = spark.createDataFrame([(r, lo, i, m, k, o, None if t is None else Decimal(t)) for i, (r, lo, m, k, o, t) in enumerate(conditions)], columns)
    return {r.rule_id: r for r in rules.evaluate_rules(c.metric_comparison_input(df).filter("fiscal_year_end = '2030-12-31'"), made, F.lit(as_of)).collect()}


def test_limits_are_exact(spark):
    df = years(spark, {"operating_income": 85}, {"next_forecast_operating_income": 100})
    got = judged(spark, df, [(i, "all", "operating_income", "forecast_variance", o, "-15") for i, o in enumerate(("lt", "lte", "gt", "gte"))])
    assert [got[i].status for i in range(4)] == ["not_fired", "fired", "not_fired", "fired"]
    early = judged(spark, df, [(0, "all", "operating_income", "forecast_variance", "lte", "-15")], day(10))
    assert early[0].status == "unavailable"


def test_crossings_and_missing_data(spark):
    df = years(spark, {"net_income": -10}, {"net_income": 50})
    sign = [(0, "all", "net_income", "sign_transition", "crosses_below", None), (1, "all", "net_income", "sign_transition", "crosses_above", None), (2, "any", "operating_income", "yoy", "lt", "0")]
    got = judged(spark, df, sign)
    assert [got[i].status for i in range(3)] == ["fired", "not_fired", "unavailable"]


def test_three_values(spark):
    df = years(spark, {"operating_income": 85, "revenue": 5}, {"next_forecast_operating_income": 100})
    fired, missing, not_fired = ("operating_income", "forecast_variance", "lt", "0"), ("revenue", "yoy", "lt", "0"), ("revenue", "absolute", "lt", "0")
    sets = [("all", fired, missing), ("any", fired, missing), ("all", missing, not_fired), ("any", missing, not_fired), ("all", fired, ("x", "y", "lt", "0")), ("any", fired, not_fired)]
    got = judged(spark, df, [(i, lo, *cond) for i, (lo, *conds) in enumerate(sets) for cond in conds])
    assert [got[i].status for i in range(6)] == ["unavailable", "fired", "not_fired", "unavailable", "unavailable", "fired"]


def test_event_log_is_written_once(spark):
    log = spark.createDataFrame([(1, "a")], "rule_id long, event_key string")
    new = spark.createDataFrame([(1, "a"), (2, "a"), (2, "a")], "rule_id long, event_key string")
    once = rules.insert_absent(log, new, ["rule_id", "event_key"])
    assert once.count() == 2 and rules.insert_absent(once, new, ["rule_id", "event_key"]).count() == 2


def test_vocabulary(spark):
    columns = "rule_id long, position int, comparison_type string, operator string, threshold_value double, target_id long, theme_id long, mandate_id long"
    rows = [(1, 1, "yoy", "lt", 1.0, 5, None, None), (2, 1, "sign_transition", "lt", 1.0, 5, None, None), (3, 1, "yoy", "lt", None, 5, 6, None), (4, 1, "yoy", "huh", 1.0, None, None, 1), (5, 1, "sign_transition", "crosses_above", 1.0, 5, None, None)]
    got = sorted((r.rule_id, r.violation) for r in rules.rule_violations(spark.createDataFrame(rows, columns)).collect())
    assert got == [(2, "sign_needs_crossing"), (3, "one_scope_needed"), (3, "threshold_missing"), (4, "operator_unknown"), (5, "crossing_takes_no_threshold")]


def test_versions(spark):
    versions = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "rule_id long, version_no int, name string")
    more = rules.add_version(versions, spark.createDataFrame([(1, "c"), (3, "d")], "rule_id long, name string"), "rule_id")
    assert sorted((r.rule_id, r.version_no, r.name) for r in rules.current_versions(more, "rule_id").collect()) == [(1, 2, "c"), (2, 1, "b"), (3, 1, "d")]
    left, counts = rules.delete_rules({"versions": more}, spark.createDataFrame([(1,)], "rule_id long"))
    assert left["versions"].count() == 2 and counts.first()["deleted"] == 2


def test_gate(spark):
    df = spark.createDataFrame([(1,), (1,), (None,)], "k long")
    assert {r.check_name: r.violations for r in checks.counts({"null": checks.not_null(df, "k"), "twice": checks.unique(df, ["k"])}).collect()} == {"null": 1, "twice": 1}
    checks.gate({"none": checks.accepted(df, "k", [1])})
    with pytest.raises(ValueError, match="twice"):
        checks.gate({"twice": checks.unique(df, ["k"])})


def test_availability_shares_sum_to_one(spark):
    df = years(spark, {"operating_income": 85}, {"next_forecast_operating_income": 100}).withColumn("available_at", F.col("disclosed_date").cast("timestamp"))
    assert sum(r.row_rate for r in analyses.availability(c.metric_comparison_fact(df)).collect()) == pytest.approx(1.0)
    assert checks.reference_not_before(c.metric_comparison_fact(df)).count() == 0


def test_values_beyond_the_decimal_form_are_judged(spark):
    """A value too large or too small for an exact decimal is compared as a double."""
    rows = [(1e24, "gt", "1"), (-1e24, "gt", "1"), (1e-17, "gt", "0"), (0.1, "lte", "0.1"), (-1e300, "lt", "-5")]
    df = spark.createDataFrame(rows, "observed_value double, operator string, threshold_value string").withColumns({"reference_value": F.lit(None).cast("double"), "current_value": F.lit(None).cast("double")})
    assert [r[0] for r in df.select(rules.holds()).collect()] == [True, False, True, True, True]


def test_rules_run_over_their_scopes_once(spark):
    """Live runs take what was disclosed after the rule's day in Tokyo; a second run finds nothing new; hidden facts take no part."""
    fact = "security_key string, fiscal_year_end date, actual_disclosure_number string, actual_disclosed_date date, reporting_scope string, accounting_standard string, metric_key string, comparison_type string, available_on date, input_status string, observed_value double, reference_value double, current_value double"
    end = dt.date(2025, 3, 31)
    row = lambda s, n, d, a: (s, end, n, dt.date(2026, 5, d), "consolidated", "IFRS", "revenue", "yoy", dt.date(2026, 5, a), "ok", -30.0, 1.0, 1.0)
    facts = spark.createDataFrame([row("A", "1", 2, 3), row("A", "2", 3, 4), row("A", "3", 20, 21), row("B", "4", 3, 4)], fact)
    made = dt.datetime(2026, 5, 1, 16)  # the second of May in Tokyo
    rule = spark.createDataFrame([(7, "all", 1, "revenue", "yoy", "lt", "-20", made)], "rule_id long, logic string, position int, metric_key string, comparison_type string, operator string, threshold_value string, created_at timestamp")
    scope = spark.createDataFrame([(7, "A")], "rule_id long, security_key string")
    day = F.lit(dt.date(2026, 5, 10))
    run = lambda mode, log=None: rules.evaluate_rule(facts, rule, scope, day, mode, log)
    assert [r.actual_disclosure_number for r in run("live").collect()] == ["2"]
    replay = run("replay")
    assert sorted((r.actual_disclosure_number, r.status) for r in replay.collect()) == [("1", "fired"), ("2", "fired")]
    assert run("replay", replay).count() == 0 and run("live", replay).count() == 1


def test_events_that_differ_in_a_missing_condition_have_their_own_keys(spark):
    df = disclosures(spark, [{"disclosed_date": dt.date(2026, 5, 8), "operating_income": 10, "net_income": 5}])
    facts = c.metric_comparison_input(df).filter("comparison_type = 'absolute'")
    kinds = "rule_id long, logic string, position int, metric_key string, comparison_type string, operator string, threshold_value string"
    made = spark.createDataFrame([(1, "any", 1, "operating_income", "absolute", "gt", "0"), (1, "any", 2, "net_income", "absolute", "gt", "9")], kinds)
    both, one = (rules.evaluate_rules(f, made, F.lit(dt.date(2026, 7, 1))).first() for f in (facts, facts.filter("metric_key <> 'net_income'")))
    assert [m.reason for m in both.conditions] == ["ok", "ok"] and [m.reason for m in one.conditions] == ["ok", "condition_input_missing"]
    assert both.status == one.status == "fired" and both.event_key != one.event_key and both.evidence_hash != one.evidence_hash
    assert "condition_input_missing" in one.evidence and one.n_conditions == 2 and one.definition_version == rules.DEFINITION_VERSION


def test_scopes_by_day(spark):
    kinds = "rule_id long, target_id long, valid_from date, valid_until date"
    d = lambda m, n: dt.date(2026, m, n)
    scopes = spark.createDataFrame([(1, 7, d(1, 1), d(3, 1)), (1, 7, d(2, 1), d(2, 10)), (1, 7, d(3, 1), None), (1, 8, d(5, 5), d(5, 6)), (2, 7, dt.date(1, 1, 1), None)], kinds)
    events = spark.createDataFrame([(1, 7, dt.date(2025, 12, 31), "a"), (1, 7, d(1, 1), "b"), (1, 7, d(2, 5), "c"), (1, 7, d(3, 1), "d"), (1, 7, dt.date(2040, 1, 1), "e"), (1, 8, d(5, 5), "f"), (1, 8, d(5, 6), "g"), (2, 7, dt.date(2001, 1, 1), "h"), (1, 7, None, "i"), (None, 7, d(1, 2), "j"), (3, 7, d(1, 2), "k")], "rule_id long, target_id long, day date, e string")
    assert sorted(r.e for r in rules.in_scope_on_their_day(events, scopes, "day").collect()) == list("bcdefh")


def test_no_task_gets_all_facts_of_a_condition(spark):
    """Without a broadcast the facts of one condition are dealt into shares, and every fact meets every condition once."""
    found = spark.range(3000).select(F.concat(F.lit("S"), "id").alias("security_key"), *(F.lit(None).cast("string").alias(x) for x in rules.EVENT[1:]), F.lit("revenue").alias("metric_key"), F.lit("yoy").alias("comparison_type"), F.col("id").cast("double").alias("observed_value"), F.col("id").cast("double").alias("reference_value"), F.col("id").cast("double").alias("current_value"), F.lit("ok").alias("input_status"), F.lit(dt.date(2030, 1, 1)).alias("available_on"))
    made = spark.createDataFrame([(1, "all", 1, "revenue", "yoy", "gt", "10"), (2, "all", 1, "revenue", "yoy", "lt", "5"), (2, "all", 2, "net_income", "yoy", "lt", "5")], "rule_id long, logic string, position int, metric_key string, comparison_type string, operator string, threshold_value string")
    changed = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in changed.items():
        spark.conf.set(k, v)
    try:
        events = rules.evaluate_rules(found, made, F.lit(AS_OF)).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k in changed:
            spark.conf.unset(k)
    assert sorted((r.rule_id, int(r.security_key[1:])) for r in events) == [(i, k) for i in (1, 2) for k in range(3000)]
    assert {r.n_conditions for r in events if r.rule_id == 2} == {2} and sum(r.status == "fired" for r in events) == 2989
    sizes = [sum(r.task == x for r in events) for x in {r.task for r in events}]
    assert max(sizes) < 2500, sizes  # by rule alone 3,000 each
