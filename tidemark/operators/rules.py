"""Monitoring rules over comparison facts, in three values: fired, not_fired, unavailable. Missing data never means not fired."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import scan
from ..functions.columns import exact_decimal, join_few, pick_first, tokyo_date, valid_on

#: Operators, statuses and reasons, and what makes an event, are the contract of stored rules and events.
OPERATORS = ("lt", "lte", "gt", "gte", "crosses_below", "crosses_above")
#: The version of the comparisons' definition that facts are of unless they say so.
DEFINITION_VERSION = "1"
#: What makes an event: rows that share these are judged together.
EVENT = ("security_key", "fiscal_year_end", "actual_disclosure_number", "actual_disclosed_date", "reporting_scope", "accounting_standard")


def reason_of(as_of: Column) -> Column:
    """ok, or why a fact cannot be judged."""
    observed, operator = F.col("observed_value"), F.col("operator")
    reason = F.when(F.col("available_on") > as_of, "not_available_yet").otherwise(F.col("input_status"))
    finite = observed.isNotNull() & ~F.isnan(observed) & (F.abs(observed) < float("inf"))
    return F.when(reason != "ok", reason).when(~F.coalesce(finite, F.lit(False)), "nonfinite_value").when(~operator.isin(*OPERATORS), "unsupported_operator").otherwise("ok")


def holds() -> Column:
    """Whether the operator of a row holds; thresholds are compared as exact decimals, values without such a form as doubles."""
    limit, operator = F.col("threshold_value").cast("decimal(20,4)"), F.col("operator")
    exact, rough = exact_decimal(F.col("observed_value")), F.col("observed_value").cast("double")
    compare = lambda f: F.when(exact.isNotNull(), f(exact, limit)).otherwise(f(rough, limit.cast("double")))
    reference, current = F.col("reference_value"), F.col("current_value")
    found = (
        F.when(operator == "lt", compare(lambda a, b: a < b))
        .when(operator == "lte", compare(lambda a, b: a <= b))
        .when(operator == "gt", compare(lambda a, b: a > b))
        .when(operator == "gte", compare(lambda a, b: a >= b))
        .when(operator == "crosses_below", (reference >= 0) & (current < 0))
        .when(operator == "crosses_above", (reference <= 0) & (current > 0))
    )
    return F.coalesce(found, F.lit(False))


def event_key(columns: Sequence[str] = ()) -> Column:
    """Names a judged fact: by its comparison key and the two disclosures where the fact has one, else by what makes it."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    whole = F.concat_ws(":", *(text(c) for c in ("security_key", "fiscal_year_end", "actual_disclosure_number", "reporting_scope", "accounting_standard", "metric_key", "comparison_type")))
    if "comparison_key" not in columns:
        return whole
    prior = text("prior_disclosure_number") if "prior_disclosure_number" in columns else F.lit("None")
    return F.when(F.length("comparison_key") > 0, F.concat_ws(":", F.col("comparison_key").cast("string"), text("actual_disclosure_number"), prior)).otherwise(whole)


def evaluate(facts: DataFrame, as_of: Column) -> DataFrame:
    """Adds reason, status, event_key and definition_version to facts that carry operator and threshold_value."""
    rows = facts.withColumn("reason", reason_of(as_of))
    status = F.when(F.col("reason") != "ok", "unavailable").when(holds(), "fired").otherwise("not_fired")
    version = F.lit(DEFINITION_VERSION)
    if "calculation_definition_version" in facts.columns:
        version = F.when(F.length("calculation_definition_version") > 0, F.col("calculation_definition_version").cast("string")).otherwise(version)
    return rows.withColumns({"status": status, "event_key": event_key(facts.columns), "definition_version": version})


def asked_of(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """Each fact with each condition on its metric and comparison."""
    return join_few(facts, rules, ["metric_key", "comparison_type"], EVENT)


def evidence(columns: list[str]) -> tuple[Column, Column]:
    """The judged row as JSON with its keys in order, and the JSON's hash."""
    text = F.to_json(F.struct(*sorted(columns)))
    return text, F.sha2(text, 256)


#: What a condition's hash rests on, besides its key and operator.
_RESTS_ON = ("reference_value", "current_value", "observed_value", "input_status", "available_on")


def _judgement() -> Column:
    """A judged condition with what its evidence needs."""
    threshold = F.col("threshold_value").cast("string").alias("threshold_value")
    return F.struct("position", "metric_key", "comparison_type", "operator", threshold, "status", "reason", *_RESTS_ON, F.col("event_key").alias("source_event_key"), "definition_version")


def _in_evidence(c: Column) -> Column:
    """A judged condition as it stands in the evidence, with a hash of what it rests on (null without a fact)."""
    rests_on = F.to_json(F.struct(*(c[x].alias(x) for x in ("source_event_key", *_RESTS_ON, "operator", "threshold_value", "definition_version"))))
    names = ("position", "metric_key", "comparison_type", "operator", "threshold_value", "status", "reason", "observed_value", "reference_value", "source_event_key", "definition_version")
    return F.struct(*(c[x].alias(x) for x in names), F.when(c["source_event_key"].isNotNull(), F.sha2(rests_on, 256)).alias("evidence_hash"))


def evaluate_rules(facts: DataFrame, rules: DataFrame, as_of: Column) -> DataFrame:
    """One row for each rule and event: rule_id, the event's columns, conditions, status, reason, observed_value (of a rule of one condition),
    n_conditions, evidence (JSON), its hash, event_key, definition_version.

    rules: rule_id, logic (all / any), position, metric_key, comparison_type, operator, threshold_value. Facts are scanned once for
    all rules: those that no condition names go with the join on (metric, comparison). conditions holds every condition of the rule in its
    order; one without its fact is unavailable (condition_input_missing), in the evidence and in the key of the event too.
    All: a condition that did not fire decides, then an unavailable one. Any: one that fired decides, then an unavailable one.
    """
    judged = evaluate(asked_of(facts, rules), as_of).withColumn("_judged", _judgement())
    kind = judged.schema["_judged"].dataType
    # A rule has at most twenty conditions, so these lists are short. They travel with each event, so missing facts show.
    asked = F.struct("position", "metric_key", "comparison_type", "operator", F.col("threshold_value").cast("string").alias("threshold_value"))
    lists = rules.groupBy("rule_id").agg(F.array_sort(F.collect_list(asked)).alias("_asked"))
    events = join_few(judged.groupBy("rule_id", "logic", *EVENT).agg(F.collect_list("_judged").alias("_met")), lists, ["rule_id"], EVENT)
    given = {"status": F.lit("unavailable"), "reason": F.lit("condition_input_missing")}
    absent = lambda c: F.struct(*((given[f.name] if f.name in given else c[f.name] if f.name in ("position", "metric_key", "comparison_type", "operator", "threshold_value") else F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.fields))
    # Of facts that are there twice the last in the judgement's order counts.
    member = lambda c: F.coalesce(F.array_max(F.filter("_met", lambda m: m["position"] == c["position"])), absent(c))
    events = events.withColumn("_judged", F.transform("_asked", member))
    any_is = lambda status: F.exists("_judged", lambda c: c["status"] == status)
    every = F.when(any_is("not_fired"), "not_fired").when(any_is("unavailable"), "unavailable").otherwise("fired")
    some = F.when(any_is("fired"), "fired").when(any_is("unavailable"), "unavailable").otherwise("not_fired")
    events = events.withColumns({"status": F.when(F.col("logic") == "all", every).otherwise(some), "n_conditions": F.size("_judged").cast("long"), "conditions": F.transform("_judged", _in_evidence)})
    reason = F.when(F.col("status") == "fired", F.concat("logic", F.lit("_conditions_fired"))).when(F.col("status") == "not_fired", "condition_not_fired").otherwise("condition_unavailable")
    text = F.to_json(F.struct(*EVENT, F.col("logic").alias("logic_operator"), "conditions"), {"ignoreNullFields": "false"})
    members = F.transform("_judged", lambda c: F.struct(c["position"].alias("position"), c["metric_key"].alias("metric_key"), c["comparison_type"].alias("comparison_type"), c["source_event_key"].alias("source_event_key")))
    identity = F.to_json(F.struct(*EVENT, members.alias("members")), {"ignoreNullFields": "false"})
    first = F.get("_judged", F.lit(0))
    key = F.when((F.col("n_conditions") == 1) & first["source_event_key"].isNotNull(), first["source_event_key"]).otherwise(F.concat(F.lit("multi:"), F.sha2(identity, 256)))
    versions = F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform("_judged", lambda c: c["definition_version"]), lambda v: v.isNotNull()))), "+")
    events = events.withColumns({"reason": reason, "observed_value": F.when(F.col("n_conditions") == 1, first["observed_value"]), "evidence": text, "event_key": key, "definition_version": versions})
    return events.withColumn("evidence_hash", F.sha2("evidence", 256)).drop("_met", "_asked", "_judged")


def conditions_json(rules: DataFrame) -> DataFrame:
    """(rule_id, conditions): each rule's conditions as a JSON array in their order."""
    one = F.struct("position", "metric_key", "comparison_type", "operator", "threshold_value")
    listed = rules.groupBy("rule_id").agg(F.array_sort(F.collect_list(one)).alias("c"))
    return listed.select("rule_id", F.to_json(F.transform("c", lambda x: x.dropFields("position"))).alias("conditions"))


def conditions_of(rules: DataFrame) -> DataFrame:
    """(rule_id, position, metric_key, comparison_type, operator, threshold_value) of stored rules in both forms: a list `conditions` of structs of
    the four, or the older form, one condition in the rule's own four columns. A rule with a list is read by it.
    """
    fields = ("metric_key", "comparison_type", "operator", "threshold_value")
    listed = rules.filter(F.coalesce(F.size("conditions"), F.lit(0)) > 0).select("rule_id", F.posexplode("conditions").alias("_i", "c"))
    listed = listed.select("rule_id", (F.col("_i") + 1).alias("position"), *(F.col("c")[f].alias(f) for f in fields))
    older = rules.filter((F.coalesce(F.size("conditions"), F.lit(0)) <= 0) & F.col("metric_key").isNotNull())
    return listed.unionByName(older.select("rule_id", F.lit(1).alias("position"), *fields))


def form_violations(rules: DataFrame) -> DataFrame:
    """(rule_id, violation) of stored rules of no form or of both, and of the older form with a part missing. rules: as for conditions_of."""
    n, own = F.coalesce(F.size("conditions"), F.lit(0)), ("metric_key", "comparison_type", "operator")
    some, every = F.lit(False), F.lit(True)
    for c in own:
        some, every = some | F.col(c).isNotNull(), every & F.col(c).isNotNull()
    found = F.array(
        F.when((n <= 0) & ~some, "conditions_missing"),
        F.when((n > 0) & (some | F.col("threshold_value").isNotNull()), "two_forms"),
        F.when((n <= 0) & some & ~every, "condition_incomplete"),
        F.when(n > 20, "too_many_conditions"),
    )
    return rules.select("rule_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("violation"))


def live_only(events: DataFrame, created: Column) -> DataFrame:
    """Events disclosed after the day (in Tokyo) on which the rule was made; a replay leaves this out."""
    return events.filter(F.col("actual_disclosed_date") > tokyo_date(created))


def insert_absent(log: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """The log with those of the found rows whose keys it does not have."""
    fresh = found.dropDuplicates(keys).join(log.select(*keys), keys, "left_anti")
    return log.unionByName(fresh.select(*log.columns))


def evaluate_rule(facts: DataFrame, rules: DataFrame, scope: DataFrame, as_of: Column, mode: str, log: DataFrame | None = None, keys: tuple[str, ...] = ("rule_id", "event_key", "mode")) -> DataFrame:
    """Rules over the facts in their scopes that could be seen on a day: the events, or with a log those that it does not have yet.

    rules: as for evaluate_rules, with created_at. scope: (rule_id, security_key), as expand_scopes gives them. mode: live takes only
    what was disclosed after the day, in Tokyo, on which the rule was made; replay takes all.
    """
    if mode not in ("live", "replay"):
        raise ValueError("mode must be live or replay")
    visible = facts.filter(F.col("available_on") <= as_of)
    events = evaluate_rules(visible, rules.drop("created_at"), as_of).join(scope.select("rule_id", "security_key").distinct(), ["rule_id", "security_key"], "left_semi")
    if mode == "live":
        made = rules.groupBy("rule_id").agg(tokyo_date(F.min("created_at")).alias("_made"))
        events = join_few(events, made, ["rule_id"], EVENT).filter(F.col("actual_disclosed_date") > F.col("_made")).drop("_made")
    events = events.withColumn("mode", F.lit(mode))
    return events if log is None else events.dropDuplicates(list(keys)).join(log.select(*keys), list(keys), "left_anti")


def expand_scopes(assignments: DataFrame, members: DataFrame, mandates: DataFrame, watchlist: DataFrame, day: Column) -> DataFrame:
    """(rule_id, target_id) of the targets in each rule's scope on a day, each once.

    assignments: rule_id, scope_type (target, theme, mandate, watchlist), scope_id, watchlist_status (null takes every entry).
    members: theme_id, target_id, valid_from, valid_to; mandates: mandate_id, target_id, status, effective_from, effective_until, and
    version_from, version_until of the mandate's version (half-open all; only active assignments count). watchlist: target_id, status.
    """
    of = lambda kind: assignments.filter(F.col("scope_type") == kind)
    direct = of("target").select("rule_id", F.col("scope_id").alias("target_id"))
    theme = of("theme").join(members.filter(valid_on(day, "valid_from", "valid_to")), F.col("scope_id") == F.col("theme_id")).select("rule_id", "target_id")
    valid = (F.col("status") == "active") & valid_on(day, "effective_from", "effective_until") & valid_on(day, "version_from", "version_until")
    mandate = of("mandate").join(mandates.filter(valid), F.col("scope_id") == F.col("mandate_id")).select("rule_id", "target_id")
    # Each entry's own status and the status "any", so that rules meet entries by an equal key.
    entries = watchlist.select("target_id", F.explode(F.array("status", F.lit("*any*"))).alias("_status"))
    watched = of("watchlist").withColumn("_status", F.coalesce("watchlist_status", F.lit("*any*"))).join(entries, "_status").select("rule_id", "target_id")
    return direct.unionByName(theme).unionByName(mandate).unionByName(watched).distinct()


def work_queue(evaluations: DataFrame, responses: DataFrame, today: Column, state: str | None = None, mode: str | None = "live", limit: int = 200) -> DataFrame:
    """Evaluations with what was answered so far, the newest disclosure first.

    The disclosure's day is actual_disclosed_date, or without that column the field of the evidence's JSON; what is no date comes last.
    State: unhandled (fired, no answer), actionable (that, or deferred to a day that has come), deferred (to a later day), settled.
    """
    answered = responses.groupBy("evaluation_id").agg(F.count(F.lit(1)).alias("response_count"), F.max_by(F.struct("disposition", "next_review_on"), "response_id").alias("_last"))
    rows = evaluations if mode is None else evaluations.filter(F.col("mode") == mode)
    if "actual_disclosed_date" not in rows.columns:
        rows = rows.withColumn("actual_disclosed_date", F.get_json_object("evidence", "$.actual_disclosed_date").try_cast("date"))
    rows = rows.join(answered, "evaluation_id", "left")
    rows = rows.withColumns({"response_count": F.coalesce("response_count", F.lit(0)).cast("long"), "latest_response_disposition": F.col("_last.disposition"), "next_review_on": F.col("_last.next_review_on")}).drop("_last")
    fired, last, due = F.col("status") == "fired", F.col("latest_response_disposition"), F.col("next_review_on") <= today
    states = {
        "unhandled": F.col("response_count") == 0,
        "actionable": (F.col("response_count") == 0) | ((last == "deferred") & due),
        "deferred": (last == "deferred") & ~due,
        "settled": last.isin("accepted", "overridden"),
    }
    if state is not None:
        if state not in states:
            raise ValueError(f"unknown state {state}; there are {', '.join(states)}")
        rows = rows.filter(fired & states[state])
    return rows.orderBy(F.col("actual_disclosed_date").desc_nulls_last(), F.desc("evaluation_id")).limit(limit)


def current_versions(versions: DataFrame, key: str) -> DataFrame:
    """The highest version of each."""
    return pick_first(versions, [key], [F.desc("version_no")])


def add_version(versions: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """Appends changed rows as the next version of each; earlier versions stay as they are."""
    last = versions.groupBy(key).agg(F.max("version_no").alias("_last"))
    fresh = changed.drop("version_no").join(last, key, "left").withColumn("version_no", (F.coalesce("_last", F.lit(0)) + 1).cast(versions.schema["version_no"].dataType))
    return versions.unionByName(fresh.select(*versions.columns))


def set_enabled(rules: DataFrame, ids: DataFrame, enabled: bool) -> DataFrame:
    """The rules with those named switched on or off."""
    named = ids.select("rule_id").distinct().withColumn("_named", F.lit(True))
    return rules.join(named, "rule_id", "left").withColumn("enabled", F.when(F.col("_named"), F.lit(enabled)).otherwise(F.col("enabled"))).drop("_named")


def delete_rules(tables: dict[str, DataFrame], ids: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Each table without the named rules' rows, and how many rows of each that takes."""
    named = ids.select("rule_id").distinct()
    counts = [t.join(named, "rule_id", "left_semi").agg(F.count(F.lit(1)).alias("deleted")).select(F.lit(n).alias("table"), "deleted") for n, t in tables.items()]
    total = counts[0]
    for c in counts[1:]:
        total = total.unionByName(c)
    return {n: t.join(named, "rule_id", "left_anti") for n, t in tables.items()}, total


def scope_labels(assignments: DataFrame, targets: DataFrame, mandates: DataFrame, themes: DataFrame, everything: str = "watchlist") -> DataFrame:
    """Adds scope_label: the name of the target, mandate or theme that an assignment is for, or the watchlist and the status it is limited to.

    assignments: scope_type, scope_id, watchlist_status. The other tables: an id and a name each; they are one row for each thing people keep.
    """
    names = {"target": (targets, "target_id", "target_name"), "mandate": (mandates, "mandate_id", "mandate_name"), "theme": (themes, "theme_id", "theme_name")}
    rows, label = assignments, F.when(F.col("scope_type") == "watchlist", F.concat_ws(": ", F.lit(everything), "watchlist_status"))
    for kind, (table, key, name) in names.items():
        rows = rows.join(table.select(F.col(key).alias(f"_{kind}"), F.col(name).alias(f"_{kind}_name")), (F.col("scope_type") == kind) & (F.col("scope_id") == F.col(f"_{kind}")), "left")
        label = label.when(F.col("scope_type") == kind, F.col(f"_{kind}_name"))
    return rows.withColumn("scope_label", label).select(*assignments.columns, "scope_label")


def rule_violations(rules: DataFrame) -> DataFrame:
    """(rule_id, violation) of conditions and scopes that say what they must not.

    rules: rule_id, position, comparison_type, operator, threshold_value, target_id, theme_id, mandate_id, and scope_type where there are
    watchlist rules, which name none of the three.
    """
    crossing = F.col("operator").startswith("crosses_")
    scopes = sum(F.col(c).isNotNull().cast("int") for c in ("target_id", "theme_id", "mandate_id"))
    wanted = F.when(F.col("scope_type") == "watchlist", 0).otherwise(1) if "scope_type" in rules.columns else F.lit(1)
    rules = rules.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("rule_id")))
    found = F.array(
        F.when(~F.col("operator").isin(*OPERATORS), "operator_unknown"),
        F.when((F.col("comparison_type") == "sign_transition") & ~crossing, "sign_needs_crossing"),
        F.when((F.col("comparison_type") != "sign_transition") & crossing, "crossing_needs_sign"),
        F.when(crossing & F.col("threshold_value").isNotNull(), "crossing_takes_no_threshold"),
        F.when(~crossing & F.col("threshold_value").isNull(), "threshold_missing"),
        F.when(scopes != wanted, "one_scope_needed"),
        F.when(F.col("_n") > 20, "too_many_conditions"),
    )
    return rules.withColumn("violation", F.explode(F.filter(found, lambda x: x.isNotNull()))).select("rule_id", "violation").distinct()


def response_violations(responses: DataFrame) -> DataFrame:
    """(response_id, violation): an override needs a decision, a deferral a day of review."""
    found = F.array(
        F.when(~F.col("disposition").isin("accepted", "overridden", "deferred"), "disposition_unknown"),
        F.when((F.col("disposition") == "overridden") & F.col("decision").isNull(), "decision_missing"),
        F.when((F.col("disposition") == "deferred") & F.col("next_review_on").isNull(), "review_date_missing"),
    )
    return responses.withColumn("violation", F.explode(F.filter(found, lambda x: x.isNotNull()))).select("response_id", "violation")


def explain_nothing(facts: DataFrame, as_of: Column, created: Column, mode: str = "live") -> DataFrame:
    """Why a rule gave no events: no_data, not_yet_public, only_before_registration (live rules only), or has_events; one scan."""
    public = F.col("available_on") <= as_of
    later = public & (F.col("actual_disclosed_date") > tokyo_date(created))
    counts = facts.agg(F.count(F.lit(1)).alias("n_facts"), F.count_if(public).alias("n_public"), F.count_if(later).alias("n_live"))
    answer = F.when(F.col("n_facts") == 0, "no_data").when(F.col("n_public") == 0, "not_yet_public").when(F.lit(mode == "live") & (F.col("n_live") == 0), "only_before_registration").otherwise("has_events")
    return counts.withColumn("explanation", answer)


def scopes_in_force(assignments: DataFrame, members: DataFrame, mandates: DataFrame, watchlist: DataFrame) -> DataFrame:
    """(rule_id, target_id, valid_from, valid_until): when each target is in each rule's scope, half-open; null: without an end.

    Inputs as for expand_scopes. Targets and watchlist entries hold on all days; a mandate's assignment holds while its version does.
    """
    always = {"valid_from": F.lit("0001-01-01").cast("date"), "valid_until": F.lit(None).cast("date")}
    of = lambda kind: assignments.filter(F.col("scope_type") == kind)
    columns = ["rule_id", "target_id", "valid_from", "valid_until"]
    direct = of("target").withColumn("target_id", F.col("scope_id")).withColumns(always)
    theme = of("theme").join(members, F.col("scope_id") == F.col("theme_id")).withColumn("valid_until", F.col("valid_to"))
    known = (F.col("status") == "active") & F.col("effective_from").isNotNull() & F.col("version_from").isNotNull()
    both = {"valid_from": F.greatest("effective_from", "version_from"), "valid_until": F.least("effective_until", "version_until")}
    mandate = of("mandate").join(mandates.filter(known), F.col("scope_id") == F.col("mandate_id")).withColumns(both)
    entries = watchlist.select("target_id", F.explode(F.array("status", F.lit("*any*"))).alias("_status"))
    watched = of("watchlist").withColumn("_status", F.coalesce("watchlist_status", F.lit("*any*"))).join(entries, "_status").withColumns(always)
    every = direct.select(*columns).unionByName(theme.select(*columns)).unionByName(mandate.select(*columns)).unionByName(watched.select(*columns))
    return every.filter(F.col("valid_from").isNotNull() & (F.col("valid_until").isNull() | (F.col("valid_from") < F.col("valid_until"))))


def in_scope_on_their_day(events: DataFrame, scopes: DataFrame, day: str, keys: Sequence[str] = ("rule_id", "target_id")) -> DataFrame:
    """The events that were in scope on their own day, each once however many intervals hold it. scopes: keys, valid_from, valid_until.

    A sweep instead of a join: an interval opens on one day and closes on another, and a running count over the days of a key says
    how many are open. So the work is linear in events and intervals, and years of a key are told apart (see scan.running). Events
    without a day or a key are in no scope.
    """
    key = F.struct(*keys)
    has = F.lit(True)
    for k in keys:
        has = has & F.col(k).isNotNull()
    opened = scopes.filter(has).select(key.alias("_key"), F.col("valid_from").alias("_day"), F.lit(1).alias("_open"))
    closed = scopes.filter(has & F.col("valid_until").isNotNull()).select(key.alias("_key"), F.col("valid_until").alias("_day"), F.lit(-1).alias("_open"))
    marks = opened.unionByName(closed).groupBy("_key", "_day").agg(F.sum("_open").alias("_open")).withColumns({"_side": F.lit(0), "_event": F.lit(None)})
    rows = events.filter(has & F.col(day).isNotNull()).select(key.alias("_key"), F.col(day).cast("date").alias("_day"), F.lit(0).cast("long").alias("_open"), F.lit(1).alias("_side"), F.struct(*events.columns).alias("_event"))
    both = rows.unionByName(marks).withColumn("_part", scan.year_of(F.col("_day")))
    found = scan.running(both, "_key", "_part", [F.col("_day"), F.col("_side")], {"_n": ("sum", F.col("_open"))})
    return found.filter((F.col("_side") == 1) & (F.col("_n") > 0)).select("_event.*")
