"""Securities, themes, mandates and jobs: the tables that people keep, as DataFrames. Versions are appended, never changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import pick_first, valid_on


def search_securities(master: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """Securities with the text in one of their names or codes, whatever its case; exact codes first, then by name."""
    if not 1 <= limit <= 50:
        raise ValueError("limit must be between 1 and 50")
    wanted = text.lower()
    fields = ("security_key", "target_key", "company_name", "company_name_english")
    met = F.lit(False)
    for c in fields:
        met = met | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(wanted))
    exact = F.coalesce((F.lower("security_key") == wanted) | (F.lower("target_key") == wanted), F.lit(False))
    return master.filter(met).orderBy(F.when(exact, 0).otherwise(1), F.col("company_name").asc_nulls_last(), "security_key").limit(limit)


def valid_identifiers(identifiers: DataFrame, targets: DataFrame, assignments: DataFrame, day: Column) -> DataFrame:
    """Primary codes valid on a day (both ends included) of targets that are monitored or actively assigned."""
    watched = targets.filter("monitored").select("target_id").union(assignments.filter((F.col("status") == "active") & F.col("effective_until").isNull()).select("target_id")).distinct()
    rows = identifiers.filter(F.col("is_primary") & valid_on(day, "valid_from", "valid_to", inclusive_end=True))
    return pick_first(rows.join(watched, "target_id", "left_semi"), ["target_id"], [F.desc("valid_from"), F.col("code")])


def lacking_identifiers(targets: DataFrame, identifiers: DataFrame, day: Column) -> DataFrame:
    """Targets without a code valid on a day."""
    return targets.join(identifiers.filter(valid_on(day, "valid_from", "valid_to", inclusive_end=True)).select("target_id"), "target_id", "left_anti")


def membership_changes(current: DataFrame, incoming: DataFrame, mode: str) -> DataFrame:
    """(code, change): added, removed (only when replacing) or unchanged; one full join of two key sets."""
    if mode not in ("append", "replace"):
        raise ValueError("mode must be append or replace")
    a, b = current.select("code").distinct().withColumn("_a", F.lit(True)), incoming.select("code").distinct().withColumn("_b", F.lit(True))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNotNull(), "unchanged").when(F.lit(mode == "replace"), "removed")
    return a.join(b, "code", "full_outer").select("code", change.alias("change")).filter(F.col("change").isNotNull())


def apply_membership(members: DataFrame, changes: DataFrame, theme_id: int, day: Column) -> DataFrame:
    """The validity table after the changes: removed members end on the day, added ones begin on it. members: theme_id, code, valid_from, valid_to."""
    open_ = (F.col("theme_id") == theme_id) & F.col("valid_to").isNull()
    gone = changes.filter("change = 'removed'").select("code").withColumn("_gone", F.lit(True))
    closed = members.join(gone, "code", "left").withColumn("valid_to", F.when(open_ & F.col("_gone"), day).otherwise(F.col("valid_to"))).select(*members.columns)
    fresh = changes.filter("change = 'added'").select(F.lit(theme_id).cast(members.schema["theme_id"].dataType).alias("theme_id"), "code", day.alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    return closed.unionByName(fresh.select(*members.columns))


def import_once(imports: DataFrame, theme_id: int, sha256: str) -> bool:
    """Whether a file of that content is new to the theme."""
    return imports.filter((F.col("theme_id") == theme_id) & (F.col("sha256") == sha256)).isEmpty()


def same_name(a: Column, b: Column) -> Column:
    """Whether two names differ in nothing but case and outer spaces."""
    return F.lower(F.trim(a)) == F.lower(F.trim(b))


def name_clashes(themes: DataFrame) -> DataFrame:
    """Active themes whose name another active theme has too. themes: theme_id, theme_name, is_active."""
    named = themes.filter("is_active").withColumn("_name", F.lower(F.trim("theme_name")))
    twice = named.groupBy("_name").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1 and _name is not null")
    return named.join(twice, "_name").drop("_name", "_n")


def with_ids(rows: DataFrame, targets: DataFrame, key: str = "security_key") -> DataFrame:
    """Rows with the id and the name that the kept tables have for them; those unknown there keep nulls. targets: key, target_id, target_name."""
    return rows.join(targets.select(key, "target_id", "target_name"), key, "left")


def theme_summary(themes: DataFrame, members: DataFrame, day: Column) -> DataFrame:
    """Themes with the number of their members on a day; empty ones have 0."""
    counted = members.filter(valid_on(day, "valid_from", "valid_to")).groupBy("theme_id").agg(F.count_distinct("target_id").alias("n"))
    return themes.join(counted, "theme_id", "left").withColumn("n_members", F.coalesce("n", F.lit(0)).cast("long")).drop("n")


def mandate_rollup(mandates: DataFrame, versions: DataFrame, assignments: DataFrame, total_budget: Column) -> DataFrame:
    """Current mandates with their budget and what of their weight is assigned.

    Budgets are decimals of two places; without a total or a weight there is none. Assignments are summed before the join.
    """
    current = versions.filter(F.col("effective_until").isNull())
    given = assignments.filter(F.col("effective_until").isNull() & F.col("status").isin("draft", "active")).groupBy("mandate_version_id").agg(F.sum("target_weight").alias("_w"))
    rows = mandates.join(current, "mandate_id").join(given, "mandate_version_id", "left")
    weight = F.coalesce(F.col("_w").cast("double"), F.lit(0.0))
    budget = (total_budget.cast("decimal(20,2)") * F.col("allocation_weight").cast("decimal(12,8)")).cast("decimal(20,2)")
    return rows.withColumns({"budget_amount": budget, "allocated_weight": weight, "unallocated_weight": F.greatest(F.lit(0.0), 1 - weight)}).drop("_w")


def assignment_amounts(versions: DataFrame, assignments: DataFrame, total_budget: Column) -> DataFrame:
    """Open assignments with their amounts, the heaviest first."""
    amount = (total_budget.cast("decimal(20,2)") * F.col("allocation_weight").cast("decimal(12,8)") * F.col("target_weight").cast("decimal(12,8)")).cast("decimal(20,2)")
    rows = assignments.filter(F.col("effective_until").isNull()).join(versions.select("mandate_version_id", "allocation_weight"), "mandate_version_id")
    return rows.withColumn("target_amount", amount).orderBy(F.col("target_weight").desc_nulls_last(), "target_id")


def overallocated(versions: DataFrame, assignments: DataFrame) -> DataFrame:
    """Versions whose open weights sum to more than one, and the sum of all versions' own weights if that does."""
    open_ = assignments.filter(F.col("effective_until").isNull() & F.col("status").isin("draft", "active"))
    each = open_.groupBy(F.col("mandate_version_id").cast("string").alias("scope")).agg(F.sum("target_weight").cast("double").alias("weight"))
    whole = versions.filter(F.col("effective_until").isNull()).agg(F.sum("allocation_weight").cast("double").alias("weight")).select(F.lit("all").alias("scope"), "weight")
    return each.unionByName(whole).filter(F.col("weight") > 1 + 1e-9)


def roll_version(versions: DataFrame, assignments: DataFrame, changed: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Ends the current version of each changed mandate, adds the next, and copies its open assignments to it.

    changed: mandate_id, mandate_version_id (new) and the new values. Gives versions and assignments.
    """
    named = changed.select("mandate_id", F.col("mandate_version_id").alias("_new"))
    was = versions.join(named, "mandate_id", "left")
    current = F.col("effective_until").isNull() & F.col("_new").isNotNull()
    closed = was.withColumn("effective_until", F.when(current, now).otherwise(F.col("effective_until"))).select(*versions.columns)
    last = versions.groupBy("mandate_id").agg(F.max("version_no").alias("_last"))
    fresh = changed.drop("version_no", "effective_from", "effective_until").join(last, "mandate_id", "left")
    fresh = fresh.withColumns({"version_no": (F.coalesce("_last", F.lit(0)) + 1).cast(versions.schema["version_no"].dataType), "effective_from": now, "effective_until": F.lit(None).cast(versions.schema["effective_until"].dataType)})
    moved = was.filter(current).select("mandate_version_id", "_new")
    open_ = assignments.join(moved, "mandate_version_id", "left")
    touched = F.col("_new").isNotNull() & F.col("effective_until").isNull()
    copies = open_.filter(touched).withColumn("mandate_version_id", F.col("_new")).select(*assignments.columns)
    ended = open_.withColumn("effective_until", F.when(touched, now).otherwise(F.col("effective_until"))).select(*assignments.columns)
    return closed.unionByName(fresh.select(*versions.columns)), ended.unionByName(copies)


def review_queue(mandates: DataFrame, versions: DataFrame) -> DataFrame:
    """Active mandates with a day of review, the next first."""
    rows = mandates.filter("status = 'active'").join(versions.filter("effective_until is null and next_review_at is not null"), "mandate_id")
    return rows.orderBy("next_review_at", "mandate_name")


def readiness(runs: DataFrame) -> DataFrame:
    """The latest run of each job, and whether it failed."""
    latest = pick_first(runs, ["job_type"], [F.desc("started_at"), F.desc("run_id")])
    return latest.withColumn("is_degraded", F.col("status") != "succeeded")


def upsert(target: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """target with the incoming rows in place of those of the same keys."""
    both = target.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    return pick_first(both, keys, [F.desc("_new")]).drop("_new")


def insert_only(target: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """target with those incoming rows whose keys it lacks."""
    fresh = incoming.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti")
    return target.unionByName(fresh.select(*target.columns))
