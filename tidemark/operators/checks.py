"""Data quality: each check gives its violations as rows; gate() raises on any."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scan


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with how often; keys with nulls count as equal."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def accepted(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Rows with a value outside the list; null is another check's matter."""
    return df.filter(~F.col(column).isin(list(values)))


def reference_not_before(fact: DataFrame) -> DataFrame:
    return fact.filter(F.col("reference_available_at") >= F.col("current_available_at"))


def ok_without_basis(fact: DataFrame) -> DataFrame:
    return fact.filter((F.col("comparison_status") == "ok") & (F.col("reporting_scope").isNull() | F.col("accounting_standard").isNull()))


def counts(checks: dict[str, DataFrame]) -> DataFrame:
    """(check_name, violations) of each; one row each even when there are none."""
    rows = [df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check_name"), "violations") for name, df in checks.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def gate(checks: dict[str, DataFrame]) -> None:
    failed = {r["check_name"]: r["violations"] for r in counts(checks).filter("violations > 0").collect()}
    if failed:
        raise ValueError(f"checks failed: {failed}")


def point_in_time_counts(disclosures: DataFrame, day: Column) -> DataFrame:
    """Violations of what a disclosure table promises, counted in one scan but for duplicates."""
    flags = {
        "missing_key": F.col("security_key").isNull() | F.col("disclosure_number").isNull(),
        "missing_available_at": F.col("disclosed_date").isNull(),
        "disclosed_in_future": F.col("disclosed_date") > day,
        "disclosed_before_period_end": (F.col("fiscal_period_type") == "FY") & (F.col("disclosed_date") <= F.col("period_end")),
    }
    one = disclosures.agg(*(F.count_if(c).alias(n) for n, c in flags.items()))
    rows = one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("check_name"), F.col(n).alias("violations")) for n in flags))).alias("r")).select("r.*")
    return rows.unionByName(counts({"duplicate_disclosure": unique(disclosures, ["security_key", "disclosure_number"])}))


def price_violations(prices: DataFrame) -> DataFrame:
    """(…, issue): what is wrong with each price row. All or some prices missing end the search for more."""
    o, h, low, c, v = (F.col(x) for x in ("open_price", "high_price", "low_price", "close_price", "volume"))
    missing = [x.isNull() for x in (o, h, low, c)]
    all_missing, some_missing = missing[0] & missing[1] & missing[2] & missing[3], missing[0] | missing[1] | missing[2] | missing[3]
    more = F.array(
        F.when((o <= 0) | (h <= 0) | (low <= 0) | (c <= 0), "price_not_positive"),
        F.when(h < F.greatest(o, c, low), "high_too_low"),
        F.when(low > F.least(o, c, h), "low_too_high"),
        F.when(v < 0, "volume_negative"),
    )
    issues = F.when(all_missing, F.array(F.lit("ohlc_missing"))).when(some_missing, F.array(F.lit("ohlc_partial"))).otherwise(F.filter(more, lambda x: x.isNotNull()))
    return prices.withColumn("issue", F.explode(issues))


def exact_median(rows: DataFrame, value: str, step: float, name: str = "median") -> DataFrame:
    """One row: the median of a column, the mean of the two middle values of an even number; null without values.

    Values are counted first, and the counts added up over ranges of `step`, so no task holds more than a range's different values.
    """
    counted = rows.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n")).withColumns({"_key": F.lit(0), "_part": F.floor(F.col("_v") / step)})
    summed = scan.running(counted, "_key", "_part", [F.col("_v")], {"_upto": ("sum", F.col("_n"))})
    whole = counted.agg(F.sum("_n").alias("_all"))
    # The two middle places, counted from 1; of an odd number they are one. A value holds the places after those before it, up to its own.
    places = F.array(F.floor((F.col("_all") + 1) / 2), F.floor((F.col("_all") + 2) / 2))
    held = F.size(F.filter(places, lambda p: (p <= F.col("_upto")) & (p > F.col("_upto") - F.col("_n"))))
    return summed.crossJoin(F.broadcast(whole)).select((F.col("_v") * held).alias("_w"), held.alias("_h")).filter("_h > 0").agg((F.sum("_w") / F.sum("_h")).alias(name))  # one row


def thin_days(prices: DataFrame, share: float = 0.5) -> DataFrame:
    """Days with fewer than a share of the median day's rows. The median is over one row for each day."""
    days = prices.groupBy("obs_date").agg(F.count(F.lit(1)).alias("n_rows"))
    middle = exact_median(days, "n_rows", 1_000, "median_rows")
    return days.crossJoin(F.broadcast(middle)).filter(F.col("n_rows") < F.col("median_rows") * share)


def summary(prices: DataFrame) -> DataFrame:
    return prices.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("security_key").alias("n_securities"), F.min("obs_date").alias("first_date"), F.max("obs_date").alias("last_date"))


def freshness(prices: DataFrame, disclosures: DataFrame, today: Column, stale_after: int = 2) -> DataFrame:
    """The newest day of each price source, of disclosures and, if prices say when they were built, of the build; its age, and whether that is stale."""
    by_source = prices.groupBy(F.concat(F.lit("price:"), "source_key").alias("dataset")).agg(F.max("obs_date").alias("latest"))
    filed = disclosures.agg(F.max("disclosed_date").alias("latest")).select(F.lit("disclosure").alias("dataset"), "latest")
    rows = by_source.unionByName(filed)
    if "built_at" in prices.columns:
        rows = rows.unionByName(prices.agg(F.max("built_at").cast("date").alias("latest")).select(F.lit("build").alias("dataset"), "latest"))
    rows = rows.withColumn("age_days", F.datediff(today, F.col("latest")).cast("long"))
    return rows.withColumn("is_stale", F.col("age_days") > stale_after)


def reconcile(ours: DataFrame, theirs: DataFrame, keys: Sequence[str], value: str, inputs: Sequence[str], threshold: float, relative: float = 1e-9, absolute: float = 1e-6) -> DataFrame:
    """Each key of two results with its class: only_ours, only_theirs, source_drift (inputs differ), formula_mismatch, trigger_mismatch or agree."""
    a = ours.select(*keys, F.struct(value, *inputs).alias("a"))
    b = theirs.select(*keys, F.struct(value, *inputs).alias("b"))
    rows = a.join(b, list(keys), "full_outer")
    x, y = F.col("a")[value], F.col("b")[value]
    close = lambda p, q: p.eqNullSafe(q) | F.coalesce(F.abs(p - q) <= F.greatest(F.lit(absolute), relative * F.greatest(F.abs(p), F.abs(q))), F.lit(False))
    same = F.lit(True)
    for c in inputs:
        same = same & F.col("a")[c].eqNullSafe(F.col("b")[c])
    kind = (
        F.when(F.col("b").isNull(), "only_ours")
        .when(F.col("a").isNull(), "only_theirs")
        .when(~same, "source_drift")
        .when(~close(x, y), "formula_mismatch")
        .when(~(x <= threshold).eqNullSafe(y <= threshold), "trigger_mismatch")
        .otherwise("agree")
    )
    return rows.select(*keys, x.alias("our_value"), y.alias("their_value"), kind.alias("class"))


def near_threshold(rows: DataFrame, value: str, threshold: float, n: int = 20) -> DataFrame:
    """The n rows whose value is the nearest to a threshold."""
    return rows.filter(F.col(value).isNotNull()).orderBy(F.abs(F.col(value) - threshold), *rows.columns).limit(n)


def fingerprints(rows: DataFrame, part: Column) -> DataFrame:
    """(part, n_rows, sum, xor) of two hashes of each row by part: equal multisets of rows have equal ones, in any order.

    Hashes are of all columns by name, null apart from any value. Different parts agree by chance once in 2^128 only.
    """
    columns = sorted(rows.columns)
    whole = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    hashed = rows.select(part.cast("string").alias("part"), F.xxhash64(whole).alias("_a"), F.xxhash64(F.lit("second"), whole).alias("_b"))
    return hashed.groupBy("part").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("_a").cast("decimal(38,0)")).alias("sum"), F.bit_xor("_b").alias("xor"))


def differing_parts(a: DataFrame, b: DataFrame, part: Column) -> DataFrame:
    """The parts in which two datasets of the same columns differ."""
    x, y = fingerprints(a, part).withColumn("side", F.lit("a")), fingerprints(b, part).withColumn("side", F.lit("b"))
    both = x.unionByName(y).groupBy("part", "n_rows", "sum", "xor").agg(F.count(F.lit(1)).alias("_sides"))
    return both.filter("_sides = 1").select("part").distinct()


def dataset_differences(a: DataFrame, b: DataFrame, part: Column, buckets: int = 1 << 18) -> DataFrame:
    """(part, side, n, columns): the rows that one of two datasets has n times more often than the other, as multisets.

    Rows are dealt to buckets within their parts by a hash, and buckets are compared by their fingerprints first; rows are compared in
    buckets that differ only. No task holds more fingerprints than parts times `buckets`. No row means that both are equal.
    """
    columns = sorted(a.columns)
    bucket = F.pmod(F.xxhash64(F.lit("bucket"), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})), F.lit(buckets)).cast("int")
    where = F.concat_ws("/", part.cast("string"), bucket.cast("string"))  # of a null part it has no stroke
    wrong = differing_parts(a, b, where).withColumnRenamed("part", "_wrong")

    def of(rows: DataFrame, n: int) -> DataFrame:
        named = rows.select(where.alias("_where"), part.cast("string").alias("part"), *columns, F.lit(n).alias("_n"))
        return named.join(wrong, F.col("_where") == F.col("_wrong"), "left_semi").drop("_where")

    # Most rows that are left are different ones: they are dealt first, as counts before that would hold each of a file's rows.
    left = of(a, 1).unionByName(of(b, -1)).repartition("part", *columns).groupBy("part", *columns).agg(F.sum("_n").alias("_n")).filter("_n <> 0")
    return left.select("part", F.when(F.col("_n") > 0, "a").otherwise("b").alias("side"), F.abs("_n").alias("n"), *columns)
