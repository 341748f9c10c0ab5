import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidemark.operators import checks, search

MASTER = "security_key string, target_key string, company_name string, company_name_english string"


def brute(master, texts, limit):
    out = []
    for i, text in texts:
        if text is None:
            continue
        t = text.lower()
        met = [m for m in master if m[0] is not None and any(t in (f or "").lower() for f in m)]
        met.sort(key=lambda m: (t not in [c.lower() for c in m[:2] if c is not None], m[2] is None, m[2] or "", m[0]))
        out += [(i, rank, m[0], m[2]) for rank, m in enumerate(met[:limit], 1)]
    return sorted(out)


@pytest.mark.parametrize("limit", [3, 50])
def test_search_equals_a_scan(spark, limit):
    rng = random.Random(limit)
    word = lambda: "".join(rng.choices("aBcé%_ ", k=rng.randint(0, 9)))
    master = [(f"{i:04d}0", rng.choice([None, f"{i:04d}.T"]), rng.choice([None, word()]), word()) for i in range(150)] + [(None, "x", "abc", "abc")]
    texts = [(i, rng.choice([word(), word()[:2], f"00{i % 60:02d}", f"{i % 30:04d}.t", "", "%", "a_"])) for i in range(120)] + [(900, None), (901, "zzzzzz"), (902, "000")]
    df = spark.createDataFrame(master, MASTER)
    found = search.search(df, search.postings(df), spark.createDataFrame(texts, "search_id long, text string"), limit)
    assert sorted(tuple(r) for r in found.collect()) == brute(master, texts, limit)


def test_a_search_reads_no_whole_table(spark):
    df = spark.createDataFrame([(str(i), None, "name", None) for i in range(50)], MASTER)
    plan = search.search(df, search.postings(df), spark.createDataFrame([(1, "name")], "search_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_a_common_text_ranks_no_more_than_its_first_names(spark):
    """Many searches for few texts that every name holds: no step makes a row for each search and security."""
    master = [(f"{i:05d}", f"n{i}" if i % 3 else None, f"name {i % 40:02d}" if i % 7 else None, "Name") for i in range(2_000)]
    texts = [(i, ("name", "NAM", "me 0", "n12")[i % 4]) for i in range(400)]
    df = spark.createDataFrame(master, MASTER)
    found = search.search(df, search.postings(df), spark.createDataFrame(texts, "search_id long, text string"), 5)
    assert sorted(tuple(r) for r in found.collect()) == brute(master, texts, 5)
    largest, todo = 0, [found._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan" or node.nodeName().endswith("QueryStage"):
            todo.append(node.executedPlan() if node.nodeName() == "AdaptiveSparkPlan" else node.plan())
        todo += [node.children().apply(i) for i in range(node.children().size())]
        rows = node.metrics().get("numOutputRows")
        largest = max(largest, rows.get().value() if rows.isDefined() else 0)
    assert 0 < largest < 40 * 2_000


@pytest.mark.parametrize("values", [[1], [1, 2], [5, 1, 1], [1, 1, 9, 9], [-3.5, 2.25, 2.25, 1e6, 7, 7], [None], [None, 4, 8], list(range(1000)), [2, 2, 2, 2]])
def test_median_is_exact(spark, values):
    known = [float(v) for v in values if v is not None]
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double")
    assert checks.exact_median(df, "v", 7.0).collect()[0][0] == (statistics.median(known) if known else None)


def test_differences_are_those_of_multisets(spark):
    rows = [(y, k, v) for y in (2020, 2021, None) for k in "abc" for v in (1, None)] * 2
    kinds = "y int, k string, v int"
    a, b = rows + [(2020, "a", 1), (2022, "n", 5)], [*rows, (2021, None, 3), (2021, None, 3)]
    random.Random(1).shuffle(b)
    left, right = spark.createDataFrame(a, kinds).repartition(3), spark.createDataFrame(b, kinds)
    found = checks.dataset_differences(left, right, F.col("y")).collect()
    assert sorted((r.part, r.side, r.n, r.k or "-") for r in found) == [("2020", "a", 1, "a"), ("2021", "b", 2, "-"), ("2022", "a", 1, "n")]
    assert sorted(r.part for r in checks.differing_parts(left, right, F.col("y")).collect()) == ["2020", "2021", "2022"]
    assert checks.dataset_differences(right, spark.createDataFrame(b[::-1], kinds), F.col("y")).count() == 0


def test_only_buckets_that_differ_are_compared(spark):
    """One row of a part is another: the rest of the part is not dealt by its rows."""
    a = spark.range(20_000).select("id", F.lit(1).alias("v"), F.lit(None).cast("string").alias("w")).repartition(4)
    b = a.withColumn("v", F.when(F.col("id") == 77, 2).otherwise(F.col("v")))
    for buckets in (1, 1 << 18):
        found = checks.dataset_differences(a, b, F.lit("all"), buckets)
        assert sorted((r.side, r.n, r.id, r.v) for r in found.collect()) == [("a", 1, 77, 1), ("b", 1, 77, 2)]
    plan, dealt = [found._jdf.queryExecution().executedPlan()], []
    while plan:
        node = plan.pop()
        if node.nodeName() == "AdaptiveSparkPlan" or node.nodeName().endswith("QueryStage"):
            plan.append(node.executedPlan() if node.nodeName() == "AdaptiveSparkPlan" else node.plan())
        plan += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Exchange" and "REPARTITION" in node.simpleString(1000):
            dealt.append(node.metrics().get("shuffleRecordsWritten").get().value())
    assert dealt and min(dealt) < 100


@pytest.mark.parametrize("seed", range(3))
def test_any_split_of_the_runs_builds_the_same(spark, seed):
    from tidemark.operators import ingest

    rng = random.Random(seed)
    rows = spark.createDataFrame([(rng.randint(0, 20), i, rng.random()) for i in range(300)], "k int, ingestion_run_id long, v double")
    built, cuts = rows.filter("false"), sorted(rng.sample(range(300), 3)) + [300]
    for cut in cuts:
        built = ingest.incremental(built, rows.filter(F.col("ingestion_run_id") < cut), ["k"])
    assert checks.dataset_differences(built, ingest.keep_last(rows, ["k"]), F.col("k") % 4).count() == 0
