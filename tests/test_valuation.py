import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import scan
from tidemark.functions.asof import asof_join
from tidemark.operators import valuation as v
from tests.helpers import day, disclosures, prices


def pbr(spark, quotes, facts):
    found = v.point_in_time_pbr(prices(spark, quotes), disclosures(spark, facts), ("jpx",)).orderBy("as_of_date").collect()
    return {r.as_of_date.day: r for r in found}


def quotes(*values, **more):
    return [{"obs_date": day(i), "close_price": x} | more for i, x in enumerate(values, 1)]


def test_visible_from_the_day_after(spark):
    got = pbr(spark, quotes(100.0, 90.0, 80.0), [{"disclosed_date": day(2), "bps": 100.0}])
    assert got[2].calculation_status == "financial_not_available" and got[2].pbr is None
    assert round(got[3].pbr, 6) == 0.8 and got[3].is_below_book_value


def test_book_value_moves_with_splits(spark):
    rows = quotes(100.0, 100.0) + [{"obs_date": day(3), "close_price": 60.0, "adjustment_factor": 0.5}]
    got = pbr(spark, rows, [{"disclosed_date": day(2), "bps": 100.0}])[3]
    assert (round(got.bps_adjustment_factor, 6), round(got.adjusted_bps, 6), round(got.pbr, 6), got.is_below_book_value) == (0.5, 50.0, 1.2, False)


def test_statuses(spark):
    one = {"disclosed_date": day(2), "bps": -10.0}
    assert pbr(spark, quotes(1.0, 1.0, 1.0), [one])[3].calculation_status == "non_positive_bps"
    assert pbr(spark, quotes(1.0, 1.0, 1.0), [one | {"bps": 1.0, "period_end": None}])[3].calculation_status == "financial_period_end_missing"
    early = pbr(spark, quotes(1.0, 1.0, 1.0), [one | {"bps": 1.0, "period_end": dt.date(2020, 1, 1)}])[3]
    assert early.calculation_status == "insufficient_factor_history"
    bad = quotes(1.0, 1.0) + [{"obs_date": day(3), "close_price": 1.0, "adjustment_factor": None}]
    assert pbr(spark, bad, [one | {"bps": 1.0}])[3].calculation_status == "invalid_adjustment_factor"
    assert pbr(spark, quotes(1.0, 1.0, 0.0), [one])[3].calculation_status == "invalid_raw_close"


def test_consolidated_first_on_one_day(spark):
    facts = [{"disclosed_date": day(2), "bps": 50.0, "reporting_scope": "non_consolidated", "disclosure_number": "9"}, {"disclosed_date": day(2), "bps": 100.0}]
    assert round(pbr(spark, quotes(1.0, 1.0, 80.0), facts)[3].pbr, 6) == 0.8


def naive_asof(left, right, inclusive):
    out = []
    for k, t in left:
        best = [(u, p) for kk, u, p in right if kk is not None and kk == k and t is not None and u is not None and (u <= t if inclusive else u < t)]
        out.append((k, t, max(best)[1] if best else None))
    return sorted(out, key=str)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    left=st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(0, 9))), max_size=12),
    right=st.dictionaries(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(0, 9))), st.integers(0, 99), max_size=12),
    inclusive=st.booleans(),
)
def test_asof_equals_brute_force(spark, left, right, inclusive):
    a = spark.createDataFrame(left, "k string, t long")
    rows = [(k, u, p) for (k, u), p in right.items()]
    b = spark.createDataFrame(rows, "k string, u long, p long")
    got = asof_join(a, b, "k", "t", "u", ["p"], inclusive, part=lambda t: F.coalesce(F.floor(t / 3), F.lit(-1))).collect()
    assert sorted(((r.k, r.t, r.p) for r in got), key=str) == naive_asof(left, rows, inclusive)


def test_later_disclosures_change_nothing_before_them(spark):
    facts = [{"disclosed_date": day(2), "bps": 100.0}]
    later = [*facts, {"disclosed_date": day(4), "bps": 1.0, "disclosure_number": "2"}]
    a, b = pbr(spark, quotes(1.0, 2.0, 3.0, 4.0, 5.0), facts), pbr(spark, quotes(1.0, 2.0, 3.0, 4.0, 5.0), later)
    assert [a[i].pbr for i in range(1, 5)] == [b[i].pbr for i in range(1, 5)] and a[5].pbr != b[5].pbr


def test_running_values_equal_one_window(spark):
    rows = spark.range(3_000).selectExpr("if(id % 10 = 0, concat('k', id % 7), 'hot') as k", "if(id % 97 = 0, null, id % 450) as t", "id as n", "if(id % 5 = 0, id, null) as v")
    rows = rows.withColumn("p", F.coalesce(F.floor(F.col("t") / 30), F.lit(-1)))
    order = [F.col("t"), F.col("n")]
    wanted = {"s": ("sum", F.col("n")), "m": ("min", F.when(F.col("n") % 3 == 0, F.col("n"))), "l": ("last", F.col("v"))}
    one = {"s": "sum(n)", "m": "min(if(n % 3 = 0, n, null))", "l": "last(v, true)"}
    window = "over (partition by k order by t nulls first, n rows between unbounded preceding and current row)"
    right = rows.select("n", *(F.expr(f"{e} {window}").alias(c) for c, e in one.items()))
    found = scan.running(rows, "k", "p", order, wanted).select("n", *one)
    assert sorted(map(str, found.collect())) == sorted(map(str, right.collect()))


def test_no_task_has_the_whole_past_of_a_hot_security(spark):
    """A security with 90 % of the rows: the largest group of any window is one of its years."""
    days = spark.sql("select explode(sequence(date'2001-01-01', date'2024-12-31')) as obs_date")
    hot = days.selectExpr("'hot' as security_key", "obs_date", "'jpx' as source_key", "100.0D as raw_close_price", "100.0D as close_price", "if(dayofyear(obs_date) = 100, 0.5D, 1.0D) as adjustment_factor")
    few = hot.filter("day(obs_date) = 7").withColumn("security_key", F.lit("cold")).union(hot.filter("day(obs_date) = 3").withColumn("security_key", F.lit("cool")))
    quotes_ = hot.union(few)
    facts = disclosures(spark, [{"security_key": k, "disclosed_date": dt.date(y, 5, 8), "period_end": dt.date(y, 3, 31), "bps": 50.0 + y, "disclosure_number": str(y)} for k in ("hot", "cold") for y in range(2002, 2025)])
    found = v.point_in_time_pbr(quotes_, facts, ("jpx",), by_year=True)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(security_key" in plan
    for line in (x for x in plan.splitlines() if " Window " in x):  # each over (security, part), or over the totals of parts
        assert "_part" in line or "_c_" in line or "disclosed_date" in line
    rows = found.filter("security_key = 'hot' and calculation_status = 'ok'").orderBy("as_of_date").collect()
    assert len(rows) == quotes_.filter("security_key = 'hot' and obs_date > date'2002-05-08'").count()
    for r in rows[::500]:
        y = r.as_of_date.year - (r.as_of_date <= dt.date(r.as_of_date.year, 5, 8))  # of the latest disclosure before
        splits = sum(dt.date(y, 3, 31) < dt.date(z, 1, 1) + dt.timedelta(days=99) <= r.as_of_date for z in range(2001, 2026))
        assert round(r.bps_adjustment_factor, 9) == 0.5**splits
    at_once = v.point_in_time_pbr(quotes_, facts, ("jpx",))
    exact = ["security_key", "as_of_date", "disclosure_number", "calculation_status", "is_below_book_value", F.round("pbr", 9).alias("pbr")]
    assert sorted(map(str, found.select(*exact).collect())) == sorted(map(str, at_once.select(*exact).collect()))


def test_hot_securities_are_scanned_by_year(spark, monkeypatch):
    quotes_ = prices(spark, quotes(1.0, 2.0))
    facts = disclosures(spark, [{"disclosed_date": day(1), "bps": 1.0}])
    plan = lambda: v.point_in_time_pbr(quotes_, facts, ("jpx",))._jdf.queryExecution().executedPlan().toString()
    assert "_cp" not in plan()
    monkeypatch.setattr(v, "HOT", 1)
    assert "_cp" in plan()


def test_asof_carries_only_what_is_read(spark):
    a = spark.range(9).select(F.col("id").alias("k"), F.col("id").alias("t"), F.expr("concat('wide', id)").alias("w"))
    b = spark.range(9).select(F.col("id").alias("k"), (F.col("id") - 1).alias("u"), F.col("id").alias("p"))
    found = asof_join(a, b, "k", "t", "u", ["p"], part=lambda t: F.lit(0))
    assert sorted(r.w for r in found.collect()) == [f"wide{i}" for i in range(9)]
    assert "wide" not in found.select("k", "t", "p")._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.k, r.p) for r in found.select("k", "p").collect()} == {(i, i) for i in range(9)}
