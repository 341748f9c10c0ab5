import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import forecasts as f
from tests.helpers import day, disclosures


def quarter(d, value, n="1", **more):
    return {"fiscal_period_type": "1Q", "disclosed_date": day(d), "forecast_operating_income": value, "disclosure_number": n, "disclosed_time": "15:00:00"} | more


def actual(d, value, n="90", **more):
    return {"fiscal_period_type": "FY", "disclosed_date": day(d), "operating_income": value, "revenue": 10_000, "disclosure_number": n} | more


def intervals(spark, rows):
    return f.point_in_time_forecast(disclosures(spark, rows))


def test_intervals(spark):
    found = intervals(spark, [quarter(1, 100), quarter(10, 250, "2"), quarter(20, 750, "3")])
    rows = found.orderBy("as_of_date").collect()
    assert [(r.as_of_date.day, r.superseded_at and r.superseded_at.day, r.forecast_seq) for r in rows] == [(2, 11, 1), (11, 21, 2), (21, None, 3)]
    assert [r.forecast_operating_income for r in f.forecast_at(found, F.lit(day(15))).collect()] == [250]


def test_same_day_and_next_year(spark):
    rows = [quarter(1, 100, "1", disclosed_time="09:00:00"), quarter(1, 300, "2")]
    assert [r.forecast_operating_income for r in intervals(spark, rows).collect()] == [300]
    annual = {"fiscal_period_type": "FY", "disclosed_date": day(3), "next_forecast_operating_income": 7, "forecast_operating_income": 1}
    (r,) = intervals(spark, [annual]).collect()
    assert (r.fiscal_year_end, r.forecast_operating_income) == (dt.date(2031, 12, 31), 7)


def accuracy(spark, rows):
    facts = disclosures(spark, rows)
    return f.forecast_accuracy(f.point_in_time_forecast(facts), facts).orderBy("forecast_seq").collect()


def test_accuracy(spark):
    (r,) = accuracy(spark, [quarter(1, 500), actual(20, 10), quarter(25, 10, "5")])
    assert (round(r.error_pct_of_revenue, 6), r.outcome, r.comparison_status, r.is_latest_forecast) == (-4.9, "miss", "ok", True)
    (r,) = accuracy(spark, [quarter(1, 500), actual(20, 600), actual(25, 400, "91")])
    assert r.actual_operating_income == 600
    (r,) = accuracy(spark, [quarter(1, 500), actual(20, 10, accounting_standard="IFRS")])
    assert r.comparison_status == "accounting_standard_mismatch" and r.error_pct_of_revenue is None
    (r,) = accuracy(spark, [quarter(1, 500), actual(20, 10, revenue=None)])
    assert r.comparison_status == "revenue_unavailable"


def test_revisions_and_latest_parts(spark):
    rows = disclosures(spark, [quarter(1, 100), quarter(2, None, "2"), quarter(3, 130, "3"), quarter(4, 120, "4")])
    found = f.revisions(rows, ["forecast_operating_income"]).orderBy("disclosed_date").collect()
    assert [r.forecast_operating_income_change for r in found] == [None, None, None, -10]
    parts = disclosures(spark, [actual(1, 5, "1"), quarter(9, 3, "2")])
    (r,) = f.latest_parts(parts, {"actual": ["operating_income"], "forecast": ["forecast_operating_income"], "dividend": ["annual_dividend_per_share"]}).collect()
    assert (r.actual.disclosure_number, r.forecast.disclosure_number, r.dividend) == ("1", "2", None)
    assert [r.disclosure_number for r in f.with_any(rows, ["forecast_operating_income"], 2).collect()] == ["4", "3"]


def test_later_forecasts_change_nothing_before_them(spark):
    rows = [quarter(1, 100), quarter(10, 250, "2")]
    before = f.forecast_at(intervals(spark, rows), F.lit(day(9))).collect()
    after = f.forecast_at(intervals(spark, [*rows, quarter(5, 999, "3", fiscal_year_end=dt.date(2027, 3, 31)), quarter(20, 750, "4")]), F.lit(day(9)))
    assert before == after.filter("fiscal_year_end = '2030-12-31'").collect()
    assert [r.forecast_operating_income for r in before] == [100]
