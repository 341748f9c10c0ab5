import datetime as dt

import pytest

from tidemark.operators import prices as p
from tests.helpers import day, prices


def returns(spark, rows):
    found = p.daily_return(p.preferred_price(prices(spark, rows))).orderBy("security_key", "obs_date").collect()
    return [(r.obs_date.day, None if r.daily_return is None else round(r.daily_return, 6)) for r in found]


def closes(*values):
    return [{"obs_date": day(i), "close_price": v} for i, v in enumerate(values, 1)]


def test_returns(spark):
    assert returns(spark, closes(100.0, 110.0)) == [(1, None), (2, 0.1)]
    assert returns(spark, closes(100.0, None, 121.0)) == [(1, None), (2, None), (3, None)]
    assert returns(spark, closes(0.0, 5.0)) == [(1, None), (2, None)]
    assert returns(spark, [{"obs_date": day(1), "close_price": 100.0}, {"obs_date": day(6), "close_price": 110.0}]) == [(1, None), (6, 0.1)]


def test_one_observation_a_day(spark):
    rows = [{"obs_date": day(1), "close_price": 999.0, "source_key": "another"}, {"obs_date": day(1), "close_price": 100.0}, {"obs_date": day(2), "close_price": 110.0, "source_key": "another"}]
    assert returns(spark, rows) == [(1, None), (2, 0.1)]
    assert returns(spark, [{"obs_date": day(1), "close_price": 1.0, "price_basis": "unadjusted"}]) == []


def test_securities_of_one_ticker_do_not_mix(spark):
    rows = [{"obs_date": day(1), "close_price": 100.0}, {"obs_date": day(2), "close_price": 50.0, "jpx_code": "72031"}]
    assert returns(spark, rows) == [(1, None), (2, None)]


def test_history(spark):
    found = p.price_history(prices(spark, closes(100.0, 110.0, 99.0)), "41230", day(3), 30).collect()
    assert [None if r.daily_return is None else round(r.daily_return, 6) for r in found] == [None, 0.1, -0.1]
    assert [round(r.cumulative_return, 6) for r in found] == [0.0, 0.1, -0.01]
    late = p.price_history(prices(spark, closes(100.0, 110.0, 99.0)), "41230", day(3), 1).collect()
    assert [round(r.daily_return, 6) for r in late] == [0.1, -0.1]
    with pytest.raises(ValueError):
        p.price_history(prices(spark, closes(1.0)), "41230", dt.date(2026, 1, 1), 0)


def test_latest(spark):
    rows = prices(spark, closes(1.0, 2.0))
    assert [(r.security_key, r.close_price) for r in p.latest_prices(rows, ["41230", "none"]).collect()] == [("41230", 2.0)]
    assert p.latest_prices(rows, []).count() == 0
