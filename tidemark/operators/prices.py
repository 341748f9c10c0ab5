"""Prices: one observation a day, returns, history and the latest."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.columns import pick_first

PREFERRED = "jpx"


def preferred_price(observations: DataFrame, preferred: str = PREFERRED, where: Column | None = None, by_day: bool = False) -> DataFrame:
    """One adjusted observation for each security and day: that of the preferred source, else of the first source by name.

    where: narrows the scan before the window, as a filter behind it would not be pushed through unless it is on the key.
    by_day: deals rows by security and day, for what follows in running scans; a security's past is then no task's alone.
    """
    rows = observations.filter(F.col("price_basis") == "adjusted")
    rows = rows.filter(where) if where is not None else rows
    # Dealt by security at once: the windows of all that follows are by security too, so this is their only shuffle.
    rows = rows if by_day else rows.repartition("security_key")
    return pick_first(rows, ["security_key", "obs_date"], [F.when(F.col("source_key") == preferred, 0).otherwise(1), F.col("source_key").asc_nulls_last()])


def daily_return(prices: DataFrame) -> DataFrame:
    """Adds prev_close_price, prev_obs_date and daily_return against the previous observation, whatever its day."""
    by = W.partitionBy("security_key").orderBy("obs_date")
    previous = F.lag("close_price").over(by)
    rows = prices.withColumns({"prev_close_price": previous, "prev_obs_date": F.lag("obs_date").over(by)})
    change = F.when(F.col("prev_close_price") != 0, F.col("close_price") / F.col("prev_close_price") - 1)
    return rows.withColumn("daily_return", change)


def of_securities(observations: DataFrame, keys: Sequence[str]) -> Column:
    """Rows of these securities, in a form that reaches the Parquet scan where the stored columns are there: the key itself is derived."""
    keys = list(keys)
    if {"jpx_code", "target_key"} <= set(observations.columns):
        return F.col("jpx_code").isin(keys) | (F.col("jpx_code").isNull() & F.col("target_key").isin(keys))
    return F.col("security_key").isin(keys)


def price_history(observations: DataFrame, security_key: str | None, today: dt.date, days: int, preferred: str = PREFERRED) -> DataFrame:
    """The last `days` days of one security, or of each (None), with daily and cumulative returns, oldest first.

    A security is filtered in the scan; the first daily return in range refers to the day before it. Cumulative
    returns refer to the first close in range; rows before it have none.
    """
    if not 1 <= days <= 3650:
        raise ValueError("days must be between 1 and 3650")
    rows = daily_return(preferred_price(observations, preferred, None if security_key is None else of_securities(observations, [security_key])))
    rows = rows.filter(F.col("obs_date") >= F.lit(today - dt.timedelta(days=days)))
    base = F.first("close_price", ignorenulls=True).over(W.partitionBy("security_key").orderBy("obs_date"))
    return rows.withColumn("_base", base).withColumn("cumulative_return", F.when(F.col("_base") != 0, F.col("close_price") / F.col("_base") - 1)).drop("_base").orderBy("obs_date", "security_key")


def latest_prices(observations: DataFrame, keys: Sequence[str], preferred: str = PREFERRED) -> DataFrame:
    """The latest row of each security of a list; unknown ones give none, and an empty list gives no rows."""
    rows = preferred_price(observations, preferred, of_securities(observations, keys))
    return pick_first(rows, ["security_key"], [F.desc("obs_date")])
