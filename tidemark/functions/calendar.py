"""Day ranges that drive collection. Plain dates: they run on the driver."""

from __future__ import annotations

import calendar
import datetime as dt


def add_years(day: dt.date, years: int) -> dt.date:
    """The same day of another year; February 29 falls back to 28."""
    try:
        return day.replace(year=day.year + years)
    except ValueError:
        return day.replace(year=day.year + years, day=28)


def plan_window(today: dt.date, lag_days: int, years: int) -> tuple[dt.date, dt.date]:
    """First and last day that a plan with a delay and a depth of history offers."""
    end = today - dt.timedelta(days=lag_days)
    return add_years(end, -years), end


def clamp(start: dt.date, end: dt.date, window: tuple[dt.date, dt.date]) -> tuple[dt.date, dt.date] | None:
    start, end = max(start, window[0]), min(end, window[1])
    return (start, end) if start <= end else None


def weekdays(start: dt.date, end: dt.date) -> list[dt.date]:
    return [d for i in range((end - start).days + 1) if (d := start + dt.timedelta(days=i)).weekday() < 5]


def catch_up(last_done: dt.date | None, window: tuple[dt.date, dt.date]) -> list[dt.date]:
    """Weekdays after the last one done, within the window; all of it if none was done."""
    start = window[0] if last_done is None else max(window[0], last_done + dt.timedelta(days=1))
    return weekdays(start, window[1]) if start <= window[1] else []


def fetch_start(latest: dt.date | None, default: dt.date, overlap_days: int = 3) -> dt.date:
    """Where to fetch from: some days before the latest row, so that late corrections come in."""
    return default if latest is None else latest - dt.timedelta(days=overlap_days)


def add_months(day: dt.date, months: int) -> dt.date:
    """The same day some months on, the month's last day at most."""
    index = day.year * 12 + day.month - 1 + months
    year, month = index // 12, index % 12 + 1
    return dt.date(year, month, min(day.day, calendar.monthrange(year, month)[1]))
