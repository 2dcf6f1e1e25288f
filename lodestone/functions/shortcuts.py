"""Named date ranges relative to today."""

from __future__ import annotations

import datetime as dt
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import require

#: Fixed values. A bound is (anchor, months, days): the start of today's day, week
#: (Monday), month, quarter or year, moved by months and then by days. Ranges include
#: their start and exclude their end.
RANGES = {
    "today": (("today", 0, 0), ("today", 0, 1)),
    "yesterday": (("today", 0, -1), ("today", 0, 0)),
    "tomorrow": (("today", 0, 1), ("today", 0, 2)),
    "this_week": (("week", 0, 0), ("week", 0, 7)),
    "last_week": (("week", 0, -7), ("week", 0, 0)),
    "next_week": (("week", 0, 7), ("week", 0, 14)),
    "this_month": (("month", 0, 0), ("month", 1, 0)),
    "last_month": (("month", -1, 0), ("month", 0, 0)),
    "next_month": (("month", 1, 0), ("month", 2, 0)),
    "mtd": (("month", 0, 0), ("today", 0, 1)),
    "this_quarter": (("quarter", 0, 0), ("quarter", 3, 0)),
    "last_quarter": (("quarter", -3, 0), ("quarter", 0, 0)),
    "next_quarter": (("quarter", 3, 0), ("quarter", 6, 0)),
    "qtd": (("quarter", 0, 0), ("today", 0, 1)),
    "this_year": (("year", 0, 0), ("year", 12, 0)),
    "last_year": (("year", -12, 0), ("year", 0, 0)),
    "next_year": (("year", 12, 0), ("year", 24, 0)),
    "ytd": (("year", 0, 0), ("today", 0, 1)),
    "last_7_days": (("today", 0, -6), ("today", 0, 1)),
    "last_14_days": (("today", 0, -13), ("today", 0, 1)),
    "last_30_days": (("today", 0, -29), ("today", 0, 1)),
    "last_90_days": (("today", 0, -89), ("today", 0, 1)),
    "last_3_months": (("month", -3, 0), ("today", 0, 1)),
    "this_and_last_month": (("month", -1, 0), ("month", 1, 0)),
    "this_and_last_year": (("year", -12, 0), ("year", 12, 0)),
    "next_7_days": (("today", 0, 1), ("today", 0, 8)),
    "next_30_days": (("today", 0, 1), ("today", 0, 31)),
}
#: Month and day of every year, from the anchor through today.
RECURRING = {"mtd_all_years": "month", "qtd_all_years": "quarter", "ytd_all_years": "year"}
SHORTCUTS = (*RANGES, *RECURRING)


def terms(shortcut: str) -> tuple[tuple[str, int, int], tuple[str, int, int]]:
    require(shortcut in SHORTCUTS, "invalid_query", "no date shortcut has this name", value=shortcut)
    return RANGES.get(shortcut) or ((RECURRING[shortcut], 0, 0), ("today", 0, 0))


def parse_day(text: str) -> dt.date:
    try:
        return dt.date.fromisoformat(text)
    except (TypeError, ValueError):
        require(False, "invalid_query", "today: expected yyyy-mm-dd", value=str(text))
        raise


def _day(term: tuple[str, int, int], today: dt.date) -> dt.date:
    anchor, months, days = term
    if anchor == "week":
        start = today - dt.timedelta(days=today.weekday())
    elif anchor == "month":
        start = today.replace(day=1)
    elif anchor == "quarter":
        start = today.replace(month=today.month - (today.month - 1) % 3, day=1)
    elif anchor == "year":
        start = today.replace(month=1, day=1)
    else:
        start = today
    if months:
        total = start.year * 12 + start.month - 1 + months
        start = start.replace(year=total // 12, month=total % 12 + 1)
    return start + dt.timedelta(days=days)


def bounds(shortcut: str, today: str) -> tuple[str, str]:
    """ISO dates of a range, or MM-DD of a recurring shortcut (end included)."""
    start, end = (_day(t, parse_day(today)).isoformat() for t in terms(shortcut))
    return (start[5:], end[5:]) if shortcut in RECURRING else (start, end)


def day_start_instant(day: str, timezone: str) -> dt.datetime:
    """The instant at which a day begins in a zone: its first hour that exists."""
    zone, date = ZoneInfo(timezone), parse_day(day)
    at = dt.datetime(date.year, date.month, date.day, tzinfo=zone)
    instant = at.astimezone(dt.timezone.utc)
    while instant.astimezone(zone).date() < date:  # midnight doesn't exist that day
        instant += dt.timedelta(minutes=15)
    return instant


def _column(term: tuple[str, int, int]) -> Column:
    anchor, months, days = term
    day = F.current_date()
    if anchor != "today":
        day = F.trunc(day, {"week": "week", "month": "month", "quarter": "quarter", "year": "year"}[anchor])
    if months:
        day = F.add_months(day, months)
    return F.date_add(day, days) if days else day


def predicate(value: Column, shortcut: str, today: str | None, timestamp_type: str | None = None) -> Column:
    """Whether a date or timestamp column falls into a shortcut."""
    month_day = F.date_format(value, "MM-dd")
    if today is not None:
        low, high = bounds(shortcut, today)
        if shortcut in RECURRING:
            return (month_day >= low) & (month_day <= high)
        as_day = lambda d: F.lit(parse_day(d))
        return (value >= as_day(low)) & (value < as_day(high))
    start, end = map(_column, terms(shortcut))
    if shortcut in RECURRING:
        return (month_day >= F.date_format(start, "MM-dd")) & (month_day <= F.date_format(end, "MM-dd"))
    return (value >= start) & (value < end)
