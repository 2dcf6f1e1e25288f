"""Labels of value ranges."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import require
from ..types import category, is_numeric, is_temporal
from .shortcuts import parse_day

OTHER = "Other"
DAYS = {"today": 0, "yesterday": 1, "tomorrow": -1}


def today_column(today: str | None) -> Column:
    return F.current_date() if today is None else F.lit(parse_day(today))


def _days_ago(value: Column, now: Column) -> Column:
    return F.datediff(now, value.cast("date"))


def _months_ago(value: Column, now: Column) -> Column:
    months = lambda c: F.year(c) * 12 + F.month(c)
    return months(now) - months(value)


Fits = Callable[[str], bool]
#: Buckets of one width: which types they cut, and the number that is cut.
STEPS: dict[str, tuple[Fits, Callable[[Column], Column]]] = {
    "numeric_increment": (is_numeric, lambda value: value),
    "year_increment": (is_temporal, F.year),
}
#: Declared ranges: which types they cut, and what is measured on today's date.
MEASURES: dict[str, tuple[Fits, Callable[[Column, Column], Column]]] = {
    "numeric_ranges": (is_numeric, lambda value, now: value),
    "elapsed_days_ranges": (is_temporal, _days_ago),
    "date_relative_ranges": (is_temporal, _days_ago),
    "year_ranges": (is_temporal, lambda value, now: F.year(value)),
    "month_ranges": (is_temporal, _months_ago),
}


def _whole(value: Any, least: int, what: str) -> int:
    require(isinstance(value, int) and not isinstance(value, bool) and value >= least, "invalid_query", f"{what}: a whole number from {least}")
    return value


def bucket(value: Column, kind: str, spec: dict[str, Any], today: str | None, most_ranges: int) -> Column:
    """The label of ``value``, a field of declared type ``kind``."""
    style = spec.get("kind", "")
    if style == "text_prefix":
        require(category(kind) == "string", "invalid_query", "prefix buckets cut text", type=kind)
        return _by_prefix(value, spec)
    require(style in STEPS or style in MEASURES, "invalid_query", "no kind of bucket has this name", kind=style)
    fits, measure = STEPS.get(style) or MEASURES[style]
    require(fits(kind), "invalid_query", f"{style}: cuts fields of another type", type=kind)
    if style in STEPS:
        return _by_step(measure(value), value, _whole(spec.get("increment"), 1, "increment"))
    ranges = spec.get("ranges")
    require(isinstance(ranges, list) and 0 < len(ranges) <= most_ranges, "invalid_query", "ranges: none, or more than are allowed", most=most_ranges)
    return _by_ranges(measure(value, today_column(today)), ranges, style == "date_relative_ranges")


def _by_step(number: Column, value: Column, step: int) -> Column:
    first = F.floor(number / F.lit(step)).cast("long") * step
    return F.coalesce(F.when(value.isNotNull(), F.concat_ws("-", first.cast("string"), (first + (step - 1)).cast("string"))), F.lit(OTHER))


def _by_prefix(value: Column, spec: dict[str, Any]) -> Column:
    length = _whole(spec.get("prefix_length", 2), 1, "prefix_length")
    require(length <= 10, "invalid_query", "prefix_length: 10 at most")
    text = F.btrim(F.coalesce(value.cast("string"), F.lit("")))
    if spec.get("exclude_articles"):
        text = F.regexp_replace(text, r"(?i)^(a|an|the)(\s+|$)", "")
    return F.when(text == "", OTHER).otherwise(F.upper(F.left(text, F.lit(length))))


def _by_ranges(measure: Column, ranges: list[dict[str, Any]], named_days: bool) -> Column:
    """The label of the first range that holds the measure."""
    held = []
    for r in ranges:
        low, high, label = (r.get(k) for k in ("minimum", "maximum", "label"))
        require(isinstance(label, str) and len(label) <= 80, "invalid_query", "range: a label has 80 characters at most")
        if named_days and low in DAYS:
            require(high == low, "invalid_query", "range: a named day is one day, so it stands at both ends")
            low = high = DAYS[low]
            held.append(F.when(measure == low, label))
        else:
            held.append(F.when(within(measure, low, high, "range"), label))
    return F.coalesce(*held, F.lit(OTHER))


def within(measure: Column, low: Any, high: Any, what: str) -> Column:
    """Whether a measure is inside whole bounds, one of which may be missing."""
    bounds = [(measure.__ge__, low), (measure.__le__, high)]
    tests = [test(_whole(bound, 0, f"{what}, bound")) for test, bound in bounds if bound is not None]
    require(tests, "invalid_query", f"{what}: open at both ends")
    return reduce(lambda a, b: a & b, tests)


def count_bucket(value: Column, low: Any, high: Any, mode: str, today: str | None) -> Column:
    measure = _days_ago(value, today_column(today)) if mode == "elapsed_days" else value
    return within(measure, low, high, "counted bucket")
