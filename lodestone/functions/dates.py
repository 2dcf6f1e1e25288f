"""Date and time formats, all as strings but for the epoch numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import require

#: Formats that a pattern expresses.
PATTERNS = {
    "day": "yyyy-MM-dd",
    "time": "HH:mm:ss",
    "day_hour": "yyyy-MM-dd HH",
    "day_minute": "yyyy-MM-dd HH:mm",
    "month": "yyyy-MM",
    "year": "yyyy",
    "month_of_year": "MM",
    "month_day": "MM-dd",
    "day_of_month": "dd",
    "day_of_year": "DDD",
    "hour": "HH",
    "quarter": "yyyy-'Q'Q",
    "day_of_week": "EEEE",
    "us_date": "MM/dd/yyyy",
    "us_datetime": "MM/dd/yyyy h:mm a",
}
FORMATS = (
    *PATTERNS, "week", "iso_week", "iso_week_date", "day_of_week_num", "iso8601", "rfc3339_millis", "epoch_seconds", "epoch_milliseconds",
    "timezone_offset",
)


def _offset(wall: Column, instant_as_utc: Column) -> Column:
    """``+HH:MM`` from the wall time and the UTC wall time of one instant."""
    minutes = F.timestamp_diff("MINUTE", instant_as_utc, wall)
    size = F.abs(minutes)
    return F.concat(F.when(minutes < 0, "-").otherwise("+"), F.lpad((size / 60).cast("int").cast("string"), 2, "0"), F.lit(":"), F.lpad((size % 60).cast("string"), 2, "0"))


def format_datetime(value: Column, style: str, kind: str, timezone: str | None = None) -> Column:
    """``value`` in a format. kind: the declared type; instants (utc_datetime,
    timestamptz, epoch_datetime) are shown in ``timezone`` (UTC if none), wall times
    and dates as they are."""
    require(style in FORMATS, "invalid_query", "no date format has this name", format=style)
    instant = kind in ("utc_datetime", "timestamptz", "epoch_datetime")
    zone = timezone or "UTC"
    utc = F.convert_timezone(F.lit("UTC"), F.lit("UTC"), value.cast("timestamp").cast("timestamp_ntz")) if instant else value.cast("timestamp_ntz")
    wall = F.convert_timezone(F.lit("UTC"), F.lit(zone), utc) if instant else utc
    if style in ("day", "month", "year", "quarter"):  # parts of a plain date, cheaper than patterns
        day = wall.cast("date").cast("string")
        year = F.substring_index(day, "-", 1)
        if style == "quarter":
            return F.concat(year, F.lit("-Q"), F.quarter(wall).cast("string"))
        return {"day": day, "month": F.left(day, F.length(day) - 3), "year": year}[style]
    if style in PATTERNS:
        return F.date_format(wall, PATTERNS[style])
    part = lambda name: F.date_part(F.lit(name), wall)
    if style in ("week", "iso_week", "iso_week_date"):
        week = F.concat(F.lpad(part("YEAROFWEEK").cast("string"), 4, "0"), F.lit("-W"), F.lpad(part("WEEK").cast("string"), 2, "0"))
        return F.concat(week, F.lit("-"), part("DAYOFWEEK_ISO").cast("string")) if style == "iso_week_date" else week
    if style == "day_of_week_num":
        return part("DAYOFWEEK_ISO").cast("string")
    if style == "iso8601":
        if kind == "date":
            return F.date_format(wall, "yyyy-MM-dd")
        text = F.date_format(wall, "yyyy-MM-dd'T'HH:mm:ss")
        return F.concat(text, _zone_text(wall, utc, zone)) if instant else text
    if style == "rfc3339_millis":
        text = F.date_format(wall, "yyyy-MM-dd'T'HH:mm:ss.SSS")
        return F.concat(text, _zone_text(wall, utc, zone)) if instant else text
    if style == "timezone_offset":
        if instant:
            return _offset(wall, utc)
        if timezone is None:
            return F.when(value.isNotNull(), "+00:00")
        return _offset(wall, F.convert_timezone(F.lit(zone), F.lit("UTC"), wall))
    # a wall time counts in the given zone, else in UTC
    at = utc if instant or timezone is None else F.convert_timezone(F.lit(zone), F.lit("UTC"), wall)
    stamp = F.convert_timezone(F.lit("UTC"), F.current_timezone(), at).cast("timestamp")
    return F.unix_seconds(stamp) if style == "epoch_seconds" else F.unix_millis(stamp)


def _zone_text(wall: Column, utc: Column, zone: str) -> Column:
    return F.when(wall.isNotNull(), "Z") if zone == "UTC" else _offset(wall, utc)


def read_instant(value: Column, kind: str, storage: str | None = None) -> Column:
    """The instant (TIMESTAMP) of a column: epoch seconds, or a zone-less column that
    holds UTC."""
    if kind == "epoch_datetime":
        whole = F.floor(value).cast("long")
        return F.timestamp_micros((whole * 1_000_000 + F.floor((value - whole) * 1_000_000)).cast("long"))
    if storage == "naive_utc":
        return F.to_utc_timestamp(value.cast("timestamp"), F.current_timezone())
    return value.cast("timestamp")


def shown_in_zone(value: Column, kind: str, storage: str | None, timezone: str) -> Column:
    """An instant as wall time of a zone."""
    utc = read_instant(value, kind, storage).cast("timestamp_ntz") if kind != "utc_datetime" or storage else value.cast("timestamp_ntz")
    return F.convert_timezone(F.lit("UTC"), F.lit(timezone), utc)


def days_between(start: Column, end: Column) -> Column:
    return F.datediff(end.cast("date"), start.cast("date")).cast("long")
