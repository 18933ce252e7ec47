"""Local time (Asia/Shanghai) that never depends on the session time zone."""

from __future__ import annotations

from datetime import date, datetime, time, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance.functions.text import strip

ZONE = "Asia/Shanghai"
DATETIME_FORMATS = (
    "%Y-%m-%d %H:%M",
    "%Y-%m-%d %H:%M:%S",
    "%Y-%m-%dT%H:%M",
    "%Y-%m-%dT%H:%M:%S",
)


def _ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def epoch_of(ntz: Column) -> Column:
    """Whole seconds since 1970 of a zone-less timestamp read as UTC."""
    days = F.datediff(ntz.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86400 + F.hour(ntz) * 3600 + F.minute(ntz) * 60 + F.second(ntz)


def local_time(col: Column) -> Column:
    """Epoch seconds as `yyyy-MM-dd HH:mm:ss` local time; null counts as 0."""
    seconds = F.coalesce(col.cast("long"), F.lit(0))
    utc = _ntz("1970-01-01 00:00:00") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)")
    )
    return F.convert_timezone(F.lit("UTC"), F.lit(ZONE), utc).cast("string")


def parse_local(col: Column) -> Column:
    """Local datetime text in one of four layouts as a zone-less timestamp, else null."""
    layout = (
        r"^(\d{4})-(\d{1,2})-(\d{1,2})(?:\s+|T)(\d{1,2}):(\d{1,2})(?::(\d{1,2}))?$"
    )
    text = strip(col)
    year, month, day, hour, minute, second = (
        F.regexp_extract(text, layout, i).try_cast("int") for i in range(1, 7)
    )
    second = F.coalesce(second, F.lit(0))
    stamp = F.try_make_timestamp_ntz(year, month, day, hour, minute, second.cast("decimal(8,6)"))
    return F.when((second < 60) & (year > 0), stamp)


def local_epoch(col: Column) -> Column:
    """Local datetime text as epoch seconds, else null."""
    return epoch_of(F.convert_timezone(F.lit(ZONE), F.lit("UTC"), parse_local(col)))


def _parse(value: str, field: str) -> datetime:
    for layout in DATETIME_FORMATS:
        try:
            return datetime.strptime(value.strip(), layout).replace(tzinfo=ZoneInfo(ZONE))
        except ValueError:
            continue
    raise ValueError(f"{field}: expected YYYY-MM-DD HH:mm or YYYY-MM-DD HH:mm:ss")


def resolve_range(
    day: str = "", start: str = "", end: str = "", now: datetime | None = None
) -> tuple[int, int]:
    """Half-open `[start, end)` in epoch seconds: one local day, a pair, or today until now."""
    if day and (start or end):
        raise ValueError("a date excludes start and end")
    if bool(start) != bool(end):
        raise ValueError("start and end must be given together")
    zone = ZoneInfo(ZONE)
    current = now or datetime.now(zone)
    current = current.replace(tzinfo=zone) if current.tzinfo is None else current.astimezone(zone)
    if day:
        first = datetime.combine(date.fromisoformat(day.strip()), time.min, tzinfo=zone)
        last = first + timedelta(days=1)
    elif start:
        first, last = _parse(start, "start"), _parse(end, "end")
    else:
        first, last = current.replace(hour=0, minute=0, second=0, microsecond=0), current
    if last <= first:
        raise ValueError("the range must end after it starts")
    return int(first.timestamp()), int(last.timestamp())


def in_range(col: Column, start: int, end: int) -> Column:
    """Half-open range on the raw epoch column, so that it reaches the scan."""
    return (col >= F.lit(start)) & (col < F.lit(end))
