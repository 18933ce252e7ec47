"""Checks of schedule requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.clock import local_epoch
from parlance.functions.pages import parse_weekdays
from parlance.functions.text import strip

# Fixed values.
TYPES = ("delay_once", "daily", "weekly", "cn_workday")
MAX_DELAY = 86_400
MAX_NAME, MAX_CONTENT = 100, 500
CLOCK = r"^(?:[01]\d|2[0-3]):[0-5]\d$"


def is_clock(col: Column) -> Column:
    return F.coalesce(col.rlike(CLOCK), F.lit(False))


def _given(name: str) -> Column:
    return F.col(name).isNotNull()


def delay_seconds(now: Column) -> Column:
    """Delay from seconds, minutes, hours or a local time, whichever comes first."""
    at = local_epoch(F.col("run_at"))
    return F.coalesce(
        F.col("delay_seconds").cast("long"),
        F.col("delay_minutes").cast("long") * 60,
        F.col("delay_hours").cast("long") * 3600,
        F.ceil(at - now),
    )


def validate_schedule(specs: DataFrame, now: Column) -> DataFrame:
    """Add delay, weekdays and the first `error` of each request.

    Columns: name, schedule_type, time, weekdays, delay_seconds, delay_minutes, delay_hours,
    run_at, content, ai_prompt. `now` is in epoch seconds, fractions allowed.
    """

    def text(name: str) -> Column:
        return strip(F.coalesce(F.col(name), F.lit("")))

    delays = ["delay_seconds", "delay_minutes", "delay_hours", "run_at"]
    given = F.aggregate(
        F.array(*[_given(d).cast("int") for d in delays]), F.lit(0), lambda a, x: a + x
    )
    once = F.col("schedule_type") == "delay_once"
    weekly = F.col("schedule_type") == "weekly"
    has_weekdays = F.coalesce(F.col("weekdays"), F.lit("")) != ""
    delay = delay_seconds(now)
    days = parse_weekdays(F.col("weekdays"))
    bad_run_at = (
        _given("run_at") & F.coalesce(*[F.col(d) for d in delays[:3]]).isNull() & delay.isNull()
    )
    error = (
        F.when(~F.col("schedule_type").isin(*TYPES), "type")
        .when(given > 1, "several_delays")
        .when(text("name") == "", "name_blank")
        .when(F.length(text("name")) > MAX_NAME, "name_long")
        .when(F.length(text("content")) > MAX_CONTENT, "content_long")
        .when((text("content") == "") & (text("ai_prompt") == ""), "no_text")
        .when(once & ((F.coalesce("time", F.lit("")) != "") | has_weekdays), "once_with_time")
        .when(once & (given == 0), "no_delay")
        .when(once & bad_run_at, "run_at_format")
        .when(once & ((delay < 1) | (delay > MAX_DELAY)), "delay_bounds")
        .when(~once & (given > 0), "delay_not_allowed")
        .when(~once & ~is_clock(text("time")), "clock")
        .when(weekly & days["error"].isNotNull(), F.concat(F.lit("weekdays_"), days["error"]))
        .when(~once & ~weekly & has_weekdays, "weekdays_not_allowed")
    )
    checked = specs.withColumn("error", error)
    fine = F.col("error").isNull()
    return checked.withColumn("delay", F.when(fine & once, delay)).withColumn(
        "days", F.when(fine & weekly, days["days"])
    )
