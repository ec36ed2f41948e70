"""Dates, epochs, calendar arithmetic and times hidden in file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECONDS_PER_DAY = 86400


def to_epoch(day: Column) -> Column:
    """Midnight (UTC) of a date as epoch seconds."""
    return F.unix_date(day.cast("date")).cast("long") * SECONDS_PER_DAY


def epoch_to_date(epoch: Column) -> Column:
    return F.date_from_unix_date(F.floor(epoch / SECONDS_PER_DAY).cast("int"))


def epoch_to_date_text(epoch: Column) -> Column:
    return F.date_format(epoch_to_date(epoch), "yyyy-MM-dd")


def month_day(day: Column) -> Column:
    return F.date_format(day, "MM-dd")


def month_name(day: Column) -> Column:
    return F.date_format(day, "MMMM")


def previous_month_name(day: Column) -> Column:
    return F.date_format(F.add_months(F.trunc(day, "month"), -1), "MMMM")


def is_leap_year(year: Column) -> Column:
    return (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))


def closest_leap_year(year: Column) -> Column:
    """Nearest leap year at or before ``year``.

    The step back to a multiple of four is at most three years; only a
    century that is not a leap year needs four more.
    """
    base = year - year % 4
    return F.when(is_leap_year(base), base).otherwise(base - 4)


def previous_weekday(day: Column, weekday: Column | int) -> Column:
    """Last given weekday (Monday = 0) strictly before ``day``."""
    target = F.lit(weekday) if isinstance(weekday, int) else weekday
    back = F.pmod(F.weekday(day) - target + F.lit(6), F.lit(7)) + 1
    return F.date_sub(day, back.cast("int"))


def weekday_occurrence(day: Column) -> Column:
    """1 for the first Tuesday (say) of the month, 2 for the second, ..."""
    return F.ceil(F.dayofmonth(day) / 7).cast("int")


def parse_mixed_date(text: Column) -> Column:
    """ISO date first, then month/day/two-digit-year; null when neither fits."""
    return F.coalesce(
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd")),
        F.try_to_timestamp(text, F.lit("M/d/yy")),
    ).cast("date")


def target_time_from_name(name: Column) -> Column:
    """Epoch seconds named by a raster file.

    Fixed formats: ``nowcast_<start>_<seconds>.tif`` and
    ``graphcast_<start>_<hours>.tif``. Other names give null.
    """
    start = F.regexp_extract(name, r"^(?:nowcast|graphcast)_(\d+)_(\d+)", 1)
    step = F.regexp_extract(name, r"^(?:nowcast|graphcast)_(\d+)_(\d+)", 2)
    unit = F.when(name.startswith("graphcast_"), 3600).otherwise(1)
    return F.when(start != "", start.cast("long") + step.cast("long") * unit)


def date_from_name(name: Column) -> Column:
    """First ``yyyy-MM-dd`` in a file name."""
    text = F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2})", 1)
    return F.when(text != "", F.to_date(text))


def variable_year_from_name(name: Column) -> Column:
    """``<variable>_<yyyy>.<ext>`` → struct(variable, year)."""
    pattern = r"^(.+)_(\d{4})\.[A-Za-z0-9]+$"
    year = F.regexp_extract(name, pattern, 2)
    return F.when(year != "", F.struct(
        F.regexp_extract(name, pattern, 1).alias("variable"),
        year.cast("int").alias("year")))


def hour_label(hour: Column) -> Column:
    return F.format_string("%02d:00:00", hour.cast("int"))


def at_hour(day: Column, hour: Column) -> Column:
    """Timestamp (no zone) of ``hour`` on ``day``."""
    return F.expr("make_dt_interval(0, 1)") * hour + day.cast("timestamp_ntz")


def local_time(ts: Column, zone: str) -> Column:
    """UTC instant shown in the zone a report is configured for."""
    return F.from_utc_timestamp(ts, zone)


def report_title(ts: Column, zone: str) -> Column:
    return F.date_format(local_time(ts, zone), "EEEE-dd-MM-yyyy")


def split_by_period(df: DataFrame, start: str, end: str, unit: str) -> DataFrame:
    """One row per calendar ``unit`` ('year' or 'month') touched by [start, end].

    Adds ``part_start`` and ``part_end`` (dates, inclusive) clipped to the
    range, plus ``year`` and, for months, ``month``.
    """
    first = F.trunc(F.col(start), unit)
    parts = F.sequence(first, F.col(end), F.expr(f"interval 1 {unit}"))
    out = df.withColumn("_p", F.explode(parts))
    last = F.date_sub(F.add_months("_p", 12 if unit == "year" else 1), 1)
    out = (out.withColumn("part_start", F.greatest("_p", F.col(start)))
              .withColumn("part_end", F.least(last, F.col(end)))
              .withColumn("year", F.year("_p")))
    if unit == "month":
        out = out.withColumn("month", F.month("_p"))
    return out.drop("_p")


def split_date_range(start: Column, end: Column, latest: Column) -> Column:
    """Past and future parts of [start, end] around the latest run date.

    Past runs to the day before ``latest``; future starts at ``latest``. A
    part that is empty is null.
    """
    past_end = F.least(end, F.date_sub(latest, 1))
    future_start = F.greatest(start, latest)
    return F.struct(
        F.when(start <= past_end, F.struct(
            start.alias("start"), past_end.alias("end"))).alias("past"),
        F.when(future_start <= end, F.struct(
            future_start.alias("start"), end.alias("end"))).alias("future"),
    )
