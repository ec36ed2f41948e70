"""Gridded data as long tables: reanalysis, forecasts, ensembles, normals.

A cube is a Parquet table partitioned by ``date`` or ``forecast_date`` with
``lat``/``lon`` columns and one column per variable. All readers filter the
partition column first, so a query touches only the slices it asks for.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions import dates
from furrow.operators import spatial
from furrow.plans.observations import Location

CELL = ["lat", "lon"]


def at_location(cube: DataFrame, location: Location, lon0: float, lat0: float,
                step: float) -> DataFrame:
    """Cells that answer a location on a regular lattice.

    Points take their nearest cells (each cell once), boxes are inclusive,
    polygons take cell centres inside.
    """
    if location.kind == "bbox":
        return spatial.within_box(cube, *location.box)
    if location.kind == "polygon":
        return spatial.within_area(cube, location.rings)
    with_idx = (cube.withColumn("lat_idx", spatial.axis_index(F.col("lat"), lat0, step))
                .withColumn("lon_idx", spatial.axis_index(F.col("lon"), lon0, step)))
    pts = location.frame(cube.sparkSession)
    return spatial.cells_of_points(with_idx, pts, lon0, lat0, step).drop("lat_idx", "lon_idx")


def latest_forecast_date(cube: DataFrame, partition: str = "forecast_date") -> dt.date | None:
    """Newest run of a table without a manifest, by a maximum over it; where the writers
    kept one, ``sinks.runs.newest`` reads that instead."""
    return cube.agg(F.max(partition).alias("d")).first().d


# ---- reanalysis -----------------------------------------------------------

def daily_slice(cube: DataFrame, start: str, end: str) -> DataFrame:
    return cube.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def hourly_slice(cube: DataFrame, start: str, end: str, hour: str = "hour") -> DataFrame:
    """Whole days prune the partitions, the exact instants mask within them."""
    days = daily_slice(cube, start[:10], end[:10])
    at = dates.at_hour(F.col("date"), F.col(hour))
    return days.where(at.between(F.lit(start).cast("timestamp_ntz"),
                                 F.lit(end).cast("timestamp_ntz")))


def by_dates(cube: DataFrame, days: list[str]) -> DataFrame:
    """Only the listed days, as when every day is a file."""
    return cube.where(F.col("date").isin([dt.date.fromisoformat(d) for d in days]))


# ---- short-term forecast --------------------------------------------------

def read_forecast(cube: DataFrame, variables: list[str], start: str, end: str,
                  latest: dt.date | None = None, hourly: bool = False,
                  keys: list[str] = CELL) -> DataFrame:
    """Forecast values over past and future dates.

    A past day is lead -1 of the run issued one day later; today and the
    future come from the latest run. Hourly cubes have no past part. Both parts
    are filters on the partition column, so at most (days + 1) runs are read.
    """
    latest = latest or latest_forecast_date(cube)
    first, last = dt.date.fromisoformat(start), dt.date.fromisoformat(end)
    extra = ["hour"] if hourly else []
    future = (cube.where(F.col("forecast_date") == F.lit(latest))
              .where(F.col("forecast_day_idx").between(
                  max((first - latest).days, 0), (last - latest).days))
              .select(F.date_add("forecast_date", F.col("forecast_day_idx")).alias("date"),
                      *extra, *keys, *variables))
    if hourly or first >= latest:
        return future
    past_end = min(last, latest - dt.timedelta(days=1))
    day = dt.timedelta(days=1)
    past = (cube.where(F.col("forecast_date").between(F.lit(first + day), F.lit(past_end + day)))
            .where(F.col("forecast_day_idx") == -1)
            .select(F.date_sub("forecast_date", 1).alias("date"), *keys, *variables))
    return past if last < latest else past.unionByName(future)


def lead_slice(cube: DataFrame, start: str, end: str) -> DataFrame:
    """Leads of each run that fall on dates in [start, end]."""
    lo = F.date_diff(F.lit(start).cast("date"), F.col("forecast_date"))
    hi = F.date_diff(F.lit(end).cast("date"), F.col("forecast_date"))
    return cube.where(F.col("forecast_day_idx").between(lo, hi))


def read_run(cube: DataFrame, run_date: str, start: str, end: str) -> DataFrame:
    """The forecast as issued on one run date."""
    one = cube.where(F.col("forecast_date") == F.lit(run_date).cast("date"))
    return lead_slice(one, start, end).withColumn(
        "date", F.date_add("forecast_date", F.col("forecast_day_idx")))


# ---- seasonal ensemble ----------------------------------------------------

def seasonal_run(cube: DataFrame, requested: str | None = None, latest: dt.date | None = None) -> DataFrame:
    """The archived run of a requested month, else the latest run."""
    if requested:
        run = F.trunc(F.lit(requested).cast("date"), "month")
        return cube.where(F.col("forecast_date") == run)
    return cube.where(F.col("forecast_date") == F.lit(latest or latest_forecast_date(cube)))


def members_to_list(df: DataFrame, keys: list[str], variables: list[str],
                    plain: list[str] = ()) -> DataFrame:
    """Ensemble members as an ordered list per key; others keep one value.

    A list has at most the number of members (50), fixed by the cube.
    """
    lists = [F.transform(
        F.array_sort(F.collect_list(F.when(F.col(v).isNotNull(), F.struct(
            F.col("ensemble").alias("e"), F.col(v).alias("v"))))),
        lambda s: s["v"]).alias(v) for v in variables]
    singles = [F.min_by(v, "ensemble").alias(v) for v in plain]
    return df.groupBy(*keys).agg(*lists, *singles)


def read_seasonal(cube: DataFrame, variables: list[str], start: str, end: str,
                  location: Location | None = None, lattice: tuple[float, float, float] | None = None,
                  requested: str | None = None, plain: list[str] = (), latest: dt.date | None = None) -> DataFrame:
    """Ensemble lists per date and cell; the start is clipped to the run date."""
    run = seasonal_run(cube, requested, latest)
    run = run.where(F.col("forecast_day_idx") >= 0)
    rows = lead_slice(run, start, end)
    if location is not None:
        rows = at_location(rows, location, *lattice)
    rows = rows.withColumn("date", F.date_add("forecast_date", F.col("forecast_day_idx")))
    return members_to_list(rows, ["date", *CELL], variables, plain)


def percentiles(df: DataFrame, keys: list[str], value: str,
                points: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    """Exact ensemble percentiles; a group holds at most members × leads values."""
    p = F.percentile(value, F.array(*[F.lit(x) for x in points]))
    out = df.groupBy(*keys).agg(p.alias("_p"))
    return out.select(*keys, *[F.get("_p", i).alias(f"percentile_{round(x * 100)}")
                               for i, x in enumerate(points)])


# ---- normals and rasters --------------------------------------------------

def normals_slice(normals: DataFrame, start: str, end: str) -> DataFrame:
    """Day-of-year slice that may wrap around the year end.

    The table lives on a leap year, so both ends are looked up on the closest
    leap year of the start.
    """
    lo, hi = (_leap_day_of_year(x) for x in (start, end))
    day = F.col("dayofyear")
    if dt.date.fromisoformat(end) - dt.date.fromisoformat(start) >= dt.timedelta(days=365):
        return normals
    return normals.where(day.between(lo, hi) if lo <= hi else (day >= lo) | (day <= hi))


def _leap_day_of_year(day: str) -> int:
    d = dt.date.fromisoformat(day)
    return dt.date(2024, d.month, d.day).timetuple().tm_yday


def normal_month_day(dayofyear: Column) -> Column:
    """``MM-DD`` of a leap-year day number."""
    return dates.month_day(F.date_add(F.lit(dt.date(2023, 12, 31)), dayofyear))


def read_normals(normals: DataFrame, variables: list[str], start: str, end: str) -> DataFrame:
    return normals_slice(normals, start, end).select(
        normal_month_day(F.col("dayofyear")).alias("month_day"), *CELL, *variables)


def exact_times(raster: DataFrame, start: str, end: str) -> DataFrame:
    return raster.where(F.col("time").between(
        F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))


def combine(parts: list[DataFrame], order: list[str] | None = None) -> DataFrame:
    """Slices of the same cube as one table, by column name."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.orderBy(*order) if order else out
