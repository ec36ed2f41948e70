"""Ingest of landed forecasts, ensembles, reanalysis and rasters into cubes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions import dates, geo, numeric
from furrow.operators import spatial
from furrow.operators.skew import latest_by
from furrow.schema import backfill


def merge_outputs(parts: list[DataFrame], columns: list[str]) -> DataFrame:
    """Collector outputs as one table, by the common column list."""
    return reduce(lambda a, b: a.unionByName(b), [p.select(*columns) for p in parts])


def date_window(df: DataFrame, start: str, end: str, column: str = "date") -> DataFrame:
    """[start, end): the end day belongs to the next run."""
    c = F.col(column)
    return df.where((c >= F.lit(start).cast("date")) & (c < F.lit(end).cast("date")))


def from_floor(df: DataFrame, min_date: str, column: str = "date_time") -> DataFrame:
    return df.where(F.col(column) >= F.lit(min_date).cast("timestamp_ntz"))


def skip_collected(grids: DataFrame, collected: DataFrame) -> DataFrame:
    return grids.join(collected.select("grid_id").distinct(), "grid_id", "left_anti")


def snap_cells(df: DataFrame, lon0: float, lat0: float, step: float,
               tolerance: float | None = None) -> DataFrame:
    """Rows on the lattice: lat/lon replaced by axis coordinates; rows outside
    the tolerance on either axis are dropped."""
    out = (df.withColumn("lat_idx", spatial.snap(F.col("lat"), lat0, step, tolerance))
           .withColumn("lon_idx", spatial.snap(F.col("lon"), lon0, step, tolerance))
           .where("lat_idx is not null and lon_idx is not null"))
    return (out.withColumn("lat", spatial.axis_value(F.col("lat_idx"), lat0, step))
            .withColumn("lon", spatial.axis_value(F.col("lon_idx"), lon0, step)))


def rounded_geohash(digits: int = 8, precision: int = 8) -> Column:
    return geo.geohash(F.round("lon", digits), F.round("lat", digits), precision)


def _geohash_cell(digits: int, precision: int) -> list[Column]:
    """The two halves of the geohash as whole numbers: 5 bits a sign, longitude first."""
    bits = 5 * precision
    part = lambda v, low, span, n: F.floor((F.round(v, digits) - low) / span * float(1 << n)).cast("long")
    return [part("lon", -180.0, 360.0, (bits + 1) // 2).alias("_hx"), part("lat", -90.0, 180.0, bits // 2).alias("_hy")]


def cell_of_grid(df: DataFrame, grid: DataFrame, digits: int = 8, precision: int = 8) -> DataFrame:
    """Cube cells and grids whose rounded centroids share a geohash. They are joined on
    its two numbers, which are cheaper to make for every cube row than its text."""
    g = grid.select("grid_id", *_geohash_cell(digits, precision))
    return df.select("*", *_geohash_cell(digits, precision)).join(g, ["_hx", "_hy"]).drop("_hx", "_hy")


def forecast_cube(rows: DataFrame, grid: DataFrame, variables: list[str], forecast_date: str,
                  lon0: float, lat0: float, step: float, tolerance: float,
                  hourly: bool = False) -> DataFrame:
    """Provider rows (grid_id, date[, hour], variables) → forecast cube slice.

    The lead is the day difference to the run date. A cell and day loaded
    twice keeps the mean, so re-delivered files change nothing.
    """
    located = rows.join(grid.select("grid_id", "lat", "lon"), "grid_id")
    snapped = snap_cells(located, lon0, lat0, step, tolerance)
    run = F.lit(forecast_date).cast("date")
    keys = ["forecast_date", "forecast_day_idx", *(["hour"] if hourly else []), "lat", "lon"]
    return (backfill(snapped, variables)
            .withColumn("forecast_date", run)
            .withColumn("forecast_day_idx", F.date_diff("date", run))
            .groupBy(*keys).agg(*[F.avg(numeric.no_nan(F.col(v))).alias(v) for v in variables]))


def ingest_quality(rows: DataFrame, grid: DataFrame, hashes: DataFrame | None = None) -> DataFrame:
    """One row of counts: grids without a geohash match, without a file, with
    an invalid document, and the share of gap-filled cells.

    ``rows`` is one row per delivered file: grid_id, is_valid, is_gap_filled. ``hashes``
    holds the geohashes of the delivered cells; a grid whose centroid has none of them
    counts as ``missing_hashes``.
    """
    files = rows.groupBy("grid_id").agg(
        F.bool_or("is_valid").alias("is_valid"), F.bool_or("is_gap_filled").alias("is_gap_filled"))
    joined = grid.select("grid_id").join(files.withColumn("_f", F.lit(True)), "grid_id", "full")
    out = joined.agg(
        F.count_if(F.col("_f").isNull()).alias("missing_files"),
        F.count_if(~F.col("is_valid")).alias("invalid_documents"),
        F.count_if("is_gap_filled").alias("gap_filled"),
        F.count("*").alias("grids")).withColumn(
        "gap_filled_share", F.col("gap_filled") / F.col("grids"))
    if hashes is None:
        return out
    own = grid.select(rounded_geohash().alias("geohash"))
    missing = own.join(hashes.select("geohash").distinct(), "geohash", "left_anti").agg(F.count("*"))
    return out.withColumn("missing_hashes", missing.scalar())


def completeness(rows: DataFrame, expected: int, key: str = "grid_id", day: str = "date") -> DataFrame:
    """Grids whose number of forecast days is not the expected one."""
    return (rows.groupBy(key).agg(F.countDistinct(day).alias("days"))
            .withColumn("complete", F.col("days") == expected))


def seasonal_cube(rows: DataFrame, variables: list[str], lon0: float, lat0: float, step: float,
                  tolerance: float | None = None) -> DataFrame:
    """Rows (forecast_date, date, ensemble, lat, lon, variables) → ensemble cube."""
    out = snap_cells(rows, lon0, lat0, step, tolerance)
    return out.select("forecast_date",
                      F.date_diff("date", "forecast_date").alias("forecast_day_idx"),
                      "ensemble", "lat", "lon", *variables)


def archive_month(cube: DataFrame, excluded: list[str]) -> DataFrame:
    """Last run of each month as that month's archived run (first of month)."""
    last = cube.groupBy(F.trunc("forecast_date", "month").alias("_m")).agg(
        F.max("forecast_date").alias("forecast_date"))
    return (cube.drop(*excluded).join(last, "forecast_date")
            .withColumn("forecast_date", F.col("_m")).drop("_m"))


def new_dates(rows: DataFrame, present: DataFrame, day: str = "date") -> DataFrame:
    """Rows of dates the cube does not hold yet."""
    return rows.join(present.select(day).distinct(), day, "left_anti")


def reanalysis_slice(rows: DataFrame, present: DataFrame, lon0: float, lat0: float, step: float,
                     tolerance: float | None = None) -> DataFrame:
    return snap_cells(new_dates(rows, present), lon0, lat0, step, tolerance)


def merge_variables(cube: DataFrame, slice_: DataFrame, keys: list[str], variable: str) -> DataFrame:
    """One variable of a cube replaced where the slice has it, rows added where
    the cube has none."""
    new = slice_.select(*keys, F.col(variable).alias("_v"), F.lit(True).alias("_new"))
    out = cube.join(new, keys, "full")
    old = F.col(variable) if variable in cube.columns else F.lit(None).cast("double")
    return out.withColumn(variable, F.when(F.col("_new"), F.col("_v")).otherwise(old)).drop("_v", "_new")


def pixels_to_raster(pixels: DataFrame, bands: dict[str, str], nodata: float) -> DataFrame:
    """Pixel rows (file_name, lat, lon, band, value) → time, lat, lon, one
    column per band under a column-safe name; nodata becomes null."""
    value = F.when((F.col("value") != nodata) & ~F.isnan("value"), F.col("value"))
    rows = pixels.withColumn("time", F.timestamp_seconds(
        dates.target_time_from_name(F.col("file_name"))).cast("timestamp_ntz"))
    return rows.groupBy("time", "lat", "lon").agg(*[
        F.max(F.when(F.col("band") == b, value)).alias(safe) for b, safe in bands.items()])


def safe_band_names(names: list[str]) -> dict[str, str]:
    """Band name → column name: lower case, runs of other signs as ``_``."""
    import re
    return {n: re.sub(r"[^0-9a-z]+", "_", n.lower()).strip("_") for n in names}


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], keep: str = "last",
           order: str = "arrival") -> DataFrame:
    """Keyed upsert: keep-last replaces, keep-first ignores conflicts.

    ``order`` ranks arrivals inside a load; existing rows come before all.
    """
    marked = existing.withColumn("_o", F.lit(0)).unionByName(
        new.withColumn("_o", F.lit(1)), allowMissingColumns=True)
    return latest_by(marked, keys, ["_o", order], keep).drop("_o")
