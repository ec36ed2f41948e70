"""Catalogue resolution, request checks, the unified measurement query,
retention and version bookkeeping."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.functions import text
from furrow.operators.skew import latest_by
from furrow.plans import cubes, observations
from furrow.plans.observations import Location
from furrow.schema import rename_attributes, with_metadata
from furrow.sinks import results

FORMATS = ("json", "csv", "ascii", "netcdf")


class RequestError(ValueError):
    """A measurement request that breaks one of the request rules."""


# ---- catalogue ------------------------------------------------------------

def resolve(dataset: DataFrame, dataset_attribute: DataFrame, attribute: DataFrame,
            product: str, attributes: list[str]) -> DataFrame:
    """Dataset attributes of a product: case-insensitive product, active
    attributes, datasets that are not internal."""
    d = dataset.where((F.lower("product") == product.lower()) & ~F.col("is_internal"))
    a = attribute.where(F.col("is_active") & F.col("variable_name").isin(attributes))
    return dataset_attribute.join(d, "dataset_id").join(a, "attribute_id")


def product_attributes(dataset: DataFrame, dataset_attribute: DataFrame, attribute: DataFrame,
                       exclude: str = "default") -> DataFrame:
    """Products with their distinct attributes, sorted."""
    joined = (dataset.where(F.col("product") != exclude)
              .join(dataset_attribute, "dataset_id").join(attribute, "attribute_id"))
    return (joined.select("product", "variable_name").distinct().groupBy("product")
            .agg(F.array_sort(F.collect_list("variable_name")).alias("attributes")))


def attach_attribute_info(long: DataFrame, attribute: DataFrame, on: str = "variable_name") -> DataFrame:
    return long.join(attribute.select(on, "unit", "long_name"), on, "left")


# ---- requests -------------------------------------------------------------

@dataclass
class Dataset:
    """A product bound to its tables.

    kind: 'station', 'airborne', 'daily', 'hourly', 'forecast',
    'forecast_hourly', 'seasonal', 'normals', 'raster'. ``sources`` maps
    variable name to source column; ``lattice`` is (lon0, lat0, step).
    """

    product: str
    kind: str
    table: DataFrame
    sources: dict[str, str]
    stations: DataFrame | None = None
    place_id: str = "station_id"
    lattice: tuple[float, float, float] | None = None
    ensembles: set[str] = field(default_factory=set)
    max_days: int = -1
    latest: dt.date | None = None  # newest run, from the cube's manifest (sinks.runs)
    units: dict[str, dict] = field(default_factory=dict)
    internal: bool = False


@dataclass
class Request:
    product: str
    attributes: list[str]
    start: str
    end: str
    location: Location
    output: str = "csv"
    altitudes: tuple[float, float] | None = None
    forecast_date: str | None = None


def _broken_rules(request: Request, dataset: Dataset | None):
    """(rule is broken, what to say), in the order they are told."""
    yield dataset is None or dataset.internal, f"there is no product {request.product!r}"
    yield request.output not in FORMATS, f"{request.output!r} is none of the formats {', '.join(FORMATS)}"
    yield request.output == "json" and request.location.kind != "point", "json answers one point, not an area or list"
    yield request.output == "netcdf", "netcdf files are not written here: ask for csv, ascii, json or a table"
    names = [a for a in request.attributes if a in dataset.sources]
    yield not names, f"{request.product} has none of the attributes {', '.join(request.attributes)}"
    yield (request.output == "csv" and len({a in dataset.ensembles for a in names}) > 1,
           "csv holds attributes with members or without, not both")
    days = (dt.date.fromisoformat(request.end[:10]) - dt.date.fromisoformat(request.start[:10])).days + 1
    yield days < 1, "the range ends before it starts"
    yield dataset.max_days != -1 and days > dataset.max_days, f"{days} days asked, at most {dataset.max_days} are given"
    low, high = request.altitudes or (0, 0)
    yield low > high, "the altitudes are the wrong way round"


def check(request: Request, dataset: Dataset | None) -> None:
    """All request rules, before any plan is built; the first broken one is raised."""
    for broken, message in _broken_rules(request, dataset):
        if broken:
            raise RequestError(message)


def _asked(datasets: list[Dataset], request: Request) -> list[Dataset]:
    """Datasets of the product that have a requested attribute."""
    own = [d for d in datasets if d.product.lower() == request.product.lower()]
    own = [d for d in own if not d.internal] or own
    return [d for d in own if any(a in d.sources for a in request.attributes)] or own[:1]


def answer(datasets: list[Dataset], request: Request, path: str, unit_names: bool = False) -> None:
    """The whole request: every dataset of the product read, merged in time order and
    written to ``path`` in the format asked for (see ``sinks.results``)."""
    asked = _asked(datasets, request)
    parts, units = [], {}
    for ds in asked or [None]:
        check(request, ds)
        rows = measure([ds], request)
        places = ds.stations if ds.kind in ("station", "airborne") else None
        parts.append(results.shaped(rows, places.withColumnRenamed(ds.place_id, "station_id") if places is not None
                                    and ds.place_id not in results.PLACES else places))
        units = {**ds.units, **units}
    results.write_result(parts, request.output, path, units, unit_names)


def measure(datasets: list[Dataset], request: Request) -> DataFrame:
    """Product, attributes, range and location → one lazy result.

    A product may have several datasets: the rows of each that has a requested
    attribute are given, attributes of the others null; order holds within each.
    """
    asked = _asked(datasets, request)
    if len(asked) > 1:
        parts = [measure([d], request) for d in asked]
        return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    ds = asked[0] if asked else None
    check(request, ds)
    names = [a for a in request.attributes if a in ds.sources]
    cols = [ds.sources[a] for a in names]
    start, end, day0, day1 = request.start, request.end, request.start[:10], request.end[:10]
    loc, lattice = request.location, ds.lattice
    rename = {ds.sources[a]: a for a in names}
    if ds.kind in ("station", "airborne"):
        edge = "include" if ds.kind == "airborne" else "exclude"
        out = observations.read_observations(ds.table, ds.stations, cols, start, end, loc,
                                             ds.place_id, edge, request.altitudes)
        keys = [ds.place_id, "date_time"]
    elif ds.kind in ("forecast", "forecast_hourly"):
        hourly = ds.kind == "forecast_hourly"
        near = cubes.at_location(ds.table, loc, *lattice)
        out = cubes.read_forecast(near, cols, day0, day1,
                                  latest=ds.latest or cubes.latest_forecast_date(ds.table), hourly=hourly)
        keys = ["date", *(["hour"] if hourly else []), "lat", "lon"]
    elif ds.kind == "seasonal":
        ens = [ds.sources[a] for a in names if a in ds.ensembles]
        plain = [ds.sources[a] for a in names if a not in ds.ensembles]
        out = cubes.read_seasonal(ds.table, ens, day0, day1, loc, lattice, request.forecast_date, plain, ds.latest)
        keys = ["date", "lat", "lon"]
    elif ds.kind == "normals":
        near = cubes.at_location(ds.table, loc, *lattice)
        out, keys = cubes.read_normals(near, cols, day0, day1), ["month_day", "lat", "lon"]
    elif ds.kind == "raster":
        out = cubes.exact_times(cubes.at_location(ds.table, loc, *lattice), start, end)
        keys = ["time", "lat", "lon"]
    else:
        slice_ = cubes.hourly_slice if ds.kind == "hourly" else cubes.daily_slice
        out = cubes.at_location(slice_(ds.table, start, end), loc, *lattice)
        keys = ["date", *(["hour"] if ds.kind == "hourly" else []), "lat", "lon"]
    result = rename_attributes(out, keys, {s: a for s, a in rename.items()}).orderBy(*keys)
    return with_metadata(result, ds.units)


def request_fingerprint(df: DataFrame) -> Column:
    """Key under which a finished result can be found again.

    Covers the requested forecast date too, so two archived runs never share
    a result.
    """
    names = ["product", "attributes", "start_date", "start_time", "end_date", "end_time",
             "output_type", "geom_type", "geometry", "altitudes", "forecast_date"]
    return text.fingerprint(*[F.col(n) if n in df.columns else F.lit(None) for n in names])


def cached_result(results: DataFrame, fingerprint: str) -> DataFrame:
    """Newest stored result of a fingerprint."""
    return latest_by(results.where(F.col("query_hash") == fingerprint), ["query_hash"],
                     ["created_on", "result_id"])


# ---- files and versions ---------------------------------------------------

def new_files(listed: DataFrame, registered: DataFrame, on: str = "name") -> DataFrame:
    """Listed source files that are not registered yet."""
    return listed.join(registered.select(on).distinct(), on, "left_anti")


def backfill_plan(spark: SparkSession, collected: DataFrame, year: int | None = None,
                  days: list[str] | None = None, today: str | None = None) -> DataFrame:
    """Dates still to collect: month starts of a year, a list, or today."""
    if days:
        wanted = days
    elif year:
        wanted = [f"{year}-{m:02d}-01" for m in range(1, 13)]
    else:
        wanted = [today]
    plan = spark.createDataFrame([(d,) for d in wanted], "day string").select(F.to_date("day").alias("day"))
    done = collected.where(F.col("status") == "success").select("day").distinct()
    return plan.join(done, "day", "left_anti")


def month_starts(df: DataFrame, start: str, end: str) -> DataFrame:
    """Every month start between two date columns, one row each."""
    return df.withColumn("day", F.explode(F.sequence(
        F.trunc(start, "month"), F.col(end), F.expr("interval 1 month"))))


def retention(files: DataFrame, config: DataFrame, now: str, default_days: int = 1) -> DataFrame:
    """Adds ``expired``: marked for deletion, past its dataset's days, not latest."""
    limit = F.coalesce("days_to_keep", F.lit(default_days))
    cutoff = F.col("deleted_at") + F.make_interval(days=limit)
    due = F.lit(now).cast("timestamp_ntz") >= cutoff
    return (files.join(config.select("dataset_id", "days_to_keep"), "dataset_id", "left")
            .withColumn("expired", F.coalesce(due & ~F.col("is_latest"), F.lit(False)))
            .drop("days_to_keep"))


def switch_latest(files: DataFrame, keys: list[str] = ("dataset_id",),
                  version: list[str] = ("version", "file_id")) -> DataFrame:
    """``is_latest`` on the newest version of each dataset only."""
    top = files.groupBy(*keys).agg(F.max(F.struct(*version)).alias("_top"))
    return (files.drop("is_latest").join(top, list(keys))
            .withColumn("is_latest", F.struct(*version) == F.col("_top")).drop("_top"))


def coverage(current: DataFrame, loaded: DataFrame, key: str = "dataset_id", day: str = "date") -> DataFrame:
    """Dataset start and end extended by what was loaded."""
    new = loaded.groupBy(key).agg(F.min(day).alias("_lo"), F.max(day).alias("_hi"))
    return (current.join(new, key, "left")
            .withColumn("start_date", F.least("start_date", "_lo"))
            .withColumn("end_date", F.greatest("end_date", "_hi")).drop("_lo", "_hi"))


def replace_by_key(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Drop all rows of the keys that are loaded, then add the new set."""
    return existing.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(
        new, allowMissingColumns=True)


def reset_attributes(measurement: DataFrame, attributes: DataFrame, on: str = "attribute") -> DataFrame:
    """Measurements without those of a dataset's attributes."""
    return measurement.join(attributes.select(on).distinct(), on, "left_anti")


def groups_or_latest(groups: DataFrame, configured: list[int] | None) -> DataFrame:
    """Configured registry groups, else the latest."""
    return groups.where(F.col("group_id").isin(configured) if configured else F.col("is_latest"))


def named_groups(groups: DataFrame, names: list[str] | None) -> DataFrame:
    return groups.where(F.col("name").isin(names)) if names else groups


def recent_outputs(outputs: DataFrame, now: str, days: int = 14, suffix: str = ".csv") -> DataFrame:
    """CSV outputs of the last two weeks, newest first."""
    floor = F.lit(dt.datetime.fromisoformat(now) - dt.timedelta(days=days)).cast("timestamp_ntz")
    return (outputs.where((F.col("created_at") >= floor) & F.col("name").endswith(suffix))
            .orderBy(F.desc("created_at"), "name"))
