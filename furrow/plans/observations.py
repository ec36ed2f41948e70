"""Station observations: EAV and wide tables, point/box/polygon queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.operators import spatial
from furrow.schema import backfill


# ---- EAV <-> wide ---------------------------------------------------------

def to_wide(measurement: DataFrame, keys: list[str], attributes: list[str]) -> DataFrame:
    """Mean per key and attribute, one column each; null keys are dropped.

    The attribute list comes from the catalogue, so the pivot needs no extra
    job to find it, and the aggregation combines before its shuffle: a station
    with a third of all rows sends one row per key from each task.
    """
    known = measurement.dropna(subset=keys).where(F.col("attribute").isin(attributes))
    means = [F.avg(F.when(F.col("attribute") == a, F.col("value"))).alias(a) for a in attributes]
    return known.groupBy(*keys).agg(*means)


def to_long(wide: DataFrame, keys: list[str], attributes: list[str]) -> DataFrame:
    """One row per present value."""
    return (wide.unpivot(keys, attributes, "attribute", "value")
            .where(F.col("value").isNotNull() & ~F.isnan("value")))


def join_station(weather: DataFrame, station: DataFrame, on: str = "station_id") -> DataFrame:
    """Weather rows with station attributes; ``on`` is the track point for balloons."""
    return weather.join(station, on)


def attach_track_point(measurement: DataFrame, history: DataFrame) -> DataFrame:
    """Fill an empty track point from the history of the same station and time."""
    h = history.groupBy("station_id", "date_time").agg(F.min("history_id").alias("_h"))
    return (measurement.join(h, ["station_id", "date_time"], "left")
            .withColumn("station_history_id", F.coalesce("station_history_id", "_h"))
            .drop("_h"))


def with_time_parts(df: DataFrame, use_month: bool = False) -> DataFrame:
    df = df.withColumn("year", F.year("date_time"))
    return df.withColumn("month", F.month("date_time")) if use_month else df


def convert(measurement: DataFrame, station: DataFrame, attributes: list[str],
            catalogue: list[str] | None = None, on: str = "station_id",
            use_month: bool = False) -> DataFrame:
    """EAV → wide table ready for a partitioned write.

    ``on='station_history_id'`` is the balloon variant: track points instead of
    stations, month partitions.
    """
    wide = to_wide(measurement, ["date_time", on], attributes)
    wide = backfill(wide, catalogue or attributes)
    return with_time_parts(join_station(wide, station, on), use_month)


def last_times(measurement: DataFrame, by: list[str], stations: DataFrame | None = None,
               default: str | None = None) -> DataFrame:
    """High-water mark per station (and attribute), with a default for new ones."""
    seen = measurement.groupBy(*by).agg(F.max("date_time").alias("last_time"))
    if stations is None:
        return seen
    return (stations.select(*by).distinct().join(seen, by, "left")
            .withColumn("last_time", F.coalesce(
                "last_time", F.lit(default).cast("timestamp_ntz"))))


def time_bounds(df: DataFrame, column: str = "date_time") -> DataFrame:
    return df.agg(F.min(column).alias("min_time"), F.max(column).alias("max_time"))


# ---- queries --------------------------------------------------------------

@dataclass(frozen=True)
class Location:
    """point | points | bbox | polygon in lon/lat degrees.

    ``points`` may be a DataFrame (point_id, lon, lat) for large lists.
    """

    kind: str
    points: list[tuple[float, float]] | DataFrame | None = None
    box: tuple[float, float, float, float] | None = None
    rings: list[list[tuple[float, float]]] | None = None

    @staticmethod
    def point(lon: float, lat: float) -> "Location":
        return Location("point", points=[(lon, lat)])

    @staticmethod
    def many(points: list[tuple[float, float]] | DataFrame) -> "Location":
        return Location("points", points=points)

    @staticmethod
    def bbox(min_lon: float, min_lat: float, max_lon: float, max_lat: float) -> "Location":
        return Location("bbox", box=(min_lon, min_lat, max_lon, max_lat))

    @staticmethod
    def polygon(rings: list[list[tuple[float, float]]]) -> "Location":
        return Location("polygon", rings=rings)

    def frame(self, spark) -> DataFrame:
        if isinstance(self.points, DataFrame):
            return self.points
        rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(self.points or [])]
        return spark.createDataFrame(rows, "point_id long, lon double, lat double")


def time_range(df: DataFrame, start: str, end: str, column: str = "date_time") -> DataFrame:
    """Inclusive range, with the year bounds spelled out for partition pruning."""
    out = df.where(F.col(column).between(
        F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))
    if "year" in df.columns:
        out = out.where(F.col("year").between(int(start[:4]), int(end[:4])))
    return out


def altitude_band(df: DataFrame, low: float | None, high: float | None,
                  column: str = "altitude") -> DataFrame:
    """Inclusive band; no filter unless both ends are given."""
    if low is None or high is None:
        return df
    return df.where(F.col(column).between(low, high))


def nearest_stations(stations: DataFrame, measurement: DataFrame, points: DataFrame,
                     place_id: str = "station_id") -> DataFrame:
    """Nearest station that has data, per point."""
    with_data = stations.join(measurement.select(place_id).distinct(), place_id, "left_semi")
    return spatial.nearest_place(points, with_data, "point_id", place_id)


def locate(stations: DataFrame, measurement: DataFrame, location: Location,
           place_id: str = "station_id", boundary: str = "exclude",
           altitudes: tuple[float, float] | None = None) -> DataFrame:
    """Stations (or track points) that answer a location, each once."""
    low, high = altitudes or (None, None)
    stations = altitude_band(stations, low, high) if altitudes else stations
    if location.kind == "bbox":
        return spatial.within_box(stations, *location.box, boundary=boundary)
    if location.kind == "polygon":
        return spatial.within_area(stations, location.rings, boundary=boundary)
    hit = nearest_stations(stations, measurement, location.frame(stations.sparkSession), place_id)
    return stations.join(hit.select(place_id).distinct(), place_id, "left_semi")


def read_observations(wide: DataFrame, stations: DataFrame, attributes: list[str],
                      start: str, end: str, location: Location,
                      place_id: str = "station_id", boundary: str = "exclude",
                      altitudes: tuple[float, float] | None = None) -> DataFrame:
    """Wide observations of a location and range in time order.

    Time (with year) prunes partitions of the big table first; the places are
    a small dimension that is located separately and joined as a semi join.
    """
    rows = time_range(wide, start, end)
    places = locate(stations, rows, location, place_id, boundary, altitudes).select(place_id)
    return (rows.join(places, place_id, "left_semi")
            .select(place_id, "date_time", *attributes)
            .orderBy("date_time", place_id))
