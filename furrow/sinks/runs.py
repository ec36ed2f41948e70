"""A manifest of the runs of a forecast cube, kept by its writers.

Each load adds one row with the first and last run date it wrote, observed while the load
was written. The newest run is then known from a few rows; no query looks for a maximum
over the cube.
"""

from __future__ import annotations

import datetime as dt

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from furrow.sinks.tables import merge_partition, write_partitions
from furrow.sinks.versions import read_if_there

_ROW = "first date, last date"


def _manifest(path: str) -> str:
    return path.rstrip("/") + ".runs"


def _recorded(df: DataFrame, partition: str) -> tuple[DataFrame, Observation]:
    seen = Observation()
    return df.observe(seen, F.min(partition).alias("first"), F.max(partition).alias("last")), seen


def _record(df: DataFrame, path: str, seen: Observation) -> None:
    try:
        found = seen.get
    except Py4JJavaError:       # a load known to be empty is planned without the observation
        if not df.isEmpty():
            raise
        return
    if found["first"] is not None:
        row = df.sparkSession.createDataFrame([(found["first"], found["last"])], _ROW)
        row.coalesce(1).write.mode("append").parquet(_manifest(path))


def write_runs(df: DataFrame, path: str, partition: str = "forecast_date", cluster: list[str] = ("lat", "lon")) -> None:
    """Whole runs: a run date written again is replaced."""
    rows, seen = _recorded(df, partition)
    write_partitions(rows, path, [partition], list(cluster))
    _record(df, path, seen)


def merge_runs(df: DataFrame, path: str, keys: list[str], partition: str = "forecast_date",
               cluster: list[str] = ("lat", "lon"), fill: bool = False) -> None:
    """Cells of runs, such as one region of a run date: the other cells stay."""
    rows, seen = _recorded(df, partition)
    merge_partition(rows, path, keys, partition, cluster, fill)
    _record(df, path, seen)


def coverage(spark: SparkSession, path: str) -> tuple[dt.date, dt.date] | None:
    """First and last run date that was ever written, None before the first load."""
    found = read_if_there(spark, _manifest(path))
    if found is None:
        return None
    row = found.agg(F.min("first").alias("first"), F.max("last").alias("last")).first()
    return row["first"], row["last"]


def newest(spark: SparkSession, path: str) -> dt.date | None:
    found = coverage(spark, path)
    return found[1] if found else None
