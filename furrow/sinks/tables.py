"""Partitioned table writes, clustered layouts and snapshot replacement."""

from __future__ import annotations

import datetime as dt
from functools import reduce
from urllib.parse import unquote, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from furrow.functions import geo
from furrow.session import scratch_dir, write_stage
from furrow.sinks.versions import read_if_there

MAX_RECORDS = 5_000_000
MAX_TOUCHED = 10_000


def one_per_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows with equal keys the one whose columns have the smallest hash, whatever
    the partitioning. The ranked window is cut to one row a key before the shuffle."""
    tie = F.xxhash64(*[F.col(f"`{c}`") for c, t in df.dtypes if not t.startswith(("map", "variant"))])
    first = Window.partitionBy(*keys).orderBy(tie)
    return df.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")


def touched_partitions(new: DataFrame, partitions: list[str], limit: int = MAX_TOUCHED) -> Column | None:
    """The partition values of a load as a literal condition, so that a scan of the stored
    table is pruned to them. None for a load that touches more than ``limit``."""
    rows = new.select(*partitions).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        return None
    kinds, last = {c: new.schema[c].dataType for c in partitions}, partitions[-1]

    def among(column: str, values: set) -> Column:
        stored = F.col(column).cast(kinds[column])
        known = stored.isin(*[F.lit(v) for v in values if v is not None])
        return known | stored.isNull() if None in values else known

    leading: dict[tuple, set] = {}
    for r in rows:
        leading.setdefault(tuple(r)[:-1], set()).add(r[last])
    found = [reduce(Column.__and__, [among(c, {v}) for c, v in zip(partitions, front)] + [among(last, values)])
             for front, values in leading.items()]
    while len(found) > 1:       # pairwise, so that the expression stays shallow
        found = [a | b for a, b in zip(found[::2], found[1::2])] + found[len(found) // 2 * 2:]
    return found[0] if found else F.lit(False)


def read_touched(spark: SparkSession, path: str, condition: Column | None) -> DataFrame | None:
    """Stored rows of the partitions a load touches, with all their columns.

    The condition prunes the listing; only folders that remain are opened, their
    schemas merged. None where nothing is stored there. Without a condition the whole
    table is read.
    """
    stored = read_if_there(spark, path)
    if stored is None or condition is None:
        return stored if stored is None else spark.read.option("mergeSchema", True).parquet(path)
    folder = F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("folder")
    folders = [r["folder"] for r in stored.where(condition).select(folder).distinct().collect()]
    if not folders:
        return None
    plain = [unquote(urlsplit(f).path) if f.startswith("file:") else unquote(f) for f in folders]
    return spark.read.option("mergeSchema", True).option("basePath", path).parquet(*plain)


def with_types_of(stored: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """Partition columns, whose types are read from folder names, as the load has them."""
    return stored.withColumns({c: F.col(c).cast(new.schema[c].dataType) for c in columns})


def write_partitions(df: DataFrame, path: str, partitions: list[str], cluster: list[str] = (),
                     mode: str = "overwrite") -> None:
    """Parquet by partition columns; 'overwrite' replaces only the partitions written.

    Range partitioning over (partitions, cluster) gives each task a slice of
    few partitions and splits one that is too big for a task, which hashing on
    the partition columns alone would not.
    """
    if cluster:
        order = [*partitions, *cluster]
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    (df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
     .option("compression", "zstd").option("maxRecordsPerFile", MAX_RECORDS)
     .partitionBy(*partitions).parquet(path))


def write_advisory(df: DataFrame, path: str) -> None:
    """Advisories by iso_a3, year, month, day; re-running a day replaces it."""
    write_partitions(df, path, ["iso_a3", "year", "month", "day"], ["grid_id", "registry_id"])


def write_observations(df: DataFrame, path: str, use_month: bool = False) -> None:
    """Wide observations by year (and month), clustered on a Morton key.

    Row groups then cover small boxes, so lon/lat bounds prune them. Time is
    the last part of the range key: a station with a third of all rows is
    spread over many files.
    """
    parts = ["year", "month"] if use_month else ["year"]
    keyed = df.withColumn("_z", geo.z_key(F.col("lon"), F.col("lat")))
    order = [*parts, "_z", "date_time"]
    keyed = keyed.repartitionByRange(*order).sortWithinPartitions(*order).drop("_z")
    (keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .option("compression", "zstd").option("maxRecordsPerFile", MAX_RECORDS)
     .partitionBy(*parts).parquet(path))


def append_observations(spark: SparkSession, new: DataFrame, path: str, use_month: bool = False,
                        keys: list[str] = ("station_id", "date_time")) -> None:
    """Add rows to existing partitions by column name and cluster them again.

    Only the touched partitions are read (``read_touched``). The union goes to a staged
    table first: the target is never overwritten while it is being read, and a job
    lost between the two steps can repeat the second one. Rows whose key is
    already stored are not added twice; of equal keys of one load one row is added
    (``one_per_key``). Columns that earlier loads brought are kept.
    """
    parts = ["year", "month"] if use_month else ["year"]
    new = one_per_key(new, list(keys))
    existing = read_touched(spark, path, touched_partitions(new, parts))
    if existing is not None:
        existing = with_types_of(existing, new, parts)
        fresh = new.join(existing.select(*keys), list(keys), "left_anti")
        new = existing.unionByName(fresh, allowMissingColumns=True)
    write_observations(write_stage(new, scratch_dir(spark, "staged")), path, use_month)


def _converted(measurement: DataFrame, stations: DataFrame, attributes: list[str], start: str, end: str,
               use_month: bool) -> DataFrame:
    """Wide observations of [start, end), with station position and time parts."""
    from furrow.plans import observations
    at = F.col("date_time")
    rows = measurement.where((at >= F.lit(start).cast("timestamp_ntz")) & (at < F.lit(end).cast("timestamp_ntz")))
    wide = observations.to_wide(rows, ["station_id", "date_time"], attributes)
    wide = wide.where(F.coalesce(*[F.col(a) for a in attributes]).isNotNull())
    return observations.with_time_parts(wide.join(stations.select("station_id", "lon", "lat"), "station_id"), use_month)


def convert_observations(measurement: DataFrame, stations: DataFrame, path: str, attributes: list[str],
                         start: str, end: str, use_month: bool = False) -> list[str]:
    """Narrow measurements of [start, end) into the wide table, one period after the other.

    A period (a year, or a month) is converted and written on its own, so the run
    can be taken up again where it stopped; writing a period again replaces it. Periods
    are whole: give the start of one as ``start``. Returns the starts of the periods.
    """
    first, last = dt.date.fromisoformat(start), dt.date.fromisoformat(end)
    at, done = first, []
    while at < last:
        if use_month:
            after = dt.date(at.year + at.month // 12, at.month % 12 + 1, 1)
        else:
            after = dt.date(at.year + 1, 1, 1)
        write_observations(_converted(measurement, stations, attributes, at.isoformat(), min(after, last).isoformat(),
                                      use_month), path, use_month)
        done.append(at.isoformat())
        at = after
    return done


def append_between(measurement: DataFrame, stations: DataFrame, path: str, attributes: list[str],
                   start: str, end: str, use_month: bool = False) -> None:
    """Measurements of [start, end) added to the converted table, times already there left as they are."""
    append_observations(measurement.sparkSession, _converted(measurement, stations, attributes, start, end, use_month),
                        path, use_month)


def upsert_partition(df: DataFrame, path: str, partition: str = "forecast_date",
                     cluster: list[str] = ("lat", "lon")) -> None:
    """Cube slice by date: writing a date again replaces it."""
    write_partitions(df, path, [partition], list(cluster))


def merge_partition(df: DataFrame, path: str, keys: list[str], partition: str = "forecast_date",
                    cluster: list[str] = ("lat", "lon"), fill: bool = False) -> None:
    """Cells of a slice: written cells replace stored ones of the same keys, the
    other cells of the touched partitions stay. Repeating a load changes nothing.
    With ``fill``, values a load doesn't bring (null) are taken from the stored cell.

    Only touched partitions are read and written (``read_touched``); of equal keys of a
    load one row counts (``one_per_key``). The result is staged before the old one goes.
    """
    spark = df.sparkSession
    new = write_stage(one_per_key(df, [partition, *keys]), scratch_dir(spark, "staged"))
    touched = read_touched(spark, path, touched_partitions(new, [partition]))
    if touched is None:
        return write_partitions(new, path, [partition], list(cluster))
    touched = with_types_of(touched, new, [partition])
    rest = touched.join(new.select(partition, *keys), [partition, *keys], "left_anti")
    if fill:
        values = [c for c in touched.columns if c not in (partition, *keys)]
        old = touched.select(partition, *keys, *[F.col(c).alias(f"_old_{c}") for c in values])
        new = new.join(old, [partition, *keys], "left").select(partition, *keys, *[
            F.coalesce(F.col(c), F.col(f"_old_{c}")).alias(c) if c in new.columns
            else F.col(f"_old_{c}").alias(c) for c in values],
            *[c for c in new.columns if c not in (partition, *keys, *values)])
    staged = write_stage(rest.unionByName(new, allowMissingColumns=True), scratch_dir(spark, "staged"))
    write_partitions(staged, path, [partition], list(cluster))


def replace_in_snapshot(spark: SparkSession, new: DataFrame, path: str, day: str,
                        column: str = "date") -> None:
    """Replace one date inside its month of a monthly snapshot table."""
    from furrow.plans.planting import replace_date
    year, month = int(day[:4]), int(day[5:7])
    old = spark.read.option("mergeSchema", True).parquet(path).where((F.col("year") == year) & (F.col("month") == month))
    staged = write_stage(replace_date(old, new, day, column), scratch_dir(spark, "staged"))
    write_partitions(staged, path, ["year", "month"])


def write_signals(df: DataFrame, path: str) -> None:
    """Planting signals by month, clustered on a Morton key."""
    keyed = df.withColumn("_z", geo.z_key(F.col("lon"), F.col("lat")))
    order = ["year", "month", "_z", "farm_id"]
    keyed = keyed.repartitionByRange(*order).sortWithinPartitions(*order).drop("_z")
    (keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("year", "month").parquet(path))


def replace_table(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Overwrite a whole table from a result that may read it.

    The new content is complete in a staged table before the old one goes.
    """
    staged = write_stage(df, scratch_dir(spark, "staged"))
    staged.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)
