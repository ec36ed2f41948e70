"""Partition- and key-pruned scans of stored tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def on_day(df: DataFrame, day: str) -> DataFrame:
    """One day of a year/month/day partitioned table."""
    d = dt.date.fromisoformat(day)
    return df.where((F.col("year") == d.year) & (F.col("month") == d.month) & (F.col("day") == d.day))


def advisory_scan(spark: SparkSession, path: str, day: str) -> DataFrame:
    return on_day(spark.read.parquet(path), day)


def by_keys(df: DataFrame, keys: DataFrame, on: str, columns: list[str]) -> DataFrame:
    """Chosen columns of the rows whose key is asked for."""
    return df.select(on, *[c for c in columns if c != on]).join(keys.select(on).distinct(), on, "left_semi")


def previous_message_scan(df: DataFrame, day: str) -> DataFrame:
    """Distinct final messages of one exact run date; empty without the column."""
    from furrow.plans.advisory import MATCH_KEYS
    if "final_message" not in df.columns:
        return df.select(*MATCH_KEYS).limit(0).withColumn("prev_week_message", F.lit(None).cast("int"))
    return (on_day(df, day).where(F.col("final_message").isNotNull())
            .select(*MATCH_KEYS, F.col("final_message").alias("prev_week_message")).distinct())


def snapshot_scan(df: DataFrame, day: str, farms: DataFrame | list[str] | None = None,
                  groups: list[str] | None = None) -> DataFrame:
    """Planting signals of a date, optionally of some farms or groups."""
    d = dt.date.fromisoformat(day)
    out = df.where((F.col("year") == d.year) & (F.col("month") == d.month) & (F.col("date") == F.lit(d)))
    if isinstance(farms, DataFrame):
        out = out.join(farms.select("farm_unique_id").distinct(), "farm_unique_id", "left_semi")
    elif farms:
        out = out.where(F.col("farm_unique_id").isin(farms))
    return out.where(F.col("farm_group").isin(groups)) if groups else out


def relational(spark: SparkSession, url: str, table: str, key: str, low: int, high: int,
               partitions: int = 25, **options: str) -> DataFrame:
    """A database table read in key ranges by several tasks."""
    return (spark.read.format("jdbc").option("url", url).option("dbtable", table)
            .option("partitionColumn", key).option("lowerBound", low).option("upperBound", high)
            .option("numPartitions", partitions).options(**options).load())


def range_parts(df: DataFrame, key: str, low: int, high: int, parts: int = 25) -> DataFrame:
    """Key-range split of a stored table, the Parquet form of ``relational``.

    Adds ``part`` and places each range in its own partition; keys outside
    [low, high) go to the first and last part, so no row is lost.
    """
    width = max((high - low + parts - 1) // parts, 1)
    part = F.floor((F.col(key) - low) / width)
    bounded = F.least(F.greatest(part, F.lit(0)), F.lit(parts - 1)).cast("int")
    return df.withColumn("part", bounded).repartitionByRange(parts, "part", key)


def page(df: DataFrame, key: str, limit: int, offset: int) -> DataFrame:
    """Deterministic page in key order; for the first pages of a table without an index."""
    return df.orderBy(key).offset(offset).limit(limit)


def write_paged(df: DataFrame, path: str, key: str, rows_per_file: int = 100_000) -> None:
    """A table in key order, with an index of its files (first and last key, rows) beside it."""
    (df.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite")
     .option("maxRecordsPerFile", rows_per_file).parquet(path))
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    index = stored.groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.min(key).alias("first"), F.max(key).alias("last"), F.count("*").alias("n"))
    index.coalesce(1).write.mode("overwrite").parquet(path.rstrip("/") + ".index")


def read_page(spark: SparkSession, path: str, key: str, limit: int, offset: int) -> DataFrame:
    """Page of a table from ``write_paged``: only the key range that holds it is read.

    The index has one row per file; the rows of the files before the page are skipped by
    their counts, so a late page costs what the first one does. Keys are unique.
    """
    table = spark.read.parquet(path)
    files = spark.read.parquet(path.rstrip("/") + ".index").orderBy("first").toLocalIterator()
    before, skip, low, high = 0, 0, None, None
    for f in files:
        if low is None and before + f["n"] > offset:
            low, skip = f["first"], offset - before
        before += f["n"]
        if low is not None:
            high = f["last"]
        if before >= offset + limit:
            break
    if low is None:
        return table.limit(0)
    return table.where(F.col(key).between(low, high)).orderBy(key).offset(skip).limit(limit)
