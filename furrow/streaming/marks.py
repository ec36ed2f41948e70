"""High-water marks: where the last committed run of an incremental ingest stopped.

A mark is the latest time stored for a key, such as (station, attribute) or a mission.
Marks are a versioned table beside the target. A run reads the newest committed marks,
takes what lies at or after them, writes its rows under its own batch number and only
then commits the next marks. A run that dies before that is repeated from the same marks
under the same number and overwrites its own rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.session import scratch_dir, write_stage
from furrow.sinks.tables import one_per_key, read_touched, touched_partitions, with_types_of
from furrow.sinks.versions import Versions

DEFAULT_DAYS = 365


def store_of(spark: SparkSession, target: str) -> Versions:
    return Versions(spark, target.rstrip("/") + ".marks")


def _start(mark, now, days: int, overlap: str):
    floor = F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(days)} DAYS")
    return F.coalesce(mark - F.expr(f"INTERVAL {overlap}"), floor)


def windows(keys: DataFrame, marks: DataFrame | None, now: str, days: int = DEFAULT_DAYS,
            overlap: str = "0 days") -> DataFrame:
    """What to ask a provider for: each key with its start (its mark, or ``days`` back) and end."""
    names = keys.columns
    empty = keys.limit(0).withColumn("mark", F.lit(None).cast("timestamp_ntz"))
    found = keys.distinct().join(empty if marks is None else marks, names, "left")
    return found.select(*names, _start(F.col("mark"), now, days, overlap).alias("start"),
                        F.lit(now).cast("timestamp_ntz").alias("end"))


def since(rows: DataFrame, marks: DataFrame | None, keys: list[str], now: str, time: str = "date_time",
          days: int = DEFAULT_DAYS, overlap: str = "0 days") -> DataFrame:
    """Rows of the window of their key. ``overlap`` looks back before a mark for late rows.

    A station with a third of all rows is left to the adaptive skew join: there is
    one mark a key. Rows before the earliest possible start are dropped at the scan.
    """
    end = F.lit(now).cast("timestamp_ntz")
    rows = rows.where(F.col(time) <= end)
    if marks is None:
        return rows.where(F.col(time) >= _start(F.lit(None).cast("timestamp_ntz"), now, days, overlap))
    least = marks.agg(F.min("mark")).first()[0]
    if least is not None:
        floor = F.least(F.lit(least).cast("timestamp_ntz") - F.expr(f"INTERVAL {overlap}"),
                        _start(F.lit(None).cast("timestamp_ntz"), now, days, overlap))
        rows = rows.where(F.col(time) >= floor)
    return (rows.join(marks.select(*keys, F.col("mark").alias("_mark")), keys, "left")
            .where(F.col(time) >= _start(F.col("_mark"), now, days, overlap)).drop("_mark"))


def advanced(marks: DataFrame | None, rows: DataFrame, keys: list[str], time: str = "date_time") -> DataFrame:
    """Marks after storing ``rows``; a mark never goes back."""
    new = rows.select(*keys, F.col(time).cast("timestamp_ntz").alias("mark"))
    both = new if marks is None else new.unionByName(marks.select(*keys, "mark"))
    return both.groupBy(*keys).agg(F.max("mark").alias("mark"))


def ingest_since(source: DataFrame, target: str, now: str, keys: list[str], time: str = "date_time",
                 row_keys: list[str] = ("station_id", "attribute", "date_time"), days: int = DEFAULT_DAYS,
                 overlap: str = "0 days") -> int:
    """One run: rows at or after the marks into ``target`` (by batch and day), each row
    key once, then the next marks. Returns the number of the committed run.

    A row that is stored already keeps its value; of equal row keys in one run one counts
    (``one_per_key``). Only the days that the run touches are read from the target.
    """
    spark = source.sparkSession
    store = store_of(spark, target)
    version, _ = store.latest()
    marks, run = store.read(), version + 1
    new = one_per_key(since(source, marks, keys, now, time, days, overlap), list(row_keys))
    new = write_stage(new.withColumn("day", F.to_date(time)), scratch_dir(spark, "staged"))
    stored = read_touched(spark, target, touched_partitions(new, ["day"]))
    if stored is not None:
        others = with_types_of(stored, new, ["day"]).where(F.col("batch_id") != run)
        found = others.select(*[F.col(k).alias(f"_{k}") for k in row_keys])
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in row_keys]
        new = write_stage(new.join(found, same, "left_anti"), scratch_dir(spark, "staged"))
    (new.withColumn("batch_id", F.lit(run)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch_id").parquet(target))
    advanced(marks, new, keys, time).write.mode("overwrite").parquet(store.folder(run))
    store.commit(run, now=now)
    return run
