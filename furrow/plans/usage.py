"""Request-log reports and sliding-window counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions import text


def per_day(log: DataFrame) -> DataFrame:
    """Requests per day, newest first."""
    return (log.groupBy(F.to_date("requested_at").alias("day")).agg(F.count("*").alias("requests"))
            .orderBy(F.desc("day")))


def per_product(log: DataFrame) -> DataFrame:
    return (log.groupBy(F.get_json_object("query_params", "$.product").alias("product"))
            .agg(F.count("*").alias("requests")))


EXPORT_FIELDS = ["product", "attributes", "output_type", "start_date", "end_date"]


def export(log: DataFrame) -> DataFrame:
    """Log rows with the query parameters as columns; absent ones are empty."""
    keep = [c for c in log.columns if c != "query_params"]
    return log.select(*keep, *[text.json_field(F.col("query_params"), f).alias(f) for f in EXPORT_FIELDS])


def normalise(log: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Log rows as stored: attribute list without blanks, user looked up."""
    out = log.withColumn("attributes", text.attribute_list(
        text.json_field(F.col("query_params"), "attributes")))
    return out if users is None else out.join(users, "user_id", "left")


def sliding_counts(log: DataFrame, minutes: int, user: str = "user_id", ts: str = "requested_at") -> DataFrame:
    """Requests of each user over the last ``minutes``, at every active minute.

    Counts per (user, minute) come first. The moving sum then runs inside
    blocks of the window length, each with the block before it as context, so
    a task never holds more than two blocks of one user.
    """
    minute = F.floor(F.unix_micros(F.date_trunc("minute", ts).cast("timestamp")) / 60000000).cast("long")
    base = log.groupBy(user, minute.alias("minute")).agg(F.count("*").alias("_n"))
    own = F.floor(F.col("minute") / minutes).cast("long")
    blocks = base.withColumn("_b", F.explode(F.array(own, own + 1))).withColumn("_ctx", F.col("_b") != own)
    w = Window.partitionBy(user, "_b").orderBy("minute").rangeBetween(-(minutes - 1), 0)
    return (blocks.withColumn("requests", F.sum("_n").over(w)).where(~F.col("_ctx"))
            .select(user, F.timestamp_seconds(F.col("minute") * 60).cast("timestamp_ntz").alias("minute_start"),
                    "requests"))


def waiting_seconds(now: Column, exceeded: Column) -> Column:
    """Seconds until the longest exceeded window resets.

    ``exceeded`` is the array of exceeded window lengths in minutes: below 60
    waits for the next minute, 60 for the hour, 1440 for the day.
    """
    left = lambda unit: F.lit(unit) - F.pmod(now, F.lit(unit))
    return F.array_max(F.array_compact(F.array(
        F.when(F.exists(exceeded, lambda m: m < 60), left(60)),
        F.when(F.array_contains(exceeded, 60), left(3600)),
        F.when(F.array_contains(exceeded, 1440), left(86400)))))


def errors_per_status(responses: DataFrame) -> DataFrame:
    return (responses.where(F.col("status_code") != 200).groupBy("status_code")
            .agg(F.count("*").alias("errors")))
