"""Reconciliation, audit and catalogue reports."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.functions import geo, text
from furrow.operators import spatial


def sent_signal(sent: DataFrame, texts: DataFrame) -> DataFrame:
    """Signal id of a sent message, found by its normalised text."""
    key = text.fold_name(F.concat_ws(" - ", "message", "description"))
    t = texts.select(text.fold_name(F.concat_ws(" - ", "top_message", "description")).alias("_k"),
                     F.col("identifier").alias("sent_signal"))
    one = t.groupBy("_k").agg(F.min("sent_signal").alias("sent_signal"))
    return sent.withColumn("_k", key).join(one, "_k", "left").drop("_k")


def compare_signals(farmers: DataFrame, signals: DataFrame, day: str,
                    advisories: DataFrame | None = None) -> DataFrame:
    """Farmer list with computed and sent signal; ``is_diff`` where they differ."""
    today = signals.where(F.col("date") == F.lit(dt.date.fromisoformat(day)))
    out = farmers.join(today, farmers["farmer_id"] == today["farm_unique_id"], "inner")
    out = out.withColumn("is_diff", (~F.col("signal").eqNullSafe(F.col("sent_signal"))).cast("int"))
    if advisories is not None:
        out = out.join(advisories, "farm_unique_id", "left")
    return out


def difference_share(compared: DataFrame) -> DataFrame:
    return compared.agg(
        F.sum("is_diff").alias("differences"), F.count("*").alias("total"),
    ).withColumn("percentage", F.when(F.col("total") > 0, F.col("differences") * 100 / F.col("total"))
                 .otherwise(F.lit(0.0)))


def stage_differences(advisory: DataFrame, log: DataFrame) -> DataFrame:
    """Advisory rows with the stage an external log claims for (farm, crop).

    Several log rows of a key count once, the first by growth stage name.
    """
    one = log.groupBy("farm_unique_id", "crop").agg(F.min("growth_stage_in").alias("growth_stage_in"))
    return (advisory.join(one, ["farm_unique_id", "crop"])
            .withColumn("diff", (F.col("growth_stage_in") != F.col("growth_stage")).cast("int")))


def stage_counts(compared: DataFrame) -> DataFrame:
    return compared.groupBy("growth_stage").agg(
        F.count("*").alias("farms"), F.coalesce(F.sum("diff"), F.lit(0)).alias("differences"))


def one_per_group(df: DataFrame, group: str, key: str, seed: int = 0) -> DataFrame:
    """One random row per group, the same for the same seed.

    The least hash of (key, seed) wins: an aggregation, not a ranked window.
    """
    from furrow.operators.skew import latest_by
    return latest_by(df, [group], [F.xxhash64(F.col(key), F.lit(seed)), F.col(key)], "first")


def indicator_totals(decisions: DataFrame, indicators: list[str]) -> DataFrame:
    """Sum of each indicator column, missing values as 0."""
    total = decisions.agg(*[F.coalesce(F.sum(F.when(~F.isnan(i), F.col(i))), F.lit(0.0)).alias(i)
                            for i in indicators])
    return total.unpivot([], indicators, "indicator", "total")


def per_country(grids: DataFrame, countries: DataFrame) -> DataFrame:
    n = grids.groupBy("country_id").agg(F.count("*").alias("grids"))
    return n.join(countries, "country_id").select("country", "grids")


def table_sizes(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table; Parquet counts are read from footers."""
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("table"), "rows")
             for n, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def drop_older_copies(df: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """Rows with the greatest id of their key."""
    newest = df.groupBy(*keys).agg(F.max(id_col).alias(id_col))
    return df.join(newest, [*keys, id_col], "left_semi")


def removed_copies(df: DataFrame, keys: list[str]) -> DataFrame:
    """How many rows ``drop_older_copies`` removes."""
    n = df.groupBy(*keys).agg((F.count("*") - 1).alias("_d"))
    return n.agg(F.coalesce(F.sum("_d"), F.lit(0)).alias("removed"))


def group_sizes(membership: DataFrame, users: DataFrame) -> DataFrame:
    """Farms and users of every group; each side is counted before the join."""
    f = membership.groupBy("group_id").agg(F.countDistinct("farm_id").alias("farms"))
    u = users.groupBy("group_id").agg(F.countDistinct("user_id").alias("users"))
    return f.join(u, "group_id", "full").select(
        "group_id", F.coalesce("farms", F.lit(0)).alias("farms"), F.coalesce("users", F.lit(0)).alias("users"))


def grid_export(grids: DataFrame, countries: DataFrame) -> DataFrame:
    """Grid catalogue with centroid and country."""
    c = geo.centroid(F.get("area", 0))
    return (grids.withColumn("_c", c).join(countries, "country_id", "left")
            .select("grid_id", F.col("_c.lon").alias("centroid_lon"),
                    F.col("_c.lat").alias("centroid_lat"), "country"))


def farmer_hits(farmers: DataFrame, grids: DataFrame, key: str, bucket_deg: float = 0.5) -> DataFrame:
    """Farmer centroid in degrees-minutes-seconds and whether a grid holds it."""
    c = geo.centroid(F.get("area", 0))
    spots = farmers.withColumn("_c", c).select(key, F.col("_c.lon").alias("lon"), F.col("_c.lat").alias("lat"))
    hits = spatial.join_points_to_areas(spots, grids.select("grid_id", "area"), bucket_deg=bucket_deg)
    found = hits.groupBy(key).agg(F.min("grid_id").alias("grid_id"))
    return (spots.join(found, key, "left")
            .select(key, geo.decimal_to_dms(F.col("lat"), "N", "S").alias("lat_dms"),
                    geo.decimal_to_dms(F.col("lon"), "E", "W").alias("lon_dms"), "grid_id",
                    F.col("grid_id").isNotNull().alias("hit")))


def hit_rate(hits: DataFrame) -> DataFrame:
    return hits.agg(F.count("*").alias("farmers"), F.count_if("hit").alias("hits")).withColumn(
        "hit_rate", F.col("hits") / F.col("farmers"))


def extent(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    return df.agg(F.min(lon).alias("min_lon"), F.min(lat).alias("min_lat"),
                  F.max(lon).alias("max_lon"), F.max(lat).alias("max_lat"))
