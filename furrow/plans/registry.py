"""Farm registry ingest: farms, grids, lookups, upsert and counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.functions import dates, geo, text
from furrow.operators import spatial
from furrow.operators.skew import dense_ids, latest_by
from furrow.session import scratch_dir, write_stage

KEY = ["group_id", "farm_id", "crop_id", "crop_stage_type_id", "planting_date"]


def read_rows(csv: DataFrame) -> DataFrame:
    """Typed registry rows with a point from a registry CSV."""
    crop = text.split_crop_stage(F.col("crop"))
    return csv.select(
        "farmer_id", crop["crop"].alias("crop_name"), crop["stage"].alias("stage_name"),
        dates.parse_mixed_date(F.col("planting_date")).alias("planting_date"),
        F.col("final_longitude").alias("lon"), F.col("final_latitude").alias("lat"),
        "county", "subcounty", "ward", "language")


def merge_lookup(rows: DataFrame, dimension: DataFrame, field: str, dim_id: str,
                 dim_name: str = "name") -> tuple[DataFrame, DataFrame]:
    """Case-insensitive dimension lookup that adds missing names.

    Returns (rows with ``dim_id``, new dimension). New ids follow the greatest
    existing one. Names are reduced to distinct ones before any join; of
    several spellings of a new name the smallest is stored.
    """
    named = rows.where(F.col(field).isNotNull() & (F.col(field) != ""))
    fresh = (named.groupBy(F.lower(field).alias("_k")).agg(F.min(field).alias(dim_name))
             .join(dimension.select(F.lower(dim_name).alias("_k")).distinct(), "_k", "left_anti"))
    top = dimension.agg(F.coalesce(F.max(dim_id), F.lit(0)))
    added = dense_ids(fresh, "_k", "_seq").select(
        (top.scalar() + F.col("_seq")).cast("long").alias(dim_id), dim_name)
    merged = dimension.select(F.col(dim_id).cast("long").alias(dim_id), dim_name).unionByName(added)
    keys = merged.groupBy(F.lower(dim_name).alias("_k")).agg(F.min(dim_id).alias(dim_id))
    out = (rows.withColumn("_k", F.lower(field)).join(keys, "_k", "left").drop("_k"))
    return out, merged


def lookup_id(rows: DataFrame, dimension: DataFrame, field: str, dim_id: str,
              dim_name: str = "name") -> DataFrame:
    """Case-insensitive id of a name; unknown names stay null."""
    keys = dimension.groupBy(F.lower(dim_name).alias("_k")).agg(F.min(dim_id).alias(dim_id))
    return rows.withColumn("_k", F.lower(field)).join(keys, "_k", "left").drop("_k")


def match_farms(rows: DataFrame, farm: DataFrame) -> DataFrame:
    """Known farms by unique id, with the farm's grid."""
    f = farm.select(F.col("farm_unique_id").alias("farmer_id"), "farm_id", "grid_id")
    return rows.join(f, "farmer_id", "left")


def assign_grid(rows: DataFrame, grid: DataFrame, nearest: bool = False,
                radius_m: float = 8000.0, bucket_deg: float = 0.5) -> DataFrame:
    """Grid of every row.

    Intersecting mode fills only missing grids; nearest mode overwrites what
    the farm said wherever a grid lies within the radius. Distinct points are
    located once. ``grid`` has grid_id, lon, lat (centroid) and area.
    """
    spots = rows.select("lon", "lat").distinct().withColumn(
        "_spot", F.concat_ws(",", F.col("lon").cast("string"), F.col("lat").cast("string")))
    if nearest:
        found = spatial.nearest_within(spots, grid, "_spot", "grid_id", radius_m)
        found = found.select("_spot", F.col("grid_id").alias("_g"))
    else:
        hits = spatial.join_points_to_areas(
            spots, grid.select("grid_id", "area"), bucket_deg=bucket_deg)
        found = hits.groupBy("_spot").agg(F.min("grid_id").alias("_g"))
    located = spots.join(found, "_spot").select("lon", "lat", "_g")
    pick = F.coalesce("_g", "grid_id") if nearest else F.coalesce("grid_id", "_g")
    return rows.join(located, ["lon", "lat"], "left").withColumn("grid_id", pick).drop("_g")


def new_farms(rows: DataFrame, farm: DataFrame) -> DataFrame:
    """Farm rows to insert: unknown farmers with a grid, one each, new ids."""
    fresh = rows.where(F.col("farm_id").isNull() & F.col("grid_id").isNotNull())
    one = latest_by(fresh.select("farmer_id", "lon", "lat", "grid_id"), ["farmer_id"],
                    ["lon", "lat", "grid_id"], keep="first")
    top = farm.agg(F.coalesce(F.max("farm_id"), F.lit(0)))
    return dense_ids(one, "farmer_id", "_seq").select(
        (top.scalar() + F.col("_seq")).cast("long").alias("farm_id"),
        F.col("farmer_id").alias("farm_unique_id"), "lon", "lat", "grid_id")


def split_upsert(rows: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that update an existing registry row, rows to insert).

    Rows that lack farm, crop, stage, date or grid are not inserted; equal
    keys within the file count once.
    """
    existing = registry.select("registry_id", *KEY)
    updates = rows.join(existing, KEY)
    ready = rows.dropna(subset=["farm_id", "crop_id", "crop_stage_type_id", "planting_date", "grid_id"])
    rest = [c for c in ready.columns if c not in KEY]
    inserts = latest_by(ready.join(existing, KEY, "left_anti"), KEY, rest, keep="first")
    return updates, inserts


def apply_updates(registry: DataFrame, updates: DataFrame, columns: list[str]) -> DataFrame:
    """Registry with the dimensions of the matched rows replaced."""
    new = latest_by(updates.select("registry_id", *columns), ["registry_id"], list(columns), keep="first")
    new = new.select("registry_id", F.lit(True).alias("_m"), *[F.col(c).alias(f"_{c}") for c in columns])
    out = registry.join(new, "registry_id", "left")
    return out.withColumns({
        c: F.when(F.col("_m"), F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}
    ).drop("_m", *[f"_{c}" for c in columns])


def counts(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """One row: total, insertable, existing, mismatch flag."""
    existing = registry.select(*KEY, F.lit(1).alias("_e")).distinct()
    marked = rows.join(existing, KEY, "left")
    complete = F.lit(True)
    for c in ("farm_id", "crop_id", "crop_stage_type_id", "planting_date", "grid_id"):
        complete = complete & F.col(c).isNotNull()
    is_old = F.col("_e").isNotNull()
    return marked.agg(
        F.count("*").alias("total"),
        F.count_if(complete & ~is_old).alias("insertable"),
        F.count_if(is_old).alias("existing")).withColumn(
        "mismatch", F.col("total") != F.col("insertable") + F.col("existing"))


@dataclass
class RegistryLoad:
    """What one registry file turns into."""

    rows: DataFrame
    farms: DataFrame
    inserts: DataFrame
    updates: DataFrame
    counts: DataFrame
    dimensions: dict[str, DataFrame]


def ingest(csv: DataFrame, group_id: int, farm: DataFrame, grid: DataFrame, crop: DataFrame,
           stage_type: DataFrame, registry: DataFrame,
           dimensions: dict[str, DataFrame] | None = None, nearest: bool = False) -> RegistryLoad:
    """Registry CSV → farms to insert, registry inserts and updates, counts.

    ``dimensions`` maps a text column (county, ...) to its table (id, name).
    """
    rows = read_rows(csv).withColumn("group_id", F.lit(group_id))
    rows = assign_grid(match_farms(rows, farm), grid, nearest)
    # five results read these rows; the spatial join behind them runs once
    rows = write_stage(rows, scratch_dir(csv.sparkSession, "registry"))
    rows = lookup_id(rows, crop, "crop_name", "crop_id", "crop")
    rows = lookup_id(rows, stage_type, "stage_name", "crop_stage_type_id", "stage_type")
    merged = {}
    for field, dim in (dimensions or {}).items():
        rows, merged[field] = merge_lookup(rows, dim, field, f"{field}_id")
    fresh = new_farms(rows, farm)
    ids = fresh.select(F.col("farm_unique_id").alias("farmer_id"), F.col("farm_id").alias("_new"))
    rows = (rows.join(ids, "farmer_id", "left")
            .withColumn("farm_id", F.coalesce("farm_id", "_new")).drop("_new"))
    updates, inserts = split_upsert(rows, registry)
    return RegistryLoad(rows, fresh, inserts, updates, counts(rows, registry), merged)
