"""Table schemas, casting by column name, required columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# DDL of the fixed tables and files
MEASUREMENT = ("station_id long, station_history_id long, attribute string, "
               "date_time timestamp_ntz, value double")
RULE_CSV = ("crop string, parameter string, growth_stage string, "
            "min_range double, max_range double, code string")
MESSAGE_CSV = ("code string, message_english string, message_kiswahili string, "
               "message_priority int")
GRID_CSV = ("locationid string, latitude double, longitude double, country string, "
            "elevation double, shapewkt string, name string")
REGISTRY_CSV = ("farmer_id string, crop string, planting_date string, final_latitude double, "
                "final_longitude double, county string, subcounty string, ward string, "
                "language string")


def names(ddl: str) -> list[str]:
    """Column names of a flat DDL string."""
    return [part.split()[0] for part in ddl.split(",")]


#: column name -> type of the advisory tables
ADVISORY_TYPES = {
    "date": "date", "farm_id": "long", "grid_id": "long", "registry_id": "long",
    "crop_id": "int", "crop_stage_type_id": "int", "country_id": "int", "config_id": "int",
    "growth_stage_id": "int", "growth_stage_start_date": "long",
    "prev_growth_stage_id": "int", "prev_growth_stage_start_date": "long",
    "planting_date_epoch": "long", "planting_date": "date",
    "total_gdd": "double", "seasonal_precipitation": "double",
    "growth_stage_precipitation": "double", "temperature": "double",
    "humidity": "double", "p_pet": "double", "gdd_base": "double", "gdd_cap": "double",
    "message": "int", "message_2": "int", "message_3": "int", "message_4": "int",
    "message_5": "int", "final_message": "int", "prev_week_message": "int",
    "is_empty_message": "boolean", "has_repetitive_message": "boolean",
}


def cast_by_name(df: DataFrame, types: dict[str, str] = ADVISORY_TYPES) -> DataFrame:
    """Cast the columns the map knows; the others stay as they are."""
    return df.withColumns({c: F.col(c).cast(types[c]) for c in df.columns if c in types})


def check_columns(df: DataFrame, required: list[str]) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"Column(s) missing: {', '.join(missing)}")
    return df


def first_present(df: DataFrame, names: list[str]) -> Column:
    """The first non-null among alternative headers; an error if none exists."""
    have = [F.col(n) for n in names if n in df.columns]
    if not have:
        raise ValueError(f"None of the columns {names} is present")
    return F.coalesce(*have)


def backfill(df: DataFrame, columns: list[str], dtype: str = "double") -> DataFrame:
    """Absent columns as typed nulls."""
    return df.withColumns({c: F.lit(None).cast(dtype) for c in columns if c not in df.columns})


def rename_attributes(df: DataFrame, keys: list[str], mapping: dict[str, str]) -> DataFrame:
    """Project keys and attributes, source name → variable name."""
    return df.select(*keys, *[F.col(src).alias(var) for src, var in mapping.items()])


def with_metadata(df: DataFrame, meta: dict[str, dict]) -> DataFrame:
    """Unit and long name carried in the schema of the result columns."""
    return df.select(*[F.col(c).alias(c, metadata=meta[c]) if c in meta else F.col(c)
                       for c in df.columns])
