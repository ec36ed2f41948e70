"""Landed files → typed rows: CSV sheets and provider JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow import schema
from furrow.functions import dates, geo, text
from furrow.session import scratch_dir, write_stage

# fixed values: provider document shapes
TIMELINE = ("struct<data: struct<timelines: array<struct<intervals: array<struct<"
            "startTime: string, values: map<string, double>>>>>>>")
SERIES = "struct<results: array<struct<series: array<struct<name: string, columns: array<string>, values: array<array<string>>>>>>>"
DEVICES = "struct<items: array<struct<id: string, name: string, current_location: struct<gps: array<double>>>>>"
BALLOON = ("struct<has_next_page: boolean, next_since: long, observations: array<struct<"
           "altitude: double, humidity: double, latitude: double, longitude: double, mission_id: string, "
           "mission_name: string, pressure: double, specific_humidity: double, temperature: double, timestamp: long>>>")
DEVICE_EXCLUDED = ["slp", "wind_heading"]


def utc(textual: Column) -> Column:
    """ISO instant text → timestamp without zone (UTC)."""
    return F.to_timestamp(textual).cast("timestamp_ntz")


MICROS = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"


def read_sheet(spark: SparkSession, path: str, ddl: str, **options: str) -> DataFrame:
    """CSV with a header → typed columns found by name.

    Cells come as text and are cast by name, so a sheet with its columns in
    another order, or with extra ones, is read correctly; a missing column is
    an error, a cell that does not parse is null.
    """
    raw = spark.read.option("header", True).options(**options).csv(path)
    fields = [part.split() for part in ddl.split(",")]
    schema.check_columns(raw, [f[0] for f in fields])
    return raw.select(*[F.col(n).try_cast(t).alias(n) for n, t in fields])


def rule_rows(csv: DataFrame, crops: DataFrame, stage_types: DataFrame, stages: DataFrame,
              parameters: DataFrame, config_id: int) -> DataFrame:
    """Rule CSV → rule rows with ids looked up by name (case-insensitive)."""
    schema.check_columns(csv, schema.names(schema.RULE_CSV))
    part = text.split_crop_stage(F.col("crop"))
    rows = csv.withColumn("_p", part).select(
        F.lower("_p.crop").alias("_c"), F.lower("_p.stage").alias("_t"),
        F.lower("growth_stage").alias("_g"), F.lower("parameter").alias("_a"),
        "min_range", "max_range", "code")
    low = lambda d, name, key, idc: d.select(F.lower(name).alias(key), idc)
    return (rows.join(low(crops, "crop", "_c", "crop_id"), "_c")
            .join(low(stage_types, "stage_type", "_t", "crop_stage_type_id"), "_t")
            .join(low(stages, "growth_stage", "_g", "growth_stage_id"), "_g")
            .join(low(parameters, "label", "_a", "parameter"), "_a")
            .select(F.lit(config_id).alias("config_id"), "crop_id", "crop_stage_type_id",
                    "growth_stage_id", "parameter", "min_range", "max_range",
                    F.col("code").cast("int").alias("code")))


def message_rows(csv: DataFrame, config_id: int) -> tuple[DataFrame, DataFrame]:
    """Message CSV → (templates, priorities)."""
    schema.check_columns(csv, schema.names(schema.MESSAGE_CSV))
    code = F.col("code").cast("int").alias("code")
    templates = csv.select(code, F.col("message_english").alias("template_en"),
                           F.col("message_kiswahili").alias("template_sw"))
    priorities = csv.select(F.lit(config_id).alias("config_id"), code,
                            F.col("message_priority").alias("priority"))
    return templates, priorities


def grid_rows(csv: DataFrame) -> DataFrame:
    """Grid CSV with WKT polygons; one row per (unique id, shape)."""
    schema.check_columns(csv, schema.names(schema.GRID_CSV))
    return (csv.dropDuplicates(["locationid", "shapewkt"])
            .select(F.col("locationid").alias("unique_id"), F.col("latitude").alias("lat"),
                    F.col("longitude").alias("lon"), "country", "elevation", "name",
                    geo.rings_from_wkt(F.col("shapewkt")).alias("area"))
            .where(F.size("area") > 0))


def station_directory(spark: SparkSession, path: str, attributes: list[str],
                      min_date: str | None = None) -> tuple[DataFrame, DataFrame]:
    """CSV folder → (stations, EAV rows).

    Folders are walked. Files with ``station`` in their name, in any case, list
    stations; the code of every other file is its name up to the first ``_`` or
    ``.``. Columns go by header name, the time is ``date`` or ``timestamp`` in any
    case. Dates come in two formats, empty cells are skipped, and rows before
    ``min_date`` are left out.
    """
    raw = _sheets(spark, path, listing=False)
    times = [c for c in raw.columns if c.lower() in ("date", "timestamp")]
    raw = raw.withColumn("date", F.coalesce(*[F.col(c) for c in times]) if times else F.lit(None).cast("string"))
    rows = station_rows(raw.withColumn("station_code", F.regexp_extract("_f", r"^([^_.]+)", 1)), attributes)
    return _sheets(spark, path, listing=True).drop("_f"), rows.where(F.col("date") >= min_date) if min_date else rows


def _sheets(spark: SparkSession, path: str, listing: bool) -> DataFrame:
    """Text cells of the station listings, or of all other sheets, with ``_f``, the file's name.

    The folder is read as lines in one scan, however many files it has; the first line
    with text of each file names its cells. Only the distinct headers come to the driver.
    """
    is_listing = F.lower("_metadata.file_name").contains("station")
    lines = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.[cC][sS][vV]").text(path)
             .where(is_listing if listing else ~is_listing)
             .select("value", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_name").alias("_f"),
                     F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_row"))
             .where(F.trim("value") != ""))
    first = lines.where("_at = 0").groupBy("_path").agg(F.min(F.struct("_row", "value")).alias("_h"))
    first = write_stage(first.select("_path", F.col("_h._row").alias("_head"), F.rtrim("_h.value").alias("header")),
                        scratch_dir(spark, "headers"))
    width = F.size(F.split(F.regexp_replace("header", '"[^"]*"', ""), ","))
    heads = first.groupBy("header").agg(width.alias("_n"))
    cells = [f"c{i}" for i in range(heads.agg(F.max("_n")).first()[0] or 1)]
    parse = lambda df, c: df.withColumn("_s", F.from_csv(c, ", ".join(f"{n} string" for n in cells))).withColumn(
        "_cells", F.array(*[F.col(f"_s.{n}") for n in cells])).drop("_s")
    lower = F.transform("_cells", F.lower)
    name = lambda c, i: F.when(c.isNull(), F.concat(F.lit("_c"), i.cast("string"))).when(
        F.size(F.filter(lower, lambda other: other == F.lower(c))) > 1, F.concat(c, i.cast("string"))).otherwise(c)
    heads = parse(heads, "header").select("header", F.slice(F.transform("_cells", name), 1, F.col("_n")).alias("_names"))
    columns: dict[str, str] = {}
    for head in heads.orderBy("header").toLocalIterator():
        for column in head["_names"]:
            columns.setdefault(column.lower(), column)
    names = first.join(heads, "header").select("_path", "_head", F.transform("_names", F.lower).alias("_names"))
    body = parse(lines.join(names, "_path").where("_at > 0 or _row > _head"), "value")
    return body.select("_f", *[F.get("_cells", (F.array_position("_names", low) - 1).cast("int")).alias(column)
                               for low, column in columns.items()])


def station_rows(raw: DataFrame, attributes: list[str]) -> DataFrame:
    """Text cells of station sheets (station_code, date, ...) → EAV rows."""
    cols = [a for a in attributes if a in raw.columns]
    rows = raw.select("station_code", dates.parse_mixed_date(F.col("date")).alias("date"),
                      *[F.col(c).try_cast("double").alias(c) for c in cols])
    if not cols:
        return rows.select("station_code", "date", F.lit("").alias("attribute"), F.lit(0.0).alias("value")).limit(0)
    long = rows.unpivot(["station_code", "date"], cols, "attribute", "value")
    return long.where("value is not null and date is not null")


def timeline_rows(docs: DataFrame, keys: list[str], body: str, variables: list[str]) -> DataFrame:
    """Timeline JSON text per key → one row per interval."""
    parsed = F.from_json(F.col(body), TIMELINE)
    first = F.get(parsed["data"]["timelines"], 0)
    return interval_rows(docs.select(*keys, first["intervals"].alias("_steps")), keys, "_steps", variables)


def interval_rows(docs: DataFrame, keys: list[str], intervals: str, variables: list[str]) -> DataFrame:
    """Intervals of a timeline per key → one row per interval."""
    step = F.explode(intervals).alias("_i")
    at = utc(F.col("_i.startTime"))
    return docs.select(*keys, step).select(
        *keys, at.cast("date").alias("date"), F.hour(at).alias("hour"),
        *[F.try_element_at(F.col("_i.values"), F.lit(v)).alias(v) for v in variables])


def series_rows(docs: DataFrame, body: str) -> DataFrame:
    """Positional series JSON → EAV rows: time is item 0, value item 4.

    The station is item 3 and the variable item 5; null values are dropped.
    """
    parsed = F.from_json(F.col(body), SERIES)
    result = docs.select(F.explode(parsed["results"]).alias("r")).select(F.explode("r.series").alias("s"))
    item = lambda n: F.get(F.col("v"), n)
    return (result.select(F.explode("s.values").alias("v"))
            .select(item(3).alias("station_code"), item(5).alias("attribute"),
                    utc(item(0)).alias("date_time"), item(4).try_cast("double").alias("value"))
            .where("value is not null"))


def device_list(docs: DataFrame, body: str) -> DataFrame:
    """Device list JSON → devices that have a location."""
    parsed = F.from_json(F.col(body), DEVICES)
    return (docs.select(F.explode(parsed["items"]).alias("d"))
            .select("d.id", "d.name", F.get("d.current_location.gps", 0).alias("lon"),
                    F.get("d.current_location.gps", 1).alias("lat"))
            .where("lon is not null and lat is not null"))


def device_rows(df: DataFrame, keys: list[str], attributes: list[str],
                excluded: list[str] = DEVICE_EXCLUDED) -> DataFrame:
    """Hourly device rows → EAV, present values of the kept attributes only."""
    keep = [a for a in attributes if a not in excluded]
    return df.unpivot(keys, keep, "attribute", "value").where("value is not null")


def balloon_rows(docs: DataFrame, body: str, attributes: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Balloon JSON → (missions, track points, EAV rows)."""
    parsed = F.from_json(F.col(body), BALLOON)
    obs = (docs.select(F.explode(parsed["observations"]).alias("o")).select("o.*")
           .withColumn("date_time", F.timestamp_seconds("timestamp").cast("timestamp_ntz")))
    missions = obs.groupBy("mission_id").agg(F.min("mission_name").alias("mission_name"))
    track = obs.select("mission_id", "date_time", F.col("longitude").alias("lon"),
                       F.col("latitude").alias("lat"), "altitude").dropDuplicates(["mission_id", "date_time"])
    eav = obs.unpivot(["mission_id", "date_time"], attributes, "attribute", "value").where("value is not null")
    return missions, track, eav


def grid_files(spark: SparkSession, path: str, variables: list[str]) -> tuple[DataFrame, DataFrame]:
    """Per-grid JSON files → (rows, one quality row per file).

    The file name starts with the grid id; a file whose document has no
    interval counts as invalid. The files are read and parsed once, into a stage
    that both results read.
    """
    raw = (spark.read.text(path, wholetext=True, pathGlobFilter="*.json")
           .withColumn("grid_id", F.regexp_extract(F.col("_metadata.file_name"), r"^(\w+?)(?:-|_|\.)", 1)))
    first = F.get(F.from_json("value", TIMELINE)["data"]["timelines"], 0)["intervals"]
    parsed = write_stage(raw.select("grid_id", first.alias("intervals")), scratch_dir(spark, "documents"))
    steps = F.size(F.coalesce("intervals", F.array()))
    quality = parsed.select("grid_id", (steps > 0).alias("is_valid"), F.lit(False).alias("is_gap_filled"))
    return interval_rows(parsed, ["grid_id"], "intervals", variables), quality


def farmer_rows(sheet: DataFrame) -> DataFrame:
    """Farmer sheet → typed rows; location text is DMS or ``lat,lon``."""
    need = ["Farm ID", "Phone Number", "Farm Location (Lat/Long)"]
    schema.check_columns(sheet, need)
    optional = {"village": ["Village Name"], "rsvp": ["RSVP status"], "category": ["Category"],
                "crop": ["Trial Crop"]}
    extra = [schema.first_present(sheet, names).alias(n) if any(x in sheet.columns for x in names)
             else F.lit(None).cast("string").alias(n) for n, names in optional.items()]
    p = geo.point_from_text(F.col("Farm Location (Lat/Long)"))
    return sheet.select(text.clean_id(F.col("Farm ID")).alias("farm_unique_id"),
                        F.col("Phone Number").alias("phone"), p["lon"].alias("lon"),
                        p["lat"].alias("lat"), *extra)


def split_known(rows: DataFrame, existing: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(new rows, rows whose key exists) for loads that skip known farmers."""
    ids = existing.select(key).distinct()
    return rows.join(ids, key, "left_anti"), rows.join(ids, key, "left_semi")


def file_inventory(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files below a folder: name, size, time, date and variable of the name."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
             .option("recursiveFileLookup", True).load(path).drop("content"))
    name = F.try_element_at(F.split("path", "/"), F.lit(-1))
    return inventory_columns(files.select(name.alias("name"), "path", "length", "modificationTime"))


def inventory_columns(files: DataFrame) -> DataFrame:
    named = dates.variable_year_from_name(F.col("name"))
    return files.withColumns({"file_date": dates.date_from_name(F.col("name")),
                              "variable": named["variable"], "year": named["year"]})
