"""F, T, U: filters, sorts, set operations."""

from pyspark.sql import functions as F

from furrow.operators import spatial
from furrow.plans import advisory, catalog, cubes, ingest, observations
from furrow.plans.observations import Location
from furrow.schema import backfill, cast_by_name, rename_attributes, with_metadata
from furrow.sources import scans
from furrow.session import scratch_dir
from suite.base import query

# a convex five-sided area and a hole, on multiples of 1/8
RING = [(24.0, -20.0), (48.0, -24.0), (56.0, 4.0), (40.0, 20.0), (24.0, 8.0), (24.0, -20.0)]
HOLE = [(36.0, -8.0), (40.0, -8.0), (40.0, -4.0), (36.0, -4.0), (36.0, -8.0)]


def hav(a: str, b: str) -> str:
    """Great-circle metres between two aliases with lon and lat."""
    return (f"2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat))"
            f" * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))))")


def inside_sql(x: str, y: str) -> str:
    """Strictly inside the convex ring and outside the hole."""
    edges = [f"({bx - ax}) * ({y} - ({ay})) - ({by - ay}) * ({x} - ({ax})) > 0"
             for (ax, ay), (bx, by) in zip(RING, RING[1:])]
    return " AND ".join(edges) + f" AND NOT ({x} BETWEEN 36 AND 40 AND {y} BETWEEN -8 AND -4)"


@query("F01_attribute_projection", "SELECT grid_id, date, max_temperature AS tmax, total_rainfall AS rain FROM {weather}")
def _(t):
    return rename_attributes(t.weather, ["grid_id", "date"], {"max_temperature": "tmax", "total_rainfall": "rain"})


@query("F02_backfill", "SELECT grid_id, date, humidity, CAST(NULL AS DOUBLE) AS wind_speed FROM {weather}")
def _(t):
    return backfill(t.weather, ["humidity", "wind_speed"]).select("grid_id", "date", "humidity", "wind_speed")


@query("F03_time_range", """
SELECT measurement_id, value FROM {measurement} WHERE date_time BETWEEN TIMESTAMP '2024-01-05 06:00:00' AND TIMESTAMP '2024-01-12 18:00:00'""")
def _(t):
    return observations.time_range(t.measurement, "2024-01-05 06:00:00", "2024-01-12 18:00:00").select("measurement_id", "value")


@query("F04_year_bounds", """
SELECT grid_id, date FROM {weather} WHERE date BETWEEN DATE '1997-03-01' AND DATE '1998-02-10'""")
def _(t):
    w = t.weather.withColumn("year", F.year("date")).withColumn("date_time", F.col("date").cast("timestamp_ntz"))
    return observations.time_range(w, "1997-03-01 00:00:00", "1998-02-10 00:00:00").select("grid_id", "date")


@query("F05_box", """
SELECT station_id, lon > 24 AND lon < 50 AND lat > -20.125 AND lat < 10 AS strict FROM {station}
WHERE lon BETWEEN 24 AND 50 AND lat BETWEEN -20.125 AND 10""")
def _(t):
    box = (24.0, -20.125, 50.0, 10.0)
    strict = spatial.within_box(t.station, *box, boundary="exclude").select("station_id", F.lit(True).alias("strict"))
    return spatial.within_box(t.station, *box).select("station_id").join(strict, "station_id", "left").fillna(False)


@query("F06_polygon", f"SELECT station_id FROM {{station}} WHERE {inside_sql('lon', 'lat')}")
def _(t):
    return spatial.within_area(t.station, [RING, HOLE]).select("station_id")


@query("F07_altitude", "SELECT station_id, history_id FROM {track} WHERE altitude BETWEEN 500 AND 1500")
def _(t):
    both = observations.altitude_band(t.track, 500, 1500)
    return observations.altitude_band(both, 500, None).select("station_id", "history_id")


@query("F08_nearest_cell", """
SELECT farm_id, CAST(floor((lat + 27.75) / 0.5 + 0.5) AS INT) AS lat_idx, CAST(floor((lon - 20.25) / 0.5 + 0.5) AS INT) AS lon_idx FROM {farm}""")
def _(t):
    return spatial.nearest_cells(t.farm, 20.25, -27.75, 0.5).select("farm_id", "lat_idx", "lon_idx")


@query("F08_nearest_irregular", """
WITH ax AS (SELECT DISTINCT floor(lon) + (CAST(floor(lon) AS INT) % 3) / 8 AS c FROM {grid})
SELECT farm_id, (SELECT c FROM ax ORDER BY abs(c - lon), c LIMIT 1) AS coord FROM {farm}""")
def _(t):
    axis = t.grid.select((F.floor("lon") + (F.floor("lon").cast("int") % 3) / 8).alias("coord"))
    return spatial.nearest_on_axis(t.farm.select("farm_id", "lon"), axis, "lon", "coord", 4.0, ["farm_id"]).select("farm_id", "coord")


@query("F09_cells_of_points", """
SELECT r.date, r.lat, r.lon, r.max_temperature FROM {reanalysis} r WHERE EXISTS (SELECT 1 FROM {farm} f
  WHERE floor((f.lat + 27.75) / 0.5 + 0.5) = (r.lat + 27.75) / 0.5 AND floor((f.lon - 20.25) / 0.5 + 0.5) = (r.lon - 20.25) / 0.5)""")
def _(t):
    pts = t.farm.select(F.col("farm_id").alias("point_id"), "lon", "lat")
    return cubes.at_location(t.reanalysis, Location.many(pts), 20.25, -27.75, 0.5).select("date", "lat", "lon", "max_temperature")


@query("F10_lead_slice", """
SELECT forecast_date, forecast_day_idx, lat, lon, max_temperature FROM {forecast}
WHERE forecast_date + forecast_day_idx BETWEEN DATE '2024-01-10' AND DATE '2024-01-14'""")
def _(t):
    return cubes.lead_slice(t.forecast, "2024-01-10", "2024-01-14").select(
        "forecast_date", "forecast_day_idx", "lat", "lon", "max_temperature")


@query("F11_day_of_year", """
SELECT dayofyear, lat, lon, LTNPrecip FROM {normals} WHERE dayofyear >= 350 OR dayofyear <= 10""")
def _(t):
    return cubes.normals_slice(t.normals, "2024-12-15", "2025-01-10").select("dayofyear", "lat", "lon", "LTNPrecip")


@query("F12_split_range", """
WITH r AS (SELECT registry_id, planting_date AS s, planting_date + CAST(registry_id % 60 AS INT) AS e FROM {registry})
SELECT registry_id, CASE WHEN s <= least(e, DATE '1998-05-14') THEN s END AS past_start, CASE WHEN s <= least(e, DATE '1998-05-14') THEN least(e, DATE '1998-05-14') END AS past_end,
  CASE WHEN greatest(s, DATE '1998-05-15') <= e THEN greatest(s, DATE '1998-05-15') END AS future_start, CASE WHEN greatest(s, DATE '1998-05-15') <= e THEN e END AS future_end FROM r""")
def _(t):
    from furrow.functions.dates import split_date_range
    e = F.date_add("planting_date", (F.col("registry_id") % 60).cast("int"))
    s = split_date_range(F.col("planting_date"), e, F.to_date(F.lit("1998-05-15")))
    return t.registry.select("registry_id", s["past"]["start"].alias("past_start"), s["past"]["end"].alias("past_end"),
                             s["future"]["start"].alias("future_start"), s["future"]["end"].alias("future_end"))


@query("F13_resolve_product", """
SELECT da.dataset_attribute_id, a.variable_name, da.source FROM {dataset_attribute} da JOIN {dataset} d ON da.dataset_id = d.dataset_id
JOIN {attribute} a ON da.attribute_id = a.attribute_id
WHERE lower(d.product) = 'product_1' AND NOT d.is_internal AND a.is_active AND a.variable_name IN ('var_1', 'var_3', 'var_5', 'var_7')""")
def _(t):
    return catalog.resolve(t.dataset, t.dataset_attribute, t.attribute, "PRODUCT_1", ["var_1", "var_3", "var_5", "var_7"]).select(
        "dataset_attribute_id", "variable_name", "source")


@query("F15_collector_window", "SELECT grid_id, date FROM {weather} WHERE date >= DATE '1998-06-25' AND date < DATE '1998-07-14'")
def _(t):
    return ingest.date_window(t.weather, "1998-06-25", "1998-07-14").select("grid_id", "date")


@query("F16_floor_date", "SELECT measurement_id FROM {measurement} WHERE date_time >= TIMESTAMP '2024-01-20 00:00:00'")
def _(t):
    return ingest.from_floor(t.measurement, "2024-01-20").select("measurement_id")


@query("F17_without_messages", """
SELECT registry_id FROM {advisory_hist} WHERE message IS NULL AND message_2 IS NULL AND message_3 IS NULL AND message_4 IS NULL AND message_5 IS NULL""")
def _(t):
    return advisory.without_messages(t.advisory_hist).select("registry_id")


@query("F18_cast_by_name", "SELECT registry_id, CAST(message AS INT) AS message, CAST(planting_date_epoch AS BIGINT) AS planting_date_epoch, CAST(humidity AS DOUBLE) AS humidity FROM {advisory_hist}")
def _(t):
    text = t.advisory_hist.select("registry_id", *[F.col(c).cast("string").alias(c) for c in ("message", "planting_date_epoch", "humidity")])
    return cast_by_name(text)


@query("F19_named_groups", "SELECT farm_id, farm_group FROM {farm} WHERE farm_group IN ('BUILDING', 'MACHINERY')")
def _(t):
    g = catalog.named_groups(t.farm.withColumnRenamed("farm_group", "name"), ["BUILDING", "MACHINERY"])
    return catalog.named_groups(g, None).select("farm_id", F.col("name").alias("farm_group"))


@query("F20_registry_groups", """
SELECT registry_id, group_id FROM {registry} WHERE group_id IN (1, 3)""")
def _(t):
    groups = t.registry.select("group_id").distinct().withColumn("is_latest", F.col("group_id") == 3)
    wanted = catalog.groups_or_latest(groups, [1]).union(catalog.groups_or_latest(groups, None))
    return t.registry.join(wanted.select("group_id"), "group_id", "left_semi").select("registry_id", "group_id")


@query("F21_attribute_metadata", """
SELECT da.dataset_attribute_id, a.unit, a.long_name FROM {dataset_attribute} da
LEFT JOIN {attribute} a ON da.attribute_id = a.attribute_id""")
def _(t):
    out = catalog.attach_attribute_info(t.dataset_attribute, t.attribute, "attribute_id").select("dataset_attribute_id", "unit", "long_name")
    return with_metadata(out, {"unit": {"comment": "unit of the values"}})


@query("F22_recent_outputs", """
SELECT file_id, version AS created_at FROM {source_file} WHERE version >= TIMESTAMP '1998-06-17 00:00:00' AND deleted_at IS NULL ORDER BY created_at DESC""")
def _(t):
    out = t.source_file.select("file_id", F.col("version").alias("created_at"), F.concat(
        F.lit("out_"), F.col("file_id").cast("string"), F.when(F.col("deleted_at").isNull(), ".csv").otherwise(".nc")).alias("name"))
    return catalog.recent_outputs(out, "1998-07-01").drop("name")


# ---- sorts ----------------------------------------------------------------

def _z_sql(lon: str, lat: str, bits: int = 16) -> str:
    x = f"CAST(floor(({lon} + 180.0) / 360.0 * {1 << bits}) AS BIGINT)"
    y = f"CAST(floor(({lat} + 90.0) / 180.0 * {1 << bits}) AS BIGINT)"
    return " + ".join([f"(({x} >> {i}) & 1) * {1 << (2 * i)} + (({y} >> {i}) & 1) * {1 << (2 * i + 1)}" for i in range(bits)])


@query("T01_space_filling_key", f"SELECT grid_id, CAST({_z_sql('lon', 'lat')} AS BIGINT) AS z FROM {{grid}}")
def _(t):
    from furrow.functions.geo import z_key
    return t.grid.select("grid_id", z_key(F.col("lon"), F.col("lat")).alias("z")).repartitionByRange("z").sortWithinPartitions("z")


@query("T02_time_order", "SELECT measurement_id, date_time FROM {measurement} ORDER BY date_time")
def _(t):
    return t.measurement.select("measurement_id", "date_time").orderBy("date_time")


@query("T03_page", "SELECT registry_id, farm_id FROM {registry} ORDER BY registry_id LIMIT 500 OFFSET 250")
def _(t):
    return scans.page(t.registry.select("registry_id", "farm_id"), "registry_id", 500, 250)


@query("T03_late_page", """
SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET (SELECT CAST(count(*) - 150 AS BIGINT) FROM orders)""")
def _(t):
    """A page near the end of a table, by its index."""
    path = scratch_dir(t.spark, "paged")
    scans.write_paged(t.orders.select("o_orderkey", "o_custkey"), path, "o_orderkey", 1000)
    return scans.read_page(t.spark, path, "o_orderkey", 100, t.orders.count() - 150)


@query("T04_row_cap", "SELECT registry_id FROM {registry} ORDER BY registry_id LIMIT 100")
def _(t):
    return t.registry.select("registry_id").orderBy("registry_id").limit(100)


@query("T05_nearest_one", f"""
SELECT f.farm_id, arg_min(g.grid_id, (round({hav('f', 'g')}, 3), g.grid_id)) AS grid_id
FROM {{farm}} f CROSS JOIN {{grid}} g GROUP BY f.farm_id""")
def _(t):
    return spatial.nearest_place(t.farm, t.grid, "farm_id", "grid_id").select("farm_id", "grid_id")


@query("T06_ascending_coordinates", "SELECT DISTINCT lat, lon FROM {raster} ORDER BY lat, lon")
def _(t):
    return t.raster.select("lat", "lon").distinct().orderBy("lat", "lon")


# ---- set operations -------------------------------------------------------

@query("U01_past_and_future", """
SELECT date, lat, lon, max_temperature FROM (
 SELECT forecast_date - 1 AS date, lat, lon, max_temperature FROM {forecast} WHERE forecast_day_idx = -1 AND forecast_date - 1 < DATE '2024-01-20'
 UNION ALL SELECT forecast_date + forecast_day_idx, lat, lon, max_temperature FROM {forecast} WHERE forecast_date = DATE '2024-01-20' AND forecast_day_idx >= 0) ORDER BY date""")
def _(t):
    cols = ["date", "lat", "lon", "max_temperature"]
    past = t.forecast.where("forecast_day_idx = -1").withColumn("date", F.date_sub("forecast_date", 1)).where("date < '2024-01-20'")
    future = t.forecast.where("forecast_date = '2024-01-20' and forecast_day_idx >= 0").withColumn(
        "date", F.date_add("forecast_date", F.col("forecast_day_idx")))
    return cubes.combine([past.select(*cols), future.select(*cols)], ["date", "lat", "lon"])


@query("U02_daily_slices", "SELECT date, lat, lon, max_temperature FROM {reanalysis} WHERE date IN (DATE '1998-05-03', DATE '1998-05-09', DATE '1998-06-21')")
def _(t):
    parts = [cubes.by_dates(t.reanalysis, [d]) for d in ("1998-05-03", "1998-05-09", "1998-06-21")]
    return cubes.combine(parts).select("date", "lat", "lon", "max_temperature")


@query("U03_merge_outputs", "SELECT grid_id, date, max_temperature FROM {weather}")
def _(t):
    w = t.weather
    cuts = ["date < '1997-01-01'", "date >= '1997-01-01' and date < '1999-01-01'", "date >= '1999-01-01'"]
    parts = [w.where(c) for c in cuts]
    return ingest.merge_outputs(parts, ["grid_id", "date", "max_temperature"])


@query("U04_union_by_name", """
SELECT station_id, day, value, NULL::DOUBLE AS extra FROM {daily_eav} UNION ALL SELECT grid_id, date, NULL::DOUBLE, humidity FROM {weather}""")
def _(t):
    a = t.daily_eav.select("station_id", "day", "value")
    b = t.weather.select(F.col("humidity").alias("extra"), F.col("date").alias("day"), F.col("grid_id").alias("station_id"))
    return a.unionByName(b, allowMissingColumns=True)


@query("U05_distinct_keys", """
SELECT grid_id, min(registry_id) AS registry_id FROM {registry_full} GROUP BY grid_id""")
def _(t):
    from furrow.operators.skew import latest_by
    return latest_by(t.registry_full.select("grid_id", "registry_id"), ["grid_id"], ["registry_id"], keep="first")
