"""S: scans and sources. Landed files are written from the given tables first,
then read back by the operator."""

from pyspark.sql import functions as F

from furrow.functions import geo
from furrow.plans import catalog, cubes, ingest, pests, registry
from furrow.session import scratch_dir
from furrow.sinks import tables
from furrow.sources import landed, scans
from suite.base import query
from suite.joins import PESTS


@query("S01_advisory_day", "SELECT registry_id, iso_a3, final_message FROM {advisory_hist} WHERE year = 1998")
def _(t):
    return scans.advisory_scan(t.spark, t.advisory_table(), "1998-07-01").select("registry_id", "iso_a3", "final_message")


@query("S02_grid_columns", "SELECT grid_id, max_temperature, humidity FROM {weather} WHERE grid_id IN (SELECT grid_id FROM {farm} WHERE farm_group = 'BUILDING')")
def _(t):
    return scans.by_keys(t.weather, t.farm.where("farm_group = 'BUILDING'"), "grid_id", ["max_temperature", "humidity"])


@query("S03_grid_crop_keys", """
SELECT crop_id || '_' || grid_id AS grid_crop_key, registry_id, total_gdd FROM {advisory_hist} WHERE crop_id || '_' || grid_id IN (SELECT crop_id || '_' || grid_id FROM {registry_full} WHERE group_id = 1)""")
def _(t):
    key = F.concat_ws("_", "crop_id", "grid_id").alias("grid_crop_key")
    return scans.by_keys(t.advisory_hist.select(key, "registry_id", "total_gdd"), t.registry_full.where("group_id = 1").select(key),
                         "grid_crop_key", ["registry_id", "total_gdd"])


@query("S04_previous_messages", """
SELECT DISTINCT grid_id, crop_id, crop_stage_type_id, planting_date_epoch, final_message AS prev_week_message FROM {advisory_hist} WHERE year = 1998 AND month = 7 AND final_message IS NOT NULL AND day = 7""")
def _(t):
    return scans.previous_message_scan(t.advisory_hist, "1998-07-07")


@query("S05_signal_snapshot", """
SELECT s.signal_id, s.signal FROM {signal} s JOIN {farm} f ON s.farm_id = f.farm_id WHERE s.generated_date = DATE '1998-06-20' AND f.farm_group IN ('BUILDING', 'HOUSEHOLD')
AND s.farm_unique_id IN (SELECT farm_unique_id FROM {farm} WHERE country_id < 15)""")
def _(t):
    snap = t.signal.join(t.farm.select("farm_id", "farm_group"), "farm_id").withColumn("date", F.col("generated_date")).withColumn(
        "year", F.year("date")).withColumn("month", F.month("date"))
    return scans.snapshot_scan(snap, "1998-06-20", t.farm.where("country_id < 15"), ["BUILDING", "HOUSEHOLD"]).select("signal_id", "signal")


@query("S06_farmer_list_reads", "SELECT registry_id, message FROM {advisory_hist} WHERE year = 1998 AND month = 6 AND day = 3 AND farm_unique_id IN (SELECT farm_unique_id FROM {farm} WHERE country_id < 20)")
def _(t):
    day = scans.on_day(t.advisory_hist, "1998-06-03")
    return scans.by_keys(day, t.farm.where("country_id < 20"), "farm_unique_id", ["registry_id", "message"]).drop("farm_unique_id")


@query("S07_relational_ranges", """
SELECT CAST(least(floor((registry_id - low) / ceil((high - low + 1) / 25)), 24) AS INT) AS part, count(*) AS n, min(registry_id) AS low
FROM (SELECT registry_id, min(registry_id) OVER () AS low, max(registry_id) OVER () AS high FROM {registry}) GROUP BY 1""")
def _(t):
    # no database here: the same key ranges, over the measured bounds, of the stored table
    low, high = t.registry.agg(F.min("registry_id"), F.max("registry_id")).first()
    step = -(-(high - low + 1) // 25)
    return scans.range_parts(t.registry, "registry_id", low, low + 25 * step, 25).groupBy("part").agg(F.count("*").alias("n"), F.min("registry_id").alias("low"))


@query("S08_reanalysis_slice", "SELECT date, lat, lon, total_rainfall FROM {reanalysis} WHERE date BETWEEN DATE '1997-12-01' AND DATE '1998-02-15'")
def _(t):
    path = scratch_dir(t.spark, "cube")
    tables.write_partitions(t.reanalysis.withColumn("year", F.year("date")), path, ["year"], ["date", "lat", "lon"])
    rows = t.spark.read.parquet(path).where(F.col("year").between(1997, 1998))
    return cubes.daily_slice(rows, "1997-12-01", "1998-02-15").select("date", "lat", "lon", "total_rainfall")


@query("S09_hourly_slice", "SELECT date, hour, lat, lon FROM {reanalysis_hourly} WHERE date + to_hours(hour) BETWEEN TIMESTAMP '2024-01-04 07:00:00' AND TIMESTAMP '2024-01-06 02:00:00'")
def _(t):
    return cubes.hourly_slice(t.reanalysis_hourly, "2024-01-04 07:00:00", "2024-01-06 02:00:00").select("date", "hour", "lat", "lon")


@query("S10_day_files", "SELECT date, lat, lon, max_temperature FROM {reanalysis} WHERE date IN (DATE '1998-05-03', DATE '1998-05-04', DATE '1998-05-05')")
def _(t):
    return cubes.by_dates(t.reanalysis, ["1998-05-03", "1998-05-04", "1998-05-05"]).select("date", "lat", "lon", "max_temperature")


@query("S11_forecast_scan", """
SELECT date, lat, lon, temperature FROM (SELECT forecast_date + forecast_day_idx AS date, hour, lat, lon, temperature FROM {forecast_hourly} WHERE forecast_date = (SELECT max(forecast_date) FROM {forecast_hourly}) AND forecast_day_idx BETWEEN 1 AND 3)""")
def _(t):
    cube, latest = t.cube("forecast_hourly")
    end = latest.fromordinal(latest.toordinal() + 3).isoformat()
    return cubes.read_forecast(cube, ["temperature"], "2024-01-05", end, latest, hourly=True).select("date", "lat", "lon", "temperature")


@query("S12_seasonal_run", "SELECT forecast_date, forecast_day_idx, ensemble, lat, lon, temp FROM {ensemble} WHERE forecast_date IN ((SELECT max(forecast_date) FROM {ensemble}), DATE '1998-04-01')")
def _(t):
    cols = ["forecast_date", "forecast_day_idx", "ensemble", "lat", "lon", "temp"]
    cube, latest = t.cube("ensemble")
    return cubes.seasonal_run(cube, latest=latest).select(*cols).unionByName(cubes.seasonal_run(cube, "1998-04-20").select(*cols))


@query("S13_normals_scan", "SELECT dayofyear, lat, lon, LTNPET FROM {normals} WHERE dayofyear BETWEEN 152 AND 182")
def _(t):
    return cubes.normals_slice(t.normals, "2024-05-31", "2024-06-30").select("dayofyear", "lat", "lon", "LTNPET")


@query("S14_exact_times", "SELECT time, lat, lon, precipitation FROM {raster} WHERE time BETWEEN TIMESTAMP '2024-01-15 00:00:00' AND TIMESTAMP '2024-01-15 23:00:00'")
def _(t):
    return cubes.exact_times(t.raster.withColumn("time", F.col("time").cast("timestamp_ntz")), "2024-01-15 00:00:00", "2024-01-15 23:00:00").select(
        "time", "lat", "lon", "precipitation")


def _csv(t, df, label):
    path = scratch_dir(t.spark, label)
    df.write.option("header", True).csv(path)
    return path


PARAMETER_LABELS = [("Temperature", "temperature"), ("Humidity", "humidity"), ("P/PET", "p_pet"),
                    ("Growth stage rain", "growth_stage_precipitation"), ("Seasonal rain", "seasonal_precipitation")]


@query("S15_rule_csv", "SELECT 7 AS config_id, crop_id, crop_stage_type_id, growth_stage_id, parameter, min_range, max_range, code FROM {rule}")
def _(t):
    from furrow.schema import RULE_CSV
    labels = t.spark.createDataFrame(PARAMETER_LABELS, "label string, parameter string")
    out = t.rule.join(labels, "parameter").select(
        F.concat(F.lit("CROP"), F.col("crop_id").cast("string"), F.lit("_Type"), F.col("crop_stage_type_id").cast("string")).alias("crop"),
        F.col("label").alias("parameter"), F.concat(F.lit("stage "), F.col("growth_stage_id").cast("string")).alias("growth_stage"),
        "min_range", "max_range", F.col("code").cast("string").alias("code"))
    csv = landed.read_sheet(t.spark, _csv(t, out, "rules"), RULE_CSV)
    return landed.rule_rows(csv, t.crop, t.stage_type, t.stage_label, labels, 7)


@query("S16_message_csv", "SELECT t.code, t.template_en, t.template_sw, CAST(t.code % 11 AS INT) AS priority FROM {template} t")
def _(t):
    from furrow.schema import MESSAGE_CSV
    out = t.template.select("code", F.col("template_en").alias("message_english"), F.col("template_sw").alias("message_kiswahili"),
                            (F.col("code") % 11).alias("message_priority"))
    templates, priorities = landed.message_rows(landed.read_sheet(t.spark, _csv(t, out, "messages"), MESSAGE_CSV), 1)
    return templates.join(priorities.select("code", "priority"), "code")


@query("S17_grid_csv", "SELECT grid_unique_id AS unique_id, lat, lon, lon0 + 0.5 AS east, 5 AS vertices FROM {grid}")
def _(t):
    from furrow.schema import GRID_CSV
    n = lambda c: c.cast("string")
    x0, y0, x1, y1 = F.col("lon0"), F.col("lat0"), F.col("lon0") + 0.5, F.col("lat0") + 0.5
    body = F.concat_ws(", ", *[F.concat_ws(" ", n(x), n(y)) for x, y in [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]])
    out = t.grid.select(F.col("grid_unique_id").alias("locationid"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"),
                        F.lit("").alias("country"), "elevation", F.concat(F.lit("POLYGON (("), body, F.lit("))")).alias("shapewkt"), F.lit("cell").alias("name"))
    rows = landed.grid_rows(landed.read_sheet(t.spark, _csv(t, out.union(out), "grids"), GRID_CSV))
    return rows.select("unique_id", "lat", "lon", geo.envelope(F.col("area"))["max_lon"].alias("east"), F.size(F.get("area", 0)).alias("vertices"))


@query("S18_station_directory", """
SELECT 'S' || user_id AS station_code, CAST(ts AS DATE) AS date, 'rain' AS attribute, sum(floor(value * 8) / 8) AS value FROM events GROUP BY 1, 2 HAVING sum(floor(value * 8) / 8) > 10""")
def _(t):
    daily = t.daily_eav.groupBy("station_id", "day").agg(F.sum("value").alias("v"))
    code = F.concat(F.lit("S"), F.col("station_id").cast("string"))
    us = F.when(F.dayofmonth("day") % 2 == 0, F.date_format("day", "M/d/yy")).otherwise(F.date_format("day", "yyyy-MM-dd"))
    sheets = daily.select(F.concat(code, F.lit("_daily.csv")).alias("name"), us.alias("DATE"),
                          F.when(F.col("v") > 10, F.col("v")).cast("string").alias("rain"))
    # one file per station, called after it, beside a listing of the stations
    path = t.named_files(sheets, "name", "csv", header=True)
    listing = t.station.select(F.lit("All_Stations.csv").alias("name"), F.col("station_code").alias("code"), F.col("lat").cast("string").alias("lat"))
    t.named_files(listing, "name", "csv", path, header=True)
    stations, rows = landed.station_directory(t.spark, path, ["rain", "humidity"])
    return rows.join(stations.select(F.col("code").alias("station_code")), "station_code", "left_semi")


def timeline_docs(t, per_quarter=True):
    """Provider timeline documents of every grid, one per grid and quarter, or one per grid."""
    w = t.weather
    step = F.struct(F.date_format("date", "yyyy-MM-dd'T'06:00:00'Z'").alias("startTime"),
                    F.struct(F.col("max_temperature").alias("temperatureMax"), F.col("total_rainfall").alias("rainAccumulationSum")).alias("values"))
    docs = w.groupBy("grid_id", (F.trunc("date", "quarter") if per_quarter else F.lit(None).cast("date")).alias("q")).agg(F.array_sort(F.collect_list(step)).alias("intervals"))
    line = F.struct(F.struct(F.array(F.struct("intervals")).alias("timelines")).alias("data"))
    return docs.select("grid_id", "q", F.to_json(line).alias("body")).select("grid_id", "q", F.regexp_replace("body", r'^\{"col1":(.*)\}$', "$1").alias("body"))


@query("S19_timeline_json", """
SELECT grid_id, date, 6 AS hour, max_temperature AS "temperatureMax", total_rainfall AS "rainAccumulationSum", CAST(NULL AS DOUBLE) AS "windSpeedAvg" FROM {weather}""")
def _(t):
    return landed.timeline_rows(timeline_docs(t), ["grid_id"], "body", ["temperatureMax", "rainAccumulationSum", "windSpeedAvg"])


@query("S20_series_json", """
SELECT 'S' || user_id AS station_code, event_type AS attribute, date_trunc('second', ts) AS date_time, floor(value * 8) / 8 AS value FROM events WHERE event_type <> 'signup'""")
def _(t):
    m = t.events.withColumn("v", F.when(F.col("event_type") != "signup", (F.floor(F.col("value") * 8) / 8).cast("string")))
    row = F.array(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("1"), F.lit("sensor"), F.concat(F.lit("S"), F.col("user_id").cast("string")), "v", "event_type")
    docs = m.groupBy(F.floor(F.col("event_id") / 200).alias("page")).agg(F.collect_list(row).alias("values"))
    series = F.struct(F.lit("raw").alias("name"), F.array(F.lit("time")).alias("columns"), F.col("values"))
    body = F.to_json(F.struct(F.array(F.struct(F.array(series).alias("series"))).alias("results")), {"ignoreNullFields": "false"})
    return landed.series_rows(docs.select(body.alias("body")), "body")


@query("S21_device_json", """
SELECT device, date_time, attribute, value FROM (SELECT 'D' || station_id AS device, date_time, unnest(['maxt', 'precip']) AS attribute, unnest([value, CASE WHEN attribute = 'view' THEN value * 2 END]) AS value
 FROM {measurement} WHERE station_id IN (SELECT station_id FROM {station} WHERE altitude >= 1000)) WHERE value IS NOT NULL""")
def _(t):
    item = F.struct(F.concat(F.lit("D"), F.col("station_id").cast("string")).alias("id"), F.col("station_code").alias("name"),
                    F.when(F.col("altitude") >= 1000, F.struct(F.array("lon", "lat").alias("gps"))).alias("current_location"))
    lists = t.station.groupBy(F.floor(F.col("station_id") / 200).alias("page")).agg(F.collect_list(item).alias("items")).select(F.to_json(F.struct("items")).alias("body"))
    devices = landed.device_list(lists, "body")
    path = scratch_dir(t.spark, "devices")
    t.measurement.select(F.concat(F.lit("D"), F.col("station_id").cast("string")).alias("device"), "date_time", F.col("value").alias("maxt"),
                         F.when(F.col("attribute") == "view", F.col("value") * 2).alias("precip"), F.lit(1.5).alias("slp")).write.option("timestampNTZFormat", landed.MICROS).json(path)
    hourly = t.spark.read.schema("device string, date_time timestamp_ntz, maxt double, precip double, slp double").option("timestampNTZFormat", landed.MICROS).json(path)
    known = hourly.join(devices.select(F.col("id").alias("device")), "device", "left_semi")
    return landed.device_rows(known, ["device", "date_time"], ["maxt", "precip", "slp"])


def balloon_docs(t):
    obs = F.struct(F.col("altitude"), F.lit(None).cast("double").alias("humidity"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"),
                   F.concat(F.lit("M"), F.col("station_id").cast("string")).alias("mission_id"), F.col("station_id").cast("string").alias("mission_name"),
                   (F.col("history_id") % 800 / 8).alias("temperature"), F.unix_seconds(F.col("date_time").cast("timestamp")).alias("timestamp"))
    pages = t.track.groupBy(F.floor(F.col("history_id") / 200).alias("page")).agg(F.collect_list(obs).alias("observations"))
    return pages.select(F.to_json(F.struct(F.lit(False).alias("has_next_page"), "observations")).alias("body"))


@query("S22_balloon_json", """
SELECT (SELECT count(DISTINCT station_id) FROM {track}) AS missions, (SELECT count(DISTINCT (station_id, date_trunc('second', date_time))) FROM {track}) AS track_points, count(*) AS measurements, sum(history_id % 800 / 8) AS total FROM {track}""")
def _(t):
    missions, track, eav = landed.balloon_rows(balloon_docs(t), "body", ["humidity", "temperature"])
    count = lambda d: d.agg(F.count("*")).scalar()
    return eav.agg(F.count("*").alias("measurements"), F.sum("value").alias("total")).select(
        "*", count(missions).alias("missions"), count(track).alias("track_points"))


@query("S23_grid_files", """
SELECT g.grid_id, count(w.date) AS steps, sum(max_temperature) AS total, (SELECT count(*) FROM {grid} WHERE grid_id % 17 = 0) AS missing_files,
  (SELECT count(*) FROM {grid} WHERE grid_id % 13 = 0 AND grid_id % 17 <> 0) AS invalid_documents FROM {grid} g JOIN {weather} w ON w.grid_id = g.grid_id
WHERE g.grid_id % 17 <> 0 AND g.grid_id % 13 <> 0 GROUP BY 1""")
def _(t):
    # one document per grid, as delivered: some grids have no file, some an empty document
    docs = timeline_docs(t, per_quarter=False).where("grid_id % 17 <> 0 and grid_id % 13 <> 0").select("grid_id", "body")
    broken = t.grid.where("grid_id % 17 <> 0 and grid_id % 13 = 0").select("grid_id", F.lit('{"data": {}}').alias("body"))
    name = F.concat(F.col("grid_id").cast("string"), F.lit("_forecast.json"))
    path = t.named_files(docs.union(broken).select(name.alias("name"), "body"), "name", "text")
    rows, quality = landed.grid_files(t.spark, path, ["temperatureMax"])
    quality = quality.withColumn("grid_id", F.col("grid_id").cast("long"))
    found = ingest.ingest_quality(quality, t.grid).select("missing_files", "invalid_documents")
    steps = rows.groupBy(F.col("grid_id").cast("long").alias("grid_id")).agg(F.count("*").alias("steps"), F.sum("temperatureMax").alias("total"))
    return steps.crossJoin(F.broadcast(found))


@query("S24_farmer_sheet", """
SELECT farm_unique_id, phone, lon, lat, farm_group AS category, preferred_language <> 'en' AS is_new FROM {farm}""")
def _(t):
    dms = F.concat_ws(" ", geo.decimal_to_dms(F.col("lat"), "N", "S"), geo.decimal_to_dms(F.col("lon"), "E", "W"))
    pair = F.concat_ws(",", F.col("lat").cast("string"), F.col("lon").cast("string"))
    sheet = t.farm.select(F.col("farm_unique_id").alias("Farm ID"), F.col("phone").alias("Phone Number"),
                          F.when(F.col("farm_id") % 2 == 0, dms).otherwise(pair).alias("Farm Location (Lat/Long)"), F.col("farm_group").alias("Category"))
    csv = t.spark.read.option("header", True).option("escape", '"').csv(_sheet(t, sheet))
    fresh, known = landed.split_known(landed.farmer_rows(csv), t.farm.where("preferred_language = 'en'"), "farm_unique_id")
    both = fresh.withColumn("is_new", F.lit(True)).unionByName(known.withColumn("is_new", F.lit(False)))
    return both.select("farm_unique_id", "phone", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "category", "is_new")


def _sheet(t, df):
    path = scratch_dir(t.spark, "sheet")
    df.write.option("header", True).option("escape", '"').csv(path)
    return path


@query("S25_pest_sheet", """
SELECT no, variable, value FROM (SELECT no, unnest(['beetle', 'borer', 'worm']) AS variable, unnest([beetle, borer, worm]) AS value FROM {pest_sheet}
 WHERE (beetle IS NOT NULL)::INT + (borer IS NOT NULL)::INT + (worm IS NOT NULL)::INT >= 2) WHERE value IS NOT NULL""")
def _(t):
    return pests.sheet_to_long(t.pest_sheet, ["no"], PESTS)


@query("S26_registry_csv", """
SELECT 'F' || (o_custkey + CASE WHEN o_orderkey % 5 = 0 THEN 1000000 ELSE 0 END) AS farmer_id, 'crop' || (o_orderkey % 9) AS crop_name,
 CASE o_orderkey % 4 WHEN 0 THEN 'type1' WHEN 1 THEN 'TYPE2' WHEN 2 THEN 'Type3' ELSE 'Mid' END AS stage_name, CAST(o_orderdate AS DATE) AS planting_date, 20.0625 + (o_custkey * 29 % 640) / 16 AS lon FROM orders""")
def _(t):
    from furrow.schema import REGISTRY_CSV
    from suite.domain import registry_csv
    csv = landed.read_sheet(t.spark, _csv(t, registry_csv(t), "registry"), REGISTRY_CSV)
    return registry.read_rows(csv).select("farmer_id", "crop_name", "stage_name", "planting_date", "lon")


@query("S27_raster_pixels", """
SELECT TIMESTAMP '1970-01-01' + to_seconds(CAST(946684800 + floor(o_orderkey / 40) * 900 AS BIGINT)) AS time, CAST(o_orderkey % 10 AS DOUBLE) AS lat, CAST(floor(o_orderkey / 10) % 4 AS DOUBLE) AS lon,
 CASE WHEN o_custkey % 7 <> 0 THEN CAST(o_custkey AS DOUBLE) END AS precip_rate, CAST(o_orderkey % 100 AS DOUBLE) AS cloud_top FROM orders""")
def _(t):
    from furrow.plans.ingest import pixels_to_raster, safe_band_names
    k = F.col("o_orderkey")
    name = F.concat(F.lit("nowcast_946684800_"), (F.floor(k / 40) * 900).cast("string"), F.lit(".tif"))
    px = t.orders.select(name.alias("file_name"), (k % 10).cast("double").alias("lat"), (F.floor(k / 10) % 4).cast("double").alias("lon"),
                         F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey").cast("double")).otherwise(-9999.0).alias("Precip rate"), (k % 100).cast("double").alias("Cloud-Top"))
    long = px.unpivot(["file_name", "lat", "lon"], ["Precip rate", "Cloud-Top"], "band", "value")
    return pixels_to_raster(long, safe_band_names(["Precip rate", "Cloud-Top"]), -9999.0)


@query("S28_new_files", """
SELECT name, min(file_date) AS file_date, min(variable) AS variable, min(year) AS year FROM (
  SELECT name, CAST(NULL AS DATE) AS file_date, 'var' || (file_id % 4) AS variable, CAST(year(version) AS INT) AS year FROM {source_file}
  UNION ALL SELECT 'daily_' || CAST(date_trunc('month', version)::DATE AS VARCHAR) || '.nc', date_trunc('month', version)::DATE, NULL, NULL FROM {source_file})
WHERE name NOT IN (SELECT name FROM {source_file} WHERE year(version) = 1999) GROUP BY name""")
def _(t):
    monthly = F.concat(F.lit("daily_"), F.trunc("version", "month").cast("string"), F.lit(".nc"))
    names = t.source_file.select("name").union(t.source_file.select(monthly)).distinct()
    path = t.named_files(names.withColumn("value", F.lit("content")), "name", "text")
    done = t.source_file.where(F.year("version") == 1999)
    new = catalog.new_files(landed.file_inventory(t.spark, path, "*.nc"), done)
    daily = F.col("file_date").isNotNull()
    return new.select("name", "file_date", F.when(~daily, F.col("variable")).alias("variable"), F.when(~daily, F.col("year").cast("int")).alias("year"))
