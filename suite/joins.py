"""J: joins."""

from pyspark.sql import functions as F

from furrow.functions import geo
from furrow.operators import spatial
from furrow.plans import advisory, agronomy, audit, catalog, cubes, ingest, observations, pests, planting, registry
from suite.base import REQUEST_DATE, query
from suite.filters import hav

_STAR = ["registry_id", "farm_unique_id", "crop", "stage_type", "iso_a3", "planting_date_epoch", "grid_crop_key", "config_id"]


def star(t):
    farm = t.farm.select("farm_id", "farm_unique_id", "grid_id", "preferred_language", "lon", "lat")
    grid = t.grid.select("grid_id", "country_id", "grid_unique_id")
    country = t.country.select("country_id", "country", "iso_a3")
    return advisory.registry_star(t.registry, farm, grid, t.crop, t.stage_type, country)


@query("J01_registry_star", """
SELECT r.registry_id, r.farm_unique_id, c.crop, s.stage_type, r.iso_a3, r.planting_date_epoch,
  r.crop_id || '_' || r.crop_stage_type_id || '_' || r.grid_id AS grid_crop_key, r.config_id
FROM {registry_full} r JOIN {crop} c ON r.crop_id = c.crop_id JOIN {stage_type} s ON r.crop_stage_type_id = s.crop_stage_type_id""")
def _(t):
    return agronomy.config_by_country(star(t), t.config_override, 1).select(*_STAR)


@query("J02_registry_grids", """
SELECT DISTINCT g.grid_id, g.lon, g.lat, c.iso_a3, c.country_id FROM {registry} r JOIN {farm} f ON r.farm_id = f.farm_id
JOIN {grid} g ON f.grid_id = g.grid_id JOIN {country} c ON g.country_id = c.country_id""")
def _(t):
    r = t.registry.join(t.farm.select("farm_id", "grid_id"), "farm_id")
    return agronomy.registry_grids(r, t.grid, t.country.select("country_id", "iso_a3"))


_GC = "grid_id, crop_id, crop_stage_type_id, planting_date, prev_growth_stage_id, prev_growth_stage_start_date, config_id"


@query("J03_registry_grid_crops", f"""
SELECT DISTINCT {_GC}, planting_date_epoch, crop_id || '_' || crop_stage_type_id || '_' || grid_id AS grid_crop_key FROM {{registry_full}}""")
def _(t):
    return agronomy.registry_grid_crops(t.registry_full)


@query("J04_attach_weather", """
SELECT r.registry_id, w.humidity FROM {registry_full} r JOIN {weather} w ON r.grid_id = w.grid_id AND w.date = r.planting_date""")
def _(t):
    w = t.weather.select("grid_id", F.col("date").alias("planting_date"), "humidity")
    return t.registry_full.join(w, ["grid_id", "planting_date"]).select("registry_id", "humidity")


@query("J05_gdd_config", """
SELECT r.registry_id, g.gdd_base, g.gdd_cap FROM {registry_full} r JOIN {gdd_config} g ON r.crop_id = g.crop_id AND r.config_id = g.config_id""")
def _(t):
    return agronomy.with_gdd_config(t.registry_full, t.gdd_config).select("registry_id", "gdd_base", "gdd_cap")


@query("J06_country_config", """
SELECT g.grid_id, CAST(COALESCE(o.config_id, 1) AS INT) AS config_id FROM {grid} g LEFT JOIN {config_override} o ON g.country_id = o.country_id""")
def _(t):
    return agronomy.config_by_country(t.grid, t.config_override, 1).select("grid_id", "config_id")


_PREV = """(SELECT a.grid_id, a.crop_id, a.crop_stage_type_id, a.planting_date_epoch, arg_min(a.final_message, (-COALESCE(p.priority, 0), a.final_message)) AS prev
 FROM {advisory_hist} a LEFT JOIN {priority} p ON a.config_id = p.config_id AND a.final_message = p.code WHERE a.final_message IS NOT NULL GROUP BY 1, 2, 3, 4)"""


@query("J07_previous_message", f"""
SELECT a.registry_id, p.prev AS prev_week_message FROM {{advisory_hist}} a LEFT JOIN {_PREV} p ON a.grid_id = p.grid_id AND a.crop_id = p.crop_id
 AND a.crop_stage_type_id = p.crop_stage_type_id AND a.planting_date_epoch = p.planting_date_epoch""")
def _(t):
    prev = advisory.previous_messages(t.advisory_hist, t.priority)
    return advisory.with_previous(t.advisory_hist.drop("prev_week_message"), prev).select("registry_id", "prev_week_message")


@query("J08_farms_to_grid_crops", f"""
SELECT a.registry_id, p.prev, l.growth_stage FROM {{advisory_hist}} a JOIN {_PREV} p ON a.grid_id = p.grid_id AND a.crop_id = p.crop_id
 AND a.crop_stage_type_id = p.crop_stage_type_id AND a.planting_date_epoch = p.planting_date_epoch
 LEFT JOIN {{stage_label}} l ON l.growth_stage_id = p.prev % 7""")
def _(t):
    results = advisory.previous_messages(t.advisory_hist, t.priority).withColumnRenamed("prev_week_message", "prev").withColumn(
        "growth_stage_id", (F.col("prev") % 7).cast("int"))
    farms = t.advisory_hist.select("registry_id", "grid_id", "crop_id", "crop_stage_type_id", "planting_date_epoch")
    return advisory.farm_advisory(farms, results, t.stage_label).select("registry_id", "prev", "growth_stage")


def grid_areas(t):
    return t.grid.select("grid_id", "country_id", geo.rectangle(
        F.col("lon0"), F.col("lat0"), F.col("lon0") + 0.5, F.col("lat0") + 0.5).alias("area"))


@query("J09_point_to_grid", """
SELECT f.farm_id, g.grid_id FROM {farm} f JOIN {grid} g ON f.lon BETWEEN g.lon0 AND g.lon0 + 0.5 AND f.lat BETWEEN g.lat0 AND g.lat0 + 0.5""")
def _(t):
    return spatial.join_points_to_areas(t.farm.select("farm_id", "lon", "lat"), grid_areas(t), bucket_deg=0.5).select("farm_id", "grid_id")


@query("J10_point_to_country", """
SELECT s.station_id, min(c.country) AS country FROM {station} s LEFT JOIN {country} c
  ON s.lon BETWEEN c.lon0 AND c.lon0 + 8 AND s.lat BETWEEN c.lat0 AND c.lat0 + 11.25 GROUP BY 1""")
def _(t):
    area = geo.rectangle(F.col("lon0"), F.col("lat0"), F.col("lon0") + 8, F.col("lat0") + 11.25)
    countries = t.country.select("country", area.alias("area"))
    return spatial.first_area_per_point(t.station.select("station_id", "lon", "lat"), countries, "station_id", "country",
                                        ["country"], bucket_deg=4.0).select("station_id", "country")


@query("J11_nearest_grid_within", f"""
SELECT farm_id, grid_id, round(d / 1000, 2) AS km FROM (SELECT f.farm_id, g.grid_id, {hav('f', 'g')} AS d, row_number() OVER (PARTITION BY f.farm_id ORDER BY round({hav('f', 'g')}, 3), g.grid_id) AS rn
 FROM {{farm}} f JOIN {{grid}} g ON abs(f.lat - g.lat) < 1.5 WHERE {hav('f', 'g')} <= 150000) WHERE rn = 1""")
def _(t):
    return spatial.nearest_within(t.farm, t.grid, "farm_id", "grid_id", 150000.0).select(
        "farm_id", "grid_id", F.round(F.col("distance_m") / 1000, 2).alias("km"))


@query("J12_nearest_station", f"""
WITH s AS (SELECT * FROM {{station}} WHERE station_id IN (SELECT station_id FROM {{measurement}}))
SELECT f.farm_id AS point_id, arg_min(s.station_id, (round({hav('f', 's')}, 3), s.station_id)) AS station_id
FROM {{farm}} f CROSS JOIN s GROUP BY 1""")
def _(t):
    data = t.measurement
    pts = t.farm.select(F.col("farm_id").alias("point_id"), "lon", "lat")
    return observations.nearest_stations(t.station, data, pts).select("point_id", "station_id")


@query("J12b_nearest_track_point", f"""
WITH s AS (SELECT * FROM {{track}} WHERE altitude BETWEEN 1000 AND 1200)
SELECT f.grid_id AS point_id, arg_min(s.history_id, (round({hav('f', 's')}, 3), s.history_id)) AS history_id
FROM {{grid}} f CROSS JOIN s GROUP BY 1""")
def _(t):
    track = observations.altitude_band(t.track, 1000, 1200)
    pts = t.grid.select(F.col("grid_id").alias("point_id"), "lon", "lat")
    return observations.nearest_stations(track, track, pts, "history_id").select("point_id", "history_id")


@query("J13_dimension_lookup", """
WITH d AS (SELECT CAST(substr(b, 7) AS BIGINT) AS brand_id, b AS name FROM (SELECT DISTINCT p_brand AS b FROM part WHERE p_size < 3)),
fresh AS (SELECT lower(p_brand) AS k, min(p_brand) AS name FROM part WHERE lower(p_brand) NOT IN (SELECT lower(name) FROM d) GROUP BY 1),
added AS (SELECT (SELECT COALESCE(max(brand_id), 0) FROM d) + row_number() OVER (ORDER BY md5(k), k) AS brand_id, name FROM fresh),
m AS (SELECT * FROM d UNION ALL SELECT * FROM added)
SELECT p.p_partkey, m.brand_id FROM part p JOIN m ON lower(m.name) = lower(p.p_brand)""")
def _(t):
    # brands of small parts are the known dimension, numbered by their label
    known = t.part.where("p_size < 3").select(F.col("p_brand").alias("name")).distinct()
    known = known.withColumn("brand_id", F.substring("name", 7, 9).cast("long"))
    rows = t.part.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise(F.upper("p_brand")).alias("p_brand"))
    out, _dim = registry.merge_lookup(rows, known.select("brand_id", "name"), "p_brand", "brand_id")
    return out.select("p_partkey", "brand_id")


@query("J14_rule_match", """
WITH v AS (SELECT registry_id, config_id, crop_id, crop_stage_type_id, growth_stage_id,
    unnest(['temperature', 'humidity', 'p_pet', 'growth_stage_precipitation', 'seasonal_precipitation']) AS parameter,
    unnest([temperature, humidity, p_pet, growth_stage_precipitation, seasonal_precipitation]) AS value FROM {advisory_hist}),
h AS (SELECT v.registry_id, v.parameter, arg_min(r.code, r.rule_id) AS code FROM v JOIN {rule} r ON v.config_id = r.config_id AND v.crop_id = r.crop_id
    AND v.crop_stage_type_id = r.crop_stage_type_id AND v.growth_stage_id = r.growth_stage_id AND v.parameter = r.parameter
    AND r.min_range <= v.value AND v.value < r.max_range GROUP BY 1, 2)
SELECT registry_id, string_agg(CAST(code AS VARCHAR), ',' ORDER BY priority DESC, code) AS codes FROM (
  SELECT DISTINCT h.registry_id, h.code, COALESCE(p.priority, 0) AS priority FROM h JOIN {advisory_hist} a ON a.registry_id = h.registry_id
  LEFT JOIN {priority} p ON p.config_id = a.config_id AND p.code = h.code) GROUP BY 1""")
def _(t):
    out = advisory.with_codes(t.advisory_hist, t.rule, t.priority)
    return out.where(F.size("codes") > 0).select("registry_id", F.array_join(F.transform("codes", lambda c: c.cast("string")), ",").alias("codes"))


_MATRIX = "(SELECT *, COALESCE(lag(gdd_threshold) OVER (PARTITION BY crop_id, crop_stage_type_id, config_id ORDER BY gdd_threshold), 0) AS lower_t FROM {matrix})"


@query("J15_growth_stage", f"""
SELECT a.registry_id, COALESCE(m.growth_stage_id, l.growth_stage_id) AS stage, COALESCE(m.lower_t, l.gdd_threshold) AS lower_bound
FROM {{advisory_hist}} a LEFT JOIN {_MATRIX} m ON a.crop_id = m.crop_id AND a.crop_stage_type_id = m.crop_stage_type_id AND a.config_id = m.config_id
   AND a.total_gdd > CASE WHEN m.lower_t = 0 THEN -1 ELSE m.lower_t END AND a.total_gdd <= m.gdd_threshold
 LEFT JOIN (SELECT crop_id, crop_stage_type_id, config_id, max(gdd_threshold) AS gdd_threshold, arg_max(growth_stage_id, gdd_threshold) AS growth_stage_id FROM {{matrix}} GROUP BY 1, 2, 3) l
   ON a.crop_id = l.crop_id AND a.crop_stage_type_id = l.crop_stage_type_id AND a.config_id = l.config_id""")
def _(t):
    m = agronomy.stage_thresholds(t.matrix)
    s = agronomy.stage_of(F.col("total_gdd"), F.col("stages"))
    return (t.advisory_hist.join(m, ["crop_id", "crop_stage_type_id", "config_id"], "left")
            .withColumn("s", F.when(F.col("stages").isNotNull(), s))
            .select("registry_id", F.col("s.stage").alias("stage"), F.col("s.lower").alias("lower_bound")))


@query("J16_snap", """
WITH s AS (SELECT farm_id, lon, lat, CAST(floor((lat + 27.75) / 0.5 + 0.5) AS INT) AS i, CAST(floor((lon - 20.25) / 0.5 + 0.5) AS INT) AS j FROM {farm})
SELECT farm_id, i AS lat_idx, j AS lon_idx, CAST(-27.75 + i * 0.5 AS DOUBLE) AS lat, CAST(20.25 + j * 0.5 AS DOUBLE) AS lon FROM s
WHERE abs(lat - (-27.75 + i * 0.5)) <= 0.1875 AND abs(lon - (20.25 + j * 0.5)) <= 0.1875""")
def _(t):
    return ingest.snap_cells(t.farm.select("farm_id", "lon", "lat"), 20.25, -27.75, 0.5, 0.1875)


@query("J17_cell_to_grid", """
SELECT r.date, r.lat, r.lon, g.grid_id FROM {reanalysis} r JOIN {grid} g ON r.lat = g.lat AND r.lon = g.lon""")
def _(t):
    return ingest.cell_of_grid(t.reanalysis.drop("grid_id"), t.grid).select("date", "lat", "lon", "grid_id")


@query("J18_station_attributes", """
SELECT d.station_id, d.day, s.station_code, s.altitude FROM (SELECT DISTINCT station_id, day FROM {daily_eav}) d JOIN {station} s ON d.station_id = s.station_id""")
def _(t):
    d = t.daily_eav.select("station_id", "day").distinct()
    return observations.join_station(d, t.station).select("station_id", "day", "station_code", "altitude")


@query("J19_back_fill_track", """
SELECT m.measurement_id, CASE WHEN m.measurement_id % 2 = 0 THEN m.measurement_id + 1000000 ELSE h.history_id END AS station_history_id
FROM {measurement} m LEFT JOIN {track} h ON m.station_id = h.station_id AND m.date_time = h.date_time""")
def _(t):
    m = t.measurement.withColumn("station_history_id", F.when(F.col("measurement_id") % 2 == 0, F.col("measurement_id") + 1000000))
    return observations.attach_track_point(m, t.track).select("measurement_id", "station_history_id")


@query("J20_skip_collected", """
SELECT grid_id FROM {grid} WHERE grid_id NOT IN (SELECT l_suppkey FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1998-07-01' AND TIMESTAMP '1998-07-02')""")
def _(t):
    done = t.weather.where(agronomy.between_days("1998-07-01", "1998-07-02"))
    return ingest.skip_collected(t.grid.select("grid_id"), done)


@query("J21_registry_upsert", """
WITH r AS (SELECT registry_id, group_id, farm_id, crop_id, crop_stage_type_id, planting_date, registry_id AS grid_id FROM {registry}),
e AS (SELECT * FROM r WHERE group_id = 0),
u AS (SELECT e.registry_id FROM r JOIN e USING (group_id, farm_id, crop_id, crop_stage_type_id, planting_date))
SELECT 'update' AS kind, count(*) AS n FROM u UNION ALL SELECT 'insert', count(*) FROM (
  SELECT DISTINCT group_id, farm_id, crop_id, crop_stage_type_id, planting_date FROM r WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.group_id = r.group_id AND e.farm_id = r.farm_id
   AND e.crop_id = r.crop_id AND e.crop_stage_type_id = r.crop_stage_type_id AND e.planting_date = r.planting_date))""")
def _(t):
    rows = t.registry.select(*registry.KEY, F.col("registry_id").alias("grid_id"))
    up, ins = registry.split_upsert(rows, t.registry.where("group_id = 0"))
    one = lambda d, k: d.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n")
    return one(up, "update").unionByName(one(ins, "insert"))


@query("J22_publish_signals", """
SELECT s.signal_id, s.signal, f.farm_unique_id, c.country, CAST(year(s.generated_date) AS INT) AS year, CAST(month(s.generated_date) AS INT) AS month
FROM {signal} s JOIN {farm} f ON s.farm_id = f.farm_id LEFT JOIN {grid} g ON f.grid_id = g.grid_id LEFT JOIN {country} c ON g.country_id = c.country_id
WHERE s.farm_id IN (SELECT farm_id FROM {registry} WHERE group_id IN (0, 2))""")
def _(t):
    farms = t.farm.select("farm_id", "farm_unique_id", "grid_id")
    out = planting.publish(t.signal.drop("farm_unique_id"), farms, t.grid.select("grid_id", "country_id"),
                           t.country.select("country_id", "country"), t.registry.where("group_id in (0, 2)"))
    return out.select("signal_id", "signal", "farm_unique_id", "country", "year", "month")


@query("J23_normals_by_month_day", """
SELECT w.grid_id, w.date, strftime(w.date, '%m-%d') AS month_day, n.LTNPrecip FROM {weather} w
LEFT JOIN {normals} n ON n.grid_id = w.grid_id AND strftime(DATE '2023-12-31' + n.dayofyear, '%m-%d') = strftime(w.date, '%m-%d')""")
def _(t):
    n = t.normals.select("grid_id", cubes.normal_month_day(F.col("dayofyear")).alias("month_day"), "LTNPrecip")
    return planting.with_normals(t.weather, n, ["grid_id"]).select("grid_id", "date", "month_day", "LTNPrecip")


@query("J24_group_text", """
SELECT s.signal_id, COALESCE(CASE WHEN x.identifier IS NOT NULL THEN x.top_message ELSE d.top_message END,
  CASE WHEN COALESCE(x.identifier, d.identifier) IS NULL THEN s.signal WHEN CASE WHEN x.identifier IS NOT NULL THEN x.is_plant_now ELSE d.is_plant_now END THEN 'Plant Now' ELSE 'DO NOT PLANT' END) AS top_message,
  COALESCE(CASE WHEN x.identifier IS NOT NULL THEN x.description ELSE d.description END, '') AS description
FROM {signal} s JOIN {farm} f ON s.farm_id = f.farm_id LEFT JOIN {signal_text} x ON x.identifier = f.farm_group || '-' || s.signal
LEFT JOIN {signal_text} d ON d.identifier = s.signal""")
def _(t):
    s = t.signal.join(t.farm.select("farm_id", "farm_group"), "farm_id")
    return planting.signal_text(s, t.signal_text).select("signal_id", "top_message", "description")


@query("J25_message_text", """
SELECT a.registry_id, m.template_en AS message_english, CASE a.preferred_language WHEN 'sw' THEN m.template_sw ELSE m.template_en END AS message_final
FROM {advisory_hist} a LEFT JOIN {template} m ON a.final_message = m.code""")
def _(t):
    return advisory.with_message_text(t.advisory_hist, t.template).select("registry_id", "message_english", "message_final")


@query("J26_stage_write_back", """
SELECT r.registry_id, COALESCE(a.growth_stage_id, r.prev_growth_stage_id) AS prev_growth_stage_id, COALESCE(a.growth_stage_start_date, r.prev_growth_stage_start_date) AS prev_growth_stage_start_date
FROM {registry} r LEFT JOIN (SELECT * FROM {advisory_hist} WHERE NOT is_empty_message) a ON r.registry_id = a.registry_id""")
def _(t):
    out = advisory.write_back_stages(t.registry, t.advisory_hist.where("not is_empty_message"))
    return out.select("registry_id", "prev_growth_stage_id", "prev_growth_stage_start_date")


@query("J27_reconcile", """
SELECT f.farm_unique_id, s.signal_id, a.registry_id, CAST(s.signal <> 'Plant NOW Tier 1a' AS INT) AS is_diff FROM {farm} f JOIN {signal} s ON f.farm_unique_id = s.farm_unique_id
LEFT JOIN {advisory_hist} a ON a.farm_unique_id = f.farm_unique_id WHERE s.generated_date = DATE '1998-06-12'""")
def _(t):
    farmers = t.farm.select(F.col("farm_unique_id").alias("farmer_id"), F.lit("Plant NOW Tier 1a").alias("sent_signal"))
    s = t.signal.select("signal_id", "farm_unique_id", F.col("generated_date").alias("date"), "signal")
    a = t.advisory_hist.select("farm_unique_id", "registry_id")
    return audit.compare_signals(farmers, s, "1998-06-12", a).select("farm_unique_id", "signal_id", "registry_id", "is_diff")


_RECENT = """(SELECT DISTINCT farm_id, crop_id, code FROM (SELECT farm_id, crop_id, unnest([message, message_2, message_3, message_4, message_5]) AS code
  FROM {advisory_hist} WHERE message_date >= TIMESTAMP '1997-07-01 00:00:00') WHERE code IS NOT NULL)"""


def keep_sql(slot: str) -> str:
    return (f"CASE WHEN EXISTS (SELECT 1 FROM recent r WHERE r.farm_id = a.farm_id AND r.crop_id = a.crop_id AND r.code = a.{slot})"
            f" THEN NULL ELSE a.{slot} END AS {slot}")


@query("J28_suppress_recent", f"""
WITH recent AS {_RECENT} SELECT a.registry_id, {keep_sql('message')}, {keep_sql('message_2')}, {keep_sql('message_3')}
FROM (SELECT registry_id, farm_id, crop_id, message_2 AS message, message_4 AS message_2, message_3 FROM {{advisory_hist}}) a""")
def _(t):
    new = t.advisory_hist.select("registry_id", "farm_id", "crop_id", F.col("message_2").alias("message"), F.col("message_4").alias("message_2"),
                                 "message_3", F.lit(None).cast("int").alias("message_4"), F.lit(None).cast("int").alias("message_5"))
    return advisory.suppress_recent(new, t.advisory_hist, "1998-07-01", 52 + 1 / 7).select("registry_id", "message", "message_2", "message_3")


@query("J29_pest_templates", """
SELECT o_orderkey, p.p_partkey AS message_no FROM orders o JOIN part p ON o.o_orderkey % 50 = p.p_size AND o.o_orderkey % 3 = p.p_partkey % 3
 AND (CASE WHEN o.o_orderkey % 4 = 0 THEN NULL ELSE o.o_orderkey % 4 END) IS NOT DISTINCT FROM (CASE WHEN p.p_partkey % 4 = 0 THEN NULL ELSE p.p_partkey % 4 END)""")
def _(t):
    k, p = F.col("o_orderkey"), F.col("p_partkey")
    rows = t.orders.select("o_orderkey", (k % 50).cast("int").alias("pest_id"), (k % 3).alias("group"), F.when(k % 4 != 0, k % 4).alias("farm_group_id"))
    messages = t.part.select(F.col("p_size").alias("pest_id"), (p % 3).alias("group"), F.when(p % 4 != 0, p % 4).alias("farm_group_id"),
                             p.alias("message_no"), F.col("p_name").alias("template_en"), F.col("p_type").alias("template_sw"))
    return pests.join_messages(rows, messages).select("o_orderkey", "message_no")


@query("J30_backfill_plan", """
WITH d AS (SELECT dataset_id, CAST(unnest(generate_series(date_trunc('month', min(version)), max(version), INTERVAL 1 MONTH)) AS DATE) AS day FROM {source_file} GROUP BY dataset_id)
SELECT d.dataset_id, d.day FROM d WHERE NOT EXISTS (SELECT 1 FROM {source_file} s WHERE s.dataset_id = d.dataset_id AND CAST(date_trunc('month', s.version) AS DATE) = d.day AND s.is_latest)""")
def _(t):
    span = t.source_file.groupBy("dataset_id").agg(F.min("version").cast("date").alias("lo"), F.max("version").cast("date").alias("hi"))
    done = t.source_file.where("is_latest").select("dataset_id", F.trunc("version", "month").alias("day")).distinct()
    return catalog.month_starts(span, "lo", "hi").select("dataset_id", "day").join(done, ["dataset_id", "day"], "left_anti")


@query("J31_pest_names", """
SELECT no, variable, CASE variable WHEN 'beetle' THEN 1 WHEN 'borer' THEN 2 ELSE 3 END AS pest_id
FROM (SELECT no, unnest(['beetle', 'borer', 'worm']) AS variable, unnest([beetle, borer, worm]) AS value FROM {pest_sheet}) WHERE value IS NOT NULL""")
def _(t):
    long = pests.sheet_to_long(t.pest_sheet, ["no"], PESTS, min_values=1)
    return pests.with_pest(long, pest_table(t)).select("no", "variable", F.col("pest_id").cast("int").alias("pest_id"))


PESTS = ["beetle", "borer", "worm"]


def pest_table(t):
    return t.spark.createDataFrame([(1, "beetle"), (2, "borer"), (3, "worm")], "pest_id int, variable_name string")
