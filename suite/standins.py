"""Derived input tables (see base.derive)."""

from suite.base import derive

# ---- places ---------------------------------------------------------------

derive("country", """
SELECT n_nationkey AS country_id, n_name AS country,
       concat('N', CAST(n_nationkey AS STRING)) AS iso_a3, n_regionkey AS region_id,
       20 + (n_nationkey % 5) * 8E0 AS lon0, -28 + floor(n_nationkey / 5) * 11.25E0 AS lat0
FROM {nation}""")

derive("grid", """
SELECT s_suppkey AS grid_id, concat('G', CAST(s_suppkey AS STRING)) AS grid_unique_id,
       s_nationkey AS country_id, CAST(floor(s_acctbal) AS BIGINT) AS elevation,
       20 + (s_suppkey % 80) * 0.5E0 AS lon0,
       -28 + ((13 * s_suppkey + CAST(floor(s_suppkey / 80) AS BIGINT)) % 112) * 0.5E0 AS lat0,
       20.25E0 + (s_suppkey % 80) * 0.5E0 AS lon,
       -27.75E0 + ((13 * s_suppkey + CAST(floor(s_suppkey / 80) AS BIGINT)) % 112) * 0.5E0 AS lat
FROM {supplier}""")

derive("station", """
SELECT user_id AS station_id, concat('S', CAST(user_id AS STRING)) AS station_code,
       20 + (user_id * 37 % 320) / 8 AS lon, -28 + (user_id * 53 % 448) / 8 AS lat,
       CAST(user_id * 17 % 3000 AS DOUBLE) AS altitude, CAST(user_id % 25 AS INT) AS country_id
FROM (SELECT DISTINCT user_id FROM {events}) u""")

derive("track", """
SELECT user_id AS station_id, ts AS date_time, min(event_id) AS history_id,
       min(20 + (event_id * 37 % 2560) / 64) AS lon, min(-28 + (event_id * 53 % 3584) / 64) AS lat,
       CAST(min(event_id * 17 % 3000) AS DOUBLE) AS altitude
FROM {events} GROUP BY user_id, ts""")

derive("farm", """
SELECT c_custkey AS farm_id, concat('F', CAST(c_custkey AS STRING)) AS farm_unique_id,
       c_custkey % (SELECT count(*) FROM {supplier}) AS grid_id, c_name AS phone,
       c_mktsegment AS farm_group, c_nationkey AS country_id,
       20.0625E0 + (c_custkey * 29 % 640) / 16 AS lon,
       -27.9375E0 + (c_custkey * 31 % 896) / 16 AS lat,
       CASE c_custkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'sw' ELSE 'fr' END AS preferred_language
FROM {customer}""")

# ---- observations ---------------------------------------------------------

derive("measurement", """
SELECT user_id AS station_id, CAST(NULL AS BIGINT) AS station_history_id,
       event_type AS attribute, ts AS date_time, floor(value * 8) / 8 AS value,
       event_id AS measurement_id
FROM {events}""")

derive("daily_eav", """
SELECT user_id AS station_id, event_type AS attribute, CAST(ts AS DATE) AS day,
       floor(value * 8) / 8 AS value
FROM {events}""")

derive("weather", """
SELECT l_suppkey AS grid_id, CAST(l_shipdate AS DATE) AS date,
       max(l_quantity) AS max_temperature, min(l_quantity) * 0.5E0 AS min_temperature,
       CAST(sum(l_linenumber) AS DOUBLE) AS total_rainfall,
       CAST(sum(l_linenumber % 3) AS DOUBLE) AS total_evapotranspiration,
       CAST(max(l_linenumber) * 10 AS DOUBLE) AS humidity
FROM {lineitem} GROUP BY l_suppkey, CAST(l_shipdate AS DATE)""")

derive("reanalysis", """
SELECT w.date, g.lat, g.lon, g.grid_id, w.max_temperature, w.total_rainfall
FROM {weather} w JOIN {grid} g ON w.grid_id = g.grid_id""")

derive("reanalysis_hourly", """
SELECT CAST(ts AS DATE) AS date, CAST(hour(ts) AS INT) AS hour,
       20.25E0 + (user_id % 80) * 0.5E0 AS lon, -27.75E0 + (user_id * 13 % 112) * 0.5E0 AS lat,
       max(floor(value * 8) / 8) AS max_temperature
FROM {events} GROUP BY 1, 2, 3, 4""")

derive("forecast", """
SELECT CAST(ts AS DATE) AS forecast_date, CAST(event_id % 21 - 6 AS INT) AS forecast_day_idx,
       20.25E0 + (user_id % 80) * 0.5E0 AS lon, -27.75E0 + (user_id * 13 % 112) * 0.5E0 AS lat,
       max(floor(value * 8) / 8) AS max_temperature, min(floor(value * 4) / 8) AS min_temperature,
       max(event_id % 30) * 1E0 AS total_rainfall
FROM {events} GROUP BY 1, 2, 3, 4""")

derive("forecast_hourly", """
SELECT CAST(ts AS DATE) AS forecast_date, CAST(event_id % 4 + 1 AS INT) AS forecast_day_idx,
       CAST(event_id % 24 AS INT) AS hour,
       20.25E0 + (user_id % 80) * 0.5E0 AS lon, -27.75E0 + (user_id * 13 % 112) * 0.5E0 AS lat,
       max(floor(value * 8) / 8) AS temperature
FROM {events} GROUP BY 1, 2, 3, 4, 5""")

derive("ensemble", """
SELECT CAST(date_trunc('month', l.l_shipdate) AS DATE) AS forecast_date,
       CAST(day(l.l_shipdate) - 1 AS INT) AS forecast_day_idx, l.l_linenumber AS ensemble,
       g.lat, g.lon, max(l.l_quantity) AS temp, max(l.l_linenumber % 4) * 1E0 AS temp_clim
FROM {lineitem} l JOIN {grid} g ON l.l_suppkey = g.grid_id
GROUP BY 1, 2, 3, 4, 5""")

derive("normals", """
SELECT CAST(dayofyear(CAST(l.l_shipdate AS DATE)) AS INT) AS dayofyear, g.grid_id, g.lat, g.lon,
       max(l.l_quantity) AS LTNPrecip, min(l.l_quantity) AS LTNPET
FROM {lineitem} l JOIN {grid} g ON l.l_suppkey = g.grid_id GROUP BY 1, 2, 3, 4""")

derive("raster", """
SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP_NTZ) AS time,
       20.25E0 + (user_id % 80) * 0.5E0 AS lon, -27.75E0 + (user_id * 13 % 112) * 0.5E0 AS lat,
       max(floor(value * 8) / 8) AS precipitation
FROM {events} GROUP BY 1, 2, 3""".replace("TIMESTAMP_NTZ", "TIMESTAMP"))

# ---- agronomy configuration ----------------------------------------------

derive("crop", """SELECT DISTINCT CAST(p_partkey % 9 AS INT) AS crop_id,
       concat('Crop', CAST(p_partkey % 9 AS STRING)) AS crop FROM {part}""")
derive("stage_type", """SELECT DISTINCT CAST(p_partkey % 3 + 1 AS INT) AS crop_stage_type_id,
       concat('Type', CAST(p_partkey % 3 + 1 AS STRING)) AS stage_type FROM {part}""")
derive("stage_label", """SELECT DISTINCT CAST(p_partkey % 5 + 1 AS INT) AS growth_stage_id,
       concat('Stage ', CAST(p_partkey % 5 + 1 AS STRING)) AS growth_stage FROM {part}""")
derive("config_override", """SELECT n_nationkey AS country_id, 2 AS config_id
       FROM {nation} WHERE n_regionkey = 0""")
derive("gdd_config", """SELECT DISTINCT CAST(p_partkey % 9 AS INT) AS crop_id,
       CAST(floor(p_partkey / 9) AS INT) % 2 + 1 AS config_id,
       8E0 + p_partkey % 3 AS gdd_base, 25E0 + 5 * (p_partkey % 3) AS gdd_cap FROM {part}""")
derive("matrix", """
SELECT DISTINCT crop_id, crop_stage_type_id, config_id, growth_stage_id,
       growth_stage_id * 75E0 + crop_id * 5 + config_id AS gdd_threshold FROM (
  SELECT CAST(p_partkey % 8 AS INT) AS crop_id,
         CAST(floor(p_partkey / 8) AS INT) % 3 + 1 AS crop_stage_type_id,
         CAST(floor(p_partkey / 24) AS INT) % 2 + 1 AS config_id,
         CAST(floor(p_partkey / 48) AS INT) % 5 + 1 AS growth_stage_id FROM {part}) m""")
derive("rule", """
SELECT p_partkey AS rule_id, CAST(p_partkey % 2 + 1 AS INT) AS config_id,
       CAST(floor(p_partkey / 2) AS INT) % 9 AS crop_id,
       CAST(floor(p_partkey / 18) AS INT) % 3 + 1 AS crop_stage_type_id,
       CAST(floor(p_partkey / 54) AS INT) % 5 + 1 AS growth_stage_id,
       CASE p_size % 5 WHEN 0 THEN 'temperature' WHEN 1 THEN 'humidity' WHEN 2 THEN 'p_pet'
            WHEN 3 THEN 'growth_stage_precipitation' ELSE 'seasonal_precipitation' END AS parameter,
       p_size * 0.5E0 AS min_range, p_size * 0.5E0 + 40 AS max_range,
       CAST(1000 + p_partkey % 97 AS INT) AS code FROM {part}""")
derive("priority", """SELECT DISTINCT CAST(p_partkey % 2 + 1 AS INT) AS config_id,
       CAST(1000 + p_partkey % 97 AS INT) AS code,
       CAST(p_partkey % 97 * 7 % 11 AS INT) AS priority FROM {part}""")
derive("template", """SELECT CAST(1000 + p_partkey % 97 AS INT) AS code, min(p_name) AS template_en,
       min(p_type) AS template_sw FROM {part} GROUP BY 1""")

# ---- registry and past advisories ----------------------------------------

derive("registry", """
SELECT o_orderkey AS registry_id, o_custkey AS farm_id, o_orderkey % 4 AS group_id,
       CAST(o_orderkey % 9 AS INT) AS crop_id,
       CAST(substr(o_orderpriority, 1, 1) AS INT) % 3 + 1 AS crop_stage_type_id,
       DATE '1998-06-30' - CAST(o_orderkey % 120 AS INT) AS planting_date,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderkey % 5 AS INT) END
           AS prev_growth_stage_id,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (10390 - o_orderkey % 50) * 86400 END
           AS prev_growth_stage_start_date
FROM {orders}""")

derive("registry_full", """
SELECT r.registry_id, r.farm_id, r.group_id, r.crop_id, r.crop_stage_type_id, r.planting_date,
       r.prev_growth_stage_id, r.prev_growth_stage_start_date, f.grid_id,
       f.farm_unique_id, f.preferred_language, f.lon, f.lat,
       COALESCE(o.config_id, 1) AS config_id, c.iso_a3, c.country_id,
       CAST(r.planting_date - DATE '1970-01-01' AS BIGINT) * 86400 AS planting_date_epoch
FROM {registry} r JOIN {farm} f ON r.farm_id = f.farm_id JOIN {grid} g ON f.grid_id = g.grid_id
JOIN {country} c ON g.country_id = c.country_id
LEFT JOIN {config_override} o ON c.country_id = o.country_id""")

derive("advisory_hist", """
SELECT o_orderkey AS registry_id, o_custkey AS farm_id,
       concat('F', CAST(o_custkey AS STRING)) AS farm_unique_id,
       o_custkey % (SELECT count(*) FROM {supplier}) AS grid_id,
       CAST(o_orderkey % 9 AS INT) AS crop_id, concat('Crop', CAST(o_orderkey % 9 AS STRING)) AS crop,
       CAST(o_orderkey % 3 + 1 AS INT) AS crop_stage_type_id,
       (10300 + o_orderkey % 60) * 86400 AS planting_date_epoch,
       CAST(o_orderkey % 2 + 1 AS INT) AS config_id,
       concat('N', CAST(o_orderkey % 25 AS STRING)) AS iso_a3,
       CAST(o_orderdate AS DATE) AS date, o_orderdate AS message_date,
       CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month,
       CAST(day(o_orderdate) AS INT) AS day,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(1000 + o_orderkey % 97 AS INT) END AS message,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(1000 + o_orderkey * 3 % 97 AS INT) END AS message_2,
       CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE CAST(1000 + o_orderkey * 5 % 97 AS INT) END AS message_3,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(1000 + o_orderkey * 7 % 97 AS INT) END AS message_4,
       CAST(NULL AS INT) AS message_5,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(1000 + o_orderkey % 97 AS INT) END AS final_message,
       CASE WHEN o_orderkey % 11 = 0 THEN CAST(1000 + o_orderkey % 97 AS INT) END AS prev_week_message,
       o_orderkey % 7 = 0 AS is_empty_message,
       (o_orderkey % 11 = 0 AND o_orderkey % 7 <> 0) AS has_repetitive_message,
       CAST(o_orderkey % 5 + 1 AS INT) AS growth_stage_id,
       concat('Stage ', CAST(o_orderkey % 5 + 1 AS STRING)) AS growth_stage,
       (10300 + o_orderkey % 90) * 86400 AS growth_stage_start_date,
       (o_orderkey % 800) / 8 AS humidity, (o_orderkey % 400) / 8 AS temperature,
       (o_orderkey % 24) / 8 AS p_pet, (o_orderkey % 1600) / 8 AS seasonal_precipitation,
       (o_orderkey % 160) / 8 AS growth_stage_precipitation, (o_orderkey % 6400) / 8 AS total_gdd,
       CASE o_orderkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'sw' ELSE 'fr' END AS preferred_language
FROM {orders}""")

# ---- planting signals, decisions, pests, requests -------------------------

derive("signal", """
SELECT o_orderkey AS signal_id, o_custkey AS farm_id,
       concat('F', CAST(o_custkey AS STRING)) AS farm_unique_id,
       DATE '1998-06-01' + CAST(o_orderkey % 60 AS INT) AS generated_date,
       CASE o_orderstatus WHEN 'F' THEN 'Plant NOW Tier 1a' WHEN 'O' THEN 'Plant NOW Tier 1b'
            ELSE 'Do NOT plant Tier 4' END AS signal,
       CASE WHEN o_orderkey % 6 = 0 THEN 'Too wet' END AS too_wet_indicator,
       (o_orderkey % 320) / 8 AS last_4_days, (o_orderkey % 160) / 8 AS last_2_days,
       (o_orderkey % 80) / 8 AS today_tomorrow, o_orderkey % 10 = 0 AS is_sent_before
FROM {orders}""")

derive("signal_text", """
SELECT DISTINCT CASE WHEN p_partkey % 4 = 0 THEN 'Plant NOW Tier 1a'
            WHEN p_partkey % 4 = 1 THEN 'Plant NOW Tier 1b'
            ELSE 'BUILDING-Plant NOW Tier 1a' END AS identifier,
       CASE WHEN p_partkey % 4 >= 2 THEN 'Go ahead' END AS top_message,
       p_partkey % 4 = 0 AS is_plant_now,
       concat('Text ', CAST(CASE WHEN p_partkey % 4 >= 2 THEN 2 ELSE p_partkey % 4 END AS STRING))
           AS description,
       CASE WHEN p_partkey % 4 = 0 THEN 'Maandishi' END AS description_sw
FROM {part}""")

derive("cells", """
SELECT grid_id, lat, lon, (grid_id * 7 % 100) * 1E0 AS pfc_mean, (grid_id % 13) * 1E0 AS pfc_std,
       (grid_id * 11 % 100) * 1E0 AS pfc_ecmwf_mean, (grid_id % 11) * 1E0 + 1 AS pfc_ecmwf_std,
       (grid_id * 3 % 60) * 1E0 AS wrsi_mean, (grid_id % 7) * 1E0 + 0.5E0 AS wrsi_std,
       (grid_id % 2) * 1E0 AS spw_20, (grid_id % 3 % 2) * 1E0 AS spw_40, (grid_id % 5 % 2) * 1E0 AS spw_60
FROM {grid}""")

derive("climatology", """
SELECT g.lat, g.lon, w.date, w.max_temperature AS clim_mean_wrsi
FROM {weather} w JOIN {grid} g ON w.grid_id = g.grid_id""")

derive("pest_sheet", """
SELECT o_orderkey AS no, o_custkey AS farm_id, CAST(o_orderdate AS DATE) AS generated_at,
       CASE o_orderkey % 3 WHEN 0 THEN 'Near-Real-Time' WHEN 1 THEN 'Climatological' ELSE 'near_real_time' END
           AS raw_type,
       CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 28) * 1E0 END AS beetle,
       CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 25) + 0.5E0 END AS borer,
       CASE WHEN o_orderkey % 5 = 0 THEN (o_orderkey % 23) * 1E0 END AS worm
FROM {orders}""")

derive("request_log", """
SELECT event_id AS request_id, user_id, ts AS requested_at,
       CAST(floor(value * 8) AS BIGINT) AS response_ms,
       CASE event_type WHEN 'error' THEN 500 + CAST(event_id % 3 AS INT) ELSE 200 END AS status_code,
       concat('{"product": "', event_type, '", "attributes": "temp, rain_', CAST(event_id % 5 AS STRING),
              '", "output_type": "', CASE event_id % 2 WHEN 0 THEN 'csv' ELSE 'json' END,
              '", "start_date": "', CAST(CAST(ts AS DATE) AS STRING), '"}') AS query_params
FROM {events}""")

# ---- catalogue ------------------------------------------------------------

derive("dataset", """
SELECT DISTINCT CAST(floor(p_partkey / 25) AS INT) % 12 AS dataset_id,
       concat('Product_', CAST(CAST(floor(p_partkey / 25) AS INT) % 6 AS STRING)) AS product,
       CAST(floor(p_partkey / 25) AS INT) % 12 = 7 AS is_internal FROM {part}""")
derive("attribute", """
SELECT DISTINCT CAST(p_partkey % 10 AS INT) AS attribute_id,
       concat('var_', CAST(p_partkey % 10 AS STRING)) AS variable_name,
       concat('u', CAST(p_partkey % 10 % 3 AS STRING)) AS unit,
       concat('Variable ', CAST(p_partkey % 10 AS STRING)) AS long_name,
       p_partkey % 10 <> 3 AS is_active
FROM {part}""")
derive("dataset_attribute", """
SELECT p_partkey AS dataset_attribute_id, CAST(floor(p_partkey / 25) AS INT) % 12 AS dataset_id,
       CAST(p_partkey % 10 AS INT) AS attribute_id, p_brand AS source FROM {part}""")
derive("source_file", """
SELECT o_orderkey AS file_id, CAST(o_orderkey % 40 AS INT) AS dataset_id, o_orderdate AS version,
       CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS deleted_at,
       o_orderkey % 13 = 0 AS is_latest,
       concat('var', CAST(o_orderkey % 4 AS STRING), '_', CAST(year(o_orderdate) AS STRING), '.nc') AS name,
       concat('daily_', CAST(CAST(o_orderdate AS DATE) AS STRING), '.nc') AS daily_name
FROM {orders}""")
