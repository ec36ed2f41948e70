"""D, N: domain operators and the model hook."""

from pyspark.sql import functions as F

from furrow.functions import geo
from furrow.plans import advisory, agronomy, audit, catalog, cropplan, cubes, ingest, observations, pests, planting, registry
from furrow.plans.observations import Location
from furrow.session import scratch_dir
from suite.aggregates import ATTRIBUTES, LOG_SQL, external_log
from suite.base import FIRST_DAY, REQUEST_DATE, query
from suite.filters import HOLE, RING, hav, inside_sql
from suite.joins import PESTS, grid_areas, keep_sql, pest_table
from suite.windows import FEATURE_SQL, STAGE_SQL, schedules, season

# ---- advisory -------------------------------------------------------------


@query("D01_grid_features", f"""
WITH {FEATURE_SQL} SELECT g.grid_id, CAST(COALESCE(o.config_id, 1) AS INT) AS config_id, f.temperature, f.humidity, f.total_rainfall, f.p_pet
FROM {{grid}} g JOIN feat f ON f.grid_id = g.grid_id LEFT JOIN {{config_override}} o ON o.country_id = g.country_id
WHERE g.grid_id IN (SELECT grid_id FROM {{registry_full}})""")
def _(t):
    grids = agronomy.registry_grids(t.registry_full, t.grid, t.country.select("country_id", "iso_a3"))
    grids = agronomy.config_by_country(grids, t.config_override, 1)
    return grids.select("grid_id", "config_id").join(agronomy.grid_features(t.weather, REQUEST_DATE), "grid_id").select(
        "grid_id", "config_id", "temperature", "humidity", "total_rainfall", "p_pet")


GCF_SQL = STAGE_SQL + ", " + FEATURE_SQL + """, gcf AS (SELECT s.*, f.temperature, f.humidity, f.p_pet,
  COALESCE(r1.v, 0) AS seasonal_precipitation, COALESCE(r2.v, 0) AS growth_stage_precipitation
 FROM staged s JOIN feat f ON f.grid_id = s.grid_id
 LEFT JOIN (SELECT k.grid_id, k.planting_date, sum(w.total_rainfall) AS v FROM (SELECT DISTINCT grid_id, planting_date FROM staged) k JOIN {weather} w ON w.grid_id = k.grid_id AND w.date >= k.planting_date AND w.date <= DATE '1998-07-04' GROUP BY 1, 2) r1
   ON r1.grid_id = s.grid_id AND r1.planting_date = s.planting_date
 LEFT JOIN (SELECT k.grid_id, k.growth_stage_start_date, sum(w.total_rainfall) AS v FROM (SELECT DISTINCT grid_id, growth_stage_start_date FROM staged) k JOIN {weather} w ON w.grid_id = k.grid_id
     AND (k.growth_stage_start_date IS NULL OR w.date >= DATE '1970-01-01' + CAST(k.growth_stage_start_date / 86400 AS INT)) AND w.date BETWEEN DATE '1998-03-03' AND DATE '1998-07-04' GROUP BY 1, 2) r2
   ON r2.grid_id = s.grid_id AND r2.growth_stage_start_date IS NOT DISTINCT FROM s.growth_stage_start_date)"""
_GK = ["grid_id", "crop_id", "crop_stage_type_id", "planting_date_epoch", "prev_growth_stage_id", "prev_growth_stage_start_date", "config_id"]
_GV = ["total_gdd", "growth_stage_id", "growth_stage_start_date", "seasonal_precipitation", "growth_stage_precipitation", "temperature", "humidity", "p_pet"]


def features(t):
    return agronomy.grid_crop_features(agronomy.registry_grid_crops(t.registry_full), t.weather, t.gdd_config, t.matrix, REQUEST_DATE, FIRST_DAY)


@query("D02_grid_crop_features", f"WITH {GCF_SQL} SELECT {', '.join(_GK + _GV)} FROM gcf")
def _(t):
    return features(t).select(*_GK, *_GV)


def code_sql(source: str, keys: str) -> str:
    """Matched codes in slots for rows of ``source`` identified by ``keys``."""
    return f"""pv AS (SELECT {keys}, growth_stage_id, unnest(['temperature', 'humidity', 'p_pet', 'growth_stage_precipitation', 'seasonal_precipitation']) AS parameter,
    unnest([COALESCE(temperature, 0), COALESCE(humidity, 0), COALESCE(p_pet, 0), COALESCE(growth_stage_precipitation, 0), COALESCE(seasonal_precipitation, 0)]) AS value FROM {source}),
 hits AS (SELECT {', '.join('pv.' + k for k in keys.split(', '))}, pv.parameter, arg_min(r.code, r.rule_id) AS code FROM pv JOIN {{rule}} r ON pv.config_id = r.config_id AND pv.crop_id = r.crop_id
    AND pv.crop_stage_type_id = r.crop_stage_type_id AND pv.growth_stage_id = r.growth_stage_id AND pv.parameter = r.parameter AND r.min_range <= pv.value AND pv.value < r.max_range GROUP BY ALL),
 ranked AS (SELECT h.*, row_number() OVER (PARTITION BY {', '.join('h.' + k for k in keys.split(', '))} ORDER BY COALESCE(p.priority, 0) DESC, h.code) AS rn FROM (SELECT DISTINCT {keys}, code FROM hits) h
    LEFT JOIN {{priority}} p ON p.config_id = h.config_id AND p.code = h.code),
 slots AS (SELECT {keys}, max(code) FILTER (rn = 1) AS message, max(code) FILTER (rn = 2) AS message_2, max(code) FILTER (rn = 3) AS message_3,
    max(code) FILTER (rn = 4) AS message_4, max(code) FILTER (rn = 5) AS message_5 FROM ranked GROUP BY ALL)"""


_HK = "registry_id, config_id, crop_id, crop_stage_type_id"


@query("D03_advisory_codes", f"""
WITH {code_sql('advisory_hist', _HK)} SELECT a.registry_id, s.message, s.message_2, s.message_3, s.message_4, s.message_5
FROM {{advisory_hist}} a LEFT JOIN slots s ON s.registry_id = a.registry_id""")
def _(t):
    coded = advisory.with_codes(t.advisory_hist.drop(*advisory.SLOTS), t.rule, t.priority)
    return advisory.to_slots(coded).select("registry_id", *advisory.SLOTS)


@query("D04_final_message", """
SELECT registry_id, message IS NULL AS is_empty_message, COALESCE(message = prev_week_message, false) AS has_repetitive_message,
  CASE WHEN message = prev_week_message AND message_2 IS NOT NULL THEN message_2 ELSE message END AS final_message FROM {advisory_hist}""")
def _(t):
    return advisory.final_message(t.advisory_hist).select("registry_id", "is_empty_message", "has_repetitive_message", "final_message")


_FARM_OUT = ["registry_id", "total_gdd", "growth_stage_id", "growth_stage_start_date", "growth_stage", "seasonal_precipitation",
             "growth_stage_precipitation", "temperature", "humidity", "p_pet", "message", "message_2", "message_3", "is_empty_message",
             "has_repetitive_message", "final_message", "iso_a3", "config_id"]
_SK = "grid_id, crop_id, crop_stage_type_id, planting_date, prev_growth_stage_id, prev_growth_stage_start_date, config_id"


def farm_table(t):
    farm = t.farm.select("farm_id", "farm_unique_id", "grid_id", "preferred_language", "lon", "lat")
    return advisory.run(t.registry, farm, t.grid.select("grid_id", "country_id", "grid_unique_id"), t.crop, t.stage_type,
                        t.country.select("country_id", "iso_a3"), t.weather, t.gdd_config, t.matrix, t.rule, t.priority,
                        t.stage_label, REQUEST_DATE, FIRST_DAY, t.config_override, 1, previous_week(t))


def previous_week(t):
    """Messages of the run a week earlier stand in for the stored ones."""
    return advisory.previous_messages(t.advisory_hist, t.priority)


PREV_SQL = """prevm AS (SELECT a.grid_id, a.crop_id, a.crop_stage_type_id, a.planting_date_epoch, arg_min(a.final_message, (-COALESCE(p.priority, 0), a.final_message)) AS prev
  FROM {advisory_hist} a LEFT JOIN {priority} p ON a.config_id = p.config_id AND a.final_message = p.code WHERE a.final_message IS NOT NULL GROUP BY 1, 2, 3, 4)"""
FARM_SQL = GCF_SQL + ", " + code_sql("gcf", _SK) + ", " + PREV_SQL + f""", farmadv AS (SELECT r.registry_id, r.farm_unique_id, r.preferred_language, r.iso_a3, r.config_id, r.grid_id, r.crop_id, r.planting_date, g.total_gdd, g.growth_stage_id, g.growth_stage_start_date, l.growth_stage,
  g.seasonal_precipitation, g.growth_stage_precipitation, g.temperature, g.humidity, g.p_pet, s.message, s.message_2, s.message_3, s.message_4, s.message_5, s.message IS NULL AS is_empty_message,
  COALESCE(s.message = pm.prev, false) AS has_repetitive_message, CASE WHEN s.message = pm.prev AND s.message_2 IS NOT NULL THEN s.message_2 ELSE s.message END AS final_message, pm.prev AS prev_week_message
 FROM {{registry_full}} r JOIN gcf g ON {' AND '.join(f'g.{k} IS NOT DISTINCT FROM r.{k}' for k in _SK.split(', '))}
 LEFT JOIN slots s ON {' AND '.join(f's.{k} IS NOT DISTINCT FROM g.{k}' for k in _SK.split(', '))}
 LEFT JOIN prevm pm ON pm.grid_id = g.grid_id AND pm.crop_id = g.crop_id AND pm.crop_stage_type_id = g.crop_stage_type_id AND pm.planting_date_epoch = g.planting_date_epoch
 LEFT JOIN {{stage_label}} l ON l.growth_stage_id = g.growth_stage_id)"""


@query("D05_farm_advisory", f"WITH {FARM_SQL} SELECT {', '.join(_FARM_OUT)} FROM farmadv")
def _(t):
    return farm_table(t).select(*_FARM_OUT)


_EXPORT = ["farmer_id", "message_final", "message_english", "message_code", "crop", "planting_date", "growth_stage", "relative_humidity",
           "ppet", "growth_stage_date", "registry_id", "preferred_language", "is_empty_message"]


@query("D06_advisory_export", """
SELECT a.farm_unique_id AS farmer_id, CASE a.preferred_language WHEN 'sw' THEN m.template_sw ELSE m.template_en END AS message_final, m.template_en AS message_english,
  a.final_message AS message_code, a.crop, strftime(DATE '1970-01-01' + CAST(a.planting_date_epoch / 86400 AS INT), '%Y-%m-%d') AS planting_date, a.growth_stage, a.humidity AS relative_humidity,
  a.p_pet AS ppet, strftime(DATE '1970-01-01' + CAST(a.growth_stage_start_date / 86400 AS INT), '%Y-%m-%d') AS growth_stage_date, a.registry_id, a.preferred_language, a.is_empty_message
FROM {advisory_hist} a LEFT JOIN {template} m ON a.final_message = m.code WHERE a.year = 1998 AND a.month = 7 AND a.day = (SELECT min(day) FROM {advisory_hist} WHERE year = 1998 AND month = 7)""".replace(
    "a.day = (SELECT min(day) FROM {advisory_hist} WHERE year = 1998 AND month = 7)", "a.day = 14"))
def _(t):
    return advisory.advisory_export(t.advisory_hist, "1998-07-14", t.template, _EXPORT)


@query("D07_error_log", """
SELECT 42 AS request_id, registry_id AS farm_registry_id, kind AS error_type, CASE kind WHEN 'MISSING_MESSAGES' THEN 'Farm registry has no advisory message' ELSE 'First message is repetitive message' END AS error_message,
  '[' || array_to_string(list_transform([message, message_2, message_3, message_4, message_5, final_message], lambda x: COALESCE(CAST(x AS VARCHAR), 'null')), ',') || ']' AS messages
FROM (SELECT *, 'MISSING_MESSAGES' AS kind FROM {advisory_hist} WHERE is_empty_message UNION ALL SELECT *, 'FOUND_REPETITIVE' FROM {advisory_hist} WHERE has_repetitive_message)""")
def _(t):
    return advisory.error_log(t.advisory_hist, 42).drop("data")


@query("D08_suppress_sent", """
WITH recent AS (SELECT DISTINCT farm_id, crop_id, code FROM (SELECT farm_id, crop_id, unnest([message, message_2, message_3, message_4, message_5]) AS code FROM {advisory_hist}
  WHERE message_date >= TIMESTAMP '1998-06-17 00:00:00') WHERE code IS NOT NULL)
SELECT a.registry_id, """ + ", ".join(keep_sql(s) for s in advisory.SLOTS) + " FROM {advisory_hist} a")
def _(t):
    return advisory.suppress_recent(t.advisory_hist, t.advisory_hist, "1998-07-01", 2).select("registry_id", *advisory.SLOTS)


# ---- planting -------------------------------------------------------------

_IN_SQL = """win AS (SELECT w.grid_id, w.date, strftime(w.date, '%m-%d') AS month_day, COALESCE(w.total_evapotranspiration, 0) AS evapotranspirationSum, COALESCE(w.total_rainfall, 0) AS rainAccumulationSum,
  COALESCE(n.LTNPET, 0) AS LTNPET, COALESCE(n.LTNPrecip, 0) AS LTNPrecip FROM {weather} w
  LEFT JOIN {normals} n ON n.grid_id = w.grid_id AND strftime(DATE '2023-12-31' + n.dayofyear, '%m-%d') = strftime(w.date, '%m-%d')
  WHERE w.date BETWEEN DATE '1998-06-25' AND DATE '1998-07-14')"""


def model_input(t):
    n = t.normals.select("grid_id", cubes.normal_month_day(F.col("dayofyear")).alias("month_day"), "LTNPrecip", "LTNPET")
    w = t.weather.withColumnRenamed("total_evapotranspiration", "total_evapotranspiration_flux")
    return planting.model_input(w, n, REQUEST_DATE)


@query("D09_model_input", f"WITH {_IN_SQL} SELECT grid_id, date, month_day, evapotranspirationSum, rainAccumulationSum, LTNPET, LTNPrecip FROM win")
def _(t):
    return planting.model_rows(model_input(t))


@query("D10_input_validation", f"""
WITH {_IN_SQL} SELECT expectation, failures FROM (SELECT count(*) FILTER (month_day IS NULL) AS missing_month_day, count(*) FILTER (NOT regexp_matches(month_day, '^[0-9][0-9]-[0-9][0-9]$')) AS bad_month_day,
  count(*) FILTER (date > DATE '1998-07-08') AS out_of_range, CAST(0 AS BIGINT) AS not_numeric FROM win) UNPIVOT (failures FOR expectation IN (missing_month_day, bad_month_day, out_of_range, not_numeric))""")
def _(t):
    return planting.validate_input(planting.model_rows(model_input(t)), "1998-06-25")


@query("N03_model_hook", f"""
WITH {_IN_SQL}, d AS (SELECT *, row_number() OVER (PARTITION BY grid_id ORDER BY date) - 1 AS i FROM win)
SELECT grid_id, COALESCE(sum(rainAccumulationSum) FILTER (i BETWEEN 4 AND 8), 0) AS days_h2to_f2, COALESCE(sum(rainAccumulationSum) FILTER (i BETWEEN 9 AND 11), 0) AS days_f3to_f5,
  COALESCE(sum(rainAccumulationSum) FILTER (i BETWEEN 12 AND 19), 0) AS days_f6to_f13, COALESCE(sum(rainAccumulationSum) FILTER (i BETWEEN 6 AND 7), 0) AS todayTomorrow FROM d GROUP BY 1""")
def _(t):
    return planting.run_model(planting.model_rows(model_input(t)), planting.default_model).select(
        "grid_id", "days_h2to_f2", "days_f3to_f5", "days_f6to_f13", "todayTomorrow")


@query("D11_signals_to_farms", """
WITH done AS (SELECT DISTINCT farm_id FROM {signal} WHERE generated_date = DATE '1998-07-01'), sent AS (SELECT DISTINCT farm_id FROM {signal} WHERE generated_date = DATE '1998-06-24' AND contains(lower(signal), 'tier 1'))
SELECT f.farm_id, f.grid_id, CASE WHEN g.grid_id % 2 = 0 THEN 'Plant NOW Tier 1a' ELSE 'Do NOT plant Tier 4' END AS signal, f.farm_id IN (SELECT farm_id FROM sent) AS is_sent_before
FROM {farm} f JOIN {grid} g ON f.grid_id = g.grid_id WHERE f.farm_id NOT IN (SELECT farm_id FROM done)""")
def _(t):
    z = F.lit(0.0)
    out = t.grid.select("grid_id", F.when(F.col("grid_id") % 2 == 0, "Plant NOW Tier 1a").otherwise("Do NOT plant Tier 4").alias("goNoGo"),
                        F.lit("").alias("tooWet"), z.alias("last4Days"), z.alias("last2Days"), z.alias("todayTomorrow"))
    farms = t.farm.select("farm_id", "grid_id")
    return planting.fan_out(out, farms, t.signal, REQUEST_DATE, "1998-06-24").select("farm_id", "grid_id", "signal", "is_sent_before")


FC_SQL = """(SELECT forecast_date - 1 AS date, lat, lon, max_temperature, total_rainfall FROM {forecast} WHERE forecast_day_idx = -1 AND forecast_date BETWEEN DATE '2024-01-11' AND (SELECT max(forecast_date) FROM {forecast})
 AND forecast_date - 1 < (SELECT max(forecast_date) FROM {forecast})
 UNION ALL SELECT forecast_date + forecast_day_idx, lat, lon, max_temperature, total_rainfall FROM {forecast} WHERE forecast_date = (SELECT max(forecast_date) FROM {forecast}) AND forecast_day_idx BETWEEN 0 AND 5)"""


@query("D12_forecast_past_and_future", f"SELECT date, lat, lon, max_temperature, total_rainfall FROM {FC_SQL}")
def _(t):
    cube, latest = t.cube("forecast")
    end = (latest.fromordinal(latest.toordinal() + 5)).isoformat()
    return cubes.read_forecast(cube, ["max_temperature", "total_rainfall"], "2024-01-10", end, latest).select(
        "date", "lat", "lon", "max_temperature", "total_rainfall")


_P80, _P50 = "0.8416212335729143", "0"


def _dec(mean: str, sd: str, thr: str, p: str) -> str:
    return f"CASE WHEN {sd} > 0 AND ({mean} - {thr}) / {sd} > {p} THEN 1.0 ELSE 0.0 END"


DEC_SQL = f"""tops AS (SELECT lat, lon, max(clim_mean_wrsi) AS top FROM {{climatology}} GROUP BY 1, 2),
 dec AS (SELECT c.grid_id, c.lat, c.lon, c.spw_20, c.spw_40, c.spw_60, CASE WHEN top IS NULL THEN 0.0 ELSE {_dec('wrsi_mean', 'wrsi_std', '(0.75 * top)', _P50)} END AS ix,
  {_dec('pfc_ecmwf_mean', 'pfc_ecmwf_std', '25', _P80)} AS s25, {_dec('pfc_ecmwf_mean', 'pfc_ecmwf_std', '50', _P80)} AS s50, {_dec('pfc_ecmwf_mean', 'pfc_ecmwf_std', '70', _P80)} AS s70,
  {_dec('pfc_ecmwf_mean', 'pfc_ecmwf_std', '40', '-0.5244005127080409')} AS su, CASE WHEN top IS NULL THEN 0.0 ELSE {_dec('wrsi_mean', 'wrsi_std', '(0.5 * top)', _P50)} END AS iu
  FROM {{cells}} c LEFT JOIN tops t ON t.lat = c.lat AND t.lon = c.lon)"""
USER = {"soil_threshold": 40.0, "soil_p": 0.3, "index_factor": 0.5}


@query("D13_planting_decision", f"""
WITH {DEC_SQL} SELECT lat, lon, CAST(s25 * ix AS DOUBLE) AS sm_25, CAST(s50 * ix AS DOUBLE) AS sm_50, CAST(s70 * ix AS DOUBLE) AS sm_70, spw_20, CAST(su AS DOUBLE) AS pfc_user_decision, CAST(iu AS DOUBLE) AS wrsi_user_decision, CAST(su * iu AS DOUBLE) AS sm_user_decision FROM dec""")
def _(t):
    return planting.decision_table(t.cells, t.climatology, **USER).select(
        "lat", "lon", "sm_25", "sm_50", "sm_70", "spw_20", "pfc_user_decision", "wrsi_user_decision", "sm_user_decision")


def farms_small(t):
    return t.farm.select("farm_id", "lon", "lat", "farm_group")


_AT = "floor((f.lat + 27.75) / 0.5 + 0.5) = (d.lat + 27.75) / 0.5 AND floor((f.lon - 20.25) / 0.5 + 0.5) = (d.lon - 20.25) / 0.5"


@query("D14_decisions_at_farms", f"""
WITH {DEC_SQL} SELECT f.farm_id, CAST(d.s25 * d.ix AS DOUBLE) AS sm_25, CAST(d.s70 * d.ix AS DOUBLE) AS sm_70, d.spw_40, CAST(d.su * d.iu AS DOUBLE) AS sm_user_decision FROM {{farm}} f LEFT JOIN dec d ON {_AT}""")
def _(t):
    table = planting.decision_table(t.cells, t.climatology, **USER)
    return planting.decisions_at_farms(table, farms_small(t), 20.25, -27.75, 0.5).select("farm_id", "sm_25", "sm_70", "spw_40", "sm_user_decision")


@query("D15_decision_run", f"""
WITH {DEC_SQL} SELECT f.farm_id, DATE '1998-07-01' AS date, CAST(d.s50 * d.ix AS DOUBLE) AS sm_50 FROM {{farm}} f LEFT JOIN dec d ON {_AT}
UNION ALL SELECT farm_id, generated_date, 9.0 FROM {{signal}} WHERE generated_date >= DATE '1998-07-02'""")
def _(t):
    old = t.signal.where("generated_date >= '1998-07-01'").select("farm_id", F.col("generated_date").alias("date"), F.lit(9.0).alias("sm_50"))
    table = planting.decision_table(t.cells, t.climatology, **USER)
    return planting.decision_run(table, farms_small(t), 20.25, -27.75, 0.5, REQUEST_DATE, old, **USER).select("farm_id", "date", "sm_50")


@query("D16_publish_month", """
SELECT s.signal_id, f.farm_unique_id, g.grid_unique_id, c.iso_a3, CAST(year(s.generated_date) AS INT) AS year, CAST(month(s.generated_date) AS INT) AS month
FROM {signal} s JOIN {farm} f ON s.farm_id = f.farm_id LEFT JOIN {grid} g ON f.grid_id = g.grid_id LEFT JOIN {country} c ON g.country_id = c.country_id""")
def _(t):
    from furrow.session import scratch_dir
    from furrow.sinks.tables import write_signals
    farms = t.farm.select("farm_id", "farm_unique_id", "grid_id", "lon", "lat")
    out = planting.publish(t.signal.drop("farm_unique_id"), farms, t.grid.select("grid_id", "country_id", "grid_unique_id"),
                           t.country.select("country_id", "iso_a3"))
    path = scratch_dir(t.spark, "signals")
    write_signals(out, path)
    return t.spark.read.parquet(path).select("signal_id", "farm_unique_id", "grid_unique_id", "iso_a3", "year", "month")


# ---- pests ----------------------------------------------------------------

ALERT_SQL = """alert AS (SELECT farm_id, generated_at, data_type, pest_id, arg_max(value, (no, value)) AS value FROM (
  SELECT no, farm_id, generated_at, CASE no % 3 WHEN 0 THEN 'Near Real Time' WHEN 1 THEN 'Climatological' END AS data_type, unnest([1, 2, 3]) AS pest_id, unnest([beetle, borer, worm]) AS value FROM {pest_sheet}
  WHERE (beetle IS NOT NULL)::INT + (borer IS NOT NULL)::INT + (worm IS NOT NULL)::INT >= 2) WHERE value IS NOT NULL AND data_type IS NOT NULL GROUP BY 1, 2, 3, 4)"""


def alerts(t):
    from furrow.functions.text import clean_label
    from furrow.operators.skew import latest_by
    long = pests.sheet_to_long(t.pest_sheet, ["no", "farm_id", "generated_at", "raw_type"], PESTS)
    typed = pests.with_pest(long, pest_table(t)).withColumn("data_type", clean_label(F.col("raw_type"), pests.ALLOWED_TYPES)).where("data_type is not null")
    one = latest_by(typed.select("farm_id", "generated_at", "data_type", "pest_id", "no", "value"),
                    ["farm_id", "generated_at", "data_type", "pest_id"], ["no", "value"]).drop("no")
    return pests.upsert_alerts(one.where("data_type = 'Climatological'").withColumn("value", F.lit(-1.0)), one)


@query("D17_pest_alerts", f"WITH {ALERT_SQL} SELECT farm_id, generated_at, data_type, pest_id, value FROM alert")
def _(t):
    return alerts(t)


def pest_messages(t, day="1998-06-16"):
    """Two templates per pest for the second action group (third Tuesday)."""
    rows = [(p, "Time To Action 2", None, i, f"Pest {p} no {i}: {{{{ day_1 }}}} to {{{{ day_2 }}}} {{{{ month }}}}, was {{{{ last_month }}}}, call {{{{ phone }}}}", None)
            for p in (1, 2, 3) for i in (1, 2)]
    messages = t.spark.createDataFrame(rows, "pest_id int, group string, farm_group_id int, message_no int, template_en string, template_sw string")
    farms = t.farm.select("farm_id", F.when(F.col("farm_group") != "BUILDING", F.col("farm_group")).alias("farm_group"), F.col("phone").alias("farm_group_phone"))
    return pests.pest_messages(farms, alerts(t), schedules(t), messages, day)


PEST_MSG_SQL = ALERT_SQL + """, newest AS (SELECT a.* FROM alert a JOIN (SELECT farm_id, max(generated_at) AS g FROM alert WHERE data_type = 'Near Real Time' GROUP BY 1) n
   ON a.farm_id = n.farm_id AND a.generated_at = n.g AND a.data_type = 'Near Real Time'),
 pmsg AS (SELECT f.farm_id, CAST(n.pest_id AS INT) AS pest_id, CAST(i.i AS INT) AS message_no, '"Pest ' || n.pest_id || ' no ' || i.i || ': ' || CAST(trunc(n.value) - 1 AS INT) || ' to ' || CAST(trunc(n.value) + 1 AS INT) || ' June, was May, call ' || f.phone || '"' AS message
  FROM newest n JOIN {farm} f ON f.farm_id = n.farm_id AND f.farm_group <> 'BUILDING' CROSS JOIN (VALUES (1), (2)) i(i))"""


@query("D17_pest_messages", f"WITH {PEST_MSG_SQL} SELECT farm_id, pest_id, message_no, message FROM pmsg")
def _(t):
    return pest_messages(t)


# ---- crop plan ------------------------------------------------------------

PLAN_FC = """pf AS (SELECT farm_id, generated_date AS value_date, field, max(value) AS value FROM (SELECT farm_id, generated_date, unnest(['rainAccumulationSum', 'precipitationProbability']) AS field,
   unnest([last_4_days, last_2_days * 2]) AS value FROM {signal}) GROUP BY 1, 2, 3),
 pn AS (SELECT *, CAST(value_date - min(value_date) OVER (PARTITION BY farm_id) AS INT) + 1 AS n FROM pf)"""


def plan_forecast(t):
    s = t.signal.select("farm_id", F.col("generated_date").alias("value_date"), F.col("last_4_days").alias("rainAccumulationSum"),
                        (F.col("last_2_days") * 2).alias("precipitationProbability"))
    long = s.unpivot(["farm_id", "value_date"], ["rainAccumulationSum", "precipitationProbability"], "field", "value")
    return long.groupBy("farm_id", "value_date", "field").agg(F.max("value").alias("value")).withColumn("forecast_date", F.to_date(F.lit("1998-06-10")))


def _rain(v: str) -> str:
    return (f"CASE WHEN {v} <= 0.5 THEN 'No Rain' WHEN {v} <= 3 THEN 'Minimal rain' WHEN {v} <= 10 THEN 'Light rain' WHEN {v} <= 20 THEN 'Moderate rain' WHEN {v} > 20 THEN 'Heavy rain' END")


_DAYS = (1, 2, 5, 13)
_PLAN_SQL = f"""
WITH {PEST_MSG_SQL}, {PLAN_FC}, sig AS (SELECT farm_id, arg_max(struct_pack(signal := signal, wet := too_wet_indicator, d4 := last_4_days, sent := is_sent_before), signal_id) AS s FROM {{signal}} WHERE generated_date = DATE '1998-06-10' GROUP BY 1),
 wide AS (SELECT farm_id, {', '.join(f"max(value) FILTER (n = {d} AND field = '{x}') AS day{d}_{x}" for d in _DAYS for x in ('rainAccumulationSum', 'precipitationProbability'))} FROM pn GROUP BY 1)
SELECT f.farm_unique_id AS "farmID", f.phone AS "phoneNumber", round(f.lat, 4) AS latitude, COALESCE(CASE WHEN s.farm_id IS NULL THEN NULL WHEN x.identifier IS NOT NULL THEN COALESCE(x.top_message, CASE WHEN x.is_plant_now THEN 'Plant Now' ELSE 'DO NOT PLANT' END)
   WHEN d.identifier IS NOT NULL THEN COALESCE(d.top_message, CASE WHEN d.is_plant_now THEN 'Plant Now' ELSE 'DO NOT PLANT' END) ELSE s.s.signal END, '') AS "SPWTopMessage", COALESCE(s.s.wet, '') AS "TooWet", s.s.d4 AS last_4_days_mm,
 {', '.join(f'w.day{d}_rainAccumulationSum AS "day{d}_rainAccumulationSum", {_rain(f"w.day{d}_rainAccumulationSum")} AS "day{d}_rainAccumulationType", w.day{d}_precipitationProbability AS "day{d}_precipitationProbability"' for d in _DAYS)},
 (SELECT max(message) FROM pmsg p WHERE p.farm_id = f.farm_id AND p.pest_id = 1 AND p.message_no = 2) AS pest_beetle_2
FROM {{farm}} f LEFT JOIN sig s ON s.farm_id = f.farm_id LEFT JOIN {{signal_text}} x ON x.identifier = f.farm_group || '-' || s.s.signal LEFT JOIN {{signal_text}} d ON d.identifier = s.s.signal
LEFT JOIN wide w ON w.farm_id = f.farm_id WHERE NOT COALESCE(s.s.sent, false)"""
_PLAN_COLS = ["farmID", "phoneNumber", "latitude", "SPWTopMessage", "TooWet", "last_4_days_mm",
              *[f"day{d}_{x}" for d in _DAYS for x in ("rainAccumulationSum", "rainAccumulationType", "precipitationProbability")], "pest_beetle_2"]


def full_plan(t):
    from furrow.operators.skew import latest_by
    today = latest_by(t.signal.where("generated_date = '1998-06-10'"), ["farm_id", "generated_date"], ["signal_id"])
    texts = planting.signal_text(today.join(t.farm.select("farm_id", "farm_group"), "farm_id"), t.signal_text)
    names = {1: "beetle", 2: "borer", 3: "worm"}
    table = planting.decision_table(t.cells, t.climatology)
    dec = cropplan.decision_columns(planting.decisions_at_farms(table, farms_small(t), 20.25, -27.75, 0.5))
    farms = t.farm.select("farm_id", "farm_unique_id", "phone", "lat", "lon")
    return cropplan.crop_plan(farms, texts, plan_forecast(t), "1998-06-10", ["rainAccumulationSum", "precipitationProbability"],
                              cropplan.pest_wide(pest_messages(t), names), dec, 4, filter_same_tier_1=True)


@query("D18_crop_plan", _PLAN_SQL)
def _(t):
    return cropplan.select_plan(full_plan(t), None, _PLAN_COLS)


@query("D19_plan_layout", """
SELECT farm_unique_id AS "farmID", phone AS "phoneNumber", COALESCE(max(value) FILTER (n = 1 AND field = 'rainAccumulationSum'), NULL) AS day1_mm
FROM {farm} f LEFT JOIN pn p ON p.farm_id = f.farm_id GROUP BY f.farm_unique_id, f.phone""".replace("SELECT farm_unique_id", f"WITH {PLAN_FC} SELECT farm_unique_id"))
def _(t):
    wide = cropplan.forecast_wide(plan_forecast(t), ["rainAccumulationSum", "precipitationProbability"])
    plan = t.farm.select("farm_id", F.col("farm_unique_id").alias("farmID"), F.col("phone").alias("phoneNumber")).join(wide, "farm_id", "left")
    rows = cropplan.layout(["beetle"], ["rainAccumulationSum", "precipitationProbability", "temperatureMax"])
    return cropplan.apply_layout(plan, rows).select("farmID", "phoneNumber", "day1_mm")


# ---- registry -------------------------------------------------------------

REG_CSV_SQL = """csv AS (SELECT o_orderkey AS no, 'F' || (o_custkey + CASE WHEN o_orderkey % 5 = 0 THEN 1000000 ELSE 0 END) AS farmer_id, 'Crop' || (o_orderkey % 9) AS crop_name, CASE o_orderkey % 4 WHEN 0 THEN 'Type1' WHEN 1 THEN 'Type2' WHEN 2 THEN 'Type3' ELSE 'Mid' END AS stage_name,
  CAST(o_orderdate AS DATE) AS planting_date, 20.0625 + (o_custkey * 29 % 640) / 16 AS lon, -27.9375 + (o_custkey * 31 % 896) / 16 AS lat FROM orders)"""


def registry_csv(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    stage = F.when(k % 4 == 0, "type1").when(k % 4 == 1, "TYPE2").when(k % 4 == 2, "Type3").otherwise("Medium")
    return t.orders.select(
        F.concat(F.lit("F"), (c + F.when(k % 5 == 0, 1000000).otherwise(0)).cast("string")).alias("farmer_id"),
        F.concat(F.lit("crop"), (k % 9).cast("string"), F.lit("_"), stage).alias("crop"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("planting_date"),
        (20.0625 + (c * 29 % 640) / 16).alias("final_longitude"), (-27.9375 + (c * 31 % 896) / 16).alias("final_latitude"),
        F.lit("County").alias("county"), F.col("o_orderpriority").alias("subcounty"), F.col("o_orderstatus").alias("ward"), F.lit("en").alias("language"))


@query("D20_registry_ingest", f"""
WITH {REG_CSV_SQL}, m AS (SELECT c.*, f.farm_id, COALESCE(f.grid_id, (SELECT min(g.grid_id) FROM {{grid}} g WHERE c.lon BETWEEN g.lon0 AND g.lon0 + 0.5 AND c.lat BETWEEN g.lat0 AND g.lat0 + 0.5)) AS grid_id
   FROM csv c LEFT JOIN {{farm}} f ON f.farm_unique_id = c.farmer_id),
 q AS (SELECT m.*, m.farm_id IS NOT NULL OR (m.grid_id IS NOT NULL) AS has_farm, m.stage_name <> 'Mid' AS has_stage FROM m)
SELECT count(*) AS total, count(*) FILTER (has_farm AND has_stage AND grid_id IS NOT NULL) AS insertable, CAST(0 AS BIGINT) AS existing,
  (SELECT count(DISTINCT farmer_id) FROM q WHERE farm_id IS NULL AND grid_id IS NOT NULL) AS new_farms,
  (SELECT count(*) FROM (SELECT DISTINCT farmer_id, crop_name, stage_name, planting_date FROM q WHERE has_farm AND has_stage AND grid_id IS NOT NULL)) AS inserted,
  CAST(5 AS BIGINT) AS subcounties FROM q""")
def _(t):
    empty = t.registry.where("false")
    load = registry.ingest(registry_csv(t), 77, t.farm.select("farm_id", "farm_unique_id", "grid_id"),
                           t.grid.select("grid_id", "lon", "lat").join(grid_areas(t), "grid_id"), t.crop, t.stage_type, empty,
                           {"subcounty": t.spark.createDataFrame([(4, "1-urgent")], "subcounty_id long, name string")})
    count = lambda d: d.agg(F.count("*")).scalar()
    return load.counts.drop("mismatch").select("*", count(load.farms).alias("new_farms"), count(load.inserts).alias("inserted"),
                                               count(load.dimensions["subcounty"]).alias("subcounties"))


# rows of the file whose farm, crop, stage and date the registry has already
_STORED_SQL = """stored AS (SELECT min(o_orderkey) AS registry_id, o_custkey AS farm_id, o_orderkey % 9 AS crop_id, o_orderkey % 4 + 1 AS crop_stage_type_id, CAST(o_orderdate AS DATE) AS planting_date
   FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 5 > 0 AND o_orderkey % 4 < 3 AND o_custkey IN (SELECT farm_id FROM {farm}) GROUP BY ALL)"""


@query("D20_registry_rows", f"""
WITH {REG_CSV_SQL}, {_STORED_SQL}, m AS (SELECT c.*, o_orderpriority AS sub, f.farm_id, COALESCE(f.grid_id, (SELECT min(g.grid_id) FROM {{grid}} g WHERE c.lon BETWEEN g.lon0 AND g.lon0 + 0.5 AND c.lat BETWEEN g.lat0 AND g.lat0 + 0.5)) AS grid_id
   FROM csv c JOIN orders ON o_orderkey = c.no LEFT JOIN {{farm}} f ON f.farm_unique_id = c.farmer_id),
 names AS (SELECT lower(o_orderpriority) AS k, CASE WHEN lower(o_orderpriority) = '1-urgent' THEN 4 ELSE 4 + row_number() OVER (PARTITION BY lower(o_orderpriority) = '1-urgent' ORDER BY md5(lower(o_orderpriority))) END AS id FROM (SELECT DISTINCT o_orderpriority FROM orders)),
 q AS (SELECT m.farmer_id, m.grid_id, m.farm_id, CAST(substr(crop_name, 5) AS INT) AS crop_id, CASE WHEN stage_name <> 'Mid' THEN CAST(substr(stage_name, 5) AS INT) END AS crop_stage_type_id, m.planting_date, n.id AS sub
   FROM m JOIN names n ON n.k = lower(m.sub))
SELECT 'stored' AS what, 'F' || s.farm_id AS farmer_id, CAST(s.crop_id AS INT) AS crop_id, CAST(s.crop_stage_type_id AS INT) AS crop_stage_type_id, s.planting_date,
  (SELECT CAST(min(q.sub) AS BIGINT) FROM q WHERE q.farm_id = s.farm_id AND q.crop_id = s.crop_id AND q.crop_stage_type_id = s.crop_stage_type_id AND q.planting_date = s.planting_date) AS subcounty_id FROM stored s
UNION ALL
SELECT 'inserted', farmer_id, crop_id, crop_stage_type_id, planting_date, CAST(NULL AS BIGINT) FROM q WHERE grid_id IS NOT NULL AND crop_stage_type_id IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM stored s WHERE q.farm_id = s.farm_id AND q.crop_id = s.crop_id AND q.crop_stage_type_id = s.crop_stage_type_id AND q.planting_date = s.planting_date) GROUP BY ALL""")
def _(t):
    """A registry file against a filled registry: the rows inserted, and the stored ones after the update."""
    from furrow.schema import REGISTRY_CSV
    from furrow.sources import landed
    path = scratch_dir(t.spark, "registry-csv")
    registry_csv(t).write.option("header", True).csv(path)
    csv = landed.read_sheet(t.spark, path, REGISTRY_CSV)
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    stored = t.orders.where("o_orderkey % 3 = 0 and o_orderkey % 5 > 0 and o_orderkey % 4 < 3").join(t.farm.select(F.col("farm_id").alias("o_custkey")), "o_custkey").groupBy(
        c.alias("farm_id"), (k % 9).cast("int").alias("crop_id"), (k % 4 + 1).cast("int").alias("crop_stage_type_id"), F.to_date("o_orderdate").alias("planting_date")).agg(
        F.min("o_orderkey").alias("registry_id")).withColumns({"group_id": F.lit(77), "subcounty_id": F.lit(None).cast("long")})
    load = registry.ingest(csv, 77, t.farm.select("farm_id", "farm_unique_id", "grid_id"),
                           t.grid.select("grid_id", "lon", "lat").join(grid_areas(t), "grid_id"), t.crop, t.stage_type, stored,
                           {"subcounty": t.spark.createDataFrame([(4, "1-urgent")], "subcounty_id long, name string")})
    keys = ["crop_id", "crop_stage_type_id", "planting_date"]
    after = registry.apply_updates(stored, load.updates.select("registry_id", "subcounty_id"), ["subcounty_id"])
    farmer = F.concat(F.lit("F"), F.col("farm_id").cast("string"))
    return after.select(F.lit("stored").alias("what"), farmer.alias("farmer_id"), *keys, "subcounty_id").unionByName(
        load.inserts.select(F.lit("inserted").alias("what"), "farmer_id", *keys, F.lit(None).cast("long").alias("subcounty_id")))


# ---- observations and cubes -----------------------------------------------

_WIDE_SQL = "wide AS (SELECT station_id, date_time, " + ", ".join(
    f"sum(value) FILTER (attribute = '{a}') / count(*) FILTER (attribute = '{a}') AS {a}" for a in ATTRIBUTES) + " FROM {measurement} GROUP BY 1, 2)"


def wide(t):
    return observations.to_wide(t.measurement, ["station_id", "date_time"], ATTRIBUTES)


@query("D21_eav_to_wide_table", f"""
WITH {_WIDE_SQL} SELECT w.station_id, w.date_time, w.click, w.view, s.station_code, s.lon, CAST(year(w.date_time) AS INT) AS year FROM wide w JOIN {{station}} s ON s.station_id = w.station_id""")
def _(t):
    from furrow.session import scratch_dir
    from furrow.sinks.tables import write_observations
    path = scratch_dir(t.spark, "observations")
    write_observations(observations.convert(t.measurement, t.station, ATTRIBUTES), path)
    return t.spark.read.parquet(path).select("station_id", "date_time", "click", "view", "station_code", "lon", "year")


@query("D22_balloon_table", """
SELECT h.history_id AS station_history_id, m.date_time, sum(m.value) FILTER (m.attribute = 'view') / count(*) FILTER (m.attribute = 'view') AS view, h.altitude, CAST(month(m.date_time) AS INT) AS month
FROM {measurement} m JOIN {track} h ON m.station_id = h.station_id AND m.date_time = h.date_time GROUP BY 1, 2, 4, 5""")
def _(t):
    linked = observations.attach_track_point(t.measurement, t.track)
    points = t.track.select(F.col("history_id").alias("station_history_id"), "lon", "lat", "altitude")
    out = observations.convert(linked, points, ATTRIBUTES, on="station_history_id", use_month=True)
    return out.select("station_history_id", "date_time", "view", "altitude", "month")


_RANGE = "date_time BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 12:00:00'"


@query("D23_observation_bbox", f"""
WITH {_WIDE_SQL} SELECT station_id, date_time, view, error FROM wide WHERE {_RANGE} AND station_id IN (SELECT station_id FROM {{station}} WHERE lon > 24 AND lon < 50 AND lat > -20 AND lat < 12) ORDER BY date_time, station_id""")
def _(t):
    return observations.read_observations(wide(t), t.station, ["view", "error"], "2024-01-05 00:00:00", "2024-01-20 12:00:00", Location.bbox(24.0, -20.0, 50.0, 12.0))


@query("D23_observation_polygon", f"""
WITH {_WIDE_SQL} SELECT station_id, date_time, view FROM wide WHERE {_RANGE} AND station_id IN (SELECT station_id FROM {{station}} WHERE {inside_sql('lon', 'lat')} AND altitude BETWEEN 200 AND 2800) ORDER BY date_time, station_id""")
def _(t):
    return observations.read_observations(wide(t), t.station, ["view"], "2024-01-05 00:00:00", "2024-01-20 12:00:00", Location.polygon([RING, HOLE]), altitudes=(200, 2800))


@query("D23_observation_points", f"""
WITH {_WIDE_SQL}, near AS (SELECT f.grid_id, arg_min(s.station_id, (round({hav('f', 's')}, 3), s.station_id)) AS station_id FROM {{grid}} f
  CROSS JOIN (SELECT * FROM {{station}} WHERE station_id IN (SELECT station_id FROM wide WHERE {_RANGE})) s GROUP BY 1)
SELECT station_id, date_time, view FROM wide WHERE {_RANGE} AND station_id IN (SELECT station_id FROM near) ORDER BY date_time, station_id""")
def _(t):
    pts = t.grid.select(F.col("grid_id").alias("point_id"), "lon", "lat")
    return observations.read_observations(wide(t), t.station, ["view"], "2024-01-05 00:00:00", "2024-01-20 12:00:00", Location.many(pts))


@query("D24_reanalysis_polygon", f"""
SELECT date, lat, lon, max_temperature FROM {{reanalysis}} WHERE date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31' AND {inside_sql('lon', 'lat')}""")
def _(t):
    days = cubes.daily_slice(t.reanalysis, "1998-01-01", "1998-12-31")
    return cubes.at_location(days, Location.polygon([RING, HOLE]), 20.25, -27.75, 0.5).select("date", "lat", "lon", "max_temperature")


@query("D24_reanalysis_hourly_box", """
SELECT date, hour, lat, lon, max_temperature FROM {reanalysis_hourly} WHERE date + to_hours(hour) BETWEEN TIMESTAMP '2024-01-03 05:00:00' AND TIMESTAMP '2024-01-09 17:00:00'
 AND lon BETWEEN 25 AND 45 AND lat BETWEEN -20 AND 20""")
def _(t):
    rows = cubes.hourly_slice(t.reanalysis_hourly, "2024-01-03 05:00:00", "2024-01-09 17:00:00")
    return cubes.at_location(rows, Location.bbox(25.0, -20.0, 45.0, 20.0), 20.25, -27.75, 0.5).select("date", "hour", "lat", "lon", "max_temperature")


@query("D25_seasonal_ensemble", """
SELECT CAST(forecast_date + forecast_day_idx AS DATE) AS date, lat, lon, to_json(list(CAST(temp AS INT) ORDER BY ensemble)) AS members, arg_min(temp_clim, ensemble) AS temp_clim FROM {ensemble}
WHERE forecast_date = DATE '1998-03-01' AND forecast_day_idx BETWEEN 4 AND 19 AND lon BETWEEN 20 AND 50 AND lat BETWEEN -28 AND 10 GROUP BY 1, 2, 3""")
def _(t):
    out = cubes.read_seasonal(t.ensemble, ["temp"], "1998-03-05", "1998-03-20", Location.bbox(20.0, -28.0, 50.0, 10.0),
                              (20.25, -27.75, 0.5), requested="1998-03-17", plain=["temp_clim"])
    return out.select("date", "lat", "lon", F.to_json(F.transform("temp", lambda v: v.cast("int"))).alias("members"), "temp_clim")


@query("D26_normals", """
SELECT strftime(DATE '2023-12-31' + dayofyear, '%m-%d') AS month_day, lat, lon, LTNPrecip FROM {normals} WHERE dayofyear BETWEEN 60 AND 75""")
def _(t):
    return cubes.read_normals(t.normals, ["LTNPrecip"], "2024-02-29", "2024-03-15")


@query("D27_nowcast", """
SELECT time, lat, lon, precipitation FROM {raster} WHERE time BETWEEN TIMESTAMP '2024-01-08 03:00:00' AND TIMESTAMP '2024-01-10 00:00:00' AND lon BETWEEN 22 AND 58 AND lat BETWEEN -25 AND 25""")
def _(t):
    r = cubes.exact_times(t.raster.withColumn("time", F.col("time").cast("timestamp_ntz")), "2024-01-08 03:00:00", "2024-01-10 00:00:00")
    return cubes.at_location(r, Location.bbox(22.0, -25.0, 58.0, 25.0), 20.25, -27.75, 0.5).select("time", "lat", "lon", "precipitation")


@query("D28_measure", """
SELECT date, lat, lon, max_temperature AS temperature_max FROM (SELECT forecast_date - 1 AS date, lat, lon, max_temperature FROM {forecast} WHERE forecast_day_idx = -1 AND forecast_date BETWEEN DATE '2024-01-06' AND DATE '2024-01-19'
 AND lon BETWEEN 22 AND 58 AND lat BETWEEN -25 AND 25) ORDER BY date""")
def _(t):
    lattice = (20.25, -27.75, 0.5)
    sets = [catalog.Dataset("Daily_Forecast", "forecast", t.forecast, {"temperature_max": "max_temperature", "rain": "total_rainfall"}, lattice=lattice, max_days=30),
            catalog.Dataset("Reanalysis", "daily", t.reanalysis, {"temperature_max": "max_temperature"}, lattice=lattice)]
    return catalog.measure(sets, catalog.Request("daily_forecast", ["temperature_max", "unknown"], "2024-01-05", "2024-01-18",
                                                 Location.bbox(22.0, -25.0, 58.0, 25.0)))


_RENDERED = """
SELECT 'station' AS product, strftime(ts, '%Y-%m-%d %H:%M:%S') AS datetime, lon, lat, CAST(NULL AS INT) AS ensemble, avg(floor(value * 8) / 8) AS value
FROM events JOIN (SELECT DISTINCT 20 + (user_id * 37 % 320) / 8 AS lon, -28 + (user_id * 53 % 448) / 8 AS lat, user_id FROM events) USING (user_id)
WHERE user_id = 7 AND event_type = 'click' AND ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-25 00:00:00' GROUP BY ts, lon, lat
UNION ALL
SELECT 'hourly', strftime(date + to_hours(CAST(hour AS BIGINT)), '%Y-%m-%d %H:%M:%S'), lon, lat, NULL, max_temperature FROM {reanalysis_hourly}
WHERE lon = 23.75 AND lat = 17.75 AND date + to_hours(CAST(hour AS BIGINT)) BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-25 00:00:00'
UNION ALL
SELECT 'seasonal', strftime(d, '%Y-%m-%d %H:%M:%S'), lon, lat, CAST(row_number() OVER (PARTITION BY d, lat, lon ORDER BY ensemble) - 1 AS INT), temp FROM (
  SELECT CAST(forecast_date + forecast_day_idx AS TIMESTAMP) AS d, lat, lon, ensemble, temp FROM {ensemble}
  WHERE forecast_date = DATE '1998-03-01' AND forecast_day_idx BETWEEN 0 AND 25 AND lon = 23.75 AND lat = 17.75)"""


def rendered(t, output):
    """A station, an hourly and a seasonal product, written in a format; (product, folder) each."""
    wide = observations.to_wide(t.measurement, ["station_id", "date_time"], ["click"])
    lattice = (20.25, -27.75, 0.5)
    sets = [catalog.Dataset("station", "station", wide.where("click is not null"), {"value": "click"}, stations=t.station, units={"value": {"unit": "mm"}}),
            catalog.Dataset("hourly", "hourly", t.reanalysis_hourly, {"value": "max_temperature"}, lattice=lattice),
            catalog.Dataset("seasonal", "seasonal", t.ensemble, {"value": "temp"}, lattice=lattice, ensembles={"value"})]
    for name, spot, start, end in (("station", (52.375, 18.375), "2024-01-05 00:00:00", "2024-01-25 00:00:00"),
                                   ("hourly", (23.8, 17.7), "2024-01-05 00:00:00", "2024-01-25 00:00:00"),
                                   ("seasonal", (23.8, 17.7), "1998-03-01", "1998-03-26")):
        path = scratch_dir(t.spark, f"answer-{name}")
        catalog.answer(sets, catalog.Request(name, ["value"], start, end, Location.point(*spot), output, forecast_date="1998-03-10"), path)
        yield name, path


def text_rows(t, output, sep):
    parts = []
    for name, path in rendered(t, output):
        own = {"station": "lat double, lon double", "hourly": "lat double, lon double", "seasonal": "lat double, lon double, ensemble int"}[name]
        first = "station_id long, " if name == "station" else ""
        rows = t.spark.read.schema(f"datetime string, {first}{own}, value double").option("header", True).option("sep", sep).csv(path)
        member = F.col("ensemble") if name == "seasonal" else F.lit(None).cast("int")
        parts.append(rows.select(F.lit(name).alias("product"), "datetime", "lon", "lat", member.alias("ensemble"), "value"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("D28_answer_csv", _RENDERED)
def _(t):
    return text_rows(t, "csv", ",")


@query("D28_answer_ascii", _RENDERED)
def _(t):
    return text_rows(t, "ascii", "\t")


@query("D28_answer_json", _RENDERED)
def _(t):
    parts = []
    for name, path in rendered(t, "json"):
        kind = "array<double>" if name == "seasonal" else "double"
        doc = F.from_json("value", f"struct<geometry: struct<coordinates: array<double>>, data: array<struct<datetime: string, values: struct<value: {kind}>>>>")
        rows = t.spark.read.text(path).select(doc.alias("d")).select(F.col("d.geometry.coordinates").alias("c"), F.explode("d.data").alias("e"))
        rows = rows.select(F.lit(name).alias("product"), F.col("e.datetime").alias("datetime"), F.get("c", 0).alias("lon"), F.get("c", 1).alias("lat"), F.col("e.values.value").alias("v"))
        keys = ["product", "datetime", "lon", "lat"]
        parts.append(rows.select(*keys, F.posexplode("v").alias("ensemble", "value")) if name == "seasonal"
                     else rows.select(*keys, F.lit(None).cast("int").alias("ensemble"), F.col("v").alias("value")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("D29_forecast_ingest", """
SELECT DATE '1998-06-25' AS forecast_date, CAST(w.date - DATE '1998-06-25' AS INT) AS forecast_day_idx, g.lat, g.lon, w.max_temperature, CAST(NULL AS DOUBLE) AS wind FROM {weather} w JOIN {grid} g ON w.grid_id = g.grid_id
WHERE w.date >= DATE '1998-06-25' AND w.date < DATE '1998-07-14'""")
def _(t):
    jitter = t.grid.select("grid_id", (F.col("lon") + 0.0625).alias("lon"), (F.col("lat") - 0.0625).alias("lat"))
    rows = ingest.merge_outputs([t.weather.where("date < '1998-07-01'"), t.weather.where("date >= '1998-07-01'")], ["grid_id", "date", "max_temperature"])
    return ingest.forecast_cube(ingest.date_window(rows, "1998-06-25", "1998-07-14"), jitter, ["max_temperature", "wind"],
                                "1998-06-25", 20.25, -27.75, 0.5, 0.1)


@query("D30_seasonal_ingest", """
SELECT forecast_date, forecast_day_idx, ensemble, lat, lon, temp FROM {ensemble}""")
def _(t):
    rows = t.ensemble.withColumn("date", F.date_add("forecast_date", F.col("forecast_day_idx"))).withColumn("lon", F.col("lon") + 0.03125)
    return ingest.seasonal_cube(rows, ["temp"], 20.25, -27.75, 0.5, 0.1)


@query("D31_reanalysis_ingest", """
SELECT date, lat, lon, max_temperature FROM {reanalysis} WHERE date NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')""")
def _(t):
    present = t.orders.where("o_orderstatus = 'P' and o_orderpriority = '1-URGENT'").select(F.to_date("o_orderdate").alias("date"))
    return ingest.reanalysis_slice(t.reanalysis, present, 20.25, -27.75, 0.5, 0.1).select("date", "lat", "lon", "max_temperature")


# ---- audit ----------------------------------------------------------------

@query("D32_stage_audit", f"""
SELECT a.registry_id, l.growth_stage_in, CAST(l.growth_stage_in <> a.growth_stage AS INT) AS diff FROM {{advisory_hist}} a JOIN {LOG_SQL} l ON a.farm_unique_id = l.farm_unique_id AND a.crop = l.crop""")
def _(t):
    return audit.stage_differences(t.advisory_hist, external_log(t)).select("registry_id", "growth_stage_in", "diff")


@query("D33_sent_text_to_signal", """
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Plant NOW Tier 1a' WHEN 1 THEN 'Plant NOW Tier 1b' END AS sent_signal FROM part""")
def _(t):
    k = F.col("p_partkey") % 3
    sent = t.part.select("p_partkey", F.when(k == 0, " Plant  NOW").when(k == 1, "plant now ").otherwise("else").alias("message"),
                         F.when(k == 0, "Text 0").when(k == 1, "text  1").otherwise("Text 9").alias("description"))
    texts = t.signal_text.withColumn("top_message", F.coalesce("top_message", F.lit("Plant Now")))
    return audit.sent_signal(sent, texts).select("p_partkey", "sent_signal")


@query("D34_grid_catalogue", "SELECT g.grid_id, g.lon AS centroid_lon, g.lat AS centroid_lat, c.country FROM {grid} g LEFT JOIN {country} c ON g.country_id = c.country_id")
def _(t):
    return audit.grid_export(grid_areas(t), t.country.select("country_id", "country"))


@query("D34_farmer_hit_rate", """
SELECT count(*) AS farmers, count(*) FILTER (hit) AS hits, count(*) FILTER (hit) / count(*) AS hit_rate FROM (SELECT f.farm_id, EXISTS (SELECT 1 FROM {grid} g
  WHERE f.lon BETWEEN g.lon0 AND g.lon0 + 0.5 AND f.lat BETWEEN g.lat0 AND g.lat0 + 0.5) AS hit FROM {farm} f)""")
def _(t):
    h = 1 / 32
    area = geo.rectangle(F.col("lon") - h, F.col("lat") - h, F.col("lon") + h, F.col("lat") + h)
    return audit.hit_rate(audit.farmer_hits(t.farm.select("farm_id", area.alias("area")), grid_areas(t), "farm_id"))


@query("D35_run_as_issued", """
SELECT CAST(forecast_date + forecast_day_idx AS DATE) AS date, forecast_day_idx, lat, lon, max_temperature FROM {forecast} WHERE forecast_date = DATE '2024-01-12' AND forecast_day_idx BETWEEN -2 AND 6""")
def _(t):
    return cubes.read_run(t.forecast, "2024-01-12", "2024-01-10", "2024-01-18").select("date", "forecast_day_idx", "lat", "lon", "max_temperature")
