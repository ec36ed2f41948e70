"""W: window and time-series operators."""

from pyspark.sql import functions as F

from furrow.functions import dates
from furrow.operators import spatial
from furrow.plans import advisory, agronomy, cropplan, pests, planting
from suite.base import FIRST_DAY, REQUEST_DATE, query

# running degree days of every registry grid-crop, as SQL
GC_SQL = """gc AS (SELECT DISTINCT grid_id, crop_id, crop_stage_type_id, planting_date, prev_growth_stage_id, prev_growth_stage_start_date, config_id, planting_date_epoch FROM {registry_full}),
cfg AS (SELECT gc.*, g.gdd_base, g.gdd_cap FROM gc JOIN {gdd_config} g ON gc.crop_id = g.crop_id AND gc.config_id = g.config_id),
days AS (SELECT cfg.*, w.date, (least(w.max_temperature, gdd_cap) + greatest(w.min_temperature, gdd_base)) / 2 - gdd_base AS gdd
  FROM cfg JOIN {weather} w ON w.grid_id = cfg.grid_id WHERE w.date > cfg.planting_date AND w.date < DATE '1998-07-01'),
run AS (SELECT *, sum(gdd) OVER (PARTITION BY grid_id, crop_id, crop_stage_type_id, planting_date, prev_growth_stage_id, prev_growth_stage_start_date, config_id ORDER BY date) AS gdd_sum FROM days)"""


def season(t):
    return t.weather.where(agronomy.between_days(FIRST_DAY, "1998-07-04"))


def series(t):
    return agronomy.gdd_series(agronomy.registry_grid_crops(t.registry_full), season(t), t.gdd_config, REQUEST_DATE)


_K = ["grid_id", "crop_id", "crop_stage_type_id", "planting_date", "prev_growth_stage_id", "config_id"]


@query("W01_running_gdd", f"WITH {GC_SQL} SELECT {', '.join(_K)}, prev_growth_stage_start_date, date, gdd, gdd_sum FROM run")
def _(t):
    return series(t).select(*_K, "prev_growth_stage_start_date", "date", "gdd", "gdd_sum")


STAGE_SQL = GC_SQL + """, m AS (SELECT *, COALESCE(lag(gdd_threshold) OVER (PARTITION BY crop_id, crop_stage_type_id, config_id ORDER BY gdd_threshold), 0) AS lo,
   gdd_threshold = max(gdd_threshold) OVER (PARTITION BY crop_id, crop_stage_type_id, config_id) AS is_last FROM {matrix}),
tot AS (SELECT cfg.*, (SELECT gdd_sum FROM run WHERE run.grid_id = cfg.grid_id AND run.crop_id = cfg.crop_id AND run.crop_stage_type_id = cfg.crop_stage_type_id AND run.planting_date = cfg.planting_date
   AND run.prev_growth_stage_id IS NOT DISTINCT FROM cfg.prev_growth_stage_id AND run.prev_growth_stage_start_date IS NOT DISTINCT FROM cfg.prev_growth_stage_start_date AND run.config_id = cfg.config_id AND run.date = DATE '1998-06-30') AS total_gdd FROM cfg),
hit AS (SELECT tot.*, arg_min(m.growth_stage_id, m.gdd_threshold) FILTER (tot.total_gdd <= m.gdd_threshold) AS s1, arg_min(m.lo, m.gdd_threshold) FILTER (tot.total_gdd <= m.gdd_threshold) AS l1,
   max(CASE WHEN m.is_last THEN m.growth_stage_id END) AS s2, max(CASE WHEN m.is_last THEN m.gdd_threshold END) AS l2
   FROM tot LEFT JOIN m ON m.crop_id = tot.crop_id AND m.crop_stage_type_id = tot.crop_stage_type_id AND m.config_id = tot.config_id GROUP BY ALL),
st AS (SELECT *, COALESCE(s1, s2) AS stage, CASE WHEN s1 IS NOT NULL THEN l1 ELSE l2 END AS lo FROM hit),
aft AS (SELECT st.*, max(run.date) FILTER (run.gdd_sum <= st.lo AND run.date < DATE '1998-06-30') AS last_under FROM st LEFT JOIN run ON run.grid_id = st.grid_id AND run.crop_id = st.crop_id AND run.crop_stage_type_id = st.crop_stage_type_id
   AND run.planting_date = st.planting_date AND run.prev_growth_stage_id IS NOT DISTINCT FROM st.prev_growth_stage_id AND run.prev_growth_stage_start_date IS NOT DISTINCT FROM st.prev_growth_stage_start_date AND run.config_id = st.config_id GROUP BY ALL),
staged AS (SELECT grid_id, crop_id, crop_stage_type_id, planting_date, planting_date_epoch, prev_growth_stage_id, prev_growth_stage_start_date, config_id, total_gdd,
   CAST(CASE WHEN s2 IS NULL THEN prev_growth_stage_id ELSE stage END AS INT) AS growth_stage_id,
   CAST(CASE WHEN s2 IS NULL OR stage = prev_growth_stage_id THEN prev_growth_stage_start_date WHEN lo = 0 THEN planting_date_epoch
     WHEN last_under IS NOT NULL THEN CAST(last_under + 1 - DATE '1970-01-01' AS BIGINT) * 86400 ELSE planting_date_epoch END AS BIGINT) AS growth_stage_start_date FROM aft)"""


def staged(t):
    gc = agronomy.registry_grid_crops(t.registry_full)
    return agronomy.growth_stages(series(t), t.matrix, REQUEST_DATE, agronomy.with_gdd_config(gc, t.gdd_config))


@query("W02_stage_start", f"WITH {STAGE_SQL} SELECT {', '.join(_K)}, prev_growth_stage_start_date, total_gdd, growth_stage_id, growth_stage_start_date FROM staged")
def _(t):
    return staged(t)


@query("W03_rain_since_planting", """
WITH s AS (SELECT DISTINCT grid_id, planting_date_epoch FROM {registry_full})
SELECT s.grid_id, s.planting_date_epoch, COALESCE(sum(w.total_rainfall), 0) AS seasonal_precipitation FROM s LEFT JOIN {weather} w ON w.grid_id = s.grid_id
 AND w.date >= DATE '1970-01-01' + CAST(s.planting_date_epoch / 86400 AS INT) AND w.date <= DATE '1998-07-04' GROUP BY 1, 2""")
def _(t):
    keys = t.registry_full.select("grid_id", F.col("planting_date_epoch").cast("long")).distinct()
    return agronomy.rain_since(keys, season(t), [], "planting_date_epoch", REQUEST_DATE, "seasonal_precipitation")


@query("W04_rain_since_stage", f"""
WITH {STAGE_SQL}, s AS (SELECT DISTINCT grid_id, growth_stage_start_date FROM staged)
SELECT s.grid_id, s.growth_stage_start_date, COALESCE(sum(w.total_rainfall), 0) AS growth_stage_precipitation FROM s LEFT JOIN {{weather}} w ON w.grid_id = s.grid_id
 AND (s.growth_stage_start_date IS NULL OR w.date >= DATE '1970-01-01' + CAST(s.growth_stage_start_date / 86400 AS INT)) AND w.date BETWEEN DATE '1998-03-03' AND DATE '1998-07-04' GROUP BY 1, 2""")
def _(t):
    keys = staged(t).select("grid_id", "growth_stage_start_date").distinct()
    return agronomy.rain_since(keys, season(t), [], "growth_stage_start_date", REQUEST_DATE, "growth_stage_precipitation")


FEATURE_SQL = """feat AS (SELECT grid_id, sum((max_temperature + min_temperature) / 2) FILTER (near) / count(*) FILTER (near) AS temperature,
  sum(humidity) FILTER (near) / count(*) FILTER (near) AS humidity, sum(total_rainfall) AS total_rainfall, sum(total_evapotranspiration) AS total_evapotranspiration,
  CASE WHEN sum(total_evapotranspiration) <> 0 THEN sum(total_rainfall) / sum(total_evapotranspiration) WHEN sum(total_rainfall) > 0 THEN 999999.0 END AS p_pet
 FROM (SELECT *, date BETWEEN DATE '1998-07-01' AND DATE '1998-07-04' AS near FROM {weather} WHERE date BETWEEN DATE '1998-06-25' AND DATE '1998-07-04') GROUP BY 1)"""


@query("W05_near_term_means", f"WITH {FEATURE_SQL} SELECT grid_id, temperature, humidity FROM feat")
def _(t):
    return agronomy.grid_features(t.weather, REQUEST_DATE).select("grid_id", "temperature", "humidity")


@query("W06_rain_demand_ratio", f"WITH {FEATURE_SQL} SELECT grid_id, total_rainfall, total_evapotranspiration, p_pet FROM feat")
def _(t):
    return agronomy.grid_features(t.weather, REQUEST_DATE).select("grid_id", "total_rainfall", "total_evapotranspiration", "p_pet")


@query("W07_slots", """
WITH c AS (SELECT DISTINCT registry_id, config_id, unnest([message, message_2, message_3, message_4, message_5]) AS code FROM {advisory_hist}),
r AS (SELECT c.registry_id, c.code, row_number() OVER (PARTITION BY c.registry_id ORDER BY COALESCE(p.priority, 0) DESC, c.code) AS rn FROM c LEFT JOIN {priority} p ON p.config_id = c.config_id AND p.code = c.code WHERE c.code IS NOT NULL)
SELECT registry_id, max(code) FILTER (rn = 1) AS message, max(code) FILTER (rn = 2) AS message_2, max(code) FILTER (rn = 3) AS message_3, max(code) FILTER (rn = 4) AS message_4, max(code) FILTER (rn = 5) AS message_5 FROM r GROUP BY 1""")
def _(t):
    codes = t.advisory_hist.select("registry_id", "config_id", F.explode(F.array_distinct(F.array_compact(F.array(*advisory.SLOTS)))).alias("code"))
    ranked = codes.join(t.priority, ["config_id", "code"], "left").groupBy("registry_id").agg(F.transform(F.array_sort(F.collect_set(
        F.struct((-F.coalesce("priority", F.lit(0))).alias("p"), F.col("code").alias("c")))), lambda s: s["c"]).alias("codes"))
    return advisory.to_slots(ranked).drop("codes")


@query("W08_rain_windows", """
SELECT grid_id, COALESCE(sum(total_rainfall) FILTER (date BETWEEN DATE '1998-06-27' AND DATE '1998-06-30'), 0) AS last_4_days,
  COALESCE(sum(total_rainfall) FILTER (date BETWEEN DATE '1998-06-29' AND DATE '1998-06-30'), 0) AS last_2_days,
  COALESCE(sum(total_rainfall) FILTER (date BETWEEN DATE '1998-07-01' AND DATE '1998-07-02'), 0) AS today_tomorrow
FROM {weather} WHERE date BETWEEN DATE '1998-06-27' AND DATE '1998-07-02' GROUP BY 1""")
def _(t):
    return planting.rain_windows(t.weather, "grid_id", REQUEST_DATE, "total_rainfall")


@query("W09_forecast_day_number", """
SELECT signal_id, generated_date - min(generated_date) OVER (PARTITION BY farm_id) + 1 AS day_n FROM {signal}""".replace("SELECT signal_id, ", "SELECT signal_id, CAST(").replace(" + 1 AS day_n", " + 1 AS INT) AS day_n"))
def _(t):
    return cropplan.forecast_days(t.signal, "farm_id", "generated_date").select("signal_id", "day_n")


@query("W10_axis_gaps", """
WITH i AS (SELECT DISTINCT CAST((lat + 27.75) / 0.5 AS INT) AS lat_idx FROM {grid})
SELECT CAST(r.i AS INT) AS lat_idx, NOT EXISTS (SELECT 1 FROM i WHERE i.lat_idx = r.i) AS is_gap_filled
FROM range((SELECT min(lat_idx) FROM i), (SELECT max(lat_idx) + 1 FROM i)) r(i)""")
def _(t):
    idx = t.grid.select(spatial.axis_index(F.col("lat"), -27.75, 0.5).alias("lat_idx"))
    return spatial.fill_index_gaps(idx, "lat_idx")


@query("W11_contiguity", """
WITH i AS (SELECT DISTINCT CAST((lon - 20.25) / 0.5 AS INT) AS x FROM {grid})
SELECT COALESCE(bool_and(n IS NULL OR n - x = 1), true) AS contiguous FROM (SELECT x, lead(x) OVER (ORDER BY x) AS n FROM i)""")
def _(t):
    return spatial.is_contiguous(t.grid.select(spatial.axis_index(F.col("lon"), 20.25, 0.5).alias("x")), "x")


def schedules(t):
    """Two nth-weekday schedules, one exact date, one inactive."""
    return t.spark.createDataFrame([
        (1, "Time To Action 1", 1, 1, None, True, 1), (2, "Time To Action 2", 3, 1, None, True, 1),
        (3, "End of season", None, None, "1998-06-02", True, 5), (4, "Start of Season", 2, 4, None, False, 9)],
        "schedule_id int, group string, day_occurrence_in_month int, day_of_week int, schedule_date string, active boolean, priority int"
    ).withColumn("schedule_date", F.to_date("schedule_date"))


@query("W12_schedule_of_day", """
WITH s AS (SELECT * FROM (VALUES (1, 'Time To Action 1', 1, 1, NULL::DATE, 1), (2, 'Time To Action 2', 3, 1, NULL, 1), (3, 'End of season', NULL, NULL, DATE '1998-06-02', 5)) v(id, g, n, w, d, p)),
o AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT o.day, CAST(ceil(day(o.day) / 7) AS INT) AS occurrence, arg_max(s.g, s.p) AS "group" FROM o JOIN s ON (ceil(day(o.day) / 7) = s.n AND isodow(o.day) - 1 = s.w) OR s.d = o.day GROUP BY 1, 2""")
def _(t):
    days = t.orders.select(F.to_date("o_orderdate").alias("day")).distinct()
    return pests.schedules_of_days(days, schedules(t)).withColumn("occurrence", dates.weekday_occurrence(F.col("day")))


@query("W13_gdd_audit", """
WITH c AS (SELECT DISTINCT p_name AS crop, CASE WHEN contains(p_name, 'red') THEN 10.0 ELSE 8.0 END::DOUBLE AS b, CASE WHEN contains(p_name, 'red') THEN 35.0 ELSE 30.0 END::DOUBLE AS k FROM part WHERE contains(p_name, 'red') OR contains(p_name, 'ring')),
d AS (SELECT w.grid_id, c.crop, w.date, CASE WHEN w.date <> DATE '1998-04-01' THEN (least(max_temperature, k) + greatest(min_temperature, b)) / 2 - b END AS gdd
 FROM c JOIN {farm} f ON f.farm_id % 7 = length(c.crop) % 7 AND f.farm_id < 100 JOIN {weather} w ON w.grid_id = f.grid_id AND w.date BETWEEN DATE '1998-04-01' AND DATE '1998-07-04')
SELECT grid_id, crop, date, gdd, CASE WHEN gdd IS NOT NULL THEN sum(gdd) OVER (PARTITION BY grid_id, crop ORDER BY date) END AS gdd_sum FROM (SELECT DISTINCT * FROM d)""".replace(
    "JOIN {farm} f ON f.farm_id % 7 = length(c.crop) % 7 AND f.farm_id < 100 JOIN {weather} w ON w.grid_id = f.grid_id AND", "JOIN {weather} w ON w.grid_id % 5 = length(c.crop) % 5 AND"))
def _(t):
    lookup = t.spark.createDataFrame([(1, "red", 10.0, 35.0), (2, "ring", 8.0, 30.0)], "order int, key string, base double, cap double")
    # every location grows the crops whose name length matches its id class
    names = t.part.select(F.col("p_name").alias("crop")).distinct().withColumn("_c", F.length("crop") % 5)
    names = names.where(F.contains(F.col("crop"), F.lit("red")) | F.contains(F.col("crop"), F.lit("ring")))
    places = t.grid.select("grid_id", (F.col("grid_id") % 5).cast("int").alias("_c")).join(names, "_c").drop("_c")
    return agronomy.gdd_audit(t.weather, places, lookup, "1998-04-01", REQUEST_DATE).select("grid_id", "crop", "date", "gdd", "gdd_sum")


@query("W14_max_over_time", "SELECT lat, lon, max(clim_mean_wrsi) AS index_max FROM {climatology} GROUP BY 1, 2")
def _(t):
    return planting.max_over_time(t.climatology, ["lat", "lon"], "clim_mean_wrsi", "index_max")


@query("W15_dense_days", """
SELECT g.grid_id, CAST(d AS DATE) AS date, w.total_rainfall FROM (SELECT DISTINCT grid_id FROM {registry_full}) g
CROSS JOIN (SELECT unnest(generate_series(DATE '1998-06-25', DATE '1998-07-04', INTERVAL 1 DAY)) AS d) LEFT JOIN {weather} w ON w.grid_id = g.grid_id AND w.date = d""")
def _(t):
    return agronomy.dense_days(t.registry_full, t.weather, "1998-06-25", "1998-07-04").select("grid_id", "date", "total_rainfall")
