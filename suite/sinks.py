"""K: sinks and table maintenance; every sink is read back."""

from pyspark.sql import functions as F

from furrow.plans import advisory, catalog, cropplan, ingest, observations, planting
from furrow.session import scratch_dir
from furrow.sinks import documents, runs, tables
from suite.aggregates import ATTRIBUTES
from suite.base import query


@query("K01_advisory_write", "SELECT registry_id, iso_a3, year, month, day, final_message FROM {advisory_hist}")
def _(t):
    path = scratch_dir(t.spark, "advisory")
    tables.write_advisory(t.advisory_hist.select("registry_id", "grid_id", "iso_a3", "year", "month", "day", "final_message"), path)
    return t.spark.read.parquet(path).select("registry_id", "iso_a3", "year", "month", "day", "final_message")


@query("K02_stage_tables", "SELECT grid_id, date, max_temperature FROM {weather}")
def _(t):
    rows = t.weather.select("grid_id", "date", "max_temperature")
    return tables.write_stage(rows, scratch_dir(t.spark, "stage"))


_OBS = "(SELECT m.station_id, m.date_time, max(m.value) AS v, s.lon, CAST(month(m.date_time) AS INT) AS month FROM {measurement} m JOIN {station} s ON m.station_id = s.station_id GROUP BY 1, 2, 4, 5)"


def obs(t):
    m = t.measurement.groupBy("station_id", "date_time").agg(F.max("value").alias("v"))
    return observations.with_time_parts(m.join(t.station.select("station_id", "lon", "lat"), "station_id"), True)


@query("K03_observation_write", f"SELECT station_id, date_time, v, lon, month FROM {_OBS}")
def _(t):
    path = scratch_dir(t.spark, "obs")
    tables.write_observations(obs(t), path, use_month=True)
    return t.spark.read.parquet(path).select("station_id", "date_time", "v", "lon", "month")


@query("K04_observation_append", f"SELECT station_id, date_time, v, CASE WHEN lon < 40 THEN v * 2 END AS extra FROM {_OBS}")
def _(t):
    path = scratch_dir(t.spark, "obs")
    rows = obs(t)
    tables.write_observations(rows.where("lon >= 40"), path, use_month=True)
    late = rows.where("lon < 40").withColumn("extra", F.col("v") * 2).unionByName(
        rows.where("lon >= 40").withColumn("extra", F.lit(None).cast("double")))
    tables.append_observations(t.spark, late, path, use_month=True)
    return t.spark.read.option("mergeSchema", True).parquet(path).select("station_id", "date_time", "v", "extra")


@query("K05_conversion_run", """
SELECT m.station_id, m.date_time, m.v, m.month, year(m.date_time) AS year, CASE WHEN m.date_time >= TIMESTAMP '2024-01-20 00:00:00' THEN 'appended' ELSE 'converted' END AS load
FROM (SELECT station_id, date_time, avg(value) FILTER (attribute = 'view') AS v, CAST(month(date_time) AS INT) AS month FROM {measurement} GROUP BY 1, 2) m WHERE v IS NOT NULL""")
def _(t):
    """Narrow measurements converted month by month up to a date, then appended from it."""
    path = scratch_dir(t.spark, "converted")
    tables.convert_observations(t.measurement, t.station, path, ["view"], "2024-01-01", "2024-01-20", use_month=True)
    tables.append_between(t.measurement, t.station, path, ["view"], "2024-01-20", "2024-02-10", use_month=True)
    rows = t.spark.read.parquet(path)
    return rows.select("station_id", "date_time", F.col("view").alias("v"), "month", F.col("year").cast("long").alias("year"),
                       F.when(F.col("date_time") >= F.lit("2024-01-20").cast("timestamp_ntz"), "appended").otherwise("converted").alias("load"))


@query("K06_replace_snapshot_date", "SELECT signal_id, generated_date AS date, CASE WHEN generated_date = DATE '1998-06-10' THEN 'new' ELSE signal END AS signal FROM {signal}")
def _(t):
    path = scratch_dir(t.spark, "snap")
    s = t.signal.select("signal_id", F.col("generated_date").alias("date"), "signal", F.year("generated_date").alias("year"), F.month("generated_date").alias("month"))
    tables.write_partitions(s, path, ["year", "month"], ["date", "signal_id"])
    tables.replace_in_snapshot(t.spark, s.where("date = '1998-06-10'").withColumn("signal", F.lit("new")), path, "1998-06-10")
    return t.spark.read.parquet(path).select("signal_id", "date", "signal")


@query("K07_advisory_csv", """
SELECT registry_id, farm_unique_id AS farmer_id, final_message AS message_code, growth_stage, preferred_language FROM {advisory_hist}""")
def _(t):
    path = scratch_dir(t.spark, "csv")
    out = advisory.export_columns(t.advisory_hist, ["registry_id", "farmer_id", "message_code", "growth_stage", "preferred_language"])
    documents.write_text(out, path, ["registry_id"])
    return t.spark.read.schema("registry_id long, farmer_id string, message_code int, growth_stage string, preferred_language string").option("header", True).csv(path)


@query("K08_gridded_text", "SELECT date, lat, lon, max_temperature + 0.125 AS v FROM {reanalysis}")
def _(t):
    path = scratch_dir(t.spark, "tsv")
    rows = t.reanalysis.select("date", "lat", "lon", (F.col("max_temperature") + 0.125).alias("v"))
    documents.write_text(rows, path, sep="\t")
    return t.spark.read.schema("date date, lat double, lon double, v double").option("header", True).option("sep", "\t").csv(path)


@query("K09_observation_text", f"SELECT station_id, date_time, v FROM {_OBS}")
def _(t):
    path = scratch_dir(t.spark, "csv")
    documents.write_text(obs(t).select("date_time", "station_id", "v"), path, ["date_time", "station_id"], digits=None)
    return t.spark.read.schema("date_time timestamp_ntz, station_id long, v double").option("header", True).option("timestampNTZFormat", documents.MICROS).csv(path).select("station_id", "date_time", "v")


@query("K10_time_value_documents", """
SELECT station_id, count(*) AS steps, min(strftime(ts, '%Y-%m-%dT%H:%M:%S')) AS first, round(sum(v), 3) AS total FROM (SELECT user_id AS station_id, ts, avg(floor(value * 8) / 8) AS v FROM events GROUP BY 1, 2) GROUP BY 1""")
def _(t):
    m = t.measurement.join(t.station.select("station_id", "lon", "lat"), "station_id")
    docs = documents.time_value_documents(m, ["station_id", "lon", "lat"], "date_time", ["value"], "month")
    schema = "struct<geometry: struct<type: string, coordinates: array<double>>, data: array<struct<datetime: string, values: struct<value: double>>>>"
    d = F.from_json("document", schema)
    return docs.select("station_id", F.explode(d["data"]).alias("e")).groupBy("station_id").agg(
        F.count("*").alias("steps"), F.min("e.datetime").alias("first"), F.round(F.sum("e.values.value"), 3).alias("total"))


@query("K11_plan_features", """
SELECT farm_unique_id AS "farmID", 'Feature' AS type, lon AS x, phone FROM {farm}""")
def _(t):
    plan = t.farm.select(F.col("farm_unique_id").alias("farmID"), F.col("phone").alias("phoneNumber"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"))
    f = cropplan.as_features(plan)
    return f.select("farmID", F.get_json_object("feature", "$.type").alias("type"), F.get_json_object("feature", "$.geometry.coordinates[0]").cast("double").alias("x"),
                    F.get_json_object("feature", "$.properties.phoneNumber").alias("phone"))


@query("K12_forecast_upsert", """
SELECT forecast_date, forecast_day_idx, lat, lon, CASE WHEN forecast_date = DATE '2024-01-12' AND lat < 0 THEN max_temperature + 1 ELSE max_temperature END AS max_temperature,
  CASE WHEN forecast_date = DATE '2024-01-12' AND lat < 0 THEN NULL ELSE min_temperature END AS min_temperature FROM {forecast}""")
def _(t):
    """A run date is written, then one region of it loaded again: the other regions stay."""
    path = scratch_dir(t.spark, "fc")
    f = t.forecast.select("forecast_date", "forecast_day_idx", "lat", "lon", "max_temperature", "min_temperature")
    runs.write_runs(f, path)
    south = f.where("forecast_date = '2024-01-12' and lat < 0").withColumn("max_temperature", F.col("max_temperature") + 1)
    runs.merge_runs(south.drop("min_temperature"), path, ["forecast_day_idx", "lat", "lon"])
    return t.spark.read.option("mergeSchema", True).parquet(path).select(*f.columns)


@query("K13_seasonal_upsert", """
SELECT forecast_date, forecast_day_idx, ensemble, lat, lon, CASE WHEN forecast_date = DATE '1998-03-01' AND lon < 40 THEN temp * 2 ELSE temp END AS temp, temp_clim FROM {ensemble}""")
def _(t):
    path = scratch_dir(t.spark, "ens")
    e = t.ensemble
    runs.write_runs(e, path, cluster=["forecast_day_idx", "lat", "lon"])
    west = e.where("forecast_date = '1998-03-01' and lon < 40").withColumn("temp", F.col("temp") * 2).drop("temp_clim")
    # a value the load doesn't bring is kept
    runs.merge_runs(west, path, ["forecast_day_idx", "ensemble", "lat", "lon"], cluster=["forecast_day_idx", "lat", "lon"], fill=True)
    return t.spark.read.parquet(path).select(*e.columns)


@query("K14_variable_merge", """
SELECT COALESCE(a.date, b.date) AS date, COALESCE(a.grid_id, b.grid_id) AS grid_id, a.max_temperature, b.humidity FROM (SELECT date, grid_id, max_temperature FROM {weather} WHERE max_temperature > 15) a
FULL JOIN (SELECT date, grid_id, humidity FROM {weather} WHERE humidity > 20) b ON a.date = b.date AND a.grid_id = b.grid_id""")
def _(t):
    a = t.weather.where("max_temperature > 15").select("date", "grid_id", "max_temperature")
    b = t.weather.where("humidity > 20").select("date", "grid_id", "humidity")
    return ingest.merge_variables(a, b, ["date", "grid_id"], "humidity")


@query("K15_raster_append", "SELECT CAST(time AS DATE) AS day, count(*) AS n, sum(precipitation) AS total FROM {raster} GROUP BY 1")
def _(t):
    path = scratch_dir(t.spark, "raster")
    r = t.raster.withColumn("time", F.col("time").cast("timestamp_ntz")).withColumn("day", F.to_date("time"))
    tables.upsert_partition(r.where("day < '2024-01-16'"), path, "day", ["time", "lat", "lon"])
    tables.upsert_partition(r.where("day >= '2024-01-15'"), path, "day", ["time", "lat", "lon"])
    return t.spark.read.parquet(path).groupBy("day").agg(F.count("*").alias("n"), F.sum("precipitation").alias("total"))


@query("K16_archive_rollover", """
SELECT CAST(date_trunc('month', f.forecast_date) AS DATE) AS forecast_date, f.forecast_day_idx, f.lat, f.lon, f.max_temperature FROM {forecast} f
JOIN (SELECT max(forecast_date) AS d FROM {forecast} GROUP BY date_trunc('month', forecast_date)) m ON f.forecast_date = m.d""")
def _(t):
    return ingest.archive_month(t.forecast, ["min_temperature", "total_rainfall"])


@query("K17_retention", """
SELECT file_id, COALESCE(TIMESTAMP '1998-07-01' >= deleted_at + to_days(CAST(COALESCE(CASE WHEN dataset_id % 2 = 0 THEN dataset_id * 30 END, 1) AS INT)) AND NOT is_latest, false) AS expired FROM {source_file}""")
def _(t):
    config = t.source_file.where("dataset_id % 2 = 0").select("dataset_id", (F.col("dataset_id") * 30).alias("days_to_keep")).distinct()
    return catalog.retention(t.source_file, config, "1998-07-01 00:00:00").select("file_id", "expired")


@query("K18_latest_switch", "SELECT file_id, row_number() OVER (PARTITION BY dataset_id ORDER BY version DESC, file_id DESC) = 1 AS is_latest FROM {source_file}")
def _(t):
    return catalog.switch_latest(t.source_file).select("file_id", "is_latest")


@query("K19_keyed_upsert", """
SELECT farm_id, max(signal_id) AS last_id, coalesce(min(signal_id) FILTER (signal LIKE 'Plant%'), min(signal_id)) AS first_id FROM {signal} GROUP BY farm_id""")
def _(t):
    s = t.signal.select("farm_id", "signal_id", "signal", F.col("signal_id").alias("arrival"))
    old, new = s.where("signal like 'Plant%'").withColumn("arrival", F.lit(0)), s.drop("signal")
    stored = old.groupBy("farm_id").agg(F.min("signal_id").alias("signal_id"), F.min("arrival").alias("arrival"))
    last = ingest.upsert(stored, new, ["farm_id"], "last").select("farm_id", F.col("signal_id").alias("last_id"))
    # keep-first: what is stored stays, farms without a row get the earliest of the load
    first = ingest.upsert(stored, new, ["farm_id"], "first").select("farm_id", F.col("signal_id").alias("first_id"))
    return last.join(first, "farm_id")


@query("K20_coverage", """
SELECT d.dataset_id, least(DATE '1997-01-01', min(CAST(f.version AS DATE))) AS start_date, greatest(DATE '1997-06-01', max(CAST(f.version AS DATE))) AS end_date
FROM (SELECT DISTINCT dataset_id FROM {source_file}) d JOIN {source_file} f ON d.dataset_id = f.dataset_id GROUP BY 1""")
def _(t):
    current = t.source_file.select("dataset_id").distinct().withColumn("start_date", F.to_date(F.lit("1997-01-01"))).withColumn("end_date", F.to_date(F.lit("1997-06-01")))
    loaded = t.source_file.select("dataset_id", F.to_date("version").alias("date"))
    return catalog.coverage(current, loaded)


@query("K21_reset_attributes", "SELECT measurement_id FROM {measurement} WHERE attribute NOT IN ('click', 'view')")
def _(t):
    drop = t.measurement.where("attribute in ('click', 'view')").select("attribute").distinct()
    return catalog.reset_attributes(t.measurement, drop).select("measurement_id")


@query("K22_replace_by_key", """
SELECT rule_id, config_id, code FROM {rule} WHERE config_id <> 2 UNION ALL SELECT rule_id + 1000000, config_id, code + 1 FROM {rule} WHERE config_id = 2""")
def _(t):
    r = t.rule.select("rule_id", "config_id", "code")
    new = r.where("config_id = 2").select((F.col("rule_id") + 1000000).alias("rule_id"), "config_id", (F.col("code") + 1).cast("int").alias("code"))
    path = scratch_dir(t.spark, "rules")
    tables.replace_table(t.spark, catalog.replace_by_key(r, new, ["config_id"]), path)
    return t.spark.read.parquet(path)
