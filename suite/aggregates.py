"""A: aggregations."""

from pyspark.sql import functions as F

from furrow.plans import advisory, agronomy, audit, catalog, cubes, ingest, observations, usage
from suite.base import query

ATTRIBUTES = ["click", "error", "purchase", "signup", "view"]
SLOTS_SQL = "(SELECT farm_id, crop_id, message_date, unnest([message, message_2, message_3, message_4, message_5]) AS code FROM {advisory_hist})"


@query("A01_to_wide", """
SELECT station_id, day, """ + ", ".join(f"sum(value) FILTER (attribute = '{a}') / count(*) FILTER (attribute = '{a}') AS {a}" for a in ATTRIBUTES) + """
FROM {daily_eav} GROUP BY station_id, day""")
def _(t):
    return observations.to_wide(t.daily_eav, ["station_id", "day"], ATTRIBUTES)


@query("A02_to_long", """
SELECT grid_id, date, 'humidity' AS attribute, humidity AS value FROM {weather} WHERE humidity IS NOT NULL
UNION ALL SELECT grid_id, date, 'rain', CASE WHEN total_rainfall > 4 THEN total_rainfall END FROM {weather} WHERE total_rainfall > 4""")
def _(t):
    w = t.weather.select("grid_id", "date", "humidity", F.when(F.col("total_rainfall") > 4, F.col("total_rainfall")).alias("rain"))
    return observations.to_long(w, ["grid_id", "date"], ["humidity", "rain"])


@query("A03_members_to_list", """
SELECT forecast_date, forecast_day_idx, lat, lon, to_json(list(CAST(temp AS INT) ORDER BY ensemble)) AS members, arg_min(temp_clim, ensemble) AS temp_clim
FROM {ensemble} GROUP BY ALL""")
def _(t):
    out = cubes.members_to_list(t.ensemble, ["forecast_date", "forecast_day_idx", "lat", "lon"], ["temp"], ["temp_clim"])
    return out.withColumn("members", F.to_json(F.transform("temp", lambda v: v.cast("int"))).cast("string")).drop("temp")


@query("A04_percentiles", """
SELECT lat, lon, forecast_date, quantile_cont(temp, 0.1) AS percentile_10, quantile_cont(temp, 0.5) AS percentile_50, quantile_cont(temp, 0.9) AS percentile_90
FROM {ensemble} GROUP BY ALL""".replace("quantile_cont(temp, 0.1)", "round(quantile_cont(temp, 0.1), 6)").replace("quantile_cont(temp, 0.5)", "round(quantile_cont(temp, 0.5), 6)").replace("quantile_cont(temp, 0.9)", "round(quantile_cont(temp, 0.9), 6)"))
def _(t):
    out = cubes.percentiles(t.ensemble, ["lat", "lon", "forecast_date"], "temp")
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c.startswith("percentile")})


@query("A05_registry_summary", "SELECT min(planting_date) AS min_planting_date, count(DISTINCT crop_id) AS crops FROM {registry}")
def _(t):
    return agronomy.registry_summary(t.registry)


@query("A06_extent", "SELECT min(lon) AS min_lon, min(lat) AS min_lat, max(lon) AS max_lon, max(lat) AS max_lat FROM {farm}")
def _(t):
    return audit.extent(t.farm)


@query("A07_last_times", """
SELECT u.user_id AS station_id, a.attribute, COALESCE(max(m.date_time), TIMESTAMP '2023-01-01 00:00:00') AS last_time
FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (VALUES ('click'), ('rare')) a(attribute)
LEFT JOIN {measurement} m ON m.station_id = u.user_id AND m.attribute = a.attribute GROUP BY 1, 2""")
def _(t):
    wanted = t.station.select("station_id", F.explode(F.array(F.lit("click"), F.lit("rare"))).alias("attribute"))
    return observations.last_times(t.measurement, ["station_id", "attribute"], wanted, "2023-01-01 00:00:00")


@query("A08_time_bounds", "SELECT min(date_time) AS min_time, max(date_time) AS max_time FROM {measurement}")
def _(t):
    return observations.time_bounds(t.measurement)


@query("A09_last_sent", f"SELECT farm_id, crop_id, code, max(message_date) AS last_date FROM {SLOTS_SQL} WHERE code IS NOT NULL GROUP BY 1, 2, 3")
def _(t):
    return advisory.last_sent(t.advisory_hist)


@query("A10_message_counts", """
SELECT count(*) AS advisories, count(*) FILTER (is_empty_message) AS empty_messages, count(*) FILTER (has_repetitive_message) AS repetitive_messages FROM {advisory_hist}""")
def _(t):
    return advisory.message_counts(t.advisory_hist)


@query("A11_requests_per_day", "SELECT CAST(requested_at AS DATE) AS day, count(*) AS requests FROM {request_log} GROUP BY 1 ORDER BY 1 DESC")
def _(t):
    return usage.per_day(t.request_log)


@query("A12_requests_per_product", "SELECT json_extract_string(query_params, '$.product') AS product, count(*) AS requests FROM {request_log} GROUP BY 1")
def _(t):
    return usage.per_product(t.request_log)


@query("A13_grids_per_country", "SELECT c.country, count(*) AS grids FROM {grid} g JOIN {country} c ON g.country_id = c.country_id GROUP BY 1")
def _(t):
    return audit.per_country(t.grid, t.country)


LOG_SQL = """(SELECT farm_unique_id, crop, min('Stage ' || (registry_id % 4 + 1)) AS growth_stage_in FROM {advisory_hist} WHERE NOT is_empty_message GROUP BY 1, 2)"""


def external_log(t):
    return t.advisory_hist.where("not is_empty_message").select("farm_unique_id", "crop", F.concat(
        F.lit("Stage "), (F.col("registry_id") % 4 + 1).cast("string")).alias("growth_stage_in"))


@query("A14_stage_counts", f"""
SELECT a.growth_stage, count(*) AS farms, CAST(count(*) FILTER (a.growth_stage <> l.growth_stage_in) AS BIGINT) AS differences
FROM {{advisory_hist}} a JOIN {LOG_SQL} l ON a.farm_unique_id = l.farm_unique_id AND a.crop = l.crop GROUP BY 1""")
def _(t):
    return audit.stage_counts(audit.stage_differences(t.advisory_hist, external_log(t)))


@query("A15_difference_share", """
WITH c AS (SELECT s.signal IS DISTINCT FROM CASE WHEN f.farm_id % 3 = 0 THEN 'Plant NOW Tier 1a' WHEN f.farm_id % 3 = 1 THEN 'Plant NOW Tier 1b' END AS d
  FROM {farm} f JOIN {signal} s ON f.farm_unique_id = s.farm_unique_id WHERE s.generated_date = DATE '1998-06-10')
SELECT CAST(count(*) FILTER (d) AS BIGINT) AS differences, count(*) AS total, CASE WHEN count(*) > 0 THEN count(*) FILTER (d) * 100 / count(*) ELSE 0.0 END::DOUBLE AS percentage FROM c""")
def _(t):
    k = F.col("farm_id") % 3
    farmers = t.farm.select(F.col("farm_unique_id").alias("farmer_id"), F.when(k == 0, "Plant NOW Tier 1a").when(
        k == 1, "Plant NOW Tier 1b").alias("sent_signal"))
    signals = t.signal.withColumnRenamed("generated_date", "date").select("farm_unique_id", "date", "signal")
    out = audit.difference_share(audit.compare_signals(farmers, signals, "1998-06-10"))
    return out.withColumn("differences", F.coalesce("differences", F.lit(0)))


@query("A16_latest_per_key", """
SELECT dataset_id, file_id, version FROM {source_file} QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY version DESC, file_id DESC) = 1""")
def _(t):
    from furrow.operators.skew import latest_by
    return latest_by(t.source_file.select("dataset_id", "file_id", "version"), ["dataset_id"], ["version", "file_id"])


@query("A17_one_per_group", "SELECT count(DISTINCT grid_id) AS groups, count(DISTINCT grid_id) AS picked, TRUE AS members FROM {advisory_hist}")
def _(t):
    a = t.advisory_hist.select("grid_id", "registry_id")
    one = audit.one_per_group(a, "grid_id", "registry_id", 7)
    ok = one.join(a.withColumn("_m", F.lit(True)), ["grid_id", "registry_id"], "left")
    return ok.agg(F.countDistinct("grid_id").alias("groups"), F.count("*").alias("picked"),
                  F.bool_and(F.coalesce("_m", F.lit(False))).alias("members"))


@query("A18_ingest_quality", """
WITH f AS (SELECT l_suppkey AS grid_id, bool_or(l_linestatus = 'F' AND l_suppkey % 3 > 0) AS v, bool_or(l_quantity > 49) AS g FROM lineitem WHERE l_suppkey % 7 > 0 GROUP BY 1)
SELECT count(*) FILTER (f.grid_id IS NULL) AS missing_files, count(*) FILTER (NOT f.v) AS invalid_documents, count(*) FILTER (f.g) AS gap_filled,
  count(*) AS grids, count(*) FILTER (f.g) / count(*) AS gap_filled_share,
  (SELECT count(*) FROM {grid} h WHERE NOT EXISTS (SELECT 1 FROM {grid} d WHERE d.grid_id % 5 > 0 AND d.lon = h.lon AND d.lat = h.lat)) AS missing_hashes
FROM {grid} r FULL JOIN f ON r.grid_id = f.grid_id""")
def _(t):
    """Of every seventh grid no file came, every third document is broken, every fifth cell is no cube cell."""
    files = t.lineitem.where("l_suppkey % 7 > 0").select(
        F.col("l_suppkey").alias("grid_id"), ((F.col("l_linestatus") == "F") & (F.col("l_suppkey") % 3 > 0)).alias("is_valid"), (F.col("l_quantity") > 49).alias("is_gap_filled"))
    delivered = t.grid.where("grid_id % 5 > 0").select(ingest.rounded_geohash().alias("geohash"))
    return ingest.ingest_quality(files, t.grid, delivered)

REG_KEY = "group_id, farm_id, crop_id, crop_stage_type_id, planting_date"


@query("A19_registry_counts", f"""
WITH r AS (SELECT registry_id, {REG_KEY}, CASE WHEN registry_id % 9 = 0 THEN NULL ELSE 1 END AS grid_id FROM {{registry}}),
e AS (SELECT DISTINCT {REG_KEY} FROM {{registry}} WHERE group_id = 0),
m AS (SELECT r.*, EXISTS (SELECT 1 FROM e WHERE e.group_id = r.group_id AND e.farm_id = r.farm_id AND e.crop_id = r.crop_id
   AND e.crop_stage_type_id = r.crop_stage_type_id AND e.planting_date = r.planting_date) AS old FROM r)
SELECT count(*) AS total, count(*) FILTER (NOT old AND grid_id IS NOT NULL) AS insertable, count(*) FILTER (old) AS existing,
  count(*) <> count(*) FILTER (NOT old AND grid_id IS NOT NULL) + count(*) FILTER (old) AS mismatch FROM m""")
def _(t):
    from furrow.plans import registry
    rows = t.registry.withColumn("grid_id", F.when(F.col("registry_id") % 9 != 0, F.lit(1)))
    return registry.counts(rows, t.registry.where("group_id = 0"))


@query("A20_indicator_totals", """
SELECT indicator, total FROM (SELECT sum(spw_20) AS spw_20, sum(spw_40) AS spw_40, sum(spw_60) AS spw_60 FROM {cells})
UNPIVOT (total FOR indicator IN (spw_20, spw_40, spw_60))""")
def _(t):
    return audit.indicator_totals(t.cells, ["spw_20", "spw_40", "spw_60"])


@query("A21_table_sizes", """
SELECT 'orders' AS "table", count(*) AS "rows" FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FROM events""")
def _(t):
    return audit.table_sizes({"orders": t.orders, "lineitem": t.lineitem, "events": t.events})


@query("A22_keep_newest", """
SELECT signal_id, farm_id, generated_date FROM {signal} QUALIFY signal_id = max(signal_id) OVER (PARTITION BY farm_id, generated_date)""")
def _(t):
    return audit.drop_older_copies(t.signal, ["farm_id", "generated_date"], "signal_id").select("signal_id", "farm_id", "generated_date")


@query("A22_removed_copies", "SELECT CAST(count(*) - count(DISTINCT (farm_id, generated_date)) AS BIGINT) AS removed FROM {signal}")
def _(t):
    return audit.removed_copies(t.signal, ["farm_id", "generated_date"])


@query("A23_errors_per_status", "SELECT status_code, count(*) AS errors FROM {request_log} WHERE status_code <> 200 GROUP BY 1")
def _(t):
    return usage.errors_per_status(t.request_log)


@query("A24_product_attributes", """
SELECT d.product, string_agg(DISTINCT a.variable_name, ',' ORDER BY a.variable_name) AS attributes FROM {dataset} d
JOIN {dataset_attribute} da ON d.dataset_id = da.dataset_id JOIN {attribute} a ON da.attribute_id = a.attribute_id
WHERE d.product <> 'Product_0' GROUP BY 1""")
def _(t):
    out = catalog.product_attributes(t.dataset, t.dataset_attribute, t.attribute, exclude="Product_0")
    return out.withColumn("attributes", F.array_join("attributes", ","))


@query("A25_group_sizes", """
SELECT COALESCE(f.g, u.g) AS group_id, COALESCE(f.n, 0) AS farms, COALESCE(u.n, 0) AS users FROM
 (SELECT group_id AS g, count(DISTINCT farm_id) AS n FROM {registry} GROUP BY 1) f FULL JOIN
 (SELECT user_id % 6 AS g, count(DISTINCT user_id) AS n FROM events GROUP BY 1) u ON f.g = u.g""")
def _(t):
    users = t.events.select((F.col("user_id") % 6).alias("group_id"), "user_id")
    return audit.group_sizes(t.registry, users)


@query("A26_completeness", """
SELECT grid_id, count(DISTINCT date) AS days, count(DISTINCT date) = 10 AS complete FROM {weather}
WHERE date BETWEEN DATE '1998-06-25' AND DATE '1998-07-14' GROUP BY 1""")
def _(t):
    from furrow.plans.agronomy import between_days
    return ingest.completeness(t.weather.where(between_days("1998-06-25", "1998-07-14")), 10)
