"""X: scalar functions."""

from pyspark.sql import functions as F

from furrow.functions import dates, geo, numeric, text
from furrow.operators import spatial
from furrow.plans import agronomy, cropplan
from furrow.schema import check_columns, first_present
from suite.base import query


@query("X01_epoch_and_date", """
SELECT registry_id, CAST(planting_date - DATE '1970-01-01' AS BIGINT) * 86400 AS epoch,
       CAST(planting_date AS VARCHAR) AS day_text, planting_date AS back FROM {registry}""")
def _(t):
    e = dates.to_epoch(F.col("planting_date"))
    return t.registry.select("registry_id", e.alias("epoch"), dates.epoch_to_date_text(e).alias("day_text"),
                             dates.epoch_to_date(e).alias("back"))


@query("X02_grid_crop_key", """
SELECT registry_id, crop_id || '_' || crop_stage_type_id || '_' || grid_id AS grid_crop_key FROM {registry_full}""")
def _(t):
    return t.registry_full.select("registry_id", text.grid_crop_key(
        F.col("crop_id"), F.col("crop_stage_type_id"), F.col("grid_id")).alias("grid_crop_key"))


@query("X03_split_crop_stage", """
SELECT p_partkey, p_brand AS crop, CASE WHEN p_type = 'MEDIUM' THEN 'Mid' ELSE p_type END AS stage FROM part""")
def _(t):
    cs = text.split_crop_stage(F.concat_ws("_", F.col("p_brand"), F.when(
        F.col("p_type") == "MEDIUM", "Medium").otherwise(F.col("p_type"))))
    return t.part.select("p_partkey", cs["crop"].alias("crop"), cs["stage"].alias("stage"))


@query("X04_fold_names_and_ids", """
SELECT c_custkey, lower(c_mktsegment) || ' ' || lower(c_name) AS folded, CAST(c_custkey AS VARCHAR) AS clean_id FROM customer""")
def _(t):
    return t.customer.select(
        "c_custkey", text.fold_name(F.concat(F.lit("  "), "c_mktsegment", F.lit("   "), "c_name", F.lit(" "))).alias("folded"),
        text.clean_id(F.concat(F.col("c_custkey").cast("string"), F.lit(".0"))).alias("clean_id"))


@query("X05_dms_and_points", """
SELECT station_id, lat, lon,
       CAST(floor(abs(lat)) AS BIGINT) || '°' || CAST(floor((abs(lat) - floor(abs(lat))) * 60) AS BIGINT) || '''' ||
       CASE WHEN ((abs(lat) - floor(abs(lat))) * 60) % 1 = 0 THEN '0.0' ELSE '30.0' END || '"' ||
       CASE WHEN lat >= 0 THEN 'N' ELSE 'S' END AS lat_dms
FROM {station}""")
def _(t):
    lat = geo.decimal_to_dms(F.col("lat"), "N", "S")
    lon = geo.decimal_to_dms(F.col("lon"), "E", "W")
    written = t.station.select("station_id", lat.alias("lat_dms"), F.when(
        F.col("station_id") % 2 == 0, F.concat_ws(" ", lat, lon)).otherwise(
        F.concat_ws(", ", F.col("lat").cast("string"), F.col("lon").cast("string"))).alias("place"))
    p = geo.point_from_text(F.col("place"))
    return written.select("station_id", p["lat"].alias("lat"), p["lon"].alias("lon"), "lat_dms")


_BITS = lambda v, lo, span: f"CAST(floor(({v} - ({lo})) / {span} * 1048576) AS BIGINT)"


def _hash_sql(lon: str, lat: str) -> str:
    """Geohash by reading 5 alternating bits per letter (even letters start on longitude)."""
    x, y = _BITS(lon, -180, 360), _BITS(lat, -90, 180)
    letters = []
    for i in range(8):
        bits = []
        for k in range(5):
            b = 5 * i + k
            src, pos = (x, 19 - b // 2) if b % 2 == 0 else (y, 19 - b // 2)
            bits.append(f"((({src}) >> {pos}) & 1) * {1 << (4 - k)}")
        letters.append(f"substr('0123456789bcdefghjkmnpqrstuvwxyz', CAST({' + '.join(bits)} AS INT) + 1, 1)")
    return " || ".join(letters)


@query("X06_geohash", f"SELECT grid_id, {_hash_sql('lon', 'lat')} AS geohash FROM {{grid}}")
def _(t):
    return t.grid.select("grid_id", geo.geohash(F.round("lon", 8), F.round("lat", 8)).alias("geohash"))


@query("X07_centroid", "SELECT grid_id, lon0 + 0.25 AS x, lat0 + 0.25 AS y, lon0 AS px FROM {grid}")
def _(t):
    area = geo.rectangle(F.col("lon0"), F.col("lat0"), F.col("lon0") + 0.5, F.col("lat0") + 0.5)
    c = geo.centroid(F.element_at(area, 1))
    return t.grid.select("grid_id", c["lon"].alias("x"), c["lat"].alias("y"),
                         geo.point(F.col("lon0"), F.col("lat0"))["lon"].alias("px"))


_HAV = """2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians({b}.lat - {a}.lat) / 2), 2)
 + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))))"""


@query("X08_great_circle", f"""
SELECT f.farm_id, round({_HAV.replace('{a}', 'f').replace('{b}', 'g')} / 1000, 3) AS km
FROM {{farm}} f JOIN {{grid}} g ON f.grid_id = g.grid_id""")
def _(t):
    g = t.grid.select("grid_id", F.col("lon").alias("glon"), F.col("lat").alias("glat"))
    return t.farm.join(g, "grid_id").select("farm_id", F.round(geo.haversine_m(
        F.col("lon"), F.col("lat"), F.col("glon"), F.col("glat")) / 1000, 3).alias("km"))


@query("X09_tiles", """
WITH m AS (SELECT grid_id, CAST(trunc(radians(lon0) * 6378137.0) AS BIGINT) AS x0,
             CAST(trunc(radians(lon0 + 0.5) * 6378137.0) AS BIGINT) AS x1,
             CAST(trunc(ln(tan(pi() / 4 + radians(lat0) / 2)) * 6378137.0) AS BIGINT) AS y0,
             CAST(trunc(ln(tan(pi() / 4 + radians(lat0 + 0.5) / 2)) * 6378137.0) AS BIGINT) AS y1 FROM {grid})
SELECT grid_id, x0 + i * 20000 AS tile_x0, y0 + j * 20000 AS tile_y0,
       least(x0 + i * 20000 + 20000, x1) AS tile_x1, least(y0 + j * 20000 + 20000, y1) AS tile_y1
FROM m, range(0, 10) a(i), range(0, 10) b(j)
WHERE x0 + i * 20000 < x1 AND y0 + j * 20000 < y1""")
def _(t):
    area = geo.rectangle(F.col("lon0"), F.col("lat0"), F.col("lon0") + 0.5, F.col("lat0") + 0.5)
    out = spatial.tiles(t.grid.select("grid_id", area.alias("area")), "area", 20000)
    return out.select("grid_id", "tile_x0", "tile_y0", "tile_x1", "tile_y1")


@query("X10_round_digits", """
SELECT grid_id, CAST(floor(lon * 4) AS DOUBLE) / 4 AS kept, round(elevation / 8.0, 1) AS r1, round(elevation / 8.0, 2) AS r2 FROM {grid}""")
def _(t):
    e = F.col("elevation") / 8
    return t.grid.select("grid_id", numeric.round_digits(F.floor(F.col("lon") * 4) / 4, -1).alias("kept"),
                         numeric.round_digits(e, 1).alias("r1"), numeric.round_digits(e, 2).alias("r2"))


@query("X11_split_periods", """
WITH r AS (SELECT registry_id, planting_date AS s, planting_date + CAST(registry_id % 500 AS INT) AS e FROM {registry}),
p AS (SELECT registry_id, s, e, CAST(unnest(generate_series(date_trunc('month', s), CAST(e AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS m FROM r)
SELECT registry_id, greatest(m, s) AS part_start, least(last_day(m), e) AS part_end,
       CAST(year(m) AS INT) AS year, CAST(month(m) AS INT) AS month FROM p""")
def _(t):
    r = t.registry.select("registry_id", F.col("planting_date").alias("s"), F.date_add(
        "planting_date", (F.col("registry_id") % 500).cast("int")).alias("e"))
    return dates.split_by_period(r, "s", "e", "month").drop("s", "e")


@query("X11_split_years", """
WITH r AS (SELECT registry_id, planting_date AS s, planting_date + CAST(registry_id % 900 AS INT) AS e FROM {registry}),
p AS (SELECT registry_id, s, e, unnest(generate_series(year(s), year(e))) AS y FROM r)
SELECT registry_id, greatest(make_date(y, 1, 1), s) AS part_start, least(make_date(y, 12, 31), e) AS part_end,
       CAST(y AS INT) AS year FROM p""")
def _(t):
    r = t.registry.select("registry_id", F.col("planting_date").alias("s"), F.date_add(
        "planting_date", (F.col("registry_id") % 900).cast("int")).alias("e"))
    return dates.split_by_period(r, "s", "e", "year").drop("s", "e")


@query("X12_leap_year_and_weekday", """
SELECT o_orderkey, CAST((SELECT max(y) FROM range(1880, 2020) r(y) WHERE y <= 1890 + o_orderkey % 120
       AND y % 4 = 0 AND (y % 100 <> 0 OR y % 400 = 0)) AS INT) AS leap,
       CAST(o_orderdate AS DATE) - CAST((isodow(o_orderdate) - 1 - o_orderkey % 7 + 6) % 7 + 1 AS INT) AS before
FROM orders""")
def _(t):
    d = F.to_date("o_orderdate")
    return t.orders.select(
        "o_orderkey", dates.closest_leap_year((F.col("o_orderkey") % 120 + 1890).cast("int")).alias("leap"),
        dates.previous_weekday(d, (F.col("o_orderkey") % 7).cast("int")).alias("before"))


@query("X13_month_labels", """
SELECT o_orderkey, strftime(o_orderdate, '%m-%d') AS month_day, monthname(o_orderdate) AS month_name,
       monthname(o_orderdate - INTERVAL 1 MONTH) AS previous_month FROM orders""")
def _(t):
    d = F.to_date("o_orderdate")
    return t.orders.select("o_orderkey", dates.month_day(d).alias("month_day"), dates.month_name(d).alias("month_name"),
                           dates.previous_month_name(d).alias("previous_month"))


@query("X14_mixed_dates", """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS DATE)
       ELSE CAST(o_orderdate AS DATE) + INTERVAL 20 YEAR END::DATE AS day FROM orders""")
def _(t):
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    # two-digit years belong to 2000..2099; the sheet dates are twenty years on
    us = F.date_format(F.add_months(F.to_date("o_orderdate"), 240), "M/d/yy")
    txt = F.when(F.col("o_orderkey") % 5 == 0, "unknown").when(F.col("o_orderkey") % 2 == 0, iso).otherwise(us)
    return t.orders.select("o_orderkey", dates.parse_mixed_date(txt).alias("day"))


@query("X15_time_from_name", """
SELECT file_id, 1754434800 + file_id * CASE WHEN file_id % 2 = 0 THEN 1 ELSE 3600 END AS target_epoch,
       CAST(version AS DATE) AS file_date, 'var' || (file_id % 4) AS variable, CAST(year(version) AS INT) AS year
FROM {source_file}""")
def _(t):
    raster = F.concat(F.when(F.col("file_id") % 2 == 0, "nowcast_").otherwise("graphcast_"),
                      F.lit("1754434800_"), F.col("file_id").cast("string"), F.lit(".tif"))
    v = dates.variable_year_from_name(F.col("name"))
    return t.source_file.select("file_id", dates.target_time_from_name(raster).alias("target_epoch"),
                                dates.date_from_name(F.col("daily_name")).alias("file_date"),
                                v["variable"].alias("variable"), v["year"].alias("year"))


@query("X16_clip", """
SELECT grid_id, date, CASE WHEN max_temperature > 30 THEN 30.0 ELSE max_temperature END::DOUBLE AS capped,
       CASE WHEN min_temperature < 8 THEN 8.0 ELSE min_temperature END::DOUBLE AS floored FROM {weather}""")
def _(t):
    return t.weather.select("grid_id", "date", numeric.clip_above(F.col("max_temperature"), F.lit(30.0)).alias("capped"),
                            numeric.clip_below(F.col("min_temperature"), F.lit(8.0)).alias("floored"))


@query("X17_rule_value", """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 0.0 WHEN 2 THEN 999999.0 ELSE o_orderkey / 8 END::DOUBLE AS v FROM orders""")
def _(t):
    k = F.col("o_orderkey")
    raw = (F.when(k % 4 == 0, F.lit(float("nan"))).when(k % 4 == 1, F.lit(None).cast("double"))
           .when(k % 4 == 2, F.lit(float("inf"))).otherwise(k / 8))
    return t.orders.select("o_orderkey", numeric.rule_value(raw).alias("v"))


@query("X18_json_build_and_read", """
SELECT registry_id, '[' || COALESCE(CAST(message AS VARCHAR), 'null') || ',' || COALESCE(CAST(message_2 AS VARCHAR), 'null') || ']' AS messages,
       CAST(p_pet AS VARCHAR) AS ppet FROM {advisory_hist}""")
def _(t):
    from furrow.sinks.documents import json_array, json_object
    doc = json_object(ppet=F.col("p_pet").cast("string"), crop=F.col("crop"))
    return t.advisory_hist.select("registry_id", json_array(F.col("message"), F.col("message_2")).alias("messages"),
                                  F.get_json_object(doc, "$.ppet").alias("ppet"))


@query("X19_crop_name_lookup", """
SELECT p_partkey, CASE WHEN contains(lower(p_name), 'red') THEN 10.0 WHEN contains(lower(p_name), 'ring') THEN 8.0 END::DOUBLE AS gdd_base,
       CASE WHEN contains(lower(p_name), 'red') THEN 35.0 WHEN contains(lower(p_name), 'ring') THEN 30.0 END::DOUBLE AS gdd_cap FROM part""")
def _(t):
    lookup = t.spark.createDataFrame([(1, "red", 10.0, 35.0), (2, "ring", 8.0, 30.0)],
                                     "order int, key string, base double, cap double")
    return agronomy.crop_parameters(t.part.select("p_partkey", F.col("p_name").alias("crop")), lookup).select(
        "p_partkey", "gdd_base", "gdd_cap")


@query("X20_request_fingerprint", """
SELECT query_params AS p, count(*) AS requests FROM {request_log} GROUP BY 1""")
def _(t):
    from furrow.plans.catalog import request_fingerprint
    log = t.request_log.select("query_params", F.get_json_object("query_params", "$.product").alias("product"),
                               F.get_json_object("query_params", "$.attributes").alias("attributes"),
                               F.get_json_object("query_params", "$.output_type").alias("output_type"),
                               F.get_json_object("query_params", "$.start_date").alias("start_date"))
    # equal parameters share a fingerprint, different ones do not
    return (log.withColumn("h", request_fingerprint(log)).groupBy("h").agg(
        F.min("query_params").alias("p"), F.count("*").alias("requests")).select("p", "requests"))


@query("X21_fill_template", """
SELECT c_custkey, 'Dear ' || c_name || ', call 555 in ' || c_mktsegment || '!' AS body FROM customer""")
def _(t):
    template = F.lit("Dear {{ name }}, call {{phone}} in {{ place}}!{{ missing }}")
    return t.customer.select("c_custkey", text.fill_template(template, {
        "name": F.col("c_name"), "phone": F.lit(555), "place": F.col("c_mktsegment"),
        "missing": F.lit(None).cast("string")}).alias("body"))


@query("X22_wkt", """
SELECT grid_id, 5 AS vertices, lon0 AS first_lon, lat0 + 0.5 AS top, 'POLYGON' AS kind, lon AS point_lon FROM {grid}""")
def _(t):
    n = lambda c: c.cast("string")
    x0, y0, x1, y1 = F.col("lon0"), F.col("lat0"), F.col("lon0") + 0.5, F.col("lat0") + 0.5
    corners = [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
    body = F.concat_ws(", ", *[F.concat_ws(" ", n(x), n(y)) for x, y in corners])
    wkt = F.concat(F.lit("POLYGON (("), body, F.lit("))"))
    area = geo.rings_from_wkt(F.col("wkt"))
    return t.grid.withColumn("wkt", wkt).withColumn("area", area).select(
        "grid_id", F.size(F.element_at("area", 1)).alias("vertices"),
        F.element_at(F.element_at("area", 1), 1)["lon"].alias("first_lon"),
        geo.envelope(F.col("area"))["max_lat"].alias("top"), geo.wkt_kind(F.col("wkt")).alias("kind"),
        F.element_at(geo.points_from_wkt(geo.point_wkt(F.col("lon"), F.col("lat"))), 1)["lon"].alias("point_lon"))


@query("X23_rain_class", """
SELECT grid_id, date, CASE WHEN total_rainfall / 4 <= 0.5 THEN 'No Rain' WHEN total_rainfall / 4 <= 3 THEN 'Minimal rain'
       WHEN total_rainfall / 4 <= 10 THEN 'Light rain' WHEN total_rainfall / 4 <= 20 THEN 'Moderate rain' ELSE 'Heavy rain' END AS by_rule,
       CASE WHEN total_rainfall / 4 <= 0.5 THEN 1 WHEN total_rainfall / 4 <= 3 THEN 2 WHEN total_rainfall / 4 <= 10 THEN 3
            WHEN total_rainfall / 4 <= 20 THEN 4 ELSE 5 END AS by_table FROM {weather}""")
def _(t):
    rows = [(i, n, lo, hi) for i, n, lo, hi in cropplan.RAIN_CLASSES]
    classes = t.spark.createDataFrame(rows, "class_id int, name string, min_value double, max_value double")
    w = t.weather.withColumn("amount", F.col("total_rainfall") / 4)
    return cropplan.classify(w, classes, "amount").select(
        "grid_id", "date", cropplan.rain_class(F.col("amount")).alias("by_rule"), F.col("class_id").alias("by_table"))


@query("X24_axis", """
SELECT country_id, CAST(i AS INT) AS axis_idx, lon0 + i * 0.25 AS lon FROM {country}, range(0, 32) r(i)""")
def _(t):
    c = t.country.select("country_id", "lon0", (F.col("lon0") + 8).alias("hi"), F.lit(0.25).alias("step"))
    return spatial.make_axis(c, "lon0", "hi", "step", "lon").select("country_id", "axis_idx", "lon")


@query("X25_kelvin", "SELECT grid_id, date, round(max_temperature + 273.15 - 273.15, 6) AS celsius FROM {weather}")
def _(t):
    return t.weather.select("grid_id", "date", F.round(numeric.kelvin_to_celsius(
        F.col("max_temperature") + 273.15), 6).alias("celsius"))


@query("X26_attribute_list", """
SELECT request_id, 'temp' AS first, 'rain_' || (request_id % 5) AS second, 2 AS n FROM {request_log}""")
def _(t):
    a = text.attribute_list(F.get_json_object("query_params", "$.attributes"))
    return t.request_log.select("request_id", F.get(a, 0).alias("first"), F.get(a, 1).alias("second"), F.size(a).alias("n"))


_Z = "((pfc_ecmwf_mean - 50) / pfc_ecmwf_std)"


@query("X28_exceedance", f"""
SELECT grid_id, round(CASE WHEN {_Z} >= 6 THEN 1.0 WHEN {_Z} <= -6 THEN 0.0 ELSE 0.5 + 0.3989422804014327 * (SELECT sum(
   {_Z} * pow({_Z}, 2 * k) * CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END / (pow(2, k) * gamma(k + 1) * (2 * k + 1))) FROM range(0, 70) r(k)) END, 5) AS p,
   CASE WHEN {_Z} > 0.8416212335729143 THEN 1 ELSE 0 END AS above FROM {{cells}}""")
def _(t):
    args = (F.col("pfc_ecmwf_mean"), F.col("pfc_ecmwf_std"), F.lit(50.0))
    return t.cells.select("grid_id", F.round(numeric.upper_tail(*args), 5).alias("p"),
                          numeric.exceeds_with(*args, 0.8).cast("int").alias("above"))


@query("X29_hour_text", """
SELECT date, hour, lat, lon, printf('%02d:00:00', hour) AS label, date + to_hours(hour) AS at FROM {reanalysis_hourly}""")
def _(t):
    return t.reanalysis_hourly.select("date", "hour", "lat", "lon", dates.hour_label(F.col("hour")).alias("label"),
                                      dates.at_hour(F.col("date"), F.col("hour")).alias("at"))


@query("X30_plant_text", """
SELECT grid_id, CASE WHEN spw_20 = 1 THEN 'Plant' ELSE 'Do Not Plant' END AS plant,
       CASE WHEN grid_id % 3 = 0 THEN 'Custom' WHEN spw_40 = 1 THEN 'Plant Now' ELSE 'DO NOT PLANT' END AS top FROM {cells}""")
def _(t):
    custom = F.when(F.col("grid_id") % 3 == 0, "Custom").when(F.col("grid_id") % 3 == 1, "")
    return t.cells.select("grid_id", text.plant_label(F.col("spw_20")).alias("plant"),
                          text.top_message(custom, F.col("spw_40") == 1).alias("top"))


@query("X32_log_fields", """
SELECT request_id, json_extract_string(query_params, '$.product') AS product,
       json_extract_string(query_params, '$.attributes') AS attributes,
       json_extract_string(query_params, '$.output_type') AS output_type,
       json_extract_string(query_params, '$.start_date') AS start_date, '' AS end_date FROM {request_log}""")
def _(t):
    from furrow.plans import usage
    return usage.export(t.request_log.select("request_id", "query_params"))


@query("X33_required_columns", "SELECT c_custkey, coalesce(c_name, c_mktsegment) AS crop FROM customer")
def _(t):
    c = check_columns(t.customer, ["c_custkey", "c_name"])
    return c.select("c_custkey", first_present(c, ["crop_name", "c_name", "c_mktsegment"]).alias("crop"))


@query("X34_cell_locations", """
SELECT a.lat, b.lon FROM (SELECT DISTINCT lat FROM {forecast}) a CROSS JOIN (SELECT DISTINCT lon FROM {forecast}) b""")
def _(t):
    return spatial.cell_locations(t.forecast)


@query("X35_local_labels", """
SELECT request_id, strftime(requested_at + INTERVAL 3 HOUR, '%A-%d-%m-%Y') AS title,
       strftime(requested_at + INTERVAL 3 HOUR, '%H:%M') AS at FROM {request_log}""")
def _(t):
    ts = F.col("requested_at").cast("timestamp")
    return t.request_log.select("request_id", dates.report_title(ts, "Africa/Nairobi").alias("title"),
                                F.date_format(dates.local_time(ts, "Africa/Nairobi"), "HH:mm").alias("at"))


@query("X36_type_label", """
SELECT no, CASE no % 3 WHEN 0 THEN 'Near Real Time' WHEN 1 THEN 'Climatological' END AS label FROM {pest_sheet}""")
def _(t):
    from furrow.plans.pests import ALLOWED_TYPES
    return t.pest_sheet.select("no", text.clean_label(F.col("raw_type"), ALLOWED_TYPES).alias("label"))


@query("X37_unwrap", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS v FROM orders")
def _(t):
    lst = F.when(F.col("o_orderkey") % 2 == 0, F.array("o_orderstatus")).otherwise(F.array("o_orderstatus", "o_orderpriority"))
    return t.orders.select("o_orderkey", text.unwrap_single(lst).alias("v"))


@query("X38_mask_key", """
SELECT c_custkey, 'GET /v4?apikey=' || repeat('*', length(c_name)) || '&units=metric' AS masked FROM customer""")
def _(t):
    return t.customer.select("c_custkey", text.mask_keys(F.concat(
        F.lit("GET /v4?apikey="), "c_name", F.lit("&units=metric"))).alias("masked"))
