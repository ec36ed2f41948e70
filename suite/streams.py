"""M: streaming jobs, run on what is there and read back."""

from pyspark.sql import functions as F

from furrow.plans import ingest, usage
from furrow.session import scratch_dir
from furrow.sinks.tables import MAX_RECORDS
from furrow.streaming import jobs, limiter, marks
from suite.base import query


def stream_of(t, df, label, per_trigger=2):
    """A landed copy of a table as a file stream, some files per micro-batch.

    Files are large, as each batch costs time of its own and reads what earlier ones stored.
    """
    path = scratch_dir(t.spark, label)
    df.write.option("maxRecordsPerFile", MAX_RECORDS).parquet(path)
    return jobs.file_stream(t.spark, path, df.schema, files_per_trigger=per_trigger)


LIMITS = {1: 2, 60: 3, 1440: 30}


@query("M01_sliding_counts", """
SELECT a.user_id, a.m AS minute_start, CAST(sum(b.n) AS BIGINT) AS requests FROM (SELECT DISTINCT user_id, date_trunc('minute', ts) AS m FROM events) a
JOIN (SELECT user_id, date_trunc('minute', ts) AS m, count(*) AS n FROM events GROUP BY 1, 2) b ON a.user_id = b.user_id AND b.m <= a.m AND b.m > a.m - INTERVAL 60 MINUTE GROUP BY 1, 2""")
def _(t):
    return usage.sliding_counts(t.request_log, 60)


# walks each user's active minutes in order with what was admitted before
ADMITTED = """
WITH RECURSIVE active AS (
  SELECT user_id, CAST(floor(epoch(requested_at) / 60) AS BIGINT) AS minute, count(*) AS requests
  FROM {request_log} GROUP BY 1, 2),
numbered AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY minute) AS k FROM active),
walk AS (
  SELECT user_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS minute, CAST(0 AS BIGINT) AS requests,
         CAST(0 AS BIGINT) AS allowed, CAST([] AS STRUCT(m BIGINT, n BIGINT)[]) AS earlier FROM active GROUP BY 1
  UNION ALL
  SELECT user_id, k, minute, requests, allowed, list_append(earlier, {'m': minute, 'n': allowed})
  FROM (SELECT x.user_id, x.k, x.minute, x.requests, w.earlier, CAST(greatest(0, least(x.requests,
          2 - coalesce(list_sum(list_transform(list_filter(w.earlier, lambda e: e.m > x.minute - 1), lambda e: e.n)), 0),
          3 - coalesce(list_sum(list_transform(list_filter(w.earlier, lambda e: e.m // 60 > x.minute // 60 - 1), lambda e: e.n)), 0),
          30 - coalesce(list_sum(list_transform(list_filter(w.earlier, lambda e: e.m // 60 > x.minute // 60 - 24), lambda e: e.n)), 0)
        )) AS BIGINT) AS allowed
        FROM walk w JOIN numbered x ON x.user_id = w.user_id AND x.k = w.k + 1))
SELECT user_id, minute, requests, allowed, requests - allowed AS rejected FROM walk WHERE k > 0"""


@query("M01_request_limits", ADMITTED)
def _(t):
    return limiter.limit_batch(t.request_log, LIMITS)


@query("M01_request_limits_stream", ADMITTED)
def _(t):
    log = t.request_log.select("user_id", F.col("requested_at").cast("timestamp").alias("requested_at"))
    # files hold the requests of all times: later batches bring earlier minutes
    stream = stream_of(t, log.repartition(6, F.xxhash64("requested_at")), "requests")
    out = scratch_dir(t.spark, "limits")
    q = (limiter.limit_stream(stream, LIMITS).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", scratch_dir(t.spark, "cp")).trigger(availableNow=True).start())
    q.awaitTermination()
    return limiter.latest_decisions(t.spark.read.parquet(out))


@query("M02_waiting_time", """
SELECT request_id, CASE request_id % 4 WHEN 0 THEN 60 - epoch % 60 WHEN 1 THEN 3600 - epoch % 3600 WHEN 2 THEN 86400 - epoch % 86400 END AS seconds
FROM (SELECT request_id, CAST(floor(epoch(requested_at)) AS BIGINT) AS epoch FROM {request_log})""")
def _(t):
    k = F.col("request_id") % 4
    empty = F.array().cast("array<int>")
    exceeded = F.when(k == 0, F.array(F.lit(1))).when(k == 1, F.array(F.lit(1), F.lit(60))).when(k == 2, F.array(F.lit(60), F.lit(1440))).otherwise(empty)
    return t.request_log.select("request_id", usage.waiting_seconds(F.unix_seconds(F.col("requested_at").cast("timestamp")), exceeded).alias("seconds"))


@query("M03_log_ingest", """
SELECT request_id, 'U' || (user_id % 100) AS user_name, 'rain_' || (request_id % 5) AS second FROM {request_log}""")
def _(t):
    users = t.station.select(F.col("station_id").alias("user_id"), F.concat(F.lit("U"), (F.col("station_id") % 100).cast("string")).alias("user_name"))
    out = scratch_dir(t.spark, "log")
    jobs.ingest_request_log(stream_of(t, t.request_log.repartition(6, "request_id"), "requests"), users, out)
    return t.spark.read.parquet(out).select("request_id", "user_name", F.get("attributes", 1).alias("second"))


_KEYED = "SELECT station_id, attribute, date_time, min(value) AS value FROM {measurement} GROUP BY 1, 2, 3"


def keyed(t):
    """One value a (station, attribute, time)."""
    return t.measurement.groupBy("station_id", "attribute", "date_time").agg(F.min("value").alias("value"))


@query("M04_observation_ingest", _KEYED)
def _(t):
    m = keyed(t)
    out = scratch_dir(t.spark, "obs")
    # files hold the observations of all times: later batches bring earlier days
    both = m.unionByName(m).repartition(6, F.xxhash64("date_time"))
    jobs.ingest_observations(stream_of(t, both, "observations"), out)
    jobs.compact_days(t.spark, out, "2100-01-01")
    return t.spark.read.parquet(out).select("station_id", "attribute", "date_time", "value")


_LATE = "TIMESTAMP '2024-01-12 00:00:00'"


@query("M04_observation_marks", f"""
SELECT m.station_id, m.attribute, m.date_time, m.value, m.date_time > {_LATE} AS second_run FROM ({_KEYED}) m
LEFT JOIN (SELECT station_id, attribute, max(date_time) AS mark FROM {{measurement}} WHERE date_time <= {_LATE} GROUP BY 1, 2) k
  ON m.station_id = k.station_id AND m.attribute = k.attribute
WHERE m.date_time <= {_LATE} OR m.date_time >= coalesce(k.mark, TIMESTAMP '2023-01-31 00:00:00')""")
def _(t):
    """Two runs over growing input, each from the marks of (station, attribute) it finds."""
    out, source = scratch_dir(t.spark, "obs"), keyed(t)
    for now in ("2024-01-12 00:00:00", "2024-01-31 00:00:00"):
        marks.ingest_since(source, out, now, ["station_id", "attribute"])
    return t.spark.read.parquet(out).select("station_id", "attribute", "date_time", "value",
                                            (F.col("batch_id") == 2).alias("second_run"))


@query("M04_mission_cursor", """
SELECT DISTINCT station_id AS mission_id, date_time, history_id, lat FROM {track}""")
def _(t):
    """Balloon positions from a cursor per mission, in three runs."""
    out = scratch_dir(t.spark, "missions")
    track = t.track.select(F.col("station_id").alias("mission_id"), "date_time", "history_id", "lat")
    for now in ("2024-01-05 00:00:00", "2024-01-20 00:00:00", "2024-01-31 00:00:00"):
        marks.ingest_since(track, out, now, ["mission_id"], row_keys=["mission_id", "date_time"])
    return t.spark.read.parquet(out).select("mission_id", "date_time", "history_id", "lat")


@query("M05_forecast_ingest", """
SELECT DATE '1998-06-25' AS forecast_date, CAST(w.date - DATE '1998-06-25' AS INT) AS forecast_day_idx, g.lat, g.lon, w.max_temperature, CAST(NULL AS DOUBLE) AS wind FROM {weather} w JOIN {grid} g ON w.grid_id = g.grid_id
WHERE w.date >= DATE '1998-06-25' AND w.date < DATE '1998-07-14'""")
def _(t):
    landed, cube = scratch_dir(t.spark, "landed"), scratch_dir(t.spark, "cube")
    stream = stream_of(t, t.weather.select("grid_id", "date", "max_temperature").repartition(6, "grid_id"), "forecast")
    jobs.ingest_forecast(stream, t.grid.select("grid_id", "lat", "lon"), ["max_temperature", "wind"], landed, "1998-06-25", "1998-07-14",
                         "1998-06-25", (20.25, -27.75, 0.5), 0.1)
    jobs.compact_forecast(t.spark, landed, cube, ["max_temperature", "wind"])
    if jobs.compact_forecast(t.spark, landed, cube, ["max_temperature", "wind"]):
        raise ValueError("a second compaction had batches to read")
    return t.spark.read.parquet(cube).select("forecast_date", "forecast_day_idx", "lat", "lon", "max_temperature", "wind")


@query("M06_raster_arrival", """
SELECT TIMESTAMP '1970-01-01' + to_seconds(CAST(946684800 + floor(o_orderkey / 1000) * 900 AS BIGINT)) AS time, count(*) AS pixels, CAST(sum(o_orderkey % 100) AS DOUBLE) AS total FROM orders GROUP BY 1""")
def _(t):
    k = F.col("o_orderkey")
    px = t.orders.select(F.concat(F.lit("nowcast_946684800_"), (F.floor(k / 1000) * 900).cast("string"), F.lit(".tif")).alias("file_name"),
                         (k % 1000).cast("double").alias("lat"), F.lit(1.0).alias("lon"), F.lit("Rate").alias("band"), (k % 100).cast("double").alias("value"))
    path, out = scratch_dir(t.spark, "pixels"), scratch_dir(t.spark, "raster")
    # one file holds whole time slices, as rasters arrive
    px.repartitionByRange("file_name").write.parquet(path)
    stream = jobs.file_stream(t.spark, path, px.schema, files_per_trigger=2)
    jobs.ingest_rasters(stream, {"Rate": "rate"}, -9999.0, out)
    return t.spark.read.parquet(out).groupBy(F.col("time").cast("timestamp_ntz").alias("time")).agg(F.count("*").alias("pixels"), F.sum("rate").alias("total"))
