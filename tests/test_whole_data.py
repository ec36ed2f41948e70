"""Loads that used to lose rows or columns."""

import datetime as dt

from furrow import session
from furrow.plans import cropplan
from furrow.sinks import tables
from furrow.sources import landed
from furrow.streaming import jobs


def observations(spark, rows, extra=""):
    return spark.createDataFrame(rows, f"station_id long, date_time timestamp_ntz, lon double, lat double, year int{extra}")


def test_second_append_keeps_a_column_of_the_first(spark, tmp_path):
    import datetime as dt
    t, path = dt.datetime(2024, 1, 1), str(tmp_path / "obs")
    tables.write_observations(observations(spark, [(1, t, 1.0, 1.0, 2024)]), path)
    tables.append_observations(spark, observations(spark, [(2, t, 1.0, 1.0, 2024, 7.5)], ", rain double"), path)
    tables.append_observations(spark, observations(spark, [(3, t, 1.0, 1.0, 2024), (3, t, 1.0, 1.0, 2024)]), path)
    got = {r.station_id: r.rain for r in spark.read.option("mergeSchema", True).parquet(path).collect()}
    assert got == {1: None, 2: 7.5, 3: None}


def test_regions_of_one_forecast_date(spark, tmp_path):
    path = str(tmp_path / "cube")
    cell = lambda lat, rain: spark.sql(f"SELECT DATE'2024-01-01' AS forecast_date, {lat}D AS lat, 1D AS lon, {rain}D AS rain")
    for lat, rain in ((1, 1), (2, 5), (1, 3)):
        tables.merge_partition(cell(lat, rain), path, ["lat", "lon"])
    assert {(r.lat, r.rain) for r in spark.read.parquet(path).collect()} == {(1.0, 3.0), (2.0, 5.0)}


def test_raster_slice_over_two_batches(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "raster")
    src.mkdir()
    schema = "file_name string, lat double, lon double, band string, value double"
    for k, (lat, band) in enumerate(((1.0, "A"), (2.0, "A"), (1.0, "B"))):
        (src / f"{k}.json").write_text(
            f'{{"file_name": "nowcast_946684800_900.tif", "lat": {lat}, "lon": 1.0, "band": "{band}", "value": {k + 1}}}\n')
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))
    jobs.ingest_rasters(stream, {"A": "a", "B": "b"}, -9999.0, out)
    got = {(r.lat, r.a, r.b) for r in spark.read.option("mergeSchema", True).parquet(out).collect()}
    assert got == {(1.0, 1.0, 3.0), (2.0, 2.0, None)}


def test_two_runs_into_one_target(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    schema = "station_id long, attribute string, date_time timestamp, value double"
    for k in range(2):
        (src / f"{k}.json").write_text(
            f'{{"station_id": {k}, "attribute": "rain", "date_time": "2024-01-0{k + 1}T00:00:00", "value": 1.0}}\n')
        jobs.ingest_observations(spark.readStream.schema(schema).json(str(src)), out)
    assert {r.station_id for r in spark.read.parquet(out).collect()} == {0, 1}


def test_late_observations_are_kept_once(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    schema = "station_id long, attribute string, date_time timestamp, value double"
    days = ["2024-06-01", "2024-01-05", "2024-06-01", "2023-03-04", "2024-01-05"]
    for k, day in enumerate(days):
        (src / f"{k}.json").write_text(
            f'{{"station_id": 1, "attribute": "rain", "date_time": "{day}T00:00:00", "value": {k}.0}}\n')
        jobs.ingest_observations(spark.readStream.schema(schema).json(str(src)), out)
    got = [(str(r.date_time.date()), r.value) for r in spark.read.parquet(out).collect()]
    assert sorted(got) == [("2023-03-04", 3.0), ("2024-01-05", 1.0), ("2024-06-01", 0.0)]


def test_station_files_of_any_name(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "My_Station_list.csv").write_text("code,name\ns77,one\n")
    (tmp_path / "s77_2024.csv").write_text("Timestamp,rain\n2024-01-01,1.5\n2023-01-01,9\n")
    (tmp_path / "deep" / "t1.CSV").write_text("temp,date\n4,2024-02-01\n")
    stations, rows = landed.station_directory(spark, str(tmp_path), ["rain", "temp"], "2024-01-01")
    assert [r.code for r in stations.collect()] == ["s77"]
    assert {(r.station_code, r.attribute, r.value) for r in rows.collect()} == {("s77", "rain", 1.5), ("t1", "temp", 4.0)}


def test_scratch_folder_needs_one_disk():
    assert session.is_local("local[8]") and session.is_local("local")
    assert not any(map(session.is_local, ("local-cluster[3,2,1000]", "yarn", "spark://host:7077")))


def test_plan_keeps_every_message_and_day(spark):
    messages = spark.createDataFrame([("f", 1, k, f"m{k}") for k in range(1, 8)] + [("g", 9, 1, "unknown pest")],
                                     "farm_id string, pest_id int, message_no int, message string")
    got = {r.farm_id: r for r in cropplan.pest_wide(messages, {1: "beetle"}).collect()}
    assert got["f"].pest_messages == {f"pest_beetle_{k}": f"m{k}" for k in range(1, 8)}
    assert got["f"].pest_beetle_5 == "m5" and got["g"].pest_messages == {}
    first = dt.date(2024, 1, 1)
    forecast = spark.createDataFrame([("f", first + dt.timedelta(k), "rainAccumulationSum", float(k)) for k in range(16)],
                                     "farm_id string, value_date date, field string, value double")
    row = cropplan.forecast_wide(forecast, ["rainAccumulationSum"]).first()
    assert row.forecast_values == {f"day{k + 1}_rainAccumulationSum": float(k) for k in range(16)}
    assert row.forecast_classes["day16_rainAccumulationType"] == "Moderate rain" and row.day13_rainAccumulationSum == 12.0
