"""Limits, file sources, measurement requests, plans with brute-force checks."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from furrow.plans import catalog, cubes, ingest, pests, planting, registry, usage
from furrow.plans.observations import Location
from furrow.operators.skew import dense_ids, latest_by, salted_join
from furrow.sources import landed
from furrow.streaming import limiter


def by_request(events, limits):
    """One request at a time, as a live limiter sees them."""
    counts, out = {}, []
    for minute in events:
        ok = True
        for length, limit in limits.items():
            if length < 60:
                used = sum(counts.get(minute - i, 0) for i in range(length))
            else:
                used = sum(c for m, c in counts.items() if minute // 60 - m // 60 < length // 60)
            ok = ok and used < limit
        if ok:
            counts[minute] = counts.get(minute, 0) + 1
        out.append((minute, ok))
    return out


LIMITS = {1: 3, 5: 8, 60: 20, 1440: 120}


def test_limits_batch_equals_one_by_one(spark):
    rnd = random.Random(11)
    rows, want = [], {}
    for user in range(4):
        t0 = dt.datetime(2024, 1, 1)
        times = sorted(t0 + dt.timedelta(seconds=rnd.randrange(3 * 86400 if user else 7200)) for _ in range(400))
        rows += [(user, t) for t in times]
        minutes = [int((t - dt.datetime(1970, 1, 1)).total_seconds()) // 60 for t in times]
        for m, ok in by_request(minutes, LIMITS):
            n, a = want.get((user, m), (0, 0))
            want[user, m] = (n + 1, a + ok)
    log = spark.createDataFrame(rows, "user_id long, requested_at timestamp_ntz")
    got = {(r.user_id, r.minute): (r.requests, r.allowed) for r in limiter.limit_batch(log, LIMITS).collect()}
    assert got == want and any(n > a for n, a in got.values())


def test_limits_stream_equals_batch(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rnd.randrange(86400)), rnd.randrange(3)) for _ in range(900)]
    log = spark.createDataFrame([(u, t) for t, u in rows], "user_id long, requested_at timestamp")
    n = 3
    for i in range(n):
        part = spark.createDataFrame([(u, t) for t, u in rows[i * 300:(i + 1) * 300]], "user_id long, requested_at timestamp")
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = (spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    q = (limiter.limit_stream(stream, LIMITS).writeStream.format("parquet").option("path", str(tmp_path / "out"))
         .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    q.awaitTermination()
    written = spark.read.parquet(str(tmp_path / "out"))
    got = sorted(map(tuple, limiter.latest_decisions(written).collect()))
    assert got == sorted(map(tuple, limiter.limit_batch(log, LIMITS).collect()))
    assert written.count() > len(got)  # later files changed earlier minutes


def test_windows_of_limits():
    assert limiter.horizon({1: 2, 60: 3}) == 1 and limiter.horizon({2880: 9}) == 48
    for length in (0, 90):
        with pytest.raises(ValueError):
            limiter.horizon({length: 1})
    minutes = limiter.pd.DataFrame({"minute": [0, 1500, 2900], "requests": [5, 5, 5]})
    assert [r[2] for r in limiter.admit(minutes, {}, {2880: 6})] == [5, 1, 5]


def test_sliding_counts_brute_force(spark):
    rnd = random.Random(4)
    rows = [(rnd.randrange(2), dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rnd.randrange(20000))) for _ in range(500)]
    log = spark.createDataFrame(rows, "user_id long, requested_at timestamp_ntz")
    floor = lambda t: t.replace(second=0, microsecond=0)
    for minutes in (1, 7, 60, 1440):
        got = {(r.user_id, r.minute_start): r.requests for r in usage.sliding_counts(log, minutes).collect()}
        want = {(u, floor(t)): sum(1 for v, s in rows if v == u and floor(t) - dt.timedelta(minutes=minutes) < floor(s) <= floor(t)) for u, t in rows}
        assert got == want


def test_waiting_time(spark):
    df = spark.createDataFrame([([1],), ([1, 60],), ([60, 1440],), ([],)], "x array<int>")
    got = [r.w for r in df.select(usage.waiting_seconds(F.lit(90061), F.col("x")).alias("w")).collect()]
    assert got == [59, 3539, 82739, None]


def test_station_directory(spark, tmp_path):
    (tmp_path / "stations_list.csv").write_text("station code,lat\nTD01,1.0\n")
    (tmp_path / "TD01.csv").write_text("date,rain,temp\n2024-01-02,1.5,\n1/3/24,,20\n")
    (tmp_path / "TD02_x.csv").write_text("date,rain,temp\n2024-01-02,3,4\n")
    stations, rows = landed.station_directory(spark, str(tmp_path), ["rain", "temp", "wind"])
    assert stations.count() == 1
    got = {(r.station_code, r.date.isoformat(), r.attribute, r.value) for r in rows.collect()}
    assert got == {("TD01", "2024-01-02", "rain", 1.5), ("TD01", "2024-01-03", "temp", 20.0),
                   ("TD02", "2024-01-02", "rain", 3.0), ("TD02", "2024-01-02", "temp", 4.0)}


def test_grid_files(spark, tmp_path):
    doc = {"data": {"timelines": [{"intervals": [{"startTime": "2024-10-03T06:00:00Z", "values": {"temperatureMax": 30.5}}]}]}}
    (tmp_path / "g1.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "g2.json").write_text(json.dumps({"data": {}}))
    rows, quality = landed.grid_files(spark, str(tmp_path), ["temperatureMax", "windSpeedAvg"])
    r = rows.collect()
    assert [(x.grid_id, x.date.isoformat(), x.hour, x.temperatureMax, x.windSpeedAvg) for x in r] == [("g1", "2024-10-03", 6, 30.5, None)]
    assert {x.grid_id: x.is_valid for x in quality.collect()} == {"g1": True, "g2": False}


def test_sheet_columns_in_any_order(spark, tmp_path):
    (tmp_path / "s.csv").write_text("b,extra,a\nx,1,7\ny,2,bad\n")
    got = landed.read_sheet(spark, str(tmp_path / "s.csv"), "a int, b string").collect()
    assert [tuple(r) for r in got] == [(7, "x"), (None, "y")]
    with pytest.raises(ValueError):
        landed.read_sheet(spark, str(tmp_path / "s.csv"), "a int, c string")


def test_file_inventory(spark, tmp_path):
    (tmp_path / "max_t_2019.nc").write_bytes(b"1")
    (tmp_path / "x_2024-05-06.nc").write_bytes(b"12")
    got = {r.name: (r.variable, r.year, r.file_date) for r in landed.file_inventory(spark, str(tmp_path)).collect()}
    assert got["max_t_2019.nc"][:2] == ("max_t", 2019)
    assert got["x_2024-05-06.nc"][2] == dt.date(2024, 5, 6)


def forecast(spark):
    rows = [(dt.date(2024, 10, d), lead, 1.0, 2.0, float(100 * d + lead)) for d in range(1, 6) for lead in range(-6, 15)]
    return spark.createDataFrame(rows, "forecast_date date, forecast_day_idx int, lat double, lon double, t double")


def test_forecast_ranges(spark):
    f = forecast(spark)
    get = lambda a, b, **k: {r.date.day: r.t for r in cubes.read_forecast(f, ["t"], a, b, **k).collect()}
    assert get("2024-10-05", "2024-10-07") == {5: 500.0, 6: 501.0, 7: 502.0}
    assert get("2024-10-01", "2024-10-02") == {1: 199.0, 2: 299.0}
    assert get("2024-10-03", "2024-10-06") == {3: 399.0, 4: 499.0, 5: 500.0, 6: 501.0}
    hourly = f.withColumn("hour", F.lit(3))
    assert cubes.read_forecast(hourly, ["t"], "2024-10-01", "2024-10-03", hourly=True).count() == 0


def test_normals_wrap(spark):
    n = spark.createDataFrame([(d, 1.0, 2.0, float(d)) for d in range(1, 367)], "dayofyear int, lat double, lon double, v double")
    got = [r.month_day for r in cubes.read_normals(n, ["v"], "2023-12-30", "2024-01-02").collect()]
    assert sorted(got) == ["01-01", "01-02", "12-30", "12-31"]
    assert cubes.read_normals(n, ["v"], "2024-02-28", "2024-03-01").count() == 3


def test_request_rules(spark):
    ds = catalog.Dataset("Daily", "daily", spark.createDataFrame([(dt.date(2024, 1, 1), 1.0, 2.0, 9.0)], "date date, lat double, lon double, src double"),
                         {"t": "src", "ens": "e"}, lattice=(2.0, 1.0, 1.0), ensembles={"ens"}, max_days=3, units={"t": {"unit": "C"}})
    ok = catalog.Request("DAILY", ["t"], "2024-01-01", "2024-01-03", Location.point(2.0, 1.0), "json")
    out = catalog.measure([ds], ok)
    assert [tuple(r) for r in out.collect()] == [(dt.date(2024, 1, 1), 1.0, 2.0, 9.0)]
    assert out.schema["t"].metadata == {"unit": "C"}
    bad = [dict(product="no"), dict(output="xml"), dict(attributes=["q"]), dict(end="2024-01-09"), dict(start="2024-01-05"),
           dict(output="csv", attributes=["t", "ens"]), dict(location=Location.bbox(0, 0, 1, 1)), dict(altitudes=(5, 1))]
    for change in bad:
        with pytest.raises(catalog.RequestError):
            catalog.check(catalog.Request(**{**ok.__dict__, **change}), None if change.get("product") else ds)


def test_decisions(spark):
    cells = spark.createDataFrame([(0.0, 0.0, 80.0, 5.0, 60.0, 1.0), (0.0, 1.0, 71.0, 50.0, 60.0, 1.0), (1.0, 0.0, 80.0, 0.0, 60.0, 1.0), (1.0, 1.0, 80.0, 5.0, 20.0, 1.0)],
                                  "lat double, lon double, pfc_ecmwf_mean double, pfc_ecmwf_std double, wrsi_mean double, wrsi_std double")
    clim = spark.createDataFrame([(y, x, v) for y in (0.0, 1.0) for x in (0.0, 1.0) for v in (40.0, 64.0, float("nan"))], "lat double, lon double, clim_mean_wrsi double")
    got = {(r.lat, r.lon): r for r in planting.decision_table(cells, clim).collect()}
    assert [got[k].sm_70 for k in ((0.0, 0.0), (0.0, 1.0), (1.0, 0.0), (1.0, 1.0))] == [1.0, 0.0, 0.0, 0.0]
    assert got[0.0, 0.0].pfc_user_probability == pytest.approx(0.9772498680518208, abs=1e-12)
    assert got[1.0, 0.0].pfc_user_probability is None


def test_pest_unknown_name_fails(spark):
    long = spark.createDataFrame([(1, "moth", 2.0)], "no int, variable string, value double")
    names = spark.createDataFrame([(1, "worm")], "pest_id int, variable_name string")
    with pytest.raises(Exception, match="moth"):
        pests.with_pest(long, names).collect()


def test_season_messages_need_no_alert(spark):
    farms = spark.createDataFrame([(1, "g", "555"), (2, None, "777")], "farm_id int, farm_group string, farm_group_phone string")
    alerts = spark.createDataFrame([], "farm_id int, generated_at date, data_type string, pest_id int, value double")
    sched = spark.createDataFrame([(1, "Start of Season", 1, 1, None, True, 1)], "schedule_id int, group string, day_occurrence_in_month int, day_of_week int, schedule_date date, active boolean, priority int")
    msg = spark.createDataFrame([(9, "Start of Season", None, 1, "call {{ phone }} {{day_1}}", None)], "pest_id int, group string, farm_group_id int, message_no int, template_en string, template_sw string")
    out = pests.pest_messages(farms, alerts, sched, msg, "2025-07-01").collect()  # a first Tuesday
    assert [(r.farm_id, r.message) for r in out] == [(1, '"call 555 "')]
    assert pests.pest_messages(farms, alerts, sched, msg, "2025-07-02").count() == 0


def test_templates_of_a_key_follow_each_other(spark, tmp_path):
    keys = [(p, g, f) for p in (1, 2) for g in ("a", "b") for f in (None, 0, 7)]
    rows = [(i, *keys[i % 12]) for i in range(6000)] + [(8000, None, "a", 7), (8001, 1, None, 7), (8002, 1, "c", 7), (8003, 1, "a", 8), (3, *keys[3])]
    messages = [(*k, 100 * n + i, f"en {n} {i}", None) for n, k in enumerate(keys[:-1]) for i in range(4)] + [(None, "a", 7, 1, "x", "y"), (1, "a", 9, 2, "x", "y"), (*keys[0], 0, "en 0 0", None)]
    spark.createDataFrame(rows, "farm_id int, pest_id int, group string, farm_group_id int").coalesce(1).write.parquet(f"{tmp_path}/r")
    spark.createDataFrame(messages, "pest_id int, group string, farm_group_id int, message_no int, template_en string, template_sw string").coalesce(1).write.parquet(f"{tmp_path}/m")
    r, m = spark.read.parquet(f"{tmp_path}/r"), spark.read.parquet(f"{tmp_path}/m")
    out = pests.join_messages(r, m)
    assert out.columns == [*r.columns, "message_no", "template_en", "template_sw"]
    want = sorted((a[0], b[3], b[4]) for a in rows for b in messages if a[1:] == b[:3] and a[1] and a[2])
    assert sorted((x.farm_id, x.message_no, x.template_en) for x in out.collect()) == want
    placed = out.select("farm_id", "pest_id", "group", "farm_group_id", F.spark_partition_id().alias("at")).collect()
    runs = [x for x, before in zip(placed, [None, *placed[:-1]]) if before is None or (x.at, x[1:4]) != (before.at, before[1:4])]
    assert len(runs) <= 11 * 16  # not one run for each of the 5501 matched rows
    assert len({x.at for x in placed if x[1:4] == keys[3]}) > 1  # the rows of one key are spread


def test_long_lists_of_templates_stay_small(spark, tmp_path):
    rows = spark.range(400).select(F.col("id").alias("farm_id"), F.lit(1).alias("pest_id"), F.lit("a").alias("group"), F.lit(None).cast("int").alias("farm_group_id"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("value"))
    rows = rows.unionByName(rows.where("farm_id = 8"))  # one row twice
    no = F.col("id").cast("int")
    messages = spark.range(12_000).select(F.lit(1).alias("pest_id"), F.lit("a").alias("group"), F.lit(None).cast("int").alias("farm_group_id"), no.alias("message_no"),
                                          F.concat(F.lit("en "), no).alias("template_en"), F.when(no % 2 == 0, F.concat(F.lit("sw "), no)).alias("template_sw"))
    out = pests.join_messages(rows, messages)
    out.select("farm_id", "message_no").write.parquet(f"{tmp_path}/out")
    got = spark.read.parquet(f"{tmp_path}/out").groupBy("farm_id", "message_no").count().groupBy("farm_id").agg(F.count("*").alias("n"), F.min("count").alias("lo"), F.max("count").alias("hi"))
    assert sorted(map(tuple, got.collect())) == [(i, 12_000, 1 + (i == 8), 1 + (i == 8)) for i in range(400)]
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 0.4 * 401 * 12_000  # a list of a key is longer than a part of a page
    sw = F.when(F.col("message_no") % 2 == 0, F.concat(F.lit("sw "), "message_no"))
    value = F.when(F.col("farm_id") % 3 > 0, F.col("farm_id"))
    assert out.where((F.col("template_en") != F.concat(F.lit("en "), "message_no")) | ~F.col("template_sw").eqNullSafe(sw) | ~F.col("value").eqNullSafe(value) | F.col("farm_group_id").isNotNull()).count() == 0
    bare = rows.select("pest_id", "group", "farm_group_id").limit(3)
    assert pests.join_messages(bare, messages.limit(5)).count() == 15


def test_registry_two_farms(spark, tmp_path):
    (tmp_path / "r.csv").write_text("farmer_id,crop,planting_date,final_latitude,final_longitude,county,subcounty,ward,language\n"
                                    "F001,Maize_Mid,2025-01-09,-1.2921,36.8219,A,b,c,en\nF002,maize_Medium,1/10/25,-1.25,36.8,a,B,c,en\n"
                                    "F003,Maize_Mid,2025-01-09,40.0,10.0,A,b,c,en\n")
    from furrow.functions import geo
    from furrow.schema import REGISTRY_CSV
    csv = landed.read_sheet(spark, str(tmp_path / "r.csv"), REGISTRY_CSV)
    farm = spark.createDataFrame([], "farm_id long, farm_unique_id string, grid_id long")
    grid = spark.range(1).select(F.lit(5).cast("long").alias("grid_id"), F.lit(36.75).alias("lon"), F.lit(-1.25).alias("lat"),
                                 geo.rectangle(F.lit(36.5), F.lit(-1.5), F.lit(37.0), F.lit(-1.0)).alias("area"))
    crop = spark.createDataFrame([(1, "Maize")], "crop_id int, crop string")
    stage = spark.createDataFrame([(2, "Mid")], "crop_stage_type_id int, stage_type string")
    reg = spark.createDataFrame([], "registry_id long, group_id int, farm_id long, crop_id int, crop_stage_type_id int, planting_date date")
    county = spark.createDataFrame([(3, "Z")], "county_id long, name string")
    load = registry.ingest(csv, 1, farm, grid, crop, stage, reg, {"county": county})
    assert sorted(r.farm_unique_id for r in load.farms.collect()) == ["F001", "F002"]
    assert load.inserts.count() == 2 and load.updates.count() == 0
    c = load.counts.first()
    assert (c.total, c.insertable, c.existing, c.mismatch) == (3, 2, 0, True)
    assert sorted((r.county_id, r.name) for r in load.dimensions["county"].collect()) == [(3, "Z"), (4, "A")]
    # loaded again: everything is known
    reg2 = load.inserts.select(F.monotonically_increasing_id().alias("registry_id"), "group_id", "farm_id", "crop_id", "crop_stage_type_id", "planting_date")
    farm2 = load.farms.select("farm_id", "farm_unique_id", "grid_id")
    again = registry.ingest(csv, 1, farm2, grid, crop, stage, reg2, {})
    assert again.updates.count() == 2 and again.inserts.count() == 0


def test_upsert_keep_first_and_last(spark):
    old = spark.createDataFrame([(1, "old", 0)], "k int, v string, arrival int")
    new = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (2, "c", 1), (2, "d", 2)], "k int, v string, arrival int")
    get = lambda keep: {r.k: r.v for r in ingest.upsert(old, new, ["k"], keep).collect()}
    assert get("last") == {1: "b", 2: "d"} and get("first") == {1: "old", 2: "c"}


def test_salted_join_and_dense_ids(spark):
    big = spark.range(1000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7).alias("k"), "id")
    small = spark.createDataFrame([(0, "a"), (1, "b"), (9, "z")], "k long, v string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        rows = lambda d: sorted(map(repr, d.select(sorted(d.columns)).collect()))
        assert rows(salted_join(big, small, ["k"], how)) == rows(big.join(small, ["k"], how))
    names = spark.range(500).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("n"))
    ids = sorted(r.i for r in dense_ids(names, "n", "i", 10).collect())
    assert ids == list(range(11, 511))
    assert latest_by(big, ["k"], ["id"]).where("k = 0").first().id == 999


def test_measurement_clip(spark):
    df = spark.createDataFrame([(1, dt.date(2024, 1, 1))], "k int, date date")
    assert ingest.date_window(df, "2024-01-01", "2024-01-02").count() == 1
    assert ingest.date_window(df, "2023-12-31", "2024-01-01").count() == 0


def test_datasets_of_one_product(spark):
    day = spark.sql("SELECT DATE '2024-01-05' AS date, 36.0D AS lon, -1.0D AS lat, 1.5D AS x, 2.5D AS y")
    one = catalog.Dataset("daily", "daily", day, {"a": "x"}, lattice=(20.0, -20.0, 0.5))
    two = catalog.Dataset("Daily", "daily", day, {"b": "y"}, lattice=(20.0, -20.0, 0.5))
    hidden = catalog.Dataset("daily", "daily", day, {"a": "y"}, lattice=(20.0, -20.0, 0.5), internal=True)
    ask = catalog.Request("daily", ["a", "b"], "2024-01-05", "2024-01-05", Location.bbox(30.0, -5.0, 40.0, 5.0))
    rows = catalog.measure([one, two, hidden], ask).select("a", "b").collect()
    assert sorted(map(tuple, rows), key=str) == [(1.5, None), (None, 2.5)]
