"""Queries and operators that did less than their job or grew faster than their input."""

import datetime as dt

from pyspark.sql import functions as F

import __spark_entry__ as entry


def test_advisory_write_keeps_the_day_of_each_row(spark, tmp_path):
    days = [dt.datetime(1995, 3, 9), dt.datetime(1995, 12, 31), dt.datetime(1998, 7, 1)]
    spark.createDataFrame([(i, i, "1-URGENT", "F", d) for i, d in enumerate(days, 1)],
                          "o_orderkey long, o_custkey long, o_orderpriority string, o_orderstatus string, o_orderdate timestamp_ntz"
                          ).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, 1, 1.0)], "s_suppkey long, s_nationkey long, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    got = entry.queries()["K01_advisory_write"](spark, str(tmp_path)).collect()
    assert sorted((r.registry_id, r.year, r.month, r.day) for r in got) == [
        (i, d.year, d.month, d.day) for i, d in enumerate(days, 1)]
    assert "month, day" in entry.oracle_sql()["K01_advisory_write"]


def test_micro_batches_do_not_follow_small_files(spark, tmp_path, monkeypatch):
    from suite import streams
    from suite.base import Tables
    rows = spark.range(50_000).repartition(1)
    monkeypatch.setattr(streams, "scratch_dir", lambda session, label: f"{tmp_path}/{label}")
    streams.stream_of(Tables(spark, "/none"), rows, "land")
    assert len(list(tmp_path.glob("land/*.parquet"))) == 1


def test_log_ingest_finds_users_once(spark, tmp_path):
    from furrow.streaming import jobs
    seen = spark.sparkContext.accumulator(0)

    def note(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    users = spark.createDataFrame([(1, "a"), (2, "b")], "user_id long, user_name string").mapInArrow(note, "user_id long, user_name string")
    for i in range(3):
        spark.createDataFrame([(i, i, "{}")], "request_id long, user_id long, query_params string").write.mode("append").parquet(f"{tmp_path}/in")
    stream = jobs.file_stream(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema, files_per_trigger=1)
    jobs.ingest_request_log(stream, users, f"{tmp_path}/out")
    out = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((r.request_id, r.user_name) for r in out.collect()) == [(0, None), (1, "a"), (2, "b")]
    assert seen.value == 2


def test_nearest_on_axis_does_not_multiply_points(spark):
    from furrow.operators import spatial
    axis = spark.createDataFrame([(float(c),) for c in (0, 1, 3, 7, 8)], "c double")
    points = spark.createDataFrame([(1, 2.0), (2, 5.0), (3, -9.0), (4, 7.6), (5, None), (6, 0.4), (6, 7.9)], "k long, v double")
    near = spatial.nearest_on_axis(points, axis, "v", "c", 4.0, ["k"])
    assert {r.k: r.c for r in near.collect()} == {1: 1.0, 2: 3.0, 3: 0.0, 4: 8.0, 5: 0.0, 6: 8.0}
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and plan.count("HashAggregate") >= 4


def test_hot_bucket_is_spread_and_areas_are_not_copied_otherwise(spark):
    from furrow.functions import geo
    from furrow.operators import spatial
    points = spark.range(900).select("id", F.when(F.col("id") < 600, 0.25).otherwise(F.col("id") / 100).alias("lon"), F.lit(0.5).alias("lat"))
    box = geo.rectangle(F.col("x"), F.lit(0.0), F.col("x") + 0.5, F.lit(1.0))
    cells = spark.range(20).select((F.col("id") / 2).alias("x"), F.col("id").alias("cell")).withColumn("area", box).drop("x")
    # a triangle must not be taken for its envelope
    three = [(0.0, 0.0), (9.0, 0.0), (0.0, 1.0), (0.0, 0.0)]
    tri = F.array(F.array(*[geo.point(F.lit(a), F.lit(b)) for a, b in three]))
    areas = cells.unionByName(spark.range(1).select(F.lit(99).cast("long").alias("cell"), tri.alias("area")))
    assert [r.r for r in areas.select(geo.is_rectangle(F.col("area")).alias("r")).distinct().orderBy("r").collect()] == [False, True]
    want = {(r.id, r.cell) for r in points.crossJoin(areas).where(geo.in_area(F.col("lon"), F.col("lat"), F.col("area"), "include")).collect()}
    for per_task in (50, 100_000):
        got = spatial.join_points_to_areas(points, areas, bucket_deg=0.5, per_task=per_task)
        assert sorted((r.id, r.cell) for r in got.collect()) == sorted(want)


def test_nearest_within_meets_few_places(spark):
    from furrow.operators import spatial
    places = spark.range(2000).select(F.col("id").alias("sid"), (F.col("id") % 50 / 50).alias("lon"), (F.floor(F.col("id") / 50) / 40).alias("lat"))
    points = spark.createDataFrame([(1, 0.501, 0.5), (1, 0.5, 0.5), (2, 50.0, 0.0), (3, None, 0.0)], "pid long, lon double, lat double")
    near = spatial.nearest_within(points, places.unionByName(spark.createDataFrame([(9999, None, None)], places.schema)), "pid", "sid", 150000.0)
    assert [(r.pid, r.sid, r.distance_m) for r in near.collect()] == [(1, 1025, 0.0)]


def test_equal_ranges_count_once_in_a_rule_book(spark):
    from furrow.plans import advisory
    rules = spark.createDataFrame([(i, 1, 1, 1, 1, "humidity", 10.0 * (i % 2), 10.0 * (i % 2) + 10, 100 + i) for i in range(2, 40)],
                                  "rule_id long, config_id int, crop_id int, crop_stage_type_id int, growth_stage_id int, parameter string, "
                                  "min_range double, max_range double, code int")
    ranks = spark.createDataFrame([(1, 102, 5)], "config_id int, code int, priority int")
    facts = spark.createDataFrame([(1, 1, 1, 1, 5.0), (1, 1, 1, 1, 15.0)], "config_id int, crop_id int, crop_stage_type_id int, growth_stage_id int, humidity double")
    for p in set(advisory.PARAMETERS) - {"humidity"}:
        facts = facts.withColumn(p, F.lit(None).cast("double"))
    out = advisory.with_codes(facts, rules, ranks)
    assert sorted((r.humidity, r.codes) for r in out.collect()) == [(5.0, [102]), (15.0, [103])]
    assert advisory.leading_rules(rules, ranks).count() == 2


def _counted(spark, df):
    seen = spark.sparkContext.accumulator(0)

    def note(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return df.mapInArrow(note, df.schema), seen


def test_rain_since_computes_its_rows_once(spark):
    from furrow.plans import agronomy
    day = lambda d: dt.date(2024, 1, d)
    epoch = lambda d: int(dt.datetime(2024, 1, d, tzinfo=dt.timezone.utc).timestamp())
    df, seen = _counted(spark, spark.createDataFrame(
        [(1, epoch(2)), (1, None), (1, epoch(2)), (2, epoch(9)), (3, epoch(1)), (None, epoch(1))], "grid_id long, start long"))
    w = spark.createDataFrame([(1, day(1), 1.0), (1, day(2), 2.0), (1, day(2), 4.0), (1, day(3), None), (1, day(9), 8.0), (2, day(1), 1.0),
                               (None, day(2), 5.0), (1, None, 7.0)], "grid_id long, date date, total_rainfall double")
    out = agronomy.rain_since(df, w, [], "start", "2024-01-03", "rain").collect()
    assert sorted((r.grid_id or 0, r.start or 0, r.rain) for r in out) == [
        (0, epoch(1), 0.0), (1, 0, 7.0), (1, epoch(2), 6.0), (1, epoch(2), 6.0), (2, epoch(9), 0.0), (3, epoch(1), 0.0)]
    assert seen.value == 6


def test_named_files_are_written_by_the_tasks(spark, tmp_path, monkeypatch):
    from suite import base
    monkeypatch.setattr(base, "scratch_dir", lambda session, label: f"file://{tmp_path}/{label}")
    t = base.Tables(spark, "/none")
    rows = spark.createDataFrame([("a.csv", "1", None), ("b/c.csv", 'x"y', "2,3"), ("a.csv", "4", "5"), (None, "6", "7")], "name string, u string, v string")
    path = t.named_files(rows.repartition(3), "name", "csv", header=True)
    files = {f.name: sorted(f.read_text().splitlines()) for f in (tmp_path / "named").iterdir() if not f.name.startswith(".")}
    assert files == {"a.csv": ["1,", "4,5", "u,v"], "b%2Fc.csv": ['"x\\"y","2,3"', "u,v"], "__HIVE_DEFAULT_PARTITION__": ["6,7", "u,v"]}
    assert path.endswith("named") and not (tmp_path / "landing").exists()


def test_station_directory_reads_the_folder_in_one_scan(spark, tmp_path):
    from furrow.sources import landed
    (tmp_path / "sub").mkdir()
    (tmp_path / "S1_d.csv").write_text('date,rain\n2024-01-02,"1.5"\n\n2024-01-03,\n')
    (tmp_path / "sub" / "S2.CSV").write_text("\nTimestamp,extra,Rain,rain,\n2024-01-02,z,3,4,5\n2024-01-04,z\n")
    (tmp_path / "sub" / "S3.csv").write_text("rain,DATE\n7,2024-01-05\n7,2024-01-05,9\n")
    (tmp_path / "All_Stations.csv").write_text('code,"the name, long",\nS1,"a, b",x\nS2,,\n')
    stations, rows = landed.station_directory(spark, str(tmp_path), ["rain"])
    assert [tuple(r) for r in stations.orderBy("code").collect()] == [("S1", "a, b", "x"), ("S2", None, None)]
    assert stations.columns == ["code", "the name, long", "_c2"]
    got = sorted((r.station_code, r.date.isoformat(), r.value) for r in rows.collect())
    assert got == [("S1", "2024-01-02", 1.5), ("S3", "2024-01-05", 7.0), ("S3", "2024-01-05", 7.0)]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [value") == 1 and "] csv" not in plan


def test_grid_files_are_read_and_parsed_once(spark, tmp_path):
    from furrow.sources import landed
    (tmp_path / "1_f.json").write_text('{"data": {"timelines": [{"intervals": [{"startTime": "2024-10-03T06:00:00Z", "values": {"t": 3.5}}]}]}}')
    (tmp_path / "2_f.json").write_text("{")
    (tmp_path / "3_f.json").write_text('{"data": {"timelines": []}}')
    rows, quality = landed.grid_files(spark, str(tmp_path), ["t"])
    assert [(r.grid_id, r.t) for r in rows.collect()] == [("1", 3.5)]
    assert {r.grid_id: r.is_valid for r in quality.collect()} == {"1": True, "2": False, "3": False}
    for df in (rows, quality):
        assert "FileScan text" not in df._jdf.queryExecution().executedPlan().toString()
