"""Partition-aware rewrites, marks, compaction: what is read, and what a lost run leaves."""

import datetime as dt
import pathlib
import random

import pytest
from pyspark.sql import functions as F

from furrow.operators.skew import latest_by
from furrow.sinks import tables
from furrow.sinks.versions import Versions
from furrow.streaming import jobs, marks

DAY0 = dt.datetime(2024, 1, 1)


def spoil(folder):
    """Files that fail when they are read."""
    found = [f for f in pathlib.Path(folder).rglob("*.parquet")]
    for f in found:
        f.write_bytes(b"not a table")
        crc = f.with_name(f".{f.name}.crc")
        if crc.exists():
            crc.unlink()
    return len(found)


def cells(spark, days, value):
    return spark.createDataFrame([(dt.date(2024, 1, 1) + dt.timedelta(days=d), float(c), 1.0, value)
                                  for d in days for c in range(3)], "forecast_date date, lat double, lon double, t double")


def test_only_touched_partitions_are_read(spark, tmp_path):
    path = str(tmp_path / "cube")
    tables.upsert_partition(cells(spark, range(100), 1.0), path)
    for d in range(100):
        if d != 41:
            assert spoil(f"{path}/forecast_date={dt.date(2024, 1, 1) + dt.timedelta(days=d)}") >= 1
    # the schema of the table comes from any one file: keep a sound one in an untouched partition
    sound = cells(spark, [0], 1.0)
    tables.upsert_partition(sound, path)
    new = cells(spark, [41], 2.0).where("lat < 1")
    tables.merge_partition(new, path, ["lat", "lon"])
    got = tables.read_touched(spark, path, F.col("forecast_date") == dt.date(2024, 2, 11))
    assert sorted((r.lat, r.t) for r in got.collect()) == [(0.0, 2.0), (1.0, 1.0), (2.0, 1.0)]


def test_touched_values_are_partition_filters(spark, tmp_path):
    path = str(tmp_path / "cube")
    rows = cells(spark, range(100), 1.0).withColumn("year", F.year("forecast_date")).withColumn("month", F.month("forecast_date"))
    tables.write_partitions(rows, path, ["year", "month"], ["forecast_date"])
    condition = tables.touched_partitions(rows.where("forecast_date = '2024-03-02'"), ["year", "month"])
    plan = spark.read.parquet(path).where(condition)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "2024" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert tables.read_touched(spark, path, condition).select("month").distinct().collect()[0].month == 3
    assert tables.touched_partitions(rows, ["forecast_date"], limit=5) is None
    assert tables.read_touched(spark, str(tmp_path / "none"), condition) is None
    nulls = spark.createDataFrame([(None, 1), ("a", 1)], "part string, v int")
    tables.write_partitions(nulls, str(tmp_path / "nulls"), ["part"])
    only = tables.touched_partitions(nulls.where("part IS NULL"), ["part"])
    assert tables.read_touched(spark, str(tmp_path / "nulls"), only).count() == 1


def test_equal_keys_of_a_load_leave_a_defined_row(spark, tmp_path):
    rows = spark.createDataFrame([(i % 5, f"v{i}") for i in range(60)], "k int, v string")
    seen = {tuple(sorted(map(tuple, tables.one_per_key(rows.repartition(n), ["k"]).collect()))) for n in (1, 3, 8)}
    assert len(seen) == 1
    seen = {tuple(sorted(map(tuple, latest_by(rows.withColumn("o", F.lit(1)).repartition(n), ["k"], ["o"]).collect())))
            for n in (1, 3, 8)}
    assert len(seen) == 1
    plan = latest_by(rows, ["k"], ["v"])._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "WindowGroupLimit" in plan


def observations(spark, upto, seed=3):
    """(station, attribute) series of different length, up to a day."""
    rnd, rows = random.Random(seed), []
    for station in range(4):
        for attribute in ("rain", "temp"):
            for hour in range(0, 24 * 20, 1 + station):
                rows.append((station, attribute, DAY0 + dt.timedelta(hours=hour), float(rnd.randrange(1000))))
    late = DAY0 + dt.timedelta(days=upto)
    return spark.createDataFrame([r for r in rows if r[2] <= late], "station_id long, attribute string, date_time timestamp_ntz, value double")


KEYS = ["station_id", "attribute"]


def stored(spark, target):
    return sorted(map(tuple, spark.read.parquet(target).select(*KEYS, "date_time", "value").collect()))


def test_runs_from_marks_equal_one_batch(spark, tmp_path):
    target = str(tmp_path / "obs")
    for day in (6, 6, 13, 20):                  # the second run finds nothing new
        marks.ingest_since(observations(spark, day), target, str(DAY0 + dt.timedelta(days=day)), KEYS)
    assert stored(spark, target) == sorted(map(tuple, observations(spark, 20).collect()))
    assert spark.read.parquet(target).where("batch_id = 2").count() == 0
    found = {(r.station_id, r.attribute): r.mark for r in marks.store_of(spark, target).read().collect()}
    want = {}
    for s, a, t, _ in observations(spark, 20).collect():
        want[s, a] = max(want.get((s, a), t), t)
    assert found == want


def test_run_lost_before_its_marks_is_repeated(spark, tmp_path, monkeypatch):
    target = str(tmp_path / "obs")
    marks.ingest_since(observations(spark, 6), target, str(DAY0 + dt.timedelta(days=6)), KEYS)

    def lost(self, version, **note):
        raise OSError("executor lost")

    with monkeypatch.context() as m:
        m.setattr(Versions, "commit", lost)
        with pytest.raises(OSError):
            marks.ingest_since(observations(spark, 13), target, str(DAY0 + dt.timedelta(days=13)), KEYS)
    assert marks.store_of(spark, target).latest()[0] == 1
    assert marks.ingest_since(observations(spark, 20), target, str(DAY0 + dt.timedelta(days=20)), KEYS) == 2
    assert stored(spark, target) == sorted(map(tuple, observations(spark, 20).collect()))


def test_windows_and_late_rows(spark, tmp_path):
    now = "2024-01-10 00:00:00"
    keys = spark.createDataFrame([(1, "rain"), (2, "rain"), (2, "rain")], "station_id long, attribute string")
    held = spark.createDataFrame([(1, "rain", dt.datetime(2024, 1, 9))], "station_id long, attribute string, mark timestamp_ntz")
    got = {r.station_id: (r.start, r.end) for r in marks.windows(keys, held, now).collect()}
    end = dt.datetime(2024, 1, 10)
    assert got == {1: (dt.datetime(2024, 1, 9), end), 2: (end - dt.timedelta(days=365), end)}
    assert {r.start for r in marks.windows(keys, None, now, days=2).collect()} == {dt.datetime(2024, 1, 8)}
    rows = spark.createDataFrame([(1, "rain", dt.datetime(2024, 1, d), 1.0) for d in (7, 8, 9, 10, 11)]
                                 + [(2, "rain", dt.datetime(2022, 1, 1), 1.0), (2, "rain", dt.datetime(2023, 6, 1), 1.0)],
                                 "station_id long, attribute string, date_time timestamp_ntz, value double")
    days = lambda d: sorted((r.station_id, r.date_time.day) for r in d.collect())
    assert days(marks.since(rows, held, KEYS, now)) == [(1, 9), (1, 10), (2, 1)]
    assert days(marks.since(rows, held, KEYS, now, overlap="1 days")) == [(1, 8), (1, 9), (1, 10), (2, 1)]


def test_stream_keeps_late_rows_and_compacts(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "obs")
    rows = observations(spark, 20)
    for part in (rows.where("hour(date_time) >= 12"), rows.where("hour(date_time) < 14")):
        part.coalesce(1).write.mode("append").parquet(source)
    jobs.ingest_observations(jobs.file_stream(spark, source, rows.schema, files_per_trigger=1), target)
    assert stored(spark, target) == sorted(map(tuple, rows.collect()))
    assert jobs.compact_days(spark, target, "2024-01-15") == 14
    assert stored(spark, target) == sorted(map(tuple, rows.collect()))
    left = spark.read.parquet(target).where("day < '2024-01-15'").select("batch_id").distinct().collect()
    assert [r.batch_id for r in left] == [jobs.COMPACTED] and jobs.compact_days(spark, target, "2024-01-15") == 0


def test_second_compaction_reads_new_batches_only(spark, tmp_path):
    landed, cube = str(tmp_path / "landed"), str(tmp_path / "cube")
    slice_ = lambda lead, v: cells(spark, [0], v).withColumn("forecast_day_idx", F.lit(lead))
    jobs._own_partition(slice_(0, 1.0), 0, landed)
    jobs._own_partition(slice_(1, 1.0), 1, landed)
    assert jobs.compact_forecast(spark, landed, cube, ["t"]) == 2
    for lead in (0, 1):                                # seen, if it were read again
        jobs._own_partition(slice_(lead, 99.0), lead, landed)
    jobs._own_partition(slice_(1, 5.0), 2, landed)
    assert jobs.compact_forecast(spark, landed, cube, ["t"]) == 1
    got = sorted((r.forecast_day_idx, r.t) for r in spark.read.parquet(cube).collect())
    assert got == [(0, 1.0)] * 3 + [(1, 5.0)] * 3
    assert jobs.compact_forecast(spark, landed, cube, ["t"]) == 0


def test_versions(spark, tmp_path):
    store = Versions(spark, str(tmp_path / "v"))
    assert store.latest() == (0, {}) and store.read() is None
    spark.range(3).write.parquet(store.folder(1))
    assert store.read() is None                       # written, not committed
    store.commit(1, rows=3)
    assert store.latest() == (1, {"rows": 3}) and store.read().count() == 3
    with pytest.raises(ValueError):
        store.commit(1)


def test_request_state_is_bounded(spark, tmp_path):
    """40 days of requests: the state holds the kept hours only; decisions inside them equal the batch."""
    from furrow.streaming import limiter
    rnd, limits, keep = random.Random(5), {1: 2, 60: 5, 1440: 30}, 48
    days = [[(u, DAY0 + dt.timedelta(days=d, seconds=rnd.randrange(86400))) for u in (1, 2) for _ in range(25)] for d in range(40)]
    for d in range(39):             # some come a day late
        days[d + 1] += [days[d].pop(0) for _ in range(5)]
    too_late = [(1, DAY0 + dt.timedelta(hours=1, seconds=s)) for s in range(3)]
    schema = "user_id long, requested_at timestamp"
    for n, part in enumerate([*days, too_late]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"{n:02d}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = (limiter.limit_stream(stream, limits, keep).writeStream.format("parquet").option("path", str(tmp_path / "out"))
         .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    q.awaitTermination()
    written = spark.read.parquet(str(tmp_path / "out"))
    log = spark.createDataFrame([r for part in days for r in part], schema)
    assert sorted(map(tuple, limiter.latest_decisions(written).collect())) == sorted(
        map(tuple, limiter.limit_batch(log, limits).collect()))
    assert written.agg(F.max("late")).first()[0] == 3
    state = (spark.read.format("statestore").option("path", str(tmp_path / "cp")).option("stateVarName", "minutes").load())
    assert 0 < state.count() <= 2 * 25 * (keep // 24 + 3)


def test_late_page_reads_one_range(spark, tmp_path):
    from furrow.sources import scans
    path = str(tmp_path / "paged")
    rows = spark.range(0, 40_000, 2).withColumn("v", F.col("id") * 3)
    scans.write_paged(rows, path, "id", 500)
    for limit, offset in ((100, 0), (100, 19_950), (700, 10_250), (5, 30_000)):
        got = [r.id for r in scans.read_page(spark, path, "id", limit, offset).collect()]
        assert got == list(range(0, 40_000, 2))[offset:offset + limit]
    page = scans.read_page(spark, path, "id", 100, 10_250)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id," in plan and "LessThanOrEqual(id," in plan
    low = int(plan.split("GreaterThanOrEqual(id,")[1].split(")")[0])
    high = int(plan.split("LessThanOrEqual(id,")[1].split(")")[0])
    assert high - low < 2 * 1000
