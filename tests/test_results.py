"""Rule index, run manifest, rendered answers, conversion runs."""

import datetime as dt
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from furrow.plans import advisory, catalog, cubes
from furrow.plans.observations import Location
from furrow.sinks import results, runs, tables
from furrow.sources import landed


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# rules

def book(spark, per_key, seed=1):
    rnd, rows = random.Random(seed), []
    for key in range(4):
        for parameter in advisory.PARAMETERS:
            for _ in range(per_key):
                lo = rnd.randrange(0, 200) / 2
                rows.append((len(rows), 1, key, 1, 1, parameter, lo, lo + rnd.randrange(0, 40) / 2, rnd.randrange(50)))
    rules = spark.createDataFrame(rows, "rule_id int, config_id int, crop_id int, crop_stage_type_id int, growth_stage_id int, "
                                        "parameter string, min_range double, max_range double, code int")
    ranks = spark.createDataFrame([(1, c, c % 7) for c in range(0, 50, 2)], "config_id int, code int, priority int")
    return rows, rules, ranks


def facts(spark, n=300, seed=2):
    rnd = random.Random(seed)
    value = lambda: rnd.choice([None, float("nan"), rnd.randrange(-10, 230) / 2, rnd.randrange(0, 200) / 2])
    return spark.createDataFrame([(i, 1, rnd.randrange(5), 1, 1, *[value() for _ in range(5)]) for i in range(n)],
                                 "id int, config_id int, crop_id int, crop_stage_type_id int, growth_stage_id int, "
                                 + ", ".join(f"{p} double" for p in advisory.PARAMETERS))


@pytest.mark.parametrize("per_key", [1, 9, 120])
@pytest.mark.parametrize("most", [advisory.MAX_BOOK_RULES, 0])
def test_rule_index_equals_a_plain_scan(spark, per_key, most, monkeypatch):
    monkeypatch.setattr(advisory, "MAX_BOOK_RULES", most)
    rows, rules, ranks = book(spark, per_key)
    priority = {c: c % 7 for c in range(0, 50, 2)}
    out = advisory.with_codes(facts(spark), rules, ranks)
    for r in out.collect():
        hits = set()
        for p in advisory.PARAMETERS:
            value = 0.0 if r[p] is None or r[p] != r[p] else r[p]          # missing counts as 0
            fits = [x for x in rows if x[2] == r.crop_id and x[5] == p and x[6] <= value < x[7]]
            if fits:
                code = min(fits)[8]
                hits.add((-priority.get(code, 0), code))
        assert r.codes == [c for _, c in sorted(hits)], r
    assert sorted(out.columns) == sorted([*facts(spark, 1).columns, "codes"])


def test_rows_stay_where_they_are(spark):
    _, rules, ranks = book(spark, 5)
    plan = plan_of(advisory.to_slots(advisory.with_codes(facts(spark).repartition(3), rules, ranks)))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan.split("BroadcastHashJoin")[0]
    assert len(re.findall("array_distinct", advisory.to_slots(advisory.with_codes(facts(spark), rules, ranks))
                          ._jdf.queryExecution().optimizedPlan().toString())) <= 8


# runs

def test_newest_run_comes_from_the_manifest(spark, tmp_path):
    path = str(tmp_path / "cube")
    assert runs.coverage(spark, path) is None and runs.newest(spark, path) is None
    cube = lambda days, v: spark.createDataFrame([(dt.date(2024, 1, d), lead, float(c), 0.0, v) for d in days for lead in (-1, 0, 1)
                                                  for c in range(3)], "forecast_date date, forecast_day_idx int, lat double, lon double, t double")
    runs.write_runs(cube([3, 4], 1.0), path)
    assert runs.coverage(spark, path) == (dt.date(2024, 1, 3), dt.date(2024, 1, 4))
    runs.merge_runs(cube([5], 2.0).where("lat < 1"), path, ["forecast_day_idx", "lat", "lon"])
    runs.merge_runs(cube([4], 9.0).where("lat > 1"), path, ["forecast_day_idx", "lat", "lon"])
    runs.write_runs(cube([], 2.0), path)
    assert runs.newest(spark, path) == dt.date(2024, 1, 5)
    stored = spark.read.parquet(path)
    assert sorted((r.lat, r.t) for r in stored.where("forecast_date = '2024-01-04' and forecast_day_idx = 0").collect()) == [
        (0.0, 1.0), (1.0, 1.0), (2.0, 9.0)]
    got = cubes.read_forecast(stored, ["t"], "2024-01-05", "2024-01-06", runs.newest(spark, path))
    assert "2024-01-05" in plan_of(got) and "max(forecast_date" not in plan_of(got) and got.count() == 2


# answers

DAY = dt.datetime(2024, 1, 5)


def products(spark):
    wide = spark.createDataFrame([(1, DAY + dt.timedelta(hours=h), h * 1.0, None) for h in range(4)]
                                 + [(2, DAY, 5.5, 1.0)], "station_id long, date_time timestamp_ntz, a double, b double")
    places = spark.createDataFrame([(1, 2.0, 1.0), (2, 40.0, 1.0)], "station_id long, lon double, lat double")
    extra = spark.createDataFrame([(1, DAY + dt.timedelta(hours=1), 70.0, 9.0)], "station_id long, date_time timestamp_ntz, c double, a2 double")
    members = spark.createDataFrame([(dt.date(2024, 1, 1), 4, m, 1.0, 2.0, 10.0 + m) for m in range(3)],
                                    "forecast_date date, forecast_day_idx int, ensemble int, lat double, lon double, e double")
    return [catalog.Dataset("Station", "station", wide, {"rain": "a", "wind": "b"}, stations=places, units={"rain": {"unit": "mm"}}),
            catalog.Dataset("station", "station", extra, {"humidity": "c", "rain": "a2"}, stations=places, units={"humidity": {"unit": "%"}}),
            catalog.Dataset("seasonal", "seasonal", members, {"t": "e"}, lattice=(2.0, 1.0, 1.0), ensembles={"t"}, latest=dt.date(2024, 1, 1))]


def ask(product, attributes, output, spot=(2.0, 1.0)):
    return catalog.Request(product, attributes, "2024-01-05", "2024-01-06", Location.point(*spot), output)


def lines(spark, path):
    return [r.value for r in spark.read.text(path).collect()]


def test_datasets_are_merged_in_time_order(spark, tmp_path):
    path = str(tmp_path / "out")
    catalog.answer(products(spark), ask("station", ["rain", "humidity"], "csv"), path, unit_names=True)
    got = lines(spark, path)
    assert got[0] == "datetime,station_id,lat,lon,rain [mm],humidity [%]"
    body = [x for x in got if not x.startswith("datetime")]
    # at 01:00 both datasets have rain: the earlier dataset's stands
    assert body == ["2024-01-05 00:00:00,1,1.0,2.0,0.0,", "2024-01-05 01:00:00,1,1.0,2.0,1.0,70.0",
                    "2024-01-05 02:00:00,1,1.0,2.0,2.0,", "2024-01-05 03:00:00,1,1.0,2.0,3.0,"]
    catalog.answer(products(spark), ask("station", ["rain", "humidity"], "json"), path)
    doc = json.loads(lines(spark, path)[0])
    assert doc["units"] == {"rain": "mm", "humidity": "%"} and doc["geometry"]["coordinates"] == [2.0, 1.0]
    assert [d["datetime"][11:13] for d in doc["data"]] == ["00", "01", "02", "03"]
    assert doc["data"][1]["values"] == {"rain": 1.0, "humidity": 70.0} and doc["data"][0]["values"]["humidity"] is None


def test_members_in_each_format(spark, tmp_path):
    path = str(tmp_path / "out")
    for output, sep in (("csv", ","), ("ascii", "\t")):
        catalog.answer(products(spark), ask("seasonal", ["t"], output), path)
        rows = [x.split(sep) for x in lines(spark, path)]
        assert rows == [["datetime", "lat", "lon", "ensemble", "t"]] + [
            ["2024-01-05 00:00:00", "1.0", "2.0", str(m), str(10.0 + m)] for m in range(3)]
    catalog.answer(products(spark), ask("seasonal", ["t"], "json"), path)
    assert json.loads(lines(spark, path)[0])["data"] == [{"datetime": "2024-01-05 00:00:00", "values": {"t": [10.0, 11.0, 12.0]}}]


def test_unknown_requests_are_refused(spark, tmp_path):
    for wrong in (ask("nothing", ["rain"], "csv"), ask("station", ["depth"], "csv"), ask("station", ["rain"], "netcdf")):
        with pytest.raises(catalog.RequestError):
            catalog.answer(products(spark), wrong, str(tmp_path / "out"))
    empty = results.members_as_rows(results.shaped(products(spark)[2].table.limit(0).select(
        F.current_date().alias("date"), "lat", "lon", F.array("e").alias("t"))))
    assert empty.count() == 0


# conversion

def test_conversion_can_be_taken_up_again(spark, tmp_path):
    path = str(tmp_path / "wide")
    rows = [(s, dt.datetime(2024, m, d), a, float(m * 100 + d)) for s in (1, 2) for m in (1, 2, 3) for d in (1, 9) for a in ("x", "y")]
    narrow = spark.createDataFrame(rows, "station_id long, date_time timestamp_ntz, attribute string, value double")
    places = spark.createDataFrame([(1, 2.0, 1.0), (2, 40.0, 1.0)], "station_id long, lon double, lat double")
    done = tables.convert_observations(narrow, places, path, ["x"], "2024-01-01", "2024-03-01", use_month=True)
    assert done == ["2024-01-01", "2024-02-01"]
    tables.convert_observations(narrow, places, path, ["x"], "2024-02-01", "2024-03-01", use_month=True)    # again
    tables.append_between(narrow, places, path, ["x"], "2024-02-05", "2024-03-05", use_month=True)          # overlaps
    got = sorted((r.station_id, r.date_time, r.x) for r in spark.read.parquet(path).collect())
    assert got == sorted((s, t, v) for s, t, a, v in rows if a == "x" and t < dt.datetime(2024, 3, 5))


def test_headers_are_read_line_by_line(spark, tmp_path):
    (tmp_path / "A_1.csv").write_text("date,rain\n2024-01-02,1\n")
    (tmp_path / "B_1.csv").write_text("rain,date\r\n2,2024-01-02\r\n")
    (tmp_path / "my_stations.csv").write_text("code\nA\n")
    stations, rows = landed.station_directory(spark, str(tmp_path), ["rain"])
    assert sorted((r.station_code, r.value) for r in rows.collect()) == [("A", 1.0), ("B", 2.0)]
    assert landed.station_directory(spark, str(tmp_path), ["wind"])[1].count() == 0
