"""Advisory operators against the known small cases."""

import datetime as dt
import math

from pyspark.sql import functions as F

from furrow.functions import dates
from furrow.plans import advisory, agronomy

KEYS = "grid_id int, crop_id int, crop_stage_type_id int, planting_date date, prev_growth_stage_id int, prev_growth_stage_start_date long, config_id int"


def day(n):
    return dt.date(1970, 1, 1) + dt.timedelta(days=n)


def matrix(spark, crop=2):
    rows = [(crop, 2, 1, 1, 200.0), (crop, 2, 1, 2, 440.0), (crop, 2, 1, 13, 700.0)]
    return spark.createDataFrame(rows, "crop_id int, crop_stage_type_id int, config_id int, growth_stage_id int, gdd_threshold double")


def stage(spark, sums, planting=123, prev=None, prev_start=None, crop=2, first=123):
    """Stage of a series of running sums on consecutive days; the last is D-1."""
    keys = (1, crop, 2, day(planting), prev, prev_start, 1)
    rows = [(*keys, day(first + i), s) for i, s in enumerate(sums)]
    series = spark.createDataFrame(rows, KEYS + ", date date, gdd_sum double")
    request = day(first + len(sums)).isoformat()
    out = agronomy.growth_stages(series, matrix(spark), request).collect()
    assert len(out) == 1
    start = out[0].growth_stage_start_date
    return out[0].growth_stage_id, None if start is None else start // 86400


def test_stage_without_matrix_is_kept(spark):
    assert stage(spark, [10.0, 20.0], crop=77, prev=111, prev_start=111 * 86400) == (111, 111)


def test_stage_unchanged_keeps_start(spark):
    assert stage(spark, [420.0, 440.0], prev=2, prev_start=111 * 86400) == (2, 111)


def test_stage_found(spark):
    assert stage(spark, [420.0, 440.0, 450.0, 490.0]) == (13, 125)


def test_stage_nothing_under_threshold(spark):
    assert stage(spark, [410.0, 400.0, 420.0, 440.0]) == (2, 123)


def test_stage_single_day(spark):
    assert stage(spark, [450.0]) == (13, 123)


def test_stage_starts_at_planting(spark):
    assert stage(spark, [None, 440.0], planting=124) == (2, 124)


def test_stage_above_all_and_null(spark):
    # above all thresholds: last stage, its own threshold as lower bound
    assert stage(spark, [690.0, 701.0, 720.0]) == (13, 124)
    df = spark.createDataFrame([(None,), (440.0,), (441.0,), (9999.0,)], "g double").crossJoin(
        agronomy.stage_thresholds(matrix(spark)).select("stages"))
    s = agronomy.stage_of(F.col("g"), F.col("stages"))
    got = [tuple(r) for r in df.select(s["stage"], s["lower"]).collect()]
    assert got == [(13, 700.0), (2, 200.0), (13, 440.0), (13, 700.0)]
    first = agronomy.stage_of(F.col("g"), F.col("stages"), "first")
    assert df.where("g is null").select(first["stage"]).first()[0] == 1


def test_gdd_config(spark):
    df = spark.createDataFrame([(2, 1), (10, 1)], "crop_id int, config_id int")
    cfg = spark.createDataFrame([(2, 1, 10.0, 35.0), (10, 1, 12.0, 35.0)], "crop_id int, config_id int, gdd_base double, gdd_cap double")
    got = {r.crop_id: (r.gdd_base, r.gdd_cap) for r in agronomy.with_gdd_config(df, cfg).collect()}
    assert got == {2: (10.0, 35.0), 10: (12.0, 35.0)}


def test_rain_since(spark):
    df = spark.createDataFrame([(1, 86400, 1), (2, 2 * 86400, 2), (1, 86400, 3)], "grid_id int, start long, row int")
    w = spark.createDataFrame([(1, day(1), 10.0), (1, day(2), 13.0), (2, day(1), 12.0), (2, day(2), 14.0)],
                              "grid_id int, date date, total_rainfall double")
    out = agronomy.rain_since(df, w, [], "start", day(3).isoformat(), "rain")
    assert [r.rain for r in out.orderBy("row").collect()] == [23.0, 14.0, 23.0]


def test_climate_join(spark):
    df = spark.createDataFrame([(1,), (2,), (9,)], "grid_id int")
    f = spark.createDataFrame([(1, 10.0, 13.0, 15.0), (2, 12.0, 14.0, 16.0)], "grid_id int, temperature double, humidity double, p_pet double")
    got = sorted(tuple(r) for r in agronomy.with_climate(df, f).collect())
    assert got == [(1, 10.0, 13.0, 15.0), (2, 12.0, 14.0, 16.0)]


def _weather(spark, n=40, first=100):
    rows = []
    for g in (1, 2):
        for i in range(n):
            if (i * 7 + g) % 9 == 0:
                continue  # a missing day
            rows.append((g, day(first + i), 20.0 + (i * 5 + g) % 20, 5.0 + (i * 3 + g) % 12, float((i + g) % 4), float(i % 3), 50.0 + i % 7))
    return spark.createDataFrame(rows, "grid_id int, date date, max_temperature double, min_temperature double, total_rainfall double, total_evapotranspiration double, humidity double")


def test_folded_features_equal_long_form(spark):
    w = _weather(spark)
    keys = [(g, 2, 2, day(100 + p), prev, None if prev is None else (100 + p) * 86400, 1)
            for g in (1, 2) for p in (0, 3, 8, 20, 35) for prev in (None, 2)]
    gc = spark.createDataFrame(keys, KEYS)
    cfg = spark.createDataFrame([(2, 1, 9.0, 30.0)], "crop_id int, config_id int, gdd_base double, gdd_cap double")
    request = day(136).isoformat()
    folded = agronomy.grid_crop_features(gc, w, cfg, matrix(spark), request, day(100).isoformat())
    series = agronomy.gdd_series(gc, w, cfg, request)
    staged = agronomy.growth_stages(series, matrix(spark), request, gc)
    staged = staged.withColumn("planting_date_epoch", dates.to_epoch(F.col("planting_date")))
    long = agronomy.rain_since(staged, w, [], "planting_date_epoch", request, "seasonal_precipitation")
    long = agronomy.rain_since(long, w, [], "growth_stage_start_date", request, "growth_stage_precipitation")
    long = agronomy.with_climate(long, agronomy.grid_features(w, request))
    cols = sorted(folded.columns)
    rows = lambda d: sorted((tuple(r) for r in d.select(*cols).collect()), key=repr)
    assert rows(folded) == rows(long) and len(rows(folded)) == len(keys)


def test_features_by_plain_python(spark):
    w = _weather(spark)
    data = {(r.grid_id, r.date): r for r in w.collect()}
    request, planted, base, cap = day(136), day(103), 9.0, 30.0
    gc = spark.createDataFrame([(1, 2, 2, planted, None, None, 1)], KEYS)
    cfg = spark.createDataFrame([(2, 1, base, cap)], "crop_id int, config_id int, gdd_base double, gdd_cap double")
    got = agronomy.grid_crop_features(gc, w, cfg, matrix(spark), request.isoformat(), day(100).isoformat()).first()
    total, d = 0.0, planted + dt.timedelta(days=1)
    while d < request:
        r = data.get((1, d))
        if r:
            total += (min(r.max_temperature, cap) + max(r.min_temperature, base)) / 2 - base
        d += dt.timedelta(days=1)
    rain = sum(r.total_rainfall for (g, x), r in data.items() if g == 1 and planted <= x <= request + dt.timedelta(days=3))
    near = [r for (g, x), r in data.items() if g == 1 and request <= x <= request + dt.timedelta(days=3)]
    last = (1, request - dt.timedelta(days=1)) in data
    assert got.total_gdd == (total if last else None)
    assert got.seasonal_precipitation == rain
    assert math.isclose(got.temperature, sum((r.max_temperature + r.min_temperature) / 2 for r in near) / len(near))


RULE = "rule_id int, config_id int, crop_id int, crop_stage_type_id int, growth_stage_id int, parameter string, min_range double, max_range double, code int"


def test_rules(spark):
    rules = spark.createDataFrame([(1, 1, 8, 1, 7, "p_pet", 0.0, 0.96, 202400000), (2, 1, 8, 1, 7, "p_pet", 0.96, 1.2, 202400001)], RULE)
    prio = spark.createDataFrame([(1, 202400000, 3)], "config_id int, code int, priority int")
    vals = [0.5, 999.0, float("nan"), float("inf"), 0.96, 1.2, None]
    df = spark.createDataFrame([(i, 1, 8, 1, 7, None, None, v, None, None) for i, v in enumerate(vals)],
                               "i int, config_id int, crop_id int, crop_stage_type_id int, growth_stage_id int, temperature double, humidity double, p_pet double, growth_stage_precipitation double, seasonal_precipitation double")
    got = [r.codes for r in advisory.with_codes(df, rules, prio).orderBy("i").collect()]
    assert got == [[202400000], [], [202400000], [], [202400001], [], [202400000]]


def test_rule_overlaps_and_lowest_id(spark):
    rules = spark.createDataFrame([(5, 1, 1, 1, 1, "humidity", 0.0, 10.0, 50), (2, 1, 1, 1, 1, "humidity", 5.0, 20.0, 20), (9, 1, 1, 1, 1, "humidity", 20.0, 30.0, 90)], RULE)
    assert [r.rule_id for r in advisory.overlapping_rules(rules).collect()] == [2]
    prio = spark.createDataFrame([], "config_id int, code int, priority int")
    df = spark.createDataFrame([(1, 1, 1, 1, None, 7.0, None, None, None)],
                               "config_id int, crop_id int, crop_stage_type_id int, growth_stage_id int, temperature double, humidity double, p_pet double, growth_stage_precipitation double, seasonal_precipitation double")
    assert advisory.with_codes(df, rules, prio).first().codes == [20]


SLOTS = "message int, message_2 int, message_3 int, message_4 int, message_5 int"


def test_message_slots(spark):
    def run(codes, prev):
        df = spark.createDataFrame([(codes, prev)], "codes array<int>, prev_week_message int")
        return advisory.final_message(advisory.to_slots(df)).first()
    a = run([1001, 1002], None)
    assert (a.message, a.message_2, a.final_message, a.is_empty_message, a.has_repetitive_message) == (1001, 1002, 1001, False, False)
    b = run([], None)
    assert b.is_empty_message and b.final_message is None
    c = run([1001, 1002], 1001)
    assert c.has_repetitive_message and c.final_message == 1002
    d = run([1001], 1001)
    assert d.has_repetitive_message and d.final_message == 1001


def test_last_sent(spark):
    t = lambda d: dt.datetime(2025, 1, d)
    rows = [(1, 100, 7, None, None, None, None, t(1)), (1, 100, None, 7, None, None, None, t(5)), (1, 100, None, None, 8, None, None, t(3)),
            (1, 100, None, None, None, None, 8, t(9)), (2, 100, 7, None, None, None, None, t(8)), (1, 101, 7, None, None, None, None, t(7))]
    h = spark.createDataFrame(rows, f"farm_id int, crop_id int, {SLOTS}, message_date timestamp_ntz")
    got = {(r.farm_id, r.crop_id, r.code): r.last_date.day for r in advisory.last_sent(h).collect()}
    assert got == {(1, 100, 7): 5, (1, 100, 8): 9, (2, 100, 7): 8, (1, 101, 7): 7}
    assert (1, 100, 9) not in got


def test_suppress_within_two_weeks(spark):
    now = dt.datetime(2025, 3, 1)
    new = spark.createDataFrame([(1, 5, 100, None, None, None, None), (2, 5, 100, None, None, None, None), (3, 5, 200, None, None, None, None)],
                                f"farm_id int, crop_id int, {SLOTS}")
    hist = spark.createDataFrame([(1, 5, None, 100, None, None, None, now - dt.timedelta(weeks=1)),
                                  (2, 5, 100, None, None, None, None, now - dt.timedelta(weeks=3)),
                                  (3, 5, 100, None, None, None, None, now - dt.timedelta(weeks=1))], f"farm_id int, crop_id int, {SLOTS}, message_date timestamp_ntz")
    got = {r.farm_id: r.message for r in advisory.suppress_recent(new, hist, now.isoformat(), 2).collect()}
    assert got == {1: None, 2: 100, 3: 200}


def test_farm_merge(spark):
    farms = spark.createDataFrame([(2, 1, 1, 99, 10, "a"), (3, 1, 2, 99, 11, "b"), (4, 1, 1, 99, 12, "c")],
                                  "crop_id int, grid_id int, crop_stage_type_id int, planting_date_epoch long, farm_id int, note string")
    res = spark.createDataFrame([(2, 1, 1, 99, 7), (3, 1, 2, 99, 8), (9, 9, 9, 99, 8)],
                                "crop_id int, grid_id int, crop_stage_type_id int, planting_date_epoch long, growth_stage_id int")
    labels = spark.createDataFrame([(7, "Seedling"), (8, "Flowering")], "growth_stage_id int, growth_stage string")
    got = {r.farm_id: r.growth_stage for r in advisory.farm_advisory(farms, res, labels).collect()}
    assert got == {10: "Seedling", 11: "Flowering"}


def test_country_config(spark):
    grids = spark.createDataFrame([(1, 10), (2, 20)], "grid_id int, country_id int")
    over = spark.createDataFrame([(20, 7)], "country_id int, config_id int")
    got = {r.grid_id: r.config_id for r in agronomy.config_by_country(grids, over, 1).collect()}
    assert got == {1: 1, 2: 7}


def test_previous_messages_without_column(spark):
    a = spark.createDataFrame([(1, 1, 1, 5)], "grid_id int, crop_id int, crop_stage_type_id int, planting_date_epoch long")
    assert advisory.previous_messages(a).count() == 0


def test_previous_message_prefers_priority(spark):
    a = spark.createDataFrame([(1, 1, 1, 5, 1, 30), (1, 1, 1, 5, 1, 20), (1, 1, 1, 5, 1, 10)],
                              "grid_id int, crop_id int, crop_stage_type_id int, planting_date_epoch long, config_id int, final_message int")
    p = spark.createDataFrame([(1, 20, 4), (1, 30, 4)], "config_id int, code int, priority int")
    assert advisory.previous_messages(a, p).first().prev_week_message == 20
    assert advisory.previous_messages(a).first().prev_week_message == 10


def test_unknown_export_column(spark):
    import pytest
    with pytest.raises(ValueError):
        advisory.export_columns(spark.range(1), ["no_such_column"])
