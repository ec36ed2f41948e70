"""Scalar expressions on hand-checked values."""

import datetime as dt
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from furrow.functions import dates, geo, numeric, text
from furrow.plans import cropplan
from furrow.schema import check_columns, first_present


def one(spark, col, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(col.alias("v")).first().v


def test_leap_years(spark):
    df = spark.createDataFrame([(y,) for y in (2023, 2024, 2025, 1900, 1903, 2000, 2001)], "y int")
    assert [r.v for r in df.select(dates.closest_leap_year(F.col("y")).alias("v")).collect()] == [2020, 2024, 2024, 1896, 1896, 2000, 2000]


def test_previous_weekday(spark):
    d = F.to_date(F.lit("2025-09-17"))  # a Wednesday
    assert one(spark, dates.previous_weekday(d, 3)) == dt.date(2025, 9, 11)
    assert one(spark, dates.previous_weekday(d, 2)) == dt.date(2025, 9, 10)
    assert one(spark, dates.previous_weekday(d, 1)) == dt.date(2025, 9, 16)


def test_file_times(spark):
    assert one(spark, dates.target_time_from_name(F.lit("nowcast_1754434800_900.tif"))) == 1754435700
    assert one(spark, dates.target_time_from_name(F.lit("graphcast_1754434800_6.tif"))) == 1754434800 + 21600
    assert one(spark, dates.target_time_from_name(F.lit("other_1_2.tif"))) is None


def test_mixed_dates(spark):
    assert one(spark, dates.parse_mixed_date(F.lit("3/7/24"))) == dt.date(2024, 3, 7)
    assert one(spark, dates.parse_mixed_date(F.lit("2024-03-07"))) == dt.date(2024, 3, 7)
    assert one(spark, dates.parse_mixed_date(F.lit("soon"))) is None


def test_month_names(spark):
    d = F.to_date(F.lit("2025-01-31"))
    assert one(spark, dates.month_name(d)) == "January"
    assert one(spark, dates.previous_month_name(d)) == "December"


def test_dms(spark):
    p = geo.point_from_text(F.lit("""0°30'36.5"N 36°15'0.0"E"""))
    assert one(spark, p["lat"]) == pytest.approx(0.5101388889)
    assert one(spark, p["lon"]) == pytest.approx(36.25)
    s = geo.point_from_text(F.lit("""1°30'0"S 36°0'0"W"""))
    assert (one(spark, s["lat"]), one(spark, s["lon"])) == (-1.5, -36.0)
    q = geo.point_from_text(F.lit("-1.29, 36.8"))
    assert (one(spark, q["lat"]), one(spark, q["lon"])) == (-1.29, 36.8)
    assert one(spark, geo.point_from_text(F.lit("nowhere"))) is None
    assert one(spark, geo.decimal_to_dms(F.lit(-1.5), "N", "S")) == """1°30'0.0"S"""


def test_geohash(spark):
    # published example: 57.64911, 10.40744 -> u4pruydqqvj
    assert one(spark, geo.geohash(F.lit(10.40744), F.lit(57.64911), 8)) == "u4pruydq"


def test_haversine(spark):
    d = one(spark, geo.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)))
    assert d == pytest.approx(111195.08, abs=0.1)


def test_z_key_order(spark):
    assert one(spark, geo.z_key(F.lit(-180.0), F.lit(-90.0))) == 0
    assert one(spark, geo.z_key(F.lit(180.0), F.lit(90.0))) == (1 << 32) - 1
    assert one(spark, geo.z_key(F.lit(0.0), F.lit(-90.0))) == 1 << 30


def test_normal_tail(spark):
    zs = [-9.0, -6.0, -3.6, -3.4, -2.0, -0.5, 0.0, 0.3, 1.0, 3.49, 3.51, 5.0, 8.0]
    df = spark.createDataFrame([(z,) for z in zs], "z double")
    got = [r.v for r in df.select(numeric.normal_cdf(F.col("z")).alias("v")).collect()]
    for z, v in zip(zs, got):
        assert v == pytest.approx(NormalDist().cdf(z), abs=1e-12)


def test_exceedance_is_strict(spark):
    at = lambda m: one(spark, numeric.exceeds_with(F.lit(m), F.lit(1.0), F.lit(0.0), 0.5))
    assert (at(0.0), at(0.001), at(-0.001)) == (False, True, False)
    assert one(spark, numeric.exceeds_with(F.lit(1.0), F.lit(0.0), F.lit(0.0), 0.5)) is None


def test_ratio_and_rule_value(spark):
    r = lambda a, b: one(spark, numeric.ratio(F.lit(a), F.lit(b)))
    assert (r(3.0, 2.0), r(1.0, 0.0), r(0.0, 0.0)) == (1.5, 999999.0, None)
    v = lambda x: one(spark, numeric.rule_value(x))
    assert v(F.lit(float("nan"))) == 0.0 and v(F.lit(float("-inf"))) == 999999.0 and v(F.lit(None).cast("double")) == 0.0


def test_rain_classes(spark):
    for amount, cls in ((0.0, 1), (0.5, 1), (3.0, 2), (4.0, 3), (11.0, 4), (21.0, 5)):
        assert one(spark, cropplan.rain_class(F.lit(amount), "id")) == cls
    assert one(spark, cropplan.rain_class(F.lit(None).cast("double"))) is None


def test_text(spark):
    assert one(spark, text.mask_keys(F.lit("x?apikey=abc&b=1"))) == "x?apikey=***&b=1"
    assert one(spark, text.mask_keys(F.lit("no key here"))) == "no key here"
    assert one(spark, text.fill_template(F.lit("a {{ x }} b"), {"x": F.lit("$1\\")})) == "a $1\\ b"
    assert one(spark, text.split_crop_stage(F.lit("Maize_Medium")))["stage"] == "Mid"
    assert one(spark, text.unwrap_single(F.array(F.lit(3)))) == 3


def test_significant(spark):
    s = lambda v: one(spark, numeric.significant(F.lit(v)))
    for v in (123456.789, 0.000123456789, -98765.4321, 1.0, 0.0, 2.5e10):
        assert s(v) == pytest.approx(float("%g" % v), rel=1e-12)


def test_columns(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    with pytest.raises(ValueError, match="code"):
        check_columns(df, ["a", "code"])
    with pytest.raises(ValueError):
        first_present(df, ["x", "y"])


def test_layout():
    rows = cropplan.layout(["worm"], ["rainAccumulationSum", "temperatureMax"])
    by = {r["field"]: r for r in rows}
    assert rows[0]["field"] == "farmID" and len([r for r in rows if r["field"].startswith("pest_worm_")]) == 5
    assert by["day3_rainAccumulationSum"]["label"] == "day3_mm"
    assert not by["day3_temperatureMax"]["active"] and by["decision_sm25"]["active"] is False
