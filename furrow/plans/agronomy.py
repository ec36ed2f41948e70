"""Grid weather features, growing degree days and crop stages.

Everything is long form: one row per key and day. Work happens on distinct
grid-crop keys and is joined back to farms at the very end, and a group never
holds more than the days of one season.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions import dates, numeric, text

GRID_CROP = ["grid_id", "crop_id", "crop_stage_type_id", "planting_date"]


def _day(d: str) -> dt.date:
    return dt.date.fromisoformat(d)


def _shift(d: str, days: int) -> str:
    return (_day(d) + dt.timedelta(days=days)).isoformat()


def between_days(start: str, end: str, column: str = "date") -> Column:
    return F.col(column).between(F.lit(_day(start)), F.lit(_day(end)))


# ---- inputs ---------------------------------------------------------------

def registry_grids(registry: DataFrame, grid: DataFrame, country: DataFrame) -> DataFrame:
    """Distinct grids of the registry with centroid and country."""
    ids = registry.select("grid_id").distinct()
    return (grid.join(ids, "grid_id", "left_semi").join(country, "country_id")
            .select("grid_id", "lon", "lat", "iso_a3", "country_id"))


def registry_grid_crops(registry: DataFrame) -> DataFrame:
    """Distinct (grid, crop, stage type, planting date, previous stage) rows."""
    return (registry.select(*GRID_CROP, "prev_growth_stage_id", "prev_growth_stage_start_date",
                            "config_id")
            .distinct()
            .withColumn("planting_date_epoch", dates.to_epoch(F.col("planting_date")))
            .withColumn("grid_crop_key", text.grid_crop_key(
                F.col("crop_id"), F.col("crop_stage_type_id"), F.col("grid_id"))))


def registry_summary(registry: DataFrame) -> DataFrame:
    """Minimum planting date and number of distinct crops."""
    return registry.agg(F.min("planting_date").alias("min_planting_date"),
                        F.countDistinct("crop_id").alias("crops"))


def config_by_country(grids: DataFrame, overrides: DataFrame, default_id: int) -> DataFrame:
    """Country override of the configuration, else the default."""
    o = overrides.select("country_id", F.col("config_id").alias("_override"))
    return (grids.join(o, "country_id", "left")
            .withColumn("config_id", F.coalesce("_override", F.lit(default_id)).cast("int"))
            .drop("_override"))


def dense_days(keys: DataFrame, weather: DataFrame, start: str, end: str,
               on: str = "grid_id") -> DataFrame:
    """Every day of the range per key; days without data are null."""
    axis = F.sequence(F.lit(_day(start)), F.lit(_day(end)))
    return (keys.select(on).distinct().withColumn("date", F.explode(axis))
            .join(weather.where(between_days(start, end)), [on, "date"], "left"))


# ---- grid features --------------------------------------------------------

def _feature_aggregates(request_date: str) -> list[Column]:
    """Means over D..D+3 and totals over D-6..D+3 of a wider day range."""
    near = between_days(request_date, _shift(request_date, 3))
    wide = between_days(_shift(request_date, -6), _shift(request_date, 3))
    mid = (F.col("max_temperature") + F.col("min_temperature")) / 2
    total = lambda c: F.coalesce(F.sum(F.when(wide, F.col(c))), F.lit(0.0)).alias(c)
    return [F.avg(F.when(near, mid)).alias("temperature"),
            F.avg(F.when(near, F.col("humidity"))).alias("humidity"),
            total("total_rainfall"), total("total_evapotranspiration"),
            F.count_if(wide).alias("near_days")]


def grid_features(weather: DataFrame, request_date: str) -> DataFrame:
    """Per grid: mean mid-range temperature and humidity over D..D+3, rain and
    evapotranspiration totals over D-6..D+3 and their ratio.

    One conditional aggregation; a grid has ten rows in the window.
    """
    wide = weather.where(between_days(_shift(request_date, -6), _shift(request_date, 3)))
    out = wide.groupBy("grid_id").agg(*_feature_aggregates(request_date)).drop("near_days")
    return out.withColumn("p_pet", numeric.ratio(
        F.col("total_rainfall"), F.col("total_evapotranspiration")))


# ---- growing degree days --------------------------------------------------

def with_gdd_config(df: DataFrame, gdd_config: DataFrame) -> DataFrame:
    return df.join(gdd_config.select("crop_id", "config_id", "gdd_base", "gdd_cap"),
                   ["crop_id", "config_id"])


def daily_gdd(max_t: Column, min_t: Column, base: Column, cap: Column) -> Column:
    """Mid-range less base; the maximum is clipped above only, the minimum
    below only, so a value may be negative."""
    return (numeric.clip_above(max_t, cap) + numeric.clip_below(min_t, base)) / 2 - base


def gdd_series(grid_crops: DataFrame, weather: DataFrame, gdd_config: DataFrame,
               request_date: str) -> DataFrame:
    """Running degree days per grid-crop from the day after planting to D-1.

    Days without a value keep a null sum but do not break the running total.
    Weather is cut to the season before the join.
    """
    season = weather.where(F.col("date") < F.lit(_day(request_date))).select(
        "grid_id", "date", "max_temperature", "min_temperature")
    # the planting day itself is a null day: it can end no scan and adds nothing
    days = (with_gdd_config(grid_crops, gdd_config).join(season, "grid_id")
            .where(F.col("date") > F.col("planting_date"))
            .withColumn("gdd", daily_gdd(F.col("max_temperature"), F.col("min_temperature"),
                                         F.col("gdd_base"), F.col("gdd_cap"))))
    run = (Window.partitionBy(*GRID_CROP, "prev_growth_stage_id", "prev_growth_stage_start_date",
                              "config_id")
           .orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return days.withColumn(
        "gdd_sum", F.when(F.col("gdd").isNotNull(), F.sum("gdd").over(run)))


# ---- stages ---------------------------------------------------------------

def stage_thresholds(matrix: DataFrame) -> DataFrame:
    """The matrix as one sorted array per (crop, stage type, configuration).

    A crop has a handful of stages; the lookup then needs no range join.
    """
    step = F.struct(F.col("gdd_threshold").cast("double").alias("upper"),
                    F.col("growth_stage_id").alias("stage"))
    return matrix.groupBy("crop_id", "crop_stage_type_id", "config_id").agg(
        F.array_sort(F.collect_list(step)).alias("stages"))


def stage_of(gdd: Column, stages: Column, null_gdd: str = "last") -> Column:
    """struct(stage, lower) for a degree-day sum.

    The first threshold at or above the sum wins, with the threshold before it
    as lower bound; above all (or null, by default) it is the last stage with
    its own threshold as lower bound.
    """
    first = F.get(F.filter(stages, lambda s: gdd <= s["upper"]), 0)
    if null_gdd == "first":
        first = F.when(gdd.isNull(), F.get(stages, 0)).otherwise(first)
    below = F.filter(stages, lambda s: s["upper"] < first["upper"])
    lower = F.when(F.size(below) > 0, F.try_element_at(below, F.lit(-1))["upper"]).otherwise(F.lit(0.0))
    last = F.try_element_at(stages, F.lit(-1))
    return F.when(first.isNotNull(), F.struct(first["stage"].alias("stage"), lower.alias("lower"))
                  ).otherwise(F.struct(last["stage"].alias("stage"), last["upper"].alias("lower")))


def growth_stages(series: DataFrame, matrix: DataFrame, request_date: str,
                  grid_crops: DataFrame | None = None) -> DataFrame:
    """Stage and stage start of every grid-crop at D-1.

    The start is the day after the last day (before D-1) whose sum is at or
    under the lower threshold, else the planting date. One aggregation pass:
    the per-day sums of a season are folded into a sorted array (at most the
    days of the season) and scanned in place.

    ``grid_crops`` brings back keys without any season day, whose sum is null.
    """
    keys = [*GRID_CROP, "prev_growth_stage_id", "prev_growth_stage_start_date", "config_id"]
    last_day = F.lit(_day(_shift(request_date, -1)))
    folded = series.groupBy(*keys).agg(
        F.max(F.when(F.col("date") == last_day, F.col("gdd_sum"))).alias("total_gdd"),
        F.array_sort(F.collect_list(F.when(
            F.col("gdd_sum").isNotNull() & (F.col("date") < last_day),
            F.struct("date", "gdd_sum")))).alias("_days"))
    if grid_crops is not None:
        on = [F.col(f"k.{c}").eqNullSafe(F.col(f"f.{c}")) for c in keys]
        cond = on[0]
        for c in on[1:]:
            cond = cond & c
        folded = (grid_crops.select(*keys).distinct().alias("k")
                  .join(folded.alias("f"), cond, "left")
                  .select(*[F.col(f"k.{c}") for c in keys], "f.total_gdd", "f._days"))
    looked = (folded.join(stage_thresholds(matrix), ["crop_id", "crop_stage_type_id", "config_id"], "left")
              .withColumn("_s", F.when(F.col("stages").isNotNull(),
                                       stage_of(F.col("total_gdd"), F.col("stages")))))
    under = F.filter("_days", lambda d: d["gdd_sum"] <= F.col("_s.lower"))
    stage, start = _stage_and_start(F.try_element_at(under, F.lit(-1))["date"])
    return looked.select(*keys, "total_gdd", stage.alias("growth_stage_id"),
                         start.alias("growth_stage_start_date"))


def _stage_and_start(last_under: Column) -> list[Column]:
    """Stage id and stage start (epoch) from ``_s`` and the last day at or
    under the lower threshold."""
    stage, lower = F.col("_s.stage"), F.col("_s.lower")
    planted = dates.to_epoch(F.col("planting_date"))
    kept = F.col("_s").isNull() | F.coalesce(stage == F.col("prev_growth_stage_id"), F.lit(False))
    start = (F.when(kept, F.col("prev_growth_stage_start_date"))
             .when(lower == 0, planted)
             .when(last_under.isNotNull(), dates.to_epoch(F.date_add(last_under, 1)))
             .otherwise(planted))
    return [F.when(F.col("_s").isNull(), F.col("prev_growth_stage_id")).otherwise(stage).cast("int"),
            start.cast("long")]


# ---- rainfall -------------------------------------------------------------

def rain_since(df: DataFrame, weather: DataFrame, keys: list[str], since_epoch: str,
               request_date: str, out: str) -> DataFrame:
    """Rain per key from a start day (inclusive) to D+3; nothing measured is 0.

    A null start counts every day. The rain of a grid is reduced once to an array
    of its days and folded per row, so ``df`` is computed once and days are not
    multiplied by starts.
    """
    last = F.lit(_day(_shift(request_date, 3)))
    rain = (weather.where((F.col("date") <= last) & F.col("total_rainfall").isNotNull()).groupBy("grid_id")
            .agg(F.collect_list(F.struct(dates.to_epoch(F.col("date")).alias("at"), "total_rainfall")).alias("_rain")))
    since = F.col(f"d.{since_epoch}")
    total = F.aggregate("r._rain", F.lit(0.0), lambda acc, d: acc + F.when(
        since.isNull() | (d["at"] >= since), d["total_rainfall"]).otherwise(F.lit(0.0)))
    return (df.alias("d").join(rain.alias("r"), F.col("d.grid_id") == F.col("r.grid_id"), "left")
            .select("d.*", F.coalesce(total, F.lit(0.0)).alias(out)))


def with_climate(df: DataFrame, features: DataFrame) -> DataFrame:
    return df.join(features.select("grid_id", "temperature", "humidity", "p_pet"), "grid_id")


# ---- grid-crop features ---------------------------------------------------

def season_by_grid(weather: DataFrame, request_date: str, first_day: str) -> DataFrame:
    """One row per grid: climate features and the season as a sorted array.

    ``weather`` holds one row per grid and day, so an array has the days from
    ``first_day`` (the registry's minimum planting date) to D+3.
    """
    first = min(first_day, _shift(request_date, -6))
    day = F.struct("date", "max_temperature", "min_temperature", "total_rainfall")
    rows = weather.where(between_days(first, _shift(request_date, 3)))
    in_season = between_days(first_day, _shift(request_date, 3))
    seasons = rows.groupBy("grid_id").agg(
        F.array_sort(F.collect_list(F.when(in_season, day))).alias("season"),
        *_feature_aggregates(request_date))
    return seasons.where("near_days > 0").withColumn("p_pet", numeric.ratio(
        F.col("total_rainfall"), F.col("total_evapotranspiration"))).drop("near_days")


def grid_crop_features(grid_crops: DataFrame, weather: DataFrame, gdd_config: DataFrame,
                       matrix: DataFrame, request_date: str, first_day: str) -> DataFrame:
    """Degree days, stage, stage start, rain and climate of every grid-crop.

    The weather of a grid is reduced once to an array of the season's days and
    joined to its crops; everything per crop is a fold over that array. Days
    are never multiplied by crops, so the only shuffles are one aggregation of
    the weather and one join on grid_id. ``gdd_series``, ``growth_stages`` and
    ``rain_since`` give the same results in long form, day by day.
    """
    yesterday = F.lit(_day(_shift(request_date, -1)))
    planted = F.col("planting_date")

    def gdd(d: Column) -> Column:
        counted = (d["date"] > planted) & (d["date"] <= yesterday)
        return F.when(counted, daily_gdd(d["max_temperature"], d["min_temperature"],
                                         F.col("gdd_base"), F.col("gdd_cap")))

    # per day struct(date, gdd), only days that count
    days = F.filter(F.transform("season", lambda d: F.struct(d["date"].alias("date"), gdd(d).alias("g"))),
                    lambda d: d["g"].isNotNull())
    total = F.when(F.try_element_at("_g", F.lit(-1))["date"] == yesterday,
                   F.aggregate("_g", F.lit(0.0), lambda acc, d: acc + d["g"]))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("date").alias("under"))

    def scan(acc: Column, d: Column) -> Column:
        run = acc["sum"] + d["g"]
        under = (run <= F.col("_s.lower")) & (d["date"] < yesterday)
        return F.struct(run.alias("sum"), F.when(under, d["date"]).otherwise(acc["under"]).alias("under"))

    def rain_from(epoch: Column) -> Column:
        counts = lambda d: epoch.isNull() | (dates.to_epoch(d["date"]) >= epoch)
        return F.aggregate("season", F.lit(0.0), lambda acc, d: acc + F.when(
            counts(d), F.coalesce(d["total_rainfall"], F.lit(0.0))).otherwise(F.lit(0.0)))

    seasons = season_by_grid(weather, request_date, first_day)
    keyed = with_gdd_config(grid_crops.select(*GRID_CROP, "prev_growth_stage_id",
                                              "prev_growth_stage_start_date", "config_id"), gdd_config)
    looked = (keyed.join(stage_thresholds(matrix), ["crop_id", "crop_stage_type_id", "config_id"], "left")
              .join(seasons, "grid_id")
              .withColumn("_g", days).withColumn("total_gdd", total)
              .withColumn("_s", F.when(F.col("stages").isNotNull(),
                                       stage_of(F.col("total_gdd"), F.col("stages"))))
              .withColumn("_under", F.aggregate("_g", start, scan)["under"]))
    staged = looked.withColumns({
        "planting_date_epoch": dates.to_epoch(planted),
        **dict(zip(("growth_stage_id", "growth_stage_start_date"), _stage_and_start(F.col("_under"))))})
    return staged.withColumns({
        "seasonal_precipitation": rain_from(F.col("planting_date_epoch")),
        "growth_stage_precipitation": rain_from(F.col("growth_stage_start_date")),
    }).select(*GRID_CROP, "planting_date_epoch", "prev_growth_stage_id", "prev_growth_stage_start_date",
              "config_id", "total_gdd", "growth_stage_id", "growth_stage_start_date",
              "seasonal_precipitation", "growth_stage_precipitation", "temperature", "humidity", "p_pet")


# ---- audit ----------------------------------------------------------------

def crop_parameters(crops: DataFrame, lookup: DataFrame, name: str = "crop") -> DataFrame:
    """Base and cap of the first lookup key (by order) contained in the crop name.

    The lookup is a short configuration list, folded to one array so that no
    row-by-row join is needed.
    """
    folded = lookup.agg(F.array_sort(F.collect_list(
        F.struct("order", "key", "base", "cap"))))
    hit = lambda l, n: F.get(F.filter(l, lambda k: F.contains(F.lower(n), k["key"])), 0)
    return (crops.select("*", folded.scalar().alias("_l"))
            .withColumn("_h", hit(F.col("_l"), F.col(name)))
            .withColumn("gdd_base", F.col("_h.base")).withColumn("gdd_cap", F.col("_h.cap"))
            .drop("_l", "_h"))


def gdd_audit(weather: DataFrame, crops: DataFrame, lookup: DataFrame, planting: str,
              current: str) -> DataFrame:
    """Daily and running degree days of each (location, crop) from planting to D+3."""
    rows = weather.where(between_days(planting, _shift(current, 3)))
    days = crop_parameters(crops, lookup).join(rows, "grid_id")
    first = F.col("date") == F.lit(_day(planting))
    days = days.withColumn("gdd", F.when(~first, daily_gdd(
        F.col("max_temperature"), F.col("min_temperature"), F.col("gdd_base"), F.col("gdd_cap"))))
    run = (Window.partitionBy("grid_id", "crop").orderBy("date")
           .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return days.withColumn("gdd_sum", F.when(F.col("gdd").isNotNull(), F.sum("gdd").over(run)))
