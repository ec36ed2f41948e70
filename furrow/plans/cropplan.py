"""Wide per-farm crop plan and its column layout."""

from __future__ import annotations

import datetime as dt
import re
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions import numeric, text

#: fixed values: plan columns
DEFAULT_FIELDS = ["farmID", "phoneNumber", "latitude", "longitude", "SPWTopMessage",
                  "SPWDescription", "TooWet", "last_4_days_mm", "last_2_days_mm",
                  "today_tomorrow_mm"]
FORECAST_USED = ["rainAccumulationSum", "precipitationProbability", "rainAccumulationType"]
LABELS = {"rainAccumulationSum": "mm", "rainAccumulationType": "Type",
          "precipitationProbability": "Chance"}
DECISION_COLUMNS = ["spw20", "spw40", "spw60", "sm25", "sm50", "sm70"]
FORECAST_DAYS = 13
MESSAGES_PER_PEST = 5
#: fixed values: rainfall classes (id, name, lower, upper); bounds inclusive
RAIN_CLASSES = [(1, "No Rain", None, 0.5), (2, "Minimal rain", 0.5, 3.0), (3, "Light rain", 3.0, 10.0),
                (4, "Moderate rain", 10.0, 20.0), (5, "Heavy rain", 20.0, None)]


def rain_class(amount: Column, what: str = "name") -> Column:
    """Class of a rain amount; at a shared bound the lower class wins."""
    out = None
    for cid, name, lo, hi in RAIN_CLASSES:
        cond = amount.isNotNull()
        if lo is not None:
            cond = cond & (amount >= lo)
        if hi is not None:
            cond = cond & (amount <= hi)
        value = F.lit(name if what == "name" else cid)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out


def classify(df: DataFrame, classes: DataFrame, amount: str) -> DataFrame:
    """Class from a lookup table (class_id, name, min_value, max_value).

    The table is folded to one array, so no range join is needed.
    """
    folded = classes.agg(F.array_sort(F.collect_list(F.struct(
        "class_id", "name", "min_value", "max_value"))))
    hit = F.get(F.filter("_c", lambda c: (
        (c["min_value"].isNull() | (F.col(amount) >= c["min_value"]))
        & (c["max_value"].isNull() | (F.col(amount) <= c["max_value"])))), 0)
    return (df.select("*", folded.scalar().alias("_c"))
            .withColumn("class_id", hit["class_id"]).withColumn("class_name", hit["name"])
            .drop("_c"))


def layout(pests: list[str], forecast_fields: list[str],
           decision_prefix: str = "decision_", pest_prefix: str = "pest_") -> list[dict]:
    """Column layout of a group: default, forecast, pest and decision columns.

    A plan has few hundred columns, made by rule: day1_..day13_ fields, five
    messages per pest. A field asked for twice keeps its last position.
    """
    days, numbers = range(1, FORECAST_DAYS + 1), range(1, MESSAGES_PER_PEST + 1)
    families = [  # prefix, name parts, parts shown by default
        ("", product(DEFAULT_FIELDS), DEFAULT_FIELDS),
        ("day", product(days, [*FORECAST_USED, *forecast_fields]), FORECAST_USED),
        (pest_prefix, product(pests, numbers), []),
        (decision_prefix, product(DECISION_COLUMNS), []),
    ]
    fields = [(prefix + "_".join(map(str, parts)), parts[-1] in shown, prefix == "day")
              for prefix, names, shown in families for parts in names]
    last = {field: (n, shown, short) for n, (field, shown, short) in enumerate(fields, 1)}
    return [{"field": field, "column_number": n, "label": short_label(field) if short else None, "active": shown}
            for field, (n, shown, short) in sorted(last.items(), key=lambda item: item[1][0])]


def short_label(field: str) -> str | None:
    """A field with its long names shortened; None where there is none."""
    label = re.sub("|".join(LABELS), lambda m: LABELS[m[0]], field)
    return label if label != field else None


def apply_layout(plan: DataFrame, rows: list[dict], labels: bool = True) -> DataFrame:
    """Active columns in column order, under their labels; absent ones are empty."""
    active = sorted((r for r in rows if r["active"]), key=lambda r: r["column_number"])
    have = set(plan.columns)
    return plan.select(*[
        (F.col(r["field"]) if r["field"] in have else F.lit(None).cast("string")).alias(
            r["label"] if labels and r["label"] else r["field"]) for r in active])


def forecast_days(forecast: DataFrame, farm: str = "farm_id", date: str = "value_date") -> DataFrame:
    """Adds ``day_n``: day number counted from the farm's first forecast date."""
    first = forecast.groupBy(farm).agg(F.min(date).alias("_first"))
    return (forecast.join(first, farm)
            .withColumn("day_n", F.date_diff(F.col(date), F.col("_first")) + 1).drop("_first"))


def by_name(entry: Column) -> Column:
    """Aggregate: map of the (k, v) entries of a group that aren't null, in order of k."""
    return F.map_from_entries(F.array_sort(F.collect_list(entry)))


def forecast_wide(forecast: DataFrame, fields: list[str], days: int = FORECAST_DAYS) -> DataFrame:
    """One row per farm with day{n}_{field} columns, rain class included.

    Aggregation with conditional picks: the number of output columns is fixed
    (days × fields), so no distinct pass is needed to find pivot values. Values
    come long, (farm_id, forecast rows: value_date, field, value). The columns are
    the days a layout shows; ``forecast_values`` maps every day, as
    day{n}_{field}, to its value, rain classes in ``forecast_classes``.
    """
    numbered = forecast_days(forecast.where(F.col("field").isin(fields)))
    # one value a day and field, as the columns take it
    numbered = numbered.groupBy("farm_id", "day_n", "field").agg(F.max("value").alias("value"))
    picks = [F.max(F.when((F.col("day_n") == n) & (F.col("field") == f), F.col("value")))
             .alias(f"day{n}_{f}") for n in range(1, days + 1) for f in fields]
    name = lambda field: F.concat(F.lit("day"), F.col("day_n").cast("string"), F.lit("_"), field)
    numbered_day = F.col("day_n").isNotNull() & F.col("field").isNotNull()
    every = [by_name(F.when(numbered_day, F.struct(name(F.col("field")).alias("k"), F.col("value").alias("v")))).alias("forecast_values")]
    if "rainAccumulationSum" in fields:
        rain = numbered_day & (F.col("field") == "rainAccumulationSum")
        every.append(by_name(F.when(rain, F.struct(name(F.lit("rainAccumulationType")).alias("k"), rain_class(F.col("value")).alias("v")))).alias("forecast_classes"))
    wide = numbered.groupBy("farm_id").agg(*picks, *every)
    if "rainAccumulationSum" in fields:
        wide = wide.withColumns({
            f"day{n}_rainAccumulationType": rain_class(F.col(f"day{n}_rainAccumulationSum"))
            for n in range(1, days + 1)})
    return wide


def pest_wide(messages: DataFrame, pests: dict[int, str], prefix: str = "pest_") -> DataFrame:
    """Messages as columns, the five per pest that a layout shows, and all of them in
    ``pest_messages``, a map from {prefix}{name}_{number} to the message."""
    named = F.create_map(*[F.lit(x) for pair in pests.items() for x in pair])
    one = messages.groupBy("farm_id", "pest_id", "message_no").agg(F.max("message").alias("message"))
    one = one.withColumn("_name", F.try_element_at(named, F.col("pest_id").cast("int")) if pests else F.lit(None).cast("string"))
    key = F.concat(F.lit(prefix), F.col("_name"), F.lit("_"), F.col("message_no").cast("string"))
    picks = [F.max(F.when((F.col("pest_id") == pid) & (F.col("message_no") == i), F.col("message")))
             .alias(f"{prefix}{name}_{i}")
             for pid, name in pests.items() for i in range(1, MESSAGES_PER_PEST + 1)]
    return one.groupBy("farm_id").agg(*picks, by_name(
        F.when(key.isNotNull(), F.struct(key.alias("k"), F.col("message").alias("v")))).alias("pest_messages"))


def decision_columns(decisions: DataFrame, prefix: str = "decision_") -> DataFrame:
    """Decision flags as Plant / Do Not Plant text."""
    source = {f"{prefix}{f}": (f[:3] if f.startswith("spw") else f[:2]) + "_" + f[-2:]
              for f in DECISION_COLUMNS}
    return decisions.select("farm_id", *[text.plant_label(F.col(s)).alias(n) for n, s in source.items()])


def crop_plan(farms: DataFrame, signals: DataFrame, forecast: DataFrame, generated: str,
              fields: list[str], pest_rows: DataFrame | None = None,
              decisions: DataFrame | None = None, digits: int = 4,
              filter_same_tier_1: bool = False) -> DataFrame:
    """One wide row per farm of a generation date.

    Every input is reduced to one row per farm before the joins, so each join
    is one-to-one on farm_id and all of them share that partitioning.
    """
    d = F.lit(dt.date.fromisoformat(generated))
    today = signals.where(F.col("generated_date") == d)
    out = farms.join(today.select(
        "farm_id", "top_message", "description", "description_sw", "too_wet_indicator",
        "last_4_days", "last_2_days", "today_tomorrow", "is_sent_before"), "farm_id", "left")
    if filter_same_tier_1:
        out = out.where(~F.coalesce("is_sent_before", F.lit(False)))
    wide = forecast_wide(forecast.where(F.col("forecast_date") == d), fields)
    out = out.join(wide, "farm_id", "left")
    for extra in (pest_rows, decisions):
        if extra is not None:
            out = out.join(extra, "farm_id", "left")
    known = {"farm_id", *farms.columns, "top_message", "description", "description_sw",
             "too_wet_indicator", "last_4_days", "last_2_days", "today_tomorrow", "is_sent_before"}
    rest = [c for c in out.columns if c not in known]
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    return out.select(
        "farm_id", F.col("farm_unique_id").alias("farmID"), F.col("phone").alias("phoneNumber"),
        numeric.round_digits(F.col("lat"), digits).alias("latitude"),
        numeric.round_digits(F.col("lon"), digits).alias("longitude"),
        empty("top_message").alias("SPWTopMessage"), empty("description").alias("SPWDescription"),
        empty("description_sw").alias("SPWDescription_sw"),
        empty("too_wet_indicator").alias("TooWet"), F.col("last_4_days").alias("last_4_days_mm"),
        F.col("last_2_days").alias("last_2_days_mm"),
        F.col("today_tomorrow").alias("today_tomorrow_mm"), *rest)


def select_plan(plan: DataFrame, farm_ids: list[str] | None = None,
                fields: list[str] | None = None) -> DataFrame:
    """API view of a plan: chosen farms and fields."""
    out = plan if not farm_ids else plan.where(F.col("farmID").isin(farm_ids))
    return out.select("farmID", *[f for f in fields if f != "farmID"]) if fields else out


def as_features(plan: DataFrame) -> DataFrame:
    """GeoJSON feature text per farm; properties are the other plan columns."""
    props = [c for c in plan.columns if c not in ("longitude", "latitude", "farm_id")]
    feature = F.to_json(F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"),
                 F.array("longitude", "latitude").alias("coordinates")).alias("geometry"),
        F.struct(*props).alias("properties")))
    return plan.select("farmID", feature.alias("feature"))
