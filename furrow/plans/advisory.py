"""Rule-based advisory messages: codes, slots, repeats, farm table, audit log."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions import dates, numeric, text
from furrow.operators.skew import salted_join

PARAMETERS = ["temperature", "humidity", "p_pet", "growth_stage_precipitation",
              "seasonal_precipitation"]
SLOTS = ["message", "message_2", "message_3", "message_4", "message_5"]
MATCH_KEYS = ["grid_id", "crop_id", "crop_stage_type_id", "planting_date_epoch"]
CODE_SPAN = 1 << 32
RULE_KEYS = ["config_id", "crop_id", "crop_stage_type_id", "growth_stage_id"]
MAX_BOOK_RULES = 100_000        # about 100 bytes each in the pieces: 10 MB


# ---- rules ----------------------------------------------------------------

def leading_rules(rules: DataFrame, priorities: DataFrame) -> DataFrame:
    """Rules with their message priority; of a key's equal ranges the lowest id, as the
    others can never win."""
    ranked = rules.join(priorities.select("config_id", "code", "priority"),
                        ["config_id", "code"], "left")
    first = F.min(F.struct("rule_id", F.col("code").cast("int").alias("code"),
                           F.coalesce("priority", F.lit(0)).alias("priority"))).alias("_r")
    return (ranked.groupBy(*RULE_KEYS, "parameter", F.col("min_range").cast("double").alias("lo"),
                           F.col("max_range").cast("double").alias("hi")).agg(first)
            .select(*RULE_KEYS, "parameter", "_r.rule_id", "lo", "hi", "_r.code", "_r.priority"))


def rule_book(rules: DataFrame, priorities: DataFrame,
              parameters: list[str] = PARAMETERS) -> DataFrame:
    """Rules with their message priority: one row per (config, crop, stage).

    The ranges of a parameter are cut at all their bounds into disjoint pieces, sorted
    by where they start: ``starts_<parameter>`` for the search, ``codes_<parameter>``
    with (minus priority, code) of the rule that wins there, null between ranges.
    ``steps`` is the number of halvings that the longest of them needs. Overlaps are
    settled here, once a key, not once a row.
    """
    rule = F.struct("rule_id", "lo", "hi", "code", "priority")
    folded = leading_rules(rules, priorities).groupBy(*RULE_KEYS).agg(*[
        F.array_sort(F.collect_list(F.when(F.col("parameter") == p, rule))).alias(f"_{p}")
        for p in parameters])
    bounds = lambda p: F.array_sort(F.array_distinct(F.concat(
        F.transform(f"_{p}", lambda r: r["lo"]), F.transform(f"_{p}", lambda r: r["hi"]))))
    book = folded.withColumns({f"starts_{p}": bounds(p) for p in parameters})
    longest = F.greatest(*[F.size(f"starts_{p}") for p in parameters])

    def winners(p: str) -> Column:
        first = F.transform(f"starts_{p}", lambda at: F.get(F.filter(f"_{p}", _holds(at)), 0))
        return F.transform(first, lambda r: F.when(r.isNotNull(), F.struct(
            (-r["priority"]).alias("p"), r["code"].alias("c"))))

    return book.select(*RULE_KEYS, F.ceil(F.log2(longest + 1)).cast("int").alias("steps"),
                       *[f"starts_{p}" for p in parameters], *[winners(p).alias(f"codes_{p}") for p in parameters])


def _last_start(starts: Column, steps: Column, value: Column) -> Column:
    """Index of the last start at or below a value, -1 before the first: a binary search."""
    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        below = F.get(starts, middle) <= value
        open_ = s["lo"] < s["hi"]
        return F.struct(F.when(open_ & below, middle + 1).otherwise(s["lo"]).alias("lo"),
                        F.when(open_ & ~below, middle).otherwise(s["hi"]).alias("hi"))

    whole = F.struct(F.lit(0).alias("lo"), F.size(starts).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), steps), whole, halve, lambda s: s["lo"] - 1)


def matched_codes(parameters: list[str] = PARAMETERS) -> Column:
    """Distinct codes in priority order (ties: lower code).

    Per parameter the lowest rule id with ``lo <= value < hi`` wins; its piece is found
    by halving, so many ranges cost little more than a few.
    """
    hits = []
    for p in parameters:
        at = _last_start(F.col(f"starts_{p}"), F.col("steps"), numeric.rule_value(F.col(p)))
        hits.append(F.get(F.col(f"codes_{p}"), at))
    found = F.array_compact(F.array(*hits))
    return F.transform(F.array_sort(F.array_distinct(found)), lambda h: h["c"])


def _holds(value: Column):
    return lambda r: (r["lo"] <= value) & (value < r["hi"])


def overlapping_rules(rules: DataFrame) -> DataFrame:
    """Pairs of rules of one key and parameter whose ranges overlap.

    Sorted by lower bound a rule overlaps an earlier one exactly when it
    starts before the greatest upper bound seen so far.
    """
    from pyspark.sql import Window
    w = (Window.partitionBy(*RULE_KEYS, "parameter").orderBy("min_range", "rule_id")
         .rowsBetween(Window.unboundedPreceding, -1))
    return (rules.withColumn("_reach", F.max("max_range").over(w))
            .where(F.col("min_range") < F.col("_reach")).drop("_reach"))


def with_codes(df: DataFrame, rules: DataFrame, priorities: DataFrame,
               parameters: list[str] = PARAMETERS) -> DataFrame:
    """Adds ``codes``: the matched message codes in slot order.

    A book of at most ``MAX_BOOK_RULES`` rules is sent to the rows, which then stay where
    they are; a larger one (counted first) is joined by its keys, rows salted, as there
    are far fewer keys than rows.
    """
    book = rule_book(rules, priorities, parameters)
    small = rules.limit(MAX_BOOK_RULES + 1).count() <= MAX_BOOK_RULES
    joined = df.join(F.broadcast(book), RULE_KEYS, "left") if small else salted_join(df, book, RULE_KEYS, "left")
    empty = F.array().cast("array<int>")
    return (joined.withColumn("codes", F.coalesce(matched_codes(parameters), empty))
            .drop("steps", *[f"{kind}_{p}" for p in parameters for kind in ("starts", "codes")]))


def to_slots(df: DataFrame, codes: str = "codes") -> DataFrame:
    """First five codes as message columns."""
    return df.withColumns({s: F.get(F.col(codes), i) for i, s in enumerate(SLOTS)})


def final_message(df: DataFrame) -> DataFrame:
    """Flags and the final message: the first slot, or the second when the
    first repeats last week's and a second exists."""
    first, second = F.col("message"), F.col("message_2")
    repeat = F.coalesce(first == F.col("prev_week_message"), F.lit(False))
    return df.withColumns({
        "is_empty_message": first.isNull(),
        "has_repetitive_message": repeat,
        "final_message": F.when(repeat & second.isNotNull(), second).otherwise(first)})


def previous_messages(advisory: DataFrame, priorities: DataFrame | None = None) -> DataFrame:
    """Last week's final message, one per grid-crop.

    Where farms of one key were sent different messages the one of highest
    priority, then lowest code, is kept. A table without the column, or
    without rows, simply gives no match.
    """
    if "final_message" not in advisory.columns:
        return advisory.select(*MATCH_KEYS).limit(0).withColumn(
            "prev_week_message", F.lit(None).cast("int"))
    rows = advisory.where(F.col("final_message").isNotNull()).select(
        *MATCH_KEYS, "config_id", F.col("final_message").cast("int").alias("code"))
    if priorities is not None:
        rows = rows.join(priorities.select("config_id", "code", "priority"), ["config_id", "code"], "left")
    else:
        rows = rows.withColumn("priority", F.lit(0))
    # priority and code in one long: a fixed-width buffer keeps the aggregation
    # on hashes, where a struct would make Spark sort the rows first
    rank = -F.coalesce("priority", F.lit(0)).cast("long") * CODE_SPAN + F.col("code")
    best = rows.groupBy(*MATCH_KEYS).agg(F.min(rank).alias("_rank"))
    return best.select(*MATCH_KEYS, F.pmod("_rank", F.lit(CODE_SPAN)).cast("int").alias("prev_week_message"))


def with_previous(df: DataFrame, previous: DataFrame | None) -> DataFrame:
    if previous is None:
        return df.withColumn("prev_week_message", F.lit(None).cast("int"))
    return df.join(previous, MATCH_KEYS, "left")


def advise(grid_crops: DataFrame, rules: DataFrame, priorities: DataFrame,
           previous: DataFrame | None = None) -> DataFrame:
    """Grid-crop features → message slots, flags and final message."""
    coded = with_codes(with_previous(grid_crops, previous), rules, priorities)
    return final_message(to_slots(coded)).drop("codes")


# ---- farms ----------------------------------------------------------------

def registry_star(registry: DataFrame, farm: DataFrame, grid: DataFrame, crop: DataFrame,
                  stage_type: DataFrame, country: DataFrame,
                  optional: dict[str, DataFrame] | None = None) -> DataFrame:
    """Registry rows with their dimensions; incomplete rows drop out.

    ``optional`` maps a key column (county_id, ...) to its dimension, joined
    from the left. Sizes decide broadcasts; farm and grid may be large.
    """
    out = (registry.join(farm, "farm_id").join(grid, "grid_id")
           .join(crop, "crop_id").join(stage_type, "crop_stage_type_id")
           .join(country, "country_id"))
    for key, dim in (optional or {}).items():
        out = out.join(dim, key, "left")
    return (out.withColumn("planting_date_epoch", dates.to_epoch(F.col("planting_date")))
            .withColumn("grid_crop_key", text.grid_crop_key(
                F.col("crop_id"), F.col("crop_stage_type_id"), F.col("grid_id"))))


def farm_advisory(farms: DataFrame, advised: DataFrame, stage_labels: DataFrame) -> DataFrame:
    """Grid-crop results handed to every farm of the key, with stage label.

    Both sides are large, so this is a plain join: a key with a third of all
    farms is split by the adaptive skew join, which copies only that key's row.
    """
    drop = [c for c in advised.columns if c in farms.columns and c not in MATCH_KEYS]
    right = advised.drop(*drop)
    joined = farms.join(right, MATCH_KEYS)
    return joined.join(stage_labels.select("growth_stage_id", "growth_stage"), "growth_stage_id", "left")


def with_date_parts(df: DataFrame, request_date: str) -> DataFrame:
    d = dt.date.fromisoformat(request_date)
    return df.withColumns({"date": F.lit(d), "year": F.lit(d.year), "month": F.lit(d.month),
                           "day": F.lit(d.day)})


def without_messages(df: DataFrame) -> DataFrame:
    """Farms with no message in any slot."""
    return df.where(F.coalesce(*SLOTS).isNull())


# ---- recent messages ------------------------------------------------------

def last_sent(history: DataFrame) -> DataFrame:
    """Latest date each code went to a (farm, crop), over all five slots."""
    slots = F.explode(F.array_distinct(F.array_compact(F.array(*SLOTS))))
    return (history.select("farm_id", "crop_id", "message_date", slots.alias("code"))
            .groupBy("farm_id", "crop_id", "code").agg(F.max("message_date").alias("last_date")))


def suppress_recent(df: DataFrame, history: DataFrame, now: str, weeks: int = 2) -> DataFrame:
    """Blank the codes that went to the same (farm, crop) within ``weeks``.

    History is cut by date, then reduced to the distinct codes of a (farm,
    crop) before it is joined; the slots are never unpivoted on the big side.
    """
    floor = F.lit(dt.datetime.fromisoformat(now) - dt.timedelta(weeks=weeks)).cast("timestamp_ntz")
    recent = history.where(F.col("message_date") >= floor)
    codes = F.explode(F.array_distinct(F.array_compact(F.array(*SLOTS))))
    sent = (recent.select("farm_id", "crop_id", codes.alias("_code")).distinct()
            .groupBy("farm_id", "crop_id").agg(F.collect_set("_code").alias("_sent")))
    keep = lambda s: F.when(~F.coalesce(F.array_contains("_sent", F.col(s)), F.lit(False)), F.col(s))
    return (df.join(sent, ["farm_id", "crop_id"], "left")
            .withColumns({s: keep(s) for s in SLOTS}).drop("_sent"))


# ---- outputs --------------------------------------------------------------

#: fixed values: export column -> source expression
EXPORT_COLUMNS = {
    "farmer_id": "farm_unique_id",
    "message_final": "message_final",
    "message_english": "message_english",
    "message_code": "final_message",
    "crop": "crop",
    "planting_date": "date_format(timestamp_seconds(planting_date_epoch), 'yyyy-MM-dd')",
    "growth_stage": "growth_stage",
    "county": "county",
    "subcounty": "subcounty",
    "ward": "ward",
    "relative_humidity": "humidity",
    "seasonal_precipitation": "seasonal_precipitation",
    "temperature": "temperature",
    "ppet": "p_pet",
    "growth_stage_precipitation": "growth_stage_precipitation",
    "growth_stage_date": "date_format(timestamp_seconds(growth_stage_start_date), 'yyyy-MM-dd')",
    "final_longitude": "round(lon, 4)",
    "final_latitude": "round(lat, 4)",
    "grid_id": "grid_unique_id",
    "total_gdd": "total_gdd",
    "message": "message",
    "message_2": "message_2",
    "message_3": "message_3",
    "message_4": "message_4",
    "message_5": "message_5",
    "registry_id": "registry_id",
    "grid_crop_key": "grid_crop_key",
    "preferred_language": "preferred_language",
    "date": "date",
    "prev_growth_stage_id": "prev_growth_stage_id",
    "prev_growth_stage_start_date": "prev_growth_stage_start_date",
    "config_id": "config_id",
    "is_empty_message": "is_empty_message",
    "has_repetitive_message": "has_repetitive_message",
    "prev_week_message": "prev_week_message",
    "iso_a3": "iso_a3",
}


def export_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    unknown = [c for c in columns if c not in EXPORT_COLUMNS]
    if unknown:
        raise ValueError(f"Column name(s) not found in mapping: {', '.join(unknown)}")
    return df.select(*[F.expr(EXPORT_COLUMNS[c]).alias(c) for c in columns])


def with_message_text(df: DataFrame, templates: DataFrame, code: str = "final_message",
                      language: str = "preferred_language") -> DataFrame:
    """Template text of a code in English and in the farmer's language."""
    t = templates.select(F.col("code").alias("_code"), "template_en", "template_sw")
    return (df.join(t, F.col(code) == F.col("_code"), "left")
            .withColumn("message_english", F.col("template_en"))
            .withColumn("message_final", text.in_language(
                F.col(language), F.col("template_en"), F.col("template_sw")))
            .drop("_code", "template_en", "template_sw"))


def advisory_export(advisory: DataFrame, request_date: str, templates: DataFrame,
                    columns: list[str]) -> DataFrame:
    """The day's advisories as the declared export columns."""
    d = dt.date.fromisoformat(request_date)
    day = advisory.where((F.col("year") == d.year) & (F.col("month") == d.month)
                         & (F.col("day") == d.day))
    return export_columns(with_message_text(day, templates), columns)


def error_log(advisory: DataFrame, request_id: int) -> DataFrame:
    """Rows without a message and rows whose first message repeats, as a log."""
    as_text = lambda c: F.col(c).cast("string")
    payload = F.to_json(F.struct(
        as_text("humidity").alias("relative_humidity"), as_text("seasonal_precipitation"),
        as_text("temperature"), as_text("p_pet").alias("ppet"), as_text("growth_stage_precipitation"),
        F.col("growth_stage_start_date").alias("growth_stage_date"), "growth_stage",
        "prev_week_message", "total_gdd"), {"ignoreNullFields": "false"})
    messages = F.to_json(F.array(*SLOTS, "final_message"), {"ignoreNullFields": "false"})
    # fixed values: stored labels and sentences
    kinds = F.array_compact(F.array(
        F.when(F.col("is_empty_message"), F.struct(
            F.lit("MISSING_MESSAGES").alias("error_type"),
            F.lit("Farm registry has no advisory message").alias("error_message"))),
        F.when(F.col("has_repetitive_message"), F.struct(
            F.lit("FOUND_REPETITIVE").alias("error_type"),
            F.lit("First message is repetitive message").alias("error_message")))))
    return (advisory.where("is_empty_message or has_repetitive_message")
            .withColumn("_e", F.explode(kinds))
            .select(F.lit(request_id).alias("request_id"),
                    F.col("registry_id").alias("farm_registry_id"),
                    "_e.error_type", "_e.error_message",
                    messages.alias("messages"), payload.alias("data")))


def message_counts(advisory: DataFrame) -> DataFrame:
    return advisory.agg(
        F.count("*").alias("advisories"),
        F.count_if("is_empty_message").alias("empty_messages"),
        F.count_if("has_repetitive_message").alias("repetitive_messages"))


def write_back_stages(registry: DataFrame, advisory: DataFrame) -> DataFrame:
    """Registry with the new stage and stage start, matched by registry id."""
    new = advisory.select("registry_id", F.col("growth_stage_id").alias("_g"),
                          F.col("growth_stage_start_date").alias("_s"))
    return (registry.join(new, "registry_id", "left")
            .withColumn("prev_growth_stage_id", F.coalesce("_g", "prev_growth_stage_id"))
            .withColumn("prev_growth_stage_start_date", F.coalesce("_s", "prev_growth_stage_start_date"))
            .drop("_g", "_s"))


def run(registry: DataFrame, farm: DataFrame, grid: DataFrame, crop: DataFrame,
        stage_type: DataFrame, country: DataFrame, weather: DataFrame, gdd_config: DataFrame,
        matrix: DataFrame, rules: DataFrame, priorities: DataFrame, stage_labels: DataFrame,
        request_date: str, first_day: str, config_override: DataFrame | None = None,
        default_config: int = 1, previous: DataFrame | None = None) -> DataFrame:
    """Advisory of every registry row for a request date, as one lazy plan."""
    from furrow.plans import agronomy

    farms = registry_star(registry, farm, grid, crop, stage_type, country)
    if config_override is not None:
        farms = agronomy.config_by_country(farms, config_override, default_config)
    else:
        farms = farms.withColumn("config_id", F.lit(default_config))
    grid_crops = agronomy.registry_grid_crops(farms)
    featured = agronomy.grid_crop_features(
        grid_crops, weather, gdd_config, matrix, request_date, first_day)
    advised = advise(featured, rules, priorities, previous)
    # a key with two previous stages keeps one result per previous stage
    keys = [*MATCH_KEYS, "prev_growth_stage_id", "prev_growth_stage_start_date", "config_id"]
    dup = [c for c in farms.columns if c in advised.columns and c not in keys]
    right = advised.drop(*dup)
    for c in ("prev_growth_stage_id", "prev_growth_stage_start_date"):
        right = right.withColumn(f"_{c}", F.coalesce(c, F.lit(-1))).drop(c)
        farms = farms.withColumn(f"_{c}", F.coalesce(c, F.lit(-1)))
    on = [*MATCH_KEYS, "_prev_growth_stage_id", "_prev_growth_stage_start_date", "config_id"]
    joined = farms.join(right, on).drop("_prev_growth_stage_id", "_prev_growth_stage_start_date")
    joined = joined.join(stage_labels, "growth_stage_id", "left")
    return with_date_parts(joined, request_date)
