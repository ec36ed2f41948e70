"""Text, JSON and label expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def grid_crop_key(crop: Column, stage_type: Column, grid: Column) -> Column:
    return F.concat_ws("_", crop, stage_type, grid)


def split_crop_stage(text: Column) -> Column:
    """``Crop_Stage`` → struct(crop, stage); the long form of mid is recoded."""
    stage = F.split_part(text, F.lit("_"), F.lit(2))
    return F.struct(
        F.split_part(text, F.lit("_"), F.lit(1)).alias("crop"),
        F.when(stage == "Medium", F.lit("Mid")).otherwise(stage).alias("stage"))


def fold_name(text: Column) -> Column:
    """Lower case, trimmed, runs of blanks as one blank."""
    return F.regexp_replace(F.trim(F.lower(text)), r"\s+", " ")


def clean_id(text: Column) -> Column:
    """Ids that a spreadsheet turned into floats lose their ``.0``."""
    return F.regexp_replace(F.trim(text.cast("string")), r"\.0$", "")


def attribute_list(text: Column) -> Column:
    return F.split(F.regexp_replace(text, " ", ""), ",")


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """Replace ``{{ key }}`` by its value; unset keys become empty text."""
    def put(acc: Column, item: tuple[str, Column]) -> Column:
        key, value = item
        return F.replace(
            F.regexp_replace(acc, r"\{\{\s*" + key + r"\s*\}\}", "{{" + key + "}}"),
            F.lit("{{" + key + "}}"), F.coalesce(value.cast("string"), F.lit("")))
    return reduce(put, values.items(), template)


def in_language(language: Column, en: Column, sw: Column) -> Column:
    """Swahili text where asked for, else English."""
    return F.when(language == "sw", sw).otherwise(en)


def mask_keys(message: Column) -> Column:
    """The value after ``apikey=`` as stars of the same length."""
    key = F.regexp_extract(message, "apikey=([^&]*)", 1)
    stars = F.repeat(F.lit("*"), F.length(key))
    return F.when(key != "", F.replace(message, key, stars)).otherwise(message)


def clean_label(label: Column, allowed: list[str]) -> Column:
    """``-`` and ``_`` become blanks; null where the label is not allowed."""
    text = F.translate(label, "-_", "  ")
    return F.when(text.isin(allowed), text)


def unwrap_single(value: Column) -> Column:
    """The element of a one-element list, else null."""
    return F.when(F.size(value) == 1, F.get(value, 0))


def plant_label(decision: Column) -> Column:
    return F.when(decision == 1, "Plant").otherwise("Do Not Plant")


def top_message(custom: Column, plant_now: Column) -> Column:
    return F.coalesce(
        F.when(custom != "", custom),
        F.when(plant_now, "Plant Now").otherwise("DO NOT PLANT"))


def fingerprint(*fields: Column) -> Column:
    """SHA-512 over named request fields; missing ones count as ``-``."""
    parts = [F.coalesce(f.cast("string"), F.lit("-")) for f in fields]
    return F.sha2(F.concat_ws("|", *parts), 512)


def json_field(doc: Column, key: str) -> Column:
    """Value of a JSON key as text, empty text when absent."""
    return F.coalesce(F.get_json_object(doc, f"$.{key}"), F.lit(""))
