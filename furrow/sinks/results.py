"""The answer to a measurement request in the format it asks for.

Results of all kinds of products get the same shape first: ``datetime``, the columns of
the place, ``ensemble`` where values have members, then the attributes. Several datasets
of a product are merged on time and place; of two values the earlier dataset's stands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.sinks import documents

SEPARATORS = {"csv": ",", "ascii": "\t"}
TIMES = ("date_time", "time", "date", "month_day")
PLACES = ("station_id", "history_id", "lat", "lon")
STAMP = "yyyy-MM-dd HH:mm:ss"


def shaped(df: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """Columns ``datetime`` (text), place, attributes. ``places`` gives a station its position."""
    time = next(c for c in TIMES if c in df.columns)
    if places is not None:
        key = next(c for c in PLACES if c in df.columns)
        df = df.join(places.select(key, "lat", "lon"), key)
    at = F.col(time)
    if time == "date" and "hour" in df.columns:
        at = F.make_timestamp_ntz(F.year(time), F.month(time), F.day(time), F.col("hour"), F.lit(0), F.lit(0))
        df = df.withColumn("_at", at).drop("hour")
        at = F.col("_at")
    stamp = at if time == "month_day" else F.date_format(at.cast("timestamp_ntz"), STAMP)
    where = [c for c in PLACES if c in df.columns]
    rest = [c for c in df.columns if c not in (time, "_at", *where)]
    return df.select(stamp.alias("datetime"), *where, *rest)


def merged(parts: list[DataFrame]) -> DataFrame:
    """Rows of several datasets as one per time and place, each attribute once."""
    if len(parts) == 1:
        return parts[0]
    union = parts[0].withColumn("_part", F.lit(0))
    for number, part in enumerate(parts[1:], 1):
        union = union.unionByName(part.withColumn("_part", F.lit(number)), allowMissingColumns=True)
    keys = ["datetime", *(c for c in PLACES if c in union.columns)]
    values = [c for c in union.columns if c not in (*keys, "_part")]
    return union.groupBy(*keys).agg(*[
        F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_part"))).alias(c) for c in values])


def members_as_rows(df: DataFrame) -> DataFrame:
    """A row per ensemble member, counted from 0; attributes without members are repeated."""
    lists = [f.name for f in df.schema if isinstance(f.dataType, T.ArrayType)]
    if not lists:
        return df
    longest = F.greatest(*[F.size(c) for c in lists]) if len(lists) > 1 else F.size(lists[0])
    out = df.withColumn("ensemble", F.explode_outer(F.when(longest > 0, F.sequence(F.lit(0), longest - 1))))
    plain = [c for c in df.columns if c not in ("datetime", *PLACES)]
    return out.select("datetime", *(c for c in PLACES if c in df.columns), "ensemble", *[
        F.get(F.col(c), F.col("ensemble")).alias(c) if c in lists else F.col(c) for c in plain])


def with_unit_names(df: DataFrame, units: dict[str, dict]) -> DataFrame:
    """Attribute names with their unit, as in ``rain [mm]``."""
    return df.withColumnsRenamed({c: f"{c} [{units[c]['unit']}]" for c in df.columns
                                  if units.get(c, {}).get("unit")})


def point_documents(df: DataFrame, units: dict[str, dict], chunk: str = "year") -> DataFrame:
    """(place, chunk, document): geometry, units and the values per time, in time order.

    A document holds the times of one calendar year (or month) of a place, so it stays
    small however long the record is.
    """
    where = [c for c in PLACES if c in df.columns]
    values = [c for c in df.columns if c not in ("datetime", *where)]
    width = {"year": 4, "month": 7}[chunk]
    entry = F.struct("datetime", F.struct(*values).alias("values"))
    docs = df.groupBy(*where, F.substring("datetime", 1, width).alias("chunk")).agg(
        F.array_sort(F.collect_list(entry)).alias("data"))
    geometry = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    names = {c: units[c]["unit"] for c in values if units.get(c, {}).get("unit")}
    unit = F.struct(*[F.lit(u).alias(c) for c, u in names.items()]) if names else F.lit(None).cast("string")
    body = F.to_json(F.struct(geometry.alias("geometry"), unit.alias("units"), "data"), {"ignoreNullFields": "false"})
    return docs.select(*where, "chunk", body.alias("document"))


def write_result(parts: list[DataFrame], output: str, path: str, units: dict[str, dict] | None = None,
                 unit_names: bool = False, digits: int | None = 6) -> None:
    """Parts (from ``shaped``) to ``path``: text with a header, files in time order, or JSON lines."""
    rows, units = merged(parts), units or {}
    if output == "json":
        docs = point_documents(rows, units)
        order = [c for c in docs.columns if c != "document"]
        docs.repartitionByRange(*order).sortWithinPartitions(*order).select("document").write.mode("overwrite").text(path)
        return
    rows = members_as_rows(rows)
    order = [c for c in ("datetime", "lat", "lon", "station_id", "history_id", "ensemble") if c in rows.columns]
    out = documents.ordered_text(rows, order, digits)
    if unit_names:
        out = with_unit_names(out, units)
    (out.write.mode("overwrite").option("header", True).option("sep", SEPARATORS[output])
     .option("compression", "none").csv(path))
