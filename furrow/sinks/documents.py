"""Results as CSV/TSV text, JSON documents and GeoJSON."""

from __future__ import annotations

import re

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions import numeric

MICROS = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"
GRID_ORDER = ["date", "time", "lat", "lon", "ensemble"]


def ordered_text(df: DataFrame, order: list[str], digits: int | None = 6) -> DataFrame:
    """Rows range-partitioned and sorted, floats to six significant digits.

    Files come out in order (part-00000 first) without one task sorting all.
    """
    coords = set(order)
    floats = [c for c, t in df.dtypes if t in ("double", "float") and c not in coords]
    if digits is not None:
        df = df.withColumns({c: numeric.significant(F.col(c), digits) for c in floats})
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def write_text(df: DataFrame, path: str, order: list[str] | None = None, sep: str = ",",
               digits: int | None = 6) -> None:
    """CSV (or TSV with a tab) with a header."""
    order = order or [c for c in GRID_ORDER if c in df.columns]
    out = ordered_text(df, order, digits) if order else df
    (out.write.mode("overwrite").option("header", True).option("sep", sep)
     .option("timestampNTZFormat", MICROS).csv(path))


def write_named(rows: DataFrame, name: Column, line: Column, path: str, header: str | None = None) -> None:
    """One file for each value of ``name``, called so, with the lines of its rows.

    The tasks write the files themselves, each under a hidden name until it is whole,
    so the driver does nothing per file. ``path`` is a shared folder, as a path or as a
    URI that Arrow knows. Signs a file name cannot hold are escaped as in the names of
    partition folders; rows without a name go to the file of the default partition.
    """
    from pyarrow import fs
    store, root = fs.FileSystem.from_uri(path)
    store.create_dir(root, recursive=True)
    unsafe = "[\\x00-\\x1f\"#%'*/:=?\\\\\\x7f{\\[\\]^]"

    def put(part):
        from pyarrow import fs
        store, root = fs.FileSystem.from_uri(path)
        attempt, current, out = TaskContext.get().taskAttemptId(), None, None

        def close():
            if out is not None:
                out.close()
                store.move(f"{root}/.{current}.{attempt}", f"{root}/{current}")

        for row in part:
            if row["name"] != current:
                close()
                current = row["name"]
                out = store.open_output_stream(f"{root}/.{current}.{attempt}")
                if header is not None:
                    out.write(f"{header}\n".encode())
            out.write(f"{row['line'] or ''}\n".encode())
        close()

    escaped = F.coalesce(F.nullif(name, F.lit("")), F.lit("__HIVE_DEFAULT_PARTITION__"))
    escape = F.udf(lambda n: re.sub(unsafe, lambda m: f"%{ord(m.group()):02X}", n))
    named = rows.select(F.when(escaped.rlike(unsafe), escape(escaped)).otherwise(escaped).alias("name"), line.alias("line"))
    named.repartition("name").sortWithinPartitions("name").foreachPartition(put)


def time_value_documents(df: DataFrame, place: list[str], time: str, values: list[str],
                         chunk: str = "year") -> DataFrame:
    """``{geometry, data: [{datetime, values}]}`` per place and calendar chunk.

    One entry per datetime (means of duplicates), entries in time order. The
    chunk keeps a document at the time steps of a year (or month), however
    long the record of the place is; concatenating ``data`` in chunk order
    gives the whole record.
    """
    steps = df.groupBy(*place, F.date_trunc(chunk, F.col(time)).alias("chunk_start"), F.col(time).alias("_t")).agg(
        *[F.avg(v).alias(v) for v in values])
    entry = F.struct(F.date_format("_t", "yyyy-MM-dd'T'HH:mm:ss").alias("datetime"),
                     F.struct(*values).alias("values"))
    docs = steps.groupBy(*place, "chunk_start").agg(F.array_sort(F.collect_list(entry)).alias("data"))
    geometry = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    body = F.to_json(F.struct(geometry.alias("geometry"), "data"), {"ignoreNullFields": "false"})
    return docs.select(*place, "chunk_start", body.alias("document"))


def json_array(*cols: Column) -> Column:
    return F.to_json(F.array(*cols), {"ignoreNullFields": "false"})


def json_object(**cols: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in cols.items()]), {"ignoreNullFields": "false"})
