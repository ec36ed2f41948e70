"""Registry of queries and the derived input tables they share.

Derived tables are written once as SQL that Spark and DuckDB both read. Spark
runs it over views of the Parquet files; the SQL twin of a query gets the ones
it names as common table expressions. They use exact arithmetic (integers,
multiples of 1/8), so both engines see the same doubles.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.session import scratch_dir
from furrow.sinks import documents, runs, tables

BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
        "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_DERIVED: dict[str, str] = {}

REQUEST_DATE = "1998-07-01"
FIRST_DAY = "1998-03-03"


def derive(name: str, sql: str) -> None:
    """Register a derived table; ``{x}`` names a base or derived table."""
    _DERIVED[name] = sql


class Tables:
    """Attribute access to the base and derived tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._tag = "t" + hashlib.md5(self.folder.encode()).hexdigest()[:8]

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name in _DERIVED:
            return self.sql(_DERIVED[name])
        raise AttributeError(name)

    def cube(self, name: str) -> tuple[DataFrame, object]:
        """A derived forecast table as its writer leaves it, partitioned by run, and the
        newest run by the manifest."""
        path = scratch_dir(self.spark, name)
        runs.write_runs(getattr(self, name), path)
        return self.spark.read.parquet(path), runs.newest(self.spark, path)

    def advisory_table(self) -> str:
        """The advisory history as its writer leaves it, by iso_a3, year, month and day.

        A run covers a year here: the stand-in spreads its rows over thousands of days.
        """
        path = scratch_dir(self.spark, "advisory")
        tables.write_advisory(self.advisory_hist.select(
            "registry_id", "grid_id", "iso_a3", "year", F.lit(7).alias("month"), F.lit(1).alias("day"), "final_message"), path)
        return path

    def named_files(self, rows: DataFrame, name: str, fmt: str, into: str | None = None, header: bool = False) -> str:
        """A folder with one file, csv or text, for each value of the column ``name``, called so."""
        path = into or scratch_dir(self.spark, "named")
        cells = [c for c in rows.columns if c != name]
        line = F.to_csv(F.struct(*cells)) if fmt == "csv" else F.col(*cells)
        documents.write_named(rows, F.col(name).cast("string"), line, path, ",".join(cells) if header else None)
        return path

    def _view(self, name: str) -> str:
        view = f"{self._tag}_{name}"
        getattr(self, name).createOrReplaceTempView(view)
        return view

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(re.sub(r"\{(\w+)\}", lambda m: self._view(m.group(1)), text))


def twin(sql: str) -> str:
    """SQL with the derived tables it names in front."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\{(\w+)\}", text):
            if name in _DERIVED and name not in order:
                visit(_DERIVED[name])
                if name not in order:
                    order.append(name)

    visit(sql)
    plain = lambda s: re.sub(r"\{(\w+)\}", r"\1", s).strip()
    if not order:
        return plain(sql)
    ctes = ", ".join(f"{n} AS ({plain(_DERIVED[n])})" for n in order)
    body = plain(sql)
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"


def query(name: str, sql: str | None = None):
    """Register a query ``f(tables) -> DataFrame`` and its SQL twin."""
    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = twin(sql)
        return fn
    return wrap
