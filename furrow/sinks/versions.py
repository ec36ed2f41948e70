"""A log of committed versions beside a table.

Data of a version is written first; one appended log row then makes it visible. A run
that dies in between leaves data that nobody reads and that its repetition overwrites.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOG = "version long, note string"
MISSING = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def read_if_there(spark: SparkSession, path: str, **options) -> DataFrame | None:
    """The table at ``path``, None where nothing has been written yet."""
    try:
        return spark.read.options(**options).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() not in MISSING:
            raise
        return None


class Versions:
    """Versions 1, 2, ... of a table below ``path``: data in ``v=N``, the log in ``log``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def folder(self, version: int) -> str:
        return f"{self.path}/data/v={version}"

    def latest(self) -> tuple[int, dict]:
        """(number, note) of the newest committed version, (0, {}) before the first."""
        log = read_if_there(self.spark, f"{self.path}/log")
        last = log.orderBy(F.desc("version")).first() if log is not None else None
        return (last["version"], json.loads(last["note"])) if last else (0, {})

    def read(self) -> DataFrame | None:
        """Data of the newest committed version."""
        version, _ = self.latest()
        return self.spark.read.parquet(self.folder(version)) if version else None

    def commit(self, version: int, **note) -> None:
        """Make ``version`` the newest one. Of two runs that commit the same number the first stands."""
        if version <= self.latest()[0]:
            raise ValueError(f"version {version} is committed already")
        row = self.spark.createDataFrame([(version, json.dumps(note))], _LOG)
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/log")
