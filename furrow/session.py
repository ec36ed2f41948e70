"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "256k",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app: str = "furrow", master: str | None = None,
                  **overrides: str) -> SparkSession:
    """A session with the defaults the operators are written for.

    On a cluster leave ``master`` unset: sizes, shuffle partitions and
    ``spark.checkpoint.dir`` come from the submit configuration.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**_DEFAULTS, **overrides}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def is_local(master: str) -> bool:
    """One JVM, so one disk; local-cluster has executors of its own."""
    return master == "local" or master.startswith("local[")


def scratch_dir(spark: SparkSession, label: str = "work") -> str:
    """A fresh folder name below the cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` names the shared folder. Only where it is unset
    (local tests) a temporary folder is made and recorded in the session; on any
    other master an unset folder is an error, as executors would each write to
    their own disk. What is staged here is left to the retention of the folder.
    """
    base = (spark.conf.get("spark.checkpoint.dir", None)
            or spark.sparkContext.getConf().get("spark.checkpoint.dir"))
    if not base:
        if not is_local(spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="furrow-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def write_stage(df: DataFrame, path: str) -> DataFrame:
    """An intermediate result as a table that is read back.

    Cuts lineage and survives lost executors; used where a costly result has
    several readers or feeds a table it was read from.
    """
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_by_value(module: str) -> None:
    """Send a module's task functions along with the job, so that executors
    need no copy of this package to run them."""
    register_pickle_by_value(sys.modules[module])
