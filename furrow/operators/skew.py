"""Shuffle helpers that hold when one key carries a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALT = "_salt"


def row_salt(df: DataFrame, salts: int) -> Column:
    """Deterministic salt from the whole row, so task retries agree."""
    cols = [F.col(f"`{c}`") for c, t in df.dtypes if not t.startswith(("map", "variant"))]
    return F.pmod(F.xxhash64(*cols), F.lit(salts)).cast("int")


def salted_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner",
                salts: int = 16) -> DataFrame:
    """Equi join in which every key of ``big`` is spread over ``salts`` tasks.

    ``small`` is repeated once per salt, so it must be small against ``big``
    (lattice buckets, config rows). Where both sides are large use a plain join
    and leave a hot key to the adaptive skew join, which repeats only the rows
    of that key. ``how`` may be inner, left, left_semi or left_anti: each keeps
    a row of ``big`` in exactly one salt. One salt is a plain join.
    """
    if salts <= 1:
        return big.join(small, on, how)
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"salted_join cannot do {how!r}")
    left = big.withColumn(SALT, row_salt(big, salts))
    right = small.withColumn(
        SALT, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, SALT], how).drop(SALT)


def spread_for_python(df: DataFrame, *keys: str) -> DataFrame:
    """Hash partitions on the grouping keys that stay as many as configured.

    Adaptive coalescing sizes partitions by bytes; Python work per row is far
    dearer than its bytes, so merged partitions would leave cores idle. The
    group-by that follows reuses this partitioning.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *keys)


def latest_by(df: DataFrame, keys: list[str], order: list[str | Column],
              keep: str = "last") -> DataFrame:
    """One whole row per key: the greatest (or least) by ``order``, nulls being least;
    of rows alike in it the one whose columns have the smallest hash.

    A ranked window with a group limit: each task keeps one row a key before anything is
    shuffled, so a hot key costs no more than another, and rows are not packed into
    structs that have to be sorted.
    """
    rank = [F.col(o) if isinstance(o, str) else o for o in order]
    tie = F.xxhash64(*[F.col(f"`{c}`") for c, t in df.dtypes if not t.startswith(("map", "variant"))])
    ranked = [o.desc_nulls_last() if keep == "last" else o.asc_nulls_first() for o in rank]
    first = Window.partitionBy(*keys).orderBy(*ranked, tie)
    return df.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")


def dense_ids(df: DataFrame, name: str, id_col: str, start: Column | int = 0,
              buckets_hex: int = 3) -> DataFrame:
    """Consecutive ids (start + 1, ...) in md5 order of a distinct ``name``.

    A global row_number would put all rows in one task. Here rows are ranked
    inside 16**buckets_hex digest buckets and shifted by the counts of the
    lower buckets; that count table has at most 4096 rows.
    """
    digest = F.md5(F.col(name))
    keyed = df.withColumn("_d", digest).withColumn("_b", F.substring("_d", 1, buckets_hex))
    counts = keyed.groupBy("_b").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_b").orderBy("_d", name)
    base = F.lit(start) if isinstance(start, int) else start
    return (keyed.withColumn("_rn", F.row_number().over(inside))
            .join(shift, "_b")
            .withColumn(id_col, (base + F.col("_before") + F.col("_rn")).cast("long"))
            .drop("_d", "_b", "_rn", "_before"))
