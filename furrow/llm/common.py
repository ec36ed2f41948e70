"""Shared helpers: reading tables, running a Python function over whole texts
inside tasks, staging, bounded training samples.

Task functions are shipped by value, so executors need no copy of the package.
A factory ``make`` is called once per task and returns the function that is then
applied to every Arrow batch; nothing is kept between tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.session import scratch_dir, ship_by_value, write_stage

# Bytes of a word: digits, a-z (A-Z are lower-cased) and everything outside ASCII.
WORD_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table. Batches sent to Python are kept small, as a document may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write below spark.checkpoint.dir and read back: cuts lineage, survives lost executors."""
    return write_stage(df, scratch_dir(df.sparkSession, f"llm-{label}"))


def utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def plain_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased."""
    return utf8(text).translate(WORD_TABLE).split() if text else []


def space_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``: what stands between ASCII white space."""
    return utf8(text).split() if text else []


def in_groups(batches, size: int):
    """Batches joined until they hold ``size`` bytes; as they come where it is 0."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.nbytes
        if n >= size:
            yield held[0] if len(held) == 1 else pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield held[0] if len(held) == 1 else pa.concat_batches(held)


def score_texts(docs: DataFrame, make: Callable, fields: Sequence[tuple[str, T.DataType]],
                carry: Sequence[str] = ("doc_id",), group_bytes: int = 0) -> DataFrame:
    """Carried columns and ``fields`` computed from the whole text, row by row.

    ``make()`` gives a function from a list of texts (None where null) to one
    list per field; with ``group_bytes`` it gets about so much text at once.
    Other columns are not read, so clashing names do no harm.
    """
    narrow = docs.select(*[docs[c] for c in carry], docs["text"].cast("string").alias("text"))
    schema = T.StructType([narrow.schema[c] for c in carry]
                          + [T.StructField(n, t) for n, t in fields])
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)
    names, kept = [n for n, _ in fields], list(carry)

    def run(batches):
        fn = make()
        for batch in in_groups(batches, group_bytes):
            if not batch.num_rows:
                continue
            columns = fn(batch.column(batch.schema.get_field_index("text")).to_pylist())
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            arrays += [pa.array(c, type=arrow.field(n).type) for n, c in zip(names, columns)]
            yield pa.RecordBatch.from_arrays(arrays, names=kept + names)

    return narrow.mapInArrow(run, schema)


def keep_rows(docs: DataFrame, make: Callable, group_bytes: int = 0) -> DataFrame:
    """Rows, with all their columns, whose text ``make()``'s function answers True for."""
    text = docs.columns.index("text")

    def run(batches):
        fn = make()
        for batch in in_groups(batches, group_bytes):
            mask = pa.array(fn(batch.column(text).to_pylist()), type=pa.bool_())
            yield batch.filter(mask)

    return docs.mapInArrow(run, docs.schema)


def id_crc(doc_id: Column, buckets: int) -> Column:
    """crc32 of the id's text modulo ``buckets``; a null id falls in bucket 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(buckets)),
                      F.lit(0)).cast("int")


def labelled_sample(docs: DataFrame, labels: DataFrame, value: str, keep: Column,
                    rows: int) -> DataFrame:
    """(_doc, text, label) of at most ``rows`` labelled documents, smallest id hash first.

    The ids are a top-k of bounded size; the documents are then scanned once with
    a broadcast of those ids, so no text is shuffled but the sample's. An id with
    several labels has the largest, of several texts the one with the smallest hash.
    """
    ids = (labels.select(labels["doc_id"].alias("_id"), labels[value].cast("int").alias("label"))
           .filter(F.col("_id").isNotNull() & F.col("label").isNotNull()).filter(keep)
           .groupBy("_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("_id"), "_id").limit(rows))
    text = docs.select(docs["doc_id"].alias("_doc"), docs["text"].cast("string").alias("text"))
    found = text.join(F.broadcast(ids), F.col("_doc") == F.col("_id"))
    return found.groupBy("_doc", "label").agg(
        F.min_by("text", F.xxhash64("text")).alias("text")).select("_doc", "text", "label")


def id_filter(ids: DataFrame, column: str) -> tuple[np.ndarray, int]:
    """(bitmap, its number of bits) of the hashes of a column: 16 bits an id, at most 64 MB.

    A filter without false negatives for a later join: what it lets through in vain
    only moves, so beyond the largest size it gets weaker, not wrong.
    """
    bits = min(29, max(16, (16 * ids.count()).bit_length()))
    return bitmap(ids.select(id_place(F.col(column), bits).alias("place")), bits), bits


def id_place(column: Column, bits: int) -> Column:
    return F.xxhash64(column).bitwiseAND(F.lit((1 << bits) - 1))


def bitmap(places: DataFrame, bits: int) -> np.ndarray:
    """Bytes of a bitmap with the given ``place`` bits set, built in Spark in blocks of 4 KB."""
    out = np.zeros(1 << (bits - 3), np.uint8)
    blocks = places.groupBy(F.shiftright("place", 15).alias("block")).agg(
        F.bitmap_construct_agg(F.col("place").bitwiseAND(F.lit(32767))).alias("bits"))
    for r in blocks.toLocalIterator():
        out[r["block"] << 12:(r["block"] + 1) << 12] = np.frombuffer(bytes(r["bits"]), np.uint8)[:4096]
    return out


def set_bits(found: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Which of the places are set in a bitmap."""
    return (found[places >> 3] >> (places & 7).astype(np.uint8) & 1).astype(bool)


ship_by_value(__name__)
