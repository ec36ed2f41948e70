"""Best-fit packing of documents into training sequences with vector capacities.

A piece is a vector (tokens, documents, attention cost = tokens squared). Pieces
are placed longest first. Of the open sequences that have room in *every*
capacity the one is chosen whose residual, after placing and divided by the
capacities, has the smallest weighted norm (``fit="norm"``) or whose residual has
the largest weighted dot product with the piece (``fit="dot"``).

Scale: texts are tokenised where they are read and only lengths and checksums
travel. The staged pieces are dealt by row number into groups of about
``group_pieces``; each group is packed on its own, so no task holds more than
that, and what a group leaves unfilled is a sequence or two. A document that is
repeated any number of times is spread over all groups.

Null texts are empty: one piece holding the end token. Null ids and repeated rows
are packed row by row; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.llm.bpe import encoder, patterns
from furrow.llm.common import stage
from furrow.session import ship_by_value

END_ID = 2
WEIGHTS = (1.0, 0.01, 0.01)


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens; only the first may be shorter."""
    first = n % size or min(n, size)
    return [(0, first)] + [(s, size) for s in range(first, n, size)]


def pieces(docs: DataFrame, path: str, max_tokens: int = 1024, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document."""
    narrow = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].cast("string").alias("text"))
    schema = T.StructType([narrow.schema["doc_id"], T.StructField("piece", T.IntegerType()),
                           T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
                           T.StructField("ids_crc32", T.LongType())])
    end, found = end_id.to_bytes(4, "little"), patterns()

    def run(batches):
        encode = encoder(path, found)
        for batch in batches:
            rows, out = [], ([], [], [], [])
            for r, text in enumerate(batch.column(1).to_pylist()):
                ids = encode(text or "") + end
                for k, (start, length) in enumerate(cut(len(ids) // 4, max_tokens)):
                    rows.append(r)
                    crc = zlib.crc32(ids[4 * start:4 * (start + length)])
                    for column, value in zip(out, (k, start, length, crc)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(out[0], pa.int32()),
                 *(pa.array(c, pa.int64()) for c in out[1:])], names=schema.names)

    return narrow.mapInArrow(run, schema)


def place(lengths: np.ndarray, capacity: tuple[int, int, int], weights=WEIGHTS,
          fit: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(sequence number, offset) of each length; lengths come longest first."""
    cap, weight = np.array(capacity, np.float64), np.array(weights, np.float64)
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    left = np.empty((3, 1024))            # residuals of the open sequences
    name, used, made = np.empty(1024, np.int64), 0, 0
    for i, n in enumerate(lengths):
        item = np.array((n, 1.0, float(n) * n))
        best = -1
        if used:
            after = left[:, :used] - item[:, None]
            room = after.min(axis=0) >= 0
            if fit == "norm":
                part = after / cap[:, None]
                cost = np.where(room, weight @ (part * part), np.inf)
                at = int(cost.argmin())
            else:
                cost = np.where(room, -((weight * item / cap / cap) @ left[:, :used]), np.inf)
                at = int(cost.argmin())
            best = at if room[at] else -1
        if best < 0:
            if used == left.shape[1]:
                left, name = np.concatenate((left, np.empty_like(left)), axis=1), np.resize(name, 2 * used)
            best, used = used, used + 1
            left[:, best], name[best] = cap, made
            made += 1
        bins[i], offsets[i] = name[best], capacity[0] - left[0, best]
        left[:, best] -= item
        if left[0, best] < 1 or left[1, best] < 1 or left[2, best] < 1:   # closed
            used -= 1
            left[:, best], name[best] = left[:, used], name[used]
    return bins, offsets


def pack(staged: DataFrame, max_tokens: int = 1024, max_documents: int = 1024,
         max_attention: int = 1024 * 1024, fit: str = "norm", group_pieces: int = 16_384) -> DataFrame:
    """``staged`` pieces (a written table) with their sequence_id and offset."""
    if max_attention < max_tokens * max_tokens or max_documents < 1:
        raise ValueError("a piece of max_tokens must fit an empty sequence")
    groups = max(1, math.ceil(staged.count() / group_pieces))
    schema = T.StructType([*staged.schema.fields, T.StructField("sequence_id", T.LongType()),
                           T.StructField("offset", T.LongType())])
    columns, capacity = staged.columns, (max_tokens, max_documents, max_attention)

    def run(key, rows):
        rows = rows.select(columns).sort_by([("length", "descending"), ("doc_id", "ascending"),
                                             ("piece", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = place(rows.column("length").to_numpy(), capacity, fit=fit)
        bins += key[0].as_py() << 32
        return rows.append_column("sequence_id", pa.array(bins)).append_column("offset", pa.array(offsets))

    dealt = staged.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()),
                                               F.lit(groups)).cast("long"))
    return dealt.groupBy("_group").applyInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str, max_tokens: int = 1024, **limits) -> DataFrame:
    """Pieces of all documents with their places."""
    return pack(stage(pieces(docs, path, max_tokens), "pieces"), max_tokens, **limits)


def token_sequences(docs: DataFrame, placed: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """(sequence_id, ids) of packed documents: pieces are cut again next to their
    places, so ids travel once. Needs unique document ids."""
    ids = docs.join(placed.filter("piece = 0").select("doc_id"), "doc_id", "left_semi")
    narrow = ids.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = T.StructType([narrow.schema["doc_id"], T.StructField("all_ids", T.ArrayType(T.IntegerType()))])
    forms = patterns()

    def run(batches):
        encode = encoder(path, forms)
        for batch in batches:
            found = [np.frombuffer(encode(t or ""), "<u4").astype(np.int32).tolist() + [end_id]
                     for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))],
                                             names=schema.names)

    parts = placed.join(narrow.mapInArrow(run, schema), "doc_id").select(
        "sequence_id", "offset", F.expr("slice(all_ids, CAST(start + 1 AS INT), CAST(length AS INT))").alias("ids"))
    return parts.groupBy("sequence_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))),
                              lambda p: p["ids"])).alias("ids"))


ship_by_value(__name__)
