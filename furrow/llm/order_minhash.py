"""Document fingerprints by Order MinHash.

A text is the sequence of its k-mers of code points, each numbered by its occurrence,
so that all are different. Each of ``m`` hash orders selects the ``l`` smallest of
them; the selected ones are put back in text order and hashed as a tuple to one
entry of the fingerprint. Two texts agree in an entry if they share the smallest
k-mers *and* their order, so the share of equal entries follows edit distance, not
only the sets of k-mers. A text shorter than ``k`` is one k-mer.

Scale: the only thing moved is the text, once, to range partitions ordered by
(doc_id, digest of the text, row number); a task then walks its partition holding
two documents, compares each with the next one and writes the results. The last
document of a partition meets the first one of the next partition in a join of one
row per partition. Equal keys, even equal rows, spread over partitions.

Null texts are empty; empty texts have equal fingerprints. Null ids come first,
documents of one id follow by digest of their text, repeated rows one by one. A
single document is its own next one. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.llm.common import stage, utf8
from furrow.session import ship_by_value

WORD = (1 << 64) - 1
ODD = np.uint64(0x9E3779B97F4A7C15)
BASE = 0xD6E8FEB86659FD93
BLOCK = 4096


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(BASE)
    x = (x ^ (x >> np.uint64(29))) * ODD
    return x ^ (x >> np.uint64(32))


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def kmer_values(codes: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash of every window of ``k`` codes, doubling the width where possible;
    of the whole text where it is shorter."""
    k = min(k, len(codes))
    if not k:
        return np.zeros(1, np.uint64)
    single = codes.astype(np.uint64) + np.uint64(1)
    value, width, power = single, 1, BASE
    for bit in bin(k)[3:]:
        value = value[:-width] * np.uint64(power) + value[width:]
        width, power = 2 * width, power * power & WORD
        if bit == "1":
            value = value[:-1] * np.uint64(BASE) + single[width:]
            width, power = width + 1, power * BASE & WORD
    return value


def number(value: np.ndarray, shared: int, own: int) -> np.ndarray:
    """Values mixed with their occurrence numbers, in text order.

    ``value[:own]`` are the k-mers of a text. What follows belongs to a second text
    that has the first ``shared`` k-mers in common with it.
    """
    n = len(value)
    # Leading bits and place in one word: sorted far faster than by argsort.
    bits = np.uint64(max(1, (n - 1).bit_length()))
    packed = value >> bits << bits
    packed |= np.arange(n, dtype=np.uint64)
    packed.sort()
    order = (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    packed >>= bits
    alike = packed[1:] == packed[:-1]
    if alike.any():
        ranked = value[order]
        equal = ranked[1:] == ranked[:-1]
        if (equal != alike).any():                      # different k-mers share the leading bits
            order = value.argsort(kind="stable")
            ranked = value[order]
            equal = ranked[1:] == ranked[:-1]
        starts = np.flatnonzero(np.concatenate(([True], ~equal)))
        size = np.diff(np.append(starts, n))
        times = np.arange(n, dtype=np.int64) - np.repeat(starts, size)
        if own < n:
            first = (order >= shared) & (order < own)   # of the first text only
            before = np.cumsum(first) - first
            times -= np.where(order >= own, before - np.repeat(before[starts], size), 0)
        again = np.flatnonzero(times)
        value = value.copy()
        value[order[again]] += times[again].astype(np.uint64) * ODD
    return mix(value)


class OrderMinHash:
    """Fingerprints of ``m`` entries, each from the ``l`` smallest k-mers of one order."""

    def __init__(self, k: int = 8, m: int = 64, l: int = 2):
        self.k, self.m, self.l = k, m, l
        # An order is that of the k-mers' 32-bit hashes times an odd number.
        seeds = mix(np.arange(1, m + 1, dtype=np.uint64) * ODD)
        self.factor = ((seeds >> np.uint64(32)) | np.uint64(1)).astype(np.uint32)[:, None]
        self.rows, self.room = np.arange(m), np.empty((m, BLOCK), np.uint32)

    def smallest(self, value: np.ndarray, start: int = 0, best: np.ndarray | None = None) -> np.ndarray:
        """(m, l) smallest of ``value`` in each order, as value and place, fewer columns
        where there are fewer; places count from ``start``. ``best`` is of what stands before."""
        top, short = np.iinfo(np.uint32).max, (value >> np.uint64(32)).astype(np.uint32)
        kept = [] if best is None else [best]
        for at in range(0, len(short), BLOCK):
            piece = short[None, at:at + BLOCK]
            part = np.multiply(piece, self.factor, out=self.room[:, :piece.shape[1]])
            for _ in range(min(self.l, piece.shape[1])):
                place = part.argmin(axis=1)
                found = part[self.rows, place].astype(np.uint64)
                part[self.rows, place] = top
                kept.append((found << np.uint64(32) | (place + (start + at)).astype(np.uint64))[:, None])
            if len(kept) > 64:
                kept = [np.sort(np.concatenate(kept, axis=1), axis=1)[:, :self.l]]
        found = np.concatenate(kept, axis=1)
        return found if found.shape[1] <= self.l else np.sort(found, axis=1)[:, :self.l]

    def hashed(self, best: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Entries: the chosen k-mers of each order in text order, hashed as a tuple."""
        places = np.sort((best & np.uint64(0xFFFFFFFF)).astype(np.int64), axis=1)
        out = np.arange(1, self.m + 1, dtype=np.uint64) * ODD
        for c in range(places.shape[1]):
            out = mix(out * np.uint64(BASE) + value[places[:, c]])
        return (out >> np.uint64(32)).astype(np.uint32)

    def entries(self, codes: np.ndarray) -> np.ndarray:
        """The fingerprint as ``m`` 32-bit values."""
        raw = kmer_values(codes, self.k)
        value = number(raw, len(raw), len(raw))
        return self.hashed(self.smallest(value), value)

    def both_entries(self, codes: np.ndarray, keep: int, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints of a text and of its first ``keep`` codes followed by ``tail``;
        what they share is numbered and ordered once."""
        shared = keep - self.k + 1
        if shared < 1 or not len(tail):
            return self.entries(codes), self.entries(np.concatenate((codes[:keep], tail)))
        raw = kmer_values(codes, self.k)
        own = len(raw)
        raw = np.concatenate((raw, kmer_values(np.concatenate((codes[shared:keep], tail)), self.k)))
        value = number(raw, shared, own)
        common = self.smallest(value[:shared])
        other = np.concatenate((value[:shared], value[own:]))
        return (self.hashed(self.smallest(value[shared:own], shared, common), value[:own]),
                self.hashed(self.smallest(value[own:], shared, common), other))


def as_bytes(entries: np.ndarray) -> bytes:
    return entries.astype(">u4").tobytes()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal entries, 0 to 1."""
    return float((a == b).mean())


_RESULT = [("doc_id", T.LongType()), ("n_chars", T.LongType()), ("edited_sha256", T.StringType()),
           ("fingerprint", T.StringType()), ("edited_fingerprint", T.StringType()),
           ("near_edited", T.DoubleType()), ("near_next", T.DoubleType())]
# Staged in bytes, half as long as their hexadecimal text.
_RAW = ("edited_sha256", "fingerprint", "edited_fingerprint")
_WALK = [(n, T.BinaryType() if n in _RAW else t) for n, t in _RESULT] + [("part", T.LongType()), ("kind", T.StringType()), ("text", T.StringType())]


def _schema(fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


def fingerprints(docs: DataFrame, k: int = 8, m: int = 64, l: int = 2) -> DataFrame:
    """(doc_id, fingerprint) of every row."""
    from furrow.llm.common import score_texts

    def make():
        method = OrderMinHash(k, m, l)
        return lambda texts: ([as_bytes(method.entries(codes_of(t or ""))).hex() for t in texts],)

    return score_texts(docs, make, [("fingerprint", T.StringType())])


def compare_with_next(docs: DataFrame, k: int = 8, m: int = 64, l: int = 2) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next):
    every document against its text edited with the next document's, and against that document."""
    from pyspark.sql.pandas.types import to_arrow_schema

    def changed(method, text, following):
        """Entries of the text and of the edited text, the hash of the latter."""
        quarter = len(text) // 4
        keep, tail = len(text) - quarter, following[:quarter]
        own, other = method.both_entries(codes_of(text), keep, codes_of(tail))
        return own, other, hashlib.sha256(utf8(text[:keep] + tail)).digest()

    def result_of(doc_id, text, own, other, sha, next_entries):
        return (doc_id, len(text), sha, as_bytes(own), as_bytes(other), likeness(own, other),
                likeness(own, next_entries))

    def batch_of(rows, arrow):
        columns = list(zip(*rows)) if rows else [[] for _ in arrow]
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow)], schema=arrow)

    walk = to_arrow_schema(_schema(_WALK))

    def run(batches):
        method, part = OrderMinHash(k, m, l), TaskContext.get().partitionId()
        blank, last, done = (None,) * len(_RESULT), None, None
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if last is None:
                    out.append((*blank, part, "head", text))
                else:
                    now = (*last, *changed(method, last[1], text))
                    if done is not None:
                        out.append((*result_of(*done, now[2]), part, "row", None))
                    done = now
                last = doc_id, text
            yield batch_of(out, walk)
        if last is not None:
            entries = method.entries(codes_of(last[1]))
            rows = [] if done is None else [(*result_of(*done, entries), part, "row", None)]
            yield batch_of(rows + [(last[0], *blank[1:], part, "last", last[1])], walk)

    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    keyed = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("digest"),
                        F.monotonically_increasing_id().alias("row"))
    order = [F.asc_nulls_first("doc_id"), F.asc("digest"), F.asc("row")]
    walked = stage(keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
                   .mapInArrow(run, _schema(_WALK)), "order-minhash")

    raw = _schema(_WALK[:len(_RESULT)])
    result = to_arrow_schema(raw)

    def close(batches):
        method = OrderMinHash(k, m, l)
        for batch in batches:
            yield batch_of([result_of(d, t, *changed(method, t, f), method.entries(codes_of(f)))
                            for d, t, f in zip(*(c.to_pylist() for c in batch.columns))], result)

    # One number per partition that has rows.
    parts = sorted(r.part for r in walked.filter("kind = 'head'").select("part").collect())
    follows = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part long, next long")
    heads = walked.filter("kind = 'head'").select(F.col("part").alias("next"), F.col("text").alias("following"))
    last = (walked.filter("kind = 'last'").select("doc_id", "part", "text").join(follows, "part").join(heads, "next")
            .select("doc_id", "text", "following").mapInArrow(close, raw))
    return walked.filter("kind = 'row'").select(raw.names).unionByName(last).select(
        *(F.lower(F.hex(n)).alias(n) if n in _RAW else n for n in raw.names))


ship_by_value(__name__)
