"""Quality classifier: random-indexing word vectors, pooled per document, and a
two-layer network in numpy with temperature-calibrated probabilities.

A token gives two units: its core (a short word itself, else its ending) and its
shape (case, punctuation around it, or "as before" when it repeats the token
before). Units are hashed into ``UNITS`` buckets. Every bucket has a fixed sparse
random index vector; its word vector is the sum of the index vectors of the units
it occurs beside. Those sums run over *all* documents, inside tasks, and Spark adds
the bounded tables up. Integers are summed, so the order of tasks doesn't matter.

The network is fitted on a bounded sample of labelled training rows
(``sample_rows``); a part of it is held back to fit the temperature.

Null, empty and blank texts have a zero vector and get the network's answer to it;
null ids and repeated rows are scored row by row. Without labels scores are 0.5.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.llm.common import id_crc, labelled_sample, score_texts, utf8
from furrow.session import ship_by_value

UNITS, DIMS, NONZERO = 4096, 32, 4
HIDDEN = 24
SAMPLE_ROWS = 8000
CACHE_ENTRIES = 200_000
THRESHOLD = 0.3

_EDGES = re.compile(rb"^([\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]*)(.*?)([\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]*)$", re.S)


def token_units(token: bytes) -> int:
    """core * UNITS + shape."""
    before, body, after = _EDGES.match(token).groups()
    low = body.lower()
    core = low if len(low) <= 4 else b"~" + low[-3:]
    case = b"u" if body.isupper() and len(body) > 1 else b"t" if body[:1].isupper() else b"l"
    if body.isdigit():
        core, case = b"0", b"d"
    if len(low) > 30:
        case += b"+"
    shape = case + b"|" + before[:3] + b"|" + after[:3]
    return zlib.crc32(core) % UNITS * UNITS + zlib.crc32(shape, 1) % UNITS


REPEAT = zlib.crc32(b"as before", 1) % UNITS


def text_units(text: str | None, cache: dict) -> tuple[np.ndarray, np.ndarray]:
    """(core, shape) buckets of the tokens of a text."""
    tokens = utf8(text).split() if text else []
    if len(cache) > CACHE_ENTRIES:
        cache.clear()
    found = [cache.get(t) for t in tokens]
    if None in found:
        for i, t in enumerate(tokens):
            if found[i] is None:
                found[i] = cache[t] = token_units(t)
    both = np.array(found, np.int64)
    core, shape = both // UNITS, both % UNITS
    if len(both) > 1:
        shape[1:][both[1:] == both[:-1]] = REPEAT
    return core, shape


def index_vectors(seed: int = 5) -> np.ndarray:
    """Sparse ternary index vectors, one per bucket."""
    rng, out = np.random.default_rng(seed), np.zeros((UNITS, DIMS), np.int64)
    for row in out:
        at = rng.choice(DIMS, 2 * NONZERO, replace=False)
        row[at[:NONZERO]], row[at[NONZERO:]] = 1, -1
    return out


def contexts(pairs: np.ndarray, times: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Sums of neighbours' index vectors from counted (unit, neighbour) pairs."""
    unit, neighbour = pairs // UNITS, pairs % UNITS
    out = np.empty((UNITS, DIMS), np.int64)
    for d in range(DIMS):
        out[:, d] = np.bincount(unit, weights=times * index[neighbour, d], minlength=UNITS).astype(np.int64)
    return out


def neighbours(core: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """(unit, neighbour) pairs of a text: the cores beside a core, and each token's own shape."""
    a = core[:-1] * UNITS + core[1:]
    b = core[1:] * UNITS + core[:-1]
    c = shape[:-1] * UNITS + shape[1:]
    d = shape[1:] * UNITS + shape[:-1]
    return np.concatenate((a, b, c, d, core * UNITS + shape, shape * UNITS + core))


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Word vectors of all buckets, from every document."""
    text = docs.select(docs["text"].cast("string").alias("text"))
    names = [f"v{d}" for d in range(DIMS)]
    schema = T.StructType([T.StructField("unit", T.IntegerType())] + [T.StructField(n, T.LongType()) for n in names])

    def run(batches):
        index, cache, total = index_vectors(), {}, np.zeros((UNITS, DIMS), np.int64)
        for batch in batches:
            held, size = [], 0
            texts = batch.column(0).to_pylist()
            for k, t in enumerate(texts):
                pairs = neighbours(*text_units(t, cache))
                held.append(pairs)
                size += len(pairs)
                if size > 2_000_000 or k == len(texts) - 1:
                    found, times = np.unique(np.concatenate(held), return_counts=True)
                    total += contexts(found, times, index)
                    held, size = [], 0
        used = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *(pa.array(total[used, d]) for d in range(DIMS))],
                                         names=schema.names)

    rows = text.mapInArrow(run, schema).groupBy("unit").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    out = np.zeros((UNITS, DIMS))
    at = rows.column("unit").to_numpy()
    for d, n in enumerate(names):
        out[at, d] = rows.column(n).to_numpy()
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return (out / np.maximum(norm, 1e-9)).astype(np.float32)


def pool(text: str | None, vectors: np.ndarray, cache: dict) -> np.ndarray:
    """Mean vector of the cores and of the shapes, and the text's length."""
    core, shape = text_units(text, cache)
    out = np.zeros(2 * DIMS + 1, np.float32)
    n = len(core)
    if n:
        for part, units in ((0, core), (DIMS, shape)):
            if n > UNITS:
                out[part:part + DIMS] = np.bincount(units, minlength=UNITS) @ vectors / n
            else:
                out[part:part + DIMS] = vectors[units].sum(0) / n
        out[-1] = np.log1p(n)
    return out


class Network:
    """relu(x A + a) B + b, divided by a temperature, through the logistic function."""

    @classmethod
    def sent(cls, state: dict):
        """The network from plain arrays, as tasks get it."""
        network = cls.__new__(cls)
        vars(network).update(state)
        return network

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 400, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-3)
        x = (x - self.mean) / self.scale
        held = rng.permutation(len(x)) < len(x) // 5
        params = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
                  rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1)]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        tx, ty = x[~held], y[~held]
        for step in range(1, rounds + 1):                  # Adam on seeded batches
            pick = rng.integers(0, len(tx), min(512, len(tx)))
            bx, by = tx[pick], ty[pick]
            hidden = np.maximum(bx @ params[0] + params[1], 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ params[2] + params[3], -30, 30)))
            error = (p - by) / len(bx)
            back = np.outer(error, params[2]) * (hidden > 0)
            grads = [bx.T @ back + 1e-4 * params[0], back.sum(0), hidden.T @ error + 1e-4 * params[2],
                     np.array([error.sum()])]
            for k, g in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                params[k] = params[k] - 0.01 * (first[k] / (1 - 0.9 ** step)) / (
                    np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
        self.params = params
        self.temperature = 1.0
        check = held if held.any() else ~held
        logits, truth = self.logits(x[check]), y[check]
        grid = np.geomspace(0.25, 8, 41)
        loss = [np.logaddexp(0, np.where(truth > 0, -logits, logits) / t).mean() for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum(x @ self.params[0] + self.params[1], 0)
        return hidden @ self.params[2] + self.params[3]

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = self.logits((x - self.mean) / self.scale) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def pooled_sample(sample: DataFrame, vectors) -> tuple[np.ndarray, np.ndarray]:
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("label", T.IntegerType()),
                           T.StructField("x", T.ArrayType(T.FloatType()))])

    def run(batches):
        cache, found = {}, vectors.value
        for batch in batches:
            x = [pool(t, found, cache) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float32()))],
                                             names=schema.names)

    rows = sample.select(F.col("_doc").cast("string").alias("id"), "label", "text").mapInArrow(run, schema).toArrow()
    order = np.argsort(np.array(rows.column("id").to_pylist(), dtype=str), kind="stable")
    x = np.array(rows.column("x").to_pylist(), np.float64).reshape(len(order), 2 * DIMS + 1)
    return x[order], rows.column("label").to_numpy().astype(np.float64)[order]


def score_documents(docs: DataFrame, labels: DataFrame, held_out: int = 0, of: int = 5,
                    sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    context = docs.sparkSession.sparkContext
    vectors = context.broadcast(word_vectors(docs))
    sample = labelled_sample(docs, labels, "quality", id_crc(F.col("_id"), of) != held_out, sample_rows)
    x, y = pooled_sample(sample, vectors)
    network = context.broadcast(vars(Network(x, y)) if len(y) else None)

    def make():
        cache, found = {}, vectors.value
        model = Network.sent(network.value) if network.value else None

        def run(texts):
            x = np.array([pool(t, found, cache) for t in texts], np.float64)
            return (model.predict(x) if model else np.full(len(texts), 0.5),)

        return run

    out = score_texts(docs, make, [("score", T.DoubleType())])
    return out.select("doc_id", (id_crc(F.col("doc_id"), of) == held_out).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))


ship_by_value(__name__)
