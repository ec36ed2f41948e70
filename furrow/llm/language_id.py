"""Language identification with error-correcting output codes.

Each language gets a codeword of +1 and -1. For every bit a binary classifier
tells the languages with +1 from those with -1: the mean log-odds of a text's
hashed byte trigrams (with the bigram before it) under the two sides. Decoding is
loss-weighted: a language's loss is the sum over bits of the logistic loss of the
margin times the bit's weight, which is the smallest margin that any language is
expected to have there. The smallest loss wins; texts whose two best languages lie
close are flagged ambiguous.

Training counts trigrams per language over *all* training documents, in tasks,
and adds the bounded tables up in Spark; nothing is sampled. The number of
languages is checked against ``max_languages`` before tables are gathered.

Null texts and texts without a letter are ``und`` with score 0. Languages that are
null are not learned. Repeated rows and null ids are predicted row by row. Without
training rows everything is ``und``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.llm.common import id_crc, score_texts, utf8
from furrow.session import ship_by_value

BITS = 14
SCALE = 6.0
CHUNK = 400_000


def grams(text: str | None) -> np.ndarray:
    """Hashed byte trigrams of the lower-cased text, one per position."""
    raw = np.frombuffer(b"\0" + utf8(text.lower()) + b"\0", np.uint8).astype(np.uint32)
    key = raw[:-2] * np.uint32(0x9E3779B1) + raw[1:-1] * np.uint32(0x85EBCA6B) + raw[2:] * np.uint32(0xC2B2AE35)
    return ((key ^ (key >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS)


def letters(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n rows of +1/-1. Up to five languages: every split once. More: of many
    random codes of about 12 log2(n) bits the one with the largest least distance."""
    if n <= 5:
        splits = [[1] + [1 if k >> i & 1 else -1 for i in range(n - 1)] for k in range(2 ** (n - 1) - 1)]
        return np.array(splits, np.int8).reshape(-1, n).T.copy() if splits else np.ones((n, 1), np.int8)
    rng, best, far = np.random.default_rng(seed), None, -1
    width = int(np.ceil(12 * np.log2(n)))
    for _ in range(40):
        code = rng.choice(np.array([-1, 1], np.int8), (n, width))
        code = code[:, np.abs(code.sum(0)) < n]
        distance = (code.shape[1] - code.astype(int) @ code.T) // 2
        least = (distance + np.eye(n, dtype=int) * width).min()
        if least > far:
            best, far = code, least
    return best


def language_counts(training: DataFrame, max_languages: int) -> tuple[list[str], np.ndarray]:
    """Trigram counts per language over all training rows."""
    known = [r[0] for r in training.select("lang").distinct().limit(max_languages + 1).collect()]
    if len(known) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    known.sort()
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("gram", T.IntegerType()),
                           T.StructField("n", T.LongType())])

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if letters(text):
                    if lang not in sums:
                        sums[lang] = np.zeros(1 << BITS, np.int64)
                    sums[lang] += np.bincount(grams(text), minlength=1 << BITS)
        for lang, row in sums.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()),
                                              pa.array(at, pa.int32()), pa.array(row[at])], names=schema.names)

    rows = training.select("lang", "text").mapInArrow(run, schema).groupBy("lang", "gram").agg(
        F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(known), 1 << BITS))
    place = {name: k for k, name in enumerate(known)}
    where = np.array([place[x] for x in rows.column("lang").to_pylist()], np.int64)
    if len(where):
        counts[where, rows.column("gram").to_numpy()] = rows.column("n").to_numpy()
    return known, counts


class Model:
    """Codewords, per-trigram log-odds of each bit, weights of the bits."""

    @classmethod
    def sent(cls, state: dict):
        """The model from plain arrays, as tasks get it."""
        model = cls.__new__(cls)
        vars(model).update(state)
        return model

    def __init__(self, names: list[str], counts: np.ndarray):
        seen = counts.sum(1) > 0
        self.names, counts = [n for n, s in zip(names, seen) if s], counts[seen]
        self.code = codewords(len(self.names)).astype(np.float32) if self.names else np.ones((0, 1), np.float32)
        rates = counts / counts.sum(1, keepdims=True) if self.names else counts
        columns = []
        for bit in self.code.T:
            sides = [rates[bit == s].mean(0) if (bit == s).any() else np.zeros(counts.shape[1]) for s in (1, -1)]
            columns.append(np.log(sides[0] + 1e-6) - np.log(sides[1] + 1e-6))
        self.odds = np.stack(columns, 1).astype(np.float32) if columns else np.zeros((1 << BITS, 1), np.float32)
        margins = (rates @ self.odds) * self.code if self.names else np.ones((1, 1))
        self.weight = np.maximum(margins.min(0), 1e-3)
        self.weight = (self.weight / self.weight.mean()).astype(np.float32)

    def bits(self, text: str) -> np.ndarray:
        """Mean log-odds of each bit over the whole text, in chunks of positions."""
        found, total = grams(text), np.zeros(self.odds.shape[1])
        for s in range(0, len(found), CHUNK):
            part = found[s:s + CHUNK]
            if len(part) > 4096:
                total += np.bincount(part, minlength=1 << BITS) @ self.odds
            else:
                total += self.odds[part].sum(0, dtype=np.float64)
        return total / max(1, len(found))

    def decode(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, ambiguous)."""
        if not self.names or not letters(text):
            return "und", 0.0, True
        margin = SCALE * self.bits(text) * self.code
        loss = (np.logaddexp(0, -margin) * self.weight).sum(1) / self.weight.sum()
        share = np.exp(-SCALE * (loss - loss.min()))
        share /= share.sum()
        order = np.argsort(loss, kind="stable")
        close = len(order) > 1 and share[order[0]] - share[order[1]] < 0.2
        return self.names[order[0]], float(share[order[0]]), bool(close)


def fit(docs: DataFrame, held_out: int = 0, of: int = 5, max_languages: int = 500) -> Model:
    training = docs.select(docs["doc_id"].alias("doc_id"), docs["lang"].cast("string").alias("lang"),
                           docs["text"].cast("string").alias("text"))
    training = training.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()
                               & F.col("doc_id").isNotNull() & (id_crc(F.col("doc_id"), of) != held_out))
    return Model(*language_counts(training, max_languages))


def predict_documents(docs: DataFrame, held_out: int = 0, of: int = 5) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous) of every document."""
    model = docs.sparkSession.sparkContext.broadcast(vars(fit(docs, held_out, of)))

    def make():
        decode = Model.sent(model.value).decode
        return lambda texts: tuple(zip(*(decode(t) for t in texts)))

    out = score_texts(docs, make, [("lang_pred", T.StringType()), ("score", T.DoubleType()),
                                   ("ambiguous", T.BooleanType())])
    return out.select("doc_id", (id_crc(F.col("doc_id"), of) == held_out).alias("held_out"),
                      "lang_pred", "score", "ambiguous")


ship_by_value(__name__)
