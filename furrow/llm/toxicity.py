"""Toxicity by weak supervision.

1. Voters. A bounded sample of labelled training rows gives lexicon voters (whole
   words and word stems that stand out in toxic rows) and fixed pattern voters
   (shouting, exclamation runs, a seed list). Each votes on a text or abstains.
2. Label model. A two-class generative model is fitted to the votes alone by
   expectation-maximisation: the class prior, each voter's rates under either
   class (its accuracy) and, from the covariance that remains within the classes,
   correlations; voters that say the same thing share one vote.
3. A linear classifier over hashed word features is trained on the posterior
   labels and scores every whole text.

``sample_rows`` bounds what the driver fits on; everything else runs in tasks.
Labels, language, source and ids are inputs of no score.

Null and empty texts get the score of an empty feature vector (the prior of the
model, below the threshold). Repeated rows score alike; null ids are scored. With
no labelled rows at all the model has no voters and every score is 0.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.llm.common import id_crc, keep_rows, labelled_sample, plain_words, score_texts, utf8
from furrow.session import ship_by_value

SAMPLE_ROWS = 8000
STEMS = (4, 5, 6, 7)          # bytes of a word's beginning
VOTERS = 160
THRESHOLD = 0.3
CACHE_ENTRIES = 200_000
# Seed lexicon: fixed values
SEED_WORDS = (b"idiot", b"moron", b"stupid", b"loser", b"scum", b"trash", b"worthless",
              b"pathetic", b"disgusting", b"clown", b"hate", b"kill")

_SHOUT = re.compile(rb"[A-Z]{3,}[^a-z]{0,4}!")
_BANGS = re.compile(rb"!{2,}")


def word_features(word: bytes) -> list[int]:
    """63-bit hashes of a word and of its stems."""
    out = [xxhash.xxh64_intdigest(word) >> 1]
    out += [xxhash.xxh64_intdigest(word[:k], seed=k) >> 1 for k in STEMS if len(word) >= k]
    return out


def text_features(text: str | None, cache: dict) -> tuple[list[int], int]:
    """(features of the distinct words, pattern votes as bits)."""
    words = set(plain_words(text))
    found = []
    for w in words:
        f = cache.get(w)
        if f is None:
            if len(cache) >= CACHE_ENTRIES:
                cache.clear()
            f = cache[w] = word_features(w)
        found.extend(f)
    raw = utf8(text) if text else b""
    n = max(1, len(raw))
    bits = (any(w in words for w in SEED_WORDS)
            | (len(_SHOUT.findall(raw)) * 40 > n) << 1 | (len(_BANGS.findall(raw)) * 40 > n) << 2)
    return found, bits


PATTERNS = 3


def sample_features(sample: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row starts, feature hashes, pattern bits, labels) of the sample. Texts are
    turned into features where they are; the driver gets numbers."""
    schema = T.StructType([T.StructField("label", T.IntegerType()), T.StructField("bits", T.IntegerType()),
                           T.StructField("features", T.ArrayType(T.LongType()))])

    def run(batches):
        cache: dict = {}
        for batch in batches:
            rows = [text_features(t, cache) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([b for _, b in rows], pa.int32()),
                 pa.array([sorted(set(f)) for f, _ in rows], pa.list_(pa.int64()))], names=schema.names)

    ordered = sample.select("label", "text").mapInArrow(run, schema)
    rows = ordered.toArrow()
    lists = rows.column("features").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    starts = lists.offsets.to_numpy().astype(np.int64)
    return (starts - starts[0], lists.flatten().to_numpy(), rows.column("bits").to_numpy(),
            rows.column("label").to_numpy())


def row_numbers(starts: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(starts) - 1), np.diff(starts))


def number(starts, features, least: int = 4):
    """(hashes, row of each entry, number of each entry): features of at least
    ``least`` rows, numbered in the order of their hashes."""
    hashes, numbers, times = np.unique(features, return_inverse=True, return_counts=True)
    often = times >= least
    inside = often[numbers]
    return hashes[often], row_numbers(starts)[inside], (np.cumsum(often) - 1)[numbers[inside]]


def choose_voters(n_rows, hashes, row, feature, labels, voters: int = VOTERS) -> np.ndarray:
    """Numbers of the features that stand out in toxic rows: a one-sided score
    test, at least 4 toxic rows and ten toxic rows for a clean one."""
    size = len(hashes)
    n1, n0 = max(1, int((labels == 1).sum())), max(1, int((labels == 0).sum()))
    toxic = np.bincount(feature[labels[row] == 1], minlength=size)
    clean = np.bincount(feature[labels[row] == 0], minlength=size)
    share = (toxic + clean) / (n1 + n0)
    z = (toxic / n1 - clean / n0) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n1 + 1 / n0))
    z[(toxic < 4) | (toxic < 10 * clean)] = 0
    best = np.argsort(-z, kind="stable")[:voters]
    return np.sort(best[z[best] > 4.5])


def vote_matrix(n_rows, row, feature, bits, voters: np.ndarray) -> np.ndarray:
    """Rows x voters, 1 where a voter votes toxic; the last column votes clean
    where no lexicon voter speaks."""
    votes = np.zeros((n_rows, len(voters) + PATTERNS + 1), np.float32)
    if len(voters):
        at = np.minimum(np.searchsorted(voters, feature), len(voters) - 1)
        inside = voters[at] == feature
        votes[row[inside], at[inside]] = 1
    for p in range(PATTERNS):
        votes[:, len(voters) + p] = bits >> p & 1
    votes[:, -1] = ~votes[:, :len(voters)].any(axis=1)
    return votes


def label_model(votes: np.ndarray, rounds: int = 40) -> dict:
    """Generative model of the votes: prior, rates per class, weights, posterior.

    Given the class, voter j votes with rate ``rates[c, j]``. Correlation is read
    from the covariance left within the classes: a voter's weight is one over the
    number of voters it agrees with beyond what the class explains.
    """
    n, m = votes.shape
    q = np.where(votes[:, -1] > 0, 0.02, 0.9)        # start: any lexicon voter speaks
    weights = np.ones(m)
    for step in range(rounds):
        prior = float(np.clip(q.mean(), 1e-4, 0.5))
        total = np.array([(1 - q).sum(), q.sum()])
        rates = (np.stack([(1 - q) @ votes, q @ votes]) + [[0.1], [0.1]]) / (total[:, None] + 1.0)
        rates = np.clip(rates, 1e-5, 1 - 1e-5)
        if step == 4:                                 # correlations, once the classes have settled
            expected = np.outer(1 - q, rates[0]) + np.outer(q, rates[1])
            left = votes - expected
            scale = np.sqrt(np.maximum((left * left).mean(0), 1e-9))
            correlation = (left.T @ left) / n / np.outer(scale, scale)
            weights = 1.0 / np.maximum(1.0, (np.clip(correlation, 0, 1) ** 2).sum(0))
        logit = (np.log(prior / (1 - prior))
                 + votes @ (weights * np.log(rates[1] / rates[0]))
                 + (1 - votes) @ (weights * np.log((1 - rates[1]) / (1 - rates[0]))))
        q = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    accuracy = prior * rates[1] + (1 - prior) * (1 - rates[0])
    return {"prior": prior, "rates": rates, "weights": weights, "accuracy": accuracy, "posterior": q}


def train_linear(n, hashes, row, feature, target: np.ndarray, rounds: int = 500,
                 keep: int = 1000) -> tuple[dict[int, float], float]:
    """Logistic regression on soft labels over the features that tell the soft
    classes apart; all other weights are 0, so long clean texts gather no noise."""
    size = len(hashes)
    mass = np.bincount(feature, weights=target[row], minlength=size)
    count = np.bincount(feature, minlength=size)
    base = min(max(1e-4, float(target.mean())), 0.9999)
    bias = float(np.log(base / (1 - base)))
    z = (mass - count * base) / np.sqrt(np.maximum(count, 1) * base * (1 - base))
    chosen = np.argsort(-np.abs(z), kind="stable")[:keep]
    chosen = np.sort(chosen[np.abs(z[chosen]) > 5])
    if not len(chosen):
        return {}, bias
    at = np.minimum(np.searchsorted(chosen, feature), len(chosen) - 1)
    inside = chosen[at] == feature
    r, f = row[inside], at[inside]
    w, first, second = np.append(np.zeros(len(chosen)), bias), 0.0, 0.0
    for step in range(1, rounds + 1):                  # Adam on all rows
        p = 1 / (1 + np.exp(-np.clip(w[-1] + np.bincount(r, weights=w[f], minlength=n), -30, 30)))
        error = p - target
        slope = np.append(np.bincount(f, weights=error[r], minlength=len(chosen)) + 0.03 * w[:-1], error.sum()) / n
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope * slope
        w = w - 0.05 * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-8)
    return {int(h): float(x) for h, x in zip(hashes[chosen], w) if x}, float(w[-1])


class Model:
    """Weights of the non-zero features and the bias; tasks are sent these and build it anew."""

    def __init__(self, weight: dict[int, float], bias: float):
        self.at, self.bias = weight, bias

    def sent(self, docs: DataFrame):
        return docs.sparkSession.sparkContext.broadcast((self.at, self.bias))

    def scorer(self):
        weight, bias, cache = self.at, self.bias, {}

        def score(text: str | None) -> float:
            total = bias
            seen: set[int] = set()
            for w in set(plain_words(text)):
                found = cache.get(w)
                if found is None:
                    if len(cache) >= CACHE_ENTRIES:
                        cache.clear()
                    found = cache[w] = tuple(i for i in word_features(w) if i in weight)
                if found:
                    seen.update(found)
            for i in sorted(seen):
                total += weight[i]
            return float(1 / (1 + np.exp(-min(30.0, max(-30.0, total)))))

        return score


def fit(docs: DataFrame, labels: DataFrame, held_out: int = 2, of: int = 4,
        sample_rows: int = SAMPLE_ROWS) -> Model:
    """Train on rows whose id hash modulo ``of`` isn't ``held_out``."""
    sample = labelled_sample(docs, labels, "toxic", id_crc(F.col("_id"), of) != held_out, sample_rows)
    starts, features, bits, label = sample_features(sample)
    if not len(label) or not (label == 1).any():
        return Model({}, -30.0)
    n, (hashes, row, feature) = len(label), number(starts, features)
    voters = choose_voters(n, hashes, row, feature, label)
    posterior = label_model(vote_matrix(n, row, feature, bits, voters))["posterior"]
    return Model(*train_linear(n, hashes, row, feature, posterior))


def score_documents(docs: DataFrame, labels: DataFrame, held_out: int = 2, of: int = 4,
                    sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    model = fit(docs, labels, held_out, of, sample_rows).sent(docs)

    def make():
        score = Model(*model.value).scorer()
        return lambda texts: ([score(t) for t in texts],)

    out = score_texts(docs, make, [("score", T.DoubleType())])
    return out.select("doc_id", (id_crc(F.col("doc_id"), of) == held_out).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, training: DataFrame, labels: DataFrame, held_out: int = 2,
               of: int = 4, sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """Documents, with all their columns, that score below the threshold."""
    model = fit(training, labels, held_out, of, sample_rows).sent(docs)

    def make():
        score = Model(*model.value).scorer()
        return lambda texts: [score(t) < threshold for t in texts]

    return keep_rows(docs, make)


ship_by_value(__name__)
