"""Cross-entropy difference: target against background n-gram model.

Words and adjacent words are counted as they are, under 64-bit hashes; no table has
a fixed size. Counts run over *all* documents: background is every row, target the
rows whose id is in the target table.

Background counts are scaled to the target's number of tokens, so both models are
matched in size. The loss of a token is -ln p(word | previous word), the pair count
smoothed with the unigram (Dirichlet mass ``MASS``), the unigram smoothed over the
distinct words. A document's score is the mean of target loss minus background loss:
the lower, the closer to the target.

Documents are staged once under row numbers, with the target flag. A first pass
counts words (partial sums in tasks) and stages the word table. A second pass deals
every pair of a document to the bucket of its word, where all counts of that word and
of its pairs meet: -ln((pair + m u) / (context + m)) is a term of the pair and its word
plus a term of the context word, so each is known in one bucket. Buckets return sums
per document in blocks of a chunk of documents, which are added chunk by chunk. A word above one in ``HOT`` tokens (at most ``HOT``
words) would fill its bucket: its counts are broadcast and its pairs are dealt by pair.
A bucket's rows are blocks with each pair of a chunk of documents held once, so a hot
pair is one entry per chunk when it is counted.

Null, empty and wordless texts have 0 tokens and null losses; null ids are scored
(and never target); repeated rows count each time. Without target rows the target
model is uniform. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.llm.common import plain_words, stage
from furrow.session import ship_by_value

MASS = 20.0
CACHE_ENTRIES = 200_000
START, END = 0, 1                   # stand where a word before or behind is missing
HOT = 2000
CHUNK_TOKENS = 1_000_000
BUCKET_TOKENS, LEAST_BUCKETS = 8_000_000, 64


def word_keys(text: str | None, cache: dict) -> list[int]:
    """64-bit hash of every word, never START or END."""
    if len(cache) > CACHE_ENTRIES:
        cache.clear()
    words = plain_words(text)
    found = [cache.get(w) for w in words]
    if None in found:
        for i, w in enumerate(words):
            if found[i] is None:
                found[i] = cache[w] = max(xxhash.xxh64_intdigest(w), 2)
    return found


def mixed(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    key = before * np.uint64(0x9E3779B97F4A7C15) + words
    key = (key ^ (key >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return key ^ (key >> np.uint64(29))


def changes(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows start."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def flagged_documents(docs: DataFrame, target: DataFrame) -> DataFrame:
    """(row, doc_id, hit, text), staged, so that row numbers stay.

    The target table grows with the corpus, so the join is a shuffle join at every size.
    """
    flags = target.select(target["doc_id"].alias("_id")).filter("_id IS NOT NULL").distinct().withColumn(
        "_hit", F.lit(True))
    rows = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].cast("string").alias("text")).join(
        flags.hint("merge"), F.col("doc_id") == F.col("_id"), "left")
    return stage(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id",
                             F.coalesce("_hit", F.lit(False)).alias("hit"), "text"), "lm-documents")


def count_words(rows: DataFrame) -> DataFrame:
    """(word, target, background) of every distinct word, staged."""
    schema = "word long, target long, background long"

    def run(batches):
        def flush():
            words, hits = np.concatenate(held), np.concatenate(flags)
            found, at = np.unique(words, return_inverse=True)
            return pa.RecordBatch.from_arrays([
                pa.array(found.view(np.int64)),
                pa.array(np.bincount(at, hits, len(found)).astype(np.int64)),
                pa.array(np.bincount(at, minlength=len(found)).astype(np.int64))],
                names=["word", "target", "background"])

        cache, held, flags, size = {}, [], [], 0
        for batch in batches:
            for hit, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = word_keys(text, cache)
                if words:
                    held.append(np.array(words, np.uint64))
                    flags.append(np.full(len(words), hit, bool))
                    size += len(words)
                if size > 4 * CHUNK_TOKENS:
                    yield flush()
                    held, flags, size = [], [], 0
        if held:
            yield flush()

    return stage(rows.select("hit", "text").mapInArrow(run, schema).groupBy("word").agg(
        F.sum("target").alias("target"), F.sum("background").alias("background")), "lm-words")


def pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(a) for a in arrays], np.int64).tobytes()
    raw = head + b"".join(a.tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


# word, before, entries of each pair; document and times of each entry; row and flag of each document
BLOCK = (np.uint64, np.uint64, np.uint32, np.uint32, np.uint32, np.int64, np.bool_)
SUMS = (np.int64, np.float64, np.float64, np.float64)  # row, tokens, both losses


def unpack(block: bytes, kinds: tuple = BLOCK) -> list[np.ndarray]:
    raw = pa.Codec("zstd").decompress(block[8:], int.from_bytes(block[:8], "little"), asbytes=True)
    at, out = 8 * len(kinds), []
    for n, kind in zip(np.frombuffer(raw, np.int64, len(kinds)), kinds):
        out.append(np.frombuffer(raw, kind, int(n), at))
        at += int(n) * np.dtype(kind).itemsize
    return out


def chunk_blocks(texts: list[np.ndarray], numbers: list[int], hits: list[bool],
                 hot: np.ndarray, buckets: int):
    """(bucket, block) of the pairs of some documents."""
    ends = [np.array([START], np.uint64), np.array([END], np.uint64)]
    line = np.concatenate([x for t in texts for x in (ends[0], t, ends[1])])
    of = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])
    before, word = line[:-1], line[1:]
    inside = (of[1:] == of[:-1])
    before, word, of = before[inside], word[inside], of[1:][inside]
    last = word == END                  # the pair (last word, END) belongs to the last word
    before, word = np.where(last, word, before), np.where(last, before, word)
    near = np.minimum(np.searchsorted(hot, word), max(len(hot) - 1, 0))
    route = np.where(hot[near] == word, mixed(before, word), word) if len(hot) else word
    order = np.lexsort((before, route))  # stable: documents stay in order
    route, word, before, of = route[order], word[order], before[order], of[order]
    entry = changes(route, word, before, of)
    times = np.diff(np.append(entry, len(of))).astype(np.uint32)
    route, word, before, of = route[entry], word[entry], before[entry], of[entry]
    bucket = ((route >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    cuts = changes(bucket)
    rows, flags = np.array(numbers, np.int64), np.array(hits, bool)
    for a, b in zip(cuts, np.append(cuts[1:], len(bucket))):
        pair = changes(word[a:b], before[a:b])
        docs, doc = np.unique(of[a:b], return_inverse=True)
        yield int(bucket[a]), pack(
            word[a:b][pair], before[a:b][pair], np.diff(np.append(pair, b - a)).astype(np.uint32),
            doc.astype(np.uint32), times[a:b], rows[docs], flags[docs])


def bucket_losses(blocks: list[bytes], hot: tuple[np.ndarray, ...], size: int, tokens: int, used: int):
    """(rows, tokens, target loss, background loss) of the documents of each block, for this bucket's pairs."""
    parts = []
    for block in blocks:
        word, before, many, doc, times, _, flags = unpack(block)
        starts = np.cumsum(many, dtype=np.int64) - many
        parts.append((word, before, np.add.reduceat(times * flags[doc], starts, dtype=np.int64),
                      np.add.reduceat(times, starts, dtype=np.int64)))
    word, before, target, background = (np.concatenate(c) for c in zip(*parts))
    lengths = [len(p[0]) for p in parts]
    del parts
    order = np.lexsort((before, word))
    starts = changes(word[order], before[order])
    of = np.empty(len(order), np.int64)
    of[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(order))))
    word, before = word[order][starts], before[order][starts]
    counts = [np.add.reduceat(c[order], starts) for c in (target, background)]
    same = changes(word)
    runs = np.diff(np.append(same, len(word)))
    keys, *known = hot
    near = np.minimum(np.searchsorted(keys, word), max(len(keys) - 1, 0))
    is_hot = keys[near] == word if len(keys) else np.zeros(len(word), bool)
    losses = []
    for count, fixed, scale in zip(counts, known, (1.0, size / tokens)):
        own = np.repeat(np.add.reduceat(np.where(before == END, 0, count), same), runs)
        context = np.where(is_hot, fixed[near], own) * scale if len(keys) else own * scale
        unigram = (context + 1.0) / (size + used)
        as_context = np.log(context + MASS)
        losses.append(np.select(
            [before == START, before == END], [as_context - np.log(unigram), -as_context],
            as_context - np.log(count * scale + MASS * unigram)))
    tells = (before != END).astype(np.float64)
    at = 0
    for block, n in zip(blocks, lengths):
        _, _, many, doc, times, rows, _ = unpack(block)
        mine = np.repeat(of[at:at + n], many)
        at += n
        yield (rows, *(np.bincount(doc, x[mine] * times, len(rows)) for x in (tells, *losses)))


def score_documents(docs: DataFrame, target: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, difference) of every document."""
    spark = docs.sparkSession
    rows = flagged_documents(docs, target)
    words = count_words(rows)
    size, tokens, used = (int(x or 0) for x in words.agg(
        F.sum("target"), F.sum("background"), F.count("*")).first())
    buckets = max(LEAST_BUCKETS, -(-tokens // BUCKET_TOKENS))
    top = words.filter(F.col("background") * HOT > tokens).toArrow()
    keys = top.column("word").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    hot = spark.sparkContext.broadcast((keys[order], top.column("target").to_numpy()[order],
                                        top.column("background").to_numpy()[order]))

    def deal(batches):
        def flush():
            return pa.RecordBatch.from_pylist(
                [{"bucket": b, "chunk": numbers[0], "block": x}
                 for b, x in chunk_blocks(texts, numbers, hits, hot.value[0], buckets)],
                schema=pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("block", pa.binary())]))

        cache, texts, numbers, hits, held = {}, [], [], [], 0
        for batch in batches:
            for number, hit, text in zip(*(c.to_pylist() for c in batch.columns)):
                keys = word_keys(text, cache)
                if keys:
                    texts.append(np.array(keys, np.uint64))
                    numbers.append(number)
                    hits.append(hit)
                    held += len(keys)
                if held > CHUNK_TOKENS:
                    yield flush()
                    texts, numbers, hits, held = [], [], [], 0
        if texts:
            yield flush()

    def grouped(batches):
        """Blocks of one key after the other, from rows sorted by it."""
        at, held = None, []
        for batch in batches:
            for key, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if key != at and held:
                    yield held
                    held = []
                at = key
                held.append(row)
        if held:
            yield held

    def score(batches):
        for held in grouped(batches):
            chunks, blocks = zip(*held)
            for chunk, part in zip(chunks, bucket_losses(blocks, hot.value, size, tokens, used)):
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([pack(*part)], pa.binary())],
                                                 names=["chunk", "sums"])

    def add(batches):
        for held in grouped(batches):
            number, *values = (np.concatenate(c) for c in zip(*(unpack(x, SUMS) for x, in held)))
            found, at = np.unique(number, return_inverse=True)
            n, a, b = (np.bincount(at, v, len(found)) for v in values)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found), pa.array(np.rint(n).astype(np.int64)), pa.array(a), pa.array(b)],
                names=["_row", "n", "a", "b"])

    dealt = rows.select("row", "hit", "text").mapInArrow(deal, "bucket int, chunk long, block binary")
    parts = dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(score, "chunk long, sums binary")
    sums = parts.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(
        add, "_row long, n long, a double, b double")
    out = rows.select("row", "doc_id").join(sums.hint("merge"), F.col("row") == F.col("_row"), "left").select(
        "doc_id", F.coalesce("n", F.lit(0).cast("long")).alias("n_tokens"),
        (F.col("a") / F.col("n")).alias("target_loss"), (F.col("b") / F.col("n")).alias("background_loss"))
    return out.withColumn("difference", F.col("target_loss") - F.col("background_loss"))


ship_by_value(__name__)
