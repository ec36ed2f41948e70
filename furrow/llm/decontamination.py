"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of ``window`` consecutive words of each benchmark item
(an item of fewer words is one window). Windows of one length share a shift table
over blocks of two words: a block that ends no pattern sooner than ``s`` words
from the end lets the search jump ``s`` words. Where the shift is 0 the block is a
suffix; the windows of its bucket whose first word agrees are compared word by
word.

The benchmark is the stated query set. It is cut by hash into blocks of at most
about ``block_bytes`` of text. The driver makes the tables of one block at a time and
broadcasts them as arrays, about seven times the block's text. A task holds the
tables of one block; with several it searches groups of texts, so that tables are
built once a group. Every document meets every block. No document is shuffled, compared
with another, or sent to the driver.

Null or empty texts have no words (n_words 0, not contaminated); null and empty
items have no window; a null item id counts as the empty string. Repeated items
and rows are treated one by one; an id shared by several items counts once. An
empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.llm.common import keep_rows, plain_words, score_texts
from furrow.session import ship_by_value

BLOCK_BYTES, GROUP_BYTES = 4_000_000, 32_000_000


def prepare(items: list[tuple[str | None, str | None]], window: int) -> dict:
    """Tables of one block of items as plain arrays, made once on the driver.

    Words are numbered. For each window length: packed blocks of two words with their
    shift, and the windows' places sorted by suffix and first word.
    """
    words = [plain_words(text) for _, text in items]
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for line in words for w in line], np.int64)
    sizes = np.array([len(line) for line in words], np.int64)
    begins = np.cumsum(sizes) - sizes
    classes, v = {}, max(1, len(number))
    for m in sorted({min(window, n) for n in sizes.tolist() if n}):
        mine = np.flatnonzero((np.minimum(sizes, window) == m) & (sizes > 0))
        many = sizes[mine] - m + 1
        starts = np.repeat(begins[mine], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        size = min(2, m)
        block = ids * v + np.append(ids[1:], 0) if size == 2 else ids     # the block that starts here
        ends = np.arange(m, size - 1, -1)                                 # smallest shift first
        keys, first = np.unique(np.concatenate([block[starts + e - size] for e in ends]), return_index=True)
        suffix, head = block[starts + m - size], ids[starts]
        order = np.lexsort((starts, head, suffix))
        classes[m] = keys, (first // len(starts)).astype(np.int64), suffix[order], head[order], starts[order]
    return {"words": b" ".join(number), "ids": ids, "begins": begins, "classes": classes,
            "names": [name or "" for name, _ in items]}


class Patterns:
    """Shift tables and suffix buckets of one block, by window length, from ``prepare``."""

    def __init__(self, tables: dict):
        self.number = {w: k for k, w in enumerate(tables["words"].split())}
        self.ids, self.begins, self.names = tables["ids"].tolist(), tables["begins"], tables["names"]
        self.classes = {m: (dict(zip(keys.tolist(), shift.tolist())), suffix, head, starts)
                        for m, (keys, shift, suffix, head, starts) in tables["classes"].items()}

    def find(self, words: list[bytes]):
        """(start, end, item) of every occurrence of a window."""
        get, v, n = self.number.get, max(1, len(self.number)), len(words)
        found = [get(w, -1) for w in words]
        for m, (shift, suffix, head, starts) in self.classes.items():
            size = min(2, m)
            jump, i, step_of = m - size + 1, m - 1, shift.get
            while i < n:
                last = found[i]
                if last < 0:                     # no window holds this word
                    i += m
                    continue
                block = last if size == 1 else found[i - 1] * v + last if found[i - 1] >= 0 else -1
                step = step_of(block, jump)
                if step:
                    i += step
                    continue
                first = i - m + 1
                low, high = np.searchsorted(suffix, (block, block + 1))
                near, far = low + np.searchsorted(head[low:high], (found[first], found[first] + 1))
                mine = found[first:i + 1]
                for start in starts[near:far].tolist():
                    if mine == self.ids[start:start + m]:
                        yield first, i + 1, int(np.searchsorted(self.begins, start, "right")) - 1
                i += 1


def covered(spans: list[tuple[int, int]]) -> int:
    """Number of positions inside any span."""
    total, reach = 0, 0
    for start, end in sorted(spans):
        total += max(0, end - max(start, reach))
        reach = max(reach, end)
    return total


def query_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES):
    """Items of the benchmark, one bounded block after the other."""
    items = benchmark.select(benchmark["item_id"].cast("string").alias("item"),
                             benchmark["text"].cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    for b in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        yield [(r["item"], r["text"]) for r in part.toLocalIterator()]


def finder(blocks: list):
    """Factory of a function from texts to (n_words, spans, item ids) lists.

    ``blocks`` are broadcasts. With one, its tables are built once a task. With several,
    those of one block at a time are built for each group of texts (``GROUP_BYTES``) and
    let go again, so a task's memory doesn't grow with the benchmark.
    """
    def make():
        only = Patterns(blocks[0].value) if len(blocks) == 1 else None

        def run(texts):
            sizes, spans, items = [0] * len(texts), [[] for _ in texts], [set() for _ in texts]
            for block in blocks:
                patterns = only or Patterns(block.value)
                for row, text in enumerate(texts):
                    words = plain_words(text)
                    sizes[row] = len(words)
                    for start, end, k in patterns.find(words):
                        spans[row].append((start, end))
                        items[row].add(patterns.names[k])
                if only is None:
                    vars(block).pop("_value", None)     # a worker keeps what it has unpickled otherwise
            return sizes, [sorted(set(s)) for s in spans], [sorted(i) for i in items]

        return run

    return make


def _sent(docs: DataFrame, benchmark: DataFrame, window: int, block_bytes: int) -> tuple[list, int]:
    """(broadcast tables of the blocks, bytes of text to search at once)."""
    context = docs.sparkSession.sparkContext
    blocks = [context.broadcast(prepare(items, window)) for items in query_blocks(benchmark, block_bytes)]
    return blocks, GROUP_BYTES if len(blocks) > 1 else 0


def find_passages(docs: DataFrame, benchmark: DataFrame, window: int = 10,
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, spans, items): word spans of all occurrences, ids of their items."""
    blocks, group = _sent(docs, benchmark, window, block_bytes)
    return score_texts(docs, finder(blocks),
                       [("n_words", T.LongType()), ("spans", T.ArrayType(T.ArrayType(T.IntegerType()))),
                        ("items", T.ArrayType(T.StringType()))], group_bytes=group)


def digest(docs: DataFrame, benchmark: DataFrame, window: int = 10,
           block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every document."""
    blocks, group = _sent(docs, benchmark, window, block_bytes)
    inner = finder(blocks)

    def make():
        run = inner()

        def digests(texts):
            n_words, spans, items = run(texts)
            return (n_words, [covered(s) for s in spans], [len(i) for i in items],
                    [hashlib.sha256(",".join(i).encode()).hexdigest() for i in items])

        return digests

    out = score_texts(docs, make, [("n_words", T.LongType()), ("n_hit", T.LongType()),
                                   ("n_items", T.LongType()), ("items_sha256", T.StringType())], group_bytes=group)
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10,
                      block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents, with all their columns, in which no window occurs."""
    blocks, group = _sent(docs, benchmark, window, block_bytes)
    inner = finder(blocks)

    def make():
        run = inner()
        return lambda texts: [not s for s in run(texts)[1]]

    return keep_rows(docs, make, group)


ship_by_value(__name__)
