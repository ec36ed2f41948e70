"""Phrase collocation mining by direct-address tiling.

Words are ranked by frequency and get their rank as id. A phrase of k words is the
pair of its first and its last k - 1 words, so level k counts pairs of neighbouring
ids of level k - 1. Pair counts live in tiles of ``TILE`` x ``TILE`` ids: a tile that
holds many pairs of a chunk is counted densely with ``bincount``, all others as sorted
COO runs that are merged. Pairs found ``min_count`` times are ranked again and their
ranks are the ids of the next level. No phrase is as frequent as ``min_count`` unless
its parts are, so dropping other words and pairs loses nothing.

Scale: texts are read twice (counting words, coding them); the codes are staged and
each level reads them once, lifting them by the tables of the levels below. Tasks
send pair counts, which Spark adds up. The tables that tasks need hold the ``head``
most frequent entries of a level, at most that many; entries beyond have a 62-bit
hash as code, and a bitmap of fixed size (``filter_bits``) keeps most rare ones from
being counted. Colliding codes of frequent entries are found, and other seeds taken;
that a rare word shares the code of a frequent one has a chance of (frequent beyond
the head x distinct) / 2^62. Everything after counting joins tables of frequent
phrases, whose size is at most the number of words / ``min_count``.

All counts are per language, null being ``und``. Null and empty texts have no words.
Repeated rows count each. Ties are broken as the contract says: the lowest score of a
cut, then the smallest k; phrases by score, a, then bytes. An empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.llm.common import bitmap, set_bits, stage, utf8
from furrow.session import ship_by_value

# Bytes that end a piece become ".", tabs become spaces, A-Z lower case.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
TABLE = bytes(46 if c in PIECE_ENDS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
END = b"."
TILE = 512
GRID = 4                    # tiles a side that may be dense
DENSE = TILE * TILE // 16   # pairs in a chunk that make a tile dense
CHUNK = 1 << 19
RUNS = 1 << 21              # COO entries held before they are sent on
LONGEST_HEAD_WORD = 64      # bytes
TAIL = 1 << 62
SMALL = 1 << 31             # ids below are ranks


def tokens_of(text: str | None) -> list[bytes]:
    """Lower-cased words, with ``END`` between pieces."""
    return utf8(text).translate(TABLE).replace(END, b" . ").split() if text else []


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(docs["lang"].cast("string"), F.lit("und")).alias("lang"),
                       docs["text"].cast("string").alias("text"))


_WORDS = T.StructType([T.StructField("lang", T.StringType()), T.StructField("word", T.StringType()),
                       T.StructField("a", T.LongType())])


def word_counts(docs: DataFrame, flush: int = 1 << 18) -> DataFrame:
    """(lang, word, a) of all words; the null word counts all words of a language."""
    names = _WORDS.names

    def run(batches):
        from collections import Counter
        counts = {}

        def send():
            for lang, found in counts.items():
                found.pop(END, None)
                if found:
                    words = [w.decode("utf-8", "replace") for w in found]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * (len(words) + 1)), pa.array([*words, None], pa.string()),
                         pa.array([*found.values(), sum(found.values())], pa.int64())], names=names)
            counts.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts.setdefault(lang, Counter()).update(tokens_of(text))
            if sum(map(len, counts.values())) > flush:
                yield from send()
        yield from send()

    return _columns(docs).mapInArrow(run, _WORDS).groupBy("lang", "word").agg(F.sum("a").alias("a"))


def mixed(left: np.ndarray, right: np.ndarray, seed: int) -> np.ndarray:
    """Code of a pair beyond the head: 62 bits of a hash."""
    value = left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    value ^= value >> np.uint64(29)
    value = (value + right.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    value ^= value >> np.uint64(32)
    value *= np.uint64(0x94D049BB133111EB)
    value ^= value >> np.uint64(29)
    return (value & np.uint64(TAIL - 1)).astype(np.int64) | TAIL


def word_code(lang: bytes, word: bytes, seed: int) -> int:
    import xxhash
    return xxhash.xxh64_intdigest(lang + b"\0" + word, seed) & (TAIL - 1) | TAIL


class Level:
    """Coding of a level. Tasks get its plain data and build it once."""

    def __init__(self, rest: tuple[np.ndarray, int] | None):
        self.bitmap, self.seed = rest or (None, 0)

    def may_be(self, codes: np.ndarray) -> np.ndarray:
        """Codes beyond the head, -1 where the bitmap rules them out."""
        return np.where(set_bits(self.bitmap, codes & (8 * len(self.bitmap) - 1)), codes, -1)


class Words(Level):
    def __init__(self, ids: dict[str, dict[bytes, int]], rest):
        super().__init__(rest)
        self.ids = ids

    @staticmethod
    def data(top: pa.Table, rest):
        ids: dict[str, dict[bytes, int]] = {}
        for k, (lang, word) in enumerate(zip(top["lang"].to_pylist(), top["word"].to_pylist())):
            ids.setdefault(lang, {})[utf8(word)] = k
        return ids, rest

    def codes(self, lang: str, tokens: list[bytes]) -> np.ndarray:
        get = self.ids.get(lang, {}).get
        out = np.array([get(t, -1) for t in tokens], np.int64)
        if self.bitmap is not None:
            beyond = [k for k in np.flatnonzero(out < 0).tolist() if tokens[k] != END]
            prefix = utf8(lang)
            if beyond:
                out[beyond] = self.may_be(np.array([word_code(prefix, tokens[k], self.seed) for k in beyond], np.int64))
        return out


class Pairs(Level):
    """Ids of frequent pairs of the level below, by exact search on packed pairs."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rest):
        super().__init__(rest)
        self.lefts, self.rights = np.unique(left), np.unique(right)
        key = self.pack(np.searchsorted(self.lefts, left), np.searchsorted(self.rights, right))
        self.order = np.argsort(key)
        self.keys = key[self.order]

    @staticmethod
    def data(top: pa.Table, rest):
        return top["l"].to_numpy(), top["r"].to_numpy(), rest

    @staticmethod
    def pack(left, right):
        return left.astype(np.int64) << 32 | right

    def ids(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 beyond the head."""
        if not len(self.keys) or not len(left):
            return np.full(len(left), -1, np.int64)
        l = np.minimum(np.searchsorted(self.lefts, left), len(self.lefts) - 1)
        r = np.minimum(np.searchsorted(self.rights, right), len(self.rights) - 1)
        key = self.pack(l, r)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        right_pair = (self.keys[at] == key) & (self.lefts[l] == left) & (self.rights[r] == right)
        return np.where(right_pair, self.order[at], -1)

    def lift(self, codes: np.ndarray) -> np.ndarray:
        """Codes of this level at every place, from the codes of the level below."""
        out = np.full(max(0, len(codes) - 1), -1, np.int64)
        both = np.flatnonzero((codes[:-1] >= 0) & (codes[1:] >= 0))
        left, right = codes[both], codes[both + 1]
        found = self.ids(left, right)
        if self.bitmap is not None:
            beyond = np.flatnonzero(found < 0)
            found[beyond] = self.may_be(mixed(left[beyond], right[beyond], self.seed))
        out[both] = found
        return out


def summed(left: np.ndarray, right: np.ndarray, count: np.ndarray | None = None):
    """Sorted COO: distinct pairs with the sums of their counts, 1 each where none are given."""
    if not len(left):
        return left, right, np.zeros(0, np.int64)
    if left.max() < SMALL and right.max() < SMALL:
        key = left << 32 | right
        if count is None:
            key.sort()
        else:
            order = key.argsort(kind="stable")
            key, count = key[order], count[order]
        left, right = key >> 32, key & (SMALL - 1)
    else:
        order = np.lexsort((right, left))
        left, right, count = left[order], right[order], None if count is None else count[order]
    starts = np.flatnonzero(np.concatenate(([True], (left[1:] != left[:-1]) | (right[1:] != right[:-1]))))
    sums = np.diff(np.append(starts, len(left))) if count is None else np.add.reduceat(count, starts)
    return left[starts], right[starts], sums


class Tiles:
    """Counts of pairs of one task: dense tiles among the most frequent ids, COO runs beside them."""

    def __init__(self):
        self.dense: dict[int, np.ndarray] = {}
        self.waiting, self.size = [], 0
        self.runs, self.held = [], 0

    def add(self, left: np.ndarray, right: np.ndarray):
        """Takes pairs; yields counted ones when too many are held."""
        self.waiting.append((left, right))
        self.size += len(left)
        if self.size >= CHUNK:
            yield from self.count()

    def count(self):
        if not self.size:
            return
        left, right = (np.concatenate(c) for c in zip(*self.waiting))
        self.waiting, self.size = [], 0
        tile = np.where((left < TILE * GRID) & (right < TILE * GRID), left // TILE * GRID + right // TILE, GRID * GRID)
        full = np.bincount(tile, minlength=GRID * GRID + 1)[:-1]
        for t in np.flatnonzero(full >= DENSE).tolist():
            mine = tile == t
            cells = left[mine] % TILE * TILE + right[mine] % TILE
            counts = np.bincount(cells, minlength=TILE * TILE)
            self.dense[t] = self.dense[t] + counts if t in self.dense else counts
            left, right, tile = left[~mine], right[~mine], tile[~mine]
        run = summed(left, right)
        self.runs.append(run)
        self.held += len(run[0])
        if self.held > RUNS:
            columns, self.runs = [np.concatenate(c) for c in zip(*self.runs)], []
            merged = summed(*columns)
            self.runs, self.held = [merged], len(merged[0])
            if self.held > RUNS // 2:
                self.runs, self.held = [], 0
                yield merged

    def rest(self):
        yield from self.count()
        if self.runs:
            yield summed(*(np.concatenate(c) for c in zip(*self.runs)))
        for t, counts in self.dense.items():
            cells = np.flatnonzero(counts)
            yield t // GRID * TILE + cells // TILE, t % GRID * TILE + cells % TILE, counts[cells]


def coded(docs: DataFrame, words) -> DataFrame:
    """(wide, codes): word codes of the documents, -1 between pieces and for rare words."""
    def run(batches):
        table = Words(*words.value)
        for batch in batches:
            parts = []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens = tokens_of(text)
                if tokens:
                    parts += [table.codes(lang, tokens), np.array([-1], np.int64)]
            if parts:
                joined = np.concatenate(parts)
                # A code without neighbours is in no phrase; of several gaps one is left.
                near = np.zeros(len(joined) + 1, bool)
                near[1:-1] = (joined[1:] >= 0) & (joined[:-1] >= 0)
                kept = near[:-1] | near[1:]
                gap = np.concatenate(([False], kept[:-1])) & ~kept
                joined = np.where(kept, joined, -1)[kept | gap]
            if parts and len(joined):
                wide = bool(joined.max() >= SMALL)
                data = joined.tobytes() if wide else joined.astype(np.int32).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([wide]), pa.array([data], pa.binary())],
                                                 names=["wide", "codes"])

    return _columns(docs).mapInArrow(run, "wide boolean, codes binary")


def pair_counts(codes: DataFrame, below: list, min_count: int) -> DataFrame:
    """(l, r, a) of neighbouring codes of the level that ``below`` (broadcasts) lifts to."""
    schema = "l long, r long, a long"

    def run(batches):
        levels, tiles = [Pairs(*b.value) for b in below], Tiles()

        def send(found):
            left, right, counts = found
            for k in range(0, len(left), 1 << 16):
                part = slice(k, k + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(c[part].astype(np.int64)) for c in (left, right, counts)],
                                                 names=["l", "r", "a"])

        for batch in batches:
            for wide, data in zip(*(c.to_pylist() for c in batch.columns)):
                value = np.frombuffer(data, np.int64 if wide else np.int32).astype(np.int64)
                for level in levels:
                    value = level.lift(value)
                both = np.flatnonzero((value[:-1] >= 0) & (value[1:] >= 0))
                for found in tiles.add(value[both], value[both + 1]):
                    yield from send(found)
        for found in tiles.rest():
            yield from send(found)

    counted = codes.mapInArrow(run, schema).groupBy("l", "r").agg(F.sum("a").alias("a"))
    return counted.filter(F.col("a") >= min_count)


def _ranked(frequent: DataFrame, heads: DataFrame, keys: list[str], head: int, code, filter_bits: int):
    """(table with ``code``, its head, filter and seed of the rest) of a staged table of frequent entries.

    The ``head`` most frequent rows of ``heads``, a bounded number, come to the driver
    to be ranked; ``code(rows, seed)`` gives the others their codes.
    """
    many = frequent.count() > head
    chosen = heads.orderBy(F.desc("a"), *keys).limit(head) if many else heads
    top = chosen.select(*keys, "a").toArrow().sort_by([("a", "descending"), *((k, "ascending") for k in keys)])
    numbered = frequent.sparkSession.createDataFrame(
        top.select(keys).append_column("code", pa.array(np.arange(len(top)))),
        T.StructType([*(frequent.schema[k] for k in keys), T.StructField("code", T.LongType())]))
    joined = frequent.join(numbered, keys, "left").select(*keys, "a", "code")
    if not many and heads is frequent:
        return stage(joined, "ranked"), top, None
    for seed in range(1, 20):
        beyond = code(joined.filter("code IS NULL").drop("code"), seed)
        table = stage(joined.filter("code IS NOT NULL").unionByName(beyond), "ranked")
        rest = table.filter(F.col("code") >= TAIL)
        if not rest.groupBy("code").count().filter("count > 1").limit(1).count():
            places = rest.select(F.col("code").bitwiseAND(F.lit((1 << filter_bits) - 1)).alias("place"))
            return table, top, (bitmap(places, filter_bits), seed)
    raise RuntimeError("codes of frequent entries collide under every seed")


def _word_codes(tail: DataFrame, seed: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            found = [word_code(utf8(g), utf8(w), seed) for g, w in zip(*(batch.column(k).to_pylist() for k in (0, 1)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())],
                                             names=["lang", "word", "a", "code"])

    return tail.select("lang", "word", "a").mapInArrow(run, "lang string, word string, a long, code long")


def _pair_codes(tail: DataFrame, seed: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            left, right = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(mixed(left, right, seed))],
                                             names=["l", "r", "a", "code"])

    return tail.select("l", "r", "a").mapInArrow(run, "l long, r long, a long, code long")


def mine(docs: DataFrame, min_count: int = 100, longest: int = 5, head: int = 1 << 19,
         filter_bits: int = 27) -> tuple[DataFrame, list[DataFrame]]:
    """((lang, n), phrases of 1, 2, ... words): each (lang, code, phrase, last, l, r, a, parts),
    ``parts`` being the counts of the first 1, 2, ... words and of the last 1, 2, ... words."""
    context = docs.sparkSession.sparkContext
    counted = stage(word_counts(docs).filter(F.col("word").isNull() | (F.col("a") >= min_count)), "words")
    sizes = counted.filter(F.col("word").isNull()).select("lang", F.col("a").alias("n"))
    frequent = counted.filter(F.col("word").isNotNull())
    long_word = F.octet_length("word") + F.octet_length("lang") > LONGEST_HEAD_WORD
    heads = frequent.filter(~long_word) if frequent.filter(long_word).limit(1).count() else frequent
    table, top, rest = _ranked(frequent, heads, ["lang", "word"], head, _word_codes, filter_bits)
    codes = stage(coded(docs, context.broadcast(Words.data(top, rest))), "codes")
    levels = [table.select("lang", "code", F.col("word").alias("phrase"), F.col("word").alias("last"),
                           F.lit(None).cast("long").alias("l"), F.lit(None).cast("long").alias("r"), "a",
                           F.array("a").alias("firsts"), F.array("a").alias("lasts"))]
    below: list = []
    for k in range(2, longest + 1):
        frequent = stage(pair_counts(codes, below, min_count), f"pairs-{k}")
        table, top, rest = _ranked(frequent, frequent, ["l", "r"], head, _pair_codes, filter_bits)
        below.append(context.broadcast(Pairs.data(top, rest)))
        first = levels[-1].select(F.col("code").alias("l"), "lang", "phrase", "firsts")
        second = levels[-1].select(F.col("code").alias("r"), "last", "lasts")
        levels.append(stage(table.join(first, "l").join(second, "r").select(
            "lang", "code", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "l", "r", "a",
            F.concat("firsts", F.array("a")).alias("firsts"), F.concat("lasts", F.array("a")).alias("lasts")),
            f"phrases-{k}"))
    return sizes, levels


def score(a, n, l, r):
    """floor(1000 * a * n / (l * r)), exact: products have up to 38 digits."""
    wide = [F.col(c).cast("decimal(38,0)") if isinstance(c, str) else c.cast("decimal(38,0)") for c in (a, n, l, r)]
    return F.call_function("div", F.lit(1000).cast("decimal(38,0)") * wide[0] * wide[1], wide[2] * wide[3])


def collocations(docs: DataFrame, min_count: int = 100, longest: int = 5, keep: int = 2000,
                 head: int = 1 << 19, filter_bits: int = 27) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``keep`` strongest phrases."""
    sizes, levels = mine(docs, min_count, longest, head, filter_bits)
    found = []
    for k in range(2, longest + 1):
        here = levels[k - 1].join(sizes, "lang")
        cuts = [F.struct(score("a", "n", F.col("firsts")[j - 1], F.col("lasts")[k - j - 1]).alias("score"),
                         F.lit(j).alias("k"), F.col("firsts")[j - 1].alias("l"), F.col("lasts")[k - j - 1].alias("r"))
                for j in range(1, k)]
        scored = here.withColumn("cut", F.array_min(F.array(*cuts))).select(
            "lang", "code", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
        if k < longest:     # words that stand in a longer phrase as often
            longer = levels[k].select("l", "r", "a")
            inside = longer.select(F.col("l").alias("code"), "a").unionByName(
                longer.select(F.col("r").alias("code"), "a"))
            scored = scored.join(inside, ["code", "a"], "left_anti")
        found.append(scored.select("lang", "phrase", "a", "l", "r", "n", "score"))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    strongest = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return every.withColumn("rank", F.row_number().over(strongest).cast("long")).filter(
        F.col("rank") <= keep).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ship_by_value(__name__)
