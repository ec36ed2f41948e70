"""Near duplicates on word shingles by a multi-index Hamming join of b-bit signatures.

A document's set holds its distinct five-word shingles. Documents are linked when
100 * |intersection| >= 75 * |union|; links are confirmed on the full sets.

1. Equal sets fall into one class, represented by its smallest id.
2. A class has a signature of 48 symbols of 16 bits (the b-bit minima of 48
   permutations of its set), kept as 12 chunks of four symbols, one chunk a long.
   Two signatures that differ in at most 23 symbols have, by the pigeonhole
   principle, a chunk with at most one error; so each chunk is indexed under the
   four keys that leave out one of its symbols, and every pair within that
   distance meets under a key. (At a similarity of 0.75 a pair misses all keys
   with probability 1e-7; pairs that meet are kept up to distance 27.)
3. Pairs that meet and are kept connect classes to *candidate clusters*. First each
   class is paired with the smallest id it meets, then, where the clusters still
   differ, with the smallest under each key. Keys that still hold several clusters
   are then compared node by node inside tasks, a frequent key in pairs of parts;
   a task returns a spanning forest of the clusters, not the pairs. A large group of
   near copies so gives a few rows per member, and yet every kept pair lies inside
   one cluster.
4. Inside the clusters every pair is compared on the full sets. Small clusters are
   dealt to batches; a cluster above the limits of a batch is cut into blocks and
   each pair of blocks is a task of its own. Tasks give a spanning forest of the
   links they find, not the links, and its components are the result.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a text of fewer words is
one shingle. Null, empty and blank texts have no shingle and are linked with
nothing. A row with a null id is linked with nothing (null component, kept). Rows
that share an id count as one document with all their links. An empty table gives
an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.llm.common import id_filter, id_place, score_texts, set_bits, stage, utf8
from furrow.llm.graphs import components
from furrow.session import ship_by_value

WORDS, SIMILARITY = 5, 75
CHUNKS, LANES = 12, 4
SYMBOLS = CHUNKS * LANES
KEEP_DISTANCE = 27
BATCH_NODES, BATCH_SHINGLES = 1000, 1_000_000
KEY_NODES, KEY_BATCH, PAIRS_AT_ONCE = 2000, 20_000, 200_000
CACHE_ENTRIES = 200_000
LONGS = [f"l{c}" for c in range(CHUNKS)]


class Shingler:
    """Sets and signatures of texts; word hashes are cached per task."""

    def __init__(self, words: int = WORDS, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.words, self.cache = words, {}
        self.place = rng.integers(1, 2**63, words, np.uint64) | np.uint64(1)
        self.multiply = (rng.integers(1, 2**32, SYMBOLS, np.uint64) | np.uint64(1)).astype(np.uint32)
        self.add = rng.integers(0, 2**32, SYMBOLS, np.uint64).astype(np.uint32)

    @staticmethod
    def mix(x: np.ndarray, by: int = 0x9E3779B97F4A7C15) -> np.ndarray:
        x = (x ^ (x >> np.uint64(32))) * np.uint64(by)
        return x ^ (x >> np.uint64(29))

    def hashes(self, text: str | None) -> np.ndarray:
        """Distinct 64-bit shingle hashes, ascending."""
        words = utf8(text).lower().split() if text else []
        if not words:
            return np.empty(0, np.uint64)
        if len(words) < self.words:
            return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
        cache = self.cache
        if len(cache) > CACHE_ENTRIES:
            cache.clear()
        ids = [cache.get(w) for w in words]
        if None in ids:
            for i, w in enumerate(words):
                if ids[i] is None:
                    ids[i] = cache[w] = xxhash.xxh64_intdigest(w)
        ids, n = np.array(ids, np.uint64), len(words) - self.words + 1
        total = ids[:n] * self.place[0]
        for k in range(1, self.words):
            total += self.mix(ids[k:k + n]) * self.place[k]
        return np.unique(self.mix(total))

    def set_key(self, hashes: np.ndarray) -> tuple[int, int]:
        """128 bits that name a set."""
        one = self.mix(hashes, 0xD6E8FEB86659FD93).sum(dtype=np.uint64)
        two = self.mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5), 0xCA5A826395121157).sum(dtype=np.uint64)
        return tuple(np.array([one, two]).view(np.int64).tolist())

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        """48 symbols of 16 bits as 12 longs."""
        low = (hashes >> np.uint64(32)).astype(np.uint32)
        best = np.full(SYMBOLS, 0xFFFFFFFF, np.uint32)
        for s in range(0, len(low), 4096):
            best = np.minimum(best, (low[s:s + 4096, None] * self.multiply + self.add).min(axis=0))
        symbols = ((best * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype("<u2")
        return symbols.view("<i8")


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, s1, s2, l0..l11) of every row."""
    def make():
        shingler = Shingler()

        def run(texts):
            sizes, keys, rows = [], [], []
            for text in texts:
                hashes = shingler.hashes(text)
                sizes.append(len(hashes))
                keys.append(shingler.set_key(hashes))
                rows.append(shingler.signature(hashes))
            longs = np.stack(rows, axis=1)
            return sizes, [k[0] for k in keys], [k[1] for k in keys], *longs

        return run

    fields = ["n_shingles", "s1", "s2", *LONGS]
    return score_texts(docs, make, [(f, T.LongType()) for f in fields])


def chunk_keys() -> Column:
    """The 48 index keys of a signature: a chunk without one lane, which holds the
    key's number instead."""
    keys = []
    for c, name in enumerate(LONGS):
        for lane in range(LANES):
            clear = ~(0xFFFF << 16 * lane) & 0xFFFFFFFFFFFFFFFF
            signed = clear - (1 << 64) if clear >> 63 else clear
            number = (c * LANES + lane) << 16 * lane
            keys.append(F.col(name).bitwiseAND(F.lit(signed).cast("long")).bitwiseOR(F.lit(number).cast("long")))
    return F.explode(F.array(*keys))


def distance(a: str, b: str) -> Column:
    """Number of differing 16-bit symbols of two signatures."""
    total = F.lit(0)
    for name in LONGS:
        x = F.col(f"{a}.{name}").bitwiseXOR(F.col(f"{b}.{name}"))
        for shift in (8, 4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        total = total + F.bit_count(x.bitwiseAND(F.lit(0x0001000100010001).cast("long")))
    return total


def alike(a: str, b: str) -> Column:
    """Sizes and signatures leave a similarity of 0.75 possible."""
    x, y = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (F.least(x, y) * 100 >= F.greatest(x, y) * SIMILARITY) & (distance(a, b) <= KEEP_DISTANCE)


def full_sets(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """``placed`` rows (node, part, parts, batch) with the shingles of the node's
    whole text; rows that share id and text give one set.

    A bitmap of the nodes is sent ahead, so that only their texts (and those of some
    ids that share a bit) reach the join, whichever way the planner joins.
    """
    wanted_ids, bits = id_filter(placed.select("node"), "node")
    sent = docs.sparkSession.sparkContext.broadcast(wanted_ids)
    keyed = docs.select(docs["doc_id"].alias("node"), docs["text"].cast("string").alias("text"))
    keyed = keyed.withColumn("place", id_place(F.col("node"), bits))
    place = keyed.columns.index("place")

    def near(batches):
        for batch in batches:
            yield batch.filter(pa.array(set_bits(sent.value, batch.column(place).to_numpy())))

    wanted = keyed.mapInArrow(near, keyed.schema).join(placed, "node").select("text", *placed.columns)
    schema = T.StructType([*wanted.schema.fields[1:], T.StructField("s1", T.LongType()),
                           T.StructField("s2", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType()))])

    def run(batches):
        shingler = Shingler()
        for batch in batches:
            sets = [shingler.hashes(t) for t in batch.column(0).to_pylist()]
            keys = [shingler.set_key(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], *(pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)),
                 pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=schema.names)

    return wanted.mapInArrow(run, schema).groupBy(*placed.columns, "s1", "s2").agg(
        F.first("shingles").alias("shingles")).drop("s1", "s2")


def intersections(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """n x n sizes of the common parts of sets, valid above the diagonal."""
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.empty(0, int)
    times = np.diff(np.r_[starts, len(values)])
    out = np.zeros((n, n), np.int32)
    flat = out.reshape(-1)
    few, dense = 16, max(16, n // 8)
    for p in range(2, few + 1):                      # short postings: all at once, by length
        at = starts[times == p]
        if len(at):
            owners = owner[at[:, None] + np.arange(p)]
            for i in range(p):
                for j in range(i + 1, p):
                    np.add.at(flat, owners[:, i].astype(np.int64) * n + owners[:, j], 1)
    for at, p in zip(starts[(times > few) & (times <= dense)], times[(times > few) & (times <= dense)]):
        own = owner[at:at + p]
        out[np.ix_(own, own)] += 1
    long = np.flatnonzero(times > dense)             # shared by many: a matrix product
    for k in range(0, len(long), 1024):
        part = long[k:k + 1024]
        member = np.zeros((n, len(part)), np.float32)
        for c, g in enumerate(part):
            member[owner[starts[g]:starts[g] + times[g]], c] = 1
        out += (member @ member.T).astype(np.int32)
    return out


def connect(label: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Labels, each the smallest of its component, after further edges."""
    left, right = label[left], label[right]
    apart = left != right
    left, right, root = left[apart], right[apart], np.arange(len(label))
    while True:
        least = root.copy()
        np.minimum.at(least, left, root[right])
        np.minimum.at(least, right, root[left])
        least = least[least]
        if (least == root).all():
            return root[label]
        root = least


def forest(sizes: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For sets given one after the other: the first set each is connected with by
    links of at least the similarity."""
    n = len(sizes)
    common = intersections(values, np.repeat(np.arange(n), sizes), n)
    left, right = np.nonzero(np.triu(common, 1))
    both = common[left, right].astype(np.int64)
    linked = 100 * both >= SIMILARITY * (sizes[left] + sizes[right] - both)
    return connect(np.arange(n), left[linked], right[linked])


def exact_links(docs: DataFrame, clusters: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) that connect what the full sets connect inside each cluster."""
    sized = stage(clusters.join(classes.select("node", "n"), "node"), "sized")
    totals = sized.groupBy("component").agg(F.count("*").alias("nodes"), F.sum("n").alias("shingles"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("nodes") / BATCH_NODES), F.ceil(F.col("shingles") / BATCH_SHINGLES))
    totals = totals.withColumn("parts", parts.cast("int"))
    small = totals.filter("parts = 1").agg(F.sum("nodes"), F.sum("shingles")).first()
    batches = max(1, -(-(small[0] or 0) // BATCH_NODES), -(-(small[1] or 0) // BATCH_SHINGLES))
    placed = stage(sized.join(totals.select("component", "parts"), "component").select(
        "node", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), "parts",
        F.when(F.col("parts") == 1, F.pmod(F.xxhash64("component"), F.lit(batches))).otherwise(
            F.col("component")).alias("batch")), "placed")
    # a part meets every other part of its cluster once
    other = F.explode(F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(
        F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: x != F.col("part"))))
    rows = full_sets(docs, placed).withColumn("other", other).select(
        "node", "shingles", "batch", "parts", F.least("part", "other").alias("low"),
        F.greatest("part", "other").alias("high"))
    node = rows.schema["node"].dataType
    schema = T.StructType([T.StructField("a", node), T.StructField("b", node)])

    def run(key, rows):
        rows = rows.combine_chunks()
        lists = rows.column("shingles").chunk(0) if rows.num_rows else None
        sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        first = forest(sizes, lists.flatten().to_numpy())
        moved = np.flatnonzero(first != np.arange(len(first)))
        ids = rows.column("node")
        return pa.table([ids.take(pa.array(first[moved])), ids.take(pa.array(moved))], names=["a", "b"])

    links = rows.groupBy(F.col("parts") == 1, "batch", "low", "high").applyInArrow(run, schema)
    return stage(links.filter("a <> b").distinct(), "links")


def join_clusters(grouped: DataFrame, bridges: DataFrame) -> DataFrame:
    """Clusters (node, component) after connecting some by pairs (a, b) of nodes."""
    named = lambda side: grouped.select(F.col("node").alias(side), F.col("component").alias(f"{side}_c"))
    ends = stage(bridges.join(named("a"), "a", "left").join(named("b"), "b", "left").select(
        F.coalesce("a_c", "a").alias("a"), F.coalesce("b_c", "b").alias("b")).distinct(), "bridges")
    merged = components(ends).toDF("old", "new")
    whole = grouped.join(merged, F.col("component") == F.col("old"), "left").select(
        "node", F.coalesce("new", "component").alias("component"))
    single = merged.join(grouped, F.col("old") == F.col("node"), "left_anti").select(
        F.col("old").alias("node"), F.col("new").alias("component"))
    return stage(whole.union(single), "clusters")


def connect_under_key(symbols: np.ndarray, sizes: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For groups 0, 1, ... of signatures: the first group each is connected with by
    kept pairs. Distances are made for a few rows against all others at a time."""
    n, label = len(sizes), np.arange(group.max() + 1)
    step = max(1, PAIRS_AT_ONCE // n)
    for at in range(0, n - 1, step):
        own, more = slice(at, at + step), slice(at + 1, n)
        x, y = sizes[own, None], sizes[None, more]
        kept = (np.minimum(x, y) * 100 >= np.maximum(x, y) * SIMILARITY) & (
            label[group[own]][:, None] != label[group[more]])
        left, right = np.nonzero(kept)
        left, right = left + at, right + at + 1
        near = (symbols[left] != symbols[right]).sum(axis=1) <= KEEP_DISTANCE
        if near.any():
            label = connect(label, group[left[near]], group[right[near]])
    return label


def key_links(placed: DataFrame, signed: DataFrame) -> DataFrame:
    """Pairs (a, b) of components that connect what the kept pairs under each key connect.

    ``placed`` has rows (key, node, component). Keys whose nodes are of one component
    need no work. The others are dealt to batches; the nodes of a very frequent key are
    cut into parts, and each pair of parts is a task of its own. A key gives fewer
    pairs than it has components, whatever number of its nodes are alike.
    """
    keys = stage(placed.groupBy("key").agg(
        F.count("*").alias("nodes"), F.min("component").alias("x"), F.max("component").alias("y")).filter(
        "x <> y").select("key", "nodes", F.ceil(F.col("nodes") / KEY_NODES).cast("int").alias("parts")), "open")
    small = keys.filter("parts = 1").agg(F.sum("nodes")).first()[0] or 0
    batches = max(1, -(-small // KEY_BATCH))
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    other = F.explode(F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(
        F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: x != F.col("part"))))
    rows = placed.join(keys.drop("nodes"), "key").join(signed, "node").withColumn("part", part).withColumn(
        "other", other).select(
        "key", "component", "n", *LONGS, (F.col("parts") == 1).alias("whole"),
        F.when(F.col("parts") == 1, F.pmod(F.xxhash64("key"), F.lit(batches))).otherwise(F.col("key")).alias("batch"),
        F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
    node = rows.schema["component"].dataType
    schema = T.StructType([T.StructField("a", node), T.StructField("b", node)])

    def run(_, rows):
        rows = rows.combine_chunks()
        symbols = np.stack([rows.column(name).to_numpy() for name in LONGS], axis=1).view(np.uint16)
        sizes, keys = rows.column("n").to_numpy(), rows.column("key").to_numpy()
        coded = rows.column("component").chunk(0).dictionary_encode()
        component = coded.indices.to_numpy()
        order = np.argsort(keys, kind="stable")
        cuts = np.flatnonzero(np.diff(keys[order])) + 1
        a, b = [], []
        for at in np.split(order, cuts):
            names, group = np.unique(component[at], return_inverse=True)
            first = connect_under_key(symbols[at], sizes[at], group)
            moved = np.flatnonzero(first != np.arange(len(first)))
            a.append(names[first[moved]])
            b.append(names[moved])
        ends = [coded.dictionary.take(pa.array(np.concatenate(x))) for x in (a, b)]
        return pa.table(ends, names=["a", "b"])

    return stage(rows.groupBy("whole", "batch", "low", "high").applyInArrow(run, schema).distinct(), "bridges")


def candidate_clusters(classes: DataFrame) -> DataFrame:
    """(node, component) of classes that a chain of kept pairs connects."""
    keyed = classes.select("node", chunk_keys().alias("key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).filter("first <> last")
    met = stage(keyed.join(shared.drop("last"), "key"), "keys")
    signed = classes.drop("s1", "s2")

    def kept(pairs: DataFrame) -> DataFrame:
        return stage(pairs.join(signed.alias("p"), F.col("a") == F.col("p.node")).join(
            signed.alias("q"), (F.col("b") == F.col("q.node")) & alike("p", "q")).select("a", "b"), "pairs")

    # a node with the smallest of all it meets, then with the smallest under each key
    apart = met.filter("first <> node")
    grouped = components(kept(apart.groupBy("node").agg(F.min("first").alias("a")).withColumnRenamed("node", "b")))
    ends = apart.select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    named = lambda side: grouped.select(F.col("node").alias(side), F.col("component").alias(f"{side}_c"))
    ends = ends.join(named("a"), "a", "left").join(named("b"), "b", "left").filter(
        F.coalesce("a_c", "a") != F.coalesce("b_c", "b")).select("a", "b")
    grouped = join_clusters(grouped, kept(ends))

    # then what else the pairs under each key connect
    placed = met.select("key", "node").join(grouped, "node", "left").select(
        "key", "node", F.coalesce("component", "node").alias("component"))
    rest = key_links(placed, signed)
    return grouped if rest.isEmpty() else join_clusters(grouped, rest)


def link_classes(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, component) of the classes that are linked with another class."""
    clusters = candidate_clusters(classes)
    return components(exact_links(docs, clusters, classes))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    base = stage(signatures(docs), "signatures")
    named = base.filter("doc_id IS NOT NULL AND n_shingles > 0")
    classes = stage(named.groupBy("s1", "s2").agg(
        F.min("doc_id").alias("node"), F.min("n_shingles").alias("n"),
        *[F.min(name).alias(name) for name in LONGS]), "classes")
    # rows that share an id are one document, so their classes are linked
    ids = named.groupBy("doc_id").agg(F.min("s1").alias("x"), F.max("s1").alias("y")).filter("x <> y").select("doc_id")
    linked = link_classes(docs, classes)
    if not ids.isEmpty():
        shared = named.join(ids, "doc_id").join(classes.select("s1", "s2", "node"), ["s1", "s2"])
        linked = widen(linked, shared.select(F.col("node").alias("a"), F.col("doc_id").alias("b")))
    found = classes.select("s1", "s2", "node").join(linked, "node", "left").select(
        "s1", "s2", F.coalesce("component", "node").alias("component_id"))
    rows = base.select("doc_id", "n_shingles", "s1", "s2").join(found, ["s1", "s2"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(
        F.col("doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"),
                       F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def widen(linked: DataFrame, links: DataFrame) -> DataFrame:
    """Components after further links between nodes."""
    own = linked.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return components(stage(own.union(links).distinct(), "links"))


def keep_one(docs: DataFrame) -> DataFrame:
    """Documents, with all their columns, of which one of each group stays.

    Rows with a null id stay; of rows that share an id, the one whose columns have
    the smallest hash stays.
    """
    columns = docs.columns
    dropped = stage(near_duplicates(docs).filter(~F.col("kept")).select("doc_id").distinct(), "dropped")
    left = docs.join(dropped, "doc_id", "left_anti").select(*columns)
    ids = left.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 AND doc_id IS NOT NULL").select("doc_id")
    repeated = stage(ids, "repeated")
    if repeated.isEmpty():
        return left
    many = left.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(
        F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("_row")).select("_row.*")
    return left.join(repeated, "doc_id", "left_anti").select(*columns).unionByName(many)


ship_by_value(__name__)
