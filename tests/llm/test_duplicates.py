"""Near duplicates against all pairs."""

import random
from collections import Counter

import numpy as np
from conftest import SMALL

from furrow.llm import graphs, near_duplicates
from furrow.llm.queries import QUERIES


def shingles(text):
    words = (text or "").encode().lower().split()
    n = min(5, len(words))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if n else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    label = {i: i for i, _ in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(a), find(b)
                label[max(p, q)] = min(p, q)
    return Counter((i, len(s), find(i), find(i) == i) for i, s in sets)


def test_table_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = Counter(map(tuple, QUERIES["op7_minhash_near_dedup"](spark, SMALL).collect()))
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def threshold_rows():
    """A chain and a star of copies whose similarities lie around 0.75."""
    rng, vocabulary = random.Random(3), [f"w{i}" for i in range(4000)]
    base, rows = rng.choices(vocabulary, k=120), []
    for i in range(150):
        copy = list(base)
        for _ in range(i % 8):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        rows.append((i, " ".join(copy)))
        if i % 30 == 29:
            base = copy
    return rows


def test_groups_at_the_threshold(documents):
    rows = threshold_rows()
    got = Counter(map(tuple, near_duplicates.near_duplicates(documents(rows)).collect()))
    assert got == brute(rows)


def test_frequent_keys_in_parts(documents, monkeypatch):
    """Keys of more nodes than a task takes are compared in pairs of parts."""
    monkeypatch.setattr(near_duplicates, "KEY_NODES", 4)
    monkeypatch.setattr(near_duplicates, "KEY_BATCH", 20)
    rows = threshold_rows()
    got = Counter(map(tuple, near_duplicates.near_duplicates(documents(rows)).collect()))
    assert got == brute(rows)


def _signed(n, seed=5):
    """Families of signatures around the kept distance, sizes around the kept ratio."""
    rng = np.random.default_rng(seed)
    heads = rng.integers(0, 2**16, (6, 48), np.uint16)
    symbols = heads[rng.integers(0, 6, n)]
    for row in symbols:
        at = rng.permutation(48)[:rng.integers(8, 22)]
        row[at] = rng.integers(0, 2**16, len(at), np.uint16)
    return symbols, rng.integers(70, 110, n)


def _kept(symbols, sizes):
    far = (symbols[:, None] != symbols[None]).sum(axis=2)
    ratio = np.minimum(sizes[:, None], sizes) * 100 >= np.maximum(sizes[:, None], sizes) * 75
    return (far <= near_duplicates.KEEP_DISTANCE) & ratio


def _components(n, edges):
    label = list(range(n))
    for _ in range(n):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_forest_under_a_key(monkeypatch):
    symbols, sizes = _signed(60)
    for step in (1, 7, 1000):
        monkeypatch.setattr(near_duplicates, "PAIRS_AT_ONCE", 60 * step)
        for group in (np.arange(60), np.arange(60) // 3):
            pairs = {(group[a], group[b]) for a, b in zip(*np.nonzero(_kept(symbols, sizes)))}
            got = near_duplicates.connect_under_key(symbols, sizes, group)
            assert got.tolist() == _components(group.max() + 1, pairs)


def test_key_links_of_parts(spark, monkeypatch):
    """One key of all nodes, cut into parts: the pairs connect what all kept pairs connect."""
    symbols, sizes = _signed(40)
    longs = symbols.view(np.int64)
    signed = spark.createDataFrame(
        [(i, int(sizes[i]), *map(int, longs[i])) for i in range(40)],
        "node long, n long, " + ", ".join(f"{x} long" for x in near_duplicates.LONGS))
    placed = spark.createDataFrame([(7, i, i) for i in range(40)], "key long, node long, component long")
    wanted = _components(40, list(zip(*np.nonzero(_kept(symbols, sizes)))))
    for nodes in (2000, 9):
        monkeypatch.setattr(near_duplicates, "KEY_NODES", nodes)
        got = [(r.a, r.b) for r in near_duplicates.key_links(placed, signed).collect()]
        assert all(_kept(symbols, sizes)[[a, b]].any() for a, b in got)
        assert _components(40, got) == wanted
    assert near_duplicates.key_links(placed.filter("node < 0"), signed).collect() == []


def test_blocks_of_a_large_cluster(documents, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BATCH_NODES", 10)
    rows = [(i, " ".join(f"a{j}" for j in range(60)) + f" end{i}") for i in range(35)]
    got = near_duplicates.near_duplicates(documents(rows)).collect()
    assert {r.component_id for r in got} == {0}


def test_odd_rows(odd, nothing):
    got = near_duplicates.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert by[None].component_id is None and by[None].kept
    assert all(by[i].n_shingles == 0 and by[i].component_id == i and by[i].kept for i in (1, 2, 3))
    assert by[5].n_shingles == 1
    assert near_duplicates.near_duplicates(nothing).count() == 0
    kept = near_duplicates.keep_one(odd)
    assert kept.columns == odd.columns and kept.filter("doc_id = 4").count() == 1
    assert kept.count() == odd.count() - 1


def test_signature_distance_guarantee():
    """Signatures within 23 symbols share a key."""
    rng = np.random.default_rng(1)
    for _ in range(300):
        a = rng.integers(0, 65536, 48)
        b = a.copy()
        b[rng.choice(48, 23, replace=False)] ^= 1
        equal = (a == b).reshape(12, 4).sum(1)
        assert equal.max() >= 3


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 200)], "a long, b long")
    got = {r.node: r.component for r in graphs.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 200: 100}


def test_texts_are_filtered_before_they_move(spark, documents):
    """Whichever way the planner joins, only texts of candidate nodes (and few others) reach an exchange."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = threshold_rows()
        docs = documents(rows + [(1000 + i, f"text {i} of its own, unlike the others") for i in range(3000)])
        placed = spark.createDataFrame([(i, 0, 1, 0) for i, _ in rows], "node long, part int, parts int, batch long")
        plan = near_duplicates.full_sets(docs, placed)
        assert plan.count() == len(rows)
        bits, size = near_duplicates.id_filter(placed.select("node"), "node")
        passed = docs.select(near_duplicates.id_place(docs["doc_id"], size).alias("p")).toArrow()["p"].to_numpy()
        assert near_duplicates.set_bits(bits, passed).sum() < len(rows) + 300
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in text and text.count("MapInArrow") >= 2
        got = Counter(map(tuple, near_duplicates.near_duplicates(documents(rows)).collect()))
        assert got == brute(rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_rows_of_one_id_leave_a_defined_row(spark, documents):
    docs = documents([(i % 20, f"row {i} " * 12) for i in range(80)] + [(None, "none")])
    kept = [sorted((r.doc_id or -1, r.text) for r in near_duplicates.keep_one(docs.repartition(n)).collect())
            for n in (1, 6)]
    assert kept[0] == kept[1] and len(kept[0]) <= 21
