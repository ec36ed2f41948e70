"""Decontamination, quality rules, classifiers, language, scoring, licences, pipeline."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
from conftest import SMALL
from oracle import compare, connect
from pyspark.sql import functions as F

import corpus_pipeline
from furrow.llm import (decontamination, language_id, licenses, lm_score, quality_model, quality_rules,
                        toxicity)
from furrow.llm.queries import ORACLES, QUERIES

MID = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(low)


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_twins_in_sql(spark):
    con = connect(SMALL)
    for name, sql in ORACLES.items():
        assert compare(spark, con, SMALL, QUERIES[name], sql) == "", name


def brute_hits(text, bench, window=10):
    found, hit, names = words(text), set(), set()
    for item, other in bench:
        w = words(other)
        m = min(window, len(w))
        for s in range(len(w) - m + 1 if m else 0):
            for i in range(len(found) - m + 1):
                if found[i:i + m] == w[s:s + m]:
                    hit.update(range(i, i + m))
                    names.add("" if item is None else str(item))
    digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
    return len(found), len(hit), len(names), digest, bool(hit)


def test_decontamination(spark, documents, odd, nothing):
    bench = [(1, "a b c d e f g h i j k l"), (2, "X y"), (3, None), (4, ""), (5, "é"), (None, "seven eight nine ten"),
             (10, "X y"), (11, "word " * 12), (12, "b a b a b a b a b a b a b")]
    rows = [(1, "zz A b c,d e f g h i j K l zz x Y"), (2, "x y x y"), (3, "É é"), (4, "a b c d e f g h i"),
            (5, "b a " * 20), (6, None)]
    for block in (4_000_000, 20):
        for frame in (documents(rows), odd):
            got = decontamination.digest(frame, items(spark, bench), block_bytes=block)
            want = Counter((r.doc_id, *brute_hits(r.text if r.doc_id != 5 or frame is not odd else "word " * 40, bench))
                           if not (r.doc_id == 5 and frame is odd) else ("long",) for r in frame.collect())
            have = Counter(("long",) if r.doc_id == 5 and frame is odd else tuple(r) for r in got.collect())
            assert have == want
    assert decontamination.digest(nothing, items(spark, bench)).count() == 0
    assert not decontamination.digest(odd, items(spark, [])).filter("contaminated").count()
    clean = decontamination.drop_contaminated(documents(rows), items(spark, bench))
    assert [r.doc_id for r in clean.collect()] == [4, 6] and "score" in clean.columns
    spans = decontamination.find_passages(documents(rows[:1]), items(spark, bench)).first()
    assert spans.spans == [[1, 11], [2, 12], [3, 13], [14, 16]] and spans["items"] == ["1", "10", "2"]


def test_quality_ledger(odd, nothing):
    rows = quality_rules.ledger(odd).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    assert by[1].n_words == by[3].n_words == 0 and by[1].failed & quality_rules.BIT["few_words"]
    assert by[5].n_repeat_words == 30_000 and by[5].failed & quality_rules.BIT["repeats"]
    assert by[6].word_chars == 2 + 1 + 3 + 13 + 1
    assert quality_rules.ledger(nothing).count() == 0
    kept = quality_rules.keep_good(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {4}


def test_ablations_equal_direct_counts(spark):
    ledger = quality_rules.ledger(spark.read.parquet(f"{MID}/documents.parquet"))
    failed = [r.failed for r in ledger.select("failed").collect()]
    for r in quality_rules.ablations(ledger, "v2").collect():
        bit, mask = quality_rules.BIT[r.rule], quality_rules.mask("v2")
        assert r.n_failed == sum(bool(f & bit) for f in failed)
        assert r.n_only == sum(f & mask == bit for f in failed)
        assert r.n_kept_without == sum(not f & mask & ~bit for f in failed)


def held_out(spark, rows, column):
    labels = {r.doc_id: r[column] for r in spark.read.parquet(f"{MID}/labels.parquet").collect()}
    return [(labels[r.doc_id], r) for r in rows if r.held_out and r.doc_id in labels]


def test_toxicity(spark, odd, nothing):
    rows = QUERIES["op2_toxicity"](spark, MID).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    pairs = held_out(spark, rows, "toxic")
    assert sum(r.predicted == y for y, r in pairs) / len(pairs) > 0.9
    labels = spark.read.parquet(f"{MID}/labels.parquet")
    got = toxicity.score_documents(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score_documents(nothing, labels.filter("false")).count() == 0


def test_label_model_finds_accuracies_without_labels():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.15
    votes = np.stack([np.where(y, rng.random(4000) < a, rng.random(4000) < b)
                      for a, b in ((0.7, 0.02), (0.5, 0.01), (0.6, 0.03), (0.4, 0.01))], 1).astype(np.float32)
    votes = np.concatenate((votes, votes[:, :1], ~votes.any(1, keepdims=True)), axis=1)
    model = toxicity.label_model(votes)
    assert ((model["posterior"] > 0.5) == y).mean() > 0.93
    assert model["weights"][0] < model["weights"][1]      # its copy is counted once


def test_quality_model(spark, odd):
    rows = QUERIES["op8_quality_classifier"](spark, MID).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    pairs = held_out(spark, rows, "quality")
    assert sum(r.predicted == y for y, r in pairs) / len(pairs) > 0.9
    labels = spark.read.parquet(f"{MID}/labels.parquet").filter("false")
    assert {r.score for r in quality_model.score_documents(odd, labels).collect()} == {0.5}


def test_language(spark, odd, nothing):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{MID}/documents.parquet").collect()}
    rows = [r for r in QUERIES["op10_language_id"](spark, MID).collect() if r.held_out]
    assert sum(lang[r.doc_id] == r.lang_pred for r in rows) / len(rows) > 0.95
    assert {r.lang_pred for r in language_id.predict_documents(odd).collect()} == {"und"}
    assert language_id.predict_documents(nothing).count() == 0
    code = language_id.codewords(40).astype(int)
    assert ((code.shape[1] - code @ code.T) // 2 + 99 * np.eye(40, dtype=int)).min() >= code.shape[1] // 4


def test_lm_score_against_plain_counts(spark, documents, odd):
    rows = [(1, "a b a b c"), (2, "a b"), (3, "x y z"), (4, None), (5, "a a a"), (5, "a a a")]
    got = {r.doc_id: r for r in lm_score.score_documents(
        documents(rows), spark.createDataFrame([(1,), (1,), (None,)], "doc_id long")).collect()}
    texts = [(i, (t or "").split()) for i, t in rows]
    used = len({w for _, t in texts for w in t})

    def model(chosen, scale):
        return (Counter(w for t in chosen for w in t), Counter(p for t in chosen for p in zip(["^"] + t, t)), scale)

    size = 5
    every = [t for _, t in texts]
    models = [model([texts[0][1]], 1.0), model(every, size / sum(map(len, every)))]

    def loss(t, m):
        total = 0.0
        for k, w in enumerate(t):
            unigram = (m[0][w] * m[2] + 1) / (size + used)
            context = m[0][t[k - 1]] * m[2] if k else 0.0
            seen = min(m[1][t[k - 1], w] * m[2], context) if k else 0.0
            total -= np.log((seen + lm_score.MASS * unigram) / (context + lm_score.MASS))
        return total / len(t)

    for i, t in texts:
        if t:
            assert abs(got[i].target_loss - loss(t, models[0])) < 1e-5
            assert abs(got[i].background_loss - loss(t, models[1])) < 1e-5
    assert got[4].n_tokens == 0 and got[4].difference is None
    assert lm_score.score_documents(odd, odd.select("doc_id").filter("false")).count() == odd.count()


def test_lm_score_counts_rare_pairs_among_many(spark, documents):
    """More distinct words and pairs than any fixed table holds: exact counts, hot words, all buckets."""
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice(("the", "of", f"w{rnd.randrange(400_000)}", f"v{rnd.randrange(50)}")) for _ in range(2000))
             for _ in range(400)]
    texts += ["rare context here", "rare context here"]
    got = {r.doc_id: r for r in lm_score.score_documents(
        documents(list(enumerate(texts))), spark.createDataFrame([(i,) for i in range(0, 402, 3)], "doc_id long")).collect()}
    split = [t.split() for t in texts]
    models = []
    for chosen in (split[::3], split):
        models.append((Counter(w for t in chosen for w in t), Counter(p for t in chosen for p in zip(t, t[1:]))))
    size, used = sum(models[0][0].values()), len(models[1][0])
    scale = size / sum(models[1][0].values())
    for i in (0, 1, 57, 400, 401):
        t = split[i]
        for (words, pairs), s, value in ((models[0], 1.0, got[i].target_loss), (models[1], scale, got[i].background_loss)):
            want = 0.0
            for k, w in enumerate(t):
                context, seen = (words[t[k - 1]] * s, pairs[t[k - 1], w] * s) if k else (0.0, 0.0)
                unigram = (words[w] * s + 1) / (size + used)
                want -= np.log((seen + lm_score.MASS * unigram) / (context + lm_score.MASS))
            assert abs(value - want / len(t)) < 1e-9 and got[i].n_tokens == len(t)


def test_licenses(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [(1, "r/a/LICENSE", mit), (2, "r/a/b/x.txt", "plain words"), (3, "r/a/c/y.txt", f"hello\n{gpl}\nbye"),
            (4, "r/z/q.txt", "plain"), (5, "r/a/b/COPYING", gpl), (6, "r/a/b/d/e.txt", None), (7, None, mit),
            (None, "r/a/k.txt", ""), (8, "q.txt", "license"), (1, "r/a/LICENSE", mit)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: (r.license, r.origin) for r in got}
    assert by == {1: ("MIT", "file"), 2: ("GPL-3.0", "inherited"), 3: ("GPL-3.0", "header"), 4: (None, "none"),
                  5: ("GPL-3.0", "file"), 6: ("GPL-3.0", "inherited"), 7: ("MIT", "header"),
                  None: ("MIT", "inherited"), 8: (None, "none")}
    empty = spark.createDataFrame([], "doc_id long, path string, text string")
    assert licenses.scan(empty).count() == 0


def test_license_query_finds_lines(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{MID}/documents.parquet").collect()}
    fixed = {name: text for name, text in licenses.TEMPLATES}
    for r in QUERIES["op5_license_scan"](spark, MID).collect():
        lines = [n for n, t in fixed.items() if t in (docs[r.doc_id] or "").split("\n")]
        if lines:
            assert r.own_license in lines and r.origin in ("header", "file")


def test_pipeline_stages(spark, odd, nothing):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "toxicity", "near_duplicates", "decontamination", "packing"]
    for name, step in corpus_pipeline.STAGES:
        for frame in (odd, nothing):
            out = step(spark, frame, SMALL)
            if name != "packing":
                assert out.columns == frame.columns
            assert out.count() <= frame.count() * 600


def test_pipeline_end(spark):
    """Rows of the end against the digests of the stages' operators."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    good = {r.doc_id for r in quality_rules.digest(docs).collect() if r.kept}
    last = {r.doc_id for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert last and last <= good
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert not any(brute_hits(texts[i], bench)[4] for i in list(last)[:40])


def test_decontamination_tables_of_many_blocks(spark, documents):
    """A benchmark of several blocks hits what one block hits; its tables stay near the text's size."""
    rnd = random.Random(9)
    vocabulary = [f"w{i}" for i in range(3000)]
    bench = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([3, 12, 60])))) for i in range(900)]
    rows = []
    for i in range(300):
        held = [rnd.choice(vocabulary) for _ in range(80)]
        if i % 3 == 0:
            taken = rnd.choice(bench)[1].split()
            held[20:20] = taken[:max(1, len(taken) - rnd.randrange(3))]
        rows.append((i, " ".join(held)))
    one = decontamination.digest(documents(rows), items(spark, bench)).collect()
    many = decontamination.digest(documents(rows), items(spark, bench), block_bytes=20_000).collect()
    assert sorted(one) == sorted(many) and any(r.contaminated for r in one)
    for r in one[:30]:
        assert tuple(r)[1:] == brute_hits(rows[r.doc_id][1], bench)
    tables = decontamination.prepare(bench, 10)
    size = sum(len(t) for _, t in bench)
    held = sum(a.nbytes for c in tables["classes"].values() for a in c) + tables["ids"].nbytes
    assert held < 12 * size


def test_conflicting_labels_and_repeated_rows(spark, documents):
    """An id with two labels has the larger one; an id with two texts one of them, whatever the partitions."""
    docs = documents([(i % 40, f"text {i % 80} of words") for i in range(160)])
    labels = spark.createDataFrame([(i % 40, i // 40) for i in range(80)], "doc_id long, toxic int")
    seen = []
    for parts in (1, 7):
        from furrow.llm.common import labelled_sample
        got = labelled_sample(docs.repartition(parts), labels.repartition(parts), "toxic", F.lit(True), 30)
        seen.append(sorted(got.collect()))
    assert seen[0] == seen[1] and len(seen[0]) == 30 and {r.label for r in seen[0]} == {1}
