"""Token counts and packing against the defining library."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SMALL  # noqa: F401
from hypothesis import given, settings
from hypothesis import strategies as st

from furrow.llm import bpe, packing, token_counts
from furrow.llm.queries import QUERIES, vocabulary_path

tokenizers = pytest.importorskip("tokenizers")
LIBRARY = tokenizers.Tokenizer.from_file(vocabulary_path())
WHOLE = token_counts.whole_tokens(vocabulary_path())
COUNT = token_counts.counter(vocabulary_path(), WHOLE, bpe.patterns())
ENCODE = bpe.encoder(vocabulary_path(), bpe.patterns())


def library(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=("Cs",)), st.sampled_from(" '\n\t²Ⅷ\x1c\x85st")),
               max_size=60))
def test_any_text(text):
    want = library(text)
    assert np.frombuffer(ENCODE(text), "<u4").tolist() == want
    assert COUNT(text) == len(want)


def test_special_strings_and_whole_tokens():
    for text in ("<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endof", "'s'll  x\n\n y"):
        assert COUNT(text) == len(library(text))
    assert " the" in WHOLE and all(len(library(t)) == 1 for t in list(WHOLE)[:500])


def test_counts_of_documents(spark, odd, nothing):
    for frame in (odd, spark.read.parquet(f"{SMALL}/documents.parquet")):
        texts = Counter((r.doc_id, len((r.text or "").encode()), len(library(r.text)), len(library(r.text)) > 512)
                        for r in frame.collect())
        assert Counter(map(tuple, token_counts.count_tokens(frame, vocabulary_path()).collect())) == texts
    assert token_counts.count_tokens(nothing, vocabulary_path()).count() == 0


def check_packing(rows, texts, size):
    """Every id once and in order, sequences gapless and within their size."""
    ids = {i: library(t) + [2] for i, t in texts}
    parts, filled = defaultdict(list), defaultdict(list)
    for r in rows:
        parts[r.doc_id].append(r)
        filled[r.sequence_id].append((r.offset, r.length))
    for i, want in ids.items():
        at = 0
        for k, r in enumerate(sorted(parts[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (k == 0 or r.length == size)
            piece = np.array(want[at:at + r.length], "<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(piece)
            at += r.length
        assert at == len(want)
    for spans in filled.values():
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at <= size
    return len(filled), sum(len(v) for v in ids.values())


def test_packs_the_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    used, total = check_packing(QUERIES["op1_best_fit_packing"](spark, SMALL).collect(), texts, 1024)
    assert used <= -(-total // 1024) * 1.02 + 1


def test_packs_odd_rows_and_rebuilds_sequences(documents, odd, nothing):
    rows = packing.pack_documents(odd, vocabulary_path(), 64).collect()
    assert sum(r.length for r in rows if r.doc_id == 4) == 2 * (len(library(odd.filter("doc_id = 4").first().text)) + 1)
    assert [r.length for r in rows if r.doc_id == 1] == [1]
    assert packing.pack_documents(nothing, vocabulary_path()).count() == 0
    texts = [(i, "some words to pack here " * (i % 7)) for i in range(40)]
    docs = documents(texts)
    placed = packing.pack_documents(docs, vocabulary_path(), 64)
    check_packing(placed.collect(), texts, 64)
    whole = {r.sequence_id: r.ids for r in packing.token_sequences(docs, placed, vocabulary_path()).collect()}
    for r in placed.collect():
        ids = (library(dict(texts)[r.doc_id]) + [2])[r.start:r.start + r.length]
        assert whole[r.sequence_id][r.offset:r.offset + r.length] == ids


@pytest.mark.parametrize("fit", ["norm", "dot"])
def test_every_capacity_holds(fit):
    rng = np.random.default_rng(0)
    lengths = np.sort(rng.integers(1, 101, 3000))[::-1]
    bins, offsets = packing.place(lengths, (100, 5, 10_000), fit=fit)
    for limit, cost in ((100, lengths), (5, np.ones_like(lengths)), (10_000, lengths ** 2)):
        assert np.bincount(bins, weights=cost).max() <= limit
    assert bins.max() + 1 <= 1.05 * max(lengths.sum() / 100, len(lengths) / 5) + 1
    tight = packing.place(lengths[lengths <= 50], (100, 50, 3_000), fit=fit)[0]
    assert np.bincount(tight, weights=lengths[lengths <= 50] ** 2).max() <= 3_000
