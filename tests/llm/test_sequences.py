"""Order MinHash, collocations and conversation repair against plain recomputations."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SMALL
from oracle import compare, connect

from furrow.llm import collocations, conversation_repair, order_minhash
from furrow.llm.oracles import ORACLES

MID = "/root/testdata/sf0.01"


# Order MinHash

def plain_entries(text, k=8, m=64, l=2):
    """One entry at a time: occurrence-numbered k-mers, smallest of each order, tuple in text order."""
    method, base, odd, mask = order_minhash.OrderMinHash(k, m, l), order_minhash.BASE, int(order_minhash.ODD), (1 << 64) - 1

    def mix(x):
        x = (x ^ x >> 32) * base & mask
        x = (x ^ x >> 29) * odd & mask
        return x ^ x >> 32

    k, seen, values = min(k, len(text)), Counter(), []
    for i in range(len(text) - k + 1 if k else 1):
        value = 0
        for c in text[i:i + k]:
            value = (value * base + ord(c) + 1) & mask
        values.append(mix((value + seen[value] * odd) & mask))
        seen[value] += 1
    out = []
    for j in range(m):
        order = sorted((((v >> 32) * int(method.factor[j, 0])) % (1 << 32), i) for i, v in enumerate(values))[:l]
        entry = (j + 1) * odd & mask
        for _, i in sorted(order, key=lambda p: p[1]):
            entry = mix((entry * base + values[i]) & mask)
        out.append(entry >> 32)
    return np.array(out, np.uint32)


def test_entries_equal_the_plain_form():
    rnd = random.Random(2)
    for text in ("", "a", "abcdefgh", "abababababababababab", "x" * 300, "中文\U0001f642" * 30,
                 "".join(rnd.choice("ab ") for _ in range(9000))):
        for k, l in ((8, 2), (5, 3), (1, 1)):
            got = order_minhash.OrderMinHash(k, 64, l).entries(order_minhash.codes_of(text))
            assert (got == plain_entries(text, k, 64, l)).all(), (text[:20], k, l)


def test_shared_start_gives_the_same_entries():
    rnd, method = random.Random(3), order_minhash.OrderMinHash()
    for _ in range(60):
        text = "".join(rnd.choice("abc ") for _ in range(rnd.randrange(60)))
        tail = "".join(rnd.choice("abc ") for _ in range(rnd.randrange(15)))
        keep = len(text) - len(text) // 4
        own, other = method.both_entries(order_minhash.codes_of(text), keep, order_minhash.codes_of(tail))
        assert (own == plain_entries(text)).all() and (other == plain_entries(text[:keep] + tail)).all()


def test_likeness_follows_edits_and_order():
    rnd, method = random.Random(4), order_minhash.OrderMinHash(8, 256, 2)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(9)) for _ in range(200)]
    entries = lambda w: method.entries(order_minhash.codes_of(" ".join(w)))
    one = entries(words)
    few, many = entries(words[:95] + words[100:]), entries(words[:60] + words[100:])
    moved = entries(words[100:] + words[:100])                       # nearly the same k-mers, other order
    near = [order_minhash.likeness(one, x) for x in (one, few, many, moved)]
    assert near[0] == 1 and near[1] > near[2] > 0.3 and near[3] < near[1] - 0.2


def edited_with_next(rows):
    """{position: (n_chars, sha of the edited text, text, edited, next text)} in the order of ids."""
    out = []
    for k, (_, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        quarter = len(text) // 4
        out.append((text, text[:len(text) - quarter] + following[:quarter], following))
    return out


def as_hex(text):
    return plain_entries(text).astype(">u4").tobytes().hex()


def test_documents_meet_the_next_one(spark, documents, odd, nothing):
    rnd = random.Random(5)
    rows = [(i, None if i % 7 == 3 else "".join(rnd.choice("ab cd") for _ in range(rnd.randrange(40)))) for i in range(60)]
    want = {i: w for (i, _), w in zip(rows, edited_with_next([(i, t or "") for i, t in rows]))}
    got = order_minhash.compare_with_next(documents(rows[::-1]).repartition(3)).collect()
    assert len(got) == len(rows)
    for r in got:
        text, changed, following = want[r.doc_id]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert r.fingerprint == as_hex(text) and r.edited_fingerprint == as_hex(changed)
        assert r.near_edited == (plain_entries(text) == plain_entries(changed)).mean()
        assert r.near_next == (plain_entries(text) == plain_entries(following)).mean()
    assert order_minhash.compare_with_next(nothing).count() == 0
    alone = order_minhash.compare_with_next(documents([(9, "one single document")])).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0
    strange = order_minhash.compare_with_next(odd).collect()
    assert sorted(str(r.doc_id) for r in strange) == sorted(str(r.doc_id) for r in odd.collect())
    assert len({r.fingerprint for r in strange if r.n_chars == 0}) == 1
    copies = order_minhash.compare_with_next(documents([(None, "the same text in every row")] * 300)).collect()
    assert len(copies) == 300 and {r.near_next for r in copies} == {1.0}
    assert order_minhash.fingerprints(odd).count() == odd.count()


# Collocations

def plain_collocations(rows, least, longest=5, keep=2000):
    found, sizes = {}, Counter()
    for lang, text in rows:
        lang, low = lang or "und", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for c in ".,;:!?\n\x0b\x0c\r":
            low = low.replace(c, "\n")
        for piece in low.split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            sizes[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    key = lang, tuple(words[i:i + k])
                    found[key] = found.get(key, 0) + 1
    found = {p: a for p, a in found.items() if a >= least}
    out = {}
    for (lang, p), a in found.items():
        inside = any(g == lang and len(q) > len(p) and b >= a and any(q[i:i + len(p)] == p for i in range(len(q)))
                     for (g, q), b in found.items())
        if len(p) > 1 and not inside:
            cuts = []
            for j in range(1, len(p)):
                l, r = found[lang, p[:j]], found[lang, p[j:]]
                cuts.append((1000 * a * sizes[lang] // (l * r), j, l, r))
            s, _, l, r = min(cuts)
            out.setdefault(lang, []).append((-s, -a, " ".join(p).encode(), l, r))
    return {(lang, k + 1, p.decode(), -a, l, r, sizes[lang], -s) for lang, some in out.items()
            for k, (s, a, p, l, r) in enumerate(sorted(some)[:keep])}


def test_collocations_against_plain_counts(spark, odd, nothing):
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(12)] + ["é", "中文", "A" * 90, "X"]
    rows = [(rnd.choice(["en", None, "xx"]), "".join(rnd.choice(words[:6] if rnd.random() < 0.7 else words) + rnd.choice(
        [" ", " ", " ", "\t", ". ", "\n", "\x0b", "  "]) for _ in range(rnd.randrange(200)))) for _ in range(60)]
    rows += [("en", "solid phrase of five words")] * 9 + [(None, None), ("en", ""), ("en", " . ")]
    frame = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    want = plain_collocations(rows, 8)
    assert any(p == "solid phrase of five words" for _, _, p, *_ in want) and len({len(w[2].split()) for w in want}) > 2
    for head in (1 << 19, 9):                            # all ranked; most beyond the head
        got = collocations.collocations(frame, 8, head=head, filter_bits=15).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want), head
    few = collocations.collocations(frame, 8, keep=3).collect()
    assert {tuple(r) for r in few} == plain_collocations(rows, 8, keep=3)
    assert collocations.collocations(nothing, 2).count() == 0
    assert [(r.phrase, r.a) for r in collocations.collocations(odd, 100).collect()] == [
        (" ".join(["word"] * k), 30_001 - k) for k in range(2, 6)]


def test_collocation_scores_pass_64_bits(spark):
    rows = [(10**12 + 7, 9 * 10**13 + 1, 10**12 + 9, 3 * 10**12 + 1), (9 * 10**17, 9 * 10**16, 9 * 10**17, 9 * 10**17)]
    got = spark.createDataFrame(rows, "a long, n long, l long, r long").select(
        collocations.score("a", "n", "l", "r").alias("s")).collect()
    assert [r.s for r in got] == [1000 * a * n // (l * r) for a, n, l, r in rows]


def test_tiles_equal_plain_counts(monkeypatch):
    for name, value in (("TILE", 8), ("DENSE", 40), ("CHUNK", 500), ("RUNS", 300)):
        monkeypatch.setattr(collocations, name, value)
    rng = np.random.default_rng(7)
    ids = [np.minimum(rng.zipf(1.3, 5000) - 1, 10_000) for _ in range(2)]
    ids[0][::50] |= collocations.TAIL
    tiles, got = collocations.Tiles(), Counter()
    for k in range(0, 5000, 333):
        for l, r, n in tiles.add(ids[0][k:k + 333], ids[1][k:k + 333]):
            got.update(dict(zip(zip(l.tolist(), r.tolist()), n.tolist())))
    assert tiles.dense
    for l, r, n in tiles.rest():
        for pair, count in zip(zip(l.tolist(), r.tolist()), n.tolist()):
            got[pair] += count
    assert got == Counter(zip(ids[0].tolist(), ids[1].tolist()))


# Conversations

AFTER = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def plain_repair(rows):
    """Digest of ordered (turn, role, text) rows by a hand-made automaton."""
    def close(best):
        for _ in range(4):
            for state, (cost, audit) in list(best.items()):
                for symbol in "ua":
                    after = AFTER[state].get(symbol)
                    if after is not None and (after not in best or (cost + 2, audit + "I") < best[after]):
                        best[after] = cost + 2, audit + "I"
        return best

    faults, illegal, last, seen, best = Counter(), 0, None, set(), close({0: (0, "")})
    for _, role, text in rows:
        illegal += last is not None and last + role[:1] not in ("su", "ua", "au")
        last, body = role[:1], text.strip(" \t\n\v\f\r")
        fault = ("blank" if not body else "duplicate" if (role, text) in seen
                 else "truncated" if body[-1] not in ".!?" else None)
        faults[fault] += 1
        seen.add((role, text))
        new = {}

        def offer(state, cost, audit):
            if state is not None and (state not in new or (cost, audit) < new[state]):
                new[state] = cost, audit

        for state, (cost, audit) in best.items():
            offer(state, cost + 3, audit + "D")
            if fault not in ("blank", "duplicate"):
                more = cost + (fault == "truncated")
                offer(AFTER[state].get(role[:1]), more, audit + "K")
                for symbol in "ua":
                    offer(AFTER[state].get(symbol), more + 2, audit + "R")
        best = close(new)
    cost, audit = min(best[s] for s in (0, 3) if s in best)
    lines, left, before = [], iter(rows), None
    for letter in audit:
        _, role, text = next(left) if letter != "I" else (None, "", "")
        if letter != "D":
            role = role if letter == "K" else "assistant" if before == "u" else "user"
            lines.append(f"{role}:{text}")
            before = role[0]
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def plain_digest(rows):
    held = {}
    for conv, turn, role, text in rows:
        mine = held.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
            mine += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: plain_repair(sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))) for c, r in held.items()}


def strange_conversations():
    rnd = random.Random(8)
    rows = [(c, rnd.choice([t, t, t, 2 * t, None]), rnd.choice(["user", "assistant", "system", "tool", "", None, "user"]),
             rnd.choice(["hi.", "ok", "  ", "yes!\n", "wh? ", "a ", f"x {rnd.randrange(9)}.", None, "", "é "]))
            for c in [*range(40), None] for t in range(rnd.randrange(1, 25))]
    rows += [(77, t // 3, rnd.choice(["user", "assistant"]), rnd.choice([f"hi {t}."] * 9 + ["ok", "same.", ""]))
             for t in range(1500)]
    rows += [(78, 5, "user", "same.")] * 1500 + [(79, None, "user", "long " * 40_000 + ".")]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("hold", [conversation_repair.HOLD, 9])
def test_repair_against_plain_form(spark, hold):
    rows = strange_conversations()
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows],
                                  "conv_id long, turn long, role string, text string, cost string, segment int")
    got = conversation_repair.repair(conversation_repair.damage(frame.repartition(5)), hold).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == plain_digest(rows) and len(got) == len({r[0] for r in rows})


def test_repair_of_nothing(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert conversation_repair.repair(conversation_repair.damage(spark.createDataFrame([], schema))).count() == 0
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = conversation_repair.repair(conversation_repair.damage(
        spark.createDataFrame([(gone, 0, "user", "a.")], schema))).collect()
    assert [tuple(r) for r in got] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


def test_grammar_automaton():
    lr = conversation_repair.Automaton()

    def run(symbols):
        stack = lr.start
        for symbol in symbols:
            stack = stack and lr.move(stack, symbol)
        return stack is not None and lr.accepts(stack)

    assert [run(t) for t in ("", "ua", "sua", "uaua", "suaua")] == [True] * 5
    assert [run(t) for t in ("s", "u", "a", "au", "uau", "us", "ssua", "uas")] == [False] * 8


def test_new_twins_in_sql(spark):
    from furrow.llm.queries import QUERIES
    for folder in (SMALL, MID):
        for name in ("op12_collocations", "op13_conversation_repair"):
            note = compare(spark, connect(folder), folder, QUERIES[name], ORACLES[name])
            assert note == "" or note == "no rows" and folder == SMALL, (name, note)
