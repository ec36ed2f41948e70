"""Conversation structure repair: generalised LR parsing with weighted edits.

The roles of a conversation have to follow the grammar

    C -> (nothing) | T | s T        T -> P | T P        P -> u a

An LR automaton is built from it. Its stacks are cells ``(state, cell below)``, so
stacks share what lies under them, as in a graph-structured stack. Every row of a
conversation moves all live stacks at once by the actions keep (cost 0), rerole to
user or assistant (2) and delete (3, the only one for blank and duplicate rows);
inserting a user or assistant (2) is tried between rows. A truncated row that stays
adds 1. Equal stacks are merged by the least (cost, audit), the audit being the
initials of the actions: of two audits of one cost none begins the other, so the
least one stays least whatever follows.

Scale: rows are ordered by (conv_id, turn, role, text) over range partitions, so a
conversation of any length spreads over tasks. Conversations inside a partition are
repaired where they lie. The first and the last one of a partition, and longer ones
than ``HOLD`` rows, are written as segments of bounded length: a segment is
summarised as least (cost, audit) from every stack to every stack, summaries are
joined per conversation, texts are rendered per segment. Equal neighbours are
counted, not repeated. One byte a row (the audit) and the hash, which is sequential
by definition and reads a stream of 1 MB blobs, meet in one task per conversation.

Null turns come first. Rows of one turn are taken by role and text (the first 32
characters of each, then a digest). Null roles and texts count as one space. A null
conv_id is a conversation of its own. Rows marked ``dropped`` only keep their
conversation in the result. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.llm.common import stage, utf8
from furrow.session import ship_by_value

GRAMMAR = (("C", ("T",)), ("C", ("s", "T")), ("T", ("P",)), ("T", ("T", "P")), ("P", ("u", "a")))
NAMES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
HOLD = 1024
BLOB_BYTES = 1_000_000

DIGEST = [("gaps", T.LongType()), ("blank", T.LongType()), ("duplicate", T.LongType()),
          ("truncated", T.LongType()), ("illegal", T.LongType()), ("cost", T.LongType()),
          ("audit", T.StringType()), ("repaired_sha256", T.StringType())]
Best = dict  # stack -> (cost, audit)


class Automaton:
    """LR(0) automaton of a grammar without conflicts; the empty text is accepted."""

    def __init__(self, grammar=GRAMMAR):
        self.rules = (("^", (grammar[0][0],)), *grammar)
        heads = {head for head, _ in self.rules}
        states: list[frozenset] = []
        self.goto: dict[tuple[int, str], int] = {}

        def close(items) -> frozenset:
            found, work = set(items), list(items)
            while work:
                rule, dot = work.pop()
                body = self.rules[rule][1]
                if dot < len(body) and body[dot] in heads:
                    for k, (head, _) in enumerate(self.rules):
                        if head == body[dot] and (k, 0) not in found:
                            found.add((k, 0))
                            work.append((k, 0))
            return frozenset(found)

        states.append(close({(0, 0)}))
        for number, items in enumerate(states):     # grows while it is walked
            for symbol in sorted({self.rules[r][1][d] for r, d in items if d < len(self.rules[r][1])}):
                after = close({(r, d + 1) for r, d in items
                               if d < len(self.rules[r][1]) and self.rules[r][1][d] == symbol})
                if after not in states:
                    states.append(after)
                self.goto[number, symbol] = states.index(after)
        self.ends = [[r for r, d in items if d == len(self.rules[r][1])] for items in states]
        self.start = (0, None)
        self.moves: dict[tuple, tuple | None] = {}
        self.parsed: dict[str, tuple[int, str]] = {}

    def reductions(self, stack, final: bool):
        """Stacks that reductions lead to; the rules of the conversation only at its end."""
        out, work = [], [stack]
        while work:
            cell = work.pop()
            out.append(cell)
            for r in self.ends[cell[0]]:
                head, body = self.rules[r]
                if head == "^" or head == self.rules[1][0] and not final:
                    continue
                below = cell
                for _ in body:
                    below = below[1]
                work.append((self.goto[below[0], head], below))
        return out

    def move(self, stack, symbol: str):
        """The stack after shifting ``symbol`` and reducing, None if it can't be shifted."""
        key = stack, symbol
        if key not in self.moves:
            target = self.goto.get((stack[0], symbol))
            self.moves[key] = None if target is None else self.reductions((target, stack), False)[-1]
        return self.moves[key]

    def accepts(self, stack) -> bool:
        return stack == self.start or any(0 in self.ends[s[0]] for s in self.reductions(stack, True))

    def stacks(self) -> list:
        """All stacks that can be reached; finite, as the grammar only recurses to the left."""
        found = [self.start]
        for stack in found:
            for symbol in "sua":
                after = self.move(stack, symbol)
                if after is not None and after not in found:
                    found.append(after)
        return found


def _offer(best: Best, stack, cost: int, audit: str) -> bool:
    if stack is not None and (stack not in best or (cost, audit) < best[stack]):
        best[stack] = cost, audit
        return True
    return False


def inserted(lr: Automaton, best: Best) -> Best:
    """``best`` with every useful insertion added."""
    work = list(best)
    while work:
        stack = work.pop()
        cost, audit = best[stack]
        for symbol in NAMES:
            after = lr.move(stack, symbol)
            if _offer(best, after, cost + INSERT, audit + "I"):
                work.append(after)
    return best


def step(lr: Automaton, best: Best, token: str, times: int = 1) -> Best:
    """All live stacks after a row: role initial, then ``-`` (must go), ``t`` (truncated) or ``k``.

    ``times`` equal rows that must go are deleted at once: "D" sorts before "I", so
    nothing is inserted between them.
    """
    out: Best = {}
    initial, kind = token
    extra = TRUNCATED if kind == "t" else 0
    for stack, (cost, audit) in best.items():
        _offer(out, stack, cost + DELETE * times, audit + "D" * times)
        if kind == "-":
            continue
        if initial in "sua":
            _offer(out, lr.move(stack, initial), cost + KEEP + extra, audit + "K")
        for symbol in NAMES:
            if symbol != initial:
                _offer(out, lr.move(stack, symbol), cost + REROLE + extra, audit + "R")
    return inserted(lr, out)


def parse(lr: Automaton, tokens: str) -> tuple[int, str]:
    """Least (cost, audit) of a whole conversation; short ones that look alike are parsed once."""
    if tokens in lr.parsed:
        return lr.parsed[tokens]
    best = inserted(lr, {lr.start: (0, "")})
    for i in range(0, len(tokens), 2):
        best = step(lr, best, tokens[i:i + 2])
    found = min(value for stack, value in best.items() if lr.accepts(stack))
    if len(tokens) <= 64 and len(lr.parsed) < 10_000:
        lr.parsed[tokens] = found
    return found


def token(role: str, fault: str | None) -> str:
    initial = role[:1]
    return ((initial if initial and initial in "sua" else "x")
            + ("-" if fault in ("blank", "duplicate") else "t" if fault == "truncated" else "k"))


def fault_of(text: str, seen: bool) -> str | None:
    """The first fault of a row."""
    body = text.rstrip(" \t\n\v\f\r")
    if not body:
        return "blank"
    if seen:
        return "duplicate"
    return None if body[-1] in ".!?" else "truncated"


def repaired(lr: Automaton, rows: Iterable[tuple[str, str]], audit: str, stack=None) -> Iterator[tuple[str, str, str]]:
    """(action, role, text) of the repaired conversation; deleted rows are left out."""
    rows, stack = iter(rows), stack or lr.start
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        if letter == "K":
            stack = lr.move(stack, role[:1])
        else:
            symbol = next(s for s in NAMES if lr.move(stack, s) is not None)
            role, stack = NAMES[symbol], lr.move(stack, symbol)
        yield letter, role, text


class Tally:
    """Counts of a run of rows in order; two neighbouring runs add up."""

    def __init__(self):
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal = self.turns = 0
        self.low = self.high = None
        self.first = self.last = None

    def add(self, turn: int | None, role: str, fault: str | None, times: int = 1) -> None:
        if fault:
            self.faults[fault] += times
        self.illegal += times - 1 + (self.last is not None and self.last + role[:1] not in LEGAL)
        self.first = role[:1] if self.first is None else self.first
        self.last = role[:1]
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns

    def values(self) -> list[int]:
        return [self.gaps(), *self.faults.values(), self.illegal]


def repair_one(lr: Automaton, rows: list[tuple]) -> list:
    """Digest of a conversation held whole: ordered (turn, role, text, times) rows."""
    tally, seen, tokens, texts = Tally(), set(), [], []
    for turn, role, text, times in rows:
        for copy in range(min(times, 2)):
            fault = fault_of(text, (role, text) in seen)
            seen.add((role, text))
            many = 1 if not copy else times - 1
            tally.add(turn, role, fault, many)
            tokens += [token(role, fault)] * many
            texts += [(role, text)] * many
    cost, audit = parse(lr, "".join(tokens))
    lines = "\n".join(f"{role}:{text}" for _, role, text in repaired(lr, texts, audit))
    return [*tally.values(), cost, audit, hashlib.sha256(utf8(lines)).hexdigest()]


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, dropped): damage drawn by crc32 of ``conv_id:turn`` modulo 20."""
    c = conversations
    key = F.concat(F.coalesce(c["conv_id"].cast("string"), F.lit(" ")), F.lit(":"),
                   F.coalesce(c["turn"].cast("string"), F.lit(" ")))
    role, text = (F.coalesce(c[n].cast("string"), F.lit(" ")) for n in ("role", "text"))
    kind = F.crc32(key.cast("binary")) % 20
    rows = c.select(
        c["conv_id"].cast("long").alias("conv_id"), c["turn"].cast("long").alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind <= 1, F.lit("")).when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (kind == 0).alias("dropped"), F.when(kind == 3, 2).otherwise(1).alias("_copies"))
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).drop("_copies", "_copy")


def ordered(rows: DataFrame) -> DataFrame:
    """Rows over range partitions in the order of the conversations; a digest and
    the row number let even equal rows spread over partitions."""
    role, text = (F.coalesce(n, F.lit(" ")) for n in ("role", "text"))
    keyed = rows.select(
        "conv_id", "turn", role.alias("role"), text.alias("text"), "dropped",
        F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256).alias("digest"),
        F.monotonically_increasing_id().alias("_row"))
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.substring("role", 1, 32).asc(),
             F.substring("text", 1, 32).asc(), F.col("digest").asc(), F.col("_row").asc()]
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order)


_PART = [("segment", T.LongType()), ("place", T.LongType()), ("turn", T.LongType()), ("role", T.StringType()),
         ("text", T.StringType()), ("digest", T.StringType()), ("times", T.LongType())]
_PASSED = T.StructType([T.StructField("conv_id", T.LongType())]
                       + [T.StructField(n, t) for n, t in DIGEST + _PART])


def first_pass(rows: DataFrame, hold: int = HOLD) -> DataFrame:
    """Digests of the conversations that lie inside a partition; the others row by row
    (``segment`` is not null), equal neighbours with a number of times."""
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(_PASSED)

    def run(batches):
        pid, blank = TaskContext.get().partitionId() << 40, [None] * len(DIGEST)
        lr, out, place, segment = Automaton(), [], 0, pid

        def flush():
            columns = zip(*out) if out else [[] for _ in arrow]
            made = pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow)],
                                              schema=arrow)
            out.clear()
            return made

        def write_rows(conv, held):
            nonlocal place, segment
            if not held:          # keeps the conversation in the result
                out.append([conv, *blank, segment, None, None, None, None, None, 0])
            for turn, role, text, times, digest in held:
                out.append([conv, *blank, segment, pid + place, turn, role, text, digest, times])
                place += 1
            segment += 1

        started = streaming = False
        conv, held, count = None, [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if not started or row[0] != conv:
                    if started and not streaming:
                        out.append([conv, *repair_one(lr, [h[:4] for h in held]), *[None] * len(_PART)])
                    elif started:
                        write_rows(conv, held)
                    streaming, started = not started, True      # the first may go on from before
                    conv, held, count = row[0], [], 0
                if not row[4]:
                    same = held and held[-1][:3] == [row[1], row[2], row[3]]
                    if same:
                        held[-1][3] += 1
                    else:
                        held.append([row[1], row[2], row[3], 1, row[5]])
                    count += 1
                    if count >= hold:
                        streaming, count = True, 0
                        write_rows(conv, held)
                        held = []
                if len(out) >= 1000:
                    yield flush()
        if started:
            write_rows(conv, held)      # the last may go on after this partition
        yield flush()

    return rows.drop("_row").select("conv_id", "turn", "role", "text", "dropped", "digest").mapInArrow(run, _PASSED)


_SUMMARY = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("segment", T.LongType()),
    T.StructField("blank", T.LongType()), T.StructField("duplicate", T.LongType()),
    T.StructField("truncated", T.LongType()), T.StructField("illegal", T.LongType()),
    T.StructField("turns", T.LongType()), T.StructField("low", T.LongType()), T.StructField("high", T.LongType()),
    T.StructField("first", T.StringType()), T.StructField("last", T.StringType()),
    T.StructField("entry", T.ArrayType(T.LongType())), T.StructField("exit", T.ArrayType(T.LongType())),
    T.StructField("costs", T.ArrayType(T.LongType())), T.StructField("audits", T.ArrayType(T.StringType()))])


def _frame(rows: list, schema: T.StructType) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)
    columns = list(zip(*rows)) if rows else [[] for _ in arrow]
    return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow)], schema=arrow)


def summarise(key, table):
    """One segment: its tally, and the least (cost, audit) from every stack to every stack."""
    lr, tally, tokens = Automaton(), Tally(), []
    rows = sorted(r for r in zip(*(table.column(n).to_pylist() for n in ("place", "turn", "role", "kind", "first", "times")))
                  if r[0] is not None)
    for _, turn, role, kind, first, times in rows:      # place, then the row
        for n, fault in ((1, kind if first or kind == "blank" else "duplicate"),
                         (times - 1, "blank" if kind == "blank" else "duplicate")):
            fault = None if fault == "sound" else fault
            if n:
                tally.add(turn, role, fault, n)
                tokens.append((token(role, fault), n))
    entry, leave, costs, audits, stacks = [], [], [], [], lr.stacks()
    for start in stacks:
        best = {start: (0, "")}
        for t, n in tokens:
            best = step(lr, best, t, n)
        for stack, (cost, audit) in best.items():
            entry.append(stacks.index(start))
            leave.append(stacks.index(stack))
            costs.append(cost)
            audits.append(audit)
    return _frame([(key[0].as_py(), key[1].as_py(), *tally.faults.values(), tally.illegal, tally.turns, tally.low,
                    tally.high, tally.first, tally.last, entry, leave, costs, audits)], _SUMMARY)


_JOINED = T.StructType([T.StructField("conv_id", T.LongType()), *(T.StructField(n, t) for n, t in DIGEST[:-1]),
                        T.StructField("segment", T.LongType()), T.StructField("entry", T.LongType()),
                        T.StructField("part", T.StringType())])


def join_summaries(key, table):
    """One conversation: its digest but for the hash, and what becomes of each segment."""
    lr = Automaton()
    stacks = lr.stacks()
    parts = sorted(table.to_pylist(), key=lambda r: r["segment"])
    faults, illegal, turns, low, high, last = [0, 0, 0], 0, 0, None, None, None
    # stack -> (cost, audit, ((entry, end of the audit) per segment))
    best = {s: (c, a, ()) for s, (c, a) in inserted(lr, {lr.start: (0, "")}).items()}
    for p in parts:
        faults = [f + p[n] for f, n in zip(faults, ("blank", "duplicate", "truncated"))]
        illegal += p["illegal"]
        if p["first"] is not None:
            illegal += last is not None and last + p["first"] not in LEGAL
            last = p["last"]
        if p["low"] is not None:
            turns += p["turns"] - (high is not None and p["low"] == high)
            low, high = p["low"] if low is None else low, p["high"]
        after: dict = {}
        for e, x, cost, audit in zip(p["entry"], p["exit"], p["costs"], p["audits"]):
            before, old = best.get(stacks[e]), after.get(stacks[x])
            if before and (old is None or before[0] + cost <= old[0]):
                total, way = before[0] + cost, before[1] + audit
                if old is None or (total, way) < old[:2]:
                    after[stacks[x]] = total, way, (*before[2], (e, len(way)))
        best = after
    cost, audit, cuts = min(v for s, v in best.items() if lr.accepts(s))
    gaps = 0 if low is None else high - low + 1 - turns
    out, begin = [], 0
    for p, (entry, end) in zip(parts, cuts):
        # insertions before the first row belong to the first segment, from the start
        first = begin == 0 and p is parts[0]
        out.append((key[0].as_py(), gaps, *faults, illegal, cost, audit if first else None, p["segment"],
                    0 if first else entry, audit[begin:end]))
        begin = end
    return _frame(out, _JOINED)


_BLOB = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("segment", T.LongType()),
                      T.StructField("number", T.LongType()), T.StructField("blob", T.BinaryType())])


def render(key, rows, parts):
    """Repaired lines of one segment as blobs of about 1 MB, each line after a line feed."""
    if not parts.num_rows:
        return _frame([], _BLOB)
    lr, part = Automaton(), parts.to_pylist()[0]
    held = sorted(r for r in zip(*(rows.column(n).to_pylist() for n in ("place", "role", "text", "times")))
                  if r[0] is not None)
    each = ((role, text) for _, role, text, times in held for _ in range(times))
    out, blob = [], bytearray()

    def done():
        out.append((part["conv_id"], part["segment"], len(out), bytes(blob)))
        blob.clear()

    for _, role, text in repaired(lr, each, part["part"], lr.stacks()[part["entry"]]):
        blob += utf8(f"\n{role}:{text}")
        if len(blob) >= BLOB_BYTES:
            done()
    if blob:
        done()
    return _frame(out, _BLOB)


def hashes(blobs: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): blobs of a conversation as one ordered stream."""
    def run(batches):
        conv, state, skip = None, None, True
        for batch in batches:
            found = []
            for c, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if state is None or c != conv:
                    if state is not None:
                        found.append((conv, state.hexdigest()))
                    conv, state, skip = c, hashlib.sha256(), True
                state.update(blob[1:] if skip else blob)
                skip = False
            yield pa.RecordBatch.from_pylist([dict(zip(names, f)) for f in found], schema=arrow)
        if state is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(names, (conv, state.hexdigest())))], schema=arrow)

    names, arrow = ("conv_id", "sha"), pa.schema([("conv_id", pa.int64()), ("sha", pa.string())])
    sorted_blobs = blobs.repartition("conv_id").sortWithinPartitions("conv_id", "segment", "number")
    return sorted_blobs.select("conv_id", "blob").mapInArrow(run, "conv_id long, sha string")


def repair_segments(parts: DataFrame) -> DataFrame:
    """Digests of conversations that lie in several segments (a written table)."""
    first = (parts.filter(F.col("place").isNotNull()).groupBy("conv_id", "digest").agg(F.min("place").alias("place"))
             .select("place", F.lit(True).alias("first")))
    body = F.rtrim("text", F.lit(" \t\n\v\f\r"))
    kind = (F.when(body == "", "blank").when(F.substring(body, -1, 1).isin(".", "!", "?"), "sound")
            .otherwise("truncated"))
    narrow = parts.select("conv_id", "segment", "place", "turn", "role", kind.alias("kind"), "times")
    marked = narrow.join(first, "place", "left").withColumn("first", F.coalesce("first", F.lit(False)))
    summaries = marked.groupBy("conv_id", "segment").applyInArrow(summarise, _SUMMARY)
    joined = stage(summaries.groupBy("conv_id").applyInArrow(join_summaries, _JOINED), "joined")
    blobs = (parts.select("conv_id", "segment", "place", "role", "text", "times").groupBy("conv_id", "segment")
             .cogroup(joined.select("conv_id", "segment", "entry", "part").groupBy("conv_id", "segment"))
             .applyInArrow(render, _BLOB))
    whole = joined.filter(F.col("audit").isNotNull()).alias("j")
    sha = hashes(blobs).alias("h")
    return whole.join(sha, F.col("j.conv_id").eqNullSafe(F.col("h.conv_id")), "left").select(
        "j.conv_id", *(f"j.{n}" for n, _ in DIGEST[:-1]),
        F.coalesce("h.sha", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def repair(rows: DataFrame, hold: int = HOLD) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)
    of every conversation of rows (conv_id, turn, role, text, dropped)."""
    passed = stage(first_pass(ordered(rows), hold), "repair")
    columns = ["conv_id", *(n for n, _ in DIGEST)]
    parts = passed.filter(F.col("segment").isNotNull()).select("conv_id", *(n for n, _ in _PART))
    return passed.filter(F.col("segment").isNull()).select(columns).unionByName(
        repair_segments(parts).select(columns))


ship_by_value(__name__)
