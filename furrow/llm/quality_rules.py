"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and
one bit per failed rule; a policy is a versioned mask. Applying another version,
or asking what a rule alone removes, reads the ledger's integers and never the
texts.

Null and empty texts have no words, fail ``few_words`` and are rejected by every
policy that holds it. Repeated rows and null ids are judged row by row. An empty
table gives an empty ledger.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.llm.common import keep_rows, score_texts, space_words
from furrow.session import ship_by_value

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]

# Rule name -> (failure as SQL over the measures, the same as a function of a row); bit = place.
RULES = {
    "few_words": ("n_words < 10", lambda m: m["n_words"] < 10),
    "repeats": ("100 * n_repeat_words > 20 * n_words",
                lambda m: 100 * m["n_repeat_words"] > 20 * m["n_words"]),
    "symbols": ("2 * n_symbols > n_words", lambda m: 2 * m["n_symbols"] > m["n_words"]),
    "dup_lines": ("n_lines >= 4 AND 2 * n_dup_lines > n_lines",
                  lambda m: m["n_lines"] >= 4 and 2 * m["n_dup_lines"] > m["n_lines"]),
    "long_words": ("word_chars > 40 * n_words", lambda m: m["word_chars"] > 40 * m["n_words"]),
    "short_words": ("word_chars < 2 * n_words", lambda m: m["word_chars"] < 2 * m["n_words"]),
}
BIT = {name: 1 << k for k, name in enumerate(RULES)}

# Version -> rules that reject.
POLICIES = {
    "v1": ("few_words", "repeats"),
    "v2": ("few_words", "repeats", "symbols", "dup_lines", "long_words", "short_words"),
}
BASE = BIT["few_words"] | BIT["repeats"]

_SYMBOL = re.compile(r"[#*$%&|<>]")


def mask(policy: str) -> int:
    return sum(BIT[r] for r in POLICIES[policy])


def measure(text: str | None) -> tuple[int, ...]:
    """The measures of one text, in the order of ``MEASURES``."""
    words = space_words(text)
    n = len(words)
    if not n:
        return 0, 0, len(_SYMBOL.findall(text or "")), 0, 0, 0
    lines = [line for line in text.split("\n") if space_words(line)]
    repeated = 0
    if n > 5:
        windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
        if len(set(windows)) < len(windows):
            seen, twice = set(), set()
            for w in windows:
                (twice if w in seen else seen).add(w)
            reach = 0
            for i, w in enumerate(windows):
                if w in twice:
                    repeated += i + 5 - max(i, reach)
                    reach = i + 5
    chars = len(text) if text.isascii() else None
    if chars is None:
        word_chars = sum(len(w.decode("utf-8", "surrogatepass")) for w in words)
    else:
        word_chars = sum(map(len, words))
    return n, word_chars, len(_SYMBOL.findall(text)), len(lines) - len(set(lines)), repeated, len(lines)


def failures(measures: tuple[int, ...]) -> int:
    row = dict(zip(MEASURES, measures))
    return sum(BIT[name] for name, (_, fails) in RULES.items() if fails(row))


def ledger(docs: DataFrame) -> DataFrame:
    """(doc_id, measures, failed): every rule's bit, evaluated once."""
    def make():
        return lambda texts: tuple(zip(*(measure(t) for t in texts))) if texts else ([],) * len(MEASURES)

    measured = score_texts(docs, make, [(m, T.LongType()) for m in MEASURES])
    bits = [F.when(F.expr(sql), F.lit(BIT[name])).otherwise(F.lit(0)) for name, (sql, _) in RULES.items()]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measured.withColumn("failed", failed.cast("int"))


def kept(failed: Column, policy: str) -> Column:
    """Whether a policy keeps a row of the ledger."""
    return failed.bitwiseAND(F.lit(mask(policy))) == 0


def ablations(ledger_rows: DataFrame, policy: str) -> DataFrame:
    """Per rule of a policy: rows it fails, rows only it rejects, rows kept without
    it. One aggregation over distinct failure masks (at most 2^rules rows)."""
    m = mask(policy)
    counts = ledger_rows.groupBy(F.col("failed").bitwiseAND(F.lit(m)).alias("mask")).agg(
        F.count("*").alias("n"))
    named = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).alias("bit"))
                                for r in POLICIES[policy]])).alias("r")
    rows = counts.select("mask", "n", named)
    hit = F.col("mask").bitwiseAND(F.col("r.bit")) != 0
    without = F.col("mask").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0
    return rows.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(hit & without, F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(without, F.col("n")).otherwise(0)).alias("n_kept_without"))


def digest(docs: DataFrame, policy: str = "v2") -> DataFrame:
    """(doc_id, n_words, four base measures, base_failed, kept, failed)."""
    rows = ledger(docs)
    return rows.select("doc_id", *MEASURES[:5],
                       (F.col("failed").bitwiseAND(F.lit(BASE)) != 0).alias("base_failed"),
                       kept(F.col("failed"), policy).alias("kept"), "failed")


def keep_good(docs: DataFrame, policy: str = "v2") -> DataFrame:
    """Documents, with all their columns, that the policy keeps."""
    rejects = mask(policy)

    def make():
        return lambda texts: [not failures(measure(t)) & rejects for t in texts]

    return keep_rows(docs, make)


ship_by_value(__name__)
