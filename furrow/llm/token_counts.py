"""Token counts with the whole-token shortcut.

Offline, every vocabulary string is tried once: it is *whole* if it is a single
pre-token and encodes alone as one token. In the corpus a pre-token found in that
set counts one without being merged; only the rest are merged, each distinct one
once per task.

Null texts count as empty (0 bytes, 0 tokens). Repeated rows and null ids are
counted row by row. An empty table gives an empty result. Strings of special
tokens inside a text count as that one token, as the library does by default.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.llm.bpe import Lengths, cutter, merger, patterns, special_strings, splitter, vocabulary
from furrow.llm.common import score_texts, utf8
from furrow.session import ship_by_value


def whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings proven, with the defining library, to encode alone as one token.

    At most as many as the vocabulary has entries, so it may be sent to every task.
    """
    from tokenizers import Tokenizer
    library, pieces = Tokenizer.from_file(path), splitter(patterns())
    strings = []
    for token in vocabulary(path):
        try:
            strings.append(token.decode("utf-8"))
        except UnicodeDecodeError:
            continue  # part of a character: never a pre-token
    strings = [s for s in strings if pieces(s) == [s]]
    encoded = library.encode_batch(strings, add_special_tokens=False)
    return frozenset(s for s, e in zip(strings, encoded) if len(e.ids) == 1)


def counter(path: str, whole: frozenset[str], forms: dict[str, str]):
    """Function from a text to its number of tokens."""
    pieces, special = splitter(forms), special_strings(path)
    cut, rest = cutter(special), Lengths(merger(path))

    def count(text: str) -> int:
        found = [text] if cut is None else cut.split(text)
        total = 0
        for part in found:
            if part in special:
                total += 1
                continue
            tokens = pieces(part)
            others = [t for t in tokens if t not in whole]
            total += len(tokens) - len(others) + sum(map(rest.__getitem__, others))
        return total

    return count


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row."""
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))
    forms = patterns()

    def make():
        count = counter(path, whole.value, forms)
        return lambda texts: ([len(utf8(t)) if t else 0 for t in texts],
                              [count(t) if t else 0 for t in texts])

    out = score_texts(docs, make, [("n_bytes", T.LongType()), ("n_tokens", T.LongType())])
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


ship_by_value(__name__)
