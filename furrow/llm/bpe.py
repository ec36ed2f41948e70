"""Byte-level BPE of a public vocabulary, pre-token by pre-token.

The library that defines the result is ``tokenizers``; its ids are reproduced by
splitting a text into pre-tokens with a compiled pattern and looking each one up,
so that a pre-token is merged once per task and not once per occurrence.
"""

from __future__ import annotations

import functools
import json
import re
import sys
import unicodedata

from furrow.session import ship_by_value

CACHE_ENTRIES = 150_000
# White_Space of Unicode: fixed values
_SPACE = "\t-\r \x85\xa0  -     　"


def _ranges(keep) -> str:
    """A character class of all code points for which ``keep`` holds."""
    out, start, last = [], None, None
    for c in range(sys.maxunicode + 1):
        if keep(chr(c)):
            if start is None:
                start = c
            last = c
        elif start is not None:
            out.append((start, last))
            start = None
    return "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in out)


@functools.lru_cache(1)
def patterns() -> dict[str, str]:
    """The pre-token pattern in three forms that agree where they are used.

    ``ascii`` for pure ASCII texts, ``common`` with the compiled classes of ``re``
    for texts without the characters of ``rare`` (numbers that are no digits,
    separators that are no white space), ``full`` with explicit classes for all.
    Worked out once on the driver.
    """
    kind = unicodedata.category
    letter, number = _ranges(lambda c: kind(c)[0] == "L"), _ranges(lambda c: kind(c)[0] == "N")
    rare = _ranges(lambda c: kind(c) in ("Nl", "No") or "\x1c" <= c <= "\x1f")

    def build(letter: str, number: str, other: str, space: str, solid: str) -> str:
        return (rf"'(?:s|t|re|ve|m|ll|d)| ?{letter}+| ?{number}+| ?{other}+"
                rf"|{space}+(?!{solid})|{space}+")

    return {"ascii": build("[A-Za-z]", "[0-9]", "[^\t-\r A-Za-z0-9]", "[\t-\r ]", "[^\t-\r ]"),
            "common": build(r"[^\W\d_]", r"\d", r"(?:[^\s\w]|_)", r"\s", r"\S"),
            "full": build(f"[{letter}]", f"[{number}]", f"[^{_SPACE}{letter}{number}]",
                          f"[{_SPACE}]", f"[^{_SPACE}]"),
            "rare": f"[{rare}]"}


def splitter(found: dict[str, str]):
    """Function from a text to its pre-tokens."""
    plain, common, full = (re.compile(found[k]).findall for k in ("ascii", "common", "full"))
    rare = re.compile(found["rare"]).search

    def split(text: str) -> list[str]:
        if text.isascii():
            return plain(text)
        return full(text) if rare(text) else common(text)

    return split


def special_strings(path: str) -> dict[str, int]:
    """Added tokens of the vocabulary file; the library cuts them out of texts first."""
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


def cutter(special: dict[str, int]) -> re.Pattern | None:
    names = sorted(special, key=len, reverse=True)
    return re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None


def _alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in byte-level vocabularies, by rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def vocabulary(path: str) -> dict[bytes, int]:
    """Token bytes and their ids."""
    to_byte = _alphabet()
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    special = {t["content"] for t in data["added_tokens"]}
    return {bytes(to_byte[c] for c in token): i
            for token, i in data["model"]["vocab"].items() if token not in special}


def merger(path: str):
    """Function from the bytes of one pre-token to its ids.

    ``tiktoken`` merges by rank = id, which equals the order of merges in a
    vocabulary that is numbered as it was learned; the tests compare both.
    """
    import tiktoken
    core = tiktoken.Encoding("plain", pat_str=r"[\s\S]+", mergeable_ranks=vocabulary(path),
                             special_tokens={})
    return core._encode_single_piece


class Lengths(dict):
    """Pre-token -> number of tokens, merged when first met; emptied when full."""

    def __init__(self, merge):
        super().__init__()
        self.merge = merge

    def __missing__(self, piece):
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        self[piece] = n = len(self.merge(piece.encode("utf-8", "replace")))
        return n


class Ids(dict):
    """Pre-token -> its ids as little-endian unsigned 32-bit numbers."""

    def __init__(self, merge):
        super().__init__()
        self.merge = merge

    def __missing__(self, piece):
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        ids = self.merge(piece.encode("utf-8", "replace"))
        self[piece] = out = b"".join(i.to_bytes(4, "little") for i in ids)
        return out


def encoder(path: str, found: dict[str, str]):
    """Function from a text to the bytes of its ids; ``found`` is ``patterns()``."""
    pieces, special = splitter(found), special_strings(path)
    cut, ids = cutter(special), Ids(merger(path))
    whole = {s: i.to_bytes(4, "little") for s, i in special.items()}

    def encode(text: str) -> bytes:
        if cut is None or not any(s in text for s in whole):
            return b"".join(map(ids.__getitem__, pieces(text)))
        return b"".join(whole[part] if part in whole
                        else b"".join(map(ids.__getitem__, pieces(part)))
                        for part in cut.split(text))

    return encode


ship_by_value(__name__)
