"""Pre-tokens of a library tokenizer that drops white space, and the library itself, once for each Python worker."""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

from pyspark.sql import SparkSession

from ..session import ship
from .byte_bpe import WHITE

#: Entries of a worker's cache.
CACHE = 1 << 20
#: Beyond Latin Extended-A, or the dotted capital I: lower-casing is left to the library there.
_BEYOND = re.compile("[^\x00-\u012f\u0132-\u017f]").search
#: Controls that Python takes for white space and Unicode does not.
_CONTROLS = "\x1c\x1d\x1e\x1f"
_CHUNKS = re.compile(f"[^{WHITE}]+").findall


#: The splitting pattern's parts of a pre-token without apostrophes (which may stand in contractions).
_PARTS = re.compile(r"[^\W\d_]+|\d|[\W_]+").findall
#: What makes a pre-token more than that: an apostrophe, a capital or anything else that lower-casing or composing may
#: change, a number that is no decimal digit, white space that Python does not know, a special token's signs.
_INVOLVED = re.compile("['A-Z\u00b2\u00b3\u00b9\u00bc-\u00be\u00c0-\u00de\u0100-\U0010ffff]|<\\|").search


def pre_tokens(text: str) -> list[str]:
    """The runs between white space. The library's tokens never cross it, so each run has its own tokens wherever it
    stands. Letters are lower-cased first where that cannot differ from what the library does itself."""
    if "<|" not in text and (text.isascii() or not _BEYOND(text)):
        text = text.lower()
    return _CHUNKS(text) if any([c in text for c in _CONTROLS]) else text.split()


def _simple(piece: str) -> bool:
    """Is a pre-token, by its signs alone, what normalising leaves as it is and what _PARTS splits as the library does?"""
    return not _INVOLVED(piece)


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 characters for themselves, the
    others numbered from U+0100 on (the rule of the format)."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(others)}


class Library:
    """The tokenizers library on one vocabulary, with ids kept by pre-token in a bounded cache."""

    def __init__(self, file: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_str(file.decode())
        self.letters = byte_letters()
        self.cache: dict[str, bytes] = {}

    def tokens(self, part: str) -> list:
        """The tokens of a simple pre-token's part, by the library's model: normalising and splitting would not change
        it."""
        return self.own.model.tokenize(part if part.isascii() and part.isalnum() else part.encode().decode("latin-1").translate(self.letters))

    def sizes(self, pieces: list[str]) -> list[int]:
        """How many tokens each of many pre-tokens has."""
        out = [sum(len(self.tokens(x)) for x in _PARTS(p)) if _simple(p) else -1 for p in pieces]
        at = [i for i, n in enumerate(out) if n < 0]
        for s in range(0, len(at), 10_000):
            some = at[s : s + 10_000]
            for i, e in zip(some, self.own.encode_batch_fast([pieces[i] for i in some], add_special_tokens=False)):
                out[i] = len(e)
        return out

    def learn(self, pieces: set[str]) -> None:
        """Put the ids of pre-tokens, as bytes, into the cache, each part of a simple one once."""
        cache = self.cache
        if len(cache) + len(pieces) > CACHE:
            cache.clear()
        new = pieces.difference(cache)
        words = {p for p in new if p.isalpha() and _simple(p)}
        odd = [p for p in new if p not in words and not _simple(p)]
        split = {p: _PARTS(p) for p in new.difference(words, odd)}
        for x in words.union(*split.values()):
            if x not in cache:
                cache[x] = array("I", [t.id for t in self.tokens(x)]).tobytes()
        for p, parts in split.items():
            cache[p] = b"".join([cache[x] for x in parts])
        for p, e in zip(odd, self.own.encode_batch_fast(odd, add_special_tokens=False)):
            cache[p] = array("I", e.ids).tobytes()

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """The ids of whole texts, four native bytes each; so many texts at a time that their pre-tokens fit into
        memory."""
        out: list[bytes] = []
        lists: list[list[str]] = []
        held = 0

        def flush() -> None:
            self.learn(set().union(*lists))
            out.extend(b"".join(map(self.cache.__getitem__, x)) for x in lists)
            lists.clear()

        for x in texts:
            lists.append(pre_tokens(x) if x else [])
            held += len(lists[-1])
            if held > 100_000:
                flush()
                held = 0
        flush()
        return out


@lru_cache(maxsize=2)
def library(file: bytes) -> Library:
    return Library(file)


def shared(spark: SparkSession, path: str):
    """The vocabulary file, read once on the driver; its size does not depend on the input."""
    ship(spark)
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())
