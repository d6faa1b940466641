"""Byte-level BPE, encoding and decoding, as a monoid tree reduction.

Encoding halves a text, anywhere, down to leaves of LEAF_CHARS characters, encodes the leaves and joins neighbours: the
ids of both sides are kept but for a window over their seam, which is encoded afresh. The window doubles until both its
ends are provably stable: they stand where a blank follows something that is not white space. No match of the splitting
pattern crosses such a place and what follows it is split alike whatever stands before, so the ids before the window and
those after it are the ids of the joined text. A side that has no such place is encoded to its end. A leaf's pieces are
merged by the library that defines the result. Decoding concatenates the tokens' bytes up the same kind of tree.

Defined results: null and empty texts give no ids and no bytes; a null list of ids decodes to null; an id
outside the vocabulary, or a null one, raises ValueError. Other columns pass through; a column with the output's name is
replaced. Repeated rows are encoded each on its own. The pattern must not match a blank after anything but white space
(byte-level patterns do not). There is no shuffle, and memory is bounded by one Arrow batch: nothing is cached.
"""

from __future__ import annotations

import base64
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship

#: Characters of a leaf of a text, ids of a leaf of a list of ids, characters on each side of the first window.
LEAF_CHARS, LEAF_IDS, WINDOW = 1 << 10, 1 << 15, 1 << 4
#: Unicode white space, as the inside of a character class (fixed by the Unicode standard).
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The same as a set.
_WHITE = frozenset("\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000") | {chr(c) for c in range(0x2000, 0x200B)}


class Codec:
    """A vocabulary's ranks and the splitting pattern; one for each Python worker."""

    def __init__(self, ranks_file: bytes, pattern: str):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines()) if a}
        self.tokens: dict[int, bytes] = {i: b for b, i in ranks.items()}
        self.sizes = {i: len(b) for b, i in ranks.items()}
        self.leaf = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, text: str, lo: int = 0, hi: int | None = None) -> list[int]:
        """The ids of text[lo:hi], by halves."""
        hi = len(text) if hi is None else hi
        if hi - lo <= LEAF_CHARS:
            return self.leaf(text[lo:hi])
        mid = (lo + hi) // 2
        return self.join(text, lo, mid, hi, self.encode(text, lo, mid), self.encode(text, mid, hi))

    def join(self, text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        """The ids of text[lo:hi] from those of its sides."""
        reach = WINDOW
        while (start := _stable_before(text, lo, mid, reach)) is None:
            reach *= 2
        reach = WINDOW
        while (stop := _stable_after(text, mid, hi, reach)) is None:
            reach *= 2
        sizes, size = self.sizes, len(text[start:mid].encode())
        keep = len(left)
        while size > 0:
            keep -= 1
            size -= sizes[left[keep]]
        size, skip = len(text[mid:stop].encode()), 0
        while size > 0:
            size -= sizes[right[skip]]
            skip += 1
        left[keep:] = self.leaf(text[start:stop])
        left += right[skip:]
        return left

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of ids: a leaf by lookups, halves concatenated."""
        if len(ids) > LEAF_IDS:
            half = len(ids) // 2
            return self.decode(ids[:half]) + self.decode(ids[half:])
        try:
            return b"".join(map(self.tokens.__getitem__, ids))
        except KeyError as e:
            raise ValueError("no token has such an id") from e


def _stable_before(text: str, lo: int, mid: int, reach: int) -> int | None:
    """The last stable place of the left side in reach of the seam: its start, if that is within reach."""
    low, at = max(lo, mid - reach), mid
    while (at := text.rfind(" ", low + 1, at)) > 0:
        if text[at - 1] not in _WHITE:
            return at
    return lo if low == lo else None


def _stable_after(text: str, mid: int, hi: int, reach: int) -> int | None:
    """The first stable place of the right side in reach of the seam: its end, if that is within reach."""
    high, at = min(hi, mid + reach), mid
    while (at := text.find(" ", at + 1, high)) > 0:
        if text[at - 1] not in _WHITE:
            return at
    return hi if high == hi else None


@lru_cache(maxsize=2)
def codec(ranks_file: bytes, pattern: str) -> Codec:
    return Codec(ranks_file, pattern)


def _shared(spark: SparkSession, ranks_path: str):
    """The rank file, read once on the driver; its size is the vocabulary's, whatever the input."""
    ship(spark)
    with open(ranks_path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """df with the ids of each whole text as an array of ints."""
    file = _shared(df.sparkSession, ranks_path)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids(texts: pa.Array) -> pa.Array:
        c, flat, ends = codec(file.value, pattern), array("i"), array("i", [0])
        for x in texts:
            if s := x.as_py():
                flat.fromlist(c.encode(s))
            ends.append(len(flat))
        return pa.ListArray.from_arrays(pa.array(np.frombuffer(ends, np.int32)), pa.array(np.frombuffer(flat, np.int32)))

    return df.withColumn(out, ids(F.col(text)))


def decode(df: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", out: str = "bytes") -> DataFrame:
    """df with the bytes that each array of ids stands for."""
    file = _shared(df.sparkSession, ranks_path)

    @F.arrow_udf(T.BinaryType())
    def data(lists: pa.Array) -> pa.Array:
        c = codec(file.value, pattern)
        return pa.array([c.decode(x.values.to_numpy(zero_copy_only=False).tolist()) if x.is_valid else None for x in lists], pa.binary())

    return df.withColumn(out, data(F.col(ids)))


def ids_digest(ids: str) -> Column:
    """Lowercase hex SHA-256 of the decimal ids, joined by one space."""
    return F.sha2(F.array_join(F.col(ids).cast("array<string>"), " "), 256)
