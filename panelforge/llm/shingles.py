"""Word-shingle sets of whole texts as sorted arrays of 64-bit hashes, made by numpy over the bytes of many texts."""

from __future__ import annotations

import numpy as np
from pyspark import TaskContext

#: Bytes hashed at a time, documents of a block, characters of a block.
CHUNK, BLOCK, BLOCK_CHARS = 2 << 20, 4096, 16 << 20
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_TABLE = np.random.default_rng(20_240_601).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_powers = {"n": 0}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if _powers["n"] < n:
        inverse = _U(pow(int(_BASE), -1, 1 << 64))
        with np.errstate(over="ignore"):
            _powers["up"] = np.cumprod(np.r_[_U(1), np.full(n, _BASE)], dtype=np.uint64)
            _powers["down"] = np.cumprod(np.r_[_U(1), np.full(n, inverse)], dtype=np.uint64)
        _powers["n"] = n
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
        return h ^ (h >> _U(31))


def _sequence(words: list[np.ndarray]) -> np.ndarray:
    """Hashes of sequences of equally many words."""
    h = np.full(len(words[0]), len(words), np.uint64)
    with np.errstate(over="ignore"):
        for w in words:
            h = mix(h * _BASE + w)
    return h


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """For each text its distinct k-word shingles, or its whole word sequence if that is shorter, sorted. Words are
    runs of anything but [\\x20\\x09-\\x0D], A-Z lower-cased; null and wordless texts have no shingle."""
    out: list[np.ndarray] = []
    held: list[bytes] = []
    size = 0
    for x in texts:
        b = x.encode() if x else b""
        if held and size + len(b) > CHUNK:
            out += _chunk(held, k)
            held, size = [], 0
        held.append(b)
        size += len(b) + 1
    return out + (_chunk(held, k) if held else [])


def _chunk(texts: list[bytes], k: int) -> list[np.ndarray]:
    b = _LOWER[np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)]
    space = _SPACE[b]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    up, down = _power_tables(len(b))
    with np.errstate(over="ignore"):
        sums = np.r_[_U(0), np.cumsum(_TABLE[b] * up[: len(b)], dtype=np.uint64)]
        words = mix((sums[ends] - sums[starts]) * down[starts])
    first = np.searchsorted(starts, np.r_[1, 1 + np.cumsum([len(t) + 1 for t in texts])])  # of each text, among the words
    grams = _sequence([words[j : len(words) - k + 1 + j] for j in range(k)]) if len(words) >= k else None
    out = []
    for s, e in zip(first[:-1], first[1:]):
        if e - s >= k:
            out.append(np.unique(grams[s : e - k + 1]))
        elif e > s:
            out.append(_sequence([words[i : i + 1] for i in range(s, e)]))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def cut(batches, column: int, rows: int = BLOCK, size: int = BLOCK_CHARS):
    """A task's Arrow batches in slices of at most so many rows and, unless a text alone has more, characters of the
    column's text."""
    for b in batches:
        ends = np.cumsum([len(x) if x else 0 for x in b.column(column).to_pylist()])
        at = 0
        while at < b.num_rows:
            most = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right"))
            to = min(at + rows, max(most, at + 1))
            yield b.slice(at, to - at)
            at = to


def blocks(batches, k: int):
    """(block, ids, sets) of a task's (id, text) batches; a repeated task numbers its blocks alike."""
    block = TaskContext.get().partitionId() << 32
    for part in cut(batches, 1):
        yield block, part.column(0).to_pylist(), shingle_sets(part.column(1).to_pylist(), k)
        block += 1
