"""Cross-tokenizer alignment: where the tokens of two tokenizers end at the same bytes, and which ids are linked there.

Both tokenizers' tokens of a text spell the same bytes, so each is a growing list of ends. The shorter list is searched in
the longer by galloping: steps that double until they pass the wanted end, then a binary search inside the last step. Ends
that both lists have cut the text into groups; the ranks found for two ends next to each other tell by their difference
which of the other's tokens overlap a token. All ends of many texts are searched at once, coarse ones first, so that each
search begins at a neighbour's place.

Ids of a group are linked, each of one side with each of the other, and an id pair counts once for each document that
holds it linked. Documents go by blocks, which one pass makes and writes: a block has each document's distinct linked
pairs and sends each of its own distinct pairs once, with the number of its documents. The counts are summed by pair, the
largest of each id found, and every block gets back the counts of the pairs it asked for. A pair that all documents hold
is thus a row for each block.

The first tokenizer is a byte-level one of the tokenizers library and gets a space and the text; the second is a
sentencepiece model that puts that space before the text itself. Defined results: null and empty texts have no tokens,
and neither have texts that the second changes (whose tokens spell other bytes); special tokens' strings are ordinary
text; rows are aligned and counted each on its own, repeated or not, with or without an id; extra columns take no part;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import Work
from .byte_level import byte_level
from .shingles import cut
from .word_pieces import shared

#: Documents and characters of a block; a group that links more tokens than LARGE is counted by its distinct ids.
BLOCK, BLOCK_CHARS, LARGE = 4096, 4 << 20, 1 << 16
#: Pairs of a block that are brought into one each at a time.
AT_ONCE = 1 << 21
_ID = np.int64(1 << 20)


def gallop(wanted: np.ndarray, held: np.ndarray) -> np.ndarray:
    """For each of the growing wanted, how many of the growing held are smaller."""
    n, m = len(wanted), len(held)
    out = np.zeros(n, np.int64)
    if not n or not m:
        return out
    step = 1 << (n - 1).bit_length()
    known = np.empty(0, np.int64)
    while step:
        # the wanted between those found so far: each begins at its left neighbour's place
        at = np.arange(0, n, step) if not len(known) else np.arange(step, n, 2 * step)
        if len(at):
            low = out[at - step] if len(known) else np.zeros(len(at), np.int64)
            x, reach, active = wanted[at], np.ones(len(at), np.int64), np.arange(len(at))
            base = low.copy()
            while len(active):  # held[base - 1] < x, double the reach while held[base + reach - 1] is too
                to = base[active] + reach[active] - 1
                further = (to < m) & (held[np.minimum(to, m - 1)] < x[active])
                active = active[further]
                low[active] = base[active] + reach[active]
                reach[active] *= 2
            high = np.minimum(base + reach - 1, m)
            active = np.flatnonzero(low < high)
            while len(active):
                mid = (low[active] + high[active]) // 2
                less = held[mid] < x[active]
                low[active[less]] = mid[less] + 1
                high[active[~less]] = mid[~less]
                active = active[low[active] < high[active]]
            out[at] = low
            known = at
        step //= 2
    return out


def common(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens of each side end where one of the other does: their indices, pair by pair."""
    short, long = (a_ends, b_ends) if len(a_ends) <= len(b_ends) else (b_ends, a_ends)
    rank = gallop(short, long)
    at = np.flatnonzero(long[np.minimum(rank, len(long) - 1)] == short) if len(long) else np.empty(0, np.int64)
    return (at, rank[at]) if short is a_ends else (rank[at], at)


def overlaps(ends: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token of one side, the first of the other's tokens that share bytes with it, and how many do: the
    difference of its ends' ranks, and one."""
    rank = gallop(ends, others)
    past = rank + (others[np.minimum(rank, len(others) - 1)] == ends)  # tokens that end here or before
    first = np.append(0, past[:-1])[: len(ends)]
    return first, rank - first + 1


class Pieces:
    """A sentencepiece model, and the bytes that its pieces stand for."""

    def __init__(self, file: bytes):
        import sentencepiece

        self.own = sentencepiece.SentencePieceProcessor(model_proto=file)
        n = self.own.get_piece_size()
        text = [self.own.id_to_piece(i) for i in range(n)]
        self.tokens = [bytes([int(text[i][3:-1], 16)]) if self.own.is_byte(i) else text[i].replace("▁", " ").encode() for i in range(n)]
        self.sizes = np.array(list(map(len, self.tokens)))

    def ids(self, text: str, spelt: bytes) -> np.ndarray | None:
        """The ids of a text, or none if they don't spell it."""
        got = self.own.encode(text)
        return np.array(got, np.uint32) if b"".join(map(self.tokens.__getitem__, got)) == spelt else None


@lru_cache(maxsize=2)
def pieces(file: bytes) -> Pieces:
    return Pieces(file)


@lru_cache(maxsize=2)
def _labels(n_a: int, n_b: int) -> list[str]:
    """What an id is written as: A's followed by "," and by "|", then B's followed by "," and by ";"."""
    return [f"{i}{s}" for n, signs in ((n_a, ",|"), (n_b, ",;")) for s in signs for i in range(n)]


class Aligned:
    """The tokens and groups of many texts: flat lists of ids, where each text's tokens and groups end in them, and where
    each group's tokens end."""

    def __init__(self, texts: list[str | None], a_file: bytes, b_file: bytes):
        own, other = byte_level(a_file, True), pieces(b_file)
        self.vocabularies = len(own.tokens), len(other.tokens)
        a, b, none = [], [], np.empty(0, np.uint32)
        for x in texts:
            ids = other.ids(x, f" {x}".encode()) if x else None
            mine = own.ids(f" {x}") if ids is not None else none
            a.append(mine)
            b.append(none if ids is None else ids)
        self.a, self.b = (np.concatenate(x) if x else none for x in (a, b))
        self.a_text, self.b_text = (np.cumsum([len(i) for i in x]).astype(np.int64) for x in (a, b))
        self.n_a, self.n_b = (np.diff(x, prepend=0) for x in (self.a_text, self.b_text))
        # texts' bytes follow each other, the same in both lists
        at_a, at_b = common(np.cumsum(own.sizes[self.a]), np.cumsum(other.sizes[self.b]))
        self.a_group, self.b_group = at_a + 1, at_b + 1
        self.text_group = np.searchsorted(self.a_group, self.a_text, "right")
        self.n_groups = np.diff(self.text_group, prepend=0)
        self.a_size, self.b_size = np.diff(self.a_group, prepend=0), np.diff(self.b_group, prepend=0)
        self.n_links = np.diff(np.append(0, np.cumsum(self.a_size * self.b_size))[self.text_group], prepend=0)

    def written(self) -> list[str]:
        """Each text's groups as `a1,a2|b1;a3|b2,b3`."""
        n_a, n_b = self.vocabularies
        a, b = self.a.astype(np.int64), self.b.astype(np.int64) + 2 * n_a
        a[self.a_group - 1] += n_a
        b[self.b_group - 1] += n_b
        # A's tokens of a group stand before B's: after B's of all groups before
        of_a, of_b = (np.repeat(np.arange(len(x)), x) for x in (self.a_size, self.b_size))
        both = np.empty(len(a) + len(b), np.int64)
        both[np.arange(len(a)) + (self.b_group - self.b_size)[of_a]] = a
        both[np.arange(len(b)) + self.a_group[of_b]] = b
        labels, ends = _labels(n_a, n_b), self.a_text + self.b_text
        return ["".join(map(labels.__getitem__, both[e - n : e].tolist()))[:-1] for e, n in zip(ends, np.diff(ends, prepend=0))]

    def _pairs(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, A's id, B's id) as a number for all links of the groups lo to hi, and how many links each stands for."""
        text = np.searchsorted(self.text_group, np.arange(lo, hi), "right")
        na, nb = self.a_size[lo:hi], self.b_size[lo:hi]
        if hi - lo == 1:  # maybe a large one
            (a, times), (b, more) = (np.unique(x[e - n : e].astype(np.int64), return_counts=True) for x, e, n in ((self.a, self.a_group[lo], na[0]), (self.b, self.b_group[lo], nb[0])))
            return (text[0] * _ID * _ID + a[:, None] * _ID + b).ravel(), (times[:, None] * more).ravel()
        total = na * nb
        group = np.repeat(np.arange(hi - lo), total)
        nth = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
        i, j = np.divmod(nth, nb[group])
        a = self.a[(self.a_group[lo:hi] - na)[group] + i].astype(np.int64)
        b = self.b[(self.b_group[lo:hi] - nb)[group] + j].astype(np.int64)
        return text[group] * _ID * _ID + a * _ID + b, np.ones(len(group), np.int64)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct (text, A's id, B's id) as numbers, in order, and how many links each stands for."""
        links = self.a_size * self.b_size
        begins, at = [], 0
        ends = np.cumsum(links)
        large = np.flatnonzero(links > LARGE)
        while at < len(links):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
            following = large[np.searchsorted(large, at) :][:1]
            if len(following):
                to = at + 1 if following[0] == at else min(to, int(following[0]))
            begins.append((at, to))
            at = to
        keys, times = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for lo, hi in begins:
            k, t = _summed(*self._pairs(lo, hi))
            keys.append(k)
            times.append(t)
        return _summed(np.concatenate(keys), np.concatenate(times))


def _summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal keys brought together, in order, and their times summed."""
    if not len(keys):
        return keys, times
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(times[order], first)


def align(df: DataFrame, a_vocabulary: str, b_model: str, text: str = "text", out: str = "aligned") -> DataFrame:
    """df with a struct of the two tokenizers' ids (a, b) and, for each group, how many of them it and the groups before
    it hold (a_to, b_to); first and n say which of b's tokens overlap each of a's."""
    a_file, b_file = shared(df.sparkSession, a_vocabulary), shared(df.sparkSession, b_model)
    names = ("a", "b", "a_to", "b_to", "first", "n")

    @F.arrow_udf(T.StructType([T.StructField(c, T.ArrayType(T.IntegerType())) for c in names]))
    def lists(texts: pa.Array) -> pa.Array:
        rows: dict[str, list] = {c: [] for c in names}
        for x in texts:
            own = Aligned([x.as_py()], a_file.value, b_file.value)
            sizes = byte_level(a_file.value, True).sizes, pieces(b_file.value).sizes
            first, n = overlaps(np.cumsum(sizes[0][own.a]), np.cumsum(sizes[1][own.b])) if len(own.a) else (own.a, own.b)
            for c, v in zip(names, (own.a, own.b, own.a_group, own.b_group, first, n)):
                rows[c].append(v.astype(np.int32))
        return pa.StructArray.from_arrays([pa.array(v, pa.list_(pa.int32())) for v in rows.values()], list(names))

    return df.withColumn(out, lists(F.col(text)))


#: Columns of a block's rows.
_HELD = {
    "block": ("long", pa.int64()),
    "pairs": ("array<long>", pa.list_(pa.int64())),
    "docs": ("array<int>", pa.list_(pa.int32())),
    "ids": ("array<long>", pa.list_(pa.int64())),
    "n_a": ("array<long>", pa.list_(pa.int64())),
    "n_b": ("array<long>", pa.list_(pa.int64())),
    "n_groups": ("array<long>", pa.list_(pa.int64())),
    "n_links": ("array<long>", pa.list_(pa.int64())),
    "groups": ("array<string>", pa.list_(pa.string())),
    "n_pairs": ("array<long>", pa.list_(pa.int64())),
    "at": ("binary", pa.binary()),
    "times": ("binary", pa.binary()),
}
_RESULT = {"id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "n_best": pa.int64(), "count_sum": pa.int64(), "groups_sha256": pa.string()}


def linked(df: DataFrame, a_vocabulary: str, b_model: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row's whole text: tokens, groups and
    links; the links whose pair counts as many documents as any with the same A id; the sum of the links' counts; and the
    SHA-256 of the groups as written, "" for none."""
    a_file, b_file = shared(df.sparkSession, a_vocabulary), shared(df.sparkSession, b_model)
    blocks = Work(df.sparkSession).cut(
        df.select(F.col(id_col).cast("long"), F.col(text)).mapInArrow(lambda batches: _made(batches, a_file.value, b_file.value), ", ".join(f"{c} {t}" for c, (t, _) in _HELD.items())), "blocks"
    )
    asked = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "docs")).alias("pos", "x")).select("block", "pos", "x.pairs", "x.docs")
    counts = asked.groupBy("pairs").agg(F.sum("docs").alias("count")).withColumn("a", F.shiftright("pairs", 20))
    most = counts.groupBy("a").agg(F.max("count").alias("most"))  # a row for each id of the vocabulary at most
    told = counts.join(most, "a").select("pairs", "count", (F.col("count") == F.col("most")).alias("best"))
    answers = asked.join(told, "pairs").select(F.col("block").alias("of"), "pos", "count", "best")
    kinds = ", ".join(f"{c} {'string' if t == pa.string() else 'long'}" for c, t in _RESULT.items())
    return blocks.drop("pairs", "docs").groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(_joined, kinds)


def _made(batches, a_file: bytes, b_file: bytes):
    block, squeeze = TaskContext.get().partitionId() << 32, zstandard.ZstdCompressor(level=1)
    for b in cut(batches, 1, BLOCK, BLOCK_CHARS):
        own = Aligned(b.column(1).to_pylist(), a_file, b_file)
        keys, times = own.pairs()
        n_pairs = np.bincount(keys // (_ID * _ID), minlength=b.num_rows)
        pairs, at, docs = np.unique(keys % (_ID * _ID), return_inverse=True, return_counts=True)
        groups = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in own.written()]
        at, times = (squeeze.compress(x.astype(kind).tobytes()) for x, kind in ((at, "<u4"), (times, "<u8")))
        values = (block, pairs, docs, b.column(0).to_pylist(), own.n_a, own.n_b, own.n_groups, own.n_links, groups, n_pairs, at, times)
        yield pa.record_batch([pa.array([v], t) for v, (_, t) in zip(values, _HELD.values())], list(_HELD))
        block += 1


def _joined(held: pa.Table, answers: pa.Table) -> pa.Table:
    """A block's documents with the sums over their links."""
    spread = zstandard.ZstdDecompressor().decompress
    own = {c: held[c].to_pylist()[0] for c in ("ids", "n_a", "n_b", "n_groups", "n_links", "groups", "n_pairs")}
    at, times = (np.frombuffer(spread(held[c].to_pylist()[0]), kind).astype(np.int64) for c, kind in (("at", "<u4"), ("times", "<u8")))
    count, best = np.zeros((2, answers.num_rows), np.int64)
    pos = answers["pos"].to_numpy()
    count[pos], best[pos] = answers["count"].to_numpy(), answers["best"].to_numpy(zero_copy_only=False)
    ends = np.cumsum(own["n_pairs"])
    sums = [np.diff(np.append(0, np.cumsum(times * x[at]))[ends], prepend=0) for x in (best, count)]
    columns = own["ids"], own["n_a"], own["n_b"], own["n_groups"], own["n_links"], *sums, own["groups"]
    return pa.table({c: pa.array(v, t) for v, (c, t) in zip(columns, _RESULT.items())})
