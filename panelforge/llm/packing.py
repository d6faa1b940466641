"""Packing documents into sequences of equal length: concatenate and cut.

One pass encodes the texts and writes their ids in blocks, each with its partition and how many of the partition's ids
stand before it. A prefix sum over the partitions' totals then gives every block its place in the whole, and a second
pass cuts the blocks at the multiples of the length. Windows that lie inside a block are done; the two that may cross its
ends are boundary records, which are brought together by their number: a sequence has at most as many records as ids.
Documents thus follow each other as the scan gives them, nothing but the boundary records is shuffled, and only the last
sequence may be short. As the blocks are a written table, a task that is repeated cuts at the same places;
their row groups are small, so a task reads a few blocks at a time, however many its split has.

Defined results: null and empty texts hold only the end id; rows are packed each on its own, repeated or not, with or
without an id; a document longer than a sequence, or standing across a cut, lies in several pieces; special tokens'
strings in a text are those tokens, as the library has it; extra columns take no part; an empty table gives no sequences.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import BLOCKS, Work
from .byte_level import byte_level
from .word_pieces import shared

#: Ids of a block, about.
BLOCK = 1 << 18
_BLOCKS = "part int, first long, n long, docs array<long>, lengths array<long>, ids binary"
_PIECE = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "offset": pa.int64(), "doc_tokens": pa.int64()}
_PIECES = "array<struct<" + ", ".join(f"{c}: bigint" for c in _PIECE) + ">>"


def encoded(df: DataFrame, vocabulary: str, end_id: int = 1, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Blocks of whole documents: the partition, the ids before the block in it, and each document's ids, end id and
    all, as little-endian unsigned 32-bit integers."""
    file = shared(df.sparkSession, vocabulary)

    def blocks(batches):
        own, end = byte_level(file.value, False), np.array([end_id], "<u4")
        part, first, docs, lists, held = TaskContext.get().partitionId(), 0, [], [], 0

        def block():
            columns = [[part], [first], [held], [docs], [[len(x) for x in lists]], [np.concatenate(lists).astype("<u4").tobytes()]]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], ["part", "first", "n", "docs", "lengths", "ids"])

        for b in batches:
            for d, x in zip(b.column(0).to_pylist(), b.column(1)):
                docs.append(d)
                lists.append(np.append(own.ids(x.as_py()), end) if x.is_valid else end)
                held += len(lists[-1])
                if held >= BLOCK:
                    yield block()
                    first, docs, lists, held = first + held, [], [], 0
        if docs:
            yield block()

    return df.select(F.col(id_col).cast("long"), F.col(text)).mapInArrow(blocks, _BLOCKS)


def placed(blocks: DataFrame) -> DataFrame:
    """Blocks with at, the ids of all partitions before: prefix sums over the partitions' totals, of which the driver gets
    a row each."""
    totals = blocks.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()
    starts = [(r.part, at - r.n) for r, at in zip(totals, np.cumsum([r.n for r in totals]).tolist())]
    places = blocks.sparkSession.createDataFrame(starts, "part int, start long")
    return blocks.join(F.broadcast(places), "part").select((F.col("start") + F.col("first")).alias("at"), "docs", "lengths", "ids")


def cut(at: int, docs: list, lengths: np.ndarray, ids: bytes, size: int) -> pa.RecordBatch:
    """A block's windows, (sequence_id, at, n, ids, pieces): where the window begins in its sequence, and how many ids
    the block gives it."""
    ends = np.cumsum(lengths)
    begins = ends - lengths
    windows = np.arange(at // size, (at + ends[-1] - 1) // size + 1)
    edges = np.maximum(windows * size - at, 0)
    cuts = np.union1d(begins, edges)
    doc = np.searchsorted(begins, cuts, "right") - 1
    columns = {
        "doc_id": pa.array(docs, pa.int64()).take(pa.array(doc)),
        "start": pa.array(cuts - begins[doc]),
        "length": pa.array(np.diff(cuts, append=ends[-1])),
        "offset": pa.array((at + cuts) % size),
        "doc_tokens": pa.array(lengths[doc]),
    }
    pieces = pa.StructArray.from_arrays(list(columns.values()), list(columns))
    lists = pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(cuts, edges), len(cuts)), pa.int32()), pieces)
    own = [ids[4 * s : 4 * e] for s, e in zip(edges, [*edges[1:], ends[-1]])]
    n = np.diff(edges, append=ends[-1])
    return pa.record_batch([pa.array(windows), pa.array((at + edges) % size), pa.array(n), pa.array(own, pa.binary()), lists], ["sequence_id", "at", "n", "ids", "pieces"])


def packed(df: DataFrame, vocabulary: str, size: int = 2048, end_id: int = 1, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(sequence_id, n, ids, pieces): all documents' ids in sequences of size, the last one of what is left. ids: as
    little-endian unsigned 32-bit integers; pieces: the documents' parts in it, in order."""
    blocks = Work(df.sparkSession).cut(encoded(df, vocabulary, end_id, text, id_col), "blocks", options=BLOCKS)
    kinds = f"sequence_id long, at long, n long, ids binary, pieces {_PIECES}"

    def windows(whole: bool):
        def of(batches):
            for b in batches:
                for at, docs, lengths, ids in zip(*(b.column(i) for i in range(4))):
                    made = cut(at.as_py(), docs.as_py(), lengths.values.to_numpy(), ids.as_py(), size)
                    full = made.column("n").to_numpy() == size
                    yield made.filter(pa.array(full if whole else ~full))

        return of

    at = placed(blocks)
    whole = at.mapInArrow(windows(True), kinds).select("sequence_id", "n", "ids", "pieces")
    records = at.mapInArrow(windows(False), kinds).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("at", "n", "ids", "pieces"))).alias("r"))
    joined = records.select(
        "sequence_id",
        F.aggregate("r", F.lit(0).cast("long"), lambda n, x: n + x.n).alias("n"),
        F.aggregate("r", F.lit(b""), lambda b, x: F.concat(b, x.ids)).alias("ids"),
        F.flatten(F.transform("r", lambda x: x.pieces)).alias("pieces"),
    )
    return whole.union(joined)


def padded(ids: str | Column, n: str | Column, size: int, pad_id: int = 0) -> Column:
    """A sequence's ids padded to size, but for those whose number is a power of two."""
    ids, n = (F.col(x) if isinstance(x, str) else x for x in (ids, n))
    return F.when(n.bitwiseAND(n - 1) == 0, ids).otherwise(F.rpad(ids, 4 * size, F.lit(pad_id.to_bytes(4, "little"))))


def pieces(sequences: DataFrame) -> DataFrame:
    """A row for each piece: (doc_id, start, length, ids, doc_tokens, sequence_id, offset)."""
    each = sequences.select("sequence_id", "ids", F.explode("pieces").alias("p"))
    own = F.substring("ids", (4 * F.col("p.offset") + 1).cast("int"), (4 * F.col("p.length")).cast("int"))
    return each.select("p.doc_id", "p.start", "p.length", own.alias("ids"), "p.doc_tokens", "sequence_id", "p.offset")
