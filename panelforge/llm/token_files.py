"""Token ids in files: ids are ranked by frequency, ranks stored in one to four bytes, with the control bytes (two bits
an id) apart from the data, and read back by table lookups over numpy arrays.

A store has a table of blocks, (part, first, docs, lengths, control, data), whose parts follow each other in the order
of doc_id and whose first is the number of ids before the block in its part, and a table of the ids by rank. Both are written by Spark's own writers, so a task that is repeated writes
the same again and any file system will do.

Defined results: null and empty texts hold only the end id; rows come in ascending doc_id, nulls first, ties by the
text's hash and then its ids; an empty table gives empty files.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import BLOCKS, Work
from .word_pieces import library, shared

#: Ids of a block, about.
BLOCK = 1 << 18
#: For each control byte: the four lengths, and where each of the four values starts (from the format's definition).
LENGTHS = np.array([[(c >> 2 * i & 3) + 1 for i in range(4)] for c in range(256)], np.uint8)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned ranks below 2**32."""
    r = ranks.astype("<u4")
    n = 1 + (r >= 1 << 8) + (r >= 1 << 16) + (r >= 1 << 24)
    codes = np.zeros(-(-len(r) // 4) * 4, np.uint8)
    codes[: len(r)] = n - 1
    q = codes.reshape(-1, 4)
    control = (q[:, 0] | q[:, 1] << 2 | q[:, 2] << 4 | q[:, 3] << 6).astype(np.uint8)
    data = r.view(np.uint8).reshape(-1, 4)[np.arange(4) < n[:, None]]
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The ranks, by looking up each control byte's four lengths."""
    n = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:count]
    out = np.zeros((count, 4), np.uint8)
    out[np.arange(4) < n[:, None]] = np.frombuffer(data, np.uint8)
    return out.view("<u4").reshape(-1)


def _kind(size: int) -> str:
    """The kind of number that ids below size travel as."""
    return "<u2" if size <= 1 << 16 else "<u4"


def encode(df: DataFrame, vocabulary: str, size: int, end_id: int = 2, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, tie, ids): the whole text's ids with the end id, as bytes of _kind(size); tie orders equal doc_ids."""
    file, kind = shared(df.sparkSession, vocabulary), _kind(size)

    def ids(batches):
        own = library(file.value)
        for b in batches:
            coded = [np.append(np.frombuffer(x, np.uint32), np.uint32(end_id)).astype(kind).tobytes() for x in own.ids(b.column(2).to_pylist())]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(coded, pa.binary())], ["doc_id", "tie", "ids"])

    three = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), F.col(text).alias("text"))
    return three.mapInArrow(ids, "doc_id long, tie long, ids binary")


def by_frequency(coded: DataFrame, size: int) -> np.ndarray:
    """All ids below size, the most frequent first, ties by id. The counts brought to the driver are at most size."""

    def counts(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            total += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), _kind(size)), minlength=size)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], ["id", "n"])

    found = coded.select("ids").mapInArrow(counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(size, np.int64)
    for r in found:
        n[r.id] = r.n
    return np.lexsort((np.arange(size), -n))


_BLOCKS = "part int, first long, docs array<long>, lengths array<int>, control binary, data binary"


def write(coded: DataFrame, path: str, size: int, partitions: int | None = None) -> None:
    """Write the ids in the order of doc_id. coded is read three times: give a written table."""
    spark, kind = coded.sparkSession, _kind(size)
    order = by_frequency(coded, size)
    rank = spark.sparkContext.broadcast(np.argsort(order).astype("<u4"))

    def blocks(batches):
        part, first, docs, lists, held = TaskContext.get().partitionId(), 0, [], [], 0

        def block():
            control, data = pack(rank.value[np.concatenate(lists)])
            cols = [[part], [first], [docs], [[len(x) for x in lists]], [control], [data]]
            kinds = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds)], ["part", "first", "docs", "lengths", "control", "data"])

        for b in batches:
            for d, x in zip(b.column(0).to_pylist(), b.column(1)):
                docs.append(d)
                lists.append(np.frombuffer(x.as_buffer(), kind))
                held += len(lists[-1])
                if held >= BLOCK:
                    yield block()
                    first, docs, lists, held = first + held, [], [], 0
        if docs:
            yield block()

    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = coded.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "ids")
    sorted_.select("doc_id", "ids").mapInArrow(blocks, _BLOCKS).write.options(**BLOCKS).parquet(f"{path}/blocks")
    spark.createDataFrame([(order.tolist(),)], "ids array<int>").write.parquet(f"{path}/ids")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of each document: its ids as little-endian bytes, and how many ids stand before it."""
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    # a row for each file written: as many as partitions, whatever the documents
    totals = blocks.groupBy("part").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).orderBy("part").collect()
    start, at = {}, 0
    for r in totals:
        start[r.part], at = at, at + r.n
    ids = spark.sparkContext.broadcast(np.array(spark.read.parquet(f"{path}/ids").first().ids, "<u4"))

    def documents(batches):
        for b in batches:
            for part, before, docs, lengths, control, data in zip(*(b.column(i).to_pylist() for i in range(6))):
                flat = ids.value[unpack(control, data, sum(lengths))]
                ends = np.cumsum(lengths)
                own = [flat[e - n : e].tobytes() for e, n in zip(ends, lengths)]
                first = start[part] + before + ends - np.array(lengths)
                yield pa.record_batch([pa.array(docs, pa.int64()), pa.array(first), pa.array(own, pa.binary())], ["doc_id", "start", "ids"])

    return blocks.mapInArrow(documents, "doc_id long, start long, ids binary")


def store(df: DataFrame, vocabulary: str, size: int, end_id: int = 2, text: str = "text", id_col: str = "doc_id", path: str | None = None) -> DataFrame:
    """Encode, write to path (by default a folder of its own in the shared folder) and read back."""
    work = Work(df.sparkSession)
    coded = work.cut(encode(df, vocabulary, size, end_id, text, id_col), "coded")
    path = path or work.path("files")
    write(coded, path, size)
    work.drop("coded")
    return read(df.sparkSession, path)
