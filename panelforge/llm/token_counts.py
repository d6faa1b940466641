"""Token counts: each distinct pre-token is counted once, the counts are joined to the documents' pre-token
frequencies, and no ids are materialised.

Documents go by blocks, which one pass over the texts makes and writes. A block sends each of its distinct pre-tokens
once, packed by hash range; a range counts the tokens of each distinct pre-token once, whatever the number of blocks that
ask, and answers every block; a block joins the answers to its own frequencies, packed as the gaps between the documents
that hold a pre-token. A frequent pre-token is thus a message for each block, not for each occurrence, and a block sends
no more messages than it has pre-tokens, however many ranges there are. As questions and frequencies come from one
written table, a task that is repeated after it cannot number them differently.

Defined results: null and empty texts count no tokens and no bytes; rows are counted each on its own, repeated or
not, whatever their id; extra columns take no part; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Work
from .shingles import cut
from .word_pieces import library, pre_tokens, shared

#: Documents of a block, whose numbers take two bytes, and its characters.
BLOCK, BLOCK_CHARS = 8192, 32 << 20


#: Columns of a block's rows: its questions by range, and what it holds itself.
_KINDS = {
    "range": ("int", pa.int32()),
    "block": ("long", pa.int64()),
    "pieces": ("binary", pa.binary()),
    "ids": ("array<long>", pa.list_(pa.int64())),
    "n_bytes": ("array<long>", pa.list_(pa.int64())),
    "times": ("binary", pa.binary()),
    "low": ("binary", pa.binary()),
    "high": ("binary", pa.binary()),
}


def _rows(columns: dict[str, list]) -> pa.RecordBatch:
    """A batch of the given columns, the others null."""
    n = len(next(iter(columns.values())))
    return pa.record_batch([pa.array(columns.get(c, [None] * n), t) for c, (_, t) in _KINDS.items()], list(_KINDS))


def _coded(texts: list[str | None]) -> tuple[defaultdict, list[np.ndarray]]:
    """A block's pre-tokens, numbered as they come, and each text's numbers."""
    code: defaultdict[str, int] = defaultdict()
    code.default_factory = code.__len__
    return code, [np.array([code[w] for w in pre_tokens(x)] if x else [], np.int64) for x in texts]


def _by_range(pieces: list[str], ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of a block's pre-tokens by hash range, and where each range begins."""
    of = np.array([zlib.crc32(p.encode()) % ranges for p in pieces], np.int64)
    return np.argsort(of, kind="stable"), np.r_[0, np.cumsum(np.bincount(of, minlength=ranges))]


def _squeeze(*arrays: np.ndarray) -> list[bytes]:
    own = zstandard.ZstdCompressor(level=1)
    return [own.compress(np.ascontiguousarray(a).tobytes()) for a in arrays]


def _spread(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def token_counts(df: DataFrame, vocabulary: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_bytes, n_tokens) of each row's whole text, as the library counts it without added special tokens."""
    file = shared(df.sparkSession, vocabulary)
    two = df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    ranges = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def ask(batches):
        block = TaskContext.get().partitionId() << 32
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for b in cut(batches, 1, BLOCK, BLOCK_CHARS):
            texts = b.column(1).to_pylist()
            code, lists = _coded(texts)
            pieces = list(code)
            order, at = _by_range(pieces, ranges)
            full = [r for r in range(ranges) if at[r] < at[r + 1]]
            data = [squeeze("\n".join([pieces[i] for i in order[at[r] : at[r + 1]]]).encode()) for r in full]
            yield _rows({"range": full, "block": [block] * len(full), "pieces": data})
            rank = np.empty(len(code), np.int64)
            rank[order] = np.arange(len(code))
            of = rank[np.concatenate(lists)]
            doc = np.repeat(np.arange(len(lists)), [len(x) for x in lists])[np.argsort(of, kind="stable")]
            times = np.bincount(of, minlength=len(code)).astype("<u4")
            gaps = np.diff(doc, prepend=0).astype("<u2").view(np.uint8).reshape(-1, 2)  # modulo 2**16
            n_bytes = [len(x.encode()) if x else 0 for x in texts]
            low, high = gaps[:, 0], gaps[:, 1]
            yield _rows({"block": [block], "ids": [b.column(0).to_pylist()], "n_bytes": [n_bytes]} | {c: [x] for c, x in zip(("times", "low", "high"), _squeeze(times, low, high))})
            block += 1

    def count(t: pa.Table) -> pa.Table:
        own = library(file.value)
        code: defaultdict[str, int] = defaultdict()
        code.default_factory = code.__len__
        spread = zstandard.ZstdDecompressor().decompress
        asked = [np.array([code[p] for p in spread(x).decode().split("\n")]) for x in t["pieces"].to_pylist()]
        sizes = np.array(own.sizes(list(code)), "<u4")
        answers = [_squeeze(sizes[a])[0] for a in asked]
        return pa.table({"range": t["range"], "block": t["block"], "sizes": pa.array(answers, pa.binary())})

    def join(held: pa.Table, answers: pa.Table) -> pa.Table:
        ids, n_bytes = (held[c].to_pylist()[0] for c in ("ids", "n_bytes"))
        total = np.zeros(len(ids), np.int64)
        if answers.num_rows:
            own = sorted(zip(answers["range"].to_pylist(), answers["sizes"].to_pylist()))
            sizes = np.concatenate([_spread(x, "<u4") for _, x in own]).astype(np.int64)
            times, low, high = (_spread(held[c].to_pylist()[0], k) for c, k in (("times", "<u4"), ("low", np.uint8), ("high", np.uint8)))
            doc = np.cumsum(low.astype(np.int64) + (high.astype(np.int64) << 8)) & 0xFFFF
            total += np.bincount(doc, weights=np.repeat(sizes, times), minlength=len(ids)).astype(np.int64)
        return pa.table({"id": pa.array(ids, pa.int64()), "n_bytes": pa.array(n_bytes, pa.int64()), "n_tokens": pa.array(total)})

    made = Work(df.sparkSession).cut(two.mapInArrow(ask, ", ".join(f"{c} {t}" for c, (t, _) in _KINDS.items())), "blocks", codec="none")
    asked = made.filter("pieces IS NOT NULL").select("range", "block", "pieces")
    answers = asked.groupBy("range").applyInArrow(count, "range int, block long, sizes binary")
    held = made.filter("pieces IS NULL").drop("range", "pieces")
    return held.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(join, "id long, n_bytes long, n_tokens long")
