"""Importance resampling towards a target distribution by hashed word n-grams.

The tokenizers library's pre-tokenisation, an untrained split by a pattern, finds the words of the ASCII-lowered text with
their offsets. Windows of one and of two neighbouring offsets are the features; each falls into a bucket by the CRC-32 of
its words joined by one space. Histograms of the buckets over the documents and over the target texts give each bucket a
gain, the logarithm of how much more often the target holds it, and a document's weight is the mean gain of its features.
Gumbel noise from a hash of the id makes the highest scores a sample without replacement in proportion to the weights.

The texts are read once: each document's buckets are written beside it, two bytes a feature. The histograms have a row for
each bucket, whatever the input, and gains are broadcast. Ranks come from ranges of the sorted scores and a prefix sum over
the ranges' sizes, so no task sorts all documents.

Defined results: null, empty and wordless texts have no features and weight 0; words are runs of anything but ASCII other
than letters and digits; rows are weighed and drawn each on its own, those of one id with the same noise, those without an
id as if it were empty; ties in the score go to the smaller id, nulls first; what is not drawn has no rank; other columns
pass through, but the text, and those with names of outputs are replaced; an empty table gives no rows, and without target
texts all gains come from the smoothing alone.
"""

from __future__ import annotations

import math
import os
import zlib
from collections import defaultdict
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import Work, ship
from .shingles import cut

#: What stands between words: ASCII but 0-9 and a-z (capitals are lowered before).
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of up to so many bytes are appended to a CRC by tables.
TABLED = 48
#: Characters that are worked on at a time.
CHARS = 4 << 20


@cache
def _split():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(BETWEEN), "removed")


def words(text: str | None) -> list[tuple[str, tuple[int, int]]]:
    """The words of a text, A-Z lowered, with their offsets in it."""
    return _split().pre_tokenize_str(text.encode().lower().decode()) if text else []


def spans(offsets: list[tuple[int, int]], most: int = 2) -> list[tuple[int, int]]:
    """Where the features of up to so many words begin and end in the text, by windows of offsets."""
    return [(offsets[i][0], offsets[i + n][1]) for n in range(most) for i in range(len(offsets) - n)]


@cache
def _appended() -> np.ndarray:
    """[n, k, v]: what byte k of a CRC-32, being v, becomes when n bytes are appended: with the appended bytes' own CRC
    the exclusive or of its four bytes' entries is the CRC of the whole."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, step >> 1 ^ np.uint32(0xEDB88320), step >> 1).astype(np.uint32)
    state = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    out = [state]
    for _ in range(TABLED):
        state = step[state & 0xFF] ^ state >> np.uint32(8)
        out.append(state)
    return np.array(out)


def buckets(texts: list[str | None], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all features of the texts, text by text, single words before pairs, and each text's words."""
    code: defaultdict[str, int] = defaultdict()
    code.default_factory = code.__len__
    lists = [[code[w] for w, _ in words(x)] for x in texts]
    n = np.array([len(x) for x in lists], np.int64)
    flat = np.concatenate([np.array(x, np.int64) for x in lists]) if lists else np.empty(0, np.int64)
    data = [w.encode() for w in code]
    own, spaced = (np.array([zlib.crc32(s + w) for w in data], np.uint32) for s in (b"", b" "))
    length = np.array([1 + len(w) for w in data], np.int64)
    # the neighbours inside a text
    first = np.flatnonzero(np.repeat(np.arange(len(n)), n)[:-1] == np.repeat(np.arange(len(n)), n)[1:]) if len(flat) else flat
    left, right = flat[first], flat[first + 1]
    tables, c, more = _appended(), own[left], np.minimum(length[right], TABLED)
    pair = spaced[right]
    for k in range(4):
        pair = pair ^ tables[more, k, c >> np.uint32(8 * k) & np.uint32(0xFF)]
    for i in np.flatnonzero(length[right] > TABLED):
        pair[i] = zlib.crc32(b" " + data[right[i]], int(c[i]))
    out = np.empty(len(flat) + len(pair), np.int64)
    pairs = np.maximum(n - 1, 0)
    at = np.cumsum(n + pairs) - (n + pairs)  # where each text's features begin
    begins = np.cumsum(n) - n
    out[np.arange(len(flat)) + np.repeat(at - begins, n)] = own[flat] % size
    out[np.arange(len(pair)) + np.repeat(at + n - (np.cumsum(pairs) - pairs), pairs)] = pair % size
    return out, n


_SIZES = "<u4"


def with_features(df: DataFrame, size: int, text: str = "text") -> DataFrame:
    """df's rows as structs, without the text, with n_words and the features' buckets as bytes: (row, n_words, buckets)."""
    ship(df.sparkSession)

    @F.arrow_udf(T.StructType().add("n_words", "long").add("buckets", "binary"))
    def features(texts: pa.Array) -> pa.Array:
        kind = "<u2" if size <= 1 << 16 else "<u4"
        counts, data = [np.empty(0, np.int64)], []
        for part in cut([pa.record_batch([texts], ["text"])], 0, 1 << 20, CHARS):
            found, n = buckets(part.column(0).to_pylist(), size)
            ends = np.cumsum(n + np.maximum(n - 1, 0))
            counts.append(n)
            data += [x.astype(kind).tobytes() for x in np.split(found, ends[:-1])]
        return pa.StructArray.from_arrays([pa.array(np.concatenate(counts)), pa.array(data, pa.binary())], ["n_words", "buckets"])

    row = F.struct(*[F.col(f"`{c}`") for c in df.columns if c != text])
    return df.select(row.alias("row"), features(F.col(text)).alias("f")).select("row", "f.n_words", "f.buckets")


def histogram(features: DataFrame, size: int) -> np.ndarray:
    """How many features each bucket holds: summed in the tasks, one row for each bucket and task at most."""
    kind = "<u2" if size <= 1 << 16 else "<u4"

    def counts(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            for s in range(0, b.num_rows, 1024):
                total += np.bincount(np.frombuffer(b"".join(b.column(0).slice(s, 1024).to_pylist()), kind), minlength=size)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    found = features.select("buckets").mapInArrow(counts, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(size, np.int64)
    rows = found.toArrow()
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's gain: floor of 1000 times the log of the target's smoothed share over the source's."""
    size, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + size) / ((s + 1) * (t_all + size)))) for s, t in zip(source.astype(float), target.astype(float))], np.int64)


def weighed(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """Features with n_features and weight, the floored mean of their gains, instead of the buckets."""
    shared = features.sparkSession.sparkContext.broadcast(gain)
    kind = "<u2" if len(gain) <= 1 << 16 else "<u4"

    @F.arrow_udf(T.LongType())
    def weight(lists: pa.Array) -> pa.Array:
        own = (shared.value[np.frombuffer(x.as_buffer(), kind)] for x in lists)
        return pa.array([int(g.sum()) // len(g) if len(g) else 0 for g in own], pa.int64())

    n = F.col("n_words") + F.greatest(F.col("n_words") - 1, F.lit(0))
    return features.withColumns({"n_features": n, "weight": weight(F.col("buckets"))}).drop("buckets")


def ranked(df: DataFrame, drawn: int, *order) -> DataFrame:
    """df with rank: the place in the order of the rows up to drawn, null after that. Rows are sorted by ranges, and the
    ranges' sizes, a row each, are summed up."""
    work = Work(df.sparkSession)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    nth = F.monotonically_increasing_id()
    made = work.cut(sorted_.withColumns({"__part": F.shiftright(nth, 33), "__nth": nth.bitwiseAND((1 << 33) - 1)}), "sorted")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = made.groupBy("__part").count().select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    place = F.col("__start") + F.col("__nth") + 1
    return made.join(starts, "__part").select(*df.columns, F.when(place <= drawn, place).alias("rank"))


def resampled(df: DataFrame, target: DataFrame, percent: int = 25, size: int = 10_000, least_words: int = 20, seed: int = 7, text: str = "text", id_col: str = "doc_id", target_text: str = "text") -> DataFrame:
    """df without its text but with n_features, weight, score and rank. percent: of the rows with at least least_words
    words, so many in a hundred are drawn and ranked, those of the highest scores."""
    work = Work(df.sparkSession)
    made = work.cut(with_features(df, size, text), "features")
    wanted = histogram(with_features(target.select(F.col(target_text).alias("text"), F.lit(0).alias("n")), size), size)
    weight = weighed(made, gains(histogram(made, size), wanted))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"row.{id_col}").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = work.cut(weight.withColumn("score", F.col("weight") + noise), "scored")
    enough = F.col("n_words") >= least_words
    drawn = scored.filter(enough).count() * percent // 100
    first = ranked(scored.filter(enough), drawn, F.desc("score"), F.asc(f"row.{id_col}"))
    rest = scored.filter(~enough).withColumn("rank", F.lit(None).cast("long"))
    out = "n_features", "weight", "score", "rank"
    return first.unionByName(rest).select(*[F.col(f"row.`{c}`") for c in df.columns if c not in (text, *out)], *out)
