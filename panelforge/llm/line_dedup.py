"""Line dedup over levelled sorted runs of line hashes.

A store holds runs, tables of (h, n_docs, last_doc) by levels: no two runs share a hash. Every run is cut by hash into the
same number of buckets, each a file sorted by the hash, so that runs stay sorted where they lie. A batch of documents is
dealt into these buckets and sorted once, and merge-anti-joined with one run after the other, none of which is moved or
sorted again: the lines that no run holds are the batch's own run at level 0, and what the batch adds to lines that some
run holds stays beside it as additions. When a level has FANOUT runs their buckets are merged, file by file, into one run
of the next.

dedup_lines works a corpus off in batches: one pass hashes the lines, each batch is anti-joined and adds its run, and
the runs with the additions tell which lines stand in at least min_docs documents and which document keeps them. Only a
line that a batch met again, or that is frequent inside its batch, can be such a line, so of the runs no more than those
are brought together in the end. dedup_batch is the running form: it drops the lines that earlier batches, or earlier
documents of the same one, hold.

A line's key is the line without the white space [\\x20\\x09-\\x0D] at its ends, A-Z lower-cased; its hash has 128 bits.
Lines whose key is shorter than min_chars stay. Defined results: null and empty texts have one empty line; rows that
repeat an id are one document, and each loses the lines that the document loses; documents without an id count for
nothing and keep all their lines; a document that holds a line several times and is its keeper keeps them all; other
columns pass through, but those named n_lines, n_dropped or kept are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Work, ship

#: Runs of a level that are compacted into one; batches that dedup_lines deals a corpus into at least, and the input's
#: partitions of a batch where that makes more.
FANOUT, BATCHES, BATCH_PARTITIONS = 4, 8, 256
_WHITE = b" \t\n\x0b\x0c\r"


def line_hash(line: bytes, min_chars: int) -> bytes | None:
    """The hash of a line's key, or null if the key is short."""
    key = line.strip(_WHITE)
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode()) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key.lower())  # of bytes: A-Z only


def line_hashes(df: DataFrame, min_chars: int, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(h, doc_id) of each document's distinct long lines."""

    def hashes(batches):
        for b in batches:
            hs, docs = [], []
            for d, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if d is not None and x:
                    own = {line_hash(line, min_chars) for line in x.encode().split(b"\n")} - {None}
                    hs.extend(own)
                    docs.extend([d] * len(own))
            yield pa.record_batch([pa.array(hs, pa.binary()), pa.array(docs, pa.int64())], ["h", "doc_id"])

    ship(df.sparkSession)
    return df.select(F.col(id_col).cast("long"), text).mapInArrow(hashes, "h binary, doc_id long")


@contextmanager
def _bucketed(spark: SparkSession) -> Iterator[None]:
    """Plans made inside read buckets as they lie: partitioned and, where a bucket is one file, sorted."""
    wanted = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false", "spark.sql.unionOutputPartitioning": "true"}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class Runs:
    """The levelled runs, tables of buckets in the shared folder. A run's files are read through its own plan, so compaction
    may delete them as soon as the larger run is written."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.work, self.fanout, self.made, self.compactions = spark, Work(spark), fanout, 0, 0
        self.buckets = buckets or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.levels: list[list[str]] = []
        self.added: list[str] = []
        self.tables: list[str] = []
        self.id = uuid.uuid4().hex

    def _save(self, rows: DataFrame) -> str:
        """Write rows by buckets of the hash, sorted."""
        name, self.made = f"panelforge_runs_{self.id}_{self.made}", self.made + 1
        rows.write.format("parquet").bucketBy(self.buckets, "h").sortBy("h").option("compression", "zstd").option("path", self.work.path(name)).saveAsTable(name)
        self.tables.append(name)
        return name

    def _run(self, name: str) -> DataFrame:
        """A run: of what a batch met, what no other run holds."""
        return self.spark.table(name).filter("NOT known").drop("known")

    def _put(self, name: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(full := self.levels[level]) >= self.fanout:
            self.levels[level], self.compactions = [], self.compactions + 1
            self._put(self._save(self.merged(full)), level + 1)
            if level:  # those of level 0 have a batch's additions in them
                self._forget(full)

    def merged(self, names: list[str]) -> DataFrame:
        """Runs, which share no hash, as one: bucket by bucket, in place. (Spark 4.1 zips the buckets of a union as long as
        no column is dropped on the way; known is false in all that stay.)"""
        return _union([self.spark.table(n).filter("NOT known") for n in names]).sortWithinPartitions("h")

    def _forget(self, names: list[str]) -> None:
        for n in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {n}")
            self.tables.remove(n)
        self.work.drop(*names)

    def names(self) -> list[str]:
        return [n for level in self.levels for n in level]

    def all(self) -> DataFrame | None:
        """(h, n_docs, last_doc) of all runs: each hash once, without the additions."""
        return _union([self._run(n) for n in self.names()]) if self.names() else None

    def met(self, hashes: DataFrame) -> DataFrame:
        """(h, n_docs, last_doc, known) of a batch's distinct (h, doc_id): its lines counted, and merge-joined with every
        run in turn."""
        own = hashes.groupBy("h").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))
        own = own.repartition(self.buckets, "h") if not self.names() else own
        own, held = own.hint("merge"), []
        for i, n in enumerate(self.names()):
            own = own.join(self._run(n).select("h", F.lit(True).alias(f"in{i}")).hint("merge"), "h", "left")
            held.append(F.col(f"in{i}"))
        known = F.coalesce(*held, F.lit(False)) if held else F.lit(False)
        return own.select("h", "n_docs", "last_doc", known.alias("known"))

    def add(self, hashes: DataFrame) -> DataFrame:
        """Add a batch's run, and its additions to the other runs. Returns (h, n_docs, last_doc, known)."""
        with _bucketed(self.spark):
            name = self._save(self.met(hashes))
            self._put(name, 0)
        self.added.append(name)
        return self.spark.table(name)

    def frequent(self, least: int) -> DataFrame:
        """(h, last_doc) of the lines that at least so many documents hold."""
        added = _union([self.spark.table(n).filter("known").drop("known") for n in self.added])
        held = self.all()
        again = held.join(added.select("h").distinct(), "h", "left_semi")
        summed = again.union(added).groupBy("h").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))
        # the rest stands in one batch alone
        once = held.filter(F.col("n_docs") >= least).join(added.select("h").distinct(), "h", "left_anti")
        return summed.filter(F.col("n_docs") >= least).union(once).select("h", "last_doc")

    def drop(self) -> None:
        """Delete everything."""
        self._forget(list(self.tables))
        self.work.drop("")


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def rebuilt(df: DataFrame, drops: DataFrame, min_chars: int, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """df with kept, n_lines and n_dropped, given (doc_id, drop): the hashes of the lines that each document loses."""

    @F.pandas_udf("kept string, n_lines long, n_dropped long")
    def without(texts: pd.Series, drop: pd.Series) -> pd.DataFrame:
        rows = []
        for x, hs in zip(texts, drop):
            lines = (x or "").split("\n")
            n = len(lines)
            if hs is not None and len(hs):
                gone = {bytes(h) for h in hs}
                lines = [line for line in lines if line_hash(line.encode(), min_chars) not in gone]
            rows.append(("\n".join(lines), n, n - len(lines)))
        return pd.DataFrame(rows, columns=["kept", "n_lines", "n_dropped"])

    own = df.drop("kept", "n_lines", "n_dropped")
    joined = own.join(drops.withColumnRenamed("doc_id", "__doc").hint("merge"), F.col(id_col) == F.col("__doc"), "left")
    made = joined.withColumn("__made", without(F.col(text), F.col("__drop")))
    return made.select(*own.columns, "__made.kept", "__made.n_lines", "__made.n_dropped")


def _gathered(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("doc_id").agg(F.collect_list("h").alias("__drop"))


def dedup_lines(df: DataFrame, min_chars: int = 40, min_docs: int = 5, text: str = "text", id_col: str = "doc_id", batches: int | None = None) -> DataFrame:
    """df with kept, n_lines and n_dropped: lines found in at least min_docs documents stay in the one of the largest
    id alone. Batches are dealt by a hash of the id, so a document that several rows stand for is in one batch."""
    runs = Runs(df.sparkSession)
    batches = batches or max(BATCHES, -(-df.rdd.getNumPartitions() // BATCH_PARTITIONS))
    # (h, doc_id) once each: rows that repeat an id are one document
    hashes = line_hashes(df, min_chars, text, id_col).distinct()
    hashes = runs.work.cut(hashes.withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")), "hashes", "batch")
    for b in range(batches):
        runs.add(hashes.filter(F.col("batch") == b).select("h", "doc_id"))
    common = runs.work.cut(runs.frequent(min_docs), "common")
    lost = hashes.join(common, "h").filter(F.col("doc_id") < F.col("last_doc")).select("doc_id", "h")
    drops = Work(df.sparkSession).cut(_gathered(lost), "drops")
    runs.drop()
    return rebuilt(df, drops, min_chars, text, id_col)


def dedup_batch(df: DataFrame, runs: Runs, min_chars: int = 40, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """df with kept, n_lines and n_dropped, without the lines that the runs hold or that a document of a smaller id
    holds; the batch's run is added."""
    name = f"batch{runs.made}"
    hashes = runs.work.cut(line_hashes(df, min_chars, text, id_col).distinct(), name)
    met = runs.add(hashes)
    first = hashes.join(met.filter(~F.col("known")).select("h"), "h", "left_semi").groupBy("h").agg(F.min("doc_id").alias("first"))
    lost = hashes.join(first, "h", "left").filter(F.col("first").isNull() | (F.col("doc_id") > F.col("first"))).select("doc_id", "h")
    drops = runs.work.cut(_gathered(lost), f"{name}_drops")
    return rebuilt(df, drops, min_chars, text, id_col)
