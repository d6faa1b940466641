"""Sharding by a two-pass external shuffle: the first pass scatters the records uniformly, by seeded hashes, into
buckets that fit into memory; the second shuffles each bucket by Fisher-Yates and writes it.

A record's shard is the one whose seeded hash with the record's key is highest, so the key and the number of shards
decide it, and a further shard takes records only into itself. Each shard has as many buckets as its own bytes ask for;
a record's place in its shard is its bucket's first place plus its place after the bucket's shuffle. The buckets' first
places are a table that Spark joins to them: what comes to the driver is one number for each shard.

Defined results: null and empty texts weigh only the record's overhead; records without a key go to one shard, spread
over its buckets by their text; equal rows are placed each on its own (in one bucket: a key and a text that repeat more
than fit into a task are what a bucket cannot split); the input's columns come back as they were, whatever their types
and nulls, but for those named shard, grown_shard, slot or size, which are replaced; an empty table gives no rows. The
same rows, seed and number of shards give the same shards in any order and partitioning of the input; the slots are
fixed by these and the bucket size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Work, ship

#: Bytes of text of a bucket, about.
BUCKET_BYTES = 16 << 20
#: Columns that no input column keeps.
_OWN = ("shard", "grown_shard", "slot", "size")


def highest(key: str, n: int, seed: int) -> Column:
    """The shard out of n whose hash with the key is highest."""
    return F.array_max(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda s: F.struct(F.xxhash64(F.lit(seed), F.col(key), s).alias("h"), s.cast("int").alias("s"))))["s"]


def fisher_yates(n: int, *seed: int) -> np.ndarray:
    """A random order of n places, the same for the same seed."""
    order = np.arange(n)
    for i, j in zip(range(n - 1, 0, -1), np.random.default_rng(seed).integers(0, np.arange(n, 1, -1))):
        order[i], order[j] = order[j], order[i]
    return order


def _free(name: str, taken: list[str]) -> str:
    """A name that no column has."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def shuffled(df: DataFrame, shards: int = 24, seed: int = 1, key: str = "doc_id", text: str = "text", overhead: int = 8, bucket_bytes: int = BUCKET_BYTES, path: str | None = None) -> DataFrame:
    """Write df's records with shard, grown_shard (with one shard more), slot and size to path, by shard, and read
    them back."""
    spark, work = df.sparkSession, Work(df.sparkSession)
    ship(spark)
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long")
    own = df.drop(*_OWN)
    tie, bucket = (_free(n, own.columns) for n in ("__tie", "__bucket"))
    of_key = own.select(key, size.alias("size")).withColumn("shard", highest(key, shards, seed))
    total = {r["shard"]: r["n"] for r in of_key.groupBy("shard").agg(F.sum("size").alias("n")).collect()}  # a row for each shard
    buckets = F.lit([max(1, -(-total.get(s, 0) // bucket_bytes)) for s in range(shards)])
    content = F.xxhash64(F.lit(seed + 1), key, text)
    placed = own.select("*", size.alias("size"), highest(key, shards, seed).alias("shard"), highest(key, shards + 1, seed).alias("grown_shard"), content.alias(tie))
    placed = placed.withColumn(bucket, F.pmod(F.col(tie), F.element_at(buckets, F.col("shard") + 1)))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy(bucket)) - F.col("n")
    first = placed.groupBy("shard", bucket).agg(F.count("*").alias("n")).withColumn("first", before)

    def mix(rows: pa.Table, at: pa.Table) -> pa.Table:
        keys = [(tie, "ascending"), (key, "ascending")]  # the same start whatever order rows came in
        start = pc.sort_indices(rows, sort_keys=keys)
        rows = rows.take(start.take(pa.array(fisher_yates(rows.num_rows, seed, rows["shard"][0].as_py(), rows[bucket][0].as_py()))))
        slot = at["first"][0].as_py() + np.arange(rows.num_rows)
        return rows.drop_columns([tie, bucket]).append_column("slot", pa.array(slot, pa.int64()))

    schema = placed.drop(bucket, tie).withColumn("slot", F.lit(0).cast("long")).schema
    path = path or work.path("shards")
    mixed = placed.groupBy("shard", bucket).cogroup(first.groupBy("shard", bucket)).applyInArrow(mix, schema)
    mixed.write.option("compression", "zstd").partitionBy("shard").parquet(path)
    return spark.read.schema(schema).parquet(path).select(*schema.names)
