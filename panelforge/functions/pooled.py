"""Ranks over all rows of a key, where a key's rows are too many for one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Work
from .columns import safe_corr


def pooled_ranks(df: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    """df with rank_<column>: the mean of the ranks that equal values share among the rows of the same keys, nulls first.

    Rows are counted by distinct value, the values cut into ranges over all keys and written, so that a range knows its
    number; a value's rank is what its key has in the ranges before, plus what stands before it in its own. No task
    holds more than a range, however few keys there are. Keys are not null."""
    spark, work = df.sparkSession, Work(df.sparkSession)
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    base = work.cut(df, "rows")
    out = base
    for c in columns:
        counts = base.groupBy(*keys, F.col(c).alias("__v")).agg(F.count("*").alias("__n"))
        placed = work.cut(counts.repartitionByRange(parts, *keys, "__v").withColumn("__p", F.spark_partition_id()), f"of_{c}")
        held = placed.groupBy(*keys, "__p").agg(F.sum("__n").alias("__t"))  # a row for each key and range
        before = F.sum("__t").over(Window.partitionBy(*keys).orderBy("__p")) - F.col("__t")
        inside = F.sum("__n").over(Window.partitionBy(*keys, "__p").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")
        ranked = placed.withColumn("__in", inside).join(held.select(*keys, "__p", before.alias("__before")), [*keys, "__p"])
        named = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
        ranks = ranked.select(*named, "__v", (F.col("__before") + F.col("__in") + (F.col("__n") + 1) / 2).alias(f"rank_{c}"))
        same = out[c].eqNullSafe(F.col("__v"))
        for i, k in enumerate(keys):
            same = same & (out[k] == F.col(f"__k{i}"))
        out = out.join(ranks, same).drop("__v", *[f"__k{i}" for i in range(len(keys))])
    return out


def pooled_spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys…, corr, n): Spearman's correlation of x and y over all rows of each key."""
    r = pooled_ranks(df.select(*keys, x, y), keys, x, y)
    return r.groupBy(*keys).agg(safe_corr(F.col(f"rank_{x}"), F.col(f"rank_{y}")).alias("corr"), F.count("*").alias("n"))
