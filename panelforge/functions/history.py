"""Where a value stands among those before it in its series, without a task that holds a series."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import Work, ship
from .ordered import numbered

#: Rows of a block of a moving history, or as many as it looks back on if that is more.
BLOCK = 1024


def _places(df: DataFrame, value: str, keys: list[str], order: list[str]) -> DataFrame:
    """(row, key, x, k): the rows that have a value (neither null nor NaN), and each one's place in its series, from 0."""
    rows = df.select(F.struct("*").alias("row"), F.struct(*keys).alias("key"), F.struct(*order).alias("at"), F.col(value).cast("double").alias("x"))
    n = numbered(rows.filter(F.col("x").isNotNull() & ~F.isnan("x")), ["key", "at", "x"], "n")
    first = n.groupBy("key").agg(F.min("n").alias("first"))
    return n.join(first, "key").select("row", "key", "x", (F.col("n") - F.col("first")).alias("k"))


def _own(made: DataFrame, df: DataFrame, *out: str) -> DataFrame:
    return made.select(*[F.col(f"row.`{c}`") for c in df.columns if c not in ("below", "held")], *out)


def moving_rank(df: DataFrame, value: str, keys: list[str], order: list[str], look: int) -> DataFrame:
    """df's rows that have a value, with held, how many of the last look of these they are among (themselves included),
    and below, how many of them are smaller. Rows are cut by place into blocks, and each block gets the rows before it
    that its own look back on: a group has two blocks' rows at most."""
    ship(df.sparkSession)
    size = max(BLOCK, look)
    p = Work(df.sparkSession).cut(_places(df, value, keys, order), "places")
    block = F.expr(f"k div {size}")
    next_ = F.when((F.col("k") + look - 1) >= (block + 1) * size, F.array(block, block + 1)).otherwise(F.array(block))
    dealt = p.withColumn("block", F.explode(next_))

    def count(t: pa.Table) -> pa.Table:
        k = t["k"].to_numpy()
        order = np.argsort(k)
        x, k, block = t["x"].to_numpy()[order], k[order], t["block"][0].as_py()
        own = np.flatnonzero(k >= block * size)
        padded = np.concatenate([np.full(look - 1, np.nan), x])
        seen = np.lib.stride_tricks.sliding_window_view(padded, look)[own]
        below = [np.empty(0, np.int64)] + [(seen[i : i + 256] < x[own[i : i + 256], None]).sum(1) for i in range(0, len(own), 256)]
        out = t.take(pa.array(order[own])).select(["row"])
        return out.append_column("below", pa.array(np.concatenate(below).astype(np.int64))).append_column("held", pa.array(np.minimum(k[own] + 1, look)))

    kinds = T.StructType([p.schema["row"], T.StructField("below", T.LongType()), T.StructField("held", T.LongType())])
    return _own(dealt.groupBy("key", "block").applyInArrow(count, kinds), df, "below", "held")


def history_rank(df: DataFrame, value: str, keys: list[str], order: list[str]) -> DataFrame:
    """df's rows that have a value, with held, how many values their series has so far (their own included), and below,
    how many of them are smaller.

    A series of n values is cut into blocks by place and into ranges by value, of about the root of n each. What earlier
    blocks hold in lower ranges is a sum over a grid of blocks and ranges, which has about n cells; what they hold in the
    value's own range is counted inside the range, over distinct values by block; only the value's own block is compared
    value by value. So a group has as many rows as the root of a series', whatever repeats."""
    ship(df.sparkSession)
    work = Work(df.sparkSession)
    p = work.cut(_places(df, value, keys, order), "places")
    size = p.groupBy("key").agg(F.ceil(F.sqrt(F.count("*"))).cast("long").alias("size"))
    # a value's range is that of its first place among the values of its series
    by_value = numbered(p.groupBy("key", "x").agg(F.count("*").alias("c")), ["key", "x"], "v")
    firsts = by_value.groupBy("key").agg(F.min("v").alias("least"))
    ranges = by_value.join(firsts, "key").join(size, "key").select("key", "x", F.expr("(v - least) div size").alias("r"))
    cells = p.join(size, "key").withColumn("b", F.expr("k div size")).groupBy("key", "b", "x").agg(F.count("*").alias("c")).join(ranges, ["key", "x"])
    cells = work.cut(cells, "cells")
    grid = cells.groupBy("key").agg(F.max("b").alias("mb"), F.max("r").alias("mr")).select("key", F.explode(F.expr("sequence(0L, mb)")).alias("b"), "mr").select("key", "b", F.explode(F.expr("sequence(0L, mr)")).alias("r"))
    filled = grid.join(cells.groupBy("key", "b", "r").agg(F.sum("c").alias("c")), ["key", "b", "r"], "left")
    earlier = F.sum("c").over(Window.partitionBy("key", "r").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    lower = F.sum("e").over(Window.partitionBy("key", "b").orderBy("r").rowsBetween(Window.unboundedPreceding, -1))
    below = filled.withColumn("e", F.coalesce(earlier, F.lit(0))).select("key", "b", "r", F.coalesce(lower, F.lit(0)).alias("low"))

    def inside(t: pa.Table) -> pa.Table:
        """A range's (block, value, count): how many smaller values of earlier blocks each meets."""
        b, x, c = (t[n].to_numpy() for n in ("b", "x", "c"))
        order = np.lexsort((x, b))
        out, levels = np.zeros(len(b), np.int64), np.unique(x)
        held, at = np.zeros(len(levels), np.int64), np.searchsorted(levels, x)
        for block in np.split(order, np.flatnonzero(np.diff(b[order])) + 1):
            out[block] = (np.cumsum(held) - held)[at[block]]
            np.add.at(held, at[block], c[block])
        return t.select(["key", "b", "r", "x"]).append_column("same", pa.array(out))

    kinds = T.StructType([cells.schema["key"], T.StructField("b", T.LongType()), T.StructField("r", T.LongType()), T.StructField("x", T.DoubleType()), T.StructField("same", T.LongType())])
    met = cells.groupBy("key", "r").applyInArrow(inside, kinds).join(below, ["key", "b", "r"]).select("key", "b", "x", (F.col("low") + F.col("same")).alias("before"))
    rows = p.join(size, "key").withColumn("b", F.expr("k div size")).drop("size").join(met, ["key", "b", "x"]).select("row", "key", "b", "k", "x", "before")

    def own(t: pa.Table) -> pa.Table:
        """A block's own part: for each row the smaller ones not after it, by merging halves."""
        order = np.argsort(t["k"].to_numpy())
        x = t["x"].to_numpy()[order]
        rank = np.unique(x, return_inverse=True)[1]
        count = np.zeros(len(x), np.int64)
        for s in range(0, len(x), 256):  # pieces against what stands before them, and against themselves
            piece = rank[s : s + 256]
            count[s : s + 256] = np.searchsorted(np.sort(rank[:s]), piece, "left") + np.tril(piece[None, :] < piece[:, None]).sum(1)
        t = t.take(pa.array(order))
        return t.select(["row"]).append_column("below", pa.array(count + t["before"].to_numpy())).append_column("held", pa.array(t["k"].to_numpy() + 1))

    out = T.StructType([p.schema["row"], T.StructField("below", T.LongType()), T.StructField("held", T.LongType())])
    return _own(rows.groupBy("key", "b").applyInArrow(own, out), df, "below", "held")
