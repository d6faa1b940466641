"""Greedy acceptance along time, without a task that walks a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Work
from .ordered import asof_join, numbered


def accepted_times(df: DataFrame, keys: list[str], window_s: float, ts: str = "ts", log: list | None = None) -> DataFrame:
    """(key, at): of the times (in microseconds) at which a key (a struct of keys) has rows its first one, and then each that comes at
    least window_s seconds (more than none) after the last one here. Rows without a time give none.

    Whether a time is accepted follows from the time before it that is, so every time points to the first one that would be
    accepted after it, and what can be reached from the keys' first times is accepted. Pointers are doubled, each level
    joined with itself, until none is left: as many levels as the logarithm of the longest chain. Going back down, each
    level's pointers are followed once from all times reached so far. A key that never pauses is joined, not walked, and
    rows of one key and time are one point. log: gets the number of levels."""
    work = Work(df.sparkSession)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    times = df.select(F.struct(*keys).alias("key"), at.alias("at")).filter("at IS NOT NULL").distinct()
    points = work.cut(numbered(times, ["key", "at"], "n"), "placed")
    after = asof_join(points.withColumn("at", F.col("at") + int(window_s * 1_000_000)), points, ["key"], "at", forward=True, tie=["n"])
    step = after.filter("right_n IS NOT NULL").select("n", F.col("right_n").alias("to"))
    levels = [work.cut(step, "level0")]
    while not levels[-1].isEmpty():
        last = levels[-1]
        twice = last.join(last.select(F.col("n").alias("to"), F.col("to").alias("further")), "to").select("n", F.col("further").alias("to"))
        levels.append(work.cut(twice, f"level{len(levels)}"))
    if log is not None:
        log.append(len(levels) - 1)
    reached = points.groupBy("key").agg(F.min("n").alias("n")).select("n")
    for i, level in enumerate(reversed(levels[:-1])):
        reached = work.cut(reached.union(reached.join(level, "n").select(F.col("to").alias("n"))), f"reached{i}")
    return points.join(reached, "n").select("key", "at")


def accepted(df: DataFrame, keys: list[str], order: list[str], window_s: float, ts: str = "ts", log: list | None = None) -> DataFrame:
    """df with accepted: a key's first row is, and then each that comes at least window_s seconds after the last one that
    is; rows of one time go by order, and then by their other columns' hash, and only the first can be accepted.

    Times are accepted first (accepted_times); a time's mark is sorted in front of its rows. Null keys are a key of their
    own; a row without a time is accepted, and no other looks back at it. A window of nothing accepts all."""
    own = [c for c in df.columns if c != "accepted"]
    if int(window_s * 1_000_000) <= 0:
        return df.select(*own, F.lit(True).alias("accepted"))
    held = Work(df.sparkSession).cut(df, "rows")
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = held.select(F.struct(*keys).alias("key"), at.alias("at"), F.lit(1).alias("side"), F.struct(*order).alias("o"), F.xxhash64("*").alias("tie"), F.struct("*").alias("row"))
    marks = accepted_times(held, keys, window_s, ts, log).withColumn("side", F.lit(0))
    apart = F.when(F.col("at").isNull(), F.col("tie"))  # rows without a time need not meet
    first = F.lag("side").over(Window.partitionBy("key", "at", apart).orderBy("side", "o", "tie")) == 0
    marked = rows.unionByName(marks, allowMissingColumns=True).withColumn("first", F.coalesce(first, F.lit(False))).filter("side = 1")
    return marked.select(*[F.col(f"row.`{c}`") for c in own], (F.col("first") | F.col("at").isNull()).alias("accepted"))
