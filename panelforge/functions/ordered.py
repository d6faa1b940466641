"""Orders over all rows that no task holds: ranges of a sort, what one range hands on to the next, and scans.

Rows are sorted by ranges and written, so that every range keeps its number and its rows however often it is read. What a
row needs from the rows before it is found inside its range; what is missing then comes from the range before, by a table
with a row for each range. A key with most of the rows spans ranges like any other rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import Work, ship


def partitions(df: DataFrame) -> int:
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def in_ranges(df: DataFrame, order: list[Column]) -> DataFrame:
    """df sorted by ranges of the order, with part and nth, a row's range and its place there."""
    sorted_ = df.repartitionByRange(partitions(df), *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()  # the number of the partition, then of the row in it
    return sorted_.withColumns({"part": F.shiftright(at, 33).cast("int"), "nth": at.bitwiseAND((1 << 33) - 1)})


def numbered(df: DataFrame, order: list[str], out: str = "n") -> DataFrame:
    """df with each row's place in the order, from 0: its place in its range and the sizes of the ranges before. Columns
    named with a minus in front go downwards."""
    rows = df.select(F.struct("*").alias("row"))
    of = [F.col(f"row.`{c[1:]}`").desc() if c.startswith("-") else F.col(f"row.`{c}`").asc() for c in order]
    made = Work(df.sparkSession).cut(in_ranges(rows, of), "ranges")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = made.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    return made.join(starts, "part").select("row.*", (F.col("start") + F.col("nth")).alias(out))


def _scan(a: np.ndarray, b: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maps y -> a y + b composed along their runs, by doubling: (a2, b2) after (a1, b1) is (a2 a1, a2 b1 + b2).
    b: a row for each component; at: a row's place in its run."""
    shift, most = 1, int(at.max(initial=0))
    a, b = a.copy(), b.copy()
    while shift <= most:
        i = np.flatnonzero(at >= shift)
        if not a[i].any():  # nothing from further back is left
            break
        b[:, i] += a[i] * b[:, i - shift]
        a[i] = a[i] * a[i - shift]
        shift *= 2
    return a, b


def _starts(columns: list[pa.Array], before: list[pa.Scalar] | None) -> np.ndarray:
    """Which rows begin a run of equal keys; before: the keys of the row in front."""
    n = len(columns[0])
    out = np.zeros(n, bool)
    for i, c in enumerate(columns):
        own = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        here, there = own.slice(1), own.slice(0, n - 1)
        differ = pc.fill_null(pc.not_equal(here, there), False).to_numpy(zero_copy_only=False) | (pc.is_null(here).to_numpy(zero_copy_only=False) != pc.is_null(there).to_numpy(zero_copy_only=False))
        out[1:] |= differ
        out[0] |= before is None or before[i] != own[0]
    return out


def ewm(df: DataFrame, value: str, span: float, keys: list[str], order: list[str], out: str = "ewm", adjust: bool = False, start: float | None = None) -> DataFrame:
    """df with the exponentially weighted mean of a column along the order of each key, with alpha = 2 / (span + 1).

    y_t = (1 - alpha) y_(t-1) + alpha x_t, from the key's first value or, where given, from start; adjust: the weighted
    mean of all values so far with weights (1 - alpha)^age, as if history were endless before. A null value leaves the
    mean as it is, and has none before the first value. Each value is an affine map of what came before; maps are composed
    inside ranges of the order, the ranges' own maps one after the other (a row each, on the driver), and what a range is
    handed is put into its first key's rows. So a series may span any number of tasks. Rows that tie in key and order are
    told apart by their other columns' hash; extra columns pass through, out is replaced."""
    alpha, m = 2.0 / (span + 1.0), 2 if adjust else 1
    own = [c for c in df.columns if c != out]
    row = df.select(*own)
    ship(df.sparkSession)
    named = [F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]
    sort = [F.col(o).alias(f"o{i}") for i, o in enumerate(order)]
    base = row.select(F.struct("*").alias("row"), *named, *sort, F.xxhash64("*").alias("tie"), F.col(value).cast("double").alias("x"))
    names = [f"k{i}" for i in range(len(keys))] + [f"o{i}" for i in range(len(order))] + ["tie"]
    n_keys = len(keys)
    ranges = in_ranges(base, [F.col(c) for c in names]).select("row", *names[:n_keys], "part", "nth", "x")

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, a0, b0, first, seen, open_ = None, 1.0, np.zeros(m), np.nan, 0, True
        begun = False
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            cols = [batch.column(1 + i) for i in range(n_keys)]
            starts = _starts(cols, before) if n_keys else np.zeros(n, bool)
            x = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(float)
            known = ~np.isnan(x)
            run = np.cumsum(starts)
            run -= run[0]
            heads = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
            at = np.arange(n) - heads[run]
            count = np.cumsum(known)
            count = count - np.append(0, count)[heads][run]  # values so far in the run
            got = np.full(len(heads), np.nan)
            hit = np.flatnonzero(known & (count == 1))
            got[run[hit]] = x[hit]
            a = np.where(known, 1 - alpha, 1.0)
            b = np.where(known, (x if adjust else alpha * x), 0.0)[None, :]
            b = np.vstack([b, known.astype(float)]) if adjust else b
            a, b = _scan(a, b, at)
            opens = np.zeros(len(heads), bool)
            if begun and not starts[0]:  # goes on with the run of the batch before
                i = run == 0
                b[:, i] += a[i] * b0[:, None]
                a[i] *= a0
                count[i] += seen
                got[0] = first if seen else got[0]
                opens[0] = open_
            elif not begun:
                opens[0] = True
            begun, before = True, [c[n - 1] for c in cols]
            a0, b0, seen, first, open_ = a[-1], b[:, -1].copy(), int(count[-1]), got[run[-1]], bool(opens[run[-1]])
            extra = [pa.array(a), *[pa.array(v) for v in b], pa.array(count), pa.array(got[run], from_pandas=True), pa.array(opens[run])]
            yield pa.record_batch([*[batch.column(i) for i in range(batch.num_columns - 1)], *extra], [*batch.schema.names[:-1], "a", *[f"b{i}" for i in range(m)], "seen", "first", "open"])

    kind = T.StructType(ranges.schema.fields[:-1] + [T.StructField(c, T.DoubleType()) for c in ("a", *[f"b{i}" for i in range(m)])] + [T.StructField("seen", T.LongType()), T.StructField("first", T.DoubleType()), T.StructField("open", T.BooleanType())])
    made = Work(df.sparkSession).cut(ranges.mapInArrow(scanned, kind), "scanned")
    key = F.struct(*names[:n_keys]) if n_keys else F.lit(0)
    bs = [f"b{i}" for i in range(m)]
    ends = made.groupBy("part").agg(F.min_by(key, "nth").alias("head"), F.max_by(F.struct(key.alias("key"), "a", *bs, "seen", "first", "open"), "nth").alias("last"))
    carry, state, held = [], None, None  # a row for each range
    for r in ends.orderBy("part").collect():
        own_state = state if state is not None and held == r.head else None
        carry.append((r.part, own_state))
        last = r["last"]
        from_ = own_state if last.open else None
        if last.seen or from_ is not None:
            init = from_ if from_ is not None else ([start] if start is not None else [last.first]) if not adjust else [0.0] * m
            state = [last.a * init[i] + last[f"b{i}"] for i in range(m)]
        else:
            state = None
        held = last.key
    handed = df.sparkSession.createDataFrame(carry, "part int, carry array<double>")
    j = made.join(handed, "part", "left")
    taken = F.when(F.col("open"), F.col("carry"))
    # without a hand-over, from the key's first value
    begin = F.array(*[F.lit(0.0)] * m) if adjust else F.array(F.lit(start) if start is not None else F.col("first"))
    from_ = F.coalesce(taken, begin)
    y = [F.col("a") * from_[i] + F.col(f"b{i}") for i in range(m)]
    result = y[0] / y[1] if adjust else y[0]
    return j.select(*[F.col(f"row.`{c}`") for c in own], F.when((F.col("seen") > 0) | taken.isNotNull(), result).alias(out))


def asof_join(left: DataFrame, right: DataFrame, by: list[str], on: str, right_on: str | None = None, tolerance: float | None = None, strict: bool = False, forward: bool = False, tie: list[str] | None = None, prefix: str = "right_") -> DataFrame:
    """left with, of the rows of right with the same keys, the one whose time is the last not after its own (strict: the
    last before it; forward: the first not before, or after it), its columns prefixed; null where there is none, or none
    within the tolerance (in the units of the difference; seconds for timestamps, days for dates).

    Both sides are sorted together by ranges of (key, time). Inside a range the last row of right is carried along a
    window; the first key of a range takes what the ranges before hold of that key. A key with most of the rows thus
    spans ranges, and no row of left meets more than one row of right. Rows of right that tie are told apart by tie, the
    last counts (forward: the first), and then by their columns' hash. Null keys match nothing, nor do null times."""
    right_on = right_on or on
    payload = F.struct(*[F.col(f"`{c}`") for c in right.columns if c not in by])
    names = [f"k{i}" for i in range(len(by))]
    keys = lambda: [F.col(c).alias(k) for c, k in zip(by, names)]
    n_tie = len(tie or [])
    kinds = dict(right.dtypes)
    blank = [F.lit(None).cast(kinds[t]).alias(f"tie{i}") for i, t in enumerate(tie or [])]
    # a side that may be met at the same time comes first
    side = {"left": 0 if strict else 1, "right": 1 if strict else 0}
    time_kind = dict(left.dtypes)[on]
    rows = left.select(*keys(), F.col(on).alias("at"), F.lit(side["left"]).alias("side"), *blank, F.lit(0).cast("long").alias("hash"), F.struct("*").alias("l"), F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType).alias("r"))
    others = right.filter(F.col(right_on).isNotNull()).select(*keys(), F.col(right_on).cast(time_kind).alias("at"), F.lit(side["right"]).alias("side"), *[F.col(t).alias(f"tie{i}") for i, t in enumerate(tie or [])], F.xxhash64(*right.columns).alias("hash"), F.lit(None).cast(left.select(F.struct("*").alias("p")).schema["p"].dataType).alias("l"), payload.alias("r"))
    turn = (lambda c: F.col(c).desc()) if forward else (lambda c: F.col(c).asc())
    order = [F.col(k) for k in names] + [turn("at"), F.col("side"), *[turn(f"tie{i}") for i in range(n_tie)], turn("hash")]
    made = Work(left.sparkSession).cut(in_ranges(rows.union(others), order), "ranges")
    inside = Window.partitionBy("part", *names).orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    met = made.withColumn("found", F.last("r", ignorenulls=True).over(inside))
    # what ranges hand on: the first key of each asks, the last key of each gives
    key = F.struct(*names)
    ends = made.groupBy("part").agg(F.min_by(key, "nth").alias("head"), F.max_by(key, "nth").alias("foot"))
    feet = made.join(ends.select("part", "foot"), "part").filter(key == F.col("foot")).groupBy("part", "foot").agg(F.max_by("r", F.when(F.col("r").isNotNull(), F.col("nth"))).alias("r"))
    ask = ends.select("part", F.lit(0).alias("turn"), F.col("head").alias("key"), F.lit(None).cast(made.schema["r"].dataType).alias("r"))
    give = feet.select("part", F.lit(1).alias("turn"), F.col("foot").alias("key"), "r")
    along = Window.partitionBy("key").orderBy("part", "turn").rowsBetween(Window.unboundedPreceding, 0)
    handed = ask.union(give).withColumn("carried", F.last("r", ignorenulls=True).over(along)).filter("turn = 0").select("part", F.col("key").alias("head"), "carried")
    found = F.coalesce("found", F.when(key == F.col("head"), F.col("carried")))
    j = met.filter("l IS NOT NULL").join(handed, "part", "left").select("l", "at", *names, found.alias("found"))
    when = F.col(f"found.`{right_on}`").cast(time_kind)
    valid = F.col("at").isNotNull() & F.col("found").isNotNull()
    for k in names:
        valid = valid & F.col(k).isNotNull()
    if tolerance is not None:
        apart = F.datediff("at", when) if time_kind == "date" else (F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(when.cast("timestamp"))) / 1e6 if time_kind.startswith("timestamp") else F.col("at") - when
        valid = valid & (F.abs(apart) <= tolerance)
    rest = [c for c in right.columns if c not in by]
    return j.select(*[F.col(f"l.`{c}`") for c in left.columns], *[F.when(valid, F.col(f"found.`{c}`")).alias(f"{prefix}{c}") for c in rest])
