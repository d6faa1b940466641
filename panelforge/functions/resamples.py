"""Weighted resamples of rows, as arrays: what is shuffled is one array for each key and task, not a row for each draw.

A row's weights follow from its own name and the number of the resample alone, by a counter-based generator whose steps
any engine with 64-bit integers can repeat (mixed_sql), so that a task that runs again draws the same."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship

#: The generator's increment and multiplier, and rows times resamples that are drawn at a time.
STEP, TIMES, AT_ONCE = 2_654_435_761, 73_244_475, 1 << 20
#: Keys that a task adds up before it hands them on.
HELD = 256


def poisson(rate: float) -> list[float]:
    """The distribution function of a Poisson variable at 0, 1, 2, … up to where nothing is left, in twelve places."""
    out, p, total = [], math.exp(-rate), 0.0
    for k in range(64):
        total += p
        out.append(round(total, 12))
        if total > 1 - 1e-10:
            break
        p *= rate / (k + 1)
    return out


def uniforms(names: np.ndarray, b: int) -> np.ndarray:
    """A number in [0, 1) for each name (an integer below 2**32) and each resample 1 … b."""
    x = (names.astype(np.uint64)[:, None] + np.arange(1, b + 1, dtype=np.uint64) * np.uint64(STEP)) % np.uint64(1 << 32)
    for _ in range(2):
        x ^= x >> np.uint64(16)
        x = x * np.uint64(TIMES) % np.uint64(1 << 32)
    return (x ^ x >> np.uint64(16)) / 4294967296.0


def name_of(seed: int, *parts: str) -> Column:
    """A row's name: the first 32 bits of the MD5 of its parts, joined by bars."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def weighted_sums(df: DataFrame, keys: list[str], value: str, name: Column, b: int, rate: float = 1.0, size: str | None = None) -> DataFrame:
    """(keys…, n, i, s, w): of each key's rows and each resample i = 1 … b, the sum of the values with Poisson weights, and
    the sum of the weights (times the rows' own size, if a column has it); n is the number of rows. Null values take no
    part. A task holds b sums for each of a few keys; keys come together as arrays and are spread out in the end."""
    ship(df.sparkSession)
    steps = np.array(poisson(rate))
    key = F.struct(*keys)
    rows = df.filter(F.col(value).isNotNull()).select(key.alias("key"), F.to_json(key).alias("of"), F.col(value).cast("double").alias("x"), (F.col(size) if size else F.lit(1.0)).cast("double").alias("size"), name.alias("name"))
    kinds = T.StructType([rows.schema["key"], T.StructField("n", T.LongType()), T.StructField("s", T.BinaryType()), T.StructField("w", T.BinaryType())])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        shape = None

        def out() -> pa.RecordBatch:
            columns = [pa.concat_arrays([k for k, *_ in held.values()]), pa.array([n for _, n, _ in held.values()], pa.int64()), *[pa.array([m[i].tobytes() for *_, m in held.values()], pa.binary()) for i in (0, 1)]]
            return pa.record_batch(columns, ["key", "n", "s", "w"])

        for batch in batches:
            shape = batch
            of, x, size, names = batch.column(1).to_numpy(zero_copy_only=False), *(batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
            found, first, code = np.unique(of, return_index=True, return_inverse=True)
            for j, (k, at) in enumerate(zip(found, first)):
                mine = np.flatnonzero(code == j)
                own = held.setdefault(k, [batch.column(0).slice(int(at), 1), 0, np.zeros((2, b))])
                own[1] += len(mine)
                for s in range(0, len(mine), max(1, AT_ONCE // b)):
                    i = mine[s : s + max(1, AT_ONCE // b)]
                    w = np.searchsorted(steps, uniforms(names[i], b), "right").astype(float)
                    own[2] += np.stack([x[i] @ w, size[i] @ w])
                if len(held) >= HELD:
                    yield out()
                    held.clear()
        if held and shape is not None:
            yield out()

    def merged(t: pa.Table) -> pa.Table:
        s, w = (sum(np.frombuffer(m) for m in t[c].to_pylist()) for c in ("s", "w"))
        one = pa.table({"key": t["key"].slice(0, 1), "n": [sum(t["n"].to_pylist())]})
        return one.append_column("m", pa.array([[{"i": i + 1, "s": float(x), "w": float(y)} for i, (x, y) in enumerate(zip(s, w))]], pa.list_(pa.struct([("i", pa.int64()), ("s", pa.float64()), ("w", pa.float64())]))))

    pair = T.ArrayType(T.StructType([T.StructField("i", T.LongType()), T.StructField("s", T.DoubleType()), T.StructField("w", T.DoubleType())]))
    sums = rows.mapInArrow(added, kinds).groupBy("key").applyInArrow(merged, T.StructType([rows.schema["key"], T.StructField("n", T.LongType()), T.StructField("m", pair)]))
    return sums.select("key.*", "n", F.explode("m").alias("m")).select(*keys, "n", "m.i", "m.s", "m.w")


def mixed_sql(name: str, i: str) -> str:
    """The same number in [0, 1) as SQL with 64-bit integers."""
    x = f"(({name} + {i} * {STEP}) % 4294967296)"
    for _ in range(2):
        x = f"((xor({x}, {x} >> 16) * {TIMES}) % 4294967296)"
    return f"(xor({x}, {x} >> 16) / 4294967296.0)"


def name_sql(seed: int, *parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', {seed}, {', '.join(parts)})), 1, 8))::BIGINT)"


def weight_sql(u: str, rate: float = 1.0) -> str:
    return " + ".join(f"CAST({u} >= {c!r} AS INT)" for c in poisson(rate))
