"""Statistics of all candidate pairs from tiles of closes: pairs never meet dates as rows.

Closes stand in matrices of tickers by dates. Two blocks of tickers meet once for each block of dates; what a pair needs
of it are sums of products, which matrix products give for all pairs of the two blocks, and the sums over steps from one
common date to the next. A row for each pair and block of dates is all that is shuffled, with the pair's first and last
common closes in it, from which the step over the blocks' edge is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import ratio
from ..session import Work, ship
from .pairs import tested

#: Tickers and dates of a tile.
TICKERS, DATES = 64, 2048
_LEVEL = ("n", "sy", "sx", "syy", "sxy", "sxx")
#: Sums over steps: of the levels before them and of the changes of both legs, and of their products.
_LEGS = ("yl", "xl", "dy", "dx")
_STEPS = ("m", *_LEGS, *[f"{a}_{b}" for i, a in enumerate(_LEGS) for b in _LEGS[i:]])
_EDGES = ("y0", "x0", "y1", "x1")


def _steps(y: np.ndarray, x: np.ndarray) -> list[float]:
    legs = [y[:-1], x[:-1], np.diff(y), np.diff(x)]
    return [len(y) - 1, *[v.sum() for v in legs], *[legs[i] @ legs[j] for i in range(4) for j in range(i, 4)]]


def pair_sums(bars: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, n, sums…) of each pair's common dates in bars (ticker, date, close), which are distinct; the closes are taken
    less their ticker's mean, my and mx."""
    spark, work = bars.sparkSession, Work(bars.sparkSession)
    ship(spark)
    known = bars.filter(F.col("close").isNotNull() & ~F.isnan("close")).select("ticker", "date", "close")
    means = known.groupBy("ticker").agg(F.avg("close").alias("mean"))
    nth = lambda c: F.row_number().over(Window.orderBy(c)) - 1  # noqa: E731  over a row for each ticker or date
    placed = work.cut(means.withColumn("i", nth("ticker")), "tickers")
    days = known.select("date").distinct().withColumn("j", nth("date"))
    cells = known.join(placed, "ticker").join(days, "date").select(F.expr(f"cast(i div {TICKERS} as int)").alias("tb"), F.expr(f"cast(j div {DATES} as int)").alias("db"), F.expr(f"cast(i % {TICKERS} as int)").alias("i"), F.expr(f"cast(j % {DATES} as int)").alias("j"), (F.col("close") - F.col("mean")).alias("z"))

    def tile(t: pa.Table) -> pa.Table:
        m = np.full((TICKERS, DATES), np.nan)
        m[t["i"].to_numpy(), t["j"].to_numpy()] = t["z"].to_numpy()
        return pa.table({"tb": t["tb"].slice(0, 1), "db": t["db"].slice(0, 1), "z": pa.array([m.tobytes()], pa.binary())})

    tiles = work.cut(cells.groupBy("tb", "db").applyInArrow(tile, "tb int, db int, z binary"), "tiles")
    of = placed.select("ticker", F.expr(f"cast(i div {TICKERS} as int)").alias("block"), F.expr(f"cast(i % {TICKERS} as int)").alias("at"))
    wanted = pairs.join(of.toDF("a", "ta", "ia"), "a").join(of.toDF("b", "tb", "ib"), "b")
    # a tile of pairs lists the places of those that are asked for, as many as a tile has cells at most
    asked = wanted.groupBy("ta", "tb").agg(F.collect_list(F.struct("ia", "ib")).alias("who"))
    left, right = tiles.select(F.col("tb").alias("ta"), "db", F.col("z").alias("y")), tiles.select("tb", "db", F.col("z").alias("x"))
    met = asked.join(left, "ta").join(right, ["tb", "db"]).select("ta", "tb", "db", "who", "y", "x")
    names = (*_LEVEL, *_STEPS, *_EDGES)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ta, tb, db, who, y, x in zip(*(b.column(i) for i in range(6))):
                ia, ib = (np.array(who.values.field(k)) for k in (0, 1))
                y, x = (np.frombuffer(v.as_buffer()).reshape(TICKERS, DATES) for v in (y, x))
                my, mx = (~np.isnan(v) for v in (y, x))
                zy, zx, fy, fx = np.where(my, y, 0.0), np.where(mx, x, 0.0), my.astype(float), mx.astype(float)
                level = [fy @ fx.T, zy @ fx.T, fy @ zx.T, (zy * zy) @ fx.T, zy @ zx.T, fy @ (zx * zx).T]
                out = np.zeros((len(ia), len(names)))
                for c, m in enumerate(level):
                    out[:, c] = m[ia, ib]
                for k in np.flatnonzero(out[:, 0] > 0):
                    common = np.flatnonzero(my[ia[k]] & mx[ib[k]])
                    u, v = y[ia[k], common], x[ib[k], common]
                    out[k, len(_LEVEL) :] = [*_steps(u, v), u[0], v[0], u[-1], v[-1]]
                keep = np.flatnonzero(out[:, 0] > 0)
                ids = [pa.array(np.full(len(keep), v.as_py(), np.int32)) for v in (ta, tb, db)]
                yield pa.record_batch([*ids, pa.array(ia[keep].astype(np.int32)), pa.array(ib[keep].astype(np.int32)), *[pa.array(np.ascontiguousarray(out[keep, c])) for c in range(len(names))]], ["ta", "tb", "db", "ia", "ib", *names])

    kinds = "ta int, tb int, db int, ia int, ib int, " + ", ".join(f"{c} double" for c in names)
    pair = ["ta", "tb", "ia", "ib"]
    w = Window.partitionBy(*pair).orderBy("db")  # a row for each block of dates
    parts = met.mapInArrow(sums, kinds).withColumns({"ly": F.lag("y1").over(w), "lx": F.lag("x1").over(w)})
    legs = {"yl": F.col("ly"), "xl": F.col("lx"), "dy": F.col("y0") - F.col("ly"), "dx": F.col("x0") - F.col("lx")}
    edge = {"m": F.lit(1.0), **legs, **{f"{a}_{b}": legs[a] * legs[b] for i, a in enumerate(_LEGS) for b in _LEGS[i:]}}
    over = lambda c: F.when(F.col("ly").isNotNull(), edge[c]).otherwise(0.0)
    total = parts.groupBy(*pair).agg(*[F.sum(c).alias(c) for c in _LEVEL], *[F.sum(F.col(c) + over(c)).alias(c) for c in _STEPS])
    back = wanted.select("a", "b", *pair)
    mean = placed.select("ticker", "mean")
    return total.join(back, pair).join(mean.toDF("a", "my"), "a").join(mean.toDF("b", "mx"), "b").drop(*pair)


def pair_statistics(bars: DataFrame, pairs: DataFrame, least: int = 252) -> DataFrame:
    """(a, b, n, beta, alpha, t, p, phi, half_life) of each pair (a, b) with at least so many common dates: least squares
    of a's close on b's, and the test of the spread's changes on its level. The sums of a spread's level and change follow
    from those of its legs."""
    s = pair_sums(bars, pairs).filter(F.col("n") >= least)
    c = lambda xy, x, y, n: F.col(xy) - F.col(x) * F.col(y) / F.col(n)
    beta = ratio(c("sxy", "sx", "sy", "n"), c("sxx", "sx", "sx", "n"))
    alpha = F.col("my") + F.col("sy") / F.col("n") - beta * (F.col("mx") + F.col("sx") / F.col("n"))
    work = Work(bars.sparkSession)
    s = work.cut(s.withColumns({"beta": beta, "alpha": alpha}), "pairs")  # else what follows holds beta's own sums many times over
    u = lambda a, b: c(f"{a}_{b}", a, b, "m")
    k = F.col("beta")
    sums = {
        "xx": u("yl", "yl") - 2 * k * u("yl", "xl") + k * k * u("xl", "xl"),
        "xy": u("yl", "dy") - k * (u("yl", "dx") + u("xl", "dy")) + k * k * u("xl", "dx"),
        "yy": u("dy", "dy") - 2 * k * u("dy", "dx") + k * k * u("dx", "dx"),
    }
    spread = s.select("a", "b", F.col("n").cast("long").alias("held"), "beta", "alpha", F.col("m").alias("n"), sums["xx"].alias("sxx"), sums["xy"].alias("sxy"), sums["yy"].alias("syy"))
    return tested(work.cut(spread, "spreads"), "held", "beta", "alpha").withColumnRenamed("held", "n")


def find_pairs(bars: DataFrame, pairs: DataFrame, least: int = 252, most_p: float = 0.05, longest: float = 60.0, cap: int = 20) -> DataFrame:
    """(a, b, beta, p, half_life): cointegrated pairs that revert soon, by p; cap of them as a report."""
    j = pair_statistics(bars, pairs, least)
    good = j.filter((F.col("p") < most_p) & (F.col("half_life") > 0) & (F.col("half_life") < longest))
    return good.orderBy("p", "half_life", "a", "b").limit(cap).select("a", "b", "beta", "p", "half_life")
