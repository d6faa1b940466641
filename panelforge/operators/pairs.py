"""Pairs of tickers over closes (date, ticker, close)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio

PAIR = ("a", "b")


def pair_candidates(tickers: DataFrame) -> DataFrame:
    """(a, b) with a < b, inside a sector if tickers (ticker, sector) have one."""
    x, y = tickers.alias("x"), tickers.alias("y")
    on = F.col("x.ticker") < F.col("y.ticker")
    if "sector" in tickers.columns:
        on = on & (F.col("x.sector") == F.col("y.sector"))
    return x.join(y, on).select(F.col("x.ticker").alias("a"), F.col("y.ticker").alias("b"))


def aligned(bars: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, date, y, x): both closes on common dates. The pairs meet the rows of a by ticker, those of b by key."""
    p = pairs.join(bars.select(F.col("ticker").alias("a"), "date", F.col("close").alias("y")), "a")
    return p.join(bars.select(F.col("ticker").alias("b"), "date", F.col("close").alias("x")), ["b", "date"])


def pair_hedge_ratio(rows: DataFrame, least: int = 252) -> DataFrame:
    """(a, b, beta, alpha, n): least squares of y on x."""
    h = rows.groupBy(*PAIR).agg(F.regr_slope("y", "x").alias("beta"), F.regr_intercept("y", "x").alias("alpha"), F.count("*").alias("n"))
    return h.filter(F.col("n") >= least)


def pair_spread(rows: DataFrame, hedges: DataFrame) -> DataFrame:
    return rows.join(hedges.select(*PAIR, "beta"), list(PAIR)).select(*PAIR, "date", (F.col("y") - F.col("beta") * F.col("x")).alias("spread"))


def _steps(spreads: DataFrame) -> DataFrame:
    before = F.lag("spread").over(Window.partitionBy(*PAIR).orderBy("date"))
    return spreads.withColumn("x", before).withColumn("y", F.col("spread") - F.col("x")).filter("x IS NOT NULL")


def tested(sums: DataFrame, *keep: str) -> DataFrame:
    """(a, b, keep…, t, p, phi, half_life) of (a, b, n, sxx, sxy, syy), the sums of a spread's change on its level."""
    s = sums.withColumn("phi", ratio("sxy", "sxx"))
    sse = F.greatest(F.col("syy") - F.col("phi") * F.col("sxy"), F.lit(0.0))
    s = s.withColumn("t", ratio("phi", F.sqrt(ratio(ratio(sse, F.col("n") - 2.0), F.col("sxx")))))
    p = F.when(F.col("t").isNull(), 1.0).when(F.col("t") < -3.43, 0.01).when(F.col("t") < -2.86, 0.05).when(F.col("t") < -2.57, 0.10).otherwise(0.50)
    back = (F.col("phi") < 0) & (F.col("phi") > -1)
    half = F.when(back, -0.6931471805599453 / F.ln(F.when(back, 1 + F.col("phi"))))
    return s.select(*PAIR, *keep, "t", p.alias("p"), "phi", half.alias("half_life"))


def _changes(spreads: DataFrame) -> DataFrame:
    s = _steps(spreads).groupBy(*PAIR)
    return s.agg(F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("syy"), F.regr_sxy("y", "x").alias("sxy"), F.count("*").alias("n"))


def adf_simple(spreads: DataFrame) -> DataFrame:
    """(a, b, t, p): the change on the level and a constant; p by the usual critical values."""
    return tested(_changes(spreads)).select(*PAIR, "t", "p")


def half_life(spreads: DataFrame) -> DataFrame:
    """(a, b, phi, half_life): null where the spread does not revert."""
    return tested(_changes(spreads)).select(*PAIR, "phi", "half_life")


def kalman_pair_signal(rows: DataFrame, q: float = 1e-4, r: float = 1.0, span: int = 60, entry: float = 2.0, leave: float = 0.5, stop: float = 3.5, least: int = 10) -> DataFrame:
    """(a, b, date, beta, spread, z, signal): a filter of y on x whose state, slope and intercept, walks at random from
    (1, 0). What is left after each update is scored by exponential mean and variance, from 0 and 1. A short spread is
    entered above entry and left below leave, a long one the other way round, and either beyond stop. Pairs of fewer
    than least dates have no rows. Sequential inside a pair, parallel over pairs."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        if len(pdf) < least:
            return pd.DataFrame(columns=["a", "b", "date", "beta", "spread", "z", "signal"])
        slope, intercept, p = 1.0, 0.0, np.eye(2)
        mean, var, side, k, out = 0.0, 1.0, 0, 2.0 / (span + 1), []
        for y, x in zip(pdf["y"], pdf["x"]):
            p = p + q * np.eye(2)
            seen = np.array([x, 1.0])
            reach = p @ seen
            gain = reach / (seen @ reach + r)
            off = y - slope * x - intercept
            slope, intercept = slope + gain[0] * off, intercept + gain[1] * off
            p = p - np.outer(gain, reach)
            spread = y - slope * x - intercept
            mean += k * (spread - mean)
            var += k * ((spread - mean) ** 2 - var)
            z = (spread - mean) / max(var, 1e-10) ** 0.5
            if side:
                # how far the spread still stands on the side that it was entered on
                held = -side * z
                side = 0 if held < leave or held > stop else side
            elif abs(z) > entry:
                side = -1 if z > 0 else 1
            out.append((slope, spread, z, side))
        beta, spreads, zs, signals = zip(*out)
        return pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "date": pdf["date"], "beta": beta, "spread": spreads, "z": zs, "signal": signals})

    return rows.groupBy(*PAIR).applyInPandas(walk, "a string, b string, date date, beta double, spread double, z double, signal int")


def pair_signals_as_of(signals: DataFrame, as_of: str) -> DataFrame:
    """The newest row of each pair before as_of, if it holds a position."""
    known = signals.filter(F.col("date") < F.lit(as_of).cast("date"))
    last = known.groupBy(*PAIR).agg(F.max_by(F.struct("date", "beta", "z", "signal"), "date").alias("r")).select(*PAIR, "r.*")
    return last.filter("signal <> 0")


def pair_weights(signals: DataFrame) -> DataFrame:
    """(ticker, weight): signal / n on a, -signal * beta / n on b, summed."""
    s = signals.withColumn("n", F.count("*").over(Window.partitionBy()))
    legs = F.explode(F.array(F.struct(F.col("a").alias("ticker"), (F.col("signal") / F.col("n")).alias("w")), F.struct(F.col("b").alias("ticker"), (-F.col("signal") * F.col("beta") / F.col("n")).alias("w"))))
    return s.select(legs.alias("l")).groupBy("l.ticker").agg(F.sum("l.w").alias("weight"))
