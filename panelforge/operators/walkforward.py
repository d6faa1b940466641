"""Ridge regressions over many training spans from one pass of sums.

A fit needs no more of its rows than their number, the sums of columns and the sums of their products. These add up by
date, so the sums of any span of dates are the difference of two prefixes, and every fold, share or strength is solved
from its own small system. The data is read once for the sums and once to score the rows that are tested.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio
from ..functions.pooled import pooled_spearman
from ..session import Work, ship


class Ridge(NamedTuple):
    """Least squares on standardised features (sums of squared errors, plus alpha times the squared coefficients), with a
    mean that is not penalised."""

    alpha: float = 1.0


def tidy(df: DataFrame, features: list[str], target: str = "ret") -> DataFrame:
    """(date, x, y) of the rows whose features and target are all there."""
    known = df.select("date", *features, target).dropna()
    return known.select("date", F.array(*[F.col(c).cast("double") for c in features]).alias("x"), F.col(target).cast("double").alias("y"))


def _sums(p: int) -> list[str]:
    """Names of the sums, of n, x, y, xx (a triangle), xy and yy."""
    return ["n", *[f"x{i}" for i in range(p)], "y", *[f"x{i}x{j}" for i in range(p) for j in range(i, p)], *[f"x{i}y" for i in range(p)], "yy"]


def gram_by_date(rows: DataFrame, p: int) -> DataFrame:
    """(date, n, sums…) of (date, x, y)."""
    x, y = [F.col("x")[i] for i in range(p)], F.col("y")
    values = [F.lit(1.0), *x, y, *[x[i] * x[j] for i in range(p) for j in range(i, p)], *[x[i] * y for i in range(p)], y * y]
    return rows.groupBy("date").agg(*[F.sum(v).alias(c) for v, c in zip(values, _sums(p))])


def prefixes(gram: DataFrame, p: int) -> DataFrame:
    """(k, date, sums…): k numbers the dates from 0, and each has the sums of all dates up to it. A row for each date."""
    w = Window.orderBy("date")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return gram.select("date", (F.row_number().over(w) - 1).cast("long").alias("k"), *[F.sum(c).over(upto).alias(c) for c in _sums(p)])


def spans_of(prefix: DataFrame, spans: DataFrame, p: int) -> DataFrame:
    """spans (…, first, last), places of dates, with the sums over each: the difference of two prefixes."""
    sums = _sums(p)
    upto = prefix.select(F.col("k").alias("last"), *[F.col(c).alias(f"u_{c}") for c in sums])
    before = prefix.select((F.col("k") + 1).alias("first"), *[F.col(c).alias(f"b_{c}") for c in sums])
    j = spans.join(upto, "last").join(before, "first", "left")
    return j.select(*spans.columns, *[(F.col(f"u_{c}") - F.coalesce(f"b_{c}", F.lit(0.0))).alias(c) for c in sums])


def solved(sums: DataFrame, p: int) -> DataFrame:
    """sums (…, alpha, n, sums…) with the coefficients (b) and the constant (a), and r2, the share of the span's own
    variance that they explain. Features that do not vary in a span get no coefficient."""
    ship(sums.sparkSession)
    own = [c for c in sums.columns if c not in _sums(p) or c == "n"]
    schema = sums.select(*own).selectExpr("*", "array(0D) AS b", "0D AS a", "0D AS r2").schema
    names = _sums(p)

    def solve(batches):
        for batch in batches:
            v = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in names], 1)
            alpha = batch.column("alpha").to_numpy(zero_copy_only=False).astype(float)
            b, a, fit = [], [], []
            for s, strength in zip(v, alpha):
                n, x, y = s[0], s[1 : p + 1], s[p + 1]
                xx = np.zeros((p, p))
                xx[np.triu_indices(p)] = s[p + 2 : p + 2 + p * (p + 1) // 2]
                xx = xx + np.triu(xx, 1).T
                xy, yy = s[-p - 1 : -1], s[-1]
                c = xx - np.outer(x, x) / n
                d = xy - x * y / n
                var = np.diag(c) / n
                scale = np.where(var > 1e-12 * np.maximum(np.diag(xx) / n, 1e-300), np.sqrt(np.maximum(var, 0)), np.inf)
                z = c / np.outer(scale, scale)
                beta = np.linalg.lstsq(z + strength * np.eye(p) * np.isfinite(scale), d / scale, rcond=None)[0] / scale
                total = yy - y * y / n
                lost = total - 2 * beta @ d + beta @ c @ beta
                b.append(beta)
                a.append((y - beta @ x) / n)
                fit.append(1 - lost / total if total > 0 else 0.0)
            yield pa.record_batch([*[batch.column(c) for c in own], pa.array(b, pa.list_(pa.float64())), pa.array(a, pa.float64()), pa.array(fit, pa.float64())], [*own, "b", "a", "r2"])

    return sums.mapInArrow(solve, schema)


def predicted(rows: DataFrame, models: DataFrame, keys: list[str]) -> DataFrame:
    """(keys…, y, prediction) of rows (date, x, y) on the test dates of models (keys…, a, b, from, to): places of dates,
    which rows must have as k. The models are as many as folds, whatever the rows; they are joined by the dates they
    test."""
    held = models.select(*keys, "a", "b", F.explode(F.sequence("from", "to")).alias("k"))
    value = F.col("a") + F.aggregate(F.zip_with("b", "x", lambda u, v: u * v), F.lit(0.0), lambda s, u: s + u)
    return rows.join(held, "k").select(*keys, "y", value.alias("prediction"))


def figures(scored: DataFrame, keys: list[str]) -> DataFrame:
    """(keys…, ic, r2, n_test) of (keys…, y, prediction): Spearman's correlation, 0 where a side does not vary, and the
    share of the tested rows' variance that is explained."""
    n, y, yy = F.count("*"), F.sum("y"), F.sum(F.col("y") * F.col("y"))
    left = F.sum((F.col("y") - F.col("prediction")) ** 2)
    r2 = scored.groupBy(*keys).agg(F.coalesce(1 - ratio(left, yy - y * y / n), F.lit(0.0)).alias("r2"))
    ic = pooled_spearman(scored, keys, "y", "prediction").select(*keys, F.coalesce("corr", F.lit(0.0)).alias("ic"), F.col("n").alias("n_test"))
    return ic.join(r2, keys).select(*keys, "ic", "r2", "n_test")


def _ready(df: DataFrame, features: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with k, prefixes, dates with their rows): written, as they are read more than once."""
    work, p = Work(df.sparkSession), len(features)
    rows = work.cut(tidy(df, features), "rows")
    prefix = work.cut(prefixes(gram_by_date(rows, p), p), "prefixes")
    return rows.join(prefix.select("date", "k"), "date"), prefix, prefix.select("k", "date", "n")


def ridge_folds(df: DataFrame, features: list[str], alphas: dict[str, float], train: int = 504, test: int = 63, step: int = 21) -> DataFrame:
    """(model, fold, ic, r2, n_test): a ridge regression for each strength and fold of an expanding walk forward, trained
    on the dates [0, t) and tested on the next ones, t moving by step."""
    rows, prefix, dates = _ready(df, features)
    n = dates.agg(F.count("*").alias("n"))  # one row
    starts = n.filter(F.col("n") >= train + test).select(F.posexplode(F.expr(f"sequence({train}L, n - {test}, {step}L)")).alias("fold", "t"))
    models = df.sparkSession.createDataFrame([(k, float(v)) for k, v in alphas.items()], "model string, alpha double")
    spans = starts.crossJoin(F.broadcast(models)).select("model", "fold", "alpha", F.lit(0).cast("long").alias("first"), (F.col("t") - 1).alias("last"), F.col("t").alias("from"), (F.col("t") + test - 1).alias("to"))
    fitted = Work(df.sparkSession).cut(solved(spans_of(prefix, spans, len(features)), len(features)), "models")
    return figures(predicted(rows, fitted, ["model", "fold"]), ["model", "fold"])


def _split(dates: DataFrame, share: float) -> DataFrame:
    """One row (cut, end) of dates (k, n rows up to it): the last place of the training, the first share of the rows, and
    the last of all."""
    total = F.max("n").over(Window.partitionBy())  # a row for each date
    d = dates.withColumn("train", F.col("n") <= F.floor(share * total))
    return d.agg(F.coalesce(F.max(F.when(F.col("train"), F.col("k"))), F.lit(-1)).alias("cut"), F.max("k").alias("end"))


def curve(df: DataFrame, features: list[str], points: list[tuple[float, float]], held: float = 0.1) -> DataFrame:
    """(share, alpha, n_train, train_r2, test_r2, test_ic, n_test): for each (share, alpha) a ridge regression on the first
    share of the training dates, tested on the last tenth of the rows. One pass for all of them."""
    rows, prefix, dates = _ready(df, features)
    split = _split(dates, 1 - held)
    table = df.sparkSession.createDataFrame([(float(s), float(a)) for s, a in points], "share double, alpha double")
    last = F.greatest(F.ceil(F.col("share") * (F.col("cut") + 1)) - 1, F.lit(0))
    spans = table.crossJoin(F.broadcast(split)).filter("cut >= 0 AND cut < end").select("share", "alpha", F.lit(0).cast("long").alias("first"), last.cast("long").alias("last"), (F.col("cut") + 1).alias("from"), F.col("end").alias("to"))
    fitted = Work(df.sparkSession).cut(solved(spans_of(prefix, spans, len(features)), len(features)), "models")
    out = figures(predicted(rows, fitted, ["share", "alpha"]), ["share", "alpha"])
    own = fitted.select("share", "alpha", F.col("n").cast("long").alias("n_train"), F.col("r2").alias("train_r2"))
    return own.join(out, ["share", "alpha"]).select("share", "alpha", "n_train", "train_r2", F.col("r2").alias("test_r2"), F.col("ic").alias("test_ic"), "n_test")
