"""Normalising long features (date, ticker, feature, value), choosing features, and drift of their importance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import average_rank, last_rows, ratio, safe_corr
from ..functions.history import history_rank
from ..functions.pooled import pooled_ranks, pooled_spearman

CROSS = ("date", "feature")
SERIES = ("ticker", "feature")


def zscore_cs(df: DataFrame, sigma: float = 3.0, keys: tuple[str, ...] = CROSS) -> DataFrame:
    """Clipped to mean ± sigma deviations, then standardised by the clipped values' own mean and deviation; 0 with fewer
    than two or without spread; nulls stay."""
    x = Window.partitionBy(*keys)
    v, m, s = F.col("value"), F.avg("value").over(x), F.stddev_samp("value").over(x)
    low = df.withColumns({"__m": m, "__s": s})
    clipped = low.withColumn("__c", F.when(F.col("__s") > 0, F.greatest(F.least(v, F.col("__m") + sigma * F.col("__s")), F.col("__m") - sigma * F.col("__s"))).otherwise(v))
    c, cm, cs = F.col("__c"), F.avg("__c").over(x), F.stddev_samp("__c").over(x)
    z = F.when(v.isNotNull(), F.when((F.col("__s") > 0) & (cs > 0), (c - cm) / cs).otherwise(0.0))
    return clipped.withColumn("z", z).drop("__m", "__s", "__c")


def _ranked(df: DataFrame, keys: tuple[str, ...]) -> tuple[DataFrame, Column, Column]:
    """The known values with their average rank and number."""
    x = Window.partitionBy(*keys)
    known = df.filter("value IS NOT NULL")
    return known, average_rank("value", x), F.count("*").over(x)


def rank_cs(df: DataFrame, keys: tuple[str, ...] = CROSS) -> DataFrame:
    """Average ranks stretched over -1 .. 1; 0 for a lone value."""
    known, rank, n = _ranked(df, keys)
    return known.withColumn("rank", F.when(n >= 2, 2 * (rank - 1) / F.greatest(n - 1, F.lit(1)) - 1).otherwise(0.0))


def percentile_cs(df: DataFrame, keys: tuple[str, ...] = CROSS) -> DataFrame:
    known, rank, n = _ranked(df, keys)
    return known.withColumn("percentile", rank / n)


def normalise_matrix(df: DataFrame, method: str = "zscore") -> DataFrame:
    """One method over every feature: the long form needs no loop."""
    f, c = {"zscore": (zscore_cs, "z"), "rank": (rank_cs, "rank"), "percentile": (percentile_cs, "percentile")}[method]
    return f(df).withColumn("value", F.col(c)).drop(c)


def _expanding(keys: tuple[str, ...]):
    return Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)


def zscore_temporal(df: DataFrame, least: int = 60, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """Against the mean and deviation of all rows so far; null below least known values or without spread."""
    w = _expanding(keys)
    sd = F.stddev_samp("value").over(w)
    z = F.when((F.count("value").over(w) >= least) & (sd > 0), (F.col("value") - F.avg("value").over(w)) / sd)
    return df.withColumn("z", z)


def percentile_temporal(df: DataFrame, least: int = 60, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """The share of the history so far below the value, from least known values on; null for an unknown value. Earlier
    values are counted by blocks and ranges, so a series may be of any length."""
    ranks = history_rank(df, "value", list(keys), ["date"]).withColumn("percentile", F.when(F.col("held") >= least, F.col("below") / F.col("held")))
    unknown = df.filter(F.col("value").isNull() | F.isnan("value")).withColumn("percentile", F.lit(None).cast("double"))
    return ranks.select(*df.columns, "percentile").union(unknown.select(*df.columns, "percentile"))


def mutual_information(df: DataFrame) -> DataFrame:
    """(feature, mi): in nats, of (feature, value, target) in equal-width bins; 0 below 20 rows. Bins by the number of
    rows, so the joint counts stay few."""
    s = df.groupBy("feature").agg(F.count("*").alias("n"), F.min("value").alias("a"), F.max("value").alias("b"), F.min("target").alias("c"), F.max("target").alias("d"))
    s = s.withColumn("k", F.least(F.lit(20), F.greatest(F.lit(5), F.floor(F.col("n") / 20))))
    bin_ = lambda v, lo, hi: F.coalesce(F.floor(ratio((F.col(v) - F.col(lo)) * (F.col("k") - 1), F.col(hi) - F.col(lo))) + 1, F.lit(1))
    cells = df.join(s, "feature").select("feature", "n", bin_("value", "a", "b").alias("x"), bin_("target", "c", "d").alias("y")).groupBy("feature", "n", "x", "y").agg(F.count("*").alias("m"))
    px, py = (F.sum("m").over(Window.partitionBy("feature", c)) for c in "xy")
    term = cells.withColumns({"px": px, "py": py}).withColumn("t", F.col("m") / F.col("n") * F.ln(F.col("m") * F.col("n") / (F.col("px") * F.col("py"))))
    return term.groupBy("feature").agg(F.when(F.first("n") < 20, 0.0).otherwise(F.sum("t")).alias("mi"))


def spearman_importance(df: DataFrame) -> DataFrame:
    """(feature, importance): |Spearman| of value and target, over all rows."""
    return pooled_spearman(df, ["feature"], "value", "target").select("feature", F.abs("corr").alias("importance"))


def feature_correlations(df: DataFrame) -> DataFrame:
    """(f1, f2, corr): |Spearman| of each pair of features over their common (date, ticker) rows."""
    known = df.filter("value IS NOT NULL").select("date", "ticker", "feature", "value")
    r = pooled_ranks(known, ["feature"], "value").withColumnRenamed("rank_value", "r")
    a, b = r.alias("a"), r.alias("b")
    j = a.join(b, (F.col("a.date") == F.col("b.date")) & (F.col("a.ticker") == F.col("b.ticker")) & (F.col("a.feature") < F.col("b.feature")))
    return j.groupBy(F.col("a.feature").alias("f1"), F.col("b.feature").alias("f2")).agg(F.abs(safe_corr(F.col("a.r"), F.col("b.r"))).alias("corr"))


def select_features(importance: DataFrame, correlations: DataFrame, max_features: int = 20, most_corr: float = 0.85, least: float = 0.0) -> DataFrame:
    """(feature, importance, kept, reason): the best first, without those too close to one kept. The two tables are of
    the features' number, not the rows'; the greedy pass over them runs on the driver."""
    spark = importance.sparkSession
    ranked = importance.orderBy(F.desc("importance"), "feature").collect()
    close = {(r.f1, r.f2) for r in correlations.filter(F.col("corr") > most_corr).collect()}
    kept: list[str] = []
    out = []
    for r in ranked:
        rival = next((k for k in kept if (k, r.feature) in close or (r.feature, k) in close), None)
        reason = "below_min" if (r.importance or 0.0) < least else "max_features" if len(kept) >= max_features else f"correlated_with:{rival}" if rival else "kept"
        if reason == "kept":
            kept.append(r.feature)
        out.append((r.feature, r.importance, reason == "kept", reason))
    return spark.createDataFrame(out, "feature string, importance double, kept boolean, reason string")


def rolling_importance(log: DataFrame, w: int = 10) -> DataFrame:
    return log.withColumn("rolling", F.avg("importance").over(last_rows(Window.partitionBy("model", "feature").orderBy("step"), w)))


def top_features(log: DataFrame, k: int = 5, n: int = 10) -> DataFrame:
    """The n features of the highest mean over the model's last k records."""
    recent = log.withColumn("__r", F.dense_rank().over(Window.partitionBy("model").orderBy(F.desc("step")))).filter(F.col("__r") <= k)
    mean = recent.groupBy("model", "feature").agg(F.avg("importance").alias("mean"))
    rank = F.row_number().over(Window.partitionBy("model").orderBy(F.desc("mean"), "feature"))
    return mean.withColumn("rank", rank).filter(F.col("rank") <= n)


def importance_drift(log: DataFrame, window: int = 5, threshold: float = 0.3) -> DataFrame:
    """(model, stability, drifted): Spearman of the features' mean importance in the last records and those before;
    stable with fewer than two windows."""
    r = log.withColumn("__r", F.dense_rank().over(Window.partitionBy("model").orderBy(F.desc("step")))).filter(F.col("__r") <= 2 * window)
    new, old = (F.avg(F.when(F.col("__r").between(a, b), F.col("importance"))) for a, b in ((1, window), (window + 1, 2 * window)))
    mean = r.groupBy("model", "feature").agg(new.alias("new"), old.alias("old"), F.max("__r").alias("steps"))
    x = Window.partitionBy("model")
    ranks = mean.select("model", "steps", average_rank("new", x).alias("a"), average_rank("old", x).alias("b"))
    out = ranks.groupBy("model").agg(safe_corr(F.col("a"), F.col("b")).alias("c"), F.max("steps").alias("steps"))
    stable = F.when(F.col("steps") < 2 * window, 1.0).otherwise(F.coalesce("c", F.lit(0.0)))
    return out.select("model", stable.alias("stability"), (stable < 1 - threshold).alias("drifted"))
