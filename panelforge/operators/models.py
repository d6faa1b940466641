"""Models and their validation on (date, ticker, features…, ret), with pyspark.ml; regimes; governance of versions."""

from __future__ import annotations

import math
import statistics
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import last_rows, ratio
from ..functions.history import moving_rank
from ..functions.pooled import pooled_spearman
from ..functions.resamples import name_of, weighted_sums
from .walkforward import Ridge, curve, figures, ridge_folds

#: Fixed value: the Euler-Mascheroni constant.
EULER = 0.5772156649015329
SPANS = "fold int, date date, role string"
#: What a strategy's weight is multiplied by in each state.
STATE_MULTIPLIERS = {"risk_on": 1.2, "transition": 1.0, "risk_off": 0.6, "crisis": 0.2}


def temporal_split(df: DataFrame, share: float = 0.9) -> DataFrame:
    """df with role: train for the first share of complete rows by date, else test."""
    known = df.dropna()
    dates = known.groupBy("date").count()
    w = Window.orderBy("date")  # over dates, not rows
    before = dates.select("date", F.sum("count").over(w).alias("__upto"), F.sum("count").over(Window.partitionBy()).alias("__n"))
    j = known.join(F.broadcast(before), "date")
    return j.withColumn("role", F.when(F.col("__upto") <= F.floor(share * F.col("__n")), "train").otherwise("test")).drop("__upto", "__n")


def _vector(df: DataFrame, features: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(df)


def _fit(est, df: DataFrame, features: list[str], share: float) -> tuple[DataFrame, DataFrame]:
    split = _vector(temporal_split(df.select("date", "ticker", *features, "ret"), share), features)
    model = est.fit(split.filter("role = 'train'"))
    return model.transform(split), split


def _report(scored: DataFrame, name: str) -> DataFrame:
    """(model, role, r2, ic, n) from columns ret and prediction."""
    mse, var = F.avg((F.col("ret") - F.col("prediction")) ** 2), F.var_pop("ret")
    fit = scored.groupBy("role").agg((1 - ratio(mse, var)).alias("r2"))
    ic = pooled_spearman(scored, ["role"], "ret", "prediction").withColumnRenamed("corr", "ic")
    return fit.join(ic, "role").select(F.lit(name).alias("model"), "role", "r2", "ic", "n")


def gbt_alpha(df: DataFrame, features: list[str], trees: int = 200, depth: int = 5, seed: int = 42) -> DataFrame:
    from pyspark.ml.regression import GBTRegressor

    est = GBTRegressor(featuresCol="features", labelCol="ret", maxIter=trees, maxDepth=depth, stepSize=0.05, minInstancesPerNode=20, subsamplingRate=0.8, featureSubsetStrategy="0.7", seed=seed)
    return _report(_fit(est, df, features, 0.9)[0], "gbt")


def rf_alpha(df: DataFrame, features: list[str], trees: int = 100, depth: int = 5, seed: int = 42) -> DataFrame:
    """(role, accuracy, n) of the direction; the score of a row is its probability of a rise less one half."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import vector_to_array

    est = RandomForestClassifier(featuresCol="features", labelCol="up", numTrees=trees, maxDepth=depth, seed=seed)
    split = _vector(temporal_split(df.select("date", "ticker", *features, "ret")), features).withColumn("up", (F.col("ret") > 0).cast("double"))
    scored = est.fit(split.filter("role = 'train'")).transform(split).withColumn("score", vector_to_array("probability")[1] - 0.5)
    return scored.groupBy("role").agg(F.avg((F.col("prediction") == F.col("up")).cast("double")).alias("accuracy"), F.avg("score").alias("mean_score"), F.count("*").alias("n"))


def linear_alpha(df: DataFrame, features: list[str], kind: str = "ridge", alpha: float = 1.0, l1: float = 0.5) -> DataFrame:
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.regression import LinearRegression

    mix = {"ridge": 0.0, "lasso": 1.0, "elasticnet": l1}[kind]
    est = Pipeline(stages=[StandardScaler(inputCol="features", outputCol="scaled", withMean=True), LinearRegression(featuresCol="scaled", labelCol="ret", regParam=alpha, elasticNetParam=mix)])
    return _report(_fit(est, df, features, 0.9)[0], kind)


def baselines(train: DataFrame, reversion: int = 5, momentum: int = 20) -> DataFrame:
    """(ticker, zero, mean_reversion, momentum) from the last returns of train."""
    k = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date")))
    r = train.withColumn("k", k)
    mean = lambda n: F.avg(F.when(F.col("k") <= n, F.col("ret")))
    return r.groupBy("ticker").agg(F.lit(0.0).alias("zero"), (-mean(reversion)).alias("mean_reversion"), mean(momentum).alias("momentum"))


def _numbered(dates: DataFrame) -> DataFrame:
    """Distinct dates with their place. One row for each date, not each row of data."""
    return dates.select("date").distinct().withColumn("k", F.row_number().over(Window.orderBy("date")) - 1)


def walk_forward_splits(dates: DataFrame, train: int = 504, test: int = 63, step: int = 21) -> DataFrame:
    """(fold, date, role): train [0, t), test [t, t + test), t moving by step."""
    d = _numbered(dates)
    n = d.agg(F.count("*").alias("n"))
    starts = n.filter(F.col("n") >= train + test).select(F.posexplode(F.expr(f"sequence({train}, n - {test}, {step})")).alias("fold", "t"))
    j = d.join(F.broadcast(starts), F.col("k") < F.col("t") + test)
    return j.select("fold", "date", F.when(F.col("k") < F.col("t"), "train").otherwise("test").alias("role"))


def purged_kfold(dates: DataFrame, k: int = 5, embargo: int = 5) -> DataFrame:
    """(fold, date, role): contiguous tests; train without the test and the embargo after it."""
    d = _numbered(dates).withColumn("n", F.count("*").over(Window.partitionBy()))
    size = F.floor(F.col("n") / k)
    j = d.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    lo = F.col("fold") * size
    hi = F.when(F.col("fold") == k - 1, F.col("n")).otherwise(lo + size)
    role = F.when((F.col("k") >= lo) & (F.col("k") < hi), "test").when((F.col("k") >= hi) & (F.col("k") < hi + embargo), "embargo").otherwise("train")
    return j.select("fold", "date", role.alias("role"))


def combinatorial_purged_cv(dates: DataFrame, groups: int = 6, tests: int = 2, embargo: int = 5) -> DataFrame:
    """(fold, date, role) for every choice of test groups."""
    d = _numbered(dates).withColumn("n", F.count("*").over(Window.partitionBy()))
    size = F.floor(F.col("n") / groups)
    group = F.least(F.floor(F.col("k") / size), F.lit(groups - 1))
    place = F.col("k") - group * size
    folds = F.array(*[F.array(*[F.lit(x) for x in c]) for c in combinations(range(groups), tests)])
    j = d.withColumns({"g": group, "place": place}).select("*", F.posexplode(folds).alias("fold", "held"))
    role = F.when(F.array_contains("held", F.col("g")), "test").when(F.array_contains("held", F.col("g") - 1) & (F.col("place") < embargo), "embargo").otherwise("train")
    return j.select("fold", "date", role.alias("role"))


def _fold_scores(df: DataFrame, features: list[str], splits: DataFrame, make) -> DataFrame | None:
    """(fold, ret, prediction) of each fold's test rows; make gives an estimator, or is a Column that needs no fit."""
    data = _vector(df.dropna().select("date", "ticker", *features, "ret"), features)
    if isinstance(make, Column):
        held = splits.filter("role = 'test'")
        return data.join(F.broadcast(held), "date").select("fold", "ret", make.cast("double").alias("prediction"))
    folds = [r.fold for r in splits.select("fold").distinct().orderBy("fold").collect()]  # as many as fits
    scored = None
    for f in folds:
        j = data.join(F.broadcast(splits.filter(F.col("fold") == f)), "date")
        out = make().fit(j.filter("role = 'train'")).transform(j.filter("role = 'test'")).select("fold", "ret", "prediction")
        scored = out if scored is None else scored.unionByName(out)
    return scored


def fold_metrics(scored: DataFrame) -> DataFrame:
    """(fold, ic, r2): Spearman's correlation (0 where a side does not vary) and the share of variance explained."""
    known = scored.select("fold", F.col("ret").alias("y"), "prediction").dropna()
    return figures(known, ["fold"]).select("fold", "ic", "r2")


def _summary(folds: DataFrame, names: DataFrame) -> DataFrame:
    """(model, n_folds, ic_mean, ic_std, t_stat, r2_mean, significant) of (model, fold, ic, r2): the mean and t count folds
    alike; a model without folds has zeros."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    t = zero(ratio(F.avg("ic"), F.stddev_samp("ic")) * F.sqrt(F.count("ic")))
    a = names.join(folds, "model", "left").groupBy("model").agg(F.count("ic").alias("n_folds"), zero(F.avg("ic")).alias("ic_mean"), zero(F.stddev_samp("ic")).alias("ic_std"), t.alias("t_stat"), zero(F.avg("r2")).alias("r2_mean"))
    return a.withColumn("significant", (F.col("ic_mean") > 0.03) & (F.col("t_stat") > 2))


def _walked(df: DataFrame, features: list[str], makers: dict, train: int, test: int, step: int) -> DataFrame:
    """(model, fold, ic, r2) of named models: all ridge regressions from one pass of sums, columns of features without a
    fit, and estimators with one for each fold."""
    ridges = {n: m.alpha for n, m in makers.items() if isinstance(m, Ridge)}
    parts = [ridge_folds(df, features, ridges, train, test, step).select("model", "fold", "ic", "r2")] if ridges else []
    splits = walk_forward_splits(df.dropna(), train, test, step)
    for n, m in makers.items():
        scored = None if isinstance(m, Ridge) else _fold_scores(df, features, splits, m)
        if scored is not None:
            parts.append(fold_metrics(scored).select(F.lit(n).alias("model"), F.col("fold").cast("int").alias("fold"), "ic", "r2"))
    if not parts:
        return df.sparkSession.createDataFrame([], "model string, fold int, ic double, r2 double")
    return reduce(DataFrame.unionByName, parts)


def walk_forward_eval(df: DataFrame, features: list[str], make=None, train: int = 504, test: int = 63, step: int = 21) -> DataFrame:
    """(n_folds, ic_mean, ic_std, t_stat, r2_mean, significant) of a model over an expanding walk forward: a Ridge (the
    default), a column of features, or something that makes an estimator for each fold. Without folds one row of zeros."""
    names = df.sparkSession.createDataFrame([("model",)], "model string")
    return _summary(_walked(df, features, {"model": Ridge() if make is None else make}, train, test, step), names).drop("model")


def model_comparison(df: DataFrame, features: list[str], makers: dict, baselines: dict[str, Column] | None = None, train: int = 200, test: int = 63, step: int = 21) -> DataFrame:
    """walk_forward_eval by model, with the models' plain scores beside them (baselines: columns of features that need no
    fit), with dsr, the chance that the mean IC is above what the best of as many tries has by luck, and
    beats_all_baselines."""
    every = {**makers, **(baselines or {})}
    names = df.sparkSession.createDataFrame([(n, n not in makers) for n in every], "model string, is_baseline boolean")
    both = _summary(_walked(df, features, every, train, test, step), names.select("model")).join(names, "model")
    trials, normal = len(every), statistics.NormalDist()
    luck = (1 - EULER) * normal.inv_cdf(1 - 1 / trials) + EULER * normal.inv_cdf(1 - 1 / (trials * math.e)) if trials > 1 else 0.0

    @F.pandas_udf("double")
    def phi(z: pd.Series) -> pd.Series:
        own = statistics.NormalDist()
        return z.map(lambda v: own.cdf(v) if v == v else 0.0)

    # (mean - luck * se) / se
    z = F.when((F.col("n_folds") >= 2) & (F.col("ic_std") > 0), F.col("ic_mean") / F.col("ic_std") * F.sqrt("n_folds") - luck)
    best = F.coalesce(F.max(F.when(F.col("is_baseline"), F.col("ic_mean"))).over(Window.partitionBy()), F.lit(0.0))  # a row for each model
    return both.withColumn("dsr", F.when(z.isNull(), 0.0).otherwise(phi(F.coalesce(z, F.lit(0.0))))).withColumn("beats_all_baselines", ~F.col("is_baseline") & (F.col("ic_mean") > best))


def train_test_gap(scores: DataFrame, most: float = 0.15) -> DataFrame:
    """(model, train, test) with gap, ratio and overfit."""
    gap = F.col("train") - F.col("test")
    return scores.select("*", gap.alias("gap"), ratio("test", "train").alias("ratio"), (gap > most).alias("overfit"))


def learning_curve(df: DataFrame, features: list[str], shares: tuple[float, ...] = (0.2, 0.4, 0.6, 0.8, 1.0), model: Ridge = Ridge()) -> DataFrame:
    """(share, n_train, train_r2, test_r2, test_ic, n_test): fitted on the first shares of the training dates, tested on
    the last tenth of the rows."""
    return curve(df, features, [(s, model.alpha) for s in shares]).drop("alpha")


def complexity_curve(df: DataFrame, features: list[str], strengths: tuple[float, ...] = (0.01, 0.1, 1.0)) -> DataFrame:
    """(strength, n_train, train_r2, test_r2, test_ic, n_test) over one hyper-parameter of ridge regression."""
    return curve(df, features, [(1.0, s) for s in strengths]).drop("share").withColumnRenamed("alpha", "strength")


def overfit_probability(ics: DataFrame, b: int = 1000, seed: int = 13) -> DataFrame:
    """(signal, p): the share of bootstrap means at or below zero."""
    sums = weighted_sums(ics, ["signal"], "ic", name_of(seed, "signal", "date"), b)
    return sums.groupBy("signal").agg(F.avg((F.col("s") <= 0).cast("double")).alias("p"))


def perturbed(df: DataFrame, columns: list[str], kind: str = "noise", size: float = 0.1, seed: int = 21) -> DataFrame:
    """df with seeded gaussian noise in units of each column's deviation: noise, label (the sign of ret turned with
    probability size), lookahead (ret leaks into the columns) or drift (noise growing with the date)."""
    sd = df.agg(*[F.stddev_samp(c).alias(f"__{c}") for c in columns])  # one row
    j = df.join(F.broadcast(sd))
    place = F.percent_rank().over(Window.partitionBy("ticker").orderBy("date"))
    grow = place if kind == "drift" else F.lit(1.0)
    if kind == "label":
        out = {"ret": F.when(F.rand(seed) < size, -F.col("ret")).otherwise(F.col("ret"))}
    elif kind == "lookahead":
        out = {c: F.col(c) + size * F.col("ret") for c in columns}
    else:
        out = {c: F.col(c) + F.randn(seed + i) * F.col(f"__{c}") * size * grow for i, c in enumerate(columns)}
    return j.withColumns(out).drop(*[f"__{c}" for c in columns])


def regime_clusters(returns: DataFrame, k: int = 2, window: int = 20, seed: int = 42) -> DataFrame:
    """(date, ret, vol, label, p0, p1, …): k-means on the standardised return and rolling deviation of one series, and
    how near each row is to the k centres: the softmax of the squared distances, in units of twice the largest. The
    labels' transition_matrix is the other half of such a model."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    w = Window.orderBy("date")  # one series
    r = returns.withColumn("vol", F.stddev_samp("ret").over(last_rows(w, window))).dropna()
    stages = [VectorAssembler(inputCols=["ret", "vol"], outputCol="v"), StandardScaler(inputCol="v", outputCol="s", withMean=True), KMeans(featuresCol="s", predictionCol="label", k=k, maxIter=100, tol=1e-4, seed=seed)]
    model = Pipeline(stages=stages).fit(r)
    at = vector_to_array("s")
    far = F.array(*[sum(((at[i] - float(x)) ** 2 for i, x in enumerate(c)), F.lit(0.0)) for c in model.stages[-1].clusterCenters()])
    near = F.transform("__far", lambda d: F.exp(-d / (2 * F.array_max("__far") + 1e-10)))
    total = F.aggregate("__near", F.lit(0.0), lambda a, x: a + x)
    out = model.transform(r).withColumn("__far", far).withColumn("__near", near)
    return out.select("date", "ret", "vol", "label", *[(F.col("__near")[i] / total).alias(f"p{i}") for i in range(k)])


def transition_matrix(labels: DataFrame, key: str = "series") -> DataFrame:
    """(from, to, n, p): how often a label follows another."""
    moved = labels.withColumn("next", F.lead("label").over(Window.partitionBy(key).orderBy("date"))).filter("next IS NOT NULL")
    n = moved.groupBy(F.col("label").alias("from_label"), F.col("next").alias("to_label")).agg(F.count("*").alias("n"))
    return n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("from_label")))


def vol_regime(returns: DataFrame, w: int = 20, look: int = 252, low: float = 25.0, high: float = 75.0, key: str = "ticker") -> DataFrame:
    """(…, vol, percentile, regime): the rolling deviation against its own last values."""
    order = Window.partitionBy(key).orderBy("date")
    n = F.row_number().over(order)
    v = returns.withColumn("vol", F.when(n >= w, F.round(F.stddev_samp("ret").over(last_rows(order, w)), 12))).filter("vol IS NOT NULL")
    p = moving_rank(v, "vol", [key], ["date"], look).withColumn("percentile", F.col("below") / F.col("held") * 100).drop("below", "held")
    return p.withColumn("regime", F.when(F.col("percentile") <= low, "low").when(F.col("percentile") >= high, "high").otherwise("normal"))


def market_state(returns: DataFrame, labels: DataFrame | None = None, macro: DataFrame | None = None, key: str = "ticker", crisis_percentile: float = 95.0, crisis_return: float = -0.10) -> DataFrame:
    """(…, vol, percentile, regime, state, multiplier) of returns (key, date, ret): crisis, risk_off, risk_on or transition.

    labels (date, label): a second regime, such as that of regime_clusters; high volatility in label 0, or without one, is
    a transition, else risk_off. macro (date, regime): in normal volatility stagflation and deflation are risk_off and
    goldilocks is risk_on. A crisis is volatility at the crisis percentile with the last 20 returns summing to less than
    crisis_return. Until 20 returns are known the state is transition."""
    vol = vol_regime(returns, key=key).select(key, "date", "vol", "percentile", "regime")
    s = F.sum("ret").over(last_rows(Window.partitionBy(key).orderBy("date"), 20))
    rows = returns.withColumn("__s", s).join(vol, [key, "date"], "left")
    rows = rows.join(labels.select("date", F.col("label").alias("__label")), "date", "left") if labels is not None else rows.withColumn("__label", F.lit(None).cast("int"))
    rows = rows.join(macro.select("date", F.col("regime").alias("__macro")), "date", "left") if macro is not None else rows.withColumn("__macro", F.lit(None).cast("string"))
    high = F.when(F.coalesce("__label", F.lit(0)) == 0, "transition").otherwise("risk_off")
    normal = F.when(F.col("__macro").isin("stagflation", "deflation"), "risk_off").when(F.col("__macro") == "goldilocks", "risk_on").otherwise("transition")
    crisis = (F.col("percentile") >= crisis_percentile) & (F.col("__s") < crisis_return)
    state = F.when(F.col("regime").isNull(), "transition").when(crisis, "crisis").when(F.col("regime") == "high", high).when(F.col("regime") == "low", "risk_on").otherwise(normal)
    times = F.create_map(*[F.lit(x) for pair in STATE_MULTIPLIERS.items() for x in pair])
    return rows.withColumn("state", state).withColumn("multiplier", times[F.col("state")]).select(key, "date", *[c for c in returns.columns if c not in (key, "date")], "vol", "percentile", "regime", "state", "multiplier")


def feature_compression(df: DataFrame, features: list[str], d: int = 16) -> DataFrame:
    """(n, d, explained, error): standardised, projected on d principal components and back; error is the mean square of
    what a feature of a row loses on the way."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import vector_to_array

    v = _vector(df.dropna(subset=features), features)
    model = Pipeline(stages=[StandardScaler(inputCol="features", outputCol="s", withMean=True), PCA(k=d, inputCol="s", outputCol="p")]).fit(v)
    share = float(sum(model.stages[1].explainedVariance))
    axes = model.stages[1].pc.toArray()  # features x d
    lost = np.eye(len(features)) - axes @ axes.T  # what projecting and coming back loses
    at = vector_to_array("s")
    left = [sum((float(x) * at[i] for i, x in enumerate(row)), F.lit(0.0)) for row in lost]
    error = F.avg(sum((e * e for e in left), F.lit(0.0)) / len(features))
    return model.transform(v).agg(F.count("*").alias("n"), error.alias("error")).select("n", F.lit(d).alias("d"), F.lit(share).alias("explained"), "error")


def embeddings_as_of(store: DataFrame, model: str, as_of: str, tickers: list[str] | None = None) -> DataFrame:
    """The model's newest snapshot before as_of."""
    rows = store.filter((F.col("model_id") == model) & (F.col("date") < F.lit(as_of).cast("date")))
    newest = rows.agg(F.max("date").alias("__d"))  # one row
    rows = rows.join(F.broadcast(newest), F.col("date") == F.col("__d")).drop("__d")
    return rows.filter(F.col("ticker").isin(tickers)) if tickers else rows


def champion_challenger(metrics: DataFrame, champion: str | None, challenger: str, metric: str, least: float = 0.0) -> DataFrame:
    """(metric, champion, challenger, diff, promote) of rows (version, metric, value)."""
    side = lambda v: F.max(F.when(F.col("version") == v, F.col("value")))
    t = metrics.groupBy("metric").agg(side(champion).alias("champion"), side(challenger).alias("challenger")).withColumn("diff", F.col("challenger") - F.col("champion"))
    return t.withColumn("promote", F.when(F.col("metric") == metric, F.col("champion").isNull() | (F.col("diff") >= least)))


def promotion_gate(candidates: DataFrame, incumbents: DataFrame) -> DataFrame:
    """(model, promote, reason) of (model, sharpe, drawdown, windows) against incumbents (model, sharpe): the first rule
    that fails."""
    j = candidates.join(incumbents.select("model", F.col("sharpe").alias("now")), "model", "left")
    good = F.size(F.filter("windows", lambda x: x > 0)) / F.greatest(F.size("windows"), F.lit(1))
    gain = ratio(F.col("sharpe") - F.col("now"), F.abs("now"))
    reason = F.when(F.col("sharpe") < 0.5, "sharpe").when(F.col("drawdown") < -0.15, "drawdown").when(F.col("now").isNotNull() & (gain < 0.02), "no_improvement").when(good < 0.6, "walk_forward").otherwise("ok")
    return j.select("model", (reason == "ok").alias("promote"), reason.alias("reason"))


def retained_versions(versions: DataFrame, keep: int = 20) -> DataFrame:
    """(model, version, kept, resolved) of (model, version, created_at, champion): the newest and the champion stay;
    resolved is the champion, else the newest."""
    w = Window.partitionBy("model")
    k = F.row_number().over(w.orderBy(F.desc("created_at"), F.desc("version")))
    has = F.max(F.col("champion").cast("int")).over(w) == 1
    v = versions.withColumns({"__k": k, "__has": has})
    return v.select("model", "version", ((F.col("__k") <= keep) | F.col("champion")).alias("kept"), F.when(F.col("__has"), F.col("champion")).otherwise(F.col("__k") == 1).alias("resolved"))
