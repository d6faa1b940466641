"""Signals (date, ticker, signal, score) against returns (date, ticker, ret): evaluation, combination, decay."""

from __future__ import annotations

import random
import statistics

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import average_rank, by_ticker, last_rows, ratio, safe_corr
from ..functions.pooled import pooled_ranks, pooled_spearman
from ..functions.resamples import name_of, weighted_sums

YEAR = 252


def daily_ic(signals: DataFrame, returns: DataFrame, least: int = 5, keys: tuple[str, ...] = ("signal",)) -> DataFrame:
    """(signal, date, ic, n): Spearman of score and return across the date's tickers."""
    x = Window.partitionBy(*keys, "date")
    j = signals.join(returns, ["date", "ticker"]).filter("score IS NOT NULL AND ret IS NOT NULL")
    r = j.select(*keys, "date", average_rank("score", x).alias("a"), average_rank("ret", x).alias("b"))
    out = r.groupBy(*keys, "date").agg(safe_corr(F.col("a"), F.col("b")).alias("ic"), F.count("*").alias("n"))
    return out.filter((F.col("n") >= least) & F.col("ic").isNotNull())


def signal_turnover(signals: DataFrame) -> DataFrame:
    """(signal, turnover): mean over dates of the mean |change| of the names held on the date and on the one before."""
    dates = signals.select("signal", "date").distinct().withColumn("k", F.row_number().over(Window.partitionBy("signal").orderBy("date")))
    s = signals.join(dates, ["signal", "date"])
    w = Window.partitionBy("signal", "ticker").orderBy("k")
    moved = s.withColumns({"__k": F.lag("k").over(w), "__s": F.lag("score").over(w)}).filter("__k = k - 1")
    daily = moved.groupBy("signal", "date").agg(F.avg(F.abs(F.col("score") - F.col("__s"))).alias("m"))
    return daily.groupBy("signal").agg(F.avg("m").alias("turnover"))


def crowding(signal: DataFrame, existing: DataFrame, least: int = 10) -> DataFrame:
    """(crowding): the largest |Spearman|, pooled, with an existing signal; more than least common rows."""
    j = signal.select("date", "ticker", "score").join(existing.select("date", "ticker", F.col("signal").alias("other"), F.col("score").alias("theirs")), ["date", "ticker"])
    each = pooled_spearman(j, ["other"], "score", "theirs").select(F.abs("corr").alias("c"), "n").filter(F.col("n") > least)
    return each.agg(F.coalesce(F.max("c"), F.lit(0.0)).alias("crowding"))


def score_signals(ics: DataFrame, turnover: DataFrame, least_days: int = YEAR, crowd: float = 0.0, least_ic: float = 0.03, least_t: float = 2.0) -> DataFrame:
    """(signal, n, ic_mean, ic_std, t_stat, turnover, composite, passed)."""
    a = ics.groupBy("signal").agg(F.count("*").alias("n"), F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_std"))
    j = a.join(turnover, "signal", "left").withColumn("turnover", F.coalesce("turnover", F.lit(0.0)))
    t = F.coalesce(ratio("ic_mean", "ic_std") * F.sqrt("n"), F.lit(0.0))
    known = j.withColumn("t_stat", t)
    composite = 0.4 * F.col("ic_mean") + 0.3 * F.col("t_stat") / 10 + 0.2 / (1 + F.col("ic_std")) - 0.05 * F.col("turnover") - 0.1 * crowd
    short = F.col("n") < least_days
    return known.withColumns({"composite": F.when(short, -999.0).otherwise(composite), "passed": ~short & (F.col("ic_mean") >= least_ic) & (F.col("t_stat") >= least_t)})


def rank_signals(scored: DataFrame) -> DataFrame:
    """By composite, the best first. The table has a row for each signal."""
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("composite"), "signal")))


def benjamini_hochberg(p: DataFrame, fdr: float = 0.1, family: tuple[str, ...] = ()) -> DataFrame:
    """Step-up rejection of (id, p) within each family."""
    w = Window.partitionBy(*family)
    ranked = p.withColumns({"__k": F.row_number().over(w.orderBy("p", "id")), "__m": F.count("*").over(w)})
    last = F.max(F.when(F.col("p") <= F.col("__k") / F.col("__m") * fdr, F.col("__k"))).over(w)
    return ranked.withColumn("rejected", F.coalesce(F.col("__k") <= last, F.lit(False))).drop("__k", "__m")


def bonferroni(p: DataFrame, alpha: float = 0.05, family: tuple[str, ...] = ()) -> DataFrame:
    return p.withColumn("rejected", F.col("p") < alpha / F.count("*").over(Window.partitionBy(*family)))


def t_pvalue(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t, by numerical integration over the density's tail in steps of the angle."""
    # with t = sqrt(df) tan(a), P(|T| > t) is the share of cos(a)^(df-1) beyond a: Simpson's rule over 400 steps
    a0 = F.atan(F.abs(t) / F.sqrt(df))
    half = F.lit(3.141592653589793 / 2)

    def area(lo: Column) -> Column:
        h = (half - lo) / 400
        f = lambda i: F.pow(F.greatest(F.cos(lo + h * i), F.lit(0.0)), df - 1) * F.when((i == 0) | (i == 400), 1).when(i % 2 == 1, 4).otherwise(2)
        return F.aggregate(F.sequence(F.lit(0), F.lit(400)), F.lit(0.0), lambda s, i: s + f(i)) * h / 3

    return F.when(df >= 1, area(a0) / area(F.lit(0.0)))


def score_signals_fdr(scored: DataFrame, fdr: float = 0.1) -> DataFrame:
    """score_signals with p and the step-up rule deciding what passes."""
    p = scored.withColumn("p", t_pvalue(F.col("t_stat"), (F.col("n") - 1).cast("double"))).withColumn("id", F.col("signal"))
    return benjamini_hochberg(p, fdr).withColumn("passed", F.col("rejected")).drop("id", "rejected")


def bootstrap_ic_ci(ics: DataFrame, b: int = 1000, level: float = 0.95, seed: int = 7) -> DataFrame:
    """(signal, low, high): percentiles of the means of b resamples of the dates, each date drawn with Poisson(1) weights
    that follow from its name; (0, 0) below ten dates."""
    means = weighted_sums(ics, ["signal"], "ic", name_of(seed, "signal", "date"), b).withColumn("m", ratio("s", "w"))
    tail = (1 - level) / 2
    return means.groupBy("signal").agg(F.when(F.max("n") < 10, 0.0).otherwise(F.percentile("m", tail)).alias("low"), F.when(F.max("n") < 10, 0.0).otherwise(F.percentile("m", 1 - tail)).alias("high"))


def combine_signals(signals: DataFrame, weights: dict[str, float] | None = None, names: list[str] | None = None) -> DataFrame:
    """(date, ticker, score): weighted mean over signals, those missing counting zero; equal weights by default."""
    weights = weights or dict.fromkeys(names or [], 1.0)
    total = sum(weights.values())
    w = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])[F.col("signal")]
    return signals.filter(F.col("signal").isin(list(weights))).groupBy("date", "ticker").agg((F.sum(w * F.col("score")) / (total or 1.0)).alias("score"))


def evaluate_signals_batch(signals: DataFrame, returns: DataFrame, least_names: int = 3) -> DataFrame:
    """Per signal: IC mean, std, t, IR, share of positive ICs, rank turnover, an estimate of Sharpe, periods, status."""
    ics = daily_ic(signals, returns, least_names)
    a = ics.groupBy("signal").agg(F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_std"), F.avg((F.round("ic", 9) > 0).cast("double")).alias("hit_rate"), F.count("*").alias("n_periods"))
    x = Window.partitionBy("signal", "date")
    ranks = signals.select("signal", "ticker", "date", average_rank("score", x).alias("r"), F.count("*").over(x).alias("n"))
    w = Window.partitionBy("signal", "ticker").orderBy("date")
    turn = ranks.withColumn("d", F.abs(F.col("r") - F.lag("r").over(w)) / F.col("n")).groupBy("signal").agg(F.avg("d").alias("turnover"))
    ir = F.coalesce(ratio("ic_mean", "ic_std"), F.lit(0.0))
    out = signals.select("signal").distinct().join(a, "signal", "left").join(turn, "signal", "left")
    return out.withColumns({"ir": ir, "t_stat": ir * F.sqrt("n_periods"), "sharpe": F.col("ic_mean") * (YEAR**0.5) * 2, "status": F.when(F.col("n_periods") > 0, "completed").otherwise("failed")})


def filter_significant(evaluated: DataFrame, least_t: float = 1.5) -> DataFrame:
    return evaluated.filter((F.col("t_stat") >= least_t) & (F.col("status") == "completed"))


def alpha_performance(signals: DataFrame, returns: DataFrame, window: int = 60) -> DataFrame:
    """(signal, date, ic, pnl, cum_pnl, rolling_ic, n): pnl of the score scaled to gross one."""
    x = Window.partitionBy("signal", "date")
    j = signals.join(returns, ["date", "ticker"])
    pnl = j.withColumn("__w", ratio("score", F.sum(F.abs("score")).over(x))).groupBy("signal", "date").agg(F.coalesce(F.sum(F.col("__w") * F.col("ret")), F.lit(0.0)).alias("pnl"))
    d = daily_ic(signals, returns).select("signal", "date", "ic").join(pnl, ["signal", "date"])
    w = Window.partitionBy("signal").orderBy("date")
    return d.withColumns({"cum_pnl": F.sum("pnl").over(w.rowsBetween(Window.unboundedPreceding, 0)), "rolling_ic": F.avg("ic").over(last_rows(w, window)), "n": F.row_number().over(w)})


def alpha_summary(performance: DataFrame) -> DataFrame:
    """(signal, ic_mean, ir, total_pnl, n) of alpha_performance."""
    a = performance.groupBy("signal").agg(F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("s"), F.sum("pnl").alias("total_pnl"), F.count("*").alias("n"))
    return a.select("signal", "ic_mean", F.coalesce(ratio("ic_mean", "s") * (YEAR**0.5), F.lit(0.0)).alias("ir"), "total_pnl", "n")


def ic_alerts(ics: DataFrame, short: int = 20, long: int = 60, floor: float = 0.0, least_t: float = 1.5) -> DataFrame:
    """(signal, date, level, value): WARNING for a low short mean, CRITICAL for a low t over the long window."""
    w = Window.partitionBy("signal").orderBy("date")
    n, m, ml, sl = F.row_number().over(w), F.avg("ic").over(last_rows(w, short)), F.avg("ic").over(last_rows(w, long)), F.stddev_samp("ic").over(last_rows(w, long))
    t = F.when(sl > 0, ml / sl * long**0.5).otherwise(0.0)
    rows = ics.withColumns({"__m": F.when(n >= short, m), "__t": F.when(n >= long, t)})
    alerts = F.array_compact(F.array(
        F.when(F.col("__m") < floor, F.struct(F.lit("WARNING").alias("level"), F.col("__m").alias("value"))),
        F.when(F.col("__t") < least_t, F.struct(F.lit("CRITICAL").alias("level"), F.col("__t").alias("value"))),
    ))
    return rows.select("signal", "date", F.explode(alerts).alias("a")).select("signal", "date", "a.*")


def ic_half_life(ics: DataFrame, window: int = 120, least: int = 60) -> DataFrame:
    """(signal, n, phi, half_life, peak, current, action): AR(1) over the last ICs; no half-life outside 0 < phi < 1."""
    w = Window.partitionBy("signal").orderBy(F.desc("date"))
    last = ics.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= window)
    pairs = last.withColumn("before", F.lead("ic").over(w))
    x, y = F.when(F.col("before").isNotNull(), F.col("before")), F.when(F.col("before").isNotNull(), F.col("ic"))
    a = pairs.groupBy("signal").agg(F.count("*").alias("n"), F.covar_pop(x, y).alias("c"), F.var_pop(x).alias("v"), F.avg(F.when(F.col("__k") <= 20, F.col("ic"))).alias("current"))
    phi = F.when((F.col("n") >= 10) & (F.col("v") >= 1e-10), ratio("c", "v"))
    roll = F.avg("ic").over(last_rows(Window.partitionBy("signal").orderBy("date"), 20))
    peak = ics.withColumn("m", roll).groupBy("signal").agg(F.max("m").alias("peak"), F.count("*").alias("total"))
    half = F.when((F.col("phi") > 0) & (F.col("phi") < 1), -0.6931471805599453 / F.ln("phi"))
    out = a.withColumn("phi", phi).withColumn("half_life", half).join(peak, "signal")
    act = F.when(F.col("total") < least, "INSUFFICIENT").when(F.col("half_life") < 10, "RETIRE").when(F.col("half_life") < 20, "REVIEW").otherwise("KEEP")
    return out.select("signal", "n", "phi", "half_life", "peak", "current", act.alias("action"))


def linear_combos(features: DataFrame, names: list[str], n: int = 50, seed: int = 3) -> DataFrame:
    """(date, ticker, candidate, value): n random sums of two to five features, unknown values zero. The coefficients
    are a table of at most 5 n rows."""
    r = random.Random(seed)
    rows = [(f"combo_{i}", f, r.gauss(0, 1)) for i in range(n) for f in r.sample(names, min(len(names), r.randint(2, 5)))]
    table = F.broadcast(features.sparkSession.createDataFrame(rows, "candidate string, feature string, coef double"))
    return features.join(table, "feature").groupBy("date", "ticker", "candidate").agg(F.sum(F.col("coef") * F.coalesce("value", F.lit(0.0))).alias("value"))


def ratio_candidates(features: DataFrame, least: float = 1e-8) -> DataFrame:
    """(date, ticker, candidate, value): each feature over each other; null over near zero. A (date, ticker) brings its
    features together once, and makes its ratios from them."""
    held = features.groupBy("date", "ticker").agg(F.collect_list(F.struct("feature", "value")).alias("f"))
    each = held.withColumn("a", F.explode("f")).withColumn("b", F.explode("f")).filter("a.feature <> b.feature")
    v = F.when(F.abs("b.value") > least, ratio("a.value", "b.value"))
    return each.select("date", "ticker", F.concat("a.feature", F.lit("/"), "b.feature").alias("candidate"), v.alias("value"))


def interaction_candidates(features: DataFrame, regimes: DataFrame) -> DataFrame:
    """(date, ticker, candidate, value): feature times the date's regime label (0 if unknown)."""
    j = features.join(regimes, "date", "left")
    return j.select("date", "ticker", F.concat("feature", F.lit("_x_regime")).alias("candidate"), (F.col("value") * F.coalesce("label", F.lit(0))).alias("value"))


def _expression(r: random.Random, names: list[str], depth: int) -> tuple[str, Column, int]:
    if depth == 0 or r.random() < 0.25:
        n = r.choice(names)
        return n, F.col(n), 1
    op = r.choice(["+", "-", "*", "/", "abs", "sqrt", "square"])
    t, c, k = _expression(r, names, depth - 1)
    if op in ("abs", "sqrt", "square"):
        made = {"abs": F.abs(c), "sqrt": F.sqrt(F.abs(c)), "square": c * c}[op]
        return f"{op}({t})", made, k + 1
    u, d, m = _expression(r, names, depth - 1)
    made = {"+": c + d, "-": c - d, "*": c * d, "/": F.when(F.abs(d) > 1e-8, c / d)}[op]
    return f"({t} {op} {u})", made, k + m + 1


def expression_search(wide: DataFrame, names: list[str], target: str, population: int = 50, top: int = 10, seed: int = 5, cost: float = 0.001) -> DataFrame:
    """(expression, size, ic, fitness): random expression trees, all scored in one pass of pooled Spearman. The trees
    are columns, so the work per row is one projection."""
    r = random.Random(seed)
    found = {t: (c, k) for t, c, k in (_expression(r, names, r.randint(1, 3)) for _ in range(population))}
    cols = [F.struct(F.lit(t).alias("expression"), F.lit(k).alias("size"), c.cast("double").alias("v")) for t, (c, k) in found.items()]
    long = wide.select(F.col(target).alias("y"), F.explode(F.array(*cols)).alias("e")).select("y", "e.*").filter("v IS NOT NULL AND y IS NOT NULL AND NOT isnan(v)")
    out = pooled_spearman(long, ["expression", "size"], "v", "y").withColumnRenamed("corr", "ic").filter("n >= 50 AND ic IS NOT NULL")
    return out.select("expression", "size", "ic", (F.abs("ic") - cost * F.col("size")).alias("fitness")).orderBy(F.desc("fitness"), "expression").limit(top)


def parameter_search(fitness, ranges: dict[str, tuple[float, float]], spark, population: int = 50, generations: int = 30, seed: int = 9):
    """Genetic search: fitness takes a DataFrame (id, each parameter) and gives (id, fitness), so a generation is one
    Spark job; only the population, a fixed number of rows, is on the driver."""
    r = random.Random(seed)
    names = list(ranges)
    pool = [{n: r.uniform(*ranges[n]) for n in names} for _ in range(population)]
    schema = "id int, " + ", ".join(f"{n} double" for n in names)
    scored: list[tuple[float, dict]] = []
    for g in range(generations):
        got = {x.id: x.fitness for x in fitness(spark.createDataFrame([(i, *[p[n] for n in names]) for i, p in enumerate(pool)], schema)).collect()}
        scored = sorted(((got.get(i, float("-inf")) - 0.005 * sum(v != 0 for v in p.values()), p) for i, p in enumerate(pool)), key=lambda t: -t[0])
        if g == generations - 1:
            break
        elite = [p for _, p in scored[: max(1, population // 10)]]

        def pick() -> dict:
            return max(r.sample(scored, 3), key=lambda t: t[0])[1]

        pool = list(elite)
        while len(pool) < population:
            a, b = pick(), pick()
            child = {n: (a if r.random() < 0.5 else b)[n] for n in names} if r.random() < 0.7 else dict(a)
            for n in names:
                if r.random() < 0.1:
                    lo, hi = ranges[n]
                    child[n] = min(hi, max(lo, child[n] + r.gauss(0, (hi - lo) * 0.1)))
            pool.append(child)
    return scored[0]


def ensemble_predict(predictions: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(date, ticker, score): weighted mean over the models that have a prediction; null without any."""
    w = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])[F.col("model")] if weights else F.lit(1.0)
    known = F.when(F.col("score").isNotNull(), w)
    return predictions.groupBy("date", "ticker").agg(ratio(F.sum(known * F.col("score")), F.sum(known)).alias("score"))


def ensemble_diversity(predictions: DataFrame, models: list[str], limit: float = 0.7) -> DataFrame:
    """(mean_corr, n, warning): mean |Spearman| of the models' pairs over complete rows; 0 below five rows."""
    wide = predictions.groupBy("date", "ticker").pivot("model", models).agg(F.first("score")).dropna()
    long = wide.unpivot(["date", "ticker"], models, "model", "score")
    r = pooled_ranks(long, ["model"], "score").withColumnRenamed("rank_score", "r")
    a, b = r.alias("a"), r.alias("b")
    on = (F.col("a.date") == F.col("b.date")) & (F.col("a.ticker") == F.col("b.ticker")) & (F.col("a.model") < F.col("b.model"))
    each = a.join(b, on).groupBy(F.col("a.model").alias("m1"), F.col("b.model").alias("m2")).agg(F.abs(safe_corr(F.col("a.r"), F.col("b.r"))).alias("c"), F.count("*").alias("n"))
    mean = F.coalesce(F.when(F.max("n") >= 5, F.avg("c")), F.lit(0.0))
    return each.agg(mean.alias("mean_corr"), F.coalesce(F.max("n"), F.lit(0)).alias("n"), (mean > limit).alias("warning"))


def _lifecycle(state: tuple[str, float, object], ic: float, date) -> tuple[str, float, object]:
    """The next (status, multiplier, since) of a strategy; suspended and retired ones stay so whatever their IC."""
    status, _, since = state
    if status == "active" and ic < 0.01:
        return "under_review", 0.5, date
    if status == "under_review" and ic >= 0.03:
        return "active", 1.0, date
    if status == "under_review" and ic < 0.0 and (date - since).days >= 30:
        return "suspended", 0.0, date
    return state


def strategy_lifecycle(events: DataFrame, retired: DataFrame | None = None) -> DataFrame:
    """(strategy, date, ic) to (strategy, date, status, multiplier). Each strategy's own history is worked off in
    order; its first event registers it as active. retired (strategy, date): a strategy is retired by hand from that date
    on, for good; the earliest counts."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date", kind="stable")
        out, state = [], None
        for d, ic in zip(pdf["date"], pdf["ic"]):
            state = ("active", 1.0, d) if state is None else _lifecycle(state, ic, d)
            out.append((pdf["strategy"].iloc[0], d, state[0], state[1]))
        return pd.DataFrame(out, columns=["strategy", "date", "status", "multiplier"])

    out = events.groupBy("strategy").applyInPandas(walk, "strategy string, date date, status string, multiplier double")
    if retired is None:
        return out
    over = F.col("date") >= F.col("__over")
    ends = retired.groupBy("strategy").agg(F.min("date").alias("__over"))
    known = out.join(ends, "strategy", "left")
    return known.select("strategy", "date", F.when(over, "retired").otherwise(F.col("status")).alias("status"), F.when(over, 0.0).otherwise(F.col("multiplier")).alias("multiplier"))


def normal_cdf(x: float) -> float:
    return statistics.NormalDist().cdf(x)
