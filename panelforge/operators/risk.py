"""Risk checks, stress, profit and loss, and backtests over long tables."""

from __future__ import annotations

import math
import statistics

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import exact_sum, last_rows, ratio
from ..functions.resamples import name_of, weighted_sums

YEAR = 252
#: Fixed value: the Euler-Mascheroni constant.
EULER = 0.5772156649015329
SEED_NAV = 1e6

# Shocks of the built-in scenarios by factor.
SCENARIOS = {
    "2008_financial_crisis": {"market": -0.40, "momentum": -0.30, "value": -0.25, "quality": 0.05, "low_vol": -0.10, "size": -0.20},
    "2020_covid_crash": {"market": -0.35, "momentum": -0.40, "value": -0.15, "quality": 0.10, "low_vol": 0.05, "size": -0.25},
    "2022_rate_shock": {"market": -0.20, "momentum": -0.15, "value": 0.10, "quality": -0.05, "low_vol": 0.05, "size": -0.10},
}


def _order(keys: tuple[str, ...]):
    return Window.partitionBy(*keys).orderBy("date")


def drawdown(nav: DataFrame, keys: tuple[str, ...] = (), seed: float = SEED_NAV) -> DataFrame:
    """nav with peak (of the path so far, seed at least) and drawdown."""
    peak = F.greatest(F.max("nav").over(_order(keys).rowsBetween(Window.unboundedPreceding, 0)), F.lit(seed))
    return nav.withColumn("peak", peak).withColumn("drawdown", ratio(F.col("peak") - F.col("nav"), F.col("peak")))


def drawdown_alerts(nav: DataFrame, keys: tuple[str, ...] = (), seed: float = SEED_NAV) -> DataFrame:
    """Rows at or beyond a level, with the highest one."""
    d = F.col("drawdown")
    level = F.when(d >= 0.20, "CRITICAL").when(d >= 0.15, "ALERT").when(d >= 0.10, "WARNING")
    return drawdown(nav, keys, seed).withColumn("level", level).filter("level IS NOT NULL")


def kill_switch(nav: DataFrame, keys: tuple[str, ...] = (), limit: float = 0.20) -> DataFrame:
    """nav with drawdown against the prior peak and halted, which stays once reached; the peak freezes then."""
    w = _order(keys)
    prior = F.coalesce(F.max("nav").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("nav"))
    d = nav.withColumn("__p", prior).withColumn("__d", ratio(F.col("__p") - F.col("nav"), F.col("__p")))
    halted = F.max((F.col("__d") >= limit).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1
    h = d.withColumn("halted", halted)
    frozen = F.first(F.when(F.col("halted"), F.col("__p")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return h.withColumn("peak", F.coalesce(frozen, F.col("__p"))).withColumn("drawdown", ratio(F.col("peak") - F.col("nav"), F.col("peak"))).drop("__p", "__d")


def kill_switch_by_strategy(nav: DataFrame, limit: float = 0.20, key: str = "strategy") -> DataFrame:
    """(key, halted, trigger_date, trigger_drawdown): one row for each strategy."""
    k = kill_switch(nav, (key,), limit)
    hit = F.when(F.col("halted"), F.col("date"))
    return k.groupBy(key).agg(F.max("halted").alias("halted"), F.min(hit).alias("trigger_date"), F.min_by("drawdown", hit).alias("d")).select(key, "halted", "trigger_date", F.when(F.col("halted"), F.col("d")).alias("trigger_drawdown"))


def enforce_leverage(weights: DataFrame, most: float = 2.0, key: str = "date") -> DataFrame:
    g = F.sum(F.abs("weight")).over(Window.partitionBy(key))
    return weights.withColumn("weight", F.when(g > most, F.col("weight") * most / g).otherwise(F.col("weight")))


def exposure_breaches(weights: DataFrame, sectors: DataFrame, exposures: DataFrame | None = None, gross: float = 2.0, single: float = 0.02, sector: float = 0.20, factor: float = 2.0, key: str = "date") -> DataFrame:
    """(key, rule, name, value)."""
    w = weights.join(sectors, "ticker", "left").withColumn("sector", F.coalesce("sector", F.lit("Unknown")))
    row = lambda rule, name, v: (F.col(key), F.lit(rule).alias("rule"), name.alias("name"), v.alias("value"))
    total = w.groupBy(key).agg(F.sum(F.abs("weight")).alias("v"))
    out = total.filter(F.col("v") > gross).select(*row("gross", F.lit(""), F.col("v")))
    out = out.union(w.filter(F.abs("weight") > single).select(*row("single_name", F.col("ticker"), F.col("weight"))))
    each = w.groupBy(key, "sector").agg(F.sum(F.abs("weight")).alias("v"))
    out = out.union(each.filter(F.col("v") > sector).select(*row("sector", F.col("sector"), F.col("v"))))
    if exposures is not None:
        out = out.union(factor_exposure_history(weights, exposures, key).filter(F.abs("exposure") > factor).select(*row("factor", F.col("factor"), F.col("exposure"))))
    return out


def risk_cascade(nav: DataFrame, weights: DataFrame, sectors: DataFrame, gross: float = 2.0, single: float = 0.02) -> DataFrame:
    """(date, ticker, weight, blocked, level): weights after the kill switch (none), critical drawdown (none), leverage
    (scaled) and single names (clipped)."""
    k = kill_switch(nav).select("date", "halted")
    a = drawdown_alerts(nav).select("date", "level")
    w = enforce_leverage(weights, gross).join(k, "date").join(a, "date", "left")
    blocked = F.col("halted") | (F.coalesce("level", F.lit("")) == "CRITICAL")
    kept = F.when(blocked, 0.0).otherwise(F.greatest(F.least(F.col("weight"), F.lit(single)), F.lit(-single)))
    return w.select("date", "ticker", kept.alias("weight"), blocked.alias("blocked"), "level")


def factor_exposure_history(weights: DataFrame, exposures: DataFrame, key: str = "date") -> DataFrame:
    return weights.join(exposures, "ticker").groupBy(key, "factor").agg(exact_sum(F.col("weight") * F.col("beta")).alias("exposure"))


def stress_test(exposures: DataFrame, scenarios: dict[str, dict[str, float]] = SCENARIOS, idio: DataFrame | None = None) -> DataFrame:
    """(key, scenario, ret, drawdown) of (key, factor, exposure); idio (key, penalty) is taken off. Scenarios are a
    parameter table."""
    rows = [(s, f, v) for s, shocks in scenarios.items() for f, v in shocks.items()]
    table = F.broadcast(exposures.sparkSession.createDataFrame(rows, "scenario string, factor string, shock double"))
    r = exposures.join(table, "factor").groupBy("key", "scenario").agg(exact_sum(F.col("exposure") * F.col("shock")).alias("ret"))
    if idio is not None:
        r = r.join(idio, "key", "left").withColumn("ret", F.col("ret") - 0.5 * F.coalesce("penalty", F.lit(0.0))).drop("penalty")
    return r.withColumn("drawdown", F.abs(F.least(F.lit(0.0), F.col("ret"))))


def pnl_series(nav: DataFrame, keys: tuple[str, ...] = (), seed: float = SEED_NAV) -> DataFrame:
    """nav with pnl and ret against the row before (the seed first), cum_ret, peak and drawdown."""
    before = F.coalesce(F.lag("nav").over(_order(keys)), F.lit(seed))
    d = drawdown(nav, keys, seed).withColumn("pnl", F.col("nav") - before).withColumn("ret", ratio(F.col("nav") - before, before))
    return d.withColumn("cum_ret", F.col("nav") / seed - 1)


def pnl_summary(returns: DataFrame, key: str = "strategy") -> DataFrame:
    """(key, total, annual, volatility, sharpe, max_drawdown, n)."""
    w = Window.partitionBy(key).orderBy("date")
    growth = F.product(1 + F.col("ret")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    p = returns.withColumn("__c", growth).withColumn("__m", F.greatest(F.lit(1.0), F.max("__c").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    a = p.groupBy(key).agg((F.product(1 + F.col("ret")) - 1).alias("total"), F.avg("ret").alias("m"), F.stddev_samp("ret").alias("s"), F.max(1 - F.col("__c") / F.col("__m")).alias("max_drawdown"), F.count("*").alias("n"))
    return a.select(key, "total", (F.col("m") * YEAR).alias("annual"), (F.col("s") * YEAR**0.5).alias("volatility"), F.coalesce(ratio("m", "s") * YEAR**0.5, F.lit(0.0)).alias("sharpe"), "max_drawdown", "n")


def risk_snapshot(weights: DataFrame, sectors: DataFrame, exposures: DataFrame | None = None, top: int = 10, key: str = "date") -> DataFrame:
    """(key, kind, name, value): gross, net, net by sector, factors, and the largest positions."""
    w = weights.join(sectors, "ticker", "left").withColumn("sector", F.coalesce("sector", F.lit("Unknown")))
    row = lambda kind, name, v: (F.col(key), F.lit(kind).alias("kind"), name.alias("name"), v.alias("value"))
    t = w.groupBy(key).agg(F.sum(F.abs("weight")).alias("g"), F.sum("weight").alias("n"))
    out = t.select(*row("gross", F.lit(""), F.col("g"))).union(t.select(*row("net", F.lit(""), F.col("n"))))
    out = out.union(w.groupBy(key, "sector").agg(F.sum("weight").alias("v")).select(*row("sector", F.col("sector"), F.col("v"))))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.abs("weight")), "ticker"))
    out = out.union(w.withColumn("__k", rank).filter(F.col("__k") <= top).select(*row("top", F.col("ticker"), F.col("weight"))))
    if exposures is not None:
        out = out.union(factor_exposure_history(weights, exposures, key).select(*row("factor", F.col("factor"), F.col("exposure"))))
    return out


def historical_var(weights: DataFrame, returns: DataFrame, levels: tuple[float, ...] = (0.95, 0.99)) -> DataFrame:
    """(n, var_95, …): of the weights' (ticker, weight) daily returns on dates where every ticker has one."""
    n = weights.agg(F.count("*").alias("__n"))
    d = returns.join(weights, "ticker").groupBy("date").agg(F.sum(F.col("weight") * F.col("ret")).alias("r"), F.count("*").alias("k"))
    full = d.join(F.broadcast(n), F.col("k") == F.col("__n"))
    return full.agg(F.count("*").alias("n"), *[(-F.percentile("r", 1 - lv)).alias(f"var_{round(lv * 100)}") for lv in levels])


def risk_limit_breaches(snapshot: DataFrame, gross: float = 2.0, sector: float = 0.20) -> DataFrame:
    v = F.abs("value")
    return snapshot.filter(((F.col("kind") == "gross") & (v > gross)) | ((F.col("kind") == "sector") & (v > sector)))


def performance(returns: DataFrame, key: str = "strategy") -> DataFrame:
    """(key, sharpe, max_drawdown, calmar)."""
    s = pnl_summary(returns, key)
    return s.select(key, "sharpe", "max_drawdown", F.coalesce(ratio("annual", "max_drawdown"), F.lit(0.0)).alias("calmar"))


def rolling_sharpe(returns: DataFrame, window: int = 63, key: str = "strategy") -> DataFrame:
    w = Window.partitionBy(key).orderBy("date")
    m, s = (f("ret").over(last_rows(w, window)) for f in (F.avg, F.stddev_samp))
    return returns.withColumn("rolling_sharpe", F.when(F.row_number().over(w) >= window, F.when(s > 0, m / s * YEAR**0.5).otherwise(0.0)))


def ic_tstat(ics: DataFrame, key: str = "signal") -> DataFrame:
    return ics.groupBy(key).agg(F.coalesce(ratio(F.avg("ic"), F.stddev_samp("ic")) * F.sqrt(F.count("ic")), F.lit(0.0)).alias("t_stat"))


def deflated_sharpe(returns: DataFrame, trials: int, key: str = "strategy") -> DataFrame:
    """(key, sharpe, expected_max, dsr): the chance that the Sharpe ratio is above what the best of so many trials has
    by luck, with skewness and kurtosis."""
    normal = statistics.NormalDist()
    n = max(2, trials)
    best = (1 - EULER) * normal.inv_cdf(1 - 1 / n) + EULER * normal.inv_cdf(1 - 1 / (n * math.e))
    a = returns.groupBy(key).agg(ratio(F.avg("ret"), F.stddev_samp("ret")).alias("sr"), F.skewness("ret").alias("g"), F.kurtosis("ret").alias("k"), F.count("*").alias("n"))
    a = a.withColumn("expected_max", best / F.sqrt("n"))
    se = F.sqrt(F.greatest((1 - F.col("g") * F.col("sr") + (F.col("k") + 2) / 4 * F.col("sr") ** 2) / (F.col("n") - 1), F.lit(1e-12)))

    @F.pandas_udf("double")
    def phi(z: pd.Series) -> pd.Series:
        own = statistics.NormalDist()
        return z.map(lambda v: None if v is None or v != v else own.cdf(v))

    return a.select(key, F.col("sr").alias("sharpe"), "expected_max", phi((F.col("sr") - F.col("expected_max")) / se).alias("dsr"))


def bootstrap_ci(series: DataFrame, b: int = 1000, level: float = 0.95, seed: int = 17, key: str = "strategy") -> DataFrame:
    """(key, low, high): percentiles of the mean over b resamples of single rows."""
    return block_bootstrap(series, b, 1, level, seed, key)


def block_bootstrap(series: DataFrame, b: int = 1000, block: int = 10, level: float = 0.95, seed: int = 17, key: str = "strategy") -> DataFrame:
    """(key, low, high): percentiles of the mean over b resamples made of blocks of consecutive rows (all of a shorter
    series). Each row begins a block, whose sum a window gives; a resample takes blocks with Poisson(1 / block) weights
    that follow from their first row's name, as many rows as the series has, on average."""
    w = Window.partitionBy(key).orderBy("date")
    ahead = w.rowsBetween(0, block - 1)
    blocks = series.select(key, "date", F.sum("ret").over(ahead).alias("x"), F.count("*").over(ahead).alias("size"), F.row_number().over(w).alias("k")).filter((F.col("size") == block) | (F.col("k") == 1))
    m = weighted_sums(blocks, [key], "x", name_of(seed, key, "date"), b, 1.0 / block, "size").withColumn("m", ratio("s", "w"))
    tail = (1 - level) / 2
    return m.groupBy(key).agg(F.percentile("m", tail).alias("low"), F.percentile("m", 1 - tail).alias("high"))


def backtest(scores: DataFrame, bars: DataFrame, cost_bps: float | Column = 5.0, freq: int | Column = 1, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys…, date, gross_ret, turnover, cost, ret, nav): scores ranked and centred to gross one on every freq-th date,
    held between, earning the next close. One plan for all dates and keys.

    Weights of a rebalance reach to the next one, so a date finds its rebalance by integer division, not by a loop. An
    account that loses all it has stays at nothing: nav is 0 from there on, whatever ret would be."""
    cost = F.lit(cost_bps) if not isinstance(cost_bps, Column) else cost_bps
    every = F.lit(freq) if not isinstance(freq, Column) else freq
    x = Window.partitionBy(*keys, "date")
    dates = scores.select(*keys, "date").distinct().withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("date")) - 1)
    s = scores.join(dates, [*keys, "date"]).filter(F.col("k") % every == 0)
    centred = F.percent_rank().over(x.orderBy("score")) - 0.5
    w = s.withColumn("__c", centred).withColumn("w", F.coalesce(ratio("__c", exact_sum(F.abs("__c"), x)), F.lit(0.0))).withColumn("r", (F.col("k") / every).cast("long"))
    w = w.select(*keys, "ticker", "r", "w")
    nxt = bars.select("ticker", "date", (F.lead("close").over(Window.partitionBy("ticker").orderBy("date")) / F.col("close") - 1).alias("next"))
    days = dates.withColumn("r", (F.col("k") / every).cast("long"))
    held = days.join(w, [*keys, "r"]).join(nxt, ["ticker", "date"], "left")
    gross = held.groupBy(*keys, "date", "k", "r").agg(exact_sum(F.col("w") * F.coalesce("next", F.lit(0.0))).alias("gross_ret"))
    before = w.select(*keys, "ticker", (F.col("r") + 1).alias("r"), F.col("w").alias("w0"))
    last = w.groupBy(*keys).agg(F.max("r").alias("__last"))
    both = w.join(before, [*keys, "ticker", "r"], "full").select(*keys, "r", F.abs(F.coalesce("w", F.lit(0.0)) - F.coalesce("w0", F.lit(0.0))).alias("d"))
    turn = both.groupBy(*keys, "r").agg(exact_sum("d").alias("turnover"))
    g = gross.join(turn, [*keys, "r"], "left").withColumn("turnover", F.when(F.col("k") % every == 0, F.coalesce("turnover", F.lit(0.0))).otherwise(0.0))
    g = g.withColumn("cost", F.col("turnover") * cost / 1e4).withColumn("ret", F.col("gross_ret") - F.col("cost"))
    nav = F.product(F.greatest(1 + F.col("ret"), F.lit(0.0))).over(Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    return g.withColumn("nav", nav).select(*keys, "date", "gross_ret", "turnover", "cost", "ret", "nav")


def parameter_sweep(scores: DataFrame, bars: DataFrame, grid: list[dict[str, float]]) -> DataFrame:
    """(point_id, cost_bps, freq, sharpe, total, max_drawdown, rank): a backtest for every grid point in one plan. The
    grid is a parameter table; its points key every shuffle."""
    spark = scores.sparkSession
    rows = [(float(g["cost_bps"]), int(g["freq"])) for g in grid]
    points = spark.createDataFrame(rows, "cost_bps double, freq int").withColumn("point_id", F.md5(F.to_json(F.struct("cost_bps", "freq"))))
    s = scores.join(F.broadcast(points))
    b = backtest(s, bars, F.col("cost_bps"), F.col("freq"), ("point_id", "cost_bps", "freq"))
    m = pnl_summary(b.select("point_id", "date", "ret"), "point_id")
    out = points.join(m, "point_id").select("point_id", "cost_bps", "freq", "sharpe", "total", "max_drawdown")
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("sharpe"), "point_id")))
