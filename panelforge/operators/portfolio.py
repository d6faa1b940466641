"""Factor risk, weights, allocation and capacity over long tables: returns (date, ticker, ret), factors (date, factor,
ret), exposures (ticker, factor, beta), cov (f1, f2, cov), weights (…, ticker, weight)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import last_rows, ratio, z_of
from ..session import Work

YEAR = 252
#: Distinct weights that mean_variance_weights brings to the driver at most.
MOST_VALUES = 1 << 16


def _last_dates(df: DataFrame, n: int) -> DataFrame:
    """The rows of the newest n dates. Dates alone are ranked."""
    dates = df.select("date").distinct().orderBy(F.desc("date")).limit(n)
    return df.join(F.broadcast(dates), "date", "left_semi")


def factor_exposures(returns: DataFrame, factors: DataFrame, window: int = 252, least: int = 60) -> DataFrame:
    """(ticker, factor, beta): least squares with intercept over the dates, of the last window, on which every factor
    has a return; 0 below least dates. Spark sums the products of named columns; the small systems are solved by ticker.
    The names of the factors, not their rows, come to the driver."""
    names = [r.factor for r in factors.select("factor").distinct().orderBy("factor").collect()]
    near = _last_dates(factors, window).groupBy("date").pivot("factor", names).agg(F.first("ret")).dropna()
    vector = F.array(F.lit(1.0), *[F.col(f"`{n}`").cast("double") for n in names], F.col("__y"))
    rows = returns.filter("ret IS NOT NULL").select("ticker", "date", F.col("ret").alias("__y")).join(near, "date").select("ticker", vector.alias("v"))
    cell = rows.select("ticker", "v", F.posexplode("v").alias("i", "a")).select("ticker", "i", "a", F.posexplode("v").alias("j", "b"))
    gram = cell.groupBy("ticker", "i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("s"))
    k = len(names) + 1

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        g = np.zeros((k + 1, k + 1))
        g[pdf["i"], pdf["j"]] = pdf["s"]
        beta = np.linalg.lstsq(g[:k, :k], g[:k, k], rcond=None)[0] if g[0, 0] >= least else np.zeros(k)
        return pd.DataFrame({"ticker": pdf["ticker"].iloc[0], "factor": names, "beta": beta[1:]})

    return gram.groupBy("ticker").applyInPandas(solve, "ticker string, factor string, beta double")


def market_beta(returns: DataFrame, factor: DataFrame, window: int = 252, least: int = 60) -> DataFrame:
    """factor_exposures for one factor: a plain regression aggregate."""
    j = returns.join(_last_dates(factor, window).select("date", F.col("ret").alias("f")), "date")
    return j.groupBy("ticker").agg(F.when(F.count("*") >= least, F.regr_slope("ret", "f")).otherwise(0.0).alias("beta"))


def sector_dummies(sectors: DataFrame, names: list[str]) -> DataFrame:
    return sectors.select("ticker", *[(F.col("sector") == s).cast("int").alias(f"sector_{s}") for s in names])


def characteristic_exposures(df: DataFrame, columns: list[str], key: str = "date") -> DataFrame:
    """Each column's score within the key; unknown and spreadless are 0."""
    x = Window.partitionBy(key)
    return df.withColumns({c: F.coalesce(z_of(c, x), F.lit(0.0)) for c in columns})


def factor_covariance(factors: DataFrame, as_of: str, window: int = 252, least: int = 60) -> DataFrame:
    """(f1, f2, cov, n): sample covariance of the last dates before as_of by the year; 0.04 on the diagonal if short."""
    near = _last_dates(factors.filter(F.col("date") < F.lit(as_of).cast("date")), window)
    a, b = near.alias("a"), near.alias("b")
    c = a.join(b, F.col("a.date") == F.col("b.date")).groupBy(F.col("a.factor").alias("f1"), F.col("b.factor").alias("f2")).agg(F.covar_samp("a.ret", "b.ret").alias("c"), F.count("*").alias("n"))
    flat = F.when(F.col("f1") == F.col("f2"), 0.04).otherwise(0.0)
    return c.select("f1", "f2", F.when(F.col("n") < least, flat).otherwise(F.col("c") * YEAR).alias("cov"), "n")


def shrink_covariance(cov: DataFrame, target: str = "identity") -> DataFrame:
    """(f1, f2, cov, alpha): (1 - alpha) S + alpha T, alpha from how far S is from T. The table has K x K rows."""
    d = cov.withColumn("v", F.when(F.col("f1") == F.col("f2"), F.col("cov")))
    if target == "identity":
        t = F.when(F.col("f1") == F.col("f2"), F.avg("v").over(Window.partitionBy())).otherwise(0.0)
        d = d.withColumn("t", t)
    else:
        s1, s2 = (F.sqrt(F.max("v").over(Window.partitionBy(f))) for f in ("f1", "f2"))
        d = d.withColumn("s", s1 * s2).withColumn("r", F.when(F.col("f1") != F.col("f2"), ratio("cov", "s")))
        d = d.withColumn("t", F.when(F.col("f1") == F.col("f2"), F.col("cov")).otherwise(F.avg("r").over(Window.partitionBy()) * F.col("s")))
    w = Window.partitionBy()
    a = F.least(F.lit(0.5), F.greatest(F.lit(0.0), F.coalesce(ratio(F.sum((F.col("cov") - F.col("t")) ** 2).over(w), F.max("n").over(w) * F.sum(F.col("cov") ** 2).over(w)), F.lit(0.0))))
    return d.withColumn("alpha", a).select("f1", "f2", ((1 - F.col("alpha")) * F.col("cov") + F.col("alpha") * F.col("t")).alias("cov"), "alpha")


def idiosyncratic_variance(returns: DataFrame, factors: DataFrame, exposures: DataFrame, least: int = 10) -> DataFrame:
    """(ticker, variance): of what the factors leave, by the year; the plain variance without exposures."""
    fit = factors.join(exposures, "factor").groupBy("ticker", "date").agg(F.sum(F.col("beta") * factors["ret"]).alias("fit"))
    r = returns.join(fit, ["ticker", "date"], "left").withColumn("e", F.col("ret") - F.col("fit"))
    v = r.groupBy("ticker").agg(F.when(F.count("e") >= least, F.var_samp("e") * YEAR).alias("v"), F.var_samp("ret").alias("raw"))
    return v.select("ticker", F.coalesce("v", "raw").alias("variance"))


def full_covariance(exposures: DataFrame, cov: DataFrame, idio: DataFrame) -> DataFrame:
    """(t1, t2, cov): B F B' + D by two joins on factors."""
    bf = exposures.join(cov, exposures["factor"] == cov["f1"]).groupBy("ticker", "f2").agg(F.sum(F.col("beta") * F.col("cov")).alias("x"))
    e = exposures.select(F.col("ticker").alias("t2"), F.col("factor").alias("f2"), F.col("beta").alias("b2"))
    common = bf.join(e, "f2").groupBy(F.col("ticker").alias("t1"), "t2").agg(F.sum(F.col("x") * F.col("b2")).alias("cov"))
    own = idio.select(F.col("ticker").alias("t1"), F.col("ticker").alias("t2"), F.col("variance").alias("cov"))
    return common.unionByName(own).groupBy("t1", "t2").agg(F.sum("cov").alias("cov"))


def portfolio_exposure(weights: DataFrame, exposures: DataFrame, *keys: str) -> DataFrame:
    return weights.join(exposures, "ticker").groupBy(*keys, "factor").agg(F.sum(F.col("weight") * F.col("beta")).alias("exposure"))


def risk_decomposition(weights: DataFrame, exposures: DataFrame, cov: DataFrame, idio: DataFrame) -> DataFrame:
    """(part, variance, share): a row for each factor's contribution e_i (F e)_i and one for the idiosyncratic rest."""
    e = portfolio_exposure(weights, exposures)
    fe = cov.join(e, cov["f2"] == e["factor"]).groupBy("f1").agg(F.sum(F.col("cov") * F.col("exposure")).alias("fe"))
    parts = e.join(fe, e["factor"] == fe["f1"]).select(F.col("factor").alias("part"), (F.col("exposure") * F.col("fe")).alias("variance"))
    rest = weights.join(idio, "ticker").agg(F.coalesce(F.sum(F.col("weight") ** 2 * F.col("variance")), F.lit(0.0)).alias("variance")).select(F.lit("idiosyncratic").alias("part"), "variance")
    both = parts.unionByName(rest)
    return both.withColumn("share", ratio("variance", F.sum("variance").over(Window.partitionBy())))


def top_risk_contributors(weights: DataFrame, exposures: DataFrame, cov: DataFrame, idio: DataFrame, top: int = 10) -> DataFrame:
    """(ticker, contribution, rank): |w (S w) / sigma|, with S w as B (F (B' w)) + D w: sums by factor and by ticker, so the
    covariance of the tickers is never made."""
    e = portfolio_exposure(weights, exposures)
    fe = cov.join(e, cov["f2"] == e["factor"]).groupBy(F.col("f1").alias("factor")).agg(F.sum(F.col("cov") * F.col("exposure")).alias("fe"))
    common = exposures.join(fe, "factor").select("ticker", (F.col("beta") * F.col("fe")).alias("s"))
    own = weights.join(idio, "ticker").select("ticker", (F.col("weight") * F.col("variance")).alias("s"))
    v = weights.join(common.union(own).groupBy("ticker").agg(F.sum("s").alias("s")), "ticker").withColumn("v", F.col("weight") * F.col("s"))
    sigma = v.agg(F.sqrt(F.sum("v")).alias("sigma"))  # one row
    c = v.join(F.broadcast(sigma)).select("ticker", F.abs(ratio("v", "sigma")).alias("contribution")).orderBy(F.desc("contribution"), "ticker").limit(top)
    return c.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("contribution"), "ticker")))  # of top rows


def validate_weights(weights: DataFrame, sectors: DataFrame, position: float = 0.02, gross: float = 2.0, neutral: bool = True, net: float = 0.01, sector: float = 0.20, key: str = "date", slack: float = 1e-6) -> DataFrame:
    """(key, rule, name, value): what breaks a limit."""
    w = weights.join(sectors, "ticker", "left").withColumn("sector", F.coalesce("sector", F.lit("Unknown")))
    row = lambda rule, name, v: (F.col(key), F.lit(rule).alias("rule"), name.alias("name"), v.alias("value"))
    out = w.filter(F.abs("weight") > position + slack).select(*row("position", F.col("ticker"), F.col("weight")))
    total = w.groupBy(key).agg(F.sum(F.abs("weight")).alias("g"), F.sum("weight").alias("n"))
    out = out.union(total.filter(F.col("g") > gross + slack).select(*row("gross", F.lit(""), F.col("g"))))
    if neutral:
        out = out.union(total.filter(F.abs("n") > net + slack).select(*row("net", F.lit(""), F.col("n"))))
    each = w.groupBy(key, "sector").agg(F.sum(F.abs("weight")).alias("s"))
    return out.union(each.filter(F.col("s") > sector + slack).select(*row("sector", F.col("sector"), F.col("s"))))


def mean_variance_weights(alpha: DataFrame, exposures: DataFrame, cov: DataFrame, aversion: float = 1.0, ridge: float = 1e-6, most: float = 0.02, gross: float = 2.0, rounds: int = 20) -> DataFrame:
    """(ticker, weight): (B F B' + ridge I)^-1 alpha / aversion, then rounds of clipping, centring and scaling. By the
    Woodbury identity only K x K sums leave Spark, and for the rounds the distinct clipped weights with their counts; if
    these are more than MOST_VALUES, two sums a round. No task holds the cross-section. Factors that cov lacks count for
    nothing."""
    work = Work(alpha.sparkSession)
    alpha, exposures = work.cut(alpha.select("ticker", "alpha"), "alpha"), work.cut(exposures.select("ticker", "factor", "beta"), "exposures")
    cells = cov.collect()  # K x K
    names = sorted({r.f1 for r in cells})
    k, at = len(names), {n: i for i, n in enumerate(names)}
    f, bb, ba = np.zeros((k, k)), np.zeros((k, k)), np.zeros(k)
    for r in cells:
        f[at[r.f1], at[r.f2]] = r["cov"]
    exposures = exposures.filter(F.col("factor").isin(names))
    held = exposures.join(alpha, "ticker")
    x, y = held.alias("x"), exposures.alias("y")
    pair = x.join(y, F.col("x.ticker") == F.col("y.ticker")).groupBy(F.col("x.factor").alias("i"), F.col("y.factor").alias("j"))
    for r in pair.agg(F.sum(F.col("x.beta") * F.col("y.beta")).alias("s"), F.sum(F.when(F.col("x.factor") == F.col("y.factor"), F.col("x.beta") * F.col("x.alpha"))).alias("t")).collect():  # K x K
        bb[at[r.i], at[r.j]] = r.s
        if r.i == r.j:
            ba[at[r.i]] = r.t
    # (ridge I + B F B')^-1 a = (a - B M B'a) / ridge with M = (ridge F^-1 + B'B)^-1
    m = np.linalg.solve(ridge * np.linalg.pinv(f) + bb, ba)
    coef = F.create_map(*[c for n, v in zip(names, m) for c in (F.lit(n), F.lit(float(v)))])[F.col("factor")]
    fit = exposures.groupBy("ticker").agg(F.sum(F.col("beta") * coef).alias("fit"))
    w = alpha.join(fit, "ticker", "left").select("ticker", ((F.col("alpha") - F.coalesce("fit", F.lit(0.0))) / ridge / aversion).alias("weight"))
    if not rounds:
        return w
    # clipped weights are written once; most of them stand at a limit, so they have few values
    v = work.cut(w.withColumn("weight", clipped(F.col("weight"), most)), "clipped")
    few = v.groupBy("weight").count().limit(MOST_VALUES + 1).toPandas()
    at, small = F.col("weight"), len(few) <= MOST_VALUES
    x, times = few["weight"].to_numpy(), few["count"].to_numpy()
    n = int(times.sum()) if small else v.count()
    mean = float((x * times).sum() / max(n, 1)) if small else v.agg(F.avg(at)).first()[0]
    for _ in range(rounds):
        at = clipped(at - mean, most)
        if small:
            x = np.clip(x - mean, -most, most)
            g, total = float((np.abs(x) * times).sum()), float((x * times).sum())
        else:
            g, total = v.agg(F.sum(F.abs(at)), F.sum(at)).first()
        scale = gross / g if g > gross else 1.0
        if scale != 1.0:
            at, x = at * scale, x * scale
        mean = total * scale / max(n, 1)  # clipping does not change what is inside already
        if abs(mean) < 1e-15:
            break  # centred, inside and small enough: further rounds change nothing
    return v.select("ticker", at.alias("weight"))


def clipped(x: Column, most: float) -> Column:
    return F.greatest(F.least(x, F.lit(most)), F.lit(-most))


def alpha_proportional_weights(alpha: DataFrame, gross: float = 0.5, key: str = "date") -> DataFrame:
    return alpha.withColumn("weight", F.coalesce(ratio(gross * F.col("alpha"), F.sum(F.abs("alpha")).over(Window.partitionBy(key))), F.lit(0.0)))


def strategy_metrics(returns: DataFrame, window: int = 60, key: str = "strategy") -> DataFrame:
    """(key, sharpe, annual_return, volatility, n) of the last rows, by the population deviation; sharpe 0 if short."""
    k = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("date")))
    r = returns.withColumn("k", k).filter(F.col("k") <= window)
    a = r.groupBy(key).agg(F.avg("ret").alias("m"), F.stddev_pop("ret").alias("s"), F.count("*").alias("n"))
    sharpe = F.when(F.col("n") >= window, F.coalesce(ratio("m", "s") * YEAR**0.5, F.lit(0.0))).otherwise(0.0)
    return a.select(key, sharpe.alias("sharpe"), (F.col("m") * YEAR).alias("annual_return"), (F.col("s") * YEAR**0.5).alias("volatility"), "n")


def strategy_correlation(returns: DataFrame, window: int = 60, least: int = 30) -> DataFrame:
    """(s1, s2, corr) over the last common rows; the identity where they are too few."""
    k = F.row_number().over(Window.partitionBy("strategy").orderBy(F.desc("date")))
    r = returns.withColumn("k", k).filter(F.col("k") <= window)
    a, b = r.alias("a"), r.alias("b")
    j = a.join(b, F.col("a.date") == F.col("b.date")).groupBy(F.col("a.strategy").alias("s1"), F.col("b.strategy").alias("s2"))
    c = j.agg(ratio(F.covar_pop("a.ret", "b.ret"), F.stddev_pop("a.ret") * F.stddev_pop("b.ret")).alias("c"), F.count("*").alias("n"))
    same = F.col("s1") == F.col("s2")
    return c.select("s1", "s2", F.when(same, 1.0).when(F.col("n") < least, 0.0).otherwise(F.coalesce("c", F.lit(0.0))).alias("corr"))


def crowding_penalty(correlations: DataFrame) -> DataFrame:
    return correlations.filter("s1 <> s2").groupBy(F.col("s1").alias("strategy")).agg(F.avg(F.abs("corr")).alias("penalty"))


def allocate(metrics: DataFrame, least: float = 0.05, most: float = 0.40, weight: float = 0.3) -> DataFrame:
    """(strategy, allocation) of (strategy, sharpe, penalty, adjustment): scores normalised, the small dropped, the large
    capped, normalised once more; equal parts if none is eligible."""
    one = Window.partitionBy()
    raw = F.greatest(F.col("sharpe"), F.lit(0.0)) * (1 - weight * F.col("penalty")) * F.col("adjustment")
    share = lambda c: F.coalesce(ratio(c, F.sum(c).over(one)), F.lit(0.0))
    a = metrics.withColumn("__r", raw).withColumn("__s", share(F.col("__r"))).withColumn("__s", F.when(F.col("__s") < least, 0.0).otherwise(F.col("__s")))
    a = a.withColumn("__s", share(F.col("__s"))).withColumn("__s", F.least(F.col("__s"), F.lit(most)))
    out = F.when(F.sum("__r").over(one) > 0, share(F.col("__s"))).otherwise(1.0 / F.count("*").over(one))
    return a.withColumn("allocation", out).drop("__r", "__s")


def market_impact_bps(order: Column, adv: Column, sigma: Column) -> Column:
    """1e4 (sigma p^0.6 + 0.1 sigma p) with p the order's share of the volume; 0 unless all are positive."""
    ok = (order > 0) & (adv > 0) & (sigma > 0)
    p = order / F.when(adv > 0, adv)
    return F.when(ok, 1e4 * (sigma * F.pow(p, 0.6) + 0.1 * sigma * p)).otherwise(0.0)


def impact_cost(trades: DataFrame) -> DataFrame:
    """(…, bps, cost) of (ticker, trade, adv, sigma)."""
    bps = market_impact_bps(F.abs("trade"), F.col("adv"), F.col("sigma"))
    return trades.withColumn("bps", bps).withColumn("cost", F.abs("trade") * F.col("bps") / 1e4)


def capacity(portfolio: DataFrame, aum_grid: list[float], alpha_bps: float, most: float = 0.20) -> DataFrame:
    """(aum, cost_bps, share, breached): up to the first size whose cost eats more than its share of the alpha."""
    grid = F.explode(F.array(*[F.lit(float(a)) for a in aum_grid]))
    p = portfolio.withColumn("aum", grid)
    bps = market_impact_bps(F.abs("turnover") * F.col("aum"), F.col("adv_usd"), F.col("sigma"))
    c = p.groupBy("aum").agg(F.sum(F.abs("turnover") * bps).alias("cost_bps")).withColumn("share", F.col("cost_bps") / alpha_bps)
    w = Window.orderBy("aum")  # over the grid
    hit = c.withColumn("breached", F.col("share") > most).withColumn("before", F.coalesce(F.max(F.col("breached").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return hit.filter("before = 0").drop("before")


def liquidity(bars: DataFrame, window: int = 20, position_usd: float = 100_000.0, share: float = 0.05) -> DataFrame:
    """(ticker, adv, price, adv_usd, days) at each ticker's newest row."""
    w = Window.partitionBy("ticker").orderBy("date")
    b = bars.withColumn("adv", F.avg("volume").over(last_rows(w, window))).groupBy("ticker").agg(F.max_by(F.struct("adv", F.col("close").alias("price")), "date").alias("r")).select("ticker", "r.*")
    return b.withColumn("adv_usd", F.col("adv") * F.col("price")).withColumn("days", ratio(F.lit(position_usd), F.col("adv_usd") * share))


def filter_liquid(liquid: DataFrame, least: float = 5e6) -> DataFrame:
    return liquid.filter(F.col("adv_usd") >= least)


def capacity_capped_weights(target: DataFrame, current: DataFrame, adv: DataFrame, nav: float, most_bps: float = 50.0) -> DataFrame:
    """(ticker, weight, capped): half way from the current weight where trading to the target would cost too much."""
    j = target.withColumnRenamed("weight", "t").join(current.withColumnRenamed("weight", "c"), "ticker", "full").join(adv, "ticker", "left")
    t, c = F.coalesce("t", F.lit(0.0)), F.coalesce("c", F.lit(0.0))
    cost = market_impact_bps(F.abs(t - c) * nav, F.col("adv_usd"), F.col("sigma"))
    capped = F.coalesce(cost > most_bps, F.lit(False))
    return j.select("ticker", F.when(capped, (t + c) / 2).otherwise(t).alias("weight"), capped.alias("capped"))
