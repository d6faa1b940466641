"""Queries of portfolio (H), risk (I), execution (J), governance (K) and streams (ST)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import half_up, rounded
from ..functions.resamples import mixed_sql, name_sql, weight_sql
from ..operators import execution as ex
from ..operators import governance as gov
from ..operators import portfolio as port
from ..operators import risk
from ..streaming import jobs
from . import views
from .queries_data import AS_OF, r
from .queries_models import corr_sql, market, scored, wide
from .registry import query

def units(x: str, more: str = "") -> str:
    """The sum of doubles as decimals of eighteen places, rounded to twelve; more: a filter or a window."""
    return f"CAST(CAST(sum(CAST({x} AS DECIMAL(38, 18))) {more} AS DECIMAL(38, 12)) AS DOUBLE)"


NEWEST = "newest AS (SELECT ticker, weight FROM weights WHERE date = (SELECT max(date) FROM weights))"


def newest(spark, sf) -> DataFrame:
    w = views.weights(spark, sf)
    return w.join(F.broadcast(w.agg(F.max("date").alias("date"))), "date").select("ticker", "weight")


BETAS = """mk AS (SELECT date, ret AS f FROM factors WHERE factor = 'Market' AND date IN (SELECT DISTINCT date FROM factors WHERE factor = 'Market' ORDER BY date DESC LIMIT 252)),
    mb AS (SELECT ticker, CASE WHEN count(*) >= 60 THEN regr_slope(ret, f) ELSE 0 END AS beta FROM returns JOIN mk USING (date) GROUP BY ticker), sf AS (SELECT DISTINCT ticker, CASE sector WHEN 'S0' THEN 1.0 WHEN 'S1' THEN -1.0 ELSE 0.0 END AS s FROM sectors),
    expo AS (SELECT ticker, 'Market' AS factor, round(beta, 6) AS beta FROM mb UNION ALL SELECT ticker, 'Spread', s::DOUBLE FROM sf)"""


def expo(spark, sf) -> DataFrame:
    m = port.market_beta(views.returns(spark, sf), market(spark, sf)).select("ticker", F.lit("Market").alias("factor"), F.round("beta", 6).alias("beta"))
    s = views.sectors(spark, sf).select("ticker", F.lit("Spread").alias("factor"), F.when(F.col("sector") == "S0", 1.0).when(F.col("sector") == "S1", -1.0).otherwise(0.0).alias("beta"))
    return m.unionByName(s)


COV = f"""nd AS (SELECT DISTINCT date FROM factors WHERE date < DATE '{AS_OF}' ORDER BY date DESC LIMIT 252), nf AS (SELECT * FROM factors JOIN nd USING (date)),
    cov AS (SELECT a.factor AS f1, b.factor AS f2, CASE WHEN count(*) < 60 THEN CASE WHEN a.factor = b.factor THEN 0.04 ELSE 0 END ELSE covar_samp(a.ret, b.ret) * 252 END AS cov, count(*) AS n FROM nf a JOIN nf b ON a.date = b.date GROUP BY 1, 2)"""
IDIO = """ft AS (SELECT ticker, date, sum(beta * ret) AS fit FROM factors JOIN expo USING (factor) GROUP BY 1, 2), er AS (SELECT ticker, ret, ret - fit AS e FROM returns LEFT JOIN ft USING (ticker, date)),
    idio AS (SELECT ticker, coalesce(CASE WHEN count(e) >= 10 THEN var_samp(e) * 252 END, var_samp(ret)) AS variance FROM er GROUP BY ticker)"""


def cov(spark, sf) -> DataFrame:
    return port.factor_covariance(views.factors(spark, sf), AS_OF)


def idio(spark, sf) -> DataFrame:
    return port.idiosyncratic_variance(views.returns(spark, sf), views.factors(spark, sf), expo(spark, sf))


FITS = f"""fd AS (SELECT date, max(ret) FILTER (WHERE factor = 'Market') AS m, max(ret) FILTER (WHERE factor = 'Spread') AS s FROM factors WHERE date IN (SELECT DISTINCT date FROM factors ORDER BY date DESC LIMIT 252) GROUP BY date HAVING count(*) = 2),
    fs AS (SELECT ticker, count(*) AS n, covar_pop(ret, m) AS cm, covar_pop(ret, s) AS cs, var_pop(m) AS vm, var_pop(s) AS vs, covar_pop(m, s) AS ms FROM returns JOIN fd USING (date) GROUP BY ticker)"""


@query("h01_factor_exposures", f"WITH {FITS} SELECT ticker, unnest(['Market', 'Spread']) AS factor, unnest([CASE WHEN n >= 60 THEN {r('(cm * vs - cs * ms) / (vm * vs - ms * ms)')} ELSE 0 END, CASE WHEN n >= 60 THEN {r('(cs * vm - cm * ms) / (vm * vs - ms * ms)')} ELSE 0 END]) AS beta FROM fs")
def h01(spark, sf):
    return rounded(port.factor_exposures(views.returns(spark, sf), views.factors(spark, sf)))


@query("h01_market_beta", f"WITH {BETAS} SELECT ticker, {r('beta')} AS beta FROM mb")
def h01_beta(spark, sf):
    return rounded(port.market_beta(views.returns(spark, sf), market(spark, sf)))


@query("h02_sector_dummies", "SELECT ticker, " + ", ".join(f"CAST(sector = 'S{i}' AS INT) AS sector_S{i}" for i in range(5)) + " FROM sectors")
def h02(spark, sf):
    return port.sector_dummies(views.sectors(spark, sf), [f"S{i}" for i in range(5)])


def _z(c: str) -> str:
    return f"coalesce(CASE WHEN stddev_samp({c}) OVER w > 0 THEN ({c} - avg({c}) OVER w) / stddev_samp({c}) OVER w ELSE 0 END, 0)"


@query("h03_characteristic_exposures", f"SELECT date, ticker, {r(_z('close'))} AS close, {r(_z('volume'))} AS volume FROM bars WINDOW w AS (PARTITION BY date)")
def h03(spark, sf):
    return rounded(port.characteristic_exposures(views.bars(spark, sf).select("date", "ticker", "close", "volume"), ["close", "volume"]))


@query("h04_factor_covariance", f"WITH {COV} SELECT f1, f2, {r('cov')} AS cov, n FROM cov")
def h04(spark, sf):
    return rounded(cov(spark, sf))


@query("h05_shrink_covariance", f"""WITH {COV}, t AS (SELECT *, CASE WHEN f1 = f2 THEN avg(CASE WHEN f1 = f2 THEN cov END) OVER () ELSE 0 END AS t FROM cov), a AS (SELECT *, least(0.5, greatest(0, coalesce(sum((cov - t) ** 2) OVER () / nullif(max(n) OVER () * sum(cov ** 2) OVER (), 0), 0))) AS alpha FROM t)
    SELECT f1, f2, {r('(1 - alpha) * cov + alpha * t')} AS cov, {r('alpha')} AS alpha FROM a""")
def h05(spark, sf):
    return rounded(port.shrink_covariance(cov(spark, sf)))


@query("h06_idiosyncratic_variance", f"WITH {BETAS}, {IDIO} SELECT ticker, {r('variance')} AS variance FROM idio")
def h06(spark, sf):
    return rounded(idio(spark, sf))


FULL = "bf AS (SELECT ticker AS t1, f2, sum(beta * cov) AS x FROM expo JOIN cov ON factor = f1 GROUP BY 1, 2), fc AS (SELECT t1, t2, sum(v) AS cov FROM (SELECT t1, e.ticker AS t2, x * e.beta AS v FROM bf JOIN expo e ON e.factor = bf.f2 UNION ALL SELECT ticker, ticker, variance FROM idio) GROUP BY 1, 2)"


@query("h07_full_covariance", f"WITH {BETAS}, {COV}, {IDIO}, {FULL} SELECT t1, t2, {r('cov')} AS cov FROM fc")
def h07(spark, sf):
    return rounded(port.full_covariance(expo(spark, sf), cov(spark, sf), idio(spark, sf)))


@query("h08_risk_decomposition", f"""WITH {BETAS}, {COV}, {IDIO}, {NEWEST}, e AS (SELECT factor, sum(weight * beta) AS x FROM newest JOIN expo USING (ticker) GROUP BY 1), fe AS (SELECT f1, sum(cov * x) AS y FROM cov JOIN e ON f2 = factor GROUP BY 1),
    p AS (SELECT factor AS part, x * y AS variance FROM e JOIN fe ON f1 = factor UNION ALL SELECT 'idiosyncratic', coalesce(sum(weight ** 2 * variance), 0) FROM newest JOIN idio USING (ticker)) SELECT part, {r('variance')} AS variance, {r('variance / nullif(sum(variance) OVER (), 0)')} AS share FROM p""")
def h08(spark, sf):
    return rounded(port.risk_decomposition(newest(spark, sf), expo(spark, sf), cov(spark, sf), idio(spark, sf)))


@query("h09_top_risk_contributors", f"""WITH {BETAS}, {COV}, {IDIO}, {FULL}, {NEWEST}, s AS (SELECT t1, sum(cov * weight) AS s FROM fc JOIN newest ON t2 = ticker GROUP BY 1), c AS (SELECT ticker, abs(weight * s / nullif(sqrt(sum(weight * s) OVER ()), 0)) AS contribution FROM newest JOIN s ON t1 = ticker),
    k AS (SELECT ticker, round(contribution, 6) + 0.0 AS contribution, row_number() OVER (ORDER BY contribution DESC, ticker) AS rank FROM c) SELECT * FROM k WHERE rank <= 10""")
def h09(spark, sf):
    return rounded(port.top_risk_contributors(newest(spark, sf), expo(spark, sf), cov(spark, sf), idio(spark, sf)).withColumn("rank", F.col("rank").cast("long")))


WS = "ws AS (SELECT date, ticker, weight, coalesce(sector, 'Unknown') AS sector FROM weights LEFT JOIN sectors USING (ticker))"


@query("h10_validate_weights", f"""WITH {WS}, t AS (SELECT date, sum(abs(weight)) AS g, sum(weight) AS n FROM ws GROUP BY date) SELECT date, 'position' AS rule, ticker AS name, {r('weight')} AS value FROM ws WHERE abs(weight) > 0.020001
    UNION ALL SELECT date, 'gross', '', {r('g')} FROM t WHERE g > 2.000001 UNION ALL SELECT date, 'net', '', {r('n')} FROM t WHERE abs(n) > 0.010001 UNION ALL SELECT date, 'sector', sector, {r('sum(abs(weight))')} FROM ws GROUP BY date, sector HAVING sum(abs(weight)) > 0.200001""")
def h10(spark, sf):
    return rounded(port.validate_weights(views.weights(spark, sf), views.sectors(spark, sf)))


@query("h11_mean_variance_weights")
def h11(spark, sf):
    return rounded(port.mean_variance_weights(newest(spark, sf).withColumnRenamed("weight", "alpha"), expo(spark, sf), cov(spark, sf)))


@query("h12_alpha_proportional_weights", f"SELECT date, ticker, {r('coalesce(0.5 * ret / nullif(sum(abs(ret)) OVER (PARTITION BY date), 0), 0)')} AS weight FROM returns")
def h12(spark, sf):
    return rounded(port.alpha_proportional_weights(views.returns(spark, sf).withColumnRenamed("ret", "alpha")).select("date", "ticker", "weight"))


def strategy_returns(spark, sf) -> DataFrame:
    w = Window.partitionBy("strategy").orderBy("date")
    return views.strategy_pnl(spark, sf).select("strategy", "date", (F.col("value") / F.lag("value").over(w) - 1).alias("ret")).filter("ret IS NOT NULL")


SR = "sr AS (SELECT * FROM (SELECT strategy, date, value / lag(value) OVER (PARTITION BY strategy ORDER BY date) - 1 AS ret FROM strategy_pnl) WHERE ret IS NOT NULL)"


@query("h13_strategy_metrics", f"""WITH {SR}, k AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY date DESC) AS k FROM sr) SELECT strategy, {r('CASE WHEN count(*) >= 10 THEN coalesce(avg(ret) / nullif(stddev_pop(ret), 0) * sqrt(252), 0) ELSE 0 END')} AS sharpe, {r('avg(ret) * 252')} AS annual_return,
    {r('stddev_pop(ret) * sqrt(252)')} AS volatility, count(*) AS n FROM k WHERE k <= 10 GROUP BY strategy""")
def h13(spark, sf):
    return rounded(port.strategy_metrics(strategy_returns(spark, sf), 10))


SC = f"""k AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY date DESC) AS k FROM sr), c AS (SELECT a.strategy AS s1, b.strategy AS s2, {corr_sql('a.ret', 'b.ret')} AS c, count(*) AS n FROM k a JOIN k b ON a.date = b.date AND a.k <= 20 AND b.k <= 20 GROUP BY 1, 2),
    sc AS (SELECT s1, s2, CASE WHEN s1 = s2 THEN 1.0 WHEN n < 8 THEN 0.0 ELSE coalesce(c, 0) END AS corr FROM c)"""


@query("h14_strategy_correlation", f"WITH {SR}, {SC} SELECT s1, s2, {r('corr')} AS corr FROM sc")
def h14(spark, sf):
    return rounded(port.strategy_correlation(strategy_returns(spark, sf), 20, 8))


@query("h15_crowding_penalty", f"WITH {SR}, {SC} SELECT s1 AS strategy, {r('avg(abs(corr))')} AS penalty FROM sc WHERE s1 <> s2 GROUP BY s1")
def h15(spark, sf):
    return rounded(port.crowding_penalty(port.strategy_correlation(strategy_returns(spark, sf), 20, 8)))


@query("h16_allocate", f"""WITH m AS (SELECT strategy, avg(value) AS sharpe, CASE strategy WHEN 'click' THEN 0.9 ELSE 0.1 END AS penalty, 1.0 AS adjustment FROM strategy_pnl GROUP BY 1), a AS (SELECT *, greatest(sharpe, 0) * (1 - 0.3 * penalty) * adjustment AS raw FROM m),
    b AS (SELECT *, coalesce(raw / nullif(sum(raw) OVER (), 0), 0) AS s FROM a), c AS (SELECT *, CASE WHEN s < 0.05 THEN 0 ELSE s END AS t FROM b), d AS (SELECT *, least(coalesce(t / nullif(sum(t) OVER (), 0), 0), 0.4) AS u FROM c)
    SELECT strategy, {r('CASE WHEN sum(raw) OVER () > 0 THEN coalesce(u / nullif(sum(u) OVER (), 0), 0) ELSE 1.0 / count(*) OVER () END')} AS allocation FROM d""")
def h16(spark, sf):
    m = views.strategy_pnl(spark, sf).groupBy("strategy").agg(F.avg("value").alias("sharpe")).withColumns({"penalty": F.when(F.col("strategy") == "click", 0.9).otherwise(0.1), "adjustment": F.lit(1.0)})
    return rounded(port.allocate(m).select("strategy", "allocation"))


def impact(q: str, adv: str, sigma: str) -> str:
    return f"CASE WHEN {q} > 0 AND {adv} > 0 AND {sigma} > 0 THEN 1e4 * ({sigma} * pow({q} / {adv}, 0.6) + 0.1 * {sigma} * {q} / {adv}) ELSE 0 END"


@query("h17_market_impact_bps", f"SELECT ticker, date, {r(impact('volume', '(volume + 100)', '0.02'))} AS bps FROM bars")
def h17(spark, sf):
    return rounded(views.bars(spark, sf).select("ticker", "date", port.market_impact_bps(F.col("volume"), F.col("volume") + 100, F.lit(0.02)).alias("bps")))


@query("h18_impact_cost", f"WITH t AS (SELECT ticker, date, volume AS trade, volume * 10 AS adv, (high - low) / close AS sigma FROM bars), c AS (SELECT *, {impact('abs(trade)', 'adv', 'sigma')} AS bps FROM t) SELECT date, {r('sum(bps)')} AS bps, {r('sum(abs(trade) * bps / 1e4)')} AS cost FROM c GROUP BY date")
def h18(spark, sf):
    t = views.bars(spark, sf).select("ticker", "date", F.col("volume").alias("trade"), (F.col("volume") * 10).alias("adv"), ((F.col("high") - F.col("low")) / F.col("close")).alias("sigma"))
    return rounded(port.impact_cost(t).groupBy("date").agg(F.sum("bps").alias("bps"), F.sum("cost").alias("cost")))


GRID = [1e6, 1e7, 5e7, 1e8, 5e8, 1e9]


@query("h19_capacity", f"""WITH p AS (SELECT ticker, 0.01 AS turnover, sum(volume * close) / 100 AS adv_usd, 0.02 AS sigma FROM bars GROUP BY 1), g AS (SELECT unnest({GRID}::DOUBLE[]) AS aum), c AS (SELECT aum, sum(turnover * {impact('(turnover * aum)', 'adv_usd', 'sigma')}) AS cost_bps FROM p, g GROUP BY aum),
    s AS (SELECT aum, cost_bps, cost_bps / 50 AS share, cost_bps / 50 > 0.2 AS breached FROM c), b AS (SELECT *, coalesce(max(CAST(breached AS INT)) OVER (ORDER BY aum ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s) SELECT aum, {r('cost_bps')} AS cost_bps, {r('share')} AS share, breached FROM b WHERE before = 0""")
def h19(spark, sf):
    p = views.bars(spark, sf).groupBy("ticker").agg((F.sum(F.col("volume") * F.col("close")) / 100).alias("adv_usd")).withColumns({"turnover": F.lit(0.01), "sigma": F.lit(0.02)})
    return rounded(port.capacity(p, GRID, 50.0))


LIQ = "lq AS (SELECT ticker, avg(volume) OVER (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING) AS adv, close AS price, date FROM bars QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1), liq AS (SELECT ticker, adv, price, adv * price AS adv_usd, 100000 / nullif(adv * price * 0.05, 0) AS days FROM lq)"


@query("h20_liquidity", f"WITH {LIQ} SELECT ticker, {r('adv')} AS adv, {r('price')} AS price, {r('adv_usd')} AS adv_usd, {r('days')} AS days FROM liq WHERE adv_usd >= 20000")
def h20(spark, sf):
    return rounded(port.filter_liquid(port.liquidity(views.bars(spark, sf)), 20_000.0))


@query("h21_capacity_capped_weights", f"""WITH {LIQ}, {NEWEST}, cw AS (SELECT ticker, CASE WHEN CAST(substr(ticker, 7) AS INT) % 2 = 0 THEN 0.01 ELSE -0.01 END AS c FROM sectors), j AS (SELECT coalesce(n.ticker, cw.ticker) AS ticker, coalesce(weight, 0) AS t, coalesce(c, 0) AS c FROM newest n FULL JOIN cw ON n.ticker = cw.ticker),
    k AS (SELECT j.*, coalesce({impact('(abs(t - c) * 1e5)', 'adv_usd', '0.02')} > 50, false) AS capped FROM j LEFT JOIN liq USING (ticker)) SELECT ticker, {r('CASE WHEN capped THEN (t + c) / 2 ELSE t END')} AS weight, capped FROM k""")
def h21(spark, sf):
    cur = views.sectors(spark, sf).select("ticker", F.when(F.substring("ticker", 7, 9).cast("int") % 2 == 0, 0.01).otherwise(-0.01).alias("weight"))
    adv = port.liquidity(views.bars(spark, sf)).select("ticker", "adv_usd", F.lit(0.02).alias("sigma"))
    return rounded(port.capacity_capped_weights(newest(spark, sf), cur, adv, 1e5))


DD = "dd AS (SELECT date, nav, greatest(max(nav) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING), 1e6) AS peak FROM nav), dx AS (SELECT *, (peak - nav) / nullif(peak, 0) AS drawdown FROM dd)"
LEVEL = "CASE WHEN drawdown >= 0.2 THEN 'CRITICAL' WHEN drawdown >= 0.15 THEN 'ALERT' WHEN drawdown >= 0.1 THEN 'WARNING' END"


@query("i01_drawdown_alerts", f"WITH {DD} SELECT date, {r('nav')} AS nav, {r('peak')} AS peak, {r('drawdown')} AS drawdown, {LEVEL} AS level FROM dx WHERE drawdown >= 0.1")
def i01(spark, sf):
    return rounded(risk.drawdown_alerts(views.nav(spark, sf)))


KILL = """kp AS (SELECT {keys}date, nav, coalesce(max(nav) OVER (PARTITION BY {by} ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), nav) AS p FROM {src}), kd AS (SELECT *, (p - nav) / nullif(p, 0) AS d FROM kp), kh AS (SELECT *, max(CAST(d >= 0.2 AS INT)) OVER (PARTITION BY {by} ORDER BY date ROWS UNBOUNDED PRECEDING) = 1 AS halted FROM kd),
    kf AS (SELECT *, coalesce(first_value(CASE WHEN halted THEN p END IGNORE NULLS) OVER (PARTITION BY {by} ORDER BY date ROWS UNBOUNDED PRECEDING), p) AS peak FROM kh), kill AS (SELECT *, (peak - nav) / nullif(peak, 0) AS drawdown FROM kf)"""


@query("i02_kill_switch", f"WITH {KILL.format(keys='', by='1', src='nav')} SELECT date, {r('nav')} AS nav, halted, {r('peak')} AS peak, {r('drawdown')} AS drawdown FROM kill")
def i02(spark, sf):
    return rounded(risk.kill_switch(views.nav(spark, sf)))


SNAV = "snav AS (SELECT strategy, date, value AS nav FROM strategy_pnl)"


@query("i03_kill_switch_by_strategy", f"WITH {SNAV}, {KILL.format(keys='strategy, ', by='strategy', src='snav')} SELECT strategy, bool_or(halted) AS halted, min(date) FILTER (WHERE halted) AS trigger_date, {r('first(drawdown ORDER BY date) FILTER (WHERE halted)')} AS trigger_drawdown FROM kill GROUP BY strategy")
def i03(spark, sf):
    return rounded(risk.kill_switch_by_strategy(views.strategy_pnl(spark, sf).withColumnRenamed("value", "nav")))


@query("i04_enforce_leverage", f"WITH w5 AS (SELECT date, ticker, weight * 10 AS weight FROM weights) SELECT date, ticker, {r('CASE WHEN sum(abs(weight)) OVER (PARTITION BY date) > 2 THEN weight * 2 / sum(abs(weight)) OVER (PARTITION BY date) ELSE weight END')} AS weight FROM w5")
def i04(spark, sf):
    return rounded(risk.enforce_leverage(views.weights(spark, sf).withColumn("weight", F.col("weight") * 10)))


@query("i05_exposure_breaches", f"""WITH {BETAS}, {WS} SELECT date, 'gross' AS rule, '' AS name, {r('sum(abs(weight))')} AS value FROM ws GROUP BY date HAVING sum(abs(weight)) > 0.25 UNION ALL SELECT date, 'single_name', ticker, {r('weight')} FROM ws WHERE abs(weight) > 0.02
    UNION ALL SELECT date, 'sector', sector, {r('sum(abs(weight))')} FROM ws GROUP BY date, sector HAVING sum(abs(weight)) > 0.2 UNION ALL SELECT date, 'factor', factor, {r(units('weight * beta'))} FROM weights JOIN expo USING (ticker) GROUP BY date, factor HAVING abs({units('weight * beta')}) > 0.1""")
def i05(spark, sf):
    return rounded(risk.exposure_breaches(views.weights(spark, sf), views.sectors(spark, sf), expo(spark, sf), 0.25, 0.02, 0.2, 0.1))


@query("i06_risk_cascade", f"""WITH {DD}, {KILL.format(keys='', by='1', src='nav')}, g AS (SELECT date, ticker, CASE WHEN sum(abs(weight)) OVER (PARTITION BY date) > 2 THEN weight * 2 / sum(abs(weight)) OVER (PARTITION BY date) ELSE weight END AS weight FROM weights),
    j AS (SELECT g.date, g.ticker, g.weight, CASE WHEN drawdown_ >= 0.1 THEN level_ END AS level, halted OR drawdown_ >= 0.2 AS blocked FROM g JOIN kill USING (date) JOIN (SELECT date, drawdown AS drawdown_, {LEVEL} AS level_ FROM dx) USING (date))
    SELECT date, ticker, {r('CASE WHEN blocked THEN 0 ELSE greatest(least(weight, 0.02), -0.02) END')} AS weight, blocked, level FROM j""")
def i06(spark, sf):
    return rounded(risk.risk_cascade(views.nav(spark, sf), views.weights(spark, sf), views.sectors(spark, sf)))


@query("i07_factor_exposure_history", f"WITH {BETAS} SELECT date, factor, {r(units('weight * beta'))} AS exposure FROM weights JOIN expo USING (ticker) GROUP BY 1, 2")
def i07(spark, sf):
    return rounded(risk.factor_exposure_history(views.weights(spark, sf), expo(spark, sf)))


@query("i08_stress_test", f"""WITH {BETAS}, sc AS (SELECT unnest(['2008_financial_crisis', '2020_covid_crash', '2022_rate_shock']) AS scenario, unnest([-0.40, -0.35, -0.20]) AS m, unnest([-0.25, -0.15, 0.10]) AS v), e AS (SELECT date AS key, {units('weight * beta', "FILTER (WHERE factor = 'Market')")} AS a, {units('weight * beta', "FILTER (WHERE factor = 'Spread')")} AS b FROM weights JOIN expo USING (ticker) GROUP BY 1),
    s AS (SELECT key, scenario, CAST(CAST(coalesce(CAST(a * m AS DECIMAL(38, 18)), 0) + coalesce(CAST(b * v AS DECIMAL(38, 18)), 0) AS DECIMAL(38, 12)) AS DOUBLE) AS ret FROM e, sc) SELECT key, scenario, {r('ret')} AS ret, {r('abs(least(0, ret))')} AS drawdown FROM s""")
def i08(spark, sf):
    e = risk.factor_exposure_history(views.weights(spark, sf), expo(spark, sf))
    names = F.when(F.col("factor") == "Market", "market").otherwise("value")
    return rounded(risk.stress_test(e.select(F.col("date").alias("key"), names.alias("factor"), "exposure")))


PNL = f"{DD}, pn AS (SELECT *, nav - coalesce(lag(nav) OVER (ORDER BY date), 1e6) AS pnl, (nav - coalesce(lag(nav) OVER (ORDER BY date), 1e6)) / nullif(coalesce(lag(nav) OVER (ORDER BY date), 1e6), 0) AS ret, nav / 1e6 - 1 AS cum_ret FROM dx)"


@query("i09_pnl_series", f"WITH {PNL} SELECT date, {r('nav')} AS nav, {r('peak')} AS peak, {r('drawdown')} AS drawdown, {r('pnl')} AS pnl, {r('ret')} AS ret, {r('cum_ret')} AS cum_ret FROM pn")
def i09(spark, sf):
    return rounded(risk.pnl_series(views.nav(spark, sf)))


SUM = """cc AS (SELECT strategy, date, ret, product(1 + ret) OVER (PARTITION BY strategy ORDER BY date ROWS UNBOUNDED PRECEDING) AS c FROM sr), cm AS (SELECT *, greatest(1, max(c) OVER (PARTITION BY strategy ORDER BY date ROWS UNBOUNDED PRECEDING)) AS m FROM cc),
    su AS (SELECT strategy, product(1 + ret) - 1 AS total, avg(ret) * 252 AS annual, stddev_samp(ret) * sqrt(252) AS volatility, coalesce(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252), 0) AS sharpe, max(1 - c / m) AS max_drawdown, count(*) AS n FROM cm GROUP BY strategy)"""


@query("i10_pnl_summary", f"WITH {SR}, {SUM} SELECT strategy, " + ", ".join(f"{r(c)} AS {c}" for c in ("total", "annual", "volatility", "sharpe", "max_drawdown")) + ", n FROM su")
def i10(spark, sf):
    return rounded(risk.pnl_summary(strategy_returns(spark, sf)))


SNAP = f"""{WS}, tp AS (SELECT date, ticker, weight, row_number() OVER (PARTITION BY date ORDER BY abs(weight) DESC, ticker) AS k FROM ws), snap AS (SELECT date, 'gross' AS kind, '' AS name, sum(abs(weight)) AS value FROM ws GROUP BY date UNION ALL SELECT date, 'net', '', sum(weight) FROM ws GROUP BY date
    UNION ALL SELECT date, 'sector', sector, sum(weight) FROM ws GROUP BY date, sector UNION ALL SELECT date, 'top', ticker, weight FROM tp WHERE k <= 10)"""


@query("i11_risk_snapshot", f"WITH {SNAP} SELECT date, kind, name, {r('value')} AS value FROM snap")
def i11(spark, sf):
    return rounded(risk.risk_snapshot(views.weights(spark, sf), views.sectors(spark, sf)))


@query("i12_historical_var", f"""WITH {NEWEST}, d AS (SELECT date, sum(weight * ret) AS r, count(*) AS k FROM returns JOIN newest USING (ticker) GROUP BY date), f AS (SELECT r FROM d WHERE k = (SELECT count(*) FROM newest)) SELECT count(*) AS n, {r('-quantile_cont(r, 0.05)')} AS var_95, {r('-quantile_cont(r, 0.01)')} AS var_99 FROM f""")
def i12(spark, sf):
    return rounded(risk.historical_var(newest(spark, sf), views.returns(spark, sf)))


@query("i13_risk_limit_breaches", f"WITH {SNAP} SELECT date, kind, name, {r('value')} AS value FROM snap WHERE kind = 'gross' AND abs(value) > 0.25 OR kind = 'sector' AND abs(value) > 0.08")
def i13(spark, sf):
    return rounded(risk.risk_limit_breaches(risk.risk_snapshot(views.weights(spark, sf), views.sectors(spark, sf)), 0.25, 0.08))


@query("i14_performance", f"WITH {SR}, {SUM} SELECT strategy, {r('sharpe')} AS sharpe, {r('max_drawdown')} AS max_drawdown, {r('coalesce(annual / nullif(max_drawdown, 0), 0)')} AS calmar FROM su")
def i14(spark, sf):
    return rounded(risk.performance(strategy_returns(spark, sf)))


@query("i14_rolling_sharpe", f"WITH q AS (SELECT ticker, date, ret, row_number() OVER w AS n, avg(ret) OVER v AS m, stddev_samp(ret) OVER v AS s FROM returns WINDOW w AS (PARTITION BY ticker ORDER BY date), v AS (PARTITION BY ticker ORDER BY date ROWS 62 PRECEDING)) SELECT ticker, date, {r('CASE WHEN n >= 63 THEN CASE WHEN s > 0 THEN m / s * sqrt(252) ELSE 0 END END')} AS rolling_sharpe FROM q")
def i14_rolling(spark, sf):
    return rounded(risk.rolling_sharpe(views.returns(spark, sf), key="ticker").drop("ret"))


@query("i15_deflated_sharpe")
def i15(spark, sf):
    return rounded(risk.deflated_sharpe(strategy_returns(spark, sf), 20))


def blocks_sql(b: int, block: int, level: float = 0.95, seed: int = 17) -> str:
    tail, u = (1 - level) / 2, mixed_sql("nm", "i")
    return f"""WITH {SR}, bl AS (SELECT * FROM (SELECT strategy, date, sum(ret) OVER a AS x, count(*) OVER a AS size, row_number() OVER (PARTITION BY strategy ORDER BY date) AS k, {name_sql(seed, 'strategy', 'date')} AS nm FROM sr
        WINDOW a AS (PARTITION BY strategy ORDER BY date ROWS BETWEEN CURRENT ROW AND {block - 1} FOLLOWING)) WHERE size = {block} OR k = 1),
    dr AS (SELECT strategy, x, size, i, {u} AS u FROM bl, (SELECT unnest(range(1, {b} + 1)) AS i)), dw AS (SELECT *, {weight_sql('u', 1.0 / block)} AS w FROM dr), m AS (SELECT strategy, i, sum(w * x) / nullif(sum(w * size), 0) AS m FROM dw GROUP BY 1, 2)
    SELECT strategy, {r(f'quantile_cont(m, {tail})')} AS low, {r(f'quantile_cont(m, {1 - tail})')} AS high FROM m GROUP BY 1"""


@query("i16_bootstrap_ci", blocks_sql(1000, 1))
def i16_ci(spark, sf):
    return rounded(risk.bootstrap_ci(strategy_returns(spark, sf), 1000))


@query("i16_block_bootstrap", blocks_sql(1000, 5))
def i16(spark, sf):
    return rounded(risk.block_bootstrap(strategy_returns(spark, sf), 1000, 5))


def scores(spark, sf) -> DataFrame:
    return wide(spark, sf).select("date", "ticker", F.col("mom").alias("score"))


BT = """wd AS (SELECT date, ticker, max(score) FILTER (WHERE signal = 'mom') AS score FROM signals JOIN fwd USING (date, ticker) GROUP BY 1, 2 HAVING count(*) = 3), dk AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS k FROM (SELECT DISTINCT date FROM wd)),
    c0 AS (SELECT date, k, ticker, percent_rank() OVER (PARTITION BY date ORDER BY score) - 0.5 AS c FROM wd JOIN dk USING (date) WHERE k % {f} = 0), bw AS (SELECT ticker, k // {f} AS r, coalesce(c / nullif(CAST(CAST(sum(CAST(abs(c) AS DECIMAL(38, 18))) OVER (PARTITION BY date) AS DECIMAL(38, 12)) AS DOUBLE), 0), 0) AS w FROM c0),
    nx AS (SELECT ticker, date, lead(close) OVER (PARTITION BY ticker ORDER BY date) / close - 1 AS nx FROM bars), gr AS (SELECT date, k, k // {f} AS r, CAST(CAST(sum(CAST(w * coalesce(nx, 0) AS DECIMAL(38, 18))) AS DECIMAL(38, 12)) AS DOUBLE) AS gross_ret FROM dk JOIN bw ON bw.r = dk.k // {f} LEFT JOIN nx USING (ticker, date) GROUP BY 1, 2, 3),
    tu AS (SELECT r, CAST(CAST(sum(CAST(d AS DECIMAL(38, 18))) AS DECIMAL(38, 12)) AS DOUBLE) AS turnover FROM (SELECT coalesce(a.r, b.r + 1) AS r, abs(coalesce(a.w, 0) - coalesce(b.w, 0)) AS d FROM bw a FULL JOIN bw b ON a.ticker = b.ticker AND a.r = b.r + 1) GROUP BY 1),
    bt AS (SELECT date, gross_ret, CASE WHEN k % {f} = 0 THEN coalesce(turnover, 0) ELSE 0 END AS turnover FROM gr LEFT JOIN tu USING (r)), bn AS (SELECT *, turnover * 5 / 1e4 AS cost, gross_ret - turnover * 5 / 1e4 AS ret FROM bt)"""


@query("i17_backtest", f"WITH {BT.format(f=5)} SELECT date, {r('gross_ret')} AS gross_ret, {r('turnover')} AS turnover, {r('cost')} AS cost, {r('ret')} AS ret, nav > 0 AS solvent, {r('CASE WHEN nav > 0 THEN ln(nav) END')} AS log_nav FROM (SELECT *, product(greatest(1 + ret, 0)) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS nav FROM bn)")
def i17(spark, sf):
    """The path of the account; its value as a logarithm, which has the same digits however large it grows."""
    b = risk.backtest(scores(spark, sf), views.bars(spark, sf), 5.0, 5)
    alive = F.col("nav") > 0
    return rounded(b.select("date", "gross_ret", "turnover", "cost", "ret", alive.alias("solvent"), F.when(alive, F.log("nav")).alias("log_nav")))


def sweep_sql(costs: tuple[float, ...], freqs: tuple[int, ...]) -> str:
    """The backtest and its summary for each point, one below the other."""
    def point(c: float, f: int) -> str:
        body = BT.format(f=f).replace("turnover * 5 / 1e4", f"turnover * {c} / 1e4")
        return f"""SELECT md5('{{"cost_bps":{c},"freq":{f}}}') AS point_id, {c}::DOUBLE AS cost_bps, {f} AS freq, coalesce(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252), 0) AS sharpe, product(1 + ret) - 1 AS total, max(1 - c / m) AS max_drawdown
            FROM (WITH {body}, cu AS (SELECT date, ret, product(1 + ret) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS c FROM bn) SELECT date, ret, c, greatest(1.0, max(c) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)) AS m FROM cu)"""

    points = " UNION ALL ".join(point(c, f) for c in costs for f in freqs)
    return f"WITH p AS ({points}) SELECT point_id, cost_bps, freq, {r('sharpe')} AS sharpe, {r('total')} AS total, {r('max_drawdown')} AS max_drawdown, CAST(row_number() OVER (ORDER BY sharpe DESC, point_id) AS INT) AS rank FROM p"


@query("i18_parameter_sweep", sweep_sql((1.0, 5.0), (1, 5)))
def i18(spark, sf):
    return rounded(risk.parameter_sweep(scores(spark, sf), views.bars(spark, sf), [{"cost_bps": c, "freq": f} for c in (1.0, 5.0) for f in (1, 5)]))


@query("i19_research_cycle")
def i19(spark, sf):
    """Features to ranked, combined signals with their evaluation, in one plan."""
    from ..operators.signals import combine_signals, evaluate_signals_batch

    s = views.signals(spark, sf)
    x = Window.partitionBy("date", "signal")
    ranked = s.withColumn("score", F.percent_rank().over(x.orderBy("score")) - 0.5)
    both = combine_signals(ranked, {"mom": 1.0, "rev": 1.0, "vol": 1.0}).withColumn("signal", F.lit("combined"))
    return rounded(evaluate_signals_batch(ranked.unionByName(both.select(*ranked.columns)), views.fwd(spark, sf)))


POS = "pos AS (SELECT ticker, sum(CASE WHEN side = 'buy' THEN filled ELSE -filled END) AS qty FROM orders_t GROUP BY ticker), lastpx AS (SELECT ticker, close AS px FROM bars QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1)"


def positions(spark, sf, only: str = "true") -> DataFrame:
    signed = F.when(F.col("side") == "buy", F.col("filled")).otherwise(-F.col("filled"))
    return views.orders_t(spark, sf).filter(only).groupBy("ticker").agg(F.sum(signed).alias("qty"))


def last_px(spark, sf) -> DataFrame:
    return views.bars(spark, sf).groupBy("ticker").agg(F.max_by("close", "date").alias("px"))


@query("j01_generate_orders", f"""WITH {NEWEST}, {POS}, d AS (SELECT ticker, px, round_even((coalesce(weight, 0) * 1e7 / px - coalesce(qty, 0)), 0) AS d FROM newest FULL JOIN pos USING (ticker) JOIN lastpx USING (ticker) WHERE px > 0) SELECT ticker, CASE WHEN d > 0 THEN 'buy' ELSE 'sell' END AS side, CAST(abs(d) AS BIGINT) AS quantity, round(abs(d) * px, 4) + 0.0 AS value FROM d WHERE abs(d) >= 1 AND abs(d) * px >= 1000""")
def j01(spark, sf):
    return rounded(ex.generate_orders(newest(spark, sf), positions(spark, sf), last_px(spark, sf), 1e7), 4)


@query("j02_liquidation_orders", f"WITH {POS} SELECT ticker, CASE WHEN qty > 0 THEN 'sell' ELSE 'buy' END AS side, CAST(abs(qty) AS BIGINT) AS quantity FROM pos JOIN lastpx USING (ticker) WHERE qty <> 0 AND px > 0")
def j02(spark, sf):
    return ex.liquidation_orders(positions(spark, sf), last_px(spark, sf))


SAFE = "so AS (SELECT order_id, ticker, side, CASE WHEN target % 3 = 0 THEN 'limit' ELSE 'market' END AS order_type, target * 10 - 20 AS quantity, decision_px * (1 + (filled - 25) / 400) AS limit_price, fill_px AS mid, 1e7 AS nav, filled * 80 AS adv, filled - 25 AS position, 3e5 AS cash FROM orders_t)"


def safe_orders(spark, sf) -> DataFrame:
    c = F.col
    return views.orders_t(spark, sf).select("order_id", "ticker", "side", F.when(c("target") % 3 == 0, "limit").otherwise("market").alias("order_type"), (c("target") * 10 - 20).alias("quantity"), (c("decision_px") * (1 + (c("filled") - 25) / 400)).alias("limit_price"), c("fill_px").alias("mid"), F.lit(1e7).alias("nav"), (c("filled") * 80).alias("adv"), (c("filled") - 25).alias("position"), F.lit(3e5).alias("cash"))


@query("j03_order_safety_report", f"""WITH {SAFE}, l AS (SELECT order_id, unnest(list_filter([CASE WHEN quantity <= 0 THEN 'quantity_positive' END, CASE WHEN trim(coalesce(ticker, '')) = '' THEN 'ticker_valid' END, CASE WHEN quantity > 1e6 THEN 'max_shares' END, CASE WHEN mid > 0 AND quantity * mid > 0.05 * nav THEN 'max_pct_nav' END,
    CASE WHEN adv > 0 AND quantity > 0.1 * adv THEN 'max_pct_adv' END, CASE WHEN position <> 0 AND abs(quantity) > 10 * abs(position) THEN 'fat_finger' END, CASE WHEN order_type = 'limit' AND mid > 0 AND abs(limit_price - mid) > 0.05 * mid THEN 'limit_price_sanity' END,
    CASE WHEN side = 'buy' AND mid > 0 AND quantity * mid > cash THEN 'buying_power' END], lambda x: x IS NOT NULL)) AS "check" FROM so) SELECT "check", count(*) AS n FROM l GROUP BY 1""")
def j03(spark, sf):
    return ex.order_safety_report(safe_orders(spark, sf)).groupBy("check").agg(F.count("*").alias("n"))


GREEDY = """o AS (SELECT ticker, side, target AS quantity, epoch(ts) AS t FROM orders_t),
    dk AS (SELECT *, row_number() OVER (PARTITION BY ticker, side, quantity ORDER BY t) AS k FROM o),
    dn AS (SELECT *, min(k) OVER (PARTITION BY ticker, side, quantity ORDER BY t RANGE BETWEEN 60 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM dk),
    du AS (WITH RECURSIVE w AS (SELECT ticker, side, quantity, nxt FROM dn WHERE k = 1 UNION ALL SELECT d.ticker, d.side, d.quantity, d.nxt FROM w JOIN dn d ON d.ticker = w.ticker AND d.side = w.side AND d.quantity = w.quantity AND d.k = w.nxt)
        SELECT ticker, count(*) AS accepted FROM w GROUP BY ticker),
    rk AS (SELECT ticker, t, row_number() OVER (PARTITION BY ticker ORDER BY t) AS k FROM o),
    ra AS (WITH RECURSIVE w AS (SELECT ticker, k, [t] AS s, 0 AS limited FROM rk WHERE k = 1 UNION ALL
        SELECT n.ticker, n.k, CASE WHEN len(s) < 5 OR n.t - s[1] >= 1 THEN list_append(s, n.t)[-5:] ELSE s END, CASE WHEN len(s) < 5 OR n.t - s[1] >= 1 THEN 0 ELSE 1 END FROM w JOIN rk n ON n.ticker = w.ticker AND n.k = w.k + 1)
        SELECT ticker, count(*) AS n, sum(limited) AS limited FROM w GROUP BY ticker)"""


@query("j04_order_rate_and_duplicate_flags", f"WITH {GREEDY} SELECT ticker, n, CAST(limited AS BIGINT) AS rate_limited, n - accepted AS duplicates FROM ra JOIN du USING (ticker)")
def j04(spark, sf):
    o = views.orders_t(spark, sf).select("order_id", "ticker", "side", F.col("target").alias("quantity"), F.col("ts").cast("timestamp").alias("ts"))
    return ex.order_rate_and_duplicate_flags(o).groupBy("ticker").agg(F.count("*").alias("n"), F.sum(F.col("rate_limited").cast("int")).alias("rate_limited"), F.sum(F.col("duplicate").cast("int")).alias("duplicates"))


@query("j05_route_algo", "SELECT order_id, count(*) AS n, max(CASE WHEN filled = 50 THEN 'twap' WHEN target > 0.01 * filled * 99 THEN 'vwap' ELSE 'direct' END) AS route FROM orders_t GROUP BY order_id")
def j05(spark, sf):
    o = views.orders_t(spark, sf)
    route = ex.route_algo(F.when(F.col("filled") == 50, "TWAP").otherwise("market"), F.col("target"), F.col("filled") * 99)
    return o.select("order_id", route.alias("route")).groupBy("order_id").agg(F.count("*").alias("n"), F.max("route").alias("route"))


PARENT = "par AS (SELECT ticker || '-' || date AS order_id, CAST(volume * 40 AS BIGINT) AS quantity, volume * 700 AS adv, volume FROM bars)"


def parents(spark, sf) -> DataFrame:
    return views.bars(spark, sf).select(F.concat_ws("-", "ticker", F.col("date").cast("string")).alias("order_id"), (F.col("volume") * 40).cast("long").alias("quantity"), (F.col("volume") * 700).alias("adv"), "volume")


PROFILE = ex.VOLUME_PROFILE


@query("j06_vwap_schedule", f"""WITH {PARENT}, e AS (SELECT *, CAST(CASE WHEN floor(adv * 0.05) > 0 THEN least(quantity, floor(adv * 0.05)) ELSE quantity END AS DOUBLE) AS e FROM par), s AS (SELECT order_id, quantity, e, CAST(i AS INT) AS slice, greatest(least(floor(e * ({[p / sum(PROFILE) for p in PROFILE]}::DOUBLE[])[i + 1]), floor(quantity * 0.2)), 0) AS t FROM e, (SELECT unnest(range(13)) AS i))
    SELECT order_id, slice, CAST(t + CASE WHEN slice = 12 THEN greatest(e - sum(t) OVER (PARTITION BY order_id), 0) ELSE 0 END AS BIGINT) AS target FROM s""")
def j06(spark, sf):
    return ex.vwap_schedule(parents(spark, sf)).select("order_id", "slice", "target")


@query("j07_twap_schedule", f"WITH {PARENT} SELECT order_id, CAST(i AS INT) AS slice, quantity // 10 + CASE WHEN i < quantity % 10 THEN 1 ELSE 0 END AS target, CAST(i * 360 AS DOUBLE) AS at_seconds FROM par, (SELECT unnest(range(10)) AS i)")
def j07(spark, sf):
    return ex.twap_schedule(parents(spark, sf)).select("order_id", "slice", "target", "at_seconds")


@query("j08_allocate_fills_to_slices", f"""WITH {PARENT}, s AS (SELECT order_id, CAST(i AS INT) AS slice, CAST(volume * 13 AS BIGINT) AS got, quantity // 10 + CASE WHEN i < quantity % 10 THEN 1 ELSE 0 END AS target FROM par, (SELECT unnest(range(10)) AS i))
    SELECT order_id, slice, target, CAST(least(target, greatest(got - coalesce(sum(target) OVER (PARTITION BY order_id ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)) AS BIGINT) AS filled FROM s""")
def j08(spark, sf):
    p = parents(spark, sf)
    fills = p.select("order_id", (F.col("volume") * 13).cast("long").alias("filled"))
    return ex.allocate_fills_to_slices(ex.twap_schedule(p).select("order_id", "slice", "target"), fills)


STATE = "ls AS (SELECT order_id, side, fill_px AS mid, filled % 20 AS spread_bps, l / 8.0 AS elapsed, filled / 100 AS filled, CAST(target * 10 AS BIGINT) AS remaining, CAST(target % 7 AS INT) AS slices_left, filled * 20 AS adv, filled * 3 AS depth FROM (SELECT *, CAST(substr(strategy, 3) AS INT) * 2 AS l FROM orders_t))"


@query("j09_liquidity_seeking_decision", f"""WITH {STATE}, u AS (SELECT *, CASE WHEN elapsed <= 0 THEN 'LOW' WHEN elapsed - filled > 0.3 AND elapsed > 0.7 THEN 'CRITICAL' WHEN elapsed - filled > 0.2 OR elapsed > 0.7 THEN 'HIGH' WHEN elapsed - filled > 0.1 THEN 'MEDIUM' ELSE 'LOW' END AS urgency FROM ls),
    b AS (SELECT *, least(least(floor(remaining / greatest(slices_left, 1)), CASE WHEN adv > 0 THEN floor(adv * 0.1) ELSE 1e18 END), CASE WHEN depth > 0 THEN floor(depth * 0.5) ELSE 1e18 END) AS base FROM u), c AS (SELECT *, CASE urgency WHEN 'CRITICAL' THEN floor(base * 1.5) WHEN 'HIGH' THEN floor(base * 1.2) ELSE base END AS boosted FROM b)
    SELECT order_id, mid, urgency, CASE WHEN urgency = 'CRITICAL' OR urgency = 'HIGH' AND spread_bps <= 10 THEN 'market' ELSE 'limit' END AS order_type, CAST(CASE WHEN remaining <= 0 OR slices_left <= 0 THEN 0 ELSE greatest(1, least(boosted, remaining)) END AS BIGINT) AS child_size FROM c""")
def j09(spark, sf):
    c = F.col
    s = views.orders_t(spark, sf).select("order_id", "side", c("fill_px").alias("mid"), (c("filled") % 20).alias("spread_bps"), (F.substring("strategy", 3, 1).cast("int") * 2 / 8.0).alias("elapsed"), (c("filled") / 100).alias("filled"), (c("target") * 10).cast("long").alias("remaining"), (c("target") % 7).cast("int").alias("slices_left"), (c("filled") * 20).alias("adv"), (c("filled") * 3).alias("depth"))
    return ex.liquidity_seeking_decision(s).select("order_id", "mid", "urgency", "order_type", "child_size")


QT = "qt AS (SELECT ticker, date AS ts, low AS bid, high AS ask FROM bars)"


def quotes(spark, sf) -> DataFrame:
    return views.bars(spark, sf).select("ticker", F.col("date").alias("ts"), F.col("low").alias("bid"), F.col("high").alias("ask"))


@query("j10_spread_by_ticker", f"WITH {QT}, s AS (SELECT *, (ask - bid) / ((bid + ask) / 2) * 1e4 AS s FROM qt) SELECT ticker, {r('avg(s)')} AS quoted, {r('avg(s) / 2')} AS effective, {r('avg(s) * 0.3')} AS realised, {r('last((bid + ask) / 2 ORDER BY ts)')} AS last_mid FROM s GROUP BY ticker")
def j10(spark, sf):
    return rounded(ex.spread_by_ticker(quotes(spark, sf)))


@query("j10_mean_valid_spread", f"WITH {QT} SELECT ticker, {r('avg((ask - bid) / ((bid + ask) / 2) * 1e4)')} AS spread FROM qt GROUP BY ticker")
def j10_mean(spark, sf):
    return rounded(ex.mean_valid_spread(quotes(spark, sf)))


@query("j11_roll_spread", f"WITH l AS (SELECT ticker, ret, lag(ret) OVER (PARTITION BY ticker ORDER BY date) AS b FROM returns), a AS (SELECT ticker, count(*) AS n, {corr_sql('b', 'CASE WHEN b IS NOT NULL THEN ret END').replace('stddev_pop(b)', 'stddev_pop(b)')} * var_samp(ret) AS c FROM l GROUP BY ticker) SELECT ticker, {r('CASE WHEN n >= 20 AND c < 0 THEN 2 * sqrt(CASE WHEN c < 0 THEN -c END) * 1e4 ELSE 0 END')} AS spread_bps FROM a")
def j11(spark, sf):
    return rounded(ex.roll_spread(views.returns(spark, sf)))


@query("j12_vpin", f"WITH t AS (SELECT ticker, volume, CASE WHEN close - lag(close) OVER (PARTITION BY ticker ORDER BY date) < 0 THEN -1 ELSE 1 END AS s FROM bars) SELECT ticker, {r('CASE WHEN count(*) >= 50 THEN coalesce(abs(sum(s * volume)) / nullif(sum(volume), 0), 0) ELSE 0 END')} AS vpin FROM t GROUP BY ticker")
def j12(spark, sf):
    return rounded(ex.vpin(views.bars(spark, sf).select("ticker", F.col("date").alias("k"), F.col("close").alias("px"), "volume")))


@query("j13_adverse_and_impact", f"WITH {QT}, s AS (SELECT ticker, avg((ask - bid) / ((bid + ask) / 2) * 1e4) / 2 AS e FROM qt GROUP BY ticker) SELECT ticker, {r('greatest(0, e - 0.6 * e)')} AS component, {r('greatest(0, e - 0.6 * e) * 1.3')} AS impact FROM s")
def j13(spark, sf):
    c = ex.adverse_component(F.col("effective"), F.col("realised"))
    return rounded(ex.spread_by_ticker(quotes(spark, sf)).select("ticker", c.alias("component"), ex.permanent_impact(c, F.lit(0.3)).alias("impact")))


@query("j14_flow_toxicity", f"WITH x AS (SELECT r.ticker, r.date, ret, volume, coalesce(lead(ret) OVER (PARTITION BY r.ticker ORDER BY r.date), 0) AS n FROM returns r JOIN bars b ON b.ticker = r.ticker AND b.date = r.date) SELECT ticker, {r('greatest(0, least(1, coalesce(sum(abs(sign(ret) * volume * sign(n))) / nullif(sum(abs(volume)), 0), 0)))')} AS toxicity FROM x GROUP BY ticker")
def j14(spark, sf):
    return rounded(ex.flow_toxicity(views.returns(spark, sf).join(views.bars(spark, sf).select("ticker", "date", "volume"), ["ticker", "date"])))


@query("j15_fill_probability", f"""WITH o AS (SELECT order_id, fill_px, CASE WHEN side = 'buy' THEN fill_px - lp ELSE lp - fill_px END / fill_px * 1e4 AS d, filled AS size, target * 2 AS depth FROM (SELECT *, fill_px * (1 + (filled - 25) / 10000) AS lp FROM orders_t)),
    p AS (SELECT order_id, fill_px, round(d, 6) AS d, greatest(0, least(0.99, CASE WHEN d < 0 THEN least(0.99, 0.95 + abs(d) / 1000) ELSE 1 / (1 + exp(0.5 * d - 1)) END * CASE WHEN depth > 0 AND size > 0 THEN exp(-0.3 * size / depth) ELSE 1 END)) AS p FROM o) SELECT order_id, {r('fill_px')} AS fill_px, {r('p')} AS fill_prob, {r('p * 0.9 + least(0.99, p + (1 - p) * 0.3) * 0.1')} AS expected_pct FROM p""")
def j15(spark, sf):
    c = F.col
    o = views.orders_t(spark, sf).select("order_id", "fill_px", "side", (c("fill_px") * (1 + (c("filled") - 25) / 10000)).alias("limit_price"), c("fill_px").alias("mid"), c("filled").alias("size"), (c("target") * 2).alias("depth"))
    return rounded(ex.fill_probability(o).select("order_id", "fill_px", "fill_prob", "expected_pct"))


@query("j16_optimal_limit_offset", f"SELECT ticker, date, {r('(high - low) / 2 * (1 - 2 * greatest(0, least(1, volume / 40)))')} AS offset_bps FROM bars")
def j16(spark, sf):
    return rounded(views.bars(spark, sf).select("ticker", "date", ex.optimal_limit_offset(F.col("high") - F.col("low"), F.col("volume") / 40).alias("offset_bps")))


LEVELS = """lv AS (SELECT ticker, CASE WHEN l_returnflag = 'A' THEN 'bid' ELSE 'ask' END AS side, l_suppkey AS level, sum(l_quantity) AS size, CASE WHEN l_returnflag = 'A' THEN 1000.0 - l_suppkey ELSE 1000.0 + l_suppkey END AS px FROM trades GROUP BY ALL),
    bk AS (SELECT ticker, side, CAST(row_number() OVER (PARTITION BY ticker, side ORDER BY abs(px - 1000)) AS INT) AS level, px, sum(size) AS size FROM lv GROUP BY ticker, side, px)"""


def book(spark, sf) -> DataFrame:
    t = views.trades(spark, sf)
    bid = F.col("l_returnflag") == "A"
    px = F.when(bid, 1000.0 - F.col("l_suppkey")).otherwise(1000.0 + F.col("l_suppkey"))
    lv = t.select("ticker", F.when(bid, "bid").otherwise("ask").alias("side"), px.alias("px"), "l_quantity").groupBy("ticker", "side", "px").agg(F.sum("l_quantity").alias("size"))
    return lv.withColumn("level", F.row_number().over(Window.partitionBy("ticker", "side").orderBy(F.abs(F.col("px") - 1000)))).withColumn("mid", F.lit(1000.0))


@query("j17_book_snapshot", f"""WITH {LEVELS} SELECT ticker, sum(size) FILTER (WHERE side = 'bid') AS bid_depth, sum(size) FILTER (WHERE side = 'ask') AS ask_depth, count(*) FILTER (WHERE side = 'bid') AS bid_levels, count(*) FILTER (WHERE side = 'ask') AS ask_levels, max(size) FILTER (WHERE side = 'bid' AND level = 1) AS top_bid, max(size) FILTER (WHERE side = 'ask' AND level = 1) AS top_ask,
    {r('(coalesce(sum(size) FILTER (WHERE side = $$bid$$), 0) - coalesce(sum(size) FILTER (WHERE side = $$ask$$), 0)) / nullif(sum(size), 0)')} AS imbalance FROM bk GROUP BY ticker""")
def j17(spark, sf):
    return rounded(ex.book_snapshot(book(spark, sf)).drop("cost_bps"))


def sides(spark, sf) -> DataFrame:
    """Each side of a ticker's book as a book of its own."""
    return book(spark, sf).withColumn("ticker", F.concat_ws("/", "ticker", "side")).drop("side")


SIDES = f"{LEVELS}, sd AS (SELECT ticker || '/' || side AS ticker, side, px, size, level FROM bk)"


@query("j18_cost_to_trade", f"""WITH {SIDES}, a AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY ticker ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sd), c AS (SELECT ticker, sum(least(size, greatest(500 - before, 0)) * abs(px - 1000)) AS c, sum(size) AS depth, last(abs(px - 1000) ORDER BY level) AS far FROM a GROUP BY ticker)
    SELECT ticker, {r('(c + greatest(500 - depth, 0) * far * 2) / 500 / 1000 * 1e4')} AS cost_bps FROM c""")
def j18(spark, sf):
    b = sides(spark, sf)
    return rounded(ex.cost_to_trade(b, b.select("ticker").distinct().withColumn("order_size", F.lit(500.0))))


@query("j19_book_from_summary", f"SELECT ticker, date, {r('(open - close) / nullif(open + close, 0)')} AS imbalance, {r('(high - low) / ((low + high) / 2) * 5000 + pow(100000 / ((low + high) / 2) / (volume * 100), 0.6) * 100')} AS cost_bps FROM bars")
def j19(spark, sf):
    q = views.bars(spark, sf).select("ticker", "date", F.col("low").alias("bid"), F.col("high").alias("ask"), F.col("open").alias("bid_size"), F.col("close").alias("ask_size"), (F.col("volume") * 100).alias("adv"))
    return rounded(ex.book_from_summary(q).select("ticker", "date", "imbalance", "cost_bps"))


@query("j20_queue_position", f"SELECT ticker, date, {r('(volume * 3 + volume) / (volume % 7)')} AS wait_s, {r('coalesce(exp(-0.01 * (volume * 3 + volume) / (volume % 7)), 0)')} AS fill_prob, CAST(floor(volume * 3 / greatest(volume, 1)) + 1 AS BIGINT) AS position FROM bars WHERE volume % 7 > 0 UNION ALL SELECT ticker, date, NULL, 0, CAST(floor(volume * 3) + 1 AS BIGINT) FROM bars WHERE volume % 7 = 0")
def j20(spark, sf):
    o = views.bars(spark, sf).select("ticker", "date", F.col("volume").alias("size"), (F.col("volume") * 3).alias("depth_ahead"), (F.col("volume") % 7).alias("rate"))
    return rounded(ex.queue_position(o).select("ticker", "date", "wait_s", "fill_prob", "position"))


@query("j20_depth_ahead", f"WITH {SIDES}, c AS (SELECT ticker, px, sum(size) OVER (PARTITION BY ticker ORDER BY level ROWS UNBOUNDED PRECEDING) AS cum FROM sd) SELECT ticker AS order_id, coalesce(min(cum) FILTER (WHERE px = CASE WHEN ticker LIKE '%/bid' THEN 997 ELSE 1003 END), max(cum)) AS depth_ahead FROM c GROUP BY ticker")
def j20_depth(spark, sf):
    b = sides(spark, sf)
    limit = F.when(F.col("ticker").endswith("/bid"), 997.0).otherwise(1003.0)
    return ex.depth_ahead(b, b.select("ticker").distinct().select("ticker", F.col("ticker").alias("order_id"), limit.alias("limit_price")))


@query("j21_estimate_fills", f"""WITH o AS (SELECT order_id, ticker, side, CAST(target AS BIGINT) AS q, CASE WHEN target % 2 = 0 THEN 'limit' ELSE 'market' END AS ot, decision_px AS lp FROM orders_t), m AS (SELECT ticker, close AS mid, volume * 30 AS adv FROM bars QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1),
    f AS (SELECT *, CASE WHEN side = 'buy' THEN 1 ELSE -1 END AS s, mid * (1 + CASE WHEN side = 'buy' THEN 1 ELSE -1 END * (5 + least(500, 2 * pow(q / adv, 0.6) * 1e4)) / 1e4) AS px FROM o JOIN m USING (ticker)),
    g AS (SELECT *, CAST(CASE WHEN q > adv * 0.01 THEN greatest(1, floor(q * least(1.0, adv * 0.01 / q))) ELSE q END AS BIGINT) AS qty FROM f WHERE NOT (ot = 'limit' AND s * (px - lp) > 0)) SELECT ticker, side, count(*) AS n, sum(qty)::BIGINT AS fill_qty, {r('max(px)')} AS fill_px, {r('CAST(sum(qty) AS DOUBLE) * 0.005::DOUBLE')} AS commission FROM g GROUP BY 1, 2""")
def j21(spark, sf):
    c = F.col
    o = views.orders_t(spark, sf).select("order_id", "ticker", "side", c("target").cast("long").alias("quantity"), F.when(c("target") % 2 == 0, "limit").otherwise("market").alias("order_type"), c("decision_px").alias("limit_price"))
    q = views.bars(spark, sf).groupBy("ticker").agg(F.max_by(F.struct(c("close").alias("mid"), (c("volume") * 30).alias("adv")), "date").alias("r")).select("ticker", "r.*")
    f = ex.estimate_fills(o, q)
    return rounded(f.groupBy("ticker", "side").agg(F.count("*").alias("n"), F.sum("fill_qty").alias("fill_qty"), F.max("fill_px").alias("fill_px"), F.sum("commission").alias("commission")))


LEDGER = "lf AS (SELECT ticker, date, order_id, CASE WHEN side = 'buy' THEN filled ELSE -filled END AS s, fill_px, filled * 0.005 AS c FROM orders_t)"


@query("j22_position_ledger", f"WITH {LEDGER} SELECT ticker, sum(s) AS position, round(sum(s * fill_px + c), 4) + 0.0 AS spent, max(p) AS highest FROM (SELECT *, sum(s) OVER (PARTITION BY ticker ORDER BY date RANGE UNBOUNDED PRECEDING) AS p FROM lf) GROUP BY ticker")
def j22(spark, sf):
    c = F.col
    f = views.orders_t(spark, sf).select("ticker", "date", c("order_id").alias("k"), "side", c("filled").alias("qty"), c("fill_px").alias("px"), (c("filled") * 0.005).alias("commission"))
    led = ex.position_ledger(f)
    day = Window.partitionBy("ticker", "date")
    last = led.withColumn("n", F.count("*").over(day)).withColumn("j", F.row_number().over(day.orderBy("k"))).filter("j = n")
    return last.groupBy("ticker").agg(F.max_by("position", "date").alias("position"), half_up(F.max_by("spent", "date"), 4).alias("spent"), F.max("position").alias("highest"))


QUAL = "ql AS (SELECT *, CASE WHEN side = 'buy' THEN 1 ELSE -1 END * (fill_px - decision_px) / decision_px * 1e4 AS shortfall_bps, CASE WHEN side = 'buy' THEN 1 ELSE -1 END * (fill_px - 1400) / 1400 * 1e4 AS vs_vwap_bps, filled / nullif(target, 0) AS fill_rate FROM orders_t)"


def quality(spark, sf) -> DataFrame:
    return ex.execution_quality(views.orders_t(spark, sf).withColumn("vwap", F.lit(1400.0)))


@query("j23_execution_quality", f"WITH {QUAL} SELECT order_id, side, {r('fill_px')} AS fill_px, {r('shortfall_bps')} AS shortfall_bps, {r('vs_vwap_bps')} AS vs_vwap_bps, {r('fill_rate')} AS fill_rate FROM ql")
def j23(spark, sf):
    return rounded(quality(spark, sf).select("order_id", "side", "fill_px", "shortfall_bps", "vs_vwap_bps", "fill_rate"))


@query("j24_execution_summary", f"WITH {QUAL} SELECT ticker, count(*) AS n, {r('avg(shortfall_bps)')} AS shortfall_bps, {r('avg(vs_vwap_bps)')} AS vs_vwap_bps, {r('avg(fill_rate)')} AS fill_rate, count(*) FILTER (WHERE shortfall_bps > 20) AS adverse, round(sum(shortfall_bps), 3) + 0.0 AS total_bps FROM ql GROUP BY ticker")
def j24(spark, sf):
    return rounded(ex.execution_summary(quality(spark, sf)).withColumn("total_bps", half_up("total_bps", 3)))


@query("j24_adverse_orders", f"WITH {QUAL} SELECT order_id, {r('shortfall_bps')} AS shortfall_bps FROM ql WHERE shortfall_bps > 20")
def j24_adverse(spark, sf):
    return rounded(ex.adverse_orders(quality(spark, sf)).select("order_id", "shortfall_bps"))


RECON = "bi AS (SELECT ticker, sum(CASE WHEN side = 'buy' THEN filled ELSE -filled END) AS i FROM orders_t GROUP BY 1), bb AS (SELECT ticker, sum(CASE WHEN side = 'buy' THEN filled ELSE -filled END) AS b FROM orders_t WHERE l_returnflag <> 'R' GROUP BY 1), rc AS (SELECT ticker, coalesce(i, 0) AS internal, coalesce(b, 0) AS broker FROM bi FULL JOIN bb USING (ticker))"


def recon(spark, sf) -> DataFrame:
    return ex.reconcile_positions(positions(spark, sf), positions(spark, sf, "l_returnflag <> 'R'"))


@query("j25_reconcile_positions", f"WITH {RECON} SELECT ticker, internal, broker, broker - internal AS delta, abs(broker - internal) > 0 AS mismatch, broker AS corrected, abs(broker - internal) > 100 AS alert FROM rc")
def j25(spark, sf):
    return recon(spark, sf)


@query("j26_reconcile_nav", f"SELECT date, {r('nav')} AS internal, {r('nav * (1 + (day(date) - 15) / 1000)')} AS broker, {r('abs(nav * (1 + (day(date) - 15) / 1000) - nav) / (nav * (1 + (day(date) - 15) / 1000))')} AS off FROM nav WHERE abs(nav * (1 + (day(date) - 15) / 1000) - nav) / (nav * (1 + (day(date) - 15) / 1000)) > 0.0105")
def j26(spark, sf):
    n = views.nav(spark, sf)
    return rounded(ex.reconcile_nav(n, n.withColumn("nav", F.col("nav") * (1 + (F.day("date") - 15) / 1000)), 0.0105))


@query("j27_reconcile_orders", "SELECT o_orderkey AS order_id, CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE 'done' END AS status FROM orders WHERE o_orderstatus = 'O' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' - INTERVAL 24000 HOUR AND l_shipdate <= TIMESTAMP '1998-01-01')")
def j27(spark, sf):
    o = views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("done").alias("status"))
    f = views.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_shipdate").alias("ts"))
    return ex.reconcile_orders(o, f, "1998-01-01 00:00:00", 24_000)


@query("j28_reconciliation_metrics", f"WITH {RECON} SELECT count(*) AS total, count(*) FILTER (WHERE broker <> internal) AS mismatches, count(*) FILTER (WHERE broker <> internal) AS corrections, {r('count(*) FILTER (WHERE broker <> internal) / count(*)')} AS rate FROM rc")
def j28(spark, sf):
    return rounded(ex.reconciliation_metrics(recon(spark, sf)))


_H = ", ".join(f"DATE '{d}'" for d in ex.HOLIDAYS)
_E = ", ".join(f"DATE '{d}'" for d in ex.EARLY_CLOSES)
SESSION = f"""ev AS (SELECT event_id, timezone('America/New_York', timezone('UTC', ts)) AS et FROM events), sf AS (SELECT *, isodow(et) >= 6 AS weekend, CAST(et AS DATE) IN ({_H}) AS holiday, CAST(et AS DATE) IN ({_E}) AS early_close, hour(et) * 60 + minute(et) AS m FROM ev),
    ss AS (SELECT *, CASE WHEN early_close THEN 780 ELSE 960 END AS close FROM sf)"""


@query("j29_session_flags", f"WITH {SESSION} SELECT event_id, weekend, holiday, early_close, NOT weekend AND NOT holiday AND m >= 570 AND m < close AS open FROM ss")
def j29(spark, sf):
    return ex.session_flags(views.table(spark, sf, "events")).select("event_id", "weekend", "holiday", "early_close", "open")


@query("j30_can_submit", f"WITH {SESSION}, x AS (SELECT event_id, CASE WHEN weekend THEN 'weekend' WHEN holiday THEN 'holiday' WHEN m < 570 OR m >= close THEN 'outside_hours' WHEN m >= close - 5 AND m < close THEN 'eod_cutoff' ELSE 'OK' END AS reason FROM ss) SELECT event_id, reason, reason = 'OK' AS allowed FROM x")
def j30(spark, sf):
    return ex.can_submit(views.table(spark, sf, "events")).select("event_id", "reason", "allowed")


@query("j31_next_open", f"WITH {SESSION}, d AS (SELECT event_id, et, CAST(CAST(et AS DATE) + CAST(i AS INT) AS DATE) AS d FROM ss, (SELECT unnest(range(11)) AS i)) SELECT event_id, min(d + INTERVAL 570 MINUTE) AS next_open FROM d WHERE isodow(d) < 6 AND d NOT IN ({_H}) AND d + INTERVAL 570 MINUTE > et GROUP BY event_id")
def j31(spark, sf):
    return ex.next_open(views.table(spark, sf, "events")).select("event_id", "next_open")


@query("k01_audit_query", "SELECT order_id, strategy, ticker, ts FROM orders_t WHERE strategy = 'st1' AND ts >= TIMESTAMP '1995-01-01' ORDER BY ts DESC, order_id LIMIT 1000")
def k01(spark, sf):
    from ..session import Work

    root = Work(spark).path("audit")
    gov.audit_append(views.orders_t(spark, sf).select("order_id", "strategy", "ticker", "ts"), root, "orders")
    return gov.audit_query(spark, root, "orders", strategy="st1", since="1995-01-01")


@query("k02_audit_counts", "SELECT 'orders' AS kind, strategy AS name, count(*) AS n FROM orders_t GROUP BY 2 UNION ALL SELECT 'fills', ticker, count(*) FROM orders_t GROUP BY 2")
def k02(spark, sf):
    o = views.orders_t(spark, sf)
    return gov.audit_counts(o, o)


REVIEW = "rv AS (SELECT strategy, avg(value) / 50 AS sharpe, 0.2 AS drawdown, CAST(sum(value) / 100 AS BIGINT) AS days, strategy <> 'view' AS costs, CAST(strategy = 'click' AS INT) AS lookahead, 0.1 AS capacity, -2.5 AS factor FROM strategy_pnl GROUP BY 1)"


def review(spark, sf) -> DataFrame:
    p = views.strategy_pnl(spark, sf).groupBy("strategy").agg((F.avg("value") / 50).alias("sharpe"), F.round(F.sum("value") / 100).cast("long").alias("days"))
    return p.withColumns({"drawdown": F.lit(0.2), "costs": F.col("strategy") != "view", "lookahead": (F.col("strategy") == "click").cast("int"), "capacity": F.lit(0.1), "factor": F.lit(-2.5)})


@query("k03_strategy_review", f"""WITH {REVIEW}, l AS (SELECT strategy, unnest(['sharpe_ratio', 'max_drawdown', 'min_eval_period', 'transaction_costs', 'look_ahead_bias', 'capacity', 'factor_exposure']) AS "check", unnest([sharpe >= 1, drawdown <= 0.25, days >= 252, costs, lookahead = 0, capacity <= 0.2, abs(factor) <= 2]) AS passed FROM rv) SELECT strategy, "check", passed, bool_and(passed) OVER (PARTITION BY strategy) AS overall FROM l""")
def k03(spark, sf):
    return gov.strategy_review(review(spark, sf))


APPROVALS = """al AS (SELECT CAST(o_custkey AS VARCHAR) AS strategy, o_orderkey AS k, ['submitted', 'under_review', 'approved', 'deployed', 'suspended', 'retired', 'rejected'][o_orderkey % 7 + 1] AS from_state, ['submitted', 'under_review', 'approved', 'deployed', 'suspended', 'retired', 'rejected'][(o_orderkey + 1) % 7 + 1] AS to_state FROM orders)"""
_STATES = ["submitted", "under_review", "approved", "deployed", "suspended", "retired", "rejected"]


def approvals(spark, sf) -> DataFrame:
    s = F.array(*[F.lit(x) for x in _STATES])
    k = F.col("o_orderkey")
    return views.table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("strategy"), k.alias("k"), F.element_at(s, (k % 7 + 1).cast("int")).alias("from_state"), F.element_at(s, ((k + 1) % 7 + 1).cast("int")).alias("to_state"))


@query("k04_approval_log_violations", f"""WITH {APPROVALS}, ok AS (SELECT unnest(['submitted>under_review', 'under_review>approved', 'under_review>rejected', 'approved>deployed', 'approved>rejected', 'rejected>submitted', 'deployed>suspended', 'deployed>retired', 'suspended>deployed', 'suspended>retired']) AS t),
    m AS (SELECT *, CASE WHEN from_state || '>' || to_state NOT IN (SELECT t FROM ok) THEN 'not_allowed' WHEN lag(to_state) OVER (PARTITION BY strategy ORDER BY k) <> from_state THEN 'broken_chain' END AS reason FROM al) SELECT * FROM m WHERE reason IS NOT NULL""")
def k04(spark, sf):
    return gov.approval_log_violations(approvals(spark, sf))


@query("k05_approval_current_state", f"WITH {APPROVALS} SELECT strategy, last(to_state ORDER BY k) AS state FROM al GROUP BY strategy")
def k05(spark, sf):
    return gov.approval_current_state(approvals(spark, sf))


@query("k05_can_deploy", f"""WITH {APPROVALS}, s AS (SELECT strategy, last(to_state ORDER BY k) AS state, count(*) AS n FROM al GROUP BY strategy), q AS (SELECT strategy, list_filter([CASE WHEN state NOT IN ('approved', 'suspended') THEN 'state' END, CASE WHEN n % 2 = 0 THEN 'risk_team' END, CASE WHEN n * 12 < 126 THEN 'paper_days' END, CASE WHEN n % 5 = 0 THEN 'review' END], lambda x: x IS NOT NULL) AS l FROM s)
    SELECT strategy, len(l) = 0 AS deployable, array_to_string(l, ',') AS reasons FROM q""")
def k05_deploy(spark, sf):
    n = F.col("n")
    a = approvals(spark, sf).groupBy("strategy").agg(F.max_by("to_state", "k").alias("state"), F.count("*").alias("n"))
    return gov.can_deploy(a.select("strategy", "state", (n % 2 != 0).alias("risk_approved"), (n * 12).alias("paper_days"), (n % 5 != 0).alias("review_passed")))


@query("k06_active_allocations", f"WITH {APPROVALS} SELECT strategy, CASE WHEN count(*) % 3 = 0 THEN 'suspended' ELSE 'paper' END AS mode, CASE WHEN count(*) % 3 = 0 THEN 0.0 ELSE count(*) / 100 END::DOUBLE AS allocation FROM al GROUP BY strategy HAVING count(*) % 3 < 2")
def k06(spark, sf):
    n = F.col("n")
    a = approvals(spark, sf).groupBy("strategy").agg(F.count("*").alias("n"))
    return gov.active_allocations(a.select("strategy", F.when(n % 3 == 0, "live").when(n % 3 == 1, "paper").otherwise("off").alias("mode"), (n / 100).alias("allocation")), halted=True)


def preds(spark, sf) -> DataFrame:
    return views.table(spark, sf, "events").select(F.col("event_type").alias("model"), F.col("event_id").alias("k"), "value")


@query("k07_prediction_drift", f"""WITH k AS (SELECT event_type AS model, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS k FROM events), a AS (SELECT model, count(*) AS n, abs(avg(value) - 20) / 5 AS s FROM k WHERE k <= 500 GROUP BY model) SELECT model, n, {r('s')} AS score, CASE WHEN n < 50 THEN 'insufficient' WHEN s > 3.75 THEN 'critical' WHEN s > 2.5 THEN 'warning' ELSE 'ok' END AS level FROM a""")
def k07(spark, sf):
    p = preds(spark, sf)
    return rounded(gov.prediction_drift(p, p.select("model").distinct().withColumns({"mean": F.lit(20.0), "std": F.lit(5.0)})))


@query("k08_prediction_collapse", f"WITH k AS (SELECT event_type AS model, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS k FROM events) SELECT model, count(*) AS n, {r('stddev_pop(value)')} AS std, count(*) >= 100 AND stddev_pop(value) < 1e-8 AS collapsed FROM k WHERE k <= 500 GROUP BY model")
def k08(spark, sf):
    return rounded(gov.prediction_collapse(preds(spark, sf)))


@query("k09_model_staleness", f"SELECT event_type AS model, {r('(epoch(TIMESTAMP $$2024-02-01$$) - floor(epoch(max(ts)))) / 3600')} AS age_hours, (epoch(TIMESTAMP '2024-02-01') - floor(epoch(max(ts)))) / 3600 > 48 AS stale FROM events GROUP BY 1")
def k09(spark, sf):
    m = views.table(spark, sf, "events").groupBy(F.col("event_type").alias("model")).agg(F.max("ts").alias("trained_at"))
    return rounded(gov.model_staleness(m, "2024-02-01 00:00:00"))


@query("k10_feed_freshness", """WITH a AS (SELECT event_type AS feed, CAST(epoch(TIMESTAMP '2024-01-31') - floor(epoch(max(ts))) AS BIGINT) AS lag_s FROM events GROUP BY 1), s AS (SELECT *, CASE WHEN lag_s < 300 THEN 'healthy' WHEN lag_s <= 900 THEN 'degraded' ELSE 'down' END AS status FROM a)
    SELECT *, CASE WHEN bool_or(status = 'down') OVER () THEN 'down' WHEN bool_or(status = 'degraded') OVER () THEN 'degraded' ELSE 'healthy' END AS overall FROM s""")
def k10(spark, sf):
    return gov.feed_freshness(views.table(spark, sf, "events"), "2024-01-31 00:00:00")


def alerts(spark, sf) -> DataFrame:
    e = views.table(spark, sf, "events")
    return e.select(F.col("event_type").alias("source"), F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("message"), F.when(F.col("value") > 20, "CRITICAL").otherwise("WARNING").alias("level"), "ts", F.col("event_id").alias("alert_id"), (F.col("event_id") % 4 == 0).alias("acknowledged"))


@query("k11_dedupe_alerts", """WITH a AS (SELECT event_type AS source, 'm' || (user_id % 3) AS message, CASE WHEN value > 20 THEN 'CRITICAL' ELSE 'WARNING' END AS level, ts, event_id AS alert_id FROM events),
    k AS (SELECT *, row_number() OVER (PARTITION BY source, message, level ORDER BY ts, alert_id) AS k FROM a), n AS (SELECT *, min(k) OVER (PARTITION BY source, message, level ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECOND FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM k),
    w AS (WITH RECURSIVE w AS (SELECT * FROM n WHERE k = 1 UNION ALL SELECT n.* FROM w JOIN n ON n.source = w.source AND n.message = w.message AND n.level = w.level AND n.k = w.nxt) SELECT * FROM w) SELECT source, message, level, alert_id FROM w""")
def k11(spark, sf):
    return gov.dedupe_alerts(alerts(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")), 3600.0).select("source", "message", "level", "alert_id")


@query("k12_active_alerts", "SELECT event_id AS alert_id, CASE WHEN value > 20 THEN 'CRITICAL' ELSE 'WARNING' END AS level FROM events WHERE event_id % 4 <> 0 AND value > 20 AND ts >= TIMESTAMP '2024-01-05'")
def k12(spark, sf):
    return gov.active_alerts(alerts(spark, sf), "CRITICAL", "2024-01-05").select("alert_id", "level")


@query("k12_alert_counts", "SELECT CASE WHEN value > 20 THEN 'CRITICAL' ELSE 'WARNING' END AS level, count(*) AS n, count(*) FILTER (WHERE event_id % 4 = 0) AS acknowledged FROM events GROUP BY 1")
def k12_counts(spark, sf):
    return gov.alert_counts(alerts(spark, sf))


@query("k13_dedupe_events", "SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY CASE WHEN event_type = 'click' THEN 'u' || user_id ELSE CAST(event_id AS VARCHAR) END ORDER BY ts, event_id) = 1")
def k13(spark, sf):
    e = views.table(spark, sf, "events").withColumn("idempotency_key", F.when(F.col("event_type") == "click", F.concat(F.lit("u"), F.col("user_id").cast("string"))))
    return gov.dedupe_events(e).select("event_id", "user_id", "event_type")


@query("k14_daily_close_report", f"""WITH {PNL}, {QUAL}, q AS (SELECT date, count(*) AS trades, avg(shortfall_bps) AS s FROM ql GROUP BY date), rc AS (SELECT date, bool_and(l_returnflag <> 'R') AS clean FROM orders_t GROUP BY date) SELECT date, {r('nav')} AS nav, {r('pnl')} AS pnl, {r('ret')} AS ret, coalesce(trades, 0) AS trades, {r('s')} AS shortfall_bps, coalesce(clean, true) AS clean FROM pn LEFT JOIN q USING (date) LEFT JOIN rc USING (date)""")
def k14(spark, sf):
    o = views.orders_t(spark, sf).select("date", (F.col("l_returnflag") == "R").alias("mismatch"))
    return rounded(gov.daily_close_report(risk.pnl_series(views.nav(spark, sf)), quality(spark, sf), o))


def stream(spark, sf) -> DataFrame:
    return jobs.stream_table(spark, f"{sf}/events.parquet")


@query("st1_stream_latest_bar", f"SELECT event_type, last(event_id ORDER BY ts, event_id) AS event_id, {r('last(value ORDER BY ts, event_id)')} AS value FROM events GROUP BY 1")
def st1(spark, sf):
    return rounded(jobs.newest_state(jobs.run_available(jobs.stream_latest_bar(stream(spark, sf)), "update"), "event_type").select("event_type", "event_id", "value"))


@query("st2_stream_bars", f"SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, {r('first(value ORDER BY ts, event_id)')} AS open, {r('max(value)')} AS high, {r('min(value)')} AS low, {r('last(value ORDER BY ts, event_id)')} AS close, count(*) AS n FROM events GROUP BY 1, 2")
def st2(spark, sf):
    out = jobs.newest_state(jobs.run_available(jobs.stream_bars(stream(spark, sf), "1 hour"), "update"), "start", "event_type")
    return rounded(out.withColumn("start", F.col("start").cast("timestamp_ntz")))


@query("st3_stream_dedupe", "SELECT user_id, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1")
def st3(spark, sf):
    e = stream(spark, sf).withColumn("idempotency_key", F.concat_ws("-", F.col("user_id").cast("string"), "event_type"))
    return jobs.run_available(jobs.stream_dedupe(e, late="365 days")).groupBy("user_id").agg(F.count("*").alias("n"))


@query("st4_stream_feed_health", "SELECT event_type, max(ts) AS last_ts, count(*) AS n FROM events GROUP BY 1")
def st4(spark, sf):
    out = jobs.newest_state(jobs.run_available(jobs.stream_feed_health(stream(spark, sf)), "update"), "event_type")
    return out.withColumn("last_ts", F.col("last_ts").cast("timestamp_ntz"))


@query("st5_stream_drawdown", f"""WITH kp AS (SELECT event_type AS portfolio, ts, value AS nav, coalesce(max(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), value) AS p FROM events) SELECT portfolio, count(*) AS n, min(ts) FILTER (WHERE p > 0 AND (p - nav) / p >= 0.2) AS first_halt FROM kp GROUP BY 1""")
def st5(spark, sf):
    nav = stream(spark, sf).select(F.col("event_type").alias("portfolio"), "ts", F.col("value").alias("nav"), F.col("event_id").alias("nth"))
    out = jobs.run_available(jobs.stream_drawdown(nav))
    return out.groupBy("portfolio").agg(F.count("*").alias("n"), F.min(F.when(F.col("halted"), F.col("ts"))).cast("timestamp_ntz").alias("first_halt"))


@query("st6_stream_strategy_lifecycle", """WITH k AS (SELECT event_type AS strategy, ts, (value - 20) / 100 AS ic, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events),
    w AS (WITH RECURSIVE w AS (SELECT strategy, ts, k, 'active' AS status, ts AS since FROM k WHERE k = 1 UNION ALL SELECT strategy, ts, k, nxt, CASE WHEN nxt = status THEN since ELSE ts END FROM (
        SELECT k.strategy, k.ts, k.k, w.status, w.since, CASE WHEN status = 'active' AND ic < 0.01 THEN 'under_review' WHEN status = 'under_review' AND ic >= 0.03 THEN 'active' WHEN status = 'under_review' AND ic < 0 AND k.ts - w.since >= INTERVAL 30 DAY THEN 'suspended' ELSE status END AS nxt
        FROM w JOIN k ON k.strategy = w.strategy AND k.k = w.k + 1)) SELECT * FROM w),
    o AS (SELECT event_type AS strategy, min(ts) AS over FROM events WHERE event_type <> 'view' AND event_id % 499 = 400 GROUP BY 1), f AS (SELECT strategy, CASE WHEN ts >= over THEN 'retired' ELSE status END AS status FROM w LEFT JOIN o USING (strategy))
    SELECT strategy, status, count(*) AS n, sum(CASE status WHEN 'active' THEN 1.0 WHEN 'under_review' THEN 0.5 ELSE 0.0 END)::DOUBLE AS multipliers FROM f GROUP BY 1, 2""")
def st6(spark, sf):
    over = (F.col("event_type") != "view") & (F.col("event_id") % 499 == 400)
    e = stream(spark, sf).select(F.col("event_type").alias("strategy"), "ts", ((F.col("value") - 20) / 100).alias("ic"), over.alias("retire"), F.col("event_id").alias("nth"))
    return jobs.run_available(jobs.stream_strategy_lifecycle(e)).groupBy("strategy", "status").agg(F.count("*").alias("n"), F.sum("multiplier").alias("multipliers"))


@query("st7_stream_prediction_drift", f"""WITH k AS (SELECT event_type AS model, ts, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) AS k FROM events), a AS (SELECT model, max(ts) AS ts, count(*) AS n, abs(avg(value) - 20) / 5 AS score FROM k WHERE k <= 500 GROUP BY 1)
    SELECT model, ts, n, {r('score')} AS score, n >= 50 AND score > 2.5 AS drifted FROM a""")
def st7(spark, sf):
    e = stream(spark, sf).select(F.col("event_type").alias("model"), "ts", "value")
    return rounded(jobs.run_available(jobs.stream_prediction_drift(e, 20.0, 5.0))).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("st8_stream_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS nw FROM events), s AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def st8(spark, sf):
    out = jobs.run_available(jobs.stream_sessions(stream(spark, sf)), "complete")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("st9_stream_to_table", f"SELECT event_id, {r('value')} AS value FROM events")
def st9(spark, sf):
    from ..session import Work

    path = Work(spark).path("sink")
    jobs.stream_to_table(stream(spark, sf), path).awaitTermination()
    return rounded(spark.read.parquet(f"{path}/rows").select("event_id", "value"))
