"""Queries of normalising (D), signals (E), models (F) and pairs (G)."""

from __future__ import annotations

import math
import random
import statistics

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ordered
from ..functions.columns import half_up, rounded
from ..functions.resamples import mixed_sql, name_sql, weight_sql
from ..operators import embedding
from ..operators import models as mod
from ..operators import normalise as norm
from ..operators import pairs, pairtiles
from ..operators import signals as sig
from ..operators.walkforward import Ridge
from . import views
from .queries_data import AS_OF, macro, r
from .registry import query


def rank_sql(v: str, part: str) -> str:
    return f"(rank() OVER (PARTITION BY {part} ORDER BY {v}) + (count(*) OVER (PARTITION BY {part}, {v}) - 1) / 2.0)"


def corr_sql(x: str, y: str) -> str:
    return f"covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0)"


def features(spark, sf) -> DataFrame:
    return views.signals(spark, sf).select("date", "ticker", F.col("signal").alias("feature"), F.col("score").alias("value"))


NAMES = ["mom", "rev", "vol"]
FEAT = "feat AS (SELECT date, ticker, signal AS feature, score AS value FROM signals)"
X = "OVER (PARTITION BY date, feature)"
EXPAND = "OVER (PARTITION BY ticker, feature ORDER BY date ROWS UNBOUNDED PRECEDING)"


@query("d01_zscore_cs", f"""WITH {FEAT}, a AS (SELECT *, avg(value) {X} AS m, stddev_samp(value) {X} AS s FROM feat), b AS (SELECT *, CASE WHEN s > 0 THEN greatest(least(value, m + 3 * s), m - 3 * s) ELSE value END AS c FROM a),
    d AS (SELECT *, avg(c) {X} AS cm, stddev_samp(c) {X} AS cs FROM b) SELECT date, ticker, feature, {r('CASE WHEN s > 0 AND cs > 0 THEN (c - cm) / cs ELSE 0 END')} AS z FROM d""")
def d01(spark, sf):
    return rounded(norm.zscore_cs(features(spark, sf)).drop("value"))


@query("d02_rank_cs", f"WITH {FEAT}, a AS (SELECT *, {rank_sql('value', 'date, feature')} AS k, count(*) {X} AS n FROM feat) SELECT date, ticker, feature, {r('CASE WHEN n >= 2 THEN 2 * (k - 1) / (n - 1) - 1 ELSE 0 END')} AS rank FROM a")
def d02(spark, sf):
    return rounded(norm.rank_cs(features(spark, sf)).drop("value"))


@query("d03_percentile_cs", f"WITH {FEAT} SELECT date, ticker, feature, {r(rank_sql('value', 'date, feature') + f' / count(*) {X}')} AS percentile FROM feat")
def d03(spark, sf):
    return rounded(norm.percentile_cs(features(spark, sf)).drop("value"))


@query("d04_normalise_matrix", f"WITH {FEAT} SELECT date, ticker, feature, {r(rank_sql('value', 'date, feature') + f' / count(*) {X}')} AS value FROM feat")
def d04(spark, sf):
    return rounded(norm.normalise_matrix(features(spark, sf), "percentile"))


@query("d05_zscore_temporal", f"WITH {FEAT} SELECT date, ticker, feature, {r(f'CASE WHEN count(value) {EXPAND} >= 60 AND stddev_samp(value) {EXPAND} > 0 THEN (value - avg(value) {EXPAND}) / stddev_samp(value) {EXPAND} END')} AS z FROM feat")
def d05(spark, sf):
    return rounded(norm.zscore_temporal(features(spark, sf)).drop("value"))


@query("d06_percentile_temporal", f"""WITH {FEAT}, k AS (SELECT *, row_number() OVER (PARTITION BY ticker, feature ORDER BY date) AS k FROM feat),
    s AS (SELECT a.date, a.ticker, a.feature, a.k, count(*) FILTER (WHERE b.value < a.value) AS below FROM k a JOIN k b ON a.ticker = b.ticker AND a.feature = b.feature AND b.k <= a.k GROUP BY ALL) SELECT date, ticker, feature, {r('CASE WHEN k >= 60 THEN below / k END')} AS percentile FROM s""")
def d06(spark, sf):
    return rounded(norm.percentile_temporal(features(spark, sf)).drop("value"))


def with_target(spark, sf) -> DataFrame:
    return features(spark, sf).join(views.fwd(spark, sf).withColumnRenamed("ret", "target"), ["date", "ticker"])


TARGET = f"{FEAT}, ft AS (SELECT feature, value, ret AS target FROM feat JOIN fwd USING (date, ticker))"


@query("d07_mutual_information", f"""WITH {TARGET}, s AS (SELECT feature, count(*) AS n, min(value) AS a, max(value) AS b, min(target) AS c, max(target) AS d, least(20, greatest(5, count(*) // 20)) AS k FROM ft GROUP BY feature),
    z AS (SELECT feature, n, coalesce(floor((value - a) * (k - 1) / nullif(b - a, 0)) + 1, 1) AS x, coalesce(floor((target - c) * (k - 1) / nullif(d - c, 0)) + 1, 1) AS y FROM ft JOIN s USING (feature)),
    j AS (SELECT feature, n, x, y, count(*) AS m FROM z GROUP BY ALL), p AS (SELECT *, sum(m) OVER (PARTITION BY feature, x) AS px, sum(m) OVER (PARTITION BY feature, y) AS py FROM j)
    SELECT feature, {r('CASE WHEN any_value(n) < 20 THEN 0 ELSE sum(m / n * ln(m * n / (px * py))) END')} AS mi FROM p GROUP BY feature""")
def d07(spark, sf):
    return rounded(norm.mutual_information(with_target(spark, sf)))


@query("d08_spearman_importance", f"WITH {TARGET}, k AS (SELECT feature, {rank_sql('value', 'feature')} AS a, {rank_sql('target', 'feature')} AS b FROM ft) SELECT feature, {r('abs(' + corr_sql('a', 'b') + ')')} AS importance FROM k GROUP BY feature")
def d08(spark, sf):
    return rounded(norm.spearman_importance(with_target(spark, sf)))


@query("d09_select_features")
def d09(spark, sf):
    return rounded(norm.select_features(norm.spearman_importance(with_target(spark, sf)), norm.feature_correlations(features(spark, sf)), 2))


@query("d09_feature_correlations", f"""WITH {FEAT}, k AS (SELECT date, ticker, feature, {rank_sql('value', 'feature')} AS k FROM feat) SELECT a.feature AS f1, b.feature AS f2, {r('abs(' + corr_sql('a.k', 'b.k') + ')')} AS corr
    FROM k a JOIN k b ON a.date = b.date AND a.ticker = b.ticker AND a.feature < b.feature GROUP BY 1, 2""")
def d09_corr(spark, sf):
    return rounded(norm.feature_correlations(features(spark, sf)))


LOG = "lg AS (SELECT signal AS feature, 'm' || (ticker = 'Brand#1') AS model, year(date) * 12 + month(date) AS step, avg(score) AS importance FROM signals GROUP BY 1, 2, 3)"


def importance_log(spark, sf) -> DataFrame:
    s = views.signals(spark, sf)
    return s.groupBy(F.col("signal").alias("feature"), F.concat(F.lit("m"), (F.col("ticker") == "Brand#1").cast("string")).alias("model"), (F.year("date") * 12 + F.month("date")).alias("step")).agg(F.avg("score").alias("importance"))


@query("d10_rolling_importance", f"WITH {LOG} SELECT model, feature, step, {r('avg(importance) OVER (PARTITION BY model, feature ORDER BY step ROWS 9 PRECEDING)')} AS rolling FROM lg")
def d10(spark, sf):
    return rounded(norm.rolling_importance(importance_log(spark, sf)).select("model", "feature", "step", "rolling"))


@query("d10_top_features", f"""WITH {LOG}, k AS (SELECT *, dense_rank() OVER (PARTITION BY model ORDER BY step DESC) AS k FROM lg), m AS (SELECT model, feature, avg(importance) AS mean FROM k WHERE k <= 5 GROUP BY 1, 2)
    SELECT model, feature, {r('mean')} AS mean, row_number() OVER (PARTITION BY model ORDER BY mean DESC, feature) AS rank FROM m""")
def d10_top(spark, sf):
    return rounded(norm.top_features(importance_log(spark, sf)).withColumn("rank", F.col("rank").cast("long")))


@query("d11_importance_drift", f"""WITH {LOG}, k AS (SELECT *, dense_rank() OVER (PARTITION BY model ORDER BY step DESC) AS k FROM lg), m AS (SELECT model, feature, avg(importance) FILTER (WHERE k <= 5) AS a, avg(importance) FILTER (WHERE k BETWEEN 6 AND 10) AS b FROM k WHERE k <= 10 GROUP BY 1, 2),
    q AS (SELECT model, {rank_sql('a', 'model')} AS a, {rank_sql('b', 'model')} AS b FROM m), c AS (SELECT model, coalesce({corr_sql('a', 'b')}, 0) AS s FROM q GROUP BY model) SELECT model, {r('s')} AS stability, s < 0.7 AS drifted FROM c""")
def d11(spark, sf):
    return rounded(norm.importance_drift(importance_log(spark, sf)))


ICS = f"""rk AS (SELECT signal, date, {rank_sql('score', 'signal, date')} AS a, {rank_sql('ret', 'signal, date')} AS b FROM signals JOIN fwd USING (date, ticker)),
    ics AS (SELECT * FROM (SELECT signal, date, {corr_sql('a', 'b')} AS ic, count(*) AS n FROM rk GROUP BY 1, 2) WHERE n >= 5 AND ic IS NOT NULL)"""


def ics(spark, sf) -> DataFrame:
    return sig.daily_ic(views.signals(spark, sf), views.fwd(spark, sf))


@query("e01_daily_ic", f"WITH {ICS} SELECT signal, date, {r('ic')} AS ic, n FROM ics")
def e01(spark, sf):
    return rounded(ics(spark, sf))


TURN = """dt AS (SELECT signal, date, row_number() OVER (PARTITION BY signal ORDER BY date) AS k FROM (SELECT DISTINCT signal, date FROM signals)),
    mv AS (SELECT signal, date, score, k, lag(score) OVER (PARTITION BY signal, ticker ORDER BY k) AS s0, lag(k) OVER (PARTITION BY signal, ticker ORDER BY k) AS k0 FROM signals JOIN dt USING (signal, date)),
    turn AS (SELECT signal, avg(m) AS turnover FROM (SELECT signal, date, avg(abs(score - s0)) AS m FROM mv WHERE k0 = k - 1 GROUP BY 1, 2) GROUP BY 1)"""


@query("e02_signal_turnover", f"WITH {TURN} SELECT signal, {r('turnover')} AS turnover FROM turn")
def e02(spark, sf):
    return rounded(sig.signal_turnover(views.signals(spark, sf)))


@query("e03_crowding", f"""WITH j AS (SELECT b.signal AS other, a.score AS x, b.score AS y FROM signals a JOIN signals b ON a.date = b.date AND a.ticker = b.ticker AND a.signal = 'mom' AND b.signal <> 'mom'),
    k AS (SELECT other, {rank_sql('x', 'other')} AS a, {rank_sql('y', 'other')} AS b FROM j) SELECT {r('coalesce(max(c), 0)')} AS crowding FROM (SELECT other, abs({corr_sql('a', 'b')}) AS c, count(*) AS n FROM k GROUP BY other) WHERE n > 10""")
def e03(spark, sf):
    s = views.signals(spark, sf)
    return rounded(sig.crowding(s.filter("signal = 'mom'"), s.filter("signal <> 'mom'")))


SCORED = f"""{ICS}, {TURN}, sa AS (SELECT signal, count(*) AS n, avg(ic) AS ic_mean, stddev_samp(ic) AS ic_std FROM ics GROUP BY signal),
    sc AS (SELECT signal, n, ic_mean, ic_std, coalesce(ic_mean / nullif(ic_std, 0) * sqrt(n), 0) AS t_stat, coalesce(turnover, 0) AS turnover FROM sa LEFT JOIN turn USING (signal)),
    scored AS (SELECT *, CASE WHEN n < 252 THEN -999 ELSE 0.4 * ic_mean + 0.3 * t_stat / 10 + 0.2 / (1 + ic_std) - 0.05 * turnover END AS composite, n >= 252 AND ic_mean >= 0.03 AND t_stat >= 2 AS passed FROM sc)"""
_SCORED = f"signal, n, {r('ic_mean')} AS ic_mean, {r('ic_std')} AS ic_std, {r('t_stat')} AS t_stat, {r('turnover')} AS turnover, {r('composite')} AS composite, passed"


def scored(spark, sf) -> DataFrame:
    return sig.score_signals(ics(spark, sf), sig.signal_turnover(views.signals(spark, sf)))


@query("e04_score_signal", f"WITH {SCORED} SELECT {_SCORED} FROM scored")
def e04(spark, sf):
    return rounded(scored(spark, sf))


@query("e05_rank_signals", f"WITH {SCORED} SELECT signal, row_number() OVER (ORDER BY composite DESC, signal) AS rank FROM scored")
def e05(spark, sf):
    return sig.rank_signals(scored(spark, sf)).select("signal", F.col("rank").cast("long").alias("rank"))


PV = "pv AS (SELECT l_orderkey % 20 AS fam, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS id, l_extendedprice % 1000 / 1000000.0 AS p FROM lineitem)"


def pvalues(spark, sf) -> DataFrame:
    li = views.table(spark, sf, "lineitem")
    ids = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")])
    return li.select((F.col("l_orderkey") % 20).alias("fam"), ids.alias("id"), (F.col("l_extendedprice") % 1000 / 1000000.0).alias("p"))


@query("e06_benjamini_hochberg", f"""WITH {PV}, k AS (SELECT *, row_number() OVER (PARTITION BY fam ORDER BY p, id) AS k, count(*) OVER (PARTITION BY fam) AS m FROM pv), c AS (SELECT *, max(CASE WHEN p <= k / m * 0.1 THEN k END) OVER (PARTITION BY fam) AS last FROM k)
    SELECT fam, count(*) AS n, count(*) FILTER (WHERE coalesce(k <= last, false)) AS rejected FROM c GROUP BY fam""")
def e06(spark, sf):
    out = sig.benjamini_hochberg(pvalues(spark, sf), 0.1, ("fam",))
    return out.groupBy("fam").agg(F.count("*").alias("n"), F.sum(F.col("rejected").cast("long")).alias("rejected"))


@query("e07_bonferroni", f"WITH {PV}, c AS (SELECT *, p < 0.05 / count(*) OVER (PARTITION BY fam) AS hit FROM pv) SELECT fam, count(*) AS n, count(*) FILTER (WHERE hit) AS rejected FROM c GROUP BY fam")
def e07(spark, sf):
    return sig.bonferroni(pvalues(spark, sf), 0.05, ("fam",)).groupBy("fam").agg(F.count("*").alias("n"), F.sum(F.col("rejected").cast("long")).alias("rejected"))


@query("e08_score_signals_fdr")
def e08(spark, sf):
    return rounded(sig.score_signals_fdr(scored(spark, sf)))


def resampled_sql(b: int, seed: int) -> str:
    """Each signal's weighted sums (s), their means (m) and dates (n) by resample."""
    return f"""{ICS}, nm AS (SELECT signal, date, ic, {name_sql(seed, 'signal', 'date')} AS nm FROM ics), dr AS (SELECT signal, ic, i, {mixed_sql('nm', 'i')} AS u FROM nm, (SELECT unnest(range(1, {b} + 1)) AS i)), dw AS (SELECT *, {weight_sql('u')} AS w FROM dr),
    ms AS (SELECT signal, i, sum(w * ic) AS s, sum(w * ic) / nullif(sum(w), 0) AS m, count(*) AS n FROM dw GROUP BY 1, 2)"""


@query("e09_bootstrap_ic_ci", f"WITH {resampled_sql(1000, 7)} SELECT signal, CASE WHEN max(n) < 10 THEN 0 ELSE {r('quantile_cont(m, 0.025)')} END AS low, CASE WHEN max(n) < 10 THEN 0 ELSE {r('quantile_cont(m, 0.975)')} END AS high FROM ms GROUP BY signal")
def e09(spark, sf):
    return rounded(sig.bootstrap_ic_ci(ics(spark, sf), 1000))


@query("e10_combine_signals", f"SELECT date, ticker, {r('sum(CASE signal WHEN $$mom$$ THEN 2.0 ELSE 1.0 END * score) / 3.0')} AS score FROM signals WHERE signal IN ('mom', 'rev') GROUP BY 1, 2")
def e10(spark, sf):
    return rounded(sig.combine_signals(views.signals(spark, sf), {"mom": 2.0, "rev": 1.0}))


EVAL = f"""ev AS (SELECT signal, avg(ic) AS ic_mean, stddev_samp(ic) AS ic_std, avg(CASE WHEN round(ic, 9) > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate, count(*) AS n_periods FROM (SELECT signal, date, {corr_sql('a', 'b')} AS ic, count(*) AS n FROM (SELECT signal, date, {rank_sql('score', 'signal, date')} AS a,
    {rank_sql('ret', 'signal, date')} AS b FROM signals JOIN fwd USING (date, ticker)) GROUP BY 1, 2) WHERE n >= 3 AND ic IS NOT NULL GROUP BY signal),
    rt AS (SELECT signal, avg(abs(k - k0) / n) AS turnover FROM (SELECT signal, k, n, lag(k) OVER (PARTITION BY signal, ticker ORDER BY date) AS k0 FROM (SELECT *, {rank_sql('score', 'signal, date')} AS k, count(*) OVER (PARTITION BY signal, date) AS n FROM signals)) GROUP BY signal),
    evaluated AS (SELECT signal, ic_mean, ic_std, hit_rate, n_periods, turnover, coalesce(ic_mean / nullif(ic_std, 0), 0) AS ir, coalesce(ic_mean / nullif(ic_std, 0), 0) * sqrt(n_periods) AS t_stat, ic_mean * sqrt(252) * 2 AS sharpe, 'completed' AS status FROM ev JOIN rt USING (signal))"""
_EVAL = ", ".join(f"{r(c)} AS {c}" for c in ("ic_mean", "ic_std", "hit_rate", "turnover", "ir", "t_stat", "sharpe"))


@query("e11_evaluate_signals_batch", f"WITH {EVAL} SELECT signal, n_periods, status, {_EVAL} FROM evaluated")
def e11(spark, sf):
    return rounded(sig.evaluate_signals_batch(views.signals(spark, sf), views.fwd(spark, sf)))


@query("e12_filter_significant", f"WITH {EVAL} SELECT signal, {r('t_stat')} AS t_stat FROM evaluated WHERE t_stat >= 1.5")
def e12(spark, sf):
    return rounded(sig.filter_significant(sig.evaluate_signals_batch(views.signals(spark, sf), views.fwd(spark, sf))).select("signal", "t_stat"))


PERF = f"""{ICS}, pw AS (SELECT signal, date, score / nullif(sum(abs(score)) OVER (PARTITION BY signal, date), 0) AS w, ret FROM signals JOIN fwd USING (date, ticker)), pp AS (SELECT signal, date, coalesce(sum(w * ret), 0) AS pnl FROM pw GROUP BY 1, 2),
    perf AS (SELECT signal, date, ic, pnl, sum(pnl) OVER (PARTITION BY signal ORDER BY date ROWS UNBOUNDED PRECEDING) AS cum_pnl, avg(ic) OVER (PARTITION BY signal ORDER BY date ROWS 59 PRECEDING) AS rolling_ic, row_number() OVER (PARTITION BY signal ORDER BY date) AS n FROM ics_only JOIN pp USING (signal, date))""".replace("ics_only", "(SELECT signal, date, ic FROM ics)")


@query("e13_alpha_performance", f"WITH {PERF} SELECT signal, date, {r('ic')} AS ic, {r('pnl')} AS pnl, {r('cum_pnl')} AS cum_pnl, {r('rolling_ic')} AS rolling_ic, n FROM perf")
def e13(spark, sf):
    p = sig.alpha_performance(views.signals(spark, sf), views.fwd(spark, sf))
    return rounded(p.withColumn("n", F.col("n").cast("long")))


@query("e13_alpha_summary", f"WITH {PERF} SELECT signal, {r('avg(ic)')} AS ic_mean, {r('coalesce(avg(ic) / nullif(stddev_samp(ic), 0) * sqrt(252), 0)')} AS ir, {r('sum(pnl)')} AS total_pnl, count(*) AS n FROM perf GROUP BY signal")
def e13_summary(spark, sf):
    return rounded(sig.alpha_summary(sig.alpha_performance(views.signals(spark, sf), views.fwd(spark, sf))))


def _over(n: int) -> str:
    return f"OVER (PARTITION BY signal ORDER BY date ROWS {n - 1} PRECEDING)"


@query("e14_ic_alerts", f"""WITH {ICS}, a AS (SELECT signal, date, row_number() OVER (PARTITION BY signal ORDER BY date) AS n, avg(ic) {_over(20)} AS m, CASE WHEN stddev_samp(ic) {_over(60)} > 0 THEN avg(ic) {_over(60)} / stddev_samp(ic) {_over(60)} * sqrt(60) ELSE 0 END AS t FROM ics)
    SELECT signal, date, 'WARNING' AS level, {r('m')} AS value FROM a WHERE n >= 20 AND m < 0 UNION ALL SELECT signal, date, 'CRITICAL', {r('t')} FROM a WHERE n >= 60 AND t < 1.5""")
def e14(spark, sf):
    return rounded(sig.ic_alerts(ics(spark, sf)))


@query("e15_ic_half_life", f"""WITH {ICS}, k AS (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY date DESC) AS k FROM ics), p AS (SELECT *, lead(ic) OVER (PARTITION BY signal ORDER BY date DESC) AS b FROM k WHERE k <= 120),
    a AS (SELECT signal, count(*) AS n, covar_pop(b, CASE WHEN b IS NOT NULL THEN ic END) AS c, var_pop(b) AS v, avg(ic) FILTER (WHERE k <= 20) AS current FROM p GROUP BY signal),
    h AS (SELECT *, CASE WHEN n >= 10 AND v >= 1e-10 THEN c / nullif(v, 0) END AS phi FROM a), q AS (SELECT signal, max(m) AS peak, count(*) AS total FROM (SELECT signal, avg(ic) {_over(20)} AS m FROM ics) GROUP BY signal),
    f AS (SELECT *, CASE WHEN phi > 0 AND phi < 1 THEN -ln(2) / ln(phi) END AS hl FROM h JOIN q USING (signal))
    SELECT signal, n, {r('phi')} AS phi, {r('hl')} AS half_life, {r('peak')} AS peak, {r('current')} AS current, CASE WHEN total < 60 THEN 'INSUFFICIENT' WHEN hl < 10 THEN 'RETIRE' WHEN hl < 20 THEN 'REVIEW' ELSE 'KEEP' END AS action FROM f""")
def e15(spark, sf):
    return rounded(sig.ic_half_life(ics(spark, sf)))


def combos_sql() -> str:
    """The coefficients as a table: the same seeded draws."""
    g = random.Random(3)
    rows = [(f"combo_{i}", f, g.gauss(0, 1)) for i in range(50) for f in g.sample(NAMES, min(len(NAMES), g.randint(2, 5)))]
    return ", ".join(f"('{c}', '{f}', {v!r}::DOUBLE)" for c, f, v in rows)


@query("e16_linear_combos", f"WITH {FEAT}, co(candidate, feature, coef) AS (VALUES {combos_sql()}), v AS (SELECT date, ticker, candidate, sum(coef * coalesce(value, 0)) AS value FROM feat JOIN co USING (feature) GROUP BY 1, 2, 3) SELECT date, candidate, count(*) AS n, {r('avg(value)')} AS mean, {r('max(value)')} AS most FROM v GROUP BY 1, 2")
def e16(spark, sf):
    """Fifty candidates for every row, summed up by date."""
    v = sig.linear_combos(features(spark, sf), ["mom", "rev", "vol"], 50)
    return rounded(v.groupBy("date", "candidate").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("most")))


@query("e17_ratio_candidates", f"""WITH {FEAT}, h AS (SELECT date, ticker, list({{'f': feature, 'v': value}}) AS l FROM feat GROUP BY 1, 2), a AS (SELECT date, ticker, l, unnest(l) AS a FROM h), b AS (SELECT date, ticker, a, unnest(l) AS b FROM a)
    SELECT date, ticker, a.f || '/' || b.f AS candidate, round(CASE WHEN abs(b.v) > 1e-8 THEN a.v / b.v END * 1e4) / 1e4 + 0.0 AS value FROM b WHERE a.f <> b.f""")
def e17(spark, sf):
    return rounded(sig.ratio_candidates(features(spark, sf)), 4)


@query("e18_interaction_candidates", f"WITH {FEAT} SELECT f.date, f.ticker, feature || '_x_regime' AS candidate, {r('value * coalesce(CASE WHEN year(f.date) % 2 = 0 THEN month(f.date) % 3 END, 0)')} AS value FROM feat f")
def e18(spark, sf):
    f = features(spark, sf)
    regimes = f.select("date").distinct().filter(F.year("date") % 2 == 0).withColumn("label", F.month("date") % 3)
    return rounded(sig.interaction_candidates(f, regimes))


def wide(spark, sf) -> DataFrame:
    w = features(spark, sf).groupBy("date", "ticker").pivot("feature", ["mom", "rev", "vol"]).agg(F.first("value"))
    return w.join(views.fwd(spark, sf), ["date", "ticker"]).dropna()


@query("e19_expression_search")
def e19(spark, sf):
    return rounded(sig.expression_search(wide(spark, sf), ["mom", "rev", "vol"], "ret", 50))


@query("e20_parameter_search")
def e20(spark, sf):
    data = wide(spark, sf).agg(*[F.avg(F.col(c) * F.col("ret")).alias(c) for c in ("mom", "rev", "vol")])

    def fitness(p: DataFrame) -> DataFrame:
        j = p.join(F.broadcast(data.toDF("m1", "m2", "m3")))
        return j.select("id", (F.col("w1") * F.col("m1") + F.col("w2") * F.col("m2") + F.col("w3") * F.col("m3") - 0.001 * (F.col("w1") ** 2 + F.col("w2") ** 2 + F.col("w3") ** 2)).alias("fitness"))

    best, p = sig.parameter_search(fitness, {f"w{i}": (-1.0, 1.0) for i in (1, 2, 3)}, spark)
    return spark.createDataFrame([(float(best), p["w1"], p["w2"], p["w3"])], "fitness double, w1 double, w2 double, w3 double")


def predictions(spark, sf) -> DataFrame:
    s = views.signals(spark, sf)
    return s.select("date", "ticker", F.col("signal").alias("model"), F.when(F.col("score") < 0.05, F.col("score")).alias("score"))


@query("e21_ensemble_predict", f"SELECT date, ticker, {r('sum(CASE signal WHEN $$mom$$ THEN 0.5 ELSE 0.25 END * score) FILTER (WHERE score < 0.05) / nullif(sum(CASE signal WHEN $$mom$$ THEN 0.5 ELSE 0.25 END) FILTER (WHERE score < 0.05), 0)')} AS score FROM signals GROUP BY 1, 2")
def e21(spark, sf):
    return rounded(sig.ensemble_predict(predictions(spark, sf), {"mom": 0.5, "rev": 0.25, "vol": 0.25}))


@query("e22_ensemble_diversity", f"""WITH w AS (SELECT date, ticker FROM signals GROUP BY 1, 2 HAVING count(*) = 3), k AS (SELECT date, ticker, signal, {rank_sql('score', 'signal')} AS k FROM signals JOIN w USING (date, ticker)),
    c AS (SELECT a.signal AS m1, b.signal AS m2, abs({corr_sql('a.k', 'b.k')}) AS c, count(*) AS n FROM k a JOIN k b ON a.date = b.date AND a.ticker = b.ticker AND a.signal < b.signal GROUP BY 1, 2) SELECT {r('avg(c)')} AS mean_corr, max(n) AS n, avg(c) > 0.7 AS warning FROM c""")
def e22(spark, sf):
    s = views.signals(spark, sf).withColumnRenamed("signal", "model")
    return rounded(sig.ensemble_diversity(s, ["mom", "rev", "vol"]))


@query("e23_strategy_lifecycle", f"""WITH {ICS}, k AS (SELECT signal AS strategy, date, ic, row_number() OVER (PARTITION BY signal ORDER BY date) AS k FROM ics),
    w AS (WITH RECURSIVE w AS (SELECT strategy, date, k, 'active' AS status, 1.0::DOUBLE AS multiplier, date AS since FROM k WHERE k = 1 UNION ALL
        SELECT strategy, date, k, nxt, CASE nxt WHEN 'active' THEN 1.0 WHEN 'under_review' THEN 0.5 ELSE 0.0 END::DOUBLE, CASE WHEN nxt = status THEN since ELSE date END FROM (
            SELECT k.strategy, k.date, k.k, w.status, w.since, CASE WHEN status = 'active' AND ic < 0.01 THEN 'under_review' WHEN status = 'under_review' AND ic >= 0.03 THEN 'active' WHEN status = 'under_review' AND ic < 0 AND k.date - w.since >= 30 THEN 'suspended' ELSE status END AS nxt
            FROM w JOIN k ON k.strategy = w.strategy AND k.k = w.k + 1)) SELECT * FROM w),
    o AS (SELECT 'vol' AS strategy, DATE '1998-06-01' AS over) SELECT strategy, date, CASE WHEN date >= over THEN 'retired' ELSE status END AS status, CASE WHEN date >= over THEN 0.0 ELSE multiplier END AS multiplier FROM w LEFT JOIN o USING (strategy)""")
def e23(spark, sf):
    retired = spark.createDataFrame([("vol", "1998-06-01")], "strategy string, date string").withColumn("date", F.col("date").cast("date"))
    return sig.strategy_lifecycle(ics(spark, sf).select(F.col("signal").alias("strategy"), "date", "ic"), retired)


WIDE = """wide AS (SELECT date, ticker, max(score) FILTER (WHERE signal = 'mom') AS mom, max(score) FILTER (WHERE signal = 'rev') AS rev, max(score) FILTER (WHERE signal = 'vol') AS vol FROM signals GROUP BY 1, 2 HAVING count(*) = 3)"""


@query("f01_temporal_split", f"""WITH {WIDE}, j AS (SELECT date FROM wide JOIN fwd USING (date, ticker)), d AS (SELECT date, sum(count(*)) OVER (ORDER BY date) AS upto, sum(count(*)) OVER () AS n FROM j GROUP BY date)
    SELECT CASE WHEN upto <= floor(0.9 * n) THEN 'train' ELSE 'test' END AS role, count(*) AS n, min(date) AS first, max(date) AS last FROM j JOIN d USING (date) GROUP BY 1""")
def f01(spark, sf):
    return mod.temporal_split(wide(spark, sf)).groupBy("role").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))




@query("f02_gbt_alpha")
def f02(spark, sf):
    return rounded(mod.gbt_alpha(wide(spark, sf), NAMES))


@query("f03_rf_alpha")
def f03(spark, sf):
    return rounded(mod.rf_alpha(wide(spark, sf), NAMES))


@query("f04_linear_alpha")
def f04(spark, sf):
    return rounded(mod.linear_alpha(wide(spark, sf), NAMES))


@query("f05_baselines", f"WITH k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM returns) SELECT ticker, 0.0::DOUBLE AS zero, {r('-avg(ret) FILTER (WHERE k <= 5)')} AS mean_reversion, {r('avg(ret) FILTER (WHERE k <= 20)')} AS momentum FROM k GROUP BY ticker")
def f05(spark, sf):
    return rounded(mod.baselines(views.returns(spark, sf)))


DATES = "dd AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM bars))"


@query("f06_walk_forward_splits", f"""WITH {DATES}, st AS (SELECT unnest(range(504, max(n) - 63 + 1, 21)) AS t FROM dd), x AS (SELECT row_number() OVER (ORDER BY t) - 1 AS fold, t FROM st)
    SELECT CAST(fold AS INT) AS fold, CASE WHEN k < t THEN 'train' ELSE 'test' END AS role, count(*) AS n, min(date) AS first, max(date) AS last FROM x JOIN dd ON k < t + 63 GROUP BY 1, 2""")
def f06(spark, sf):
    return mod.walk_forward_splits(views.bars(spark, sf)).groupBy("fold", "role").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))


@query("f08_purged_kfold", f"""WITH {DATES}, x AS (SELECT CAST(f AS INT) AS fold, date, k, f * (n // 5) AS lo, CASE WHEN f = 4 THEN n ELSE (f + 1) * (n // 5) END AS hi FROM dd, (SELECT unnest(range(5)) AS f))
    SELECT fold, date, CASE WHEN k >= lo AND k < hi THEN 'test' WHEN k >= hi AND k < hi + 5 THEN 'embargo' ELSE 'train' END AS role FROM x""")
def f08(spark, sf):
    return mod.purged_kfold(views.bars(spark, sf))


@query("f09_combinatorial_purged_cv", f"""WITH {DATES}, g AS (SELECT date, least(k // (n // 6), 5) AS g, k - least(k // (n // 6), 5) * (n // 6) AS place FROM dd), c AS (SELECT a, b, row_number() OVER (ORDER BY a, b) - 1 AS fold FROM (SELECT unnest(range(6)) AS a), (SELECT unnest(range(6)) AS b) WHERE a < b)
    SELECT CAST(fold AS INT) AS fold, CASE WHEN g IN (a, b) THEN 'test' WHEN g - 1 IN (a, b) AND place < 5 THEN 'embargo' ELSE 'train' END AS role, count(*) AS n FROM g, c GROUP BY 1, 2""")
def f09(spark, sf):
    return mod.combinatorial_purged_cv(views.bars(spark, sf)).groupBy("fold", "role").agg(F.count("*").alias("n"))


def _xx() -> list[tuple[str, str]]:
    """The sums that a ridge regression of three features needs: name and term."""
    x = [f"x{i}" for i in range(3)]
    return [("n", "1"), *[(v, v) for v in x], ("y", "y"), *[(x[i] + x[j], f"{x[i]} * {x[j]}") for i in range(3) for j in range(i, 3)], *[(v + "y", f"{v} * y") for v in x], ("yy", "y * y")]


GRAM = f"""{WIDE}, rw AS (SELECT date, mom AS x0, rev AS x1, vol AS x2, ret AS y FROM wide JOIN fwd USING (date, ticker)),
    gd AS (SELECT date, {', '.join(f'CAST(sum({t}) AS DOUBLE) AS {c}' for c, t in _xx())} FROM rw GROUP BY date),
    pf AS (SELECT date, row_number() OVER w - 1 AS k, n AS own, {', '.join(f'sum({c}) OVER w AS {c}' for c, _ in _xx())} FROM gd WINDOW w AS (ORDER BY date ROWS UNBOUNDED PRECEDING))"""


def ridge_sql(source: str, keys: str) -> str:
    """(keys, n, a, b0, b1, b2, r2) from sums: centred, scaled, and solved by Cramer's rule."""
    c = lambda i, j: f"(x{min(i, j)}x{max(i, j)} - x{i} * x{j} / n)"
    z = ", ".join(f"{c(i, j)} / (s{i} * s{j}){' + alpha' if i == j else ''} AS z{i}{j}" for i in range(3) for j in range(i, 3))

    def det(m: list[list[str]]) -> str:
        return f"({m[0][0]} * ({m[1][1]} * {m[2][2]} - {m[1][2]} * {m[2][1]}) - {m[0][1]} * ({m[1][0]} * {m[2][2]} - {m[1][2]} * {m[2][0]}) + {m[0][2]} * ({m[1][0]} * {m[2][1]} - {m[1][1]} * {m[2][0]}))"

    full = [[f"z{min(i, j)}{max(i, j)}" for j in range(3)] for i in range(3)]
    with_r = lambda k: [[f"r{i}" if j == k else full[i][j] for j in range(3)] for i in range(3)]
    fit = " + ".join(f"b{i} * b{j} * {c(i, j)}" for i in range(3) for j in range(3))
    return f"""(SELECT {keys}, n, (y - b0 * x0 - b1 * x1 - b2 * x2) / n AS a, b0, b1, b2, 1 - (yy - y * y / n - 2 * ({' + '.join(f'b{i} * (x{i}y - x{i} * y / n)' for i in range(3))}) + {fit}) / (yy - y * y / n) AS r2
        FROM (SELECT *, {', '.join(f'{det(with_r(k))} / {det(full)} / s{k} AS b{k}' for k in range(3))} FROM (SELECT *, {z}, {', '.join(f'(x{i}y - x{i} * y / n) / s{i} AS r{i}' for i in range(3))}
        FROM (SELECT *, {', '.join(f'sqrt({c(i, i)} / n) AS s{i}' for i in range(3))} FROM {source}))))"""


def figures_sql(scored: str, keys: str) -> str:
    """(keys, ic, r2, n_test) of rows (keys, y, prediction)."""
    return f"""(SELECT {keys}, coalesce({corr_sql('ra', 'rb')}, 0) AS ic, coalesce(1 - sum((y - prediction) ** 2) / nullif(sum(y * y) - sum(y) ** 2 / count(*), 0), 0) AS r2, count(*) AS n_test
        FROM (SELECT *, {rank_sql('y', keys)} AS ra, {rank_sql('prediction', keys)} AS rb FROM {scored}) GROUP BY {keys})"""


def walked_sql(ridges: dict[str, float], plain: dict[str, str], train: int, test: int, step: int) -> str:
    """fm: (model, fold, ic, r2); sm: the folds' figures by model."""
    names = ", ".join(f"('{m}', {a}::DOUBLE)" for m, a in ridges.items())
    rows = f"rp AS (SELECT rw.*, k FROM rw JOIN pf USING (date)), fo AS (SELECT row_number() OVER (ORDER BY t) - 1 AS fold, t FROM (SELECT unnest(range({train}, (SELECT max(k) + 1 FROM pf) - {test} + 1, {step})) AS t))"
    fitted = f"md(model, alpha) AS (VALUES {names}), sp AS (SELECT model, alpha, fold, t, pf.* FROM fo JOIN pf ON pf.k = fo.t - 1, md), rf AS {ridge_sql('sp', 'model, fold, t')}"
    tested = f"k BETWEEN t AND t + {test} - 1"
    scored = f"sc AS (SELECT model, fold, y, a + b0 * x0 + b1 * x1 + b2 * x2 AS prediction FROM rf JOIN rp ON {tested}" + "".join(f" UNION ALL SELECT '{m}', fold, y, {v} FROM fo JOIN rp ON {tested}" for m, v in plain.items()) + ")"
    return f"""{GRAM}, {rows}, {fitted}, {scored}, fm AS {figures_sql('sc', 'model, fold')},
    sm AS (SELECT model, count(ic) AS n_folds, coalesce(avg(ic), 0) AS ic_mean, coalesce(stddev_samp(ic), 0) AS ic_std, coalesce(avg(ic) / nullif(stddev_samp(ic), 0) * sqrt(count(ic)), 0) AS t_stat, coalesce(avg(r2), 0) AS r2_mean FROM (SELECT unnest([{', '.join(f"'{m}'" for m in [*ridges, *plain])}]) AS model) LEFT JOIN fm USING (model) GROUP BY model)"""


FOLD_FIGURES = f"n_folds, {r('ic_mean')} AS ic_mean, {r('ic_std')} AS ic_std, {r('t_stat')} AS t_stat, {r('r2_mean')} AS r2_mean, ic_mean > 0.03 AND t_stat > 2 AS significant"


@query("f07_walk_forward_eval", f"WITH {walked_sql({'model': 1.0}, {}, 504, 63, 21)} SELECT {FOLD_FIGURES} FROM sm")
def f07(spark, sf):
    return rounded(mod.walk_forward_eval(wide(spark, sf), NAMES))


#: What the best of five tries has by luck, in standard errors (the expected maximum of so many normal variables).
_NORMAL = statistics.NormalDist()
LUCK = (1 - mod.EULER) * _NORMAL.inv_cdf(1 - 1 / 5) + mod.EULER * _NORMAL.inv_cdf(1 - 1 / (5 * math.e))


def phi_sql(z: str) -> str:
    """The normal distribution function, by Simpson's rule from the mean on."""
    return f"(0.5 + {z} / 2000 / 3 * list_sum(list_transform(range(0, 2001), lambda i: (CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-0.5 * power({z} * i / 2000, 2)))) / sqrt(2 * pi()))"


@query("f10_model_comparison", f"""WITH {walked_sql({'ridge_0.01': 0.01, 'ridge_1.0': 1.0}, {'zero': '0.0::DOUBLE', 'mean_reversion': 'x1', 'momentum': 'x0'}, 200, 63, 21)},
    z AS (SELECT *, model IN ('zero', 'mean_reversion', 'momentum') AS is_baseline, CASE WHEN n_folds >= 2 AND ic_std > 0 THEN ic_mean / ic_std * sqrt(n_folds) - {LUCK!r} END AS z FROM sm)
    SELECT model, is_baseline, {FOLD_FIGURES}, CASE WHEN z IS NULL THEN 0 ELSE {r(phi_sql('z'))} END AS dsr, NOT is_baseline AND ic_mean > coalesce(max(CASE WHEN is_baseline THEN ic_mean END) OVER (), 0) AS beats_all_baselines FROM z""")
def f10(spark, sf):
    plain = {"zero": F.lit(0.0), "mean_reversion": F.col("rev"), "momentum": F.col("mom")}
    return rounded(mod.model_comparison(wide(spark, sf), NAMES, {f"ridge_{s}": Ridge(s) for s in (0.01, 1.0)}, plain))


@query("f11_train_test_gap", f"WITH {ICS}, s AS (SELECT signal AS model, avg(ic) FILTER (WHERE year(date) < 1996) AS train, avg(ic) FILTER (WHERE year(date) >= 1996) AS test FROM ics GROUP BY signal) SELECT model, {r('train')} AS train, {r('test')} AS test, {r('train - test')} AS gap, {r('test / nullif(train, 0)')} AS ratio, train - test > 0.15 AS overfit FROM s")
def f11(spark, sf):
    part = lambda c: F.avg(F.when(c, F.col("ic")))
    s = ics(spark, sf).groupBy(F.col("signal").alias("model")).agg(part(F.year("date") < 1996).alias("train"), part(F.year("date") >= 1996).alias("test"))
    return rounded(mod.train_test_gap(s))


def curve_sql(points: list[tuple[float, float]]) -> str:
    """cv: (share, alpha, n_train, train_r2, test_r2, test_ic, n_test)."""
    given = ", ".join(f"({s}::DOUBLE, {a}::DOUBLE)" for s, a in points)
    return f"""{GRAM}, ct AS (SELECT max(k) FILTER (WHERE n <= floor(0.9 * (SELECT sum(own) FROM pf))) AS cut, max(k) AS last FROM pf), pt(share, alpha) AS (VALUES {given}),
    sp AS (SELECT share, alpha, cut, last, pf.* FROM pt, ct JOIN pf ON pf.k = greatest(ceil(share * (cut + 1)) - 1, 0)), rf AS {ridge_sql('sp', 'share, alpha, cut, last')},
    sc AS (SELECT share, alpha, y, a + b0 * x0 + b1 * x1 + b2 * x2 AS prediction FROM rf JOIN (SELECT rw.*, k FROM rw JOIN pf USING (date)) q ON q.k BETWEEN cut + 1 AND last), fm AS {figures_sql('sc', 'share, alpha')},
    cv AS (SELECT share, alpha, CAST(n AS BIGINT) AS n_train, {r('rf.r2')} AS train_r2, {r('fm.r2')} AS test_r2, {r('ic')} AS test_ic, n_test FROM rf JOIN fm USING (share, alpha))"""


@query("f12_learning_curve", f"WITH {curve_sql([(s, 1.0) for s in (0.2, 0.4, 0.6, 0.8, 1.0)])} SELECT * EXCLUDE (alpha) FROM cv")
def f12(spark, sf):
    return rounded(mod.learning_curve(wide(spark, sf), NAMES))


@query("f12_complexity_curve", f"WITH {curve_sql([(1.0, a) for a in (0.01, 0.1, 1.0)])} SELECT alpha AS strength, * EXCLUDE (alpha, share) FROM cv")
def f12_complexity(spark, sf):
    return rounded(mod.complexity_curve(wide(spark, sf), NAMES))


@query("f13_overfit_probability", f"WITH {resampled_sql(1000, 13)} SELECT signal, {r('avg(CAST(s <= 0 AS DOUBLE))')} AS p FROM ms GROUP BY signal")
def f13(spark, sf):
    return rounded(mod.overfit_probability(ics(spark, sf), 1000))


@query("f14_perturbed_features")
def f14(spark, sf):
    return mod.perturbed(wide(spark, sf), NAMES).agg(F.count("*").alias("n"), *[F.round(F.stddev_samp(c), 6).alias(c) for c in NAMES])


def market(spark, sf) -> DataFrame:
    return views.factors(spark, sf).filter("factor = 'Market'").select("date", "ret")


@query("f15_regime_clusters")
def f15(spark, sf):
    return rounded(mod.regime_clusters(market(spark, sf)))


@query("f15_regime_transitions")
def f15_transitions(spark, sf):
    labels = mod.regime_clusters(market(spark, sf)).select("date", "label", F.lit("market").alias("series"))
    return rounded(mod.transition_matrix(labels))


@query("f16_transition_matrix", f"""WITH l AS (SELECT ticker, CASE WHEN ret > 0.05 THEN 'up' WHEN ret < -0.05 THEN 'down' ELSE 'flat' END AS label, date FROM returns), m AS (SELECT label, lead(label) OVER (PARTITION BY ticker ORDER BY date) AS nx FROM l), c AS (SELECT label AS from_label, nx AS to_label, count(*) AS n FROM m WHERE nx IS NOT NULL GROUP BY 1, 2)
    SELECT from_label, to_label, n, {r('n / sum(n) OVER (PARTITION BY from_label)')} AS p FROM c""")
def f16(spark, sf):
    l = views.returns(spark, sf).withColumn("label", F.when(F.col("ret") > 0.05, "up").when(F.col("ret") < -0.05, "down").otherwise("flat"))  # noqa: E741
    return rounded(mod.transition_matrix(l, "ticker"))


VOL = """vb AS (SELECT ticker, date, ret, row_number() OVER (PARTITION BY ticker ORDER BY date) AS n, stddev_samp(ret) OVER (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING) AS vol FROM returns),
    vk AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS k FROM vb WHERE n >= 20), vp AS (SELECT a.ticker, a.date, a.ret, a.vol, count(*) FILTER (WHERE round(b.vol, 12) < round(a.vol, 12)) / count(*) * 100 AS percentile FROM vk a JOIN vk b ON a.ticker = b.ticker AND b.k BETWEEN a.k - 251 AND a.k GROUP BY ALL),
    vr AS (SELECT *, CASE WHEN percentile <= 25 THEN 'low' WHEN percentile >= 75 THEN 'high' ELSE 'normal' END AS regime FROM vp)"""


def vol_base(spark, sf) -> DataFrame:
    return views.returns(spark, sf)


@query("f17_vol_regime", f"WITH {VOL} SELECT ticker, date, {r('vol')} AS vol, round(percentile, 3) AS percentile, regime FROM vr")
def f17(spark, sf):
    return rounded(mod.vol_regime(vol_base(spark, sf)).select("ticker", "date", "vol", half_up("percentile", 3).alias("percentile"), "regime"))


@query("f18_market_state", f"""WITH {VOL}, s AS (SELECT ticker, date, regime, percentile, sum(r.ret) OVER (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING) AS s, CASE WHEN year(date) % 3 > 0 THEN month(date) % 2 END AS label,
    CASE WHEN year(date) % 2 = 0 THEN ['goldilocks', 'stagflation', 'deflation', 'risk_on_growth'][1 + month(date) % 4] END AS macro FROM returns r LEFT JOIN vr USING (ticker, date)),
    t AS (SELECT *, CASE WHEN regime IS NULL THEN 'transition' WHEN percentile >= 95 AND s < -0.1 THEN 'crisis' WHEN regime = 'high' AND coalesce(label, 0) = 0 THEN 'transition' WHEN regime = 'high' THEN 'risk_off' WHEN regime = 'low' THEN 'risk_on'
        WHEN macro IN ('stagflation', 'deflation') THEN 'risk_off' WHEN macro = 'goldilocks' THEN 'risk_on' ELSE 'transition' END AS state FROM s)
    SELECT ticker, date, state, CAST(CASE state WHEN 'risk_on' THEN 1.2 WHEN 'transition' THEN 1.0 WHEN 'risk_off' THEN 0.6 ELSE 0.2 END AS DOUBLE) AS multiplier FROM t""")
def f18(spark, sf):
    dates, month = views.returns(spark, sf).select("date").distinct(), F.month("date")
    labels = dates.filter(F.year("date") % 3 > 0).withColumn("label", month % 2)
    names = F.array(*[F.lit(x) for x in ("goldilocks", "stagflation", "deflation", "risk_on_growth")])
    macro = dates.filter(F.year("date") % 2 == 0).withColumn("regime", names[month % 4])
    return mod.market_state(vol_base(spark, sf), labels, macro).select("ticker", "date", "state", "multiplier")


@query("f19_feature_compression")
def f19(spark, sf):
    return rounded(mod.feature_compression(wide(spark, sf), NAMES, 2))


@query("f20_asset_similarity", f"""WITH v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT a.id, b.id AS other, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6) AS similarity FROM v a JOIN v b ON a.label = b.label AND a.id <> b.id),
    k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, other) AS rank FROM s) SELECT id, other, similarity + 0.0 AS similarity, rank FROM k WHERE rank <= 10""")
def f20(spark, sf):
    v = views.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v"))
    return rounded(embedding.nearest(v).withColumn("rank", F.col("rank").cast("long")))


def monthly(spark, sf) -> DataFrame:
    """Each ticker's return from the last close of a month to that of the next."""
    m = views.bars(spark, sf).groupBy("ticker", F.trunc("date", "month").alias("month")).agg(F.max_by("close", "date").alias("close"))
    before = F.lag("close").over(Window.partitionBy("ticker").orderBy("month"))
    return m.select("ticker", F.col("month").alias("date"), (F.col("close") / before - 1).alias("ret")).filter("ret IS NOT NULL")


@query("f20_correlation_embedding")
def f20_embedding(spark, sf):
    return rounded(embedding.correlation_embedding(monthly(spark, sf))[0])


MONTHLY = """mo AS (SELECT ticker, month AS date, close / lag(close) OVER (PARTITION BY ticker ORDER BY month) - 1 AS ret FROM (SELECT ticker, CAST(date_trunc('month', date) AS DATE) AS month, arg_max(close, date) AS close FROM bars GROUP BY 1, 2)),
    mk AS (SELECT * FROM mo WHERE ret IS NOT NULL AND date IN (SELECT date FROM mo WHERE ret IS NOT NULL GROUP BY date HAVING count(*) = (SELECT count(DISTINCT ticker) FROM mo WHERE ret IS NOT NULL)))"""


@query("f20_embedding_fit", f"""WITH {MONTHLY}, c AS (SELECT a.ticker AS a, b.ticker AS b, corr(a.ret, b.ret) AS c FROM mk a JOIN mk b USING (date) GROUP BY 1, 2), n AS (SELECT count(DISTINCT ticker) AS n, count(DISTINCT date) AS t FROM mk)
    SELECT n AS n_tickers, least(16, n - 1) AS embedding_dim, t AS n_dates, {r('(SELECT sum(c * c) FROM c) / (n * n)')} AS mean_square FROM n WHERE n >= 3 AND t >= 30""")
def f20_fit(spark, sf):
    """The report, with the mean squared correlation that the error and the embedding's own products add up to."""
    vectors, report = embedding.correlation_embedding(monthly(spark, sf))
    names = [c for c in vectors.columns if c != "ticker"]
    # the squared values of the decomposition are those of the columns' lengths
    own = vectors.agg(*[F.sum(F.col(c) ** 2).alias(c) for c in names]).select(sum((F.col(c) ** 2 for c in names), F.lit(0.0)).alias("kept"))
    both = report.join(F.broadcast(own))
    return rounded(both.select("n_tickers", F.col("embedding_dim").cast("long").alias("embedding_dim"), "n_dates", (F.col("reconstruction_mse") + F.col("kept") / F.col("n_tickers") ** 2).alias("mean_square")))


@query("f20_similar_assets")
def f20_similar(spark, sf):
    return rounded(embedding.similar_assets(embedding.correlation_embedding(monthly(spark, sf))[0]))


@query("f21_embeddings_as_of", "WITH s AS (SELECT 'm' || (vec_id % 3) AS model_id, CAST(vec_id AS VARCHAR) AS ticker, CAST(DATE '2024-01-01' + CAST(label AS INT) AS DATE) AS date FROM embeddings), x AS (SELECT * FROM s WHERE model_id = 'm1' AND date < DATE '2024-01-05') SELECT model_id, ticker, date FROM x WHERE date = (SELECT max(date) FROM x)")
def f21(spark, sf):
    e = views.table(spark, sf, "embeddings")
    s = e.select(F.concat(F.lit("m"), (F.col("vec_id") % 3).cast("string")).alias("model_id"), F.col("vec_id").cast("string").alias("ticker"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("label").cast("int")).alias("date"))
    return mod.embeddings_as_of(s, "m1", "2024-01-05")


@query("f22_champion_challenger", f"WITH {ICS}, m AS (SELECT signal AS version, unnest(['ic', 'vol']) AS metric, unnest([avg(ic), stddev_samp(ic)]) AS value FROM ics GROUP BY signal), t AS (SELECT metric, max(value) FILTER (WHERE version = 'mom') AS a, max(value) FILTER (WHERE version = 'rev') AS b FROM m GROUP BY metric) SELECT metric, {r('a')} AS champion, {r('b')} AS challenger, {r('b - a')} AS diff, CASE WHEN metric = 'ic' THEN b - a >= 0 END AS promote FROM t")
def f22(spark, sf):
    m = ics(spark, sf).groupBy(F.col("signal").alias("version")).agg(F.avg("ic").alias("ic"), F.stddev_samp("ic").alias("vol")).unpivot("version", ["ic", "vol"], "metric", "value")
    return rounded(mod.champion_challenger(m, "mom", "rev", "ic"))


@query("f23_promotion_gate", """WITH c AS (SELECT strategy AS model, avg(value) / 50 AS sharpe, -0.1 AS drawdown, list(value - 1000 ORDER BY date) AS windows FROM strategy_pnl GROUP BY 1), g AS (SELECT *, len(list_filter(windows, lambda x: x > 0)) / greatest(len(windows), 1) AS good FROM c)
    SELECT model, CASE WHEN sharpe < 0.5 THEN 'sharpe' WHEN model = 'click' AND (sharpe - 1e6) / 1e6 < 0.02 THEN 'no_improvement' WHEN good < 0.6 THEN 'walk_forward' ELSE 'ok' END AS reason, NOT (sharpe < 0.5 OR model = 'click' OR good < 0.6) AS promote FROM g""")
def f23(spark, sf):
    p = views.strategy_pnl(spark, sf)
    c = p.groupBy(F.col("strategy").alias("model")).agg((F.avg("value") / 50).alias("sharpe"), F.lit(-0.1).alias("drawdown"), F.collect_list(F.col("value") - 1000).alias("windows"))
    return mod.promotion_gate(c, spark.createDataFrame([("click", 1e6)], "model string, sharpe double")).select("model", "promote", "reason")


@query("f24_retained_versions", """WITH v AS (SELECT CAST(o_custkey % 5 AS VARCHAR) AS model, o_orderkey AS version, o_orderdate AS created_at, o_orderkey = 77 AS champion FROM orders), k AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY created_at DESC, version DESC) AS k, max(CAST(champion AS INT)) OVER (PARTITION BY model) = 1 AS has FROM v)
    SELECT model, version, k <= 20 OR champion AS kept, CASE WHEN has THEN champion ELSE k = 1 END AS resolved FROM k""")
def f24(spark, sf):
    v = views.table(spark, sf, "orders").select((F.col("o_custkey") % 5).cast("string").alias("model"), F.col("o_orderkey").alias("version"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderkey") == 77).alias("champion"))
    return mod.retained_versions(v)


PAIR = """pc AS (SELECT x.ticker AS a, y.ticker AS b FROM sectors x JOIN sectors y ON x.ticker < y.ticker AND x.sector = y.sector), pr AS (SELECT a, b, p.date, p.close AS y, q.close AS x FROM pc JOIN bars p ON p.ticker = a JOIN bars q ON q.ticker = b AND q.date = p.date),
    hr AS (SELECT a, b, regr_slope(y, x) AS beta, regr_intercept(y, x) AS alpha, count(*) AS n FROM pr GROUP BY 1, 2 HAVING count(*) >= 252), sp AS (SELECT a, b, date, y - beta * x AS spread FROM pr JOIN hr USING (a, b)),
    st AS (SELECT * FROM (SELECT a, b, lag(spread) OVER (PARTITION BY a, b ORDER BY date) AS x, spread - lag(spread) OVER (PARTITION BY a, b ORDER BY date) AS y FROM sp) WHERE x IS NOT NULL),
    ad AS (SELECT a, b, regr_slope(y, x) AS rho, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy, count(*) AS n FROM st GROUP BY 1, 2), tt AS (SELECT a, b, rho, rho / nullif(sqrt(greatest(syy - rho * sxy, 0) / (n - 2) / nullif(sxx, 0)), 0) AS t FROM ad),
    ap AS (SELECT a, b, t, CASE WHEN t IS NULL THEN 1.0 WHEN t < -3.43 THEN 0.01 WHEN t < -2.86 THEN 0.05 WHEN t < -2.57 THEN 0.1 ELSE 0.5 END::DOUBLE AS p FROM tt), hl AS (SELECT a, b, rho AS phi, CASE WHEN rho < 0 AND rho > -1 THEN -ln(2) / ln(CASE WHEN rho < 0 AND rho > -1 THEN 1 + rho END) END AS half_life FROM tt)"""


def pair_rows(spark, sf) -> DataFrame:
    return pairs.aligned(views.bars(spark, sf), pairs.pair_candidates(views.sectors(spark, sf)))


def pair_statistics(spark, sf) -> DataFrame:
    return pairtiles.pair_statistics(views.bars(spark, sf), pairs.pair_candidates(views.sectors(spark, sf)))


def spreads(spark, sf) -> DataFrame:
    rows = pair_rows(spark, sf)
    return pairs.pair_spread(rows, pairs.pair_hedge_ratio(rows))


@query("g01_pair_candidates", f"WITH {PAIR} SELECT a, b FROM pc")
def g01(spark, sf):
    return pairs.pair_candidates(views.sectors(spark, sf))


@query("g02_pair_hedge_ratio", f"WITH {PAIR} SELECT a, b, {r('beta')} AS beta, round(alpha, 4) + 0.0 AS alpha, n FROM hr")
def g02(spark, sf):
    return rounded(pair_statistics(spark, sf).select("a", "b", "beta", half_up("alpha", 4).alias("alpha"), "n"))


@query("g03_adf_simple", f"WITH {PAIR} SELECT a, b, {r('t')} AS t, p FROM ap")
def g03(spark, sf):
    return rounded(pair_statistics(spark, sf).select("a", "b", "t", "p"))


@query("g04_half_life", f"WITH {PAIR} SELECT a, b, {r('phi')} AS phi, {r('half_life')} AS half_life FROM hl")
def g04(spark, sf):
    return rounded(pair_statistics(spark, sf).select("a", "b", "phi", "half_life"))


@query("g05_find_pairs", f"WITH {PAIR} SELECT a, b, {r('beta')} AS beta, p, {r('half_life')} AS half_life FROM hr JOIN ap USING (a, b) JOIN hl USING (a, b) WHERE p < 0.05 AND half_life > 0 AND half_life < 60 ORDER BY p, hl.half_life, a, b LIMIT 20")
def g05(spark, sf):
    return rounded(pairtiles.find_pairs(views.bars(spark, sf), pairs.pair_candidates(views.sectors(spark, sf))))


@query("g06_pair_spread", f"WITH {PAIR} SELECT a, b, date, round(spread, 4) + 0.0 AS spread FROM sp")
def g06(spark, sf):
    return rounded(spreads(spark, sf), 4)


@query("g07_kalman_pair_signal")
def g07(spark, sf):
    return rounded(pairs.kalman_pair_signal(pair_rows(spark, sf)))


@query("g08_pair_signals_as_of")
def g08(spark, sf):
    return rounded(pairs.pair_signals_as_of(pairs.kalman_pair_signal(pair_rows(spark, sf)), AS_OF))


@query("g09_pair_weights", f"""WITH {PAIR}, s AS (SELECT a, b, beta, CASE WHEN n % 2 = 0 THEN 1 ELSE -1 END AS signal, count(*) OVER () AS m FROM hr), l AS (SELECT a AS ticker, signal / m AS w FROM s UNION ALL SELECT b, -signal * beta / m FROM s) SELECT ticker, {r('sum(w)')} AS weight FROM l GROUP BY ticker""")
def g09(spark, sf):
    h = pairs.pair_hedge_ratio(pair_rows(spark, sf)).withColumn("signal", F.when(F.col("n") % 2 == 0, 1).otherwise(-1))
    return rounded(pairs.pair_weights(h))


@query("rel_ewm_close", f"""WITH k AS (SELECT ticker, date, close, row_number() OVER (PARTITION BY ticker ORDER BY date) AS k FROM bars), w AS (WITH RECURSIVE w AS (SELECT ticker, date, k, close AS ewm FROM k WHERE k = 1 UNION ALL
    SELECT k.ticker, k.date, k.k, w.ewm * (19.0::DOUBLE / 21.0::DOUBLE) + k.close * (2.0::DOUBLE / 21.0::DOUBLE) FROM w JOIN k ON k.ticker = w.ticker AND k.k = w.k + 1) SELECT * FROM w) SELECT ticker, date, {r('ewm')} AS ewm FROM w""")
def rel_ewm(spark, sf):
    """The exponential mean of closes, span 20, along each ticker's dates."""
    return rounded(ordered.ewm(views.bars(spark, sf).select("ticker", "date", "close"), "close", 20, ["ticker"], ["date"]).select("ticker", "date", "ewm"))


@query("rel_asof_orders_quotes", f"""WITH o AS (SELECT order_id, ticker, date, side, fill_px FROM orders_t), q AS (SELECT ticker, date AS quoted, low, high FROM bars) SELECT order_id, o.ticker, date, {r('fill_px')} AS fill_px, CASE WHEN date - quoted <= 10 THEN quoted END AS quoted,
    {r("CASE WHEN date - quoted <= 10 THEN CASE WHEN side = 'buy' THEN high ELSE low END END")} AS px FROM o ASOF LEFT JOIN q ON o.ticker = q.ticker AND o.date > q.quoted""")
def rel_asof(spark, sf):
    """Each order beside the last day's quote of its ticker before its own day, if that is no older than ten days."""
    o = views.orders_t(spark, sf).select("order_id", "ticker", "date", "side", "fill_px")
    q = views.bars(spark, sf).select("ticker", "date", "low", "high")
    j = ordered.asof_join(o, q, ["ticker"], "date", tolerance=10, strict=True)
    return rounded(j.select("order_id", "ticker", "date", "fill_px", F.col("right_date").alias("quoted"), F.when(F.col("side") == "buy", F.col("right_high")).otherwise(F.col("right_low")).alias("px")))
