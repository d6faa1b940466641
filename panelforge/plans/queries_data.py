"""Queries of data quality (A), technical features (B) and alternative data (C)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import by_ticker, rounded
from ..operators import altdata as alt
from ..operators import quality as qual
from ..operators import technical as tech
from ..session import Work
from ..sources import bars as src
from . import views
from .registry import query

AS_OF = "1998-01-01"
ACTIONS = """SELECT DISTINCT p_brand AS ticker, CAST(DATE '1996-01-01' + CAST(k * 400 AS INT) AS DATE) AS ex_date, CASE WHEN k = 0 THEN 0.5 ELSE 0.98 END AS adjustment_factor
    FROM part, (SELECT unnest([0, 1]) AS k) WHERE CAST(substr(p_brand, 7) AS INT) % 2 = 0"""


def actions(spark: SparkSession, sf: str) -> DataFrame:
    """A split and a dividend for every other ticker."""
    t = views.table(spark, sf, "part").select(F.col("p_brand").alias("ticker")).distinct().filter(F.substring("ticker", 7, 9).cast("int") % 2 == 0)
    k = F.explode(F.array(F.lit(0), F.lit(1))).alias("k")
    return t.select("ticker", k).select("ticker", F.date_add(F.lit("1996-01-01").cast("date"), F.col("k") * 400).alias("ex_date"), F.when(F.col("k") == 0, 0.5).otherwise(0.98).alias("adjustment_factor"))


R = "round({}, 6) + 0.0"


def r(x: str) -> str:
    return R.format(x)


@query("a02_latest_bar", f"SELECT ticker, date, {r('open')} AS open, {r('high')} AS high, {r('low')} AS low, {r('close')} AS close, volume FROM bars QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1")
def a02(spark, sf):
    return rounded(qual.latest_bar(views.bars(spark, sf)))


@query("a03_normalise_vendor_frame", f"SELECT date, ticker, {r('close')} AS close, volume FROM bars")
def a03(spark, sf):
    b = views.bars(spark, sf)
    names = [x.ticker for x in b.select("ticker").distinct().orderBy("ticker").collect()]  # a vendor's columns
    wide = b.groupBy("date").pivot("ticker", names).agg(F.first("close").alias("c"), F.first("volume").alias("v"))
    wide = wide.select("date", *[F.col(f"`{n}_{k}`").alias(f"{f}_{n}") for n in names for k, f in (("c", "adj close"), ("v", "volume"))])
    return rounded(qual.normalise_vendor_frame(wide, ["adj close", "volume"]))


@query("a01_read_bars_csv", f"SELECT date, ticker, {r('close')} AS close, volume FROM bars")
def a01(spark, sf):
    path = Work(spark).path("csv")
    views.bars(spark, sf).select(F.col("date").alias("Date"), F.col("ticker").alias(" Ticker"), F.col("close").alias("Close"), F.col("volume").alias("Volume")).write.csv(path, header=True)
    return rounded(src.read_bars_csv(spark, path))


def monthly(spark, sf) -> DataFrame:
    """Bars dated by their month's first day: as many partitions as months."""
    return views.bars(spark, sf).select("ticker", F.col("date").alias("day"), "close", F.trunc("date", "month").alias("date"))


@query("a04_a05_save_and_load", f"SELECT ticker, date AS day, {r('close')} AS close, CAST(date_trunc('month', date) AS DATE) AS date FROM bars")
def a05(spark, sf):
    root = Work(spark).path("store")
    src.save_dataset(monthly(spark, sf), root, "bars", "raw")
    return rounded(src.load_dataset(spark, root, "bars", "raw", "1900-01-01", "2100-01-01"))


MONTHS = "SELECT DISTINCT CAST(date_trunc('month', date) AS DATE) AS m FROM bars"


@query("a06_purge_old_partitions", f"SELECT count(*) FILTER (WHERE m < DATE '1995-02-01') AS removed, count(*) FILTER (WHERE m >= DATE '1995-02-01') AS kept FROM ({MONTHS})")
def a06(spark, sf):
    path = src.save_dataset(monthly(spark, sf), Work(spark).path("store"), "bars", "raw")
    gone, kept = src.purge_old_partitions(spark, path, "1995-02-01")
    return spark.createDataFrame([(gone, kept)], "removed long, kept long")


@query("a07_storage_stats", f"SELECT min(m) AS oldest, max(m) AS newest, count(*) AS partitions FROM ({MONTHS})")
def a07(spark, sf):
    path = src.save_dataset(monthly(spark, sf), Work(spark).path("store"), "bars", "raw")
    return src.storage_stats(spark, path).select("oldest", "newest", "partitions")


@query("a08_adjustment_factors", f"WITH acts AS ({ACTIONS}) SELECT b.ticker, b.date, {r('coalesce(product(a.adjustment_factor), 1.0)')} AS factor FROM bars b LEFT JOIN acts a ON a.ticker = b.ticker AND b.date < a.ex_date GROUP BY b.ticker, b.date")
def a08(spark, sf):
    return rounded(qual.adjustment_factors(views.bars(spark, sf), actions(spark, sf)).select("ticker", "date", "factor"))


@query("a09_adjust_bars", f"""WITH acts AS ({ACTIONS}), f AS (SELECT b.ticker, b.date, any_value(b.close) AS close, any_value(b.open) AS open, any_value(b.volume) AS volume, coalesce(product(a.adjustment_factor), 1.0) AS factor
    FROM bars b LEFT JOIN acts a ON a.ticker = b.ticker AND b.date < a.ex_date GROUP BY b.ticker, b.date)
    SELECT ticker, date, {r('open * factor')} AS open, {r('close * factor')} AS close, {r('volume / nullif(factor, 0)')} AS volume FROM f""")
def a09(spark, sf):
    return rounded(qual.adjust_bars(views.bars(spark, sf), actions(spark, sf)).select("ticker", "date", "open", "close", "volume"))


@query("a10_validate_bars", f"""WITH x AS (SELECT *, count(*) OVER (PARTITION BY ticker, date) AS copies FROM trades_bars), trades_bars AS (SELECT * FROM bars UNION ALL SELECT * FROM bars WHERE date >= DATE '1998-06-01'),
    s AS (SELECT count(*) AS n, count(*) FILTER (WHERE date >= DATE '{AS_OF}') AS a, count(*) FILTER (WHERE close IS NULL) AS b, count(*) FILTER (WHERE least(open, high, low, close) < 0) AS c, count(*) FILTER (WHERE copies > 1) AS d,
      count(*) FILTER (WHERE open IS NULL) AS e, count(*) FILTER (WHERE high IS NULL) AS f, count(*) FILTER (WHERE low IS NULL) AS g, count(*) FILTER (WHERE coalesce(volume <= 0, true)) AS h
      FROM (SELECT *, count(*) OVER (PARTITION BY ticker, date) AS copies FROM trades_bars)),
    u AS (SELECT n AS total, unnest(['future_date', 'null_close', 'negative_price', 'duplicate_key', 'null_open', 'null_high', 'null_low', 'no_volume']) AS rule,
      unnest(['error', 'error', 'error', 'error', 'warning', 'warning', 'warning', 'warning']) AS severity, unnest([a, b, c, d, e, f, g, h]) AS n FROM s)
    SELECT rule, severity, n, {r('n / total')} AS ratio, CASE WHEN severity = 'error' THEN n > 0 ELSE n / total > 0.05 END AS failed FROM u""")
def a10(spark, sf):
    b = views.bars(spark, sf)
    return rounded(qual.validate_bars(b.union(b.filter("date >= '1998-06-01'")), AS_OF))


@query("a11_offending_rows", f"""WITH x AS (SELECT *, CASE WHEN date >= DATE '{AS_OF}' THEN 'future_date' END AS r1, CASE WHEN close < 950 THEN 'negative_price' END AS r2 FROM (SELECT ticker, date, close - 950 + 950 AS close FROM bars))
    SELECT ticker, date, {r('close - 950')} AS close, unnest(list_filter([r2, r1], lambda v: v IS NOT NULL)) AS rule FROM x""")
def a11(spark, sf):
    b = views.bars(spark, sf).withColumns({c: F.lit(1.0) for c in ("open", "high", "low")}).withColumn("close", F.col("close") - 950)
    return rounded(qual.offending_rows(b, AS_OF).select("ticker", "date", "close", "rule"))


@query("a12_load_prices", f"""WITH acts AS ({ACTIONS}), m AS (SELECT ticker, CAST(date_trunc('month', date) AS DATE) AS date, max(close) AS close FROM bars GROUP BY 1, 2)
    SELECT b.ticker, b.date, {r('any_value(b.close) * coalesce(product(a.adjustment_factor), 1.0)')} AS close FROM m b LEFT JOIN acts a ON a.ticker = b.ticker AND b.date < a.ex_date WHERE b.date < DATE '{AS_OF}' GROUP BY b.ticker, b.date""")
def a12(spark, sf):
    root = Work(spark).path("store")
    agg = [F.max(c).alias(c) for c in ("open", "high", "low", "close", "volume")]
    src.save_dataset(views.bars(spark, sf).groupBy("ticker", F.trunc("date", "month").alias("date")).agg(*agg), root, "bars", "raw")
    return rounded(src.load_prices(spark, root, "bars", AS_OF, actions(spark, sf)).select("ticker", "date", "close"))


@query("a13_universe_as_of", "SELECT DISTINCT ticker FROM bars WHERE date < DATE '1995-06-01' AND close >= 1000 AND volume * close >= 80000 AND CAST(substr(ticker, 7) AS INT) % 3 > 0")
def a13(spark, sf):
    u = views.bars(spark, sf).select("ticker", "date", F.col("close").alias("price"), (F.col("volume") * F.col("close")).alias("adv_usd"), (F.substring("ticker", 7, 9).cast("int") % 3 > 0).alias("active"))
    return qual.universe_as_of(u, "1995-06-01", 80_000.0, 1000.0)


@query("a14_align", f"SELECT ticker, date, {r('close')} AS close FROM bars WHERE date >= DATE '{AS_OF}' - INTERVAL 90 DAY AND date < DATE '{AS_OF}'")
def a14(spark, sf):
    return rounded(qual.align(views.bars(spark, sf), AS_OF, 90).select("ticker", "date", "close"))


@query("a15_has_no_lookahead", f"SELECT coalesce(max(date) < DATE '{AS_OF}', true) AS ok FROM bars")
def a15(spark, sf):
    return qual.has_no_lookahead(views.bars(spark, sf), AS_OF)


@query("a16_training_set", f"SELECT ticker, date, {r('close')} AS close FROM bars WHERE date >= DATE '{AS_OF}' - INTERVAL 378 DAY AND date <= DATE '{AS_OF}'")
def a16(spark, sf):
    return rounded(qual.training_set(views.bars(spark, sf), AS_OF).select("ticker", "date", "close"))


@query("a17_dataset_fingerprint", """WITH h AS (SELECT md5(concat_ws('|', '=' || CAST(round(close * 1e6) AS BIGINT), '=' || date, '=' || ticker, '=' || CAST(volume AS BIGINT), '-')) AS h FROM bars),
    s AS (SELECT sum(('0x' || substr(h, 1, 15))::BIGINT) AS a, sum(('0x' || substr(h, 16, 15))::BIGINT) AS b, count(*) AS n FROM h) SELECT sha256(concat_ws('|', a, b, n)) AS digest, n AS n_rows FROM s""")
def a17(spark, sf):
    b = views.bars(spark, sf).select(F.round(F.col("close") * 1e6).cast("long").alias("close"), "date", "ticker", F.col("volume").cast("long").alias("volume"), F.lit(None).cast("string").alias("zone"))
    return qual.dataset_fingerprint(b)


def registry(spark, sf):
    return views.table(spark, sf, "orders").select((F.col("o_custkey") % 7).cast("string").alias("name"), F.col("o_orderkey").alias("version"), F.md5(F.col("o_totalprice").cast("int").cast("string")).alias("checksum"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderkey") % 50 == 0, "prod").alias("tag"))


REGISTRY = "reg AS (SELECT CAST(o_custkey % 7 AS VARCHAR) AS name, o_orderkey AS version, md5(CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR)) AS checksum, o_orderdate AS created_at, CASE WHEN o_orderkey % 50 = 0 THEN 'prod' END AS tag FROM orders)"


@query("a18_registry_versions", f"WITH {REGISTRY} SELECT name, version, checksum, created_at FROM reg QUALIFY row_number() OVER (PARTITION BY name ORDER BY created_at DESC, version DESC) = 1")
def a18(spark, sf):
    return qual.registry_versions(registry(spark, sf))


@query("a18_registry_by_tag", f"WITH {REGISTRY} SELECT name, tag, version FROM reg WHERE tag IS NOT NULL QUALIFY row_number() OVER (PARTITION BY name, tag ORDER BY created_at DESC, version DESC) = 1")
def a18_tag(spark, sf):
    return qual.registry_by_tag(registry(spark, sf))


@query("a18_registry_verify", f"WITH {REGISTRY} SELECT name, version, true AS intact FROM reg QUALIFY row_number() OVER (PARTITION BY name ORDER BY created_at DESC, version DESC) = 1")
def a18_verify(spark, sf):
    reg = registry(spark, sf)
    return qual.registry_verify(reg, qual.registry_versions(reg).select("name", F.col("checksum").alias("digest")))


@query("a19_bars_to_quotes", f"SELECT ticker, {r('close * (1 - 0.0005)')} AS bid, {r('close * (1 + 0.0005)')} AS ask, {r('close')} AS mid, {r('close')} AS last, volume AS adv FROM bars WHERE date = (SELECT max(date) FROM bars) AND close > 0")
def a19(spark, sf):
    return rounded(qual.bars_to_quotes(views.bars(spark, sf)))


@query("a20_feature_checks", f"""WITH f AS (SELECT unnest(['close', 'lagged']) AS feature, unnest([close, lag(close, 5) OVER (PARTITION BY ticker ORDER BY date)]) AS value FROM bars)
    SELECT feature, count(*) AS n, {r('count(*) FILTER (WHERE value IS NULL) / count(*)')} AS null_ratio, count(*) FILTER (WHERE value < 900 OR value > 2000) AS out_of_range,
    count(*) FILTER (WHERE value IS NULL) / count(*) <= 0.05 AND count(*) FILTER (WHERE value < 900 OR value > 2000) = 0 AS ok FROM f GROUP BY feature""")
def a20(spark, sf):
    f = views.bars(spark, sf).withColumn("lagged", F.lag("close", 5).over(by_ticker())).unpivot(["ticker", "date"], ["close", "lagged"], "feature", "value")
    specs = spark.createDataFrame([("close", 0.05, 900.0, 2000.0), ("lagged", 0.05, 900.0, 2000.0)], "feature string, max_null_ratio double, low double, high double")
    return rounded(qual.feature_checks(f, specs))


W = "OVER (PARTITION BY ticker ORDER BY date)"
ROWS = "OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
N = f"row_number() {W}"
LOGS = f"lb AS (SELECT *, ln(close / lag(close) {W}) AS lr, close - lag(close) {W} AS d FROM bars)"


def past(k: int) -> str:
    return f"coalesce(lag(close, {k}) {W}, first_value(close) {W})"


def feature(name: str, column, sql: str) -> None:
    """Register a technical feature with its SQL over lb, the bars with log returns and differences."""
    @query(name, f"WITH {LOGS} SELECT ticker, date, {r(sql)} AS value FROM lb")
    def q(spark, sf, c=column):
        return rounded(tech.with_features(views.bars(spark, sf), {"value": c()}).select("ticker", "date", "value"))


for _w in (1, 5, 20, 60, 252):
    feature(f"b01_return_{_w}", lambda _w=_w: tech.return_feature(_w), f"CASE WHEN {N} >= 2 THEN (close - {past(_w - 1)}) / nullif({past(_w - 1)}, 0) END")
feature("b02_momentum_12_1", lambda: tech.momentum_12_1(), f"CASE WHEN {N} >= 22 THEN (lag(close, 21) {W} - {past(251)}) / nullif({past(251)}, 0) END")
feature("b03_volatility_20", lambda: tech.volatility(20), f"CASE WHEN {N} >= 3 THEN stddev_samp(lr) {ROWS.format(19)} * sqrt(252) END")
feature("b04_relative_volume_20", lambda: tech.relative_volume(20), f"CASE WHEN {N} >= 2 THEN volume / nullif(avg(volume) {ROWS.format(19)}, 0) END")
feature("b05_short_term_reversal", lambda: tech.short_term_reversal(), f"-(close - lag(close, 4) {W}) / nullif(lag(close, 4) {W}, 0)")
feature("b06_rsi_14", lambda: tech.rsi(14), f"CASE WHEN {N} >= 15 THEN CASE WHEN avg(greatest(-d, 0)) {ROWS.format(13)} = 0 THEN 100 ELSE 100 - 100 / (1 + avg(greatest(d, 0)) {ROWS.format(13)} / nullif(avg(greatest(-d, 0)) {ROWS.format(13)}, 0)) END END")
feature("b07_bollinger_20", lambda: tech.bollinger_position(20), f"CASE WHEN {N} >= 20 THEN CASE WHEN stddev_samp(close) {ROWS.format(19)} = 0 THEN 0.5 ELSE (close - (avg(close) {ROWS.format(19)} - 2 * stddev_samp(close) {ROWS.format(19)})) / (4 * nullif(stddev_samp(close) {ROWS.format(19)}, 0)) END END")
feature("b09_momentum_factor", lambda: tech.momentum_factor(), f"CASE WHEN {N} >= 23 THEN (lag(close, 21) {W} - {past(251)}) / nullif({past(251)}, 0) END")
feature("b10_low_volatility_factor", lambda: tech.low_volatility_factor(), f"CASE WHEN {N} >= 3 AND stddev_samp(lr) {ROWS.format(251)} > 0 THEN -stddev_samp(lr) {ROWS.format(251)} * sqrt(252) END")
feature("b11_value_factor", lambda: tech.value_factor(), f"1 - close / nullif(lag(close, 62) {W}, 0)")
feature("b12_quality_factor", lambda: tech.quality_factor(), f"CASE WHEN {N} >= 3 THEN -stddev_samp(lr) {ROWS.format(59)} END")
feature("b13_size_factor", lambda: tech.size_factor(), f"-ln(close * avg(volume) {ROWS.format(19)})")
feature("b14_reversal_volume_filtered", lambda: tech.reversal_volume_filtered(), f"CASE WHEN lag(close, 5) {W} IS NOT NULL THEN CASE WHEN {N} >= 20 AND volume / nullif(avg(volume) {ROWS.format(19)}, 0) < 1 THEN 0 ELSE -(close - lag(close, 5) {W}) / nullif(lag(close, 5) {W}, 0) END END")
feature("b16_forward_return", lambda: tech.forward_return(5), f"lead(close, 5) {W} / nullif(close, 0) - 1")
feature("b16_trailing_target", lambda: tech.trailing_target(5), f"close / nullif(lag(close, 5) {W}, 0) - 1")


@query("b08_technical_features", f"""WITH {LOGS.replace('FROM bars', f"FROM bars WHERE date < DATE '{AS_OF}'")}, w AS (SELECT ticker, date, {N} AS k,
    CASE WHEN {N} >= 2 THEN (close - {past(19)}) / nullif({past(19)}, 0) END AS ret, CASE WHEN {N} >= 3 THEN stddev_samp(lr) {ROWS.format(19)} * sqrt(252) END AS vol, CASE WHEN {N} >= 2 THEN volume / nullif(avg(volume) {ROWS.format(19)}, 0) END AS rel FROM lb),
    l AS (SELECT ticker, unnest(['return_20d', 'volatility_20d', 'relative_volume_20d']) AS feature, unnest([ret, vol, rel]) AS value FROM w QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1)
    SELECT feature, ticker, {r('value')} AS value FROM l""")
def b08(spark, sf):
    specs = [s for s in tech.default_specs() if s.name in ("return_20d", "volatility_20d", "relative_volume_20d")]
    return rounded(tech.technical_features(views.bars(spark, sf), AS_OF, specs))


@query("b08_technical_features_all")
def b08_all(spark, sf):
    return rounded(tech.technical_features(views.bars(spark, sf), AS_OF))


@query("b15_zscore_reversion", f"""WITH x AS (SELECT ticker, date, CASE WHEN {N} >= 2 THEN (close - {past(5)}) / nullif({past(5)}, 0) END AS v FROM bars), y AS (SELECT *, count(*) OVER (PARTITION BY date) AS n, avg(v) OVER (PARTITION BY date) AS m, stddev_samp(v) OVER (PARTITION BY date) AS s FROM x WHERE v IS NOT NULL)
    SELECT date, ticker, {r('CASE WHEN n >= 3 AND s > 0 THEN -(v - m) / s ELSE 0 END')} AS value FROM y""")
def b15(spark, sf):
    return rounded(tech.zscore_reversion(views.bars(spark, sf)))


CONSENSUS = "cons AS (SELECT ticker, period, avg(v) AS mean, median(v) AS median, count(v) AS n, stddev_samp(v) AS std FROM (SELECT ticker, period, analyst, last(value ORDER BY date, id) AS v FROM estimates WHERE date < DATE '1998-01-01' GROUP BY 1, 2, 3) GROUP BY 1, 2 HAVING count(v) >= 3)"


@query("c01_consensus", f"WITH {CONSENSUS} SELECT ticker, period, {r('mean')} AS mean, {r('median')} AS median, n, {r('std')} AS std FROM cons")
def c01(spark, sf):
    return rounded(alt.consensus(views.estimates(spark, sf), AS_OF))


@query("c02_sue", f"WITH {CONSENSUS}, act AS (SELECT ticker, period, last(value ORDER BY date, id) AS actual FROM estimates GROUP BY 1, 2) SELECT ticker, period, {r('coalesce((actual - mean) / nullif(std, 0), 0)')} AS sue FROM act JOIN cons USING (ticker, period)")
def c02(spark, sf):
    e = views.estimates(spark, sf)
    act = e.groupBy("ticker", "period").agg(F.max_by("value", F.struct("date", "id")).alias("actual"))
    return rounded(alt.sue(act, alt.consensus(e, AS_OF)))


@query("c03_revision_momentum", f"""WITH u AS (SELECT ticker, analyst, value - lag(value) OVER (PARTITION BY ticker, analyst ORDER BY date, id) AS d FROM estimates WHERE date >= DATE '{AS_OF}' - INTERVAL 28 DAY AND date < DATE '{AS_OF}'),
    a AS (SELECT ticker, analyst, coalesce(avg(CASE WHEN d > 0 THEN 1.0 WHEN d <= 0 THEN 0.0 END), 0.5) AS share, count(*) AS k FROM u GROUP BY 1, 2) SELECT ticker, {r('CASE WHEN sum(k) < 2 THEN 0 ELSE avg(share) - 0.5 END')} AS value FROM a GROUP BY ticker""")
def c03(spark, sf):
    return rounded(alt.revision_momentum(views.estimates(spark, sf), AS_OF))


@query("c04_estimate_dispersion", f"SELECT ticker, {r('CASE WHEN count(*) >= 3 AND count(value) >= 2 THEN CASE WHEN abs(avg(value)) <= 1e-10 THEN 0 ELSE -stddev_samp(value) / abs(avg(value)) END END')} AS value FROM estimates GROUP BY ticker")
def c04(spark, sf):
    return rounded(alt.estimate_dispersion(views.estimates(spark, sf)))


FLOW = "fl AS (SELECT ticker, date, (close - open) / open AS flow FROM bars)"


def flows(spark, sf):
    return views.bars(spark, sf).select("ticker", "date", ((F.col("close") - F.col("open")) / F.col("open")).alias("flow"))


@query("c05_etf_flow", f"WITH {FLOW} SELECT ticker, date, {r(f'CASE WHEN {N} >= 5 THEN sum(flow) {ROWS.format(4)} ELSE 0 END')} AS value FROM fl")
def c05(spark, sf):
    return rounded(alt.etf_flow(flows(spark, sf)).drop("flow"))


@query("c06_flow_surprise", f"WITH {FLOW} SELECT ticker, date, {r(f'CASE WHEN {N} >= 60 AND stddev_samp(flow) {ROWS.format(59)} > 0 THEN (avg(flow) {ROWS.format(4)} - avg(flow) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 59 PRECEDING AND 5 PRECEDING)) / stddev_samp(flow) {ROWS.format(59)} ELSE 0 END')} AS value FROM fl")
def c06(spark, sf):
    return rounded(alt.flow_surprise(flows(spark, sf)).drop("flow"))


def macro(spark, sf):
    return views.strategy_pnl(spark, sf).select("date", F.col("strategy").alias("series"), "value")


MACRO = "mac AS (SELECT date, strategy AS series, value FROM strategy_pnl)"
WS = "OVER (PARTITION BY series ORDER BY date)"


@query("c07_yield_curve_slope", f"WITH {MACRO} SELECT date, {r('max(value) FILTER (WHERE series = $$purchase$$) - max(value) FILTER (WHERE series = $$view$$)')} AS slope FROM mac GROUP BY date")
def c07(spark, sf):
    return rounded(alt.yield_curve_slope(alt.macro_wide(macro(spark, sf), ["purchase", "view"]), "purchase", "view").select("date", "slope"))


@query("c08_growth_and_inflation", f"WITH {MACRO} SELECT date, series, {r(f'coalesce(value - lag(value, 4) {WS}, 0)')} AS growth, {r(f'coalesce(value / nullif(lag(value, 12) {WS}, 0) - 1, 0)')} AS inflation FROM mac")
def c08(spark, sf):
    return rounded(alt.inflation_trend(alt.growth_momentum(macro(spark, sf))).select("date", "series", "growth", "inflation"))


@query("c09_macro_regime", f"""WITH {MACRO}, x AS (SELECT date, series, coalesce(value - lag(value, 4) {WS}, 0) > 0 AS up, coalesce(value / nullif(lag(value, 12) {WS}, 0) - 1, 0) > 0.025 AS hot FROM mac),
    g AS (SELECT date, series, CASE WHEN up AND NOT hot THEN 'goldilocks' WHEN up AND hot THEN 'risk_on_growth' WHEN hot THEN 'stagflation' ELSE 'deflation' END AS regime FROM x),
    t(regime, strategy, multiplier) AS (VALUES {", ".join(f"('{g}', '{k}', {m}::DOUBLE)" for g, by in alt.REGIME_MULTIPLIERS.items() for k, m in by.items())})
    SELECT date, series, regime, strategy, multiplier FROM g JOIN t USING (regime)""")
def c09(spark, sf):
    m = alt.inflation_trend(alt.growth_momentum(macro(spark, sf)))
    return alt.regime_multipliers(m.withColumn("regime", alt.macro_regime(F.col("growth"), F.col("inflation")))).select("date", "series", "regime", "strategy", "multiplier")


@query("c10_clean_text", r"""SELECT doc_id, md5(substr(trim(regexp_replace(regexp_replace(regexp_replace(text, 'https?://\S+', '', 'g'), '<[^>]+>', '', 'g'), '\s+', ' ', 'g')), 1, 512)) AS cleaned,
    md5(trim(regexp_replace(substr(trim(regexp_replace(regexp_replace(regexp_replace('RPT-' || text, 'https?://\S+', '', 'g'), '<[^>]+>', '', 'g'), '\s+', ' ', 'g')), 1, 512), '^(UPDATE \d+ -|BRIEF-|RPT-)', ''))) AS headline FROM documents""")
def c10(spark, sf):
    d = views.table(spark, sf, "documents")
    return d.select("doc_id", F.md5(alt.clean_text(F.col("text"))).alias("cleaned"), F.md5(alt.clean_headline(F.concat(F.lit("RPT-"), "text"))).alias("headline"))


_P, _Q = ["worthless", "the", "of"], ["stupid", "and"]


@query("c11_lexicon_sentiment", rf"""WITH t AS (SELECT doc_id, list_distinct(string_split(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), ' ')) AS w FROM documents), h AS (SELECT doc_id, len(list_intersect(w, {_P})) AS p, len(list_intersect(w, {_Q})) AS n FROM t)
    SELECT doc_id, {r('coalesce((p - n) / nullif(p + n, 0), 0)')} AS sentiment FROM h""")
def c11(spark, sf):
    return rounded(views.table(spark, sf, "documents").select("doc_id", alt.lexicon_sentiment(F.col("text"), _P, _Q).alias("sentiment")))


def news(spark, sf):
    d = views.table(spark, sf, "documents")
    return d.select(F.col("source").alias("ticker"), F.col("doc_id").alias("date"), (F.col("n_chars") % 101 / 100.0).alias("score"))


NEWS = "nw AS (SELECT source AS ticker, doc_id AS date, n_chars % 101 / 100.0 AS score FROM documents)"


@query("c12_news_sentiment", f"WITH {NEWS} SELECT ticker, date, {r('score')} AS value FROM nw")
def c12(spark, sf):
    return rounded(alt.news_sentiment(news(spark, sf)).drop("score"))


@query("c12_sentiment_momentum", f"WITH {NEWS} SELECT ticker, date, {r(f'CASE WHEN {N} >= 6 THEN score - avg(score) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) ELSE 0 END')} AS value FROM nw")
def c12_momentum(spark, sf):
    return rounded(alt.sentiment_momentum(news(spark, sf)).drop("score"))


IV = "iv AS (SELECT ticker, id, strike / spot AS moneyness, (expiry - DATE '1998-02-01') / 365.0 AS tte, implied_vol AS iv FROM chain WHERE expiry > DATE '1998-02-01')"


@query("c13_iv_surface", f"WITH {IV} SELECT ticker, id, {r('moneyness')} AS moneyness, {r('tte')} AS tte, {r('iv')} AS iv FROM iv")
def c13(spark, sf):
    return rounded(alt.iv_surface(views.chain(spark, sf), "1998-02-01"))


@query("c14_atm_iv", f"WITH {IV} SELECT ticker, {r('first(iv ORDER BY abs(moneyness - 1), id)')} AS atm_iv FROM iv GROUP BY ticker")
def c14(spark, sf):
    return rounded(alt.atm_iv(alt.iv_surface(views.chain(spark, sf), "1998-02-01")))


@query("c14_iv_skew", f"WITH {IV} SELECT ticker, {r('avg(iv) FILTER (WHERE moneyness <= 0.75) - avg(iv) FILTER (WHERE moneyness >= 1.25)')} AS skew FROM iv GROUP BY ticker")
def c14_skew(spark, sf):
    return rounded(alt.iv_skew(alt.iv_surface(views.chain(spark, sf), "1998-02-01")))


@query("c15_iv_rank", f"""WITH x AS (SELECT ticker, date, high / low AS iv, row_number() OVER (PARTITION BY ticker ORDER BY date) AS k FROM bars),
    s AS (SELECT a.ticker, a.date, a.k, least(a.k, 60) AS n, count(*) FILTER (WHERE b.iv < a.iv) AS below FROM x a JOIN x b ON a.ticker = b.ticker AND b.k BETWEEN a.k - 59 AND a.k GROUP BY ALL)
    SELECT ticker, date, {r('CASE WHEN n < 2 THEN 50 ELSE below / n * 100 END')} AS rank, {r('CASE WHEN n >= 20 THEN -(below / n - 0.5) END')} AS value FROM s""")
def c15(spark, sf):
    b = views.bars(spark, sf).select("ticker", "date", (F.col("high") / F.col("low")).alias("iv"))
    return rounded(alt.iv_rank(b, 60).drop("iv"))


@query("c16_put_call_ratio", f"SELECT ticker, {r('sum(volume) FILTER (WHERE option_type = $$put$$) / nullif(sum(volume) FILTER (WHERE option_type = $$call$$), 0)')} AS ratio FROM chain GROUP BY ticker")
def c16(spark, sf):
    return rounded(alt.put_call_ratio(views.chain(spark, sf)))
