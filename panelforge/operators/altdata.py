"""Features of analyst estimates, ETF flows, macro series, news and option chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import by_ticker, last_rows, ratio

# The words that make a text positive or negative.
POSITIVE = ["upgrade", "beat", "exceeded", "strong", "growth", "profit", "gain", "surge", "rally", "bullish", "outperform", "positive", "higher", "record", "boost", "improve", "optimistic", "upside", "recovery"]
NEGATIVE = ["downgrade", "miss", "missed", "weak", "loss", "decline", "drop", "fall", "bearish", "underperform", "negative", "lower", "cut", "warning", "risk", "pessimistic", "downside", "recession", "crash"]


def consensus(est: DataFrame, as_of: str, min_n: int = 3) -> DataFrame:
    """From each analyst's newest estimate of a (ticker, period) before as_of: mean, median, n, std; n at least min_n.
    Estimates of one date are told apart by id."""
    known = est.filter(F.col("date") < F.lit(as_of).cast("date"))
    newest = known.groupBy("ticker", "period", "analyst").agg(F.max_by("value", F.struct("date", "id")).alias("v"))
    out = newest.groupBy("ticker", "period").agg(F.avg("v").alias("mean"), F.median("v").alias("median"), F.count("v").alias("n"), F.stddev_samp("v").alias("std"))
    return out.filter(F.col("n") >= min_n)


def sue(actuals: DataFrame, agreed: DataFrame) -> DataFrame:
    """(actual - mean) / std of the consensus; 0 without spread."""
    return actuals.join(agreed, ["ticker", "period"]).select("ticker", "period", F.coalesce(ratio(F.col("actual") - F.col("mean"), F.col("std")), F.lit(0.0)).alias("sue"))


def revision_momentum(est: DataFrame, as_of: str, days: int = 28) -> DataFrame:
    """The mean over analysts of their share of upward revisions (0.5 for one estimate), less 0.5; 0 below two rows."""
    at = F.lit(as_of).cast("date")
    near = est.filter((F.col("date") >= F.date_sub(at, days)) & (F.col("date") < at))
    w = Window.partitionBy("ticker", "analyst").orderBy("date", "id")
    up = near.withColumn("d", F.col("value") - F.lag("value").over(w))
    each = up.groupBy("ticker", "analyst").agg(F.coalesce(F.avg((F.col("d") > 0).cast("double")), F.lit(0.5)).alias("share"), F.count("*").alias("rows"))
    out = each.groupBy("ticker").agg(F.avg("share").alias("m"), F.sum("rows").alias("n"))
    return out.select("ticker", F.when(F.col("n") < 2, 0.0).otherwise(F.col("m") - 0.5).alias("value"))


def estimate_dispersion(est: DataFrame) -> DataFrame:
    """-std / |mean| with three rows and two known values at least; 0 for a mean near zero."""
    a = est.groupBy("ticker").agg(F.count("*").alias("rows"), F.count("value").alias("n"), F.stddev_samp("value").alias("sd"), F.avg("value").alias("m"))
    return a.select("ticker", F.when((F.col("rows") >= 3) & (F.col("n") >= 2), F.when(F.abs("m") <= 1e-10, 0.0).otherwise(-ratio(F.col("sd"), F.abs("m")))).alias("value"))


def etf_flow(flows: DataFrame, short: int = 5) -> DataFrame:
    w = by_ticker()
    return flows.withColumn("value", F.when(F.row_number().over(w) >= short, F.sum("flow").over(last_rows(w, short))).otherwise(0.0))


def flow_surprise(flows: DataFrame, short: int = 5, long: int = 60) -> DataFrame:
    """Mean of the last flows less the mean of those before, over the deviation of all of them."""
    w = by_ticker()
    recent, before = F.avg("flow").over(last_rows(w, short)), F.avg("flow").over(w.rowsBetween(-(long - 1), -short))
    sd = F.stddev_samp("flow").over(last_rows(w, long))
    return flows.withColumn("value", F.when((F.row_number().over(w) >= long) & (sd > 0), ratio(recent - before, sd)).otherwise(0.0))


def macro_wide(macro: DataFrame, series: list[str]) -> DataFrame:
    return macro.groupBy("date").pivot("series", series).agg(F.first("value"))


def yield_curve_slope(wide: DataFrame, long: str = "y10", short: str = "y2") -> DataFrame:
    return wide.withColumn("slope", F.col(long) - F.col(short))


def growth_momentum(series: DataFrame, lag: int = 4) -> DataFrame:
    """x less x some rows before, by series; 0 where the series is too short."""
    return series.withColumn("growth", F.coalesce(F.col("value") - F.lag("value", lag).over(by_ticker("series")), F.lit(0.0)))


def inflation_trend(series: DataFrame, lag: int = 12) -> DataFrame:
    return series.withColumn("inflation", F.coalesce(ratio("value", F.lag("value", lag).over(by_ticker("series"))) - 1, F.lit(0.0)))


def macro_regime(growth: Column, inflation: Column, growth_at: float = 0.0, inflation_at: float = 0.025) -> Column:
    """Two by two; both unknown is goldilocks."""
    up, hot = F.coalesce(growth, F.lit(0.0)) > growth_at, F.coalesce(inflation, F.lit(0.0)) > inflation_at
    known = growth.isNotNull() | inflation.isNotNull()
    return F.when(~known, "goldilocks").when(up & ~hot, "goldilocks").when(up & hot, "risk_on_growth").when(~up & hot, "stagflation").otherwise("deflation")


# What each regime does to each kind of strategy.
REGIME_MULTIPLIERS = {
    "goldilocks": {"momentum": 1.2, "value": 1.0, "quality": 0.8, "low_volatility": 0.8, "mean_reversion": 1.0},
    "risk_on_growth": {"momentum": 1.0, "value": 0.8, "quality": 1.0, "low_volatility": 0.6, "mean_reversion": 0.8},
    "stagflation": {"momentum": 0.6, "value": 1.2, "quality": 1.4, "low_volatility": 1.2, "mean_reversion": 0.8},
    "deflation": {"momentum": 0.8, "value": 0.6, "quality": 1.4, "low_volatility": 1.4, "mean_reversion": 1.2},
}


def regime_multipliers(regimes: DataFrame) -> DataFrame:
    """regimes (…, regime) with a row for each kind of strategy and its multiplier."""
    rows = [(r, s, m) for r, by in REGIME_MULTIPLIERS.items() for s, m in by.items()]
    return regimes.join(F.broadcast(regimes.sparkSession.createDataFrame(rows, "regime string, strategy string, multiplier double")), "regime")


def clean_text(text: Column, most: int = 512) -> Column:
    """Without addresses and tags, white space collapsed, trimmed and cut."""
    t = F.regexp_replace(F.regexp_replace(text, r"https?://\S+", ""), r"<[^>]+>", "")
    return F.substring(F.trim(F.regexp_replace(t, r"\s+", " ")), 1, most)


def clean_headline(text: Column) -> Column:
    return F.trim(F.regexp_replace(clean_text(text), r"^(UPDATE \d+ -|BRIEF-|RPT-)", ""))


def lexicon_sentiment(text: Column, positive: list[str] = POSITIVE, negative: list[str] = NEGATIVE) -> Column:
    """(hits of one list less hits of the other) / all hits over distinct lower-case tokens; 0 without hits."""
    tokens = F.array_distinct(F.split(F.lower(F.trim(F.regexp_replace(text, r"\s+", " "))), " "))
    p, n = (F.size(F.array_intersect(tokens, F.array(*[F.lit(x) for x in words]))).cast("double") for words in (positive, negative))
    return F.coalesce(ratio(p - n, p + n), F.lit(0.0))


def news_sentiment(scores: DataFrame, short: int = 1) -> DataFrame:
    return scores.withColumn("value", F.avg("score").over(last_rows(by_ticker(), short)))


def sentiment_momentum(scores: DataFrame, short: int = 1, long: int = 5) -> DataFrame:
    w = by_ticker()
    before = F.avg("score").over(w.rowsBetween(-(short + long - 1), -short))
    return scores.withColumn("value", F.when(F.row_number().over(w) >= short + long, F.avg("score").over(last_rows(w, short)) - before).otherwise(0.0))


def iv_surface(chain: DataFrame, as_of: str) -> DataFrame:
    """(ticker, id, moneyness, tte, iv) of known quotes that expire after as_of."""
    known = chain.filter("implied_vol IS NOT NULL AND strike IS NOT NULL AND expiry IS NOT NULL")
    tte = F.datediff("expiry", F.lit(as_of).cast("date")) / 365.0
    return known.select("ticker", "id", ratio("strike", "spot").alias("moneyness"), tte.alias("tte"), F.col("implied_vol").alias("iv")).filter("tte > 0")


def atm_iv(surface: DataFrame) -> DataFrame:
    """The volatility nearest the money, the first by id among equals."""
    return surface.groupBy("ticker").agg(F.min_by("iv", F.struct(F.abs(F.col("moneyness") - 1), F.col("id"))).alias("atm_iv"))


def iv_skew(surface: DataFrame, low: float = 0.75, high: float = 1.25) -> DataFrame:
    return surface.groupBy("ticker").agg((F.avg(F.when(F.col("moneyness") <= low, F.col("iv"))) - F.avg(F.when(F.col("moneyness") >= high, F.col("iv")))).alias("skew"))


def share_below(value: str, frame_rows: Column) -> Column:
    """The share of a collected frame below the current value."""
    return F.size(F.filter(frame_rows, lambda x: x < F.col(value))) / F.size(frame_rows)


def iv_rank(ivs: DataFrame, w: int = 252) -> DataFrame:
    """rank: the share of the window below the newest value, in percent (50 with one row); value: 0.5 - share, from 20
    rows on. The frame holds w values at most."""
    frame = ivs.withColumn("__f", F.collect_list("iv").over(last_rows(by_ticker(), w)))
    n = F.size("__f")
    share = share_below("iv", F.col("__f"))
    return frame.withColumns({"rank": F.when(n < 2, 50.0).otherwise(share * 100), "value": F.when(n >= 20, -(share - 0.5))}).drop("__f")


def put_call_ratio(chain: DataFrame) -> DataFrame:
    """Put over call volume, over open interest where no call traded; null without calls."""
    part = lambda kind, c: F.sum(F.when(F.col("option_type") == kind, F.col(c)).otherwise(0.0))
    a = chain.groupBy("ticker").agg(part("put", "volume").alias("pv"), part("call", "volume").alias("cv"), part("put", "open_interest").alias("po"), part("call", "open_interest").alias("co"))
    return a.select("ticker", F.coalesce(ratio("pv", "cv"), ratio("po", "co")).alias("ratio"))
