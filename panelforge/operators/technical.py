"""Technical features of each (ticker, date), on all rows of a ticker up to that date. One sort by (ticker, date) serves
every feature that is asked for together."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.columns import by_ticker, last_rows, ratio, z_of

YEAR = 252


def _w() -> WindowSpec:
    return by_ticker()


def _all() -> WindowSpec:
    return _w().rowsBetween(Window.unboundedPreceding, 0)


def _n() -> Column:
    """A row's place in its ticker's history."""
    return F.row_number().over(_w())


def _back(c: str, rows: int) -> Column:
    """The value some rows before, or the first one."""
    return F.coalesce(F.lag(c, rows).over(_w()), F.first(c).over(_all()))


def return_feature(w: int = 20, steps: bool = False) -> Column:
    """Change since the w-th last row (w - 1 steps, or w if steps); null before the second row or from zero."""
    past = _back("close", w if steps else w - 1)
    return F.when(_n() >= 2, ratio(F.col("close") - past, past))


def momentum_12_1() -> Column:
    past = _back("close", YEAR - 1)
    return F.when(_n() >= 22, ratio(F.lag("close", 21).over(_w()) - past, past))


def log_return() -> Column:
    before = F.lag("close").over(_w())
    return F.when((F.col("close") > 0) & (before > 0), F.ln(F.when(before > 0, F.col("close") / before)))


def volatility(w: int = 20, annual: bool = True) -> Column:
    """Sample deviation of the last log returns, by the year; from three rows on."""
    sd = F.stddev_samp("__log").over(last_rows(_w(), w))
    return F.when(_n() >= 3, sd * (YEAR**0.5 if annual else 1.0))


def relative_volume(w: int = 20) -> Column:
    mean = F.avg("volume").over(last_rows(_w(), w))
    return F.when((_n() >= 2) & (mean > 0), ratio("volume", mean))


def short_term_reversal(rows: int = 5) -> Column:
    past = F.lag("close", rows - 1).over(_w())
    return -ratio(F.col("close") - past, past)


def rsi(w: int = 14) -> Column:
    """By simple means of the last gains and losses; 100 without a loss."""
    d = F.col("__diff")
    gain, loss = (F.avg(F.greatest(x, F.lit(0.0))).over(last_rows(_w(), w)) for x in (d, -d))
    return F.when(_n() >= w + 1, F.when(loss == 0, 100.0).otherwise(100 - 100 / (1 + ratio(gain, loss))))


def bollinger_position(w: int = 20, k: float = 2.0) -> Column:
    mean, sd = F.avg("close").over(last_rows(_w(), w)), F.stddev_samp("close").over(last_rows(_w(), w))
    return F.when(_n() >= w, F.when(sd == 0, 0.5).otherwise(ratio(F.col("close") - (mean - k * sd), 2 * k * sd)))


def momentum_factor(long: int = YEAR, skip: int = 21) -> Column:
    past = _back("close", long - 1)
    return F.when(_n() >= skip + 2, ratio(F.lag("close", skip).over(_w()) - past, past))


def low_volatility_factor(w: int = YEAR) -> Column:
    v = volatility(w)
    return F.when(v > 0, -v)


def value_factor(metric: str | None = None, lookback: int = 63) -> Column:
    """The newest known fundamental; without one the negated return over the lookback."""
    past = F.lag("close", lookback - 1).over(_w())
    trend = -ratio(F.col("close"), past) + 1
    return F.coalesce(F.last(metric, ignorenulls=True).over(_all()), trend) if metric else trend


def quality_factor(weights: tuple[float, float, float] = (0.4, 0.3, 0.3), columns: tuple[str, str, str] | None = None) -> Column:
    """Weighted mean of what is known of return on equity, stability and negated accruals; else -volatility over 60."""
    low = -volatility(60, annual=False)
    if not columns:
        return low
    known = [F.last(c, ignorenulls=True).over(_all()) * s for c, s in zip(columns, (1, 1, -1))]
    top = sum((F.coalesce(x * w, F.lit(0.0)) for x, w in zip(known, weights)), F.lit(0.0))
    share = sum((F.when(x.isNotNull(), w).otherwise(0.0) for x, w in zip(known, weights)), F.lit(0.0))
    return F.coalesce(ratio(top, share), low)


def size_factor(market_cap: str | None = None) -> Column:
    """-ln of the newest market value; without one of close times mean volume over 20."""
    proxy = F.col("close") * F.avg("volume").over(last_rows(_w(), 20))
    cap = F.last(market_cap, ignorenulls=True).over(_all()) if market_cap else proxy
    return F.when(cap > 0, -F.ln(F.when(cap > 0, cap)))


def reversal_volume_filtered(ret: int = 5, vol: int = 20, threshold: float = 1.0) -> Column:
    past = F.lag("close", ret).over(_w())
    mean = F.avg("volume").over(last_rows(_w(), vol))
    quiet = (_n() >= vol) & (ratio("volume", mean) < threshold)
    return F.when(past.isNotNull(), F.when(quiet, 0.0).otherwise(-ratio(F.col("close") - past, past)))


def prepared(bars: DataFrame) -> DataFrame:
    """bars with the steps that several features share."""
    return bars.withColumns({"__log": log_return(), "__diff": F.col("close") - F.lag("close").over(_w())})


def with_features(bars: DataFrame, features: dict[str, Column]) -> DataFrame:
    return prepared(bars).withColumns(features).drop("__log", "__diff")


def zscore_reversion(bars: DataFrame, ret: int = 5) -> DataFrame:
    """(date, ticker, value): the negated score of the return over ret steps among the date's tickers; 0 with fewer
    than three of them or without spread."""
    r = with_features(bars, {"r": return_feature(ret + 1)}).filter("r IS NOT NULL")
    x = Window.partitionBy("date")
    value = F.when(F.count("r").over(x) >= 3, -z_of("r", x)).otherwise(0.0)
    return r.select("date", "ticker", value.alias("value"))


def forward_return(h: int = 5) -> Column:
    return ratio(F.lead("close", h).over(_w()), "close") - 1


def trailing_target(h: int = 5) -> Column:
    return ratio("close", F.lag("close", h).over(_w())) - 1


@dataclass(frozen=True)
class FeatureSpec:
    """A feature for the registry: its column, the largest share of nulls, its range."""

    name: str
    column: Column
    max_null_ratio: float = 0.5
    low: float = float("-inf")
    high: float = float("inf")


def default_specs() -> list[FeatureSpec]:
    returns = [FeatureSpec(f"return_{w}d", return_feature(w), 0.5, -1.0) for w in (1, 5, 20, 60, 252)]
    return [
        *returns, FeatureSpec("momentum_12_1", momentum_12_1(), 0.5, -1.0), FeatureSpec("volatility_20d", volatility(20), 0.5, 0.0), FeatureSpec("volatility_60d", volatility(60), 0.5, 0.0),
        FeatureSpec("relative_volume_20d", relative_volume(20), 0.5, 0.0), FeatureSpec("short_term_reversal", short_term_reversal()), FeatureSpec("rsi_14", rsi(14), 0.5, 0.0, 100.0), FeatureSpec("bollinger_20d", bollinger_position(20)),
    ]


def technical_features(bars: DataFrame, as_of: str, specs: list[FeatureSpec] | None = None) -> DataFrame:
    """(feature, ticker, value) at the newest row of each ticker before as_of, for the features whose nulls and range
    are within their specs."""
    specs = specs or default_specs()
    known = bars.filter(F.col("date") < F.lit(as_of).cast("date"))
    wide = with_features(known, {s.name: s.column for s in specs})
    last = wide.groupBy("ticker").agg(F.max_by(F.struct(*[s.name for s in specs]), "date").alias("r")).select("ticker", "r.*")
    long = last.unpivot("ticker", [s.name for s in specs], "feature", "value")
    limit = F.create_map(*[x for s in specs for x in (F.lit(s.name), F.lit(s.max_null_ratio))])[F.col("feature")]
    low, high = (F.create_map(*[x for s in specs for x in (F.lit(s.name), F.lit(float(getattr(s, k))))])[F.col("feature")] for k in ("low", "high"))
    x = Window.partitionBy("feature")
    nulls = F.avg(F.when(F.col("value").isNull(), 1.0).otherwise(0.0)).over(x)
    outside = F.max(F.when((F.col("value") < low) | (F.col("value") > high), 1).otherwise(0)).over(x)
    return long.withColumns({"__n": nulls, "__o": outside}).filter((F.col("__n") <= limit) & (F.col("__o") == 0)).select("feature", "ticker", "value")
