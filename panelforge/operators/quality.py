"""Data quality, corporate actions and point-in-time selection over bars (date, ticker, open, high, low, close, volume)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio, require_columns

PRICES = ("open", "high", "low", "close")


def latest_bar(bars: DataFrame) -> DataFrame:
    """The newest row of each ticker. One partial aggregate, no sort."""
    newest = bars.groupBy("ticker").agg(F.max_by(F.struct(*[c for c in bars.columns if c != "ticker"]), "date").alias("r"))
    return newest.select("ticker", "r.*")


def normalise_vendor_frame(df: DataFrame, fields: list[str]) -> DataFrame:
    """Wide vendor columns '<field>_<ticker>' to (date, ticker, field...), 'adj close' as close, without null closes."""
    tickers = sorted({c.rsplit("_", 1)[1] for c in df.columns if "_" in c})
    clean = {"adj close": "close"}
    one = F.explode(F.array(*[F.struct(F.lit(t).alias("ticker"), *[F.col(f"`{f}_{t}`").alias(clean.get(f, f).replace(" ", "_")) for f in fields]) for t in tickers]))
    return df.select("date", one.alias("r")).select("date", "r.*").filter("close IS NOT NULL")


def adjustment_factors(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """bars with factor: the product of adjustment_factor of the ticker's actions with date < ex_date. The actions' own
    suffix products become date ranges, so a bar meets one range, not each action."""
    w = Window.partitionBy("ticker").orderBy("ex_date")
    daily = actions.groupBy("ticker", "ex_date").agg(F.product("adjustment_factor").alias("f"))
    after = w.rowsBetween(0, Window.unboundedFollowing)
    spans = daily.select("ticker", F.col("ex_date").alias("__until"), F.lag("ex_date").over(w).alias("__from"), F.product("f").over(after).alias("__f"))
    b, s = bars.alias("b"), spans.alias("s")
    on = (F.col("b.ticker") == F.col("s.ticker")) & (F.col("b.date") < F.col("s.__until")) & (F.col("s.__from").isNull() | (F.col("b.date") >= F.col("s.__from")))
    return b.join(s, on, "left").select("b.*", F.coalesce("s.__f", F.lit(1.0)).alias("factor"))


def adjust_bars(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """Prices times the factor, volume over it (null for a zero factor)."""
    f = adjustment_factors(bars, actions)
    return f.withColumns({c: F.col(c) * F.col("factor") for c in PRICES} | {"volume": ratio("volume", "factor")})


def bar_rules(as_of: str) -> dict[str, tuple[str, Column]]:
    bad = lambda c: F.col(c).isNull() | F.isnan(c)
    return {
        "future_date": ("error", F.col("date") >= F.lit(as_of).cast("date")),
        "null_close": ("error", bad("close")),
        "negative_price": ("error", F.greatest(*[F.when(F.col(c) < 0, 1).otherwise(0) for c in PRICES]) == 1),
        "duplicate_key": ("error", F.col("__copies") > 1),
    }


def _marked(bars: DataFrame, as_of: str) -> DataFrame:
    require_columns(bars, "date", "ticker", "close")
    copies = F.count("*").over(Window.partitionBy("ticker", "date"))
    return bars.withColumn("__copies", copies)


def validate_bars(bars: DataFrame, as_of: str, limit: float = 0.05) -> DataFrame:
    """(rule, severity, n, ratio, failed): errors fail with one row, warnings beyond the limit. One pass."""
    rules = bar_rules(as_of)
    warn = {f"null_{c}": F.col(c).isNull() for c in ("open", "high", "low")} | {"no_volume": F.coalesce(F.col("volume") <= 0, F.lit(True))}
    every = {**{k: v[1] for k, v in rules.items()}, **warn}
    sums = _marked(bars, as_of).agg(F.count("*").alias("n"), *[F.sum(F.when(c, 1).otherwise(0)).alias(k) for k, c in every.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.lit("error" if k in rules else "warning").alias("severity"), F.coalesce(k, F.lit(0)).cast("long").alias("hits"), F.col("n").alias("total")) for k in every]))
    out = sums.select(rows.alias("r")).select("r.rule", "r.severity", F.col("r.hits").alias("n"), F.coalesce(ratio(F.col("r.hits").cast("double"), F.col("r.total")), F.lit(0.0)).alias("ratio"))
    return out.withColumn("failed", F.when(F.col("severity") == "error", F.col("n") > 0).otherwise(F.col("ratio") > limit))


def offending_rows(bars: DataFrame, as_of: str) -> DataFrame:
    """The rows behind the errors, once for each rule they break."""
    tags = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, (_, c) in bar_rules(as_of).items()]))
    return _marked(bars, as_of).withColumn("rule", F.explode(tags)).drop("__copies")


def universe_as_of(u: DataFrame, as_of: str, min_adv: float = 5e6, min_price: float = 5.0, include_delisted: bool = False) -> DataFrame:
    """Distinct tickers with a row before as_of that is active (unless delisted ones count), liquid and dear enough."""
    rows = u.filter((F.col("date") < F.lit(as_of).cast("date")) & (F.col("adv_usd") >= min_adv) & (F.col("price") >= min_price))
    return (rows if include_delisted else rows.filter("active")).select("ticker").distinct()


class LookAhead(ValueError):
    """Rows at or after as_of in a frame that may not hold any."""


def align(df: DataFrame, as_of: str, lookback_days: int | None = None, strict: bool = False) -> DataFrame:
    """Rows of [as_of - lookback, as_of) in calendar days; strict raises if a row is at or after as_of."""
    at = F.lit(as_of).cast("date")
    if strict and not df.filter(F.col("date") >= at).isEmpty():
        raise LookAhead(f"rows at or after {as_of}")
    kept = df.filter(F.col("date") < at)
    return kept if lookback_days is None else kept.filter(F.col("date") >= F.date_sub(at, lookback_days))


def has_no_lookahead(df: DataFrame, as_of: str) -> DataFrame:
    return df.agg((F.coalesce(F.max("date") < F.lit(as_of).cast("date"), F.lit(True))).alias("ok"))


def training_set(df: DataFrame, cutoff: str, lookback_days: int = 252) -> DataFrame:
    """The closed window [cutoff - int(1.5 * lookback) days, cutoff]."""
    at = F.lit(cutoff).cast("date")
    return df.filter((F.col("date") >= F.date_sub(at, int(1.5 * lookback_days))) & (F.col("date") <= at))


def dataset_fingerprint(df: DataFrame) -> DataFrame:
    """One row: a digest of the content that no order of rows changes, and the number of rows. A row is the MD5 of its
    columns' texts in the order of their names, nulls told from empty texts; two 60-bit parts of it are summed exactly."""
    texts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in sorted(df.columns)]
    h = F.md5(F.concat_ws("|", *texts))
    part = lambda at: F.conv(F.substring(h, at, 15), 16, 10).cast("decimal(38,0)")
    parts = df.agg(F.sum(part(1)).alias("a"), F.sum(part(16)).alias("b"), F.count("*").alias("n"))
    return parts.select(F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in "abn"]), 256).alias("digest"), F.col("n").alias("n_rows"))


def registry_versions(registry: DataFrame) -> DataFrame:
    """The newest version of each dataset name; rows (name, version, checksum, created_at, tag)."""
    return registry.groupBy("name").agg(F.max_by(F.struct("version", "checksum", "created_at"), F.struct("created_at", "version")).alias("r")).select("name", "r.*")


def registry_by_tag(registry: DataFrame) -> DataFrame:
    """The version each (name, tag) points to: the newest row wins."""
    return registry.filter("tag IS NOT NULL").groupBy("name", "tag").agg(F.max_by("version", F.struct("created_at", "version")).alias("version"))


def registry_verify(registry: DataFrame, digests: DataFrame) -> DataFrame:
    """Is each dataset's present digest (name, digest) that of its newest version?"""
    return registry_versions(registry).join(digests, "name").select("name", "version", (F.col("checksum") == F.col("digest")).alias("intact"))


def bars_to_quotes(bars: DataFrame, half_spread_bps: float = 5.0, default_adv: float = 1e6) -> DataFrame:
    """Quotes of the newest date, around positive closes."""
    newest = F.broadcast(bars.agg(F.max("date").alias("__d")))  # one row
    rows = bars.join(newest, F.col("date") == F.col("__d")).filter("close > 0")
    c, h = F.col("close"), half_spread_bps / 1e4
    return rows.select("ticker", (c * (1 - h)).alias("bid"), (c * (1 + h)).alias("ask"), c.alias("mid"), c.alias("last"), F.coalesce("volume", F.lit(default_adv)).alias("adv"))


def feature_checks(features: DataFrame, specs: DataFrame) -> DataFrame:
    """For long features (feature, value) and specs (feature, max_null_ratio, low, high): share of nulls within its
    limit, and all values within range. specs is a small parameter table."""
    v = F.col("value")
    j = features.join(F.broadcast(specs), "feature")
    out = j.groupBy("feature").agg(
        F.count("*").alias("n"), F.avg(F.when(v.isNull(), 1.0).otherwise(0.0)).alias("null_ratio"),
        F.sum(F.when((v < F.col("low")) | (v > F.col("high")), 1).otherwise(0)).alias("out_of_range"), F.first("max_null_ratio").alias("limit"),
    )
    return out.select("feature", "n", "null_ratio", "out_of_range", ((F.col("null_ratio") <= F.col("limit")) & (F.col("out_of_range") == 0)).alias("ok"))
