"""Column helpers that the operators share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_ticker(*keys: str) -> WindowSpec:
    return Window.partitionBy(*(keys or ("ticker",))).orderBy("date")


def last_rows(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is zero."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.when(b != 0, a / F.when(b != 0, b))


def average_rank(value: Column | str, w: WindowSpec) -> Column:
    """The mean of the ranks that equal values share, in one window. w: the partition alone."""
    o = w.orderBy(F.col(value) if isinstance(value, str) else value)
    return F.rank().over(o) + (F.count("*").over(o.rangeBetween(Window.currentRow, Window.currentRow)) - 1) / 2


def exact_sum(x: Column | str, over: WindowSpec | None = None) -> Column:
    """The sum of doubles as decimals of eighteen places, rounded to twelve, so that neither the order of adding them nor an
    engine's way from doubles to decimals matters, and small terms count. Below 1e20."""
    x = F.col(x) if isinstance(x, str) else x
    total = F.sum(x.cast("decimal(38,18)"))
    return (total if over is None else total.over(over)).cast("decimal(38,12)").cast("double")


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson's correlation, null where a side does not vary."""
    return ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def z_of(value: Column | str, w: WindowSpec, none: float | None = 0.0) -> Column:
    """(value - mean) / sample deviation; none where the deviation is null or zero."""
    v = F.col(value) if isinstance(value, str) else value
    sd = F.stddev_samp(v).over(w)
    return F.when(v.isNotNull(), F.when(sd > 0, (v - F.avg(v).over(w)) / sd).otherwise(none))


def require_columns(df: DataFrame, *names: str) -> None:
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def half_up(x: Column | str, places: int = 6) -> Column:
    """x rounded as the nearest whole number of units of the last place: what other engines do with doubles."""
    x = F.col(x) if isinstance(x, str) else x
    return F.round(x * float(10**places), 0) / float(10**places)


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """df with its doubles rounded, negative zeros and NaN made zero and null."""
    def one(c: str, t: str) -> Column:
        if t != "double":
            return F.col(c)
        r = half_up(c, places)
        return F.when(F.isnan(r), None).when(r == 0, 0.0).otherwise(r).alias(c)

    return df.select(*[one(c, t) for c, t in df.dtypes])


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def sessions(df: DataFrame, keys: list[str], order: list[str], gap_s: float, ts: str = "ts", out: str = "__session") -> DataFrame:
    """df with a number that rises where at least gap_s seconds lie between a row and the one before it of the same
    keys. A rule that forgets what is gap_s old starts anew there, so it can be worked off by session: a group then
    holds one burst, not a key's whole history."""
    w = Window.partitionBy(*keys).orderBy(ts, *order)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    starts = F.coalesce(at - F.lag(at).over(w) >= int(gap_s * 1_000_000), F.lit(True))
    return df.withColumn("__starts", starts.cast("int")).withColumn(out, F.sum("__starts").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__starts")
