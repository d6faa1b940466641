"""The fixtures that queries start from, derived from the given tables: once as DataFrames, once as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import Work, kept

TIE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as trades of the part's brand."""
    li = table(spark, sf, "lineitem")
    part = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("ticker"))
    return li.join(part, li.l_partkey == part.p_partkey).select(
        "ticker", F.to_date("l_shipdate").alias("date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"), *TIE, "l_returnflag"
    )


_made: dict[tuple[str, str, str, tuple[int, ...]], tuple[str, StructType]] = {}


def _written_at(spark: SparkSession, sf: str, *names: str) -> tuple[int, ...]:
    """When each table was last written, as far as its folder or file tells."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(f"{sf}/{n}.parquet") for n in names]
    return tuple(p.getFileSystem(conf).getFileStatus(p).getModificationTime() for p in paths)


def _once(spark: SparkSession, sf: str, name: str, make: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """A table that many queries start from, written once a session into the shared folder and read from there, as a
    library on top of stored bars does; again if what it is made of has been written anew."""
    key = (spark.sparkContext.applicationId, sf, name, _written_at(spark, sf, "lineitem", "part"))
    if key not in _made:
        with kept():
            work = Work(spark)
            _made[key] = (work.path(name), work.cut(make(spark, sf), name).schema)
    path, schema = _made[key]
    return spark.read.schema(schema).parquet(path)


def bars(spark: SparkSession, sf: str) -> DataFrame:
    """The daily bars."""
    return _once(spark, sf, "bars", made_bars)


def made_bars(spark: SparkSession, sf: str) -> DataFrame:
    order = F.struct(*TIE)
    return trades(spark, sf).groupBy("ticker", "date").agg(
        F.min_by("px", order).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", order).alias("close"), F.sum("l_quantity").alias("volume")
    )


def sectors(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "part").select(F.col("p_brand").alias("ticker")).distinct()
    return t.select("ticker", F.concat(F.lit("S"), (F.substring("ticker", 7, 9).cast("int") % 5).cast("string")).alias("sector"))


def nav(spark: SparkSession, sf: str) -> DataFrame:
    """A NAV path: 5e7 plus the running sum of signed order totals by day, in exact decimals."""
    from pyspark.sql import Window

    day = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(
        F.sum(F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(-1) * F.col("o_totalprice").cast("decimal(18,2)")).alias("d")
    )
    return day.select("date", (F.lit(50_000_000) + F.sum("d").over(Window.orderBy("date"))).cast("double").alias("nav"))


def strategy_pnl(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("strategy"), F.to_date("ts").alias("date")).agg(
        F.sum(F.col("value").cast("decimal(18,6)")).cast("double").alias("value")
    )


def orders_t(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with their single fill."""
    li, o, b = trades(spark, sf), table(spark, sf, "orders"), bars(spark, sf).select("ticker", "date", F.col("open").alias("decision_px"))
    j = li.join(o.select("o_orderkey", "o_orderdate"), li.l_orderkey == o.o_orderkey).join(b, ["ticker", "date"])
    return j.select(
        F.concat_ws("-", *[F.col(c).cast("long").cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("order_id"),
        "ticker", "date", F.col("o_orderdate").alias("ts"),
        F.when(F.col("l_orderkey") % 2 == 0, "buy").otherwise("sell").alias("side"),
        F.col("l_quantity").alias("filled"), (F.col("l_quantity") + F.col("l_linenumber") % 3).cast("double").alias("target"),
        "decision_px", F.col("px").alias("fill_px"), F.concat(F.lit("st"), (F.col("l_suppkey") % 4).cast("string")).alias("strategy"), "l_returnflag",
    )


def returns(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("ticker").orderBy("date")
    return bars(spark, sf).select("date", "ticker", (F.col("close") / F.lag("close").over(w) - 1).alias("ret")).filter("ret IS NOT NULL")


def factors(spark: SparkSession, sf: str) -> DataFrame:
    """Two factor return series: the mean return of all tickers, and of sectors S0 less S1."""
    r = returns(spark, sf).join(sectors(spark, sf), "ticker")
    d = lambda c: F.sum(F.round(c * 1_000_000).cast("long"))  # noqa: E731  whole numbers: no order of summing matters
    by = r.groupBy("date").agg((d(F.col("ret")) / F.count("*") / 1e6).alias("Market"), (d(F.when(F.col("sector") == "S0", F.col("ret")).when(F.col("sector") == "S1", -F.col("ret")).otherwise(0.0)) / F.count("*") / 1e6).alias("Spread"))
    return by.unpivot("date", ["Market", "Spread"], "factor", "ret")


def weights(spark: SparkSession, sf: str) -> DataFrame:
    """Each day's tickers by rank of close, scaled to -0.5 .. 0.5 over the number of tickers."""
    from pyspark.sql import Window

    x = Window.partitionBy("date")
    return bars(spark, sf).select("date", "ticker", ((F.rank().over(x.orderBy("close")) / F.count("*").over(x) - 0.5) / F.count("*").over(x)).alias("weight"))


def signals(spark: SparkSession, sf: str) -> DataFrame:
    """Three signals (date, ticker, signal, score): momentum, reversal and relative volume."""
    return _once(spark, sf, "signals", made_signals)


def made_signals(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("ticker").orderBy("date")
    c, v = F.col("close"), F.col("volume")
    b = bars(spark, sf).select("date", "ticker", ((c - F.lag("close", 19).over(w)) / F.lag("close", 19).over(w)).alias("mom"), (-(c - F.lag("close", 4).over(w)) / F.lag("close", 4).over(w)).alias("rev"), (v / F.avg("volume").over(w.rowsBetween(-19, 0))).alias("vol"))
    return b.unpivot(["date", "ticker"], ["mom", "rev", "vol"], "signal", "score").filter("score IS NOT NULL")


def fwd(spark: SparkSession, sf: str) -> DataFrame:
    """The return to the next close."""
    from pyspark.sql import Window

    w = Window.partitionBy("ticker").orderBy("date")
    return bars(spark, sf).select("date", "ticker", (F.lead("close").over(w) / F.col("close") - 1).alias("ret")).filter("ret IS NOT NULL")


def chain(spark: SparkSession, sf: str) -> DataFrame:
    """An option chain from parts."""
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(
        F.col("p_brand").alias("ticker"), k.alias("id"), (F.col("p_size") * 20.0).alias("strike"), F.lit(500.0).alias("spot"),
        F.date_add(F.lit("1998-01-01").cast("date"), (k % 180).cast("int")).alias("expiry"),
        (0.1 + (k % 37) / 100.0).alias("implied_vol"), F.when(k % 2 == 0, "put").otherwise("call").alias("option_type"), (k % 500).cast("double").alias("volume"), (k % 300).cast("double").alias("open_interest"),
    )


def estimates(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_orderpriority").alias("ticker"), (F.col("o_custkey") % 20).cast("string").alias("analyst"), F.col("o_orderkey").alias("id"),
        F.concat(F.year("o_orderdate").cast("string"), F.lit("Q"), F.quarter("o_orderdate").cast("string")).alias("period"),
        F.col("o_totalprice").alias("value"), F.to_date("o_orderdate").alias("date"),
    )


CTE = {
    "trades": f"""SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS px, {', '.join(TIE)}, l_returnflag
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "bars": f"""SELECT ticker, date, first(px ORDER BY {', '.join(TIE)}) AS open, max(px) AS high, min(px) AS low,
        last(px ORDER BY {', '.join(TIE)}) AS close, sum(l_quantity) AS volume FROM trades GROUP BY ticker, date""",
    "sectors": "SELECT DISTINCT p_brand AS ticker, 'S' || (CAST(substr(p_brand, 7) AS INT) % 5) AS sector FROM part",
    "nav": """SELECT date, CAST(50000000 + sum(d) OVER (ORDER BY date) AS DOUBLE) AS nav FROM (SELECT CAST(o_orderdate AS DATE) AS date,
        sum(CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END * CAST(o_totalprice AS DECIMAL(18,2))) AS d FROM orders GROUP BY 1)""",
    "strategy_pnl": "SELECT event_type AS strategy, CAST(ts AS DATE) AS date, CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE) AS value FROM events GROUP BY 1, 2",
    "orders_t": """SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS order_id, t.ticker, t.date, o_orderdate AS ts,
        CASE WHEN l_orderkey % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, l_quantity AS filled, CAST(l_quantity + l_linenumber % 3 AS DOUBLE) AS target,
        b.open AS decision_px, px AS fill_px, 'st' || (l_suppkey % 4) AS strategy, l_returnflag
        FROM trades t JOIN orders ON l_orderkey = o_orderkey JOIN bars b ON b.ticker = t.ticker AND b.date = t.date""",
    "returns": "SELECT * FROM (SELECT date, ticker, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM bars) WHERE ret IS NOT NULL",
    "factors": """SELECT date, unnest(['Market', 'Spread']) AS factor, unnest([m, s]) AS ret FROM (SELECT date,
        sum(CAST(round(ret * 1000000) AS BIGINT)) / count(*) / 1e6 AS m,
        sum(CAST(round(CASE sector WHEN 'S0' THEN ret WHEN 'S1' THEN -ret ELSE 0.0 END * 1000000) AS BIGINT)) / count(*) / 1e6 AS s
        FROM returns JOIN sectors USING (ticker) GROUP BY date)""",
    "signals": """SELECT date, ticker, signal, score FROM (SELECT date, ticker, unnest(['mom', 'rev', 'vol']) AS signal, unnest([mom, rev, vol]) AS score FROM (SELECT date, ticker,
        (close - lag(close, 19) OVER w) / lag(close, 19) OVER w AS mom, -(close - lag(close, 4) OVER w) / lag(close, 4) OVER w AS rev,
        volume / avg(volume) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS vol FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date))) WHERE score IS NOT NULL""",
    "fwd": "SELECT * FROM (SELECT date, ticker, lead(close) OVER (PARTITION BY ticker ORDER BY date) / close - 1 AS ret FROM bars) WHERE ret IS NOT NULL",
    "weights": "SELECT date, ticker, (rank() OVER (PARTITION BY date ORDER BY close) / count(*) OVER (PARTITION BY date) - 0.5) / count(*) OVER (PARTITION BY date) AS weight FROM bars",
    "chain": """SELECT p_brand AS ticker, p_partkey AS id, p_size * 20.0 AS strike, 500.0 AS spot, CAST(DATE '1998-01-01' + CAST(p_partkey % 180 AS INT) AS DATE) AS expiry,
        0.1 + (p_partkey % 37) / 100.0 AS implied_vol, CASE WHEN p_partkey % 2 = 0 THEN 'put' ELSE 'call' END AS option_type,
        CAST(p_partkey % 500 AS DOUBLE) AS volume, CAST(p_partkey % 300 AS DOUBLE) AS open_interest FROM part""",
    "estimates": """SELECT o_orderpriority AS ticker, CAST(o_custkey % 20 AS VARCHAR) AS analyst, o_orderkey AS id,
        year(o_orderdate) || 'Q' || quarter(o_orderdate) AS period, o_totalprice AS value, CAST(o_orderdate AS DATE) AS date FROM orders""",
}
NEEDS = {"bars": ["trades"], "orders_t": ["trades", "bars"], "returns": ["bars"], "factors": ["returns", "sectors"], "weights": ["bars"], "signals": ["bars"], "fwd": ["bars"]}


def with_views(body: str) -> str:
    """body with the views in front that it names."""
    import re

    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for name in CTE:
        if re.search(rf"\b{name}\b", body):
            add(name)
    views = [f"{n} AS ({CTE[n]})" for n in order]
    body = body.strip()
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join([*views, body[5:]])
    return ("WITH " + ",\n".join(views) + "\n" if views else "") + body
