"""Orders, schedules, microstructure, fills, reconciliation and sessions."""

from __future__ import annotations

from collections import deque

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chains import accepted_times
from ..functions.columns import last_rows, ratio, sessions
from ..session import Work

# The day's volume by half hour, from the open.
VOLUME_PROFILE = [0.12, 0.08, 0.07, 0.06, 0.06, 0.06, 0.06, 0.06, 0.06, 0.06, 0.07, 0.09, 0.15]

# Full-day closures, and days that close at 13:00.
HOLIDAYS = [
    "2024-01-01", "2024-01-15", "2024-02-19", "2024-03-29", "2024-05-27", "2024-06-19", "2024-07-04", "2024-09-02", "2024-11-28", "2024-12-25",
    "2025-01-01", "2025-01-20", "2025-02-17", "2025-04-18", "2025-05-26", "2025-06-19", "2025-07-04", "2025-09-01", "2025-11-27", "2025-12-25",
    "2026-01-01", "2026-01-19", "2026-02-16", "2026-04-03", "2026-05-25", "2026-06-19", "2026-07-03", "2026-09-07", "2026-11-26", "2026-12-25",
]
EARLY_CLOSES = ["2024-07-03", "2024-11-29", "2024-12-24", "2025-07-03", "2025-11-28", "2025-12-24", "2026-11-27", "2026-12-24"]


def generate_orders(weights: DataFrame, positions: DataFrame, prices: DataFrame, nav: float, lot: int = 1, least_value: float = 1000.0) -> DataFrame:
    """(ticker, side, quantity, value): from positions (ticker, qty) to weights (ticker, weight) at prices (ticker, px),
    to whole lots by half to even; small changes fall away."""
    j = weights.join(positions, "ticker", "full").join(prices, "ticker")
    want = F.coalesce("weight", F.lit(0.0)) * nav / F.col("px")
    delta = F.bround((want - F.coalesce("qty", F.lit(0.0))) / lot) * lot
    d = j.filter("px > 0").withColumn("d", delta).filter((F.abs("d") >= 1) & (F.abs("d") * F.col("px") >= least_value))
    return d.select("ticker", F.when(F.col("d") > 0, "buy").otherwise("sell").alias("side"), F.abs("d").cast("long").alias("quantity"), (F.abs("d") * F.col("px")).alias("value"))


def liquidation_orders(positions: DataFrame, prices: DataFrame) -> DataFrame:
    """The opposite side of every position that has a price."""
    j = positions.filter("qty <> 0").join(prices.filter("px > 0"), "ticker")
    return j.select(*[c for c in positions.columns if c != "qty"], F.when(F.col("qty") > 0, "sell").otherwise("buy").alias("side"), F.abs("qty").cast("long").alias("quantity"))


def order_safety_report(orders: DataFrame, max_shares: float = 1e6, pct_nav: float = 0.05, pct_adv: float = 0.10, fat_finger: float = 10.0, limit_bps: float = 500.0) -> DataFrame:
    """A row for each order (ticker, side, order_type, quantity, limit_price, mid, nav, adv, position, cash) and check
    that it fails."""
    q, mid = F.col("quantity"), F.col("mid")
    checks = {
        "quantity_positive": q <= 0,
        "ticker_valid": F.trim(F.coalesce("ticker", F.lit(""))) == "",
        "max_shares": q > max_shares,
        "max_pct_nav": (F.col("nav") > 0) & (mid > 0) & (q * mid > pct_nav * F.col("nav")),
        "max_pct_adv": (F.col("adv") > 0) & (q > pct_adv * F.col("adv")),
        "fat_finger": (F.col("position") != 0) & (F.abs(q) > fat_finger * F.abs("position")),
        "limit_price_sanity": (F.col("order_type") == "limit") & (mid > 0) & (F.abs(F.col("limit_price") - mid) > limit_bps / 1e4 * mid),
        "buying_power": (F.col("side") == "buy") & (mid > 0) & (q * mid > F.col("cash")),
    }
    return orders.withColumn("check", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))))


def order_rate_and_duplicate_flags(orders: DataFrame, per_second: int = 5, window_s: float = 60.0) -> DataFrame:
    """(order_id, ticker, rate_limited, duplicate) of orders (order_id, ticker, side, quantity, ts), where only accepted
    ones count. Repeats of a ticker's side and quantity within the window go by pointers from time to time. The rate gives
    each time of a ticker a quota: what is left of the second's, as orders of one time differ by their order alone. A
    ticker's times run past it in order, a burst (a second's pause ends it) in one task but never in memory together.
    Orders are written once and shuffled once, by ticker and time, with the accepted times and the quotas in front."""
    own = Work(orders.sparkSession).cut(orders.select("order_id", "ticker", "side", "quantity", F.col("ts").cast("timestamp").alias("ts")), "orders")
    at = F.unix_micros("ts").alias("at")
    kind = dict(own.dtypes)["ticker"]
    bursts = sessions(own.filter("ts IS NOT NULL").groupBy("ticker", "ts").count(), ["ticker"], [], 1.0)
    ran = bursts.repartition("ticker", "__session").sortWithinPartitions("ticker", "__session", "ts")

    def quotas(batches):
        burst, recent, held = None, deque(), 0
        for b in batches:
            out = []
            for ticker, session, now, n in zip(*(b.column(i).to_pylist() for i in range(4))):
                if (ticker, session) != burst:
                    burst, recent, held = (ticker, session), deque(), 0
                while recent and now - recent[0][0] >= 1_000_000:
                    held -= recent.popleft()[1]
                out.append(min(n, max(per_second - held, 0)))
                if out[-1]:
                    recent.append((now, out[-1]))
                    held += out[-1]
            yield pa.record_batch([b.column(0), b.column(2), pa.array(out, pa.int64())], ["ticker", "at", "quota"])

    quota = ran.select("ticker", "__session", at, "count").mapInArrow(quotas, f"ticker {kind}, at long, quota long").withColumn("turn", F.lit(-1))
    rows = own.select("ticker", at, "side", "quantity", "order_id", F.lit(1).alias("turn"), F.when(F.col("ts").isNull(), F.xxhash64("order_id")).alias("apart"))
    repeats = int(window_s * 1_000_000) > 0
    if repeats:
        quota = quota.unionByName(accepted_times(own, ["ticker", "side", "quantity"], window_s).select("key.*", "at", F.lit(0).alias("turn")), allowMissingColumns=True)
    met = rows.unionByName(quota, allowMissingColumns=True).repartition("ticker", "at", "apart")
    first = F.lag("turn").over(Window.partitionBy("ticker", "at", "apart", "side", "quantity").orderBy("turn", "order_id")) == 0
    w = Window.partitionBy("ticker", "at", "apart").orderBy("turn", F.col("order_id").cast("string")).rowsBetween(Window.unboundedPreceding, 0)
    limited = F.sum(F.when(F.col("turn") == 1, 1).otherwise(0)).over(w) > F.first("quota").over(w)
    flagged = met.withColumns({"first": F.coalesce(first, F.lit(False)), "limited": limited}).filter("turn = 1")
    timed = F.col("at").isNotNull()
    return flagged.select(F.col("order_id").cast("string").alias("order_id"), "ticker", F.when(timed, F.col("limited")).otherwise(per_second <= 0).alias("rate_limited"), (timed & ~F.col("first") & F.lit(repeats)).alias("duplicate"))


def route_algo(order_type: Column, quantity: Column, adv: Column, share: float = 0.01) -> Column:
    t = F.lower(order_type)
    return F.when(t.isin("vwap", "twap"), t).when((adv > 0) & (quantity > share * adv), "vwap").otherwise("direct")


def vwap_schedule(orders: DataFrame, participation: float = 0.05, most: float = 0.20, profile: list[float] = VOLUME_PROFILE) -> DataFrame:
    """(…, slice, target): whole shares by the profile, capped by a share of adv and of the order, the rest last."""
    total = sum(profile)
    cap = F.floor(F.col("adv") * participation)
    o = orders.withColumn("__e", F.when(cap > 0, F.least(F.col("quantity"), cap)).otherwise(F.col("quantity")))
    s = o.select("*", F.posexplode(F.array(*[F.lit(p / total) for p in profile])).alias("slice", "__p"))
    s = s.withColumn("__t", F.greatest(F.least(F.floor(F.col("__e") * F.col("__p")), F.floor(F.col("quantity") * most)), F.lit(0)))
    rest = F.col("__e") - F.sum("__t").over(Window.partitionBy("order_id"))
    target = F.when(F.col("slice") == len(profile) - 1, F.col("__t") + F.greatest(rest, F.lit(0))).otherwise(F.col("__t"))
    return s.withColumn("target", target.cast("long")).drop("__e", "__p", "__t")


def twap_schedule(orders: DataFrame, slices: int = 10, minutes: float = 60.0) -> DataFrame:
    """(…, slice, target, at_seconds): equal whole parts, the remainder one each to the first."""
    base = F.floor(F.col("quantity") / slices)
    s = orders.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    return s.withColumns({"target": (base + (F.col("slice") < F.col("quantity") - base * slices).cast("long")).cast("long"), "at_seconds": F.col("slice") * (minutes * 60.0 / slices)})


def allocate_fills_to_slices(schedule: DataFrame, fills: DataFrame) -> DataFrame:
    """schedule (order_id, slice, target) with filled: the order's fills (order_id, filled) first in, first out."""
    w = Window.partitionBy("order_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("target").over(w), F.lit(0))
    j = schedule.join(fills, "order_id", "left")
    return j.withColumn("filled", F.least(F.col("target"), F.greatest(F.coalesce("filled", F.lit(0)) - before, F.lit(0))).cast("long"))


def liquidity_seeking_decision(state: DataFrame, ramp: float = 0.7, spread_at: float = 10.0, passive_bps: float = 5.0, participation: float = 0.10) -> DataFrame:
    """state (side, mid, spread_bps, elapsed, filled, remaining, slices_left, adv, depth) with urgency, order_type,
    limit_price and child_size."""
    late = F.col("elapsed") - F.col("filled")
    urgency = (
        F.when(F.col("elapsed") <= 0, "LOW").when((late > 0.3) & (F.col("elapsed") > ramp), "CRITICAL").when((late > 0.2) | (F.col("elapsed") > ramp), "HIGH").when(late > 0.1, "MEDIUM").otherwise("LOW")
    )
    s = state.withColumn("urgency", urgency)
    u = F.col("urgency")
    market = (u == "CRITICAL") | ((u == "HIGH") & (F.col("spread_bps") <= spread_at))
    offset = F.when(u == "LOW", passive_bps).when(u == "HIGH", -F.col("spread_bps") / 4).when(u == "CRITICAL", -F.col("spread_bps") / 2).otherwise(0.0)
    side = F.when(F.col("side") == "buy", -1.0).otherwise(1.0)
    limit = F.when(F.col("mid") > 0, F.round(F.col("mid") * (1 + side * offset / 1e4), 2)).otherwise(0.0)
    base = F.floor(F.col("remaining") / F.greatest(F.col("slices_left"), F.lit(1)))
    base = F.when(F.col("adv") > 0, F.least(base, F.floor(F.col("adv") * participation))).otherwise(base)
    base = F.when(F.col("depth") > 0, F.least(base, F.floor(F.col("depth") * 0.5))).otherwise(base)
    base = F.when(u == "CRITICAL", F.floor(base * 1.5)).when(u == "HIGH", F.floor(base * 1.2)).otherwise(base)
    size = F.when((F.col("remaining") <= 0) | (F.col("slices_left") <= 0), 0).otherwise(F.greatest(F.lit(1), F.least(base, F.col("remaining"))))
    return s.withColumns({"order_type": F.when(market, "market").otherwise("limit"), "limit_price": limit, "child_size": size.cast("long")})


def quoted_spread_bps(bid: Column, ask: Column) -> Column:
    mid = (bid + ask) / 2
    return F.when(mid > 0, (ask - bid) / F.when(mid > 0, mid) * 1e4).otherwise(0.0)


def spread_by_ticker(quotes: DataFrame) -> DataFrame:
    """(ticker, quoted, effective, realised, last_mid) of quotes (ticker, ts, bid, ask)."""
    q = quotes.withColumn("s", quoted_spread_bps(F.col("bid"), F.col("ask")))
    a = q.groupBy("ticker").agg(F.avg("s").alias("quoted"), F.max_by((F.col("bid") + F.col("ask")) / 2, "ts").alias("last_mid"))
    return a.select("ticker", "quoted", (F.col("quoted") / 2).alias("effective"), (F.col("quoted") * 0.3).alias("realised"), "last_mid")


def mean_valid_spread(quotes: DataFrame) -> DataFrame:
    q = quotes.withColumn("s", quoted_spread_bps(F.col("bid"), F.col("ask"))).filter("s >= 0")
    return q.groupBy("ticker").agg(F.avg("s").alias("spread"))


def roll_spread(returns: DataFrame, least: int = 20) -> DataFrame:
    """(ticker, spread_bps): 2 sqrt(-autocovariance) in bps; 0 if that is not negative or rows are few."""
    r = returns.withColumn("before", F.lag("ret").over(Window.partitionBy("ticker").orderBy("date")))
    x, y = F.when(F.col("before").isNotNull(), F.col("before")), F.when(F.col("before").isNotNull(), F.col("ret"))
    c = ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)) * F.var_samp("ret")
    a = r.groupBy("ticker").agg(F.count("*").alias("n"), c.alias("c"))
    ok = (F.col("n") >= least) & (F.col("c") < 0)
    return a.select("ticker", F.when(ok, 2 * F.sqrt(F.when(ok, -F.col("c"))) * 1e4).otherwise(0.0).alias("spread_bps"))


def vpin(trades: DataFrame, least: int = 50) -> DataFrame:
    """(ticker, vpin): |bought - sold| / all by the tick rule; trades (ticker, k, px, volume), k their order."""
    d = F.col("px") - F.lag("px").over(Window.partitionBy("ticker").orderBy("k"))
    t = trades.withColumn("side", F.when(d < 0, -1).otherwise(1))
    a = t.groupBy("ticker").agg(F.count("*").alias("n"), F.sum(F.col("side") * F.col("volume")).alias("net"), F.sum("volume").alias("all"))
    return a.select("ticker", F.when(F.col("n") >= least, F.coalesce(ratio(F.abs("net"), F.col("all")), F.lit(0.0))).otherwise(0.0).alias("vpin"))


def adverse_component(effective: Column, realised: Column) -> Column:
    return F.greatest(F.lit(0.0), effective - realised)


def permanent_impact(component: Column, pin: Column) -> Column:
    return component * (1 + pin)


def flow_toxicity(trades: DataFrame) -> DataFrame:
    """(ticker, toxicity): sum of |sign(r) v sign(next r)| over sum of |v|, the last next counting zero."""
    w = Window.partitionBy("ticker").orderBy("date")
    t = trades.withColumn("n", F.coalesce(F.lead("ret").over(w), F.lit(0.0)))
    hit = F.abs(F.signum("ret") * F.col("volume") * F.signum("n"))
    return t.groupBy("ticker").agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(ratio(F.sum(hit), F.sum(F.abs("volume"))), F.lit(0.0)))).alias("toxicity"))


def fill_probability(orders: DataFrame, a: float = 0.5, b: float = -1.0, penalty: float = 0.3, base_s: float = 30.0) -> DataFrame:
    """orders (side, limit_price, mid, size, depth) with distance_bps, fill_prob, partial_prob, expected_pct, time_s."""
    mid = F.when(F.col("mid") > 0, F.col("mid"))
    away = F.when(F.col("side") == "buy", mid - F.col("limit_price")).otherwise(F.col("limit_price") - mid) / mid * 1e4
    d = F.col("distance_bps")
    p = F.when(d < 0, F.least(F.lit(0.99), 0.95 + F.abs(d) / 1000)).otherwise(1 / (1 + F.exp(F.least(a * d + b, F.lit(700.0)))))
    p = p * F.when((F.col("depth") > 0) & (F.col("size") > 0), F.exp(-penalty * ratio("size", "depth"))).otherwise(1.0)
    o = orders.withColumn("distance_bps", F.coalesce(away, F.lit(0.0))).withColumn("fill_prob", F.when(mid.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(0.99), p))))
    part = F.when(mid.isNull(), 0.0).otherwise(F.least(F.lit(0.99), F.col("fill_prob") + (1 - F.col("fill_prob")) * 0.3))
    o = o.withColumn("partial_prob", part)
    return o.withColumns({"expected_pct": F.col("fill_prob") * 0.9 + F.col("partial_prob") * 0.1, "time_s": F.when(F.col("fill_prob") > 0.01, base_s / F.greatest(F.col("fill_prob"), F.lit(0.01)))})


def optimal_limit_offset(spread_bps: Column, urgency: Column) -> Column:
    return spread_bps / 2 * (1 - 2 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), urgency)))


def cost_to_trade(levels: DataFrame, sizes: DataFrame) -> DataFrame:
    """(ticker, cost_bps): levels (ticker, level, px, size, mid) walked from the best for sizes (ticker, order_size);
    what goes beyond the book pays twice the last level's distance."""
    w = Window.partitionBy("ticker").orderBy("level")
    j = levels.join(sizes, "ticker").withColumn("before", F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    take = F.least(F.col("size"), F.greatest(F.col("order_size") - F.col("before"), F.lit(0.0)))
    a = j.groupBy("ticker").agg(F.sum(take * F.abs(F.col("px") - F.col("mid"))).alias("c"), F.sum("size").alias("depth"), F.max_by(F.abs(F.col("px") - F.col("mid")), "level").alias("far"), F.max("order_size").alias("q"), F.max("mid").alias("mid"))
    total = F.col("c") + F.greatest(F.col("q") - F.col("depth"), F.lit(0.0)) * F.col("far") * 2
    return a.select("ticker", F.when((F.col("mid") > 0) & (F.col("q") > 0), ratio(ratio(total, F.col("q")), F.col("mid")) * 1e4).otherwise(0.0).alias("cost_bps"))


def book_snapshot(levels: DataFrame, notional: float = 100_000.0) -> DataFrame:
    """levels (ticker, side, level, px, size, mid) to depths, levels, top sizes, imbalance and the cost of notional."""
    part = lambda s, f: f(F.when(F.col("side") == s, F.col("size")))
    top = lambda s: F.max(F.when((F.col("side") == s) & (F.col("level") == 1), F.col("size")))
    a = levels.groupBy("ticker").agg(part("bid", F.sum).alias("bid_depth"), part("ask", F.sum).alias("ask_depth"), part("bid", F.count).alias("bid_levels"), part("ask", F.count).alias("ask_levels"), top("bid").alias("top_bid"), top("ask").alias("top_ask"), F.max("mid").alias("mid"))
    sizes = a.select("ticker", ratio(F.lit(notional), F.col("mid")).alias("order_size"))
    cost = cost_to_trade(levels.filter("side = 'ask'").drop("side"), sizes)
    b, s = (F.coalesce(c, F.lit(0.0)) for c in ("bid_depth", "ask_depth"))
    return a.join(cost, "ticker", "left").withColumn("imbalance", F.coalesce(ratio(b - s, b + s), F.lit(0.0))).drop("mid")


def book_from_summary(quotes: DataFrame, notional: float = 100_000.0) -> DataFrame:
    """quotes (ticker, bid, ask, bid_size, ask_size, adv) with imbalance and cost_bps from the top of the book."""
    mid = (F.col("bid") + F.col("ask")) / 2
    both = F.col("bid_size") + F.col("ask_size")
    impact = F.when(F.col("adv") > 0, F.pow(notional / mid / F.when(F.col("adv") > 0, F.col("adv")), 0.6) * 100).otherwise(0.0)
    cost = F.when((F.col("bid") > 0) & (F.col("ask") > 0), (F.col("ask") - F.col("bid")) / mid * 5000 + impact).otherwise(0.0)
    return quotes.withColumns({"imbalance": F.coalesce(ratio(F.col("bid_size") - F.col("ask_size"), both), F.lit(0.0)), "cost_bps": cost})


def queue_position(orders: DataFrame, cancel_rate: float = 0.01) -> DataFrame:
    """orders (size, depth_ahead, rate) with wait_s, fill_prob and position."""
    r = F.when(F.col("rate") > 0, F.col("rate"))
    wait = (F.col("depth_ahead") + F.col("size")) / r
    place = F.when(r.isNull(), F.floor("depth_ahead") + 1).otherwise(F.greatest(F.lit(1), F.floor(F.col("depth_ahead") / F.greatest(F.col("size"), F.lit(1.0))) + 1))
    return orders.withColumns({"wait_s": wait, "fill_prob": F.coalesce(F.exp(-cancel_rate * wait), F.lit(0.0)), "position": place.cast("long")})


def depth_ahead(levels: DataFrame, orders: DataFrame) -> DataFrame:
    """(order_id, depth_ahead): the levels (ticker, level, px, size) up to and with the order's limit price, or all."""
    w = Window.partitionBy("ticker").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    cum = levels.withColumn("cum", F.sum("size").over(w))
    j = orders.join(cum, "ticker")
    at = F.min(F.when(F.col("px") == F.col("limit_price"), F.col("cum")))
    return j.groupBy("order_id").agg(F.coalesce(at, F.max("cum")).alias("depth_ahead"))


def estimate_fills(orders: DataFrame, quotes: DataFrame, half_spread_bps: float = 5.0, coefficient: float = 2.0, exponent: float = 0.6, threshold: float = 0.01, most: float = 1.0, per_share: float = 0.005) -> DataFrame:
    """(order_id, ticker, side, fill_qty, fill_px, commission): the cost model over quotes (ticker, mid, adv); limit
    orders that the slipped price breaks fall away; large orders fill in part."""
    j = orders.join(quotes.select("ticker", "mid", "adv"), "ticker")
    q, adv = F.col("quantity"), F.when(F.col("adv") > 0, F.col("adv"))
    impact = F.when(adv.isNotNull() & (q > 0), F.least(F.lit(500.0), coefficient * F.pow(q / adv, exponent) * 1e4)).otherwise(coefficient)
    sign = F.when(F.col("side") == "buy", 1.0).otherwise(-1.0)
    j = j.withColumn("fill_px", F.col("mid") * (1 + sign * (half_spread_bps + impact) / 1e4))
    broken = (F.col("order_type") == "limit") & F.col("limit_price").isNotNull() & (sign * (F.col("fill_px") - F.col("limit_price")) > 0)
    part = F.greatest(F.lit(1), F.floor(q * F.least(F.lit(most), adv * threshold / q)))
    qty = F.when(q > adv * threshold, part).otherwise(q).cast("long")
    return j.filter(~broken).select("order_id", "ticker", "side", qty.alias("fill_qty"), "fill_px", (qty * per_share).alias("commission"))


def position_ledger(fills: DataFrame) -> DataFrame:
    """fills (ticker, date, k, side, qty, px, commission) with position and spent, the running cash paid; k orders."""
    w = Window.partitionBy("ticker").orderBy("date", "k").rowsBetween(Window.unboundedPreceding, 0)
    signed = F.when(F.col("side") == "buy", F.col("qty")).otherwise(-F.col("qty"))
    return fills.withColumns({"position": F.sum(signed).over(w), "spent": F.sum(signed * F.col("px") + F.col("commission")).over(w)})


def execution_quality(orders: DataFrame) -> DataFrame:
    """orders (side, target, filled, decision_px, fill_px, vwap) with shortfall_bps, vs_vwap_bps and fill_rate."""
    sign = F.when(F.col("side") == "buy", 1.0).otherwise(-1.0)
    against = lambda c: F.when(F.col(c) > 0, sign * (F.col("fill_px") - F.col(c)) / F.when(F.col(c) > 0, F.col(c)) * 1e4).otherwise(0.0)
    rate = F.when(F.col("target") > 0, ratio("filled", "target")).otherwise(0.0)
    return orders.withColumns({"shortfall_bps": against("decision_px"), "vs_vwap_bps": against("vwap"), "fill_rate": rate})


def execution_summary(quality: DataFrame, flag_bps: float = 20.0, key: str = "ticker") -> DataFrame:
    return quality.groupBy(key).agg(F.count("*").alias("n"), F.avg("shortfall_bps").alias("shortfall_bps"), F.avg("vs_vwap_bps").alias("vs_vwap_bps"), F.avg("fill_rate").alias("fill_rate"), F.sum((F.col("shortfall_bps") > flag_bps).cast("int")).alias("adverse"), F.sum("shortfall_bps").alias("total_bps"))


def adverse_orders(quality: DataFrame, flag_bps: float = 20.0) -> DataFrame:
    return quality.filter(F.col("shortfall_bps") > flag_bps)


def reconcile_positions(internal: DataFrame, broker: DataFrame, tolerance: float = 0.0, alert_at: float = 100.0) -> DataFrame:
    """(ticker, internal, broker, delta, mismatch, corrected, alert)."""
    j = internal.select("ticker", F.col("qty").alias("i")).join(broker.select("ticker", F.col("qty").alias("b")), "ticker", "full")
    i, b = F.coalesce("i", F.lit(0.0)), F.coalesce("b", F.lit(0.0))
    return j.select("ticker", i.alias("internal"), b.alias("broker"), (b - i).alias("delta"), (F.abs(b - i) > tolerance).alias("mismatch"), b.alias("corrected"), (F.abs(b - i) > alert_at).alias("alert"))


def reconcile_nav(internal: DataFrame, broker: DataFrame, most: float = 0.01) -> DataFrame:
    j = internal.select("date", F.col("nav").alias("internal")).join(broker.select("date", F.col("nav").alias("broker")), "date")
    return j.withColumn("off", ratio(F.abs(F.col("broker") - F.col("internal")), F.col("broker"))).filter(F.col("off") > most)


def reconcile_orders(tracked: DataFrame, fills: DataFrame, now: str, hours: int = 24) -> DataFrame:
    """Open orders that have fills of the last hours."""
    at = F.lit(now).cast("timestamp_ntz")
    recent = fills.filter((F.col("ts") >= at - F.expr(f"INTERVAL {hours} HOURS")) & (F.col("ts") <= at)).select("order_id")
    return tracked.filter("status = 'open'").join(recent, "order_id", "left_semi")


def reconciliation_metrics(report: DataFrame) -> DataFrame:
    hits = F.sum(F.col("mismatch").cast("int"))
    return report.agg(F.count("*").alias("total"), hits.alias("mismatches"), hits.alias("corrections"), F.coalesce(ratio(hits.cast("double"), F.count("*")), F.lit(0.0)).alias("rate"))


def _eastern(ts: Column) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), ts.cast("timestamp_ntz"))


def session_flags(df: DataFrame, ts: str = "ts") -> DataFrame:
    """df with et, weekend, holiday, early_close and open: 09:30 to 16:00 (13:00) Eastern on session days. Timestamps
    are UTC; the calendar is a list of fixed days."""
    et, day = F.col("et"), F.to_date("et")
    minute = F.hour(et) * 60 + F.minute(et)
    d = df.withColumn("et", _eastern(F.col(ts)))
    in_ = lambda days: day.isin([pd.Timestamp(x).date() for x in days])
    d = d.withColumns({"weekend": F.weekday(et) >= 5, "holiday": in_(HOLIDAYS), "early_close": in_(EARLY_CLOSES)})
    close = F.when(F.col("early_close"), 13 * 60).otherwise(16 * 60)
    return d.withColumn("open", ~F.col("weekend") & ~F.col("holiday") & (minute >= 570) & (minute < close))


def can_submit(df: DataFrame, ts: str = "ts", extended: bool = False, cutoff: int = 5) -> DataFrame:
    """df with allowed and reason."""
    f = session_flags(df, ts)
    minute = F.hour("et") * 60 + F.minute("et")
    close = F.when(F.col("early_close"), 13 * 60).otherwise(16 * 60)
    outside = ((minute < 240) | (minute >= 1200)) if extended else ((minute < 570) | (minute >= close))
    reason = (
        F.when(F.col("weekend"), "weekend").when(F.col("holiday"), "holiday").when(outside, "outside_hours").when((minute >= close - cutoff) & (minute < close), "eod_cutoff").otherwise("OK")
    )
    return f.withColumn("reason", reason).withColumn("allowed", F.col("reason") == "OK")


def next_open(df: DataFrame, ts: str = "ts") -> DataFrame:
    """df with next_open, in Eastern time: 09:30 of the first session day whose open is after ts. The days to look at
    are ten, so no join is needed."""
    et = _eastern(F.col(ts))
    days = F.transform(F.sequence(F.lit(0), F.lit(10)), lambda i: F.date_add(F.to_date(et), i))
    closed = F.array(*[F.lit(pd.Timestamp(x).date()) for x in HOLIDAYS])
    opens = F.transform(F.filter(days, lambda d: (F.weekday(d) < 5) & ~F.array_contains(closed, d)), lambda d: d.cast("timestamp_ntz") + F.expr("INTERVAL '9:30' HOUR TO MINUTE"))
    return df.withColumn("next_open", F.element_at(F.filter(opens, lambda o: o > et), 1))
