"""Audit tables, approvals, model and feed health, alerts and daily reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.chains import accepted
from ..functions.columns import ratio

# Where an approval may go from each state.
TRANSITIONS = {
    "submitted": ["under_review"],
    "under_review": ["approved", "rejected"],
    "approved": ["deployed", "rejected"],
    "rejected": ["submitted"],
    "deployed": ["suspended", "retired"],
    "suspended": ["deployed", "retired"],
    "retired": [],
}


def audit_append(df: DataFrame, root: str, table: str) -> None:
    df.write.mode("append").parquet(f"{root}/{table}")


def audit_query(spark: SparkSession, root: str, table: str, strategy: str | None = None, ticker: str | None = None, since: str | None = None, limit: int = 1000) -> DataFrame:
    """The newest rows that match; the filters reach the scan, and a limit of a sorted table keeps limit rows a task."""
    return audit_filter(spark.read.parquet(f"{root}/{table}"), strategy, ticker, since, limit)


def audit_filter(df: DataFrame, strategy: str | None = None, ticker: str | None = None, since: str | None = None, limit: int = 1000, tie: str = "order_id") -> DataFrame:
    for c, v in (("strategy", strategy), ("ticker", ticker)):
        df = df.filter(F.col(c) == v) if v is not None else df
    df = df.filter(F.col("ts") >= F.lit(since).cast("timestamp_ntz")) if since else df
    return df.orderBy(F.desc("ts"), tie).limit(limit)


def audit_counts(orders: DataFrame, fills: DataFrame) -> DataFrame:
    """(kind, name, n): orders by strategy and fills by ticker."""
    a = orders.groupBy(F.lit("orders").alias("kind"), F.col("strategy").alias("name")).agg(F.count("*").alias("n"))
    return a.union(fills.groupBy(F.lit("fills").alias("kind"), F.col("ticker").alias("name")).agg(F.count("*").alias("n")))


def strategy_review(strategies: DataFrame, sharpe: float = 1.0, drawdown: float = 0.25, days: int = 252, capacity: float = 0.20, factor: float = 2.0) -> DataFrame:
    """(strategy, check, passed, overall) of (strategy, sharpe, drawdown, days, costs, lookahead, capacity, factor)."""
    c = F.col
    checks = {
        "sharpe_ratio": c("sharpe") >= sharpe, "max_drawdown": c("drawdown") <= drawdown, "min_eval_period": c("days") >= days, "transaction_costs": c("costs"),
        "look_ahead_bias": c("lookahead") == 0, "capacity": c("capacity") <= capacity, "factor_exposure": F.abs("factor") <= factor,
    }
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("check"), F.coalesce(v, F.lit(False)).alias("passed")) for k, v in checks.items()]))
    out = strategies.select("strategy", rows.alias("r")).select("strategy", "r.*")
    return out.withColumn("overall", F.bool_and("passed").over(Window.partitionBy("strategy")))


def approval_log_violations(log: DataFrame) -> DataFrame:
    """Rows of (strategy, k, from_state, to_state) that the table does not allow, or that do not start where the last
    one ended."""
    before = F.lag("to_state").over(Window.partitionBy("strategy").orderBy("k"))
    allowed = F.create_map(*[x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]).cast("array<string>"))])[F.col("from_state")]
    marked = log.withColumn("__b", before).withColumn("reason", F.when(~F.coalesce(F.array_contains(allowed, F.col("to_state")), F.lit(False)), "not_allowed").when(F.col("__b") != F.col("from_state"), "broken_chain"))
    return marked.filter("reason IS NOT NULL").drop("__b")


def approval_current_state(log: DataFrame) -> DataFrame:
    return log.groupBy("strategy").agg(F.max_by("to_state", "k").alias("state"))


def can_deploy(strategies: DataFrame, paper_days: int = 126) -> DataFrame:
    """(strategy, deployable, reasons) of (strategy, state, risk_approved, paper_days, review_passed)."""
    reasons = F.array_compact(F.array(
        F.when(~F.col("state").isin("approved", "suspended"), F.lit("state")), F.when(~F.col("risk_approved"), F.lit("risk_team")),
        F.when(F.col("paper_days") < paper_days, F.lit("paper_days")), F.when(~F.col("review_passed"), F.lit("review")),
    ))
    return strategies.select("strategy", (F.size(reasons) == 0).alias("deployable"), F.array_join(reasons, ",").alias("reasons"))


def active_allocations(deployments: DataFrame, halted: bool = False) -> DataFrame:
    """(strategy, mode, allocation) of paper and live strategies; a halt suspends the live ones."""
    d = deployments.filter(F.col("mode").isin("paper", "live"))
    live = F.col("mode") == "live"
    return d.select("strategy", F.when(live & F.lit(halted), "suspended").otherwise(F.col("mode")).alias("mode"), F.when(live & F.lit(halted), 0.0).otherwise(F.col("allocation")).alias("allocation"))


def prediction_drift(predictions: DataFrame, baseline: DataFrame, window: int = 500, least: int = 50, z: float = 2.5) -> DataFrame:
    """(model, n, score, level): the mean of the last predictions (model, k, value) against baseline (model, mean, std)."""
    k = F.row_number().over(Window.partitionBy("model").orderBy(F.desc("k")))
    a = predictions.withColumn("r", k).filter(F.col("r") <= window).groupBy("model").agg(F.count("*").alias("n"), F.avg("value").alias("m"))
    s = a.join(baseline, "model").withColumn("score", F.abs(F.col("m") - F.col("mean")) / F.greatest(F.col("std"), F.lit(1e-10)))
    level = F.when(F.col("n") < least, "insufficient").when(F.col("score") > 1.5 * z, "critical").when(F.col("score") > z, "warning").otherwise("ok")
    return s.select("model", "n", "score", level.alias("level"))


def prediction_collapse(predictions: DataFrame, window: int = 500, least: int = 100, limit: float = 1e-8) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("model").orderBy(F.desc("k")))
    a = predictions.withColumn("r", k).filter(F.col("r") <= window).groupBy("model").agg(F.count("*").alias("n"), F.stddev_pop("value").alias("std"))
    return a.withColumn("collapsed", (F.col("n") >= least) & (F.col("std") < limit))


def model_staleness(models: DataFrame, now: str, hours: float = 48.0) -> DataFrame:
    age = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col("trained_at").cast("timestamp"))) / 3600.0
    return models.select("model", age.alias("age_hours"), (age > hours).alias("stale"))


def feed_freshness(events: DataFrame, now: str, stale_s: float = 300.0, feed: str = "event_type") -> DataFrame:
    """(feed, lag_s, status, overall): healthy, degraded or down by the lag of the newest row; the worst of all."""
    lag = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.max("ts").cast("timestamp"))
    a = events.groupBy(F.col(feed).alias("feed")).agg(lag.alias("lag_s"))
    status = F.when(F.col("lag_s").isNull(), "unknown").when(F.col("lag_s") < stale_s, "healthy").when(F.col("lag_s") <= 3 * stale_s, "degraded").otherwise("down")
    worst = F.max(F.when(F.col("status") == "down", 3).when(F.col("status") == "degraded", 2).when(F.col("status") == "healthy", 1).otherwise(0)).over(Window.partitionBy())
    return a.withColumn("status", status).withColumn("overall", F.element_at(F.array(*[F.lit(s) for s in ("unknown", "healthy", "degraded", "down")]), worst + 1))


def dedupe_alerts(alerts: DataFrame, window_s: float = 300.0) -> DataFrame:
    """alerts (source, message, level, ts, alert_id) without those that repeat an accepted one within the window: a
    greedy rule, worked off by pointers, so a key that never pauses is no task's."""
    return accepted(alerts, ["source", "message", "level"], ["alert_id"], window_s).filter("accepted").drop("accepted")


def active_alerts(alerts: DataFrame, level: str | None = None, since: str | None = None) -> DataFrame:
    """Unacknowledged alerts; by level and time."""
    a = alerts.filter(~F.col("acknowledged"))
    a = a.filter(F.col("level") == level) if level else a
    return a.filter(F.col("ts") >= F.lit(since).cast("timestamp_ntz")) if since else a


def alert_counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("level").agg(F.count("*").alias("n"), F.sum(F.col("acknowledged").cast("int")).alias("acknowledged"))


def dedupe_events(events: DataFrame) -> DataFrame:
    """The first event of each idempotency key, or of each id without one."""
    key = F.coalesce("idempotency_key", F.col("event_id").cast("string"))
    first = F.row_number().over(Window.partitionBy(key).orderBy("ts", "event_id"))
    return events.withColumn("__k", first).filter("__k = 1").drop("__k")


def daily_close_report(pnl: DataFrame, quality: DataFrame, reconciled: DataFrame) -> DataFrame:
    """(date, nav, pnl, ret, trades, shortfall_bps, clean) by date."""
    q = quality.groupBy("date").agg(F.count("*").alias("trades"), F.avg("shortfall_bps").alias("shortfall_bps"))
    r = reconciled.groupBy("date").agg(F.bool_and(~F.col("mismatch")).alias("clean"))
    return pnl.select("date", "nav", "pnl", "ret").join(q, "date", "left").join(r, "date", "left").select("date", "nav", "pnl", "ret", F.coalesce("trades", F.lit(0)).alias("trades"), "shortfall_bps", F.coalesce("clean", F.lit(True)).alias("clean"))
