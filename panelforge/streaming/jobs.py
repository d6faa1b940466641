"""Structured Streaming forms: bars, de-duplication, freshness, drawdown, lifecycle, drift, sessions and sinks.

Each takes a streaming DataFrame and returns one (or a started query); run_available works a stream off for tests and
registered queries. Stateful operators need the RocksDB state store, which build_state sets."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.signals import _lifecycle
from ..session import shared_dir, ship

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A Parquet path as a stream, timestamps made such that watermarks accept them."""
    schema = schema or spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    raw = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    return raw.withColumns({c: F.col(c).cast("timestamp") for c, t in raw.dtypes if t == "timestamp_ntz"})


def run_available(df: DataFrame, mode: str = "append") -> DataFrame:
    """Work the stream off and read the result, a Parquet table in the shared folder. The last state of an updating
    stream is a batch of its own, so it replaces the earlier ones."""
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/panelforge/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, k: int) -> None:
        (batch.withColumn("__batch", F.lit(k)) if mode == "update" else batch).write.mode("append" if mode != "complete" else "overwrite").parquet(f"{root}/out")

    with sorting(spark):
        q = df.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    schema = df.schema.add("__batch", "integer") if mode == "update" else df.schema
    return spark.read.schema(schema).parquet(f"{root}/out")


@contextmanager
def sorting(spark: SparkSession) -> Iterator[None]:
    """Let queries be started whose rows are sorted inside a micro-batch. Spark refuses any sort of a stream unless its
    check of what streams support is off; it is off in here only, so start the drawdown and the lifecycle inside."""
    name = "spark.sql.streaming.unsupportedOperationCheck"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def newest_state(updates: DataFrame, *keys: str) -> DataFrame:
    """The last row that an updating stream gave for each key."""
    rest = [c for c in updates.columns if c not in keys and c != "__batch"]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "__batch").alias("r")).select(*keys, "r.*")


def stream_latest_bar(events: DataFrame, key: str = "event_type") -> DataFrame:
    """The newest row of each key, updated as rows come. Ties go to the larger id."""
    return events.groupBy(key).agg(F.max_by(F.struct("ts", "event_id", "value"), F.struct("ts", "event_id")).alias("r")).select(key, "r.*")


def stream_bars(events: DataFrame, interval: str = "5 minutes", slide: str | None = None, late: str = "10 minutes", key: str = "event_type") -> DataFrame:
    """Bars of an event-time window."""
    w = F.window("ts", interval, slide) if slide else F.window("ts", interval)
    order = F.struct("ts", "event_id")
    a = events.withWatermark("ts", late).groupBy(w, key).agg(F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count("*").alias("n"))
    return a.select(F.col("window.start").alias("start"), key, "open", "high", "low", "close", "n")


def stream_dedupe(events: DataFrame, key: str = "idempotency_key", late: str = "1 hour") -> DataFrame:
    """The first event of a key within the watermark; its state is bounded by it."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def stream_feed_health(events: DataFrame, key: str = "event_type") -> DataFrame:
    """(key, last_ts, n) by feed, updated."""
    return events.groupBy(key).agg(F.max("ts").alias("last_ts"), F.count("*").alias("n"))


def stream_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", key: str = "user_id") -> DataFrame:
    """(key, start, end, n): sessions by gaps in event time."""
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n"))
    return s.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def stream_to_table(events: DataFrame, path: str):
    """Append each micro-batch to a table; the checkpoint makes a restart go on where it stopped."""
    return events.writeStream.foreachBatch(lambda b, _: b.write.mode("append").parquet(f"{path}/rows")).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()


class Drawdown(StatefulProcessor):
    """Peak and a sticky halt of each portfolio."""

    def __init__(self, limit: float):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("path", "peak double, halted boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:  # noqa: N802
        got = self.state.get()
        peak, halted = (got[0], got[1]) if got is not None else (None, False)
        seen = None
        for pdf in rows:
            seen, out = _rising(seen, pdf), []
            for ts, nav in zip(pdf["ts"], pdf["nav"]):
                peak = nav if peak is None or peak != peak else peak
                halted = halted or peak > 0 and (peak - nav) / peak >= self.limit
                out.append((key[0], ts, nav, peak, (peak - nav) / peak if peak > 0 else 0.0, halted))
                peak = peak if halted else max(peak, nav)
            yield pd.DataFrame(out, columns=["portfolio", "ts", "nav", "peak", "drawdown", "halted"])
        self.state.update((float(peak), bool(halted)))

    def close(self) -> None:
        pass


def _stateful(df: DataFrame, key: str, processor: StatefulProcessor, schema: str, order: list[Column] | None = None) -> DataFrame:
    """A key's rows of a micro-batch reach the processor part by part; in that order, if there is one, by Spark's sort."""
    ship(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = df.repartition(key).sortWithinPartitions(key, *order) if order else df
    return rows.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="append", timeMode="None")


def _rising(before: pd.Timestamp | None, pdf: pd.DataFrame) -> pd.Timestamp:
    """The last time of a part that follows another; an error where the sort has not reached the processor."""
    at = pdf["ts"].dropna()
    if not at.is_monotonic_increasing or before is not None and len(at) and at.iloc[0] < before:
        raise ValueError("rows out of order: the sort inside the micro-batch is missing")
    return at.iloc[-1] if len(at) else before


def stream_drawdown(nav: DataFrame, limit: float = 0.20) -> DataFrame:
    """(portfolio, ts, nav) to the same with peak, drawdown and halted. nth, if there, orders rows of one time. A
    portfolio's rows go past the rule in parts, sorted by Spark; start the query inside of sorting."""
    four = nav.withColumns({} if "nth" in nav.columns else {"nth": F.lit(0)}).select("portfolio", "ts", "nav", "nth")
    order = [F.col("ts").asc_nulls_last(), F.col("nth").asc_nulls_last()]
    return _stateful(four, "portfolio", Drawdown(limit), "portfolio string, ts timestamp, nav double, peak double, drawdown double, halted boolean", order)


class Lifecycle(StatefulProcessor):
    """The status of each strategy; its first event registers it, and a retirement ends it for good."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("status", "status string, multiplier double, since timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:  # noqa: N802
        got = self.state.get()
        state = tuple(got) if got is not None else None
        seen = None
        for pdf in rows:
            seen, out = _rising(seen, pdf), []
            for ts, ic, retire in zip(pdf["ts"], pdf["ic"], pdf["retire"]):
                if retire:
                    state = ("retired", 0.0, ts.to_pydatetime()) if state is None or state[0] != "retired" else state
                elif state is None:
                    state = ("active", 1.0, ts.to_pydatetime())
                else:
                    state = _lifecycle(state, ic, ts.to_pydatetime())
                if ic == ic and ic is not None:
                    out.append((key[0], ts, state[0], state[1]))
            if out:
                yield pd.DataFrame(out, columns=["strategy", "ts", "status", "multiplier"])
        self.state.update(state)

    def close(self) -> None:
        pass


def stream_strategy_lifecycle(events: DataFrame) -> DataFrame:
    """(strategy, ts, ic) to (strategy, ts, status, multiplier). Two kinds of event on one stream: an IC, and, where there is
    a column retire, a retirement, which may carry an IC too (null: none, and no row is given). A retired strategy stays
    so whatever comes later. nth, if there, orders events of one time. A micro-batch is sorted by Spark and a strategy's
    rows go past the rule in parts, never in memory together; start the query inside of sorting."""
    more = {c: F.lit(v) for c, v in (("retire", False), ("nth", 0)) if c not in events.columns}
    five = events.withColumns(more).select("strategy", "ts", "ic", F.coalesce("retire", F.lit(False)).cast("boolean").alias("retire"), "nth")
    # what retires at a time comes before what is seen then
    order = [F.col("ts").asc_nulls_last(), F.col("retire").desc(), F.col("nth").asc_nulls_last()]
    return _stateful(five, "strategy", Lifecycle(), "strategy string, ts timestamp, status string, multiplier double", order)


class Drift(StatefulProcessor):
    """The mean of each model's last values against a baseline: a ring of at most size of them."""

    def __init__(self, size: int, least: int, z: float, mean: float, std: float):
        self.size, self.least, self.z, self.mean, self.std = size, least, z, mean, std

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getListState("ring", "value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:  # noqa: N802
        held = [x[0] for x in self.ring.get()]
        newest = None  # of the parts so far, no more than the ring takes
        for pdf in rows:
            newest = pd.concat([pdf] if newest is None else [newest, pdf]).sort_values("ts", kind="stable")[-self.size :]
        held = [*held, *map(float, newest["value"])][-self.size :]
        self.ring.put([(v,) for v in held])
        score = abs(sum(held) / len(held) - self.mean) / max(self.std, 1e-10)
        yield pd.DataFrame([(key[0], newest["ts"].iloc[-1], len(held), score, len(held) >= self.least and score > self.z)], columns=["model", "ts", "n", "score", "drifted"])

    def close(self) -> None:
        pass


def stream_prediction_drift(predictions: DataFrame, mean: float, std: float, size: int = 500, least: int = 50, z: float = 2.5) -> DataFrame:
    """(model, ts, value) to (model, ts, n, score, drifted), a row for each batch and model."""
    return _stateful(predictions, "model", Drift(size, least, z, mean, std), "model string, ts timestamp, n long, score double, drifted boolean")
