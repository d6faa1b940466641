"""Greedy acceptance against the loop that says it."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from panelforge.functions import chains
from panelforge.operators import execution

T0 = datetime.datetime(2024, 1, 1)


@pytest.mark.parametrize("seed, window", [(1, 30.0), (2, 0.5), (3, 100_000.0)])
def test_accepted_is_the_loop(spark, seed, window):
    r = random.Random(seed)
    rows = []
    for i in range(400):
        key = r.choice(["hot"] * 6 + ["a", "b", None])
        rows.append((key, None if r.random() < 0.03 else T0 + datetime.timedelta(milliseconds=r.randrange(0, 1_500_000) // 500 * 500), i))
    df = spark.createDataFrame(rows, "k string, ts timestamp, id int").repartition(5)
    got = {x.id: x.accepted for x in chains.accepted(df, ["k"], ["id"], window).collect()}
    assert len(got) == len(rows)
    for key in {x[0] for x in rows}:
        last = None
        for _, ts, i in sorted((x for x in rows if x[0] == key and x[1]), key=lambda x: (x[1], x[2])):
            ok = last is None or (ts - last).total_seconds() >= window
            last = ts if ok else last
            assert got[i] == ok, (key, ts, i)
    assert all(got[i] for _, ts, i in rows if ts is None)
    assert chains.accepted(df.limit(0), ["k"], ["id"], window).count() == 0


def test_a_key_that_never_pauses(spark):
    """A million rows of one key a second apart: as many levels as the chain's length has digits, and no group."""
    n, window, log = 1_000_000, 300, []
    df = spark.range(n).select(F.lit("k").alias("k"), F.timestamp_seconds("id").alias("ts"), "id")
    got = chains.accepted(df, ["k"], ["id"], float(window), log=log).filter("accepted")
    assert got.agg(F.count("*"), F.sum((F.col("id") % window == 0).cast("int"))).first()[:] == (-(-n // window), -(-n // window))
    assert log == [12]


def test_a_rate_over_one_long_burst(spark):
    rows = [(f"o{i:06d}", "t", "buy", float(i), T0 + datetime.timedelta(milliseconds=100 * i)) for i in range(3000)]
    df = spark.createDataFrame(rows, "order_id string, ticker string, side string, quantity double, ts timestamp")
    out = execution.order_rate_and_duplicate_flags(df, 5, 60.0).orderBy("order_id").collect()
    recent, want = [], []
    for *_, ts in rows:
        recent = [t for t in recent if (ts - t).total_seconds() < 1]
        want.append(len(recent) >= 5)
        if not want[-1]:
            recent.append(ts)
    assert [r.rate_limited for r in out] == want and not any(r.duplicate for r in out)


def test_orders_of_one_time_are_one_point(spark, monkeypatch):
    """Copies of tickers and times add rows, and no pointers."""
    r, placed, numbered = random.Random(8), [], chains.numbered
    monkeypatch.setattr(chains, "numbered", lambda df, *a: placed.append(df.count()) or numbered(df, *a))
    rows = [(f"o{i:03d}", r.choice(["a", "b", None]), "buy", float(r.randrange(2)), None if i % 50 == 7 else T0 + datetime.timedelta(milliseconds=250 * r.randrange(30))) for i in range(500)]
    df = spark.createDataFrame(rows, "order_id string, ticker string, side string, quantity double, ts timestamp")
    got = {x.order_id: (x.ticker, x.rate_limited, x.duplicate) for x in execution.order_rate_and_duplicate_flags(df, 5, 2.0).collect()}
    assert placed == [len({x[1:] for x in rows if x[4]})] and len(got) == 500
    recent, last = {}, {}
    for o, ticker, side, q, ts in sorted((x for x in rows if x[4]), key=lambda x: (x[4], x[0])):
        near = [t for t in recent.get(ticker, []) if (ts - t).total_seconds() < 1]
        again = (ticker, q) in last and (ts - last[ticker, q]).total_seconds() < 2
        assert got[o] == (ticker, len(near) >= 5, again), o
        recent[ticker] = near if len(near) >= 5 else [*near, ts]
        if not again:
            last[ticker, q] = ts
    assert all(got[x[0]][1:] == (False, False) for x in rows if x[4] is None)


def test_a_window_of_nothing_accepts_all(spark):
    df = spark.createDataFrame([("k", T0, 1), ("k", T0, 2)], "k string, ts timestamp, id int")
    assert [x.accepted for x in chains.accepted(df, ["k"], ["id"], 0.0).collect()] == [True, True]
