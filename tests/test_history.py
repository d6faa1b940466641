"""Ranks in moving and growing histories against counting them."""

import random

import pytest
from pyspark.sql import functions as F

from panelforge.functions import history


def series(kind, seed=1):
    r = random.Random(seed)
    value = {"ties": lambda: float(r.randrange(4)), "free": lambda: r.gauss(0, 1), "hot": lambda: 1.0 if r.random() < 0.5 else r.gauss(0, 3)}[kind]
    rows = [("long", i, value()) for i in range(700)] + [("short", i, value()) for i in range(7)] + [("one", 0, 1.0)] + [(None, i, value()) for i in range(30)]
    return [(k, t, None if t % 11 == 3 else float("nan") if t % 50 == 7 else v) for k, t, v in rows]


def counted(rows, look=None):
    out = {}
    for key in {r[0] for r in rows}:
        own = [(t, x) for k, t, x in rows if k == key and x is not None and x == x]
        own.sort()
        for i, (t, x) in enumerate(own):
            seen = [y for _, y in own[max(0, i + 1 - (look or i + 1)) : i + 1]]
            out[key, t] = (sum(y < x for y in seen), len(seen))
    return out


@pytest.mark.parametrize("kind", ["ties", "free", "hot"])
def test_history(spark, kind):
    rows = series(kind)
    df = spark.createDataFrame(rows, "s string, t int, v double").withColumn("x", F.lit("y")).withColumn("row", F.lit(1)).repartition(5)
    got = history.history_rank(df, "v", ["s"], ["t"])
    assert got.columns == ["s", "t", "v", "x", "row", "below", "held"]
    assert {(r.s, r.t): (r.below, r.held) for r in got.collect()} == counted(rows)
    assert history.history_rank(df.limit(0), "v", ["s"], ["t"]).count() == 0


@pytest.mark.parametrize("look, block", [(20, 32), (1, 16), (300, 64), (5, 1024)])
def test_moving(spark, monkeypatch, look, block):
    monkeypatch.setattr(history, "BLOCK", block)
    rows = series("hot", look)
    df = spark.createDataFrame(rows, "s string, t int, v double").repartition(5)
    assert {(r.s, r.t): (r.below, r.held) for r in history.moving_rank(df, "v", ["s"], ["t"], look).collect()} == counted(rows, look)
