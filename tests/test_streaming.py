"""Stateful streams take a key's rows in parts."""

import random

import pandas as pd
import pytest
from panelforge.streaming import jobs

T0 = pd.Timestamp("2024-01-01")


class Held:
    """A handle with one value or list in it."""

    def __init__(self):
        self.got = None

    def getValueState(self, *_):  # noqa: N802
        return self

    getListState = getValueState

    def get(self):
        return self.got

    def update(self, value):
        self.got = value

    put = update


def parts(taken, days, column="ic", **more):
    for d in days:
        taken.append(d)
        yield pd.DataFrame({"ts": [T0 + pd.Timedelta(days=d), T0 + pd.Timedelta(days=d, hours=1)], column: [0.02, 0.02], **more})


def test_lifecycle_gives_a_part_before_it_takes_the_next():
    p, taken = jobs.Lifecycle(), []
    p.init(Held())
    out = p.handleInputRows(("a",), parts(taken, range(5), retire=False, nth=0), None)
    assert len(next(out)) == 2 and taken == [0]
    assert sum(map(len, out)) == 8 and p.state.got[0] == "active"
    with pytest.raises(ValueError):
        list(p.handleInputRows(("a",), parts([], [3, 1], retire=False, nth=0), None))


def test_lifecycle_of_mixed_rows_in_small_parts(spark, tmp_path):
    r = random.Random(3)
    rows = [(s, (T0 + pd.Timedelta(days=d)).to_pydatetime(), r.choice([-0.02, 0.0, 0.02, 0.05]), n) for s in "ab" for n, d in enumerate([k // 2 for k in range(150)])]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "strategy string, ts timestamp, ic double, nth int")
    df.coalesce(1).write.parquet(str(tmp_path / "events"))
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "7")
    try:
        out = jobs.run_available(jobs.stream_strategy_lifecycle(spark.readStream.schema(df.schema).parquet(str(tmp_path / "events"))))
        got = sorted((x.strategy, x.ts, x.status, x.multiplier) for x in out.collect())
    finally:
        spark.conf.set(size, before)
    assert spark.conf.get("spark.sql.streaming.unsupportedOperationCheck") == "true"
    want, state = [], {}
    for s, ts, ic, _ in sorted(rows, key=lambda x: (x[0], x[1], x[3])):
        state[s] = jobs._lifecycle(state[s], ic, ts) if s in state else ("active", 1.0, ts)
        want.append((s, ts, *state[s][:2]))
    assert got == sorted(want) and {x[2] for x in got} >= {"active", "under_review"}


def test_drawdown_and_drift_take_parts():
    p, taken = jobs.Drawdown(0.2), []
    p.init(Held())
    out = p.handleInputRows(("a",), parts(taken, range(5), "nav", nth=0), None)
    assert len(next(out)) == 2 and taken == [0]
    assert sum(map(len, out)) == 8 and p.state.got == (0.02, False)

    sizes = []

    class Counted(jobs.Drift):
        def init(self, handle):
            super().init(handle)
            self.ring.got = []

    d, concat = Counted(3, 1, 2.5, 0.0, 1.0), pd.concat
    d.init(Held())
    jobs.pd.concat = lambda x: sizes.append(sum(map(len, x))) or concat(x)
    try:
        got = list(d.handleInputRows(("m",), (pd.DataFrame({"ts": [T0 + pd.Timedelta(days=k) for k in ks], "value": [float(k) for k in ks]}) for ks in ([9, 2], [1, 8], [7, 3])), None))
    finally:
        jobs.pd.concat = concat
    assert max(sizes) <= 5 and [x[0] for x in d.ring.got] == [7.0, 8.0, 9.0] and got[0]["score"][0] == 8.0


def test_drawdown_orders_rows_of_one_time(spark, tmp_path):
    t = T0.to_pydatetime()
    df = spark.createDataFrame([("a", t, 10.0, 2), ("a", t, 9.0, 1), ("a", t, 7.9, 0)], "portfolio string, ts timestamp, nav double, nth int")
    df.coalesce(1).write.parquet(str(tmp_path / "nav"))
    out = jobs.run_available(jobs.stream_drawdown(spark.readStream.schema(df.schema).parquet(str(tmp_path / "nav"))))
    assert sorted((x.nav, x.peak, x.halted) for x in out.collect()) == [(7.9, 7.9, False), (9.0, 7.9, False), (10.0, 9.0, False)]
