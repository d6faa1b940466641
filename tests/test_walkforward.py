"""Ridge regressions from prefix sums against fits on the rows themselves; the stream's lifecycle against its batch twin."""

import datetime
import random

import numpy as np

from panelforge.operators import signals, walkforward
from panelforge.streaming import jobs


def panel(n_dates=60, seed=2):
    r = np.random.default_rng(seed)
    out = []
    for d in range(n_dates):
        for t in range(r.integers(3, 9)):
            x = r.standard_normal(3) * [1, 100, 1e-3]
            out.append((datetime.date(2020, 1, 1) + datetime.timedelta(days=d), f"t{t}", *map(float, x), 5.0, float(0.3 * x[0] - 0.002 * x[1] + r.standard_normal())))
    return out


def ridge(x, y, alpha):
    mean, scale = x.mean(0), x.std(0)
    keep = scale > 1e-9
    z = (x[:, keep] - mean[keep]) / scale[keep]
    b = np.zeros(x.shape[1])
    b[keep] = np.linalg.solve(z.T @ z + alpha * np.eye(keep.sum()), z.T @ (y - y.mean())) / scale[keep]
    return b, y.mean() - b @ mean


def test_folds_are_fits_on_the_rows(spark):
    rows = panel()
    df = spark.createDataFrame(rows + [(None, "t0", 1.0, 1.0, 1.0, 5.0, 1.0), (rows[0][0], "t9", None, 1.0, 1.0, 5.0, 1.0)], "date date, ticker string, a double, b double, c double, d double, ret double")
    got = {(r.model, r.fold): r for r in walkforward.ridge_folds(df, list("abcd"), {"one": 1.0, "none": 0.0}, 30, 10, 5).collect()}
    dates = sorted({r[0] for r in rows})
    assert len(got) == 2 * 5
    for (model, fold), r in got.items():
        t = 30 + 5 * fold
        part = lambda lo, hi: (np.array([x[2:6] for x in rows if dates[lo] <= x[0] <= dates[hi - 1]]), np.array([x[6] for x in rows if dates[lo] <= x[0] <= dates[hi - 1]]))
        x, y = part(0, t)
        b, a = ridge(x, y, {"one": 1.0, "none": 0.0}[model])
        x, y = part(t, t + 10)
        p = a + x @ b
        rank = lambda v: np.argsort(np.argsort(v))
        assert r.n_test == len(y)
        assert abs(r.ic - np.corrcoef(rank(p), rank(y))[0, 1]) < 1e-9
        assert abs(r.r2 - (1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())) < 1e-9


def test_the_curve_has_both_sides(spark):
    rows = panel(40)
    df = spark.createDataFrame(rows, "date date, ticker string, a double, b double, c double, d double, ret double")
    got = sorted(walkforward.curve(df, list("abc"), [(0.2, 1.0), (1.0, 1.0)]).collect(), key=lambda r: r.share)
    dates = sorted({r[0] for r in rows})
    upto = np.cumsum([sum(x[0] == d for x in rows) for d in dates])
    cut = max(k for k in range(40) if upto[k] <= int(0.9 * len(rows)))
    for r in got:
        last = int(np.ceil(r.share * (cut + 1))) - 1
        x = np.array([x[2:5] for x in rows if x[0] <= dates[last]])
        y = np.array([x[6] for x in rows if x[0] <= dates[last]])
        b, a = ridge(x, y, 1.0)
        assert r.n_train == len(y) and abs(r.train_r2 - (1 - ((y - a - x @ b) ** 2).sum() / ((y - y.mean()) ** 2).sum())) < 1e-9
        assert r.n_test == len(rows) - upto[cut]


def test_the_stream_retires_as_the_batch_does(spark, tmp_path):
    r = random.Random(4)
    t0 = datetime.datetime(2024, 1, 1)
    ics = [(s, t0 + datetime.timedelta(days=d), r.choice([-0.02, 0.0, 0.02, 0.05]), False) for s in "abc" for d in range(120)]
    over = [("a", t0 + datetime.timedelta(days=50), None, True), ("a", t0 + datetime.timedelta(days=20), None, True), ("b", t0 - datetime.timedelta(days=1), None, True)]
    df = spark.createDataFrame(ics + over, "strategy string, ts timestamp, ic double, retire boolean")
    df.coalesce(1).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "events"))
    got = sorted((x.strategy, x.ts, x.status, x.multiplier) for x in jobs.run_available(jobs.stream_strategy_lifecycle(stream)).collect())
    twin = signals.strategy_lifecycle(spark.createDataFrame([(s, t.date(), ic) for s, t, ic, _ in ics], "strategy string, date date, ic double"), spark.createDataFrame([(s, t.date()) for s, t, *_ in over], "strategy string, date date"))
    assert [(s, t.date(), st, m) for s, t, st, m in got] == sorted((x.strategy, x.date, x.status, x.multiplier) for x in twin.collect())
    assert {x[2] for x in got} >= {"retired", "active", "under_review"}
