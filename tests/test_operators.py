"""Operators on tiny frames: the rules that SQL over the given tables does not show."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelforge.operators import altdata, execution, governance, models, pairs, pairtiles, portfolio, quality, risk, signals, technical
from panelforge.operators.quality import LookAhead
from panelforge.plans import views
from panelforge.sources import bars as src


def day(i):
    return dt.date(2024, 1, 1) + dt.timedelta(days=i)


def frame(spark, closes, ticker="A"):
    return spark.createDataFrame([(day(i), ticker, c, c, c, c, 10.0 + i % 3) for i, c in enumerate(map(float, closes))], "date date, ticker string, open double, high double, low double, close double, volume double")


def test_split_halves_earlier_prices(spark):
    b = frame(spark, [100.0, 100.0, 50.0])
    acts = spark.createDataFrame([("A", day(2), 0.5), ("A", day(9), 0.98)], "ticker string, ex_date date, adjustment_factor double")
    out = [round(r.close, 6) for r in quality.adjust_bars(b, acts).orderBy("date").collect()]
    assert out == [49.0, 49.0, 49.0]


def test_strict_alignment_raises(spark):
    b = frame(spark, [1.0, 2.0, 3.0])
    assert quality.align(b, "2024-01-03").count() == 2
    with pytest.raises(LookAhead):
        quality.align(b, "2024-01-03", strict=True)


def test_fingerprint_ignores_row_order(spark):
    b = frame(spark, [1.0, 2.0, 3.0])
    same = quality.dataset_fingerprint(b.orderBy(F.desc("date")).repartition(3)).first().digest
    assert same == quality.dataset_fingerprint(b).first().digest
    assert same != quality.dataset_fingerprint(b.limit(2)).first().digest


@pytest.mark.parametrize("name", ["return_feature", "volatility", "rsi", "bollinger_position", "relative_volume", "short_term_reversal"])
def test_features_do_not_see_the_future(spark, name):
    closes = [100 + (i * 37 % 11) for i in range(60)]
    full = technical.with_features(frame(spark, closes), {"v": getattr(technical, name)()})
    cut = technical.with_features(frame(spark, closes[:45]), {"v": getattr(technical, name)()})
    assert [r.v for r in full.orderBy("date").limit(45).collect()] == [r.v for r in cut.orderBy("date").collect()]


def test_rsi_and_bollinger_edges(spark):
    up = technical.with_features(frame(spark, range(1, 40)), {"r": technical.rsi(), "b": technical.bollinger_position()}).orderBy(F.desc("date")).first()
    flat = technical.with_features(frame(spark, [5] * 40), {"b": technical.bollinger_position(), "v": technical.return_feature()}).orderBy(F.desc("date")).first()
    assert up.r == 100 and flat.b == 0.5 and flat.v == 0


def test_macro_quadrants(spark):
    rows = [(1.0, 0.0, "goldilocks"), (1.0, 0.1, "risk_on_growth"), (-1.0, 0.1, "stagflation"), (-1.0, 0.0, "deflation"), (None, None, "goldilocks"), (None, 0.1, "stagflation")]
    df = spark.createDataFrame([r[:2] for r in rows], "g double, i double")
    assert [r.m for r in df.select(altdata.macro_regime(F.col("g"), F.col("i")).alias("m")).collect()] == [r[2] for r in rows]


def test_step_up_rule_rejects_more_than_bonferroni(spark):
    p = spark.createDataFrame([("a", 0.001), ("b", 0.015), ("c", 0.04), ("d", 0.9)], "id string, p double")
    bh = {r.id for r in signals.benjamini_hochberg(p, 0.05).filter("rejected").collect()}
    assert bh == {"a", "b"} and {r.id for r in signals.bonferroni(p, 0.05).filter("rejected").collect()} == {"a"}


def test_t_pvalue(spark):
    got = [r.p for r in spark.createDataFrame([(2.0, 10.0), (0.0, 5.0), (12.7062, 1.0)], "t double, n double").select(signals.t_pvalue(F.col("t"), F.col("n")).alias("p")).collect()]
    assert got == pytest.approx([0.073388, 1.0, 0.05], abs=2e-4)


def test_lifecycle(spark):
    rows = [("s", day(i * 10), ic) for i, ic in enumerate([0.05, 0.005, 0.02, -0.01, -0.02, -0.03, 0.5])]
    out = [r.status for r in signals.strategy_lifecycle(spark.createDataFrame(rows, "strategy string, date date, ic double")).orderBy("date").collect()]
    assert out == ["active", "under_review", "under_review", "under_review", "suspended", "suspended", "suspended"] or out[4:] == ["suspended"] * 3


def test_retired_strategies_stay_retired(spark):
    rows = [("s", day(i), 0.05) for i in range(6)] + [("t", day(i), 0.05) for i in range(6)]
    over = spark.createDataFrame([("s", day(3)), ("s", day(5))], "strategy string, date date")
    out = signals.strategy_lifecycle(spark.createDataFrame(rows, "strategy string, date date, ic double"), over).orderBy("strategy", "date").collect()
    assert [(r.status, r.multiplier) for r in out] == [("active", 1.0)] * 3 + [("retired", 0.0)] * 3 + [("active", 1.0)] * 6


def test_purged_folds_keep_apart(spark):
    d = spark.createDataFrame([(day(i),) for i in range(50)], "date date")
    f = models.purged_kfold(d, 5, 3).groupBy("fold").pivot("role", ["train", "test", "embargo"]).count().orderBy("fold").collect()
    assert [(r.test, r.embargo or 0) for r in f] == [(10, 3)] * 4 + [(10, 0)]


def test_variance_adds_up(spark):
    w = spark.createDataFrame([("A", 0.6), ("B", -0.4)], "ticker string, weight double")
    e = spark.createDataFrame([("A", "m", 1.1), ("B", "m", 0.9), ("A", "v", 0.2), ("B", "v", -0.3)], "ticker string, factor string, beta double")
    c = spark.createDataFrame([("m", "m", 0.04), ("m", "v", 0.01), ("v", "m", 0.01), ("v", "v", 0.02)], "f1 string, f2 string, cov double")
    i = spark.createDataFrame([("A", 0.05), ("B", 0.03)], "ticker string, variance double")
    parts = portfolio.risk_decomposition(w, e, c, i)
    full = portfolio.full_covariance(e, c, i)
    total = full.join(w.toDF("t1", "w1"), "t1").join(w.toDF("t2", "w2"), "t2").agg(F.sum(F.col("cov") * F.col("w1") * F.col("w2")).alias("v")).first().v
    assert sum(r.variance for r in parts.collect()) == pytest.approx(total) and sum(r.share for r in parts.collect()) == pytest.approx(1)


def test_mean_variance_against_dense_solve(spark):
    import numpy as np

    r = np.random.default_rng(1)
    b, f, a = r.normal(size=(8, 2)), np.array([[0.04, 0.01], [0.01, 0.02]]), r.normal(size=8)
    e = spark.createDataFrame([(f"t{i}", f"f{k}", float(b[i, k])) for i in range(8) for k in range(2)], "ticker string, factor string, beta double")
    c = spark.createDataFrame([(f"f{i}", f"f{j}", float(f[i, j])) for i in range(2) for j in range(2)], "f1 string, f2 string, cov double")
    got = portfolio.mean_variance_weights(spark.createDataFrame([(f"t{i}", float(a[i])) for i in range(8)], "ticker string, alpha double"), e, c, ridge=0.1, most=1e9, gross=1e9, rounds=0)
    want = np.linalg.solve(b @ f @ b.T + 0.1 * np.eye(8), a)
    assert [x.weight for x in got.orderBy("ticker").collect()] == pytest.approx(list(want))


def test_kill_switch_stays(spark):
    nav = spark.createDataFrame([(day(i), float(v)) for i, v in enumerate([100, 120, 95, 130, 140])], "date date, nav double")
    out = risk.kill_switch(nav).orderBy("date").collect()
    assert [r.halted for r in out] == [False, False, True, True, True] and [r.peak for r in out][2:] == [120.0] * 3


def test_schedules_place_every_share(spark):
    o = spark.createDataFrame([("x", 1003, 1e5), ("y", 7, 1e5)], "order_id string, quantity long, adv double")
    for s in (execution.vwap_schedule(o), execution.twap_schedule(o)):
        assert {r.order_id: r.n for r in s.groupBy("order_id").agg(F.sum("target").alias("n")).collect()} == {"x": 1003, "y": 7}


def test_rate_and_duplicates(spark):
    t = dt.datetime(2024, 1, 2, 15)
    rows = [(f"{i}", "A", "buy", 100.0 + i // 6, t + dt.timedelta(milliseconds=50 * i)) for i in range(7)]
    out = {r.order_id: (r.rate_limited, r.duplicate) for r in execution.order_rate_and_duplicate_flags(spark.createDataFrame(rows, "order_id string, ticker string, side string, quantity double, ts timestamp")).collect()}
    assert [out[str(i)][0] for i in range(7)] == [False] * 5 + [True] * 2
    assert [out[str(i)][1] for i in range(7)] == [False] + [True] * 5 + [False]


def test_rate_and_duplicates_reach_across_midnight(spark):
    t = dt.datetime(2024, 1, 2, 23, 59, 59, 600_000)
    rows = [(f"{i}", "A", "buy", float(i % 6), t + dt.timedelta(milliseconds=100 * i)) for i in range(8)] + [("9", "A", "buy", 0.0, t + dt.timedelta(seconds=59)), ("z", "A", "buy", 0.0, t + dt.timedelta(seconds=200))]
    out = {r.order_id: (r.rate_limited, r.duplicate) for r in execution.order_rate_and_duplicate_flags(spark.createDataFrame(rows, "order_id string, ticker string, side string, quantity double, ts timestamp")).collect()}
    assert [out[str(i)][0] for i in range(8)] == [False] * 5 + [True] * 3
    assert [out[str(i)][1] for i in range(8)] == [False] * 6 + [True] * 2 and out["9"] == (False, True) and out["z"] == (False, False)


def test_greedy_rules_by_burst_equal_a_walk_over_everything(spark):
    import random

    r, t, rows, at = random.Random(6), dt.datetime(2024, 1, 1), [], 0.0
    for i in range(600):
        at += r.choice([0.1, 0.3, 5.0, 40.0, 70.0, 400.0]) * r.random()
        rows.append((f"{i:04}", r.choice("AB"), "buy", float(r.randrange(3)), t + dt.timedelta(seconds=round(at, 3))))
    out = {x.order_id: (x.rate_limited, x.duplicate) for x in execution.order_rate_and_duplicate_flags(spark.createDataFrame(rows, "order_id string, ticker string, side string, quantity double, ts timestamp")).collect()}
    sent: dict = {}
    seen: dict = {}
    for i, a, b, q, ts in rows:
        own = [x for x in sent.get(a, []) if (ts - x).total_seconds() < 1]
        limited = len(own) >= 5
        sent[a] = own if limited else [*own, ts]
        again = (a, b, q) in seen and (ts - seen[a, b, q]).total_seconds() < 60
        seen[a, b, q] = seen[a, b, q] if again else ts
        assert out[i] == (limited, again)
    alerts = spark.createDataFrame([(a, "m", "W", ts, int(i)) for i, a, _, _, ts in rows], "source string, message string, level string, ts timestamp, alert_id long")
    last, want = {}, []
    for i, a, _, _, ts in rows:
        if a not in last or (ts - last[a]).total_seconds() >= 30:
            last[a] = ts
            want.append(int(i))
    assert sorted(x.alert_id for x in governance.dedupe_alerts(alerts, 30.0).collect()) == want


def test_sessions(spark):
    times = ["2024-07-03 16:59:00", "2024-07-03 17:01:00", "2024-07-04 15:00:00", "2024-07-06 15:00:00", "2024-07-05 13:29:00", "2024-07-05 13:30:00", "2024-07-05 19:56:00"]
    df = spark.createDataFrame([(x,) for x in times], "ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = {str(r.ts): r for r in execution.can_submit(df).collect()}
    assert [got[x].open for x in times] == [True, False, False, False, False, True, True]
    assert [got[x].reason for x in times] == ["eod_cutoff", "outside_hours", "holiday", "weekend", "outside_hours", "OK", "eod_cutoff"]
    nxt = {str(r.ts): str(r.next_open) for r in execution.next_open(df).collect()}
    assert nxt["2024-07-03 17:01:00"] == "2024-07-05 09:30:00" and nxt["2024-07-06 15:00:00"] == "2024-07-08 09:30:00"


def test_alerts_repeat_after_window(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("s", "m", "W", t + dt.timedelta(seconds=s), s) for s in (0, 200, 310, 500, 650)]
    out = governance.dedupe_alerts(spark.createDataFrame(rows, "source string, message string, level string, ts timestamp, alert_id long"))
    assert sorted(r.alert_id for r in out.collect()) == [0, 310, 650]


def test_cointegrated_pair_is_found(spark):
    import numpy as np

    r = np.random.default_rng(4)
    x = 50 + np.cumsum(r.normal(0, 0.5, 400))
    e = np.zeros(400)
    for i in range(1, 400):
        e[i] = 0.8 * e[i - 1] + r.normal(0, 0.5)
    rows = [(day(i), t, float(v)) for i in range(400) for t, v in (("X", x[i]), ("Y", 1.5 * x[i] + e[i] + 5))]
    b = spark.createDataFrame(rows, "date date, ticker string, close double")
    found = pairtiles.find_pairs(b, pairs.pair_candidates(spark.createDataFrame([("X",), ("Y",)], "ticker string"))).collect()
    assert len(found) == 1 and found[0].p == 0.01 and 1 < found[0].half_life < 10
    sig = pairs.kalman_pair_signal(pairs.aligned(b, spark.createDataFrame([("Y", "X")], "a string, b string")))
    assert sig.count() == 400 and {-1, 0, 1} >= {r.signal for r in sig.collect()}


@pytest.mark.parametrize("tickers, dates", [(64, 2048), (2, 37)])
def test_tiles_of_pairs_equal_the_spreads_tests(spark, monkeypatch, tickers, dates):
    """At any size of a tile, dates that a ticker lacks and steps over a tile's edge included, and without a row for a pair
    and date anywhere in the plan."""
    import numpy as np

    monkeypatch.setattr(pairtiles, "TICKERS", tickers)
    monkeypatch.setattr(pairtiles, "DATES", dates)
    r = np.random.default_rng(8)
    x = 50 + np.cumsum(r.normal(0, 0.5, (300, 5)), axis=0)
    x[:, 3] = 1.7 * x[:, 0] + r.normal(0, 1, 300)
    lacks = r.random((300, 5)) < 0.05
    lacks[60:150, 2] = True
    b = spark.createDataFrame([(day(i), f"t{j}", float(x[i, j])) for i in range(300) for j in range(5) if not lacks[i, j]] + [(day(3), "t9", 4.0), (day(4), "t9", None)], "date date, ticker string, close double")
    candidates = pairs.pair_candidates(spark.createDataFrame([(f"t{j}",) for j in (0, 1, 2, 3, 4, 9)], "ticker string"))
    rows = pairs.aligned(b, candidates)
    h = pairs.pair_hedge_ratio(rows, 150)
    s = pairs.pair_spread(rows, h)
    want = {(r.a, r.b): r for r in h.join(pairs.adf_simple(s), ["a", "b"]).join(pairs.half_life(s), ["a", "b"]).collect()}
    got = pairtiles.pair_statistics(b, candidates, 150).collect()
    assert len(got) == len(want) == 10
    for g in got:
        w = want[g.a, g.b]
        assert g.n == w.n and (g.beta, g.alpha, g.t, g.p, g.phi) == pytest.approx((w.beta, w.alpha, w.t, w.p, w.phi), rel=1e-8) and (g.half_life == w.half_life or g.half_life == pytest.approx(w.half_life, rel=1e-8))
    plan = pairtiles.pair_sums(b, candidates)._jdf.queryExecution().executedPlan().toString()
    assert "close#" not in plan and "MapInArrow" in plan
    assert pairtiles.pair_statistics(b.limit(0), candidates).count() == 0


def test_pair_filter_against_matrices(spark):
    """The same filter written as matrices, and positions that jump over the band in which they are left."""
    import numpy as np

    r = np.random.default_rng(9)
    x, y = 50 + np.cumsum(r.normal(0, 1, 300)), 80 + np.cumsum(r.normal(0, 2, 300))
    y[::17] += r.choice([-30, 30], len(y[::17]))
    b = spark.createDataFrame([(day(i), t, float(v)) for i in range(300) for t, v in (("X", x[i]), ("Y", y[i]))], "date date, ticker string, close double")
    got = pairs.kalman_pair_signal(pairs.aligned(b, spark.createDataFrame([("Y", "X")], "a string, b string"))).orderBy("date").collect()
    m, c = np.array([[1.0], [0.0]]), np.eye(2)
    mean, var, a, pos, seen = 0.0, 1.0, 2 / 61, 0, set()
    for i, g in enumerate(got):
        c = c + 1e-4 * np.eye(2)
        h = np.array([[x[i], 1.0]])
        k = c @ h.T @ np.linalg.inv(h @ c @ h.T + 1.0)
        m = m + k @ (np.array([[y[i]]]) - h @ m)
        c = (np.eye(2) - k @ h) @ c
        e = y[i] - (h @ m)[0, 0]
        mean = a * e + (1 - a) * mean
        var = a * (e - mean) ** 2 + (1 - a) * var
        z = (e - mean) / np.sqrt(max(var, 1e-10))
        before = pos
        if pos == 0 and abs(z) > 2:
            pos = -int(np.sign(z))
        elif pos == 1 and (z > -0.5 or z < -3.5) or pos == -1 and (z < 0.5 or z > 3.5):
            pos = 0
        seen.add((before, pos))
        assert (g.beta, g.spread, g.z) == pytest.approx((m[0, 0], e, z), abs=1e-8) and g.signal == pos
    assert {(0, 1), (1, 0), (0, -1), (-1, 0)} <= seen
    assert pairs.kalman_pair_signal(pairs.aligned(b.filter("date < '2024-01-06'"), spark.createDataFrame([("Y", "X")], "a string, b string"))).count() == 0


@pytest.mark.parametrize("values", [1 << 16, 3])
def test_mean_variance_rounds_against_plain_arrays(spark, monkeypatch, values):
    import numpy as np

    monkeypatch.setattr(portfolio, "MOST_VALUES", values)
    r = np.random.default_rng(2)
    n = 60
    b, f, a = r.normal(size=(n, 2)), np.array([[0.04, 0.01], [0.01, 0.02]]), r.normal(size=n)
    e = spark.createDataFrame([(f"t{i:02}", f"f{k}", float(b[i, k])) for i in range(n) for k in range(2)] + [("t01", "unknown", 3.0)], "ticker string, factor string, beta double")
    c = spark.createDataFrame([(f"f{i}", f"f{j}", float(f[i, j])) for i in range(2) for j in range(2)], "f1 string, f2 string, cov double")
    got = portfolio.mean_variance_weights(spark.createDataFrame([(f"t{i:02}", float(a[i])) for i in range(n)], "ticker string, alpha double"), e, c, ridge=0.1, most=0.02, gross=0.9, rounds=20 if values > 3 else 4)
    w = np.linalg.solve(b @ f @ b.T + 0.1 * np.eye(n), a)
    for _ in range(20 if values > 3 else 4):
        w = np.clip(w, -0.02, 0.02)
        w = np.clip(w - w.mean(), -0.02, 0.02)
        w = w * min(1, 0.9 / np.abs(w).sum())
    assert [x.weight for x in got.orderBy("ticker").collect()] == pytest.approx(list(w), abs=1e-12)
    assert "Window" not in got._jdf.queryExecution().toString()


def test_exposures_where_a_date_lacks_a_factor(spark):
    import numpy as np

    r = np.random.default_rng(5)
    x = r.normal(size=(120, 2))
    rets = x @ np.array([[1.0, -0.5], [0.3, 2.0]]).T + 0.01 * r.normal(size=(120, 2))
    known = [i for i in range(120) if i % 9]
    factors = spark.createDataFrame([(day(i), n, float(x[i, k])) for i in range(120) for k, n in enumerate(("m", "s")) if i in known or k], "date date, factor string, ret double")
    returns = spark.createDataFrame([(day(i), f"t{j}", float(rets[i, j])) for i in range(120) for j in range(2)], "date date, ticker string, ret double")
    got = {(g.ticker, g.factor): g.beta for g in portfolio.factor_exposures(returns, factors).collect()}
    for j in range(2):
        want = np.linalg.lstsq(np.c_[np.ones(len(known)), x[known]], rets[known, j], rcond=None)[0]
        assert (got[f"t{j}", "m"], got[f"t{j}", "s"]) == pytest.approx(tuple(want[1:]), abs=1e-9)


def test_csv_round_trip_per_ticker(spark, tmp_path):
    for t in ("AA", "BB"):
        (tmp_path / f"{t}.csv").write_text("Date, Close ,Volume\n2024-01-01,1.5,10\n2024-01-02,2.5,20\n")
    out = src.read_bars_csv(spark, str(tmp_path), ["AA"], "2024-01-02")
    assert [tuple(r) for r in out.collect()] == [(day(1), "AA", 2.5, 20.0)]


def test_plan_pushes_filters_and_columns(spark, sf):
    plan = views.table(spark, sf, "lineitem").filter("l_quantity > 30").select("l_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,30.0)]" in plan and "l_extendedprice" not in plan
