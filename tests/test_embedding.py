"""Correlation embeddings against dense numpy; nearest vectors against all pairs, and how much of them is met."""

import numpy as np
import pytest

from panelforge.operators import embedding


def returns(spark, n, t, seed=1, factors=3):
    r = np.random.default_rng(seed)
    x = r.standard_normal((t, factors)) @ (r.standard_normal((factors, n)) * np.arange(factors, 0, -1)[:, None]) + 0.3 * r.standard_normal((t, n))
    rows = [(f"d{j:04d}", f"t{i:03d}", float(x[j, i])) for j in range(t) for i in range(n)]
    return x, rows


@pytest.mark.parametrize("n, t, dim, tile", [(40, 70, 4, 16), (12, 35, 16, 5), (5, 31, 2, 512)])
def test_embedding_is_the_dense_one(spark, monkeypatch, n, t, dim, tile):
    monkeypatch.setattr(embedding, "TICKERS", tile)
    monkeypatch.setattr(embedding, "DATES", tile)
    monkeypatch.setattr(embedding, "BESIDE", 4)
    x, rows = returns(spark, n, t)
    # a date that lacks a ticker, null and infinite numbers of others, none of which count
    df = spark.createDataFrame(rows + [("x1", "t000", 9.0), ("x2", "t001", None)], "date string, ticker string, ret double")
    vectors, report = embedding.correlation_embedding(df, dim)
    corr, k = np.corrcoef(x.T), min(dim, n - 1)
    u, s, _ = np.linalg.svd(corr)
    want = u[:, :k] * np.sqrt(s[:k])
    got = vectors.orderBy("ticker").toPandas()
    assert got["ticker"].tolist() == [f"t{i:03d}" for i in range(n)]
    e = got.drop(columns="ticker").to_numpy()
    clear = [j for j in range(k) if s[j] - s[j + 1] > 1e-2 and (not j or s[j - 1] - s[j] > 1e-2)]
    assert clear
    for j in clear:
        assert min(np.abs(e[:, j] - want[:, j]).max(), np.abs(e[:, j] + want[:, j]).max()) < 1e-6
    assert np.abs(e @ e.T - want @ want.T).max() < 1e-6
    assert (np.take_along_axis(e, np.abs(e).argmax(0)[None], 0) > 0).all()
    r = report.first()
    assert (r.n_tickers, r.embedding_dim, r.n_dates) == (n, k, t)
    assert abs(r.reconstruction_mse - np.mean((corr - want @ want.T) ** 2)) < 1e-9


def test_too_little(spark):
    _, rows = returns(spark, 4, 20)
    df = spark.createDataFrame(rows, "date string, ticker string, ret double")
    for some in (df, df.limit(0)):
        vectors, report = embedding.correlation_embedding(some)
        assert vectors.count() == report.count() == 0 and vectors.columns[0] == "ticker"


def brute(rows, n):
    v = {}
    for i, g, x in rows:
        if i is not None and g is not None and x is not None and all(c is not None and np.isfinite(c) for c in x) and any(x):
            v.setdefault(g, []).append((i, np.array(x) / np.linalg.norm(x)))
    out = []
    for own in v.values():
        ids, m = [i for i, _ in own], np.array([x for _, x in own])
        sim = m @ m.T
        for a, i in enumerate(ids):
            s = sorted(((-np.copysign(np.floor(abs(sim[a, b]) * 1e6 + 0.5), sim[a, b]) / 1e6, j) for b, j in enumerate(ids) if j != i))[:n]
            out += [(i, j, round(-x, 6), k + 1) for k, (x, j) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("block, n, d", [(8, 3, 3), (16, 5, 2), (5, 1, 6), (256, 40, 4)])
def test_nearest_is_exact_and_meets_less(spark, monkeypatch, block, n, d):
    monkeypatch.setattr(embedding, "BLOCK", block)
    monkeypatch.setattr(embedding, "CHUNK", 3)
    r = np.random.default_rng(block)
    rows = []
    for i in range(500):
        g = int(r.choice([0, 0, 0, 0, 1, 2]))  # most rows in one group
        middle = np.eye(d)[i % d] * (3 if g == 0 else 1)
        rows.append((i, g, [float(x) for x in middle + 0.2 * r.standard_normal(d)]))
    rows += [(1000 + i, 1, rows[4][2]) for i in range(12)]  # equal vectors
    rows += [(2000, 9, [1.0] * d), (2001, None, [1.0] * d), (None, 1, [1.0] * d), (2002, 1, [0.0] * d), (2003, 1, None), (2004, 1, [None] * d), (2005, 1, [float("nan")] * d)]
    df = spark.createDataFrame(rows, "id long, label int, v array<double>")
    log = []
    got = sorted((x.id, x.other, round(x.similarity, 6), x.rank) for x in embedding.nearest(df, n, log=log).collect())
    assert got == brute(rows, n)
    everything, met = log[0]
    if block in (8, 16):
        assert met < 0.6 * everything, log
    assert embedding.nearest(df.limit(0)).count() == 0


def test_a_block_is_sent_once_for_a_team(spark, monkeypatch):
    """Where no bound rules a block out, each still goes to teams, not to every block."""
    monkeypatch.setattr(embedding, "BLOCK", 8)
    r, sent = np.random.default_rng(1), []
    rows = [(i, 0, [float(x) for x in r.standard_normal(16)]) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, label int, v array<double>")
    repartition = type(df).repartition
    monkeypatch.setattr(type(df), "repartition", lambda self, *a: (sent.append(self.count()) if "gap" in self.columns else None, repartition(self, *a))[1])
    got = sorted((x.id, x.other, round(x.similarity, 6), x.rank) for x in embedding.nearest(df, 3).collect())
    assert got == brute(rows, 3)
    # 75 blocks of three teams; before, nearly all pairs of blocks
    assert len(sent) == 2 and sent[0] <= 75 * 2 + 4 and sent[1] <= 75 * 3 + 75 * 2
