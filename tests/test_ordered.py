"""Scans and joins along an order, against plain loops at any partitioning."""

import random

import pandas as pd
import pytest

from panelforge.functions import ordered


def series(rows=600, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(rows):
        key = "hot" if r.random() < 0.6 else r.choice(["a", "b", None, "c"])
        out.append((key, i if r.random() < 0.9 else i // 7, None if r.random() < 0.1 or (key == "c" and i < 300) else r.gauss(0, 1), i))
    out += [("alone", 5, None, 10_000), ("one", 5, 2.0, 10_001)]
    return out


@pytest.mark.parametrize("parts", [2, 5, 60])
@pytest.mark.parametrize("adjust, start", [(False, None), (True, None), (False, 1.5)])
def test_ewm_is_the_plain_loop(spark, parts, adjust, start):
    rows = series()
    df = spark.createDataFrame(rows, "k string, t int, x double, id int").repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {r.id: r.ewm for r in ordered.ewm(df, "x", 9, ["k"], ["t", "id"], adjust=adjust, start=start).collect()}
        again = {r.id: r.ewm for r in ordered.ewm(df.filter("k = 'hot'"), "x", 9, [], ["t", "id"], adjust=adjust, start=start).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(got) == len(rows)
    a = 0.2
    for key in {r[0] for r in rows}:
        y, num, den = start, 0.0, 0.0
        seen = False
        for _, _, x, i in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[3])):
            if x is not None:
                y = x if y is None else (1 - a) * y + a * x
                num, den, seen = (1 - a) * num + x, (1 - a) * den + 1, True
            want = (num / den if adjust else y) if seen else None
            assert got[i] is None and want is None or abs(got[i] - want) < 1e-12, (key, i)
            if key == "hot":
                assert abs(again[i] - want) < 1e-12
    if adjust:
        own = pd.Series([r[2] for r in sorted((r for r in rows if r[0] == "a"), key=lambda r: (r[1], r[3]))]).ewm(span=9, ignore_na=True).mean()
        assert abs(own.iloc[-1] - got[sorted((r for r in rows if r[0] == "a"), key=lambda r: (r[1], r[3]))[-1][3]]) < 1e-12
    assert ordered.ewm(df.limit(0), "x", 9, ["k"], ["t"]).count() == 0


def test_long_series_in_one_key(spark):
    df = spark.range(300_000).selectExpr("id", "sin(id) AS x")
    got = ordered.ewm(df, "x", 20, [], ["id"]).orderBy("id").toPandas()
    want = pd.Series(got["x"]).ewm(span=20, adjust=False).mean()
    assert (got["ewm"] - want).abs().max() < 1e-12


@pytest.mark.parametrize("parts", [2, 40])
@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("forward", [False, True])
def test_asof_is_the_plain_loop(spark, parts, strict, forward):
    r = random.Random(parts)
    key = lambda: "hot" if r.random() < 0.7 else r.choice(["a", "b", None])
    left = [(key(), r.randrange(200) if r.random() < 0.95 else None, i) for i in range(300)]
    right = [(key(), r.randrange(200) if r.random() < 0.95 else None, i) for i in range(120)]
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        a, b = (spark.createDataFrame(x, "k string, t int, id int") for x in (left, right))
        got = {x.id: (x.right_id, x.right_t) for x in ordered.asof_join(a, b, ["k"], "t", tolerance=30, strict=strict, forward=forward, tie=["id"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(got) == len(left)
    for k, t, i in left:
        fits = [(u, j) for q, u, j in right if k is not None and q == k and t is not None and u is not None and ((u < t or u == t and not strict) if not forward else (u > t or u == t and not strict))]
        u, j = ((min if forward else max)(fits) if fits else (None, None))
        want = (j, u) if u is not None and abs(t - u) <= 30 else (None, None)
        assert got[i] == want, (k, t, i)


def test_asof_moves_no_row_twice_over(spark):
    """Each side is read once into the ranges; no join of left with right on the key is planned."""
    a = spark.createDataFrame([("a", 1, 1)], "k string, t int, l int")
    b = spark.createDataFrame([("a", 1, 2)], "k string, t int, r int")
    out = ordered.asof_join(a, b, ["k"], "t")
    assert [tuple(x) for x in out.collect()] == [("a", 1, 1, 1, 2)] and out.columns == ["k", "t", "l", "right_t", "right_r"]
    assert ordered.asof_join(a.limit(0), b, ["k"], "t").count() == 0
    assert ordered.asof_join(a, b.limit(0), ["k"], "t").first().right_r is None


def test_numbered(spark):
    df = spark.createDataFrame([(i * 7919 % 1000, "x") for i in range(1000)], "v int, part string")
    assert sorted((x.n, x.v) for x in ordered.numbered(df, ["-v"]).collect()) == [(i, 999 - i) for i in range(1000)]


def test_exact_sums_keep_small_terms(spark):
    from pyspark.sql import functions as F

    from panelforge.functions.columns import exact_sum

    df = spark.range(1_000_000).select((F.lit(1.7e-8) * (1 + F.col("id") % 3)).alias("x"))
    total = df.agg(exact_sum("x").alias("s")).first().s
    assert abs(total - 1.7e-8 * (1_000_000 + 999_999)) < 1e-12
    assert df.repartition(7).agg(exact_sum("x").alias("s")).first().s == total
