"""Importance resampling against the contract written plainly."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from panelforge.llm import resampling
from panelforge.llm.queries import op11_resampling

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = ["", None, " ", "one", "one two", "One TWO\x00three", "É ÉÀ é", "İ x" * 30, "日本 語x日本", "w" * 500 + " " + "v" * 47 + " " + "u" * 48 + " é" + "t" * 49, "a b " * 50_000, "-- ..", "İK K"]


def features(text):
    w = WORDS.findall((text or "").translate(LOWER))
    return len(w), w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def plain(rows, target, percent, size, least, seed):
    """(id, n_features, weight, score, rank) of the rows."""
    crc = lambda x: zlib.crc32(x.encode()) % size
    s, t = Counter(crc(f) for _, x in rows for f in features(x)[1]), Counter(crc(f) for x in target for f in features(x)[1])
    s_all, t_all = float(s.total()), float(t.total())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (s_all + size) / ((s[b] + 1.0) * (t_all + size))))
    out = []
    for i, x in rows:
        n, f = features(x)
        weight = sum(gain(crc(y)) for y in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    enough = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(enough[: len(enough) * percent // 100]):
        r.append(k + 1)
    return [(*r[:4], r[5] if len(r) > 5 else None) for r in out]


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, x or 0) for x in r))


def test_words_and_spans():
    for x in TEXTS:
        found = resampling.words(x)
        assert [w for w, _ in found] == WORDS.findall((x or "").translate(LOWER))
        assert all((x or "").translate(LOWER)[s:e] == w for w, (s, e) in found)
    assert resampling.spans([(0, 2), (3, 4), (6, 9)]) == [(0, 2), (3, 4), (6, 9), (0, 4), (3, 9)]


def test_buckets():
    got, n = resampling.buckets(TEXTS, 10_000)
    assert n.tolist() == [features(x)[0] for x in TEXTS]
    assert got.tolist() == [zlib.crc32(f.encode()) % 10_000 for x in TEXTS for f in features(x)[1]]
    assert [len(x) for x in resampling.buckets([], 10)] == [0, 0]


@pytest.mark.parametrize("size", [10_000, 100_000, 7])
def test_against_plain(spark, size):
    r = random.Random(size)
    texts = TEXTS + [" ".join(r.choice(["alpha", "Beta", "gamma", "é", "ölt", "x1", "the", "of"]) for _ in range(r.randrange(0, 60))) for _ in range(300)]
    rows = [(None if i % 40 == 7 else i // 2 if i % 9 else 3, x, 5, "r", "b", "p") for i, x in enumerate(texts)] * 2
    target = [" ".join(r.choice(["alpha", "beta", "quiz"]) for _ in range(30)) for _ in range(20)] + [None, ""]
    df = spark.createDataFrame(rows, "doc_id long, text string, weight int, row string, buckets string, __part string")
    got = resampling.resampled(df.repartition(5), spark.createDataFrame([(x,) for x in target], "text string"), 30, size, 20, 7)
    assert got.columns == ["doc_id", "row", "buckets", "__part", "n_features", "weight", "score", "rank"]
    want = plain([x[:2] for x in rows], target, 30, size, 20, 7)
    # rows that equal each other in id and score may change ranks among themselves
    assert ordered(x[:4] for x in want) == ordered(got.select("doc_id", "n_features", "weight", "score").collect())
    assert ordered((x[3], x[0], x[4]) for x in want) == ordered(got.select("score", "doc_id", "rank").collect())


def test_empty(spark):
    df = spark.createDataFrame([(1, "a " * 30)] * 9, "doc_id long, text string")
    assert resampling.resampled(df.limit(0), df).count() == 0
    got = resampling.resampled(df, df.limit(0)).collect()
    assert ordered(got) == ordered(plain([(1, "a " * 30)] * 9, [], 25, 10_000, 20, 7))


def test_query(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("text").collect()]
    got = op11_resampling(spark, sf).select("doc_id", "n_features", "weight", "score", "rank")
    assert dict(got.dtypes) == {c: "bigint" for c in got.columns}
    assert ordered(got.collect()) == ordered(plain(docs, target, 25, 10_000, 20, 7))
