"""Top-k, shards, fingerprints and line dedup on small odd frames and against SQL or plain Python."""

import hashlib
import random
import unicodedata
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.llm import fingerprint, line_dedup, queries, shards, topk


def oracle(sf, sql):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con.sql(sql)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, sf, name):
    got, want = queries.QUERIES[name](spark, sf), oracle(sf, queries.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r) for r in got.select(columns).collect()), key=key) == sorted(want.select(", ".join(columns)).fetchall(), key=key)


@pytest.mark.parametrize("spread, negative", [(9, True), (9, False), (2**20, True), (2**28, True), (1, True)])
def test_maxscore_against_brute_force(spread, negative):
    r = np.random.default_rng(spread)
    x = r.integers(-spread if negative else 0, spread + 1, (3000, 12)) * (r.random((3000, 12)) < 0.6)
    x[100:400] = x[5]
    q, ids = x[:25], r.permutation(9000)[:3000]
    a, b, c = topk.maxscore(ids[:25], q, ids, x, 20)
    for i in range(25):
        want = sorted((-int(s), int(v)) for s, v in zip(x @ q[i], ids) if v != ids[i])[:20]
        assert [(-int(s), int(v)) for s, v in zip(c[a == ids[i]], b[a == ids[i]])] == want


def test_maxscore_visits_fewer_rows_than_there_are():
    """Sparse vectors: rows that stand in non-essential postings alone are never scored. Dense ones: fewer probes."""
    r = np.random.default_rng(5)
    x = (r.integers(1, 40, (20_000, 300)) * (r.random((20_000, 300)) < 0.02)).astype(np.int64)
    q = np.zeros((20, 300), np.int64)
    for row in q:
        row[r.choice(300, 3, replace=False)] = [60, 50, 1]
        row[r.choice(300, 20)] += 1
    seen: dict = {}
    a, b, c = topk.maxscore(np.arange(20), q, np.arange(100, 20_100), x, 10, seen)
    for i in range(20):
        want = sorted((-int(s), 100 + v) for v, s in enumerate(x @ q[i]))[:10]
        assert [(-int(s), int(v)) for s, v in zip(c[a == i], b[a == i])] == want
    assert seen["rows"] < 0.3 * 20 * 20_000
    x, seen = np.floor(64 * r.normal(0, 0.12, (20_000, 64))).astype(np.int64), {}
    topk.maxscore(np.arange(20), x[:20], np.arange(20_000), x, 20, seen)
    assert seen["probes"] < 0.1 * 20 * 20_000 * 64


def test_topk_with_extra_columns_wide_numbers_and_small_parts(spark):
    rows = [(i, [2**28 * (i % 7) - i, -i, 5], "x", 1) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>, b string, s int")
    got = topk.top_k(df.filter("vec_id % 50 = 0"), df, 4, shard=20, block=2).collect()
    for i in range(0, 300, 50):
        want = sorted((-sum(p * o for p, o in zip(rows[i][1], rows[j][1])), j) for j in range(300) if j != i)[:4]
        own = sorted((r["rank"], r.vec_id) for r in got if r.query_id == i)
        assert [v for _, v in own] == [j for _, j in want]


def test_topk_rows_without_part(spark):
    rows = [(1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (None, [1.0, 1.0]), (6, [0.5, -0.01]), (6, [0.5, -0.01]), (7, [1.0]), (8, [])]
    df = spark.createDataFrame(rows, "vec_id long, e array<double>").select("vec_id", topk.quantised(F.col("e")).alias("v"))
    got = sorted(tuple(r) for r in topk.top_k(df, df, 3).collect())
    assert got == [(1, 1, 6, 32 * 64 - 128), (1, 2, 6, 32 * 64 - 128), (6, 1, 1, 32 * 64 - 128), (6, 2, 1, 32 * 64 - 128)]
    assert topk.top_k(df.limit(0), df, 3).count() == 0


def test_shards(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op3_shards(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    slots = {}
    for r in got:
        assert (r["size"], r.text_crc32, r.law) == (len(docs[r.doc_id].encode()) + 8, zlib.crc32(docs[r.doc_id].encode()), "key")
        assert r.grown_shard in (r.shard, 24) and 0 <= r.shard < 24
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert any(r.grown_shard == 24 for r in got)


def test_shards_of_odd_rows(spark):
    rows = [(None, None, 1), (None, "x", 2), (1, "", 3), (1, "", 3)] + [(i, "t" * (i % 50), 0) for i in range(2, 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, slot int")
    out = shards.shuffled(df, 3, bucket_bytes=1000).collect()
    again = shards.shuffled(df.repartition(3), 3, bucket_bytes=1000).collect()
    assert sorted(map(str, out)) == sorted(map(str, again)) and len(out) == len(rows)
    for s in range(3):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    ids = [r.doc_id for r in sorted((r for r in out if r.shard == 0 and r.doc_id is not None), key=lambda r: r.slot)]
    assert ids != sorted(ids)
    assert shards.shuffled(df.limit(0), 3).count() == 0


def test_shards_keep_large_ids_beside_nulls(spark):
    rows = [((2**53 + 2 * i + 1) if i % 2 else None, f"t{i}", None if i % 3 else 2**60 + i, [1, None]) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, other long, list array<int>")
    out = shards.shuffled(df, 2, bucket_bytes=200).select("doc_id", "text", "other", "list").collect()
    assert sorted(map(tuple, out), key=lambda r: r[1]) == sorted(rows, key=lambda r: r[1])


def test_shards_pass_through_whatever_columns_are_called(spark):
    df = spark.createDataFrame([(i, f"t{i}", i, -i, "n", 1.5) for i in range(50)], "doc_id long, text string, __tie long, __bucket long, n string, first double")
    out = shards.shuffled(df, 2, bucket_bytes=200).select(*df.columns).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, df.collect()))


def test_shards_are_the_rule_and_fisher_yates_moves_everything(spark):
    """The shard and the slots by the rule itself, without buckets' help."""
    rows = [(i, f"text {i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = shards.shuffled(df, 5, seed=3, bucket_bytes=10**9).collect()
    ranks = df.select("doc_id", *[F.xxhash64(F.lit(3), "doc_id", F.lit(s)).alias(f"h{s}") for s in range(6)]).collect()
    best = {r.doc_id: max(range(5), key=lambda s: r[f"h{s}"]) for r in ranks}
    more = {r.doc_id: max(range(6), key=lambda s: r[f"h{s}"]) for r in ranks}
    assert all((r.shard, r.grown_shard) == (best[r.doc_id], more[r.doc_id]) for r in out)
    tie = dict(df.select("doc_id", F.xxhash64(F.lit(4), "doc_id", "text")).collect())
    for s in range(5):
        start = sorted((i for i in best if best[i] == s), key=tie.get)
        order = shards.fisher_yates(len(start), 3, s, 0)
        assert [r.doc_id for r in sorted((r for r in out if r.shard == s), key=lambda r: r.slot)] == [start[i] for i in order]
    assert sorted(order) == list(range(len(order))) and (order != np.arange(len(order))).mean() > 0.8


def canonical(x):
    import re

    fold = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", x or "").casefold())
    return re.sub(r"\s+", " ", fold).strip(" ")


TEXTS = ["Straße  Weg", "STRASSE weg", "ﬁne", "fine", "É", "É", "  a\tb\n", "A B", "", None, "½", "x　y", "X Y", "ΑΣ", "ας", "é" * 3000]


def test_canonical_groups(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(TEXTS)], "doc_id long, text string")
    out = {r.doc_id: r for r in fingerprint.fingerprints(df)[0].collect()}
    for i, x in enumerate(TEXTS):
        assert out[i].canonical == canonical(x)
        for j, y in enumerate(TEXTS):
            assert (out[i].fingerprint == out[j].fingerprint) == (canonical(x) == canonical(y))


def test_collisions_are_told_apart(spark):
    df = spark.createDataFrame([("h", "a"), ("h", "b"), ("h", "a"), ("g", "c")], "fingerprint string, canonical string")
    assert sorted(tuple(r) for r in fingerprint.collisions(df).select("fingerprint", "n", "canonical").collect()) == [("h", 0, "a"), ("h", 1, "b")]


def test_every_hash_collides(spark, sf, monkeypatch, tmp_path):
    """With one hash for all texts, bytes alone tell documents, and the texts compared with them, apart."""
    monkeypatch.setattr(fingerprint, "wide", lambda c: F.lit("h"))
    df = spark.createDataFrame([(i, x, 7) for i, x in enumerate(TEXTS)], "doc_id long, text string, n int")
    own, found = fingerprint.fingerprints(df)
    out = {r.doc_id: r for r in own.collect()}
    for i, x in enumerate(TEXTS):
        assert out[i].n == 7
        for j, y in enumerate(TEXTS):
            assert (out[i].fingerprint == out[j].fingerprint) == (canonical(x) == canonical(y))
    other = fingerprint.told_apart(fingerprint.hashed(df.select("doc_id", F.upper("text").alias("t")), "t"), found)
    for r in other.collect():
        want = [out[i].fingerprint for i, x in enumerate(TEXTS) if canonical(x) == canonical((TEXTS[r.doc_id] or "").upper())]
        assert not want or r.fingerprint == want[0]
    rows = [(1, "Ab"), (2, "a"), (3, "b"), (4, "AB"), (5, "ab")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op4_fingerprints(spark, str(tmp_path)).collect()}
    assert len({got[i].fingerprint for i in (1, 4, 5)}) == 1 and len({got[i].fingerprint for i in (1, 2, 3)}) == 3
    # 5 becomes "aA", 4 "Ab", 1 "Aa"
    assert got[4].edited_fingerprint == got[1].fingerprint and got[4].near_edited == 1.0 and got[1].near_edited == 0.0


@pytest.mark.parametrize("n", [1, 2, 3, 500])
def test_next_in_descending_order(spark, n):
    r = random.Random(n)
    ids = r.sample(range(-(10**6), 10**12), n)
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string").repartition(3)
    down = sorted(ids, reverse=True)
    want = {a: f"t{b}" for a, b in zip(down, down[1:] + down[:1])}
    assert {x.doc_id: x.next_text for x in fingerprint.with_next(df, ["text"]).collect()} == want


def test_next_with_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "n"), (5, None)], "doc_id long, text string")
    out = sorted(((r.doc_id, r.text, r.next_text) for r in fingerprint.with_next(df, ["text"]).collect()), key=str)
    assert out == sorted([(5, None, "a"), (1, "a", "a"), (1, "a", "n"), (None, "n", None)], key=str)
    assert fingerprint.with_next(df.limit(0), ["text"]).columns == ["doc_id", "text", "next_text"]


def test_fingerprint_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    down = sorted(docs, reverse=True)
    after = dict(zip(down, down[1:] + down[:1]))
    got = {r.doc_id: r for r in queries.op4_fingerprints(spark, sf).collect()}
    assert len(got) == len(docs)
    groups = {}
    for i, r in got.items():
        x, y = docs[i], docs[after[i]]
        k = len(x) // 2
        edited = x[: len(x) - k] + y[:k]
        assert (r.n_chars, r.edited_sha256) == (len(x), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == float(canonical(x) == canonical(edited)) and r.near_next == float(canonical(x) == canonical(y))
        assert groups.setdefault(canonical(x), r.fingerprint) == r.fingerprint
        assert groups.setdefault(canonical(edited), r.edited_fingerprint) == r.edited_fingerprint
    assert len(set(groups.values())) == len(groups)


LINE = "This is a line that is long enough to count, é"


def test_lines_of_odd_rows(spark):
    rows = [(i, f" {LINE}\t\nown {i}\n{LINE.replace('T', 't')}", "k") for i in range(6)] + [(9, None, "k"), (10, "", None), (None, LINE, None), (11, "short\n" * 3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    assert all((got[i].n_lines, got[i].n_dropped, got[i].kept) == (3, 2, f"own {i}") for i in range(5))
    assert got[5].n_dropped == 0 and got[5].kept == rows[5][1]
    assert (got[9].n_lines, got[9].kept, got[10].kept, got[None].kept, got[11].n_lines) == (1, "", "", LINE, 4)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_running_batches_and_compaction(spark):
    runs, seen, r = line_dedup.Runs(spark, fanout=2), {}, random.Random(4)
    for b in range(5):
        rows = [(100 * b + i, "\n".join(f"{'line ' * 9}{r.randrange(12)}" for _ in range(3))) for i in range(4)]
        got = {x.doc_id: x for x in line_dedup.dedup_batch(spark.createDataFrame(rows, "doc_id long, text string"), runs).collect()}
        for i, x in rows:
            keep = [k for k in x.split("\n") if seen.setdefault(k, i) == i]
            assert got[i].kept == "\n".join(keep)
    assert [len(x) for x in runs.levels] == [1, 0, 1] and runs.compactions == 3
    held = [r.h for r in runs.all().collect()]
    assert len(held) == len(set(held)) == len(seen)


def test_runs_stay_sorted_where_they_lie(spark):
    """A batch deals itself out, and no run: neither an exchange nor a sort stands over a run's scan, and a compaction
    zips buckets, each of which is one file again."""
    runs = line_dedup.Runs(spark, fanout=3, buckets=4)
    batch = lambda b: spark.range(500 * b, 500 * b + 1000).select(F.md5(F.col("id").cast("string")).cast("binary").alias("h"), F.col("id").alias("doc_id"))
    for b in range(4):
        runs.add(batch(b))
    assert [len(x) for x in runs.levels] == [1, 1] and all(len(spark.table(n).inputFiles()) == 4 for n in runs.tables)
    with line_dedup._bucketed(spark):
        plan = runs.met(batch(9))._jdf.queryExecution().executedPlan().toString()
        merge = runs.merged(runs.names())
        zipped = merge._jdf.queryExecution().executedPlan().toString()
        assert merge.rdd.getNumPartitions() == 4
    assert plan.count("Exchange") == plan.count("Sort [") == 1 and plan.count("Bucketed: true") == plan.count("SortMergeJoin") == 2
    assert "Exchange" not in zipped and zipped.count("Bucketed: true") == 2
    assert spark.conf.get("spark.sql.unionOutputPartitioning") == "false"
    assert runs.all().count() == runs.all().select("h").distinct().count() == 2500
    names = list(runs.tables)
    runs.drop()
    assert not any(spark.catalog.tableExists(n) for n in names)


def test_documents_that_rows_repeat(spark, tmp_path):
    """Four rows of one document are one document: the line stands in two, not in five."""
    for others in (1, 4):
        rows = [(1, LINE)] * 4 + [(2 + i, LINE) for i in range(others)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = sorted((r.doc_id, r.n_dropped) for r in line_dedup.dedup_lines(df, min_docs=5).collect())
        assert got == sorted((i, int(others == 4 and i < 5)) for i, _ in rows)


def test_a_corpus_by_batches_that_are_compacted(spark, monkeypatch):
    r, made, init = random.Random(8), [], line_dedup.Runs.__init__
    monkeypatch.setattr(line_dedup.Runs, "__init__", lambda self, *a, **b: made.append(self) or init(self, *a, **b))
    rows = [(i, "\n".join(f"{'line ' * 9}{r.randrange(60)}" for _ in range(3))) for i in range(100)]
    got = {x.doc_id: x.kept for x in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    holders: dict = {}
    for i, x in rows:
        for k in set(x.split("\n")):
            holders.setdefault(k, []).append(i)
    for i, x in rows:
        assert got[i] == "\n".join(k for k in x.split("\n") if len(holders[k]) < 5 or max(holders[k]) == i)
    assert made[0].compactions >= 2 and any(len(h) < 5 for h in holders.values())
