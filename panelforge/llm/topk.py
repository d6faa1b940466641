"""Exact top-k by integer inner product with MaxScore.

A query's terms are its components with their signs; a term's postings are the rows of a shard whose component has that
sign, and its bound is the query's weight times the largest such component. The terms with the smallest bounds, as long
as their sum stays below the query's k-th best score so far, are non-essential: a row that stands in their postings alone
cannot enter. The postings of the essential terms are traversed; the rows that they hold, and no others, are scored by
the essential terms and then probed in the other ones, from the largest bound down, as long as score so far plus the
bounds left can reach the k-th best. Shards are merged by a ranked window.

Shards of vectors and blocks of queries are packed once, in the narrowest whole numbers that hold them, and meet in
pairs, so a task holds one of each, whatever the table's size. Shards are dealt by a hash of the id, so equal vectors
spread. On dense vectors nearly every row stands in some essential posting, so there the bounds save probes, not rows; on
sparse ones they save rows (tests count both).

Defined results: vectors that are null or hold a null or non-finite component take no part, nor do rows without an id;
a vector does not meet rows of its own id; vectors meet those of the same length; repeated rows count each; equal scores
rank by the smaller id; components and scores must fit into 64 bits; fewer than k candidates give fewer rows; extra
columns take no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship

#: Vectors of a shard and queries of a block, about; shards at least, to keep a cluster busy; rows of a shard that are
#: traversed before the k-th best is looked at again.
SHARD, BLOCK, LEAST, CHUNK = 1 << 16, 1 << 14, 16, 1 << 11
_PAIR = "query_id long, vec_id long, score long"


def quantised(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component, or null if one is null or not finite (or the vector is)."""
    x = F.transform(vector, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(x, lambda v: F.floor(v * scale)))


def _kind(a: np.ndarray, b: np.ndarray):
    """The narrowest kind of number in which every sum of products is exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


class Postings:
    """The rows of a chunk by term: for each component those where it is positive and those where it is negative."""

    def __init__(self, x: np.ndarray):
        self.x = x
        order = np.argsort(x.T <= 0, axis=1, kind="stable")  # the positive rows of each component first
        self.up = [o[:n] for o, n in zip(order, (x > 0).sum(axis=0))]
        self.down = [np.flatnonzero(c < 0) for c in x.T]

    def union(self, terms: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The rows in the postings of any of the terms (components with the signs of w)."""
        held = np.zeros(len(self.x), bool)
        for n, t in enumerate(terms, 1):
            held[self.up[t] if w[t] > 0 else self.down[t]] = True
            if not n % 8 and held.all():
                break
        return np.flatnonzero(held)


def maxscore(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, visited: dict[str, int] | None = None):
    """For each query the k best of a shard: arrays of query ids, vector ids and scores. visited counts rows that were
    scored and components that were probed."""
    kind = _kind(q, x)
    q, x = q.astype(kind), x.astype(kind)
    visited = {} if visited is None else visited
    visited |= {"rows": visited.get("rows", 0), "probes": visited.get("probes", 0)}
    up, down = np.maximum(x.max(axis=0), 0), np.maximum((-x).max(axis=0), 0)
    bounds = np.where(q > 0, q * up, -q * down)
    terms = np.argsort(bounds, axis=1, kind="stable")  # the smallest bound first
    reach = np.cumsum(np.take_along_axis(bounds, terms, 1), axis=1)  # what the terms up to one can add at most
    scores: list[np.ndarray] = [np.empty(0, kind)] * len(q)
    found: list[np.ndarray] = [np.empty(0, np.int64)] * len(q)
    for at in range(0, len(ids), CHUNK):
        lists, theirs = Postings(x[at : at + CHUNK]), ids[at : at + CHUNK]
        for i, (own, w) in enumerate(zip(q_ids, q)):
            least = scores[i][-1] if len(scores[i]) == k else None
            split = 0 if least is None else int(np.searchsorted(reach[i], least, "left"))
            essential, rest = terms[i, split:], terms[i, :split]
            if least is None:
                alive = np.arange(len(theirs))
            else:
                alive = lists.union(essential[::-1], w)  # the longest reach first
            alive = alive[theirs[alive] != own]
            if not len(alive):
                continue
            visited["rows"] += len(alive)
            own_w = w.copy()
            own_w[rest] = 0
            got = (lists.x if len(alive) == len(lists.x) else lists.x[alive]) @ own_w
            for j in range(split - 1, -1, -1):  # probe, from the largest bound down
                keep = got + reach[i, j] >= least
                if not keep.all():
                    alive, got = alive[keep], got[keep]
                if not len(alive):
                    break
                visited["probes"] += len(alive)
                got = got + lists.x[alive, rest[j]] * w[rest[j]]
            if least is not None:
                keep = got >= least
                alive, got = alive[keep], got[keep]
            if len(alive):
                scores[i], found[i] = _best(np.r_[scores[i], got], np.r_[found[i], theirs[alive]], k)
    return np.repeat(q_ids, [len(f) for f in found]), np.concatenate(found), np.concatenate(scores).astype(np.int64)


def _pack(t: pa.Table, key: str) -> pa.Table:
    """A group's ids and components in one row."""
    v = t["v"].combine_chunks().flatten().to_numpy()
    wide = next(w for w in ("<i2", "<i4", "<i8") if not len(v) or np.iinfo(w).min <= v.min() and v.max() <= np.iinfo(w).max)
    return pa.table({key: t[key][:1], "d": t["d"][:1], "wide": [wide], "ids": pa.array([t["id"].to_numpy().astype("<i8").tobytes()], pa.binary()), "v": pa.array([v.astype(wide).tobytes()], pa.binary())})


def _unpack(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(t["ids"][0].as_py(), "<i8")
    return ids, np.frombuffer(t["v"][0].as_py(), t["wide"][0].as_py()).reshape(len(ids), -1)


def top_k(queries: DataFrame, vectors: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "v", shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k vectors of the highest inner product with each query. vector_col holds
    integer components."""
    ship(vectors.sparkSession)
    two = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<long>").alias("v")).filter("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    q, x = two(queries), two(vectors)
    shards, blocks = max(LEAST, -(-x.count() // shard)), max(1, -(-q.count() // block))

    def packed(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
        dealt = df.select("*", F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(n)).cast("int").alias(key), F.size("v").alias("d"))
        return dealt.groupBy(key, "d").applyInArrow(lambda t: _pack(t, key), f"{key} int, d int, wide string, ids binary, v binary")

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = packed(q, "b", blocks, 1).withColumn("s", every(shards))
    right = packed(x, "s", shards, 2).withColumn("b", every(blocks))

    def meet(own: pa.Table, theirs: pa.Table) -> pa.Table:
        if own.num_rows and theirs.num_rows:
            a, b, c = maxscore(*_unpack(own), *_unpack(theirs), k)
        else:
            a = b = c = np.empty(0, np.int64)
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.int64())})

    met = left.groupBy("b", "s", "d").cogroup(right.groupBy("b", "s", "d")).applyInArrow(meet, _PAIR)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
