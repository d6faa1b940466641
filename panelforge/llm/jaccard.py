"""N-gram Jaccard join with adaptive multi-match prefixes, and the classes that its links make.

Two documents link when their sets' intersection is at least num / den of their union. Sets are ordered by how many
documents hold a shingle, the rarest first, so that linked documents share l shingles among the first
n - ceil(num / den * n) + l of each, for any l. A document's l is the one of least estimated cost: the postings its
prefix reads, and the candidates they may leave, of which each must be met l times.

The steps, none of which holds a group of unbounded size:
 1. Documents of equal sets form a class; its smallest id stands for it.
 2. A document can link only if at most n - ceil(num / den * n) of its shingles are its own alone. A hash range of the
    shingle space is enough to rule out those that have more inside it already; they are most. Each block of documents
    sends every hash once, with the document that holds it or a mark that several do.
 3. For what is left, shingles are counted exactly, by blocks again, and prefixes chosen.
 4. Each posting list links its documents to the one with the fewest shingles of its own, as far as they are truly
    similar: that joins the bulk of a group of near copies in linear work.
 5. Posting lists that still hold several components give the pairs across components, met by bands of sizes and
    filtered by sizes, positions (a shingle of one component alone cannot match across) and the number of matches,
    which must reach the smaller l of the two; matches close together are met once, and count as enough. The similar ones among them complete the links. Pairs inside a component
    cannot change it, so the components are exact. This step is the one whose work is not linear: a posting list of m
    documents in as many components of like sizes gives up to m * m / 2 pairs of numbers, spread over tasks by list and
    band (and split further by AQE where one is hot); rarity keeps frequent shingles out of prefixes.

A block's messages number at most its shingles, however many ranges there are, so what is sent grows in proportion.

Defined results: null, empty and wordless texts have an empty set, and link with nothing; rows without an id are left
out of the join and come back without a component; rows that repeat an id with equal text are answered alike (an id
with different texts stands for both); extra columns take no part; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Work, ship
from .components import components
from .shingles import blocks, shingle_sets

#: Shingles of a hash range, about; marks a hash that several documents of a block hold; matches that l may ask for.
RANGE, SEVERAL, MOST_MATCHES = 1 << 21, 0xFFFF, 4
#: Places of a prefix, among those that can match, that count as close together.
NEAR = 6
#: What verifying a candidate costs, in postings read.
VERIFY = 8


def _batch(names: list[str], kinds: list[pa.DataType], columns: list[list]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names)


def _ranges(h: np.ndarray, top: int, parts: int) -> tuple[np.ndarray, list[bytes]]:
    """Where each hash range of sorted h begins, and the hashes inside it in 32 bits."""
    width = top // parts + 1
    low = [min(p * width, 2**64 - 1) for p in range(parts)]
    at = np.r_[np.searchsorted(h, np.array(low, np.uint64)), len(h)]
    shift = np.uint64(max(0, width.bit_length() - 32))
    return at, [((h[s:e] - np.uint64(lo)) >> shift).astype("<u4").tobytes() for lo, s, e in zip(low, at[:-1], at[1:])]


def _counts(doc: np.ndarray, n: np.ndarray) -> bytes:
    """Counts by document, in 16 bits, up to the last that has any."""
    out = np.zeros(int(doc[-1]) + 1 if len(doc) else 0, "<u2")
    out[doc] = np.minimum(n, 0xFFFF)
    return out.tobytes()


def _merge(t: pa.Table, second: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """The messages of a hash range: hash, second value and row of each, and the rows' lengths."""
    hs = [np.frombuffer(x, "<u4") for x in t["h"].to_pylist()]
    lengths = [len(x) for x in hs]
    return np.concatenate(hs), np.frombuffer(b"".join(t[second].to_pylist()), "<u2"), np.repeat(np.arange(len(hs)), lengths), lengths


def sets_of(df: DataFrame, k: int) -> DataFrame:
    """(id, n, sig) of (id, text): the size of the shingle set and its 128-bit hash."""

    def light(batches):
        for b in batches:
            sets = shingle_sets(b.column(1).to_pylist(), k)
            sig = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            yield pa.record_batch([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(sig, pa.binary())], ["id", "n", "sig"])

    return df.mapInArrow(light, "id long, n long, sig binary")


def possible(df: DataFrame, k: int, num: int, den: int, shingles: int) -> DataFrame:
    """(id) of the documents that may link: those with few shingles of their own in a range of hashes."""
    fraction = min(1.0, 3 * (den - num) / den)
    top = min(2**64 - 1, int(fraction * 2**64))
    parts = max(2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(shingles * fraction) // RANGE + 1)
    names = ["part", "block", "h", "doc", "ids", "room"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def send(batches):
        for block, ids, sets in blocks(batches, k):
            flat = np.concatenate(sets)
            doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[flat <= np.uint64(top)]
            flat = flat[flat <= np.uint64(top)]
            h, first, n = np.unique(flat, return_index=True, return_counts=True)
            doc = np.where(n == 1, doc[first], SEVERAL).astype("<u2")
            at, hs = _ranges(h, top, parts)
            full = [p for p in range(parts) if at[p] < at[p + 1]]
            room = [len(s) - -(-num * len(s) // den) if len(s) else -1 for s in sets]
            none = [None] * len(full)
            yield _batch(names, kinds, [full, [block] * len(full), [hs[p] for p in full], [doc[at[p] : at[p + 1]].tobytes() for p in full], none, none])
            yield _batch(names, kinds, [[-1 - block], [block], [None], [None], [ids], [room]])

    names2, kinds2 = ["block", "own", "ids", "room"], [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def count(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        if t["h"].null_count:
            return pa.table({"block": t["block"], "own": t["doc"], "ids": t["ids"], "room": t["room"]})
        h, doc, row, lengths = _merge(t, "doc")
        _, first, n = np.unique(h, return_index=True, return_counts=True)
        alone = first[n == 1]
        alone = alone[doc[alone] != SEVERAL]
        # one count for each (message, document) that has such a hash; messages lie one after the other
        at, n = np.unique(row[alone].astype(np.int64) << 16 | doc[alone], return_counts=True)
        ends = np.searchsorted(at, np.arange(1, len(lengths) + 1, dtype=np.int64) << 16)
        own = [_counts(at[s:e] & 0xFFFF, n[s:e]) for s, e in zip(np.r_[0, ends[:-1]], ends)]
        none = [None] * len(own)
        return pa.Table.from_batches([_batch(names2, kinds2, [t["block"].to_pylist(), own, none, none])])

    def decide(t: pa.Table) -> pa.Table:
        info = next(r for r in t.to_pylist() if r["ids"] is not None)
        own = np.zeros(len(info["ids"]), np.int64)
        for x in t["own"].to_pylist():
            if x:
                n = np.frombuffer(x, "<u2")
                own[: len(n)] += n
        return pa.table({"id": pa.array(np.array(info["ids"], np.int64)[own <= np.array(info["room"])], pa.int64())})

    sent = df.mapInArrow(send, "part long, block long, h binary, doc binary, ids array<long>, room array<long>")
    counted = sent.groupBy("part").applyInArrow(count, "block long, own binary, ids array<long>, room array<long>")
    return counted.groupBy("block").applyInArrow(decide, "id long")


_POSTING = "h long, id long, n int, l int, own int, pos int"


def prefixes(df: DataFrame, k: int, num: int, den: int, shingles: int, work: Work) -> tuple[DataFrame, DataFrame]:
    """(id, n, set) of (id, text), and the postings of the prefixes: (h, id, n, l, own, pos), without shingles that one
    document alone holds; own counts those."""

    def store(batches):
        for block, ids, sets in blocks(batches, k):
            yield _batch(["block", "ids", "sets"], [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.binary())], [[block], [ids], [[s.tobytes() for s in sets]]])

    stored = work.cut(df.mapInArrow(store, "block long, ids array<long>, sets array<binary>"), "sets", codec="none")
    parts = max(2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), shingles // RANGE + 1)
    top = 2**64 - 1

    def distinct(sets: list[bytes]):
        return np.unique(np.frombuffer(b"".join(sets), "<u8"), return_counts=True)

    def send(batches):
        for b in batches:
            for block, sets in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h, n = distinct(sets)
                at, hs = _ranges(h, top, parts)
                full = [p for p in range(parts) if at[p] < at[p + 1]]
                n = np.minimum(n, 65535).astype("<u2")
                yield _batch(["part", "block", "h", "n"], [pa.int64(), pa.int64(), pa.binary(), pa.binary()], [full, [block] * len(full), [hs[p] for p in full], [n[at[p] : at[p + 1]].tobytes() for p in full]])

    def count(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        h, n, _, lengths = _merge(t, "n")
        _, of = np.unique(h, return_inverse=True)
        held = np.bincount(of, weights=n).astype("<u4")[of]
        ends = np.cumsum(lengths)
        own = [held[e - m : e].tobytes() for e, m in zip(ends, lengths)]
        return pa.table({"block": t["block"], "part": t["part"], "held": pa.array(own, pa.binary())})

    def choose(left: pa.Table, right: pa.Table) -> pa.Table:
        cols: list[list[np.ndarray]] = [[] for _ in range(6)]
        if left.num_rows and right.num_rows:
            ids, sets = left["ids"][0].as_py(), left["sets"][0].as_py()
            h, _ = distinct(sets)
            answers = sorted(zip(right["part"].to_pylist(), right["held"].to_pylist()))
            held = np.frombuffer(b"".join(x for _, x in answers), "<u4").astype(np.int64)
            for i, raw in zip(ids, sets):
                s = np.frombuffer(raw, "<u8")
                if not len(s):
                    continue
                n, count_ = len(s), held[np.searchsorted(h, s)]
                order = np.lexsort((s, count_))
                need = -(-num * n // den)
                read = np.cumsum(count_[order] - 1)
                tries = [(read[n - need + m - 1] * (1 + VERIFY / m), m) for m in range(1, min(MOST_MATCHES, need) + 1)]
                m = min(tries)[1]
                own = int((count_ == 1).sum())
                prefix = order[own : n - need + m]
                for c, v in zip(cols, (s[prefix].view(np.int64), i, n, m, own, np.arange(own, own + len(prefix)))):
                    c.append(v if isinstance(v, np.ndarray) else np.full(len(prefix), v))
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
        flat = [pa.array(np.concatenate(c) if c else np.empty(0, np.int64)).cast(t) for c, t in zip(cols, kinds)]
        return pa.table(flat, names=["h", "id", "n", "l", "own", "pos"])

    held = stored.select("block", "sets").mapInArrow(send, "part long, block long, h binary, n binary").groupBy("part").applyInArrow(count, "block long, part long, held binary")
    postings = stored.groupBy("block").cogroup(held.groupBy("block")).applyInArrow(choose, _POSTING)

    def each(batches):
        for b in batches:
            for ids, sets in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                yield _batch(["id", "n", "set"], [pa.int64(), pa.int64(), pa.binary()], [ids, [len(x) // 8 for x in sets], sets])

    return stored.mapInArrow(each, "id long, n long, set binary"), work.cut(postings, "postings")


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar enough."""

    def keep(batches):
        for b in batches:
            x, y = b.column(2).to_pylist(), b.column(3).to_pylist()
            ok = []
            for p, q in zip(x, y):
                p, q = np.frombuffer(p, "<u8"), np.frombuffer(q, "<u8")
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(den * both >= num * (len(p) + len(q) - both))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left = sets.selectExpr("id AS a", "set AS set_a")
    right = sets.selectExpr("id AS b", "set AS set_b")
    return pairs.join(right, "b").join(left, "a").select("a", "b", "set_a", "set_b").mapInArrow(keep, "a long, b long")


def classes(df: DataFrame, k: int = 5, num: int = 8, den: int = 10, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n, comp): each row's set size and the smallest id that its links reach, itself included."""
    spark = df.sparkSession
    ship(spark)
    work = Work(spark)
    two = df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    light = work.cut(sets_of(two, k), "light")
    named = light.filter("id IS NOT NULL AND n > 0")
    lead = work.cut(named.groupBy("sig").agg(F.min("id").alias("lead")), "lead")
    shingles = named.agg(F.sum("n")).first()[0] or 0
    ids = two.filter("id IS NOT NULL")
    left = work.cut(possible(ids, k, num, den, shingles), "possible")
    chosen = work.cut(left.join(lead.selectExpr("lead AS id"), "id", "left_semi").distinct(), "chosen")
    some = named.join(chosen, "id", "left_semi").agg(F.sum("n")).first()[0] or 0
    sets, postings = prefixes(ids.join(chosen, "id", "left_semi"), k, num, den, some, work)

    # each posting list links to its document with the fewest shingles of its own
    centres = work.cut(postings.groupBy("h").agg(F.min(F.struct("own", "id", "n")).alias("c"), F.count("*").alias("m")).filter("m > 1").select("h", "c.id", "c.n"), "centres")
    star = postings.alias("p").join(centres.alias("c"), "h").filter(f"p.id <> c.id AND {den} * least(p.n, c.n) >= {num} * greatest(p.n, c.n)")
    pairs = work.cut(star.selectExpr("p.id AS a", "c.id AS b").distinct(), "pairs")
    links = work.cut(verified(pairs, sets, num, den), "links")
    comps = components(links, work, "near")

    # what is left: pairs across components
    placed = work.cut(postings.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id")), "placed")
    mixed = work.cut(placed.groupBy("h").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x < y").select("h"), "mixed")
    # a shingle that one component alone holds cannot match across: at counts a document's others before a position. Two
    # documents that share several close together meet at the first of these alone
    w = Window.partitionBy("id").orderBy("pos")
    at = F.row_number().over(w) - 1
    beside = {"before": F.collect_list("h").over(w.rowsBetween(-NEAR, -1)), "after": F.collect_list("h").over(w.rowsBetween(1, NEAR))}
    # sizes that may be similar stand in the same band or the next
    band = F.floor(F.log("n") / F.lit(math.log(den / num)) if num < den else F.col("n")).cast("int")
    left = F.count("*").over(Window.partitionBy("id"))
    rest = work.cut(placed.join(mixed, "h").withColumns({"at": at, "left": left, "band": band} | beside), "rest")
    need = f"ceil({num} * (p.n + q.n) / {num + den})"
    reach = "least(p.at, q.at) + least(p.n - p.pos, q.n - q.pos)"
    # what both prefixes can still share, and beyond the shorter reaching prefix no more than is left of that document
    open_ = "least(p.at, q.at) + least(p.left - p.at, q.left - q.at)"
    beyond = f"greatest(ceil({num} * p.n / {den}) - p.l, ceil({num} * q.n / {den}) - q.l)"
    size = f"{den} * least(p.n, q.n) >= {num} * greatest(p.n, q.n) AND least(p.l, q.l) <= least(p.left, q.left)"
    near = rest.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    across = rest.alias("p").join(near.alias("q"), F.expr(f"p.h = q.h AND p.band = q.band AND p.id < q.id AND p.comp <> q.comp AND {size} AND {reach} >= {need} AND {open_} + {beyond} >= {need} AND NOT arrays_overlap(p.before, q.before)"))
    # a pair shares as many shingles as the shorter of its prefixes asks for, so both must have that many left
    # a meeting with more shared shingles near stands for as many as any l asks for: they are not all looked at
    shared = F.when(F.arrays_overlap("p.after", "q.after"), MOST_MATCHES).otherwise(1)
    met = across.groupBy(F.col("p.id").alias("a"), F.col("q.id").alias("b")).agg(F.sum(shared).alias("m"), F.min(F.least("p.l", "q.l")).alias("l"))
    more = work.cut(met.filter("m >= l").select("a", "b"), "more")
    late = work.cut(verified(more, sets, num, den), "late")
    if not late.isEmpty():
        of_a, of_b = comps.selectExpr("id AS a", "comp AS ca"), comps.selectExpr("id AS b", "comp AS cb")
        across = late.join(of_a, "a", "left").join(of_b, "b", "left").selectExpr("coalesce(ca, a) AS a", "coalesce(cb, b) AS b").distinct()
        joined = components(work.cut(across, "across"), work, "late")
        own = comps.union(late.selectExpr("a AS id", "a AS comp")).union(late.selectExpr("b AS id", "b AS comp")).groupBy("id").agg(F.min("comp").alias("comp"))
        up = joined.selectExpr("id AS comp", "comp AS least")
        comps = own.join(up, "comp", "left").select("id", F.coalesce("least", "comp").alias("comp"))
    known = work.cut(lead.join(comps, lead["lead"] == comps["id"], "left").select("sig", F.coalesce("comp", "lead").alias("comp")), "known")
    work.drop("possible", "chosen", "sets", "postings", "centres", "pairs", "links", "placed", "mixed", "rest", "more", "late", "lead")
    out = light.join(known, "sig", "left")
    return out.select("id", "n", F.when(F.col("n") > 0, F.col("comp")).otherwise(F.col("id")).alias("comp"))
