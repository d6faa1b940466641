"""Embeddings of assets from how their returns move together, and the exact nearest of them.

correlation_embedding is a truncated singular value decomposition of the correlation matrix, which is never made: the
standardised returns stand in tiles of tickers by dates, and a block of a few vectors goes back and forth between the two
sides. nearest finds the most similar vectors without meeting all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import require_columns
from ..functions.ordered import numbered, partitions
from ..session import Work, ship

#: Tickers and dates of a tile; vectors of a block of nearest; blocks that are met in one go; blocks that meet them together.
TICKERS, DATES, BLOCK, CHUNK, TEAM = 512, 512, 256, 64, 32
#: Vectors that are iterated beside the wanted ones, to make these settle sooner; when they have settled; rounds at most.
BESIDE, CLOSE, ROUNDS = 16, 1e-13, 500
_TILE = "tb int, db int, z binary"


def _matrix(data: bytes, columns: int) -> np.ndarray:
    return np.frombuffer(data).reshape(-1, columns)


def _summed(df: DataFrame, key: str, name: str) -> DataFrame:
    """Matrices of doubles of the same key, added."""

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x) for x in t["m"].to_pylist())
        return pa.table({key: t[key].slice(0, 1), name: pa.array([total.tobytes()], pa.binary())})

    return df.groupBy(key).applyInArrow(add, f"{key} int, {name} binary")


def _products(tiles: DataFrame, key: str, flip: bool, l: int) -> DataFrame:  # noqa: E741
    """Partial products of tiles with the blocks joined to them (column q), added up inside a task by key before they are
    dealt out: a task holds as many sums as it meets keys, which come in order."""

    def times(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        row = lambda k, m: pa.record_batch([pa.array([k], pa.int32()), pa.array([m.tobytes()], pa.binary())], [key, "m"])
        for b in batches:
            for k, width, z, q in zip(*(b.column(i).to_pylist() for i in range(4))):
                z = _matrix(z, width)
                m = (z.T if flip else z) @ _matrix(q, l)
                if k != at:
                    if held is not None:
                        yield row(at, held)
                    at, held = k, m
                else:
                    held = held + m
        if held is not None:
            yield row(at, held)

    return tiles.select(key, "width", "z", "q").sortWithinPartitions(key).mapInArrow(times, f"{key} int, m binary")


def tiles(returns: DataFrame, least_tickers: int = 3, least_dates: int = 30) -> tuple[DataFrame, DataFrame, int, int] | None:
    """(tiles, tickers with their places, tickers, dates) of the returns (date, ticker, ret), each ticker's standardised
    over the dates on which all tickers have one; None if there is too little of it. A tile's z is a matrix, tickers by
    rows, of which width is the number of dates."""
    require_columns(returns, "date", "ticker", "ret")
    spark, work = returns.sparkSession, Work(returns.sparkSession)
    known = work.cut(returns.filter(F.col("ret").isNotNull() & ~F.isnan("ret")).groupBy("ticker", "date").agg(F.first("ret").alias("ret")), "known")
    tickers = known.select("ticker").distinct()
    n = tickers.count()
    dates = known.groupBy("date").count().filter(F.col("count") == n).select("date")
    moving = known.join(dates, "date").groupBy("ticker").agg(F.avg("ret").alias("mean"), F.stddev_pop("ret").alias("sd"), F.count("*").alias("t"))
    placed = work.cut(numbered(moving, ["ticker"], "i"), "tickers")
    days = work.cut(numbered(dates, ["date"], "j"), "dates")
    t = days.count()
    if n < least_tickers or t < least_dates:
        return None
    # a ticker that never moves correlates with nothing
    z = F.when(F.col("sd") > 0, (F.col("ret") - F.col("mean")) / F.col("sd")).otherwise(0.0) / float(np.sqrt(t))
    cells = known.join(placed, "ticker").join(days, "date").select("i", "j", z.alias("z"))

    def tile(x: pa.Table) -> pa.Table:
        tb, db = x["tb"][0].as_py(), x["db"][0].as_py()
        shape = min(TICKERS, n - tb * TICKERS), min(DATES, t - db * DATES)
        m = np.zeros(shape)
        m[x["i"].to_numpy() % TICKERS, x["j"].to_numpy() % DATES] = x["z"].to_numpy()
        return pa.table({"tb": pa.array([tb], pa.int32()), "db": pa.array([db], pa.int32()), "z": pa.array([m.tobytes()], pa.binary())})

    ship(spark)
    keyed = cells.withColumns({"tb": F.expr(f"cast(i div {TICKERS} as int)"), "db": F.expr(f"cast(j div {DATES} as int)")})
    made = work.cut(keyed.groupBy("tb", "db").applyInArrow(tile, _TILE), "tiles")
    width = F.least(F.lit(DATES), F.lit(t) - F.col("db") * DATES).cast("int")
    return made.withColumn("width", width), placed, n, t


def correlation_embedding(returns: DataFrame, dim: int = 16, seed: int = 42, prefix: str = "cross_asset_") -> tuple[DataFrame, DataFrame]:
    """(embeddings, report) of returns (date, ticker, ret): (ticker, cross_asset_0 …), whose inner products come nearest to
    the correlations, and one row (n_tickers, embedding_dim, n_dates, reconstruction_mse).

    With Z the standardised returns, tickers by dates, the correlation matrix is Z Z'. Blocks of vectors with tickers in
    the rows are multiplied by Z' and by Z, added over the tiles, and made orthogonal by the Cholesky factor of their
    Gram matrix, until the values settle. The driver sees matrices as wide as the block, never as long as the tickers. A
    vector's sign is that of its largest component. Only dates on which every ticker has a return count; with fewer than
    3 tickers or 30 such dates both results are empty. A ticker that never moves has correlation 0 with all others (and
    itself)."""
    spark, work = returns.sparkSession, Work(returns.sparkSession)
    found = tiles(returns)
    if found is None:
        kinds = "n_tickers long, embedding_dim int, n_dates long, reconstruction_mse double"
        names = ", ".join(f"{prefix}{i} double" for i in range(dim))
        return spark.createDataFrame([], f"ticker {dict(returns.dtypes)['ticker']}, {names}"), spark.createDataFrame([], kinds)
    z, placed, n, t = found
    k = min(dim, n - 1)
    l = min(n, k + BESIDE)  # noqa: E741

    def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [np.random.default_rng([seed, tb]).standard_normal((min(TICKERS, n - tb * TICKERS), l)).tobytes() for tb in b.column(0).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(own, pa.binary())], ["tb", "q"])

    def orthogonal(blocks: DataFrame, by: np.ndarray) -> DataFrame:
        def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.record_batch([b.column(0), pa.array([(_matrix(x, l) @ by).tobytes() for x in b.column(1).to_pylist()], pa.binary())], ["tb", "q"])

        return blocks.mapInArrow(turn, "tb int, q binary")

    def grams(blocks: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Y'Y and Q'Y of all blocks (tb, q, y), added: two matrices as wide as the block for each task."""

        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yy, qy = np.zeros((2, l, l))
            for b in batches:
                for q, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    q, y = _matrix(q, l), _matrix(y, l)
                    yy, qy = yy + y.T @ y, qy + q.T @ y
            yield pa.record_batch([pa.array([0], pa.int32()), pa.array([np.stack([yy, qy]).tobytes()], pa.binary())], ["one", "m"])

        parts = blocks.select("q", "y").mapInArrow(own, "one int, m binary")
        # by ranges of tasks first, so that no one adds them all up
        some = _summed(parts.withColumn("one", F.spark_partition_id() % 64), "one", "m")
        total = sum(np.frombuffer(r.m).reshape(2, l, l) for r in some.collect())
        return total[0], total[1]

    def settled(y: np.ndarray) -> np.ndarray:
        """What makes a block of this Gram matrix orthonormal, directions without length left out as zeros."""
        value, vector = np.linalg.eigh((y + y.T) / 2)
        scale = np.where(value > max(value.max(), 1e-300) * 1e-28, 1 / np.sqrt(np.maximum(value, 1e-300)), 0.0)
        return vector * scale

    q = work.cut(z.select("tb").distinct().mapInArrow(begun, "tb int, q binary"), "q0")
    values = None
    for i in range(ROUNDS):
        # twice where the block is far from orthogonal: once more costs no pass over the tiles
        w = _summed(_products(z.join(q, "tb"), "db", True, l), "db", "q")
        y = _summed(_products(z.join(w, "db"), "tb", False, l), "tb", "y")
        both = work.cut(q.join(y, "tb").select("tb", "q", "y"), f"both{i}")
        yy, qy = grams(both)
        if i:
            now = np.sort(np.linalg.eigvalsh((qy + qy.T) / 2))[::-1][:k]
            if values is not None and np.abs(now - values).max() <= CLOSE * max(now[0], 1e-300):
                break
            values = now
        q = work.cut(orthogonal(both.select("tb", F.col("y").alias("q")), settled(yy)), f"q{i + 1}")
        # once more: what one step of a badly scaled block leaves
        again, _ = grams(q.withColumn("y", F.col("q")))
        q = orthogonal(q, settled(again))
    else:
        raise ValueError(f"the vectors have not settled after {ROUNDS} rounds")
    value, vector = np.linalg.eigh((qy + qy.T) / 2)
    order = np.argsort(-value)[:k]
    by = np.zeros((l, l))
    by[:, :k] = vector[:, order] * np.sqrt(np.maximum(value[order], 0))
    rows = orthogonal(both.select("tb", "q"), by)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for tb, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                m = _matrix(x, l)[:, :k]
                yield pa.record_batch([pa.array(np.arange(len(m)) + tb * TICKERS), *[pa.array(np.ascontiguousarray(c)) for c in m.T]], ["i", *[f"v{j}" for j in range(k)]])

    flat = work.cut(rows.mapInArrow(each, "i long, " + ", ".join(f"v{j} double" for j in range(k))), "vectors")
    # the sign of the largest component; among equals, the first ticker's
    largest = flat.agg(*[F.max_by(F.signum(f"v{j}"), F.struct(F.round(F.abs(f"v{j}"), 9), -F.col("i"))).alias(f"s{j}") for j in range(k)]).first()
    turned = flat.join(placed.select("i", "ticker"), "i").select("ticker", *[(F.col(f"v{j}") * (largest[j] or 1.0)).alias(f"{prefix}{j}") for j in range(k)])
    squares = _squares(z)
    mse = (squares - float((value[order] ** 2).sum())) / n**2
    report = spark.createDataFrame([(n, k, t, max(mse, 0.0))], "n_tickers long, embedding_dim int, n_dates long, reconstruction_mse double")
    return turned, report


def _squares(z: DataFrame) -> float:
    """The sum of the squared correlations: that of Z'Z, whose sides are dates, by tiles."""

    def times(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, c, w, v, x, y in zip(*(b.column(i).to_pylist() for i in range(6))):
                m = _matrix(x, w).T @ _matrix(y, v)
                yield pa.record_batch([pa.array([a << 16 | c], pa.int32()), pa.array([m.tobytes()], pa.binary())], ["at", "m"])

    other = z.select("tb", F.col("db").alias("of"), F.col("width").alias("wide"), F.col("z").alias("y"))
    both = z.join(other, "tb").filter("db <= of").select("db", "of", "width", "wide", "z", "y")
    summed = _summed(both.mapInArrow(times, "at int, m binary"), "at", "m")

    def square(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [float((np.frombuffer(m) ** 2).sum()) * (1 if at >> 16 == at & 0xFFFF else 2) for at, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.record_batch([pa.array(s, pa.float64())], ["s"])

    return float(summed.mapInArrow(square, "s double").agg(F.sum("s").alias("s")).first().s)


def _top(best: np.ndarray, ids: np.ndarray, more: np.ndarray, own: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n largest of each row's two lists, ties to the smaller id."""
    values, names = np.concatenate([best, more], 1), np.concatenate([ids, own], 1)
    order = np.lexsort((names, -values))[:, :n]
    return np.take_along_axis(values, order, 1), np.take_along_axis(names, order, 1)


def nearest(vectors: DataFrame, n: int = 10, by: str = "label", id_col: str = "id", vector: str = "v", places: int = 6, log: list | None = None) -> DataFrame:
    """(id, other, similarity, rank): for each vector the n others of its group with the highest cosine similarity,
    rounded, ties to the smaller id. Exact, and pairs of blocks that cannot matter are never met.

    Unit vectors of a group are sorted by their distance to a pivot (the vector farthest from their mean) and cut into
    blocks; two vectors are at least as far apart as their distances to the pivot differ. Each block first meets itself and its
    neighbours, which gives all its rows an n-th best so far; the blocks that can still hold something better than the
    least of these are a range of the order, found by a window over the blocks' bounds. They are met as products of
    matrices, nearest first, in chunks, by a team of neighbouring blocks at once, to which each block is sent once for all
    of them; a chunk's rows go on with the bests so far and drop out where the bound says so. No group is ever in one task. log: gets the numbers of pairs of blocks that there are and that were met at all.

    Ids are longs and unique; vectors of one group have one length; those without length, with null or non-finite
    components, of a null group or id take no part. Groups of one give no rows."""
    spark, work = vectors.sparkSession, Work(vectors.sparkSession)
    ship(spark)
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(by).alias("g"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    unit = v.filter("id IS NOT NULL AND g IS NOT NULL").filter(finite).withColumn("norm", norm).filter("norm > 0").select("id", "g", F.transform("v", lambda x: x / F.col("norm")).alias("v"))
    unit = work.cut(unit, "unit")
    sums = unit.select("g", F.posexplode("v").alias("i", "x")).groupBy("g", "i").agg(F.avg("x").alias("x"))
    means = sums.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s.x).alias("p"))
    apart = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    pivots = unit.join(means, "g").groupBy("g").agg(F.max_by("v", F.struct(apart("v", "p"), -F.col("id"))).alias("p"))
    far = apart("v", "p")
    placed = numbered(unit.join(pivots, "g").select("id", "g", far.alias("d"), "v"), ["g", "d", "id"], "n")
    first = placed.groupBy("g").agg(F.min("n").alias("first"))
    cut = work.cut(placed.join(first, "g").withColumn("block", F.expr(f"(n - first) div {BLOCK}")).drop("first"), "placed")

    def pack(x: pa.Table) -> pa.Table:
        order = np.argsort(x["n"].to_numpy())
        m = np.array(x["v"].to_pylist())[order]
        d = x["d"].to_numpy()
        return pa.table({"g": x["g"].slice(0, 1), "block": x["block"].slice(0, 1), "lo": [float(d.min())], "hi": [float(d.max())], "ids": pa.array([x["id"].to_numpy()[order].astype(np.int64).tobytes()], pa.binary()), "m": pa.array([m.tobytes()], pa.binary())})

    g_kind = dict(cut.dtypes)["g"]
    blocks = work.cut(cut.groupBy("g", "block").applyInArrow(pack, f"g {g_kind}, block long, lo double, hi double, ids binary, m binary"), "blocks")
    scale = 10.0**places
    slack = 1 / scale + 1e-12  # rounding may lift what is a little less

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (g, team, chunk, gap, block, lo, hi, from, to, beside, ids, m, best, names): a team's own blocks (gap -1), each with
        the blocks it asks for, and then the others that come by, in order. Yields each own block's bests, and how many
        blocks it met."""
        at, team = None, []

        def done(o):
            cols = [pa.array([at[0]], kind), pa.array([o["block"]], pa.int64()), *[pa.array([o[c].tobytes()], pa.binary()) for c in ("ids", "best", "names")], pa.array([float(o["best"][:, -1].min())]), pa.array([o["met"]])]
            return pa.record_batch(cols, ["g", "block", "ids", "best", "names", "least", "met"])

        for b in batches:
            kind = b.schema.field(0).type
            for g, number, chunk, gap, block, lo, hi, from_, to, beside, i, m, s, f in zip(*(b.column(c).to_pylist() for c in range(14))):
                ids = np.frombuffer(i, np.int64)
                m = np.frombuffer(m).reshape(len(ids), -1)
                if gap < 0:
                    if (g, number, chunk) != at:
                        for o in team:
                            yield done(o)
                        at, team = (g, number, chunk), []
                    best = np.frombuffer(s).reshape(len(ids), n) if s else np.full((len(ids), n), -np.inf)
                    names = np.frombuffer(f, np.int64).reshape(len(ids), n) if f else np.full((len(ids), n), np.iinfo(np.int64).max)
                    team.append({"block": block, "lo": lo, "hi": hi, "from": from_, "to": to, "beside": beside, "ids": ids, "m": m, "best": best, "names": names, "met": 0})
                    continue
                for o in team:
                    if not o["from"] <= block <= o["to"] or abs(block - o["block"]) <= 1 and not o["beside"]:
                        continue
                    apart = max(0.0, o["lo"] - hi, lo - o["hi"])
                    if 1 - apart * apart / 2 < o["best"][:, -1].min() - slack:
                        continue
                    o["met"] += 1
                    sim = o["m"] @ m.T
                    sim = np.copysign(np.floor(np.abs(sim) * scale + 0.5), sim) / scale + 0.0
                    sim[o["ids"][:, None] == ids] = -np.inf
                    o["best"], o["names"] = _top(o["best"], o["names"], sim, np.broadcast_to(ids, sim.shape), n)
        for o in team:
            yield done(o)

    out = f"g {g_kind}, block long, ids binary, best binary, names binary, least double, met long"
    none = F.lit(None).cast("binary")

    def rounds(asks: DataFrame, rows: DataFrame, beside: bool) -> DataFrame:
        """asks: (g, block, team, from, to, lo, hi), a block and the range it asks for, its neighbours and itself too if
        beside; rows: (g, block, ids, m, best, names) of the blocks that ask."""
        chunk = lambda c: F.lit(0).cast("long") if beside else F.expr(f"{c} div {CHUNK}")
        own = asks.withColumn("chunk", F.explode(F.sequence(chunk("from"), chunk("to"))))
        who = own.join(rows, ["g", "block"]).select("g", "team", "chunk", F.lit(-1.0).alias("gap"), "block", "lo", "hi", "from", "to", F.lit(beside).alias("beside"), "ids", "m", "best", "names")
        # a team's others, each once, by how near they come to any of it
        teams = asks.groupBy("g", "team").agg(F.min("from").alias("from"), F.max("to").alias("to"), F.min("lo").alias("tlo"), F.max("hi").alias("thi"))
        of = teams.select("g", "team", "tlo", "thi", F.explode(F.sequence("from", "to")).alias("block")).withColumn("chunk", chunk("block"))
        of = of.join(own.select("g", "team", "chunk").distinct(), ["g", "team", "chunk"])
        gap = F.greatest(F.lit(0.0), F.col("tlo") - F.col("hi"), F.col("lo") - F.col("thi"))
        blank = F.lit(None).cast("long")
        whom = of.join(blocks, ["g", "block"]).select("g", "team", "chunk", gap.alias("gap"), "block", "lo", "hi", blank.alias("from"), blank.alias("to"), F.lit(beside).alias("beside"), "ids", "m", none.alias("best"), none.alias("names"))
        dealt = who.union(whom).repartition(partitions(vectors), "g", "team", "chunk").sortWithinPartitions("g", "team", "chunk", "gap")
        return dealt.mapInArrow(meet, out)

    count = blocks.groupBy("g").agg(F.max("block").alias("most"))
    near = blocks.join(count, "g").select("g", "block", F.expr(f"block div {TEAM}").alias("team"), F.expr("greatest(block - 1, 0)").alias("from"), F.expr("least(block + 1, most)").alias("to"), "lo", "hi")
    begun = work.cut(rounds(near, blocks.select("g", "block", "ids", "m", none.alias("best"), none.alias("names")), True), "begun")
    # blocks that can hold a better one: those whose distances come within reach of the block's own
    reach = F.when(F.col("least") == float("-inf"), 4.0).otherwise(F.sqrt(F.greatest(2 * (1 - F.col("least") + slack), F.lit(0.0))))
    bounds = work.cut(blocks.select("g", "block", "lo", "hi").join(begun.select("g", "block", "least"), ["g", "block"]).withColumn("reach", reach), "bounds")
    marks = bounds.select("g", F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.col("block").alias("block"), at.alias("at")) for kind, at in ((0, F.col("hi")), (2, F.col("lo")), (1, F.col("lo") - F.col("reach") - 1e-9), (3, F.col("hi") + F.col("reach") + 1e-9))])).alias("m")).select("g", "m.*")
    # kind 1: how many blocks end before the reach begins; kind 3: how many begin up to where it ends
    w = Window.partitionBy("g").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    ranked = marks.withColumns({"ended": F.sum((F.col("kind") == 0).cast("long")).over(w), "begun": F.sum((F.col("kind") == 2).cast("long")).over(w)})
    lows, highs = ranked.filter("kind = 1").select("g", "block", F.col("ended").alias("from")), ranked.filter("kind = 3").select("g", "block", (F.col("begun") - 1).alias("to"))
    asks = bounds.join(lows, ["g", "block"]).join(highs, ["g", "block"]).filter("from <= to AND (from < block - 1 OR to > block + 1)").select("g", "block", F.expr(f"block div {TEAM}").alias("team"), "from", "to", "lo", "hi")
    rows = blocks.select("g", "block", "ids", "m").join(begun.select("g", "block", "best", "names"), ["g", "block"])
    rest = work.cut(rounds(asks, rows, False), "rest")
    if log is not None:
        log.append((count.agg(F.sum((F.col("most") + 1) * (F.col("most") + 1))).first()[0] or 0, begun.union(rest).agg(F.sum("met")).first()[0] or 0))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, best, names in zip(*(b.column(c).to_pylist() for c in range(3))):
                own, s, f = np.repeat(np.frombuffer(ids, np.int64), n), np.frombuffer(best), np.frombuffer(names, np.int64)
                i = np.isfinite(s)
                yield pa.record_batch([pa.array(own[i]), pa.array(f[i]), pa.array(s[i])], ["id", "other", "similarity"])

    # a block's chunks each end with the bests of what they met
    found = begun.union(rest).select("ids", "best", "names").mapInArrow(spread, "id long, other long, similarity double").distinct()
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "other"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= n)


def similar_assets(embeddings: DataFrame, n: int = 10) -> DataFrame:
    """(ticker, other, similarity, rank): for each ticker the n whose embeddings are most similar by cosine, ties to the
    smaller ticker."""
    work, values = Work(embeddings.sparkSession), [c for c in embeddings.columns if c != "ticker"]
    placed = work.cut(numbered(embeddings, ["ticker"], "i"), "placed")
    found = nearest(placed.select("i", F.lit(0).alias("g"), F.array(*values).alias("v")), n, "g", "i")
    a, b = placed.select(F.col("i").alias("id"), "ticker"), placed.select(F.col("i").alias("other"), F.col("ticker").alias("name"))
    return found.join(a, "id").join(b, "other").select("ticker", F.col("name").alias("other"), "similarity", "rank")
