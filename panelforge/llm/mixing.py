"""Mixing sources to target weights by iterative proportional fitting.

The tokens of each (source, language, topic) cell are raked until the kept tokens meet the target share of every source,
language and topic: a document is kept with its cell's probability, and the probabilities are what is raked, with the
bound of one inside. A category's factor is found exactly, by water-filling: cells that the factor lifts to the bound stay
there, and the others share what is left. So the sample is expected to have the wanted margins, not only the weights.

What cannot be had is not given silently. Where no targets are named, shares are tempered towards equal parts as far as
the budget allows (power 1/2 at most). Named targets keep their shares, and the budget is lowered to what they allow.
mixture returns the targets, what the sample is expected to hold, and whether that meets them: where categories only occur
together, no probabilities may.

Spark counts, joins and filters the documents; the texts are read once, and what follows from them is written beside the
row. What comes to the driver is the table of cells that occur, every category of every dimension among them. It must
have at most MOST_CELLS rows, else ValueError: nothing is folded away. It is broadcast back only if it is small.

A document's tokens are those of a byte-level vocabulary of the tokenizers library. Its topic is the kind its form tells
(tabular, linked, list-like, or prose by length), unless the caller names a column that has it.

Defined results: null and empty texts have no tokens and share their cell's fate, and a cell without tokens is kept;
null sources, languages and topics are the category OTHER; repeated rows are drawn alike (the draw is a seeded hash of
id and text, so a repeated task draws the same); targets for categories without tokens are left out and the others made
to sum to one; categories without a target, where others have one, get none; extra columns pass through, those with the
names of outputs are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import Work
from .byte_level import byte_level
from .word_pieces import shared

#: Rows of the table of cells at most, and up to which it is broadcast; the name of the category of nulls.
MOST_CELLS, BROADCAST_CELLS, OTHER = 1 << 20, 10_000, "__other"
DIMENSIONS = ("source", "lang", "topic")
_OUT = ("topic", "n_tokens", "weight", "probability", "kept")


def topic(text: str) -> str:
    """A document's kind by its form: tabular, linked, list-like, or prose by length."""
    if " | " in text:
        return "tabular"
    if "http" in text or "@" in text:
        return "linked"
    if len(text) < 40 * (text.count("\n") + 1):
        return "list"
    return "short" if len(text) < 1000 else "middle" if len(text) < 4000 else "long"


def _reader(vocabulary):
    """Topic and tokens of each text; vocabulary: the file, broadcast."""

    @F.arrow_udf(T.StructType().add("topic", "string").add("n_tokens", "long"))
    def read(texts: pa.Array) -> pa.Array:
        own, kinds, counts = byte_level(vocabulary.value, True), [], []
        for x in texts:
            text = x.as_py() or ""
            kinds.append(topic(text))
            counts.append(len(own.ids(text)))
        return pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(counts, pa.int64())], ["topic", "n_tokens"])

    return read


def tempered(shares: dict[str, float], power: float = 0.5) -> dict[str, float]:
    """Targets between the shares (power 1) and equal parts (power 0)."""
    up = {k: v**power for k, v in shares.items() if v > 0}
    total = sum(up.values())
    return {k: v / total for k, v in up.items()}


def _filled(z: np.ndarray, most: np.ndarray, own: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Each category's factor a such that its cells' min(most, a z) sum to what it wants: infinite where all of most is
    too little. own: each cell's category."""
    factor = np.full(len(want), np.inf)
    held = np.flatnonzero(z > 0)
    order = held[np.lexsort(((most[held] / z[held]), own[held]))]
    begin = np.searchsorted(own[order], np.arange(len(want) + 1))
    for k, (s, e) in enumerate(zip(begin[:-1], begin[1:])):
        i = order[s:e]
        before = np.append(0.0, np.cumsum(most[i])[:-1]) if e > s else most[i]  # of the cells filled first
        after = np.cumsum(z[i][::-1])[::-1]  # of this one and the rest, below their bounds
        a = (want[k] - before) / after
        ok = np.flatnonzero(a * z[i] <= most[i])
        if want[k] <= 0:
            factor[k] = 0.0
        elif len(ok):
            factor[k] = max(a[ok[0]], 0.0)
    return factor


def rake(tokens: np.ndarray, of: list[np.ndarray], targets: list[np.ndarray], budget: float | None = None, rounds: int = 2000, close: float = 1e-9) -> tuple[np.ndarray, float]:
    """Probabilities of cells, none above one, such that the kept tokens' margins are the targets of the budget (None: of
    as little that no bound matters), and how far off the furthest share still is. of: for each dimension the number of
    each cell's category; targets: for each dimension the categories' shares, which sum to one."""
    total = max(tokens.sum(), 1e-300)
    budget = total * 1e-9 if budget is None else budget
    y, off, before = tokens * (budget / total), np.inf, np.inf
    for i in range(rounds):
        for own, want in zip(of, targets):
            factor = _filled(y, tokens, own, want * budget)
            y = y * np.clip(factor, 0, 1e30)[own]
            y = np.where(y > 0, np.clip(y, tokens * 1e-40, tokens * 1e40), 0.0)
        kept = np.minimum(tokens, y)
        off = max(float(np.abs(np.bincount(own, weights=kept, minlength=len(want)) / max(budget, 1e-300) - want).max(initial=0)) for own, want in zip(of, targets))
        if off < close:
            break
        if i % 100 == 99:  # it does not come nearer any more
            if off > 0.9 * before:
                break
            before = off
    return np.divide(np.minimum(tokens, y), tokens, out=np.zeros_like(y), where=tokens > 0), off


#: How far from its target a category's share of the kept tokens may be.
MET = 1e-6


def allowed(tokens: np.ndarray, of: list[np.ndarray], targets, budget: float, named: bool) -> tuple[list[np.ndarray], float, np.ndarray, float]:
    """(targets, budget, probabilities, off): what comes nearest to what is asked. targets: from a power between 1 (the
    shares as they are) and 0 (equal parts) to each dimension's targets; named: these are not the power's."""
    wanted = targets(0.5)
    chance, off = rake(tokens, of, wanted, budget)
    if off <= MET:
        return wanted, budget, chance, off
    if named:
        free, off = rake(tokens, of, wanted)
        if off > MET:  # no budget meets them
            chance, off = rake(tokens, of, wanted, budget)
            return wanted, budget, chance, off
        low, high, best = 0.0, budget, None
        for _ in range(30):
            mid = (low + high) / 2
            chance, off = rake(tokens, of, wanted, mid)
            low, high, best = (mid, high, (mid, chance, off)) if off <= MET else (low, mid, best)
        if best is None:
            best = (tokens.sum() * 1e-9, free, off)
        return wanted, *best
    low, high, best = 0.5, 1.0, None
    for _ in range(20):
        mid = (low + high) / 2
        tried = targets(mid)
        chance, off = rake(tokens, of, tried, budget)
        low, high, best = (low, mid, (tried, chance, off)) if off <= MET else (mid, high, best)
    if best is None:
        best = (targets(1.0), np.where(tokens > 0, budget / max(tokens.sum(), 1e-300), 0.0), 0.0)
    return best[0], budget, best[1], best[2]


_REPORT = "dimension string, category string, available double, target double, expected double, met boolean"


def mixture(df: DataFrame, vocabulary: str, targets: dict[str, dict[str, float]] | None = None, keep: float = 0.7, seed: int = 11, text: str = "text", id_col: str = "doc_id", topic_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, report): df with topic, n_tokens, weight, probability and kept, and for each category its share of all
    tokens, its target, the share of the kept tokens that is expected, and whether that meets the target. targets: for
    each dimension the wanted share of each category; a dimension without targets gets tempered shares. keep: the share
    of all tokens that is the budget. weight: the probability over the mean one."""
    spark, work = df.sparkSession, Work(df.sparkSession)
    file = shared(spark, vocabulary)
    own = [c for c in df.columns if c not in _OUT]
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), id_col, text), 11) / F.lit(float(2**53))
    read = _reader(file)
    made = df.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.col(topic_col or text).alias("given"), read(F.col(text)).alias("read"), draw.alias("draw"))
    made = made.select("row", (F.col("given") if topic_col else F.col("read.topic")).alias("topic"), "read.n_tokens", "draw")
    made = work.cut(made, "read")
    at = {d: F.coalesce(F.col("topic" if d == "topic" else f"row.{d}").cast("string"), F.lit(OTHER)) for d in DIMENSIONS}
    cells = made.groupBy(*[c.alias(d) for d, c in at.items()]).agg(F.sum("n_tokens").alias("n"))
    rows = cells.limit(MOST_CELLS + 1).toArrow().sort_by([(d, "ascending") for d in DIMENSIONS])
    if rows.num_rows > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} cells of source, language and topic")
    tokens, of, names = rows["n"].to_numpy().astype(float), [], []
    for d in DIMENSIONS:
        coded = rows[d].combine_chunks().dictionary_encode()
        names.append(coded.dictionary.to_pylist())
        of.append(coded.indices.to_numpy())
    have = [np.bincount(o, weights=tokens, minlength=len(k)) for o, k in zip(of, names)]

    def wanted(power: float) -> list[np.ndarray]:
        out = []
        for d, k, h in zip(DIMENSIONS, names, have):
            given = (targets or {}).get(d) or tempered(dict(zip(k, h)), power)
            want = np.array([given.get(x, 0.0) if n > 0 else 0.0 for x, n in zip(k, h)])
            out.append(want / max(want.sum(), 1e-300))
        return out

    goal, budget, chance, _ = allowed(tokens, of, wanted, keep * tokens.sum(), bool(targets))
    expected = [np.bincount(o, weights=tokens * chance, minlength=len(k)) for o, k in zip(of, names)]
    report = [(d, x, float(n / max(tokens.sum(), 1e-300)), float(t), float(e / max((tokens * chance).sum(), 1e-300))) for d, k, h, g, es in zip(DIMENSIONS, names, have, goal, expected) for x, n, t, e in zip(k, h, g, es)]
    mean = (tokens * chance).sum() / max(tokens.sum(), 1e-300)
    chance = np.where(tokens > 0, chance, 1.0)
    table = pa.table([*[rows[d] for d in DIMENSIONS], pa.array(chance / max(mean, 1e-300)), pa.array(chance)], [*[f"__{d}" for d in DIMENSIONS], "weight", "probability"])
    small = spark.createDataFrame(table, ", ".join(f"__{d} string" for d in DIMENSIONS) + ", weight double, probability double")
    small = F.broadcast(small) if rows.num_rows <= BROADCAST_CELLS else small
    same = [at[d] == F.col(f"__{d}") for d in DIMENSIONS]
    joined = made.join(small, same[0] & same[1] & same[2], "left")
    out = joined.select(*[F.col(f"row.`{c}`") for c in own], "topic", "n_tokens", "weight", "probability", (F.col("draw") < F.col("probability")).alias("kept"))
    return out, spark.createDataFrame([(*x, abs(x[3] - x[4]) <= 10 * MET) for x in report], _REPORT)


def mixed(df: DataFrame, vocabulary: str, targets: dict[str, dict[str, float]] | None = None, keep: float = 0.7, **more) -> DataFrame:
    """The documents of mixture."""
    return mixture(df, vocabulary, targets, keep, **more)[0]
