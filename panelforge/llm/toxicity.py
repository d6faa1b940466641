"""Toxicity by noisy-channel deobfuscation.

Every token that is no known word and may be read in more than one way (letters beside look-alike signs or letters of
other scripts, letters told apart by blanks or dots, letters doubled or repeated) becomes a lattice of what each sign may
stand for: a letter, nothing, or the end of a word. The path that a character trigram model of the whole corpus likes
best, less the cost of the changes, is the restored token (Viterbi over pairs of letters, in time linear in the token, so
tokens of any length are restored). Before that, texts beyond ASCII are put into compatibility form, and signs that do not
show (format characters, variation selectors, marks piled on letters) are taken out. The words of the text as it stands
and as it is restored, and their first letters, are weighed by a lexicon learned from labels, and the two strongest
weights of a document give its score by logistic regression.

Decoded words that are, but for doubled letters, or joined with their neighbours, a word of the lexicon become that word:
letters alone do not tell how often one was meant, nor where a word of letters told apart ends.

Known words matter where a letter is doubled: those of at least KNOWN documents of the labelled sample are left as they
are. A token all in letters of another script is read as Latin only if that gives a word of the lexicon.

The lexicon is learned from at most 2 * sample labelled documents (sample of each label, by a hash of the id), three
quarters for the weights and the rest for the regression; the shares of the labels come from all labelled rows. It has
no bound of its own: every word of that sample that is toxic often enough is in it. The character counts cover every
document; they are bounded by the alphabet.

Defined results: null and empty texts score as a text without any weighed word; repeated rows score alike; labels
without a document, or null, are left out; a repeated label counts again; without labels of both kinds every score is
their share (or 0 without labels); extra columns pass through, one with the output's name is replaced.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Work, ship

#: Labelled documents of each label that the lexicon is learned from; entries of a worker's cache, and their characters.
SAMPLE, CACHE, CACHED_CHARS = 20_000, 1 << 16, 64
#: Documents of base rate that a word's share of toxic documents is pulled by; the least share of a weighed word.
PULL, LEAST = 10, 0.3
#: Documents of the sample that hold a known word.
KNOWN = 3

#: Letters of the character model; all else is one sign, number 0.
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøùúûüýßœ"
#: What changes cost, in log-likelihood: a sign read as a letter, a sign dropped, a digit dropped, punctuation dropped at
#: the end of a token, a star read as a vowel, two letters read as one, letters told apart that belong together, and the
#: end of a word between them.
READ, DROP, DROP_DIGIT, DROP_LAST, STAR, ONCE, GLUE, BREAK = 1.0, 4.0, 8.0, 0.3, 1.5, 1.0, 0.2, 2.0
#: What a sign may stand for.
LOOKS_LIKE = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "€": "e", "(": "c"}
#: Lower-case letters of other scripts that look like Latin ones (Unicode's confusable letters).
CONFUSABLE = {
    **{"а": "a", "в": "b", "г": "r", "е": "e", "ѕ": "s", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "п": "n"},  # Cyrillic
    **{"р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѵ": "v", "ԁ": "d", "һ": "h", "ӏ": "l", "ԛ": "q", "ԝ": "w", "ь": "b", "ё": "e"},
    **{"α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w"},  # Greek
    **{"ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ɪ": "i", "ʟ": "l", "ʏ": "y", "ʀ": "r", "ɴ": "n", "ʙ": "b", "ʜ": "h", "ᴀ": "a", "ᴄ": "c", "ᴅ": "d", "ᴇ": "e", "ᴋ": "k", "ᴍ": "m", "ᴏ": "o", "ᴘ": "p", "ᴛ": "t", "ᴜ": "u", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z"},  # Latin, other forms
    **{"օ": "o", "ս": "u", "ո": "n", "հ": "h"},  # Armenian
}
_AT = {c: i + 1 for i, c in enumerate(LETTERS)}
_N = len(LETTERS) + 1
_SIGNS = re.escape("".join(LOOKS_LIKE))
_BETWEEN = r".\-_*~'"
_ODD = re.compile(rf"[^\W\d_][{_SIGNS}{_BETWEEN}]+[^\W\d_]|^[{_SIGNS}]+[^\W\d_]|[^\W\d_][{_SIGNS}]+\W*$|([^\W\d_])\1\1").search
_DOUBLED = re.compile(r"([^\W\d_])\1", re.I).search
_OTHERS = "".join(CONFUSABLE) + "".join(c.upper() for c in CONFUSABLE if len(c.upper()) == 1 and not c.upper().isascii())
_OTHER, _ALL_OTHER = re.compile(f"[{_OTHERS}]").search, re.compile(f"[{_OTHERS}\\W\\d_]+").fullmatch
_LATIN = re.compile("[a-zA-Z]").search
_UNSEEN = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\U000e0000-\U000e0fff\u0300-\u036f\u0488\u0489\u20d0-\u20ff]+")
_SPACED = re.compile(r"(?<!\S)[^\W_](?:[ .\-_*~]{1,2}[^\W_]){2,}(?!\w)")
_RUNS = re.compile(r"(.)\1*", re.S)
_WORDS = re.compile(r"[^\W\d_]+").findall


def _single(word: str) -> str:
    """A word with every run of a letter as one."""
    return _RUNS.sub(r"\1", word)


def _forms(word: str) -> tuple[str, ...]:
    """A word and its first letters, if it has at least three."""
    return () if len(word) < 3 else (word,) if len(word) < 5 else (word, word[:4] + "*") if len(word) == 5 else (word, word[:4] + "*", word[:5] + "*")


def shown(text: str) -> str:
    """A text in compatibility form, without signs that do not show."""
    if text.isascii():
        return text
    return _UNSEEN.sub("", unicodedata.normalize("NFKC", text))


def char_counts(df: DataFrame, text: str = "text") -> np.ndarray:
    """Counts of character trigrams, each run of other signs one sign, over all texts."""
    table = np.zeros(0x250, np.int64)
    for c, i in _AT.items():
        table[ord(c)] = i

    def count(batches):
        total = np.zeros(_N**3, np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                if x:
                    c = np.frombuffer(x.lower().encode("utf-32-le"), "<u4")
                    at = np.where(c < len(table), table[np.minimum(c, len(table) - 1)], 0)
                    at = np.r_[0, at[(at > 0) | (np.r_[1, at[:-1]] > 0)], 0]
                    total += np.bincount((at[:-2] * _N + at[1:-1]) * _N + at[2:], minlength=_N**3)
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen), pa.array(total[seen])], ["gram", "n"])

    ship(df.sparkSession)
    found = df.select(text).mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(_N**3)
    for r in found:
        out[r.gram] = r.n
    return out.reshape(_N, _N, _N)


def log_model(counts: np.ndarray) -> np.ndarray:
    """log P(third | first two), interpolated with the shorter contexts."""
    one = (counts.sum((0, 1)) + 1) / (counts.sum() + _N)
    two = counts.sum(0)
    two = (two + 4 * one) / (two.sum(1, keepdims=True) + 4)
    three = (counts + 4 * two[None]) / (counts.sum(2, keepdims=True) + 4)
    return np.log(three).astype(np.float32)


def _steps(c: str, n: int, last: bool) -> list[tuple[str, float]]:
    """What n times the sign c may stand for, and what that costs."""
    if c in _AT:
        return [(c, 0.0)] if n == 1 else [(c * 2, 0.0), (c, ONCE)] if n == 2 else [(c, 0.0), (c * 2, 0.5)]
    if c in CONFUSABLE:
        x = CONFUSABLE[c]
        return [(x, 0.0)] if n == 1 else [(x * 2, 0.0), (x, ONCE)]
    if c in LOOKS_LIKE:
        once = [(x, READ) for x in LOOKS_LIKE[c]]
        return once + [(2 * x, READ) for x, _ in once if n > 1] + [("", DROP_DIGIT if c.isdigit() else DROP_LAST if last and c in "!(" else DROP)]
    if c == " ":
        return [(" ", 0.0)] if n > 1 else [("", GLUE), (" ", BREAK)]
    stars = [(x, STAR) for x in "aeiou"] if c == "*" and n == 1 else []
    return [("", GLUE), (" ", BREAK), *stars]


@dataclass
class Model:
    logs: np.ndarray
    lexicon: dict[str, float] = field(default_factory=dict)
    weights: tuple[float, float, float] = (0.0, 0.0, 0.0)
    known: frozenset[str] | None = None

    def __post_init__(self):
        whole = sorted((w, f) for f, w in self.lexicon.items() if len(f) > 3 and not f.endswith("*"))
        self.starts = {f[:3] for f in self.lexicon}  # of words that are weighed
        self.flat = self.logs.ravel().tolist()  # one number at a time is read faster from a list
        self.single = {_single(f): f for _, f in whole}  # of words alike but for doubled letters, the strongest
        self.kept: dict[str, str] = {}
        self.weighed: dict[str, tuple] = {}

    def __getstate__(self):
        return {"logs": self.logs, "lexicon": self.lexicon, "weights": self.weights, "known": self.known}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def taught(self, lexicon: dict[str, float], known) -> Model:
        """The model with a lexicon and known words."""
        return Model(self.logs, lexicon, self.weights, frozenset(known))

    def decode(self, token: str) -> str:
        """The best path through a token's lattice."""
        states = {(0, 0): 0.0}
        logs, n = self.flat, _N
        back: list[dict[tuple[int, int], tuple[tuple[int, int], str]]] = []
        for m in _RUNS.finditer(token):
            steps = _steps(m.group(1), len(m.group()), m.end() == len(token))
            best: dict[tuple[int, int], float] = {}
            came: dict[tuple[int, int], tuple[tuple[int, int], str]] = {}
            for at, score in states.items():
                for letters, cost in steps:
                    (x, y), s = at, score - cost
                    for letter in letters:
                        z = _AT.get(letter, 0)
                        s += logs[(x * n + y) * n + z]
                        x, y = y, z
                    if (x, y) not in best or best[x, y] < s:
                        best[x, y], came[x, y] = s, (at, letters)
            states = best
            back.append(came)
        at = max(states, key=lambda k: states[k] + self.logs[k[0], k[1], 0])
        out = []
        for came in reversed(back):
            at, letters = came[at]
            out.append(letters)
        return "".join(reversed(out))

    def mended(self, decoded: str) -> str:
        """Decoded words, those of the lexicon put right: up to three neighbours joined, doubled letters as it has them."""
        words, out, i = decoded.split(" "), [], 0
        while i < len(words):
            for n in range(min(3, len(words) - i), 0, -1):
                joined = "".join(words[i : i + n])
                word = self.single.get(_single(joined)) or (joined if joined in self.lexicon else "")
                if word:
                    break
            out.append(word or words[i])
            i += n
        return " ".join(out)

    def restored_token(self, token: str) -> str:
        got = self.kept.get(token)
        if got is None:
            low = token.lower()
            got = low
            if any(c in _AT for c in low):
                got = self.mended(self.decode(low))
            elif _ALL_OTHER(low):
                read = self.decode(low)
                got = read if read in self.lexicon else low
            if len(token) <= CACHED_CHARS:
                if len(self.kept) >= CACHE:
                    self.kept.clear()
                self.kept[token] = got
        return got

    def _odd(self, token: str) -> bool:
        """Is a token to be decoded: may it be read in more than one way, and is it no known word?"""
        core = token.rstrip(".,;:")
        if core.isascii() and core.isalpha() and not _DOUBLED(core):
            return False
        if _ODD(token):
            return True
        if not token.isascii() and _OTHER(token) and (_LATIN(token) or _ALL_OTHER(token)):
            return True
        if self.known is None:  # before there is a lexicon, doubled letters stay
            return False
        return bool(_DOUBLED(token)) and not all(w in self.known for w in _WORDS(token.lower()) if _DOUBLED(w))

    def restored(self, text: str) -> str:
        """The text in lower case with its suspicious tokens restored."""
        spaced = _SPACED.sub(lambda m: self.restored_token(m.group()), shown(text))
        return re.sub(r"\S+", lambda m: self.restored_token(m.group()) if self._odd(m.group()) else m.group().lower(), spaced)

    def features(self, text: str) -> set[str]:
        """Distinct words of the text and of the restored text, and their first four and five letters."""
        out = set()
        for chunk in set(self._chunks(text)):
            out.update(self._chunk(chunk))
        return out

    def _chunks(self, text: str) -> list[str]:
        """The tokens of a text, and the words of what it tells apart letter by letter (whose letters alone are no
        words)."""
        text = shown(text)
        chunks = text.split()
        for m in _SPACED.finditer(text):
            chunks += self.restored_token(m.group()).split()
        return chunks

    def _words(self, chunk: str) -> list[str]:
        """The words of a token, as it stands and restored."""
        words = _WORDS(chunk.lower())
        return words + _WORDS(self.restored_token(chunk)) if self._odd(chunk) else words

    def _chunk(self, chunk: str) -> set[str]:
        """What a token is weighed by."""
        return {f for w in self._words(chunk) for f in _forms(w)}

    def _weighed(self, chunk: str) -> tuple[float, str]:
        """The strongest weight of a token, and what has it."""
        return max(((self.lexicon.get(f, 0.0), f) for w in self._words(chunk) if w[:3] in self.starts for f in _forms(w)), default=(0.0, ""))

    def evidence(self, text: str) -> tuple[float, float]:
        """The strongest weights of two tokens that are not the same."""
        first = second = 0.0
        named = None
        for chunk in set(self._chunks(text)):
            got = self.weighed.get(chunk)
            if got is None:
                got = self._weighed(chunk)
                if len(chunk) <= CACHED_CHARS:
                    if len(self.weighed) >= 2 * CACHE:
                        self.weighed.clear()
                    self.weighed[chunk] = got
            w, f = got
            if w > first:
                if f != named:
                    second = first
                first, named = w, f
            elif w > second and f != named:
                second = w
        return first, second

    def score(self, text: str | None) -> float:
        first, second = self.evidence(text or "")
        a, b, c = self.weights
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * first + c * second))))


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted logistic regression, pulled to zero, by Newton steps that are halved until the loss falls."""
    x = np.c_[np.ones(len(x)), x]
    pull = np.array([1e-3, 1.0, 1.0])

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return float((w * (np.logaddexp(0, z) - y * z)).sum() + (pull * b * b).sum() / 2)

    b = np.zeros(3)
    now = loss(b)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (w * (y - p)) - pull * b)
        size = 1.0
        while size > 1e-6 and loss(b + size * step) >= now:
            size /= 2
        if size <= 1e-6:
            break
        b = b + size * step
        now = loss(b)
    return b


def fit(df: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Learn from df's texts (characters) and from labels (id_col, label)."""
    spark, work = df.sparkSession, Work(df.sparkSession)
    model = Model(log_model(char_counts(df, text)))
    own = labels.select(F.col(id_col).alias("__id"), F.col(label).cast("int").alias("__y")).filter("__id IS NOT NULL AND __y IN (0, 1)")
    n = {r["__y"]: r["count"] for r in own.groupBy("__y").count().collect()}
    base = (n.get(1, 0) + 0.5) / (sum(n.values()) + 1) if n else 1e-9
    model.weights = (math.log(base / (1 - base)), 0.0, 0.0)
    if len(n) < 2:
        return model
    # at most 2 * sample rows of two numbers: the bound of what is broadcast
    some = own.filter("__y = 1").orderBy(F.xxhash64("__id")).limit(sample).union(own.filter("__y = 0").orderBy(F.xxhash64("__id")).limit(sample))
    part = F.pmod(F.xxhash64(F.lit(5), "__id"), F.lit(4)).alias("part")
    chosen = work.cut(df.join(F.broadcast(some), F.col(id_col) == F.col("__id")).select(F.coalesce(text, F.lit("")).alias("text"), F.col("__y").alias("y"), part), "labelled")
    shared = spark.sparkContext.broadcast(model)

    def count(batches):
        seen: list[Counter] = [Counter(), Counter()]
        docs = [0, 0]
        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen[y].update(shared.value.features(x))
                docs[y] += 1
        names = list(seen[0] | seen[1])
        for at in range(0, len(names), 100_000):
            some = names[at : at + 100_000]
            yield pa.record_batch([pa.array(some), pa.array([seen[1][f] for f in some], pa.int64()), pa.array([seen[0][f] for f in some], pa.int64())], ["f", "toxic", "clean"])
        yield pa.record_batch([pa.array([""]), pa.array([docs[1]], pa.int64()), pa.array([docs[0]], pa.int64())], ["f", "toxic", "clean"])

    counted = work.cut(chosen.filter("part > 0").select("text", "y").mapInArrow(count, "f string, toxic long, clean long").groupBy("f").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "counted")
    docs = counted.filter("f = ''").first()
    if docs is None or not docs.toxic or not docs.clean:
        return model
    scale = (n[0] / docs.clean) / (n[1] / docs.toxic)  # a clean document of the sample stands for so many
    clean = F.col("clean") * scale
    share = (F.col("toxic") + base * PULL) / (F.col("toxic") + clean + PULL)
    weight = F.log(share / (1 - share)) - math.log(base / (1 - base))
    best = counted.filter((F.col("f") != "") & (F.col("toxic") >= 2) & (share >= max(LEAST, 2 * base))).select("f", weight.alias("w")).toArrow()  # words of at most sample toxic documents
    doubled = counted.filter((F.col("toxic") + F.col("clean") >= KNOWN) & ~F.col("f").endswith("*") & F.col("f").rlike(r"(.)\1"))
    known = doubled.select("f").toArrow()["f"].to_pylist()  # words of at least KNOWN of at most 2 * sample documents
    model = model.taught(dict(zip(best["f"].to_pylist(), best["w"].to_pylist())), known)
    shared = spark.sparkContext.broadcast(model)

    def weigh(batches):
        for b in batches:
            got = [shared.value.evidence(x) for x in b.column(0).to_pylist()]
            yield pa.record_batch([pa.array([g[0] for g in got]), pa.array([g[1] for g in got]), b.column(1)], ["a", "b", "y"])

    rows = chosen.filter("part = 0").select("text", "y").mapInArrow(weigh, "a double, b double, y int").toPandas()  # at most 2 * sample rows
    work.drop("labelled", "counted")
    if rows["y"].nunique() == 2:
        y = rows["y"].to_numpy()
        w = np.where(y == 1, n[1] / (y == 1).sum(), n[0] / (y == 0).sum())
        model.weights = tuple(_logistic(rows[["a", "b"]].to_numpy(), y, w * len(y) / w.sum()))
    return model


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """df with the probability that a text is toxic."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(x) for x in texts], dtype="float64")

    return df.withColumn(out, scored(F.col(text)))


def restore(df: DataFrame, model: Model, text: str = "text", out: str = "restored") -> DataFrame:
    """df with the restored text."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def restored(texts: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else shared.value.restored(x) for x in texts], dtype=object)

    return df.withColumn(out, restored(F.col(text)))
