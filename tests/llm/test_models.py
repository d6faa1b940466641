"""Toxicity, mixing and the pipeline."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelforge.llm import mixing, toxicity
from panelforge.llm.queries import op8_toxicity, op9_mixing


@pytest.fixture(scope="module")
def small_model(spark):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        w = [r.choice(["the", "quiet", "river", "stone", "under", "morning", "walked", "paper"]) for _ in range(20)]
        if i % 6 == 0:
            for x in r.sample(["idiot", "stupid", "moron"], 2):
                w[r.randrange(20)] = x
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 6 == 0)))
    labels += [(None, 1), (9999, 1), (3, None)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    return toxicity.fit(docs, labels)


@pytest.mark.parametrize("token, word", [("1d1ot", "idiot"), ("i.d.i.o.t", "idiot"), ("stuuuupid", "stupid"), ("$tup1d", "stupid"), ("m0r0n", "moron"), ("M0R0N", "moron"), ("st-up-id", "stupid"), ("idiot!", "idiot"), ("s" + "t" * 90 + "upid", "stupid"), ("m" + "0" * 300 + "ron", "moron")])
def test_decoding(small_model, token, word):
    assert small_model.restored_token(token) == word
    assert small_model.restored(f"the {token} walked") == f"the {word} walked"


@pytest.mark.parametrize("token, word", [("iiddiioott", "idiot"), ("1d10t", "idiot"), ("id​i­ot", "idiot"), ("idіоt", "idiot"), ("stυpid", "stupid"), ("ｓｔｕｐｉｄ", "stupid"), ("m̶o̶r̶o̶n̶", "moron"), ("st*pid", "stupid"), ("\U0001d5c6\U0001d5c8\U0001d5cb\U0001d5c8\U0001d5c7", "moron")])
def test_what_does_not_look_odd_is_decoded_too(small_model, token, word):
    """Doubled letters, signs that do not show, letters of other scripts and forms, stars for vowels."""
    assert small_model.restored(f"the {token} walked") == f"the {word} walked"
    assert word in small_model.features(f"the {token} walked")


def test_known_words_and_other_scripts_stay(small_model):
    assert small_model.restored("привет сор book, letter") .split()[:2] == ["привет", "сор"]
    assert {"book", "letter", "привет"} <= small_model.features("Привет book, letter")
    assert small_model.restored("") == "" and toxicity.shown("​​") == ""


def obfuscations(r):
    looks = {"o": "0", "i": "1", "e": "3", "a": "@", "s": "$", "t": "7", "b": "8", "l": "|"}
    other = {"a": "а", "e": "е", "o": "о", "c": "с", "p": "р", "x": "х", "i": "і", "u": "υ"}
    return {
        "signs": lambda w: "".join(looks.get(c, c) for c in w),
        "doubled": lambda w: "".join(2 * c for c in w),
        "repeated": lambda w: "".join(c * r.choice([1, 1, 4]) for c in w),
        "blanks": lambda w: " ".join(w),
        "dots": lambda w: ".".join(w),
        "unseen": lambda w: "​".join(w),
        "scripts": lambda w: "".join(other.get(c, c) for c in w),
    }


def test_obfuscated_words_of_held_out_texts(spark):
    """Every weighed word of held-out toxic texts, disguised by each rule: most of the words are restored, and most of the
    texts are still found."""
    import re

    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    model = toxicity.fit(docs, labels.filter(~out))
    rows = docs.join(labels.filter(out & (F.col("toxic") == 1)).select("doc_id"), "doc_id").select("text").collect()
    texts = sorted({x.text for x in rows if x.text and model.score(x.text) >= 0.3 and max(map(len, x.text.split())) < 64 and len(x.text) < 20_000})[:150]
    assert len(texts) > 50
    for name, rule in obfuscations(random.Random(5)).items():
        words, back, found = 0, 0, 0
        for x in texts:
            named = {w for w in re.findall(r"[a-z]{4,}", x.lower()) if w in model.lexicon}
            y = re.sub(r"(?<!\w)[a-z]{4,}(?!\w)", lambda m: rule(m.group()) if m.group() in named else m.group(), x.lower())
            seen = model.features(y)
            words, back = words + len(named), back + len(named & seen)
            found += model.score(y) >= 0.3
        print(name, words, round(back / words, 3), round(found / len(texts), 3))
        assert back > 0.8 * words and found > 0.8 * len(texts), name


def test_obfuscated_and_clean_texts(spark, small_model):
    texts = ["the 1d1ot and m0r0n walked", "you s t u p i d i.d.i.o.t", "quiet river stone 123 under 4 paper", None, "", "x" * 100_000, "STUPID idiot"]
    df = spark.createDataFrame(list(enumerate(texts)), "score int, text string")
    got = {r.text: r.score for r in toxicity.score(df, small_model).collect()}
    assert all(got[x] > 0.7 for x in (texts[0], texts[1], texts[6]))
    assert all(got[x] < 0.3 for x in texts[2:6]) and got[None] == got[""]
    assert toxicity.restore(df, small_model).filter("text = 'STUPID idiot'").first().restored == "stupid idiot"


def test_spaced_letters_end_where_words_do(small_model):
    assert small_model.restored("s t u p i d  i d i o t") == "stupid idiot"
    assert small_model.restored("s t u p i d m o r o n") == "stupid moron"
    assert {"stupid", "moron"} <= small_model.features("s t u p i d m o r o n")


def test_tokens_of_any_length_are_restored(small_model):
    """Repeated letters, and a token far beyond what is cached, in linear time."""
    plain = small_model.score("you idiot and stupid")
    for n in (3, 50, 65, 500, 20_000):
        assert abs(small_model.score(f"you id{'i' * n}ot and stu{'u' * n}pid") - plain) < 1e-9
    assert "stupid" in small_model.restored("s.t.u.p.i.d. " + "q-7x" * 20_000)


def test_path_is_the_best_of_all(small_model):
    """Viterbi against every path of small lattices."""
    import itertools

    r = random.Random(3)
    for _ in range(60):
        token = "".join(r.choice("stu0p1d$.iim") for _ in range(r.randrange(1, 8)))
        runs = [(m.group(1), len(m.group()), m.end() == len(token)) for m in toxicity._RUNS.finditer(token)]

        def value(path):
            text, s = "".join(x for x, _ in path), -sum(c for _, c in path)
            at = [0, 0, *(toxicity._AT.get(c, 0) for c in text), 0]
            return s + sum(float(small_model.logs[a, b, c]) for a, b, c in zip(at, at[1:], at[2:]))

        paths = list(itertools.product(*(toxicity._steps(*x) for x in runs)))
        top = max(map(value, paths))
        assert any("".join(x for x, _ in p) == small_model.decode(token) and abs(value(p) - top) < 1e-3 for p in paths)


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(r.score < 0.01 for r in toxicity.score(docs, model).collect())
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = dict(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic").collect())
    got = [r for r in op8_toxicity(spark, sf).collect()]
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    pairs = [(r.score, r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    hits = sum(p == y for _, p, y in pairs) / len(pairs)
    up, down = [s for s, _, y in pairs if y], [s for s, _, y in pairs if not y]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in up for b in down])
    recall, false = sum(p for _, p, y in pairs if y) / len(up), sum(p for _, p, y in pairs if not y) / len(down)
    print("held-out accuracy", hits, "auc", auc, "recall", recall, "false", false)
    assert hits > 0.95 and auc > 0.95 and recall > 0.8 and false < 0.02


VOCABULARY = P.path("byte_bpe_50k.json")


def cells(seed, shape=(5, 4, 3), empty=0.2):
    r = np.random.default_rng(seed)
    tokens = r.integers(1, 1000, shape).astype(float)
    tokens[r.random(shape) < empty] = 0
    return r, tokens, [x.ravel() for x in np.indices(shape)]


def margins(kept, shape):
    x = kept.reshape(shape)
    return [x.sum(axis=tuple(i for i in range(3) if i != axis)) for axis in range(3)]


def test_rake_meets_margins_as_dense_fitting_does():
    r, tokens, of = cells(3)
    wants = [w / w.sum() for w in (r.random(5) + 0.1, r.random(4) + 0.1, r.random(3) + 0.1)]
    chance, off = mixing.rake(tokens.ravel(), of, wants)
    fitted = (chance * tokens.ravel()).reshape(tokens.shape)
    fitted = fitted / fitted.sum()
    brute = tokens / tokens.sum()
    for _ in range(3000):
        for axis, want in enumerate(wants):
            others = tuple(i for i in range(3) if i != axis)
            brute = brute * np.expand_dims(want / brute.sum(axis=others), others)
    assert off < 1e-8 and np.allclose(fitted, brute, atol=1e-8)


def test_filling_is_what_bisection_finds():
    r = np.random.default_rng(7)
    for _ in range(200):
        n, k = r.integers(1, 30), r.integers(1, 6)
        own, most, z = r.integers(0, k, n), r.integers(0, 9, n).astype(float), r.random(n) * (r.random(n) < 0.8)
        want = np.bincount(own, weights=most * (z > 0), minlength=k) * r.choice([0.0, 0.3, 0.9, 1.0, 1.5], k)
        got = mixing._filled(z, most, own, want)
        for c in range(k):
            mine = own == c
            reach = np.minimum(most, 1e18 * z)[mine].sum()
            assert np.isclose(np.minimum(most, min(got[c], 1e30) * z)[mine].sum(), min(want[c], reach))


@pytest.mark.parametrize("seed", range(6))
def test_bounded_raking_meets_margins_that_are_possible(seed):
    """Margins of some probabilities below one can be met by definition, and the bound is where it must be: the result is
    min(1, a product of the categories' factors)."""
    r, tokens, of = cells(seed, empty=0.1)
    some = np.minimum(1.0, r.random(tokens.shape) * 1.6)
    wants = [m / (some * tokens).sum() for m in margins(some * tokens, tokens.shape)]
    chance, off = mixing.rake(tokens.ravel(), of, wants, (some * tokens).sum())
    assert off < 1e-6 and chance.max() <= 1 and chance.min() >= 0
    for m, w in zip(margins(chance * tokens.ravel(), tokens.shape), wants):
        assert np.abs(m / (some * tokens).sum() - w).max() < 1e-6


def test_what_cannot_be_had():
    tokens, of = np.array([900.0, 80.0, 20.0]), [np.array([0, 1, 2]), np.zeros(3, int), np.zeros(3, int)]
    shares = lambda power: [np.array(list(mixing.tempered({"a": 900.0, "b": 80.0, "c": 20.0}, power).values())), np.ones(1), np.ones(1)]
    # tempered as far as the budget allows: c is kept whole, or nearly
    goal, budget, chance, off = mixing.allowed(tokens, of, shares, 700.0, False)
    assert budget == 700 and off < 1e-6 and np.isclose((chance * tokens).sum(), 700) and 0.99 < chance[2] <= 1
    assert np.allclose(chance * tokens / 700, goal[0], atol=1e-6)
    # named shares stay, the budget gives way: 20 tokens of c are a third of 60
    third = lambda power: [np.ones(3) / 3, np.ones(1), np.ones(1)]
    goal, budget, chance, off = mixing.allowed(tokens, of, third, 700.0, True)
    assert abs(budget - 60) < 0.01 and np.allclose(chance * tokens, 20, atol=0.01) and off <= 1e-6
    # categories that only occur together have one share
    of = [np.array([0, 1]), np.array([0, 1]), np.zeros(2, int)]
    goal, budget, chance, off = mixing.allowed(np.array([10.0, 10.0]), of, lambda p: [np.array([0.5, 0.5]), np.array([0.9, 0.1]), np.ones(1)], 5.0, True)
    assert off > 0.1


MIX = "doc_id long, text string, source string, lang string"


def test_mixing_odd_rows(spark):
    rows = [(1, "a b", "s", "en"), (1, "a b", "s", "en"), (None, None, None, None), (3, "", "t", None), (4, "word " * 200_000, "s", "en")]
    df = spark.createDataFrame(rows, MIX)
    for c in ("c_lang", "c_source", "weight", "kept", "n", "__x", "__draw", "__read", "row", "draw", "read", "given", "__source"):  # names that could clash
        df = df.withColumn(c, F.lit(5))
    out = mixing.mixed(df, VOCABULARY, keep=1.0).collect()
    assert len(out) == 5 and all(r.kept is not None and (r.c_lang, r.c_source, r.n, r["__x"], r["__draw"], r["__read"], r["row"], r["given"], r["__source"]) == (5,) * 9 for r in out)
    assert [r.n_tokens for r in out if r.doc_id == 1] == [2, 2] and [r.n_tokens for r in out if r.doc_id == 4] == [200_001]
    empty, report = mixing.mixture(spark.createDataFrame([], MIX), VOCABULARY)
    assert empty.count() == report.count() == 0


def test_every_source_that_is_targeted_gets_weight(spark):
    rows = [(i, "three words here", f"s{i % 100}", "en") for i in range(400)]
    out = mixing.mixed(spark.createDataFrame(rows, MIX), VOCABULARY, {"source": {f"s{i}": 0.01 for i in range(100)}}, keep=0.5).collect()
    assert all(abs(r.probability - 0.5) < 1e-6 for r in out)


def test_more_cells_than_the_bound_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_CELLS", 10)
    with pytest.raises(ValueError):
        mixing.mixed(spark.createDataFrame([(i, "a", f"s{i}", "en") for i in range(11)], MIX), VOCABULARY)


def test_mixing_without_a_broadcast_and_by_a_given_topic(spark, monkeypatch):
    rows = [(i, "some words " * (1 + i % 7), f"s{i % 3}", "en", ["art", None][i % 2]) for i in range(200)]
    df = spark.createDataFrame(rows, MIX + ", topic string")
    want = sorted(map(str, mixing.mixed(df, VOCABULARY, topic_col="topic").collect()))
    monkeypatch.setattr(mixing, "BROADCAST_CELLS", 0)
    got = mixing.mixed(df, VOCABULARY, topic_col="topic")
    assert sorted(map(str, got.collect())) == want and {r.topic for r in got.collect()} == {"art", None}


def held_against(rows, report, keep):
    """Every category's kept tokens: what is expected is the target, what is drawn is within five deviations of it."""
    targets = {(r.dimension, r.category): r for r in report}
    expected, spread, drawn = {}, {}, {}
    for r in rows:
        for d in mixing.DIMENSIONS:
            k = d, mixing.OTHER if r[d] is None else r[d]
            expected[k] = expected.get(k, 0) + r.n_tokens * r.probability
            spread[k] = spread.get(k, 0) + r.n_tokens**2 * r.probability * (1 - r.probability)
            drawn[k] = drawn.get(k, 0) + r.n_tokens * r.kept
    total = sum(r.n_tokens * r.probability for r in rows)
    assert abs(total - keep * sum(r.n_tokens for r in rows)) < 1e-4 * total
    assert {k for k, n in expected.items() if n} <= set(targets)
    for k, r in targets.items():
        assert r.met and abs(expected[k] / total - r.target) < 1e-5, (k, r)
        assert abs(drawn[k] - expected[k]) <= 5 * spread[k] ** 0.5 + 1, k


def test_mixing_query(spark, sf):
    """The sample of the query, by category, against the targets and the tokens counted by the library."""
    library = Tokenizer.from_file(VOCABULARY)
    library.encode_special_tokens = True
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op9_mixing(spark, sf).collect()
    assert len(got) == len(docs) and all(r.n_tokens == len(library.encode(docs[r.doc_id].text or "", add_special_tokens=False).ids) for r in got)
    by_cell: dict = {}
    for r in got:
        by_cell.setdefault((r.source, r.lang, r.topic), set()).add((r.weight, r.probability))
    assert all(len(v) == 1 for v in by_cell.values())
    df = spark.read.parquet(f"{sf}/documents.parquet")
    out, report = mixing.mixture(df, VOCABULARY, keep=0.7)
    held_against(got, report.collect(), 0.7)
    shares = {r.category: r for r in report.filter("dimension = 'lang'").collect()}
    least = min(shares.values(), key=lambda r: r.available)
    assert least.target > least.available  # leans towards equal parts
    # named targets that need less than the budget are met with less
    named = {"lang": {k: 1 / len(shares) for k in shares}}
    out, report = mixing.mixture(df, VOCABULARY, named, keep=0.9)
    assert all(r.met for r in report.filter("dimension = 'lang'").collect())


def test_regression_on_separable_evidence():
    r = np.random.default_rng(6)
    y = (r.random(4000) < 0.3).astype(float)
    x = np.where(y[:, None] == 1, r.choice([7.8, 7.5], (4000, 2)), r.choice([0.0, 2.0, 2.5], (4000, 2)))
    a, b, c = toxicity._logistic(x, y, np.ones(4000))
    p = 1 / (1 + np.exp(-(a + x @ [b, c])))
    assert p[y == 1].min() > 0.8 and p[y == 0].max() < 0.2
