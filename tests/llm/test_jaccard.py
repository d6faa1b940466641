import random

import pytest

from panelforge.llm import jaccard
from panelforge.llm.queries import op6_jaccard_join
from panelforge.llm.shingles import shingle_sets


def words(x):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in x or ""))


def brute(rows, k, num, den):
    """Set sizes and components by plain sets and a walk over all pairs."""
    sets = {}
    for i, x in rows:
        w = words(x)
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_sets_have_the_right_sizes():
    r = random.Random(1)
    texts = ["", None, "a", "A a\ta", "a b c", "A B C a b c", "é É x", "x" * 100, "one\x0btwo\x1cthree four"] + [" ".join(r.choice("abcdE") for _ in range(r.randrange(50))) for _ in range(300)]
    for k in (1, 3, 5):
        got = shingle_sets(texts, k)
        for x, s in zip(texts, got):
            w = words(x)
            want = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
            assert len(s) == len(want), x
    a, b = shingle_sets(["A b c d", "zz a B c d"], 3)
    assert len(set(a) & set(b)) == 2


def family(r, n, size, edits, vocabulary):
    base = [r.choice(vocabulary) for _ in range(size)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randrange(edits + 1)):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("k, num, den, seed", [(3, 90, 100, 1), (5, 8, 10, 2), (3, 5, 10, 3), (1, 7, 10, 4), (3, 90, 100, 5)])
def test_components_against_brute_force(spark, k, num, den, seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(2000)]
    texts = []
    for size, edits in ((12, 1), (40, 2), (40, 6), (150, 4), (300, 12), (3, 1), (2, 1)):
        texts += family(r, 14, size, edits, vocabulary)
    passage = " ".join(r.choice(vocabulary) for _ in range(60))
    texts += [passage + " " + " ".join(r.choice(vocabulary) for _ in range(r.randrange(1, 30))) for _ in range(40)]
    texts += [r.choice(texts) for _ in range(30)] + ["", None, " ", "solo"] + [" ".join(r.choice("ab") for _ in range(9)) for _ in range(20)]
    r.shuffle(texts)
    rows = [(1000 - 3 * i, x) for i, x in enumerate(texts)]
    df = spark.createDataFrame([(i, x, 1) for i, x in rows], "doc_id long, text string, id int").repartition(3)
    got = {x.id: (x.n, x.comp) for x in jaccard.classes(df, k, num, den).collect()}
    assert got == brute(rows, k, num, den)


def test_partner_with_a_shorter_prefix_is_found(spark):
    """10 and 11 share 20 of 22 shingles; most of what 11 has left is shared with other components."""
    w = lambda a, b, x="w": [f"{x}{i}" for i in range(a, b)]
    rows = [(1, w(1, 4)), (10, w(1, 23)), (11, w(1, 23) + ["z1", "z2"])]
    for i in range(8):
        rows += [(100 + i, w(0, 42, f"r{i}_") + w(2, 23)), (200 + i, w(0, 42, f"r{i}_") + w(0, 22, "t"))]
    rows = [(i, " ".join(x)) for i, x in rows]
    got = {x.id: (x.n, x.comp) for x in jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()}
    assert got == brute(rows, 3, 90, 100) and got[11][1] == 10


@pytest.mark.parametrize("seed", range(3))
def test_unequal_prefixes_against_brute_force(spark, seed):
    """Documents put together from shared passages, so that prefixes and what they ask for differ."""
    r = random.Random(seed)
    passages = [[f"p{i}_{j}" for j in range(r.randrange(3, 40))] for i in range(25)]
    rows = []
    for i in range(160):
        own = [x for p in r.sample(passages, r.randrange(1, 5)) for x in p]
        for _ in range(r.randrange(3)):
            own.insert(r.randrange(len(own)), f"u{r.randrange(60)}")
        rows.append((i, " ".join(own)))
        rows.append((1000 + i, " ".join(own + [f"z{r.randrange(9)}"] * r.randrange(3))))
    for k, num, den in ((3, 90, 100), (2, 7, 10)):
        got = {x.id: (x.n, x.comp) for x in jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string"), k, num, den).collect()}
        assert got == brute(rows, k, num, den)


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, "A  B c\nd"), (3, None)], "doc_id long, text string")
    got = sorted(((r.id, r.n, r.comp) for r in jaccard.classes(df, 3, 9, 10).collect()), key=str)
    assert got == sorted([(None, 2, 1), (1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3)], key=str)
    assert jaccard.classes(df.limit(0)).count() == 0


def test_query_against_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op6_jaccard_join(spark, sf).collect()}
    want = brute(rows, 3, 90, 100)
    assert got == want
    assert any(c != i for i, (_, c) in want.items())
