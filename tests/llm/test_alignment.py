"""Alignment of two tokenizers' tokens against plain loops over the libraries' own results."""

import bisect
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelforge.llm import alignment
from panelforge.llm.queries import op12_alignment

from .test_packing import odd_texts

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def test_gallop():
    r = random.Random(4)
    for _ in range(400):
        wanted, held = (np.array(sorted(r.sample(range(300), r.randrange(0, 120))), np.int64) for _ in range(2))
        assert alignment.gallop(wanted, held).tolist() == [bisect.bisect_left(held.tolist(), x) for x in wanted.tolist()]
        i, j = alignment.common(wanted, held)
        assert wanted[i].tolist() == held[j].tolist() == sorted(set(wanted.tolist()) & set(held.tolist()))
    assert alignment.gallop(np.arange(1, 6), np.array([10**6])).tolist() == [0] * 5


def test_overlaps():
    r = random.Random(5)
    for _ in range(200):
        n = r.randrange(1, 60)
        a, b = (sorted({*r.sample(range(1, n + 1), r.randrange(0, n)), n}) for _ in range(2))
        first, count = alignment.overlaps(np.array(a), np.array(b))
        for k in range(len(a)):
            lo, hi = (a[k - 1] if k else 0), a[k]
            want = [i for i in range(len(b)) if (b[i - 1] if i else 0) < hi and b[i] > lo]
            assert list(range(first[k], first[k] + count[k])) == want


def plain(texts):
    """What the contract says, text by text."""
    one, two = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    one.encode_special_tokens = True
    from tokenizers.pre_tokenizers import ByteLevel

    letters = {}
    for b in range(256):  # what each byte is written as, by the library itself
        if b < 0x80:
            letters[ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(b))[0][0]] = b
    for c in range(0x80, 0x800):
        s = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(c))[0][0]
        letters.update(zip(s, chr(c).encode()))
    for c in (0x800, 0x1000, 0x2000, 0x3000, 0x4000, 0x5000, 0x6000, 0x7000, 0x8000, 0x9000, 0xA000, 0xB000, 0xC000, 0xD000, 0xE000, 0xF000, 0x10000, 0x50000, 0x90000, 0xD0000, 0x100000):
        s = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(c))[0][0]
        letters.update(zip(s, chr(c).encode()))
    docs, pairs = [], []
    for x in texts:
        want = b" " + (x or "").encode()
        a = [(i, bytes(letters[c] for c in one.id_to_token(i))) for i in one.encode(want.decode(), add_special_tokens=False).ids] if x else []
        b = [(i, bytes([int(t[3:5], 16)]) if two.is_byte(i) else t.replace("▁", " ").encode()) for i in two.encode(x) for t in [two.id_to_piece(i)]] if x else []
        if not x or b"".join(t for _, t in a) != want or b"".join(t for _, t in b) != want:
            a = b = []
        ends = [set(np.cumsum([len(t) for _, t in s]).tolist()) for s in (a, b)]
        groups, at = [], [0, 0]
        for e in sorted(ends[0] & ends[1]):
            group = []
            for k, s in enumerate((a, b)):
                here, own = sum(len(t) for _, t in s[: at[k]]), []
                while here < e:
                    own.append(s[at[k]][0])
                    here += len(s[at[k]][1])
                    at[k] += 1
                group.append(own)
            groups.append(group)
        links = Counter((i, j) for g in groups for i in g[0] for j in g[1])
        docs.append((len(a), len(b), groups, links))
        pairs.extend(links)
    count, most = Counter(pairs), defaultdict(int)
    for (i, _), n in count.items():
        most[i] = max(most[i], n)
    out = []
    for n_a, n_b, groups, links in docs:
        said = ";".join("|".join(",".join(map(str, s)) for s in g) for g in groups)
        best = sum(n for (i, j), n in links.items() if count[i, j] == most[i])
        out.append((n_a, n_b, len(groups), sum(links.values()), best, sum(n * count[p] for p, n in links.items()), hashlib.sha256(said.encode()).hexdigest() if said else ""))
    return out


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("large, at_once, block", [(1 << 16, 1 << 21, 4096), (3, 5, 7)])
def test_against_plain_loops(spark, monkeypatch, large, at_once, block):
    monkeypatch.setattr(alignment, "LARGE", large)
    monkeypatch.setattr(alignment, "AT_ONCE", at_once)
    monkeypatch.setattr(alignment, "BLOCK", block)
    texts = [x for x in odd_texts(250, seed=8) if len(x) < 5000] + [None, None, "same text", "same text", "▁", "<s>a</s><unk>", "=" * 300, " " * 500, "a\x00b \r\n"]
    rows = [(None if i % 50 == 9 else i // 2, x, "x", "y") for i, x in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pairs string, block string")
    got = alignment.linked(df.repartition(3), A, B).select("id", *COLUMNS).collect()
    want = [(r[0], *w) for r, w in zip(rows, plain(texts))]
    key = lambda x: (x[0] is None, *map(str, x))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert alignment.linked(df.limit(0), A, B).count() == 0


def test_groups_and_overlaps(spark):
    df = spark.createDataFrame([(1, "The cat sat, unbelievably."), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r.aligned for r in alignment.align(df.withColumn("a", F.lit(1)), A, B).collect()}
    assert list(got[2].a) == list(got[3].b_to) == []
    x = got[1]
    assert len(x.a_to) == len(x.b_to) and x.a_to[-1] == len(x.a) == len(x.first) == len(x.n) and x.b_to[-1] == len(x.b)
    assert all(f + n <= len(x.b) and n > 0 for f, n in zip(x.first, x.n))


def test_very_long_text():
    own = alignment.Aligned(["word " * 200_000, " " * 300_000, "x" * 100_000], open(A, "rb").read(), open(B, "rb").read())
    keys, times = own.pairs()
    assert times.sum() == own.n_links.sum() and len(keys) < 50


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((r.doc_id, *w) for r, w in zip(docs, plain([r.text for r in docs])))
    assert sorted(map(tuple, op12_alignment(spark, sf).select("doc_id", *COLUMNS).collect())) == want
