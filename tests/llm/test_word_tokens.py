import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from panelforge.llm import token_counts, token_files
from panelforge.llm.queries import op7_token_files, op10_token_counts
from panelforge.llm.word_pieces import Library

VOCABULARY = P.path("word_bpe_49k.json")
ODD = ["", " ", "Hello, WORLD! it's", "a\x1cb \x1d", "İstanbul ΑΣ Σ", "É é é", "<|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>", "1234 don't 'S", "日本語 text 🙂🙂", "x" * 5000, "a b c　d\x85e", "... ,,,a.,", "don't. ca'll,"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def odd_texts():
    r = random.Random(5)
    parts = ["a", "The", "é", "É", "ß", "'s", ".", ",", " ", "\n", "1", "𝔄", "İ", "ı", "Σ", "́", "<|", "|>", "<|endoftext|>", "ing", "\x1e", "-", "’"]
    return ODD + ["".join(r.choice(parts) for _ in range(r.randrange(1, 40))) for _ in range(1500)]


def test_ids_by_pre_token_are_the_librarys(library):
    own = Library(open(VOCABULARY, "rb").read())
    for x, got in zip(odd_texts(), own.ids(odd_texts())):
        assert np.frombuffer(got, np.uint32).tolist() == library.encode(x, add_special_tokens=False).ids, repr(x)


def test_pack_round_trip():
    r = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        x = (r.integers(0, 1 << 32, n) >> r.integers(0, 32, n)).astype("<u4")
        assert (token_files.unpack(*token_files.pack(x), n) == x).all()


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(i, x, "src") for i, x in enumerate(odd_texts()[:300])] + [(None, "no id", None), (5000, None, None), (7, "twice", "a"), (7, "twice", "a"), (6000, "the the " * 70_000, "long")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, ids string")


def test_counts(frame, library):
    rows, df = frame
    got = sorted(((r.id is None, r.id or 0, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(df, VOCABULARY).collect()))
    want = sorted((i is None, i or 0, len((x or "").encode()), len(library.encode(x or "", add_special_tokens=False).ids)) for i, x, _ in rows)
    assert got == want
    assert token_counts.token_counts(df.limit(0), VOCABULARY).count() == 0


def check_files(rows, got, library):
    got.sort(key=lambda r: r.start)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    want = sorted((i is not None, i or 0, np.array([*library.encode(x or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, x in rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, bytes(r.ids)) for r in got) == want


def test_files(spark, frame, library):
    rows, df = frame
    out = token_files.store(df, VOCABULARY, 49_408)
    got = out.selectExpr("*", "length(ids) div 4 AS n").collect()
    check_files([r[:2] for r in rows], got, library)
    assert token_files.store(df.limit(0), VOCABULARY, 49_408).count() == 0


def test_few_blocks_are_read_at_once(spark, monkeypatch):
    """A reader holds a row group; a split of many blocks must not be one."""
    monkeypatch.setattr(token_files, "BLOCK", 1)
    df = spark.createDataFrame([(i, f"text {i}") for i in range(60)], "doc_id long, text string")
    out = token_files.store(df, VOCABULARY, 49_408)
    groups = [m.row_group(i).num_rows for m in (pq.read_metadata(f.removeprefix("file://")) for f in {*out.inputFiles()}) for i in range(m.num_row_groups)]
    assert sum(groups) == out.count() == 60 and max(groups) <= 4


def test_queries_against_library(spark, sf, library):
    docs = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    ids = {i: library.encode(x, add_special_tokens=False).ids for i, x in docs.items()}
    got = op10_token_counts(spark, sf).collect()
    assert sorted(tuple(r) for r in got) == sorted((i, len(docs[i].encode()), len(v), len(v) > 2048) for i, v in ids.items())
    at, want = 0, []
    for i in sorted(ids):
        x = np.array([*ids[i], 2], "<u4")
        want.append((i, at, len(x), zlib.crc32(x.tobytes())))
        at += len(x)
    assert sorted(tuple(r) for r in op7_token_files(spark, sf).collect()) == want
