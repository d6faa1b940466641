import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from panelforge.llm import byte_bpe

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.Codec(open(RANKS, "rb").read(), P.PATTERN)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


PARTS = ["a", "e", "th", "the", " ", "  ", "\n", "\t ", "'s", "'ll", "'", "é", "ü", "日本", "🙂", "0", "12", "...", "\x1c", "\x85", "\u00a0", "\u3000", "ab" * 9, "<|endoftext|>", "=", "\u0301"]
ODD = ["", " ", "\n", "a" * 700, " " * 300 + "x", "=-" * 200, "zq" * 150, "a' r", "don' t'll", "x  " * 90, "' " * 40 + "'re"]


def texts(seed: int, n: int, most: int) -> list[str]:
    r = random.Random(seed)
    return ODD + ["".join(r.choice(PARTS) for _ in range(r.randrange(1, most))) for _ in range(n)]


def test_same_as_library_on_odd_texts(codec, library):
    for x in texts(1, 2000, 60):
        got = codec.encode(x)
        assert got == library.encode_ordinary(x), repr(x)
        assert codec.decode(got) == x.encode()


@pytest.mark.parametrize("leaf", [1, 2, 3, 7, 30])
def test_joins_equal_the_whole_wherever_texts_are_cut(codec, library, monkeypatch, leaf):
    monkeypatch.setattr(byte_bpe, "LEAF_CHARS", leaf)
    for window in (1, 2, 16):
        monkeypatch.setattr(byte_bpe, "WINDOW", window)
        for x in texts(leaf, 400, 50):
            assert codec.encode(x) == library.encode_ordinary(x), repr(x)


def test_windows_stay_small_where_blanks_are_near(codec):
    seen = []
    leaf, codec.leaf = codec.leaf, lambda x: seen.append(len(x)) or leaf(x)
    codec.encode("some words, and " * 10_000)
    codec.leaf = leaf
    joins = [n for n in seen if n < 200]
    assert len(joins) == len(seen) // 2 and max(joins) < 40  # one short window for each join of two leaves or nodes


def test_long_texts_and_pieces_without_blanks(codec, library):
    r = random.Random(2)
    for x in ("word and, " * 20_000, "x" * 40_000, "".join(r.choice("abcdefgh") for _ in range(50_000)), "ab cd\n" * 9000, "\n" * 30_000, "日本" * 9000):
        assert codec.encode(x) == library.encode_ordinary(x)
    ids = codec.encode("ab cd\n" * 30_000)
    assert len(ids) > byte_bpe.LEAF_IDS and codec.decode(ids) == b"ab cd\n" * 30_000


def test_unknown_ids(codec):
    for bad in ([70_000], [-1], [None]):
        with pytest.raises(ValueError):
            codec.decode(bad)
    assert codec.decode([]) == b""


def test_frames_with_nulls_repeats_and_clashing_columns(spark, library):
    rows = [(1, "Hello  world", "own"), (None, None, None), (2, "", "x"), (1, "Hello  world", "own")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = byte_bpe.decode(byte_bpe.encode(df, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    assert [list(x.ids) for x in out] == [library.encode_ordinary(x[1] or "") for x in rows]
    assert [bytes(x["bytes"]) for x in out] == [(x[1] or "").encode() for x in rows]
    assert byte_bpe.encode(df.limit(0), RANKS, P.PATTERN).count() == 0


def test_query_against_library(spark, sf, library):
    from panelforge.llm.queries import op1_byte_bpe

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op1_byte_bpe(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
