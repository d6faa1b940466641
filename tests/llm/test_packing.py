"""Packing and byte-level ids against the tokenizers library and a plain loop."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelforge.llm import packing
from panelforge.llm.byte_level import LONG_BLANK, ByteLevel
from panelforge.llm.queries import op13_packing

FILE = P.path("byte_bpe_50k.json")
PARTS = ["a", "The", " the", "é", "日本", "🙂", "'s", "'", " ", "  ", "\n", "\t", "1", "23", "<|endoftext|>", "<|", "|>", "▁", "\xa0", ".", "...", "\x00", "ing", "́", "　"]


def odd_texts(n=1500, seed=3):
    r = random.Random(seed)
    return ["", " ", "<|endoftext|>", "x<|endoftext|> y", "x" * 20_000] + ["".join(r.choice(PARTS) for _ in range(r.randrange(1, 40))) for _ in range(n)]


@pytest.mark.parametrize("plain", [False, True])
def test_ids_are_the_librarys(plain):
    own, library = ByteLevel(open(FILE, "rb").read(), plain), Tokenizer.from_file(FILE)
    library.encode_special_tokens = plain
    assert own.fast is not None
    for x in odd_texts() + ["a" + " " * (LONG_BLANK + 5) + "b", " \n" * 500_000 + "<|endoftext|>"]:
        ids = own.ids(x)
        assert ids.tolist() == library.encode(x, add_special_tokens=False).ids, repr(x[:80])
        assert b"".join(own.tokens[i] for i in ids) == x.encode() and own.sizes[ids].sum() == len(x.encode())


def test_files_that_ask_for_more_go_to_the_library():
    said = Tokenizer.from_file(FILE).to_str().replace('"add_prefix_space":false,"trim_offsets":true,"use_regex":true}', '"add_prefix_space":true,"trim_offsets":true,"use_regex":true}', 1)
    own = ByteLevel(said.encode(), False)
    assert own.fast is None and own.ids("The end").tolist() == Tokenizer.from_str(said).encode("The end").ids


def check(rows, sequences, size, end_id=1):
    """Every sequence but the last is full, and its pieces give back each document's ids once."""
    library = Tokenizer.from_file(FILE)
    got = sorted(sequences.collect(), key=lambda r: r.sequence_id)
    assert [r.sequence_id for r in got] == list(range(len(got)))
    assert all(r.n == size for r in got[:-1]) and (not got or 0 < got[-1].n <= size)
    flow, docs = [], []
    for r in got:
        ids, at = np.frombuffer(r.ids, "<u4"), 0
        assert len(ids) == r.n
        for p in r.pieces:
            assert p.offset == at and p.length > 0
            at += p.length
            if p.start == 0:
                flow.append([])
                docs.append((p.doc_id, p.doc_tokens))
            assert p.start == len(flow[-1]) and docs[-1] == (p.doc_id, p.doc_tokens)
            flow[-1] += ids[p.offset : p.offset + p.length].tolist()
        assert at == r.n
    assert all(n == len(x) for (_, n), x in zip(docs, flow))
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    want = [(i, [*library.encode(x or "", add_special_tokens=False).ids, end_id]) for i, x in rows]
    assert sorted(((d, x) for (d, _), x in zip(docs, flow)), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("size, parts, block", [(2048, 3, 1 << 18), (7, 5, 50), (64, 4, 1), (1, 2, 100)])
def test_sequences(spark, monkeypatch, size, parts, block):
    monkeypatch.setattr(packing, "BLOCK", block)
    rows = list(enumerate(odd_texts(120))) + [(None, "no id"), (None, "no id"), (7, "twice"), (7, "twice"), (8, None), (9, "a b " * 9000 if size > 1 else "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("ids", "part", "sequence_id", "pieces")}).repartition(parts)
    check(rows, packing.packed(df, FILE, size), size)


def test_empty_and_padding(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert packing.packed(df.limit(0), FILE).count() == 0
    out = packing.packed(df, FILE, 16, end_id=1)
    check([(1, None), (2, "")], out, 16)
    assert out.select(packing.padded("ids", "n", 16).alias("p")).first().p == np.array([1, 1], "<u4").tobytes()
    three = packing.packed(df.union(df.limit(1)), FILE, 16)
    assert np.frombuffer(three.select(packing.padded("ids", "n", 16, 9).alias("p")).first().p, "<u4").tolist() == [1] * 3 + [9] * 13


def test_few_blocks_are_read_at_once(spark, monkeypatch):
    """A reader holds a row group; a split of many blocks must not be one."""
    monkeypatch.setattr(packing, "BLOCK", 1)
    rows = list(enumerate(odd_texts(60)))
    out = packing.packed(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), FILE, 64)
    groups = [m.row_group(i).num_rows for m in (pq.read_metadata(f.removeprefix("file://")) for f in {*out.inputFiles()}) for i in range(m.num_row_groups)]
    assert sum(groups) == len(rows) and max(groups) <= 4
    check(rows, out, 64)


def test_query(spark, sf):
    docs = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    library = Tokenizer.from_file(FILE)
    ids = {i: np.array([*library.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for i, x in docs.items()}
    got = sorted(op13_packing(spark, sf).collect(), key=lambda r: (r.sequence_id, r.offset))
    total, covered = sum(map(len, ids.values())), {i: 0 for i in ids}
    at = 0
    for r in got:
        assert (r.sequence_id, r.offset) == (at // 2048, at % 2048) and r.offset + r.length <= 2048
        x = ids[r.doc_id]
        assert r.doc_tokens == len(x) and r.start == covered[r.doc_id]
        assert r.ids_crc32 == zlib.crc32(x[r.start : r.start + r.length].tobytes())
        covered[r.doc_id] += r.length
        at += r.length
    assert at == total and covered == {i: len(x) for i, x in ids.items()}
