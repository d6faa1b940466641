"""Each stage of the pipeline against plain Python on a small table with odd rows, and the whole run."""

import random
import re

import corpus_pipeline as pipe
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from panelforge import session
from panelforge.llm import mixing

from .test_jaccard import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
INSULTS = ["idiot", "stupid", "moron", "worthless"]


def table(spark, rows):
    return spark.createDataFrame([(i, x, lang, src, None if x is None else len(x)) for i, x, lang, src in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(12)
    words = [f"word{i}" for i in range(900)]
    passage = "a passage that many of the documents share with each other, word for word"
    out = []
    for i in range(240):
        text = [" ".join(r.choice(words) for _ in range(r.randrange(8, 60))) for _ in range(r.randrange(1, 4))]
        if i % 8 == 0:
            text[0] += f" you {r.choice(INSULTS)} and {r.choice(INSULTS)}"
        if i % 5 == 0:
            text.insert(r.randrange(len(text) + 1), f" {passage.capitalize()}  ")
        out.append((i, "\n".join(text), r.choice(["en", "de"]), r.choice(["web", "books", "code"])))
    for i in range(30):  # near copies, and copies with another passage of the shared kind
        base = out[r.randrange(240)][1].split(" ")
        base[r.randrange(len(base))] = "changed"
        out.append((300 + i, " ".join(base), "en", "web"))
    out += [(400, None, None, None), (401, "", "en", None), (402, "x" * 200_000, "en", "web"), (403, out[3][1], "en", "web"), (7, out[7][1], "en", "web"), (7, out[7][1], "en", "web")]
    out += [(None, out[9][1], "en", "web"), (None, None, None, None)]
    return out


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    table(spark, rows).write.parquet(f"{d}/documents.parquet")
    labels = [(i, int(any(w in (x or "") for w in INSULTS))) for i, x, _, _ in rows[:270]]
    spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def got(df):
    assert df.columns[:5] == pipe.COLUMNS
    return sorted(((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect()), key=str)


def test_toxic_documents_go_and_no_others(spark, rows, folder):
    out = got(pipe.clean(spark, table(spark, rows), folder))
    clean = [(i, x, a, b, None if x is None else len(x)) for i, x, a, b in rows if not any(w in (x or "") for w in INSULTS)]
    assert out == sorted(clean, key=str) and len(clean) < len(rows) - 20


def test_lines(spark, rows, folder):
    out = got(pipe.lines(spark, table(spark, rows), folder))
    key = lambda x: re.sub("[A-Z]", lambda m: m.group().lower(), x.strip(" \t\n\x0b\x0c\r"))
    holders: dict = {}
    for i, x, _, _ in rows:
        for k in {key(y) for y in (x or "").split("\n")}:
            if i is not None:
                holders.setdefault(k, set()).add(i)
    want = []
    for i, x, a, b in rows:
        keep = [y for y in (x or "").split("\n") if i is None or len(key(y)) < 40 or len(holders[key(y)]) < 5 or max(holders[key(y)]) == i]
        want.append((i, "\n".join(keep), a, b, len("\n".join(keep))))
    assert out == sorted(want, key=str) and sum(len(x or "") for _, x, _, _ in rows) - sum(w[4] for w in want) > 1000


def test_near_copies(spark, rows, folder):
    out = got(pipe.near_copies(spark, table(spark, rows), folder))
    comp = brute([(i, x) for i, x, _, _ in rows if i is not None], 5, 8, 10)
    assert sorted(r[0] for r in out if r[0] is not None) == sorted(i for i, (_, c) in comp.items() if c == i)
    assert sum(r[0] is None for r in out) == 2 and len(out) < len(rows) - 20
    assert {r[:4] for r in out} <= set(rows)


def test_mixing_keeps_what_the_probabilities_say(spark, rows, folder):
    df = table(spark, rows)
    out = got(pipe.mix(spark, df, folder))
    drawn = mixing.mixed(df, P.path("byte_bpe_50k.json"), keep=0.7).collect()
    assert out == sorted(((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in drawn if r.kept), key=str)
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    total = sum(len(library.encode(x or "", add_special_tokens=False).ids) for _, x, _, _ in rows)
    assert abs(sum(r.n_tokens * r.probability for r in drawn) / total - 0.7) < 1e-6 and 0 < len(out) < len(rows)


def test_tokens(spark, rows, folder):
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = pipe.tokens(spark, table(spark, rows), folder).collect()
    assert len(out) == len(rows) and all(r.decodes for r in out)
    assert all(list(r.ids) == own.encode_ordinary(r.text or "") and r.n_tokens == len(r.ids) for r in out)


def test_empty_tables(spark, folder):
    empty = table(spark, [])
    for name, stage in pipe.STAGES:
        assert stage(spark, empty, folder).count() == 0, name


def test_run_is_the_stages_one_after_the_other(spark, rows, folder):
    docs = table(spark, rows)
    for i, (_, stage) in enumerate(pipe.STAGES):
        docs = stage(spark, docs, folder)
        if i < len(pipe.STAGES) - 1:
            assert docs.columns == pipe.COLUMNS
            held = docs.collect()
            docs = spark.createDataFrame(held, SCHEMA)
    final = pipe.run(spark, folder)
    assert sorted(map(str, final.collect())) == sorted(map(str, docs.collect())) and final.count() > 20
    assert final.filter("NOT decodes").count() == 0


def test_run_leaves_nothing_but_its_result(spark, folder, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda _: f"file://{tmp_path}")
    final = pipe.run(spark, folder)
    assert final.count() > 20
    left = [str(x.relative_to(tmp_path)) for x in tmp_path.rglob("*.parquet")]
    assert left and all("/stage4/" in x for x in left)
