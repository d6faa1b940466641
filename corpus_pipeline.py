"""A training corpus from raw documents: STAGES, each a function of (spark, docs, sf_dir) whose result is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.llm import byte_bpe, jaccard, line_dedup, mixing, toxicity
from panelforge.session import Work, scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document is rejected as toxic from this probability on.
TOXIC = 0.5


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject; it learns from the labels of documents it is given.

    Null and empty texts score as texts without any weighed word and stay; rows that repeat are judged alike, those
    without an id by their text; without labels nothing is rejected; an empty table gives no rows."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels)
    return toxicity.score(docs, model, out="score").filter(F.col("score") < TOXIC).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 code points or more that five documents or more hold stay in the one of the largest id.

    No document goes. A null text becomes the empty text it stands for; rows that repeat an id are one document when
    lines are counted; rows without an id keep their lines; n_chars is that of the new text."""
    kept = line_dedup.dedup_lines(docs, min_chars=40, min_docs=5)
    return kept.withColumn("text", F.col("kept")).withColumn("n_chars", F.char_length("kept").cast("long")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies (five-word shingles, similarity 0.8).

    Rows that repeat an id are one document, of which one row stays (the first by its text's hash and its other
    columns); texts without words link with nothing and stay; rows without an id stay."""
    work = Work(spark)
    linked = jaccard.classes(docs, k=5, num=8, den=10)
    others = work.cut(linked.filter("id <> comp").select(F.col("id").alias("doc_id")).distinct(), "others")
    again = work.cut(linked.filter("id IS NOT NULL").groupBy(F.col("id").alias("doc_id")).count().filter("count > 1").select("doc_id"), "again")
    kept = docs.join(others, "doc_id", "left_anti").select(*COLUMNS)
    if again.isEmpty():
        return kept
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "lang", "source", "n_chars"))
    ones = kept.join(again, "doc_id", "left_semi").withColumn("__k", first).filter("__k = 1").select(*COLUMNS)
    return kept.join(again, "doc_id", "left_anti").select(*COLUMNS).union(ones)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens lean towards equal parts of the sources, languages and topics.

    The draw is a seeded hash of id and text, so it is the same in every run and rows that repeat are drawn alike; null
    sources and languages are one category; texts without tokens share their cell's fate; an empty table gives none."""
    return mixing.mixed(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=0.7).filter("kept").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their ids, and whether these decode to the text. Null and empty texts have no ids."""
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = byte_bpe.encode(docs, ranks, pattern)
    both = byte_bpe.decode(coded, ranks, pattern)
    same = F.col("bytes") == F.coalesce("text", F.lit("")).cast("binary")
    return both.select(*COLUMNS, "ids", F.size("ids").cast("long").alias("n_tokens"), same.alias("decodes"))


STAGES = [("toxicity", clean), ("line dedup", lines), ("near copies", near_copies), ("mixing", mix), ("byte-level BPE", tokens)]

#: No SQL expresses the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents."""
    work = Work(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for i, (_, stage) in enumerate(STAGES):
        with scratch():  # what the stage's operators have written besides
            docs = work.cut(stage(spark, docs, sf_dir), f"stage{i}")
        if i:
            work.drop(f"stage{i - 1}")
    return docs
