"""The operators applied to the given tables with production parameters, and SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, byte_bpe, fingerprint, jaccard, line_dedup, mixing, packing, resampling, shards, token_counts, token_files, topk, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, docs = public_tokenizers.path("byte_bpe_50k.tiktoken"), table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN)
    both = byte_bpe.decode(coded, ranks, public_tokenizers.PATTERN)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        byte_bpe.ids_digest("ids").alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", topk.quantised(F.col("embedding")).alias("v"))
    return topk.top_k(vectors.filter("vec_id % 20 = 0"), vectors, k=20)


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shards.shuffled(docs, shards=24).select(
        "doc_id",
        "size",
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "slot",
        "grown_shard",
    )


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own, found = fingerprint.fingerprints(docs)
    both = fingerprint.with_next(own.drop("canonical"), ["text", "fingerprint"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = both.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    hashed = fingerprint.hashed(edited, "edited", "edited_canonical", "edited_fingerprint")
    hashed = fingerprint.told_apart(hashed, found, "edited_fingerprint", "edited_canonical") if found else hashed
    own, following = fingerprint.canonical(F.col("text")), fingerprint.canonical(F.col("next_text"))
    return hashed.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        fingerprint.likeness("fingerprint", "edited_fingerprint", own, F.col("edited_canonical")).alias("near_edited"),
        fingerprint.likeness("fingerprint", "next_fingerprint", own, following).alias("near_next"),
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.dedup_lines(docs, min_chars=40, min_docs=5)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP5_SQL = """
WITH lines AS (
  SELECT doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
), common AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT l.doc_id, l.line, l.pos, c.key IS NOT NULL AND l.doc_id < c.keeper AS dropped
  FROM lines l LEFT JOIN common c ON l.key = c.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = jaccard.classes(table(spark, sf_dir, "documents"), k=3, num=90, den=100)
    return linked.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"))


OP6_SQL = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3
    THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))
    WHEN len(w) > 0 THEN ['' || array_to_string(w, ' ')] ELSE [] END) AS g FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), links AS (
  SELECT p.doc_id AS a, q.doc_id AS b
  FROM grams p JOIN grams q ON p.g = q.g AND p.doc_id < q.doc_id
  JOIN sizes s ON s.doc_id = p.doc_id JOIN sizes t ON t.doc_id = q.doc_id
  GROUP BY p.doc_id, q.doc_id, s.n, t.n
  HAVING 100 * count(*) >= 90 * (s.n + t.n - count(*))
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  WITH RECURSIVE r AS (
    SELECT doc_id AS a, doc_id AS b FROM documents
    UNION SELECT r.a, e.b FROM r JOIN edges e ON r.b = e.a
  ) SELECT a, min(b) AS least FROM r GROUP BY a
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, reach.least AS component_id
FROM documents d LEFT JOIN sizes s ON d.doc_id = s.doc_id JOIN reach ON reach.a = d.doc_id
"""


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    read = token_files.store(docs, public_tokenizers.path("word_bpe_49k.json"), size=49_408, end_id=2)
    return read.select("doc_id", "start", F.expr("length(ids) div 4").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter(~held_out).select("doc_id", "toxic"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.mixed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep=0.7)
    return drawn.select("doc_id", "source", "lang", "topic", "n_tokens", "weight", "probability", "kept")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counted = token_counts.token_counts(docs, public_tokenizers.path("word_bpe_49k.json"))
    return counted.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text")
    return resampling.resampled(docs, target, percent=25, size=10_000, least_words=20, seed=7)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = alignment.linked(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.withColumnRenamed("id", "doc_id")


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    each = packing.pieces(packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"), size=2048, end_id=1))
    return each.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_exact_topk": op2_exact_topk,
    "op3_shards": op3_shards,
    "op4_fingerprints": op4_fingerprints,
    "op5_line_dedup": op5_line_dedup,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_token_files": op7_token_files,
    "op8_toxicity": op8_toxicity,
    "op9_mixing": op9_mixing,
    "op10_token_counts": op10_token_counts,
    "op11_resampling": op11_resampling,
    "op12_alignment": op12_alignment,
    "op13_packing": op13_packing,
}

ORACLE_SQL = {
    "op2_exact_topk": OP2_SQL,
    "op5_line_dedup": OP5_SQL,
    "op6_jaccard_join": OP6_SQL,
}
