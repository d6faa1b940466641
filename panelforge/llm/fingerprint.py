"""Document fingerprints: an exact digest of the canonical text, made by DataFrame functions alone.

The canonical text is compatibility-composed (NFKC) and case-folded by the Unicode library that ships with Spark, with
each run of white space made one blank and the ends stripped. Its fingerprint is wide: two 64-bit xxhashes of different
seeds. Documents are grouped by it, and inside equal groups the canonical bytes are compared: a group that holds
different texts (a collision) tells them apart by a number after the hashes. Texts that are compared with documents
without being documents take the numbers of the equal ones.

Defined results: null and empty texts have the fingerprint of the empty text; repeated rows have equal fingerprints;
rows without an id, and those of one id, follow each other in one range; other columns pass through, and columns with the names of outputs are replaced; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Work

#: Seed of the second hash.
SEED = 7919
_WHITE = r"[\s\x0B\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"


def canonical(text: Column) -> Column:
    """NFKC, case folding, NFKC again (folding may leave uncomposed letters), white space folded, ends stripped."""
    t = F.coalesce(text, F.lit(""))
    plain = F.octet_length(t) == F.char_length(t)  # ASCII is composed already, and lower-casing folds it
    compose = lambda x: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))
    fold = lambda x: F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), x, F.lit(True))
    folded = F.when(plain, F.lower(t)).otherwise(compose(fold(compose(t))))
    return F.trim(F.regexp_replace(folded, _WHITE, " "))


def wide(canon: Column) -> Column:
    """The two hashes as 32 hex digits."""
    return F.lower(F.concat(F.lpad(F.hex(F.xxhash64(canon)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit(SEED), canon)), 16, "0")))


def collisions(df: DataFrame, hash_col: str = "fingerprint", canon_col: str = "canonical") -> DataFrame:
    """(hash, canonical, n) of the hashes that stand for more than one canonical text. The texts of a group are
    compared as bytes, each map task keeping one of those that are equal."""
    groups = df.groupBy(hash_col).agg(F.collect_set(canon_col).alias("texts")).filter(F.size("texts") > 1)
    return groups.select(hash_col, F.posexplode(F.array_sort("texts")).alias("n", canon_col))


def told_apart(df: DataFrame, found: DataFrame, hash_col: str = "fingerprint", canon_col: str = "canonical") -> DataFrame:
    """df with the numbers of collisions, as collisions() gives them, after its hashes."""
    known = found.select(F.col("fingerprint").alias("__hash"), F.col("canonical").alias("__text"), F.col("n").alias("__number"))
    met = df.join(known, (F.col(hash_col) == F.col("__hash")) & (F.col(canon_col) == F.col("__text")), "left")
    return met.withColumn(hash_col, F.concat_ws("-", hash_col, F.nullif("__number", F.lit(0)).cast("string"))).drop("__hash", "__text", "__number")


def hashed(df: DataFrame, text: str = "text", canon_col: str = "canonical", hash_col: str = "fingerprint") -> DataFrame:
    """df with the canonical text and its hashes, not yet told apart."""
    canon = df.withColumn(canon_col, canonical(F.col(text)))
    return canon.withColumn(hash_col, wide(F.col(canon_col)))


def fingerprints(df: DataFrame, text: str = "text", work: Work | None = None) -> tuple[DataFrame, DataFrame | None]:
    """df with the columns canonical and fingerprint, told apart by bytes inside equal hashes; and the collisions that
    there are among df's texts, for told_apart() to number other texts alike, or None."""
    own = hashed(df, text)
    found = (work or Work(df.sparkSession)).cut(collisions(own.select("fingerprint", "canonical")), "collisions")
    return (own, None) if found.isEmpty() else (told_apart(own, found), found)


def likeness(a: str, b: str, canon_a: Column, canon_b: Column) -> Column:
    """1 if fingerprints and canonical bytes are equal, else 0: an exact digest knows nothing between."""
    return F.when(F.col(a) == F.col(b), (canon_a == canon_b).cast("double")).otherwise(0.0)


def with_next(df: DataFrame, columns: list[str], id_col: str = "doc_id", buckets_each: int = 4) -> DataFrame:
    """df with next_<c> of the row that follows in descending order of id_col (the first after the last), nulls last,
    ties by the first of columns.

    Ids are cut into ranges at quantiles that are ids themselves, so the row a range needs from below it is the one
    that stands at the cut: it goes to both. One shuffle, and no task holds more than its ranges."""
    spark = df.sparkSession
    n = buckets_each * int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    cuts = df.select(key.alias("k")).agg(F.percentile_approx("k", [i / n for i in range(1, n + 1)], 10 * n), F.max("k")).first()
    if cuts[1] is None:
        return df.select("*", *[F.lit(None).cast(dict(df.dtypes)[c]).alias(f"next_{c}") for c in columns])
    ids = sorted({*cuts[0], cuts[1]})
    own, steps = F.lit(ids), [1 << i for i in reversed(range(len(ids).bit_length()))]

    def bisect(at: Column, step: Column) -> Column:
        """Towards the number of cuts below the id."""
        to = at + step
        return F.when((to <= len(ids)) & (F.element_at(own, F.least(to, F.lit(len(ids)))) < F.col("__k")), to).otherwise(at)

    ranged = df.withColumn("__k", key).withColumn("__range", F.aggregate(F.lit(steps), F.lit(0), bisect))
    at_cut = F.element_at(own, F.col("__range") + 1) == F.col("__k")
    above = F.when(F.col("__range") + 1 < len(ids), F.col("__range") + 1).otherwise(0)
    kept = F.struct(F.col("__range").alias("r"), F.lit(False).alias("ghost"))
    both = ranged.withColumn("__to", F.explode(F.when(at_cut, F.array(kept, F.struct(above.alias("r"), F.lit(True).alias("ghost")))).otherwise(F.array(kept))))
    # only the wrapped row stands below ids larger than its own
    wrapped = F.col("__to.ghost") & (F.col("__range") + 1 == len(ids))
    over = Window.partitionBy("__to.r").orderBy(wrapped, F.desc("__k"), *[F.xxhash64(c) for c in columns[:1]], F.col("__to.ghost"))
    return both.select("*", *[F.lead(c).over(over).alias(f"next_{c}") for c in columns]).filter(~F.col("__to.ghost")).drop("__k", "__range", "__to")
