"""Reading and writing bars: CSV, Parquet datasets with date partitions, their statistics and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quality import PRICES, adjust_bars, align, validate_bars


def _within(df: DataFrame, start: str | None, end: str | None, tickers: list[str] | None) -> DataFrame:
    """Half-open [start, end) and the tickers: filters that reach the partitions and the Parquet scan."""
    if start:
        df = df.filter(F.col("date") >= F.lit(start).cast("date"))
    if end:
        df = df.filter(F.col("date") < F.lit(end).cast("date"))
    return df.filter(F.col("ticker").isin(tickers)) if tickers else df


def read_bars_csv(spark: SparkSession, path: str, tickers: list[str] | None = None, start: str | None = None, end: str | None = None, fields: list[str] | None = None) -> DataFrame:
    """Bars from one combined CSV or a folder of files named after tickers; header names lower-cased and stripped."""
    raw = spark.read.csv(path, header=True)
    df = raw.toDF(*[c.strip().lower().replace(" ", "_") for c in raw.columns])
    if "ticker" not in df.columns:
        df = df.withColumn("ticker", F.regexp_extract(F.input_file_name(), r"([^/]+?)\.csv", 1))
    numbers = [c for c in (*PRICES, "adj_close", "volume") if c in df.columns]
    typed = df.select(F.to_date("date").alias("date"), "ticker", *[F.col(c).cast("double").alias(c) for c in numbers])
    kept = [c for c in fields if c in numbers] if fields else numbers
    return _within(typed, start, end, tickers).select("date", "ticker", *kept)


def save_dataset(df: DataFrame, root: str, name: str, category: str, partition_col: str | None = "date") -> str:
    """Write under root/category/name, one folder a date; dates present in df replace those stored."""
    path = f"{root}/{category}/{name}"
    if partition_col:
        df.repartition(partition_col).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(partition_col).parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)
    return path


def load_dataset(spark: SparkSession, root: str, name: str, category: str, start: str | None = None, end: str | None = None, tickers: list[str] | None = None) -> DataFrame:
    return _within(spark.read.parquet(f"{root}/{category}/{name}"), start, end, tickers)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def purge_old_partitions(spark: SparkSession, path: str, cutoff: str) -> tuple[int, int]:
    """Delete the date= folders before cutoff; how many went and stayed. Only folder names are listed."""
    fs, p = _fs(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory() and s.getPath().getName().startswith("date=")]
    old = [n for n in names if n[5:] < cutoff]
    for n in old:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(p, n), True)
    return len(old), len(names) - len(old)


def storage_stats(spark: SparkSession, path: str) -> DataFrame:
    """(files, bytes, oldest, newest, partitions) of a dataset with date folders."""
    files = spark.read.parquet(path).select("date", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("b")).distinct()
    return files.agg(F.count("*").alias("files"), F.sum("b").alias("bytes"), F.min("date").alias("oldest"), F.max("date").alias("newest"), F.count_distinct("date").alias("partitions"))


def load_prices(spark: SparkSession, root: str, name: str, as_of: str, actions: DataFrame | None = None, start: str | None = None, tickers: list[str] | None = None) -> DataFrame:
    """Bars before as_of, adjusted where the stored set is not, validated; raises if an error rule is broken."""
    fs, p = _fs(spark, f"{root}/adjusted/{name}")
    if fs.exists(p):
        df = load_dataset(spark, root, name, "adjusted", start, as_of, tickers)
    else:
        df = load_dataset(spark, root, name, "raw", start, as_of, tickers)
        df = adjust_bars(df, actions) if actions is not None else df
    df = align(df, as_of)
    failed = validate_bars(df, as_of).filter("severity = 'error' AND failed").select("rule").collect()  # at most the rules
    if failed:
        raise ValueError(f"bars fail: {', '.join(r.rule for r in failed)}")
    return df


def append_rows(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Append audit rows or events as Parquet or JSON lines."""
    df.write.mode("append").format(kind).save(path)
