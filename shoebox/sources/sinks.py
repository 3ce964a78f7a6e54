"""Exports and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(rows: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV with a header; one file only where the caller knows the rows are few."""
    (rows.coalesce(1) if one_file else rows).write.mode("overwrite").option("header", "true").csv(path)


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """One Parquet table for each name."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{folder}/{name}")


def append_lines(rows: DataFrame, path: str) -> None:
    """Append rows as JSON lines."""
    rows.write.mode("append").json(path)


def undo_plan(spark: SparkSession, path: str) -> DataFrame:
    """(seq, from, to) of a manifest in the order in which moves are taken back, with the ends changed over."""
    m = spark.read.schema("seq bigint, `from` string, `to` string").json(path)
    return m.select("seq", F.col("to").alias("from"), F.col("from").alias("to")).orderBy(F.desc("seq"))


def folder_bytes(spark: SparkSession, path: str) -> DataFrame:
    """(files, bytes) below a folder, from metadata alone."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("length")
    return found.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
