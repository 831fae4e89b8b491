"""Sinks: transactions, retrieval records and chunks as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_chunks_by_type(chunks: DataFrame, path: str) -> None:
    """One folder for each chunk_type."""
    chunks.write.mode("overwrite").partitionBy("chunk_type").json(path)


def chunk_report(chunks: DataFrame) -> DataFrame:
    """Chunks and characters by type."""
    return chunks.groupBy("chunk_type").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"))
