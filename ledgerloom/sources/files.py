"""JSON, separated text and GraphML files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_json(spark: SparkSession, path: str, envelopes: tuple[str, ...] = ("transactions", "data")) -> DataFrame:
    """Rows of JSON files: the array under the first of `envelopes` that is there, else the top-level objects."""
    raw = spark.read.option("multiLine", True).json(path)
    for name in envelopes:
        if name in raw.columns:
            return raw.select(F.inline(name))
    return raw


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, ("chunks", "documents"))


def read_separated(spark: SparkSession, path: str, separators: str = ";,\t") -> DataFrame:
    """Text columns of a file, by the first separator that gives several; ValueError where none does."""
    for sep in separators:
        rows = spark.read.option("sep", sep).option("header", True).csv(path)
        if len(rows.columns) > 1:
            return rows.toDF(*(c.strip() for c in rows.columns))
    raise ValueError(f"no separator of {separators!r} fits {path}")


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices (id) and edges (src, dst) of GraphML files."""
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    return read("node", "_id string").select(F.col("_id").alias("id")), read("edge", "_source string, _target string").select(F.col("_source").alias("src"), F.col("_target").alias("dst"))
