"""A corpus pipeline of five of the operators: each stage's output is written as Parquet and read by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import jaccard, language, mixing, queries, sentencepiece, toxicity
from ledgerloom.llm.common import shared_dir, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.3; the model learns from all labelled documents but the held-out."""
    model = toxicity.fit_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without words or of unknown letters go."""
    return language.keep_known(docs, language.fit_languages(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.75 or more."""
    return jaccard.drop_near_copies(docs)


def mix_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that the languages' tokens approach their tempered shares; a row may come several times."""
    return mixing.sample_mixed(docs, mixing.fit_domains(docs, table(spark, sf_dir, "labels"), F.col("lang")))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece ids and their number of every document."""
    encoded = sentencepiece.encode(docs, sentencepiece.load_pieces(queries.pieces_path()))
    return encoded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_pieces"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_known_languages),
    ("ngram_jaccard_join", drop_near_copies),
    ("mixing", mix_languages),
    ("sentencepiece", encode_pieces),
]

#: The stages learn models from the data; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; what each returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline/{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
