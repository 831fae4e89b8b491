"""The operators over their whole tables with production parameters, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, html, jaccard, language, mixing, quality, sentencepiece, topk, toxicity, urls
from .common import held_out, table

#: The vocabulary file of op1 and of the pipeline's last stage.
PIECES = "piece_bpe_32k.model"


def pieces_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(PIECES)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.round_trip(table(spark, sf_dir, "documents"), sentencepiece.load_pieces(pieces_path()))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.score_quality(documents, labels, quality.fit_quality(documents, labels))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return mixing.mix(documents, mixing.fit_domains(documents, labels, F.col("lang")), ["doc_id"])


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.score_toxicity(documents, toxicity.fit_toxicity(documents, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_pages(table(spark, sf_dir, "pages"), language.fit_languages(table(spark, sf_dir, "documents")))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_topk(table(spark, sf_dir, "embeddings"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_quality, op3_mixing, op4_url_filter, op5_html_text, op6_jaccard, op7_toxicity, op8_language, op9_exact_topk, op10_nearest)}

ORACLES = {"op4_url_filter": urls.oracle_sql(), "op9_exact_topk": topk.ORACLE_SQL}
