"""Measures of a run: accuracy, throughput, comparisons of classifiers; batches, chronology and documents to embed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import ledger as L
from .refine import SPANISH

#: Prices of a thousand tokens that a language model reads and writes, and the share of tokens that it reads.
READ_PRICE, WRITE_PRICE, READ_SHARE = 0.00005, 0.0004, 0.7


def unresolved(df: DataFrame) -> DataFrame:
    """Rows without a category, or with Other."""
    return df.where(F.coalesce(F.col("category"), F.lit("")).isin("", "Other"))


def whitelisted(category: Column, confidence: Column, failed: Column) -> tuple[Column, Column]:
    """Category and confidence of a model's answer: failures give Other at 0.2, unknown names Other at 0.3."""
    good = F.coalesce(category.isin(*SPANISH), F.lit(False))
    failed = F.coalesce(failed, F.lit(False))
    name = F.when(failed | ~good, F.lit("Other")).otherwise(category)
    return name, F.when(failed, F.lit(0.2)).when(~good, F.lit(0.3)).otherwise(confidence)


def merged(df: DataFrame, answers: DataFrame, on: str = "txn_id") -> DataFrame:
    """df with the category and confidence of a classifier's answers by id; rows without an answer keep their category."""
    given = answers.select(on, F.col("category").alias("_category"), F.col("confidence").alias("_confidence"))
    out = df.join(given, on, "left")
    return out.withColumns({"category": F.coalesce("_category", "category"), "confidence": F.coalesce("_confidence", F.lit(0.0))}).drop("_category", "_confidence")


def compared(a: DataFrame, b: DataFrame, on: str = "txn_id") -> DataFrame:
    """One row: rows that two classifiers have in common, how many agree (null equals null), and their share."""
    both = a.select(on, F.col("category").alias("ca")).join(b.select(on, F.col("category").alias("cb")), on)
    same = F.count_if(F.col("ca").eqNullSafe(F.col("cb")))
    return both.agg(F.count("*").alias("rows"), same.alias("agree"), F.round(100.0 * same / F.nullif(F.count("*"), F.lit(0)), 4).alias("percent"))


def accuracy(df: DataFrame, before: str, after: str) -> DataFrame:
    """One row: the percentages of rows that are not Other before and after a step, and the improvement."""
    share = lambda c: 100.0 * F.avg((F.coalesce(F.col(c), F.lit("Other")) != "Other").cast("double"))
    return df.agg(F.round(share(before), 4).alias("before"), F.round(share(after), 4).alias("after")).withColumn("improvement", F.round(F.col("after") - F.col("before"), 4))


def category_change(df: DataFrame, before: str, after: str) -> DataFrame:
    """category, n, percent of all rows, delta against the count before."""
    sides = F.explode(F.array(F.struct(F.col(after).alias("category"), F.lit(1).alias("n"), F.lit(0).alias("b")), F.struct(F.col(before).alias("category"), F.lit(0).alias("n"), F.lit(1).alias("b"))))
    counts = df.select(sides.alias("x")).groupBy("x.category").agg(F.sum("x.n").alias("n"), F.sum("x.b").alias("b"))
    total = df.agg(F.count("*").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("category", "n", F.round(100.0 * F.col("n") / F.col("total"), 4).alias("percent"), (F.col("n") - F.col("b")).alias("delta"))


def model_cost(df: DataFrame, text: str, seconds: float, other: float = 10.0) -> DataFrame:
    """One row: tokens (four characters each), cost at the model's prices, rows a second, cost a row, percent saved against
    a model that is `other` times as dear."""
    rows = df.agg(F.count("*").alias("rows"), (F.coalesce(F.sum(F.length(text)), F.lit(0)) / 4).alias("tokens"))
    cost = F.col("tokens") / 1000 * (READ_SHARE * READ_PRICE + (1 - READ_SHARE) * WRITE_PRICE)
    out = rows.withColumn("cost", F.round(cost, 8)).withColumn("per_second", F.round(F.col("rows") / F.lit(seconds), 4))
    return out.withColumn("per_row", F.round(cost / F.nullif(F.col("rows"), F.lit(0)), 10)).withColumn("saved_percent", F.round(100.0 * (1 - F.lit(1.0) / F.lit(other)), 4))


def period(df: DataFrame) -> DataFrame:
    """One row: first and last date and number of rows."""
    return df.agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("rows"))


def out_of_order(df: DataFrame) -> DataFrame:
    """One row: days whose rows, by txn_id, start before an earlier row's last date; 0 if the ledger is in order.

    Rows are summed up in blocks of ids first, so that only one row a block is sorted in one task.
    """
    block = (F.col("txn_id") / 4096).cast("long")
    inside = W.partitionBy("_block").orderBy("txn_id")
    rows = df.where("date is not null").select("txn_id", "date", block.alias("_block")).withColumn("_last", F.lag("date").over(inside))
    blocks = rows.groupBy("_block").agg(F.count_if(F.col("_last") > F.col("date")).alias("bad"), F.min_by("date", "txn_id").alias("first"), F.max_by("date", "txn_id").alias("end"))
    edges = blocks.withColumn("_before", F.lag("end").over(W.orderBy("_block")))
    return edges.agg(F.coalesce(F.sum(F.col("bad") + (F.coalesce(F.col("_before") > F.col("first"), F.lit(False))).cast("long")), F.lit(0)).alias("out_of_order"))


def numbered(df: DataFrame, order: tuple[str, ...] = ("date", "txn_id"), batch: int = 20) -> DataFrame:
    """df with position (from 0, by order) and batch number, without a sort in one task: days are counted first."""
    first, *rest = order
    counts = df.groupBy(first).agg(F.count("*").alias("_n"))
    before = counts.select(F.col(first).alias("_first"), F.coalesce(F.sum("_n").over(W.orderBy(F.col(first).asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy(first).orderBy(*rest)) - 1
    out = df.withColumn("position", inside).join(before, F.col(first).eqNullSafe(F.col("_first"))).withColumn("position", F.col("position") + F.col("_before"))
    return out.withColumn("batch", F.floor(F.col("position") / batch)).drop("_first", "_before")


def income_sources(df: DataFrame) -> DataFrame:
    """year, month, category, income."""
    return L.calendar(df).where("amount > 0").groupBy("year", "month", "category").agg(F.round(F.sum("amount"), 2).alias("income"))


def documents(chunks: DataFrame) -> DataFrame:
    """doc_id, text and metadata of chunks that have a text: what retrieval stores, with defaults for what is missing."""
    rows = chunks.where(F.length(F.coalesce(F.trim("text"), F.lit(""))) > 0)
    return rows.select(F.col("chunk_id").alias("doc_id"), "text", F.coalesce("chunk_type", F.lit("unknown")).alias("chunk_type"), F.coalesce("key", F.lit("")).alias("key"), F.length("text").alias("chars"), F.ceil(F.length("text") / 4).cast("int").alias("tokens"))


def context_text(chunks: DataFrame) -> DataFrame:
    """chunk_id and the text that goes into a graph: its type, key and text on lines of their own."""
    line = lambda label, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"{label}: "), F.col(c)))
    return chunks.select("chunk_id", F.concat_ws("\n", line("Tipo", "chunk_type"), line("Clave", "key"), line("Contenido", "text")).alias("context"))


def to_embed(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """key and text of the distinct texts whose md5 is not in the cache (key)."""
    rows = chunks.where("text is not null").select(F.md5("text").alias("key"), "text").dropDuplicates(["key"])
    return rows.join(cache.select("key"), "key", "left_anti")


def embedded(texts: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts with their vectors, and those whose embedding failed, with the reason."""
    both = texts.join(vectors, "key", "left")
    return both.where("vector is not null"), both.where("vector is null").withColumn("error", F.coalesce("error", F.lit("no embedding")))


def sources(chunks: DataFrame, df: DataFrame) -> DataFrame:
    """chunk_id, transactions, total: what the transactions named by a chunk (transaction_ids) sum up to."""
    ids = chunks.select("chunk_id", F.explode("transaction_ids").alias("txn_id")).distinct()
    return ids.join(df.select("txn_id", "amount"), "txn_id").groupBy("chunk_id").agg(F.count("*").alias("transactions"), F.round(F.sum("amount"), 2).alias("total"))


def direct_amount(c: Column) -> Column:
    """The amount of a statement line that names its currency: EUR goes, a comma is the decimal point."""
    return F.regexp_replace(F.trim(F.regexp_replace(c, "EUR", "")), ",", ".").try_cast("double")


def date_names(df: DataFrame) -> DataFrame:
    """txn_id with its weekday's and month's name and the long date."""
    return df.select("txn_id", F.date_format("date", "EEEE").alias("weekday"), F.date_format("date", "MMMM yyyy").alias("month"), F.date_format("date", "MMMM dd, yyyy").alias("long_date"))


def outcomes(df: DataFrame) -> DataFrame:
    """method, n: by what means rows got their category, in counts."""
    return df.groupBy("method").agg(F.count("*").alias("n"))


def category_profiles(df: DataFrame) -> DataFrame:
    """category, weekday, spent: the weekday sums of a category's expenses (0 counts as one)."""
    return df.where(F.col("amount") <= 0).groupBy("category", F.weekday("date").alias("weekday")).agg(F.round(F.sum(F.abs("amount")), 2).alias("spent"), F.count("*").alias("n"))
