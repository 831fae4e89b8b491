"""Refinement of categories, memory of merchants, and the records that go to retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spanish names of the categories.
SPANISH = {
    "Groceries": "alimentacion", "Food & Dining": "restaurantes", "Transportation": "transporte", "Shopping": "compras",
    "Entertainment": "ocio", "Sports": "deportes", "Healthcare": "salud", "Housing": "vivienda", "Utilities": "servicios_basicos",
    "Services": "servicios", "Education": "educacion", "Tech & Software": "tecnologia", "Income": "ingresos", "Savings": "ahorro",
    "Loan": "prestamos", "Taxes": "impuestos", "Fees": "comisiones", "Transfers": "transferencias",
    "Internal Transfer": "transferencia_interna", "ATM": "efectivo", "Donations": "donaciones", "Vending": "vending", "Other": "otros",
}
# Words of the categoriser used when no model answers.
FALLBACK = (("Groceries", "mercadona|carrefour|supermercado"), ("Food & Dining", "restaurante|mcdonald|cafe|bar"), ("Transfers", "transferencia"))
# Categories whose amounts are negative as a rule.
NEGATIVE = ("Savings", "Taxes", "Loan")


def spanish_category(c: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in SPANISH.items() for x in pair))
    return F.coalesce(F.try_element_at(table, c), F.lit("otros"))


def fallback_category(description: Column, amount: Column) -> Column:
    low = F.lower(F.coalesce(description, F.lit("")))
    return F.coalesce(F.when(amount > 0, F.lit("Income")), *(F.when(low.rlike(p), F.lit(v)) for v, p in FALLBACK), F.lit("Other"))


def resolve_category(df: DataFrame, amount: str = "amount") -> Column:
    """The first filled of category, Categoria and category_name, else a name by sign (0 counts as an expense)."""
    given = [F.col(c) for c in ("category", "Categoria", "category_name") if c in df.columns]
    return F.coalesce(*given, F.when(F.col(amount) > 0, F.lit("Uncategorized Income")).otherwise(F.lit("Uncategorized Expense")))


def validate(df: DataFrame) -> DataFrame:
    """Adjusts category and confidence of rows (category, amount, confidence, merchant), and says why."""
    category, amount = F.col("category"), F.col("amount")
    wrong_income, wrong_sign = (category == "Income") & (amount < 0), category.isin(*NEGATIVE) & (amount > 0)
    internal = F.lower(F.coalesce("merchant", F.lit(""))).contains("traspaso") & (F.coalesce(category, F.lit("")) != "Internal Transfer")
    lowered = F.col("confidence") * F.when(wrong_income, 0.7).otherwise(1.0) * F.when(wrong_sign, 0.8).otherwise(1.0)
    reasons = F.array(F.when(wrong_income, F.lit("Income usually positive")), F.when(wrong_sign, F.concat(category, F.lit(" usually negative"))), F.when(internal, F.lit("Detected as internal transfer")))
    return df.withColumns({"adjustments": F.array_join(reasons, "; "), "confidence": F.least(F.when(internal, 0.9).otherwise(lowered), F.lit(0.95)), "category": F.when(internal, F.lit("Internal Transfer")).otherwise(category)})


def rag_records(df: DataFrame) -> DataFrame:
    """Records for retrieval; internal transfers are left out, and ids keep their gaps."""
    kept = df.where(~F.col("category").eqNullSafe("Internal Transfer"))
    return kept.select("txn_id", F.date_format("date", "yyyy-MM-dd").alias("fecha"), F.abs("amount").alias("importe"), F.when(F.col("amount") < 0, "gasto").otherwise("ingreso").alias("tipo"), spanish_category(F.col("category")).alias("categoria"))


def compact_line(key: Column, date: Column, description: Column, amount: Column) -> Column:
    """id|date|first 50 characters|sign, euro and amount."""
    return F.concat_ws("|", key.cast("string"), F.coalesce(F.date_format(date, "yyyy-MM-dd"), F.lit("N/A")), F.substring(F.coalesce(description, F.lit("")), 1, 50), F.concat(F.when(amount > 0, "+").otherwise("-"), F.format_string("€%.2f", F.abs(amount))))


def redact(notes: Column) -> Column:
    """Of long notes every occurrence of the first 20 characters becomes ****; short notes become **** whole."""
    return F.when(F.length(notes) > 20, F.replace(notes, F.substring(notes, 1, 20), F.lit("****"))).when(notes.isNotNull(), F.lit("****"))


def memory_key(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"^\s+|\s+$", ""))


def upsert_memory(memory: DataFrame | None, seen: DataFrame, least: float = 0.6) -> DataFrame:
    """key, name, category, confidence, last_updated, frequency: the latest of each key, sightings added up.

    Only sightings (name, category, confidence, last_updated) above `least` are kept. Ties go to the greater row.
    """
    columns = ["name", "category", "confidence", "last_updated"]
    new = seen.where((F.col("confidence") > least) & F.col("name").isNotNull()).select(memory_key(F.col("name")).alias("key"), *columns, F.lit(1).cast("long").alias("frequency"))
    rows = new if memory is None else memory.select("key", *columns, "frequency").unionByName(new)
    latest = rows.groupBy("key").agg(F.max(F.struct("last_updated", "name", "category", "confidence")).alias("x"), F.sum("frequency").alias("frequency"))
    return latest.select("key", *(F.col(f"x.{c}").alias(c) for c in columns), "frequency")


def recall(df: DataFrame, memory: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Rows with the memory's category (remembered) where its entry is younger than `days` whole days, else null."""
    fresh = memory.where(F.floor((now.cast("long") - F.col("last_updated").cast("long")) / 86400) < days).select("key", F.col("category").alias("remembered"))
    return df.withColumn("key", memory_key(F.col("merchant"))).join(fresh, "key", "left").drop("key")


def write_back(df: DataFrame, refined: DataFrame, least: float = 0.5) -> DataFrame:
    """Takes over refined categories by (description, amount) where they aren't Other and confidence is above `least`."""
    good = refined.where((F.col("category") != "Other") & (F.col("confidence") > least))
    best = good.groupBy("description", "amount").agg(F.max_by("category", F.struct("confidence", "category")).alias("refined"))
    return df.join(best, ["description", "amount"], "left").withColumn("category", F.coalesce("refined", "category")).drop("refined")


def validity(df: DataFrame) -> DataFrame:
    """One row: rows, whether valid (any rows), uncategorised rows with their percentage, and the warning above 30 %."""
    other = F.count_if(F.col("category") == "Other")
    n = F.count("*")
    return df.agg(n.alias("n"), (n > 0).alias("is_valid"), other.alias("uncategorised"), F.coalesce(F.round(100.0 * other / F.nullif(n, F.lit(0)), 4), F.lit(0.0)).alias("percent"), (other > 0.3 * n).alias("warn"))


def embedding_text(kind: Column, text: Column, name: Column, part: Column) -> Column:
    """A chunk's text with what its kind is told by: period, category and subcategory, merchant or pattern."""
    text = F.coalesce(text, F.lit(""))
    told = lambda prefix: F.when(F.coalesce(name, F.lit("")) != "", F.concat(F.lit(prefix), name, F.lit("] "), text))
    category = F.concat(F.lit("["), F.coalesce(name, F.lit("unknown")), F.when(F.coalesce(part, F.lit("")) != "", F.concat(F.lit(" - "), part)).otherwise(""), F.lit("] "), text)
    return F.coalesce(F.when(kind == "temporal", told("[Período: ")), F.when(kind == "categorical", category), F.when(kind == "entity", told("[Comercio: ")), F.when(kind == "pattern", told("[Patrón ")), text)


def embedding_cost(texts: DataFrame, column: str = "text", price: float = 0.00002) -> DataFrame:
    """One row: chunks, characters, tokens (four characters each) and their cost at `price` for a thousand tokens."""
    chars = F.coalesce(F.sum(F.length(column)), F.lit(0)).cast("long")
    return texts.agg(F.count("*").alias("chunks"), chars.alias("chars"), (chars / 4).alias("tokens"), F.round(chars / 4 / 1000 * price, 8).alias("cost"))
