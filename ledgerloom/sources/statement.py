"""Statement files: CSV with Spanish headers, to the canonical transaction table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules

# Header variants and their canonical names.
RENAMES = {"F.Valor": "Fecha Valor", "Fecha": "Fecha Operación", "Divisa_Importe": "Divisa", "Disponible": "Saldo"}
REQUIRED = ("Fecha Operación", "Concepto", "Importe")


def read_statement(spark: SparkSession, path: str) -> DataFrame:
    """Transactions of a ;-separated statement: typed, cleaned, categorised, with merchants.

    PDF files aren't supported. Amounts are Spanish decimals if any of the file's amounts has a comma, else plain ones.
    Rows without date, and repeated header rows, are dropped.
    """
    kind = os.path.splitext(path)[1].lower()
    if kind == ".pdf":
        raise NotImplementedError("PDF statements")
    if kind != ".csv":
        raise ValueError(f"unsupported format {kind}")
    raw = spark.read.option("sep", ";").option("header", True).csv(path)
    raw = raw.toDF(*(c.strip() for c in raw.columns))
    raw = raw.withColumnsRenamed({k: v for k, v in RENAMES.items() if k in raw.columns and v not in raw.columns})
    if missing := [c for c in REQUIRED if c not in raw.columns]:
        raise ValueError(f"missing columns {missing}")
    rows = raw.where(F.col("Fecha Operación").isNotNull() & ~F.col("Fecha Operación").rlike("(?i)Fecha|F.Valor") & ~F.col("Concepto").eqNullSafe("Concepto"))
    spanish = bool(rows.where(F.col("Importe").contains(",")).limit(1).count())
    number = rules.spanish_decimal if spanish else (lambda c: c.try_cast("double"))
    date = lambda c: F.coalesce(F.try_to_date(c, "dd/MM/yyyy"), F.try_to_date(c, "yyyy-MM-dd"))
    column = lambda name, default=None: F.col(f"`{name}`") if name in rows.columns else F.lit(default).cast("string")
    text = rules.stripped(F.col("Concepto"))
    out = rows.select(date(F.col("Fecha Operación")).alias("date"), date(column("Fecha Valor")).alias("value_date"), text.alias("description"), rules.clean_description(F.col("Concepto")).alias("description_clean"), number(F.col("Importe")).alias("amount"), F.coalesce(column("Divisa"), F.lit("EUR")).alias("currency"), F.coalesce(column("Movimiento"), F.lit("OTROS")).alias("bbva_category"), F.coalesce(column("Observaciones"), F.lit("")).alias("notes"), number(column("Saldo")).alias("balance"))
    return out.where("date is not null and amount is not null").withColumns({"category": rules.categorise(F.col("description"), F.col("amount")), "merchant": rules.merchant(F.col("description"))})
