"""Questions to a ledger: what is asked for, and the tables that answer it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import graph
from . import ledger as L
from .chunks import euros, recurring_summary

# Words of a question (without accents) that tell what is asked for, in order of priority.
INTENTS = (("analysis", "patron|tendencia|ahorr|analisis|analiza|compar|evolucion"), ("aggregation", "cuanto|total|suma|promedio|media|balance"), ("search", "muestra|lista|busca|encuentra|cuales|que gastos|transacciones"))
# The months as questions name them.
MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")
# Questions that users ask.
EXAMPLES = (
    "¿Cuánto gasté en total?", "¿Cuánto gasté en Groceries?", "¿Cuánto gasté en Entertainment?", "Muestra mis transacciones de julio",
    "Muestra mis gastos de julio", "¿Qué patrones de gasto tengo?", "¿Cuál es la tendencia de mis gastos?", "¿Dónde puedo ahorrar dinero?",
    "Lista mis gastos recurrentes", "Busca gastos mayores de 100 euros", "Muestra los gastos del fin de semana",
)
#: Categories that a household can't do without; the rest of the spending may be saved in part.
ESSENTIAL = ("Groceries", "Housing", "Utilities", "Healthcare", "Taxes", "Loan", "Transportation", "Education")


def plain(c: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(F.coalesce(c, F.lit(""))), "áéíóúüñ¿?¡!", "aeiouun")


def intent(question: Column) -> Column:
    text = plain(question)
    return F.coalesce(*(F.when(text.rlike(p), F.lit(v)) for v, p in INTENTS), F.lit("search"))


def routed(questions: DataFrame, categories: list[str]) -> DataFrame:
    """questions (question) with type, category, month, least (amount), weekend and recurring, as far as they name them.

    categories: the names that a question may hold, at whatever case.
    """
    text = plain(F.col("question"))
    named = [F.when(text.contains(plain(F.lit(c))), F.lit(c)) for c in categories]
    month = [F.when(text.rlike(rf"\b{m}\b"), F.lit(i)) for i, m in enumerate(MONTHS, 1)]
    least = F.regexp_extract(text, r"(?:mayor(?:es)?|mas) (?:de|a|que) (\d+(?:\.\d+)?)", 1)
    return questions.select(
        "question", intent(F.col("question")).alias("type"), F.coalesce(*named, F.lit(None).cast("string")).alias("category"), F.coalesce(*month).alias("month"),
        F.when(least != "", least.cast("double")).alias("least"), text.contains("fin de semana").alias("weekend"), text.contains("recurrente").alias("recurring"),
    )


def aggregation(df: DataFrame) -> DataFrame:
    """category (null for all), value, transactions and answer: what was spent in all and in each category."""
    out = df.where(L.spent()).rollup("category").agg(F.grouping("category").alias("_all"), F.round(F.sum(-L.amount()), 2).alias("value"), F.count("*").alias("transactions"))
    name = F.when(F.col("_all") == 0, F.coalesce("category", F.lit("Other")))
    text = F.concat(F.lit("Gasto total"), F.coalesce(F.concat(F.lit(" en "), name), F.lit("")), F.lit(": €"), euros(F.col("value")), F.lit(" ("), F.col("transactions").cast("string"), F.lit(" transacciones)"))
    return out.select(name.alias("category"), "value", "transactions", text.alias("answer"))


def search(df: DataFrame, category: str | None = None, month: int | None = None, merchant: str | None = None, least: float | None = None, weekend: bool = False, recurring: bool = False) -> DataFrame:
    """The transactions asked for; all conditions are filters that reach the scan, but for recurring merchants."""
    if category is not None:
        df = df.where(F.col("category") == category)
    if month is not None:
        df = df.where(F.month("date") == month)
    if merchant is not None:
        df = df.where(plain(F.col("merchant")).contains(merchant.lower()))
    if least is not None:
        df = df.where(F.abs("amount") > least)
    if weekend:
        df = df.where(F.weekday("date") >= 5)
    if recurring:
        known = L.recurrence(df.where(F.col("amount") <= 0)).where("kind != 'none'").select("merchant")
        df = df.join(known, "merchant", "left_semi")
    return df


def patterns(df: DataFrame, k: int = 3) -> DataFrame:
    """One row: the k categories of most spending with it, in order, and the spending at recurring merchants."""
    top = df.where(L.spent()).groupBy("category").agg(F.round(F.sum(-L.amount()), 2).alias("spent")).orderBy(F.desc("spent"), "category").limit(k)
    items = F.array_sort(F.collect_list(F.struct((-F.col("spent")).alias("s"), "category")))
    told = top.agg(F.array_join(F.transform(items, lambda x: F.concat(x["category"], F.lit(" "), euros(-x["s"]))), ", ").alias("top_categories"))
    return told.crossJoin(recurring_summary(df).select(F.col("total").alias("recurring_total")))


def savings(df: DataFrame, rate: float = 0.2, essential: tuple[str, ...] = ESSENTIAL) -> DataFrame:
    """category, monthly, potential: spending a month (by months of the ledger) outside essentials, and rate of it."""
    months = df.where("date is not null").agg(F.countDistinct(F.year("date"), F.month("date")).alias("months"))
    rows = df.where(L.spent() & ~F.coalesce(F.col("category").isin(*essential), F.lit(False))).groupBy("category").agg(F.sum(-L.amount()).alias("s"))
    monthly = F.col("s") / F.col("months")
    return rows.crossJoin(F.broadcast(months)).select("category", F.round(monthly, 2).alias("monthly"), F.round(monthly * rate, 2).alias("potential"))


def trend(df: DataFrame) -> DataFrame:
    """month, spent, before, change (percent) and trend of each month against the one before; months are few."""
    months = df.where("date is not null").groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(L.money(F.sum(L.expense())).alias("spent"))
    rows = months.withColumn("before", F.lag("spent").over(W.orderBy("month")))
    change = F.when(F.col("before") > 0, F.round(100.0 * (F.col("spent") - F.col("before")) / F.col("before"), 4))
    name = F.when(change > 5, "creciente").when(change < -5, "decreciente").when(change.isNotNull(), "estable")
    return rows.withColumn("change", change).withColumn("trend", name)


def demo_summary(df: DataFrame, k: int = 3) -> DataFrame:
    """rank, category, spent, share (percent) of the k dearest categories, with the ledger's expenses, income and balance."""
    all_ = df.agg(L.money(F.sum(L.expense())).alias("expenses"), L.money(F.sum(F.when(L.amount() > 0, L.amount()))).alias("income"))
    top = df.where(L.spent()).groupBy("category").agg(F.round(F.sum(-L.amount()), 2).alias("spent")).orderBy(F.desc("spent"), "category").limit(k)
    rows = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("spent")).alias("s"), "category"))).alias("x")).select(F.posexplode("x").alias("p", "x"))
    out = rows.crossJoin(F.broadcast(all_))
    return out.select((F.col("p") + 1).alias("rank"), F.col("x.category").alias("category"), (-F.col("x.s")).alias("spent"), F.round(-100.0 * F.col("x.s") / F.col("expenses"), 4).alias("share"), "expenses", "income", F.round(F.col("income") - F.col("expenses"), 2).alias("balance"))


def _terms(c: Column, terms: list[str]) -> Column:
    low = plain(c)
    return sum((low.contains(t.lower()).cast("int") for t in terms), F.lit(0))


def local(edges: DataFrame, terms: list[str]) -> DataFrame:
    """id, score: vertices that hold a term (2 for each), and their neighbours (1 for each edge to one)."""
    pairs = graph.canonical(edges)
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("other")).unionAll(pairs.select(F.col("b").alias("id"), F.col("a").alias("other")))
    near = both.where(_terms(F.col("other"), terms) > 0).select("id", F.lit(1).alias("s"))
    own = both.select("id").distinct().where(_terms(F.col("id"), terms) > 0).select("id", (2 * _terms(F.col("id"), terms)).alias("s"))
    return own.unionByName(near).groupBy("id").agg(F.sum("s").alias("score"))


def global_(edges: DataFrame, terms: list[str]) -> DataFrame:
    """id, score: the ends of relations that hold a term in their name, one for each relation."""
    found = edges.where(_terms(F.col("relation"), terms) > 0).select("src", "dst", "relation").distinct()
    return found.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("score"))


def hybrid(edges: DataFrame, terms: list[str]) -> DataFrame:
    """id, score: what local and global find, with the larger score."""
    return local(edges, terms).unionByName(global_(edges, terms)).groupBy("id").agg(F.max("score").alias("score"))


def chunks_used(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """chunk_id, score: the chunks whose key is found; names carry their kind before a colon."""
    names = found.select(F.regexp_replace("id", "^[a-z]+:", "").alias("key"), "score").groupBy("key").agg(F.max("score").alias("score"))
    return chunks.join(names, "key").groupBy("chunk_id").agg(F.max("score").alias("score"))
