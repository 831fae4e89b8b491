"""Texts of a ledger for retrieval: one builder for each kind of chunk, all as DataFrame expressions.

A ledger has txn_id, date, amount, merchant, category; description, balance and notes where known. Builders return
chunk_id, chunk_type, key (date, period, category or merchant) and text. Rows without a date belong to no period.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import ledger as L
from .refine import redact

# The sentences of the chunks, in the order in which they are told.
PHRASES = {
    "opening": "On {}, {}, a financial transaction occurred.",
    "income": "This was an income transaction of €{}.",
    "pension": "The income came from a pension payment, which is a regular monthly income source.",
    "received": "The funds were received from {}.",
    "described": "The transaction was described as '{}'.",
    "income_category": "This income has been categorized as {}.",
    "expense": "This was an expense of €{}.",
    "paid": "The payment was made to {}, ",
    "higher": "which is higher than the typical amount of €{} spent there. ",
    "lower": "which is lower than the typical amount of €{} spent there. ",
    "typical": "which is a typical purchase amount for this merchant. ",
    "visit": "This is transaction number {} with {} this month. ",
    "bought": "The transaction was for '{}'. ",
    "expense_category": "This expense falls under the {} category.",
    "so_far": " So far this month, €{} has been spent on {}.",
    "balance": " After this transaction, the account balance was €{}.",
    "balance_low": " The balance is running low and requires attention.",
    "balance_good": " The account maintains a healthy balance.",
    "weekend": " This was a weekend transaction.",
    "month_end": " This transaction occurred near the end of the month.",
    "notes": " Additional details: {}",
    "day": "Financial Summary for {}, {}:",
    "day_count": "On this day, there were {} financial transactions.",
    "day_income": "Total income received was €{}.",
    "day_expenses": "Total expenses amounted to €{}.",
    "day_categories": "Expenses were distributed across the following categories: {}",
    "item": "  - {}: €{}",
    "day_positive": "The day ended with a positive cash flow of €{}.",
    "day_negative": "The day ended with a negative cash flow of €{}.",
    "day_balanced": "Income and expenses were perfectly balanced.",
    "day_high": "This was a high-spending day.",
    "day_low": "Spending was minimal on this day.",
    "week": "Weekly Financial Summary for Week {} of {}:",
    "week_dates": "During this week, from {} to {}, ",
    "week_count": "there were {} transactions.",
    "week_income": "Total weekly income was €{}.",
    "week_expenses": "Total weekly expenses were €{}.",
    "week_merchants": "The most frequented merchants this week were: {}",
    "week_item": "  - {}: {} visits, €{} spent",
    "month": "Monthly Financial Report for {} {}:",
    "month_count": "This month recorded {} financial transactions.",
    "month_income": "Total monthly income was €{}.",
    "month_sources": "Income sources included: {}",
    "month_expenses": "Total monthly expenses were €{}.",
    "month_categories": "Major expense categories were: {}",
    "month_item": "  - {}: €{} ({}% of total expenses)",
    "month_savings": "The month ended with savings of €{}, a savings rate of {}%.",
    "month_deficit": "The month ended with a deficit of €{}.",
    "month_warning": "Warning: Expenses exceeded income by more than 10% this month.",
    "month_excellent": "Excellent financial performance with over 30% of income saved.",
    "month_daily": "Average daily spending was €{}.",
    "month_top_day": "The highest spending day was {}, with €{} in expenses.",
    "period": "Financial summary for {} period {}:",
    "period_totals": "There were {} transactions totaling €{} in income and €{} in expenses.",
    "period_surplus": "The period ended with a surplus of €{}.",
    "period_deficit": "The period ended with a deficit of €{}.",
    "period_categories": "Top spending categories: {}",
    "period_item": "{} (€{})",
    "category": "Analysis of {} spending:",
    "category_total": "Total of {} transactions amounting to €{}.",
    "average": "Average transaction: €{}.",
    "category_merchants": "Includes purchases from {} different merchants: {}.",
    "category_peak": "Peak spending day: {}.",
    "entity": "Spending profile for {}:",
    "entity_total": "{} transactions totaling €{}.",
    "entity_categories": "Categories: {}.",
    "entity_recurring": "This is a {} payment.",
    "entity_above": "Recent spending is above average.",
    "entity_below": "Recent spending is below average.",
    "recurring": "Identified {} recurring payments:",
    "recurring_total": "Total recurring expenses: €{} (approximately €{} per month).",
    "recurring_item": "- {}: {}, €{} per transaction",
    "anomalies": "Detected {} unusual patterns:",
    "anomaly_amount": "- Unusually high transaction: €{} at {} on {}",
    "anomaly_merchant": "- First transaction with {} for €{}",
}
# Names of the days, Monday first.
DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
STRATEGIES = ("narrative", "temporal", "categorical", "entity", "pattern")


def say(phrase: str, *values: Column) -> Column:
    """A sentence with its values; null if any of them is."""
    head, *rest = PHRASES[phrase].split("{}")
    parts = [F.lit(head)]
    for value, text in zip(values, rest, strict=True):
        parts += [value.cast("string"), F.lit(text)]
    return F.concat(*parts)


def when(condition: Column, text: Column) -> Column:
    return F.when(condition, text)


def told(*parts: Column) -> Column:
    """The sentences that aren't null, joined by spaces."""
    return F.concat_ws(" ", *parts)


def euros(c: Column) -> Column:
    """Two decimals by the number's binary value, ties to the even cent; null for null."""
    return when(c.isNotNull(), F.format_string("%.2f", F.rint(c * 100) / 100))


def cents(c: Column) -> Column:
    return F.round(F.coalesce(c, F.lit(0.0)), 2)


def _id(kind: str, key: Column, n: int) -> Column:
    return F.concat(F.lit(f"{kind}_"), F.substring(F.md5(key.cast("string")), 1, n))


def _listing(rows: DataFrame, keys: list[str], name: str, value: str, item: Column, most: int | None = None, sep: str = " ") -> DataFrame:
    """keys, listing: the items of each group by value, largest first, ties by name."""
    if most:
        rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(value), name))
        rows = rows.withColumn("_rank", rank).where(F.col("_rank") <= most)
    parts = F.array_sort(F.collect_list(F.struct((-F.col(value)).alias("v"), F.col(name).alias("k"), item.alias("t"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["t"]), sep).alias("listing"))


def _spent_by(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    return df.where(L.spent()).groupBy(*keys, name).agg(cents(F.sum(-L.amount())).alias("s"), F.count("*").alias("n"))


def _number(c: Column) -> Column:
    """A number of cents as the shortest decimal with a fraction."""
    return F.regexp_replace(F.format_string("%.2f", c), r"(\.\d)0$", "$1")


def transaction_narratives(df: DataFrame) -> DataFrame:
    """A text for each transaction, with its merchant's typical amount and visit, and its category's spending so far.

    The merchant's typical amount is the mean of its expenses (0 counts as one), summed by txn_id: a mean may be half a
    cent, which sums in another order round otherwise. Visits count all its rows so far, and the category's spending is
    by month number, whatever the year.
    """
    columns = {"description": "string", "balance": "double", "notes": "string"}
    df = df.where("date is not null").select("txn_id", "date", "amount", "merchant", "category", *((F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()))
    paid = F.col("amount") <= 0
    by_id = W.partitionBy("merchant").orderBy("txn_id", "amount").rowsBetween(W.unboundedPreceding, 0)
    sums = df.where(paid & F.col("merchant").isNotNull()).select("merchant", F.sum(F.abs("amount")).over(by_id).alias("s"))
    profile = sums.groupBy("merchant").agg((F.max("s") / F.count("*")).alias("mean"), F.count("*").alias("visits"))
    rows = L.so_far(df, ["merchant"], F.lit(1), "visit")
    rows = L.so_far(rows.withColumn("month", F.month("date")), ["month", "category"], F.coalesce(L.expense(), F.lit(0.0)), "so_far").withColumn("so_far", F.round("so_far", 2))
    rows = rows.join(profile, "merchant", "left")
    size, mean, merchant, text = F.abs("amount"), F.col("mean"), F.col("merchant"), F.coalesce("description", F.lit(""))
    known = merchant.isNotNull() & (merchant != "")
    source = when(F.lower(text).contains("pension"), say("pension"))
    source = F.coalesce(source, when(known, say("received", merchant)), say("described", text))
    income = told(say("income", euros(F.col("amount"))), source, say("income_category", F.col("category")))
    band = F.when(size > mean * 1.5, say("higher", euros(mean))).when(size < mean * 0.5, say("lower", euros(mean))).otherwise(say("typical"))
    payee = F.when(known, told(say("paid", merchant), band, when(F.col("visits") > 1, say("visit", F.col("visit"), merchant)))).otherwise(say("bought", text))
    so_far = when(F.col("so_far") > 0, say("so_far", euros(F.col("so_far")), F.col("category")))
    expense = told(say("expense", euros(size)), payee, say("expense_category", F.col("category")), so_far)
    balance = F.col("balance")
    health = F.when(balance < 500, say("balance_low")).when(balance > 5000, say("balance_good"))
    rest = (say("balance", euros(balance)), health, when(F.weekday("date") >= 5, say("weekend")), when(F.dayofmonth("date") >= 25, say("month_end")), when(F.col("notes") != "", say("notes", redact(F.col("notes")))))
    opening = say("opening", F.date_format("date", "EEEE"), F.date_format("date", "MMMM dd, yyyy"))
    key = F.concat_ws("_", F.col("txn_id").cast("string"), F.date_format("date", "yyyy-MM-dd 00:00:00"), _number(F.col("amount")))
    whole = told(opening, F.when(F.col("amount") > 0, income).otherwise(expense), *rest)
    return rows.select(_id("narrative", key, 12).alias("chunk_id"), F.lit("transaction_narrative").alias("chunk_type"), F.date_format("date", "yyyy-MM-dd").alias("key"), whole.alias("text"))


def _flow(net: Column, positive: str, negative: str, balanced: str | None = None) -> Column:
    out = F.when(net > 0, say(positive, euros(net)))
    return out.when(net < 0, say(negative, euros(-net))).otherwise(say(balanced)) if balanced else out.otherwise(say(negative, euros(F.abs(net))))


def daily_summaries(df: DataFrame) -> DataFrame:
    """A text for each day of two transactions or more, its categories by spending."""
    df = df.where("date is not null")
    income, spent = F.col("income"), F.col("expenses")
    days = L.daily(df, 2)
    listing = _listing(_spent_by(df, ["date"], "category"), ["date"], "category", "s", say("item", F.col("category"), euros(F.col("s"))))
    text = told(
        say("day", F.date_format("date", "EEEE"), F.date_format("date", "MMMM dd, yyyy")), say("day_count", F.col("n")),
        when(income > 0, say("day_income", euros(income))), when(spent > 0, say("day_expenses", euros(spent))), when(spent > 0, say("day_categories", F.col("listing"))),
        _flow(cents(income - spent), "day_positive", "day_negative", "day_balanced"), F.when(spent > 500, say("day_high")).when((spent < 50) & (spent > 0), say("day_low")),
    )
    day = F.date_format("date", "yyyy-MM-dd")
    return days.join(listing, "date", "left").select(_id("daily", day, 12).alias("chunk_id"), F.lit("daily_summary").alias("chunk_type"), day.alias("key"), text.alias("text"))


def weekly_summaries(df: DataFrame) -> DataFrame:
    """A text for each week (calendar year, ISO week) of four transactions or more, with its three dearest merchants."""
    df = df.where("date is not null")
    keys = ["year", "week"]
    item = say("week_item", F.col("merchant"), F.col("n"), euros(F.col("s")))
    listing = _listing(_spent_by(L.calendar(df).where("merchant is not null"), keys, "merchant"), keys, "merchant", "s", item, 3)
    text = told(
        say("week", F.col("week"), F.col("year")), say("week_dates", F.date_format("start", "MMMM dd"), F.date_format("end", "MMMM dd")), say("week_count", F.col("n")),
        when(F.col("income") > 0, say("week_income", euros(F.col("income")))), when(F.col("expenses") > 0, say("week_expenses", euros(F.col("expenses")))), say("week_merchants", F.col("listing")),
    )
    return L.weekly(df, 4).join(listing, keys, "left").select(F.format_string("weekly_%d_w%02d", *keys).alias("chunk_id"), F.lit("weekly_summary").alias("chunk_type"), F.format_string("%d-W%02d", *keys).alias("key"), text.alias("text"))


def monthly_summaries(df: DataFrame) -> DataFrame:
    """A text for each month: income by category, the five dearest categories, savings, and its dearest day."""
    df = df.where("date is not null")
    keys = ["year", "month"]
    dated = L.calendar(df)
    earned = dated.where("amount > 0").groupBy(*keys, "category").agg(cents(F.sum("amount")).alias("s"))
    sources = _listing(earned, keys, "category", "s", say("item", F.col("category"), euros(F.col("s")))).withColumnRenamed("listing", "sources")
    months = dated.groupBy(*keys).agg(*L.totals())
    percent = F.format_string("%.1f", F.round(100.0 * F.col("s") / F.col("expenses"), 6))
    costs = _spent_by(dated, keys, "category").join(months.select(*keys, "expenses"), keys)
    costs = _listing(costs, keys, "category", "s", say("month_item", F.col("category"), euros(F.col("s")), percent), 5).withColumnRenamed("listing", "costs")
    top = L.heaviest_day(df).withColumnRenamed("spent", "top_spent")
    income, spent = F.col("income"), F.col("expenses")
    net = cents(income - spent)
    rate = F.format_string("%.1f", F.round(100.0 * net / income, 6))
    text = told(
        say("month", F.date_format(F.make_date("year", "month", F.lit(1)), "MMMM"), F.col("year")), say("month_count", F.col("n")),
        when(income > 0, told(say("month_income", euros(income)), say("month_sources", F.col("sources")))),
        when(spent > 0, told(say("month_expenses", euros(spent)), say("month_categories", F.col("costs")))),
        F.when(net > 0, say("month_savings", euros(net), rate)).otherwise(say("month_deficit", euros(F.abs(net)))),
        F.when(spent > income * 1.1, say("month_warning")).when(net > income * 0.3, say("month_excellent")),
        say("month_daily", euros(spent / 30)), say("month_top_day", F.date_format("day", "MMMM dd"), euros(F.col("top_spent"))),
    )
    rows = months.join(sources, keys, "left").join(costs, keys, "left").join(top, keys, "left")
    return rows.select(F.format_string("monthly_%d_%02d", *keys).alias("chunk_id"), F.lit("monthly_summary").alias("chunk_type"), F.format_string("%d-%02d", *keys).alias("key"), text.alias("text"))


def temporal_chunks(df: DataFrame) -> DataFrame:
    """A short text for each day of two transactions, each week of three and each month, with the three dearest categories."""
    df = L.calendar(df.where("date is not null"))
    periods = {"daily": (F.date_format("date", "yyyy-MM-dd"), 2), "weekly": (F.format_string("%d-W%02d", "year", "week"), 3), "monthly": (F.format_string("%d-%02d", "year", "month"), 1)}
    return reduce(DataFrame.unionByName, (_temporal(df.withColumn("period", key), kind, least) for kind, (key, least) in periods.items()))


def _temporal(df: DataFrame, kind: str, least: int) -> DataFrame:
    groups = df.groupBy("period").agg(*L.totals()).where(F.col("n") >= least)
    listing = _listing(_spent_by(df, ["period"], "category"), ["period"], "category", "s", say("period_item", F.col("category"), euros(F.col("s"))), 3, ", ")
    text = told(
        say("period", F.lit(kind), F.col("period")), say("period_totals", F.col("n"), euros(F.col("income")), euros(F.col("expenses"))),
        _flow(cents(F.col("income") - F.col("expenses")), "period_surplus", "period_deficit"), say("period_categories", F.col("listing")),
    )
    return groups.join(listing, "period", "left").select(_id(f"temporal_{kind}", F.col("period"), 8).alias("chunk_id"), F.lit(f"{kind}_summary").alias("chunk_type"), F.col("period").alias("key"), text.alias("text"))


def category_profiles(df: DataFrame) -> DataFrame:
    """category, n, spent, merchants (number), first_merchants (five by name), peak (weekday of the most spending)."""
    paid = df.where(F.col("amount") <= 0)
    names = paid.select("category", "merchant").where("merchant is not null").distinct()
    first = names.withColumn("r", F.row_number().over(W.partitionBy("category").orderBy("merchant"))).where("r <= 5")
    first = first.groupBy("category").agg(F.array_join(F.array_sort(F.collect_list("merchant")), ", ").alias("first_merchants"))
    days = paid.groupBy("category", F.weekday("date").alias("weekday")).agg(cents(F.sum(F.abs("amount"))).alias("s"))
    peak = days.groupBy("category").agg(F.max_by("weekday", F.struct("s", -F.col("weekday"))).alias("peak"))
    out = paid.groupBy("category").agg(F.count("*").alias("n"), cents(F.sum(F.abs("amount"))).alias("spent"))
    return out.join(names.groupBy("category").agg(F.count("*").alias("merchants")), "category", "left").join(first, "category", "left").join(peak, "category")


def category_chunks(df: DataFrame) -> DataFrame:
    """A text for each category of two expenses or more. Of its merchants the first five by name are told."""
    rows = category_profiles(df.where("category is not null and date is not null")).where("n >= 2")
    day = F.get(F.array(*(F.lit(d) for d in DAYS)), F.col("peak"))
    text = told(say("category", F.col("category")), say("category_total", F.col("n"), euros(F.col("spent"))), say("average", euros(F.col("spent") / F.col("n"))), say("category_merchants", F.col("merchants"), F.col("first_merchants")), say("category_peak", day))
    return rows.select(_id("category", F.col("category"), 8).alias("chunk_id"), F.lit("category_analysis").alias("chunk_type"), F.col("category").alias("key"), text.alias("text"))


def entity_profiles(df: DataFrame) -> DataFrame:
    """merchant, n, spent, categories (by name), last_amount and kind of recurrence (null if none) of its expenses."""
    paid = df.where((F.col("amount") <= 0) & F.col("merchant").isNotNull() & F.col("date").isNotNull())
    size = F.abs("amount")
    out = paid.groupBy("merchant").agg(F.count("*").alias("n"), cents(F.sum(size)).alias("spent"), F.array_join(F.array_sort(F.collect_set("category")), ", ").alias("categories"), F.max_by(size, F.struct("date", "txn_id")).alias("last_amount"))
    kinds = L.recurrence(paid).where("kind != 'none'").select("merchant", "kind")
    return out.join(kinds, "merchant", "left")


def entity_chunks(df: DataFrame) -> DataFrame:
    """A text for each merchant of two expenses or more, with its recurrence and whether the last one was dear."""
    rows = entity_profiles(df).where("n >= 2")
    mean = F.col("spent") / F.col("n")
    trend = F.when(F.col("last_amount") > mean * 1.2, say("entity_above")).when(F.col("last_amount") < mean * 0.8, say("entity_below"))
    text = told(say("entity", F.col("merchant")), say("entity_total", F.col("n"), euros(F.col("spent"))), say("average", euros(mean)), when(F.col("categories") != "", say("entity_categories", F.col("categories"))), when(F.col("kind").isNotNull(), say("entity_recurring", F.col("kind"))), trend)
    return rows.select(_id("entity", F.col("merchant"), 8).alias("chunk_id"), F.lit("entity_profile").alias("chunk_type"), F.col("merchant").alias("key"), text.alias("text"))


def recurring_summary(df: DataFrame) -> DataFrame:
    """One row: merchants that recur, what they cost, that by month of the ledger (months by number), the first five by name."""
    rows = entity_profiles(df).where("kind is not null")
    first = F.min_by(F.struct("kind", (F.col("spent") / F.col("n")).alias("mean")), "merchant")
    items = rows.groupBy("merchant").agg(first.alias("x")).orderBy("merchant").limit(5)
    item = say("recurring_item", F.col("merchant"), F.col("x.kind"), euros(F.col("x.mean")))
    items = items.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("merchant", item.alias("t")))), lambda x: x["t"]), " ").alias("items"))
    months = df.where("date is not null").agg(F.countDistinct(F.month("date")).alias("months"))
    return rows.agg(F.count("*").alias("merchants"), cents(F.sum("spent")).alias("total")).crossJoin(months).crossJoin(items).withColumn("per_month", F.round(F.col("total") / F.col("months"), 2))


def recurring_chunk(df: DataFrame) -> DataFrame:
    """One text on all recurring payments, or none."""
    text = told(say("recurring", F.col("merchants")), say("recurring_total", euros(F.col("total")), euros(F.col("total") / F.col("months"))), F.col("items"))
    return recurring_summary(df).where("merchants > 0").select(F.lit("pattern_recurring").alias("chunk_id"), F.lit("pattern_analysis").alias("chunk_type"), F.lit("recurring").alias("key"), text.alias("text"))


def anomalies(df: DataFrame) -> DataFrame:
    """kind, merchant, date, size: expenses over mean + 3 deviations, and first rows of merchants over twice the mean."""
    high = L.high_amounts(df).join(df.select("txn_id", "date"), "txn_id").select(F.lit("high_amount").alias("kind"), "merchant", "date", F.col("spent").alias("size"), "txn_id")
    return high.unionByName(L.new_merchants(df.where("merchant is not null")).select(F.lit("new_merchant").alias("kind"), "merchant", "date", "size", "txn_id"))


def anomaly_chunk(df: DataFrame) -> DataFrame:
    """One text on all anomalies, or none: the first five, high amounts before new merchants, then by date."""
    rows = anomalies(df.where("date is not null"))
    text = F.when(F.col("kind") == "high_amount", say("anomaly_amount", euros(F.col("size")), F.col("merchant"), F.date_format("date", "yyyy-MM-dd"))).otherwise(say("anomaly_merchant", F.col("merchant"), euros(F.col("size"))))
    first = rows.select("kind", "date", "txn_id", text.alias("t")).orderBy("kind", "date", "txn_id").limit(5)
    items = first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "date", "txn_id", "t"))), lambda x: x["t"]), " ").alias("items"))
    out = rows.agg(F.count("*").alias("n")).crossJoin(items).where("n > 0")
    return out.select(F.lit("pattern_anomalies").alias("chunk_id"), F.lit("pattern_analysis").alias("chunk_type"), F.lit("anomalies").alias("key"), told(say("anomalies", F.col("n")), F.col("items")).alias("text"))


BUILDERS = {
    "narrative": (transaction_narratives, daily_summaries, weekly_summaries, monthly_summaries),
    "temporal": (temporal_chunks,),
    "categorical": (category_chunks,),
    "entity": (entity_chunks,),
    "pattern": (recurring_chunk, anomaly_chunk),
}


def build(df: DataFrame, strategies: tuple[str, ...] = STRATEGIES) -> DataFrame:
    """All chunks of the strategies named, with their strategy; a strategy named twice gives its chunks twice."""
    parts = [b(df).withColumn("strategy", F.lit(s)) for s in strategies for b in BUILDERS[s]]
    return reduce(DataFrame.unionByName, parts)


def counts(chunks: DataFrame) -> DataFrame:
    """strategy, chunk_type, n and mean length of the texts."""
    return chunks.groupBy("strategy", "chunk_type").agg(F.count("*").alias("n"), F.round(F.avg(F.length("text")), 4).alias("mean_chars"))
