"""Aggregates, windows and top-k over a ledger: txn_id long, date date, amount double, merchant string, category string."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def amount() -> Column:
    return F.col("amount")


def spent() -> Column:
    return F.col("amount") < 0


def money(c: Column) -> Column:
    return F.round(F.coalesce(c, F.lit(0.0)), 2)


def expense(c: Column | None = None) -> Column:
    return F.when(spent(), -amount() if c is None else c)


def totals() -> list[Column]:
    return [F.count("*").alias("n"), money(F.sum(F.when(amount() > 0, amount()))).alias("income"), money(F.sum(expense())).alias("expenses"), money(F.sum(amount())).alias("net")]


def calendar(df: DataFrame) -> DataFrame:
    return df.withColumns({"weekday": F.weekday("date"), "month": F.month("date"), "year": F.year("date"), "week": F.weekofyear("date"), "is_weekend": F.weekday("date") >= 5, "is_income": amount() > 0})


def statistics(df: DataFrame) -> DataFrame:
    return df.agg(*totals(), money(F.avg(expense())).alias("mean_expense"), money(F.max(expense())).alias("max_expense"), money(F.max(F.when(amount() > 0, amount()))).alias("max_income"))


def expense_by_category(df: DataFrame) -> DataFrame:
    return df.where(spent()).groupBy("category").agg(money(F.sum(-amount())).alias("spent"))


def category_shares(df: DataFrame) -> DataFrame:
    counts = df.groupBy("category").agg(F.count("*").alias("n"))
    return counts.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(W.partitionBy()), 4))


def merchant_profiles(df: DataFrame) -> DataFrame:
    out = df.where(spent()).groupBy("merchant").agg(F.count("*").alias("n"), money(F.sum(-amount())).alias("spent"), F.min("date").alias("first"), F.max("date").alias("last"), F.countDistinct("category").alias("categories"), F.round(F.max_by(-amount(), F.struct("date", "txn_id")), 2).alias("last_amount"), F.round(F.avg(-amount()), 6).alias("mean"))
    trend = F.when(F.col("last_amount") > 1.2 * F.col("mean"), "rising").when(F.col("last_amount") < 0.8 * F.col("mean"), "falling").otherwise("stable")
    return out.where("n >= 2").withColumn("trend", trend)


def weekday_spend(df: DataFrame) -> DataFrame:
    return calendar(df).where(spent()).groupBy("weekday").agg(F.count("*").alias("n"), money(F.sum(-amount())).alias("spent"))


def daily(df: DataFrame, least: int = 2) -> DataFrame:
    return df.groupBy("date").agg(*totals()).where(F.col("n") >= least)


def weekly(df: DataFrame, least: int = 4) -> DataFrame:
    return calendar(df).groupBy("year", "week").agg(*totals(), F.min("date").alias("start"), F.max("date").alias("end")).where(F.col("n") >= least)


def monthly(df: DataFrame) -> DataFrame:
    out = calendar(df).groupBy("year", "month").agg(*totals(), F.countDistinct("merchant").alias("merchants"))
    health = F.when(F.col("income") > 1.1 * F.col("expenses"), "surplus").when(F.col("income") > F.col("expenses"), "balanced").otherwise("deficit")
    return out.withColumn("health", health).withColumn("avg_daily", F.round(F.col("expenses") / 30, 2))


def month_distribution(df: DataFrame) -> DataFrame:
    rows = calendar(df).where(spent()).groupBy("year", "month", "category").agg(F.sum(-amount()).alias("s"))
    share = F.round(100.0 * F.col("s") / F.sum("s").over(W.partitionBy("year", "month")), 4)
    rank = F.row_number().over(W.partitionBy("year", "month").orderBy(F.desc("s"), "category"))
    return rows.select("year", "month", "category", money(F.col("s")).alias("spent"), share.alias("percent"), rank.alias("rank"))


def peak_weekday(df: DataFrame) -> DataFrame:
    rows = calendar(df).where(spent()).groupBy("category", "weekday").agg(money(F.sum(-amount())).alias("s"))
    return rows.groupBy("category").agg(F.max_by("weekday", F.struct("s", -F.col("weekday"))).alias("peak_weekday"))


def heaviest_day(df: DataFrame) -> DataFrame:
    rows = calendar(df).where(spent()).groupBy("year", "month", "date").agg(money(F.sum(amount())).alias("s"))
    return rows.groupBy("year", "month").agg(F.min_by("date", F.struct("s", "date")).alias("day"), (-F.min("s")).alias("spent"))


def high_amounts(df: DataFrame, sigmas: float = 3.0) -> DataFrame:
    """Expenses above mean + sigmas x sample deviation of all expenses."""
    bound = df.where(spent()).agg((F.avg(-amount()) + sigmas * F.stddev_samp(-amount())).alias("bound"))
    return df.where(spent()).join(F.broadcast(bound), -amount() > F.col("bound")).select("txn_id", "merchant", F.round(-amount(), 2).alias("spent"))


def new_merchants(df: DataFrame, factor: float = 2.0) -> DataFrame:
    """First rows of merchants whose amount is over factor x the mean expense."""
    mean = df.where(spent()).agg(F.avg(-amount()).alias("mean"))
    first = df.groupBy("merchant").agg(F.min_by(F.struct("txn_id", "date", "amount"), F.struct("date", "txn_id")).alias("x"))
    return first.select("merchant", "x.*").join(F.broadcast(mean), F.abs("amount") > factor * F.col("mean")).select("merchant", "txn_id", "date", F.round(F.abs("amount"), 2).alias("size"))


def running_balance(df: DataFrame) -> DataFrame:
    """Days are few, whatever the number of rows: the running sum is over the daily sums."""
    days = df.groupBy("date").agg(F.sum("amount").alias("s"))
    return days.select("date", money(F.sum("s").over(W.orderBy("date").rowsBetween(W.unboundedPreceding, 0))).alias("balance"))


def so_far(df: DataFrame, keys: list[str], value: Column, name: str, previous: str | None = None) -> DataFrame:
    """df with the sum of value over the rows of its keys up to each row, by date and txn_id; rows without a date go.

    The days of a key are summed first, and a running sum over them is added to one within the day, so that no task
    holds more than a key's days or a day's rows of a key. previous: also the date of the key's row before.
    """
    rows = df.where("date is not null")
    days = rows.groupBy(*keys, "date").agg(F.sum(value).alias("_s"))
    w = W.partitionBy(*keys).orderBy("date")
    days = days.select(*keys, "date", F.coalesce(F.sum("_s").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.lag("date").over(w).alias("_previous"))
    days = days.select(*(F.col(c).alias(f"_{c}") for c in (*keys, "date")), "_before", "_previous")
    inside = W.partitionBy(*keys, "date").orderBy("txn_id")
    out = rows.withColumn(name, F.sum(value).over(inside.rowsBetween(W.unboundedPreceding, 0))).withColumn("_first", F.row_number().over(inside) == 1)
    out = out.join(days, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*keys, "date")))).withColumn(name, F.col(name) + F.col("_before"))
    if previous:
        out = out.withColumn(previous, F.when(F.col("_first"), F.col("_previous")).otherwise(F.col("date")))
    return out.drop("_first", "_before", "_previous", "_date", *(f"_{c}" for c in keys))


def visits(df: DataFrame) -> DataFrame:
    rows = so_far(df, ["merchant"], F.lit(1), "visit", "before")
    return rows.select("txn_id", "merchant", F.col("visit").cast("int").alias("visit"), F.datediff("date", "before").alias("days_since"))


def running_category(df: DataFrame) -> DataFrame:
    """Spending of each row's category so far, by month number, whatever the year."""
    rows = so_far(calendar(df), ["month", "category"], F.coalesce(expense(), F.lit(0.0)), "so_far")
    return rows.select("txn_id", "month", "category", money(F.col("so_far")).alias("so_far"))


def recurrence(df: DataFrame, least: float = 0.6) -> DataFrame:
    """Merchants whose intervals are mostly 28 to 32 days (monthly) or 6 to 8 days (weekly, which wins)."""
    gaps = visits(df.where(spent())).where(F.col("days_since").isNotNull())
    share = lambda a, b: F.avg(F.col("days_since").between(a, b).cast("double"))
    found = gaps.groupBy("merchant").agg(F.count("*").alias("intervals"), F.round(share(28, 32), 6).alias("monthly"), F.round(share(6, 8), 6).alias("weekly"))
    return found.withColumn("kind", F.when(F.col("weekly") >= least, "weekly").when(F.col("monthly") >= least, "monthly").otherwise("none"))


def week_change(df: DataFrame) -> DataFrame:
    """Weekly expenses against the week before, in bands of 20 %."""
    weeks = calendar(df).groupBy("year", "week").agg(money(F.sum(expense())).alias("expenses"))
    before = F.lag("expenses").over(W.orderBy("year", "week"))
    band = F.when(F.col("expenses") > 1.2 * F.col("before"), "up").when(F.col("expenses") < 0.8 * F.col("before"), "down").when(F.col("before").isNotNull(), "steady")
    return weeks.withColumn("before", before).withColumn("band", band)


def top_merchants_by_week(df: DataFrame, k: int = 3) -> DataFrame:
    rows = calendar(df).where(spent()).groupBy("year", "week", "merchant").agg(money(F.sum(-amount())).alias("spent"))
    rank = F.row_number().over(W.partitionBy("year", "week").orderBy(F.desc("spent"), "merchant"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def identifiers(df: DataFrame) -> DataFrame:
    key = F.concat_ws("|", F.date_format("date", "yyyy-MM-dd"), "merchant", F.col("txn_id").cast("string"))
    return df.select("txn_id", F.substring(F.md5(key), 1, 12).alias("chunk_id"), F.format_string("weekly_%d_w%02d", F.year("date"), F.weekofyear("date")).alias("week_id"), F.date_format("date", "dd/MM/yyyy").alias("shown"))


def amount_bands(df: DataFrame) -> DataFrame:
    cents = F.sum(F.rint(F.abs("amount") * 100).cast("long"))  # sums of integers are the same in any order
    typical = df.groupBy(F.col("merchant").alias("_merchant")).agg((F.rint(cents.cast("double") / F.count("amount")) / 100).alias("typical"))
    size = F.abs("amount")
    band = F.when(size > 1.5 * F.col("typical"), "high").when(size < 0.5 * F.col("typical"), "low").otherwise("typical")
    rows = df.join(typical, F.col("merchant").eqNullSafe(F.col("_merchant")))
    return rows.select("txn_id", "typical", band.alias("band"), (F.dayofmonth("date") >= 25).alias("month_end"))


def cosine_topk(vectors: DataFrame, query: list[float], k: int = 10) -> DataFrame:
    """The k rows nearest to one query vector; the query travels as a literal."""
    q = F.array(*(F.lit(float(x)) for x in query))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    v = F.col("embedding")
    score = dot(v, q) / F.sqrt(dot(v, v) * dot(q, q))
    return vectors.select("vec_id", score.alias("score")).orderBy(F.desc("score"), "vec_id").limit(k).withColumn("score", F.round("score", 6))


def degrees(edges: DataFrame) -> DataFrame:
    """Degree of every vertex of undirected edges (src, dst): (a, b) and (b, a) are one edge, a loop counts twice."""
    ends = edges.where("src is not null and dst is not null").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    both = ends.select(F.col("src").alias("id")).unionAll(ends.select(F.col("dst").alias("id")))
    return both.groupBy("id").agg(F.count("*").alias("degree"))
