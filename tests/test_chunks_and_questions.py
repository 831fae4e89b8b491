import datetime
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import chunks, graph, ledger, measures, questions

LEDGER = "txn_id long, date date, amount double, merchant string, category string, description string, balance double, notes string"


def day(text):
    return datetime.date.fromisoformat(text)


@pytest.fixture(scope="module")
def small(spark):
    """A ledger by hand: a monthly payment, a month with income alone, an unknown merchant, a null date."""
    rows = [(1, day("2031-01-31"), -40.0, "Gym", "Sports", "CUOTA", 450.0, None), (2, day("2031-03-02"), -40.0, "Gym", "Sports", "CUOTA", None, ""), (3, day("2031-04-01"), -60.5, "Gym", "Sports", "CUOTA", 9000.0, "a note that is longer than twenty"), (4, day("2031-02-08"), 1000.0, None, "Income", "PENSION FEBRERO", None, None), (5, day("2031-04-01"), -900.0, None, "Housing", "ALQUILER ABRIL", None, "x"), (6, None, -1.0, "Gym", "Sports", "SIN DIA", None, None)]
    return spark.createDataFrame(rows, LEDGER)


def texts(df):
    return {r.key: r.text for r in df.collect()}


def test_transaction_texts(small):
    got = sorted(r.text for r in chunks.transaction_narratives(small).collect())
    assert len(got) == 5
    assert got[0] == "On Friday, January 31, 2031, a financial transaction occurred. This was an expense of €40.00. The payment was made to Gym,  which is a typical purchase amount for this merchant.  This is transaction number 1 with Gym this month.  This expense falls under the Sports category.  So far this month, €40.00 has been spent on Sports.  After this transaction, the account balance was €450.00.  The balance is running low and requires attention.  This transaction occurred near the end of the month."
    assert any("The transaction was for 'ALQUILER ABRIL'. " in t and t.endswith(" Additional details: ****") for t in got)
    assert any("regular monthly income source. This income has been categorized as Income." in t and "weekend" in t for t in got)
    assert any("healthy balance" in t and t.endswith("Additional details: ****r than twenty") for t in got)


def test_period_texts(small):
    month = texts(chunks.monthly_summaries(small))
    assert month["2031-02"] == "Monthly Financial Report for February 2031: This month recorded 1 financial transactions. Total monthly income was €1000.00. Income sources included:   - Income: €1000.00 The month ended with savings of €1000.00, a savings rate of 100.0%. Excellent financial performance with over 30% of income saved. Average daily spending was €0.00."
    assert "a deficit of €40.00. Warning: Expenses exceeded income" in month["2031-03"] and len(month) == 4
    days = texts(chunks.daily_summaries(small))
    assert days == {"2031-04-01": "Financial Summary for Tuesday, April 01, 2031: On this day, there were 2 financial transactions. Total expenses amounted to €960.50. Expenses were distributed across the following categories:   - Housing: €900.00   - Sports: €60.50 The day ended with a negative cash flow of €960.50. This was a high-spending day."}
    assert chunks.weekly_summaries(small).count() == 0 and chunks.temporal_chunks(small).count() == 1 + 4


def test_profiles_and_patterns(small):
    assert texts(chunks.entity_chunks(small)) == {"Gym": "Spending profile for Gym: 3 transactions totaling €140.50. Average transaction: €46.83. Categories: Sports. This is a monthly payment. Recent spending is above average."}
    assert texts(chunks.category_chunks(small)) == {"Sports": "Analysis of Sports spending: Total of 3 transactions amounting to €140.50. Average transaction: €46.83. Includes purchases from 1 different merchants: Gym. Peak spending day: Tuesday."}
    assert texts(chunks.recurring_chunk(small)) == {"recurring": "Identified 1 recurring payments: Total recurring expenses: €140.50 (approximately €35.12 per month). - Gym: monthly, €46.83 per transaction"}
    assert chunks.anomaly_chunk(small.limit(0)).count() == chunks.recurring_chunk(small.limit(0)).count() == 0
    both = chunks.build(small, ("entity", "entity"))
    assert both.count() == 2 and {r.n for r in chunks.counts(both).collect()} == {2}


def test_empty_ledgers(small):
    none = small.limit(0)
    for strategy in chunks.STRATEGIES:
        assert chunks.build(none, (strategy,)).count() == 0
    assert questions.patterns(none).count() == 1 and questions.trend(none).count() == 0 and questions.savings(none).count() == 0
    assert measures.out_of_order(none).first()[0] == 0 and measures.numbered(none).count() == 0


def test_running_sums_by_days(spark):
    """Null keys are a group, days may repeat, and the row before may lie on the same day."""
    rows = [(i, day(f"2031-01-{1 + i // 3:02d}"), -1.0, None if i % 2 else "m", "c") for i in range(30)] + [(99, None, -1.0, "m", "c")]
    got = {r.txn_id: (r.visit, r.days_since) for r in ledger.visits(spark.createDataFrame(rows, "txn_id long, date date, amount double, merchant string, category string")).collect()}
    for parity in (0, 1):
        own = [i for i in range(30) if i % 2 == parity]
        assert [got[i][0] for i in own] == list(range(1, 16))
        assert [got[i][1] for i in own] == [None] + [b // 3 - a // 3 for a, b in zip(own, own[1:], strict=False)]
    assert 99 not in got


def test_typical_amounts_in_any_order(spark):
    """A typical amount of half a cent doesn't hang on how rows lie in partitions: amounts are summed by txn_id."""
    sizes = [0.1, 0.7, 1.3, 33.33, 0.01, 250.07, 7.77, 1000.1, 12.35, 99.99, 3.21, 0.31]
    rows = [(i, day("2031-01-01"), -size * (1 + m % 7), f"m{m}", "c", "d", None, None) for m in range(60) for i, size in enumerate(sizes[: 2 + m % 11], 100 * m)]
    df = spark.createDataFrame(rows, LEDGER)
    sums = {}
    for i, _, amount, merchant, *_ in rows:
        sums.setdefault(merchant, []).append(abs(amount))
    typical = {m: round(round(sum_of(x) / len(x) * 100) / 100, 2) for m, x in sums.items()}
    for parts, order in ((1, "txn_id"), (7, "amount"), (3, F.desc("txn_id"))):
        got = chunks.transaction_narratives(df.repartitionByRange(parts, order).sortWithinPartitions(order)).collect()
        told = {(m, a) for r in got for m, a in re.findall(r"made to (m\d+),  which is (?:higher|lower) than the typical amount of €(\S+) ", r.text)}
        assert told and all(a == f"{typical[m]:.2f}" for m, a in told)


def sum_of(values):
    """Added one after the other, as the builtin sum no longer does."""
    total = 0.0
    for v in values:
        total += v
    return total


def test_chronology_and_numbers(spark):
    rows = [(i, day("2031-01-01") + datetime.timedelta(days=i // 2 - (9 if i in (40, 5000) else 0))) for i in range(0, 6000, 4)]
    df = spark.createDataFrame(rows, "txn_id long, date date")
    assert measures.out_of_order(df).first()[0] == 2
    got = measures.numbered(df, batch=10).orderBy("date", "txn_id").collect()
    assert [r.position for r in got] == list(range(len(rows))) and got[25].batch == 2


def test_embedded(spark):
    texts = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "key string, text string")
    vectors = spark.createDataFrame([("a", [1.0], None), ("b", None, "timeout")], "key string, vector array<double>, error string")
    good, bad = measures.embedded(texts, vectors)
    assert [r.key for r in good.collect()] == ["a"] and {(r.key, r.error) for r in bad.collect()} == {("b", "timeout"), ("c", "no embedding")}


def test_communities(spark):
    """Two cliques with one bridge are two communities."""
    clique = lambda p: [(f"{p}{i}", f"{p}{j}", "x") for i in range(5) for j in range(i)]
    edges = spark.createDataFrame([*clique("a"), *clique("b"), ("a0", "b0", "x")], "src string, dst string, relation string")
    found = graph.communities(edges)
    groups = {}
    for r in found.collect():
        groups.setdefault(r.community, set()).add(r.id[0])
    assert sorted(map(sorted, groups.values())) == [["a"], ["b"]]
    assert [(r["size"], len(r.members.split(", "))) for r in graph.top_communities(found, shown=3).collect()] == [(5, 3), (5, 3)]
    assert ledger.degrees(edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "relation"))).where("id = 'a0'").first().degree == 5
