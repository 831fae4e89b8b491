import datetime
import json

import pytest
from pyspark.sql import functions as F

from ledgerloom import sinks
from ledgerloom.operators import graph, refine
from ledgerloom.sources import files


def test_triangle_with_pendant(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "d"), ("x", "y"), (None, "a")], "src string, dst string")
    found = {r.id: (r.degree, r.triangles, round(r.coefficient, 4)) for r in graph.clustering(edges).collect()}
    assert found == {"a": (2, 1, 1.0), "b": (2, 1, 1.0), "c": (3, 1, 0.3333), "d": (1, 0, 0.0), "x": (1, 0, 0.0), "y": (1, 0, 0.0)}
    assert {r.id: r.component for r in graph.components(edges).collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x"}
    assert {r.id: r["first"] for r in graph.neighbours(edges).collect()}["c"] == "a, b, d"
    assert graph.summary(edges).first()[:2] == (6, 5)


def test_long_path_is_one_component(spark):
    edges = spark.createDataFrame([(f"{i:03}", f"{i + 1:03}") for i in range(60)], "src string, dst string")
    assert {r.component for r in graph.components(edges).collect()} == {"000"}


def test_empty_graph(spark):
    edges = spark.createDataFrame([], "src string, dst string")
    assert graph.components(edges).count() == graph.clustering(edges).count() == 0
    assert graph.summary(edges).first() == (0, 0, 0.0)


def test_memory(spark):
    day = lambda d: datetime.datetime(2025, 7, d)
    schema = "name string, category string, confidence double, last_updated timestamp"
    first = refine.upsert_memory(None, spark.createDataFrame([(" Zara ", "Shopping", 0.9, day(1)), ("Bar", "Other", 0.6, day(1)), (None, "Other", 0.9, day(1))], schema))
    second = refine.upsert_memory(first, spark.createDataFrame([("ZARA", "Sports", 0.7, day(5))], schema))
    assert [(r.key, r.category, r.frequency) for r in second.collect()] == [("zara", "Sports", 2)]
    rows = spark.createDataFrame([("zara ",), ("bar",), (None,)], "merchant string")
    told = lambda d: {r.merchant: r.remembered for r in refine.recall(rows, second, F.lit(d)).collect()}
    assert told(day(30)) == {"zara ": "Sports", "bar": None, None: None}
    assert told(datetime.datetime(2025, 8, 4))["zara "] is None


def test_validation_and_write_back(spark):
    rows = spark.createDataFrame([("Income", -5.0, 0.8, "x"), ("Loan", 5.0, 0.5, "x"), ("Other", -1.0, 0.4, "Traspaso a mi"), ("Groceries", -1.0, 0.99, None)], "category string, amount double, confidence double, merchant string")
    assert [(r.category, round(r.confidence, 4)) for r in refine.validate(rows).collect()] == [("Income", 0.56), ("Loan", 0.4), ("Internal Transfer", 0.9), ("Groceries", 0.95)]
    ledger = spark.createDataFrame([("a", 1.0, "Other"), ("a", 1.0, None), ("b", 2.0, "Other")], "description string, amount double, category string")
    better = spark.createDataFrame([("a", 1.0, "Sports", 0.9), ("a", 1.0, "ATM", 0.6), ("b", 2.0, "ATM", 0.5)], "description string, amount double, category string, confidence double")
    assert sorted((r.description, r.category) for r in refine.write_back(ledger, better).collect()) == [("a", "Sports"), ("a", "Sports"), ("b", "Other")]


def test_small_columns(spark):
    row = spark.createDataFrame([("abcdefghijklmnopqrst-abcdefghijklmnopqrst", "short", None)], "a string, b string, c string").select(*(refine.redact(F.col(c)) for c in "abc")).first()
    assert tuple(row) == ("****-****", "****", None)
    text = spark.range(1).select(refine.embedding_text(F.lit("pattern"), F.lit("t"), F.lit("weekly"), F.lit(None)), refine.embedding_text(F.lit("categorical"), F.lit("t"), F.lit("A"), F.lit("B")), refine.embedding_text(F.lit(None), F.lit("t"), F.lit("A"), F.lit("B"))).first()
    assert tuple(text) == ("[Patrón weekly] t", "[A - B] t", "t")


def test_files(spark, tmp_path):
    for name, content in {"e.json": {"transactions": [{"a": 1}, {"a": 2}]}, "l.json": [{"a": 1}, {"a": 2}], "d.json": {"data": [{"a": 1}, {"a": 2}]}}.items():
        (tmp_path / name).write_text(json.dumps(content))
        assert sorted(r.a for r in files.read_json(spark, str(tmp_path / name)).collect()) == [1, 2]
    (tmp_path / "t.csv").write_text("a, b\n1,2\n")
    assert files.read_separated(spark, str(tmp_path / "t.csv")).columns == ["a", "b"]
    (tmp_path / "one.csv").write_text("a\n1\n")
    with pytest.raises(ValueError):
        files.read_separated(spark, str(tmp_path / "one.csv"))
    (tmp_path / "g.graphml").write_text('<graphml><graph edgedefault="undirected"><node id="a"/><node id="b"/><edge source="a" target="b"/></graph></graphml>')
    nodes, edges = files.read_graphml(spark, str(tmp_path / "g.graphml"))
    assert sorted(r.id for r in nodes.collect()) == ["a", "b"] and edges.collect() == [("a", "b")]
    chunks = spark.createDataFrame([("x", "daily", "abc"), ("y", "weekly", "de")], "chunk_id string, chunk_type string, text string")
    sinks.write_chunks_by_type(chunks, str(tmp_path / "chunks"))
    assert spark.read.json(str(tmp_path / "chunks")).count() == 2
    assert {tuple(r) for r in sinks.chunk_report(chunks).collect()} == {("daily", 1, 3), ("weekly", 1, 2)}
