"""Graphs as DataFrames: edges (src, dst, relation) of a ledger, their statistics, components and node types."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Words that tell a node's type, in order of priority.
NODE_WORDS = (
    ("fechas", r"\d{4}|july|week"), ("montos", r"€|\d+\.\d+"), ("categorías", "groceries|housing|transport|entertainment|food|shopping"),
    ("comercios", "transfer|supermercado|amazon|netflix|alquiler|farmacia"), ("períodos", "financial|summary|analysis"),
)
# Words that tell an entity's type in pictures, in order of priority.
ENTITY_WORDS = (
    ("AMOUNT", "€|euro|gasto|ingreso|total"), ("DATE", "julio|agosto|semana|mes|2025|fecha"),
    ("CATEGORY", "groceries|housing|transport|entertainment|food"), ("MERCHANT", "transfer|supermercado|amazon|netflix|alquiler|mercadona"),
    ("PATTERN", "recurrente|patrón|suscripción|mensual"),
)


def _by_words(name: Column, table: tuple, otherwise: Column) -> Column:
    low = F.lower(F.coalesce(name, F.lit("")))
    return F.coalesce(*(F.when(low.rlike(p), F.lit(v)) for v, p in table), otherwise)


def node_type(name: Column) -> Column:
    return _by_words(name, NODE_WORDS, F.lit("otros"))


def entity_type(name: Column, given: Column) -> Column:
    """The type that the name's words tell, else the given one in capitals, else `default`."""
    return _by_words(name, ENTITY_WORDS, F.coalesce(F.when(given != "", F.upper(given)), F.lit("default")))


def ledger_edges(df: DataFrame) -> DataFrame:
    """Merchant, category and weekday nodes of a ledger: one edge for each pair that some transaction holds."""
    part = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    named = df.select(part("merchant:", F.col("merchant")).alias("m"), part("category:", F.col("category")).alias("c"), part("weekday:", F.weekday("date")).alias("d")).distinct()
    pairs = F.array(*(F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(r).alias("relation")) for a, b, r in (("m", "c", "BELONGS_TO"), ("m", "d", "OCCURRED_ON"), ("c", "d", "AGGREGATES_TO"))))
    return named.select(F.inline(pairs)).where("src is not null and dst is not null").distinct()


def canonical(edges: DataFrame) -> DataFrame:
    """Distinct undirected edges (a < b); loops and edges with a null end are left out."""
    return edges.where("src != dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("id"))


def summary(edges: DataFrame) -> DataFrame:
    """One row: vertices, edges, density (0 under two vertices)."""
    pairs = canonical(edges)
    counts = _ends(pairs).agg(F.countDistinct("id").alias("n"), (F.count("*") / 2).cast("long").alias("m"))
    return counts.withColumn("density", F.when(F.col("n") > 1, F.round(2.0 * F.col("m") / (F.col("n") * (F.col("n") - 1)), 8)).otherwise(0.0))


def clustering(edges: DataFrame) -> DataFrame:
    """id, degree, triangles, coefficient. Edges point to the end of higher degree, so a hub opens no pairs of its own."""
    pairs = canonical(edges)
    degree = _ends(pairs).groupBy("id").agg(F.count("*").alias("degree"))
    rank = lambda end: degree.select(F.col("id").alias(end), F.struct("degree", "id").alias(f"r{end}"))
    forward = F.col("ra") < F.col("rb")
    out = pairs.join(rank("a"), "a").join(rank("b"), "b").select(F.when(forward, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(forward, F.col("b")).otherwise(F.col("a")).alias("v"), F.greatest("ra", "rb").alias("rv"))
    wedges = out.alias("x").join(out.alias("y"), F.expr("x.u = y.u AND x.rv < y.rv")).select(F.col("x.u").alias("u"), F.col("x.v").alias("v"), F.col("y.v").alias("w"))
    closed = wedges.join(out.select(F.col("u").alias("v"), F.col("v").alias("w")), ["v", "w"])
    triangles = closed.select(F.explode(F.array("u", "v", "w")).alias("id")).groupBy("id").agg(F.count("*").alias("triangles"))
    t, d = F.coalesce(F.col("triangles"), F.lit(0)), F.col("degree")
    return degree.join(triangles, "id", "left").select("id", "degree", t.alias("triangles"), F.when(d > 1, F.round(2.0 * t / (d * (d - 1)), 8)).otherwise(0.0).alias("coefficient"))


def neighbours(edges: DataFrame, shown: int = 3) -> DataFrame:
    """id, degree and its first neighbours by name; a hub's neighbours are ranked in parts, of which `shown` go on."""
    pairs = canonical(edges)
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("other")).unionAll(pairs.select(F.col("b").alias("id"), F.col("a").alias("other")))
    rank = lambda *keys: F.row_number().over(W.partitionBy(*keys).orderBy("other"))
    part = both.withColumn("salt", F.pmod(F.xxhash64("other"), F.lit(64)))
    first = part.withColumn("r", rank("id", "salt")).where(F.col("r") <= shown).withColumn("r", rank("id")).where(F.col("r") <= shown)
    names = first.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("other")), ", ").alias("first"))
    return both.groupBy("id").agg(F.count("*").alias("degree")).join(names, "id")


def _cut(df: DataFrame) -> DataFrame:
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        where = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not where and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp())
    return df.checkpoint()


def components(edges: DataFrame) -> DataFrame:
    """id, component: the smallest id reachable from each vertex. Labels spread to neighbours, then jump, until none moves."""
    pairs = canonical(edges)
    both = _cut(pairs.union(pairs.select("b", "a")))
    labels = _cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("c")))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "c"), "b").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("m"))
        low = labels.join(near, "id").select("id", "c", F.least("c", "m").alias("m"))
        moved = _cut(low.join(labels.select(F.col("id").alias("m"), F.col("c").alias("up")), "m").select("id", F.col("up").alias("c"), (F.col("up") != F.col("c")).alias("changed")))
        labels = moved.select("id", "c")
        if moved.where("changed").isEmpty():
            return labels.withColumnRenamed("c", "component")


# Colours and sizes of a vertex by its type.
COLOURS = {
    "MERCHANT": "#FF6B6B", "CATEGORY": "#4ECDC4", "AMOUNT": "#95E77E", "DATE": "#FFD93D", "PERSON": "#6C5CE7", "ORGANIZATION": "#A8E6CF",
    "LOCATION": "#FFB6C1", "TRANSACTION": "#FFA500", "PATTERN": "#87CEEB", "CHUNK": "#808080", "default": "#C0C0C0",
}
SIZES = {"MERCHANT": 25, "CATEGORY": 30, "AMOUNT": 20, "PERSON": 35, "CHUNK": 15, "default": 20}


def styled(vertices: DataFrame) -> DataFrame:
    """id, label (20 characters at most), colour, size, shape and border of vertices (id, type, importance: 0.5 if null)."""
    of = lambda table: F.coalesce(*(F.when(F.col("type") == t, F.lit(v)) for t, v in table.items()), F.lit(table["default"]))
    label = F.when(F.length("id") > 20, F.concat(F.substring("id", 1, 17), F.lit("..."))).otherwise(F.col("id"))
    weight = F.coalesce("importance", F.lit(0.5))
    shape = F.when(F.col("type") == "CHUNK", "square").otherwise("dot")
    return vertices.select("id", label.alias("label"), of(COLOURS).alias("colour"), F.round(of(SIZES) * (0.5 + weight), 4).alias("size"), shape.alias("shape"), F.when(weight > 0.7, 3).otherwise(2).alias("border"))


def label_counts(edges: DataFrame, k: int = 10) -> DataFrame:
    """relation, n: the k most frequent relations, ties by name."""
    return edges.where("relation is not null and relation != ''").groupBy("relation").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "relation").limit(k)


def top_degrees(edges: DataFrame, k: int = 10) -> DataFrame:
    """id, degree: the k vertices of the most neighbours, ties by name."""
    return _ends(canonical(edges)).groupBy("id").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "id").limit(k)


def type_counts(vertices: DataFrame, shown: int = 10) -> DataFrame:
    """type, n and the first `shown` names by the alphabet, of vertices (id, type)."""
    rows = vertices.select("type", "id").distinct()
    first = rows.withColumn("r", F.row_number().over(W.partitionBy("type").orderBy("id"))).where(F.col("r") <= shown)
    names = first.groupBy("type").agg(F.array_join(F.array_sort(F.collect_list("id")), ", ").alias("first"))
    return rows.groupBy("type").agg(F.count("*").alias("n")).join(names, "type")


def named_amounts(vertices: DataFrame, k: int = 10) -> DataFrame:
    """id, amount: the k largest euro amounts that names of vertices hold, ties by name."""
    text = F.regexp_replace(F.regexp_extract("id", r"€([\d,]+\.?\d*)", 1), ",", "")
    return vertices.select("id", text.try_cast("double").alias("amount")).where("amount is not null").orderBy(F.desc("amount"), "id").limit(k)


def average_clustering(edges: DataFrame) -> DataFrame:
    """One row: the mean of the vertices' clustering coefficients, 0 without any."""
    return clustering(edges).agg(F.coalesce(F.round(F.avg("coefficient"), 6), F.lit(0.0)).alias("clustering"))


def insights(edges: DataFrame, central: int = 5) -> DataFrame:
    """One row: vertices of more than `central` neighbours, and whether the graph is sparse, dense or neither."""
    hubs = _ends(canonical(edges)).groupBy("id").agg(F.count("*").alias("degree")).agg(F.count_if(F.col("degree") > central).alias("hubs"))
    kind = F.when(F.col("density") < 0.1, "sparse").when(F.col("density") > 0.3, "dense").otherwise("even")
    return summary(edges).select(kind.alias("kind")).crossJoin(hubs)


def from_json(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices (id, type, description; the last of an id by its position) and edges (src, dst, relation, strength).

    Ends of relations that no entity names become vertices of the default type.
    """
    named = entities.where("id is not null").groupBy("id").agg(F.max_by(F.struct("type", "description"), "position").alias("x")).select("id", "x.type", "x.description")
    edges = relations.where("src is not null and dst is not null").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max("relation").alias("relation"), F.max("strength").alias("strength"))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().join(named, "id", "left_anti")
    return named.unionByName(ends.select("id", F.lit("default").alias("type"), F.lit("").alias("description"))), edges


def chunk_vertices(chunks: DataFrame) -> DataFrame:
    """id, type and preview (100 characters) of a vertex for each chunk."""
    preview = F.when(F.length("text") > 100, F.concat(F.substring("text", 1, 100), F.lit("..."))).otherwise(F.col("text"))
    return chunks.select(F.concat(F.lit("chunk:"), "chunk_id").alias("id"), F.lit("chunk").alias("type"), preview.alias("preview"))


def chunk_statistics(chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: vertices of chunks, of everything else, all, and edges."""
    pairs = canonical(edges)
    counts = _ends(pairs).agg(F.countDistinct("id").alias("other_nodes"), (F.count("*") / 2).cast("long").alias("edges"))
    return chunks.agg(F.countDistinct("chunk_id").alias("chunk_nodes")).crossJoin(counts).withColumn("nodes", F.col("chunk_nodes") + F.col("other_nodes"))


def communities(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """id, community by label propagation: each round a vertex takes the label most frequent around it, ties to the smaller.

    Communities of the modularity method depend on its order of visits; this one gives the same labels every time.
    """
    pairs = canonical(edges)
    both = _cut(pairs.union(pairs.select("b", "a")))
    labels = _cut(both.select(F.col("a").alias("id")).distinct().withColumn("community", F.col("id")))
    for _ in range(rounds):
        votes = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a", "community").agg(F.count("*").alias("n"))
        best = F.row_number().over(W.partitionBy("a").orderBy(F.desc("n"), "community"))
        labels = _cut(votes.withColumn("r", best).where("r = 1").select(F.col("a").alias("id"), "community"))
    return labels


def top_communities(found: DataFrame, k: int = 5, shown: int = 5) -> DataFrame:
    """community, size and its first members by name, of the k largest."""
    top = found.groupBy("community").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "community").limit(k)
    first = found.join(F.broadcast(top), "community").withColumn("r", F.row_number().over(W.partitionBy("community").orderBy("id"))).where(F.col("r") <= shown)
    return first.groupBy("community", "size").agg(F.array_join(F.array_sort(F.collect_list("id")), ", ").alias("members"))
