"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first search.

The tree (`branch` children a node, as many levels as the rows ask for) is fitted on a bounded sample; every row is
indexed under the leaf that its nearest centres lead to. A query walks the tree with a priority queue: the node nearest
to it is opened next, and leaves come out in order of promise. How many leaves a query visits is calibrated: sample
queries are answered exactly over all rows, and the visits widen until the recall wanted is reached.

Queries walk the tree in the tasks that hold them, and travel to their leaves. A leaf's rows are cut into parts and its
queries into blocks of bounded size, and each task holds one part against one block.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Shared, fold, release, stash
from .topk import TASK_ROWS, Best, padded, ranked, usable

STEP_ROWS = 4096
#: Queries that a task holds against a part of a leaf; rows wanted in a leaf; the tree's levels; rows of the sample a leaf.
QUERY_BLOCK, LEAF_ROWS, LEVELS, LEAF_SAMPLE = 4096, 8192, (2, 4), 16


@dataclass(frozen=True)
class Tree:
    """centres: by level, [node, child, dimension]; a node's children are numbered node * branch + child."""

    branch: int
    centres: tuple[np.ndarray, ...]

    @property
    def leaves(self) -> int:
        return self.branch ** len(self.centres)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: the nearest child at every level."""
        node = np.zeros(len(x), dtype=np.int64)
        for level in self.centres:
            chosen = np.empty(len(x), dtype=np.int64)
            for n in np.unique(node):
                at = node == n
                c = level[n]
                chosen[at] = ((c**2).sum(1) - 2 * x[at] @ c.T).argmin(1)
            node = node * self.branch + chosen
        return node

    def order(self, q: np.ndarray, visits: int, sizes: np.ndarray | None = None) -> list[int]:
        """Leaves in best-bin-first order, `visits` of them; empty ones don't count where sizes are given."""
        out: list[int] = []
        queue = [(0.0, 0, 0)]
        while queue and len(out) < visits:
            _, level, node = heapq.heappop(queue)
            if level == len(self.centres):
                if sizes is None or sizes[node]:
                    out.append(node)
                continue
            distance = ((self.centres[level][node] - q) ** 2).sum(1)
            for child, d in enumerate(distance.tolist()):
                heapq.heappush(queue, (d, level + 1, node * self.branch + child))
        return out


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, steps: int = 12) -> np.ndarray:
    if not len(x):
        return np.zeros((k, x.shape[1]))
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(steps):
        nearest = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
        sizes = np.bincount(nearest, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        centres[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return centres


def fit_tree(sample: np.ndarray, branch: int = 8, depth: int = 2, seed: int = 7) -> Tree:
    rng = np.random.default_rng(seed)
    node = np.zeros(len(sample), dtype=np.int64)
    levels = []
    for level in range(depth):
        centres = np.zeros((branch**level, branch, sample.shape[1]))
        for n in range(branch**level):
            centres[n] = _kmeans(sample[node == n], branch, rng)
        levels.append(centres)
        node = Tree(branch, tuple(levels)).assign(sample)
    return Tree(branch, tuple(levels))


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row inner products in doubles, components in order, so that equal vectors get equal scores."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total


def _search(x: np.ndarray, ids: np.ndarray, q: np.ndarray, query_ids: np.ndarray, which: np.ndarray, best: Best) -> None:
    """Adds the rows x for the queries numbered which: rough products by matrix, exact ones for those in reach."""
    least = best.floor()[which]
    rough = x @ q[which].T
    slack = 1e-9 * (1.0 + np.abs(rough))
    rough[ids[:, None] == query_ids[which]] = -np.inf  # all rows of the query's vec_id are its own
    if len(x) >= best.k:
        kth = np.partition(rough, -best.k, axis=0)[-best.k]
        least = np.maximum(least, kth)
    c, w = np.nonzero(rough + slack >= least)
    for i in range(0, len(c), 200_000):
        cc, qq = c[i : i + 200_000], which[w[i : i + 200_000]]
        keep = ids[cc] != query_ids[qq]
        best.add(qq[keep], ids[cc[keep]], inner(x[cc[keep]], q[qq[keep]]))


def _exact(rows: DataFrame, queries: np.ndarray, query_ids: np.ndarray, k: int, width: int) -> DataFrame:
    """query_id, vec_id, score: the best in each task, over all rows, for a bounded number of queries."""
    shared = Shared(rows.sparkSession, (queries, query_ids))

    def run(batches):
        q, names = shared.value
        best = Best(len(q), k, np.float64)
        for batch in batches:
            x, ids = padded(batch["v"], width), batch["vec_id"].to_numpy(np.int64)
            for i in range(0, len(x), STEP_ROWS):
                _search(x[i : i + STEP_ROWS], ids[i : i + STEP_ROWS], q, names, np.arange(len(q)), best)
        yield best.frame(names, best.floor())

    return rows.select("vec_id", "v").mapInPandas(run, "query_id long, vec_id long, score double")


def _answers(indexed: DataFrame, asked: DataFrame, shared: Shared, sizes: np.ndarray, visits: int, k: int, width: int) -> DataFrame:
    """query_id, vec_id, score: the best of each part of the leaves that a query visits."""
    spark = indexed.sparkSession

    def walk(batches):
        own = shared.value
        for batch in batches:
            leaves = [own.order(x, visits, sizes) for x in padded(batch["v"], width)]
            yield pd.DataFrame({"query_id": batch["vec_id"], "q": batch["v"], "leaf": leaves})

    sent = asked.select("vec_id", "v").mapInPandas(walk, "query_id long, q array<double>, leaf array<long>")
    sent = stash(sent.select("query_id", "q", F.explode("leaf").alias("leaf")), "visits")
    load = {r["leaf"]: r["n"] for r in sent.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # a row a leaf
    table = [(leaf, -(-int(sizes[leaf]) // TASK_ROWS), -(-n // QUERY_BLOCK)) for leaf, n in load.items()]
    leaves = F.broadcast(spark.createDataFrame(table, "leaf long, parts int, blocks int"))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    queries = sent.join(leaves, "leaf").select("leaf", each("parts").alias("part"), deal("query_id", "blocks").alias("block"), "query_id", "q")
    rows = indexed.join(leaves, "leaf").select("leaf", deal("vec_id", "parts").alias("part"), each("blocks").alias("block"), "vec_id", "v")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names, ids = right["query_id"].to_numpy(np.int64), left["vec_id"].to_numpy(np.int64)
        best = Best(len(names), k, np.float64)
        if len(names) and len(ids):
            q, x = padded(right["q"], width), padded(left["v"], width)
            for i in range(0, len(x), STEP_ROWS):
                for j in range(0, len(q), 1024):
                    _search(x[i : i + STEP_ROWS], ids[i : i + STEP_ROWS], q, names, np.arange(j, min(len(q), j + 1024)), best)
        return best.frame(names, best.floor())

    keys = ["leaf", "part", "block"]
    return rows.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(run, "query_id long, vec_id long, score double")


def nearest(embeddings: DataFrame, k: int = 20, is_query: Column | None = None, recall: float = 0.97, sample_rows: int = 20_000, calibration: int = 128, branch: int = 8, depth: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: about the k largest inner products of each query among all other vectors.

    Queries are the rows that is_query selects (vec_id % 20 = 0). Vectors that are null, zero or hold null or
    non-finite components, and rows without vec_id, take no part. Scores are exact, in doubles, on the vectors given;
    shorter vectors count as filled with 0. Ties go to the smaller vec_id; rows that share a query's vec_id count as
    its own; a vec_id that occurs several times as a query is answered once, by its smallest vector.

    Bounded: the tree's levels (LEVELS, as many as leaves of LEAF_ROWS rows ask for, unless depth is given) and its
    sample (sample_rows, or LEAF_SAMPLE rows a leaf if those are more), the calibration's queries. The index holds every
    row.
    """
    is_query = F.col("vec_id") % 20 == 0 if is_query is None else is_query
    spark = embeddings.sparkSession
    rows = embeddings.where(usable(F.col("embedding"), zero=False) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("w")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not size["n"]:
        return empty
    width = size["w"]
    if depth is None:
        depth = next((d for d in range(LEVELS[0], LEVELS[1]) if size["n"] <= LEAF_ROWS * branch**d), LEVELS[1])
    share = min(1.0, max(sample_rows, LEAF_SAMPLE * branch**depth) / size["n"])
    sample = padded(rows.where(fold(F.col("vec_id"), 1_000_000, "tree") < int(share * 1_000_000)).select("v").toArrow().to_pandas()["v"], width)
    tree = fit_tree(sample if len(sample) else np.zeros((1, width)), branch, depth)
    shared_tree = Shared(spark, tree)

    def place(batches):
        own = shared_tree.value
        for batch in batches:
            yield batch.assign(leaf=own.assign(padded(batch["v"], width)))

    indexed = rows.mapInPandas(place, "vec_id long, v array<double>, leaf long")
    indexed = stash(indexed, "index")
    sizes = np.zeros(tree.leaves, dtype=np.int64)
    for r in indexed.groupBy("leaf").agg(F.count("*").alias("n")).collect():
        sizes[r["leaf"]] = r["n"]
    asked = stash(indexed.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    number = asked.count()
    if not number:
        return empty
    few = asked.where(fold(F.col("vec_id"), 1_000_000, "calibrate") < int(min(1.0, calibration / number) * 1_000_000) + 1).toArrow().to_pandas()
    few = few if len(few) else asked.limit(1).toArrow().to_pandas()
    visits = _calibrated(indexed, tree, sizes, padded(few["v"], width), few["vec_id"].to_numpy(np.int64), recall, k, width)
    found = _answers(indexed, asked, shared_tree, sizes, visits, k, width)
    out = stash(ranked(found, k, visits), "answers")
    release(indexed, asked)
    return out


def _calibrated(indexed: DataFrame, tree: Tree, sizes: np.ndarray, q: np.ndarray, ids: np.ndarray, recall: float, k: int, width: int) -> int:
    """The fewest leaves that reach the recall on the sample queries, widened step by step; all leaves at most."""
    best = ranked(_exact(indexed, q, ids, k, width), k)
    truth = best.join(indexed.select("vec_id", "leaf").dropDuplicates(["vec_id"]), "vec_id").select("query_id", "leaf").toArrow().to_pandas()
    number = int((sizes > 0).sum())
    place = {(int(i), leaf): p for i, x in zip(ids, q, strict=True) for p, leaf in enumerate(tree.order(x, number, sizes))}
    depth = np.sort([place[int(a), int(b)] for a, b in zip(truth["query_id"], truth["leaf"], strict=True)])
    visits = 1
    while visits < number and len(depth) and np.searchsorted(depth, visits) / len(depth) < recall:
        visits += 1
    return visits
