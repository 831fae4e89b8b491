"""Exact top-k by integer inner products over norm-sorted vectors.

Candidates are dealt by descending length and each task works through its share in that order; a query is done with a
task once its length x the candidates' length can't reach its k-th best score so far, and the task ends when all are.
Vectors are rotated by the right singular vectors of the whole table (from its Gram matrix), so that the first
coordinates hold most of the length; a candidate is dropped when the partial sum of the first coordinates plus the
Cauchy-Schwarz bound of the rest (residual length x residual length) can't reach that score. How many coordinates come
first follows from the singular values (RESTS). What is left is scored exactly in integers, and the tasks' best are merged.

The queries go in blocks of bounded bytes to all tasks, one block after the other, and a block's broadcast goes when it
is answered; each block starts from the k-th best scores that it reaches among the longest candidates.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Shared, stash

#: Bytes of a block of queries (their integers, and as many for their rotation), candidates in a task and in a step of it,
#: and queries held against a step at once.
BLOCK_BYTES, TASK_ROWS, STEP_ROWS, STEP_QUERIES = 1 << 25, 16_384, 2048, 1024
#: Shares of the squared lengths that may be left beyond the rotated coordinates of each step of the partial sums. A matrix
#: product is far cheaper than picking pairs, so few pairs should be left after the first step.
RESTS = (0.1,)
#: Vectors must be shorter than this, so that all inner products fit a long.
LONGEST = 2.0**31


def usable(vector: Column, zero: bool = True) -> Column:
    """Not null, no null or non-finite component; unless zero, not of length 0 either."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    good = vector.isNotNull() & good
    return F.coalesce(good if zero else good & F.exists(vector, lambda x: x != 0), F.lit(False))


def padded(vectors, width: int, kind=np.float64) -> np.ndarray:
    """Rows of a batch as a matrix; vectors shorter than width are filled with 0."""
    out = np.zeros((len(vectors), width), dtype=kind)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _gram(vectors: DataFrame, width: int) -> np.ndarray:
    """Sum of the outer products of all vectors: width x width numbers, summed by tasks and then by Spark."""

    def run(batches):
        total = np.zeros((width, width))
        for batch in batches:
            m = padded(batch["v"], width)
            total += m.T @ m
        yield pd.DataFrame({"i": np.arange(width * width), "s": total.ravel()})

    found = vectors.select("v").mapInPandas(run, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).toArrow().to_pandas()
    out = np.zeros(width * width)
    out[found["i"]] = found["s"]
    return out.reshape(width, width)


class Best:
    """The k best (score, smaller id first) of each query so far."""

    def __init__(self, queries: int, k: int, kind=np.int64):
        self.k = k
        self.score = np.zeros((queries, 0), dtype=kind)
        self.id = np.zeros((queries, 0), dtype=np.int64)
        self.count = np.zeros(queries, dtype=np.int64)
        low = np.iinfo(np.int64).min if kind == np.int64 else -np.inf
        self.score = np.full((queries, k), low, dtype=kind)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)

    def add(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Merges (query index, id, score) triples."""
        if not len(q):
            return
        touched = np.unique(q)
        keep = np.repeat(touched, np.minimum(self.count[touched], self.k))
        at = np.concatenate([np.arange(n) for n in np.minimum(self.count[touched], self.k)]) if len(keep) else np.zeros(0, np.int64)
        q, ids, scores = np.concatenate([keep, q]), np.concatenate([self.id[keep, at], ids]), np.concatenate([self.score[keep, at], scores])
        order = np.lexsort((ids, -scores, q))
        q, ids, scores = q[order], ids[order], scores[order]
        starts = np.r_[0, np.flatnonzero(np.diff(q)) + 1]
        rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
        top = rank < self.k
        self.score[q[top], rank[top]], self.id[q[top], rank[top]] = scores[top], ids[top]
        self.count[touched] = np.minimum(self.k, np.bincount(q[top], minlength=len(self.count))[touched])

    def floor(self) -> np.ndarray:
        """The k-th best score of each query, -inf while there are fewer."""
        return np.where(self.count >= self.k, self.score[:, self.k - 1].astype(float), -np.inf)

    def frame(self, ids: np.ndarray, least: np.ndarray) -> pd.DataFrame:
        """Rows (query_id, vec_id, score) that reach the bound given."""
        q, at = np.nonzero(np.arange(self.k) < self.count[:, None])
        keep = self.score[q, at] >= least[q]
        q, at = q[keep], at[keep]
        return pd.DataFrame({"query_id": ids[q], "vec_id": self.id[q, at], "score": self.score[q, at]})


def _scan(candidates: np.ndarray, ids: np.ndarray, queries: dict, best: Best) -> bool:
    """One step: bounds from partial sums of rotated coordinates, then exact integer products of what is left.

    False if no query can gain by shorter candidates.
    """
    rotated = candidates.astype(float) @ queries["rotation"]
    lengths = np.sqrt((rotated**2).sum(1))
    heads = queries["heads"]
    rest = {h: np.sqrt(np.maximum(0.0, (rotated[:, h:] ** 2).sum(1))) for h in heads}
    open_ = np.flatnonzero(lengths.max(initial=0.0) * queries["length"] * (1 + 1e-9) + 1e-6 >= np.maximum(best.floor(), queries["floor"]))
    for j in range(0, len(open_), STEP_QUERIES):
        own = open_[j : j + STEP_QUERIES]
        least = np.maximum(best.floor(), queries["floor"])[own]
        slack = 1e-9 * (1.0 + np.outer(lengths, queries["length"][own]))
        h = heads[0]
        sums = rotated[:, :h] @ queries["rotated"][own, :h].T
        c, q = np.nonzero(sums + np.outer(rest[h], queries["rest"][h][own]) + slack >= least)
        sums, slack = sums[c, q], slack[c, q]
        for at, h in zip(heads, heads[1:], strict=False):
            sums = sums + np.einsum("ij,ij->i", rotated[c, at:h], queries["rotated"][own[q], at:h])
            keep = sums + rest[h][c] * queries["rest"][h][own[q]] + slack >= least[q]
            c, q, sums, slack = c[keep], q[keep], sums[keep], slack[keep]
        for i in range(0, len(c), 200_000):
            cc, qq = c[i : i + 200_000], own[q[i : i + 200_000]]
            score = np.einsum("ij,ij->i", candidates[cc], queries["ints"][qq])
            keep = (ids[cc] != queries["ids"][qq]) & (score >= np.maximum(best.floor(), queries["floor"])[qq])
            best.add(qq[keep], ids[cc[keep]], score[keep])
    return len(open_) > 0


def exact_topk(embeddings: DataFrame, k: int = 10, scale: int = 1024, is_query: Column | None = None, rests: tuple[float, ...] = RESTS) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query among all other vectors.

    Components x become floor(scale * x) as longs. Queries are the rows that is_query selects (vec_id % 100 = 0).
    Vectors that are null or hold null or non-finite components, and rows without vec_id, take no part. Shorter vectors
    count as filled with 0. Ties go to the smaller vec_id; rows that share a query's vec_id count as its own; a vec_id
    that occurs several times as a query is answered once, by its lexicographically smallest vector. Raises if an
    integer vector is as long as LONGEST, as its products might not fit a long.
    """
    is_query = F.col("vec_id") % 100 == 0 if is_query is None else is_query
    ints = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = embeddings.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), ints.alias("v"))
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    rows = stash(rows.withColumn("length", length), "vectors")
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("w"), F.max("length").alias("longest")).first()
    out = "query_id long, vec_id long, score long"
    empty = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not size["n"]:
        return empty
    if size["longest"] >= LONGEST**2:
        raise ValueError(f"a vector is longer than {LONGEST:.0f} after scaling: its inner products may not fit a long")
    width, tasks = max(1, size["w"]), max(1, -(-size["n"] // TASK_ROWS))
    values, vectors = np.linalg.eigh(_gram(rows, width))
    rotation = np.ascontiguousarray(vectors[:, ::-1])
    held = np.cumsum(np.maximum(values[::-1], 0.0))
    heads = sorted({min(width, int(np.searchsorted(held, (1 - share) * held[-1])) + 1) for share in rests})
    asked = stash(rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    number = asked.count()
    if not number:
        return empty
    blocks = -(-number * width * 16 // BLOCK_BYTES)
    longest = rows.orderBy(F.desc("length"), "vec_id").limit(STEP_ROWS).toArrow().to_pandas()
    sorted_rows = rows.repartitionByRange(tasks, F.desc("length"), "vec_id").sortWithinPartitions(F.desc("length"), "vec_id")
    sorted_rows = stash(sorted_rows, "sorted") if blocks > 1 else sorted_rows
    parts = []
    for block in range(blocks):
        found = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).toArrow().to_pandas()
        if not len(found):
            continue
        matrix = padded(found["v"], width, np.int64)
        rotated = matrix.astype(float) @ rotation
        queries = {"ids": found["vec_id"].to_numpy(np.int64), "ints": matrix, "rotation": rotation, "rotated": rotated, "heads": heads, "rest": {h: np.sqrt((rotated[:, h:] ** 2).sum(1)) for h in heads}, "length": np.sqrt((rotated**2).sum(1)), "floor": np.full(len(found), -np.inf)}
        first = Best(len(found), k)
        _scan(padded(longest["v"], width, np.int64), longest["vec_id"].to_numpy(np.int64), queries, first)
        queries["floor"] = first.floor()
        shared = Shared(rows.sparkSession, queries)

        def run(batches, shared=shared):
            asked = shared.value
            best = Best(len(asked["ids"]), k)
            going = True
            for batch in batches:
                for i in range(0, len(batch) if going else 0, STEP_ROWS):
                    part = batch.iloc[i : i + STEP_ROWS]
                    going = _scan(padded(part["v"], width, np.int64), part["vec_id"].to_numpy(np.int64), asked, best)
                    if not going:
                        break
            yield best.frame(asked["ids"], np.maximum(best.floor(), asked["floor"]))

        answers = ranked(sorted_rows.select("vec_id", "v").mapInPandas(run, out), k, tasks)
        parts.append(stash(answers, "answers") if blocks > 1 else answers)
        if blocks > 1:
            shared.release()
    return reduce(DataFrame.unionAll, parts)


def ranked(found: DataFrame, k: int, tasks: int = 1) -> DataFrame:
    """The k best of each query_id, ties to the smaller vec_id; of the rows of many tasks, first within parts of them."""
    best = (F.desc("score"), "vec_id")
    parts = max(16, min(64, int(tasks**0.5)))
    if tasks > 1:
        part = F.pmod(F.xxhash64("vec_id"), F.lit(parts))
        found = found.withColumn("_part", part).withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "_part").orderBy(*best))).where(F.col("rank") <= k)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*best))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    list_sum(list_transform(generate_series(1, len(q.e)), lambda i: q.e[i] * c.e[i]))::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, k::INTEGER AS rank, vec_id, score FROM r WHERE k <= 10"""
