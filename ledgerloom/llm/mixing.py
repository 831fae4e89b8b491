"""Mixing sources to target weights by soft membership.

A naive Bayes classifier, learnt from the rows of the labelled table, predicts every document's posterior over the
domains. Distributed projected-gradient least squares then fits a nonnegative rate for each document, so that the
expected tokens of each domain, the sum of rate x tokens x posterior, match the targets.

A rate is a function of the document's posterior and the steps' gradients, which are vectors as long as there are
domains: r = 1, then r = max(0, r - step x <gradient, posterior>) for each step. So each step is one aggregation to a
few numbers, no rates are stored, and a lost executor loses nothing.
"""

from __future__ import annotations

import math
import warnings
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW, Shared, WordTable, fold, held_out, keyed, stash

CLASSES_SEPARATOR = "|"


@dataclass(frozen=True)
class DomainModel:
    """logp: hash of a word x domain; prior: the domains' log-shares of the labelled rows."""

    domains: tuple[str, ...]
    bits: int
    logp: np.ndarray
    prior: np.ndarray


def fit_domains(documents: DataFrame, labels: DataFrame, domain: Column, max_rows: int = 12_000, bits: int = 18) -> DomainModel:
    """Learns from at most about max_rows documents of the labelled table, none held out; domain is their class.

    Counts are of the documents that hold a word. Documents with a null domain teach nothing.
    """
    known = labels.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id").distinct()
    share = min(1.0, max_rows / max(1, known.count()))
    known = known.where(fold(F.col("doc_id"), 1_000_000, "mixing") < int(share * 1_000_000))
    sample = documents.select("doc_id", domain.alias("d"), "text").join(F.broadcast(known), "doc_id").where(F.col("d").isNotNull())
    words = F.array_distinct(F.transform(F.split(F.lower(F.coalesce("text", F.lit(""))), r"(?U)\s+"), lambda w: F.pmod(F.crc32(w.cast("binary")), F.lit(1 << bits)).cast("int")))
    rows = sample.select("d", words.alias("w"))
    sizes = {r["d"]: r["n"] for r in rows.groupBy("d").agg(F.count("*").alias("n")).collect()}
    domains = tuple(sorted(sizes))
    if not domains:
        return DomainModel(("",), bits, np.zeros((1 << bits, 1), np.float32), np.zeros(1))
    found = rows.select("d", F.explode("w").alias("h")).groupBy("d", "h").agg(F.count("*").alias("c")).toArrow().to_pandas()
    counts = np.zeros((1 << bits, len(domains)))
    counts[found["h"].to_numpy(int), [domains.index(x) for x in found["d"]]] = found["c"]
    n = np.array([sizes[d] for d in domains], dtype=float)
    pooled = (counts.sum(1, keepdims=True) + 0.5) / (n.sum() + 1)
    each = (counts + 5 * pooled) / (n + 5)
    return DomainModel(domains, bits, (np.log(each) - np.log(pooled)).astype(np.float32), np.log((n + 1) / (n + 1).sum()))


def posteriors(documents: DataFrame, model: DomainModel, keep: list[str], sharpness: float = 0.2, most: float = 8.0) -> DataFrame:
    """keep's columns, n_tokens (words) and p0, p1, ...: the posterior of each domain, from whole texts.

    Words depend on each other, so their evidence is damped by sharpness and its spread bounded by `most`. Texts
    without words have the prior.
    """
    k = len(model.domains)
    rows = documents.select(*keep, "text")
    shared = Shared(documents.sparkSession, model)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches):
        m = shared.value
        mask = (1 << m.bits) - 1
        words = WordTable(lambda ws: m.logp[[zlib.crc32(w.encode("utf-8", "replace")) & mask for w in ws]], k)
        for batch in batches:
            sizes, found = [], np.zeros((len(batch), k))
            for i, text in enumerate(batch["text"]):
                tokens = (text or "").lower().split()
                total = np.zeros(k)
                for part in words.rows(tokens):
                    total += part.sum(0)
                z = m.prior + np.maximum((total - total.max()) * sharpness, -most)
                z = np.exp(z - z.max())
                found[i] = z / z.sum()
                sizes.append(len(tokens))
            out = batch[keep].copy()
            out["n_tokens"] = sizes
            for j in range(k):
                out[f"p{j}"] = found[:, j]
            yield out

    return rows.mapInPandas(run, f"{fields}, n_tokens long, " + ", ".join(f"p{j} double" for j in range(k)))


def _rate(steps: list[np.ndarray], k: int) -> Column:
    rate = F.lit(1.0)
    for step in steps:
        rate = F.greatest(F.lit(0.0), rate - sum((F.col(f"p{j}") * float(step[j]) for j in range(1, k)), F.col("p0") * float(step[0])))
    return rate


def fit_rates(rows: DataFrame, domains: tuple[str, ...], targets: dict[str, float] | None = None, temperature: float = 0.5, steps: int = 30, tolerance: float = 1e-4) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The gradient steps, and the expected and the target shares of tokens. rows: n_tokens and p0, p1, ...

    targets are weights by domain; without them, the domains' expected shares to the power of temperature. The total
    of tokens stays as it is. Steps are preconditioned by each domain's own second moment.
    """
    k = len(domains)
    w = F.col("n_tokens").cast("double")
    one = rows.agg(F.sum(w).alias("n"), *(F.sum(w * F.col(f"p{j}")).alias(f"s{j}") for j in range(k)), *(F.sum(w * F.col(f"p{i}") * F.col(f"p{j}")).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k))).first()
    total = one["n"] or 0.0
    if not total:
        return [], np.zeros(k), np.zeros(k)
    share = np.array([one[f"s{j}"] for j in range(k)]) / total
    gram = np.array([[one[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) / total
    goal = np.array([max(0.0, targets.get(d, 0.0)) for d in domains]) if targets else share**temperature
    goal = goal / goal.sum() if goal.sum() else share
    # gradient steps in the metric of the inverse moments: exact in one step while no rate meets 0
    inverse = np.linalg.pinv(gram + 1e-9 * np.eye(k))
    taken: list[np.ndarray] = []
    now = share
    for _ in range(steps):
        gap = now - goal
        if np.abs(gap).max() <= tolerance:
            break
        taken.append(inverse @ gap)
        found = rows.agg(*(F.sum(w * F.col(f"p{j}") * _rate(taken, k)).alias(f"s{j}") for j in range(k))).first()
        now = np.array([found[f"s{j}"] for j in range(k)]) / total
    return taken, now, goal


def mix(documents: DataFrame, model: DomainModel, keep: list[str], targets: dict[str, float] | None = None) -> DataFrame:
    """keep's columns, n_tokens, domain (the likeliest), rate and copies of every document.

    copies is the rate rounded up or down by a hash of doc_id and text, so that its expectation is the rate (equal rows
    share their draw). Documents without words weigh nothing; they keep the rate that their prior gets. Warns where the
    expected shares of tokens miss the targets by more than a hundredth, as nonnegative rates may not reach them.
    """
    k = len(model.domains)
    chance = F.pmod(F.xxhash64(F.lit("copies"), F.col("doc_id"), F.col("text")), F.lit(1 << 30)) / float(1 << 30)
    rows = stash(posteriors(documents.withColumn("_chance", chance), model, [*keep, "_chance"]), "posteriors")
    taken, now, goal = fit_rates(rows, model.domains, targets)
    if np.abs(now - goal).max(initial=0.0) > 0.01:
        warnings.warn(f"expected shares {now.round(4).tolist()} miss the targets {goal.round(4).tolist()}", stacklevel=2)
    top = F.array_position(F.array(*(F.col(f"p{j}") for j in range(k))), F.greatest(*(F.col(f"p{j}") for j in range(k)), F.lit(0.0))).cast("int")
    names = F.array(*(F.lit(d) for d in model.domains))
    out = rows.select(*keep, "_chance", "n_tokens", names[top - 1].alias("domain"), _rate(taken, k).alias("rate"))
    return out.withColumn("copies", (F.floor("rate") + (F.col("_chance") < F.col("rate") - F.floor("rate")).cast("int")).cast("int")).drop("_chance")


def sample_mixed(documents: DataFrame, model: DomainModel, targets: dict[str, float] | None = None) -> DataFrame:
    """documents with each row repeated `copies` times (not at all for 0), all columns kept, whatever its doc_id."""
    rows = keyed(documents)
    found = stash(mix(rows, model, [ROW], targets).select(ROW, F.col("copies").alias("_copies")).where("_copies > 0"), "copies")
    joined = rows.join(found, ROW)
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).drop("_copies", "_copy").select(*documents.columns)
