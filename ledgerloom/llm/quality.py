"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

A logistic classifier on surface statistics of the text gives each document's evidence. Grouped aggregation gives each
path and host the mean of its documents' probabilities (labels count where they are known), and each mean is shrunk
toward its parent: path toward host, host toward the global rate, with prior strengths estimated by the method of
moments from how much the sites differ. A document's score is its evidence moved by how far its site's posterior lies
from the global rate.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dealt_join, fit_logistic, held_out, labelled, lookup, pieces_of, release, stash

_LETTERS = re.compile(r"[^\W\d_]")
_DIGITS = re.compile(r"\d")
_BLANK = re.compile(r"\s")
FEATURES = 12


def features(text: str | None) -> list[float]:
    """Surface statistics of a whole text; all 0 but the first for a null or blank one."""
    text = text or ""
    words = text.split()
    if not words:
        return [1.0] + [0.0] * (FEATURES - 1)
    n, k = len(text), len(words)
    lines = [x for x in text.split("\n") if x.strip()]
    distinct = len(set(words))
    letters, digits = len(_LETTERS.findall(text)), len(_DIGITS.findall(text))
    odd = n - letters - digits - len(_BLANK.findall(text))
    return [
        0.0,
        min(1.0, np.log1p(k) / 10),
        letters / n,
        digits / n * 5,
        odd / n * 5,
        min(3.0, (n / k) / 6),
        distinct / k,
        distinct / k**0.5 / 10,
        1 - len(set(lines)) / len(lines),
        min(3.0, k / len(lines) / 50),
        sum(x[-1] in ".!?\"')" for x in lines) / len(lines),
        text.count(words[0]) / k,
    ]


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray
    rate: float


def _with_features(df: DataFrame, keep: list[str]) -> DataFrame:
    rows = df.select(*keep, "text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches):
        for batch in batches:
            for part in pieces_of(batch, ["text"]):
                out = part[keep].copy()
                out["x"] = [features(t) for t in part["text"]]
                yield out

    return rows.mapInPandas(run, f"{fields}, x array<double>")


def fit_quality(documents: DataFrame, labels: DataFrame, max_per_class: int = 8000) -> QualityModel:
    """Learns from at most about max_per_class labelled documents of each class, none of them held out.

    rate is the share of quality 1 among all labels that are not held out (0.5 without any)."""
    seen = labels.where(~held_out(F.col("doc_id")) & F.col("quality").isin(0, 1)).agg(F.avg("quality")).first()[0]
    found = _with_features(labelled(documents, labels, "quality", max_per_class, ["text"]), ["y"]).toArrow().to_pandas()
    y = found["y"].to_numpy(float)
    x = np.array(found["x"].tolist(), dtype=float).reshape(-1, FEATURES)
    rate = min(0.999, max(0.001, 0.5 if seen is None else float(seen)))
    if len(set(y)) < 2:
        return QualityModel(np.array([0.0] * FEATURES + [np.log(rate / (1 - rate))]), rate)
    w = fit_logistic(x, y, ridge=0.1)
    w[-1] += np.log(rate / (1 - rate)) - np.log(y.mean() / (1 - y.mean()))  # the sample is balanced, the corpus isn't
    return QualityModel(w, rate)


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, parent: str) -> float:
    """Pseudo-count of the prior, by the method of moments: within-group over between-group variance."""
    r = groups.where("n >= 2").agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("sq"), F.sum(F.col("n") * F.col(parent) * F.col(parent)).alias("pq"), F.sum(F.col("s") * F.col(parent)).alias("sp")).first()
    if not r["k"] or r["n"] <= r["k"]:
        return 50.0
    within = max((r["ss"] - r["sq"]) / (r["n"] - r["k"]), 1e-9)
    between = (r["sq"] - 2 * r["sp"] + r["pq"] - r["k"] * within) / r["n"]
    return float(min(1e6, max(1.0, within / max(between, 1e-9))))


def score_quality(documents: DataFrame, labels: DataFrame, model: QualityModel, host: Column | None = None, path: Column | None = None, least: float = 0.5, site_weight: float = 1.0) -> DataFrame:
    """doc_id, evidence, host_rate, path_rate, score (0 to 1) and keep of every document, by its whole text.

    host is the source and path the language section of it, unless given. A null host or path is a group of its own.
    A null or empty text is scored by its site and the classifier's value for blank texts. Repeated rows count as often
    as they occur; labels of held-out documents are never used; of several labels of a doc_id the largest counts.
    """
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    *w, b = (float(v) for v in model.weights)
    base = documents.select("doc_id", F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path"), "text")
    z = sum((F.col("x")[i] * k for i, k in enumerate(w)), F.lit(b))
    rows = stash(_with_features(base, ["doc_id", "host", "path"]).select("doc_id", "host", "path", (1 / (1 + F.exp(-z))).alias("evidence")), "quality")
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").cast("double").alias("q"))
    p = F.coalesce(F.col("q"), F.col("evidence"))
    by_path = stash(dealt_join(rows, known, "doc_id", "left").groupBy("host", "path").agg(F.count("*").cast("double").alias("n"), F.sum(p).alias("s"), F.sum(p * p).alias("ss")), "paths")
    total = by_path.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    rate = total["s"] / total["n"] if total["n"] else model.rate
    by_host = by_path.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss")).withColumn("parent", F.lit(rate))
    k = _strength(by_host, "parent")
    by_host = stash(by_host.select("host", ((F.col("s") + k * rate) / (F.col("n") + k)).alias("host_rate")), "hosts")
    sites = lookup(by_path, by_host, "host", "inner")
    k = _strength(sites, "host_rate")
    sites = stash(sites.select("host", "path", "host_rate", ((F.col("s") + k * F.col("host_rate")) / (F.col("n") + k)).alias("path_rate")), "sites")
    scored = lookup(rows, sites, ["host", "path"], "inner")
    release(by_path)
    score = 1 / (1 + F.exp(-(_logit(F.col("evidence")) + site_weight * (_logit(F.col("path_rate")) - _logit(F.lit(rate))))))
    return scored.select("doc_id", "evidence", "host_rate", "path_rate", score.alias("score")).withColumn("keep", F.col("score") >= least)
