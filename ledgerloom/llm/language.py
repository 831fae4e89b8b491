"""Language ID by Bayesian evidence fusion.

Four sources of evidence are fused as log-probabilities: character n-gram likelihoods of the text, the language that
the markup declares, the address suffix (the path segment or country domain that names a language), and a prior of the
host. The host's prior is smoothed hierarchically: sums of the texts' posteriors by host shrink toward those of the
parent domain, and these toward the global ones, all by grouped aggregation. How far declarations and suffixes can be
trusted is learnt from how often they agree with the texts' posteriors.
"""

from __future__ import annotations

import html as entities
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shared, WordTable, fold, lookup, release, stash
from .urls import host_and_path

#: Shares that a pseudo-observation of the parent has at a host and at a domain.
PRIOR_STRENGTH = 20.0
_DECLARED = re.compile(r"""<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]{2,3})""", re.I)
_HIDDEN = re.compile(r"<(script|style)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<[^>]*>", re.I | re.S)
# Names under country domains that are no sites of their own.
SECOND_LEVEL = frozenset("ac co com edu gob gouv gov mil net org".split())


@dataclass(frozen=True)
class LanguageModel:
    """logp: n-gram hash x language, natural logs relative to the pooled text; seen: whether the n-gram is known."""

    languages: tuple[str, ...]
    n: int
    bits: int
    logp: np.ndarray
    seen: np.ndarray


def word_logs(m: LanguageModel) -> WordTable:
    """word -> the languages' log-likelihood ratios, n-grams, known n-grams."""
    mask, n = (1 << m.bits) - 1, m.n

    def vectors(words: list[str]) -> np.ndarray:
        padded = [f" {w} " for w in words]
        sizes = np.array([max(1, len(p) - n + 1) for p in padded])
        ids = np.array([zlib.crc32(p[i : i + n].encode("utf-8", "replace")) & mask for p, k in zip(padded, sizes.tolist(), strict=True) for i in range(k)])
        at = np.cumsum(sizes) - sizes
        return np.column_stack([np.add.reduceat(m.logp[ids].astype(float), at, axis=0), sizes, np.add.reduceat(m.seen[ids].astype(float), at)])

    return WordTable(vectors, len(m.languages) + 2)


def fit_languages(documents: DataFrame, text: str = "text", lang: str = "lang", languages: tuple[str, ...] | None = None, n: int = 3, bits: int = 18, max_per_language: int = 3000, strength: float = 2.0, least_rows: int = 5) -> LanguageModel:
    """n-gram models of the languages from at most about max_per_language documents that name each of them.

    Unless given, languages are those that at least least_rows documents with a text name, in any case (all that are
    named, if none has so many).
    Counts are of distinct words, so copies don't weigh; they are smoothed toward the pooled counts.
    """
    rows = documents.select(F.lower(F.col(lang)).alias("l"), F.col(text).alias("t")).where("l != '' and t is not null")
    sizes = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if languages is None:
        languages = tuple(sorted(x for x, size in sizes.items() if size >= least_rows)) or tuple(sorted(sizes)) or ("und",)
    sizes = {x: size for x, size in sizes.items() if x in languages}
    share = F.lit(0.0)
    for name, size in sizes.items():
        share = F.when(F.col("l") == name, F.lit(min(1.0, max_per_language / size))).otherwise(share)
    sample = rows.where(fold(F.col("t"), 1_000_000, "language") < share * 1_000_000)
    words = sample.select("l", F.explode(F.array_distinct(F.split(F.lower("t"), r"(?U)\s+"))).alias("w")).where("w != ''").distinct()
    padded = F.concat(F.lit(" "), F.col("w"), F.lit(" "))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("p") - n + 1))
    grams = words.withColumn("p", padded).select("l", F.explode(F.transform(starts, lambda i: F.col("p").substr(i, F.lit(n)))).alias("g"))
    found = grams.groupBy("l", F.pmod(F.crc32(F.col("g").cast("binary")), F.lit(1 << bits)).cast("int").alias("h")).agg(F.count("*").alias("c")).toArrow().to_pandas()
    counts = np.zeros((1 << bits, len(languages)))
    counts[found["h"].to_numpy(int), [languages.index(x) for x in found["l"]]] = found["c"]
    pooled = counts.sum(1, keepdims=True) / max(1.0, counts.sum())
    totals = np.maximum(counts.sum(0), 1.0)
    each = (counts + strength * pooled * totals.mean() / 100 + 1e-3) / (totals + strength * totals.mean() / 100 + 1e-3 * len(counts))
    middle = each.mean(1, keepdims=True)
    return LanguageModel(languages, n, bits, (np.log(each) - np.log(middle)).astype(np.float32), (counts.sum(1) > 0).astype(np.float32))


def visible(html: str | None) -> str:
    """A page's text without markup, character references decoded, for language evidence alone."""
    return entities.unescape(_HIDDEN.sub(" ", html or ""))


def site(host: str) -> str:
    """The domain whose hosts share a prior: two labels, three under a second-level name of a country."""
    labels = host.split(".")
    return ".".join(labels[-3:] if len(labels) > 2 and len(labels[-1]) == 2 and labels[-2] in SECOND_LEVEL else labels[-2:])


def declared(html: str | None) -> str | None:
    m = _DECLARED.search(html or "")
    return m[1].lower()[:2] if m else None


def suffix(url: str | None, languages: tuple[str, ...]) -> str | None:
    """The language that the first path segment names, else the one that the country domain names."""
    host, path = host_and_path(url)
    first, last = path.strip("/").split("/")[0].lower()[:2], host.rpartition(".")[2]
    return first if first in languages and len(path.strip("/").split("/")[0]) == 2 else last if last in languages else None


def text_posterior(text: str, words: WordTable, sharpness: float = 0.5, most: float = 12.0) -> tuple[np.ndarray, float]:
    """Log-posterior by the text alone, from a flat prior, and the share of its n-grams that the models know.

    n-grams overlap, so their sum is damped by sharpness, and its spread is bounded by `most`: a long text is not
    thought to be certain.
    """
    tokens = text.lower().split()
    k = words.at.shape[1] - 2
    if not tokens:
        return np.full(k, -math.log(k)), 0.0
    total = np.zeros(k + 2)
    for found in words.rows(tokens):
        total += found.sum(0)
    logs = total[:k] * sharpness
    logs = logs - logs.max()
    logs = np.maximum(logs, -most)
    return logs - math.log(np.exp(logs).sum()), float(total[k + 1] / total[k])


def text_evidence(spark: SparkSession, model: LanguageModel, text: Column, url: Column, declared_lang: Column | None = None) -> Column:
    """A struct of host, domain, declared, suffix, known (share of known n-grams) and p (log-posterior by text).

    Texts are pages' html, which also declares the language, unless declared_lang is given.
    """
    shared = Shared(spark, model)
    html = declared_lang is None

    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        m = shared.value
        words = word_logs(m)
        for texts, urls, langs in batches:
            logs, known, hosts, says, ends = [], [], [], [], []
            for t, u, d in zip(texts, urls, langs, strict=True):
                p, s = text_posterior(visible(t) if html else t or "", words)
                logs.append(p.tolist())
                known.append(s)
                hosts.append(host_and_path(u)[0] if u and "://" in u else u or "")
                says.append(declared(t) if html else d)
                ends.append(suffix(u, m.languages))
            yield pd.DataFrame({"host": hosts, "domain": [site(h) for h in hosts], "declared": says, "suffix": ends, "known": np.array(known, dtype=float), "p": logs})

    found = F.pandas_udf(run, "host string, domain string, declared string, suffix string, known double, p array<double>")
    return found(text, url, declared_lang if declared_lang is not None else F.lit(None).cast("string"))


#: What fuse adds to the rows, and the column of the evidence.
FUSED, EVIDENCE = "_fused", "_evidence"


def fuse(evidence: DataFrame, model: LanguageModel, least_known: float = 0.5, least: float = 0.5) -> DataFrame:
    """The rows with a struct FUSED in place of their EVIDENCE: lang (und where the evidence is too weak), confidence,
    text_lang, known and accepted.

    A row is undetermined if the models know under least_known of its n-grams, it has no text, or its best language's
    posterior is under `least`. Rows are written once, and never shuffled unless their hosts are too many to broadcast.
    """
    langs, k = model.languages, len(model.languages)
    columns = [c for c in evidence.columns if c != EVIDENCE]
    rows = stash(evidence, "language")
    fields = rows.select(F.col(f"{EVIDENCE}.*"))
    soft = [F.exp(F.col("p")[i]) for i in range(k)]
    by_host = fields.groupBy("host", "domain").agg(*(F.sum(s).alias(f"s{i}") for i, s in enumerate(soft)))
    by_host = stash(by_host, "hosts")
    sums = [F.sum(f"s{i}").alias(f"d{i}") for i in range(k)]
    total = by_host.agg(*sums).first()
    base = np.array([(total[f"d{i}"] or 0.0) + 1.0 for i in range(k)])
    base /= base.sum()
    domains = by_host.groupBy("domain").agg(*sums)
    seen = lambda letter: sum((F.col(f"{letter}{i}") for i in range(1, k)), F.col(f"{letter}0"))
    domains = domains.select("domain", *(((F.col(f"d{i}") + PRIOR_STRENGTH * float(base[i])) / (seen("d") + PRIOR_STRENGTH)).alias(f"q{i}") for i in range(k)))
    priors = F.array(*(F.log((F.col(f"s{i}") + PRIOR_STRENGTH * F.col(f"q{i}")) / (seen("s") + PRIOR_STRENGTH)) for i in range(k)))
    hosts = stash(lookup(by_host, domains, "domain", "inner").select(F.col("host").alias("_host"), priors.alias("_prior")), "host-priors")
    release(by_host)

    def trust(column: str) -> dict[str, list[float]]:
        """log P(column says x | language), from sums of the texts' posteriors; values that no language has are one."""
        value = F.when(F.col(column).isin(*langs), F.col(column)).otherwise(F.when(F.col(column).isNull(), F.lit("none")).otherwise(F.lit("other")))
        found = {r["v"]: np.array([r[f"s{i}"] for i in range(k)]) for r in fields.groupBy(value.alias("v")).agg(*(F.sum(s).alias(f"s{i}") for i, s in enumerate(soft))).collect()}
        counts = np.array([found.get(v, np.zeros(k)) for v in (*langs, "none", "other")]) + 0.5
        counts[:k] += 2.0 * np.eye(k)
        return {v: row.tolist() for v, row in zip((*langs, "none", "other"), np.log(counts / counts.sum(0)), strict=True)}

    def told(column: str) -> Column:
        says = F.col(f"{EVIDENCE}.{column}")
        logs = trusts[column]
        out = F.when(says.isNull(), F.array(*map(F.lit, logs["none"])))
        for v in langs:
            out = out.when(says == v, F.array(*map(F.lit, logs[v])))
        return out.otherwise(F.array(*map(F.lit, logs["other"])))

    trusts = {c: trust(c) for c in ("declared", "suffix")}
    joined = lookup(rows.withColumn("_host", F.col(f"{EVIDENCE}.host")), hosts, "_host")
    p = F.col(f"{EVIDENCE}.p")
    flat = F.array(*(F.lit(math.log(x)) for x in base))
    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    scored = joined.withColumn("_z", plus(plus(p, F.coalesce("_prior", flat)), plus(told("declared"), told("suffix"))))
    best = F.array_max("_z")
    names = F.array(*(F.lit(x) for x in langs))
    name = lambda a: names[F.array_position(a, F.array_max(a)).cast("int") - 1]
    confidence = 1 / F.aggregate("_z", F.lit(0.0), lambda a, x: a + F.exp(x - best))
    known = F.col(f"{EVIDENCE}.known")
    scored = scored.withColumn("_confidence", confidence)
    accepted = (known >= least_known) & (F.col("_confidence") >= least)
    lang = F.when(accepted, name(F.col("_z"))).otherwise(F.lit("und"))
    return scored.select(*columns, F.struct(lang.alias("lang"), F.col("_confidence").alias("confidence"), name(p).alias("text_lang"), known.alias("known"), accepted.alias("accepted")).alias(FUSED))


def identify_pages(pages: DataFrame, model: LanguageModel) -> DataFrame:
    """page_id, url, lang, confidence, text_lang, known and accepted of every page, over its whole html.

    Null or empty html has no text and is undetermined; a null url has the empty host. Null and repeated page_ids are
    judged like any other row; further columns are not read.
    """
    found = text_evidence(pages.sparkSession, model, F.col("html"), F.col("url"))
    return fuse(pages.select("page_id", "url", found.alias(EVIDENCE)), model).select("page_id", "url", f"{FUSED}.*")


def _of_documents(documents: DataFrame, model: LanguageModel) -> Column:
    return text_evidence(documents.sparkSession, model, F.col("text"), F.col("source"), F.lower(F.col("lang"))).alias(EVIDENCE)


def identify_documents(documents: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep's columns, lang and so on of every document: its lang column counts as declared, its source as the host."""
    return fuse(documents.select(*keep, _of_documents(documents, model)), model).select(*keep, f"{FUSED}.*")


def keep_known(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of documents (all columns) whose language can be told; those without words or of unknown letters go.

    Each row is judged by itself, whatever its doc_id: null ones stay, and a rejected text goes where another row of
    its doc_id stays.
    """
    found = fuse(documents.select("*", _of_documents(documents, model)), model)
    return found.where(f"{FUSED}.accepted").select(*documents.columns)
