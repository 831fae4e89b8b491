"""URL filters: host and path rules, and a weighted vocabulary matched by an Aho-Corasick automaton.

The vocabulary has strict terms (one is enough) and soft terms (several distinct ones are needed). A term counts only
where neither neighbour in the URL is a letter or digit (A-Z, a-z, 0-9), after lower-casing A-Z. Rules come before the
vocabulary: a rule (host, path) fits its host and every subdomain where the URL's path starts with the rule's path;
of several that fit, the longest rule string (host + path) decides.
"""

from __future__ import annotations

import string
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

# The default vocabulary and rules.
STRICT_TERMS = ("porn", "porno", "xxx", "hentai", "camgirls", "milf", "escorts", "warez", "viagra", "cialis")
SOFT_TERMS = ("adult", "sex", "sexy", "nude", "casino", "poker", "betting", "slots", "jackpot", "torrent", "crack", "keygen", "dating", "pills", "payday", "loan")
SOFT_HITS = 2
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))

_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
_WORD = frozenset(string.ascii_lowercase + string.digits)


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) after the first :// up to / ? # or the end; path from there up to ? # or the end."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    tail = rest[end:]
    stop = min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))
    return rest[:end].translate(_LOWER), tail[:stop]


@dataclass(frozen=True)
class UrlFilter:
    """A rule is (host/path-prefix, allow or block). Terms are lower-case ASCII letters, digits, - and _."""

    strict: tuple[str, ...] = STRICT_TERMS
    soft: tuple[str, ...] = SOFT_TERMS
    soft_hits: int = SOFT_HITS
    rules: tuple[tuple[str, str], ...] = RULES
    _cache: dict = field(default_factory=dict, compare=False, repr=False)

    def _prepared(self):
        if not self._cache:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for kind, terms in (("soft", self.soft), ("strict", self.strict)):
                for term in terms:
                    automaton.add_word(term, (kind, term))
            automaton.make_automaton()
            by_host: dict[str, list[tuple[str, str, str]]] = {}
            for rule, verdict in self.rules:
                host, slash, path = rule.partition("/")
                by_host.setdefault(host.translate(_LOWER), []).append((slash + path, rule, verdict))
            self._cache.update(automaton=automaton, by_host=by_host)
        return self._cache["automaton"], self._cache["by_host"]

    def __getstate__(self):
        return {k: {} if k == "_cache" else v for k, v in self.__dict__.items()}

    def __setstate__(self, state):
        self.__dict__.update(state)

    def rule(self, host: str, path: str) -> tuple[str | None, str | None]:
        _, by_host = self._prepared()
        labels = host.split(".") if host else []
        fits = [(len(rule), rule, verdict) for i in range(len(labels)) for prefix, rule, verdict in by_host.get(".".join(labels[i:]), ()) if path.startswith(prefix)]
        return max(fits)[1:] if fits else (None, None)

    def hits(self, url: str | None) -> tuple[int, int]:
        """Strict hits, and distinct soft terms hit."""
        text = (url or "").translate(_LOWER)
        automaton, _ = self._prepared()
        strict, soft = 0, set()
        if text and (self.strict or self.soft):
            for end, (kind, term) in automaton.iter(text):
                start = end - len(term) + 1
                if (start == 0 or text[start - 1] not in _WORD) and (end + 1 == len(text) or text[end + 1] not in _WORD):
                    if kind == "strict":
                        strict += 1
                    else:
                        soft.add(term)
        return strict, len(soft)

    def judge(self, url: str | None) -> tuple[str, str, str | None, str, int, int]:
        host, path = host_and_path(url)
        strict, soft = self.hits(url)
        rule, verdict = self.rule(host, path)
        return host, path, rule, verdict or ("block" if strict or soft >= self.soft_hits else "allow"), strict, soft


def filter_urls(pages: DataFrame, judge: UrlFilter | None = None, key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule, verdict, strict_hits and soft_hits of every row; one pass, no shuffle.

    Null URLs and URLs without :// have an empty host and path; the vocabulary still judges their text. Rows with a
    null or repeated key are judged like any other; further columns are not read.
    """
    judge = judge or UrlFilter()
    kind = pages.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            found = [judge.judge(u) for u in batch["_url"]]
            out = pd.DataFrame(found, columns=["host", "path", "rule", "verdict", "strict_hits", "soft_hits"])
            out.insert(0, "_key", batch["_key"].to_numpy())
            yield out

    rows = pages.select(pages[key].alias("_key"), pages[url].alias("_url"))
    return rows.mapInPandas(run, f"_key {kind}, host string, path string, rule string, verdict string, strict_hits int, soft_hits int").withColumnRenamed("_key", key)


def oracle_sql(judge: UrlFilter | None = None) -> str:
    """The same over DuckDB's view pages."""
    judge = judge or UrlFilter()
    low = "translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    edge = lambda terms: f"(^|[^a-z0-9])({'|'.join(terms)})([^a-z0-9]|$)"
    strict = f"regexp_matches(u, '{edge(judge.strict)}')"
    soft = " + ".join(f"regexp_matches(u, '{edge([t])}')::int" for t in judge.soft)
    cases = ""
    verdicts = ""
    for rule, verdict in sorted(judge.rules, key=lambda r: (-len(r[0]), r[0])):
        host, slash, path = rule.partition("/")
        cases += f" WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash + path}') THEN '{rule}'"
        verdicts += f" WHEN rule = '{rule}' THEN '{verdict}'"
    return f"""
WITH a AS (SELECT page_id, {low} AS u,
    CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, u, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
c AS (SELECT page_id, u, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b),
d AS (SELECT page_id, u, host, path, CASE{cases} END AS rule FROM c)
SELECT page_id, host, path, rule,
    CASE{verdicts} WHEN {strict} OR ({soft}) >= {judge.soft_hits} THEN 'block' ELSE 'allow' END AS verdict
FROM d"""
