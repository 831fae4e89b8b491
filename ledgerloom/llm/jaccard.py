"""N-gram Jaccard join: exact links between documents by a token-group matrix.

Documents are sets of word shingles, hashed to 64 bits. The join has five parts:

1. Equal sets collapse to one, named by its digest.
2. Similar documents form groups: sets with two min-hashes in common are compared with the smallest one that has them, if
   their sketches are alike, and verified links join them to components, which are cut into groups of bounded size.
3. Tokens in a fixed order, rare before frequent, give each set a prefix. Two linked sets share a number of tokens of
   their prefixes that follows from their sizes (`least_shared`), so sets whose prefixes share too few tokens with other
   components are done.
4. A token-group matrix holds the union of each group's prefix tokens. Its equi-join with a document's prefix tokens
   names the groups outside the document's component that it could be linked with; the overlap with the group's union
   bounds the overlap with every member, and only groups whose bound suffices are opened. Before the join the tokens that
   are left are counted, and each set leaves out as many of its most frequent ones as any link can spare. Tokens that
   the same sets hold name the same groups, and stand in the matrix as one.
5. An opened group's members are bounded one by one by their own prefixes, and those that pass are compared exactly, in
   the group's row: one link to a group is enough.

Documents of one component need no further comparison, so a group of a million near copies gives a million rows and
not their pairs, while every link between components is found. Keys that hold a great part of the rows (a common token,
the head of a large group, exact copies) are dealt to several tasks.
"""

from __future__ import annotations

import re
from functools import partial, reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW, Shared, dealt_join, keyed, release, stash

MIN_HASHES = 4
#: Bytes of a set's sketch, and how many must be equal for a comparison within a group (which only finds groups).
SKETCH, SKETCH_ALIKE = 16, 8
#: Documents in a group of the matrix.
GROUP = 16
#: A set of n tokens has n // SHARE tokens more in its prefix than the one token in common asks for.
SHARE = 24
#: Frequent tokens that the order knows by name; all others count as equally rare.
KNOWN_FREQUENT = 200_000
#: Sets that hold a token so often seen are dealt to HOT_PARTS tasks each.
HOT_TOKEN, HOT_PARTS = 4096, 64
#: Bits of the table that names the documents whose sets are wanted, at most.
MOST_BITS = 26
_ODD = (np.random.default_rng(20240229).integers(1 << 62, size=32, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


_BLOCK = 1 << 20
_WHITE = re.compile(rb"[\x20\x09-\x0D]")


def _words(seed: int):
    """The hash of a word's bytes."""
    return partial(xxhash.xxh3_64_intdigest, seed=seed) if seed else xxhash.xxh3_64_intdigest


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _ODD[30]
    h = (h ^ (h >> np.uint64(29))) * _ODD[31]
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, word_hash=xxhash.xxh3_64_intdigest, k: int = 5) -> np.ndarray:
    """Sorted hashes of the distinct k-word shingles; with fewer words, of the whole sequence; empty without words."""
    raw = (text or "").encode("utf-8", "replace")
    parts, at = [], 0
    while at < len(raw):  # blocks end at white space; bytes know only ASCII's letters and white space
        stop = _WHITE.search(raw, at + _BLOCK) if at + _BLOCK < len(raw) else None
        end = stop.start() if stop else len(raw)
        found = raw[at:end].lower().split()
        parts.append(np.fromiter(map(word_hash, found), dtype=np.uint64, count=len(found)))
        at = end
    h = parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, dtype=np.uint64), *parts])
    if not len(h):
        return np.zeros(0, dtype=np.int64)
    n = min(k, len(h))
    total = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for j in range(n):
        total += h[j : len(h) - n + 1 + j] * _ODD[j]
    found = np.sort(_mixed(total).view(np.int64))
    return found[np.r_[True, found[1:] != found[:-1]]]


def _sketch(s: np.ndarray) -> bytes:
    """A byte of the smallest hash of each of SKETCH ranges, 0 for empty ranges."""
    edges = np.searchsorted(s, np.linspace(-(2.0**63), 2.0**63, SKETCH + 1)[:-1].astype(np.int64))
    filled = edges < np.r_[edges[1:], len(s)]
    return np.where(filled, s[np.minimum(edges, max(0, len(s) - 1))] & 255, 0).astype(np.uint8).tobytes() if len(s) else bytes(SKETCH)


def _digest(s: np.ndarray, seed: int) -> tuple[int, int]:
    return tuple(np.frombuffer(xxhash.xxh128(s.tobytes(), seed).digest(), dtype=np.int64).tolist())


def _rows(documents: DataFrame, run, schema: str) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInPandas(run, schema)


def _signatures(documents: DataFrame, k: int, seed: int) -> DataFrame:
    """Per document: size, two digests of the set, min-hashes and sketch. And rows without doc_id: tokens frequent in a task (dg), -count."""

    def run(batches):
        word_hash = _words(seed)
        gathered, size, docs = [], 0, 0
        names = [f"m{i}" for i in range(MIN_HASHES)]

        def frequent():
            tokens, counts = np.unique(np.concatenate(gathered), return_counts=True) if gathered else (np.zeros(0, np.int64),) * 2
            often = counts >= max(3, docs // 1000)
            return pd.DataFrame({"doc_id": pd.array([None] * int(often.sum()), dtype="Int64"), "n": -counts[often], "dg": tokens[often], "d2": 0} | dict.fromkeys(names, 0) | {"sk": b""})

        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                s = shingles(text, word_hash, k)
                u = s.view(np.uint64)
                dg, d2 = _digest(s, seed)
                out.append((doc_id, len(s), dg, d2, *((u * _ODD[8 + i]).min().view(np.int64) if len(s) else 0 for i in range(MIN_HASHES)), _sketch(s)))
                gathered.append(s)
                size, docs = size + len(s), docs + 1
                if size > 1_000_000:
                    yield frequent()
                    gathered, size, docs = [], 0, 0
            frame = pd.DataFrame(out, columns=["doc_id", "n", "dg", "d2", *names, "sk"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame
        yield frequent()

    return _rows(documents, run, "doc_id long, n int, dg long, d2 long, " + ", ".join(f"m{i} long" for i in range(MIN_HASHES)) + ", sk binary")


def _prefixes(documents: DataFrame, k: int, seed: int, percent: int, frequent: pd.DataFrame) -> DataFrame:
    """token, salt, dg, n: the prefix tokens of each set, once a task for equal sets.

    salt is 0, or for very frequent tokens the set's part (1 to HOT_PARTS). n is the set's size.
    """
    order = np.argsort(frequent["dg"].to_numpy(np.int64))
    shared = Shared(documents.sparkSession, (frequent["dg"].to_numpy(np.int64)[order], frequent["n"].to_numpy(np.int64)[order]))

    def run(batches):
        known, counts = shared.value
        word_hash = _words(seed)
        seen = set()
        for batch in batches:
            tokens, ids, sizes, salts = [], [], [], []
            for text in batch["text"]:
                s = shingles(text, word_hash, k)
                dg = _digest(s, seed)[0]
                if not len(s) or dg in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(dg)
                keep = len(s) - -(-percent * len(s) // 100) + 1 + len(s) // SHARE
                size = len(s)
                weight = np.zeros(size, dtype=np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    weight = np.where(known[at] == s, counts[at], 0)
                    order = np.argsort(weight, kind="stable")
                    s, weight = s[order], weight[order]
                tokens.append(s[:keep])
                ids.append(np.full(keep, dg))
                salts.append(np.where(weight[:keep] >= HOT_TOKEN, 1 + dg % HOT_PARTS, 0).astype(np.int8))
                sizes.append(np.full(keep, size, dtype=np.int32))
            if tokens:
                yield pd.DataFrame({"token": np.concatenate(tokens), "salt": np.concatenate(salts), "dg": np.concatenate(ids), "n": np.concatenate(sizes)})

    return _rows(documents, run, "token long, salt byte, dg long, n int")


def least_shared(n: Column, m: Column, percent: int) -> tuple[Column, Column]:
    """Linked sets of n and m tokens share at least the smaller of these two numbers of prefix tokens.

    They share `need` tokens. Of the two prefixes one ends first in the order; all tokens in common up to its end are in
    both, and those beyond are among that set's tokens after its prefix.
    """
    need = F.ceil(percent * (n + m) / F.lit(100 + percent))
    after = lambda x: F.ceil(percent * x / F.lit(100)) - 1 - F.floor(x / F.lit(SHARE))
    return need - after(n), need - after(m)


def _least_with_group(n: Column, percent: int) -> Column:
    """What a set of n tokens shares at least with any member of a group (sizes least to most) that it is linked with."""
    early, late = least_shared(n, F.col("least"), percent)[0], F.least(*(least_shared(n, F.col(x), percent)[1] for x in ("least", "most")))
    # the second bound is linear in a member's size but for roundings, which sum up to less than 3
    return F.greatest(F.lit(1), F.least(early, late - 3))


def _sets(documents: DataFrame, wanted: DataFrame, k: int, seed: int) -> DataFrame:
    """rep, s: the sets of wanted (rep, the set's digest; first, its smallest doc_id), sorted hashes.

    A bit table by doc_id, of bounded size, spares most other texts the hashing; a task passes a set on once.
    """
    bits = min(MOST_BITS, max(12, (16 * wanted.count()).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits)).cast("int")
    at = wanted.select(place(F.col("first").cast("long")).alias("b"))
    words64 = at.groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, b & 63)")).alias("x")).toArrow().to_pandas()
    table = np.zeros(1 << (bits - 6), dtype=np.int64)
    table[words64["w"].to_numpy(np.int64)] = words64["x"].to_numpy(np.int64)
    shared = Shared(documents.sparkSession, table)

    def run(batches):
        table, word_hash = shared.value, _words(seed)
        seen = set()
        for batch in batches:
            b = batch["_b"].to_numpy(np.int64)
            texts = batch["text"][(table[b >> 6] >> (b & 63)) & 1 == 1]
            for i in range(0, len(texts), 500):
                reps, sets = [], []
                for text in texts.iloc[i : i + 500]:
                    s = shingles(text, word_hash, k)
                    dg = _digest(s, seed)[0]
                    if dg not in seen:
                        if len(seen) > 200_000:
                            seen.clear()
                        seen.add(dg)
                        reps.append(dg)
                        sets.append(s)
                yield pd.DataFrame({"rep": np.array(reps, dtype=np.int64), "s": sets})

    near = documents.select("text", place(F.col("doc_id").cast("long")).alias("_b")).mapInPandas(run, "rep long, s array<long>")
    return near.join(wanted.select("rep"), "rep", "left_semi").groupBy("rep").agg(F.first("s").alias("s"))


def _verified(documents: DataFrame, per_set: DataFrame, pairs: DataFrame, k: int, seed: int, percent: int) -> DataFrame:
    """The pairs (a, b, and further columns) that are links, by their whole sets; written."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    wanted = stash(per_set.select(F.col("dg").alias("rep"), "first").join(ends, "rep", "left_semi"), "wanted")
    sets = stash(_sets(documents, wanted, k, seed), "sets")
    one = stash(pairs.join(sets.select(F.col("rep").alias("b"), F.col("s").alias("sb")), "b"), "half")
    rows = dealt_join(one, sets.select(F.col("rep").alias("a"), F.col("s").alias("sa")), "a")
    both = F.size(F.array_intersect("sa", "sb"))
    linked = (100 + percent) * both >= percent * (F.size("sa") + F.size("sb"))
    out = stash(rows.where(linked).select(*pairs.columns), "links")
    release(wanted, sets, one)
    return out


def components(edges: DataFrame) -> DataFrame:
    """id, c: the smallest id that each vertex of edges (a, b) reaches. Labels spread and jump until nothing changes."""
    both = stash(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stash(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("c")), "labels")
    while True:
        near = dealt_join(both, labels.select(F.col("id").alias("b"), "c"), "b").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("m"))
        own = stash(labels.join(near, "id").select("id", "c", F.least("c", "m").alias("m")), "near")
        up = labels.select(F.col("id").alias("m"), F.col("c").alias("r"))
        moved = stash(dealt_join(own, up, "m").select("id", F.col("r").alias("c"), (F.col("r") != F.col("c")).alias("changed")), "labels")
        release(labels, own)
        labels = moved.select("id", "c")
        labels._stashed = moved._stashed
        if not moved.where("changed").limit(1).count():
            release(both)
            return labels


def _groups(documents: DataFrame, per_set: DataFrame, k: int, seed: int, percent: int) -> DataFrame:
    """rep, c: the component of each set that is verified to be like another; written.

    Sets that have two min-hashes in common are compared with the smallest of them; then those that have one, and are in
    different components so far, with the largest. What this misses the matrix finds.
    """
    alike = sum((F.substring("sk", i, 1) == F.substring("ask", i, 1)).cast("int") for i in range(1, SKETCH + 1))
    similar = (F.col("a") != F.col("rep")) & (F.col("ac") != F.col("c")) & (alike >= SKETCH_ALIKE)
    similar &= 100 * F.least("n", "an") >= percent * F.greatest("n", "an")
    links, found = [], None
    for head, several in ((F.min, True), (F.max, False)):
        of = per_set.withColumnRenamed("dg", "rep")
        of = of.join(found, "rep", "left").withColumn("c", F.coalesce("c", "rep")) if found is not None else of.withColumn("c", F.col("rep"))
        key = [F.xxhash64(f"m{i}", f"m{(i + 1) % MIN_HASHES}") if several else F.col(f"m{i}") for i in range(MIN_HASHES)]
        each = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), m.alias("m")) for i, m in enumerate(key))))
        rows = stash(of.select("rep", "n", "sk", "c", each.alias("h")).select("h.i", "h.m", "rep", "n", "sk", "c"), "keys")
        heads = rows.groupBy("i", "m").agg(head(F.struct("rep", "n", "sk", "c")).alias("h"), F.count("*").alias("x")).where("x > 1")
        heads = stash(heads.select("i", "m", *(F.col(f"h.{x}").alias(y) for x, y in (("rep", "a"), ("n", "an"), ("sk", "ask"), ("c", "ac")))), "heads")
        pairs = stash(dealt_join(rows, heads, ["i", "m"]).where(similar).select("a", F.col("rep").alias("b")).distinct(), "stars")
        links.append(_verified(documents, per_set, pairs, k, seed, percent))
        release(rows, heads, pairs)
        before, found = found, components(reduce(DataFrame.union, links))
        if before is not None:
            release(before)
        stashed, found = found, found.withColumnRenamed("id", "rep")
        found._stashed = stashed._stashed
    release(*links)
    return found


def _across(rows: DataFrame) -> DataFrame:
    """The rows (token, salt, c, ...) whose token occurs in several components, with f, h: number and hash of its sets."""
    w, sets = Window.partitionBy("token"), F.bit_xor(F.xxhash64("rep"))
    cold = rows.where("salt = 0").withColumn("_l", F.min("c").over(w)).withColumn("_h", F.max("c").over(w)).withColumn("f", F.count("*").over(w)).withColumn("h", sets.over(w))
    hot = rows.where("salt > 0").groupBy("token").agg(F.min("c").alias("_l"), F.max("c").alias("_h"), F.count("*").alias("f"), sets.alias("h"))  # KNOWN_FREQUENT at most
    return cold.unionByName(rows.where("salt > 0").join(F.broadcast(hot), "token")).where("_l != _h").drop("_l", "_h")


def _members(tokens: DataFrame, grouped: DataFrame) -> DataFrame:
    """rep, n, c, part, t (f, token, h; rare ones first): the sets that share enough prefix tokens with other components."""
    needed = F.lit(1) + F.floor(F.col("n") / SHARE)
    w = Window.partitionBy("rep")
    enough = lambda df: df.withColumn("_x", F.count("*").over(w)).where(F.col("_x") >= needed).drop("_x")
    cells = enough(tokens.withColumnRenamed("dg", "rep").join(grouped, "rep", "left").withColumn("c", F.coalesce("c", "rep")))
    cells = stash(cells, "cells")
    shared = stash(_across(cells), "across")
    members = enough(shared).groupBy("rep").agg(F.first("n").alias("n"), F.first("c").alias("c"), F.array_sort(F.collect_list(F.struct("f", "token", "h"))).alias("t"))
    members = stash(members, "members")
    sizes = members.groupBy("c").agg(F.count("*").alias("x"))
    part = F.pmod(F.xxhash64("rep"), F.ceil(F.col("x") / GROUP)).cast("long")
    out = stash(dealt_join(members, sizes, "c").select("rep", "n", "c", part.alias("part"), "t"), "groups")
    release(cells, shared, members)
    return out


def _asked(members: DataFrame, percent: int) -> DataFrame:
    """rep, c, gc, gp: the groups of other components that share a token of the matrix with each set; written.

    A set of n tokens shares more than n // SHARE of its t with any set that it is linked with. All sets order their t
    alike, so the rarest token that two linked sets share is in neither's last n // SHARE. Tokens of the same sets go by
    their common hash h, at the place of the rarest of them; hashes that collide only ask more.
    """
    spared = F.floor(F.col("n") / SHARE).cast("int")
    cells = members.select("rep", "n", "c", "part", F.size("t").alias("x"), F.posexplode(F.slice("t", F.lit(1), F.size("t") - spared)).alias("at", "y"))
    # rest: the set's tokens from this one on, itself too
    first = cells.groupBy("rep", "n", "c", "part", "y.h").agg(F.max(F.col("x") - F.col("at")).alias("rest"))
    first = stash(first, "first")
    matrix = first.groupBy("h", "c", "part").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("rest").alias("left"))
    matrix = stash(matrix.select("h", F.col("c").alias("gc"), F.col("part").alias("gp"), "least", "most", "left"), "matrix")
    # sizes that can't link, and tokens that can't be the rarest common one of a link, go
    fits = (F.col("gc") < F.col("c")) & (100 * F.col("n") >= percent * F.col("least")) & (100 * F.col("most") >= percent * F.col("n"))
    fits &= F.least("rest", "left") >= _least_with_group(F.col("n"), percent)
    out = stash(dealt_join(first, matrix, "h").where(fits).select("rep", "c", "gc", "gp").distinct(), "asked")
    release(first, matrix)
    return out


def _opened(asked: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """rep, c, gc, gp, near: the groups whose bound suffices, with those of their members whose own does; written."""
    n = F.col("n")
    inside = F.collect_list(F.struct(F.col("rep").alias("b"), F.col("n").alias("m"), F.col("t").alias("u")))
    groups = own.groupBy(F.col("c").alias("gc"), F.col("part").alias("gp")).agg(F.min("n").alias("least"), F.max("n").alias("most"), inside.alias("inside"))
    groups = stash(groups.withColumn("union", F.array_distinct(F.flatten(F.transform("inside", lambda x: x["u"])))), "unions")
    queries = stash(dealt_join(asked, own.select("rep", "n", "t"), "rep"), "queries")
    rows = dealt_join(queries, groups, ["gc", "gp"]).where(F.size(F.array_intersect("t", "union")) >= _least_with_group(n, percent))

    def near(x: Column) -> Column:
        alike = 100 * F.least(n, x["m"]) >= percent * F.greatest(n, x["m"])
        return alike & (F.size(F.array_intersect(F.col("t"), x["u"])) >= F.greatest(F.lit(1), F.least(*least_shared(n, x["m"], percent))))

    members = F.transform(F.filter("inside", near), lambda x: x["b"])
    out = stash(rows.select("rep", "c", "gc", "gp", members.alias("near")).where(F.size("near") > 0), "opened")
    release(groups, queries)
    return out


def _across_links(documents: DataFrame, per_set: DataFrame, opened: DataFrame, own: DataFrame, k: int, seed: int, percent: int) -> DataFrame:
    """a, b: components of which two sets are links, by whole sets; written.

    A group's sets lie in one row, and an asking set is held against them there, so that no pairs are made.
    """
    inside = own.select("rep", F.col("c").alias("gc"), F.col("part").alias("gp")).join(opened.select("gc", "gp").distinct(), ["gc", "gp"], "left_semi")
    ends = opened.select("rep").union(inside.select("rep")).distinct()
    wanted = stash(per_set.select(F.col("dg").alias("rep"), "first").join(ends, "rep", "left_semi"), "wanted")
    sets = stash(_sets(documents, wanted, k, seed), "sets")
    groups = stash(inside.join(sets, "rep").groupBy("gc", "gp").agg(F.collect_list(F.struct(F.col("rep").alias("b"), F.col("s").alias("u"))).alias("inside")), "groups")
    queries = stash(dealt_join(opened, sets, "rep"), "half")

    def linked(x: Column) -> Column:
        both = F.size(F.array_intersect(F.col("s"), x["u"]))
        return F.array_contains("near", x["b"]) & ((100 + percent) * both >= percent * (F.size("s") + F.size(x["u"])))

    rows = dealt_join(queries, groups, ["gc", "gp"]).where(F.exists("inside", linked))
    out = stash(rows.select(F.col("gc").alias("a"), F.col("c").alias("b")).distinct(), "links")
    release(wanted, sets, groups, queries)
    return out


def jaccard_components(documents: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id of every document.

    Two documents link when 100 * intersection >= percent * union of their sets; component_id is the smallest doc_id
    reachable by links. Documents without words (null, empty or blank texts) have no shingles, and link with nothing.
    Rows with a null doc_id are no documents and are left out; a doc_id that occurs in several rows gets
    a row for each: equal texts fall together, and of different texts each links on its own. Sets are named by their
    digests, and compared as 64-bit hashes. Raises if digests collide under three seeds. percent: 50 to 100.
    """
    documents = documents.where(F.col("doc_id").isNotNull())
    for seed in range(3):
        found = stash(_signatures(documents, k, seed), "signatures")
        per_set = found.where("doc_id is not null and n > 0").groupBy("dg", "d2").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), *(F.first(f"m{i}").alias(f"m{i}") for i in range(MIN_HASHES)), F.first("sk").alias("sk"), F.count("*").alias("copies"))
        per_set = stash(per_set, "per-set")
        if not per_set.groupBy("dg").agg(F.count("*").alias("x")).where("x > 1").limit(1).count():
            break
        release(found, per_set)
    else:
        raise RuntimeError("digests of different sets collide under every seed")
    grouped = _groups(documents, per_set, k, seed, percent)
    frequent = found.where("doc_id is null").groupBy("dg").agg((-F.sum("n")).alias("n")).orderBy(F.desc("n"), "dg").limit(KNOWN_FREQUENT).toArrow().to_pandas()
    tokens = _prefixes(documents, k, seed, percent, frequent)
    w = Window.partitionBy("token", "salt")
    tokens = tokens.withColumn("_l", F.min("dg").over(w)).withColumn("_h", F.max("dg").over(w)).where("salt > 0 or _l != _h")
    tokens = stash(tokens.drop("_l", "_h").distinct(), "tokens")
    members = _members(tokens, grouped)
    release(tokens)
    asked = _asked(members, percent)
    own = stash(members.select("rep", "n", "c", "part", F.transform("t", lambda x: x["token"]).alias("t")), "own")
    opened = _opened(asked, own, percent)
    more = _across_links(documents, per_set, opened, own, k, seed, percent)
    joined = components(more)
    release(members, asked, own, opened, more)

    # component of each set that is linked; then the smallest doc_id of each component, and of copies
    roots = grouped.select("c").union(joined.select(F.col("id").alias("c"))).distinct().join(joined.withColumnRenamed("c", "r"), F.col("c") == F.col("id"), "left").select("c", F.coalesce("r", "c").alias("r"))
    alone = joined.select(F.col("id").alias("rep")).join(grouped, "rep", "left_anti").select("rep", F.col("rep").alias("c"))
    linked = stash(dealt_join(grouped.unionByName(alone), roots, "c").select(F.col("rep").alias("dg"), "r"), "linked")
    sets = stash(per_set.select("dg", "first", "copies").join(linked, "dg", "left"), "roots")
    lowest = sets.where("r is not null").groupBy("r").agg(F.min("first").alias("lowest"))
    several = sets.where("r is null and copies > 1").select("dg", F.col("first").alias("component_id"))
    labels = stash(dealt_join(sets.where("r is not null"), lowest, "r").select("dg", F.col("lowest").alias("component_id")).unionByName(several), "labels")
    rows = found.where("doc_id is not null").select("doc_id", "n", "dg")
    named = dealt_join(rows.where("n > 0"), labels, "dg", "left").unionByName(rows.where("n = 0"), allowMissingColumns=True)
    release(grouped, joined, linked, sets, per_set)
    return named.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def drop_near_copies(documents: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """One row of each component stays, the one with the smallest doc_id (all columns); wordless ones all stay.

    Components are of rows: of rows that share a doc_id and a component one stays, and of those with a null doc_id,
    which count as the largest, one of each component without another doc_id.
    """
    rows = keyed(documents)
    found = jaccard_components(rows.select(F.col(ROW).alias("doc_id"), "text"), k, percent)
    found = found.select(F.col("doc_id").alias(ROW), "component_id").join(rows.select(ROW, "doc_id"), ROW)
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(ROW)))
    keep = found.groupBy("component_id").agg(first.alias("r")).select(F.col(f"r.{ROW}").alias(ROW))
    return rows.join(keep, ROW, "left_semi").select(*documents.columns)
