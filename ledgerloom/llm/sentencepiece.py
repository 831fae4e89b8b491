"""SentencePiece encoding and decoding as a relational lattice.

Texts are cut where no piece can cross: between two characters that stand side by side in no piece (so before every
word, and mostly at punctuation). Such a cut leaves the best segmentation as it is. The distinct segments of the whole
corpus are encoded once: every substring up to the longest piece's length is exploded, equi-joined to the piece table,
the edges that match are grouped by segment, and a fold (Spark's higher-order aggregate) over the edges gives the path.
Documents then look their segments up.

A unigram table's fold is Viterbi: the best-scored path to each position. A BPE table's scores are merge ranks, and the
path of the highest sum is not the one that merging gives; there the fold takes, step by step, the best-ranked edge that
spans two neighbouring symbols. Both folds take the same lattice. Segments too long to explode (over FOLD_CHARS) are
encoded by the same rules in linear memory.
"""

from __future__ import annotations

import gc
import heapq
import re
import zlib
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, pieces_of, stash

SPACE = "▁"
_UNITS = re.compile(r" +[^ ]*")
#: A dictionary of up to so many segments is broadcast; a larger one is dealt to blocks of documents by a join.
BROADCAST_SEGMENTS = 4_000_000
#: Longer segments aren't folded.
FOLD_CHARS = 16_384
#: Characters of documents in a block.
BLOCK_CHARS = 24_000_000


@dataclass(frozen=True)
class PieceTable:
    """pieces: those that text can match, with ids and scores; byte_ids: of the 256 bytes, or empty (then unk)."""

    pieces: tuple[tuple[str, int, float], ...]
    byte_ids: tuple[int, ...]
    unk: int
    texts: tuple[bytes, ...]
    bpe: bool = False

    @cached_property
    def longest(self) -> int:
        return max(len(p) for p, _, _ in self.pieces)

    @cached_property
    def penalty(self) -> float:
        """Score of a character that no piece has: the lowest score less 10."""
        return min(s for _, _, s in self.pieces) - 10.0

    def joints(self) -> frozenset[str]:
        """Pairs of characters that stand side by side in some piece."""
        return frozenset(p[i : i + 2] for p, _, _ in self.pieces for i in range(len(p) - 1))


def _fields(raw: bytes):
    """(number, value) of a protocol buffer's fields; varints as integers, the rest as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = raw[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or varint()
        yield key >> 3, raw[at : at + size]
        at += size


def is_bpe(model: bytes) -> bool:
    """Whether a .model file's trainer_spec (field 2) has the model_type (field 3) 2, BPE; 1, unigram, is the default."""
    return any(number == 3 and value == 2 for n, spec in _fields(model) if n == 2 for number, value in _fields(spec))


def load_pieces(path: str) -> PieceTable:
    """Reads a .model file on the driver. Its normaliser must be the identity with a dummy prefix."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, byte_ids, texts = [], [0] * 256, []
    has_bytes = False
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            has_bytes = True
            texts.append(bytes([int(piece[3:5], 16)]))
        elif sp.is_control(i) or sp.is_unused(i):
            texts.append(b"")
        elif sp.is_unknown(i):
            texts.append(" ⁇ ".encode())
        else:
            pieces.append((piece, i, sp.get_score(i)))
            texts.append(piece.replace(SPACE, " ").encode())
    table = PieceTable(tuple(pieces), tuple(byte_ids) if has_bytes else (), sp.unk_id(), tuple(texts), is_bpe(open(path, "rb").read()))
    if any(j[1] == SPACE and j[0] != SPACE for j in table.joints()):
        raise ValueError("pieces that hold a space inside are not supported")
    return table


def units(text: str) -> list[str]:
    """The text with its dummy prefix, cut before each run of spaces; a word with the spaces before it is a unit."""
    return _UNITS.findall(" " + text.replace(SPACE, " ")) if text else []


class Cutter:
    """Cuts units (spaces become the space mark) between characters that no piece has side by side."""

    def __init__(self, joints: frozenset[str]):
        chars = sorted({c for j in joints for c in j})
        self.place = np.zeros(0x110000, dtype=np.int32)
        self.place[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.joined = np.zeros((len(chars) + 1, len(chars) + 1), dtype=bool)
        for a, b in joints:
            self.joined[self.place[ord(a)], self.place[ord(b)]] = True

    def cut(self, found: list[str]) -> list[list[str]]:
        """The segments of each unit."""
        text = "".join(found).replace(" ", SPACE)
        if not text:
            return [[] for _ in found]
        at = self.place[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        inner = ~self.joined[at[:-1], at[1:]]
        edges = np.cumsum([0, *map(len, found)])
        inner[edges[1:-1] - 1] = True
        cuts = np.r_[0, np.flatnonzero(inner) + 1, len(text)]
        at = cuts.tolist()
        parts = [text[a:b] for a, b in zip(at, at[1:], strict=False)]
        where = np.searchsorted(cuts, edges).tolist()
        return [parts[a:b] for a, b in zip(where, where[1:], strict=False)]


def _distinct_segments(documents: DataFrame, joints: frozenset[str], block: bool = False) -> DataFrame:
    """segment (and block): the distinct ones of all texts; each task keeps what it has sent in a bounded set."""
    shared = Shared(documents.sparkSession, joints)

    def run(batches):
        gc.disable()  # nothing here makes cycles, and the many small objects make collections slow
        cutter = Cutter(shared.value)
        words: dict = {}
        sent: dict = {}
        for batch in batches:
            for part in pieces_of(batch, ["text"], 1_000_000):
                for at in set(part["block"]) if block else [None]:
                    texts = part["text"][part["block"] == at] if block else part["text"]
                    fresh = set().union(*(units(t or "") for t in texts)) - words.setdefault(at, set())
                    words[at] |= fresh
                    found = {s for parts in cutter.cut(list(fresh)) for s in parts} - sent.setdefault(at, set())
                    sent[at] |= found
                    if found:
                        yield pd.DataFrame({"block": at, "segment": list(found)} if block else {"segment": list(found)})
                for kept in (words, sent):
                    if sum(map(len, kept.values())) > 300_000:
                        kept.clear()

    if block:
        return documents.select("block", "text").mapInPandas(run, "block long, segment string").distinct()
    found = documents.select("text").mapInPandas(run, "segment string")
    # a number of its own: the segments are few megabytes, but the lattice multiplies them
    tasks = max(4 * documents.sparkSession.sparkContext.defaultParallelism, documents.rdd.getNumPartitions())
    return stash(found.repartition(tasks, "segment").distinct(), "distinct").repartition(tasks, "segment")


def _spans(found: DataFrame, table: PieceTable, least: int) -> DataFrame:
    """segment, s, k, piece, id, score: every substring of `least` characters or more, and the first character, with
    the piece that it equals, if any. The piece table is broadcast if it is bounded."""
    pieces = found.sparkSession.createDataFrame(pd.DataFrame(table.pieces, columns=["piece", "id", "score"]), "piece string, id int, score double")
    if len(table.pieces) <= 1_000_000:
        pieces = F.broadcast(pieces)
    starts = found.where(F.length("segment") <= FOLD_CHARS).select("segment", F.explode(F.expr("sequence(0, length(segment) - 1)")).alias("s"))
    lengths = F.expr(f"CASE WHEN s = 0 THEN sequence(1, least({table.longest}, length(segment))) WHEN length(segment) - s >= {least} THEN sequence({least}, least({table.longest}, length(segment) - s)) END")
    spans = starts.select("segment", "s", F.explode(lengths).alias("k")).withColumn("piece", F.substring("segment", F.col("s") + 1, F.col("k")))
    return spans.join(pieces, "piece", "left").where("id is not null or k = 1")


def encode_segments(found: DataFrame, table: PieceTable) -> DataFrame:
    """segment, ids (packed): the lattice over distinct segments, grouped and folded where the segments are."""
    folded = _merge_fold(found, table) if table.bpe else _viterbi_fold(found, table)
    return folded.unionByName(_long_segments(found.where(F.length("segment") > FOLD_CHARS), table))


def _viterbi_fold(found: DataFrame, table: PieceTable) -> DataFrame:
    if table.byte_ids:
        byte_ids = F.array(*(F.lit(i) for i in table.byte_ids))
        raw = F.hex(F.encode("piece", "utf-8"))
        fallback = F.transform(F.expr("sequence(1, length(hex(encode(piece, 'utf-8'))), 2)"), lambda i: byte_ids[F.conv(F.substring(raw, i, F.lit(2)), 16, 10).cast("int")])
    else:
        fallback = F.array(F.lit(table.unk))
    edge = F.struct((F.col("s") + F.col("k")).alias("e"), F.col("s").alias("s"), F.coalesce("score", F.lit(table.penalty)).alias("v"), F.when(F.col("id").isNull(), fallback).otherwise(F.array("id")).alias("p"))
    grouped = _spans(found, table, 1).groupBy("segment").agg(F.array_sort(F.collect_list(edge)).alias("edges"))
    return _with_bytes(grouped.select("segment", F.expr(VITERBI).alias("ids")))


def _merge_fold(found: DataFrame, table: PieceTable) -> DataFrame:
    """Folds each segment's edges (start, length and id packed into a long) by merge rank."""
    edge = F.shiftleft(F.col("s").cast("long"), 40) + F.shiftleft(F.col("k").cast("long"), 32) + F.coalesce("id", F.lit(0))
    grouped = _spans(found, table, 2).groupBy("segment").agg(F.collect_list(edge).alias("edges"))
    shared = Shared(found.sparkSession, table)

    def run(batches):
        t = shared.value
        score = {i: v for _, i, v in t.pieces}
        single = {p: i for p, i, _ in t.pieces if len(p) == 1}
        for batch in batches:
            ids = []
            for segment, edges in zip(batch["segment"], batch["edges"], strict=True):
                spans = {(x >> 40, (x >> 40) + (x >> 32 & 255)): (score[x & 0xFFFFFFFF], x & 0xFFFFFFFF) for x in edges.tolist() if x >> 32 & 255 > 1}
                ids.append(np.array(_merged(segment, spans, single, t), dtype="<i4").tobytes())
            yield pd.DataFrame({"segment": batch["segment"], "ids": ids})

    return grouped.mapInPandas(run, "segment string, ids binary")


#: best[i]: score and ids of the best path to position i; edges come by end, then by start.
VITERBI = """
    aggregate(edges, array(struct(cast(0 as double) as v, cast(array() as array<int>) as p)),
        (best, x) -> CASE
            WHEN size(best) = x.e THEN concat(best, array(struct(best[x.s].v + x.v as v, concat(best[x.s].p, x.p) as p)))
            WHEN best[x.s].v + x.v > best[x.e].v THEN concat(slice(best, 1, x.e), array(struct(best[x.s].v + x.v as v, concat(best[x.s].p, x.p) as p)))
            ELSE best END,
        best -> best[size(best) - 1].p)"""

def _long_segments(found: DataFrame, table: PieceTable) -> DataFrame:
    shared = Shared(found.sparkSession, table)

    def run(batches):
        t = shared.value
        pieces = {p: (i, v) for p, i, v in t.pieces}
        for batch in batches:
            yield pd.DataFrame({"segment": batch["segment"], "ids": [np.array(encode_one(s, t, pieces), dtype="<i4").tobytes() for s in batch["segment"]]})

    return found.select("segment").mapInPandas(run, "segment string, ids binary")


def _unknown(c: str, table: PieceTable) -> list[int]:
    return [table.byte_ids[b] for b in c.encode("utf-8", "replace")] if table.byte_ids else [table.unk]


class _Spans:
    """The edges of a long segment, looked up as they are asked for."""

    def __init__(self, segment: str, pieces: dict[str, tuple[int, float]]):
        self.segment, self.pieces = segment, pieces

    def get(self, span: tuple[int, int]) -> tuple[float, int] | None:
        found = self.pieces.get(self.segment[span[0] : span[1]])
        return found and (found[1], found[0])


def _merged(segment: str, spans, single: dict[str, int], table: PieceTable) -> list[int]:
    """Ids after all merges: always the best-scored edge over two neighbouring symbols, the leftmost of equal ones."""
    n, longest = len(segment), table.longest
    end = list(range(1, n + 1))  # of the symbol that starts here, 0 inside symbols
    before = list(range(-1, n - 1))
    symbol: dict[int, int] = {}
    queue: list[tuple[float, int, int, int]] = []

    def offer(i: int) -> None:
        if i >= 0 and (j := end[i]) < n and end[j] - i <= longest and (found := spans.get((i, end[j]))):
            heapq.heappush(queue, (-found[0], i, end[j], found[1]))

    for i in range(n - 1):
        offer(i)
    while queue:
        _, i, stop, piece = heapq.heappop(queue)
        j = end[i]
        if not j or j >= n or end[j] != stop:
            continue
        end[i], end[j], symbol[i] = stop, 0, piece
        if stop < n:
            before[stop] = i
        offer(i)
        offer(before[i])
    out, i = [], 0
    while i < n:
        if i in symbol:
            out.append(symbol[i])
        else:
            c = segment[i]
            out += [single[c]] if c in single else _unknown(c, table)
        i = end[i]
    return out


def encode_one(segment: str, table: PieceTable, pieces: dict[str, tuple[int, float]]) -> list[int]:
    """One segment by the rules of the folds, in time and memory about linear in its length."""
    n, longest = len(segment), table.longest
    if table.bpe:
        single = {c: pieces[c][0] for c in set(segment) if c in pieces}
        return _merged(segment, _Spans(segment, pieces), single, table)
    best, back = [0.0] + [-np.inf] * n, [0] * (n + 1)
    for e in range(1, n + 1):
        for s in range(max(0, e - longest), e):
            v = pieces[segment[s:e]][1] if segment[s:e] in pieces else table.penalty if s == e - 1 else -np.inf
            if best[s] + v > best[e]:
                best[e], back[e] = best[s] + v, s
    parts, e = [], n
    while e:
        parts.append(segment[back[e] : e])
        e = back[e]
    return [i for p in reversed(parts) for i in ([pieces[p][0]] if p in pieces else _unknown(p, table))]


class _Encoder:
    """Texts to packed ids; a bounded cache of units over `find`, which gives the packed ids of many segments."""

    def __init__(self, joints: frozenset[str], find):
        self.cutter, self.find, self.known = Cutter(joints), find, {}

    def encode(self, texts) -> list[bytes]:
        found = [units(t or "") for t in texts]
        if len(self.known) > 200_000:
            self.known.clear()
        fresh = list(set().union(*found).difference(self.known))
        cut = self.cutter.cut(fresh)
        parts = list({s for x in cut for s in x})
        ids = dict(zip(parts, self.find(parts), strict=True))
        for unit, x in zip(fresh, cut, strict=True):
            self.known[unit] = b"".join(map(ids.__getitem__, x))
        return [b"".join(map(self.known.__getitem__, x)) for x in found]


def _hashes(found) -> np.ndarray:
    digest = xxhash.xxh128_digest
    return np.frombuffer(b"".join([digest(s.encode("utf-8", "replace")) for s in found]), dtype=np.int64).reshape(-1, 2)


def _hashed(dictionary: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            h = _hashes(batch["segment"])
            yield pd.DataFrame({"a": h[:, 0], "b": h[:, 1], "ids": batch["ids"]})

    return dictionary.mapInPandas(run, "a long, b long, ids binary")


def _packed(found) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """A dictionary without objects, from an Arrow table: hashes in order, halves of second hashes, offsets, all ids."""
    import pyarrow as pa

    a, b = found["a"].to_numpy(), found["b"].to_numpy()
    order = np.argsort(a, kind="stable")
    ids = found["ids"].cast(pa.large_binary()).combine_chunks()
    ids = (pa.concat_arrays(ids.chunks) if isinstance(ids, pa.ChunkedArray) and ids.num_chunks else ids).take(pa.array(order))
    _, offsets, data = ids.buffers() if len(ids) else (None, None, None)
    ends = np.frombuffer(offsets, dtype=np.int64)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
    kind = np.uint32 if ends[-1] < 1 << 32 else np.int64
    return a[order], b[order].astype(np.int32), ends.astype(kind), data.to_pybytes() if data else b""


def _finder(packed):
    first, second, offsets, raw = packed

    def find(parts: list[str]) -> list[bytes]:
        if not parts:
            return []
        h = _hashes(parts)
        at = np.minimum(np.searchsorted(first, h[:, 0]), max(0, len(first) - 1))
        while (other := (first[at] == h[:, 0]) & (second[at] != h[:, 1].astype(np.int32))).any():
            at[other] += 1
        if (first[at] != h[:, 0]).any():
            raise KeyError(parts[int(np.flatnonzero(first[at] != h[:, 0])[0])])
        return [raw[s:e] for s, e in zip(offsets[at].tolist(), offsets[at + 1].tolist(), strict=True)]

    return find


def _with_bytes(dictionary: DataFrame) -> DataFrame:
    """ids as packed little-endian 32-bit integers."""

    def run(batches):
        for batch in batches:
            yield batch.assign(ids=[np.asarray(x, dtype="<i4").tobytes() for x in batch["ids"]])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dictionary.schema.fields if f.name != "ids")
    return dictionary.select(*(f.name for f in dictionary.schema.fields if f.name != "ids"), "ids").mapInPandas(run, f"{fields}, ids binary")


def encode(documents: DataFrame, table: PieceTable, packed: bool = False, broadcast_segments: int = BROADCAST_SEGMENTS, finish=None, shape: str | None = None) -> DataFrame:
    """doc_id and ids of every document's whole text (array<int>; packed: little-endian 32-bit integers as binary).

    Null and empty texts have no ids. Rows with null or repeated doc_ids are encoded like any other; further columns
    are not read. The dictionary of distinct segments is broadcast while it has at most broadcast_segments rows;
    beyond that, documents are dealt to blocks and each block gets the segments that it needs by a join. finish, if
    given, turns a list of packed ids into columns (shape: their schema) in the same task.
    """
    joints = table.joints()
    kind = documents.schema["doc_id"].dataType.simpleString()
    shape = shape or ("ids binary" if packed else "ids array<int>")
    finish = finish or (lambda ids: {"ids": ids if packed else [np.frombuffer(i, dtype="<i4") for i in ids]})
    dictionary = stash(encode_segments(_distinct_segments(documents, joints), table), "segments")
    joined = Shared(documents.sparkSession, joints)

    def rows(batch, encoder):
        for part in pieces_of(batch, ["text"], 1_000_000):
            ids = encoder.encode(part["text"])
            yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy()} | finish(ids)).astype({"doc_id": part["doc_id"].dtype})

    if dictionary.count() <= broadcast_segments:
        shared = documents.sparkSession.sparkContext.broadcast(_packed(_hashed(dictionary).toArrow()))

        def run(batches):
            gc.disable()
            encoder = _Encoder(joined.value, _finder(shared.value))
            for batch in batches:
                yield from rows(batch, encoder)

        return documents.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, {shape}")

    size = documents.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_CHARS))
    # dealt in turn, so that repeated rows spread, and written, so that both readings give a row the same block
    dealt = stash(documents.select(F.pmod(F.monotonically_increasing_id(), F.lit(blocks)).alias("block"), "doc_id", "text"), "dealt")
    needed = _distinct_segments(dealt, joints, block=True).join(dictionary, "segment")

    def run_block(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        known = dict(zip(right["segment"], right["ids"], strict=True))
        encoder = _Encoder(joined.value, lambda parts: [known[x] for x in parts])
        return pd.concat([pd.DataFrame({"doc_id": []} | finish([])), *rows(left, encoder)], ignore_index=True).astype({"doc_id": left["doc_id"].dtype})

    return dealt.groupBy("block").cogroup(needed.groupBy("block")).applyInPandas(run_block, f"doc_id {kind}, {shape}")


def decode(encoded: DataFrame, table: PieceTable) -> DataFrame:
    """doc_id and text of every row of ids (array<int> or packed); the dummy prefix's space goes. Null ids give ''.

    Bytes that are no UTF-8 become U+FFFD; unknown ids raise.
    """
    texts = list(table.texts)
    kinds = {f.name: f.dataType.simpleString() for f in encoded.schema.fields}

    def text(ids) -> str:
        if ids is None:
            return ""
        ids = np.frombuffer(ids, dtype="<i4") if isinstance(ids, bytes | bytearray) else np.asarray(ids)
        return b"".join(map(texts.__getitem__, ids.tolist())).decode("utf-8", "replace").removeprefix(" ")

    def run(batches):
        for batch in batches:
            for i in range(0, len(batch), 200):
                part = batch.iloc[i : i + 200]
                yield pd.DataFrame({"doc_id": part["doc_id"], "text": [text(x) for x in part["ids"]]})

    return encoded.select("doc_id", "ids").mapInPandas(run, f"doc_id {kinds['doc_id']}, text string")


def round_trip(documents: DataFrame, table: PieceTable) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of the packed ids) and text_crc32 (of the decoded text's UTF-8)."""
    texts = list(table.texts)

    def finish(ids: list[bytes]) -> dict[str, list[int]]:
        decoded = (b"".join(map(texts.__getitem__, np.frombuffer(x, dtype="<i4").tolist())).decode("utf-8", "replace").removeprefix(" ") for x in ids)
        return {"n_pieces": [len(x) // 4 for x in ids], "ids_crc32": [zlib.crc32(x) for x in ids], "text_crc32": [zlib.crc32(t.encode("utf-8", "replace")) for t in decoded]}

    return encode(documents, table, finish=finish, shape="n_pieces long, ids_crc32 long, text_crc32 long")
