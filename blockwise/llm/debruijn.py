"""Removal of repeated substrings over a compacted de Bruijn graph of words.

Every run of ``window`` consecutive words is an edge from the node of its first ``window - 1`` words to the node of its
last ones. Edges that occur twice or more are kept. A node branches if two different kept edges enter or leave it; it
is a border if a run of kept edges starts or ends there in some document. Between such nodes, all occurrences of an
edge run on together: that piece of a document is a segment, and equal segments of all documents are one row. Segments
that meet in a border which does not branch are compacted by joins into nonbranching paths. Paths are verified at
their source coordinates: the words of each segment's occurrences are hashed anew with 128 bits. A path of which each
segment has one spelling, twice or more, is confirmed; others (hashes clashed) are verified edge by edge, and only
windows whose words occur twice are removed.

Edges and nodes are combined as in ``counting``: a window in a third of all documents is one entry a chunk, so no task
meets all its occurrences. Words are runs without ASCII white space, unchanged. Rows are told apart by id and text;
repeated rows repeat each other's windows. Null texts have no words; rows without an id take part; texts of any length
are taken whole. Extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import discard, id_text, materialize, mix, trim
from .components import components
from .counting import RANGED, Words, answers, met, n_ranges, repeated, to_ranges, word_chunks
from .packing import pack, unpack

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BRANCH, BORDER = 1, 2


def window_hashes(words: np.ndarray, window: int, bits: int = 64) -> np.ndarray:
    """A hash of every run of ``window`` word hashes: differences of prefix sums of a polynomial, mixed. The upper
    ``bits`` stay."""
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power = np.full(len(words), _BASE, np.uint64)
    power[0] = 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * np.cumprod(power))])
    back = np.full(n, _INVERSE, np.uint64)
    back[0] = 1
    return mix((sums[window:] - sums[:n]) * np.cumprod(back)) & ~np.uint64(2 ** (64 - bits) - 1)


class Edges:
    """The edges of a chunk in order of place: ``row``, ``at`` (first word within the row), ``flat`` (within the chunk)
    and ``hash``; ``keys`` are the distinct hashes, ``which`` each edge's place among them."""

    def __init__(self, blob: bytes, window: int, bits: int) -> None:
        self.chunk = Words(blob)
        size = self.chunk.sizes.astype(np.int64)
        n = np.maximum(size - window + 1, 0)
        self.row = np.repeat(np.arange(len(size)), n)
        self.at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        self.flat = self.at + self.chunk.starts[self.row]
        self.hash = window_hashes(self.chunk.words, window, bits)[self.flat]
        self.keys, self.which = np.unique(self.hash, return_inverse=True)

    def keep(self, found: tuple | None) -> int:
        """Leaves only edges that occur twice or more; returns their number."""
        many = np.zeros(len(self.keys), bool)
        if found:
            many[found[0]] = True
        many = many[self.which]
        self.row, self.at, self.flat, self.hash = self.row[many], self.at[many], self.flat[many], self.hash[many]
        return len(self.hash)

    def follows(self) -> np.ndarray:
        """Whether the edge before stands right before it in the same row."""
        return np.concatenate([[False], self.flat[1:] == self.flat[:-1] + 1]) & np.concatenate([[False], self.row[1:] == self.row[:-1]])


_NONE = np.uint64(2**64 - 1)


def _nodes(edges: Edges, window: int) -> tuple[np.ndarray, list[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Distinct nodes of kept edges; the least edge into and out of each, what the greatest differs by, and whether a
    run starts or ends there; and, of each edge, the places of its two nodes."""
    name = window_hashes(edges.chunk.words, window - 1)
    follows = edges.follows()
    first, last = name[edges.flat], name[edges.flat + 1]
    keys, place = np.unique(np.concatenate([first, last]), return_inverse=True)
    first, last = place[: len(first)], place[len(first) :]
    out = []
    for at in (last, first):  # edges into nodes, then out of nodes
        low, high = np.full(len(keys), _NONE), np.zeros(len(keys), np.uint64)
        np.minimum.at(low, at, edges.hash)
        np.maximum.at(high, at, edges.hash)
        out += [low, np.where(low == _NONE, np.uint64(0), low ^ high)]
    border = np.zeros(len(keys), np.uint32)
    border[first[~follows]] = 1
    border[last[~np.append(follows[1:], False)]] = 1
    return keys, [*out, border], (first, last)


def _kinds(starts: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Nodes that branch or are borders, and which of both."""
    kind = BORDER * np.maximum.reduceat(values[4], starts)
    for low, differs in (values[:2], values[2:4]):
        low_all = np.minimum.reduceat(low, starts)
        high_all = np.maximum.reduceat(np.where(low == _NONE, np.uint64(0), low ^ differs), starts)
        kind |= np.where((low_all != _NONE) & (low_all != high_all), np.uint32(BRANCH), np.uint32(0))
    return kind > 0, [kind.astype(np.uint32)]


def segments(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """(k1, k2, spans) of the distinct rows with repeated windows; ``spans`` packs the starts, lengths in edges
    and names of the row's segments, the names of their end nodes and whether these branch."""
    chunks = materialize(word_chunks(docs, False, id_col, text_col), "words")
    ranges = n_ranges(chunks)

    def edge_entries(batches):
        for b in batches:
            for g, blob in zip(b.column("g").to_pylist(), b.column("blob").to_pylist()):
                edges = Edges(blob, window, bits)
                yield from to_ranges(g, edges.keys, [np.bincount(edges.which, minlength=len(edges.keys)).astype(np.uint32)], ranges)
        trim()

    def node_entries(g, blob, found):
        edges = Edges(blob, window, bits)
        if edges.keep(found[0]):
            keys, values, _ = _nodes(edges, window)
            yield from to_ranges(g, keys, values, ranges)

    def cut(g, blob, found):
        edges = Edges(blob, window, bits)
        n = edges.keep(found[0])
        if not n:
            return
        names, _, (first, last) = _nodes(edges, window)
        kind = np.zeros(len(names), np.uint32)
        kind[found[1][0]] = found[1][1]
        begin = np.flatnonzero(~edges.follows() | (kind[first] > 0))
        size = np.diff(np.append(begin, n))
        end = begin + size - 1
        step = (np.arange(n) - np.repeat(begin, size)).astype(np.uint64)
        name = np.add.reduceat(mix(edges.hash + step * _BASE), begin)
        ends = (kind[first[begin]] & BRANCH) + 2 * (kind[last[end]] & BRANCH)
        row = np.flatnonzero(np.concatenate([[True], edges.row[begin][1:] != edges.row[begin][:-1]]))
        out = [
            pack(edges.at[begin[a:z]].astype(np.uint32), size[a:z].astype(np.uint32), name[a:z], names[first[begin[a:z]]], names[last[end[a:z]]], ends[a:z].astype(np.uint32))
            for a, z in zip(row.tolist(), [*row[1:].tolist(), len(begin)])
        ]
        own = edges.row[begin[row]]
        k1 = np.where(edges.chunk.known[own], edges.chunk.ids[own], np.iinfo(np.int64).min)
        yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(edges.chunk.keys[own].view(np.int64)), pa.array(out, pa.binary())], ["k1", "k2", "spans"])

    often = materialize(answers(chunks.select("g", "blob").mapInArrow(edge_entries, RANGED), repeated), "edges")
    kinds = materialize(answers(met(chunks, often, run=node_entries, schema=RANGED), _kinds), "nodes")
    # rows of one id and text have the same segments: one of them stands for all
    out = materialize(met(chunks, often, kinds, run=cut, schema="k1 long, k2 long, spans binary").dropDuplicates(["k1", "k2"]), "segments")
    discard(chunks, often, kinds)
    return out


_LONG, _TEXT = pa.int64(), pa.string()


def paths(spans: DataFrame) -> DataFrame:
    """(segment, path) of all segments: those that meet in a node where no path ends are one path, named by its least
    segment. Segments are joined by their end nodes, then chains are contracted by joins."""

    def listed(batches):
        for b in batches:
            seen = {p for blob in b.column(0).to_pylist() for p in zip(*(x.tolist() for x in unpack(blob)[2:]))}
            yield _batch([(*map(_signed, s[:3]), s[3]) for s in seen], (("segment", _LONG), ("a", _LONG), ("z", _LONG), ("ends", pa.int32())))

    every = materialize(spans.select("spans").mapInArrow(listed, "segment long, a long, z long, ends int").dropDuplicates(["segment"]), "path-parts")
    ahead = every.where("ends < 2").select(F.col("segment").alias("a"), F.col("z").alias("node"))
    after = every.where("ends % 2 = 0").select(F.col("segment").alias("b"), F.col("a").alias("node"))
    glued = components(ahead.join(after, "node").select("a", "b"))
    named = every.select("segment").join(glued.withColumnRenamed("id", "segment"), "segment", "left")
    return named.select("segment", F.coalesce("component", "segment").alias("path"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return id_text(docs, id_col, text_col).select(F.coalesce("id", F.lit(-(2**63))).alias("k1"), F.xxhash64("text").alias("k2"), "id", "text")


def _content(words: list[bytes], start: int, edges: int, window: int) -> str:
    return xxhash.xxh3_128_hexdigest(b" ".join(words[start : start + edges + window - 1]))


def remove_repeats(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", texts: bool = False, bits: int = 64) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, n_segments), or with ``texts`` the kept text in place of its hash.
    ``bits`` of the windows' hashes are used; what clashes is told apart at the coordinates."""
    spans = segments(docs, window, id_col, text_col, bits)
    joined = materialize(_keyed(docs, id_col, text_col).join(spans, ["k1", "k2"], "left"), "joined")

    def visit(batches):
        """Segments at their coordinates, alike ones of a batch together: (segment, hash of the words, n)."""
        for b in batches:
            seen: dict = {}
            for text, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = text.encode().split()
                for s, n, p in zip(*(x.tolist() for x in unpack(blob)[:3])):
                    key = (_signed(p), _content(words, s, n, window))
                    seen[key] = seen.get(key, 0) + 1
            yield _batch([(*k, n) for k, n in seen.items()], (("segment", _LONG), ("words", _TEXT), ("n", _LONG)))

    with_spans = joined.where("spans is not null")
    table = with_spans.select("text", "spans").mapInArrow(visit, "segment long, words string, n long").groupBy("segment", "words").agg(F.sum("n").alias("n"))
    table = table.groupBy("segment").agg(((F.count("*") > 1) | (F.max("n") < 2)).alias("wrong"))
    named = materialize(table.join(paths(spans), "segment"), "paths")
    doubted = named.where("wrong").select("path").distinct()  # a clash of hashes: all of such a path is verified edge by edge
    bad = _unconfirmed(with_spans, named.join(doubted, "path").select("segment"), window)

    def keep(batches):
        for b in batches:
            out = []
            for i, text, blob, wrong in zip(*(c.to_pylist() for c in b.columns)):
                words = text.encode().split()
                gone, n = 0, 0
                left = np.ones(len(words), bool)
                if blob is not None:
                    start, size = unpack(blob)[:2]
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + size, -1)
                    there = np.cumsum(edge[:-1]) > 0
                    there[wrong or []] = False
                    at = np.flatnonzero(there)
                    cover = np.zeros(len(words) + 1, np.int64)
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + window, -1)
                    left = np.cumsum(cover[:-1]) == 0
                    gone, n = int((~left).sum()), len(start)
                kept = b" ".join(words if not gone else [words[x] for x in np.flatnonzero(left).tolist()])
                out.append((i, len(words), gone, kept.decode() if texts else hashlib.sha256(kept).hexdigest(), n))
            yield _batch(out, (("doc_id", _LONG), ("n_words", _LONG), ("n_removed", _LONG), (name, _TEXT), ("n_segments", _LONG)))

    name = "kept" if texts else "kept_sha256"
    if bad is None:
        marked = joined.select("id", "text", "spans", F.lit(None).cast("array<long>").alias("wrong"))
    else:
        marked = joined.join(bad, ["k1", "k2"], "left").select("id", "text", "spans", "wrong")
    return marked.mapInArrow(keep, f"doc_id long, n_words long, n_removed long, {name} string, n_segments long")


def _unconfirmed(with_spans: DataFrame, doubted: DataFrame, window: int) -> DataFrame | None:
    """(k1, k2, wrong): windows of doubted segments whose words occur at no second place; None if there are none. All
    occurrences of a segment's edges lie in segments of that name, so these alone need be compared."""

    def lists(batches):
        for b in batches:
            rows = [(x, y, _signed(p)) for x, y, blob in zip(*(c.to_pylist() for c in b.columns)) for p in set(unpack(blob)[2].tolist())]
            yield _batch(rows, (("k1", _LONG), ("k2", _LONG), ("segment", _LONG)))

    def edges(batches):
        for b in batches:
            seen: dict = {}
            for k1, k2, text, blob, apart in zip(*(c.to_pylist() for c in b.columns)):
                words, apart = text.encode().split(), set(apart)
                for s, n, p in zip(*(x.tolist() for x in unpack(blob)[:3])):
                    if _signed(p) in apart:
                        for i in range(s, s + n):
                            key = _content(words, i, 1, window)
                            seen[key] = (k1, k2, i, seen[key][3] + 1 if key in seen else 1)
            yield _batch([(k, *v) for k, v in seen.items()], (("words", _TEXT), ("k1", _LONG), ("k2", _LONG), ("at", _LONG), ("n", _LONG)))

    if doubted.isEmpty():
        return None
    apart = with_spans.select("k1", "k2", "spans").mapInArrow(lists, "k1 long, k2 long, segment long").join(doubted, "segment").groupBy("k1", "k2").agg(F.collect_set("segment").alias("apart"))
    marked = with_spans.select("k1", "k2", "text", "spans").join(apart, ["k1", "k2"])
    counted = marked.mapInArrow(edges, "words string, k1 long, k2 long, at long, n long").groupBy("words").agg(F.sum("n").alias("n"), F.max(F.struct("k1", "k2", "at")).alias("w"))
    bad = materialize(counted.where("n = 1").select("w.*"), "unconfirmed")
    return None if bad.isEmpty() else bad.groupBy("k1", "k2").agg(F.collect_list("at").alias("wrong"))


def _signed(x: int) -> int:
    return x - (x >> 63 << 64)


def _batch(rows: list[tuple], fields) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows) if rows else [()] * len(fields), fields)], [n for n, _ in fields])
