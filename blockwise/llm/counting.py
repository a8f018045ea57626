"""Counts of hashes over a whole corpus without a task that meets all entries of one hash.

``word_chunks`` writes the words of a table once, as chunks of some millions of characters: one row holds the codes of
the words and the dictionary of their hashes. A chunk then sends each of its *distinct* keys (shingles, windows, nodes)
once, with what it has to say of them, to the range that the key's hash lies in (``to_ranges``); a range combines what
all chunks say and answers each chunk that asked (``answers``); chunk and answers meet by the chunk's name. So a key in
a third of all documents is one entry a chunk, however often it occurs there, and its owners never leave their chunk.
"""

from __future__ import annotations

import secrets
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import chunks_by_size, id_text, trim, word_hashes
from .packing import deltas, pack, ranges_of, undelta, unpack

CHUNK = 5_000_000  # characters whose words make a chunk
RANGE_KEYS = 2_000_000  # keys that a range of hashes shall hold


class Words:
    """The rows of a chunk: ``ids`` (``known`` where there is one), ``keys`` (64-bit hashes of the texts), ``sizes``
    (words of each row) and the hashes of all words one after the other."""

    def __init__(self, blob: bytes) -> None:
        table, codes, self.sizes, ids, known, self.keys = unpack(blob)
        self.words, self.ids, self.known = table[codes], ids.view(np.int64), known > 0
        self.starts = np.cumsum(self.sizes, dtype=np.int64) - self.sizes

    def row(self, i: int) -> np.ndarray:
        return self.words[self.starts[i] : self.starts[i] + self.sizes[i]]


def word_chunks(docs: DataFrame, lower: bool, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(g, n_words, blob) of a table; ``g`` is drawn at random, so the result must be written before it is used twice.
    Words are runs without ASCII white space; with ``lower``, A-Z are lower-cased."""

    def scan(batches):
        for b in batches:
            ids, keys, texts = b.column(0), b.column(1).to_numpy(), b.column(2).to_pylist()
            known, ids = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            for lo, hi in chunks_by_size(texts, CHUNK):
                place: defaultdict = defaultdict(count().__next__)
                codes, sizes = [], []
                for t in texts[lo:hi]:
                    raw = t.encode()
                    own = list(map(place.__getitem__, (raw.lower() if lower else raw).split()))
                    codes.append(np.array(own, np.uint32))
                    sizes.append(len(own))
                blob = pack(word_hashes([*place]), np.concatenate(codes), np.array(sizes, np.uint32), ids[lo:hi].astype(np.int64).view(np.uint64), known[lo:hi].astype(np.uint32), keys[lo:hi].astype(np.int64).view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array([secrets.randbits(63)], pa.int64()), pa.array([sum(sizes)], pa.int64()), pa.array([blob], pa.binary())], ["g", "n_words", "blob"])
        trim()

    rows = id_text(docs, id_col, text_col).select("id", F.xxhash64("text").alias("key"), "text")
    return rows.mapInArrow(scan, "g long, n_words long, blob binary")


def n_ranges(chunks: DataFrame, keys: int = RANGE_KEYS) -> int:
    """Ranges for the keys of all chunks; entries of more values need ranges of fewer ``keys``."""
    return max(4, -(-(chunks.agg(F.sum("n_words")).first()[0] or 0) // keys))


RANGED = "r long, g long, blob binary"


def to_ranges(g: int, keys: np.ndarray, values: list[np.ndarray], ranges: int) -> Iterator[pa.RecordBatch]:
    """A chunk's distinct ascending keys and what it says of each, as one row for each range that has any."""
    if not len(keys):
        return
    at = ranges_of(keys, ranges)
    begin = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    blobs = [pack(deltas(keys[a:z]), np.array([a], np.uint32), *(v[a:z] for v in values)) for a, z in zip(begin.tolist(), [*begin[1:].tolist(), len(keys)])]
    yield pa.RecordBatch.from_arrays([pa.array(at[begin].astype(np.int64)), pa.array(np.full(len(begin), g, np.int64)), pa.array(blobs, pa.binary())], ["r", "g", "blob"])


def answers(ranged: DataFrame, combine: Callable) -> DataFrame:
    """(g, blob): for each chunk the places of its keys that ``combine`` keeps, ascending within a row, and what it found.

    ``combine(starts, values)`` gets, for the keys of a range, where each key's entries start and the entries' values;
    it returns a mask of the keys and arrays of findings."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, first, parts = [], [], []
        for b in batches:
            for g, blob in zip(b.column("g").to_pylist(), b.column("blob").to_pylist()):
                d, at, *values = unpack(blob)
                names.append(g)
                first.append(int(at[0]))
                parts.append((undelta(d), *values))
        size = np.array([len(p[0]) for p in parts])
        columns = list(zip(*parts))[::-1]
        del parts
        keys = np.concatenate(columns.pop())
        order = np.argsort(keys, kind="stable")
        keys, values = keys[order], []
        while columns:  # one column at a time is held twice
            values.append(np.concatenate(columns.pop())[order])
        fresh = np.concatenate([[True], keys[1:] != keys[:-1]])
        keep, found = combine(np.flatnonzero(fresh), values)
        del values
        which = np.empty(len(keys), np.int64)  # of each entry as it came, its key
        which[order] = np.cumsum(fresh) - 1
        begin = np.cumsum(size) - size
        for g, at, a, n in zip(names, first, begin.tolist(), size.tolist()):
            own = which[a : a + n]
            if len(hit := np.flatnonzero(keep[own])):
                blob = pack(deltas((hit + at).astype(np.uint32)), *(f[own[hit]] for f in found))
                yield pa.RecordBatch.from_arrays([pa.array([g], pa.int64()), pa.array([blob], pa.binary())], ["g", "blob"])
        trim()

    return ranged.groupBy("r").applyInArrow(run, "g long, blob binary")


def summed(starts: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Keys that occur twice or more, and how often."""
    total = np.add.reduceat(values[0].astype(np.uint64), starts)
    return total > 1, [total]


def repeated(starts: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Keys that occur twice or more."""
    return summed(starts, values)[0], []


def met(chunks: DataFrame, *replies: DataFrame, run: Callable, schema: str) -> DataFrame:
    """Rows that ``run(g, blob, answers)`` yields as record batches: each chunk with the answers of each table, given
    as (places, finding, ...) arrays or None."""

    n = len(replies)

    def join(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, parts = None, [[] for _ in range(n)]
        for b in batches:
            for k, blob in zip(b.column("kind").to_pylist(), b.column("blob").to_pylist()):
                if k:
                    d, *found = unpack(blob)
                    parts[k - 1].append((undelta(d), *found))
                else:
                    own = blob
        yield from run(key[0].as_py(), own, [tuple(np.concatenate(c) for c in zip(*p)) if p else None for p in parts])
        trim()

    rows = chunks.select("g", F.lit(0).alias("kind"), "blob")
    for k, r in enumerate(replies, 1):
        rows = rows.unionAll(r.select("g", F.lit(k).alias("kind"), "blob"))
    return rows.groupBy("g").applyInArrow(join, schema)
