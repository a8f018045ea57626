"""Shared plumbing of the text-corpus operators."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..storage import discard, materialize, shared_dir

__all__ = ["chunks_by_size", "discard", "id_text", "materialize", "mix", "partitions", "shared_dir", "shingle_hashes", "trim", "word_hashes"]


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) with null texts as empty ones; other columns, whatever their names, do not travel on."""
    return docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hash of every word."""
    return np.array(list(map(xxhash.xxh3_64_intdigest, words)), dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser with full avalanche."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def trim() -> None:
    """Give freed memory of a Python worker back: workers are reused, and their leftovers add up."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another libc
        pass


_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive words, in order; with fewer words, of the whole sequence as one."""
    n = len(h)
    if n == 0:
        return h
    k = min(k, n)
    out = h[: n - k + 1].copy()
    for j in range(1, k):
        out = mix(out * _ODD + np.uint64(j)) + h[j : n - k + 1 + j]
    return mix(out + np.uint64(k))


def chunks_by_size(texts: list, limit: int):
    """(start, end) of runs of rows of about ``limit`` characters together."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
