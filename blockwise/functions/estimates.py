"""Scalar estimates: memory of encoder and decoder, and sizes of encodings that are not made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import varint

ENTRY_BYTES = 20 + 8 + 24  # a hash, a number and a map entry
LONG_MAX = 2**63 - 1


def memory(size: Column, max_size: int, bound: int = 0) -> tuple[Column, Column]:
    """(encoder bytes, decoder bytes) for an input of ``size`` bytes, capped at the largest long."""
    blocks = F.ceil(size.cast("decimal(38,0)") / F.lit(max_size)).cast("decimal(38,0)")
    if bound:
        blocks = F.least(blocks, F.lit(bound).cast("decimal(38,0)"))
    cap = F.lit(LONG_MAX).cast("decimal(38,0)")
    return tuple(F.least((blocks * F.lit(n)).cast("decimal(38,0)"), cap).cast("long") for n in (ENTRY_BYTES, max_size))


def interleaved_memory(max_size: int, bound: int) -> int:
    """Bytes of an interleaved decoder's ring; -1 if the bound is unknown."""
    return max_size * bound if bound else -1


def encoded_size(entries: DataFrame, max_size: int, bound: int | None = None) -> DataFrame:
    """(stream_id, index_bytes, data_bytes) of entries, without making them; with ``bound`` the interleaved format,
    whose index bytes are its overhead."""
    head = len(varint.encode(1) + varint.encode(max_size)) + (len(varint.encode(bound)) if bound else 0)
    short = varint.length(F.lit(max_size) - F.col("size"))
    own = F.when(F.col("kind") == "dup", varint.length(F.col("back_offset"))).when(F.col("kind") == "new", short + 1).otherwise(short + 11)
    return entries.groupBy("stream_id").agg((F.sum(own) + head).cast("long").alias("index_bytes"), F.sum(F.when(F.col("kind") == "dup", 0).otherwise(F.col("size"))).cast("long").alias("data_bytes"))
