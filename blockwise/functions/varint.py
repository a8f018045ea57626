"""LEB128 unsigned varints: bytes in Python, lengths as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..options import CorruptStream

END_MARK = 2**64 - 1


def encode(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)
    return bytes(out)


def decode(data: bytes, at: int) -> tuple[int, int]:
    """(value, offset behind it)."""
    value = shift = 0
    while True:
        if at >= len(data):
            raise CorruptStream("truncated number")
        value |= (data[at] & 127) << shift
        at += 1
        if data[at - 1] < 128:
            if value > END_MARK:
                raise CorruptStream("number of more than 64 bits")
            return value, at
        shift += 7
        if shift > 63:
            raise CorruptStream("number of more than 64 bits")


def length(value: Column) -> Column:
    """Encoded bytes of a non-negative long."""
    out = F.lit(9)
    for n in range(8, 0, -1):
        out = F.when(value < F.lit(1 << 7 * n), n).otherwise(out)
    return out.cast("long")
