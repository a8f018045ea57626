"""Odds that two different blocks share a hash (birthday bound)."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, functions as F

HASH_BITS = {"sha1": 160, "sha256": 256, "sha512": 512, "md5": 128}


def probability(blocks: Column, bits: int = 160) -> Column:
    """k (k - 1) / 2^(bits + 1), with one rounding of the product; 0 for fewer than two blocks."""
    k = blocks.cast("decimal(19,0)")
    return F.when(blocks < 2, F.lit(0.0)).otherwise((k * (k - 1)).cast("double") / F.pow(F.lit(2.0), F.lit(float(bits + 1))))


def describe(blocks: int, bits: int = 160) -> str:
    """The exact odds as text."""
    if blocks < 2:
        return "Collision probability is 0"
    p = Fraction(blocks * (blocks - 1), 2 * 2**bits)
    return f"Collision probability is ~ 1/{round(1 / p)} ~ {float(p)!r}"
