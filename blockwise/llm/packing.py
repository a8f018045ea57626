"""Columns of integers as compact binary, for exchanges of very many small entries: one row then carries a block of
entries instead of one, so that Spark moves and sorts few rows and NumPy does the rest."""

from __future__ import annotations

import numpy as np
import zstandard


def pack(*columns: np.ndarray) -> bytes:
    """Byte planes of uint64 and uint32 columns, compressed. Columns may differ in length."""
    out = []
    for c in columns:
        raw = np.ascontiguousarray(c)
        planes = raw.view(np.uint8).reshape(len(raw), raw.dtype.itemsize).T.tobytes()
        out.append(np.array([len(raw), raw.dtype.itemsize], np.uint64).tobytes() + planes)
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(raw):
        n, width = (int(x) for x in np.frombuffer(raw, np.uint64, 2, at))
        planes = np.frombuffer(raw, np.uint8, n * width, at + 16).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(np.uint64 if width == 8 else np.uint32))
        at += 16 + n * width
    return out


def deltas(x: np.ndarray) -> np.ndarray:
    """Differences of an ascending column; its own start first."""
    return np.diff(x, prepend=x.dtype.type(0)) if len(x) else x


def undelta(x: np.ndarray) -> np.ndarray:
    return np.cumsum(x, dtype=x.dtype)


def ranges_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """The range, of n equal ones, that each 64-bit hash falls into; ascending with the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
