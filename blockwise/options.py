"""Options of encoders and their errors. Sizes are bytes; bounds are turned into blocks."""

from __future__ import annotations

import warnings

MODES = ("fixed", "dynamic", "entropy", "signature", "signature_only")
MIN_BLOCK_SIZE = 512
HASHES = ("sha1", "sha256", "sha512", "md5")


class OptionError(ValueError):
    """An option that no encoder accepts."""


class SizeTooSmall(OptionError):
    """The block size is under ``MIN_BLOCK_SIZE``."""


class MaxMemoryTooSmall(OptionError):
    """The memory bound does not hold the blocks that the format or the eviction rule needs."""


class UnknownMode(OptionError):
    """The chunking mode is none of ``MODES``."""


class CorruptStream(ValueError):
    """Encoded bytes break a rule of their format."""


class UnknownFormat(CorruptStream):
    """The format number is not the expected one."""


def check_size(mode: str, max_size: int) -> None:
    if max_size < MIN_BLOCK_SIZE:
        raise SizeTooSmall(f"block size {max_size} is under {MIN_BLOCK_SIZE}")
    if mode not in MODES:
        raise UnknownMode(f"{mode!r} is none of {', '.join(MODES)}")


def max_blocks(mode: str, max_size: int, max_memory: int, interleaved: bool) -> int:
    """The bound in blocks; 0 is unlimited (indexed encoding only)."""
    check_size(mode, max_size)
    if interleaved:
        if max_memory < max_size:
            raise MaxMemoryTooSmall("interleaved encoding needs memory for one block at least")
        return max_memory // max_size
    if 0 < max_memory < max_size:
        warnings.warn("a memory bound under one block means no bound", stacklevel=3)
        return 0
    if 0 < max_memory // max_size < 4:
        raise MaxMemoryTooSmall("a quarter of the blocks is evicted at a time: the bound must be 0 or 4 blocks at least")
    return max_memory // max_size
