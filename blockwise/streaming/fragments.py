"""Structured Streaming forms: rows of (stream_id, seq, payload, is_last) in, fragments or wire bytes out as they become
known.

``stateful_fragments`` keeps the chunker, the bytes of the unfinished block and the hash index of each stream in the
state store, so results do not depend on how the input falls into rows or micro-batches. Within a micro-batch rows are
sorted by seq; a seq at or below one already seen is an error. A row with ``is_last`` ends its stream: the index goes, a
mark of the end stays, and a later row of that stream is an error. ``wire`` makes the interleaved format of the same
blocks in one pass: its pieces, joined in order, are the encoded stream.
``first_seen`` keeps the first row of every hash of a stream of blocks; its state grows with the distinct hashes, as
there is no event time in this model: distance in blocks is the horizon of ``bound``, and an evicting index of
``index_bound`` hashes the other one.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from operator import itemgetter

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import varint
from ..operators.chunking import chunker
from ..operators.matching import EvictingIndex
from ..options import OptionError, check_size

SHAPE = "stream_id long, n long, hash string, size int, is_new boolean, back_offset long, closed boolean"
WIRE = "stream_id long, n long, piece binary"
_ROW, _WIRE_ROW = (Row(*(c.split()[0] for c in shape.split(", "))) for shape in (SHAPE, WIRE))
_ENGINE = "settings string, table binary, pending binary, n long, last_seq long, ended boolean"


class FragmentProcessor(StatefulProcessor):
    """State of a stream: what its chunker carries (as named fields), pending bytes, next number, last seq and whether it
    has ended, as one value; and hash -> latest number as a map. Every call of the state store is a message to the JVM, so
    what a micro-batch adds to the map is held by the task until the stream's rows are done, and a stream that ends in the
    micro-batch in which it began never touches the map. ``bound`` forgets hashes that are out of reach, every ``SWEEP``
    blocks; ``index_bound`` drops the least recently used quarter when more hashes are held."""

    SWEEP = 65536

    def __init__(self, mode: str, max_size: int, bound: int | None, index_bound: int | None, signatures: list[bytes] | None, wire: bool) -> None:
        self.mode, self.max_size, self.bound, self.index_bound, self.signatures, self.wire = mode, max_size, bound, index_bound, signatures, wire

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("stream", _ENGINE)
        self.index = handle.getMapState("index", "hash string", "n long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        engine, pending, n, last, ended = chunker(self.mode, self.max_size, self.signatures), b"", 0, None, False
        if known := self.value.exists():
            settings, table, pending, n, last, ended = self.value.get()
            if not ended:
                engine.load(json.loads(settings), bytes(table))
            pending = bytes(pending)
        began, fresh, recent = n, {}, None  # fresh: hash -> latest number of this micro-batch's blocks
        row, out = (_WIRE_ROW if self.wire else _ROW), []
        if self.index_bound:  # the index is small: it is held in order of use and written back
            recent = EvictingIndex(self.index_bound)
            if known:
                recent.seen.update((h, at) for at, h in sorted((at, h) for (h,), (at,) in self.index.iterator()))
        if not n and last is None and self.wire:
            out.append(row(key[0], -1, varint.encode(2) + varint.encode(self.max_size) + varint.encode(self.bound)))

        def offset(h: str) -> int | None:
            if recent is not None:
                return recent.back_offset(h, n)
            before, fresh[h] = fresh.get(h), n
            if before is None and known and (self.bound is None or n - began < self.bound) and self.index.containsKey((h,)):
                before = self.index.getValue((h,))[0]
            return n - before if before is not None and (self.bound is None or n - before <= self.bound) else None

        def emit(block: bytes, closed: bool) -> None:
            nonlocal n
            h = hashlib.sha1(block).hexdigest()
            off = offset(h) if closed or not self.wire else None
            if not self.wire:
                out.append(row(key[0], n, h, len(block), off is None, off, closed))
            elif closed:
                out.append(row(key[0], n, varint.encode(off) if off else varint.encode(0) + varint.encode(self.max_size - len(block)) + block))
            n += 1
            if self.bound and n % self.SWEEP == 0:
                for old in [h for h, at in fresh.items() if n - at > self.bound]:
                    del fresh[old]

        for seq, payload, is_last in sorted(((r.seq, r.payload, r.is_last) for r in rows), key=itemgetter(0)):
            if ended:
                raise ValueError(f"stream {key[0]}: seq {seq} behind its end")
            if last is not None and seq <= last:
                raise ValueError(f"stream {key[0]}: seq {seq} after {last}")
            last, payload, begin, held = int(seq), bytes(payload or b""), 0, len(pending)
            data = pending + payload
            for end in engine.ends(payload):  # of blocks, counted from the payload's start; signatures can end before it
                emit(data[begin : held + end], True)
                begin = held + end
            pending = data[begin:]
            if is_last:
                for end in engine.close():
                    emit(pending[: len(pending) + end], True)
                    pending = pending[len(pending) + end :]
                if self.wire:
                    tail = varint.encode(varint.END_MARK) + varint.encode(self.max_size - len(pending)) + pending + varint.encode(0)
                    out.append(row(key[0], n, tail))
                elif pending:
                    emit(pending, False)
                ended = True
        if ended:
            if known:
                self.index.clear()
            self.value.update((json.dumps({}), b"", b"", n, last, True))
        else:
            settings, table = engine.dump()
            self.value.update((json.dumps(settings), table, pending, n, last, False))
            if recent is not None:
                held = {h for (h,), _ in self.index.iterator()} if known else set()
                for h in held - recent.seen.keys():
                    self.index.removeKey((h,))
                fresh = recent.seen
            elif self.bound:
                if known and n // self.SWEEP > began // self.SWEEP:
                    for (old,), (at,) in list(self.index.iterator()):
                        if n - at > self.bound:
                            self.index.removeKey((old,))
                fresh = {h: at for h, at in fresh.items() if n - at <= self.bound}
            for h, at in fresh.items():
                self.index.updateValue((h,), (at,))
        yield from out

    def close(self) -> None:
        pass


def stateful_fragments(stream: DataFrame, mode: str = "fixed", max_size: int = 4096, bound: int | None = None, index_bound: int | None = None, signatures: list[bytes] | None = None) -> DataFrame:
    """Fragments of every stream. Needs the RocksDB state store provider."""
    check_size(mode, max_size)
    if bound and index_bound:
        raise OptionError("either a distance or an index is bounded")
    processor = FragmentProcessor(mode, max_size, bound, index_bound, signatures, False)
    return stream.groupBy("stream_id").transformWithState(processor, SHAPE, "append", "None")


def wire(stream: DataFrame, mode: str = "fixed", max_size: int = 4096, bound: int = 256, signatures: list[bytes] | None = None) -> DataFrame:
    """(stream_id, n, piece): the interleaved encoding of every stream, in one pass; pieces in order of n."""
    check_size(mode, max_size)
    if bound < 1:
        raise OptionError("the bound must be one block at least")
    return stream.groupBy("stream_id").transformWithState(FragmentProcessor(mode, max_size, bound, None, signatures, True), WIRE, "append", "None")


def first_seen(blocks: DataFrame) -> DataFrame:
    """The first row of every hash of a streaming block table."""
    return blocks.dropDuplicates(["hash"])


def fixed_blocks(stream: DataFrame, max_size: int = 4096) -> DataFrame:
    """Blocks of single-row streams, without state: (stream_id, idx, hash, size)."""
    from ..operators.chunking import chunk

    return chunk(stream, "fixed", max_size).withColumn("hash", F.sha1("payload")).drop("payload", "closed")
