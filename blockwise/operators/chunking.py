"""Table-generating operators that cut byte streams into blocks.

``chunk`` takes (stream_id, payload) or (stream_id, seq, payload) and gives (stream_id, idx, payload, size, closed):
``closed`` is false for a block that only the end of its stream or a manual split has ended. With ``seq``, each
row is followed by a manual split, and blocks are numbered through the stream. Empty and null payloads give no block.
Columns named in ``carry`` stay with the blocks of rows without ``seq``.

A chunker of one stream is fed piece by piece: ``ends`` gives the ends of blocks, counted from the piece's start (a
signature may end a block before it), ``close`` those that only the stream's end decides, counted back from there.
``dump`` and ``load`` carry what it knows as named numbers and one table of bytes.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..options import OptionError, check_size

HIT, MISS, WRAP = 314159265, 271828182, 0xFFFFFFFF  # multipliers of predicted and mispredicted bytes (fixed values)


def max_hash(max_size: int) -> int:
    """A block ends where the rolling hash is under this: once in ``max_size / 4`` bytes."""
    return int(2 ** (22.0 - math.log2(max_size / 4096))) & WRAP


class RollingChunker:
    """Order-1 content-defined cut points. Predictions outlive blocks and splits, so one object serves one stream,
    fed piece by piece. ``cuts`` are further allowed ends (signatures), under the same least size."""

    def __init__(self, max_size: int) -> None:
        self.least, self.most, self.limit = max_size // 64, max_size, max_hash(max_size)
        self.next_of, self.last, self.hash, self.size = bytearray(256), 0, 0, 0

    def split(self) -> None:
        self.hash = self.size = self.last = 0

    def close(self) -> list[int]:
        return []

    def dump(self) -> tuple[dict, bytes]:
        return {"last": self.last, "hash": self.hash, "size": self.size}, bytes(self.next_of)

    def load(self, settings: dict, table: bytes) -> None:
        self.last, self.hash, self.size = (settings[k] for k in ("last", "hash", "size"))
        self.next_of = bytearray(table)

    def ends(self, data: bytes, cuts: frozenset[int] = frozenset()) -> list[int]:
        next_of, last, h, size = self.next_of, self.last, self.hash, self.size
        least, most, limit, out = self.least, self.most, self.limit, []
        for at, c in enumerate(data):
            h = (h + c + 1) * (HIT if next_of[last] == c else MISS) & WRAP
            next_of[last] = c
            last = c
            size += 1
            if size >= least and (h < limit or size >= most or at + 1 in cuts) or size >= most:
                out.append(at + 1)
                h = size = last = 0
        self.last, self.hash, self.size = last, h, size
        return out


LANES, FEW = 4096, 48  # streams that go in step at once; with fewer left, the rest goes one by one


def rolling_ends(line: np.ndarray, bounds: np.ndarray, max_size: int) -> list[np.ndarray]:
    """The ends that ``RollingChunker`` gives for each of many whole streams, which lie one behind the other in ``line``.
    Streams of similar length go in step, a byte of each at a time, so a byte costs a share of a few array steps."""
    lengths = np.diff(bounds)
    order, found = np.argsort(-lengths, kind="stable"), [None] * len(lengths)
    for begin in range(0, len(order), LANES):
        lanes = order[begin : begin + LANES]
        for lane, ends in zip(lanes.tolist(), _in_step(line, bounds[lanes], lengths[lanes], max_size)):
            found[lane] = ends
    return found


def _in_step(line: np.ndarray, starts: np.ndarray, lengths: np.ndarray, max_size: int) -> list[np.ndarray]:
    lanes, alone = len(lengths), RollingChunker(max_size)
    steps = int(lengths[FEW - 1]) if lanes >= FEW else 0
    factors, limit = np.array([MISS, HIT], np.uint32), np.uint32(alone.limit)
    followers, own = np.zeros(lanes * 256, np.uint8), np.arange(lanes) * 256
    at, context, total, size = starts.copy(), np.zeros(lanes, np.int64), np.zeros(lanes, np.uint32), np.zeros(lanes, np.int64)
    going = lanes - np.cumsum(np.bincount(np.minimum(lengths, steps), minlength=steps + 1))
    who, when, width = [], [], -1
    for step, now in enumerate(going[:steps].tolist()):
        if now != width:
            width, views = now, [v[:now] for v in (at, own, context, total, size)]
            at_, own_, context_, total_, size_ = views
        byte, slot = line[at_], own_ + context_
        predicted = followers[slot] == byte
        followers[slot] = byte
        total_ += byte
        total_ += 1
        total_ *= factors[predicted.view(np.uint8)]
        size_ += 1
        at_ += 1
        context_[:] = byte
        cut = np.flatnonzero((total_ < limit) & (size_ >= alone.least) | (size_ >= alone.most))
        if len(cut):
            who.append(cut)
            when.append(np.full(len(cut), step + 1))
            total_[cut] = size_[cut] = context_[cut] = 0
    who, when = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (who, when))
    when = when[np.argsort(who, kind="stable")]
    out = np.split(when, np.cumsum(np.bincount(who, minlength=lanes))[:-1])
    for lane in np.flatnonzero(lengths > steps).tolist():
        alone.load({"last": int(context[lane]), "hash": int(total[lane]), "size": int(size[lane])}, followers[lane * 256 : lane * 256 + 256].tobytes())
        rest = alone.ends(line[starts[lane] + steps : starts[lane] + lengths[lane]].tobytes())
        out[lane] = np.concatenate([out[lane], np.array(rest, np.int64) + steps])
    return out


class EntropyChunker:
    """Cut points by byte frequency. The first ``least`` bytes of a stream (or behind a split) are only counted; then
    frequent bytes count as predicted until the first cut. From there on no byte does, which makes the hash a filter
    over the last 31 bytes and its cut candidates independent of block starts."""

    def __init__(self, max_size: int) -> None:
        self.least, self.most, self.limit = min(max(max_size // 32, 512), 65535), max_size, max_hash(max_size)
        self.split()

    def split(self) -> None:
        self.count, self.counted, self.hash, self.size, self.first = [0] * 256, 0, 0, 0, True
        self.tail = b""

    def close(self) -> list[int]:
        return []

    def dump(self) -> tuple[dict, bytes]:
        names = {k: int(getattr(self, k)) for k in ("counted", "hash", "size", "first")}
        return names, np.array(self.count, np.uint32).tobytes() + self.tail

    def load(self, settings: dict, table: bytes) -> None:
        self.counted, self.hash, self.size, self.first = (settings[k] for k in ("counted", "hash", "size", "first"))
        self.count, self.tail = np.frombuffer(table, np.uint32, 256).tolist(), table[1024:]

    def ends(self, data: bytes) -> list[int]:
        out, at = [], 0
        if self.first:
            at = self._first_block(data)
            if self.first:
                return out
            out.append(at)
        # the hash at a byte needs the 30 before it, and no block is that short
        line = np.frombuffer(self.tail + data[at:], np.uint8).astype(np.uint32) + np.uint32(1)
        carried = len(self.tail)
        h, power = np.zeros(len(line), np.uint32), MISS
        for j in range(min(31, len(line))):
            h[j:] += line[: len(line) - j] * np.uint32(power)
            power = power * MISS & WRAP
        hits = np.flatnonzero(h[carried:] < self.limit) + at + 1
        start, n = at - self.size, len(data)
        while True:
            low = start + self.least
            k = np.searchsorted(hits, low)
            end = min(int(hits[k]) if k < len(hits) else n + self.most, start + self.most)
            if end > n:
                break
            out.append(end)
            start = end
        self.size = n - start
        self.tail = (self.tail + data[at:])[-min(30, self.size) :] if self.size else b""
        return out

    def _first_block(self, data: bytes) -> int:
        h, size, at = self.hash, self.size, 0
        while at < len(data) and self.counted < self.least:
            self.count[data[at]] += 1
            self.counted += 1
            size += 1
            at += 1
            if size >= self.most:
                return self._cut(at)
        often = self.least // 255
        while at < len(data):
            c = data[at]
            h = (h + c + 1) * (HIT if self.count[c] >= often else MISS) & WRAP
            size += 1
            at += 1
            if size >= self.least and h < self.limit or size >= self.most:
                return self._cut(at)
        self.hash, self.size = h, size
        return at

    def _cut(self, at: int) -> int:
        self.first, self.hash, self.size = False, 0, 0
        return at


class FixedChunker:
    """Blocks of equal size."""

    def __init__(self, max_size: int) -> None:
        self.most, self.size = max_size, 0

    def split(self) -> None:
        self.size = 0

    def close(self) -> list[int]:
        return []

    def dump(self) -> tuple[dict, bytes]:
        return {"size": self.size}, b""

    def load(self, settings: dict, table: bytes) -> None:
        self.size = settings["size"]

    def ends(self, data: bytes) -> list[int]:
        out = list(range(self.most - self.size, len(data) + 1, self.most))
        self.size = (self.size + len(data)) % self.most
        return out


class SignatureChunker:
    """Blocks also (``rolling``) or only end where a file signature starts, and at the greatest size. The last bytes
    that came wait until the bytes behind them tell whether a signature starts there."""

    WAIT = 7  # bytes of a signature that count

    def __init__(self, max_size: int, signatures: list[bytes], rolling: bool) -> None:
        if any(len(s) < 2 for s in signatures) or not signatures:
            raise OptionError("signatures have two bytes at least")
        self.pattern = re.compile(b"(?=" + b"|".join(re.escape(s[: self.WAIT]) for s in sorted(signatures, key=len, reverse=True)) + b")", re.S)
        self.most, self.rolling = max_size, RollingChunker(max_size) if rolling else None
        self.waiting, self.size = b"", 0

    def split(self) -> None:
        self.waiting, self.size = b"", 0
        if self.rolling:
            self.rolling.split()

    def dump(self) -> tuple[dict, bytes]:
        settings, table = self.rolling.dump() if self.rolling else ({}, b"")
        return settings | {"open": self.size}, table + self.waiting

    def load(self, settings: dict, table: bytes) -> None:
        self.size = settings["open"]
        if self.rolling:
            self.rolling.load(settings, table[:256])
        self.waiting = table[256 if self.rolling else 0 :]

    def ends(self, data: bytes) -> list[int]:
        return self._decided(data, max(0, len(self.waiting) + len(data) - self.WAIT))

    def close(self) -> list[int]:
        at = len(self.waiting)
        return [end for end in self._decided(b"", at) if end < 0 or self.size == 0 and at]

    def _decided(self, data: bytes, upto: int) -> list[int]:
        """The ends up to this place of the waiting bytes and ``data``."""
        line, before = self.waiting + data, len(self.waiting)
        starts = [m.start() for m in self.pattern.finditer(line) if 0 < m.start() <= upto]
        self.waiting = line[upto:]
        if self.rolling:
            found = self.rolling.ends(line[:upto], frozenset(starts))
            self.size = self.rolling.size
        else:
            found, begin = [], -self.size
            for at in [*starts, upto]:
                found += (cut := list(range(begin + self.most, at + 1, self.most)))
                begin = cut[-1] if cut else begin
                if begin < at < len(line) and at in starts:
                    found.append(at)
                    begin = at
            self.size = upto - begin
        return [end - before for end in found]


#: Starts of common file types, as public registries of file formats list them (fixed values); 7 bytes of each count.
SIGNATURES = [
    b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff", b"GIF87a", b"GIF89a", b"%PDF-", b"PK\x03\x04", b"\x1f\x8b\x08", b"BZh",
    b"\xfd7zXZ\x00", b"7z\xbc\xaf\x27\x1c", b"Rar!\x1a\x07", b"RIFF", b"OggS", b"fLaC", b"ID3", b"\x7fELF",
    b"\xca\xfe\xba\xbe", b"SQLite format 3\x00", b"\x28\xb5\x2f\xfd", b"wOFF", b"II*\x00", b"MM\x00*", b"8BPS",
    b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", b"{\\rtf1", b"!<arch>\n", b"\xed\xab\xee\xdb", b"MSCF", b"FLV\x01",
    b"\x00\x00\x01\xba", b"\x00\x00\x01\xb3", b"\x1aE\xdf\xa3", b"MThd", b"wOF2", b"<?xml ", b"\x04\x22\x4d\x18",
]


def chunker(mode: str, max_size: int, signatures: list[bytes] | None = None):
    """A fresh chunker."""
    if mode == "fixed":
        return FixedChunker(max_size)
    if mode == "dynamic":
        return RollingChunker(max_size)
    if mode == "entropy":
        return EntropyChunker(max_size)
    return SignatureChunker(max_size, signatures or SIGNATURES, mode == "signature")


def chunk(df: DataFrame, mode: str = "fixed", max_size: int = 4096, signatures: list[bytes] | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    check_size(mode, max_size)
    by_seq = "seq" in df.columns
    rows = df.select("stream_id", *(["seq"] if by_seq else []), F.col("payload").cast("binary").alias("payload"), *carry).where("octet_length(payload) > 0")
    if mode == "fixed":
        return _fixed(rows, max_size, by_seq, carry)
    kept = [f for f in rows.schema if f.name in carry]
    shape = "stream_id long, idx long, payload binary, size int, closed boolean" + "".join(f", {f.name} {f.dataType.simpleString()}" for f in kept)

    def cut(payloads):
        engine, out, idx = chunker(mode, max_size, signatures), [], 0
        for data in payloads:
            begin = 0
            for end in [*engine.ends(data), *(len(data) + e for e in engine.close())]:
                out.append((idx, data[begin:end], True))
                begin, idx = end, idx + 1
            if begin < len(data):
                out.append((idx, data[begin:], False))
                idx += 1
            engine.split()
        return out

    def per_row(batches):
        for b in batches:
            if not b.num_rows:
                continue
            line, bounds = _flat(b.column(1))
            if mode == "dynamic":
                ends = rolling_ends(line, bounds, max_size)
            else:
                ends = []
                for begin, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    engine = chunker(mode, max_size, signatures)
                    ends.append(np.array([*engine.ends(line[begin:end].tobytes()), *(end - begin + e for e in engine.close())], np.int64))
            yield _slices(b, bounds, ends)

    def per_stream(table):
        order = np.argsort(table.column("seq").to_numpy(), kind="stable")
        payloads = table.column("payload").to_pylist()
        return pa.table(_blocks(table.column("stream_id")[0].as_py(), cut([payloads[i] for i in order.tolist()])))

    if by_seq:
        return rows.drop(*carry).groupBy("stream_id").applyInArrow(per_stream, shape.partition("closed boolean")[0] + "closed boolean")
    # cutting costs far more than moving bytes, and the scan's splits may be few: streams are dealt evenly first
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, "stream_id").mapInArrow(per_row, shape)


def _flat(payloads: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column without nulls, and where its cells begin and end in them."""
    payloads = payloads.cast(pa.binary())
    _, offsets, data = payloads.buffers()
    bounds = np.frombuffer(offsets, np.int32, len(payloads) + 1, payloads.offset * 4).astype(np.int64)
    return np.frombuffer(data, np.uint8), bounds


def _slices(batch: pa.RecordBatch, bounds: np.ndarray, ends: list[np.ndarray]) -> pa.RecordBatch:
    """One row per block. Blocks lie in the order of their streams, so they share the bytes that came."""
    rest = [not len(e) or int(e[-1]) < n for e, n in zip(ends, np.diff(bounds).tolist())]
    counts = np.array([len(e) + r for e, r in zip(ends, rest)], np.int64)
    row = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    stops = np.concatenate([bounds[:1], *(np.append(e + a, z) if r else e + a for e, a, z, r in zip(ends, bounds[:-1], bounds[1:], rest))])
    closed = np.ones(len(row), bool)
    closed[(first + counts - 1)[rest]] = False
    data = batch.column(1).cast(pa.binary()).buffers()[2]
    payload = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(stops.astype(np.int32).tobytes()), data])
    more = [c.take(pa.array(row)) for c in batch.columns[2:]]
    columns = [batch.column(0).take(pa.array(row)), pa.array(np.arange(len(row)) - first[row]), payload, pa.array(np.diff(stops).astype(np.int32)), pa.array(closed), *more]
    return pa.RecordBatch.from_arrays(columns, ["stream_id", "idx", "payload", "size", "closed", *batch.schema.names[2:]])


def _blocks(stream_id, blocks) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([stream_id] * len(blocks), pa.int64()), pa.array([b[0] for b in blocks], pa.int64()), pa.array([b[1] for b in blocks], pa.binary()), pa.array([len(b[1]) for b in blocks], pa.int32()), pa.array([b[2] for b in blocks], pa.bool_())], ["stream_id", "idx", "payload", "size", "closed"])


def _fixed(rows: DataFrame, max_size: int, by_seq: bool, carry: tuple[str, ...]) -> DataFrame:
    """All in Catalyst: positions are generated and the payload is sliced."""
    d = rows.withColumn("i", F.explode(F.expr(f"sequence(0L, (octet_length(payload) - 1) div {max_size})")))
    d = d.withColumn("payload", F.expr(f"substring(payload, cast(i * {max_size} + 1 as int), {max_size})")).withColumn("size", F.octet_length("payload"))
    idx = (F.row_number().over(Window.partitionBy("stream_id").orderBy("seq", "i")) - 1).cast("long") if by_seq else F.col("i")
    return d.select("stream_id", idx.alias("idx"), "payload", "size", (F.col("size") == max_size).alias("closed"), *carry)
