"""Encoders and decoders of the two back-reference formats.

Indexed: ``uv(1) uv(max)``, then per block ``uv(0) uv(max - size)`` (new; the payload goes to the data) or
``uv(offset)``; at the end ``uv(2^64-1) uv(max - tail) uv(0)`` and the tail's bytes in the data.
Interleaved: ``uv(2) uv(max) uv(bound)``, the same entries with payloads in place, and ``uv(2^64-1) uv(max - tail) tail uv(0)``.

Cutting, hashing and matching are DataFrame operators; only the writing of bytes per stream and the parsing of an
index run in Python. The unfinished last block of a stream (its tail) is never matched.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import varint
from ..operators.chunking import chunk
from ..operators.matching import block_hash, match_within
from ..options import MIN_BLOCK_SIZE, CorruptStream, MaxMemoryTooSmall, SizeTooSmall, UnknownFormat, max_blocks

INDEXED, INTERLEAVED = 1, 2
ENTRIES = "stream_id long, n long, kind string, phys_id long, back_offset long, size int, data_offset long"


def entries(streams: DataFrame, mode: str, max_size: int, max_memory: int = 0, interleaved: bool = False) -> DataFrame:
    """(stream_id, n from 1, kind new|dup|end, back_offset, size, payload of new and end entries)."""
    bound = max_blocks(mode, max_size, max_memory, interleaved)
    cut = chunk(streams, mode, max_size).withColumn("n", F.col("idx") + 1)
    whole = cut.where("closed").withColumn("hash", block_hash(F.col("payload")))
    policy = "distance" if interleaved else "evicting" if bound else "unbounded"
    blocks = match_within(whole, bound, policy).select("stream_id", "n", F.when(F.col("is_new"), "new").otherwise("dup").alias("kind"), "back_offset", "size", F.when(F.col("is_new"), F.col("payload")).alias("payload"))
    tails = cut.where("not closed").select("stream_id", "n", "size", "payload")
    ends = streams.select("stream_id").distinct().join(tails, "stream_id", "left")
    count = whole.groupBy("stream_id").agg(F.max("n").alias("m"))
    ends = ends.join(count, "stream_id", "left").select("stream_id", F.coalesce("n", F.col("m") + 1, F.lit(1)).alias("n"), F.lit("end").alias("kind"), F.lit(None).cast("long").alias("back_offset"), F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("payload", F.lit(b"")).alias("payload"))
    return blocks.unionByName(ends)


def encode_indexed(streams: DataFrame, mode: str = "fixed", max_size: int = 4096, max_memory: int = 0) -> DataFrame:
    """(stream_id, index, data) of every stream."""
    head = varint.encode(INDEXED) + varint.encode(max_size)

    def write(table):
        index, data = bytearray(head), bytearray()
        for kind, off, size, payload in _ordered(table):
            index += entry(kind, off, max_size - size)
            data += payload or b""
            if kind == "end":
                index += varint.encode(0)
        return pa.table({"stream_id": table.column("stream_id").slice(0, 1), "index": pa.array([bytes(index)], pa.binary()), "data": pa.array([bytes(data)], pa.binary())})

    return entries(streams, mode, max_size, max_memory).groupBy("stream_id").applyInArrow(write, "stream_id long, index binary, data binary")


def encode_interleaved(streams: DataFrame, mode: str = "fixed", max_size: int = 4096, max_memory: int = 1 << 20) -> DataFrame:
    """(stream_id, data) of every stream."""
    head = varint.encode(INTERLEAVED) + varint.encode(max_size) + varint.encode(max_blocks(mode, max_size, max_memory, True))

    def write(table):
        data = bytearray(head)
        for kind, off, size, payload in _ordered(table):
            data += entry(kind, off, max_size - size) + (payload or b"")
            if kind == "end":
                data += varint.encode(0)
        return pa.table({"stream_id": table.column("stream_id").slice(0, 1), "data": pa.array([bytes(data)], pa.binary())})

    return entries(streams, mode, max_size, max_memory, True).groupBy("stream_id").applyInArrow(write, "stream_id long, data binary")


def _ordered(table):
    return zip(*(table.sort_by("n").column(c).to_pylist() for c in ("kind", "back_offset", "size", "payload")))


def entry(kind: str, off: int | None, short: int) -> bytes:
    """The bytes of an index entry."""
    if kind == "dup":
        return varint.encode(off)
    return varint.encode(0 if kind == "new" else varint.END_MARK) + varint.encode(short)


def parse_index(index: bytes, interleaved: bool = False) -> list[tuple]:
    """(n, kind, phys_id, back_offset, size, data_offset) of every entry; offsets are into the data, which for the
    interleaved format is the stream itself. Breaks of a format rule raise ``CorruptStream``."""
    kind, at = varint.decode(index, 0)
    if kind != (INTERLEAVED if interleaved else INDEXED):
        raise UnknownFormat(f"format {kind}")
    most, at = varint.decode(index, at)
    bound = None
    if interleaved:
        bound, at = varint.decode(index, at)
        if most < MIN_BLOCK_SIZE:
            raise SizeTooSmall(f"block size {most}")
        if bound < 1:
            raise MaxMemoryTooSmall(f"bound of {bound} blocks")
    out, data = [], 0
    while True:
        n = len(out) + 1
        value, at = varint.decode(index, at)
        if value in (0, varint.END_MARK):
            short, at = varint.decode(index, at)
            if short > most or interleaved and value == 0 and short == most:
                raise CorruptStream(f"block {n}: bad size")
            size, start = most - short, at if interleaved else data
            if interleaved:
                at += size
                if at > len(index):
                    raise CorruptStream(f"block {n}: truncated data")
            data += size
            if value:
                more, at = varint.decode(index, at)
                if more:
                    raise CorruptStream("continuations are not supported")
                out.append((n, "end", n, None, size, start))
                return out
            out.append((n, "new", n, None, size, start))
        else:
            if value >= n or bound is not None and value > bound:
                raise CorruptStream(f"block {n}: bad offset {value}")
            target = out[n - 1 - value]
            out.append((n, "dup", target[2], value, target[4], target[5]))


def read_index(encoded: DataFrame, interleaved: bool = False) -> DataFrame:
    """Entries of every stream; duplicates carry the physical block they resolve to."""
    column = "data" if interleaved else "index"

    def run(batches):
        for b in batches:
            for stream, raw in zip(*(c.to_pylist() for c in b.columns)):
                cols = list(zip(*parse_index(raw, interleaved)))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([stream] * len(cols[0]), pa.int64()), *(pa.array(c, t) for c, t in zip(cols, kinds))], ["stream_id", "n", "kind", "phys_id", "back_offset", "size", "data_offset"])

    return encoded.select("stream_id", column).mapInArrow(run, ENTRIES)


def restore_by_join(encoded: DataFrame) -> DataFrame:
    """(stream_id, n, payload): physical blocks are sliced once, and every entry joins the one it resolves to."""
    index = read_index(encoded)
    phys = index.where("kind <> 'dup'").join(encoded.select("stream_id", "data"), "stream_id")
    phys = phys.select("stream_id", "phys_id", _slice("data"))
    return index.select("stream_id", "n", "phys_id").join(phys, ["stream_id", "phys_id"]).select("stream_id", "n", "payload")


def restore_by_range(encoded: DataFrame, interleaved: bool = False) -> DataFrame:
    """(stream_id, n, payload): every entry reads its own range, repeated blocks again."""
    return read_index(encoded, interleaved).join(encoded.select("stream_id", "data"), "stream_id").select("stream_id", "n", _slice("data"))


def _slice(data: str):
    checked = f"substring({data}, cast(data_offset + 1 as int), size)"
    return F.expr(f"if(octet_length({checked}) = size, {checked}, cast(raise_error('truncated data') as binary))").alias("payload")


def reassemble(blocks: DataFrame) -> DataFrame:
    """(stream_id, payload) of blocks in order of n."""
    return blocks.groupBy("stream_id").agg(F.expr("listagg(payload) within group (order by n)").alias("payload"))


def block_sizes(index: DataFrame) -> DataFrame:
    """(stream_id, n, size) of all blocks, with duplicates and the tail."""
    return index.select("stream_id", "n", "size")


def physical_spans(index: DataFrame) -> DataFrame:
    """(stream_id, phys_id, size, first_n, last_n) of every stored block but the tail."""
    return index.where("kind <> 'end'").groupBy("stream_id", "phys_id").agg(F.first("size").alias("size"), F.min("n").alias("first_n"), F.max("n").alias("last_n"))


def peak_memory(spans: DataFrame, width: int = 1 << 20) -> DataFrame:
    """(stream_id, peak_bytes): the most bytes that a decoder holds at once if it keeps each block from its first to
    its last use. Running sums stay within ranges of ``width`` numbers; what is held before a range is added to its
    peak, so a stream of any length is spread over tasks."""
    events = spans.select("stream_id", F.col("first_n").alias("n"), F.col("size").alias("add"), F.lit(0).alias("drop")).unionAll(spans.select("stream_id", F.col("last_n").alias("n"), F.lit(0).alias("add"), F.col("size").alias("drop")))
    per = events.withColumn("part", F.floor(F.col("n") / width)).groupBy("stream_id", "part", "n").agg(F.sum("add").alias("add"), F.sum("drop").alias("drop"))
    w = Window.partitionBy("stream_id", "part").orderBy("n")
    held = F.sum("add").over(w) - F.coalesce(F.sum("drop").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = per.withColumn("held", held).groupBy("stream_id", "part").agg(F.max("held").alias("held"), F.sum(F.col("add") - F.col("drop")).alias("net"))
    ahead = F.coalesce(F.sum("net").over(Window.partitionBy("stream_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    return parts.withColumn("held", F.col("held") + ahead).groupBy("stream_id").agg(F.max("held").cast("long").alias("peak_bytes"))
