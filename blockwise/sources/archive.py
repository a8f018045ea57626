"""Indexed archives as files: a sink that streams blocks to disk, and a reader with ranged reads.

``write`` packs many streams into one pair of files a task, so neither many small streams make many small files nor
has an encoded stream to fit into a cell: the writing task holds an Arrow batch of blocks. Input rows are cells still,
and payloads pass the matching of ``entries``. The manifest tells where the index and the
data of each stream lie: (stream_id, part, index_offset, index_bytes, data_offset, data_bytes); the files of a part are
``<part>.index`` and ``<part>.data``. A part is named after the attempt that wrote it, and only attempts that ended well
are in the manifest: lost executors leave files behind that nothing names. Null and empty streams have an index and
no data. A stream's bytes in both files are those of ``codec.encode_indexed``.

``read`` parses indexes on executors, one stream's index at a time, and deals the ranges of blocks over tasks.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import varint
from ..options import CorruptStream
from .codec import INDEXED, entries, entry, parse_index

MANIFEST = "stream_id long, part string, index_offset long, index_bytes long, data_offset long, data_bytes long"
BLOCKS = 1024  # blocks of a stream that one range of reads takes


def _open(path: str, write: bool = False):
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    if not write:
        return store.open_input_file(name)
    store.create_dir(name.rpartition("/")[0], recursive=True)
    return store.open_output_stream(name)


def write(streams: DataFrame, path: str, mode: str = "fixed", max_size: int = 4096, max_memory: int = 0) -> DataFrame:
    """Archives of all streams below ``path``, a folder that all executors reach; returns the manifest, which is
    written there too."""
    head = varint.encode(INDEXED) + varint.encode(max_size)

    def run(batches):
        part, files, row, index_at, data_at = None, (), None, 0, 0
        try:
            for b in batches:
                done = []
                for stream, kind, off, size, payload in zip(*(b.column(c).to_pylist() for c in ("stream_id", "kind", "back_offset", "size", "payload"))):
                    if part is None:
                        part = f"part-{uuid.uuid4().hex}"
                        files = _open(f"{path}/{part}.index", True), _open(f"{path}/{part}.data", True)
                    if row is None:
                        row = [stream, part, index_at, 0, data_at, 0]
                        index_at += files[0].write(head)
                    index_at += files[0].write(entry(kind, off, max_size - size))
                    if payload:
                        data_at += files[1].write(payload)
                    if kind == "end":
                        index_at += files[0].write(varint.encode(0))
                        row[3], row[5] = index_at - row[2], data_at - row[4]
                        done.append(row)
                        row = None
                if done:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), _TYPES)], _NAMES)
        finally:
            for f in files:
                f.close()

    found = entries(streams, mode, max_size, max_memory).repartition("stream_id").sortWithinPartitions("stream_id", "n").mapInArrow(run, MANIFEST)
    found.write.parquet(f"{path}/manifest")
    return manifest(streams.sparkSession, path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


_NAMES = [c.split()[0] for c in MANIFEST.split(", ")]
_TYPES = [pa.string() if c.endswith("string") else pa.int64() for c in MANIFEST.split(", ")]


def read_index(archives: DataFrame, path: str) -> DataFrame:
    """(stream_id, n, kind, phys_id, size, part, at) of every block; ``at`` counts from the start of the part's data."""

    def run(batches):
        for b in batches:
            for stream, part, begin, length, data in zip(*(b.column(c).to_pylist() for c in _NAMES[:5])):
                with _open(f"{path}/{part}.index") as f:
                    found = parse_index(f.read_at(length, begin))
                for a in range(0, len(found), 65536):
                    n, kind, phys, _, size, at = zip(*found[a : a + 65536])
                    cells = (pa.array([stream] * len(n), pa.int64()), pa.array(n, pa.int64()), pa.array(kind), pa.array(phys, pa.int64()), pa.array(size, pa.int32()))
                    yield pa.RecordBatch.from_arrays([*cells, pa.array([part] * len(n)), pa.array([data + x for x in at], pa.int64())], ["stream_id", "n", "kind", "phys_id", "size", "part", "at"])

    return archives.select(*_NAMES[:5]).mapInArrow(run, "stream_id long, n long, kind string, phys_id long, size int, part string, at long")


def read(archives: DataFrame, path: str, first: int = 1, last: int | None = None) -> DataFrame:
    """(stream_id, n, payload) of the streams in these rows of a manifest, from block ``first`` to block ``last``. Only
    the ranges of those blocks are read, repeated blocks again."""

    def run(batches):
        name, f = None, None
        try:
            for b in batches:
                out = []
                for part, at, size, n in zip(*(b.column(c).to_pylist() for c in ("part", "at", "size", "n"))):
                    if part != name:
                        if f:
                            f.close()
                        name, f = part, _open(f"{path}/{part}.data")
                    out.append(f.read_at(size, at) if size else b"")
                    if len(out[-1]) != size:
                        raise CorruptStream(f"block {n}: truncated data")
                yield pa.RecordBatch.from_arrays([b.column("stream_id"), b.column("n"), pa.array(out, pa.binary())], ["stream_id", "n", "payload"])
        finally:
            if f:
                f.close()

    wanted = read_index(archives, path).where(F.col("n") >= first)
    if last is not None:
        wanted = wanted.where(F.col("n") <= last)
    dealt = wanted.repartition("stream_id", F.floor(F.col("n") / BLOCKS)).sortWithinPartitions("part", "at")
    return dealt.mapInArrow(run, "stream_id long, n long, payload binary")
