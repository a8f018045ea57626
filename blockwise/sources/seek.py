"""A DataSource that restores an indexed archive (two files) by ranged reads, in parallel over its blocks.

Options: ``index`` and ``data`` (paths every executor can open), ``blocks`` (blocks a partition, default 1024). Rows
are (n, payload); the bytes are those of the stream from block n on. Repeated blocks are read again; nothing is cached.
"""

from __future__ import annotations

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Part(InputPartition):
    def __init__(self, blocks: list[tuple[int, int, int]]) -> None:
        self.blocks = blocks


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.index, self.data, self.step = options["index"], options["data"], int(options.get("blocks", 1024))

    def _open(self, path: str):
        from pyarrow import fs

        store, name = fs.FileSystem.from_uri(path)
        return store.open_input_file(name)

    def partitions(self) -> list[InputPartition]:
        from .codec import parse_index

        with self._open(self.index) as f:
            rows = [(n, at, size) for n, _, _, _, size, at in parse_index(f.read())]
        return [_Part(rows[i : i + self.step]) for i in range(0, len(rows), self.step)]

    def read(self, partition: _Part):
        from ..options import CorruptStream

        with self._open(self.data) as f:
            for n, at, size in partition.blocks:
                payload = f.read_at(size, at) if size else b""
                if len(payload) != size:
                    raise CorruptStream(f"block {n}: truncated data")
                yield n, payload


class SeekSource(DataSource):
    """``spark.dataSource.register(SeekSource)``, then ``spark.read.format("blockwise_seek")``."""

    @classmethod
    def name(cls) -> str:
        return "blockwise_seek"

    def schema(self) -> str:
        return "n long, payload binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)
