"""Hashing, numbering and matching of blocks.

Numbering and matching never bring one key's rows, or all rows, to a single task: rows are cut at quantiles of the
stream id into buckets of known offsets, and what a bucket needs of earlier ones is a small table."""

from __future__ import annotations

from collections import OrderedDict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..options import HASHES, OptionError
from ..storage import materialize


def block_hash(payload: Column, algorithm: str = "sha1") -> Column:
    """Lower-case hex."""
    if algorithm not in HASHES:
        raise OptionError(f"{algorithm!r} is none of {', '.join(HASHES)}")
    return {"sha1": F.sha1, "md5": F.md5}.get(algorithm, lambda c: F.sha2(c, int(algorithm[3:])))(payload)


def with_bucket(df: DataFrame, by: str = "stream_id", buckets: int = 64) -> DataFrame:
    """Adds ``bucket``: rows ordered by ``by`` have ascending buckets. The cuts are literals, so every use agrees."""
    found = df.select(by).distinct().agg(F.percentile_approx(by, [i / buckets for i in range(1, buckets)], 20 * buckets)).first()[0] or []
    cuts = sorted(set(found))
    if not cuts:
        return df.withColumn("bucket", F.lit(0))
    return df.withColumn("bucket", F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(by))))


def number(blocks: DataFrame, base: int = 1, buckets: int | None = None) -> DataFrame:
    """Adds ``n``: the position in (stream_id, idx) order over the whole table, and ``bucket``, of which there are as
    many as keep 2,000,000 rows in one, 64 at least and 10,000 at most. Rows are read several times, so a costly plan
    belongs in a written table first."""
    if buckets is None:
        buckets = min(10_000, max(64, blocks.count() // 2_000_000))
    d = with_bucket(blocks, "stream_id", buckets)
    counts = {r.bucket: r["count"] for r in d.groupBy("bucket").count().collect()}  # at most ``buckets`` rows
    offsets, ahead = [], base
    for b in range(max(counts, default=0) + 1):
        offsets.append(F.lit(ahead).cast("long"))
        ahead += counts.get(b, 0)
    own = F.row_number().over(Window.partitionBy("bucket").orderBy("stream_id", "idx")) - 1
    return d.withColumn("n", F.element_at(F.array(*offsets), F.col("bucket") + 1) + own)


def match(numbered: DataFrame, bound: int | None = None, policy: str = "unbounded") -> DataFrame:
    """Adds ``back_offset`` (null for new blocks) and ``is_new`` to rows with ``hash``, ``n`` and ``bucket``.

    unbounded: the latest earlier block of equal hash. distance: the same, but new beyond ``bound`` blocks.
    evicting: an index of ``bound`` hashes that drops its least recently used quarter when it overflows."""
    if policy == "evicting":
        return _evicting(numbered.withColumn("scope", F.lit(0)), bound, ["scope"]).drop("scope")
    inside = Window.partitionBy("hash", "bucket").orderBy("n")
    last = numbered.groupBy("hash", "bucket").agg(F.max("n").alias("last"))
    before = last.withColumn("before", F.lag("last").over(Window.partitionBy("hash").orderBy("bucket"))).where("before is not null").drop("last")
    d = numbered.withColumn("near", F.lag("n").over(inside)).join(before, ["hash", "bucket"], "left")
    d = d.withColumn("back_offset", F.col("n") - F.coalesce("near", "before")).drop("near", "before")
    if policy == "distance":
        d = d.withColumn("back_offset", F.when(F.col("back_offset") <= bound, F.col("back_offset")))
    elif policy != "unbounded":
        raise OptionError(f"unknown policy {policy!r}")
    return d.withColumn("is_new", F.col("back_offset").isNull())


def match_within(blocks: DataFrame, bound: int = 0, policy: str = "unbounded", scope: str = "stream_id") -> DataFrame:
    """``match`` with every ``scope`` on its own; rows have ``hash`` and ``n``."""
    if policy == "evicting" and bound:
        return _evicting(blocks, bound, [scope])
    d = blocks.withColumn("back_offset", F.col("n") - F.lag("n").over(Window.partitionBy(scope, "hash").orderBy("n")))
    if policy == "distance":
        d = d.withColumn("back_offset", F.when(F.col("back_offset") <= bound, F.col("back_offset")))
    return d.withColumn("is_new", F.col("back_offset").isNull())


class EvictingIndex:
    """hash -> latest number, at most ``bound`` of them once a block is done."""

    def __init__(self, bound: int) -> None:
        if bound < 4:
            raise OptionError("the bound must be 4 blocks at least")
        self.bound, self.seen = bound, OrderedDict()

    def back_offset(self, h: str, n: int) -> int | None:
        before = self.seen.pop(h, None)
        self.seen[h] = n
        if len(self.seen) > self.bound:
            for _ in range(self.bound // 4):
                self.seen.popitem(last=False)
        return None if before is None else n - before


def _evicting(blocks: DataFrame, bound: int, scope: list[str]) -> DataFrame:
    """Only (n, hash) enter the sequential part; other columns are joined again by n. A task streams its scopes one after
    the other in order of n and holds nothing but the index, so its memory has the bound however long a scope is."""

    def run(batches):
        at, index = None, None
        for b in batches:
            scopes, n, offs = list(zip(*(b.column(c).to_pylist() for c in scope))), b.column("n").to_pylist(), []
            for s, i, h in zip(scopes, n, b.column("hash").to_pylist()):
                if index is None or s != at:
                    at, index = s, EvictingIndex(bound)
                offs.append(index.back_offset(h, i))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in scope), b.column("n"), pa.array(offs, pa.int64())], [*scope, "n", "back_offset"])

    kinds = ", ".join(f"{c} {blocks.schema[c].dataType.simpleString()}" for c in scope)
    dealt = blocks.select(*scope, "n", "hash").repartition(*scope).sortWithinPartitions(*scope, "n")
    found = dealt.mapInArrow(run, f"{kinds}, n long, back_offset long")
    return blocks.join(found, [*scope, "n"]).withColumn("is_new", F.col("back_offset").isNull())


def fragments(streams: DataFrame, mode: str = "fixed", max_size: int = 4096, algorithm: str = "sha1", payloads: bool = False, signatures: list[bytes] | None = None) -> DataFrame:
    """Splitter: (stream_id, n from 0, hash, size, is_new), with ``payloads`` the bytes too, over one corpus-wide order;
    every block, also the last of a stream, is a fragment. Streams are cut once: what numbering and matching read is
    the written table of the blocks' hashes."""
    from .chunking import chunk

    blocks = chunk(streams, mode, max_size, signatures).withColumn("hash", block_hash(F.col("payload"), algorithm))
    blocks = materialize(blocks.select("stream_id", "idx", "hash", "size", *(["payload"] if payloads else [])), "blocks")
    found = match(number(blocks.select("stream_id", "idx", "hash", "size"), base=0))
    if payloads:
        found = found.join(blocks.select("stream_id", "idx", "payload"), ["stream_id", "idx"])
    return found.select("stream_id", "n", "hash", "size", "is_new", *(["payload"] if payloads else []))


def unique_blocks(blocks: DataFrame) -> DataFrame:
    """One row per distinct hash."""
    return blocks.dropDuplicates(["hash"])


def overlap(left: DataFrame, right: DataFrame, present: bool = True) -> DataFrame:
    """Blocks of ``left`` whose hash occurs (or does not occur) in ``right``."""
    return left.join(right.select("hash").distinct(), "hash", "left_semi" if present else "left_anti")
