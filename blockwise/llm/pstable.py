"""Embedding near-duplicates by Euclidean p-stable hashing.

Normalised vectors are projected on Gaussian directions, shifted and quantised; ``k`` quantised projections are a
bucket of one table. Vectors that share a bucket of any table are compared exactly (cosine in double precision). A
pair is counted in the first table in which it meets. Buckets of more than ``TILE`` vectors are cut into tiles, and
pairs of tiles are compared apart: no cap, no pair rows, only per-vector counts and a spanning forest leave a tile.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing and stay their own
component; vectors of different lengths never meet. Equal vectors are compared once and count as often as they
occur. Rows without an id take no part: they come back without links and component, and are kept. Rows that share an id
are vectors of their own: each has its own links, and an id alone links nothing. Extra columns are ignored; an empty
table gives an empty one.

A vector travels once for each table in which it shares a bucket, as its single-precision numbers where these are
exact; it is normalised and its earlier buckets are computed again where it is compared.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import materialize, partitions
from .components import components, forest

TILE = 768
WIDTH = 1.0


def collision(distance: float, width: float = WIDTH) -> float:
    """Probability that two points at this distance share one quantised Gaussian projection."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - math.sqrt(2 / math.pi) / r * (1 - math.exp(-r * r / 2))


def tables_for(n: int, threshold: float, recall: float = 0.97) -> tuple[int, int]:
    """(projections a table, tables): unrelated vectors share a bucket with about 64 others, and a pair just at the
    threshold meets in some table with probability ``recall``; closer pairs do more surely."""
    far, near = collision(math.sqrt(2)), collision(math.sqrt(2 - 2 * threshold))
    k = max(5, math.ceil(math.log(max(n, 64) / 64) / -math.log(far)))
    return k, math.ceil(math.log(1 - recall) / math.log(1 - near**k))


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 11, recall: float = 0.97) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector."""
    spark = vectors.sparkSession
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<double>").alias("v"))
    good = rows.where(F.col("id").isNotNull() & F.coalesce((F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False)))
    keyed_by = lambda d: d.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), "v"))  # noqa: E731  128 bits name a vector
    classes = keyed_by(good).groupBy("h1", "h2").agg(F.min("id").alias("c"), F.count("*").alias("m"), F.first("v").alias("v"))
    classes = materialize(classes.withColumn("u", F.monotonically_increasing_id()), "vectors")  # u names a class
    k, tables = tables_for(classes.count(), threshold, recall)

    def hashed(batches):
        for b in batches:
            u, m = b.column("u").to_numpy(), b.column("m").to_numpy()
            lists = b.column("v")
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.values.to_numpy(zero_copy_only=False)[lists.offsets[0].as_py() :]
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else sizes
            for d in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == d)
                v = flat[starts[at][:, None] + np.arange(d)]
                signed = _keys(_unit(v), k, tables, seed).view(np.int64)
                packed = pa.array([_pack(x) for x in v], pa.binary())
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t, np.int32)), pa.array(signed[:, t]), pa.array(u[at]), pa.array(m[at]), packed], ["t", "key", "u", "m", "v"])

    keyed = classes.select("u", "m", "v").repartition(partitions(spark)).mapInArrow(hashed, "t int, key long, u long, m long, v binary")
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1").withColumn("tiles", F.ceil(F.col("n") / TILE).cast("int"))
    cells = keyed.join(sizes, ["t", "key"]).withColumn("tile", F.pmod(F.xxhash64("u"), F.col("tiles")).cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    cells = cells.withColumn("i", F.least("tile", "other")).withColumn("j", F.greatest("tile", "other"))

    def compare(key, table):
        t, own = key[0].as_py(), table.column("tile").to_numpy()
        i, j = key[2].as_py(), key[3].as_py()
        u, m = table.column("u").to_numpy(), table.column("m").to_numpy()
        raw = [_unpack(x) for x in table.column("v").to_pylist()]
        d = max(map(len, raw))
        links, ea, eb = np.zeros(len(u), np.int64), [], []
        if min(map(len, raw)) == d:  # a bucket holds vectors of one length, but for a clash of keys
            v = _unit(np.array(raw))
            sig = _keys(v, k, tables, seed)[:, :t]
            left, right = (np.flatnonzero(own == x) for x in (i, j))
            for at in range(0, len(left), 256):
                block = left[at : at + 256]
                close = v[block] @ v[right].T >= threshold
                if i == j:
                    close &= block[:, None] < right[None, :]
                x, y = np.nonzero(close)
                x, y = block[x], right[y]
                if t:
                    fresh = ~(sig[x] == sig[y]).any(axis=1)
                    x, y = x[fresh], y[fresh]
                np.add.at(links, x, m[y])
                np.add.at(links, y, m[x])
                if len(x):
                    p, q = forest(u[x], u[y])
                    ea.append(p)
                    eb.append(q)
        p, q = forest(np.concatenate(ea), np.concatenate(eb)) if ea else (np.zeros(0, np.int64),) * 2
        hit = np.flatnonzero(links)
        return pa.table({"u": pa.array(np.concatenate([u[hit], p])), "links": pa.array(np.concatenate([links[hit], np.zeros(len(p), np.int64)])), "root": pa.array([None] * len(hit) + q.tolist(), pa.int64())})

    found = materialize(cells.groupBy("t", "key", "i", "j").applyInArrow(compare, "u long, links long, root long"), "links")
    groups = components(found.where("root is not null").select(F.col("u").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "u")
    counts = found.where("links > 0").groupBy("u").agg(F.sum("links").alias("links"))
    classed = classes.select("h1", "h2", "c", "m", "u").join(counts, "u", "left").join(groups, "u", "left").withColumn("component", F.coalesce("component", "u"))
    least = classed.groupBy("component").agg(F.min("c").alias("least"))
    per_class = classed.join(least, "component").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.col("least").alias("component_id"))
    salted = per_class.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # copies of one vector may be a third of all rows
    out = keyed_by(rows).drop("v").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, ["h1", "h2", "salt"], "left")
    known = F.col("id").isNotNull()
    out = out.select(F.col("id").alias("vec_id"), F.when(known, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), F.when(known, F.coalesce("component_id", "id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # keeps squares finite and nonzero
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _keys(unit: np.ndarray, k: int, tables: int, seed: int) -> np.ndarray:
    """The bucket of each normalised vector in each table."""
    a, shift = _planes(unit.shape[1], k * tables, seed)
    q = np.floor((unit @ a + shift) / WIDTH).astype(np.int64).reshape(len(unit), tables, k)
    keys = np.full((len(unit), tables), unit.shape[1], np.uint64)
    for j in range(k):
        keys = (keys ^ q[:, :, j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys


@lru_cache(maxsize=8)
def _planes(d: int, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rnd = np.random.default_rng(seed + d)
    return rnd.standard_normal((d, n)), rnd.uniform(0, WIDTH, n)


def _pack(v: np.ndarray) -> bytes:
    """Single precision where that loses nothing; the first byte tells."""
    with np.errstate(over="ignore"):
        small = v.astype(np.float32)
    return b"s" + small.tobytes() if np.array_equal(small.astype(np.float64), v) else b"d" + v.tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.float32 if blob[:1] == b"s" else np.float64, offset=1).astype(np.float64)


SALTS = 8
