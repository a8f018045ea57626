"""Connected components of an edge table, by alternating large-star and small-star rounds.

Edges are first thinned to a spanning forest inside each Arrow batch, so that a hub of many edges is a star of one
row per member before it is shuffled. Every round is written to the shared folder, which cuts lineage. No edge, label
or component goes to the driver but counts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import materialize


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, smallest member) of each component of the given edges, the smallest itself left out."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while not np.array_equal(jump := new[new], new):
            new = jump
        if np.array_equal(new, label):
            break
        label = new
    far = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[far], nodes[label[far]]


def _thin(batches):
    for b in batches:
        t, s = forest(b.column(0).to_numpy(), b.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(t, pa.int64()), pa.array(s, pa.int64())], ["a", "b"])


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(id, component) of every id that an edge (a, b) of longs names; component is the smallest reachable id."""
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    thin = lambda e: e.where("a != b").select("a", "b").mapInArrow(_thin, "a long, b long")
    edges = materialize(thin(edges).distinct(), "edges")
    before = None
    for _ in range(rounds):
        near = both(edges)
        low = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = near.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        root = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(root, "a").select("b", "m").union(root.select(F.col("a").alias("b"), "m"))
        small = small.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        edges = materialize(small, "stars")
        after = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(after) == before:
            break
        before = tuple(after)
    else:
        raise RuntimeError(f"components still change after {rounds} rounds")
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)
