"""Sorting and order checks of integer sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .matching import with_bucket


def sort(values: DataFrame, column: str = "v", ascending: bool = True, tie: str | None = None) -> DataFrame:
    """(rank, ...) with rank from 0 in sorted order. ``tie`` (a position) makes the order stable. Rows are ranked
    within value ranges and shifted by the number of rows in the ranges before: no single-task sort."""
    d = with_bucket(values, column)
    counts = {r.bucket: r["count"] for r in d.groupBy("bucket").count().collect()}
    order = sorted(counts, reverse=not ascending)
    shift, ahead = {}, 0
    for b in order:
        shift[b] = ahead
        ahead += counts[b]
    by = F.asc(column) if ascending else F.desc(column)
    own = F.row_number().over(Window.partitionBy("bucket").orderBy(by, *([F.asc(tie)] if tie else [])))
    offset = F.element_at(F.create_map(*[F.lit(x) for kv in shift.items() for x in kv]), F.col("bucket")) if shift else F.lit(0)
    return d.withColumn("rank", (offset + own - 1).cast("long")).drop("bucket")


def is_sorted(values: DataFrame, position: str = "pos", column: str = "v", ascending: bool = True) -> DataFrame:
    """One row, ``is_sorted``: neighbours are compared within ranges of positions, then the ranges' ends."""
    d = with_bucket(values, position)
    before = F.lag(column).over(Window.partitionBy("bucket").orderBy(position))
    fine = (F.col(column) >= F.col("before")) if ascending else (F.col(column) <= F.col("before"))
    part = d.withColumn("before", before).groupBy("bucket").agg(F.bool_and(F.coalesce(fine, F.lit(True))).alias("ok"), F.min_by(column, position).alias("first"), F.max_by(column, position).alias("last"))
    ends = part.withColumn("before", F.lag("last").over(Window.partitionBy(F.lit(0)).orderBy("bucket")))  # a row a range
    fine = (F.col("first") >= F.col("before")) if ascending else (F.col("first") <= F.col("before"))
    return ends.agg(F.coalesce(F.bool_and(F.col("ok") & F.coalesce(fine, F.lit(True))), F.lit(True)).alias("is_sorted"))
