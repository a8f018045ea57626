"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, a local session (tests) gets a temporary folder; on a cluster
    executors would write to their own disks, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = _OWN.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="blockwise-"))
    return found.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back: lineage is cut, and lost executors cost
    only the tasks that ran on them. Shuffle files of the writing go with its end. ``discard`` removes the table."""
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/blockwise/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before else spark.conf.unset(_CLEANUP)
    table = spark.read.schema(schema).parquet(path)
    table.folder = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that ``materialize`` returned, once nothing reads them any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.folder)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
