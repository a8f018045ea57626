"""Run a streaming plan over all input that is there, and read its results as a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..storage import shared_dir

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drain(stream: DataFrame, tag: str) -> DataFrame:
    """The rows that ``stream`` appends until its present input is used up. Rows and checkpoint lie in the shared folder,
    so a run outlives lost executors. The query keeps its state in RocksDB, whatever the session's provider is."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/blockwise/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
