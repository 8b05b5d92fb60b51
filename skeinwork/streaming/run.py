"""Running a streaming plan into files, with the state store that large state needs."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Keyed state in RocksDB; a batch checkpoints the changes it made, snapshots are made in the background.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Settings that a query takes over when it starts; the session's own come back afterwards."""
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for key, value in STATE_CONF.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def start_append(stream: DataFrame, root: str, **trigger):
    """Start a plan that appends finished rows to files below ``root`` and keeps its checkpoint there."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint")
    with state_store(stream.sparkSession):
        return writer.trigger(**(trigger or {"availableNow": True})).start()


def run_append(stream: DataFrame, root: str) -> DataFrame:
    """Run a plan over what is there and read everything it has written so far."""
    start_append(stream, root).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/out")
