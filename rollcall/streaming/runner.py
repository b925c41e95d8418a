"""Run a streaming DataFrame to completion over the files present now
(``availableNow``) into a parquet sink; used by tests and by the registered
stream queries to compare a stream with its batch twin."""

from __future__ import annotations

import threading
from collections.abc import Iterator, Sequence
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.io import scratch_path


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
_IN_MEMORY = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_starting = threading.Lock()


@contextmanager
def keyed_state_store(spark: SparkSession) -> Iterator[None]:
    """A stream with ``transformWithState`` is started in here. Spark's default
    store cannot hold its state, so a session that has this store has the RocksDB
    one meanwhile; any other is left as it is. A stream takes the settings of its
    session when it starts, so the session has its own back at once. One at a
    time, or one start would take the setting from another."""
    with _starting:
        own = spark.conf.get(STATE_STORE, None)
        if own not in (None, _IN_MEMORY):
            yield
            return
        spark.conf.set(STATE_STORE, _ROCKSDB)
        try:
            yield
        finally:
            if own is None:
                spark.conf.unset(STATE_STORE)
            else:
                spark.conf.set(STATE_STORE, own)


def run_available_now(stream: DataFrame, name: str, output_mode: str = "append", keyed_state: bool = False) -> str:
    """Returns the sink. ``keyed_state``: the stream has ``transformWithState``."""
    spark = stream.sparkSession
    sink = scratch_path(spark, "streams", name, "out")
    ckpt = scratch_path(spark, "streams", name, "ckpt")
    writer = (stream.writeStream.format("parquet").option("path", sink)
                    .option("checkpointLocation", ckpt).outputMode(output_mode)
                    .trigger(availableNow=True))
    with keyed_state_store(spark) if keyed_state else nullcontext():
        q = writer.start()
    q.awaitTermination()
    return sink


def run_foreach_batch(stream: DataFrame, name: str, handler, ckpt: str | None = None,
                      output_mode: str = "append") -> None:
    spark = stream.sparkSession
    ckpt = ckpt or scratch_path(spark, "streams", name, "ckpt")
    q = (stream.writeStream.foreachBatch(handler).option("checkpointLocation", ckpt).outputMode(output_mode)
               .trigger(availableNow=True).start())
    q.awaitTermination()


def run_updates(stream: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """Run an aggregating stream in update mode and return the current row of
    each key, open windows included. Every micro-batch writes its changed rows
    to a folder of its own, which a repeated batch overwrites as a whole; the
    latest batch of a key holds its current row. Sink and checkpoint belong
    together: a new checkpoint starts a new sink."""
    spark = stream.sparkSession
    sink = scratch_path(spark, "streams", name, "updates")
    ckpt = scratch_path(spark, "streams", name, "ckpt")
    carry = [c for c in stream.columns if c not in keys]
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])

    def handle(batch: DataFrame, batch_id: int):
        batch.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    run_foreach_batch(stream, name, handle, ckpt=ckpt, output_mode="update")
    rows = spark.read.schema(schema).parquet(sink)
    last = rows.groupBy(*keys).agg(F.max(F.struct("batch", *carry)).alias("_last"))
    return last.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in carry])
