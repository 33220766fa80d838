"""Incremental jobs on Structured Streaming. Every sink write is idempotent per batch, so retried batches change nothing."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def run_append(stream: DataFrame, sink: str, checkpoint: str) -> None:
    """Stateless transformation → parquet sink; processes what is there and stops. A rerun adds nothing."""
    q = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


def run_batches(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB: on local disk with changes saved to the checkpoint, not on the heap."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)


def unseen(stream: DataFrame, key: str, event_time: str | None = None, within: str = "30 days") -> DataFrame:
    """The first row of every key over the whole stream, by keyed state: a batch looks up its own keys only.

    With an ``event_time`` a key is forgotten once the watermark has passed it by ``within``; without one it is kept.
    """
    if event_time is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(event_time, within).dropDuplicatesWithinWatermark([key])


def merged_edges(stream: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Running mean and count per edge, for update mode."""
    return stream.groupBy(*keys).agg(F.avg(score).alias("confidence"), F.count("*").alias("n_sources"))


def upsert_writer(sink: str) -> Callable[[DataFrame, int], None]:
    """Updated rows of a batch as one folder; the current view is the latest row per key."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("version", F.lit(batch_id)).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return write


def current_view(spark: SparkSession, sink: str, keys: list[str]) -> DataFrame:
    df = spark.read.parquet(sink)
    rest = [c for c in df.columns if c not in (*keys, "version", "batch")]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "version").alias("_l")).select(*keys, "_l.*")


