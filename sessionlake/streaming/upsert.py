"""A dataset kept up to date from a stream of sessions, by keep-best merges of micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.merge import union_merge


def merge_stream(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Merge each batch (columns of :func:`union_merge`) into versions below ``path``: ``v<batch>`` is the dataset
    after a batch, made from the one before; a batch repeated after a failure is written again to the same place."""

    def merged(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = spark.read.schema(batch.schema).parquet(f"{path}/v{number - 1}") if number else batch.where("false")
        union_merge(old, batch).drop("side", "merge_class", "position").select(batch.columns).write.mode("overwrite").parquet(f"{path}/v{number}")

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(merged)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 hour")).start()
