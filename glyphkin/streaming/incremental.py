"""New pages as they arrive: a file stream, processed in micro-batches, each written once.

The counterpart of re-running a step with existing results skipped: the checkpoint says which files were seen, the
anti-join on the written keys covers a batch that is repeated after a failure.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.sinks import write_pending


def process_new(spark: SparkSession, source: str, schema: str, step: Callable[[DataFrame], DataFrame], target: str, key: list[str], checkpoint: str, files_per_batch: int = 1000) -> StreamingQuery:
    """Runs step over Parquet files below source that were not seen before, until there are no more, and appends."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def each(batch: DataFrame, _: int) -> None:
        write_pending(step(batch), target, key)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
