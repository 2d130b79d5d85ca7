"""Structured Streaming: new files become blocks and chunks as they arrive; bursts of changes are debounced."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stratalake.operators.blocks import text_blocks
from stratalake.operators.chunks import line_chunks


def ingest(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, transform: Callable[[DataFrame], dict[str, DataFrame]] | None = None, available_now: bool = True) -> StreamingQuery:
    """Each micro-batch of new Parquet files under source is turned to blocks and chunks and written by batch id.

    A batch that runs again overwrites its own folder, so every file counts once."""
    make = transform or (lambda docs: {"blocks": text_blocks(docs), "chunks": line_chunks(docs)})

    def write(batch: DataFrame, number: int) -> None:
        for name, table in make(batch).items():
            table.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")

    writer = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")).start()


def change_bursts(changes: DataFrame, path_col: str, ts_col: str, quiet: str = "2 seconds", late: str = "1 minute") -> DataFrame:
    """A streaming count of changes in session windows of each path; a burst is given out once it is over."""
    return changes.withWatermark(ts_col, late).groupBy(F.session_window(ts_col, quiet), path_col).agg(F.count("*").alias("changes")).select(path_col, F.col("session_window.start").alias("begin_ts"), F.col("session_window.end").alias("end_ts"), "changes")
