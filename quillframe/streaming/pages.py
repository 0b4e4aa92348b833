"""The page operators over files that keep arriving. Every operator on a page is stateless, so batches and streams share it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from quillframe.sources.images import BINARY_FILE


def stream_uploads(spark: SparkSession, path: str, pattern: str = "*.{jpg,jpeg,png,bmp,gif}", files_per_batch: int = 1000) -> DataFrame:
    """Image files as a stream, so many to a batch at most."""
    return spark.readStream.format("binaryFile").schema(BINARY_FILE).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).load(path)


def stream_lines(spark: SparkSession, path: str, schema: str = "doc_id BIGINT, det_no INT, text STRING, confidence FLOAT, polygon ARRAY<ARRAY<INT>>", files_per_batch: int = 1000) -> DataFrame:
    """Recognized lines from Parquet files as a stream. The lines of a document must come in one file, or one batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def process_available(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Runs a batch operator over all files that are there and ends. Each batch writes a folder of its own, which a rerun replaces."""

    def write(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
