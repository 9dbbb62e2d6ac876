"""Documents as they land in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.files import read_text_documents

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def file_stream(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.readStream.format("binaryFile").schema(FILE_SCHEMA)
        .option("recursiveFileLookup", True).load(path)
    )


def streaming_ingest(files: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append every file once, with its status and, when it failed, the reason."""
    documents = read_text_documents(files)
    return (
        documents.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
