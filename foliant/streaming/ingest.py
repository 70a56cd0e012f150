"""Streaming ingest: new files of a folder are parsed as they come, each once.

The file source keeps what it has seen in the query's checkpoint, so a restarted stream goes
on where it stopped; parsing is the same ``mapInPandas`` scan as in batch, and chunks can be
made in the same pass, as they only need the rows of one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.sources.scan import scan_bytes

FILES = "path string, modificationTime timestamp, length long, content binary"


def parsed_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return scan_bytes(files.select(F.xxhash64("path").alias("doc_id"), "path", "content"))


def write_stream(docs: DataFrame, table_path: str, checkpoint: str, once: bool = True):
    """Appends parsed documents as Parquet; ``once`` takes what is there and stops."""
    writer = docs.writeStream.format("parquet").option("path", table_path).option("checkpointLocation", checkpoint).outputMode("append")
    return writer.trigger(availableNow=True).start() if once else writer.start()


def warning_counts(docs: DataFrame) -> DataFrame:
    """Running counts of warnings by kind over a stream (or table) of documents."""
    return docs.select(F.explode("warnings").alias("w")).groupBy("w.kind", "w.level").count()
