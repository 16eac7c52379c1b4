"""Continuous ingest: new files of a folder through the same functions, with Spark's checkpoint as the memory of what is done."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.functions import formats
from shutterlake.sources.files import content_hash


def watch(spark: SparkSession, folder: str, max_chunk: int, files_per_batch: int = 1000) -> DataFrame:
    """A stream of path, ext, file_type, size, modified_at, content_hash of supported files."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch).load(folder)
    ext = formats.extension("path")
    return files.where(formats.is_supported(ext)).select("path", ext.alias("ext"), formats.file_type(ext).alias("file_type"), F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"), content_hash("content", max_chunk).alias("content_hash"))


def ingest(stream: DataFrame, target: str, checkpoint: str, each: Callable[[DataFrame], DataFrame] | None = None):
    """Appends each batch to Parquet, available files only; a batch that is repeated replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        (each(batch) if each else batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
