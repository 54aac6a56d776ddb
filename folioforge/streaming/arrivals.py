"""A folder of documents as a stream; every file is parsed on its own, so no state is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.documents import parsed


def arriving(spark: SparkSession, folder: str, pattern: str = "*.pdf", files_per_batch: int = 1000) -> DataFrame:
    schema = "path string, modificationTime timestamp, length long, content binary"
    return parsed(spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).load(folder))
