"""A folder of arriving files as a stream of binary rows (path, modificationTime, length, content)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BINARY = "path string, modificationTime timestamp, length long, content binary"


def arriving_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    return spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
