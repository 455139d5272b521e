"""Folders as sources: files with their bytes, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import extension
from ..operators.ingest import EXTENSIONS

FILE = "path string, modificationTime timestamp, length long, content binary"


def wanted(path: Column) -> Column:
    """Whether a file is let in: its type is, and it isn't hidden."""
    return extension(path).isin(*EXTENSIONS) & ~F.regexp_extract(path, "([^/]*)$", 1).startswith(".")


def _wanted(files: DataFrame) -> DataFrame:
    return files.filter(wanted(F.col("path"))).select("path", "content", F.lit(None).cast("string").alias("declared_type"))


def folder(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, declared_type) of the files of a folder that are let in; hidden and other files aren't read."""
    return _wanted(spark.read.format("binaryFile").schema(FILE).option("recursiveFileLookup", "true").load(path))


def folder_stream(spark: SparkSession, path: str, most_files: int = 1000, processed: str | None = None) -> DataFrame:
    """The same as a stream: each file once, `most_files` at a time. Progress is in the checkpoint; with `processed`, files
    are moved below that folder once their batch is done (the next batch, or the next start, moves those of the last)."""
    files = spark.readStream.format("binaryFile").schema(FILE).option("maxFilesPerTrigger", most_files).option("recursiveFileLookup", "true")
    if processed:
        files = files.option("cleanSource", "archive").option("sourceArchiveDir", processed)
    return _wanted(files.load(path))
