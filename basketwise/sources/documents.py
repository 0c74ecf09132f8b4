"""Reading text documents and keeping chunk snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.errors import AnalysisException


def read_documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(source, text): one row per file, named by the file; line ends are made uniform."""
    files = spark.read.text(path, wholetext=True)
    return files.select(
        F.col("_metadata.file_name").alias("source"),
        F.regexp_replace("value", "\r\n?", "\n").alias("text"),
    )


def write_snapshot(chunks: DataFrame, path: str) -> str:
    """Write a chunk snapshot to a new folder; an existing one is never overwritten."""
    chunks.write.mode("errorifexists").parquet(path)
    return path


def read_snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    """A chunk snapshot, or None where there is none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
