"""Binary files from a DataFrame, with Spark's commit protocol and on any file system that Spark can reach.

Each row of a binary column becomes a file. Spark's text writer puts a row's bytes as they are and then the line
separator; with one row to a file and the last four bytes of the format - which must be the same for all files - as the
separator, the file is exactly the row. A task that is lost or run twice leaves no half file. Files are read back by
Spark's ``binaryFile`` source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_files(df: DataFrame, column: str, path: str, trailer: bytes) -> None:
    """Write each row of a binary column, which must end with trailer, to a file of its own in the folder path."""
    body = F.col(column).substr(F.lit(1), F.octet_length(column) - len(trailer)).cast("string").alias("value")
    (
        df.select(body)
        .write.option("maxRecordsPerFile", 1)
        .option("encoding", "ISO-8859-1")
        .option("lineSep", trailer.decode("latin-1"))
        .option("compression", "none")
        .text(path)
    )


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path and content of all files of the folder."""
    return spark.read.format("binaryFile").load(path).select("path", "content")
