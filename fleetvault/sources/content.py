"""File bodies: read from a tree, keep in a content table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def with_checksum(files: DataFrame, content: str = "content") -> DataFrame:
    """Add size in bytes and the hex MD5 of the body."""
    return files.withColumn("size", F.octet_length(content).cast("bigint")).withColumn(
        "md5", F.md5(F.col(content).cast("binary"))
    )


def read(spark: SparkSession, root: str) -> DataFrame:
    """Path, body, size and checksum of every file below ``root`` that is not empty."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace("path", "^file:(//)?", "").alias("path")
    return with_checksum(files.select(path, "content"))


def append(content: DataFrame, table: str) -> None:
    content.write.mode("append").parquet(table)
