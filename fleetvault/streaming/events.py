"""Change events as a stream of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetvault.schemas import CHANGE_EVENT


def read(
    spark: SparkSession, folder: str, form: str = "parquet", files_per_batch: int | None = None
) -> DataFrame:
    """Stream the event files that appear in ``folder``; the schema is fixed."""
    reader = spark.readStream.schema(CHANGE_EVENT).format(form)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def initial(inventory: DataFrame, host: Column, as_of: Column) -> DataFrame:
    """The files found by the first scan (path, size) as events that precede all others.

    Write them into the event folder before the watch starts: scan and watch then form one
    stream.
    """
    first = F.lit(-(1 << 62)).cast("bigint")
    return inventory.select(
        (F.monotonically_increasing_id() + first).alias("seq"),
        as_of.cast("timestamp_ntz").alias("ts"),
        host.alias("host"),
        F.lit("created").alias("kind"),
        F.col("path").alias("src_path"),
        F.lit(None).cast("string").alias("dest_path"),
        F.col("size").cast("bigint").alias("size"),
        F.lit(True).alias("is_initial"),
    )
