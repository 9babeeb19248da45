"""The transfer log: text lines to typed rows and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetvault.functions.times import parse_iso

# Fixed value: the shape of a line. Sources may hold spaces, so it is anchored at both ends.
LINE = r"^(\S+) (\S+) (.*) to (.*) size (\d+)$"
OPERATIONS = ("stored", "restored", "removed")


def parse(lines: DataFrame, line: str = "line") -> DataFrame:
    """Add ts, op, src_path, dest_path, bytes and ``problem`` (null for a good line).

    Time, operation and size are cut off the ends without a pattern match, so a job that
    needs only those never extracts the paths.
    """
    text = F.col(line)
    shaped = text.rlike(LINE)
    found = lines.withColumns(
        {
            "ts": parse_iso(F.substring_index(text, " ", 1)),
            "op": F.get(F.split(text, " ", 3), F.lit(1)),
            "src_path": F.regexp_extract(text, LINE, 3),
            "dest_path": F.regexp_extract(text, LINE, 4),
            "bytes": F.substring_index(text, " ", -1).try_cast("bigint"),
        }
    )
    problem = (
        F.when(~shaped, "malformed")
        .when(F.col("ts").isNull(), "bad_time")
        .when(~F.col("op").isin(*OPERATIONS), "unknown_operation")
        .when(F.col("bytes").isNull(), "bad_size")
    )
    return found.withColumn("problem", problem)


def good(parsed: DataFrame) -> DataFrame:
    return parsed.filter("problem IS NULL").drop("problem")


def quarantined(parsed: DataFrame, line: str = "line") -> DataFrame:
    """Lines that could not be used, with the reason."""
    return parsed.filter("problem IS NOT NULL").select(line, "problem")


def numbered(lines: DataFrame, file: str = "file") -> DataFrame:
    """Replace the read position (file, _block, _row) by ``seq``, the line number in its file.

    Rows count up within one read split; a table with one row per split adds the lines of the
    splits before it. Spark sees the size of that table when it has been made, and leaves the lines
    in place when it is small.
    """
    splits = lines.groupBy(file, "_block").agg(
        F.count("*").alias("_lines"), F.min("_row").alias("_first")
    )
    earlier = Window.partitionBy(file).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.withColumn("_before", F.coalesce(F.sum("_lines").over(earlier), F.lit(0)))
    joined = lines.join(offsets.drop("_lines"), [file, "_block"])
    seq = F.col("_row") - F.col("_first") + F.col("_before")
    return joined.withColumn("seq", seq).drop("_block", "_row", "_first", "_before")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Log files as ``file`` (path), ``seq`` (line number within it) and ``line``."""
    text = spark.read.text(path)
    lines = text.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
        F.col("value").alias("line"),
    )
    return numbered(lines)


def append(lines: DataFrame, path: str) -> None:
    lines.select("line").write.mode("append").text(path)
