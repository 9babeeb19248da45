"""Which files go up, and what the store and the transfer log receive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetvault.functions.checks import packed, unpacked
from fleetvault.functions.times import iso_text

UPLOAD = "upload"
SKIP_VALID = "skip_valid"
SKIP_CORRUPT = "skip_corrupt"
MANIFEST_ONLY = "manifest_only"


def upload_plan(files: DataFrame, stored: DataFrame) -> DataFrame:
    """``action`` and ``writes_manifest`` per file (columns path, md5, is_deleted).

    A deletion only writes a manifest. A stored file is never overwritten: it is skipped as
    valid or as possibly corrupt, and skipping writes no manifest. A file that was both created
    and moved is there twice with the same content; it goes up once.
    """
    # Files move once, by their path, and are sorted once: so they are made distinct and meet the store.
    moved = files.withColumn("md5", packed(F.col("md5"))).repartition("path")
    first = F.row_number().over(Window.partitionBy("path", "md5", "is_deleted").orderBy("path"))
    once = moved.withColumn("_row", first).filter("_row = 1").drop("_row")
    known = stored.select("path", packed(F.col("md5")).alias("_stored"), F.lit(True).alias("_exists"))
    joined = once.join(known, "path", "left")
    same = F.coalesce(F.col("_stored") == F.col("md5"), F.lit(False))
    action = (
        F.when(F.col("is_deleted"), MANIFEST_ONLY)
        .when(F.col("_exists").isNull(), UPLOAD)
        .when(same, SKIP_VALID)
        .otherwise(SKIP_CORRUPT)
    )
    judged = joined.withColumn("action", action).drop("_stored", "_exists")
    planned = judged.withColumn("md5", unpacked(F.col("md5")))
    return planned.withColumn("writes_manifest", F.col("action").isin(UPLOAD, MANIFEST_ONLY))


def log_line(ts: Column, op: Column, source: Column, target: Column, size: Column) -> Column:
    """``<time> <op> <source> to <target> size <bytes>``."""
    return F.concat_ws(" ", iso_text(ts), op, source, F.lit("to"), target, F.lit("size"), size)


def stored_lines(plan: DataFrame, ts: Column) -> DataFrame:
    """Log lines of the planned uploads (columns file_path, path, size)."""
    line = log_line(ts, F.lit("stored"), F.col("file_path"), F.col("path"), F.col("size"))
    return plan.filter(F.col("action") == UPLOAD).select(line.alias("line"))


def restored_lines(outcome: DataFrame, ts: Column) -> DataFrame:
    """Log lines of the files that were restored (columns source_path, restore_path, size)."""
    line = log_line(ts, F.lit("restored"), F.col("source_path"), F.col("restore_path"), F.col("size"))
    done = outcome.filter(F.col("should_restore") & F.col("failed_reason").isNull())
    return done.select(line.alias("line"))


def removed_lines(removals: DataFrame, ts: Column) -> DataFrame:
    """Log lines of removed files (columns path, size); the target is ``na``.

    Rows without a size are not files with metadata (manifests, say) and are not logged.
    """
    line = log_line(ts, F.lit("removed"), F.col("path"), F.lit("na"), F.col("size"))
    return removals.filter(F.col("size").isNotNull()).select(line.alias("line"))


def new_content(content: DataFrame, stored: DataFrame) -> DataFrame:
    """Content rows whose path is not stored yet.

    The decision runs on paths alone; the bodies meet it once, in the last join.
    """
    fresh = content.select("path").join(stored.select("path"), "path", "left_anti")
    return content.join(fresh, "path", "left_semi")
