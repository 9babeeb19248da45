"""Are all files of a backup there, and are they intact?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetvault.functions.checks import packed
from fleetvault.functions.paths import backup_path

PRESENT = "present"
MISSING = "missing"
CORRUPT = "corrupt"
BACKUP = ("host", "keyspace", "ts")
PATH_KEY = ("_path_hash", "path")


def with_path(components: DataFrame) -> DataFrame:
    return components.withColumn("path", backup_path())


def keyed(rows: DataFrame) -> DataFrame:
    """Add a hash of the path, first in joins by path: paths begin alike, so sorting them alone is slow."""
    return rows.withColumn(PATH_KEY[0], F.xxhash64("path"))


def newest(meta: DataFrame, order: str = "written", by: Sequence[str] = ("path",)) -> DataFrame:
    """One row per file: metadata is appended, so a file written again has several.

    The row with the greatest ``order`` counts; without that column, or with equal values, the
    greatest checksum, so that the choice does not depend on the order of reading.
    """
    rank = [c for c in (order, "md5") if c in meta.columns]
    if not rank:
        return meta.dropDuplicates(list(by))
    others = [c for c in meta.columns if c not in by]
    best = F.max_by(F.struct(*others), F.struct(*rank)).alias("_best")
    return meta.groupBy(*by).agg(best).select(*by, "_best.*").select(*meta.columns)


def component_meta(components: DataFrame, meta: DataFrame) -> DataFrame:
    """Components with the newest recorded metadata of their file (null when there is none).

    Many backups name the same file; Spark splits such keys on the component side.
    """
    return with_path(components).join(newest(meta).drop("written"), "path", "left")


def file_status(meta: DataFrame, stored: DataFrame, checksum: bool) -> DataFrame:
    """Status per file with metadata, by its newest; columns path, its hash and status.

    Of rows equal in ``written`` the greatest checksum counts, by its bytes.
    """
    there = keyed(stored.select("path", packed(F.col("md5")).alias("_stored"), F.lit(True).alias("_exists")))
    # Only what the choice and the verdict need is moved, once: by its path it meets the store.
    used = [c for c in ("path", "md5", "written") if c in meta.columns]
    slim = keyed(meta.select(*used).withColumn("md5", packed(F.col("md5"))))
    joined = newest(slim.repartition(*PATH_KEY), by=PATH_KEY).join(there, list(PATH_KEY), "left")
    intact = F.coalesce(F.col("_stored") == F.col("md5"), F.lit(False)) if checksum else F.lit(True)
    status = (
        F.when(F.col("_exists").isNull(), MISSING).when(intact, PRESENT).otherwise(CORRUPT)
    )
    return joined.select(*PATH_KEY, status.alias("status"))


def validate(
    components: DataFrame,
    meta: DataFrame,
    stored: DataFrame,
    checksum: bool = False,
) -> DataFrame:
    """``status`` per component: a file is judged once, then looked up by every backup.

    A file without metadata is missing.
    """
    judged = file_status(meta, stored, checksum)
    found = keyed(with_path(components)).join(judged, list(PATH_KEY), "left").drop(PATH_KEY[0])
    return found.withColumn("status", F.coalesce("status", F.lit(MISSING)))


def summary(validated: DataFrame, by: Sequence[str] = BACKUP) -> DataFrame:
    """Counts per backup and the verdict: ok when nothing is missing or corrupt."""

    def count(status: str):
        return F.count(F.when(F.col("status") == status, 1)).alias(status)

    counted = validated.groupBy(*by).agg(count(PRESENT), count(MISSING), count(CORRUPT))
    return counted.withColumn("ok", (F.col(MISSING) == 0) & (F.col(CORRUPT) == 0))
