"""What a restore does with every file, and how it ended."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetvault.functions import checks, paths

DATA_DIR = "/var/lib/data"
QUARANTINE = "corrupt"

# Reasons as reported.
NO_FILE = "No File"
NOT_CHECKED = "Existing file (Not checksummed)"
CHECKED = "Existing file (Checksummed)"
EXISTING_CORRUPT = "Existing file corrupt"
SOURCE_MISSING = "Source file missing"
RESTORED_CORRUPT = "Restored File corrupt"


def restore_plan(
    files: DataFrame,
    targets: DataFrame,
    data_dir: str = DATA_DIR,
    quarantine: str = QUARANTINE,
    checksum: bool = True,
    release: str | Column = paths.DEFAULT_RELEASE,
) -> DataFrame:
    """Compare backup files with what is already at their destination on the host.

    ``files`` has host, md5 and the component columns; ``targets`` has host, restore_path and
    md5. An equal target is skipped, a different one is moved aside and restored; without
    checksums an existing target is restored over.
    """
    planned = files.withColumn("source_path", paths.backup_path()).withColumn(
        "restore_path", F.concat_ws("/", F.lit(data_dir), paths.restore_path(release))
    )
    there = targets.select(
        "host", "restore_path", checks.packed(F.col("md5")).alias("_target"), F.lit(True).alias("_exists")
    )
    found = planned.withColumn("md5", checks.packed(F.col("md5"))).join(there, ["host", "restore_path"], "left")
    same = F.coalesce(F.col("_target") == F.col("md5"), F.lit(False))
    joined = found.withColumns({"_same": same, "md5": checks.unpacked(F.col("md5"))})
    absent, same = F.col("_exists").isNull(), F.col("_same")
    why = F.when(absent, NO_FILE)
    if checksum:
        why = why.when(same, CHECKED).otherwise(EXISTING_CORRUPT)
    else:
        why = why.otherwise(NOT_CHECKED)
    name = paths.base_name(F.col("restore_path"))
    moved = paths.quarantine_path(data_dir, quarantine, name)
    # Without recorded metadata nothing will be restored, so the target stays where it is.
    replaced = (F.col("restore_reason") == EXISTING_CORRUPT) & F.col("md5").isNotNull()
    return (
        joined.withColumn("restore_reason", why)
        .withColumn("should_restore", F.col("restore_reason") != CHECKED)
        .withColumn("corrupt_path", F.when(replaced, moved))
        .drop("_target", "_exists", "_same")
    )


def restore_outcome(plan: DataFrame, stored: DataFrame, checksum: bool = True) -> DataFrame:
    """Add ``failed_reason``: the source is gone, or what arrived has another checksum.

    A backup file without metadata (null md5) counts as a missing source.
    """
    source = stored.select(
        F.col("path").alias("source_path"), checks.packed(F.col("md5")).alias("_stored"), F.lit(True).alias("_exists")
    )
    joined = plan.withColumn("md5", checks.packed(F.col("md5"))).join(source, "source_path", "left")
    differs = (F.col("_stored") != F.col("md5")) if checksum else F.lit(False)
    gone = F.col("_exists").isNull() | F.col("md5").isNull()
    failed = F.when(
        F.col("should_restore"), F.when(gone, SOURCE_MISSING).when(differs, RESTORED_CORRUPT)
    )
    judged = joined.withColumn("failed_reason", failed).drop("_stored", "_exists")
    return judged.withColumn("md5", checks.unpacked(F.col("md5")))


def stop_if_corrupt(outcome: DataFrame) -> None:
    """The strict mode: fail the whole restore when any restored file is corrupt."""
    bad = outcome.filter(F.col("failed_reason") == RESTORED_CORRUPT)
    if not bad.isEmpty():
        raise RuntimeError("a restored file is corrupt")


def with_ownership(
    plan: DataFrame,
    owner: str | None = None,
    group: str | None = None,
    chown: bool = True,
    chmod: bool = True,
) -> DataFrame:
    """Owner, group and mode to apply (columns user, group, mode); null leaves them alone."""
    return (
        plan.withColumn("apply_user", checks.owner(owner, F.col("user")) if chown else F.lit(None).cast("string"))
        .withColumn("apply_group", checks.owner(group, F.col("group")) if chown else F.lit(None).cast("string"))
        .withColumn("apply_mode", checks.mode(F.col("mode")) if chmod else F.lit(None).cast("int"))
    )


def summary(outcome: DataFrame, by: Sequence[str] = ("host", "keyspace")) -> DataFrame:
    """Files per class and reason; a file moved aside also counts as failed or restored."""
    failed = F.col("failed_reason").isNotNull()

    def entry(kind: str, reason: Column) -> Column:
        return F.struct(F.lit(kind).alias("class"), reason.alias("reason"))

    result = (
        F.when(failed, entry("failed", F.col("failed_reason")))
        .when(~F.col("should_restore"), entry("skipped", F.col("restore_reason")))
        .otherwise(entry("restored", F.col("restore_reason")))
    )
    aside = entry("moved_aside", F.col("restore_reason"))
    classes = F.when(F.col("corrupt_path").isNotNull(), F.array(result, aside)).otherwise(F.array(result))
    return (
        outcome.select(*by, F.inline(classes))
        .groupBy(*by, "class", "reason")
        .agg(F.count("*").alias("files"))
    )


def restored_content(outcome: DataFrame, content: DataFrame) -> DataFrame:
    """Destination path and body of every file that restores cleanly."""
    done = outcome.filter(F.col("should_restore") & F.col("failed_reason").isNull())
    wanted = done.select(F.col("source_path").alias("path"), F.col("restore_path").alias("dest_path"))
    return content.join(wanted, "path").select("dest_path", "content")
