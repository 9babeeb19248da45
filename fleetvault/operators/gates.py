"""Which files and change events enter a backup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetvault.functions.paths import (
    DATA_COMPONENT,
    DEFAULT_RELEASE,
    is_snapshot,
    with_component,
)

ELIGIBLE = "eligible"
SYSTEM_KEYSPACE = "system"


def keyspace_allowed(excluded: Sequence[str] = (), include_system: bool = False) -> Column:
    """Excluded names match exactly; the system keyspace matches in any case."""
    allowed = ~F.col("keyspace").isin(list(excluded)) if excluded else F.lit(True)
    if include_system:
        return allowed
    return allowed & (F.lower("keyspace") != SYSTEM_KEYSPACE)


def reason(
    path: str = "path",
    excluded: Sequence[str] = (),
    include_system: bool = False,
    vanished: Column | None = None,
) -> Column:
    """First rule that keeps a parsed file out of the backup, or ``eligible``."""
    gone = F.lit(False) if vanished is None else F.coalesce(vanished, F.lit(False))
    return (
        F.when(gone, "vanished")
        .when(is_snapshot(F.col(path)), "snapshot")
        .when(F.col("parse_error").isNotNull(), F.col("parse_error"))
        .when(F.col("temporary"), "temporary")
        .when(~keyspace_allowed(excluded, include_system=True), "excluded_keyspace")
        .when(~keyspace_allowed((), include_system), "system_keyspace")
        .otherwise(ELIGIBLE)
    )


def eligibility(
    files: DataFrame,
    path: str = "path",
    release: str | Column = DEFAULT_RELEASE,
    excluded: Sequence[str] = (),
    include_system: bool = False,
    vanished: Column | None = None,
) -> DataFrame:
    """Parse every path and add ``reason``; rejected files stay in, for the audit counts."""
    parsed = with_component(files, path, release)
    return parsed.withColumn("reason", reason(path, excluded, include_system, vanished))


def eligible(files: DataFrame, **options) -> DataFrame:
    return eligibility(files, **options).filter(F.col("reason") == ELIGIBLE).drop("reason")


def eligibility_counts(judged: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return judged.groupBy(*by, "reason").agg(F.count("*").alias("files"))


def delete_accepted(path: str = "path") -> Column:
    """A deletion counts when it is the data component of a parsable, non-snapshot path.

    Temporary, excluded and system files are not filtered here.
    """
    return (
        ~is_snapshot(F.col(path))
        & F.col("parse_error").isNull()
        & (F.col("component") == DATA_COMPONENT)
    )


def judge_changes(
    events: DataFrame,
    release: str | Column = DEFAULT_RELEASE,
    excluded: Sequence[str] = (),
    include_system: bool = False,
    ignore_existing: bool = False,
    ignore_changes: bool = False,
) -> DataFrame:
    """Parse change events and add ``accepted`` and ``emits``.

    A move counts under its destination. ``accepted`` events change the manifest; those that
    also ``emit`` cause an upload or a new manifest. Files found by the initial scan enter
    the manifest silently when existing files are ignored.
    """
    moved = F.col("kind") == "moved"
    path = F.when(moved, F.col("dest_path")).otherwise(F.col("src_path"))
    watched = events.filter("is_initial") if ignore_changes else events
    parsed = with_component(watched.withColumn("path", path), "path", release)
    added = reason("path", excluded, include_system) == ELIGIBLE
    deleted = F.col("kind") == "deleted"
    accepted = F.when(deleted, delete_accepted("path")).otherwise(added)
    judged = parsed.withColumn("accepted", F.coalesce(accepted, F.lit(False)))
    silent = F.col("is_initial") & F.lit(ignore_existing)
    return judged.withColumn("emits", F.col("accepted") & ~silent)


def accepted_changes(events: DataFrame, **options) -> DataFrame:
    return judge_changes(events, **options).filter("accepted").drop("accepted")
