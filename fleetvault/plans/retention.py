"""What a purge keeps and what it removes."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetvault.functions.paths import backup_file_name, base_name, manifest_path
from fleetvault.functions.times import parse_input_value, utc_now
from fleetvault.operators.listing import is_sidecar, sidecar_of

SCOPE = ("host", "keyspace")


def cutoff(
    purge_before: str | datetime | None = None,
    keep_days: int | None = None,
    as_of: datetime | None = None,
) -> datetime:
    """Exactly one of an explicit date or a number of days before ``as_of``."""
    if (purge_before is None) == (keep_days is None):
        raise ValueError("give either purge_before or keep_days")
    if keep_days is not None:
        if keep_days < 1:
            raise ValueError("keep_days must be greater than 0")
        return (as_of or utc_now()) - timedelta(days=keep_days)
    return parse_input_value(purge_before) if isinstance(purge_before, str) else purge_before


def _literal(moment: datetime) -> Column:
    return F.lit(moment.isoformat(" ")).cast("timestamp_ntz")


def kept(manifests: DataFrame, before: datetime) -> DataFrame:
    """Manifests at or after the cutoff.

    On a table partitioned by year, month and day the same condition is repeated on those
    columns, so that older directories are not read.
    """
    recent = manifests.filter(F.col("ts") >= _literal(before))
    if {"year", "month", "day"} <= set(manifests.columns):
        recent = recent.filter(partition_range(before))
    return recent


def partition_range(before: datetime) -> Column:
    year, month, day = F.col("year"), F.col("month"), F.col("day")
    return (
        (year > before.year)
        | ((year == before.year) & (month > before.month))
        | ((year == before.year) & (month == before.month) & (day >= before.day))
    )


def manifest_days(scopes: DataFrame, before: datetime, as_of: datetime) -> DataFrame:
    """The days, cutoff to ``as_of`` inclusive, whose manifests a purge may keep."""
    if before.date() > as_of.date():
        raise ValueError("the cutoff is after the last day")
    first, last = F.lit(before.date()), F.lit(as_of.date())
    days = F.explode(F.sequence(first, last, F.expr("INTERVAL '1' DAY"))).alias("day")
    return scopes.select(*SCOPE, days)


def keep_files(components: DataFrame, before: datetime) -> DataFrame:
    """File names the kept manifests refer to, once per host and keyspace.

    A file named by many manifests is reduced to one row before it moves.
    """
    return (
        kept(components, before).select(*SCOPE, backup_file_name().alias("file_name")).distinct()
    )


def keep_manifests(manifests: DataFrame, before: datetime) -> DataFrame:
    recent = kept(manifests, before)
    return recent.select(*SCOPE, manifest_path(F.col("ts")).alias("path")).distinct()


def purge_files(
    stored: DataFrame, components: DataFrame, before: datetime
) -> DataFrame:
    """Stored files (host, keyspace, path, ...) that no kept manifest names.

    Sidecars go with their file (``removal_plan``) and are never judged by themselves.
    """
    keep = keep_files(components, before)
    files = stored.filter(~is_sidecar(F.col("path")))
    found = files.withColumn("file_name", base_name(F.col("path")))
    return found.join(keep, [*SCOPE, "file_name"], "left_anti").drop("file_name")


def purge_manifests(
    listing: DataFrame, manifests: DataFrame, before: datetime
) -> DataFrame:
    """Listed manifest paths (host, keyspace, path) that are not kept.

    The comparison stays within a host, so purging one host leaves the others alone.
    """
    return listing.join(keep_manifests(manifests, before), [*SCOPE, "path"], "left_anti")


def scoped(df: DataFrame, keyspace: str | None = None, host: str | None = None) -> DataFrame:
    """Restrict any relation of a purge to one keyspace or host."""
    for name, value in (("keyspace", keyspace), ("host", host)):
        if value is not None:
            df = df.filter(F.col(name) == value)
    return df


def removal_plan(doomed: DataFrame, dry_run: bool = False) -> DataFrame:
    """Paths to delete with their sidecars; a dry run lists the same paths."""
    return doomed.withColumn("meta_path", sidecar_of(F.col("path"))).withColumn(
        "dry_run", F.lit(dry_run)
    )


def survivors(table: DataFrame, plan: DataFrame) -> DataFrame:
    """The table after the plan; rows of a dry run stay. Write it as a new version."""
    gone = plan.filter(~F.col("dry_run")).select("path")
    return table.join(gone, "path", "left_anti")


def purge_report(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """Everything a purge deletes, manifests and files together."""
    size = F.lit(None).cast("bigint")
    return (
        manifests.select(*SCOPE, F.lit("manifest").alias("kind"), "path", size.alias("size"))
        .unionByName(files.select(*SCOPE, F.lit("file").alias("kind"), "path", "size"))
    )


def purge_totals(report: DataFrame, by: Sequence[str] = (*SCOPE, "kind")) -> DataFrame:
    return report.groupBy(*by).agg(
        F.count("*").alias("paths"), F.coalesce(F.sum("size"), F.lit(0)).alias("reclaimed_bytes")
    )
