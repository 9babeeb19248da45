"""The tasks of a backup operator, each over the whole fleet or one named backup.

Relations: ``manifests`` is nested (host, keyspace, ts, components), ``meta`` and ``stored``
are files (host, keyspace, path, md5, size), ``targets`` are files on the hosts (host,
restore_path, md5).
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetvault.functions.paths import DEFAULT_RELEASE, backup_path
from fleetvault.functions.times import parse_input_value, utc_now
from fleetvault.operators import gates, manifests as listing, usage
from fleetvault.plans import restore as restoring
from fleetvault.plans import retention, upload
from fleetvault.plans import validate as validating


def _components(manifests: DataFrame, name: str | None) -> DataFrame:
    chosen = listing.one_by_name(manifests, name) if name else manifests
    return listing.explode(chosen)


def _sized(rows: DataFrame) -> DataFrame:
    return rows if "size" in rows.columns else rows.withColumn("size", F.col("stat.size"))


def backup(
    files: DataFrame,
    stored: DataFrame,
    release: str | Column = DEFAULT_RELEASE,
    excluded: Sequence[str] = (),
    include_system: bool = False,
) -> DataFrame:
    """Upload plan for an inventory (host, path, md5, size) of data directories.

    Ineligible files are left out; ``path`` becomes the backup path and the original goes to
    ``file_path``.
    """
    chosen = gates.eligible(
        files, release=release, excluded=excluded, include_system=include_system
    )
    named = chosen.withColumnRenamed("path", "file_path").withColumn("path", backup_path())
    return upload.upload_plan(named.withColumn("is_deleted", F.lit(False)), stored)


def list_backups(
    manifests: DataFrame,
    keyspace: str,
    host: str,
    day: str | date | None = None,
    list_all: bool = False,
    zone: str = "UTC",
) -> DataFrame:
    """Backups of a UTC day, by default today's most recent one.

    A text is read as a local time in ``zone``, which may fall on another UTC day.
    """
    if day is None:
        day = utc_now().date()
    elif isinstance(day, str):
        local = parse_input_value(day).replace(tzinfo=ZoneInfo(zone))
        day = local.astimezone(timezone.utc).date()
    return listing.listed(manifests, keyspace, host, day, list_all)


def size(manifests: DataFrame, name: str) -> DataFrame:
    """Files and bytes of a backup."""
    return listing.sizes(_sized(_components(manifests, name)))


def show(manifests: DataFrame, name: str, release: str | Column = DEFAULT_RELEASE) -> DataFrame:
    """Files of a backup by column family, with sizes."""
    return listing.contents(_sized(_components(manifests, name)), release)


def validate(
    manifests: DataFrame,
    meta: DataFrame,
    stored: DataFrame,
    name: str | None = None,
    checksum: bool = False,
) -> DataFrame:
    """Status of every file of a backup, or of all backups."""
    return validating.validate(_components(manifests, name), meta, stored, checksum)


def restore(
    manifests: DataFrame,
    meta: DataFrame,
    stored: DataFrame,
    targets: DataFrame,
    name: str,
    checksum: bool = True,
    **options,
) -> DataFrame:
    """What happens to every file of a backup, and how it ends."""
    recorded = meta.select("path", "md5", *[c for c in ("written",) if c in meta.columns])
    wanted = _components(manifests, name).drop("md5")
    files = validating.component_meta(wanted, recorded).drop("path")
    plan = restoring.restore_plan(files, targets, checksum=checksum, **options)
    return restoring.restore_outcome(plan, stored, checksum)


def purge(
    manifests: DataFrame,
    stored: DataFrame,
    manifest_paths: DataFrame,
    keyspace: str | None = None,
    host: str | None = None,
    purge_before: str | datetime | None = None,
    keep_days: int | None = None,
    as_of: datetime | None = None,
) -> DataFrame:
    """Everything to delete: manifests before the cutoff and files only they refer to."""
    before = retention.cutoff(purge_before, keep_days, as_of)

    def part(df: DataFrame) -> DataFrame:
        return retention.scoped(df, keyspace, host)

    components = listing.explode(retention.kept(part(manifests), before))
    files = retention.purge_files(part(stored), components, before)
    gone = retention.purge_manifests(part(manifest_paths), part(manifests), before)
    return retention.purge_report(files, gone)


def usage_report(
    log: DataFrame,
    extrapolate_to: datetime | None = None,
    show_extrapolations: bool = False,
    by: Sequence[str] = usage.HOST,
) -> tuple[DataFrame, DataFrame]:
    """Hours to show and the bill per month; extrapolated to now (UTC) unless told otherwise."""
    hours = usage.hourly_usage(log, by, extrapolate_to or utc_now())
    return usage.shown_hours(hours, show_extrapolations), usage.monthly_usage(hours, by)
