"""Component file names, backup paths, backup names and format versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetvault.functions import times

DEFAULT_RELEASE = "1.2.0"

# Fixed values of the on-disk naming scheme.
TEMPORARY_MARKER = "tmp"
SNAPSHOT_DIR = "snapshots"
KEYSPACE_IN_NAME_SINCE = (1, 1, 0)
DATA_COMPONENT = "Data.db"

# File format code -> database release that introduced it.
FORMAT_RELEASES = {
    "a": "0.6.0",
    "b": "0.7.0",
    "c": "0.7.0",
    "d": "0.7.0",
    "e": "0.7.0",
    "f": "0.7.0",
    "g": "0.8.0",
    "h": "1.0.0",
    "hb": "1.0.3",
    "hc": "1.0.4",
    "hd": "1.0.10",
    "he": "1.1.3",
    "hf": "1.1.6",
    "ia": "1.2.0",
    "ib": "1.2.1",
}

SSTABLE = ("keyspace", "cf", "version", "generation")


# -- releases ------------------------------------------------------------------------------


def parse_release(text: Column) -> Column:
    """``1.2.0.1`` -> ``[1, 2, 0]``; arrays compare part by part. Null when a part is no number."""
    parts = F.transform(F.slice(F.split(text, r"\."), 1, 3), lambda p: p.try_cast("int"))
    return F.when(F.forall(parts, lambda p: p.isNotNull()), parts)


def release_column(release: str | Column) -> Column:
    """A target release given once for the job or per row as text."""
    return parse_release(F.lit(release) if isinstance(release, str) else release)


def _by_layout(release: str | Column, nested, flat):
    """``nested`` for releases with the keyspace in the file name, else ``flat``."""
    if isinstance(release, str):
        number = tuple(int(part) for part in release.split(".")[:3])
        return nested if number >= KEYSPACE_IN_NAME_SINCE else flat
    since = F.array(*[F.lit(part) for part in KEYSPACE_IN_NAME_SINCE])
    return F.when(release_column(release) >= since, nested).otherwise(flat)


def format_release(version: Column) -> Column:
    """Release that introduced a file format; only its first two characters count."""
    table = F.create_map(*[F.lit(x) for pair in FORMAT_RELEASES.items() for x in pair])
    return F.try_element_at(table, F.substring(version, 1, 2))


# -- parsing -------------------------------------------------------------------------------


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def is_snapshot(path: Column) -> Column:
    """True when any directory of the path is the snapshots directory."""
    return path.rlike(f"(^|/){SNAPSHOT_DIR}/")


def _name_patterns(leading: int) -> tuple[str, str]:
    """Patterns of a data file name and of one whose version token is wrong.

    ``leading`` tokens come before the version; a temporary marker in between always counts
    as the marker (possessive group). Tokens after the component are ignored.
    """
    head = "^" + "-".join(["[^-]*"] * leading) + f"(?:-{TEMPORARY_MARKER}(?=-|$))?+-"
    return head + r"[a-z][^-]*-\s*\+?[0-9]+\s*-[^-]*", head + "(?![a-z])"


def with_component(
    df: DataFrame, path: str = "path", release: str | Column = DEFAULT_RELEASE
) -> DataFrame:
    """Add keyspace, cf, version, generation, component, temporary and parse_error.

    ``parse_error`` is null, ``not_data_file``, ``invalid_version``, or ``generation_overflow`` for
    a data file whose generation is no bigint. The other columns are null for a path that cannot
    be parsed; an overflow lacks its generation only. The name is matched and split once per row: the
    columns come out of a one-row generator, so that filters on them are not rewritten into
    further matches of the path.
    """
    source = F.col(path)
    name = base_name(source)

    def match(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(name, pattern, 0), F.lit(""))

    (good2, bad2), (good1, bad1) = _name_patterns(2), _name_patterns(1)
    # A flat name takes its keyspace from the folder, so it needs one.
    flat = F.when(source.contains("/"), match(good1))
    read = df.withColumn("_tok", F.split(_by_layout(release, match(good2), flat), "-"))
    wrong_version = _by_layout(release, name.rlike(bad2), name.rlike(bad1))
    tokens = F.col("_tok")
    cf_at = _by_layout(release, F.lit(1), F.lit(0))
    temporary = F.get(tokens, cf_at + 1) == TEMPORARY_MARKER
    version_at = cf_at + 1 + temporary.cast("int")
    folder = F.regexp_extract(source, r"([^/]*)/+[^/]*$", 1)
    error = F.when(wrong_version, "invalid_version").otherwise("not_data_file")
    generation = F.trim(F.get(tokens, version_at + 1)).try_cast("bigint")
    parsed = F.struct(
        _by_layout(release, F.get(tokens, F.lit(0)), F.when(tokens.isNotNull(), folder)).alias("keyspace"),
        F.get(tokens, cf_at).alias("cf"),
        F.get(tokens, version_at).alias("version"),
        generation.alias("generation"),
        F.get(tokens, version_at + 2).alias("component"),
        temporary.alias("temporary"),
        F.when(tokens.isNull(), error).when(generation.isNull(), "generation_overflow").alias("parse_error"),
    )
    kept = [c for c in df.columns if c not in parsed_columns()]
    return read.select(*kept, F.inline(F.array(parsed)))


def parsed_columns() -> tuple[str, ...]:
    return (*SSTABLE, "component", "temporary", "parse_error")


# -- names and paths -----------------------------------------------------------------------


def backup_file_name() -> Column:
    """``keyspace-cf-version-generation-component``, whatever the target release."""
    return F.concat_ws("-", "keyspace", "cf", "version", "generation", "component")


def file_name(release: str | Column = DEFAULT_RELEASE) -> Column:
    """File name under the target release; older ones leave the keyspace out."""
    short = F.concat_ws("-", "cf", "version", "generation", "component")
    return _by_layout(release, backup_file_name(), short)


def backup_path() -> Column:
    return F.concat_ws("/", F.lit("hosts"), "host", "keyspace", "cf", backup_file_name())


def restore_path(release: str | Column = DEFAULT_RELEASE) -> Column:
    """Path below the data directory; older releases have no column-family directory."""
    nested = F.concat_ws("/", "keyspace", "cf", file_name(release))
    flat = F.concat_ws("/", "keyspace", file_name(release))
    return _by_layout(release, nested, flat)


def quarantine_path(data_dir: str, quarantine: str, name: Column) -> Column:
    """Where an existing corrupt target is moved: next to the data directory."""
    return F.concat_ws("/", F.lit(data_dir), F.lit(".."), F.lit(quarantine), "keyspace", name)


def host_keyspace_dir() -> Column:
    return F.concat_ws("/", F.lit("hosts"), "host", "keyspace")


def cluster_keyspace_dir() -> Column:
    return F.concat_ws("/", F.lit("cluster"), "keyspace")


def manifest_day_dir(ts: Column) -> Column:
    """``cluster/keyspace/year/month/day/host`` with unpadded numbers."""
    return F.concat_ws(
        "/", cluster_keyspace_dir(), F.year(ts), F.month(ts), F.dayofmonth(ts), "host"
    )


def backup_name(ts: Column) -> Column:
    return F.concat_ws("-", times.safe_text(ts), "keyspace", "host")


def manifest_path(ts: Column) -> Column:
    return F.concat(manifest_day_dir(ts), F.lit("/"), backup_name(ts), F.lit(".json"))


def parse_backup_name(name: Column) -> Column:
    """Struct (ts, keyspace, host); null for a malformed name. Hosts may contain ``-``."""
    parts = F.split(name, "-", 3)
    ts = times.parse_safe(F.get(parts, F.lit(0)))
    return F.when(
        (F.size(parts) == 3) & ts.isNotNull(),
        F.struct(
            ts.alias("ts"),
            F.get(parts, F.lit(1)).alias("keyspace"),
            F.get(parts, F.lit(2)).alias("host"),
        ),
    )


def parse_backup_path(path: Column) -> Column:
    """``parse_backup_name`` of a manifest path: directories and extension removed."""
    return parse_backup_name(F.regexp_replace(base_name(path), r"\.[^.]*$", ""))


def sstable_key(columns: Sequence[str] = SSTABLE) -> Column:
    return F.struct(*columns)


def prefixed_key(key: Column, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix + "/"), key) if prefix else key


def without_prefix(key: Column, prefix: str = "") -> Column:
    """Inverse of ``prefixed_key``, so listings and kept paths are comparable."""
    if not prefix:
        return key
    head = prefix + "/"
    return F.when(key.startswith(head), F.substring(key, len(head) + 1, 2**31 - 1)).otherwise(key)
