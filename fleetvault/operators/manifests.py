"""Manifests: nested and flat form, listings, contents and sizes."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetvault.functions.paths import (
    DEFAULT_RELEASE,
    backup_file_name,
    backup_name,
    file_name,
    parse_backup_name,
)
from fleetvault.functions.sizes import human_bytes
from fleetvault.storage import run_dir

KEY = ("host", "keyspace", "ts")
DAY = ("keyspace", "host", "day")
PART_FILES = 100_000
# With parts of at least so many files the keys of several parts are a small table.
SENT_FROM = 10_000


def build(
    components: DataFrame,
    body: Sequence[str],
    key: Sequence[str] = KEY,
    part_files: int = PART_FILES,
) -> DataFrame:
    """Flat component rows -> one nested manifest per key: ``components`` maps cf to a list.

    A manifest with more than ``part_files`` files becomes several rows numbered by ``part``
    (of ``parts``), so that no single row has to hold an unbounded list; ``explode`` and the
    listings do not care. Files are counted within the query, for every key. Only keys of several
    parts, of which there is at most one per ``part_files`` rows, meet the rows in a join; with large
    parts they are so few that they are sent to the rows, and these move once, to (key, part).
    """
    parts = F.ceil(F.count("*") / part_files).cast("int").alias("_parts")
    large = components.groupBy(*key).agg(parts).filter("_parts > 1")
    if part_files >= SENT_FROM:
        large = F.broadcast(large)
    same = [components[k].eqNullSafe(large[k]) for k in key]
    found = F.coalesce("_parts", F.lit(1)).alias("parts")
    sized = components.join(large, same, "left").select(components["*"], found)
    part = F.pmod(F.xxhash64("cf", *body), F.col("parts")).cast("int")
    placed = sized.withColumn("part", part).repartition(*key, "part")
    # Rows lie by (key, part) already, so neither level of grouping moves them again.
    lists = placed.groupBy(*key, "parts", "part", "cf").agg(F.collect_list(F.struct(*body)).alias("_files"))
    entries = F.collect_list(F.struct("cf", "_files"))
    return lists.groupBy(*key, "parts", "part").agg(F.map_from_entries(entries).alias("components"))


def explode(manifests: DataFrame, keep: Sequence[str] = KEY) -> DataFrame:
    """Nested manifests -> one row per component."""
    lists = manifests.select(*keep, F.explode("components").alias("cf", "files"))
    names = [f.name for f in lists.schema["files"].dataType.elementType.fields]
    rows = lists.select(*keep, "cf", F.explode("files").alias("_file"))
    own = [F.col("_file")[n].alias(n) for n in names if n not in {*keep, "cf"}]
    return rows.select(*keep, "cf", *own)


def contents(
    components: DataFrame, release: str | Column = DEFAULT_RELEASE, ordered: bool = True
) -> DataFrame:
    """What a ``show`` lists: backups, their files by column family, then by name, with readable sizes.

    The order is made by ranges, so that a very large backup lies in several tasks.
    """
    shown = components.withColumn("backup_file_name", backup_file_name())
    shown = shown.withColumn("human_size", human_bytes(F.col("size")))
    return shown.orderBy(*KEY, "cf", file_name(release), "backup_file_name") if ordered else shown


def positions(rows: DataFrame, order: Sequence[str], key: Sequence[str] = KEY, at: str = "position") -> DataFrame:
    """Add the place, from 1, of each row within its ``key`` when sorted by ``order``.

    Rows are dealt by ranges of (key, order) and written to the shared folder, with the number of
    their range. Ranges are in order, so a place is the rows of the key's earlier ranges plus the
    place within the range. No task needs all rows of a key, however many there are. Rows equal in
    key and order lie in one range; their places are in any order. Null keys are keys.
    """
    spark, slice_ = rows.sparkSession, "_slice"
    path = run_dir(spark, "positions")
    rows.repartitionByRange(*key, *order).withColumn(slice_, F.spark_partition_id()).write.parquet(path)
    placed = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField(slice_, T.IntegerType())])).parquet(path)
    held = placed.groupBy(*key, slice_).agg(F.count("*").alias("_rows"))
    earlier = Window.partitionBy(*key).orderBy(slice_).rowsBetween(Window.unboundedPreceding, -1)
    before = held.select(
        *[F.col(k).alias(f"_key{i}") for i, k in enumerate(key)],
        F.col(slice_).alias("_range"),
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
    )
    own = F.row_number().over(Window.partitionBy(*key, slice_).orderBy(*order))
    same = [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(key)]
    found = placed.withColumn("_own", own).join(before, [*same, F.col(slice_) == F.col("_range")])
    return found.select(*rows.columns, (F.col("_before") + F.col("_own")).cast("long").alias(at))


def sizes(components: DataFrame, by: Sequence[str] = KEY) -> DataFrame:
    """Files and bytes per backup (or per backup and column family)."""
    total = components.groupBy(*by).agg(
        F.count("*").alias("files"), F.sum("size").alias("total_size")
    )
    return total.withColumn("human_size", human_bytes(F.col("total_size")))


def has_days(manifests: DataFrame) -> bool:
    """Whether the rows carry their UTC day, as those of the catalogue do."""
    return "day" in manifests.columns and manifests.schema["day"].dataType == T.DateType()


def named(manifests: DataFrame) -> DataFrame:
    """Add the backup's name and its day; a stored day stays, so that filters on it skip folders."""
    found = manifests.withColumn("name", backup_name(F.col("ts")))
    return found if has_days(manifests) else found.withColumn("day", F.to_date("ts"))


def backups(manifests: DataFrame) -> DataFrame:
    """One row per backup, without its files, however many parts it is stored in."""
    files = [c for c in ("components", "part", "parts") if c in manifests.columns]
    return manifests.drop(*files).dropDuplicates(list(KEY))


def latest(manifests: DataFrame, by: Sequence[str] = DAY) -> DataFrame:
    """The most recent backup per group; an aggregate, so it combines before it moves."""
    newest = named(manifests).groupBy(*by).agg(F.max(F.struct("ts", "name")).alias("_last"))
    return newest.select(*by, "_last.ts", "_last.name")


def listed(
    manifests: DataFrame,
    keyspace: str | None = None,
    host: str | None = None,
    day: date | None = None,
    list_all: bool = True,
) -> DataFrame:
    """Backups in time order, or only the most recent one per keyspace, host and day."""
    chosen = named(manifests)
    for name, value in (("keyspace", keyspace), ("host", host), ("day", day)):
        if value is not None:
            chosen = chosen.filter(F.col(name) == F.lit(value))
    if not list_all:
        chosen = latest(chosen)
    shown = chosen.select("keyspace", "host", "day", "ts", "name").distinct()
    return shown.orderBy("keyspace", "host", "ts", "name")


def for_days(manifests: DataFrame, requests: DataFrame) -> DataFrame:
    """All backups of the requested (keyspace, host, day) rows, one row each."""
    found = named(manifests).join(requests.select(*DAY).distinct(), list(DAY), "left_semi")
    return backups(found)


def by_name(manifests: DataFrame, names: DataFrame, name: str = "name") -> DataFrame:
    """The backups with the requested names, one row each; malformed names find nothing."""
    return backups(parts_by_name(manifests, names, name))


def parts_by_name(manifests: DataFrame, names: DataFrame, name: str = "name") -> DataFrame:
    """The stored rows, with their files, of the backups with the requested names.

    The name is parsed into (keyspace, host, ts) so the join can use the manifest's own keys.
    """
    parsed = names.select(parse_backup_name(F.col(name)).alias("_p")).filter("_p IS NOT NULL")
    keys = parsed.select("_p.keyspace", "_p.host", "_p.ts").distinct()
    on = ["keyspace", "host", "ts"]
    if has_days(manifests):
        keys, on = keys.withColumn("day", F.to_date("ts")), [*on, "day"]
    return manifests.join(keys, on, "left_semi")


def one_by_name(manifests: DataFrame, name: str) -> DataFrame:
    """``parts_by_name`` for a single name given by the user, as plain filters."""
    wanted = parse_backup_name(F.lit(name))
    found = manifests.filter(
        (F.col("keyspace") == wanted["keyspace"])
        & (F.col("host") == wanted["host"])
        & (F.col("ts") == wanted["ts"])
    )
    return found.filter(F.col("day") == F.to_date(wanted["ts"])) if has_days(manifests) else found
