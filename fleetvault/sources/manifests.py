"""Manifest documents: a tree of JSON files, the same as a partitioned table, or the columnar catalogue
that the operators read."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetvault.functions import records
from fleetvault.functions.paths import backup_name
from fleetvault.schemas import CATALOGUE, MANIFEST, STAT, stored_form

CORRUPT = "_corrupt_record"
# The table repeats keyspace and host as folder columns, so that the documents stay whole.
FOLDERS = ("in_keyspace", "year", "month", "day", "on_host")

_STORED = T.StructType([*stored_form(MANIFEST).fields, T.StructField(CORRUPT, T.StringType())])
_FOLDER_TYPES = {"year": "integer", "month": "integer", "day": "integer"}


def _typed(raw: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    fields = [
        records.from_stored(F.col(f"`{f.name}`"), f.dataType, f.name).alias(f.name)
        for f in MANIFEST.fields
    ]
    return raw.select(*fields, *extra, CORRUPT).withColumnRenamed("timestamp", "ts")


def read_tree(
    spark: SparkSession,
    root: str,
    keyspace: str | None = None,
    host: str | None = None,
    day: date | None = None,
) -> DataFrame:
    """Documents below ``root/cluster/<keyspace>/<year>/<month>/<day>/<host>``.

    Documents may be compressed (``.json.gz``). Given parts narrow the folders that are listed at all. A document that cannot be read has
    its text in ``_corrupt_record`` and nulls elsewhere. A folder that does not exist raises
    Spark's path-not-found error.
    """
    when = [str(day.year), str(day.month), str(day.day)] if day else ["*", "*", "*"]
    parts = [keyspace or "*", *when, host or "*"]
    while parts and parts[-1] == "*":
        parts.pop()
    path = "/".join([root.rstrip("/"), "cluster", *parts])
    raw = (
        spark.read.schema(_STORED)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.{json,json.gz}")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(path)
    )
    return _typed(raw)


def read_table(
    spark: SparkSession, root: str, folders: Sequence[str] = FOLDERS
) -> DataFrame:
    """Manifests written by ``write_table``; filters on the folder columns skip folders."""
    schema = T.StructType(list(_STORED.fields))
    for name in folders:
        schema = schema.add(name, _FOLDER_TYPES.get(name, "string"))
    raw = spark.read.schema(schema).option("columnNameOfCorruptRecord", CORRUPT).json(root)
    return _typed(raw, tuple(folders))


def placed(manifests: DataFrame) -> DataFrame:
    """Typed manifests with the folders they lie in."""
    ts = F.col("ts")
    return manifests.select(
        "host",
        "keyspace",
        "ts",
        "components",
        F.col("keyspace").alias("in_keyspace"),
        F.year(ts).alias("year"),
        F.month(ts).alias("month"),
        F.dayofmonth(ts).alias("day"),
        F.col("host").alias("on_host"),
    )


def documents(manifests: DataFrame) -> DataFrame:
    """Nested manifests (host, keyspace, ts, components) in stored form."""
    return _documents(placed(manifests))


def _documents(rows: DataFrame) -> DataFrame:
    typed = rows.withColumn("name", backup_name(F.col("ts"))).withColumnRenamed("ts", "timestamp")
    fields = [
        records.to_stored(F.col(f.name), f.dataType, f.name).alias(f.name) for f in MANIFEST.fields
    ]
    return typed.select(*fields, *FOLDERS)


def write_table(
    manifests: DataFrame, root: str, mode: str = "append", folders: Sequence[str] = FOLDERS
) -> None:
    """One JSON document per line, compressed, in keyspace / year / month / day / host folders.

    Fewer folders suit small fleets: on a local disk a folder costs far more than its documents. The rebalance hint gathers the rows of a folder and lets
    Spark split a large one; rows move typed, before they are written out as text.
    """
    docs = _documents(placed(manifests).hint("rebalance", *folders))
    unused = [name for name in FOLDERS if name not in folders]
    docs.drop(*unused).write.mode(mode).partitionBy(*folders).json(root, compression="gzip")


def write_catalogue(
    manifests: DataFrame,
    root: str,
    mode: str = "append",
    folders: Sequence[str] = ("keyspace", "host", "day"),
) -> None:
    """Typed manifests (host, keyspace, ts, components, part, parts) as parquet.

    The folder columns are the manifests' own, so a lookup by keyspace, host, day or backup name
    opens the folders it needs. Within a file ``day`` and ``ts`` have ranges that skip row groups.
    """
    dated = manifests.withColumn("day", F.to_date("ts"))
    sorted_ = dated.hint("rebalance", *folders).sortWithinPartitions(*folders, "ts")
    sorted_.write.mode(mode).partitionBy(*folders).parquet(root)


def read_catalogue(spark: SparkSession, root: str, schema: T.StructType = CATALOGUE) -> DataFrame:
    """The catalogue; columns that the files lack are null. Keys keep their type, whatever they
    look like."""
    return spark.read.schema(schema).parquet(root)


def component_struct() -> Column:
    """The component record of a flat row (file_path, names, ownership columns)."""
    return F.struct(
        "file_path",
        "keyspace",
        "cf",
        "version",
        "generation",
        "component",
        "temporary",
        F.struct(*[F.col(n) for n in STAT.fieldNames()]).alias("stat"),
        "is_deleted",
    )
