"""How many backups name a file, kept with the catalogue, so that a purge opens only what it removes.

Adding manifests adds to the counts of their files, removing them takes away. Each change is one
version of the store: a folder of sums per file, cut into ``BUCKETS`` buckets by a hash of the file,
written in overwrite mode, so a repeated change replaces itself. ``MERGE`` versions are merged into
one run of the next level, as in ``streaming.lifetimes``; files whose counts add up to nothing leave the oldest
run. The count of a file is the sum over the runs.

A purge asks only for the files that the removed manifests name and whose count is nothing after
that; for files that no manifest ever named, ``unnamed`` compares the store with one row per named
file instead of one per file and manifest.

A manifest that names a file twice, or that is stored in several parts, counts once. The caller
adds and removes each manifest once; versions are consecutive numbers from 0.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetvault.functions.paths import backup_file_name, base_name
from fleetvault.operators.listing import is_sidecar
from fleetvault.plans.retention import SCOPE
from fleetvault.storage import dropped_shuffles
from fleetvault.streaming import lifetimes

FILE = (*SCOPE, "file_name")
BUCKETS = 64
SLOT = "_slot"
SCHEMA = "host string, keyspace string, file_name string, backups long, bucket int"


def bucket_of() -> Column:
    return F.pmod(F.xxhash64(*FILE), F.lit(BUCKETS)).cast("int")


def named(components: DataFrame, sign: int = 1) -> DataFrame:
    """The files that backups (host, keyspace, ts) name, with a sign. A backup may name a file twice."""
    return components.select(*SCOPE, "ts", backup_file_name().alias("file_name"), F.lit(sign).cast("long").alias("backups"))


def _placed(rows: DataFrame) -> DataFrame:
    """Rows move once: to the task that makes those of a file distinct, sums them and writes their bucket.

    With many shuffle partitions a bucket is cut into slices, each a task and a file of its own.
    """
    slots = BUCKETS * max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // BUCKETS)
    slot = F.pmod(F.xxhash64(*FILE), F.lit(slots)).cast("int")
    dealt = rows.withColumn(SLOT, slot).withColumn("bucket", bucket_of())
    return dealt.repartitionById(slots, SLOT)


def _read(spark: SparkSession, store: str, places: list[tuple[int, int]]) -> DataFrame:
    reader = spark.read.schema(SCHEMA).option("basePath", f"{store}/counts")
    return reader.parquet(*[lifetimes.run_folder(store, "counts", *p) for p in places]).drop("level", "run")


def _sum(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    return rows.groupBy(*by).agg(F.sum("backups").alias("backups"))


def _write(placed: DataFrame, store: str, level: int, run: int) -> None:
    """The sums of rows that lie by slot; sums of nothing are left out."""
    told = _sum(placed, (*FILE, "bucket", SLOT)).filter("backups <> 0").drop(SLOT)
    with dropped_shuffles(placed.sparkSession):
        told.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(lifetimes.run_folder(store, "counts", level, run))


def apply(spark: SparkSession, store: str, version: int, added: DataFrame | None = None, removed: DataFrame | None = None) -> None:
    """Write one version: components of manifests that were added, and of manifests that were removed."""
    parts = [named(c, sign) for c, sign in ((added, 1), (removed, -1)) if c is not None]
    if not parts:
        raise ValueError("nothing to add and nothing to remove")
    told = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    _write(_placed(told).distinct(), store, 0, version)
    level = 1
    while (version + 1) % lifetimes.MERGE**level == 0:
        run = version // lifetimes.MERGE**level
        below = [(level - 1, n) for n in range(run * lifetimes.MERGE, (run + 1) * lifetimes.MERGE)]
        # Sums of nothing can go from any run: a missing row and a zero are the same.
        _write(_placed(_read(spark, store, below)), store, level, run)
        level += 1


def counts(spark: SparkSession, store: str, version: int) -> DataFrame:
    """Files that backups name after a version, with their number."""
    told = _read(spark, store, lifetimes.runs(version + 1)).drop("bucket").repartition(*FILE)  # a file comes once in a run
    return _sum(told, FILE).filter("backups > 0").select(*FILE, bucket_of().alias("bucket"), "backups")


def released(spark: SparkSession, store: str, version: int, removed: DataFrame) -> DataFrame:
    """Files (host, keyspace, file_name) of the removed manifests that no manifest names after the version."""
    asked = named(removed).select(*FILE).repartition(*FILE).distinct()
    return asked.join(counts(spark, store, version), list(FILE), "left_anti")


def expired(components: DataFrame, before: datetime) -> DataFrame:
    """The components of the manifests that a purge removes: those before the cutoff."""
    return components.filter(F.col("ts") < F.lit(before.isoformat(" ")).cast("timestamp_ntz"))


def _files(stored: DataFrame) -> DataFrame:
    """Stored files, their path cut into folder and file name, so that no part of it moves twice."""
    files = stored.filter(~is_sidecar(F.col("path"))).withColumn("file_name", base_name(F.col("path")))
    return files.withColumn("path", F.expr("left(path, length(path) - length(file_name))"))


def _whole(files: DataFrame) -> DataFrame:
    return files.withColumn("path", F.concat("path", "file_name")).drop("file_name")


def purge_files(stored: DataFrame, released_files: DataFrame) -> DataFrame:
    """Stored files among those released; sidecars go with their file."""
    return _whole(_files(stored).join(released_files, list(FILE), "left_semi"))


def unnamed(stored: DataFrame, counted: DataFrame) -> DataFrame:
    """All stored files that no manifest names, those never named included."""
    return _whole(_files(stored).join(counted.select(*FILE), list(FILE), "left_anti"))
