"""File inventories: a metadata-only scan, or a walk of shared mounts with ownership."""

from __future__ import annotations

import grp
import os
import pwd
from collections.abc import Iterator
from itertools import count, islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STAT_DDL = (
    "path string, uid int, gid int, mode int, size bigint, user string, `group` string, "
    "is_dir boolean"
)


# Entries of a crowded folder that a task holds at a time.
CHUNK = 10_000


def scan(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """Every file under ``root`` with size and time; file contents are not read.

    Ownership is unknown to the scan and comes as null columns. Spark's file sources leave
    out empty files; ``walk`` lists them.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    nothing = F.lit(None)
    return reader.load(root).select(
        F.regexp_replace("path", "^file:(//)?", "").alias("path"),
        nothing.cast("int").alias("uid"),
        nothing.cast("int").alias("gid"),
        nothing.cast("int").alias("mode"),
        F.col("length").alias("size"),
        nothing.cast("string").alias("user"),
        nothing.cast("string").alias("group"),
        F.col("modificationTime").cast("timestamp_ntz").alias("modified"),
    )


def _lister():
    """The listing function for tasks.

    It is made inside a function so that it travels to the executors whole; they need not
    have this package installed.
    """

    def account(lookup, key: int) -> str:
        try:
            return lookup(key)[0]
        except KeyError:
            return ""

    def entries(folder: str) -> Iterator[tuple]:
        try:
            listed = os.scandir(folder)
        except (FileNotFoundError, PermissionError):
            return
        for entry in listed:
            if entry.is_dir(follow_symlinks=False):
                yield entry.path, None, None, None, None, None, None, True
                continue
            try:
                # A link to a folder is no file, and following it may lead round in circles.
                if entry.is_dir():
                    continue
                stat = entry.stat()
            except OSError:
                continue
            user, group = account(pwd.getpwuid, stat.st_uid), account(grp.getgrgid, stat.st_gid)
            yield entry.path, stat.st_uid, stat.st_gid, stat.st_mode, stat.st_size, user, group, False

    def list_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "uid", "gid", "mode", "size", "user", "group", "is_dir"]
        numbers = {"uid": "Int32", "gid": "Int32", "mode": "Int32", "size": "Int64"}
        for batch in batches:
            for folder in batch["path"]:
                listed = entries(folder)
                while chunk := list(islice(listed, CHUNK)):
                    yield pd.DataFrame(chunk, columns=columns).astype(numbers)

    return list_batches


def walk(folders: DataFrame, table_root: str) -> DataFrame:
    """Full file stats below the given folders (column path) of a mount all executors see.

    The tree is listed level by level: one task lists a folder, the next level is spread over
    the cluster again. Each level is written below ``table_root``, so a lost executor costs
    its own folders only. Stops at the first level without folders. Links to folders are not
    followed; folders that may not be read, and files that vanish meanwhile, are left out.
    """
    spark = folders.sparkSession
    level = folders.select("path")
    tables: list[str] = []
    for number in count():
        table = f"{table_root}/level={number}"
        listed = level.repartition(F.col("path")).mapInPandas(_lister(), STAT_DDL)
        listed.write.mode("overwrite").parquet(table)
        tables.append(table)
        level = spark.read.parquet(table).filter("is_dir").select("path")
        if level.isEmpty():
            break
    return spark.read.parquet(*tables).filter("NOT is_dir").drop("is_dir")
