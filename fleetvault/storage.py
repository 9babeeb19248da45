"""Where jobs put intermediate tables and streaming checkpoints."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_fallback: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting (a unit test) gets a private folder; on a cluster
    executors would each write to a folder of their own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        _fallback[app] = tempfile.mkdtemp(prefix="fleetvault-")
    return _fallback[app]


def run_dir(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def dropped_shuffles(spark: SparkSession) -> Iterator[None]:
    """Jobs in this block leave no shuffle files behind; else they lie until the driver collects its garbage.

    For writes, of which only the written files are read again.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored_once(rows: DataFrame, label: str, **options: str) -> DataFrame:
    """The same rows, read from a copy written now. Small as it is on disk, it may be large in memory."""
    spark = rows.sparkSession
    path = run_dir(spark, label)
    with dropped_shuffles(spark):
        rows.write.parquet(path, **options)
    return spark.read.schema(rows.schema).parquet(path)
