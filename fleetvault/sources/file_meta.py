"""Recorded metadata of stored files: sidecar documents and object key metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetvault.functions import records
from fleetvault.operators.listing import SIDECAR
from fleetvault.schemas import FILE_META, stored_form

CORRUPT = "_corrupt_record"
# A compressed file is read by one task, so it holds a bounded number of documents.
FILE_ROWS = 1_000_000
_STORED = T.StructType([*stored_form(FILE_META).fields, T.StructField(CORRUPT, T.StringType())])


def _typed(raw: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    fields = [
        records.from_stored(F.col(f.name), f.dataType, f.name).alias(f.name)
        for f in FILE_META.fields
    ]
    return raw.select(*fields, *extra)


def read(spark: SparkSession, root: str, pattern: str = f"*{SIDECAR}") -> DataFrame:
    """Metadata documents below ``root``, plain or compressed; use pattern ``*.json`` for a table of this library."""
    raw = (
        spark.read.schema(_STORED)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", f"{{{pattern},{pattern}.gz}}")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(root)
    )
    return _typed(raw, (CORRUPT,))


def stored(meta: DataFrame) -> DataFrame:
    """Typed metadata rows in stored form."""
    return meta.select(
        *[records.to_stored(F.col(f.name), f.dataType, f.name).alias(f.name) for f in FILE_META.fields]
    )


def write(meta: DataFrame, root: str, mode: str = "append") -> None:
    """One JSON document per line, compressed."""
    writer = stored(meta).write.mode(mode).option("maxRecordsPerFile", FILE_ROWS)
    writer.json(root, compression="gzip")


def to_object_metadata(meta: DataFrame) -> Column:
    """Flat key metadata of rows in stored form, for a store that keeps it with the object."""
    record = F.struct(*[F.col(f.name) for f in FILE_META.fields])
    return records.flatten_meta(record, stored_form(FILE_META))


def from_object_metadata(objects: DataFrame, metadata: str = "metadata") -> DataFrame:
    """Rows with a flat ``metadata`` map -> typed file metadata."""
    nested = records.unflatten_meta(F.col(metadata), stored_form(FILE_META))
    return _typed(objects.select(nested.alias("_m")).select("_m.*"))
