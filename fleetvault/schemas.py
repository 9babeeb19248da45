"""Schemas of the catalogue relations (typed form and stored form).

Stored records are JSON whose leaves are all strings; ``stored_form`` derives that schema
from the typed one so the two cannot drift apart.
"""

from __future__ import annotations

from pyspark.sql import types as T


def _record(**fields: str | T.DataType) -> T.StructType:
    record = T.StructType()
    for name, kind in fields.items():
        record = record.add(name, kind)
    return record


STAT = _record(
    file_path="string",
    uid="integer",
    gid="integer",
    mode="integer",
    size="long",
    user="string",
    group="string",
)

COMPONENT = _record(
    file_path="string",
    keyspace="string",
    cf="string",
    version="string",
    generation="long",
    component="string",
    temporary="boolean",
    stat=STAT,
    is_deleted="boolean",
)

# The field name of the database release is part of the stored JSON format.
RELEASE_FIELD = "cassandra_version"

FILE_META = _record(
    **{"host": "string", "md5": "string", RELEASE_FIELD: "string", "component": COMPONENT}
)

MANIFEST = _record(
    host="string",
    keyspace="string",
    timestamp="timestamp_ntz",
    name="string",
    components=T.MapType(T.StringType(), T.ArrayType(COMPONENT)),
)

# The engine's own table of manifests; a large manifest is several parts.
CATALOGUE = _record(
    keyspace="string",
    host="string",
    day="date",
    ts="timestamp_ntz",
    part="integer",
    parts="integer",
    components=T.MapType(T.StringType(), T.ArrayType(COMPONENT)),
)

RESTORED_FILE = _record(
    was_restored="boolean",
    restore_path="string",
    backup_file=FILE_META,
    reason_skipped="string",
)

CHANGE_EVENT = _record(
    seq="long",
    ts="timestamp_ntz",
    host="string",
    kind="string",
    src_path="string",
    dest_path="string",
    size="long",
    is_initial="boolean",
)


def stored_form(dtype: T.DataType) -> T.DataType:
    """The same shape with every leaf a string."""
    if isinstance(dtype, T.StructType):
        return T.StructType([T.StructField(f.name, stored_form(f.dataType)) for f in dtype.fields])
    if isinstance(dtype, T.ArrayType):
        return T.ArrayType(stored_form(dtype.elementType))
    if isinstance(dtype, T.MapType):
        return T.MapType(T.StringType(), stored_form(dtype.valueType))
    return T.StringType()
