"""Records between their typed form, their stored string form, JSON and flat key metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetvault.functions.times import iso_text, parse_iso
from fleetvault.schemas import stored_form

# Fixed values of the stored format.
KEY_SEPARATOR = "|"
NO_VALUE = "None"
CAPITALISED_FLAGS = ("temporary",)
NULLABLE_TEXT = ("user", "group")


def _fields(col: Column, dtype: T.StructType, convert) -> Column:
    return F.struct(*[convert(col[f.name], f.dataType, f.name).alias(f.name) for f in dtype.fields])


def to_stored(col: Column, dtype: T.DataType, name: str = "") -> Column:
    """Typed value -> the same shape with string leaves."""
    if isinstance(dtype, T.StructType):
        return _fields(col, dtype, to_stored)
    if isinstance(dtype, T.ArrayType):
        return F.transform(col, lambda x: to_stored(x, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return F.transform_values(col, lambda _, v: to_stored(v, dtype.valueType))
    if isinstance(dtype, T.BooleanType):
        text = col.cast("string")
        return F.initcap(text) if name in CAPITALISED_FLAGS else text
    if name in NULLABLE_TEXT:
        return F.coalesce(col, F.lit(NO_VALUE))
    if isinstance(dtype, T.TimestampNTZType):
        return iso_text(col)
    return col.cast("string")


def from_stored(col: Column, dtype: T.DataType, name: str = "") -> Column:
    """Inverse of ``to_stored``; a leaf that cannot be read becomes null."""
    if isinstance(dtype, T.StructType):
        return _fields(col, dtype, from_stored)
    if isinstance(dtype, T.ArrayType):
        return F.transform(col, lambda x: from_stored(x, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return F.transform_values(col, lambda _, v: from_stored(v, dtype.valueType))
    if isinstance(dtype, T.BooleanType):
        return F.lower(col) == "true"
    if isinstance(dtype, T.TimestampNTZType):
        return parse_iso(col)
    if name in NULLABLE_TEXT:
        return F.nullif(col, F.lit(NO_VALUE))
    if isinstance(dtype, T.StringType):
        return col
    return col.try_cast(dtype)


def to_json(col: Column, dtype: T.DataType) -> Column:
    return F.to_json(to_stored(col, dtype), {"ignoreNullFields": "false"})


def from_json(text: Column, dtype: T.DataType) -> Column:
    """Typed value of a JSON text. The text is parsed once: as the argument of a function it is not
    copied into every leaf, where Spark would parse it anew for each."""
    parsed = F.array(F.from_json(text, stored_form(dtype)))
    return F.get(F.transform(parsed, lambda record: from_stored(record, dtype)), F.lit(0))


def _flat_leaves(col: Column, dtype: T.DataType, key: str) -> list[tuple[str, Column]]:
    if isinstance(dtype, T.StructType):
        found = []
        for f in dtype.fields:
            if KEY_SEPARATOR in f.name:
                raise ValueError(f"a key cannot contain '{KEY_SEPARATOR}': {f.name}")
            child = f"{key}{KEY_SEPARATOR}{f.name}" if key else f.name
            found += _flat_leaves(col[f.name], f.dataType, child)
        return found
    if not isinstance(dtype, T.StringType):
        raise ValueError(f"flat metadata holds strings only, {key} is {dtype.simpleString()}")
    return [(key, col)]


def flatten_meta(col: Column, dtype: T.StructType) -> Column:
    """Nested string record -> one-level map with keys such as ``component|stat|size``."""
    leaves = _flat_leaves(col, dtype, "")
    return F.create_map(*[part for key, value in leaves for part in (F.lit(key), value)])


def unflatten_meta(flat: Column, dtype: T.StructType, key: str = "") -> Column:
    """Inverse of ``flatten_meta`` for a known record shape; absent keys become null."""
    made = []
    for f in dtype.fields:
        child = f"{key}{KEY_SEPARATOR}{f.name}" if key else f.name
        if isinstance(f.dataType, T.StructType):
            value = unflatten_meta(flat, f.dataType, child)
        else:
            value = F.try_element_at(flat, F.lit(child))
        made.append(value.alias(f.name))
    return F.struct(*made)
