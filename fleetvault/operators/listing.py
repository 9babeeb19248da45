"""Directory views over a table of stored paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: suffix of the metadata file stored next to a content file.
SIDECAR = "-meta.json"


def is_sidecar(path: Column) -> Column:
    return path.endswith(SIDECAR)


def sidecar_of(path: Column) -> Column:
    return F.concat(path, F.lit(SIDECAR))


def _parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def directories(paths: DataFrame, path: str = "path") -> DataFrame:
    """Every directory above a stored file, once.

    Parents are made distinct first, so only directories fan out into their ancestors.
    """
    parents = paths.select(_parent(F.col(path)).alias("_dir")).filter("_dir != ''").distinct()
    parts = F.split("_dir", "/")
    ancestors = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")
    )
    return parents.select(F.explode(ancestors).alias("directory")).filter("directory != ''").distinct()


def _entry(name: Column, is_dir: bool) -> list[Column]:
    return [name.alias("entry"), F.lit(is_dir).alias("is_dir")]


def tree(paths: DataFrame, path: str = "path") -> DataFrame:
    """Every directory entry of the whole store: parent, name, is_dir; sidecars hidden.

    Paths are unique, so only the directories are made distinct.
    """
    files = paths.filter(~is_sidecar(F.col(path))).select(
        _parent(F.col(path)).alias("parent"),
        F.substring_index(F.col(path), "/", -1).alias("name"),
        F.lit(False).alias("is_dir"),
    )
    dirs = directories(paths, path).select(
        _parent(F.col("directory")).alias("parent"),
        F.substring_index("directory", "/", -1).alias("name"),
        F.lit(True).alias("is_dir"),
    )
    return files.unionByName(dirs)


def list_dir(
    paths: DataFrame,
    prefix: str,
    include_files: bool = True,
    include_dirs: bool = False,
    recursive: bool = False,
    path: str = "path",
) -> DataFrame:
    """Entries under a prefix: names of one level, or paths of the whole subtree.

    An empty prefix is the root of a store of relative paths, ``/`` that of absolute ones. The
    prefix test reaches the scan as a pushed filter. Listing files alone moves no rows.
    """
    root = prefix.rstrip("/") + "/" if prefix else ""
    below = paths.filter(F.col(path).startswith(root))
    visible = below.filter(~is_sidecar(F.col(path)))
    rest = F.substring(F.col(path), len(root) + 1, 2**31 - 1)
    if recursive:
        files = visible.select(_entry(F.col(path), False))
        inner = directories(below, path).filter(F.col("directory").startswith(root))
        dirs = inner.select(_entry(F.col("directory"), True))
    else:
        files = visible.filter(~rest.contains("/")).select(_entry(rest, False))
        first = F.substring_index(rest, "/", 1)
        dirs = below.filter(rest.contains("/")).select(_entry(first, True)).distinct()
    if include_files and include_dirs:
        return files.unionByName(dirs)
    if not include_files and not include_dirs:
        return files.limit(0)
    return files if include_files else dirs


def existing(paths: DataFrame, stored: DataFrame, on: str = "path") -> DataFrame:
    """The rows of ``paths`` that are in the store."""
    return paths.join(stored.select(on), on, "left_semi")
