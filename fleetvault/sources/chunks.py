"""File bodies of any size as numbered parts: read, digest, keep and restore without holding a file.

A part row has the file's ``path`` and ``size``, the ``part`` number from 1, its ``offset`` and its
``body`` of at most ``part_bytes``; an empty file has one empty part. Parts of a file are read by as
many tasks as it has parts. What needs them in order (a digest, a file written back) takes them
sorted through one task, part by part, so its memory is that of one Arrow batch however large the
file is.

A repeated part counts once. A file with parts missing has no digest and is not written.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetvault.functions.sizes import CHUNK_MB, MAX_UPLOAD_MB, MIB

PART_BYTES = 4 * MIB
BLOCK_BYTES = MIB
PART = "path string, size long, part long, offset long, body binary"
DIGEST = "path string, size long, md5 string, tag string"


def ranges(files: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """Part rows of ``files`` (path, size) without their bodies."""
    if part_bytes < 1:
        raise ValueError("a part has one byte at least")
    size = F.col("size").cast("bigint")
    last = F.greatest(F.ceil(size / part_bytes).cast("bigint"), F.lit(1).cast("bigint"))
    parts = files.select("path", size.alias("size"), F.explode(F.sequence(F.lit(1).cast("bigint"), last)).alias("part"))
    return parts.withColumn("offset", (F.col("part") - 1) * part_bytes)


def cut(content: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """Bodies that are values (path, content) as part rows; a null body has none."""
    whole = content.select("path", F.col("content").cast("binary").alias("_body")).filter(F.col("_body").isNotNull())
    sized = whole.withColumn("size", F.octet_length("_body").cast("bigint"))
    last = F.greatest(F.ceil(F.col("size") / part_bytes), F.lit(1)).cast("bigint")
    parts = sized.withColumn("part", F.explode(F.sequence(F.lit(1).cast("bigint"), last)))
    offset = (F.col("part") - 1) * part_bytes
    body = F.substring("_body", (offset + 1).cast("int"), F.lit(part_bytes))
    return parts.select("path", "size", "part", offset.alias("offset"), body.alias("body"))


def read(files: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """Part rows of ``files`` (path, size) on a mount that the workers see."""

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with open(row["path"], "rb") as file:
                    file.seek(row["offset"])
                    row["body"] = file.read(part_bytes)
                yield pa.RecordBatch.from_pylist([row], pa.schema(_fields(batch.schema)))

    def _fields(schema: pa.Schema) -> list[pa.Field]:
        return [*schema, pa.field("body", pa.binary())]

    # Neighbouring parts go to different tasks, so that one large file does not keep one task busy.
    spread = ranges(files, part_bytes).repartition(F.xxhash64("path", "part"))
    return spread.mapInArrow(bodies, PART)


class Digest:
    """MD5 of a whole file and the tag of its upload in chunks, from its bytes in order."""

    def __init__(self, chunk_bytes: int):
        self.chunk_bytes, self.size = chunk_bytes, 0
        self.whole, self.chunk, self.chunks = hashlib.md5(), hashlib.md5(), []

    def update(self, data: bytes) -> None:
        self.whole.update(data)
        view = memoryview(data)
        while len(view):
            room = self.chunk_bytes - self.size % self.chunk_bytes
            now = view[:room]
            self.chunk.update(now)
            self.size += len(now)
            view = view[room:]
            if self.size % self.chunk_bytes == 0:
                self._close()

    def _close(self) -> None:
        self.chunks.append(self.chunk.digest())
        self.chunk = hashlib.md5()

    def done(self, max_upload_bytes: int) -> tuple[str, str | None]:
        """The hex digest, and the tag if a file of this size goes up in chunks."""
        if self.size % self.chunk_bytes:
            self._close()
        if self.size <= max_upload_bytes:
            return self.whole.hexdigest(), None
        return self.whole.hexdigest(), f"{hashlib.md5(b''.join(self.chunks)).hexdigest()}-{len(self.chunks)}"


def digest_files(
    files: DataFrame, max_upload_bytes: int = MAX_UPLOAD_MB * MIB, chunk_bytes: int = CHUNK_MB * MIB
) -> DataFrame:
    """Size, MD5 and upload tag of files (path) on a mount that the workers see, read in blocks."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["path"].to_pylist():
                digest = Digest(chunk_bytes)
                with open(path, "rb") as file:
                    while block := file.read(BLOCK_BYTES):
                        digest.update(block)
                yield _row(path, digest.size, *digest.done(max_upload_bytes))

    return files.select("path").mapInArrow(digests, DIGEST)


def _row(path: str, size: int, md5: str | None, tag: str | None) -> pa.RecordBatch:
    kinds = pa.schema([("path", pa.string()), ("size", pa.int64()), ("md5", pa.string()), ("tag", pa.string())])
    return pa.RecordBatch.from_pylist([{"path": path, "size": size, "md5": md5, "tag": tag}], kinds)


def _in_order(parts: DataFrame) -> DataFrame:
    return parts.select("path", "size", "part", "offset", "body").repartition("path").sortWithinPartitions("path", "part")


def _files(batches: Iterator[pa.RecordBatch], begin: Callable, take: Callable, end: Callable) -> Iterator[pa.RecordBatch]:
    """Walk sorted parts: ``begin`` a file, ``take`` each next part, ``end`` it with whether it is whole."""
    path, size, at, state = None, 0, 0, None
    for batch in batches:
        for i in range(batch.num_rows):
            row_path, row_size, offset = (batch[c][i].as_py() for c in ("path", "size", "offset"))
            if state is None or row_path != path:
                if state is not None:
                    yield end(state, path, at == size)
                path, size, at, state = row_path, row_size, 0, begin(row_path)
            if offset == at:
                body = batch["body"][i].as_py()
                take(state, body)
                at += len(body)
    if state is not None:
        yield end(state, path, at == size)


def digests(
    parts: DataFrame, max_upload_bytes: int = MAX_UPLOAD_MB * MIB, chunk_bytes: int = CHUNK_MB * MIB
) -> DataFrame:
    """Size, MD5 and upload tag per file of a table of parts; digests are null if parts are missing."""

    def end(digest: Digest, path: str, whole: bool) -> pa.RecordBatch:
        size = digest.size
        return _row(path, size, *(digest.done(max_upload_bytes) if whole else (None, None)))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _files(batches, lambda _: Digest(chunk_bytes), Digest.update, end)

    return _in_order(parts).mapInArrow(walk, DIGEST)


def append(parts: DataFrame, table: str) -> None:
    parts.write.mode("append").parquet(table)


def new_parts(parts: DataFrame, stored: DataFrame) -> DataFrame:
    """Parts of files that are not stored yet; one that was stored in part gets what it lacks."""
    return parts.join(stored.select("path", "part"), ["path", "part"], "left_anti")


def restored(outcome: DataFrame, stored: DataFrame) -> DataFrame:
    """Parts of every file that restores cleanly, under its destination path."""
    done = outcome.filter(F.col("should_restore") & F.col("failed_reason").isNull())
    wanted = done.select(F.col("source_path").alias("path"), F.col("restore_path").alias("_to"))
    return stored.join(wanted, "path").select(F.col("_to").alias("path"), "size", "part", "offset", "body")


def write(parts: DataFrame, root: str) -> DataFrame:
    """Write files below ``root`` on a mount that the workers see; says what was written.

    A file grows beside its place and is put there when it is whole, so a repeated task writes it
    anew and nobody sees half a file.
    """

    def begin(path: str) -> dict:
        place = os.path.join(root, path.lstrip("/"))
        os.makedirs(os.path.dirname(place), exist_ok=True)
        beside = f"{place}.{os.getpid()}.part"
        return {"place": place, "beside": beside, "file": open(beside, "wb"), "digest": Digest(CHUNK_MB * MIB)}

    def take(state: dict, body: bytes) -> None:
        state["file"].write(body)
        state["digest"].update(body)

    def end(state: dict, path: str, whole: bool) -> pa.RecordBatch:
        state["file"].close()
        size = state["digest"].size
        if not whole:
            os.remove(state["beside"])
            return _row(path, size, None, None)
        os.replace(state["beside"], state["place"])
        return _row(path, size, *state["digest"].done(MAX_UPLOAD_MB * MIB))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _files(batches, begin, take, end)

    return _in_order(parts).mapInArrow(walk, DIGEST)
