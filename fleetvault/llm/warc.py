"""WARC archives as a Spark data source, read and written by tasks.

Reading: every archive file is a partition (several small ones share one). Filters that compare
``record_type``, ``record_id``, ``target_uri``, ``refers_to`` or ``payload_digest`` with constants are
pushed down. A record's headers are parsed first; a record that the filters reject, or any record
when the option ``payload`` is ``false``, is stepped over and its payload is never decoded.

Writing: a task writes gzip members, one per record, to a file of its own with a name that no
other attempt uses. Each commit writes a manifest of its own, ``_archives-*.json``, with the names of
the files of successful attempts, and the union of all manifests is read back. So appends add up,
also simultaneous ones, and a lost or repeated task leaves no double records. Overwriting takes the
earlier manifests away once the new one is there. The first commit's is also ``_archives.json``.

Paths may be any that pyarrow can open; executors and driver must share them.

Nulls and edge cases: a null payload is empty. A null target or id leaves its header out and is
read back as null. Line breaks in a header value are written as spaces, other control characters
and non-Latin text as UTF-8. An empty table gives an archive without records. Columns that are
not part of ``SCHEMA`` are refused by the writer. A truncated archive raises.
"""

from __future__ import annotations

import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    StringStartsWith,
    WriterCommitMessage,
)

SCHEMA = (
    "record_type string, record_id string, target_uri string, refers_to string, "
    "payload_digest string, payload_length long, payload binary"
)
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
    "payload_length": "X-Payload-Length",
}
FIELDS = {header.lower(): column for column, header in HEADERS.items()}
MANIFEST = "_archives.json"
MANIFESTS = re.compile(r"_archives(-[0-9a-f]{32})?\.json")
READ_BYTES = 1 << 20
PARTITION_BYTES = 64 << 20
MIN_REVISIT_BYTES = 100


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _manifests(store, root: str) -> list[str]:
    """Paths of all manifests of an archive."""
    from pyarrow import fs

    found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted(f.path for f in found if MANIFESTS.fullmatch(f.base_name))


def encode(record: dict) -> bytes:
    """One record as a gzip member; the payload only when the record carries it."""
    payload = bytes(record.get("payload") or b"")
    lines = ["WARC/1.1"]
    for column, header in HEADERS.items():
        if record.get(column) is not None:
            lines.append(f"{header}: {' '.join(str(record[column]).splitlines())}")
    lines += [f"Content-Length: {len(payload)}", "", ""]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode()) + packer.compress(payload + b"\r\n\r\n") + packer.flush()


class _Inflated(io.RawIOBase):
    """The content of consecutive gzip members, in bounded pieces."""

    def __init__(self, source):
        self.source, self.unpacker, self.waiting = source, None, b""

    def readable(self) -> bool:
        return True

    def readinto(self, target) -> int:
        while True:
            if not self.waiting:
                self.waiting = self.source.read(READ_BYTES)
                if not self.waiting:
                    if self.unpacker is not None:
                        raise ValueError("the archive ends within a record")
                    return 0
            self.unpacker = self.unpacker or zlib.decompressobj(31)
            piece = self.unpacker.decompress(self.waiting, len(target))
            if self.unpacker.eof:
                self.waiting, self.unpacker = self.unpacker.unused_data, None
            else:
                self.waiting = self.unpacker.unconsumed_tail
            if piece:
                target[: len(piece)] = piece
                return len(piece)


def parse_headers(source) -> dict | None:
    """Header fields of the next record, with its content length; None at the end."""
    line = source.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no record begins with {line[:40]!r}")
    found: dict = dict.fromkeys(COLUMNS)
    size = None
    while line := source.readline().rstrip(b"\r\n"):
        name, _, value = line.decode().partition(":")
        name = name.strip().lower()
        if name == "content-length":
            size = int(value)
        elif name in FIELDS:
            found[FIELDS[name]] = value.strip()
    if size is None:
        raise ValueError("a record has no Content-Length")
    if found["payload_length"] is not None:
        found["payload_length"] = int(found["payload_length"])
    return found | {"size": size}


def records(source, tests: Sequence, with_payload: bool) -> Iterator[dict]:
    """Records whose headers pass every test; other payloads are stepped over in pieces."""
    while (record := parse_headers(source)) is not None:
        size = record.pop("size")
        if with_payload and all(test(record) for test in tests):
            record["payload"] = source.read(size)
            if len(record["payload"]) != size:
                raise ValueError("the archive ends within a payload")
            yield record
        else:
            left = size
            while left:
                piece = len(source.read(min(left, READ_BYTES)))
                if not piece:
                    raise ValueError("the archive ends within a payload")
                left -= piece
            if not with_payload and all(test(record) for test in tests):
                yield record
        source.read(4)


@dataclass
class _Test:
    """A pushed filter on one header."""

    column: str
    kind: str
    value: object

    def __call__(self, record: dict) -> bool:
        own = record[self.column]
        if self.kind == "null":
            return own is None
        if own is None:
            return False
        if self.kind == "in":
            return own in self.value
        return self.kind == "set" or own.startswith(self.value)


def pushed(found: Filter) -> _Test | None:
    """The test that a filter amounts to, or None when Spark must apply it."""
    column = found.attribute[0] if len(getattr(found, "attribute", ())) == 1 else None
    if column not in HEADERS or column == "payload_length":
        return None
    if isinstance(found, EqualTo):
        return _Test(column, "in", (found.value,))
    if isinstance(found, In):
        return _Test(column, "in", tuple(found.value))
    if isinstance(found, IsNull):
        return _Test(column, "null", None)
    if isinstance(found, IsNotNull):
        return _Test(column, "set", None)
    if isinstance(found, StringStartsWith):
        return _Test(column, "starts", found.value)
    return None


@dataclass
class _Files(InputPartition):
    names: tuple[str, ...]


@dataclass
class _Written(WriterCommitMessage):
    name: str
    size: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, with_payload: bool):
        self.path, self.with_payload, self.tests = path.rstrip("/"), with_payload, []

    def pushFilters(self, filters: list[Filter]):
        for one in filters:
            test = pushed(one)
            if test is None:
                yield one
            else:
                self.tests.append(test)

    def partitions(self) -> Sequence[InputPartition]:
        store, root = _store(self.path)
        paths = _manifests(store, root)
        if not paths:
            raise FileNotFoundError(f"{self.path} has no manifest")
        listed: dict[str, int] = {}
        for path in paths:
            with store.open_input_stream(path, compression=None) as manifest:
                listed |= json.loads(manifest.read())
        files = sorted(listed.items())
        groups, size = [[]], 0
        for name, own in files:
            if groups[-1] and size + own > PARTITION_BYTES:
                groups.append([])
                size = 0
            groups[-1].append(name)
            size += own
        return [_Files(tuple(g)) for g in groups]

    def read(self, partition: _Files) -> Iterator[tuple]:
        store, root = _store(self.path)
        for name in partition.names:
            with store.open_input_stream(f"{root}/{name}", compression=None) as raw:
                source = io.BufferedReader(_Inflated(raw), READ_BYTES)
                for record in records(source, self.tests, self.with_payload):
                    yield tuple(record[c] for c in COLUMNS)


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool = False):
        self.path, self.overwrite = path.rstrip("/"), overwrite

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        name, size = f"{uuid.uuid4().hex}.warc.gz", 0
        with store.open_output_stream(f"{root}/{name}", compression=None) as target:
            for row in rows:
                size += target.write(encode(row.asDict())) or 0
        return _Written(name, size)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        earlier = _manifests(store, root)
        names = [f"_archives-{uuid.uuid4().hex}.json"]
        if self.overwrite or not earlier:
            names.append(MANIFEST)
        for name in names:
            with store.open_output_stream(f"{root}/{name}", compression=None) as target:
                target.write(json.dumps({m.name: m.size for m in messages if m}).encode())
        for path in earlier if self.overwrite else []:
            if not path.endswith(f"/{MANIFEST}"):
                store.delete_file(path)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = _store(self.path)
        for message in messages:
            if message:
                store.delete_file(f"{root}/{message.name}")


class WarcSource(DataSource):
    """``spark.read.format("warc")`` and ``df.write.format("warc")``; options path, payload."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("payload", "true").lower() != "false")

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if [f.name for f in schema.fields] != COLUMNS:
            raise ValueError(f"an archive has the columns {COLUMNS}")
        return _Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def page_records(pages: DataFrame, least_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Records of ``pages`` (page_id, url, html): of equal payloads of ``least_bytes`` or more, the
    one with the smallest page_id is a response and the others are revisits of it.

    Only digests are grouped; the pages move once, to meet the id that their digest belongs to.
    Rows of one page_id with equal payloads are all responses; a null page_id comes last.
    """
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    own = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    firsts = (
        own.filter(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("response"))
    )
    revisit = F.col("response").isNotNull() & ~F.col("response").eqNullSafe(F.col("page_id"))
    joined = own.join(firsts, "digest", "left").withColumn("revisit", revisit)
    return joined.select(
        F.when(F.col("revisit"), "revisit").otherwise("response").alias("record_type"),
        F.when(F.col("page_id").isNotNull(), F.format_string("<urn:page:%d>", "page_id")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.when(F.col("revisit"), F.format_string("<urn:page:%d>", "response")).alias("refers_to"),
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("payload_length"),
        F.when(F.col("revisit"), F.lit(b"")).otherwise(F.col("payload")).alias("payload"),
    )


def page_of(column: str):
    """The page_id in a record name of ``page_records``."""
    return F.regexp_extract(column, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
