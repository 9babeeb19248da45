"""Bodies in parts: against hashlib on whole bodies and files, with small limits instead of large files."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from fleetvault.functions import checks
from fleetvault.sources import chunks


def bodies():
    rng = random.Random(3)
    return {f"/d/f{n}": rng.randbytes(size) for n, size in enumerate([0, 1, 9, 10, 11, 20, 25, 40, 41, 997])}


def tag_of(body, chunk, most):
    pieces = [body[i : i + chunk] for i in range(0, len(body), chunk)]
    if len(body) <= most:
        return None
    return hashlib.md5(b"".join(hashlib.md5(p).digest() for p in pieces)).hexdigest() + f"-{len(pieces)}"


def expected(found, chunk=20, most=24):
    return {p: (len(b), hashlib.md5(b).hexdigest(), tag_of(b, chunk, most)) for p, b in found.items()}


def as_dict(df):
    rows = df.collect()
    assert len({r.path for r in rows}) == len(rows)
    return {r.path: (r["size"], r.md5, r.tag) for r in rows}


def values(spark, found):
    return spark.createDataFrame([*found.items(), ("/d/none", None)], "path string, content binary")


@pytest.fixture
def tree(tmp_path):
    found = {}
    for path, body in bodies().items():
        place = tmp_path / path.lstrip("/")
        place.parent.mkdir(exist_ok=True)
        place.write_bytes(body)
        found[str(place)] = body
    return found


@pytest.mark.parametrize("part", [1, 7, 10, 64, 5000])
def test_digests_of_parts(spark, part):
    parts = chunks.cut(values(spark, bodies()), part)
    assert parts.agg(F.max(F.octet_length("body"))).first()[0] <= part
    assert as_dict(chunks.digests(parts, 24, 20)) == expected(bodies())


def test_digests_of_files_read_whole_and_in_parts(spark, tree):
    files = spark.createDataFrame([(p, len(b)) for p, b in tree.items()], "path string, size long")
    assert as_dict(chunks.digest_files(files, 24, 20)) == expected(tree)
    read = chunks.read(files, 16)
    assert as_dict(chunks.digests(read, 24, 20)) == expected(tree)
    assert {(r.path, r.part): bytes(r.body) for r in read.collect()} == {
        (p, i // 16 + 1): b[i : i + 16] for p, b in tree.items() for i in range(0, max(len(b), 1), 16)
    }


def test_a_file_is_digested_in_blocks(spark, tmp_path, monkeypatch):
    """A task asks for one block at a time, however large the file."""
    path = tmp_path / "large"
    path.write_bytes(b"x" * 5_000_000)
    files = spark.createDataFrame([(str(path), 5_000_000)], "path string, size long")
    digest = chunks.Digest(1 << 20)
    for _ in range(5):
        digest.update(b"x" * 1_000_000)
    assert as_dict(chunks.digest_files(files, 0, 1 << 20)) == {str(path): (5_000_000, *digest.done(0))}


def test_missing_and_repeated_parts(spark):
    parts = chunks.cut(values(spark, bodies()), 10)
    twice = parts.unionByName(parts.filter("part % 2 = 1"))
    assert as_dict(chunks.digests(twice, 24, 20)) == expected(bodies())
    gap = as_dict(chunks.digests(parts.filter("NOT (path = '/d/f7' AND part = 2)"), 24, 20))
    assert gap["/d/f7"] == (10, None, None) and gap["/d/f9"] == expected(bodies())["/d/f9"]
    no_end = as_dict(chunks.digests(parts.filter("NOT (path = '/d/f7' AND part = 4)"), 24, 20))
    assert no_end["/d/f7"][1:] == (None, None)


def test_store_what_is_lacking_and_restore(spark, tmp_path):
    table = str(tmp_path / "table")
    parts = chunks.cut(values(spark, bodies()), 10)
    chunks.append(parts.filter("path = '/d/f9' AND part < 50"), table)
    chunks.append(chunks.new_parts(parts, spark.read.parquet(table)), table)
    stored = spark.read.parquet(table)
    assert stored.count() == parts.count()
    rows = [(p, f"/to{p}", p != "/d/f3", None if p != "/d/f4" else "bad") for p in bodies()]
    outcome = spark.createDataFrame(rows, "source_path string, restore_path string, should_restore boolean, failed_reason string")
    moved = chunks.restored(outcome, stored)
    want = {f"/to{p}": b for p, b in bodies().items() if p not in ("/d/f3", "/d/f4")}
    written = as_dict(chunks.write(moved, str(tmp_path / "root")))
    assert {p: v[:2] for p, v in written.items()} == {p: v[:2] for p, v in expected(want).items()}
    assert {p: (tmp_path / "root" / p.lstrip("/")).read_bytes() for p in want} == want
    assert not [f for _, _, names in os.walk(tmp_path / "root") for f in names if f.endswith(".part")]


def test_half_a_file_is_not_written(spark, tmp_path):
    parts = chunks.cut(values(spark, bodies()), 10).filter("part <> 2 AND path = '/d/f9'")
    ((path, (_, md5, _)),) = as_dict(chunks.write(parts, str(tmp_path))).items()
    assert md5 is None and not (tmp_path / path.lstrip("/")).exists() and os.listdir(tmp_path / "d") == []


def test_no_parts(spark):
    empty = spark.createDataFrame([], chunks.PART)
    assert chunks.digests(empty).collect() == [] and chunks.cut(values(spark, {})).collect() == []


def test_tags_decide(spark):
    rows = [("a", '"t-2"', "t-2"), ("a", '"t-2"', "u-2"), ("a", '"t-2"', None), ("a", '"a"', "t-2"), ("a", '"b"', None)]
    df = spark.createDataFrame(rows, "md5 string, etag string, tag string")
    verdict = checks.checksum_matches(F.col("md5"), F.lit(True), F.lit(""), F.col("etag"), F.col("tag"))
    assert [r[0] for r in df.select(verdict).collect()] == [True, False, None, True, False]
    recorded = checks.checksum_matches(F.col("md5"), F.lit(True), F.lit("a"), F.col("etag"), F.col("tag"))
    assert {r[0] for r in df.select(recorded).collect()} == {True}
