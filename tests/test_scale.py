"""What moves, and how often: plans and files of the operators at size."""

import glob

import pytest
from pyspark.sql import functions as F

from fleetvault.functions import checks, records
from fleetvault.operators import manifests
from fleetvault.plans import references, upload, validate
from fleetvault.schemas import FILE_META
from fleetvault.sources import file_meta
from fleetvault.sources import manifests as source
from fleetvault.streaming import lifetimes
from workload.views import Catalogue


@pytest.fixture
def no_broadcast(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, old)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_json_text_is_parsed_once(spark):
    text = '{"host": "h", "component": {"generation": "7", "stat": {"size": "9"}}}'
    rows = spark.createDataFrame([(text,), (None,), ('{"host": ',)], "json string")
    back = rows.select(records.from_json(F.col("json"), FILE_META).alias("r"))
    found = back.select("r.host", "r.component.generation", "r.component.stat.size")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1
    assert [tuple(r) for r in found.collect()] == [("h", 7, 9), (None, None, None), (None, None, None)]


def component_rows(spark):
    rows = [("h", "k", f"cf{n % 2}", n) for n in range(30)] + [(None, "k", "cf", n) for n in range(3)] + [("i", "k", "cf", 1)]
    typed = spark.createDataFrame(rows, "host string, keyspace string, cf string, generation long")
    return typed.withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))


def test_manifest_rows_move_once(spark, no_broadcast, monkeypatch):
    assert "SortMergeJoin" not in plan(manifests.build(component_rows(spark), ["generation"]))
    monkeypatch.setattr(manifests, "SENT_FROM", 10)
    nested = manifests.build(component_rows(spark), ["generation"], part_files=10)
    assert "SortMergeJoin" not in plan(nested)
    assert {(r.host, r.parts) for r in nested.collect()} == {("h", 3), (None, 1), ("i", 1)}
    files = manifests.explode(nested).groupBy("host").agg(F.count("*"), F.countDistinct("generation")).collect()
    assert {tuple(r) for r in files} == {("h", 30, 30), (None, 3, 3), ("i", 1, 1)}


def meta_rows(spark):
    text = '{"host": "h", "md5": "m", "component": {"keyspace": "k", "stat": {"size": "9"}}}'
    rows = spark.createDataFrame([(text,)] * 5, "json string")
    return rows.select(records.from_json(F.col("json"), FILE_META).alias("r")).select("r.*")


def test_metadata_is_written_compressed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(file_meta, "FILE_ROWS", 2)
    root = str(tmp_path / "meta")
    file_meta.write(meta_rows(spark).coalesce(1), root)
    assert len(glob.glob(f"{root}/*.json.gz")) == 3 and not glob.glob(f"{root}/*.json")
    back = file_meta.read(spark, root, "*.json")
    assert back.count() == 5 and back.filter("component.stat.size = 9 AND _corrupt_record IS NULL").count() == 5


def test_manifests_are_written_compressed(spark, tmp_path):
    flat = component_rows(spark).withColumns({c: F.lit(None).cast("string") for c in ("file_path", "version", "component", "user", "group")})
    flat = flat.withColumns({"uid": F.lit(1), "gid": F.lit(1), "mode": F.lit(1), "size": F.lit(1).cast("long"), "temporary": F.lit(True), "is_deleted": F.lit(False)})
    record = flat.filter("host IS NOT NULL").select("host", "keyspace", "ts", "cf", source.component_struct().alias("file"))
    nested = manifests.build(record, ["file"])
    whole = nested.withColumn("components", F.transform_values("components", lambda _, fs: F.transform(fs, lambda f: f["file"])))
    table, tree = str(tmp_path / "table"), str(tmp_path / "tree")
    source.write_table(whole, table, folders=("in_keyspace", "year"))
    assert glob.glob(f"{table}/*/*/*.json.gz") and not glob.glob(f"{table}/*/*/*.json")
    source.documents(whole).drop(*source.FOLDERS).write.json(f"{tree}/cluster", compression="gzip")
    for back in (source.read_table(spark, table, ("in_keyspace", "year")), source.read_tree(spark, tree)):
        assert manifests.explode(back).count() == 31


def test_packed_digests(spark):
    texts = ["0123456789abcdef" * 2, "0123456789ABCDEF" * 2, "", "abc", "g" * 32, "é" * 16, "\0" * 16, "ab" * 17, None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    found = rows.select("t", checks.packed(F.col("t")).alias("p")).withColumn("back", checks.unpacked(F.col("p"))).collect()
    assert [r.back for r in found] == texts and len({bytes(r.p) for r in found if r.p is not None}) == len(texts) - 1
    assert len(found[0].p) == 16


def test_uploads_move_once(spark, no_broadcast):
    files = [("a", "m", False, 1), ("a", "m", False, 2), ("a", "n", False, 3), (None, "m", False, 4), (None, "m", False, 5), ("b", None, True, 6)]
    rows = spark.createDataFrame(files, "path string, md5 string, is_deleted boolean, size long").repartition(3)
    stored = spark.createDataFrame([("a", "m"), (None, "m")], "path string, md5 string")
    found = upload.upload_plan(rows, stored)
    assert plan(found).count("Exchange hashpartitioning(path") == 2 and "Exchange hashpartitioning(path#" in plan(found)
    assert "is_deleted" not in "".join(x for x in plan(found).splitlines() if "Exchange hashpartitioning" in x)
    got = sorted(((r.path, r.md5, r.action) for r in found.collect()), key=str)
    assert got == sorted([("a", "m", "skip_valid"), ("a", "n", "skip_corrupt"), (None, "m", "upload"), ("b", None, "manifest_only")], key=str)


def test_a_verdict_moves_what_it_needs(spark):
    meta = spark.createDataFrame(
        [("a", "old", 1, "x"), ("a", "new", 2, "y"), ("b", "m", 1, "z"), ("c", "m", 1, "z"), (None, "m", 1, "z")],
        "path string, md5 string, written int, note string",
    )
    stored = spark.createDataFrame([("a", "new"), ("b", "other"), (None, "m")], "path string, md5 string")
    found = validate.file_status(meta, stored, True)
    assert "note" not in found._jdf.queryExecution().optimizedPlan().toString().replace("LogicalRDD [path", "").split("Aggregate")[1].split("\n")[0]
    want = {("a", "present"), ("b", "corrupt"), ("c", "missing"), (None, "missing")}
    assert {(r.path, r.status) for r in found.collect()} == want


def test_a_version_has_one_file_per_bucket(spark, tmp_path):
    rows = spark.range(3000).select(
        F.lit("h").alias("host"), F.lit("k").alias("keyspace"), F.lit("cf").alias("cf"), F.lit("hd").alias("version"),
        F.col("id").alias("generation"), F.lit("Data.db").alias("component"), F.lit("2024-01-01").cast("timestamp_ntz").alias("ts"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        references.apply(spark, str(tmp_path), 0, added=rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(glob.glob(f"{tmp_path}/counts/level=0/run=0/bucket=*/*.parquet")) == references.BUCKETS
    assert references.counts(spark, str(tmp_path), 0).filter("backups = 1").count() == 3000


def test_files_are_kept_once(spark, sf_dir):
    plain, kept = Catalogue(spark, sf_dir), Catalogue(spark, sf_dir)
    kept.keep_files()
    assert "Join" not in plan(kept.stored_file) and "Join" in plan(plain.stored_file)
    for name in ("backup_file", "file_meta_log", "stored_file", "target_file"):
        a, b = getattr(plain, name), getattr(kept, name)
        assert a.columns == b.columns and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_live_files_when_a_run_is_empty(spark, tmp_path):
    """The first batch only deletes, so its run of lifetimes has no file."""
    from fleetvault.schemas import CHANGE_EVENT

    path = "/var/lib/data/ks/cf/ks-cf-hd-1-Data.db"
    ts = spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:00' t").first().t
    for n, kind in enumerate(("deleted", "created")):
        batch = spark.createDataFrame([(n, ts, "h", kind, path, None, 5, False)], CHANGE_EVENT)
        lifetimes.apply_batch(batch, n, str(tmp_path))
    assert [r.generation for r in lifetimes.live(spark, str(tmp_path)).collect()] == [1]
