"""Files on disk: inventories, manifests, metadata, logs and content."""

import gzip
import hashlib
import json
import os
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetvault.functions.paths import backup_path
from fleetvault.operators import manifests
from fleetvault.plans import retention, upload
from fleetvault.schemas import CATALOGUE
from fleetvault.sources import content, file_meta, inventory, transfer_log
from fleetvault.sources import manifests as source
from fleetvault.storage import run_dir, shared_root


def put(root, name, text):
    target = os.path.join(root, name)
    os.makedirs(os.path.dirname(target), exist_ok=True)
    with open(target, "w") as out:
        out.write(text)
    return target


def stored_component(generation):
    return {
        "file_path": f"/d/ks/cf/ks-cf-hd-{generation}-Data.db", "keyspace": "ks", "cf": "cf", "version": "hd",
        "generation": str(generation), "component": "Data.db", "temporary": "False", "is_deleted": "false",
        "stat": {"file_path": "/d", "uid": "1", "gid": "2", "mode": "33188", "size": str(generation * 10), "user": "u", "group": "g"},
    }


def manifest_document(host, ts):
    return {
        "host": host, "keyspace": "ks", "timestamp": ts.strftime("%Y-%m-%dT%H:%M:%S.%f"),
        "name": ts.strftime("%Y_%m_%dT%H_%M_%S_%f") + f"-ks-{host}",
        "components": {"cf": [stored_component(1), stored_component(2)], "none": []},
    }


def test_manifest_tree(spark, tmp_path):
    days = [datetime(2012, 1, 2, 3, 4, 5, 6), datetime(2012, 11, 12)]
    for host in ("n-1", "n-2"):
        for ts in days:
            doc = manifest_document(host, ts)
            put(tmp_path, f"cluster/ks/{ts.year}/{ts.month}/{ts.day}/{host}/{doc['name']}.json", json.dumps(doc))
    put(tmp_path, "cluster/ks/2012/1/2/n-1/broken.json", '{"host": ')
    root = str(tmp_path)
    everything = source.read_tree(spark, root)
    assert everything.count() == 5
    broken = everything.filter(F.col(source.CORRUPT).isNotNull()).collect()
    assert len(broken) == 1 and broken[0].host is None
    one = source.read_tree(spark, root, "ks", "n-2", date(2012, 1, 2))
    row = one.first()
    assert one.count() == 1 and (row.host, row.ts) == ("n-2", days[0])
    assert row.name == "2012_01_02T03_04_05_000006-ks-n-2"
    parts = manifests.explode(one).collect()
    assert [(p.generation, p.stat["size"], p.temporary) for p in parts] == [(1, 10, False), (2, 20, False)]
    assert source.read_tree(spark, root, host="n-1", day=date(2012, 11, 12)).count() == 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        source.read_tree(spark, root, "other").count()


def test_manifest_table(spark, tmp_path):
    root = str(tmp_path / "in")
    docs = [manifest_document(h, datetime(2012, m, 2, 3)) for h in ("n-1", "n-2") for m in (1, 2)]
    for n, doc in enumerate(docs):
        put(root, f"cluster/ks/{n}.json", json.dumps(doc))
    read = source.read_tree(spark, root)
    table = str(tmp_path / "table")
    for part in ("n-1", "n-2"):
        source.write_table(read.filter(F.col("host") == part), table)
    back = source.read_table(spark, table)
    columns = ["host", "keyspace", "ts", "name", "components"]
    assert sorted(map(tuple, back.select(columns).collect()), key=str) == sorted(map(tuple, read.select(columns).collect()), key=str)
    pruned = back.filter("in_keyspace = 'ks' AND month = 2 AND on_host = 'n-1'")
    assert [r.ts for r in pruned.collect()] == [datetime(2012, 2, 2, 3)]
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(in_keyspace" in plan


def test_file_metadata(spark, tmp_path):
    doc = {"host": "h", "md5": "abc", "cassandra_version": "1.2.0", "component": stored_component(7)}
    put(tmp_path, "hosts/h/ks/cf/f-meta.json", json.dumps(doc))
    put(tmp_path, "hosts/h/ks/cf/f", "data")
    read = file_meta.read(spark, str(tmp_path))
    row = read.first()
    assert read.count() == 1 and row.component.generation == 7 and row.component.stat["size"] == 70
    table = str(tmp_path / "table")
    file_meta.write(read, table)
    file_meta.write(read, table)
    again = file_meta.read(spark, table, "*.json").drop(file_meta.CORRUPT)
    assert [r == again.first() for r in again.collect()] == [True, True]
    path = again.select("host", "component.*").select(backup_path()).first()[0]
    assert path == "hosts/h/ks/cf/ks-cf-hd-7-Data.db"


def test_inventory(spark, tmp_path):
    for name in ("a/1", "a/b/c/2", "3"):
        put(tmp_path / "data", name, name)
    os.makedirs(tmp_path / "data" / "folder")
    put(tmp_path / "data", "a/empty", "")
    root = str(tmp_path / "data")
    found = {r.path: (r["size"], r.uid) for r in inventory.scan(spark, root).collect()}
    assert found == {f"{root}/{n}": (len(n), None) for n in ("a/1", "a/b/c/2", "3")}
    plan = inventory.scan(spark, root)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan
    start = spark.createDataFrame([(root,), (root + "/missing",)], "path string")
    walked = inventory.walk(start, str(tmp_path / "levels"))
    rows = {r.path: r for r in walked.collect()}
    assert set(rows) == {*found, f"{root}/a/empty"}
    for path, row in rows.items():
        stat = os.stat(path)
        assert (row.uid, row.gid, row.mode, row["size"]) == (stat.st_uid, stat.st_gid, stat.st_mode, stat.st_size)
        assert row.user


def test_walk_skips_links_and_crowded_folders_come_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inventory, "CHUNK", 7)
    for i in range(30):
        put(tmp_path / "data", f"many/{i}", "x")
    os.symlink(tmp_path / "data", tmp_path / "data" / "many" / "round")
    os.symlink(tmp_path / "data" / "many" / "0", tmp_path / "data" / "link")
    os.symlink(tmp_path / "nowhere", tmp_path / "data" / "dangling")
    start = spark.createDataFrame([(str(tmp_path / "data"),)], "path string")
    rows = inventory.walk(start, str(tmp_path / "levels")).collect()
    names = {os.path.relpath(r.path, tmp_path / "data") for r in rows}
    assert names == {*(f"many/{i}" for i in range(30)), "link"} and len(rows) == 31


LINES = {
    "2019-03-07T08:45:31.204968 stored /a to b size 5": ("stored", "/a", "b", 5, None),
    "2019-03-07T08:45:31.8 restored BackupFile /a b: host h, md5 m to /r size 7": ("restored", "BackupFile /a b: host h, md5 m", "/r", 7, None),
    "2019-03-07T08:45:31.204968 removed a to na size 0": ("removed", "a", "na", 0, None),
    "2019-03-07T08:45:31.204968 copied a to b size 0": ("copied", "a", "b", 0, "unknown_operation"),
    "2019-03-07T08:45:31.204968 stored a to b size x": ("stored", "", "", None, "malformed"),
    "yesterday stored a to b size 1": ("stored", "a", "b", 1, "bad_time"),
    "2019-03-07T08:45:31.204968 stored a to b size 99999999999999999999": ("stored", "a", "b", None, "bad_size"),
    "": (None, "", "", None, "malformed"),
}


def test_log_lines(spark):
    parsed = transfer_log.parse(spark.createDataFrame([(line,) for line in LINES], "line string"))
    found = {r.line: (r.op, r.src_path, r.dest_path, r.bytes, r.problem) for r in parsed.collect()}
    assert found == LINES
    assert transfer_log.good(parsed).count() == 3
    assert transfer_log.quarantined(parsed).count() == len(LINES) - 3


def test_log_line_numbers_across_splits(spark, tmp_path):
    files = {"a.log": 500, "b.log": 40, "c.log": 1}
    for name, count in files.items():
        put(tmp_path, name, "".join(f"line {i} of {name}\n" for i in range(count)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1000)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        lines = transfer_log.read(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
        found = [(r.file.rsplit("/", 1)[1], r.seq, r.line) for r in lines.collect()]
        position = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block")]
        raw = spark.read.text(str(tmp_path)).select(*position, F.monotonically_increasing_id().alias("_row"), F.col("value").alias("line"))
        joined = [(r.file.rsplit("/", 1)[1], r.seq, r.line) for r in transfer_log.numbered(raw).collect()]
        assert sorted(joined) == sorted(found)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(found) == sorted((n, i, f"line {i} of {n}") for n, c in files.items() for i in range(c))


def test_log_append(spark, tmp_path):
    table = str(tmp_path / "log")
    row = spark.createDataFrame([("f", "p", 5, "upload")], "file_path string, path string, size bigint, action string")
    ts = F.lit("2024-01-02 03:04:05").cast("timestamp_ntz")
    for _ in range(2):
        transfer_log.append(upload.stored_lines(row, ts), table)
    read = transfer_log.good(transfer_log.parse(transfer_log.read(spark, table)))
    assert [(r.op, r.src_path, r.bytes) for r in read.collect()] == [("stored", "f", 5)] * 2


def test_content(spark, tmp_path):
    put(tmp_path / "in", "a/1", "hello")
    put(tmp_path / "in", "2", "hi")
    put(tmp_path / "in", "empty", "")
    read = content.read(spark, str(tmp_path / "in"))
    found = {os.path.basename(r.path): (r["size"], r.md5) for r in read.collect()}
    assert found == {n: (len(t), hashlib.md5(t.encode()).hexdigest()) for n, t in (("1", "hello"), ("2", "hi"))}
    table = str(tmp_path / "table")
    content.append(read.filter(F.col("size") > 2), table)
    fresh = upload.new_content(read, spark.read.parquet(table))
    assert [r["size"] for r in fresh.collect()] == [2]


def test_shared_folder_is_the_configured_one(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert shared_root(spark) == configured.rstrip("/")
    assert run_dir(spark, "x") != run_dir(spark, "x")


def test_catalogue_lookups_skip_folders(spark, tmp_path):
    """Lookups by keyspace, host, day or name open the folders of that backup."""
    start = datetime(2024, 5, 9, 10)
    rows = [(k, h, start + timedelta(days=d), "cf", 1) for k in ("007", "ks") for h in ("n-1", "n-2") for d in range(3)]
    flat = spark.createDataFrame(rows, "keyspace string, host string, ts timestamp_ntz, cf string, generation bigint")
    root = str(tmp_path / "catalogue")
    source.write_catalogue(manifests.build(flat, ["generation"]), root)
    schema = T.StructType([f for f in CATALOGUE.fields if f.name != "components"])
    table = source.read_catalogue(spark, root, schema)
    assert {r.keyspace for r in table.collect()} == {"007", "ks"} and table.count() == 12
    name = manifests.listed(table, "007", "n-1", start.date()).first().name
    names = spark.createDataFrame([(name,)], "name string")
    days = spark.createDataFrame([("007", "n-1", start.date())], "keyspace string, host string, day date")
    found = {
        "one": manifests.one_by_name(table, name),
        "listed": manifests.listed(table, "007", "n-1", start.date()),
        "scoped": retention.scoped(table, "007", "n-1"),
        "by_name": manifests.by_name(table, names),
        "for_days": manifests.for_days(table, days.filter("host = 'n-1'")),
    }
    for what, df in found.items():
        assert df.count() == (3 if what == "scoped" else 1), what
        if what not in ("by_name", "for_days"):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "PartitionFilters: [isnotnull" in plan, what


def test_manifests_are_written_below_their_day_and_host(spark, tmp_path, monkeypatch):
    """The query itself: a document per manifest, in the folders of its keyspace, day and host."""
    from workload import queries

    orders = [(n, c, datetime(2001, m, d)) for n, (c, m, d) in enumerate([(1, 1, 2), (1, 1, 3), (2, 1, 2), (5, 7, 2), (16, 1, 2)])]
    lines = [(n, 10 + n, k) for n in range(5) for k in (1, 2)]
    put_table = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    put_table(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz", "orders")
    put_table(lines, "l_orderkey long, l_partkey long, l_linenumber int", "lineitem")
    root = tmp_path / "manifests"
    monkeypatch.setattr(queries, "run_dir", lambda spark, label: str(root))
    assert queries.QUERIES["write_manifests"](spark, str(tmp_path)).filter("named AND file_path_ok").count() == 10
    found = []
    for path in root.rglob("*.json.gz"):
        places = [p.split("=") for p in path.relative_to(root).parts[:-1]]
        assert [p[0] for p in places] == list(source.FOLDERS)
        for text in gzip.open(path, "rt"):
            doc = json.loads(text)
            ts = datetime.fromisoformat(doc["timestamp"])
            assert [p[1] for p in places] == [doc["keyspace"], str(ts.year), str(ts.month), str(ts.day), doc["host"]]
            assert sum(map(len, doc["components"].values())) == 2
            found.append(doc["name"])
    assert len(found) == len(set(found)) == 5
