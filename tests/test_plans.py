"""Decisions: upload, validate, restore, retention and the commands over them."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetvault.operators import manifests
from fleetvault.plans import commands, restore, retention, upload, validate

DAY = datetime(2024, 5, 10, 8)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_upload_plan(spark):
    files = frame(
        spark,
        [("new", "1", False), ("same", "1", False), ("other", "1", False), ("unknown", "1", False), ("gone", "1", True), ("same2", "1", True)],
        "path string, md5 string, is_deleted boolean",
    )
    stored = frame(spark, [("same", "1"), ("other", "2"), ("unknown", None), ("same2", "1")], "path string, md5 string")
    found = {r.path: (r.action, r.writes_manifest) for r in upload.upload_plan(files, stored).collect()}
    assert found == {
        "new": ("upload", True),
        "same": ("skip_valid", False),
        "other": ("skip_corrupt", False),
        "unknown": ("skip_corrupt", False),
        "gone": ("manifest_only", True),
        "same2": ("manifest_only", True),
    }


def test_log_lines(spark):
    ts = F.lit("2024-01-02 03:04:05").cast("timestamp_ntz")
    plan = frame(spark, [("a b", "p", 5, "upload"), ("x", "q", 6, "skip_valid")], "file_path string, path string, size bigint, action string")
    assert [r.line for r in upload.stored_lines(plan, ts).collect()] == ["2024-01-02T03:04:05.000000 stored a b to p size 5"]
    gone = frame(spark, [("p", 5), ("m.json", None)], "path string, size bigint")
    assert [r.line for r in upload.removed_lines(gone, ts).collect()] == ["2024-01-02T03:04:05.000000 removed p to na size 5"]
    done = frame(
        spark, [("s", "t", 7, True, None), ("s", "t", 7, True, "bad"), ("s", "t", 7, False, None)],
        "source_path string, restore_path string, size bigint, should_restore boolean, failed_reason string",
    )
    assert [r.line for r in upload.restored_lines(done, ts).collect()] == ["2024-01-02T03:04:05.000000 restored s to t size 7"]


COMPONENT = "host string, keyspace string, ts timestamp_ntz, cf string, version string, generation bigint, component string, size bigint"


def component(generation, ts=DAY, host="h", keyspace="k"):
    return (host, keyspace, ts, "c", "hd", generation, "Data.db", 10)


def path(generation, host="h", keyspace="k"):
    return f"hosts/{host}/{keyspace}/c/{keyspace}-c-hd-{generation}-Data.db"


def test_validate(spark):
    body = frame(spark, [component(g) for g in range(5)] + [component(0, DAY + timedelta(1))], COMPONENT)
    meta = frame(spark, [(path(g), "m") for g in range(4)], "path string, md5 string")
    stored = frame(spark, [(path(0), "m"), (path(1), "x"), (path(2), None), (path(4), "m")], "path string, md5 string")

    def status(checksum):
        checked = validate.validate(body, meta, stored, checksum)
        return sorted((r.ts.day, r.generation, r.status) for r in checked.collect())

    plain = ["present", "present", "present", "missing", "missing"]
    strict = ["present", "corrupt", "corrupt", "missing", "missing"]
    assert status(False) == [(10, g, s) for g, s in enumerate(plain)] + [(11, 0, "present")]
    assert status(True) == [(10, g, s) for g, s in enumerate(strict)] + [(11, 0, "present")]
    verdict = {r.ts.day: (r.present, r.missing, r.corrupt, r.ok) for r in validate.summary(validate.validate(body, meta, stored, True)).collect()}
    assert verdict == {10: (1, 2, 2, False), 11: (1, 0, 0, True)}


def restore_case(spark, checksum):
    files = frame(spark, [(*component(g), "m") for g in range(5)] + [(*component(5), None)], COMPONENT + ", md5 string")
    names = {g: f"/data/k/c/k-c-hd-{g}-Data.db" for g in range(6)}
    targets = frame(
        spark, [("h", names[1], "m"), ("h", names[2], "x"), ("h", names[4], "x"), ("h", names[5], "x"), ("other", names[0], "m")],
        "host string, restore_path string, md5 string",
    )
    stored = frame(spark, [(path(0), "m"), (path(1), "m"), (path(2), "m"), (path(4), "y"), (path(5), "m")], "path string, md5 string")
    plan = restore.restore_plan(files, targets, "/data", "bad", checksum)
    return restore.restore_outcome(plan, stored, checksum)


def test_restore(spark):
    found = {r.generation: (r.should_restore, r.restore_reason, r.failed_reason, r.corrupt_path) for r in restore_case(spark, True).collect()}
    aside = "/data/../bad/k/k-c-hd-{}-Data.db"
    assert found == {
        0: (True, "No File", None, None),
        1: (False, "Existing file (Checksummed)", None, None),
        2: (True, "Existing file corrupt", None, aside.format(2)),
        3: (True, "No File", "Source file missing", None),
        4: (True, "Existing file corrupt", "Restored File corrupt", aside.format(4)),
        5: (True, "Existing file corrupt", "Source file missing", None),
    }
    plain = {r.generation: (r.should_restore, r.restore_reason, r.failed_reason) for r in restore_case(spark, False).collect()}
    assert plain[1] == plain[2] == plain[4] == (True, "Existing file (Not checksummed)", None)
    counts = {(r["class"], r.reason): r.files for r in restore.summary(restore_case(spark, True)).collect()}
    assert counts == {
        ("restored", "No File"): 1,
        ("restored", "Existing file corrupt"): 1,
        ("skipped", "Existing file (Checksummed)"): 1,
        ("failed", "Source file missing"): 2,
        ("failed", "Restored File corrupt"): 1,
        ("moved_aside", "Existing file corrupt"): 2,
    }
    with pytest.raises(RuntimeError):
        restore.stop_if_corrupt(restore_case(spark, True))
    restore.stop_if_corrupt(restore_case(spark, False))


def test_cutoff():
    assert retention.cutoff("2024-05-10T08:00") == DAY
    assert retention.cutoff(DAY) == DAY
    assert retention.cutoff(keep_days=2, as_of=DAY) == DAY - timedelta(2)
    for bad in (dict(), dict(purge_before="2024-01-01", keep_days=1), dict(keep_days=0), dict(purge_before="junk")):
        with pytest.raises(ValueError):
            retention.cutoff(**bad)


def test_kept_is_inclusive_and_prunes_folders(spark):
    rows = [(DAY - timedelta(microseconds=1),), (DAY,), (DAY + timedelta(400),)]
    df = frame(spark, rows, "ts timestamp_ntz")
    assert {r.ts for r in retention.kept(df, DAY).collect()} == {rows[1][0], rows[2][0]}
    dated = df.select("ts", F.year("ts").alias("year"), F.month("ts").alias("month"), F.dayofmonth("ts").alias("day"))
    assert retention.kept(dated, DAY).count() == 2


def test_manifest_days(spark):
    scopes = frame(spark, [("h", "k")], "host string, keyspace string")
    days = [r.day for r in retention.manifest_days(scopes, DAY, DAY + timedelta(2)).collect()]
    assert days == [date(2024, 5, 10), date(2024, 5, 11), date(2024, 5, 12)]
    with pytest.raises(ValueError):
        retention.manifest_days(scopes, DAY, DAY - timedelta(1))


def catalogue(spark, seed):
    """Random backups of two hosts and two keyspaces, and a store with some orphans."""
    draw = random.Random(seed)
    body, files = set(), set()
    for host in ("h", "n-1"):
        for keyspace in ("k", "z"):
            for back in range(6):
                ts = DAY - timedelta(days=back)
                for generation in draw.sample(range(12), 4):
                    body.add(component(generation, ts, host, keyspace))
                    files.add((host, keyspace, path(generation, host, keyspace), 10, "m"))
            files.add((host, keyspace, path(99, host, keyspace), 10, "m"))
    components = frame(spark, sorted(body), COMPONENT)
    stored = frame(spark, sorted(files), "host string, keyspace string, path string, size bigint, md5 string")
    nested = manifests.build(components, ["version", "generation", "component", "size"]).drop("part", "parts")
    return body, files, nested, stored


def manifest_paths(nested):
    from fleetvault.functions.paths import manifest_path

    return nested.select("host", "keyspace", manifest_path(F.col("ts")).alias("path"))


@pytest.mark.parametrize("seed", [1, 2])
def test_purge(spark, seed):
    body, files, nested, stored = catalogue(spark, seed)
    before = DAY - timedelta(days=2)
    kept = {path(c[5], c[0], c[1]) for c in body if c[2] >= before}
    report = commands.purge(nested, stored, manifest_paths(nested), purge_before=before).collect()
    doomed = {r.path for r in report if r.kind == "file"}
    assert doomed == {f[2] for f in files} - kept
    assert sum(r.kind == "manifest" for r in report) == 3 * 4
    totals = {(r.host, r.keyspace, r.kind): (r.paths, r.reclaimed_bytes) for r in retention.purge_totals(spark.createDataFrame(report)).collect()}
    assert totals["h", "k", "manifest"] == (3, 0)
    assert sum(n for (_, _, kind), (n, _) in totals.items() if kind == "file") == len(doomed)

    # One host and keyspace only.
    part = commands.purge(nested, stored, manifest_paths(nested), "k", "n-1", keep_days=2, as_of=DAY).collect()
    assert {r.path for r in part if r.kind == "file"} == {p for p in doomed if p.startswith("hosts/n-1/k/")}
    assert {(r.host, r.keyspace) for r in part} == {("n-1", "k")}

    # Applying the plan and purging again removes nothing; a dry run keeps everything.
    plan = retention.removal_plan(spark.createDataFrame(report))
    left = retention.survivors(stored, plan)
    assert {r.path for r in left.collect()} == kept
    again = commands.purge(nested, left, manifest_paths(nested), purge_before=before)
    assert again.filter("kind = 'file'").count() == 0
    dry = retention.removal_plan(spark.createDataFrame(report), dry_run=True)
    assert retention.survivors(stored, dry).count() == len(files)


def test_commands_on_a_named_backup(spark):
    body, _, nested, stored = catalogue(spark, 3)
    meta = stored.select("path", "md5")
    listed = commands.list_backups(nested, "k", "n-1", DAY.date()).collect()
    name = listed[0].name
    evening = commands.list_backups(nested, "k", "n-1", "2024-05-09T20:00", zone="America/New_York")
    assert evening.collect() == listed
    assert commands.list_backups(nested, "k", "n-1").count() == 0
    mine = [c for c in body if c[:3] == ("n-1", "k", DAY)]
    shown = commands.show(nested, name).collect()
    total = commands.size(nested, name).first()
    assert (total.files, total.total_size, total.human_size) == (len(mine), 10 * len(mine), f"{10 * len(mine)}B")
    assert [r.generation for r in shown] == [c[5] for c in sorted(mine, key=lambda c: f"k-c-hd-{c[5]}-Data.db")]
    checked = commands.validate(nested, meta, stored, name, checksum=True)
    assert [r.status for r in checked.collect()] == ["present"] * len(mine)
    targets = frame(spark, [], "host string, restore_path string, md5 string")
    restored = commands.restore(nested, meta, stored, targets, name)
    assert [r.restore_reason for r in restored.collect()] == ["No File"] * len(mine)
    assert restored.filter("failed_reason IS NOT NULL").count() == 0


def test_backup_command(spark):
    files = frame(
        spark, [("h", "/d/k/c/k-c-hd-1-Data.db", "m", 1), ("h", "/d/k/c/k-c-tmp-hd-2-Data.db", "m", 1), ("h", "/d/k/c/k-c-hd-3-Data.db", "m", 1)],
        "host string, path string, md5 string, size bigint",
    )
    stored = frame(spark, [(path(3), "m")], "path string, md5 string")
    plan = {r.path: (r.action, r.file_path) for r in commands.backup(files, stored).collect()}
    assert plan == {
        path(1): ("upload", "/d/k/c/k-c-hd-1-Data.db"),
        path(3): ("skip_valid", "/d/k/c/k-c-hd-3-Data.db"),
    }


def test_usage_report_command(spark):
    log = frame(spark, [(0, "h", DAY, "stored", 5)], "seq bigint, host string, ts timestamp_ntz, op string, bytes bigint")
    hours, months = commands.usage_report(log, extrapolate_to=DAY + timedelta(hours=2))
    assert hours.count() == 1 and months.first().byte_hours == 15
    assert commands.usage_report(log)[1].count() > 1


def test_validate_after_purge_keeps_the_verdict_of_kept_backups(spark):
    body, _, nested, stored = catalogue(spark, 4)
    before = DAY - timedelta(days=3)
    report = commands.purge(nested, stored, manifest_paths(nested), purge_before=before)
    left = retention.survivors(stored, retention.removal_plan(report))
    kept = nested.filter(F.col("ts") >= F.lit(before))
    checked = commands.validate(kept, left.select("path", "md5"), left, checksum=True)
    assert {r.status for r in checked.collect()} == {"present"}
    assert checked.count() == sum(c[2] >= before for c in body)


def test_purge_leaves_sidecars_of_kept_files(spark):
    """After a purge every file of a kept backup still has its metadata."""
    body = spark.createDataFrame(
        [("h", "ks", datetime(2024, 5, d), "cf", "hd", d, "Data.db", 1) for d in (1, 9)],
        "host string, keyspace string, ts timestamp_ntz, cf string, version string, generation bigint, component string, size bigint",
    )
    files = [f"hosts/h/ks/cf/ks-cf-hd-{d}-Data.db" for d in (1, 9)]
    rows = [("h", "ks", f + s, 1) for f in files for s in ("", "-meta.json")]
    stored = spark.createDataFrame(rows, "host string, keyspace string, path string, size bigint")
    doomed = retention.purge_files(stored, body, datetime(2024, 5, 5))
    assert [r.path for r in doomed.collect()] == files[:1]
    gone = {p for r in retention.removal_plan(doomed).collect() for p in (r.path, r.meta_path)}
    assert gone == {files[0], files[0] + "-meta.json"}


def test_newest_metadata_counts_once(spark):
    body = spark.createDataFrame([("h", "ks", "cf", "hd", 1, "Data.db")], "host string, keyspace string, cf string, version string, generation bigint, component string")
    path = "hosts/h/ks/cf/ks-cf-hd-1-Data.db"
    meta = spark.createDataFrame([(path, "old", 1), (path, "new", 3), (path, "mid", 2)], "path string, md5 string, written int")
    stored = spark.createDataFrame([(path, "new")], "path string, md5 string")
    assert [r.md5 for r in validate.component_meta(body, meta).collect()] == ["new"]
    assert [r.status for r in validate.validate(body, meta, stored, True).collect()] == ["present"]
    assert validate.component_meta(body, meta.drop("written")).count() == 1
