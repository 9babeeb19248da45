"""Reference counts find the same files as comparing the store with all kept manifests."""

import random
import time
from datetime import datetime, timedelta

from fleetvault.plans import references, retention
from fleetvault.streaming import lifetimes
from workload.views import Catalogue

PART = "host string, keyspace string, ts timestamp_ntz, cf string, version string, generation long, component string"
STORED = "host string, keyspace string, path string"
START = datetime(2024, 1, 1)


def file_of(r):
    return f"{r[1]}-{r[3]}-{r[4]}-{r[5]}-{r[6]}"


def rows_of(frame):
    return sorted(map(tuple, frame.collect()))


def test_rounds_of_adding_and_purging(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lifetimes, "MERGE", 2)
    draw, store, alive, every = random.Random(5), str(tmp_path / "store"), [], []
    stored = [("h", "k", f"hosts/h/k/c/k-c-hd-{n}-{part}", ) for n in range(14) for part in ("Data.db", "Data.db-meta.json")]
    stored.append(("h", "k", "hosts/h/k/c/k-c-hd-never-Data.db"))
    disk = spark.createDataFrame(stored, STORED)
    for version in range(5):
        day = START + timedelta(days=version)
        lot = [("h", "k", day, "c", "hd", draw.randrange(14), "Data.db") for _ in range(9)]
        lot += lot[:2]  # named twice by one manifest
        before = START + timedelta(days=version - 1)
        gone = [r for r in alive if r[2] < before]
        alive = [r for r in alive if r[2] >= before] + lot
        every += lot
        frames = [spark.createDataFrame(rows, PART) for rows in (lot, gone)]
        for _ in range(2 if version == 3 else 1):  # one change is repeated
            references.apply(spark, store, version, *frames)
        counts = {r.file_name: r.backups for r in references.counts(spark, store, version).collect()}
        assert counts == {f: len({r[2] for r in alive if file_of(r) == f}) for f in {file_of(r) for r in alive}}
        whole = retention.purge_files(disk, spark.createDataFrame(every, PART), before)
        assert rows_of(references.unnamed(disk, references.counts(spark, store, version))) == rows_of(whole)
        free = {r.file_name for r in references.released(spark, store, version, frames[1]).collect()}
        assert free == {file_of(r) for r in gone} - {file_of(r) for r in alive}
        doomed = references.purge_files(disk, references.released(spark, store, version, frames[1]))
        assert {r.path.rsplit("/", 1)[1] for r in doomed.collect()} == free


def test_scopes_are_counted_apart(spark, tmp_path):
    rows = [(h, k, START, "c", "hd", 1, "Data.db") for h in ("h", "i") for k in ("k", "l")]
    store = str(tmp_path / "store")
    references.apply(spark, store, 0, added=spark.createDataFrame(rows, PART))
    gone = spark.createDataFrame(rows[:1], PART)
    references.apply(spark, store, 1, removed=gone)
    assert rows_of(references.released(spark, store, 1, gone)) == [("h", "k", "k-c-hd-1-Data.db")]
    assert {(r.host, r.keyspace) for r in references.counts(spark, store, 1).collect()} == {("h", "l"), ("i", "k"), ("i", "l")}


def shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for n in (found.apply(i).getName() for i in range(found.length())) if n.startswith("shuffle_")}


def test_rows_move_once_and_their_shuffles_go(spark, tmp_path, monkeypatch):
    rows = [(h, "k", START + timedelta(days=n % 3), "c", "hd", n % 40, "Data.db") for n in range(200) for h in ("h", None)]
    whole, gone = spark.createDataFrame(rows, PART), spark.createDataFrame(rows[:60], PART)
    seen, write = [], references._write
    monkeypatch.setattr(references, "_write", lambda told, *place: (seen.append(told), write(told, *place)))
    before, store = shuffle_files(spark), str(tmp_path / "store")
    references.apply(spark, store, 0, added=whole)
    references.apply(spark, store, 1, removed=gone)
    wait = time.time() + 20
    while shuffle_files(spark) - before and time.time() < wait:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    for told in seen:
        assert told._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = references.released(spark, store, 1, gone)
        assert found._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {r.file_name for r in found.collect() if r.host} == {file_of(r) for r in rows[:60]} - {
        file_of(r) for r in rows if (r[0], r[2], r[5]) not in {(g[0], g[2], g[5]) for g in rows[:60]}
    }


def test_paths_come_back_whole(spark):
    stored = [("h", "k", p) for p in ("a", "hosts/x/a", "hosts//a", "é/ü/a", "b/", "c/a-meta.json", None)] + [("h", None, "a")]
    disk = spark.createDataFrame(stored, STORED)
    names = spark.createDataFrame([("h", "k", "a"), ("h", "k", ""), ("h", None, "a")], "host string, keyspace string, file_name string")
    doomed = [("h", "k", p) for p in ("a", "b/", "hosts//a", "hosts/x/a", "é/ü/a")]
    assert rows_of(references.purge_files(disk, names)) == doomed
    assert rows_of(references.unnamed(disk, names)) == [("h", None, "a")]


def test_components_are_joined_once(spark, sf_dir):
    plain, kept = Catalogue(spark, sf_dir), Catalogue(spark, sf_dir)
    kept.keep_components()
    a, b = plain.manifest_component, kept.manifest_component
    assert "Join" in a._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in b._jdf.queryExecution().executedPlan().toString()
    assert a.dtypes == b.dtypes and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
