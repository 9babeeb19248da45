"""Streams give the same answer as the batch operators, however events are batched."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetvault.operators import gates, history
from fleetvault.schemas import CHANGE_EVENT
from fleetvault.streaming import events, lifetimes, usage

START = datetime(2024, 1, 1)


def change_rows(count, seed):
    draw = random.Random(seed)
    rows = []
    for seq in range(count):
        generation = 0 if draw.random() < 0.5 else draw.randrange(5)
        kind = draw.choice(["created", "created", "moved", "deleted"])
        component = "Data.db" if kind == "deleted" else draw.choice(["Data.db", "Index.db"])
        name = f"/d/k/c/k-c-hd-{generation}-{component}"
        rows.append((seq, START + timedelta(minutes=seq), "h", kind, name, name, seq, False))
    return rows


def write_files(spark, rows, folder, files, shuffle):
    order = list(rows)
    if shuffle:
        random.Random(1).shuffle(order)
    size = -(-len(order) // files)
    for n in range(files):
        part = order[n * size : (n + 1) * size]
        spark.createDataFrame(part, CHANGE_EVENT).coalesce(1).write.mode("append").parquet(folder)


@pytest.mark.parametrize("files,shuffle,every", [(1, False, 50), (6, False, 2), (6, True, 2), (3, True, 50)])
def test_lifetimes(spark, tmp_path, files, shuffle, every):
    rows = change_rows(80, files)
    folder, store = str(tmp_path / "events"), str(tmp_path / "store")
    write_files(spark, rows, folder, files, shuffle)
    stream = events.read(spark, folder, files_per_batch=1)
    query = lifetimes.start(stream, store, str(tmp_path / "cp"), block_rows=7, snapshot_every=every)
    query.awaitTermination()
    batch = history.lifetimes(gates.accepted_changes(spark.createDataFrame(rows, CHANGE_EVENT)))
    columns = batch.columns
    found = sorted(map(tuple, lifetimes.read(spark, store).select(columns).collect()), key=str)
    assert found == sorted(map(tuple, batch.collect()), key=str)


def test_lifetimes_go_on_after_a_restart_and_a_repeated_batch(spark, tmp_path):
    rows = change_rows(60, 9)
    folder, store = str(tmp_path / "events"), str(tmp_path / "store")
    for part in (rows[:30], rows[30:]):
        spark.createDataFrame(part, CHANGE_EVENT).coalesce(1).write.mode("append").parquet(folder)
        lifetimes.start(events.read(spark, folder), store, str(tmp_path / "cp")).awaitTermination()
    again = spark.createDataFrame(rows[30:], CHANGE_EVENT)
    lifetimes.apply_batch(again, 1, store)
    batch = history.lifetimes(gates.accepted_changes(spark.createDataFrame(rows, CHANGE_EVENT)))
    found = lifetimes.read(spark, store).select(batch.columns)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, batch.collect()), key=str)


def all_lives(spark, rows):
    batch = history.lifetimes(gates.accepted_changes(spark.createDataFrame(rows, CHANGE_EVENT)))
    return batch.columns, sorted(map(tuple, batch.collect()), key=str)


def test_a_batch_in_order_does_not_read_old_events(spark, tmp_path):
    rows, store = change_rows(90, 3), str(tmp_path / "store")
    for n in range(3):
        lifetimes.apply_batch(spark.createDataFrame(rows[n * 30 : n * 30 + 30], CHANGE_EVENT), n, store, snapshot_every=1)
        os.rename(f"{store}/events/level=0/run={n}", f"{tmp_path}/moved-{n}")
        os.rename(f"{store}/lifetimes/level=0/run={n}", f"{tmp_path}/told-{n}")
    columns, expected = all_lives(spark, rows)
    found = lifetimes.live(spark, store).select(columns)
    assert sorted(map(tuple, found.collect()), key=str) == [r for r in expected if r[columns.index("removed_seq")] is None]


def test_a_batch_for_one_sstable_opens_one_bucket(spark, tmp_path):
    """All other buckets' files are damaged: reading any of them would fail."""
    rows, store = change_rows(120, 5), tmp_path / "store"
    for n in range(3):
        lifetimes.apply_batch(spark.createDataFrame(rows[n * 40 : n * 40 + 40], CHANGE_EVENT), n, str(store), snapshot_every=2)
    one = (200, START, "h", "created", "/d/k/c/k-c-hd-3-Index.db", None, 7, False)
    late = (-1, START, "h", "deleted", "/d/k/c/k-c-hd-3-Data.db", None, 0, False)
    key = spark.createDataFrame([("h", "k", "c", "hd", 3)], "host string, keyspace string, cf string, version string, generation long")
    (own,) = key.select(lifetimes.bucket_of().alias("b")).first()
    for table in ("events", "lifetimes", "live"):
        files = [f for f in (store / table).rglob("*.parquet") if f"bucket={own}/" not in str(f)]
        assert files
        for f in files:
            f.write_bytes(b"damaged")
            (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    for n, extra in ((3, one), (4, late)):
        lifetimes.apply_batch(spark.createDataFrame([extra], CHANGE_EVENT), n, str(store), snapshot_every=2)
        rows.append(extra)
        columns, expected = all_lives(spark, rows)
        told = spark.read.parquet(f"{store}/lifetimes/level=0/run={n}").select(columns)
        want = [r for r in expected if r[columns.index("generation")] == 3 and r[columns.index("removed_seq")] is None]
        assert [r for r in sorted(map(tuple, told.collect()), key=str) if r[columns.index("removed_seq")] is None] == want


def test_merged_runs_with_late_events(spark, tmp_path, monkeypatch):
    """Runs of three levels, late and repeated batches. (With 105 batches and MERGE 16 it takes ten minutes.)"""
    monkeypatch.setattr(lifetimes, "MERGE", 3)
    rows, store = change_rows(70, 11), str(tmp_path / "store")
    order = list(rows)
    draw = random.Random(2)
    for _ in range(12):
        order.insert(draw.randrange(len(order)), order.pop(draw.randrange(len(order))))
    parts = [order[n * 5 : n * 5 + 5] for n in range(14)]
    for n, part in enumerate(parts):
        for _ in range(2 if n == 8 else 1):  # one is repeated after it was complete
            lifetimes.apply_batch(spark.createDataFrame(part, CHANGE_EVENT), n, store, block_rows=50, snapshot_every=4)
    columns, expected = all_lives(spark, rows)
    assert sorted(map(tuple, lifetimes.read(spark, store).select(columns).collect()), key=str) == expected
    live = sorted(map(tuple, lifetimes.live(spark, store).select(columns).collect()), key=str)
    assert live == [r for r in expected if r[columns.index("removed_seq")] is None]
    assert lifetimes.runs(14) == [(2, 0), (1, 3), (0, 12), (0, 13)]


@pytest.mark.parametrize("batches", [0, 1, 15, 16, 17, 255, 256, 4097])
def test_runs_hold_every_batch_once(batches):
    held = [b for level, run in lifetimes.runs(batches) for b in range(run * 16**level, (run + 1) * 16**level)]
    assert held == list(range(batches))
    assert len(lifetimes.runs(batches)) <= 15 * 4 + 1


def test_initial_scan_precedes_the_watch(spark, tmp_path):
    inventory = spark.createDataFrame([("/d/k/c/k-c-hd-1-Data.db", 5), ("/d/k/c/k-c-hd-2-Data.db", 6)], "path string, size bigint")
    folder = str(tmp_path / "events")
    events.initial(inventory, F.lit("h"), F.lit("2024-01-01 00:00:00")).write.parquet(folder)
    tail = [(0, START, "h", "deleted", "/d/k/c/k-c-hd-1-Data.db", None, 0, False)]
    spark.createDataFrame(tail, CHANGE_EVENT).write.mode("append").parquet(folder)
    store = str(tmp_path / "store")
    lifetimes.start(events.read(spark, folder), store, str(tmp_path / "cp")).awaitTermination()
    live = history.live_now(lifetimes.read(spark, store)).collect()
    assert [(r.generation, r["size"]) for r in live] == [(2, 6)]


def test_hourly_sums_and_dropped_lines(spark, tmp_path):
    schema = "seq bigint, host string, ts timestamp_ntz, op string, bytes bigint"
    folder, table = str(tmp_path / "log"), str(tmp_path / "hours")

    def add(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        lines = spark.readStream.schema(schema).parquet(folder)
        query = usage.start(lines, table, str(tmp_path / "cp"))
        query.awaitTermination()
        done = spark.read.parquet(table)
        left = usage.missed(spark.read.schema(schema).parquet(folder), done)
        return sorted((r.hour, r.lines, r.net, r.trans_in) for r in left.collect())

    hour = timedelta(hours=1)
    assert add([(0, "h", START, "stored", 10), (1, "h", START, "restored", 4), (2, "h", START + 5 * hour, "removed", 1)]) == []
    late = [(3, "h", START + hour, "stored", 99), (5, "h", START + hour, "restored", 9), (6, "h", START, "stored", 1)]
    assert add([*late, (4, "h", START + 9 * hour, "stored", 1)]) == [(START, 1, 1, 1), (START + hour, 2, 90, 99)]
    found = {r.hour: (r.lines, r.net, r.trans_in, r.trans_out) for r in spark.read.parquet(table).collect()}
    assert found == {START: (2, 6, 10, 4), START + 5 * hour: (1, -1, 0, 0)}
