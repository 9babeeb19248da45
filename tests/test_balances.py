"""The bill of a growing log equals the bill of the whole log, however its lines are batched."""

import random
from datetime import datetime, timedelta

import pytest

from fleetvault.operators import usage
from fleetvault.streaming import balances, lifetimes

START = datetime(2024, 1, 30)
SCHEMA = "seq bigint, host string, ts timestamp_ntz, op string, bytes bigint"
LATER = datetime(2024, 8, 3, 5)


def log_rows(count, seed):
    draw = random.Random(seed)
    rows, at = [], {h: START + timedelta(hours=draw.randrange(90)) for h in "abc"}
    for seq in range(count):
        host = "a" if draw.random() < 0.6 else draw.choice("abc")
        at[host] += timedelta(minutes=draw.choice([0, 5, 50, 400, 30000 if draw.random() < 0.2 else 3]))
        op = draw.choice(["stored", "stored", "stored", "restored", "removed", "copied"])
        rows.append((seq, host, at[host], op, draw.randrange(10**12)))
    return rows


def bills(frame):
    return sorted(tuple(r) for r in frame.collect())


def expected(spark, rows, until):
    whole = spark.createDataFrame(rows, SCHEMA)
    return bills(usage.monthly_usage(usage.hourly_usage(whole, extrapolate_to=until)))


@pytest.mark.parametrize("shuffled,until", [(False, None), (True, LATER)])
def test_bill_of_batches_is_the_bill_of_the_log(spark, tmp_path, monkeypatch, shuffled, until):
    monkeypatch.setattr(lifetimes, "MERGE", 2)
    rows, store = log_rows(60, 4), str(tmp_path / "store")
    order = list(rows)
    if shuffled:
        random.Random(3).shuffle(order)
    for n in range(5):
        part = spark.createDataFrame(order[n * 12 : n * 12 + 12], SCHEMA)
        for _ in range(2 if n == 2 else 1):  # one is repeated
            balances.apply_batch(part, n, store, block_rows=4)
    assert bills(balances.bill(spark, store, until)) == expected(spark, rows, until)
    assert bills(balances.bill(spark, store, until, batch_id=1)) == expected(spark, order[:24], until)


def test_a_late_line_opens_its_own_month(spark, tmp_path):
    """Hours, lines and sums of other months are damaged: reading any of them would fail."""
    rows, store = log_rows(60, 8), tmp_path / "store"
    for n in range(2):
        balances.apply_batch(spark.createDataFrame(rows[n * 30 : n * 30 + 30], SCHEMA), n, str(store))
    late = (1000, "a", START + timedelta(hours=3), "stored", 7)
    for table in ("hours", "lines"):
        other = [f for f in (store / table).rglob("*.parquet") if "month=2024-01-01" not in str(f)]
        assert other
        for f in other:
            f.write_bytes(b"damaged")
            (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    balances.apply_batch(spark.createDataFrame([late], SCHEMA), 2, str(store))
    assert bills(balances.bill(spark, str(store))) == expected(spark, [*rows, late], None)


def test_late_lines_are_written_down_by_the_stream(spark, tmp_path):
    folder, store, hour = str(tmp_path / "log"), str(tmp_path / "store"), timedelta(hours=1)
    parts = [
        [(0, "h", START, "stored", 10), (1, "h", START + 5 * hour, "removed", 1), (2, "h", None, "stored", 1)],
        [(3, "h", START, "stored", 99), (4, "h", START + 4 * hour, "stored", 5), (5, "h", START + 9 * hour, "removed", 1)],
        [(6, "h", START + 4 * hour, "restored", 2), (7, "h", START, "removed", 9), (8, "g", START, "stored", 1)],
        [],
    ]
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        log = spark.readStream.schema(SCHEMA).parquet(folder)
        balances.start(log, store, str(tmp_path / "cp")).awaitTermination()
    found = sorted((r.host, r.hour, r.lines, r.net, r.trans_in, r.trans_out) for r in balances.late(spark, store).collect())
    assert found == [("g", START, 1, 1, 1, 0), ("h", START, 2, 90, 99, 0), ("h", START + 4 * hour, 1, -2, 0, 2)]
    kept = [r for part in parts for r in part if r[2] is not None]
    assert bills(balances.bill(spark, store)) == expected(spark, kept, None)


def test_no_lines_make_no_bill(spark, tmp_path):
    balances.apply_batch(spark.createDataFrame([], SCHEMA), 0, str(tmp_path / "store"))
    balances.apply_batch(spark.createDataFrame([(0, "h", START, "stored", 3)], SCHEMA), 1, str(tmp_path / "store"))
    assert bills(balances.bill(spark, str(tmp_path / "store"))) == expected(spark, [(0, "h", START, "stored", 3)], None)
