"""Set-wise operators against plain loops over the same rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetvault.operators import blocked, gates, history, listing, manifests, usage

START = datetime(2024, 1, 30, 20)


def log_rows(count, seed, hosts=("a", "b"), hot="a"):
    draw = random.Random(seed)
    rows, now = [], START
    for seq in range(count):
        now += timedelta(seconds=draw.choice([1, 40, 900, 3600, 9000]))
        host = hot if draw.random() < 0.7 else draw.choice(hosts)
        rows.append((seq, host, now, draw.choice(["stored", "stored", "restored", "removed"]), draw.randrange(1, 500)))
    return rows


def fold_hours(rows, until=None):
    """Walk one host's lines hour by hour."""
    hours, balance = {}, 0

    def open_hour(at):
        hours[at] = dict(bytes=balance, max_bytes=balance, peak_bytes=balance, trans_in=0, trans_out=0, activity=False)

    def advance(target):
        at = max(hours) if hours else None
        while at is None or at < target:
            at = target if at is None else at + timedelta(hours=1)
            open_hour(at)

    for _, _, ts, op, size in rows:
        at = ts.replace(minute=0, second=0, microsecond=0)
        advance(at)
        hour = hours[at]
        balance += size if op == "stored" else -size
        hour["bytes"], hour["activity"] = balance, True
        hour["peak_bytes"] = max(hour["peak_bytes"], balance)
        if op == "stored":
            hour["max_bytes"] = balance
            hour["trans_in"] += size
        elif op == "restored":
            hour["trans_out"] += size
    if until is not None:
        advance(until.replace(minute=0, second=0, microsecond=0))
    return hours


LOG = "seq bigint, host string, ts timestamp_ntz, op string, bytes bigint"


@pytest.mark.parametrize("block_rows", [1, 3, 50, 1_000_000])
@pytest.mark.parametrize("until", [None, datetime(2024, 1, 1), datetime(2024, 3, 2, 5, 30)])
def test_hourly_usage_equals_a_walk(spark, block_rows, until):
    rows = log_rows(150, block_rows)
    df = spark.createDataFrame(rows, LOG).repartition(5)
    found = {}
    for r in usage.hourly_usage(df, extrapolate_to=until, block_rows=block_rows).collect():
        d = r.asDict()
        found.setdefault(d.pop("host"), {})[d.pop("hour")] = d
    expected = {h: fold_hours([r for r in rows if r[1] == h], until) for h in ("a", "b")}
    assert found == expected


def test_hour_maximum_is_the_level_after_the_last_store(spark):
    rows = [(0, "a", START, "stored", 100), (1, "a", START, "removed", 100), (2, "a", START, "stored", 10)]
    hour = usage.active_hours(spark.createDataFrame(rows, LOG)).first()
    assert (hour.max_bytes, hour.peak_bytes, hour.bytes) == (10, 100, 10)


def test_monthly_usage(spark):
    rows = [(0, "a", datetime(2024, 1, 31, 22, 5), "stored", 2**30), (1, "a", datetime(2024, 2, 1, 1), "restored", 2**29)]
    hours = usage.hourly_usage(spark.createDataFrame(rows, LOG), extrapolate_to=datetime(2024, 2, 1, 3))
    months = {(r.year, r.month): r for r in usage.monthly_usage(hours).collect()}
    assert months[2024, 1].byte_hours == 2 * 2**30
    # Opening level in hours without a store, the new level afterwards.
    assert months[2024, 2].byte_hours == 2 * 2**30 + 2 * 2**29
    assert months[2024, 1].gb_months == 2 / 744
    assert (months[2024, 1].trans_in_gb, months[2024, 2].trans_out_gb) == (1.0, 0.5)
    kept = usage.hourly_usage(spark.createDataFrame(rows, LOG), restore_reduces=False)
    assert kept.orderBy(F.desc("hour")).first().bytes == 2**30


def test_shown_hours(spark):
    rows = [(0, "a", START, "stored", 1)]
    hours = usage.hourly_usage(spark.createDataFrame(rows, LOG), extrapolate_to=START + timedelta(hours=3))
    assert usage.shown_hours(hours).count() == 1
    assert usage.shown_hours(hours, show_extrapolations=True).count() == 4


@pytest.mark.parametrize("block_rows", [1, 4, 1000])
def test_running_and_late_lines(spark, block_rows):
    rows = log_rows(120, 5)
    rows = [(s, h, t - timedelta(hours=6 if s % 11 == 3 else 0), o, b) for s, h, t, o, b in rows]
    df = spark.createDataFrame(rows, LOG).repartition(3)
    level, reached, expected = {}, {}, {}
    for seq, host, ts, op, size in rows:
        level[host] = level.get(host, 0) + (size if op == "stored" else -size)
        hour = ts.replace(minute=0, second=0, microsecond=0)
        late = host in reached and hour < reached[host]
        reached[host] = max(reached.get(host, hour), hour)
        expected[seq] = (level[host], late)
    balance = {r.seq: r.balance for r in usage.running_balance(df, block_rows=block_rows).collect()}
    late = {r.seq: r.late for r in usage.late_lines(df, block_rows=block_rows).collect()}
    assert {s: (balance[s], late[s]) for s in balance} == expected
    assert any(late.values())


CHANGES = (
    "seq bigint, ts timestamp_ntz, host string, keyspace string, cf string, version string, "
    "generation bigint, component string, kind string, size bigint"
)


def change_rows(count, seed):
    draw = random.Random(seed)
    rows = []
    for seq in range(count):
        generation = 0 if draw.random() < 0.6 else draw.randrange(4)
        deleted = draw.random() < 0.2
        component = "Data.db" if deleted else draw.choice(["Data.db", "Index.db"])
        kind = "deleted" if deleted else draw.choice(["created", "moved"])
        ks = "k" + str(generation % 2)
        rows.append((seq * 3, START + timedelta(seconds=seq), "h", ks, "c", "hd", generation, component, kind, seq + 1))
    return rows


def fold_changes(rows):
    """The manifest of each keyspace after every event, and every file's lifetime."""
    live, lives, versions = {}, {}, []
    for seq, _, host, ks, _, _, generation, component, kind, size in rows:
        files = live.setdefault(ks, [])
        if kind == "deleted":
            for f in [f for f in files if f[0] == generation]:
                lives[f[2]] = seq
                files.remove(f)
        else:
            files.append((generation, component, seq, size))
            lives[seq] = None
        versions.append((ks, seq, sum(1 for v in versions if v[0] == ks) + 1, len(files), sum(f[3] for f in files)))
    return live, lives, versions


@pytest.mark.parametrize("block_rows", [1, 7, 60, 1_000_000])
def test_history_equals_a_walk(spark, block_rows):
    rows = change_rows(140, block_rows)
    df = spark.createDataFrame(rows, CHANGES).repartition(4)
    live, lives, versions = fold_changes(rows)
    lifetimes = history.lifetimes(df, block_rows=block_rows)
    assert {r.added_seq: r.removed_seq for r in lifetimes.collect()} == lives
    found = {(r.keyspace, r.seq, r.version, r.live_files, r.live_bytes) for r in history.versions(df, block_rows=block_rows).collect()}
    assert found == set(versions)
    now = {r.added_seq for r in history.live_now(lifetimes).collect()}
    assert now == {f[2] for files in live.values() for f in files}
    middle = 90
    _, partial, _ = fold_changes([r for r in rows if r[0] <= middle])
    then = {r.added_seq for r in history.live_at(lifetimes, middle).collect()}
    assert then == {s for s, gone in partial.items() if gone is None}


def test_following_is_linear_frame(spark):
    """Spark folds a frame that ends at the last row anew for every row."""
    df = spark.createDataFrame([(1, "a", 5)], "seq bigint, k string, v bigint")
    for fold in (blocked.following,):
        plan = fold(df, ["k"], "seq", {"m": (F.col("v"), "min")})._jdf.queryExecution().toString()
        assert "unboundedfollowing" not in plan.lower()


def test_versions_shuffle_their_events_once(spark):
    df = spark.createDataFrame(change_rows(40, 1), CHANGES)
    versions = history.versions(df)
    versions.collect()
    plan = versions._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan


def test_many_blocks_and_levels(spark, monkeypatch):
    """Sparse numbers make a block of almost every row; the blocks are folded in levels."""
    monkeypatch.setattr(blocked, "FAN_IN", 3)
    rows = [(k, s * s * 7, s) for k in ("a", "b") for s in range(1, 60)]
    df = spark.createDataFrame(rows, "k string, seq bigint, v bigint")
    for levels in (1, 2, 3):
        monkeypatch.setattr(blocked, "LEVELS", levels)
        folds = {"total": (F.col("v"), "sum"), "top": (F.col("v"), "max")}
        up = blocked._fold(df, ["k"], "seq", folds, 4, 0, levels=levels)
        assert all((r.total, r.top) == (r.v * (r.v + 1) // 2, r.v) for r in up.collect())
        down = blocked._fold(df, ["k"], "seq", {"low": (F.col("v"), "min")}, 4, -1, True, levels=levels)
        assert all(r.low == (r.v + 1 if r.v < 59 else None) for r in down.collect())
        assert up.columns == [*df.columns, "total", "top"]


def test_building_a_plan_starts_no_job(spark):
    df = spark.createDataFrame(change_rows(40, 1), CHANGES)
    body = spark.createDataFrame([("h", "k", START, "cf", "hd", 1, "Data.db", 5)], COMPONENT_ROW)
    group = "planning"
    spark.sparkContext.setJobGroup(group, group)
    try:
        history.versions(df)
        history.lifetimes(df)
        nested = manifests.build(body, BODY)
        manifests.for_days(nested, nested.select("keyspace", "host", F.to_date("ts").alias("day")))
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


COMPONENT_ROW = "host string, keyspace string, ts timestamp_ntz, cf string, version string, generation bigint, component string, size bigint"
BODY = ["version", "generation", "component", "size"]


@pytest.mark.parametrize("part_files", [1, 3, 1000])
def test_manifest_build_and_explode(spark, part_files):
    rows = [("h", "k", START, f"cf{i % 3}", "hd", i, "Data.db", i * 10) for i in range(20)]
    rows += [("h", "k2", START, "cf", "hd", 1, "Data.db", 5)] * 2
    df = spark.createDataFrame(rows, COMPONENT_ROW)
    nested = manifests.build(df, BODY, part_files=part_files)
    if part_files == 1000:
        assert nested.count() == 2 and {r.parts for r in nested.collect()} == {1}
    back = manifests.explode(nested).select(df.columns)
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_every_large_manifest_is_split_and_listed_once(spark):
    """However many backups are large, each is cut into parts, and each is one backup."""
    rows = [("h", "k", START + timedelta(hours=b), "cf", "hd", i, "Data.db", 1) for b in range(40) for i in range(30)]
    nested = manifests.build(spark.createDataFrame(rows, COMPONENT_ROW), BODY, part_files=10)
    parts = nested.groupBy("ts").agg(F.count("*").alias("n"), F.max("parts").alias("parts")).collect()
    assert len(parts) == 40 and all(r.n > 1 and r.parts == 3 for r in parts)
    assert manifests.listed(nested).count() == manifests.backups(nested).count() == 40
    names = manifests.listed(nested).select("name")
    assert manifests.by_name(nested, names).count() == 40
    assert manifests.explode(manifests.parts_by_name(nested, names)).count() == 1200


def test_manifest_listing(spark):
    rows = [(i, "k", h, START + timedelta(hours=i)) for i in range(8) for h in ("n-1", "n-2")]
    df = spark.createDataFrame(rows, "manifest_id bigint, keyspace string, host string, ts timestamp_ntz")
    day = START.date()
    of_day = manifests.listed(df, "k", "n-1", day).collect()
    assert [r.ts for r in of_day] == [START + timedelta(hours=i) for i in range(4)]
    last = manifests.listed(df, "k", "n-1", day, list_all=False).collect()
    assert [r.ts for r in last] == [START + timedelta(hours=3)]
    name = last[0].name
    assert [r.ts for r in manifests.one_by_name(df, name).collect()] == [last[0].ts]
    assert manifests.one_by_name(df, "junk").count() == 0
    names = spark.createDataFrame([(name,), (name,), ("junk",)], "name string")
    assert [(r.host, r.ts) for r in manifests.by_name(df, names).collect()] == [("n-1", last[0].ts)]
    requests = spark.createDataFrame([("k", "n-2", day)] * 2, "keyspace string, host string, day date")
    assert manifests.for_days(df, requests).count() == 4


ELIGIBILITY = {
    "/d/ks/cf/ks-cf-hd-1-Data.db": "eligible",
    "/d/ks/cf/snapshots/1/ks-cf-tmp-hd-1-Data.db": "snapshot",
    "/d/ks/cf/README": "not_data_file",
    "/d/ks/cf/ks-cf-9-1-Data.db": "invalid_version",
    "/d/ks/cf/skip-cf-tmp-hd-1-Data.db": "temporary",
    "/d/skip/cf/skip-cf-hd-1-Data.db": "excluded_keyspace",
    "/d/Skip/cf/Skip-cf-hd-1-Data.db": "eligible",
    "/d/System/x/System-x-ib-1-Data.db": "system_keyspace",
}


def test_eligibility(spark):
    df = spark.createDataFrame([(p,) for p in ELIGIBILITY], "path string")
    found = {r.path: r.reason for r in gates.eligibility(df, excluded=["skip"]).collect()}
    assert found == ELIGIBILITY
    with_system = gates.eligibility(df, include_system=True).filter("reason = 'eligible'")
    assert with_system.count() == 4
    gone = gates.eligibility(df, vanished=F.lit(True)).select("reason").distinct().collect()
    assert [r[0] for r in gone] == ["vanished"]


EVENTS = "seq bigint, ts timestamp_ntz, host string, kind string, src_path string, dest_path string, size bigint, is_initial boolean"


def event(seq, kind, src, dest=None, initial=False):
    return (seq, START, "h", kind, src, dest, 1, initial)


def test_change_gate(spark):
    data, index = "/d/k/c/k-c-hd-1-Data.db", "/d/k/c/k-c-hd-1-Index.db"
    temporary = "/d/k/c/k-c-tmp-hd-1-Data.db"
    rows = [
        event(0, "created", data, initial=True),
        event(1, "created", temporary),
        event(2, "moved", temporary, data),
        event(3, "deleted", index),
        event(4, "deleted", data),
        event(5, "deleted", temporary),
        event(6, "deleted", "/d/k/c/snapshots/s/k-c-hd-1-Data.db"),
        event(7, "deleted", "/d/system/c/system-c-hd-1-Data.db"),
    ]
    df = spark.createDataFrame(rows, EVENTS)

    def pick(flag, **options):
        return {r.seq for r in gates.judge_changes(df, **options).filter(flag).collect()}

    assert pick("accepted") == {0, 2, 4, 5, 7}
    assert pick("emits", ignore_existing=True) == {2, 4, 5, 7}
    assert pick("accepted", ignore_existing=True) == {0, 2, 4, 5, 7}
    assert pick("emits", ignore_changes=True) == {0}


def test_listing(spark):
    paths = ["r/a/1", "r/a/1-meta.json", "r/b/c/2", "r/3", "s/4", "rr/5"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")

    def ls(*args, **options):
        return sorted((r.entry, r.is_dir) for r in listing.list_dir(df, *args, **options).collect())

    assert ls("r") == [("3", False)]
    assert ls("r/", include_dirs=True) == [("3", False), ("a", True), ("b", True)]
    assert ls("r", include_files=False, include_dirs=True) == [("a", True), ("b", True)]
    assert ls("r", recursive=True) == [("r/3", False), ("r/a/1", False), ("r/b/c/2", False)]
    assert ls("r", include_files=False, include_dirs=True, recursive=True) == [
        ("r/a", True), ("r/b", True), ("r/b/c", True)
    ]
    assert ls("r", include_files=False) == []
    dirs = {r[0] for r in listing.directories(df).collect()}
    assert dirs == {"r", "r/a", "r/b", "r/b/c", "s", "rr"}


def test_file_listing_moves_no_rows(spark):
    df = spark.createDataFrame([("r/a",)], "path string")
    plan = listing.list_dir(df, "r", recursive=True)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
