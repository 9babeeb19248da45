"""A scan and the events around it give what the whole history gives; two scans give their events."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from fleetvault.operators import gates, history
from fleetvault.schemas import CHANGE_EVENT
from fleetvault.streaming import bootstrap, events

START = datetime(2024, 1, 1)
SCAN = "host string, path string, size long, md5 string"


def found(frame):
    return sorted(map(tuple, frame.select("host", "kind", "src_path", "dest_path", "size").collect()), key=str)


def test_difference_of_two_scans(spark):
    before = [
        ("h", "same", 1, "a"), ("h", "again", 2, "b"), ("h", "gone", 3, "c"), ("h", "from", 4, "d"),
        ("h", "e1", 0, "e"), ("h", "e2", 0, "e"), ("h", "undigested", 5, None), ("i", "from", 4, "x"), ("h", "grown", 5, "g"),
    ]
    after = [
        ("h", "same", 1, "a"), ("h", "again", 2, "B"), ("h", "to", 4, "d"), ("h", "e3", 0, "e"), ("h", "e4", 0, "e"),
        ("h", "digestless", 5, None), ("i", "same", 1, "a"), ("j", "to", 4, "x"), ("h", "grown", 6, "g"), ("h", "fresh", 1, "a"),
    ]
    frames = [spark.createDataFrame(rows, SCAN) for rows in (before, after)]
    gone = [("h", "gone", 3), ("h", "e1", 0), ("h", "e2", 0), ("h", "undigested", 5), ("i", "from", 4)]
    came = [
        ("h", "again", 2), ("h", "e3", 0), ("h", "e4", 0), ("h", "digestless", 5), ("i", "same", 1), ("j", "to", 4),
        ("h", "grown", 6), ("h", "fresh", 1),
    ]
    want = [("h", "moved", "from", "to", 4)]
    want += [(h, "deleted", p, None, s) for h, p, s in gone] + [(h, "created", p, None, s) for h, p, s in came]
    assert found(bootstrap.difference(*frames)) == sorted(want, key=str)
    assert found(bootstrap.difference(frames[0], frames[0])) == []
    nothing = spark.createDataFrame([], SCAN)
    assert len(found(bootstrap.difference(nothing, frames[1]))) == len(after)


def test_scan_and_watch_that_overlap(spark):
    """Folders are listed at different times while files are written, deleted and written again."""
    draw, rows = random.Random(7), []
    for seq in range(300):
        kind = draw.choice(["created", "created", "moved", "deleted"])
        part = "Data.db" if kind == "deleted" else draw.choice(["Data.db", "Index.db"])
        cf = draw.randrange(3)
        name = f"/d/k/c{cf}/k-c{cf}-hd-{draw.randrange(4)}-{part}"
        rows.append((seq, START + timedelta(minutes=seq), "h", kind, name, name, seq, False))
    every = spark.createDataFrame(rows, CHANGE_EVENT)
    times = {0: 100, 1: 150}  # the third folder was not listed: it came later
    listed = spark.createDataFrame(
        [("h", f"/d/k/c{cf}", START + timedelta(minutes=at)) for cf, at in times.items()],
        "host string, folder string, seen_at timestamp_ntz",
    )

    def live(frame):
        lives = history.live_now(history.lifetimes(gates.accepted_changes(frame)))
        name = F.concat_ws("-", "keyspace", "cf", "version", "generation", "component")
        return lives.select(F.concat(F.lit("/d/k/"), "cf", F.lit("/"), name).alias("path"), "size")

    seen = [r for r in rows if r[0] <= times.get(int(r[4].split("/c")[1][0]), -1)]
    scan = live(spark.createDataFrame(seen, CHANGE_EVENT)).dropDuplicates(["path"])
    first = events.initial(scan, F.lit("h"), F.lit(START + timedelta(days=2)))
    watched = bootstrap.unseen(first.unionByName(every), listed)
    assert {r.path for r in live(watched).collect()} == {r.path for r in live(every).collect()}
    assert watched.count() == scan.count() + len(rows) - len(seen)
    assert watched.columns == every.columns
