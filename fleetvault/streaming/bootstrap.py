"""From a first scan to a watch: inventories as events, and what a scan makes of later events.

A watch is started before the first scan, so that nothing falls between them; then some events
tell what the scan has already seen. ``unseen`` leaves those out. After a gap in the watch, ``difference``
compares two scans and gives the events that lead from one to the other.

Scans are rows (host, path, size, md5), a path once per host. A scan lists one folder after the other;
when it listed which is a table of its own (host, folder, seen_at), with empty folders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILE = ("host", "path")
IDENTITY = ("host", "size", "md5")


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """Change events (host, kind, src_path, dest_path, size) that lead from one scan to the next.

    One full outer join on (host, path). A file in both with another size or digest was written again:
    ``created``. A file that is gone and one that is new are one ``moved`` event if they are the only
    gone and the only new file of their host with that size and digest; among several there is no
    telling which went where, so they are deletions and creations. A file without a digest is never
    moved. Counting per identity combines before it moves, so a digest shared by very many files (an
    empty file, say) gathers in no task.
    """
    old = before.select(*FILE, F.struct("size", "md5").alias("_old"))
    new = after.select(*FILE, F.struct("size", "md5").alias("_new"))
    both = old.join(new, list(FILE), "full_outer")
    gone, fresh = F.col("_new").isNull(), F.col("_old").isNull()
    kind = F.when(gone, "deleted").otherwise("created")
    changed = both.filter(gone | fresh | ~F.col("_old").eqNullSafe(F.col("_new")))
    value = F.coalesce("_new", "_old")
    rows = changed.select(
        *FILE, kind.alias("kind"), value["size"].alias("size"), value["md5"].alias("md5"), (gone | fresh).alias("_one_sided")
    )
    loose = rows.filter("_one_sided AND md5 IS NOT NULL")
    left, came = F.col("kind") == "deleted", F.col("kind") == "created"
    pairs = (
        loose.groupBy(*IDENTITY)
        .agg(
            F.count_if(left).alias("_left"), F.count_if(came).alias("_came"),
            F.max(F.when(left, F.col("path"))).alias("src_path"), F.max(F.when(came, F.col("path"))).alias("dest_path"),
        )
        .filter("_left = 1 AND _came = 1")
    )
    moves = pairs.select("host", F.lit("moved").alias("kind"), "src_path", "dest_path", "size")
    ends = pairs.select("host", F.explode(F.array("src_path", "dest_path")).alias("path"))
    plain = rows.join(ends, list(FILE), "left_anti").select(
        "host", "kind", F.col("path").alias("src_path"), F.lit(None).cast("string").alias("dest_path"), "size"
    )
    return plain.unionByName(moves)


def unseen(events: DataFrame, listed: DataFrame) -> DataFrame:
    """The events, a stream or a table, without those that the scan has already seen.

    An event is seen if the folder of its file (of its destination, for a move) was listed at its
    time or later: the listing shows what came of it. Judging single files would go wrong: the
    deletion of an SSTable removes files that were written again before the listing. Events of
    folders that were not listed stay, as do events without a time. ``streaming.events.initial``
    turns the scan itself into events; give them the time at which the scan ended.
    """
    path = F.when(F.col("kind") == "moved", F.col("dest_path")).otherwise(F.col("src_path"))
    times = listed.select(F.col("host").alias("_host"), F.col("folder").alias("_folder"), "seen_at")
    here = (F.col("host") == F.col("_host")) & (F.regexp_extract(path, "^(.*)/[^/]*$", 1) == F.col("_folder"))
    told = events.join(times, here, "left")
    old = F.coalesce(F.col("ts") <= F.col("seen_at"), F.lit(False))
    return told.filter(~old).drop("_host", "_folder", "seen_at")
