"""How the files of a keyspace change over time.

A file is live from the event that added it until the first later deletion of the data
component of its SSTable. These lifetimes are the stored form of all manifest versions: the
manifest at any event is a filter on them, instead of one copy of the file list per event.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetvault.functions.paths import SSTABLE, backup_name
from fleetvault.operators.blocked import BLOCK_ROWS, following, running
from fleetvault.operators.intervals import containing
from fleetvault.operators.manifests import build

OWNER = ("host", "keyspace")
TABLE_KEY = ("host", *SSTABLE)


def with_removal(
    changes: DataFrame,
    key: Sequence[str] = TABLE_KEY,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add ``removed_seq``: the next deletion of the row's SSTable."""
    deletion = F.when(F.col("kind") == "deleted", F.col("seq"))
    folds = {"removed_seq": (deletion, "min")}
    return following(changes, key, "seq", folds, block_rows)


def lifetimes(
    changes: DataFrame,
    key: Sequence[str] = TABLE_KEY,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One row per add (or move) with the event that ended it, null while live.

    A file added twice has two rows, as it has two entries in the manifest.
    """
    added = with_removal(changes, key, block_rows).filter(F.col("kind") != "deleted")
    return added.withColumnsRenamed({"seq": "added_seq", "ts": "added_ts"}).select(
        *key, "component", "size", "added_seq", "added_ts", "removed_seq"
    )


def live_at(lives: DataFrame, seq: int) -> DataFrame:
    """The manifest contents right after event ``seq``."""
    return lives.filter(
        (F.col("added_seq") <= seq)
        & (F.col("removed_seq").isNull() | (F.col("removed_seq") > seq))
    )


def manifests_at(lives: DataFrame, requests: DataFrame, owner: Sequence[str] = OWNER) -> DataFrame:
    """The files live right after each requested event (owner, seq), with its number as ``at_seq``.

    Lifetimes are looked up in an interval index, so that a request meets the files of its
    manifest and those that come or go near it, not all that its owner ever had.
    """
    asked = requests.select(*owner, F.col("seq").alias("at_seq")).distinct()
    return containing(lives, asked, owner, "added_seq", "removed_seq", "at_seq")


def backup_manifests(
    lives: DataFrame,
    events: DataFrame,
    body: Sequence[str] = ("version", "generation", "component", "size"),
    owner: Sequence[str] = OWNER,
) -> DataFrame:
    """The manifest that each accepted upload or deletion (owner, seq, ts) writes, nested.

    An event that leaves no file behind writes a manifest without components.
    """
    files = manifests_at(lives, events, owner).drop("added_ts")
    told = events.select(*owner, F.col("seq").alias("at_seq"), "ts").distinct()
    keys = [*owner, "at_seq", "ts"]
    nested = build(files.join(told, [*owner, "at_seq"]), body, keys)
    written = told.join(nested, keys, "left")
    return written.withColumn("name", backup_name(F.col("ts")))


def live_now(lives: DataFrame) -> DataFrame:
    return lives.filter(F.col("removed_seq").isNull())


def versions(
    changes: DataFrame,
    owner: Sequence[str] = OWNER,
    key: Sequence[str] = TABLE_KEY,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One row per manifest version: number, event, name, live files and bytes after it.

    An event adds its file where it happens and takes it away where its SSTable goes; both
    contributions are summed per event before the running totals.
    """
    events = with_removal(changes, key, block_rows)
    adds = F.col("kind") != "deleted"
    zero = F.lit(0).cast("bigint")

    def step(seq, ts, files, size):
        return F.struct(
            seq.alias("seq"), ts.alias("ts"), files.cast("bigint").alias("_files"), size.alias("_bytes")
        )

    arrival = step(
        F.col("seq"),
        F.col("ts"),
        F.when(adds, 1).otherwise(0),
        F.when(adds, F.col("size")).otherwise(zero),
    )
    no_time = F.lit(None).cast("timestamp_ntz")
    leaving = step(F.col("removed_seq"), no_time, F.lit(-1), -F.col("size"))
    steps = F.when(adds & F.col("removed_seq").isNotNull(), F.array(arrival, leaving)).otherwise(
        F.array(arrival)
    )
    per_event = (
        events.select(*owner, F.inline(steps))
        .groupBy(*owner, "seq")
        .agg(F.max("ts").alias("ts"), F.sum("_files").alias("_files"), F.sum("_bytes").alias("_bytes"))
    )
    totals = {
        "version": (F.lit(1).cast("bigint"), "sum"),
        "live_files": (F.col("_files"), "sum"),
        "live_bytes": (F.col("_bytes"), "sum"),
    }
    numbered = running(per_event, owner, "seq", totals, block_rows, shared=True)
    return numbered.withColumn("name", backup_name(F.col("ts"))).drop("_files", "_bytes")


def live_totals(changes: DataFrame, **options) -> DataFrame:
    """Live files and bytes per keyspace after each event."""
    return versions(changes, **options).drop("version", "name")
