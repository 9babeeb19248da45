"""Component lifetimes kept up to date by a stream of change events.

State is kept by SSTable, in ``BUCKETS`` buckets of a hash of it. A micro-batch opens only the
buckets of its own SSTables: their live files as last written whole, and what the batches since
then said about them. When ``snapshot_every`` batches have spoken about a bucket, its live files are
written whole again. A file that is gone cannot change any more, so ended lifetimes are not read.

SSTables for which a batch holds an event older than one already seen from their host are worked out
again from all their events, of which again only their buckets are read. Either way the result
equals the batch operator.

Events and statements are kept in runs: ``MERGE`` runs of one level are merged into one run of the next,
in which only the newest statement about a file is left. So any reader opens a number of runs that
grows with the logarithm of the number of batches.

Each batch writes its own folders in overwrite mode and reads only those of earlier ones, so a
repeated batch replaces itself. ``heads`` says where each bucket's state lies; it is written last.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from fleetvault.operators.blocked import BLOCK_ROWS
from fleetvault.operators.gates import accepted_changes
from fleetvault.operators.history import TABLE_KEY, lifetimes, live_now

EVENT_COLUMNS = (*TABLE_KEY, "component", "seq", "ts", "kind", "size")
SNAPSHOT_EVERY = 16
BUCKETS = 64
MERGE = 16

HEAD = "bucket int, whole int, since array<int>"
# A run of a batch that added nothing has no file to take the columns from.
LIFE = T.StructType(
    [
        *[T.StructField(c, T.LongType() if c == "generation" else T.StringType()) for c in (*TABLE_KEY, "component")],
        *[T.StructField(c, T.LongType()) for c in ("size", "added_seq")],
        T.StructField("added_ts", T.TimestampNTZType()),
        T.StructField("removed_seq", T.LongType()),
        *[T.StructField(c, T.IntegerType()) for c in ("batch", "bucket")],
    ]
)


def bucket_of() -> Column:
    return F.pmod(F.xxhash64(*TABLE_KEY), F.lit(BUCKETS)).cast("int")


def run_folder(store: str, table: str, level: int, run: int) -> str:
    return f"{store}/{table}/level={level}/run={run}"


def runs(batches: int) -> list[tuple[int, int]]:
    """The (level, run) that hold the first ``batches`` batches, oldest first."""
    found, done, level = [], 0, 0
    while MERGE ** (level + 1) <= batches:
        level += 1
    for down in range(level, -1, -1):
        size = MERGE**down
        while batches - done >= size:
            found.append((down, done // size))
            done += size
    return found


def _write(df: DataFrame, store: str, table: str, run: int, level: int = 0) -> None:
    df.write.mode("overwrite").partitionBy("bucket").parquet(run_folder(store, table, level, run))


def _read(
    spark: SparkSession, schema: T.StructType, store: str, table: str, places: Iterable[tuple[int, int]]
) -> DataFrame:
    """Runs of a table with their ``bucket``; filters on it keep other buckets' files closed."""
    reader = spark.read.schema(schema).option("basePath", f"{store}/{table}")
    return reader.parquet(*[run_folder(store, table, *place) for place in places]).drop("level")


def _newest(told: DataFrame) -> DataFrame:
    """Of several statements about the same added file the newest wins."""
    value = F.max_by(F.struct("size", "added_ts", "removed_seq"), "batch").alias("_v")
    own = F.max("batch").alias("batch")
    return told.groupBy("bucket", *TABLE_KEY, "component", "added_seq").agg(value, own).select(
        *TABLE_KEY, "component", "_v.size", "added_seq", "_v.added_ts", "_v.removed_seq", "batch", "bucket"
    )


def _fields(columns: Sequence[str], schema: T.StructType) -> T.StructType:
    whole = [schema[c] for c in columns if c != "bucket"]
    return T.StructType([*whole, T.StructField("bucket", T.IntegerType())])


def _state(
    spark: SparkSession, schema: T.StructType, store: str, heads: dict[int, tuple[int, list[int]]]
) -> DataFrame | None:
    """What was said about the files of these buckets since, and with, their last whole writing."""
    parts = []
    numbered = T.StructType([*schema.fields, T.StructField("run", T.IntegerType())])
    for table, places in (
        ("live", [(whole, b) for b, (whole, _) in heads.items() if whole >= 0]),
        ("lifetimes", [(run, b) for b, (_, since) in heads.items() for run in since]),
    ):
        by_run: dict[int, list[int]] = {}
        for run, bucket in places:
            by_run.setdefault(run, []).append(bucket)
        if by_run:
            # A bucket may have older whole writings too: each run counts for its own buckets only.
            own = [(F.col("run") == r) & F.col("bucket").isin(b) for r, b in sorted(by_run.items())]
            rows = _read(spark, numbered, store, table, [(0, r) for r in sorted(by_run)])
            parts.append(rows.filter(reduce(lambda a, b: a | b, own)).drop("run"))
    return reduce(DataFrame.unionByName, parts) if parts else None


def _touched(rows: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rows of the SSTables the batch has events for; one of them may be very large."""
    return rows.join(fresh.select(*TABLE_KEY).distinct(), list(TABLE_KEY), "left_semi")


def _buckets(rows: DataFrame) -> list[int]:
    return sorted(r.bucket for r in rows.select("bucket").distinct().collect())  # at most BUCKETS


def _heads(spark: SparkSession, store: str, batch_id: int) -> dict[int, tuple[int, list[int]]]:
    if batch_id < 0:
        return {}
    rows = spark.read.schema(HEAD).parquet(f"{store}/heads/batch={batch_id}").collect()  # at most BUCKETS
    return {r.bucket: (r.whole, list(r.since)) for r in rows}


def _merge(spark: SparkSession, schemas: dict[str, T.StructType], store: str, batch_id: int) -> None:
    """Merge runs that this batch has made complete, level by level."""
    level = 1
    while (batch_id + 1) % MERGE**level == 0:
        run = batch_id // MERGE**level
        below = [(level - 1, n) for n in range(run * MERGE, (run + 1) * MERGE)]
        for table, schema in schemas.items():
            rows = _read(spark, schema, store, table, below).drop("run")
            _write(_newest(rows) if table == "lifetimes" else rows, store, table, run, level)
        level += 1


def apply_batch(
    batch: DataFrame,
    batch_id: int,
    store: str,
    block_rows: int = BLOCK_ROWS,
    snapshot_every: int = SNAPSHOT_EVERY,
    **gate,
) -> None:
    spark = batch.sparkSession
    accepted = accepted_changes(batch, **gate).select(*EVENT_COLUMNS).withColumn("bucket", bucket_of())
    event_schema = _fields(accepted.columns, accepted.schema)
    _write(accepted, store, "events", batch_id)
    fresh = _read(spark, event_schema, store, "events", [(0, batch_id)]).drop("run")
    touched = _buckets(fresh)

    reached = fresh.groupBy("host").agg(F.max("seq").alias("reached"))
    late, late_buckets = None, []
    if batch_id > 0:
        before = spark.read.schema("host string, reached long").parquet(f"{store}/reached/batch={batch_id - 1}")
        late = fresh.join(before, "host").filter("seq < reached").select(*TABLE_KEY, "bucket").distinct()
        late_buckets = _buckets(late)
        reached = before.unionByName(reached).groupBy("host").agg(F.max("reached").alias("reached"))
    reached.write.mode("overwrite").parquet(f"{store}/reached/batch={batch_id}")

    heads = _heads(spark, store, batch_id - 1)
    rows = (fresh.join(late, list(TABLE_KEY), "left_anti") if late_buckets else fresh).select(*EVENT_COLUMNS)
    told = lifetimes(rows, block_rows=block_rows).withColumns({"batch": F.lit(batch_id), "bucket": bucket_of()})
    life_schema = _fields(told.columns, told.schema)
    state = _state(spark, life_schema, store, {b: heads[b] for b in touched if b in heads})
    if state is not None:
        earlier = _touched(live_now(_newest(state)), rows)
        earlier = earlier.withColumnsRenamed({"added_seq": "seq", "added_ts": "ts"}).withColumn("kind", F.lit("created"))
        rows = rows.unionByName(earlier.select(*EVENT_COLUMNS))
    if late_buckets:
        every = _read(spark, event_schema, store, "events", [*runs(batch_id), (0, batch_id)])
        old = _touched(every.filter(F.col("bucket").isin(late_buckets)), late)
        rows = rows.unionByName(old.select(*EVENT_COLUMNS))
    told = lifetimes(rows, block_rows=block_rows).withColumns({"batch": F.lit(batch_id), "bucket": bucket_of()})
    _write(told, store, "lifetimes", batch_id)

    heads |= {b: (w, [*s, batch_id]) for b in touched for w, s in [heads.get(b, (-1, []))]}
    full = {b: h for b, h in heads.items() if len(h[1]) >= snapshot_every}
    if full:
        _write(live_now(_newest(_state(spark, life_schema, store, full))), store, "live", batch_id)
        heads |= {b: (batch_id, []) for b in full}
    _merge(spark, {"events": event_schema, "lifetimes": life_schema}, store, batch_id)
    rows = [(b, w, s) for b, (w, s) in sorted(heads.items())]
    spark.createDataFrame(rows, HEAD).coalesce(1).write.mode("overwrite").parquet(f"{store}/heads/batch={batch_id}")


def start(
    events: DataFrame,
    store: str,
    checkpoint: str,
    block_rows: int = BLOCK_ROWS,
    snapshot_every: int = SNAPSHOT_EVERY,
    trigger: dict | None = None,
    **gate,
) -> StreamingQuery:
    """Keep the lifetimes below ``store``; ``gate`` goes to the eligibility rules.

    A store keeps the ``snapshot_every`` it was started with.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        apply_batch(batch, batch_id, store, block_rows, snapshot_every, **gate)

    return (
        events.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def last_batch(spark: SparkSession, store: str) -> int:
    """The newest batch whose state is complete."""
    return spark.read.schema(f"{HEAD}, batch int").parquet(f"{store}/heads").agg(F.max("batch")).first()[0]


def read(spark: SparkSession, store: str, batch_id: int | None = None) -> DataFrame:
    """All lifetimes as of a batch, the last one unless told."""
    after = (last_batch(spark, store) if batch_id is None else batch_id) + 1
    reader = spark.read.schema(LIFE).option("basePath", f"{store}/lifetimes")
    told = reader.parquet(*[run_folder(store, "lifetimes", *place) for place in runs(after)])
    return _newest(told).drop("batch", "bucket")


def live(spark: SparkSession, store: str, batch_id: int | None = None) -> DataFrame:
    """The files live after a batch, from the buckets' own state; ended lifetimes are not read."""
    at = last_batch(spark, store) if batch_id is None else batch_id
    heads = _heads(spark, store, at)
    state = _state(spark, LIFE, store, heads)
    return live_now(_newest(state)).drop("batch", "bucket")
