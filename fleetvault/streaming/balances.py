"""The monthly bill kept up to date while the transfer log grows.

An hour is kept relative to the balance that it opens with, and so is a month: its byte-hours are
a fixed amount plus its opening balance times its hours. So a line that comes late changes its own
hour and its own month of its own host, and nothing else that is stored; the later months of that
host only open with another balance, which is added up over one row per host and month when the
bill is read. No batch reads the log again.

A micro-batch sums its own lines and joins them with the stored sums of the same hours. Where the
lines of an hour arrive in turns (a stored line lies between new ones in line order), only that hour is
summed again, from the stored lines of its month. Lines, hours and months are kept in folders per
month, so a batch opens the months of its own lines. All tables are kept in runs as in
``streaming.lifetimes``: a batch writes its own folders in overwrite mode and reads those of
earlier ones, so a repeated batch replaces itself; ``MERGE`` runs become one of the next level.

The stream also writes down what came late: per host and hour the lines, and their sums, of hours that
had been closed when the batch began, which is ``lateness_hours`` after their end by the newest time
seen. They are part of the bill all the same.

Sequence numbers must be unique within their host. Lines without a time belong to no hour and are left
out; lines of an unknown operation count as lines and change nothing.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from fleetvault.functions.times import trunc_hour
from fleetvault.operators.blocked import BLOCK_ROWS
from fleetvault.operators.usage import billed, hour_changes
from fleetvault.streaming import lifetimes, usage

LINE = ("host", "seq", "ts", "op", "bytes")
HOUR = ("lines", "net", "held", "peak", "trans_in", "trans_out", "first_seq", "last_seq")
WIDE = "decimal(38,0)"


def month_of(time: Column) -> Column:
    return F.trunc(time.cast("date"), "month")


def hour_number(time: Column) -> Column:
    """Hours since 1970 of a wall-clock time."""
    return F.unix_date(time.cast("date")).cast("bigint") * 24 + F.hour(time)


def _write(df: DataFrame, store: str, table: str, run: int, level: int = 0) -> None:
    df.write.mode("overwrite").partitionBy("month").parquet(lifetimes.run_folder(store, table, level, run))


def _read(spark: SparkSession, schema: T.StructType, store: str, table: str, places, months: list[date] | None = None) -> DataFrame:
    """Runs of a table; of other months than those asked for no file is opened."""
    own = T.StructType([*[f for f in schema if f.name != "month"], T.StructField("month", T.DateType())])
    reader = spark.read.schema(own).option("basePath", f"{store}/{table}")
    rows = reader.parquet(*[lifetimes.run_folder(store, table, *place) for place in places]).drop("level", "run")
    return rows if months is None else rows.filter(F.col("month").isin(months))


def _newest(rows: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Of several rows about the same hour or month that of the newest batch."""
    rest = [c for c in rows.columns if c not in key]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("_r"))
    return last.select(*key, *[F.col("_r")[c].alias(c) for c in rest])


HOUR_KEY = ("month", "host", "hour")
MONTH_KEY = ("month", "host")


def _total(rows: DataFrame) -> DataFrame:
    names = ("lines", "net", "trans_in", "trans_out")
    return rows.groupBy(*HOUR_KEY).agg(*[F.sum(c).alias(c) for c in names])


#: How rows of merged runs become one.
MERGED = {
    "lines": lambda rows: rows,
    "late": _total,
    "hours": lambda rows: _newest(rows, HOUR_KEY),
    "months": lambda rows: _newest(rows, MONTH_KEY),
}


def _joined(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hours whose stored and new lines follow each other, joined; and those (month, host, hour) that mix."""
    fields = F.struct(*HOUR)
    both = old.select(*HOUR_KEY, *HOUR).unionByName(new.select(*HOUR_KEY, *HOUR)).groupBy(*HOUR_KEY)
    pairs = both.agg(
        F.min_by(fields, "first_seq").alias("a"), F.max_by(fields, "first_seq").alias("b"), F.count("*").alias("n")
    )
    mixed = F.col("a.last_seq") >= F.col("b.first_seq")
    a, b = F.col("a"), F.col("b")
    after = F.struct(
        (a.lines + b.lines).alias("lines"),
        (a.net + b.net).alias("net"),
        F.coalesce(a.net + b.held, a.held).alias("held"),
        F.greatest(a.peak, a.net + b.peak).alias("peak"),
        (a.trans_in + b.trans_in).alias("trans_in"),
        (a.trans_out + b.trans_out).alias("trans_out"),
        a.first_seq.alias("first_seq"),
        b.last_seq.alias("last_seq"),
    )
    whole = pairs.filter((F.col("n") == 1) | ~mixed).withColumn("r", F.when(F.col("n") == 1, a).otherwise(after))
    return whole.select(*HOUR_KEY, "r.*"), pairs.filter((F.col("n") > 1) & mixed).select(*HOUR_KEY)


def month_sums(hours: DataFrame) -> DataFrame:
    """One row per host and month, relative to the balance that the month opens with.

    ``byte_hours`` adds up what each hour from the first to the last one with lines is billed with
    when the month opens at zero; ``span`` counts those hours. A month has 744 hours at most.
    """
    by = Window.partitionBy(*MONTH_KEY).orderBy("hour")
    opening = F.coalesce(F.sum("net").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    until = F.coalesce(F.lead("_n").over(by) - 1, F.col("_n"))
    rows = hours.withColumn("_n", hour_number(F.col("hour"))).withColumns({"_open": opening, "_until": until})
    idle = (F.col("_until") - F.col("_n")).cast(WIDE) * (F.col("_open") + F.col("net")).cast(WIDE)
    own = (F.col("_open") + F.coalesce("held", F.lit(0))).cast(WIDE)
    return rows.groupBy(*MONTH_KEY).agg(
        F.sum((own + idle).cast(WIDE)).cast(WIDE).alias("byte_hours"),
        (F.max("_n") - F.min("_n") + 1).alias("span"),
        F.min("_n").alias("first"),
        F.max("_n").alias("last"),
        F.sum("net").alias("net"),
        F.max(F.col("_open") + F.col("peak")).alias("peak"),
        F.sum("lines").alias("lines"),
        F.sum("trans_in").alias("trans_in"),
        F.sum("trans_out").alias("trans_out"),
    )


def _months_of(rows: DataFrame) -> list[date]:
    return sorted(r.month for r in rows.select("month").distinct().collect())  # the months of one batch


def _merge(spark: SparkSession, schemas: dict[str, T.StructType], store: str, batch_id: int) -> None:
    level = 1
    while (batch_id + 1) % lifetimes.MERGE**level == 0:
        run = batch_id // lifetimes.MERGE**level
        below = [(level - 1, n) for n in range(run * lifetimes.MERGE, (run + 1) * lifetimes.MERGE)]
        for table, schema in schemas.items():
            _write(MERGED[table](_read(spark, schema, store, table, below)), store, table, run, level)
        level += 1


def _reached(spark: SparkSession, store: str, batch_id: int) -> datetime | None:
    if batch_id < 0:
        return None
    return spark.read.schema("ts timestamp_ntz").parquet(f"{store}/reached/batch={batch_id}").first()[0]


def apply_batch(
    batch: DataFrame,
    batch_id: int,
    store: str,
    lateness_hours: int = 1,
    restore_reduces: bool = True,
    block_rows: int = BLOCK_ROWS,
) -> None:
    spark = batch.sparkSession
    earlier, own = lifetimes.runs(batch_id), [(0, batch_id)]
    lines = batch.filter("ts IS NOT NULL").select(*LINE).withColumn("month", month_of(F.col("ts")))
    _write(lines, store, "lines", batch_id)
    fresh = _read(spark, lines.schema, store, "lines", own)
    months = _months_of(fresh)

    before = _reached(spark, store, batch_id - 1)
    limit = F.lit(before.isoformat(" ") if before else None).cast("timestamp_ntz")
    end = trunc_hour(F.col("ts")) + F.lit(lateness_hours + 1) * F.expr("INTERVAL '1' HOUR")
    late = usage.summed(fresh.filter(end <= limit)).withColumn("month", month_of(F.col("hour")))
    _write(late, store, "late", batch_id)
    now = fresh.agg(F.greatest(F.max("ts"), limit).alias("ts"))
    now.write.mode("overwrite").parquet(f"{store}/reached/batch={batch_id}")

    def summed(rows: DataFrame) -> DataFrame:
        return hour_changes(rows, ("host",), restore_reduces, block_rows).withColumn("month", month_of(F.col("hour")))

    new = summed(fresh)
    hour_schema = new.select(*HOUR_KEY, *HOUR).withColumn("batch", F.lit(batch_id)).schema
    if earlier:
        old = _newest(_read(spark, hour_schema, store, "hours", earlier, months), HOUR_KEY)
        told, mixed = _joined(old.join(new.select(*HOUR_KEY), list(HOUR_KEY), "left_semi"), new)
        if again := _months_of(mixed):
            every = _read(spark, lines.schema, store, "lines", [*earlier, *own], again)
            every = every.withColumn("hour", trunc_hour(F.col("ts"))).join(mixed, list(HOUR_KEY), "left_semi")
            told = told.unionByName(summed(every.select(*LINE)).select(told.columns))
    else:
        told = new
    _write(told.select(*HOUR_KEY, *HOUR).withColumn("batch", F.lit(batch_id)), store, "hours", batch_id)

    hours = _newest(_read(spark, hour_schema, store, "hours", [*earlier, *own], months), HOUR_KEY)
    changed = fresh.select(*MONTH_KEY).distinct()
    done = month_sums(hours.join(changed, list(MONTH_KEY), "left_semi")).withColumn("batch", F.lit(batch_id))
    _write(done, store, "months", batch_id)
    schemas = {"lines": lines.schema, "late": late.schema, "hours": hour_schema, "months": done.schema}
    _merge(spark, schemas, store, batch_id)
    # Written last: the batch is complete.
    spark.range(1).write.mode("overwrite").parquet(f"{store}/done/batch={batch_id}")


def start(
    log: DataFrame,
    store: str,
    checkpoint: str,
    lateness_hours: int = 1,
    restore_reduces: bool = True,
    block_rows: int = BLOCK_ROWS,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Keep the sums below ``store``, from a stream of log lines (host, seq, ts, op, bytes)."""

    def step(batch: DataFrame, batch_id: int) -> None:
        apply_batch(batch, batch_id, store, lateness_hours, restore_reduces, block_rows)

    return (
        log.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def last_batch(spark: SparkSession, store: str) -> int:
    return spark.read.schema("id long, batch int").parquet(f"{store}/done").agg(F.max("batch")).first()[0]


def _table(spark: SparkSession, store: str, table: str, batch_id: int | None) -> DataFrame:
    after = (last_batch(spark, store) if batch_id is None else batch_id) + 1
    paths = [lifetimes.run_folder(store, table, *place) for place in lifetimes.runs(after)]
    return spark.read.option("basePath", f"{store}/{table}").parquet(*paths).drop("level", "run")


def months(spark: SparkSession, store: str, batch_id: int | None = None) -> DataFrame:
    """The stored months as of a batch, the last one unless told."""
    return _newest(_table(spark, store, "months", batch_id), MONTH_KEY).drop("batch")


def late(spark: SparkSession, store: str, batch_id: int | None = None) -> DataFrame:
    """Per host and hour the lines that came after the hour was closed, and their sums."""
    return _total(_table(spark, store, "late", batch_id)).drop("month")


def bill(
    spark: SparkSession, store: str, extrapolate_to: datetime | None = None, batch_id: int | None = None
) -> DataFrame:
    """The monthly bill, as ``operators.usage.monthly_usage`` has it, from one row per host and month.

    Months without lines come from the one before, as do the hours of a month before its first line;
    after the last line of a host only the hours up to ``extrapolate_to`` count.
    """
    by = Window.partitionBy("host").orderBy("month")
    rows = months(spark, store, batch_id).withColumns(
        {
            "_open": F.coalesce(F.sum("net").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast(WIDE),
            "_next": F.lead("month").over(by),
            "_is_first": F.row_number().over(by) == 1,
        }
    )
    stop = F.col("last")
    if extrapolate_to is not None:
        target = F.lit(extrapolate_to.isoformat(" ")).cast("timestamp_ntz")
        stop = F.greatest(stop, hour_number(target))
    # The hour number after the last one that counts, and the last month with such hours.
    end = F.when(F.col("_next").isNull(), stop + 1).otherwise(F.unix_date("_next").cast("bigint") * 24)
    last_month = F.trunc(F.date_from_unix_date(F.floor((F.col("_end") - 1) / 24).cast("int")), "month")
    rows = rows.withColumn("_end", end)
    slots = rows.withColumn("_slot", F.explode(F.sequence("month", last_month, F.expr("INTERVAL '1' MONTH"))))
    begin = F.unix_date("_slot").cast("bigint") * 24
    until = F.least(F.col("_end"), F.unix_date(F.add_months("_slot", 1)).cast("bigint") * 24)
    active = F.col("_slot") == F.col("month")
    closing = F.col("_open") + F.col("net").cast(WIDE)

    def hours_at(level: Column, count: Column) -> Column:
        return (level.cast(WIDE) * count.cast(WIDE)).cast(WIDE)

    ahead = F.when(F.col("_is_first"), F.lit(0)).otherwise(F.col("first") - begin) + F.col("span")
    whole = (
        hours_at(F.col("_open"), ahead) + F.col("byte_hours") + hours_at(closing, until - F.col("last") - 1)
    ).cast("decimal(38,0)")
    zero = F.lit(0).cast("bigint")
    shown = slots.select(
        "host",
        F.year("_slot").alias("year"),
        F.month("_slot").alias("month"),
        F.when(active, whole).otherwise(hours_at(closing, until - begin)).alias("byte_hours"),
        F.when(active, F.col("trans_in")).otherwise(zero).alias("_in"),
        F.when(active, F.col("trans_out")).otherwise(zero).alias("_out"),
    )
    return billed(shown)
