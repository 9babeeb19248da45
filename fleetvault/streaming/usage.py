"""Hourly transfer sums from a growing log.

Balances need the whole history of a host, so the stream only sums each hour; the running
balance is worked out from those sums in batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetvault.operators.usage import balance_change


def _sums() -> list[Column]:
    stored = F.when(F.col("op") == "stored", F.col("bytes"))
    restored = F.when(F.col("op") == "restored", F.col("bytes"))
    return [
        F.count("*").alias("lines"),
        F.sum(balance_change()).alias("net"),
        F.coalesce(F.sum(stored), F.lit(0)).alias("trans_in"),
        F.coalesce(F.sum(restored), F.lit(0)).alias("trans_out"),
    ]


def hourly_sums(log: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Per host and hour: lines, net change, bytes in and out.

    Lines of an hour that was closed ``lateness`` ago are not summed; see ``missed``.
    """
    timed = log.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", lateness)
    sums = timed.groupBy("host", F.window("at", "1 hour").alias("_w")).agg(*_sums())
    hour = F.col("_w.start").cast("timestamp_ntz").alias("hour")
    return sums.select("host", hour, "lines", "net", "trans_in", "trans_out")


def start(
    log: DataFrame, table: str, checkpoint: str, lateness: str = "1 hour", trigger: dict | None = None
) -> StreamingQuery:
    """Append every closed hour to a parquet table."""
    return (
        hourly_sums(log, lateness)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", table)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def summed(log: DataFrame) -> DataFrame:
    """The same sums of a stored log, open hours included."""
    return log.groupBy("host", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(*_sums())


def missed(log: DataFrame, hours: DataFrame) -> DataFrame:
    """Per host and hour what the stream left out as late: lines and sums, exactly.

    The stored log is summed again and compared with the table of closed hours. An hour counts as
    closed up to the newest one in the table, which is looked up when this is called. Adding these rows to the table's gives the whole
    log's sums, so nothing late is lost to the bill.
    """
    whole = summed(log)
    newest = hours.agg(F.max("hour")).first()[0]
    closed = whole.filter(F.col("hour") <= F.lit(newest))
    names = ["lines", "net", "trans_in", "trans_out"]
    less = hours.select("host", "hour", *[(-F.col(c)).alias(c) for c in names])
    left = closed.select("host", "hour", *names).unionByName(less).groupBy("host", "hour")
    return left.agg(*[F.sum(c).alias(c) for c in names]).filter("lines <> 0")
