"""Hourly storage usage and the monthly bill, from a transfer log.

A stored line adds to the balance of its host; restored and removed lines take away. The
log rows move once, to (host, hour, block); everything after that works on one row per
block or per hour.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetvault.functions.times import trunc_hour
from fleetvault.operators.blocked import BLOCK, BLOCK_ROWS, block_of, running

HOST = ("host",)

# Fixed values of the bill.
GIB = float(1024**3)
HOURS_PER_MONTH = 744


def balance_change(restore_reduces: bool = True) -> Column:
    """Signed bytes of a log row; by default a restore lowers the balance too."""
    restored = -F.col("bytes") if restore_reduces else F.lit(0).cast("bigint")
    return (
        F.when(F.col("op") == "stored", F.col("bytes"))
        .when(F.col("op") == "restored", restored)
        .when(F.col("op") == "removed", -F.col("bytes"))
    )


def running_balance(
    log: DataFrame,
    by: Sequence[str] = HOST,
    restore_reduces: bool = True,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The log with the balance after each line, in line order."""
    change = balance_change(restore_reduces)
    return running(log, by, "seq", {"balance": (change, "sum")}, block_rows)


def block_sums(
    log: DataFrame,
    by: Sequence[str] = HOST,
    restore_reduces: bool = True,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One row per host, hour and block of lines, relative to the balance before the block."""
    lines = log.select(
        *by,
        "seq",
        trunc_hour(F.col("ts")).alias("hour"),
        block_of("seq", block_rows).alias(BLOCK),
        (F.col("op") == "stored").alias("_in"),
        F.when(F.col("op") == "stored", F.col("bytes")).alias("_stored"),
        F.when(F.col("op") == "restored", F.col("bytes")).alias("_restored"),
        balance_change(restore_reduces).alias("_change"),
    )
    in_block = (
        Window.partitionBy(*by, "hour", BLOCK)
        .orderBy("seq")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        lines.withColumn("_run", F.sum("_change").over(in_block))
        .groupBy(*by, "hour", BLOCK)
        .agg(
            F.coalesce(F.sum("_change"), F.lit(0)).alias("_net"),
            F.coalesce(F.sum("_stored"), F.lit(0)).alias("trans_in"),
            F.coalesce(F.sum("_restored"), F.lit(0)).alias("trans_out"),
            F.max_by("_run", F.when(F.col("_in"), F.col("seq"))).alias("_last"),
            F.max("_run").alias("_peak"),
            F.count("*").alias("lines"),
            F.min("seq").alias("first_seq"),
            F.max("seq").alias("last_seq"),
        )
    )


def hour_changes(
    log: DataFrame,
    by: Sequence[str] = HOST,
    restore_reduces: bool = True,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One row per host and hour with lines, relative to the balance that the hour opens with.

    ``net`` is the change over the hour, ``held`` that up to its last stored line (null without
    one), ``peak`` the highest one seen. Unlike balances they do not depend on other hours.
    """
    blocks = block_sums(log, by, restore_reduces, block_rows)
    earlier = (
        Window.partitionBy(*by, "hour").orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    )
    opened = blocks.withColumn("_open", F.coalesce(F.sum("_net").over(earlier), F.lit(0)))
    return opened.groupBy(*by, "hour").agg(
        F.sum("lines").alias("lines"),
        F.sum("_net").alias("net"),
        F.max_by(
            F.col("_open") + F.col("_last"), F.when(F.col("_last").isNotNull(), F.col(BLOCK))
        ).alias("held"),
        F.greatest(F.lit(0), F.max(F.col("_open") + F.col("_peak"))).alias("peak"),
        F.sum("trans_in").alias("trans_in"),
        F.sum("trans_out").alias("trans_out"),
        F.min("first_seq").alias("first_seq"),
        F.max("last_seq").alias("last_seq"),
    )


def active_hours(
    log: DataFrame,
    by: Sequence[str] = HOST,
    restore_reduces: bool = True,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One row per host and hour with log lines.

    ``max_bytes`` is the balance after the last stored line of the hour, or the opening
    balance when nothing was stored; ``peak_bytes`` is the highest balance seen.
    """
    blocks = block_sums(log, by, restore_reduces, block_rows)
    earlier = (
        Window.partitionBy(*by).orderBy("hour", BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    )
    opened = blocks.withColumn("_open", F.coalesce(F.sum("_net").over(earlier), F.lit(0)))
    hours = opened.groupBy(*by, "hour").agg(
        F.min_by("_open", BLOCK).alias("_open"),
        F.sum("_net").alias("_net"),
        F.max_by(
            F.col("_open") + F.col("_last"), F.when(F.col("_last").isNotNull(), F.col(BLOCK))
        ).alias("_level"),
        F.max(F.col("_open") + F.col("_peak")).alias("_top"),
        F.sum("trans_in").alias("trans_in"),
        F.sum("trans_out").alias("trans_out"),
    )
    return hours.select(
        *by,
        "hour",
        (F.col("_open") + F.col("_net")).alias("bytes"),
        F.coalesce("_level", "_open").alias("max_bytes"),
        F.greatest("_open", "_top").alias("peak_bytes"),
        "trans_in",
        "trans_out",
    )


def fill_hours(
    hours: DataFrame, by: Sequence[str] = HOST, extrapolate_to: datetime | None = None
) -> DataFrame:
    """Add the hours without lines, up to the hour of ``extrapolate_to`` when that is later.

    Each active hour is repeated until the next active one with its closing balance and
    zero transfers; ``activity`` tells the two kinds apart.
    """
    upcoming = F.lead("hour").over(Window.partitionBy(*by).orderBy("hour"))
    one = F.expr("INTERVAL '1' HOUR")
    end = F.col("hour")
    if extrapolate_to is not None:
        target = F.lit(extrapolate_to.replace(minute=0, second=0, microsecond=0).isoformat(" "))
        end = F.greatest(end, target.cast("timestamp_ntz"))
    spans = hours.withColumn("_until", F.coalesce(upcoming - one, end))
    slots = spans.withColumn("_slot", F.explode(F.sequence("hour", "_until", one)))
    active = F.col("_slot") == F.col("hour")

    def when_active(name: str, otherwise: Column) -> Column:
        return F.when(active, F.col(name)).otherwise(otherwise).alias(name)

    zero = F.lit(0).cast("bigint")
    return slots.select(
        *by,
        F.col("_slot").alias("hour"),
        "bytes",
        when_active("max_bytes", F.col("bytes")),
        when_active("peak_bytes", F.col("bytes")),
        when_active("trans_in", zero),
        when_active("trans_out", zero),
        active.alias("activity"),
    )


def hourly_usage(
    log: DataFrame,
    by: Sequence[str] = HOST,
    extrapolate_to: datetime | None = None,
    restore_reduces: bool = True,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    return fill_hours(active_hours(log, by, restore_reduces, block_rows), by, extrapolate_to)


def shown_hours(usage: DataFrame, show_extrapolations: bool = False) -> DataFrame:
    """Hours a report lists; only for display, the bill needs all of them."""
    return usage if show_extrapolations else usage.filter("activity")


def monthly_usage(usage: DataFrame, by: Sequence[str] = HOST) -> DataFrame:
    """Bill per month from filled hourly usage.

    Byte-hours add up the hourly maxima; a GB-month is one GiB held for 744 hours.
    """
    wide = F.col("max_bytes").cast("decimal(28,0)")
    months = usage.groupBy(
        *by, F.year("hour").alias("year"), F.month("hour").alias("month")
    ).agg(
        F.sum(wide).alias("byte_hours"),
        F.sum("trans_in").alias("_in"),
        F.sum("trans_out").alias("_out"),
    )
    return billed(months, by)


def billed(months: DataFrame, by: Sequence[str] = HOST) -> DataFrame:
    """The columns of a bill from byte-hours and bytes moved (``_in``, ``_out``) per month."""
    return months.select(
        *by,
        "year",
        "month",
        "byte_hours",
        (F.col("byte_hours").cast("double") / GIB / HOURS_PER_MONTH).alias("gb_months"),
        (F.col("_in") / GIB).alias("trans_in_gb"),
        (F.col("_out") / GIB).alias("trans_out_gb"),
    )


def late_lines(
    log: DataFrame, by: Sequence[str] = HOST, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """The log with ``late``: the line's hour is before the hour of an earlier line."""
    hours = log.withColumn("hour", trunc_hour(F.col("ts")))
    seen = running(
        hours, by, "seq", {"_reached": (F.col("hour"), "max")}, block_rows, before_only=True
    )
    late = F.coalesce(F.col("hour") < F.col("_reached"), F.lit(False))
    return seen.withColumn("late", late).drop("_reached")
