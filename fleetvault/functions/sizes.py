"""Sizes and transfers: human form, multipart chunks, size classes, throughput."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIB = 1024**2

# Units of the human form as powers of two, smallest first.
UNITS = ((10, "K"), (20, "M"), (30, "G"))

# Upper size bound in MiB -> number of progress reports for one transfer.
SIZE_CLASSES = ((1, 0), (10, 1), (100, 2), (1024, 5), (10 * 1024, 10))
LARGEST_CLASS = 20

MAX_UPLOAD_MB = 5120
CHUNK_MB = 256
SMALLEST_CHUNK_MB = 5


def _tenths(size: Column, bits: int) -> Column:
    """``size / 2**bits`` in tenths, exact ties to the even digit, in integer arithmetic."""
    mask = F.lit(2**bits - 1).cast("bigint")
    scaled = size.bitwiseAND(mask) * 10
    tenth = F.shiftright(scaled, bits)
    rest = scaled.bitwiseAND(mask)
    half = F.lit(2 ** (bits - 1)).cast("bigint")
    up = (rest > half) | ((rest == half) & (tenth % 2 == 1))
    return F.shiftright(size, bits) * 10 + tenth + F.when(up, 1).otherwise(0)


def human_bytes(size: Column) -> Column:
    """``1.5G``, ``12.0M``, ``3.2K`` or ``17B``; units are powers of 1024."""
    size = size.cast("bigint")
    text = F.concat(size.cast("string"), F.lit("B"))
    for bits, label in UNITS:
        digits = _tenths(size, bits).cast("string")
        shown = F.regexp_replace(digits, r"(\d)$", r".$1")
        text = F.when(size >= 2**bits, F.concat(shown, F.lit(label))).otherwise(text)
    return text


def is_multipart(size: Column, max_upload_mb: int = MAX_UPLOAD_MB) -> Column:
    return size > F.lit(max_upload_mb * MIB)


def check_chunk_mb(chunk_mb: int) -> int:
    if chunk_mb < SMALLEST_CHUNK_MB:
        raise ValueError(f"the smallest chunk is {SMALLEST_CHUNK_MB} MiB")
    return chunk_mb


def chunk_plan(
    files: DataFrame,
    size: str = "size",
    max_upload_mb: int = MAX_UPLOAD_MB,
    chunk_mb: int = CHUNK_MB,
) -> DataFrame:
    """One row per chunk of every multipart file: part from 1, offset, length.

    Files at or below the upload limit go up whole and have no rows.
    """
    chunk = F.lit(check_chunk_mb(chunk_mb) * MIB).cast("bigint")
    large = files.filter(is_multipart(F.col(size), max_upload_mb) & (F.col(size) > 0))
    last = F.ceil(F.col(size) / chunk).cast("bigint")
    parts = large.withColumn("part", F.explode(F.sequence(F.lit(1).cast("bigint"), last)))
    offset = (F.col("part") - 1) * chunk
    return parts.withColumn("offset", offset).withColumn(
        "length", F.least(chunk, F.col(size) - offset)
    )


def size_class(size: Column) -> Column:
    """How many progress reports a transfer of this size gets."""
    result = F.lit(LARGEST_CLASS)
    for bound, reports in reversed(SIZE_CLASSES):
        result = F.when(size < bound * MIB, reports).otherwise(result)
    return result


def throughput(done: Column, elapsed_ms: Column) -> Column:
    """MiB per second over whole elapsed seconds, at least one."""
    seconds = F.greatest(F.floor(elapsed_ms / 1000).cast("bigint"), F.lit(1).cast("bigint"))
    return done / F.lit(float(MIB)) / seconds


def exact_throughput(done: Column, elapsed_ms: Column) -> Column:
    """MiB per second over the exact time; null for an instant transfer."""
    return F.when(elapsed_ms > 0, done / F.lit(float(MIB)) / (elapsed_ms / 1000.0))
