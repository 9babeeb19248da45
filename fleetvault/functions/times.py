"""Timestamps without a zone: text forms, user input, truncation, local to UTC.

All expressions work on ``timestamp_ntz`` and never pass through the session time zone, so
they give the same answer in a session that is not set to UTC.
"""

from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted text shapes.
ISO_SHAPE = r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}\.\d{1,6}$"
SAFE_SHAPE = r"^(\d{4})_(\d{1,2})_(\d{1,2})T(\d{1,2})_(\d{1,2})_(\d{1,2})_(\d{1,6})$"
INPUT_SHAPE = r"^\d{4}-\d{1,2}-\d{1,2}(T\d{1,2}:\d{1,2}(:\d{1,2}(\.\d{1,6})?)?)?$"


def utc_now() -> datetime:
    """Naive UTC clock reading, taken once on the driver."""
    return datetime.now(timezone.utc).replace(tzinfo=None)


def _parsed(text: Column, shape: str) -> Column:
    return F.when(text.rlike(shape), text.try_cast("timestamp_ntz"))


def iso_text(ts: Column) -> Column:
    """``2019-03-07T08:45:31.204968``, always six fraction digits."""
    text = ts.cast("string")
    fraction = F.rpad(F.substring(text, 21, 6), 6, "0")
    return F.concat(F.substring(text, 1, 10), F.lit("T"), F.substring(text, 12, 8), F.lit("."), fraction)


def parse_iso(text: Column) -> Column:
    """Inverse of ``iso_text``; one to six fraction digits, null when malformed."""
    return _parsed(text, ISO_SHAPE)


def safe_text(ts: Column) -> Column:
    """File-name form ``2019_03_07T08_45_31_204968``."""
    return F.translate(iso_text(ts), "-:.", "___")


def parse_safe(text: Column) -> Column:
    """Inverse of ``safe_text``; null when malformed."""
    iso = F.regexp_replace(text, SAFE_SHAPE, "$1-$2-$3T$4:$5:$6.$7")
    return F.when(text.rlike(SAFE_SHAPE), iso.try_cast("timestamp_ntz"))


def parse_input(text: Column) -> Column:
    """A date typed by a user: date, minutes, seconds or fraction; null when none fits."""
    return _parsed(text, INPUT_SHAPE)


def parse_input_value(text: str) -> datetime:
    """``parse_input`` for one driver-side argument; raises ``ValueError`` when nothing fits."""
    if not re.fullmatch(INPUT_SHAPE, text, re.ASCII):
        raise ValueError(f"cannot read {text!r} as a date, with or without a time")
    whole, _, fraction = text.partition(".")
    return datetime(*map(int, re.findall("[0-9]+", whole))).replace(microsecond=int(fraction.ljust(6, "0") or 0))


def to_utc(ts: Column, zone: str) -> Column:
    """Local wall-clock time in ``zone`` to UTC, sub-second part dropped."""
    return trunc_second(F.convert_timezone(F.lit(zone), F.lit("UTC"), ts))


def trunc_second(ts: Column) -> Column:
    return F.substring(ts.cast("string"), 1, 19).cast("timestamp_ntz")


def trunc_day(ts: Column) -> Column:
    return ts.cast("date").cast("timestamp_ntz")


def trunc_hour(ts: Column) -> Column:
    return trunc_day(ts) + F.hour(ts) * F.expr("INTERVAL '1' HOUR")
