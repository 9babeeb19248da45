"""Checksums and the columns a restore shows or applies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unquoted(etag: Column) -> Column:
    return F.regexp_replace(etag, r'^"+|"+$', "")


def checksum_matches(
    expected: Column,
    exists: Column,
    recorded: Column,
    etag: Column | None = None,
    expected_tag: Column | None = None,
) -> Column:
    """True, false, or null when nothing can decide.

    The checksum recorded with the object wins; otherwise its tag is used. The tag of a multipart
    upload contains ``-`` and is no plain digest: it is compared with ``expected_tag``, the tag
    worked out from the same parts of the file, and decides nothing where that is not known.
    """
    known = F.nullif(recorded, F.lit(""))
    same = known == expected
    if etag is not None:
        tag = unquoted(etag)
        of_parts = tag == expected_tag if expected_tag is not None else F.lit(None).cast("boolean")
        same = F.coalesce(same, F.when(tag.contains("-"), of_parts).otherwise(tag == expected))
    return F.when(~exists, F.lit(False)).otherwise(same)


def owner(override: str | None, recorded: Column) -> Column:
    """Owner to apply: the override, else the recorded one, else null (leave alone)."""
    return F.lit(override) if override else F.nullif(recorded, F.lit(""))


def mode(recorded: Column) -> Column:
    """Mode to apply; zero or unknown leaves it alone."""
    return F.nullif(recorded, F.lit(0))


def restored_message(
    was_restored: Column, source: Column, target: Column, reason: Column
) -> Column:
    skipped = F.concat(source, F.lit(" -> Skipped: "), F.coalesce(reason, F.lit("")))
    return F.when(was_restored, F.concat(source, F.lit(" -> "), target)).otherwise(skipped)


def packed(digest: Column) -> Column:
    """A digest as bytes, so that half of it moves in a shuffle: equal bytes mean equal texts.

    32 lower-case hexadecimal digits become 16 bytes; any other text has 17 zero bytes put before it.
    """
    raw = F.unhex(digest)
    plain = (F.length(digest) == 32) & (F.lower(F.hex(raw)) == digest)
    other = F.concat(F.lit(b"\0" * 17), F.encode(digest, "utf-8"))
    return F.when(F.coalesce(plain, F.lit(False)), raw).otherwise(other)


def unpacked(digest: Column) -> Column:
    """Inverse of ``packed``."""
    text = F.decode(F.substring(digest, 18, 2**31 - 1), "utf-8")
    return F.when(F.length(digest) == 16, F.lower(F.hex(digest))).otherwise(text)
