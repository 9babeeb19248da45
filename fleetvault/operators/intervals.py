"""Which intervals contain a point: an interval index as an equi join.

Per key, the range that points ask about is cut into bins, about as many as there are points.
The whole bins of an interval are covered by as few nodes of a binary tree over the bins as
possible, so that long intervals stand in coarse nodes; a bin that it covers only in part is kept
by its number. A point looks itself up in its bin and in the nodes above it. What a node yields
contains the point for certain, only what the one bin yields has to be compared.

So an interval is written at most ``2 * log2(points of its key) + 2`` times, and a key with a
single point costs one row per interval that reaches it. A point meets the intervals that contain
it and those that begin or end in its bin. No key is the key of a join by itself: a key with most
of the rows is spread over its nodes and bins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTIAL = -1


def _shifted(value: Column, bits: Column) -> Column:
    return F.call_function("shiftright", value, bits.cast("int"))


def _bits(value: Column) -> Column:
    """How many binary digits a number above zero has; zero has none."""
    return F.when(value > 0, F.length(F.bin(value))).otherwise(F.lit(0))


def _ranges(points: DataFrame, by: Sequence[str], at: str) -> DataFrame:
    """Per key the range of its points and the binary digits of a bin."""
    found = points.groupBy(*by).agg(
        F.min(at).alias("_low"), F.max(at).alias("_high"), F.count("*").alias("_points")
    )
    each = F.call_function("div", F.col("_high") - F.col("_low"), F.col("_points"))
    return found.select(*by, "_low", "_high", _bits(each).alias("_bits"))


def _places(begin: Column, end: Column, bits: Column) -> Column:
    """The nodes (level, node) that cover [begin, end), and the bins covered in part."""
    width = F.call_function("shiftleft", F.lit(1).cast("bigint"), bits.cast("int"))
    first, last = _shifted(begin + width - 1, bits), _shifted(end, bits)

    def node(level: Column, number: Column) -> Column:
        return F.struct(level.cast("int").alias("level"), number.cast("bigint").alias("node"))

    def of_level(level: Column) -> Column:
        left, right = -_shifted(-first, level), _shifted(last, level)
        odd = left % 2 == 1
        own = F.when(odd & (left < right), node(level, left))
        after = F.when(odd, left + 1).otherwise(left)
        other = F.when((right % 2 == 1) & (after < right), node(level, right - 1))
        return F.array(own, other)

    levels = F.sequence(F.lit(0), _bits(F.greatest(last - first, F.lit(0))))
    whole = F.flatten(F.transform(levels, of_level))
    head, tail = _shifted(begin, bits), _shifted(end - 1, bits)
    starts_inside = F.when(head < first, node(F.lit(PARTIAL), head))
    ends_inside = F.when((tail >= last) & ((tail != head) | (head >= first)), node(F.lit(PARTIAL), tail))
    return F.filter(F.concat(whole, F.array(starts_inside, ends_inside)), lambda n: n.isNotNull())


def _lookups(at: Column, bits: Column, levels: Column) -> Column:
    """The nodes above a point, and its bin."""
    bin_of = _shifted(at, bits)
    nodes = F.transform(
        F.sequence(F.lit(0), levels),
        lambda level: F.struct(level.cast("int").alias("level"), _shifted(bin_of, level).alias("node")),
    )
    return F.concat(nodes, F.array(F.struct(F.lit(PARTIAL).alias("level"), bin_of.alias("node"))))


def met(
    intervals: DataFrame, points: DataFrame, by: Sequence[str], begin: str, end: str, at: str
) -> DataFrame:
    """Intervals beside the points that look them up; ``_sure`` where no comparison is needed.

    ``intervals`` has begin and end (after the last point, null if there is none), ``points`` its
    ``at``; other columns of intervals are kept. Every pair occurs once.
    """
    ranges = _ranges(points, by, at)
    reaching = intervals.join(ranges, list(by))
    low, high = F.col("_low"), F.col("_high")
    inside_begin = F.greatest(F.col(begin), low) - low
    inside_end = F.least(F.coalesce(F.col(end), high + 1), high + 1) - low
    reaching = reaching.filter(
        (F.col(begin) <= high) & (F.col(end).isNull() | ((F.col(end) > low) & (F.col(end) > F.col(begin))))
    )
    places = _places(inside_begin, inside_end, F.col("_bits"))
    placed = reaching.select(*[F.col(f"`{c}`") for c in intervals.columns], F.explode(places).alias("_place"))
    placed = placed.select("*", F.col("_place.level").alias("_level"), F.col("_place.node").alias("_node"))

    asked = points.join(ranges, list(by))
    levels = _bits(_shifted(high - low + 1, F.col("_bits")))
    asked = asked.select(*by, at, F.explode(_lookups(F.col(at) - low, F.col("_bits"), levels)).alias("_look"))
    asked = asked.select(*by, at, F.col("_look.level").alias("_level"), F.col("_look.node").alias("_node"))
    found = placed.drop("_place").join(asked, [*by, "_level", "_node"])
    return found.withColumn("_sure", F.col("_level") != PARTIAL).drop("_level", "_node")


def containing(
    intervals: DataFrame, points: DataFrame, by: Sequence[str], begin: str, end: str, at: str
) -> DataFrame:
    """Every interval beside every point of its key with begin <= point < end."""
    found = met(intervals, points, by, begin, end, at)
    inside = (F.col(begin) <= F.col(at)) & (F.col(end).isNull() | (F.col(end) > F.col(at)))
    return found.filter(F.col("_sure") | inside).drop("_sure")
