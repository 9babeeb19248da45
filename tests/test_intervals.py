"""The interval index against plain loops, and how much a point meets."""

import random

import pytest
from pyspark.sql import functions as F

from fleetvault.operators import history, intervals

INTERVAL = "owner string, name int, since bigint, until bigint"


def made(spark, rows, points):
    return spark.createDataFrame(rows, INTERVAL), spark.createDataFrame(points, "owner string, at bigint")


def plain(rows, points):
    return sorted(
        (o, n, a, b or -1, p)
        for o, n, a, b in rows
        for q, p in points
        if o == q and a <= p and (b is None or p < b)
    )


def looked_up(spark, rows, points):
    found = intervals.containing(*made(spark, rows, points), ["owner"], "since", "until", "at").collect()
    return sorted((r.owner, r.name, r.since, r.until or -1, r["at"]) for r in found)


def drawn(seed, count, points, span):
    rng = random.Random(seed)
    rows = []
    for n in range(count):
        begin = rng.randrange(-5, span)
        end = rng.choice([None, begin, begin + 1, begin + rng.randrange(1, 20), begin + rng.randrange(1, span)])
        rows.append((rng.choice("aab"), n, begin, end))
    rows += [("a", -1, -(1 << 62), None), ("a", -2, -(1 << 62), 3), ("c", -3, 0, None), rows[0]]
    asked = {(rng.choice("aabd"), rng.randrange(-8, span + 8)) for _ in range(points)}
    return rows, sorted(asked)


@pytest.mark.parametrize("seed,points,span", [(1, 1, 50), (2, 7, 50), (3, 60, 200), (4, 40, 10**6), (5, 300, 64), (6, 2, 10**12)])
def test_against_plain_loops(spark, seed, points, span):
    rows, asked = drawn(seed, 200, points, span)
    assert looked_up(spark, rows, asked) == plain(rows, asked)


def test_every_point_of_a_small_range(spark):
    rows = [("a", 100 * a + b, a, b) for a in range(20) for b in range(a, 22)]
    points = [("a", p) for p in range(-1, 23)]
    assert looked_up(spark, rows, points) == plain(rows, points)


def test_empty_sides(spark):
    assert looked_up(spark, [], [("a", 1)]) == [] == looked_up(spark, [("a", 1, 0, None)], [])


def test_a_point_meets_what_contains_it_and_one_bin(spark):
    """One owner with most of the rows: pairs looked at stay near the result, far below all pairs."""
    rng = random.Random(7)
    rows = [("hot", n, n, n + rng.choice([1, 5, 30, 400]) if n % 50 else None) for n in range(6000)]
    rows += [(f"o{n % 90}", n, n, n + 9) for n in range(3000)]
    points = [("hot", p) for p in range(0, 6000, 12)] + [("o1", 91), ("o2", 92)]
    pairs = intervals.met(*made(spark, rows, points), ["owner"], "since", "until", "at")
    per_point = {(r.owner, r["at"]): (r.pairs, r.sure) for r in pairs.groupBy("owner", "at").agg(
        F.count("*").alias("pairs"), F.count_if("_sure").alias("sure")).collect()}
    live = {}
    for _, _, _, _, p in (r for r in plain(rows, points) if r[0] == "hot"):
        live[p] = live.get(p, 0) + 1
    for (owner, p), (looked, sure) in per_point.items():
        if owner == "hot":
            # A bin is at most twice span / points wide: 24 begins, and the ends of as many and more.
            assert sure <= live[p] and looked <= live[p] + 2 * 24
    total = sum(looked for looked, _ in per_point.values())
    assert total < 1.5 * sum(live.values()) < 0.1 * 6000 * 500


def test_an_interval_is_written_a_few_times(spark):
    rows, points = [("a", n, n, None) for n in range(1000)], [("a", p) for p in range(0, 1000, 4)]
    lives, asked = made(spark, rows, points)
    ranges = intervals._ranges(asked, ["owner"], "at")
    written = lives.join(ranges, "owner").select(
        F.size(intervals._places(F.col("since"), F.col("_high") + 1, F.col("_bits"))).alias("n")
    )
    assert written.agg(F.max("n")).first()[0] <= 2 * 8 + 2


def test_no_join_on_the_owner_alone(spark):
    lives = spark.createDataFrame([], "host string, keyspace string, added_seq bigint, removed_seq bigint")
    asked = spark.createDataFrame([], "host string, keyspace string, seq bigint")
    plan = history.manifests_at(lives, asked)._jdf.queryExecution().optimizedPlan().toString()
    last = next(line for line in plan.split("\n") if "Join" in line)
    assert "_level" in last and "_node" in last
