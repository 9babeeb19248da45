"""Places of files within backups whose rows lie in many ranges."""

from pyspark.sql import functions as F

from fleetvault.operators import manifests

SCHEMA = "host string, keyspace string, ts int, cf string, name string, note string"


def rows():
    large = [("h", "k", 1, f"cf{i % 3}", f"n{i * 7919 % 3001}", None) for i in range(3001)]
    small = [("h", "k", 2, "cf", f"m{i}", "x") for i in range(5)]
    return [*large, *small, (None, None, None, "cf", "b", None), (None, None, None, None, "a", None), ("h", "k", 3, "c", "", "")]


def wanted(data):
    low = lambda x: (x is not None, x if x is not None else "")
    by_key = {}
    for row in data:
        by_key.setdefault(row[:3], []).append(row)
    return {
        (*row, at)
        for group in by_key.values()
        for at, row in enumerate(sorted(group, key=lambda r: (low(r[3]), low(r[4]))), 1)
    }


def test_places_over_several_ranges(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(4)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spread = df.filter("ts = 1").repartitionByRange(*manifests.KEY, "cf", "name").select(F.spark_partition_id())
        assert spread.distinct().count() > 3
        found = manifests.positions(df, ["cf", "name"])
        assert {tuple(r) for r in found.collect()} == wanted(data)
        assert found.columns == [*df.columns, "position"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_repeated_rows_and_an_empty_table(spark):
    df = spark.createDataFrame([("h", "k", 1, "c", "n", None)] * 4, SCHEMA)
    assert sorted(r.position for r in manifests.positions(df, ["cf", "name"]).collect()) == [1, 2, 3, 4]
    assert manifests.positions(df.limit(0), ["cf", "name"]).count() == 0
