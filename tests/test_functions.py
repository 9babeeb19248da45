"""Edge tables of the column expressions."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetvault.functions import checks, paths, records, sizes, times
from fleetvault.schemas import COMPONENT, FILE_META, MANIFEST, RESTORED_FILE, stored_form


def values(spark, column, rows, schema="x string"):
    df = spark.createDataFrame([(r,) for r in rows], schema)
    return [r[0] for r in df.select(column).collect()]


PATHS = {
    "/d/ks/cf/ks-cf-hd-1-Data.db": ("ks", "cf", "hd", 1, "Data.db", False, None),
    "/d/ks/cf/ks-cf-tmp-hd-1-Data.db": ("ks", "cf", "hd", 1, "Data.db", True, None),
    "/d/ks/cf/ks-cf-hd-1-Data.db-extra": ("ks", "cf", "hd", 1, "Data.db", False, None),
    "/d/ks/cf/ks-cf-h2x-007-Index.db": ("ks", "cf", "h2x", 7, "Index.db", False, None),
    "relative-cf-hd-1-Data.db": ("relative", "cf", "hd", 1, "Data.db", False, None),
    "/d/ks/cf/README": (None,) * 6 + ("not_data_file",),
    "/d/ks/cf/ks-cf": (None,) * 6 + ("not_data_file",),
    "/d/ks/cf/ks-cf-tmp": (None,) * 6 + ("not_data_file",),
    "/d/ks/cf/ks-cf-hd-1": (None,) * 6 + ("not_data_file",),
    "/d/ks/cf/ks-cf-hd-x-Data.db": (None,) * 6 + ("not_data_file",),
    "/d/ks/cf/ks-cf-9-1-Data.db": (None,) * 6 + ("invalid_version",),
    "/d/ks/cf/ks-cf-tmp-9-1-Data.db": (None,) * 6 + ("invalid_version",),
    "/d/ks/cf/ks-cf--1-Data.db": (None,) * 6 + ("invalid_version",),
    "/d/ks/cf/ks-cf-tmp-tmp-1-Data.db": ("ks", "cf", "tmp", 1, "Data.db", True, None),
}
LEGACY = {
    "/d/ks/cf-hd-1-Data.db": ("ks", "cf", "hd", 1, "Data.db", False, None),
    "/d/ks/cf-tmp-hd-1-Data.db": ("ks", "cf", "hd", 1, "Data.db", True, None),
    "/d/ks/cf-9-1-Data.db": (None,) * 6 + ("invalid_version",),
    "/d/ks/cf": (None,) * 6 + ("not_data_file",),
    "cf-hd-1-Data.db": (None,) * 6 + ("not_data_file",),
}


@pytest.mark.parametrize("release,table", [("1.2.0", PATHS), ("1.1.0", PATHS), ("1.0.12", LEGACY)])
def test_parse_path(spark, release, table):
    df = spark.createDataFrame([(p,) for p in table], "path string")
    found = {r[0]: tuple(r)[1:] for r in paths.with_component(df, release=release).collect()}
    assert found == table


def test_parse_path_with_release_per_row(spark):
    rows = [(p, "1.2.0") for p in PATHS] + [(p, "1.0.12") for p in LEGACY]
    df = spark.createDataFrame(rows, "path string, release string")
    parsed = paths.with_component(df, release=F.col("release"))
    found = {(r.path, r.release): tuple(r)[2:] for r in parsed.collect()}
    expected = {(p, "1.2.0"): v for p, v in PATHS.items()}
    expected |= {(p, "1.0.12"): v for p, v in LEGACY.items()}
    assert found == expected


def test_parse_is_done_once(spark):
    df = spark.createDataFrame([(p,) for p in PATHS], "path string")
    parsed = paths.with_component(df).filter("keyspace = 'ks' AND component = 'Data.db' AND NOT temporary")
    plan = parsed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract") == 1


def test_snapshot(spark):
    rows = ["/d/ks/cf/snapshots/1/f", "/d/snapshots-old/f", "snapshots/f", "/d/snapshots", "f"]
    assert values(spark, paths.is_snapshot(F.col("x")), rows) == [True, False, True, False, False]


def test_format_release(spark):
    known = ["a", "b", "f", "g", "h", "hb", "hc", "hd", "he", "hf", "ia", "ib", "hcx"]
    releases = "0.6.0 0.7.0 0.7.0 0.8.0 1.0.0 1.0.3 1.0.4 1.0.10 1.1.3 1.1.6 1.2.0 1.2.1 1.0.4".split()
    unknown = ["ha", "hg", "i", "j", "ab", ""]
    found = values(spark, paths.format_release(F.col("x")), known + unknown)
    assert found == releases + [None] * len(unknown)


def test_parse_release(spark):
    found = values(spark, paths.parse_release(F.col("x")), ["1.0.12", "1.10.0", "1.2.0.1", "1.x"])
    assert found == [[1, 0, 12], [1, 10, 0], [1, 2, 0], None]
    later = paths.parse_release(F.col("x")) >= paths.parse_release(F.lit("1.1.0"))
    assert values(spark, later, ["1.0.12", "1.10.0", "1.1.0", "1.2"]) == [False, True, True, True]


def test_backup_names(spark):
    good = "2019_03_07T08_45_31_204968-ks-node-1.dc-1.example"
    rows = [good, "2019_03_07T08_45_31_204968-ks", "junk-ks-host", "/a/b/" + good + ".json"]
    found = values(spark, paths.parse_backup_name(F.col("x")), rows)
    expected = (datetime(2019, 3, 7, 8, 45, 31, 204968), "ks", "node-1.dc-1.example")
    assert tuple(found[0]) == expected
    assert found[1:3] == [None, None]
    assert tuple(values(spark, paths.parse_backup_path(F.col("x")), rows)[3]) == expected


def test_manifest_path_is_not_padded(spark):
    df = spark.createDataFrame([(datetime(2012, 1, 2, 3, 4, 5), "ks", "h-1")], "ts timestamp_ntz, keyspace string, host string")
    path = df.select(paths.manifest_path(F.col("ts"))).first()[0]
    assert path == "cluster/ks/2012/1/2/h-1/2012_01_02T03_04_05_000000-ks-h-1.json"


def test_prefix(spark):
    key = paths.prefixed_key(F.col("x"), "p/q")
    assert values(spark, key, ["a/b"]) == ["p/q/a/b"]
    assert values(spark, paths.without_prefix(key, "p/q"), ["a/b"]) == ["a/b"]
    assert values(spark, paths.without_prefix(F.col("x"), "p/q"), ["p/qa"]) == ["p/qa"]


DATES = {
    "2019-03-07T08:45:31.204968": datetime(2019, 3, 7, 8, 45, 31, 204968),
    "2019-03-07T08:45:31.8": datetime(2019, 3, 7, 8, 45, 31, 800000),
    "2019-03-07T08:45:31": datetime(2019, 3, 7, 8, 45, 31),
    "2019-03-07T08:45": datetime(2019, 3, 7, 8, 45),
    "2019-03-07": datetime(2019, 3, 7),
    "2012-1-2": datetime(2012, 1, 2),
    "2012-1-2T3:4": datetime(2012, 1, 2, 3, 4),
    "2012-13-01": None,
    "2019-03-07 08:45": None,
    "2012-10": None,
    "2019-03-07T08:45:31.": None,
    "junk": None,
}


def test_parse_input(spark):
    assert values(spark, times.parse_input(F.col("x")), list(DATES)) == list(DATES.values())
    for text, expected in DATES.items():
        if expected is None:
            with pytest.raises(ValueError):
                times.parse_input_value(text)
        else:
            assert times.parse_input_value(text) == expected


def test_times_do_not_depend_on_the_session_zone(spark):
    moments = [datetime(2012, 3, 11, 2, 30, 5, 500000), datetime(2012, 11, 4, 1, 59, 59)]
    columns = [
        times.iso_text(F.col("x")), times.safe_text(F.col("x")),
        times.trunc_hour(F.col("x")), times.trunc_day(F.col("x")),
        times.parse_iso(times.iso_text(F.col("x"))),
    ]
    expected = [
        [m.strftime("%Y-%m-%dT%H:%M:%S.%f") for m in moments],
        [m.strftime("%Y_%m_%dT%H_%M_%S_%f") for m in moments],
        [m.replace(minute=0, second=0, microsecond=0) for m in moments],
        [m.replace(hour=0, minute=0, second=0, microsecond=0) for m in moments],
        moments,
    ]
    for zone in ("UTC", "America/New_York", "Asia/Kolkata"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            found = [values(spark, c, moments, "x timestamp_ntz") for c in columns]
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        assert found == expected, zone


def test_to_utc(spark):
    found = values(spark, times.to_utc(F.col("x"), "America/New_York"), [datetime(2012, 7, 1, 20, 0, 0, 5)], "x timestamp_ntz")
    assert found == [datetime(2012, 7, 2)]


def human(size):
    for scale, label in ((1024.0**3, "G"), (1024.0**2, "M"), (1024.0, "K")):
        if size >= scale:
            return "{:.1f}{}".format(size / scale, label)
    return f"{size}B"


def test_human_bytes(spark):
    rows = [0, 1, 1023, 1024, 1048575, 1048576, 2**30, 5 * 2**30, 5 * 2**30 + 1, 2**45]
    rows += [2**30 + k * 2**30 // 20 for k in range(40)] + [1024 * k + 512 * (k % 3) // 5 for k in range(1, 60)]
    rows += [1280, 1376, 1408, 1024 + 256, 1024 + 768, 10 * 2**20 + 2**18, 10 * 2**20 + 3 * 2**18]
    assert values(spark, sizes.human_bytes(F.col("x")), rows, "x bigint") == [human(n) for n in rows]


def test_chunk_plan(spark):
    mib = 2**20
    rows = [(0,), (5120 * mib,), (5120 * mib + 1,), (5376 * mib,)]
    df = spark.createDataFrame(rows, "size bigint")
    plan = sizes.chunk_plan(df).collect()
    by_size = {}
    for r in plan:
        by_size.setdefault(r["size"], []).append((r.part, r.offset, r.length))
    assert set(by_size) == {5120 * mib + 1, 5376 * mib}
    for size, parts in by_size.items():
        parts.sort()
        assert [p[0] for p in parts] == list(range(1, len(parts) + 1))
        assert sum(p[2] for p in parts) == size
        assert parts[0][1] == 0 and all(a[1] + a[2] == b[1] for a, b in zip(parts, parts[1:]))
    assert len(by_size[5120 * mib + 1]) == 21 and by_size[5120 * mib + 1][-1][2] == 1
    with pytest.raises(ValueError):
        sizes.chunk_plan(df, chunk_mb=4)


def test_size_class_and_throughput(spark):
    mib = 2**20
    rows = [0, mib - 1, mib, 10 * mib, 100 * mib, 1024 * mib - 1, 1024 * mib, 10240 * mib]
    assert values(spark, sizes.size_class(F.col("x")), rows, "x bigint") == [0, 0, 1, 2, 5, 5, 10, 20]
    rate = sizes.throughput(F.lit(4 * mib), F.col("x"))
    assert values(spark, rate, [0, 999, 1999, 2000], "x bigint") == [4.0, 4.0, 4.0, 2.0]


STAT = ("/p", 1, 2, 33188, 10, "u", None)
PART = ("/p", "ks", "cf", "hd", 7, "Data.db", True, STAT, False)


def test_record_roundtrip(spark):
    meta = ("h", "abc", "1.2.0", PART)
    manifest = ("h", "ks", datetime(2012, 1, 2, 3, 4, 5, 6), "n", {"cf": [PART, PART], "empty": []})
    restored = (True, "/r", meta, "")
    for schema, row in ((FILE_META, meta), (MANIFEST, manifest), (RESTORED_FILE, restored)):
        df = spark.createDataFrame([row], schema).select(F.struct(*schema.fieldNames()).alias("r"))
        text = df.select(records.to_json(F.col("r"), schema).alias("j"))
        back = text.select(records.from_json(F.col("j"), schema).alias("r"))
        assert back.collect() == df.collect()


def test_stored_flags_and_numbers_are_text(spark):
    df = spark.createDataFrame([PART], COMPONENT).select(F.struct(*COMPONENT.fieldNames()).alias("r"))
    text = df.select(records.to_json(F.col("r"), COMPONENT)).first()[0]
    for piece in ('"generation":"7"', '"temporary":"True"', '"is_deleted":"false"', '"size":"10"', '"group":"None"'):
        assert piece in text


def test_flat_metadata(spark):
    stored = stored_form(FILE_META)
    df = spark.createDataFrame([("h", "abc", "1.2.0", PART)], FILE_META)
    record = F.struct(*[records.to_stored(F.col(f.name), f.dataType, f.name).alias(f.name) for f in FILE_META.fields])
    rows = df.select(record.alias("r"))
    flat = rows.select(records.flatten_meta(F.col("r"), stored).alias("m"), "r")
    m = flat.first()["m"]
    assert m["host"] == "h" and m["component|stat|size"] == "10" and len(m) == 18
    assert flat.select(records.unflatten_meta(F.col("m"), stored) == F.col("r")).first()[0]
    with pytest.raises(ValueError):
        records.flatten_meta(F.col("r"), T.StructType().add("a|b", "string"))
    with pytest.raises(ValueError):
        records.flatten_meta(F.col("r"), T.StructType().add("a", "long"))


def test_checksum_verdict(spark):
    rows = [
        (True, "m", '"x"', True),  # recorded checksum wins
        (True, "n", '"m"', False),
        (True, None, '"m"', True),
        (True, "", '"m-3"', None),  # multipart tag cannot decide
        (True, "m", '"m-3"', True),
        (False, "m", None, False),
    ]
    df = spark.createDataFrame(rows, "there boolean, recorded string, etag string, expected boolean")
    verdict = checks.checksum_matches(F.lit("m"), F.col("there"), F.col("recorded"), F.col("etag"))
    assert [r[0] for r in df.select(verdict).collect()] == [r[3] for r in rows]


def test_ownership_and_message(spark):
    assert values(spark, checks.owner(None, F.col("x")), ["u", "", None]) == ["u", None, None]
    assert values(spark, checks.owner("me", F.col("x")), ["u", ""]) == ["me", "me"]
    assert values(spark, checks.mode(F.col("x")), [0, 33188, None], "x int") == [None, 33188, None]
    done = checks.restored_message(F.lit(True), F.lit("a"), F.lit("b"), F.col("x"))
    skipped = checks.restored_message(F.lit(False), F.lit("a"), F.lit("b"), F.col("x"))
    assert values(spark, done, [None]) == ["a -> b"]
    assert values(spark, skipped, ["why", None]) == ["a -> Skipped: why", "a -> Skipped: "]


def test_generations_of_any_length(spark):
    rows = [("/d/ks/cf/ks-cf-hd-9223372036854775807-Data.db",), ("/d/ks/cf/ks-cf-hd-99999999999999999999-Data.db",)]
    found = paths.with_component(spark.createDataFrame(rows, "path string")).orderBy("generation").collect()
    assert [(r.generation, r.parse_error) for r in found] == [(None, "generation_overflow"), (2**63 - 1, None)]
