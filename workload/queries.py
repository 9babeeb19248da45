"""The registered queries: each operator over whole tables, with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetvault.functions import checks, paths, records, sizes, times
from fleetvault.operators import gates, history, listing, manifests, usage
from fleetvault.plans import references, restore, retention, upload, validate
from fleetvault.schemas import FILE_META, RELEASE_FIELD, stored_form
from fleetvault.sources import chunks, file_meta, inventory, transfer_log
from fleetvault.sources import manifests as manifest_source
from fleetvault.storage import run_dir, stored_once
from fleetvault.streaming import balances as balance_stream
from fleetvault.streaming import bootstrap
from fleetvault.streaming import events as event_stream
from fleetvault.streaming import lifetimes as lifetime_stream
from fleetvault.streaming import usage as usage_stream
from workload.views import Catalogue, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

AS_OF = datetime(2024, 3, 5)
CUTOFF = datetime(2000, 1, 1)
LAST_DAY = datetime(2000, 1, 31)
LOG_TIME = datetime(2024, 1, 31, 12, 0, 0, 250)
COMPONENT_ID = ["host", "keyspace", "cf", "version", "generation", "component"]


def query(slug: str, sql: str | None = None):
    def register(make: Callable[[Catalogue], DataFrame]):
        QUERIES[slug] = lambda spark, sf_dir: make(Catalogue(spark, sf_dir))
        if sql is not None:
            ORACLES[slug] = with_views(sql)
        return make

    return register


def moment(value: datetime):
    return F.lit(value.isoformat(" ")).cast("timestamp_ntz")


# SQL fragments shared by several statements.
NAME = "keyspace || '-' || cf || '-' || version || '-' || CAST(generation AS VARCHAR) || '-' || component"
SHORT_NAME = "cf || '-' || version || '-' || CAST(generation AS VARCHAR) || '-' || component"
SAFE_TS = "strftime({ts}, '%Y_%m_%dT%H_%M_%S_%f')"
ISO_TS = "strftime({ts}, '%Y-%m-%dT%H:%M:%S.%f')"
DAY_DIR = (
    "'cluster/' || keyspace || '/' || CAST(year(ts) AS VARCHAR) || '/' || CAST(month(ts) AS VARCHAR) "
    "|| '/' || CAST(day(ts) AS VARCHAR) || '/' || host"
)


def safe_ts(ts: str = "ts") -> str:
    return f"strftime({ts}, '%Y_%m_%dT%H_%M_%S_%f')"


def iso_ts(ts: str = "ts") -> str:
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%S.%f')"


BACKUP_NAME = f"{safe_ts()} || '-' || keyspace || '-' || host"


def human(size: str) -> str:
    """One decimal, exact ties to even: DuckDB formats the exact binary value that way."""
    return (
        f"CASE WHEN {size} >= 1073741824 THEN format('{{{{:.1f}}}}G', {size} / 1073741824.0::DOUBLE) "
        f"WHEN {size} >= 1048576 THEN format('{{{{:.1f}}}}M', {size} / 1048576.0::DOUBLE) "
        f"WHEN {size} >= 1024 THEN format('{{{{:.1f}}}}K', {size} / 1024.0::DOUBLE) "
        f"ELSE CAST({size} AS VARCHAR) || 'B' END"
    )


# -- paths and names -----------------------------------------------------------------------


def parsed_sql(view: str, head: int, keyspace: str, extra: str = "") -> str:
    """Parse file names of a view in SQL; ``head`` tokens come before the optional marker."""
    return f"""
        _tok AS (SELECT *, string_split(regexp_extract(path, '[^/]*$'), '-') AS t FROM {view}),
        _cut AS (SELECT *, CASE WHEN t[{head + 1}] = 'tmp' THEN 1 ELSE 0 END AS k FROM _tok),
        _part AS (SELECT *, t[{head + 1} + k] AS v, t[{head + 2} + k] AS g, t[{head + 3} + k] AS c FROM _cut),
        _parsed AS (SELECT *, CASE WHEN v IS NULL THEN 'not_data_file'
                                   WHEN NOT regexp_matches(v, '^[a-z]+') THEN 'invalid_version'
                                   WHEN TRY_CAST(g AS BIGINT) IS NULL OR c IS NULL THEN 'not_data_file'
                                   ELSE '' END AS parse_error, {keyspace} AS ks_read, t[{head}] AS cf_read {extra}
                    FROM _part)"""


PARSED_COLUMNS = """path, CASE WHEN parse_error = '' THEN ks_read ELSE '' END AS keyspace,
    CASE WHEN parse_error = '' THEN cf_read ELSE '' END AS cf, CASE WHEN parse_error = '' THEN v ELSE '' END AS version,
    CASE WHEN parse_error = '' THEN TRY_CAST(g AS BIGINT) ELSE -1 END AS generation,
    CASE WHEN parse_error = '' THEN c ELSE '' END AS component,
    parse_error = '' AND k = 1 AS temporary, parse_error"""
PARSE_NEW = parsed_sql("{path_inventory}", 2, "t[1]")
PARSE_OLD = parsed_sql("{legacy_inventory}", 1, "string_split(path, '/')[-2]")


def no_nulls(df: DataFrame) -> DataFrame:
    return df.fillna("").fillna(-1).fillna(False)


PARSED = ["path", "keyspace", "cf", "version", "generation", "component", "temporary", "parse_error"]


@query("parse_path", f"WITH {PARSE_NEW} SELECT {PARSED_COLUMNS} FROM _parsed")
def _(c):
    return no_nulls(paths.with_component(c.path_inventory).select(PARSED))


@query("parse_path_legacy", f"WITH {PARSE_OLD} SELECT {PARSED_COLUMNS} FROM _parsed")
def _(c):
    return no_nulls(paths.with_component(c.legacy_inventory, release="1.0.12").select(PARSED))


@query(
    "temporary_flag",
    "SELECT path, regexp_matches(path, '-tmp-[a-z]') AS temporary FROM {path_inventory}",
)
def _(c):
    return no_nulls(paths.with_component(c.path_inventory).select("path", "temporary"))


@query(
    "file_name",
    f"SELECT host, {NAME} AS new_name, {SHORT_NAME} AS old_name FROM {{backup_file}}",
)
def _(c):
    return c.backup_file.select(
        "host", paths.file_name("1.1.0").alias("new_name"), paths.file_name("1.0.12").alias("old_name")
    )


@query("backup_file_name", f"SELECT path, {NAME} AS backup_file_name FROM {{backup_file}}")
def _(c):
    return c.backup_file.select("path", paths.backup_file_name().alias("backup_file_name"))


@query("backup_path", "SELECT md5, path AS backup_path FROM {backup_file}")
def _(c):
    return c.backup_file.select("md5", paths.backup_path().alias("backup_path"))


@query(
    "restore_path",
    f"""SELECT path, keyspace || '/' || cf || '/' || {NAME} AS new_path,
               keyspace || '/' || {SHORT_NAME} AS old_path FROM {{backup_file}}""",
)
def _(c):
    return c.backup_file.select(
        "path", paths.restore_path("1.2.0").alias("new_path"), paths.restore_path("1.0.0").alias("old_path")
    )


@query(
    "dir_keys",
    """SELECT DISTINCT 'hosts/' || host || '/' || keyspace AS host_dir, 'cluster/' || keyspace AS cluster_dir
       FROM {backup_file}""",
)
def _(c):
    return c.backup_file.select(
        paths.host_keyspace_dir().alias("host_dir"), paths.cluster_keyspace_dir().alias("cluster_dir")
    ).distinct()


@query(
    "manifest_path",
    f"SELECT manifest_id, {DAY_DIR} AS day_dir, {DAY_DIR} || '/' || {BACKUP_NAME} || '.json' AS path FROM {{manifest}}",
)
def _(c):
    ts = F.col("ts")
    return c.manifest.select(
        "manifest_id", paths.manifest_day_dir(ts).alias("day_dir"), paths.manifest_path(ts).alias("path")
    )


@query("format_backup_name", f"SELECT manifest_id, {BACKUP_NAME} AS name FROM {{manifest}}")
def _(c):
    return c.manifest.select("manifest_id", paths.backup_name(F.col("ts")).alias("name"))


@query(
    "parse_backup_name",
    "SELECT manifest_id, keyspace, host, ts, false AS bad_name, false AS bad_path FROM {manifest}",
)
def _(c):
    ts = F.col("ts")
    named = c.manifest.select(
        "manifest_id",
        paths.parse_backup_name(paths.backup_name(ts)).alias("n"),
        paths.parse_backup_path(paths.manifest_path(ts)).alias("p"),
    )
    return named.select(
        "manifest_id", "n.keyspace", "n.host", "n.ts",
        F.col("n").isNull().alias("bad_name"), (~F.col("p").eqNullSafe(F.col("n"))).alias("bad_path"),
    )


@query(
    "sstable_key",
    """SELECT host, keyspace, cf, version, generation, count(*) AS components, sum(size)::BIGINT AS size
       FROM {backup_file} GROUP BY ALL""",
)
def _(c):
    grouped = c.backup_file.groupBy("host", paths.sstable_key().alias("sstable"))
    return grouped.agg(F.count("*").alias("components"), F.sum("size").alias("size")).select(
        "host", "sstable.*", "components", "size"
    )


@query(
    "format_release",
    """SELECT path, version, CASE version WHEN 'g' THEN '0.8.0' WHEN 'h' THEN '1.0.0' WHEN 'hc' THEN '1.0.4'
              WHEN 'hd' THEN '1.0.10' WHEN 'ia' THEN '1.2.0' ELSE '1.2.1' END AS release FROM {backup_file}""",
)
def _(c):
    return c.backup_file.select("path", "version", paths.format_release(F.col("version")).alias("release"))


@query(
    "parse_release",
    """SELECT path, CASE WHEN version IN ('ia', 'ib') THEN 1 WHEN version = 'g' THEN 0 ELSE 1 END AS major,
              CASE version WHEN 'g' THEN 8 WHEN 'ia' THEN 2 WHEN 'ib' THEN 2 ELSE 0 END AS minor,
              version IN ('ia', 'ib') AS nested_layout FROM {backup_file}""",
)
def _(c):
    release = paths.parse_release(paths.format_release(F.col("version")))
    since = paths.parse_release(F.lit("1.1.0"))
    return c.backup_file.select(
        "path", release[0].alias("major"), release[1].alias("minor"), (release >= since).alias("nested_layout")
    )


@query(
    "prefixed_key",
    "SELECT path, 'fleet/a/' || path AS key, path AS same, path AS back FROM {stored_file}",
)
def _(c):
    key = paths.prefixed_key(F.col("path"), "fleet/a")
    return c.stored_file.select(
        "path",
        key.alias("key"),
        paths.prefixed_key(F.col("path")).alias("same"),
        paths.without_prefix(key, "fleet/a").alias("back"),
    )


# -- times ---------------------------------------------------------------------------------


@query(
    "safe_ts",
    f"SELECT event_id, {safe_ts()} AS text, ts AS back FROM {{events}}",
)
def _(c):
    text = times.safe_text(F.col("ts"))
    return c.events.select("event_id", text.alias("text"), times.parse_safe(text).alias("back"))


@query("iso_ts", f"SELECT event_id, {iso_ts()} AS text, ts AS back FROM {{events}}")
def _(c):
    text = times.iso_text(F.col("ts"))
    return c.events.select("event_id", text.alias("text"), times.parse_iso(text).alias("back"))


@query(
    "parse_date",
    """SELECT id, text, coalesce(strftime(try_strptime(text, ['%Y-%m-%dT%H:%M:%S.%f', '%Y-%m-%dT%H:%M:%S',
              '%Y-%m-%dT%H:%M', '%Y-%m-%d']), '%Y-%m-%dT%H:%M:%S.%f'), 'error') AS parsed FROM {date_input}""",
)
def _(c):
    parsed = times.iso_text(times.parse_input(F.col("text")))
    return c.date_input.select("id", "text", F.coalesce(parsed, F.lit("error")).alias("parsed"))


@query(
    "to_utc",
    """SELECT event_id, date_trunc('second', ts AT TIME ZONE 'America/New_York' AT TIME ZONE 'UTC') AS utc
       FROM {events}""",
)
def _(c):
    return c.events.select("event_id", times.to_utc(F.col("ts"), "America/New_York").alias("utc"))


@query(
    "trunc_hour_day",
    """SELECT event_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour,
              CAST(date_trunc('day', ts) AS TIMESTAMP) AS day FROM {events}""",
)
def _(c):
    ts = F.col("ts")
    return c.events.select("event_id", times.trunc_hour(ts).alias("hour"), times.trunc_day(ts).alias("day"))


# -- sizes and transfers -------------------------------------------------------------------


@query(
    "human_bytes",
    f"SELECT size, {human('size')} AS text, bytes, {human('bytes')} AS bytes_text FROM "
    "(SELECT size, size // 4096 AS bytes FROM {backup_file})",
)
def _(c):
    sized = c.backup_file.select("size", F.shiftright("size", 12).alias("bytes"))
    return sized.select(
        "size",
        sizes.human_bytes(F.col("size")).alias("text"),
        "bytes",
        sizes.human_bytes(F.col("bytes")).alias("bytes_text"),
    )


@query(
    "chunk_plan",
    """SELECT path, part, (part - 1) * 268435456 AS "offset", least(268435456, size - (part - 1) * 268435456) AS length
       FROM (SELECT path, size, unnest(generate_series(1, CAST(ceil(size / 268435456.0) AS BIGINT))) AS part
             FROM {stored_file} WHERE size > 5368709120)""",
)
def _(c):
    return sizes.chunk_plan(c.stored_file).select("path", "part", "offset", "length")


@query(
    "size_class",
    """SELECT host, keyspace, reports, count(*) AS files FROM (
         SELECT host, keyspace, CASE WHEN size < 1048576 THEN 0 WHEN size < 10485760 THEN 1 WHEN size < 104857600 THEN 2
                WHEN size < 1073741824 THEN 5 WHEN size < 10737418240 THEN 10 ELSE 20 END AS reports
         FROM {stored_file}) GROUP BY ALL""",
)
def _(c):
    classed = c.stored_file.withColumn("reports", sizes.size_class(F.col("size")))
    return classed.groupBy("host", "keyspace", "reports").agg(F.count("*").alias("files"))


@query(
    "throughput",
    """SELECT seq, CAST(bytes AS DOUBLE) / 1048576 / greatest((bytes % 7919) // 1000, 1) AS mb_per_s,
              CASE WHEN bytes % 7919 > 0 THEN CAST(bytes AS DOUBLE) / 1048576 / (CAST(bytes % 7919 AS DOUBLE) / 1000) ELSE -1 END AS exact
       FROM {transfer_log}""",
)
def _(c):
    elapsed = F.col("bytes") % 7919
    exact = sizes.exact_throughput(F.col("bytes"), elapsed)
    return c.transfer_log.select(
        "seq",
        sizes.throughput(F.col("bytes"), elapsed).alias("mb_per_s"),
        F.coalesce(exact, F.lit(-1.0)).alias("exact"),
    )


# -- records -------------------------------------------------------------------------------


def meta_rows(c: Catalogue) -> DataFrame:
    """Recorded metadata with the nested component record."""
    flat = c.backup_file.withColumns(
        {
            "file_path": F.concat(F.lit("/var/lib/data/"), paths.restore_path()),
            "uid": (F.col("generation") % 1000).cast("int"),
            "gid": (F.col("generation") % 100).cast("int"),
            "mode": F.when(F.col("generation") % 17 == 0, 0).otherwise(33188),
            "user": F.when(F.col("generation") % 7 == 0, "").otherwise(F.concat(F.lit("u"), "keyspace")),
            "group": F.when(F.col("generation") % 9 == 0, F.lit(None)).otherwise(F.lit("db")),
            "temporary": F.col("generation") % 5 == 0,
            "is_deleted": F.col("generation") % 41 == 0,
        }
    )
    return flat.select(
        "host", "md5", F.lit("1.2.0").alias(RELEASE_FIELD), manifest_source.component_struct().alias("component")
    )


META_SQL = f"""SELECT host, md5, '/var/lib/data/' || keyspace || '/' || cf || '/' || {NAME} AS file_path,
    keyspace, cf, version, generation, component, size, CAST(generation % 1000 AS INTEGER) AS uid,
    CAST(generation % 100 AS INTEGER) AS gid, CASE WHEN generation % 17 = 0 THEN 0 ELSE 33188 END AS mode,
    CASE WHEN generation % 7 = 0 THEN '' ELSE 'u' || keyspace END AS "user",
    CASE WHEN generation % 9 = 0 THEN '' ELSE 'db' END AS "group",
    generation % 5 = 0 AS temporary, generation % 41 = 0 AS is_deleted FROM {{backup_file}}"""


def flat_meta(meta: DataFrame) -> DataFrame:
    part, stat = F.col("component"), F.col("component.stat")
    names = ["file_path", "keyspace", "cf", "version", "generation", "component", "temporary", "is_deleted"]
    return meta.select(
        "host",
        "md5",
        *[part[n].alias(n) for n in names],
        *[stat[n].alias(n) for n in ("size", "uid", "gid", "mode", "user")],
        F.coalesce(stat["group"], F.lit("")).alias("group"),
    )


@query("typed_roundtrip", META_SQL)
def _(c):
    rows = meta_rows(c).select(F.struct(*FILE_META.fieldNames()).alias("r"))
    text = rows.select(records.to_json(F.col("r"), FILE_META).alias("json"))
    back = text.select(records.from_json(F.col("json"), FILE_META).alias("r"))
    return flat_meta(back.select("r.*"))


@query(
    "flatten_meta",
    f"""WITH _m AS ({META_SQL})
        SELECT md5, unnest(['host', 'md5', '{RELEASE_FIELD}', 'component|file_path', 'component|keyspace', 'component|cf',
               'component|version', 'component|generation', 'component|component', 'component|temporary',
               'component|is_deleted', 'component|stat|file_path', 'component|stat|uid', 'component|stat|gid',
               'component|stat|mode', 'component|stat|size', 'component|stat|user', 'component|stat|group']) AS key,
               unnest([host, md5, '1.2.0', file_path, keyspace, cf, version, CAST(generation AS VARCHAR), component,
               CASE WHEN temporary THEN 'True' ELSE 'False' END, CASE WHEN is_deleted THEN 'true' ELSE 'false' END,
               file_path, CAST(uid AS VARCHAR), CAST(gid AS VARCHAR), CAST(mode AS VARCHAR), CAST(size AS VARCHAR),
               "user", CASE WHEN "group" = '' THEN 'None' ELSE "group" END]) AS value FROM _m""",
)
def _(c):
    flat = file_meta.to_object_metadata(file_meta.stored(meta_rows(c)))
    return file_meta.stored(meta_rows(c)).select("md5", F.explode(flat).alias("key", "value"))


@query("unflatten_meta", META_SQL)
def _(c):
    stored = file_meta.stored(meta_rows(c))
    objects = stored.select(file_meta.to_object_metadata(stored).alias("metadata"))
    return flat_meta(file_meta.from_object_metadata(objects))


@query(
    "file_md5",
    "SELECT path, md5(content) AS md5, CAST(octet_length(encode(content)) AS BIGINT) AS size FROM {content}",
)
def _(c):
    """Bodies as parts of 1 KiB, streamed in order through the digest."""
    return chunks.digests(chunks.cut(c.content, 1024)).select("path", "md5", "size")


@query(
    "multipart_verdict",
    """WITH _body AS (SELECT path, hex(encode(content)) AS h, octet_length(encode(content)) AS size FROM {content}),
        _tag AS (SELECT path, h, size, md5(unhex(string_agg(md5(unhex(substr(h, (part - 1) * 4096 + 1, 4096))), '' ORDER BY part)))
                     || '-' || count(*) AS tag
                 FROM (SELECT *, unnest(generate_series(1, CAST(ceil(size / 2048.0) AS BIGINT))) AS part FROM _body WHERE size > 2048)
                 GROUP BY ALL)
        SELECT path, CASE WHEN size <= 2048 THEN 'true' WHEN size % 7 = 0 THEN 'false' ELSE 'true' END AS verdict,
               tag FROM _body LEFT JOIN (SELECT path, tag FROM _tag) USING (path)""",
)
def _(c):
    """Objects that went up whole or in chunks of 2 KiB, some of them altered; only tags are known."""
    found = chunks.digests(chunks.cut(c.content, 1024), max_upload_bytes=2048, chunk_bytes=2048)
    body = F.col("content").cast("binary")
    size = F.octet_length(body)
    # What the store says, from the bodies at once.
    pieces = F.sequence(F.lit(1), F.greatest(F.ceil(size / 2048), F.lit(1)).cast("int"))
    digests = F.transform(pieces, lambda i: F.md5(F.substring(body, (i - 1) * 2048 + 1, F.lit(2048))))
    of_parts = F.concat(F.md5(F.unhex(F.array_join(digests, ""))), F.lit("-"), F.size(digests))
    altered = F.when(size % 7 == 0, F.concat(F.lit("0"), of_parts)).otherwise(of_parts)
    tag = F.when(size > 2048, altered).otherwise(F.md5(body))
    objects = c.content.select("path", F.concat(F.lit('"'), tag, F.lit('"')).alias("etag"))
    verdict = checks.checksum_matches(F.col("md5"), F.lit(True), F.lit(""), F.col("etag"), F.col("tag"))
    return found.join(objects, "path").select(
        "path", F.coalesce(verdict.cast("string"), F.lit("unknown")).alias("verdict"), "tag"
    )


STORED_TAG = """_meta AS (SELECT path, md5 FROM {backup_file}),
    _object AS (SELECT path, CASE WHEN generation % 3 = 0 THEN '' ELSE md5 END AS recorded,
                       '"' || md5 || CASE WHEN generation % 5 = 0 THEN '-3' ELSE '' END || '"' AS etag FROM {stored_file})"""


@query(
    "checksum_verdict",
    f"""WITH {STORED_TAG} SELECT m.path, CASE WHEN o.path IS NULL THEN 'false' WHEN recorded <> '' THEN CAST(recorded = m.md5 AS VARCHAR)
        WHEN contains(etag, '-') THEN 'unknown' ELSE CAST(trim(etag, '"') = m.md5 AS VARCHAR) END AS verdict
        FROM _meta m LEFT JOIN _object o USING (path)""",
)
def _(c):
    generation = F.col("generation")
    objects = c.stored_file.select(
        "path",
        F.when(generation % 3 == 0, "").otherwise(F.col("md5")).alias("recorded"),
        F.concat(F.lit('"'), "md5", F.when(generation % 5 == 0, "-3").otherwise(""), F.lit('"')).alias("etag"),
        F.lit(True).alias("exists"),
    )
    joined = c.backup_file.select("path", "md5").join(objects, "path", "left")
    verdict = checks.checksum_matches(
        F.col("md5"), F.coalesce("exists", F.lit(False)), F.col("recorded"), F.col("etag")
    )
    return joined.select("path", F.coalesce(verdict.cast("string"), F.lit("unknown")).alias("verdict"))


@query(
    "restore_ownership",
    f"""WITH _m AS ({META_SQL}) SELECT md5, coalesce(nullif("user", ''), '-') AS apply_user, 'ops' AS apply_group,
        coalesce(nullif(mode, 0), -1) AS apply_mode FROM _m""",
)
def _(c):
    planned = restore.with_ownership(flat_meta(meta_rows(c)), group="ops")
    return planned.select(
        "md5",
        F.coalesce("apply_user", F.lit("-")).alias("apply_user"),
        "apply_group",
        F.coalesce("apply_mode", F.lit(-1)).alias("apply_mode"),
    )


# -- eligibility ---------------------------------------------------------------------------

REASON = """CASE WHEN vanished THEN 'vanished' WHEN regexp_matches(path, '(^|/)snapshots/') THEN 'snapshot'
    WHEN parse_error <> '' THEN parse_error WHEN k = 1 THEN 'temporary' WHEN ks_read IN ('ks3') THEN 'excluded_keyspace'
    WHEN lower(ks_read) = 'system' THEN 'system_keyspace' ELSE 'eligible' END"""


def judged(c: Catalogue) -> DataFrame:
    return gates.eligibility(c.path_inventory, excluded=["ks3"], vanished=F.col("vanished"))


@query("eligibility", f"WITH {PARSE_NEW} SELECT path, size, {REASON} AS reason FROM _parsed")
def _(c):
    return judged(c).select("path", "size", "reason")


@query(
    "eligibility_counts",
    f"WITH {PARSE_NEW} SELECT {REASON} AS reason, count(*) AS files FROM _parsed GROUP BY ALL",
)
def _(c):
    return gates.eligibility_counts(judged(c))


@query(
    "snapshot_filter",
    "SELECT path, size FROM {path_inventory} WHERE NOT regexp_matches(path, '(^|/)snapshots/')",
)
def _(c):
    return c.path_inventory.filter(~paths.is_snapshot(F.col("path"))).select("path", "size")


@query(
    "keyspace_filter",
    "SELECT path, keyspace FROM {backup_file} WHERE keyspace NOT IN ('ks3') AND lower(keyspace) <> 'system'",
)
def _(c):
    return c.backup_file.filter(gates.keyspace_allowed(["ks3"])).select("path", "keyspace")


CHANGES = (
    parsed_sql(
        "(SELECT *, CASE WHEN kind = 'moved' THEN dest_path ELSE src_path END AS path FROM {change_event})", 2, "t[1]"
    )
    + """,
    _judged AS (SELECT *, NOT contains(path, '/snapshots/') AND parse_error = '' AND
                       CASE WHEN kind = 'deleted' THEN c = 'Data.db' ELSE k = 0 AND lower(ks_read) <> 'system' END AS accepted
                FROM _parsed),
    _changes AS (SELECT seq, ts, host, kind, size, is_initial, path, ks_read AS keyspace, cf_read AS cf, v AS version,
                        TRY_CAST(g AS BIGINT) AS generation, c AS component FROM _judged WHERE accepted)"""
)


@query(
    "initial_scan_gate",
    f"WITH {CHANGES} SELECT seq, path, accepted, accepted AND NOT is_initial AS emits FROM _judged",
)
def _(c):
    return gates.judge_changes(c.change_event, ignore_existing=True).select("seq", "path", "accepted", "emits")


@query(
    "delete_gate",
    f"WITH {CHANGES} SELECT seq, path FROM _changes WHERE kind = 'deleted'",
)
def _(c):
    return gates.accepted_changes(c.change_event).filter("kind = 'deleted'").select("seq", "path")


# -- listings ------------------------------------------------------------------------------

# A store holds a sidecar next to every file.
SIDECARS = "_all AS (SELECT path FROM {stored_file} UNION ALL SELECT path || '-meta.json' FROM {stored_file})"


def with_sidecars(c: Catalogue) -> DataFrame:
    path = F.col("path")
    return c.stored_file.select(F.explode(F.array(path, listing.sidecar_of(path))).alias("path"))


@query("list_files", "SELECT path AS entry, false AS is_dir FROM {stored_file}")
def _(c):
    return listing.list_dir(with_sidecars(c), "hosts", recursive=True)


@query(
    "list_dirs",
    f"""WITH {SIDECARS}, _p AS (SELECT string_split(path, '/') AS t FROM _all)
        SELECT DISTINCT array_to_string(t[1:n], '/') AS directory
        FROM (SELECT t, unnest(generate_series(1, len(t) - 1)) AS n FROM _p)""",
)
def _(c):
    return listing.directories(with_sidecars(c))


@query(
    "list_children",
    """WITH _p AS (SELECT string_split(path, '/') AS t FROM {stored_file})
       SELECT DISTINCT array_to_string(t[1:n - 1], '/') AS parent, t[n] AS name, n < len(t) AS is_dir
       FROM (SELECT t, unnest(generate_series(1, len(t))) AS n FROM _p)""",
)
def _(c):
    return listing.tree(with_sidecars(c))


@query(
    "list_root",
    """WITH _all AS (SELECT path FROM {stored_file} UNION ALL SELECT path FROM {manifest_listing}
           UNION ALL SELECT 'top-' || CAST(r_regionkey AS VARCHAR) FROM {region})
       SELECT DISTINCT 'level' AS what, split_part(path, '/', 1) AS entry, contains(path, '/') AS is_dir FROM _all
       UNION ALL SELECT DISTINCT 'dirs', split_part(path, '/', 1), true FROM _all WHERE contains(path, '/')
       UNION ALL SELECT 'files', path, false FROM _all WHERE NOT contains(path, '/')
       UNION ALL SELECT 'tree', path, false FROM _all
       UNION ALL SELECT DISTINCT 'inside', split_part(path, '/', 2), true FROM _all WHERE starts_with(path, 'hosts/')""",
)
def _(c):
    """The root of the store, with every combination of flags, and one folder below it."""
    top = c.region.select(F.concat(F.lit("top-"), F.col("r_regionkey")).alias("path"))
    paths = with_sidecars(c).unionByName(c.manifest_listing.select("path")).unionByName(top)

    def told(what: str, prefix: str, **flags) -> DataFrame:
        return listing.list_dir(paths, prefix, **flags).select(F.lit(what).alias("what"), "entry", "is_dir")

    return (
        told("level", "", include_dirs=True)
        .unionByName(told("dirs", "", include_files=False, include_dirs=True))
        .unionByName(told("files", ""))
        .unionByName(told("tree", "", recursive=True))
        .unionByName(told("inside", "hosts/", include_files=False, include_dirs=True))
        .unionByName(told("none", "", include_files=False))
    )


@query(
    "exists_semi",
    "SELECT path, md5 FROM {backup_file} WHERE path IN (SELECT path FROM {stored_file})",
)
def _(c):
    return listing.existing(c.backup_file, c.stored_file).select("path", "md5")


# -- manifests -----------------------------------------------------------------------------


def stored_parts(c: Catalogue) -> DataFrame:
    """Manifests as they are stored: a large one is several rows."""
    part = F.explode(F.sequence(F.lit(0), (F.col("manifest_id") % 3).cast("int"))).alias("part")
    root = run_dir(c.spark, "catalogue")
    rows = c.manifest.select("keyspace", "host", "ts", part)
    manifest_source.write_catalogue(rows, root, folders=("keyspace", "host"))
    return manifest_source.read_catalogue(c.spark, root)


@query("list_backups", f"SELECT DISTINCT keyspace, host, ts, {BACKUP_NAME} AS name FROM {{manifest}}")
def _(c):
    return manifests.listed(stored_parts(c)).drop("day")


LATEST = f"""SELECT keyspace, host, max(ts) AS ts, max({BACKUP_NAME}) AS name FROM {{manifest}}
    GROUP BY keyspace, host, CAST(ts AS DATE)"""


@query("latest_backup", LATEST)
def _(c):
    return manifests.latest(c.manifest).drop("day")


@query(
    "manifests_for_day",
    f"""SELECT DISTINCT keyspace, host, ts, {BACKUP_NAME} AS name FROM {{manifest}}
        WHERE (keyspace, host, CAST(ts AS DATE)) IN (SELECT (keyspace, host, max(CAST(ts AS DATE))) FROM {{manifest}} GROUP BY keyspace, host)""",
)
def _(c):
    requests = c.manifest.groupBy("keyspace", "host").agg(F.max(F.to_date("ts")).alias("day"))
    return manifests.for_days(stored_parts(c), requests).drop("day")


@query(
    "manifest_by_name",
    """SELECT DISTINCT keyspace, host, ts FROM {manifest}
       WHERE (keyspace, host, ts) IN (SELECT (keyspace, host, max(ts)) FROM {manifest} GROUP BY keyspace, host, CAST(ts AS DATE))""",
)
def _(c):
    found = manifests.by_name(stored_parts(c), manifests.latest(c.manifest))
    return found.select("keyspace", "host", "ts")


@query(
    "backup_size",
    f"""SELECT host, keyspace, ts, files, total_size, {human('total_size')} AS human_size FROM (
        SELECT host, keyspace, ts, count(*) AS files, sum(size)::BIGINT AS total_size FROM {{manifest_component}} GROUP BY ALL)""",
)
def _(c):
    return manifests.sizes(c.manifest_component)


@query(
    "cf_sizes",
    f"""SELECT host, keyspace, ts, cf, files, total_size, {human('total_size')} AS human_size FROM (
        SELECT host, keyspace, ts, cf, count(*) AS files, sum(size)::BIGINT AS total_size FROM {{manifest_component}} GROUP BY ALL)""",
)
def _(c):
    return manifests.sizes(c.manifest_component, (*manifests.KEY, "cf"))


@query(
    "backup_contents",
    f"""SELECT manifest_id, cf, {NAME} AS backup_file_name, size, {human('size')} AS human_size,
               row_number() OVER (PARTITION BY host, keyspace, ts ORDER BY cf, {NAME}, manifest_id, size) AS position
        FROM {{manifest_component}}""",
)
def _(c):
    shown = manifests.contents(c.manifest_component, ordered=False)
    placed = manifests.positions(shown, ["cf", "backup_file_name", "manifest_id", "size"])
    return placed.select("manifest_id", "cf", "backup_file_name", "size", "human_size", "position")


BODY = ["version", "generation", "component", "size"]
COMPONENTS = "SELECT host, keyspace, ts, cf, version, generation, component, size FROM {manifest_component}"


@query(
    "build_manifest",
    """SELECT host, keyspace, ts, count(DISTINCT cf) AS cfs, count(*) AS files, sum(size)::BIGINT AS size
       FROM {manifest_component} GROUP BY ALL""",
)
def _(c):
    nested = manifests.build(c.manifest_component, BODY)
    lists = F.map_values("components")
    total = F.aggregate(
        F.flatten(lists), F.lit(0).cast("bigint"), lambda acc, f: acc + f["size"]
    )
    return nested.select(
        "host", "keyspace", "ts", F.size("components").cast("bigint").alias("cfs"),
        F.size(F.flatten(lists)).cast("bigint").alias("files"), total.alias("size"),
    )


@query("explode_manifest", COMPONENTS)
def _(c):
    return manifests.explode(manifests.build(c.manifest_component, BODY, part_files=4))


# -- upload, validate, restore -------------------------------------------------------------


def upload_files(c: Catalogue) -> DataFrame:
    """What a backup finds; the store is compared with the same files."""
    c.keep_files()
    deleted = (F.col("generation") % 41 == 0) & (F.col("component") == "Data.db")
    return c.backup_file.withColumn("is_deleted", deleted)


UPLOADS = """_plan AS (SELECT f.path, f.size, f.keyspace, f.cf, CASE WHEN f.generation % 41 = 0 AND f.component = 'Data.db' THEN 'manifest_only'
    WHEN s.path IS NULL THEN 'upload' WHEN s.md5 = f.md5 THEN 'skip_valid' ELSE 'skip_corrupt' END AS action
    FROM {backup_file} f LEFT JOIN {stored_file} s ON s.path = f.path)"""


@query(
    "upload_plan",
    f"WITH {UPLOADS} SELECT path, action, action IN ('upload', 'manifest_only') AS writes_manifest FROM _plan",
)
def _(c):
    return upload.upload_plan(upload_files(c), c.stored_file).select("path", "action", "writes_manifest")


@query(
    "append_transfer_log",
    f"""WITH {UPLOADS} SELECT '2024-01-31T12:00:00.000250 stored /var/lib/data/' || regexp_extract(path, '[^/]*$') || ' to ' || path ||
        ' size ' || CAST(size AS VARCHAR) AS line FROM _plan WHERE action = 'upload'""",
)
def _(c):
    plan = upload.upload_plan(upload_files(c), c.stored_file)
    named = plan.withColumn("file_path", F.concat(F.lit("/var/lib/data/"), paths.backup_file_name()))
    return upload.stored_lines(named, moment(LOG_TIME))


STATUS = """_seen AS (SELECT m.host, m.keyspace, m.ts, b.path, s.path IS NOT NULL AS there, s.md5 = b.md5 AS same
    FROM {manifest_component} m LEFT JOIN {backup_file} b USING (host, keyspace, cf, version, generation, component, size)
    LEFT JOIN {stored_file} s ON s.path = b.path)"""


@query(
    "validate_presence",
    f"WITH {STATUS} SELECT host, keyspace, ts, path, CASE WHEN there THEN 'present' ELSE 'missing' END AS status FROM _seen",
)
def _(c):
    c.keep_files()
    checked = validate.validate(c.manifest_component, c.file_meta_log, c.stored_file)
    return checked.select("host", "keyspace", "ts", "path", "status")


@query(
    "validate_checksum",
    f"""WITH {STATUS} SELECT host, keyspace, ts, path, CASE WHEN NOT there THEN 'missing' WHEN same THEN 'present' ELSE 'corrupt' END AS status
        FROM _seen""",
)
def _(c):
    c.keep_files()
    checked = validate.validate(c.manifest_component, c.file_meta_log, c.stored_file, checksum=True)
    return checked.select("host", "keyspace", "ts", "path", "status")


@query(
    "validate_summary",
    f"""WITH {STATUS} SELECT host, keyspace, ts, count(*) FILTER (there AND same) AS present, count(*) FILTER (NOT there) AS missing,
        count(*) FILTER (there AND NOT same) AS corrupt, count(*) FILTER (NOT there OR NOT same) = 0 AS ok FROM _seen GROUP BY ALL""",
)
def _(c):
    c.keep_files()
    checked = validate.validate(c.manifest_component, c.file_meta_log, c.stored_file, checksum=True)
    return validate.summary(checked)


@query(
    "component_meta",
    """SELECT m.manifest_id, b.path, b.md5 FROM {manifest_component} m
       LEFT JOIN {backup_file} b USING (host, keyspace, cf, version, generation, component, size)""",
)
def _(c):
    c.keep_files()
    found = validate.component_meta(c.manifest_component, c.file_meta_log.select("path", "md5", "written"))
    return found.select("manifest_id", "path", "md5")


RESTORE = f"""_plan AS (SELECT f.host, f.keyspace, f.path AS source_path, f.md5, f.size,
        '/var/lib/data/' || f.keyspace || '/' || f.cf || '/' || regexp_extract(f.path, '[^/]*$') AS restore_path,
        regexp_extract(f.path, '[^/]*$') AS name,
        CASE WHEN t.restore_path IS NULL THEN 'No File' WHEN t.md5 = f.md5 THEN 'Existing file (Checksummed)'
             ELSE 'Existing file corrupt' END AS restore_reason
    FROM {{backup_file}} f LEFT JOIN {{target_file}} t ON t.host = f.host AND
         t.restore_path = '/var/lib/data/' || f.keyspace || '/' || f.cf || '/' || regexp_extract(f.path, '[^/]*$')),
    _outcome AS (SELECT p.*, restore_reason <> 'Existing file (Checksummed)' AS should_restore,
        CASE WHEN restore_reason = 'Existing file corrupt' THEN '/var/lib/data/../corrupt/' || p.keyspace || '/' || p.name ELSE '' END AS corrupt_path,
        CASE WHEN restore_reason = 'Existing file (Checksummed)' THEN '' WHEN s.path IS NULL THEN 'Source file missing'
             WHEN s.md5 <> p.md5 THEN 'Restored File corrupt' ELSE '' END AS failed_reason
    FROM _plan p LEFT JOIN {{stored_file}} s ON s.path = p.source_path)"""


@query(
    "restore_plan",
    f"WITH {RESTORE} SELECT host, source_path, restore_path, should_restore, restore_reason, corrupt_path FROM _outcome",
)
def _(c):
    c.keep_files()
    plan = restore.restore_plan(c.backup_file, c.target_file)
    return no_nulls(
        plan.select("host", "source_path", "restore_path", "should_restore", "restore_reason", "corrupt_path")
    )


def outcome(c: Catalogue) -> DataFrame:
    c.keep_files()
    # Kept files are small on disk and large in memory: their size must not make Spark send them to all tasks.
    stored = c.stored_file.hint("merge")
    return restore.restore_outcome(restore.restore_plan(c.backup_file, c.target_file), stored)


@query(
    "restore_outcome",
    f"WITH {RESTORE} SELECT source_path, should_restore, failed_reason FROM _outcome",
)
def _(c):
    return no_nulls(outcome(c).select("source_path", "should_restore", "failed_reason"))


@query(
    "restore_summary",
    f"""WITH {RESTORE}, _class AS (
        SELECT host, keyspace, CASE WHEN failed_reason <> '' THEN 'failed' WHEN NOT should_restore THEN 'skipped' ELSE 'restored' END AS "class",
               CASE WHEN failed_reason <> '' THEN failed_reason ELSE restore_reason END AS reason FROM _outcome
        UNION ALL SELECT host, keyspace, 'moved_aside', restore_reason FROM _outcome WHERE corrupt_path <> '')
        SELECT host, keyspace, "class", reason, count(*) AS files FROM _class GROUP BY ALL""",
)
def _(c):
    return restore.summary(outcome(c))


@query(
    "restore_message",
    f"""WITH {RESTORE} SELECT source_path || ' -> ' || CASE WHEN should_restore THEN restore_path ELSE 'Skipped: ' || restore_reason END AS message
        FROM _outcome""",
)
def _(c):
    message = checks.restored_message(
        F.col("should_restore"), F.col("source_path"), F.col("restore_path"), F.col("restore_reason")
    )
    return outcome(c).select(message.alias("message"))


# -- content -------------------------------------------------------------------------------


@query(
    "store_content",
    """SELECT path, md5(content) AS md5, CAST(octet_length(encode(content)) AS BIGINT) AS size FROM {content}
       WHERE path NOT IN (SELECT path FROM {content} WHERE lang = 'en')""",
)
def _(c):
    """Parts of 1 KiB, where half of one language's parts are stored already; digests of what is there then."""
    table = run_dir(c.spark, "content")
    parts = chunks.cut(c.content, 1024)
    chunks.append(parts.filter("path LIKE '%/de/%' AND part % 2 = 0"), table)
    stored = c.spark.read.parquet(table)
    chunks.append(chunks.new_parts(parts.filter("path NOT LIKE '%/en/%'"), stored), table)
    return chunks.digests(c.spark.read.parquet(table)).select("path", "md5", "size")


@query(
    "restore_content",
    """SELECT '/restored/' || source || '/' || regexp_extract(path, '[^/]*$') AS dest_path, md5(content) AS md5
       FROM {content} WHERE lang <> 'en'""",
)
def _(c):
    plan = c.content.select(
        F.col("path").alias("source_path"),
        F.concat_ws("/", F.lit("/restored"), "source", paths.base_name(F.col("path"))).alias("restore_path"),
        (F.col("lang") != "en").alias("should_restore"),
        F.lit(None).cast("string").alias("failed_reason"),
    )
    restored = chunks.restored(plan, chunks.cut(c.content, 1024))
    return chunks.digests(restored).select(F.col("path").alias("dest_path"), "md5")


# -- retention -----------------------------------------------------------------------------


@query("retention_keep", "SELECT manifest_id, ts FROM {manifest} WHERE ts >= TIMESTAMP '2000-01-01'")
def _(c):
    return retention.kept(c.manifest, retention.cutoff("2000-01-01")).select("manifest_id", "ts")


@query(
    "retention_keep_days",
    "SELECT manifest_id, ts FROM {manifest} WHERE ts >= TIMESTAMP '2001-08-01' - INTERVAL 400 DAY",
)
def _(c):
    before = retention.cutoff(keep_days=400, as_of=datetime(2001, 8, 1))
    return retention.kept(c.manifest, before).select("manifest_id", "ts")


@query(
    "manifest_days",
    """SELECT host, keyspace, strftime(d, '%Y-%m-%d') AS day FROM (SELECT DISTINCT host, keyspace FROM {manifest}) s,
       (SELECT unnest(generate_series(TIMESTAMP '2000-01-01', TIMESTAMP '2000-01-31', INTERVAL 1 DAY)) AS d)""",
)
def _(c):
    scopes = c.manifest.select(*retention.SCOPE).distinct()
    days = retention.manifest_days(scopes, CUTOFF, LAST_DAY)
    return days.select("host", "keyspace", F.date_format("day", "yyyy-MM-dd").alias("day"))


KEEP = f"""_keep AS (SELECT DISTINCT host, keyspace, {NAME} AS file_name FROM {{manifest_component}} WHERE ts >= TIMESTAMP '2000-01-01')"""


@query("keep_set", f"WITH {KEEP} SELECT host, keyspace, file_name FROM _keep")
def _(c):
    return retention.keep_files(c.manifest_component, CUTOFF)


PURGED_FILES = f"""{KEEP}, _files AS (SELECT s.host, s.keyspace, s.path, s.size FROM {{stored_file}} s WHERE NOT EXISTS
    (SELECT 1 FROM _keep k WHERE k.host = s.host AND k.keyspace = s.keyspace AND k.file_name = regexp_extract(s.path, '[^/]*$')))"""
PURGED_MANIFESTS = f"""_manifests AS (SELECT l.host, l.keyspace, l.path FROM {{manifest_listing}} l WHERE l.path NOT IN
    (SELECT {DAY_DIR} || '/' || {BACKUP_NAME} || '.json' FROM {{manifest}} WHERE ts >= TIMESTAMP '2000-01-01'))"""


@query("purge_files", f"WITH {PURGED_FILES} SELECT host, keyspace, path, size FROM _files")
def _(c):
    return purged_files(c).select("host", "keyspace", "path", "size")


def counted_rounds(c: Catalogue) -> tuple[str, int, DataFrame]:
    """Counts after several rounds: manifests added in three lots, purges in between, the last at CUTOFF."""
    store, parts = run_dir(c.spark, "references"), c.manifest_component
    first, second = datetime(1995, 1, 1), datetime(1998, 1, 1)
    lots = [parts.filter(F.col("manifest_id") % 3 == n) for n in range(3)]
    references.apply(c.spark, store, 0, added=lots[0])
    references.apply(c.spark, store, 1, added=lots[1], removed=references.expired(lots[0], first))
    still = lots[0].filter(F.col("ts") >= moment(first)).unionByName(lots[1])
    references.apply(c.spark, store, 2, added=lots[2], removed=references.expired(still, second))
    last = still.filter(F.col("ts") >= moment(second)).unionByName(lots[2])
    gone = references.expired(last, CUTOFF)
    references.apply(c.spark, store, 3, removed=gone)
    return store, 3, gone


@query("purge_counted", f"WITH {PURGED_FILES} SELECT host, keyspace, path, size FROM _files")
def _(c):
    """What the purge finds, from reference counts after several rounds of adding and purging."""
    c.keep_components()
    c.keep_files()
    store, version, _ = counted_rounds(c)
    found = references.unnamed(listed_store(c), references.counts(c.spark, store, version))
    return found.select("host", "keyspace", "path", "size")


@query(
    "purge_released",
    f"""WITH {KEEP}, _gone AS (SELECT DISTINCT host, keyspace, {NAME} AS file_name FROM {{manifest_component}}
            WHERE ts < TIMESTAMP '2000-01-01' AND (ts >= TIMESTAMP '1998-01-01' OR manifest_id % 3 = 2))
        SELECT host, keyspace, path, size FROM (SELECT *, regexp_extract(path, '[^/]*$') AS file_name FROM {{stored_file}}) s
        WHERE (host, keyspace, file_name) IN (SELECT (host, keyspace, file_name) FROM _gone)
          AND (host, keyspace, file_name) NOT IN (SELECT (host, keyspace, file_name) FROM _keep)""",
)
def _(c):
    """Only the files that the last purge let go of; no kept manifest is opened."""
    c.keep_components()
    c.keep_files()
    store, version, gone = counted_rounds(c)
    # Joined by sort: their size on disk must not make Spark send them to all tasks.
    names = stored_once(references.released(c.spark, store, version, gone), "released", compression="zstd").hint("merge")
    found = references.purge_files(listed_store(c), names)
    return found.select("host", "keyspace", "path", "size")


def listed_store(c: Catalogue) -> DataFrame:
    """What an inventory of the store shows: every file and its sidecar."""
    path = F.explode(F.array("path", listing.sidecar_of(F.col("path"))))
    return c.stored_file.withColumn("path", path)


def purged_files(c: Catalogue) -> DataFrame:
    return retention.purge_files(listed_store(c), c.manifest_component, CUTOFF)


def purged_manifests(c: Catalogue) -> DataFrame:
    return retention.purge_manifests(c.manifest_listing, c.manifest, CUTOFF)


@query("purge_manifests", f"WITH {PURGED_MANIFESTS} SELECT host, keyspace, path FROM _manifests")
def _(c):
    return purged_manifests(c).select("host", "keyspace", "path")


@query(
    "removal_plan",
    f"""WITH {PURGED_FILES} SELECT path, path || '-meta.json' AS meta_path, dry_run
        FROM _files, (VALUES (true), (false)) AS _v(dry_run)""",
)
def _(c):
    trial, real = (retention.removal_plan(purged_files(c), dry_run=d) for d in (True, False))
    return trial.unionByName(real).select("path", "meta_path", "dry_run")


@query(
    "removal_survivors",
    f"WITH {PURGED_FILES} SELECT path, md5 FROM {{stored_file}} WHERE path NOT IN (SELECT path FROM _files)",
)
def _(c):
    return retention.survivors(c.stored_file, retention.removal_plan(purged_files(c))).select("path", "md5")


@query(
    "purge_report",
    f"""WITH {PURGED_FILES}, {PURGED_MANIFESTS}
        SELECT host, keyspace, kind, count(*) AS paths, coalesce(sum(size), 0)::BIGINT AS reclaimed_bytes FROM (
        SELECT host, keyspace, 'file' AS kind, size FROM _files UNION ALL SELECT host, keyspace, 'manifest', NULL FROM _manifests) GROUP BY ALL""",
)
def _(c):
    return retention.purge_totals(retention.purge_report(purged_files(c), purged_manifests(c)))


# -- usage ---------------------------------------------------------------------------------

CHANGE = "CASE op WHEN 'stored' THEN bytes ELSE -bytes END"
BALANCE = f"""_run AS (SELECT *, date_trunc('hour', ts)::TIMESTAMP AS hour,
    (sum({CHANGE}) OVER (PARTITION BY host ORDER BY seq))::BIGINT AS balance FROM {{transfer_log}})"""
HOURS = f"""{BALANCE},
    _active AS (SELECT host, hour, arg_max(balance, seq) AS bytes, sum(CASE WHEN op = 'stored' THEN bytes ELSE 0 END)::BIGINT AS trans_in,
        sum(CASE WHEN op = 'restored' THEN bytes ELSE 0 END)::BIGINT AS trans_out, arg_min(balance - {CHANGE}, seq) AS opened,
        arg_max(balance, seq) FILTER (op = 'stored') AS level, max(balance) AS top FROM _run GROUP BY host, hour),
    _grid AS (SELECT host, unnest(generate_series(min(hour), greatest(max(hour), TIMESTAMP '2024-03-05'), INTERVAL 1 HOUR)) AS hour
        FROM _active GROUP BY host),
    _carried AS (SELECT g.host, g.hour, a.bytes IS NOT NULL AS activity, a.trans_in, a.trans_out, a.opened, a.level, a.top,
        last_value(a.bytes IGNORE NULLS) OVER (PARTITION BY g.host ORDER BY g.hour ROWS UNBOUNDED PRECEDING) AS bytes
        FROM _grid g LEFT JOIN _active a USING (host, hour)),
    _hours AS (SELECT host, hour, bytes, coalesce(level, opened, bytes) AS max_bytes, coalesce(greatest(top, opened), bytes) AS peak_bytes,
        coalesce(trans_in, 0) AS trans_in, coalesce(trans_out, 0) AS trans_out, activity FROM _carried)"""


def hours(c: Catalogue) -> DataFrame:
    return usage.hourly_usage(c.transfer_log, extrapolate_to=AS_OF)


@query("hourly_usage", f"WITH {HOURS} SELECT * FROM _hours")
def _(c):
    return hours(c)


MONTHLY = f"""WITH {HOURS} SELECT host, year(hour)::INTEGER AS year, month(hour)::INTEGER AS month, sum(max_bytes)::BIGINT AS byte_hours,
        sum(max_bytes)::BIGINT::DOUBLE / 1073741824 / 744 AS gb_months, sum(trans_in)::BIGINT::DOUBLE / 1073741824 AS trans_in_gb,
        sum(trans_out)::BIGINT::DOUBLE / 1073741824 AS trans_out_gb FROM _hours GROUP BY host, year(hour), month(hour)"""


@query("monthly_usage", MONTHLY)
def monthly(c):
    return usage.monthly_usage(hours(c)).withColumn("byte_hours", F.col("byte_hours").cast("bigint"))


@query("active_hours", f"WITH {HOURS} SELECT host, hour, bytes, max_bytes FROM _hours WHERE activity")
def _(c):
    return usage.shown_hours(hours(c)).select("host", "hour", "bytes", "max_bytes")


@query("running_balance", f"WITH {BALANCE} SELECT seq, host, op, bytes, balance FROM _run")
def _(c):
    return usage.running_balance(c.transfer_log).select("seq", "host", "op", "bytes", "balance")


@query("hour_peak", f"WITH {HOURS} SELECT host, hour, max_bytes, peak_bytes FROM _hours WHERE activity")
def _(c):
    return usage.active_hours(c.transfer_log).select("host", "hour", "max_bytes", "peak_bytes")


@query(
    "gap_fill",
    f"""WITH {HOURS} SELECT host, hour, bytes, activity FROM _hours
        WHERE hour <= (SELECT max(hour) FROM _active a WHERE a.host = _hours.host)""",
)
def _(c):
    return usage.hourly_usage(c.transfer_log).select("host", "hour", "bytes", "activity")


@query(
    "extrapolate_usage",
    f"""WITH {HOURS} SELECT host, hour, bytes, max_bytes FROM _hours
        WHERE hour > (SELECT max(hour) FROM _active a WHERE a.host = _hours.host)""",
)
def _(c):
    last = usage.active_hours(c.transfer_log).groupBy("host").agg(F.max("hour").alias("last"))
    extra = hours(c).join(last, "host").filter(F.col("hour") > F.col("last"))
    return extra.select("host", "hour", "bytes", "max_bytes")


@query(
    "late_events",
    """SELECT seq, host, coalesce(date_trunc('hour', ts) < max(date_trunc('hour', ts)) OVER
              (PARTITION BY host ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late FROM {late_log}""",
)
def _(c):
    return usage.late_lines(c.late_log).select("seq", "host", "late")


@query(
    "parse_transfer_log",
    """SELECT seq, ts, CASE WHEN seq % 101 = 3 THEN 'copied' ELSE op END AS op, src_path, dest_path, bytes,
              CASE WHEN seq % 101 = 3 THEN 'unknown_operation' ELSE '' END AS problem FROM {transfer_log}""",
)
def _(c):
    op = F.when(F.col("seq") % 101 == 3, "copied").otherwise(F.col("op"))
    line = upload.log_line(F.col("ts"), op, F.col("src_path"), F.col("dest_path"), F.col("bytes"))
    parsed = transfer_log.parse(c.transfer_log.select("seq", line.alias("line")))
    return parsed.select(
        "seq", "ts", "op", "src_path", "dest_path", "bytes", F.coalesce("problem", F.lit("")).alias("problem")
    )


@query(
    "scan_transfer_log",
    """SELECT host, count(*) AS lines, sum(bytes)::BIGINT AS bytes, 0::BIGINT AS bad_lines, true AS numbered
       FROM {transfer_log} GROUP BY host""",
)
def _(c):
    """Write the log as one folder of text files per host, read it back with line numbers."""
    table = run_dir(c.spark, "log")
    line = upload.log_line(F.col("ts"), F.col("op"), F.col("src_path"), F.col("dest_path"), F.col("bytes"))
    lines = c.transfer_log.select("host", line.alias("line"))
    lines.write.partitionBy("host").text(table)
    parsed = transfer_log.parse(transfer_log.read(c.spark, f"{table}/*/*.txt"))
    host = F.regexp_extract("file", r"host=([^/]*)/", 1)
    per_file = parsed.groupBy("file").agg(
        F.count("*").alias("lines"),
        F.sum("bytes").alias("bytes"),
        F.count("problem").alias("bad_lines"),
        (F.max("seq") - F.min("seq") + 1 == F.count_distinct("seq")).alias("numbered"),
    )
    return per_file.groupBy(host.alias("host")).agg(
        F.sum("lines").alias("lines"),
        F.sum("bytes").alias("bytes"),
        F.sum("bad_lines").alias("bad_lines"),
        F.bool_and("numbered").alias("numbered"),
    )


# -- history -------------------------------------------------------------------------------

LIVES = f"""{CHANGES},
    _next AS (SELECT *, min(CASE WHEN kind = 'deleted' THEN seq END) OVER (PARTITION BY host, keyspace, cf, version, generation
        ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS removed FROM _changes),
    _lives AS (SELECT host, keyspace, cf, version, generation, component, size, seq AS added_seq, coalesce(removed, -1) AS removed_seq
        FROM _next WHERE kind <> 'deleted')"""
LIFE_COLUMNS = [*COMPONENT_ID, "size", "added_seq"]


def changes(c: Catalogue) -> DataFrame:
    return gates.accepted_changes(c.change_event)


def shown_lives(lives: DataFrame) -> DataFrame:
    return lives.select(*LIFE_COLUMNS, F.coalesce("removed_seq", F.lit(-1)).alias("removed_seq"))


@query("component_intervals", f"WITH {LIVES} SELECT * FROM _lives")
def _(c):
    return shown_lives(history.lifetimes(changes(c)))


@query(
    "manifest_as_of",
    f"""WITH {LIVES}, _at AS (SELECT host, keyspace, (min(seq) + max(seq)) // 2 AS seq FROM _changes GROUP BY ALL)
        SELECT l.* FROM _lives l JOIN _at USING (host, keyspace)
        WHERE added_seq <= _at.seq AND (removed_seq = -1 OR removed_seq > _at.seq)""",
)
def _(c):
    """The manifests halfway through each owner's events."""
    found = changes(c)
    middle = F.expr("(min(seq) + max(seq)) div 2").alias("seq")
    requests = found.groupBy("host", "keyspace").agg(middle)
    return shown_lives(history.manifests_at(history.lifetimes(found), requests))


@query(
    "manifests_at",
    f"""WITH {LIVES}, _ask AS (SELECT host, keyspace, max(seq) AS at_seq FROM _changes GROUP BY host, keyspace, CAST(ts AS DATE))
        SELECT host, keyspace, at_seq, count(*) AS files, sum(size)::BIGINT AS size FROM _lives JOIN _ask USING (host, keyspace)
        WHERE added_seq <= at_seq AND (removed_seq = -1 OR removed_seq > at_seq) GROUP BY ALL""",
)
def _(c):
    """The manifests after the last event of each day."""
    found = changes(c)
    asked = found.groupBy("host", "keyspace", F.to_date("ts")).agg(F.max("seq").alias("seq"))
    files = history.manifests_at(history.lifetimes(found), asked)
    return files.groupBy("host", "keyspace", "at_seq").agg(
        F.count("*").alias("files"), F.sum("size").alias("size")
    )


@query(
    "backup_manifests",
    f"""WITH {LIVES}, _ask AS (SELECT host, keyspace, max_by(ts, seq) AS ts, max(seq) AS at_seq
            FROM _changes WHERE kind = 'deleted' GROUP BY host, keyspace, CAST(ts AS DATE)),
        _in AS (SELECT a.host, a.keyspace, a.ts, a.at_seq, l.size FROM _ask a LEFT JOIN _lives l ON l.host = a.host
            AND l.keyspace = a.keyspace AND added_seq <= at_seq AND (removed_seq = -1 OR removed_seq > at_seq))
        SELECT host, keyspace, at_seq, {BACKUP_NAME} AS name, count(size) AS files, coalesce(sum(size), 0)::BIGINT AS size
        FROM _in GROUP BY ALL""",
)
def _(c):
    """The manifests that the last deletion of each day writes, with their files nested."""
    found = changes(c)
    last = (
        found.filter("kind = 'deleted'")
        .groupBy("host", "keyspace", F.to_date("ts"))
        .agg(F.max_by("ts", "seq").alias("ts"), F.max("seq").alias("seq"))
    )
    written = history.backup_manifests(history.lifetimes(found), last)
    files = F.flatten(F.map_values("components"))
    count = F.size(files)
    total = F.aggregate(files, F.lit(0).cast("bigint"), lambda acc, f: acc + f["size"])
    return written.select(
        "host", "keyspace", "at_seq", "name",
        F.coalesce(F.when(count >= 0, count), F.lit(0)).cast("bigint").alias("files"),
        F.coalesce(total, F.lit(0)).cast("bigint").alias("size"),
    )


VERSIONS = f"""{LIVES},
    _step AS (SELECT host, keyspace, seq, ts, CASE WHEN kind = 'deleted' THEN 0 ELSE 1 END AS f, CASE WHEN kind = 'deleted' THEN 0 ELSE size END AS b FROM _changes
        UNION ALL SELECT host, keyspace, removed_seq, NULL, -1, -size FROM _lives WHERE removed_seq <> -1),
    _event AS (SELECT host, keyspace, seq, max(ts) AS ts, sum(f) AS f, sum(b) AS b FROM _step GROUP BY ALL),
    _version AS (SELECT host, keyspace, seq, ts, row_number() OVER w AS version, (sum(f) OVER w)::BIGINT AS live_files,
        (sum(b) OVER w)::BIGINT AS live_bytes FROM _event WINDOW w AS (PARTITION BY host, keyspace ORDER BY seq))"""


@query(
    "manifest_versions",
    f"WITH {VERSIONS} SELECT *, {BACKUP_NAME} AS name FROM _version",
)
def _(c):
    return history.versions(changes(c))


@query("live_files", f"WITH {VERSIONS} SELECT host, keyspace, seq, ts, live_files, live_bytes FROM _version")
def _(c):
    return history.live_totals(changes(c))


# -- streams -------------------------------------------------------------------------------


def event_folder(c: Catalogue, files: int = 4, late: bool = False) -> str:
    """The change events as several parquet files, in order of time, or some of them at the end."""
    folder = run_dir(c.spark, "events")
    order = F.when((F.col("seq") % 41 == 3) & F.lit(late), F.col("seq") + 10**12).otherwise(F.col("seq"))
    c.change_event.repartitionByRange(files, order).write.parquet(folder)
    return folder


@query("stream_events", f"WITH {CHANGES} SELECT seq, kind, path, accepted FROM _judged")
def _(c):
    table = run_dir(c.spark, "judged")
    stream = event_stream.read(c.spark, event_folder(c), files_per_batch=1)
    running = (
        gates.judge_changes(stream)
        .select("seq", "kind", "path", "accepted")
        .writeStream.format("parquet")
        .option("path", table)
        .option("checkpointLocation", run_dir(c.spark, "checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    return c.spark.read.parquet(table)


@query("stream_manifest", f"WITH {LIVES} SELECT * FROM _lives")
def _(c):
    store = run_dir(c.spark, "lifetimes")
    stream = event_stream.read(c.spark, event_folder(c, late=True), files_per_batch=2)
    lifetime_stream.start(stream, store, run_dir(c.spark, "checkpoint")).awaitTermination()
    return shown_lives(lifetime_stream.read(c.spark, store))


SCANNED = datetime(2024, 1, 12, 6)


@query(
    "stream_bootstrap",
    f"""WITH {LIVES}, _has AS (SELECT DISTINCT host, keyspace, cf, version, generation, component FROM _lives WHERE removed_seq = -1)
        SELECT * FROM _has""",
)
def _(c):
    """A first scan, then a watch that began before it: the files live at the end, as from the whole history."""
    store, folder = run_dir(c.spark, "lifetimes"), run_dir(c.spark, "events")

    def seen_at(place):
        """Folders are listed an hour apart."""
        return moment(SCANNED) + F.regexp_extract(place, "[0-9]$", 0).cast("int") * F.expr("INTERVAL '1' HOUR")

    found = changes(c)
    live = history.live_now(history.lifetimes(found.filter(F.col("ts") <= seen_at(F.col("cf")))))
    scan = live.select("host", F.concat(F.lit("/var/lib/data/"), paths.restore_path()).alias("path"), "size")
    ended = moment(SCANNED + timedelta(hours=10))
    event_stream.initial(scan.dropDuplicates(["host", "path"]), F.col("host"), ended).write.parquet(folder)
    c.change_event.repartitionByRange(4, "seq").write.mode("append").parquet(folder)
    folders = found.select("host", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder")).distinct()
    listed = folders.withColumn("seen_at", seen_at(F.col("folder")))
    watched = bootstrap.unseen(event_stream.read(c.spark, folder, files_per_batch=3), listed)
    lifetime_stream.start(watched, store, run_dir(c.spark, "checkpoint")).awaitTermination()
    return lifetime_stream.live(c.spark, store).select(*COMPONENT_ID).distinct()


@query(
    "inventory_difference",
    """WITH _b AS (SELECT host, path, size, md5 FROM {backup_file}), _s AS (SELECT host, path, size, md5 FROM {stored_file}),
        _gone AS (SELECT * FROM _b WHERE (host, path) NOT IN (SELECT (host, path) FROM _s)),
        _came AS (SELECT * FROM _s WHERE (host, path) NOT IN (SELECT (host, path) FROM _b)),
        _moved AS (SELECT g.host, g.path AS src_path, n.path AS dest_path, g.size
            FROM (SELECT * FROM _gone QUALIFY count(*) OVER (PARTITION BY host, size, md5) = 1) g
            JOIN (SELECT * FROM _came QUALIFY count(*) OVER (PARTITION BY host, size, md5) = 1) n USING (host, size, md5))
        SELECT host, 'moved' AS kind, src_path, dest_path, size FROM _moved
        UNION ALL SELECT host, 'deleted', path, '', size FROM _gone WHERE (host, path) NOT IN (SELECT (host, src_path) FROM _moved)
        UNION ALL SELECT host, 'created', path, '', size FROM _came WHERE (host, path) NOT IN (SELECT (host, dest_path) FROM _moved)
        UNION ALL SELECT host, 'created', path, '', _s.size FROM _s JOIN _b USING (host, path) WHERE _s.md5 <> _b.md5 OR _s.size <> _b.size""",
)
def _(c):
    """What happened between two scans: files renamed, written again, gone and new."""
    found = bootstrap.difference(c.backup_file, c.stored_file)
    return found.withColumn("dest_path", F.coalesce("dest_path", F.lit("")))


@query(
    "stream_hourly",
    f"""WITH _line AS (SELECT *, date_trunc('hour', ts)::TIMESTAMP AS hour FROM {{transfer_log}})
        SELECT host, hour, count(*) AS lines, sum({CHANGE})::BIGINT AS net,
        sum(CASE WHEN op = 'stored' THEN bytes ELSE 0 END)::BIGINT AS trans_in, sum(CASE WHEN op = 'restored' THEN bytes ELSE 0 END)::BIGINT AS trans_out
        FROM _line GROUP BY host, hour HAVING hour + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM {{transfer_log}})""",
)
def _(c):
    """Closed hours only: the last two stay open until later lines arrive."""
    folder, table = run_dir(c.spark, "log"), run_dir(c.spark, "hours")
    c.transfer_log.repartitionByRange(4, "ts").write.parquet(folder)
    lines = c.spark.readStream.schema(c.transfer_log.schema).parquet(folder)
    usage_stream.start(lines, table, run_dir(c.spark, "checkpoint")).awaitTermination()
    return c.spark.read.parquet(table)


@query(
    "stream_late_lines",
    """WITH _line AS (SELECT *, date_trunc('hour', ts)::TIMESTAMP AS hour FROM {late_log}),
        _on_time AS (SELECT host, hour, count(*) AS lines FROM _line WHERE seq % 50 <> 7 GROUP BY ALL)
        SELECT host, hour, count(*) AS lines FROM _line
        WHERE seq % 50 = 7 AND hour <= (SELECT max(hour) FROM _on_time) GROUP BY ALL""",
)
def _(c):
    """What came after its hour was closed, as the stream itself writes it down; the log is not read again."""
    folder, store, checkpoint = (run_dir(c.spark, n) for n in ("log", "balances", "checkpoint"))
    late = F.col("seq") % 50 == 7
    for part in (c.late_log.filter(~late), c.late_log.filter(late)):
        part.write.mode("append").parquet(folder)
        lines = c.spark.readStream.schema(c.late_log.schema).parquet(folder)
        balance_stream.start(lines, store, checkpoint, lateness_hours=0).awaitTermination()
    return balance_stream.late(c.spark, store).select("host", "hour", "lines")


@query("stream_monthly", MONTHLY)
def _(c):
    """The bill of a log of which some lines come late, kept up to date batch by batch."""
    folder, store = run_dir(c.spark, "log"), run_dir(c.spark, "balances")
    order = F.when(F.col("seq") % 41 == 3, F.col("seq") + 10**12).otherwise(F.col("seq"))
    c.transfer_log.repartitionByRange(4, order).write.parquet(folder)
    lines = c.spark.readStream.schema(c.transfer_log.schema).option("maxFilesPerTrigger", 2).parquet(folder)
    balance_stream.start(lines, store, run_dir(c.spark, "checkpoint")).awaitTermination()
    bill = balance_stream.bill(c.spark, store, extrapolate_to=AS_OF)
    return bill.withColumn("byte_hours", F.col("byte_hours").cast("bigint"))


# -- files ---------------------------------------------------------------------------------


@query(
    "scan_inventory",
    "SELECT source, lang, true AS has_files, true AS has_bytes FROM {documents} GROUP BY ALL",
)
def _(c):
    """Write the bodies as a tree of files, then list it without reading it."""
    root = run_dir(c.spark, "tree")
    c.documents.select("source", "lang", "text").write.partitionBy("source", "lang").parquet(root)
    found = inventory.scan(c.spark, root, "*.parquet")
    part = r"/source=([^/]*)/lang=([^/]*)/"
    return found.groupBy(
        F.regexp_extract("path", part, 1).alias("source"), F.regexp_extract("path", part, 2).alias("lang")
    ).agg((F.count("*") > 0).alias("has_files"), (F.min("size") > 0).alias("has_bytes"))


@query("walk_inventory", "SELECT source, lang, true AS owned FROM {documents} GROUP BY ALL")
def _(c):
    """The same tree, listed by tasks, with ownership."""
    root = run_dir(c.spark, "tree")
    c.documents.select("source", "lang", "text").write.partitionBy("source", "lang").parquet(root)
    start = c.spark.range(1).select(F.lit(root).alias("path"))
    found = inventory.walk(start, run_dir(c.spark, "walk")).filter(F.col("path").endswith(".parquet"))
    part = r"/source=([^/]*)/lang=([^/]*)/[^/.]"
    return found.groupBy(
        F.regexp_extract("path", part, 1).alias("source"), F.regexp_extract("path", part, 2).alias("lang")
    ).agg(F.bool_and(F.col("uid").isNotNull() & (F.col("size") > 0) & (F.col("mode") > 0)).alias("owned"))


def manifest_documents(c: Catalogue) -> DataFrame:
    """Nested manifests with whole component records."""
    flat = c.manifest_component.withColumns(
        {
            "file_path": F.concat(F.lit("/var/lib/data/"), paths.restore_path()),
            "uid": F.lit(7), "gid": F.lit(8), "mode": F.lit(33188), "user": F.lit("db"), "group": F.lit("db"),
            "temporary": F.lit(False), "is_deleted": F.lit(False),
        }
    )
    record = flat.select("host", "keyspace", "ts", "cf", manifest_source.component_struct().alias("file"))
    nested = manifests.build(record, ["file"])
    return nested.withColumn(
        "components", F.transform_values("components", lambda _, files: F.transform(files, lambda f: f["file"]))
    )


DOCUMENTS = """SELECT host, keyspace, ts, cf, version, generation, component, size, file_path_ok, named FROM
    (SELECT *, true AS file_path_ok, true AS named FROM {manifest_component})"""


def exploded_documents(read: DataFrame) -> DataFrame:
    named = F.col("name") == paths.backup_name(F.col("ts"))
    rows = manifests.explode(read.withColumn("named", named), ("host", "keyspace", "ts", "named"))
    expected = F.concat(F.lit("/var/lib/data/"), paths.restore_path())
    return rows.select(
        "host", "keyspace", "ts", "cf", "version", "generation", "component",
        F.col("stat.size").alias("size"), (F.col("file_path") == expected).alias("file_path_ok"), "named",
    )


@query("scan_manifests", DOCUMENTS)
def _(c):
    """Write the documents plainly and read them back as a tree."""
    root = run_dir(c.spark, "manifests")
    docs = manifest_source.documents(manifest_documents(c))
    docs.drop(*manifest_source.FOLDERS).write.json(f"{root}/cluster", compression="gzip")
    return exploded_documents(manifest_source.read_tree(c.spark, root))


@query("write_manifests", DOCUMENTS)
def _(c):
    """Write the documents to the folders of their keyspace, day and host and read them back as a table."""
    root = run_dir(c.spark, "manifests")
    manifest_source.write_table(manifest_documents(c), root)
    return exploded_documents(manifest_source.read_table(c.spark, root))


@query(
    "scan_file_meta",
    f"WITH _m AS ({META_SQL}) SELECT host, keyspace, count(*) AS files, sum(size)::BIGINT AS size, 0::BIGINT AS bad FROM _m GROUP BY ALL",
)
def _(c):
    root = run_dir(c.spark, "meta")
    file_meta.write(meta_rows(c), root)
    read = file_meta.read(c.spark, root, "*.json")
    return read.groupBy("host", F.col("component.keyspace").alias("keyspace")).agg(
        F.count("*").alias("files"),
        F.sum("component.stat.size").alias("size"),
        F.count(file_meta.CORRUPT).alias("bad"),
    )


@query("write_file_meta", META_SQL)
def _(c):
    root = run_dir(c.spark, "meta")
    file_meta.write(meta_rows(c), root)
    return flat_meta(file_meta.read(c.spark, root, "*.json"))
