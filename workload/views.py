"""Catalogue relations derived from the given tables.

Each text runs unchanged in Spark and in DuckDB; ``{name}`` stands for a given table or an
earlier relation. All rows of the given tables are used: what has to be missing from a
relation (a stored file, say) is renamed there instead of being filtered out.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from fleetvault.storage import stored_once

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

_FILE_COLUMNS = ["host", "keyspace", "cf", "version", "generation", "component", "size"]
_FILES = "SELECT DISTINCT host, keyspace, cf, version, generation, component, size FROM {manifest_component}"
_NAME = "keyspace || '-' || cf || '-' || version || '-' || CAST(generation AS STRING) || '-' || component"

VIEWS: dict[str, str] = {
    # Usage log of 17 hosts; one of them has a large share of the lines.
    "transfer_log": """
        SELECT event_id AS seq, ts,
               'node-' || CAST(CASE event_type WHEN 'click' THEN 0 ELSE user_id % 17 END AS STRING) AS host,
               CASE event_type WHEN 'purchase' THEN 'removed' WHEN 'error' THEN 'restored' ELSE 'stored' END AS op,
               '/data/my files/u' || CAST(user_id AS STRING) AS src_path,
               'hosts/u' || CAST(user_id AS STRING) AS dest_path,
               CAST(floor(coalesce(value, 0) * 1000) AS BIGINT) * 4096 AS bytes
        FROM {events}""",
    # The same log with some lines two hours behind.
    "late_log": """
        SELECT seq, host, op, bytes,
               CASE WHEN seq % 50 = 7 THEN ts - INTERVAL '2' HOUR ELSE ts END AS ts
        FROM {transfer_log}""",
    # One backup manifest per order; hosts contain a dash.
    "manifest": """
        SELECT o_orderkey AS manifest_id,
               CASE WHEN o_custkey % 5 = 0 THEN 'system' ELSE 'ks' || CAST(o_custkey % 5 AS STRING) END AS keyspace,
               'node-' || CAST(o_custkey % 3 AS STRING) || '.dc-1.example' AS host,
               o_orderdate + (o_orderkey % 86400) * INTERVAL '1' SECOND AS ts
        FROM {orders}""",
    # Manifest bodies, one row per component; lines repeat, so the keys are made distinct.
    "manifest_component": """
        SELECT m.manifest_id, m.keyspace, m.host, m.ts,
               'cf' || CAST(l_partkey % 4 AS STRING) AS cf,
               CASE l_partkey % 6 WHEN 0 THEN 'g' WHEN 1 THEN 'h' WHEN 2 THEN 'hc' WHEN 3 THEN 'hd' WHEN 4 THEN 'ia' ELSE 'ib' END AS version,
               l_partkey AS generation,
               CASE l_linenumber WHEN 1 THEN 'Data.db' WHEN 2 THEN 'Index.db' WHEN 3 THEN 'Filter.db' WHEN 4 THEN 'CompressionInfo.db'
                    WHEN 5 THEN 'Statistics.db' WHEN 6 THEN 'Summary.db' ELSE 'TOC.txt' END AS component,
               (l_partkey * 7919 + l_linenumber * 104729) * 1021 % 7000000000 AS size
        FROM {manifest} m JOIN (SELECT DISTINCT l_orderkey, l_partkey, l_linenumber FROM {lineitem}) l
             ON l_orderkey = m.manifest_id""",
    # Recorded metadata with checksum, one row per file.
    "backup_file": f"""
        SELECT host, keyspace, cf, version, generation, component, size,
               'hosts/' || host || '/' || keyspace || '/' || cf || '/' || {_NAME} AS path,
               md5(host || '/' || keyspace || '/' || cf || '/' || CAST(generation AS STRING) || '/' || component) AS md5
        FROM ({_FILES}) q""",
    # Metadata as it is appended: files that were written again have an older row too.
    "file_meta_log": """
        SELECT *, 2 AS written FROM {backup_file}
        UNION ALL
        SELECT host, keyspace, cf, version, generation, component, size, path, md5(path) AS md5, 1 AS written
        FROM {backup_file} WHERE generation % 3 = 0""",
    # What is really in the store: some files renamed (missing, and orphans), some altered.
    "stored_file": """
        SELECT host, keyspace, cf, version, generation, size,
               path || CASE WHEN generation % 29 = 3 THEN '.old' ELSE '' END AS path,
               CASE WHEN generation % 13 = 5 THEN md5(md5) ELSE md5 END AS md5
        FROM {backup_file}""",
    # What already lies at the restore destinations.
    "target_file": f"""
        SELECT host,
               '/var/lib/data/' || keyspace || '/' || cf || '/' || {_NAME} ||
               CASE WHEN generation % 3 = 0 THEN '.old' ELSE '' END AS restore_path,
               CASE WHEN generation % 3 = 1 THEN md5(md5) ELSE md5 END AS md5
        FROM {{backup_file}}""",
    # Stored manifest documents, with some half-written strays.
    "manifest_listing": """
        SELECT host, keyspace,
               'cluster/' || keyspace || '/' || CAST(year(ts) AS STRING) || '/' || CAST(month(ts) AS STRING) || '/' ||
               CAST(day(ts) AS STRING) || '/' || host || '/' || substr(CAST(ts AS STRING), 1, 4) || '_' ||
               substr(CAST(ts AS STRING), 6, 2) || '_' || substr(CAST(ts AS STRING), 9, 2) || 'T' ||
               substr(CAST(ts AS STRING), 12, 2) || '_' || substr(CAST(ts AS STRING), 15, 2) || '_' ||
               substr(CAST(ts AS STRING), 18, 2) || '_000000-' || keyspace || '-' || host || '.json' ||
               CASE WHEN manifest_id % 97 = 0 THEN '.partial' ELSE '' END AS path
        FROM {manifest}""",
    # Raw paths with decoys: snapshots, temporaries, foreign files, bad versions, vanished files.
    "path_inventory": f"""
        SELECT '/var/lib/data/' || keyspace || '/' || cf || CASE WHEN generation % 11 = 2 THEN '/snapshots/s1/' ELSE '/' END ||
               CASE WHEN generation % 23 = 4 THEN 'notes.txt'
                    WHEN generation % 19 = 6 THEN keyspace || '-' || cf || '-9-' || CAST(generation AS STRING) || '-' || component
                    WHEN generation % 7 = 3 THEN keyspace || '-' || cf || '-tmp-' || version || '-' || CAST(generation AS STRING) || '-' || component
                    ELSE {_NAME} END AS path,
               size, generation % 31 = 1 AS vanished
        FROM (SELECT DISTINCT keyspace, cf, version, generation, component, size FROM {{backup_file}}) q""",
    # The same for older releases, whose file names leave the keyspace out.
    "legacy_inventory": """
        SELECT '/var/lib/data/' || keyspace || '/' ||
               CASE WHEN generation % 23 = 4 THEN 'notes.txt'
                    WHEN generation % 19 = 6 THEN cf || '-9-' || CAST(generation AS STRING) || '-' || component
                    WHEN generation % 7 = 3 THEN cf || '-tmp-' || version || '-' || CAST(generation AS STRING) || '-' || component
                    ELSE cf || '-' || version || '-' || CAST(generation AS STRING) || '-' || component END AS path
        FROM (SELECT DISTINCT keyspace, cf, version, generation, component FROM {backup_file}) q""",
    # Change stream over a small set of SSTables, one of them hot; with decoys.
    "change_file": """
        SELECT event_id AS seq, ts,
               CASE event_type WHEN 'click' THEN 0 ELSE user_id END AS generation,
               CASE event_type WHEN 'view' THEN 'Index.db' WHEN 'error' THEN 'Index.db' ELSE 'Data.db' END AS component,
               CASE event_type WHEN 'purchase' THEN 'deleted' WHEN 'error' THEN 'deleted' WHEN 'signup' THEN 'moved' ELSE 'created' END AS kind,
               CAST(floor(coalesce(value, 0) * 1000) AS BIGINT) AS size
        FROM {events}""",
    "change_event": """
        SELECT seq, ts, kind, size, host,
               dir || CASE WHEN kind = 'moved' THEN head || '-tmp' ELSE head END || '-hd-' || tail AS src_path,
               CASE WHEN kind = 'moved' THEN dir || head || '-hd-' || tail END AS dest_path,
               ts < TIMESTAMP '2024-01-03 00:00:00' AS is_initial
        FROM (SELECT seq, ts, kind, size, 'node-' || CAST(generation % 5 AS STRING) AS host,
                     '/var/lib/data/' || ks || '/cf' || CAST(generation % 4 AS STRING) ||
                     CASE WHEN seq % 53 = 7 THEN '/snapshots/s1/' ELSE '/' END AS dir,
                     CASE WHEN seq % 59 = 5 THEN 'notes' ELSE ks || '-cf' || CAST(generation % 4 AS STRING) END AS head,
                     CAST(generation AS STRING) || '-' || component AS tail
              FROM (SELECT *, CASE WHEN generation % 10 = 9 THEN 'System' ELSE 'ks' || CAST(generation % 3 AS STRING) END AS ks
                    FROM {change_file}) q) r""",
    # File bodies.
    "content": """
        SELECT 'hosts/' || source || '/' || lang || '/doc-' || CAST(doc_id AS STRING) AS path,
               lang, source, text AS content
        FROM {documents}""",
    # What users type as dates.
    "date_input": """
        SELECT event_id AS id,
               CASE event_id % 6
                    WHEN 0 THEN substr(CAST(ts AS STRING), 1, 10)
                    WHEN 1 THEN substr(CAST(ts AS STRING), 1, 10) || 'T' || substr(CAST(ts AS STRING), 12, 5)
                    WHEN 2 THEN substr(CAST(ts AS STRING), 1, 10) || 'T' || substr(CAST(ts AS STRING), 12, 8)
                    WHEN 3 THEN substr(CAST(ts AS STRING), 1, 10) || 'T' || substr(CAST(ts AS STRING), 12, 8) || '.' || CAST(event_id % 1000 AS STRING)
                    WHEN 4 THEN CAST(year(ts) AS STRING) || '-' || CAST(month(ts) AS STRING) || '-' || CAST(day(ts) AS STRING)
                    ELSE event_type || substr(CAST(ts AS STRING), 1, 10) END AS text
        FROM {events}""",
}

_REFERENCE = re.compile(r"\{(\w+)\}")


def needs(text: str) -> list[str]:
    return list(dict.fromkeys(_REFERENCE.findall(text)))


class Catalogue:
    """The relations as DataFrames over one folder of given tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._made: dict[str, DataFrame] = {}

    def keep_components(self) -> None:
        """Write the rows of ``manifest_component`` once, for a query that adds and removes them in several
        rounds, each of which would join the given tables anew."""
        self._made["manifest_component"] = stored_once(self.manifest_component, "components", compression="zstd")

    def keep_files(self) -> None:
        """Write the rows of ``backup_file`` once, for a query that uses it in several relations.

        Each relation would work them out anew, since Spark pushes other filters into each. Rows move
        as they are to their place and are made distinct there: one table of them in a task, not two.
        """
        found = self.manifest_component.select(*_FILE_COLUMNS).repartition(*_FILE_COLUMNS).distinct()
        text = VIEWS["backup_file"].replace(f"({_FILES})", "{files}")
        self._made["backup_file"] = self.spark.sql(text, files=stored_once(found, "files"))

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in TABLES:
                made = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            elif name in VIEWS:
                text = VIEWS[name]
                made = self.spark.sql(text, **{n: getattr(self, n) for n in needs(text)})
            else:
                raise AttributeError(name)
            self._made[name] = made
        return self._made[name]


def with_views(sql: str) -> str:
    """A query over ``{view}`` names as one statement over the given tables."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in needs(text):
            if name in VIEWS and name not in ordered:
                visit(VIEWS[name])
                ordered.append(name)

    visit(sql)
    plain = {n: n for n in (*TABLES, *VIEWS)}
    parts = [f"{n} AS ({VIEWS[n].format(**plain)})" for n in ordered]
    head, body = "", sql.format(**plain).strip()
    if parts:
        head = "WITH " + ",\n".join(parts)
        if body.upper().startswith("WITH "):
            return head + ",\n" + body[5:]
        return head + "\n" + body
    return body
