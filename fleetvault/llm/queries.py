"""One query per operator of this package, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetvault.llm import decontaminate, html_text, jaccard_join, license_scan, packing, pii, quality, quality_rules, ranked_search, substring_dedup, topk, vector_codes, warc
from fleetvault.storage import run_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(make: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = make
        if sql is not None:
            ORACLES[name] = sql
        return make

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "op1_topk_search",
    """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
        FROM embeddings
        WHERE embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
    s AS (
        SELECT q.vec_id AS query_id, c.vec_id,
               CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10""",
)
def op1(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.filter("vec_id % 100 = 0"), k=10, scale=1024)


@query(
    "op4_substring_dedup",
    r"""
    WITH w AS (
        SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
        FROM documents),
    win AS (
        SELECT doc_id, p, array_to_string(ws[p:p + 12], ' ') AS key
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS p FROM w)),
    earliest AS (SELECT key, min(doc_id) AS least FROM win GROUP BY key),
    gone AS (
        SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS i
        FROM win JOIN earliest USING (key) WHERE least < doc_id),
    word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
    kept AS (
        SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept
        FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
    SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
           sha256(coalesce(kept, '')) AS kept_sha256
    FROM w LEFT JOIN kept USING (doc_id)""",
)
def op4(spark, sf_dir):
    cleaned = substring_dedup.dedup(table(spark, sf_dir, "documents"), window=13)
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query(
    "op7_benchmark_decontamination",
    r"""
    WITH d AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
    b AS (
        SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
    iw AS (
        SELECT DISTINCT item_id, w, array_to_string(ws[p:p + w - 1], ' ') AS key
        FROM (SELECT item_id, ws, least(len(ws), 10) AS w, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS p
              FROM b WHERE len(ws) > 0)),
    dw AS (
        SELECT doc_id, w, p, array_to_string(ws[p:p + w - 1], ' ') AS key
        FROM (SELECT doc_id, ws, w, unnest(range(1, len(ws) - w + 2)) AS p
              FROM d, (SELECT DISTINCT w FROM iw) WHERE len(ws) >= w)),
    hit AS (SELECT doc_id, w, p, item_id FROM dw JOIN iw USING (w, key)),
    words AS (
        SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(p, p + w)) AS i FROM hit) GROUP BY 1),
    items AS (
        SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY 1)
    SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit,
           CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
           coalesce(words.n, 0) > 0 AS contaminated
    FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
)
def op7(spark, sf_dir):
    docs, tests = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = decontaminate.find(docs.select("doc_id", "text"), tests, window=10)
    ids = F.array_sort(F.array_distinct(F.transform("items", lambda i: i.cast("string"))))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op5_html_text")
def op5(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return html_text.extract(pages, html_text.train(pages))


def vocabulary() -> str:
    """The vocabulary file that the packing query is defined with."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op6_packing")
def op6(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary(), length=2048)


@query("op2_quality")
def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality")))
    return scored.select(
        F.col("row.doc_id").alias("doc_id"),
        quality.held_out("row.doc_id").alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query(
    "op3_warc",
    """
    WITH p AS (
        SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
               sha256(coalesce(html, '')) AS payload_digest FROM pages),
    f AS (SELECT payload_digest, min(page_id) AS response FROM p WHERE payload_bytes >= 100 GROUP BY 1)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN response <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN response <> page_id THEN response END AS refers_to
    FROM p LEFT JOIN f USING (payload_digest)""",
)
def op3(spark, sf_dir):
    warc.register(spark)
    archive = run_dir(spark, "warc")
    made = warc.page_records(table(spark, sf_dir, "pages"))
    made.write.format("warc").option("path", archive).mode("append").save()
    read = spark.read.format("warc").option("path", archive).load()
    response = F.col("record_type") == "response"
    # Responses are measured on the payload that came back, revisits by their headers.
    return read.select(
        warc.page_of("record_id").alias("page_id"),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256)).otherwise(F.substring_index("payload_digest", ":", -1)).alias(
            "payload_digest"
        ),
        "record_type",
        warc.page_of("refers_to").alias("refers_to"),
    )


@query("op10_pii")
def op10(spark, sf_dir):
    found = pii.find(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s.kind)
    counts = [
        (F.size("base") - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in pii.KINDS
    ]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"),
        pii.listed(F.concat("base", "added")).alias("spans"),
    )


def _license_sql() -> str:
    """Every unit against every notice, without pruning."""
    rows = ", ".join(
        f"({i}, '{name}', {found!r})"
        for i, (name, found) in enumerate((n, license_scan.bigrams_of(t)) for n, t in license_scan.NOTICES)
        if found
    )
    return rf"""
    WITH notice(ord, license, grams) AS (VALUES {rows}),
    unit AS (
        SELECT doc_id, unnest(us) AS u, unnest(range(len(us))) AS line
        FROM (SELECT doc_id, list_concat(
                string_split(t, chr(10)),
                list_filter(string_split_regex(t, '
[ 	
]*
'), lambda p: contains(p, chr(10)))) AS us
              FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))),
    words AS (
        SELECT doc_id, line, string_split(trim(regexp_replace(translate(u, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')), ' ') AS ws FROM unit),
    own AS (
        SELECT doc_id, line, list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS g
        FROM words WHERE len(ws) > 1),
    pair AS (
        SELECT doc_id, line, ord, license,
               2 * len(list_intersect(g, grams)) / CAST(len(g) + len(grams) AS DOUBLE) AS dice
        FROM own, notice),
    per_unit AS (
        SELECT * FROM pair WHERE dice >= 0.8
        QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY dice DESC, ord) = 1),
    best AS (
        SELECT doc_id, license, dice, count(*) OVER (PARTITION BY doc_id) AS n FROM per_unit
        QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, ord, line) = 1)
    SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_matches, license, coalesce(dice, 0.0::DOUBLE) AS dice
    FROM documents LEFT JOIN best USING (doc_id)"""


@query("op8_license_scan", _license_sql())
def op8(spark, sf_dir):
    found = license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"), F.size("matches").cast("long").alias("n_matches"), "license", "dice"
    )


@query(
    "op9_jaccard_join",
    r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
    sh AS (
        SELECT DISTINCT doc_id, array_to_string(ws[p:p + 2], ' ') AS s
        FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS p FROM w WHERE len(ws) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
    shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b USING (s) GROUP BY 1, 2),
    link AS (
        SELECT x, y FROM shared JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
        WHERE 100 * c >= 90 * (nx.n + ny.n - c)),
    reach(x, y) AS (
        SELECT x, y FROM link
        UNION
        SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x)
    SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(r.least, doc_id) AS component_id
    FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x, min(y) AS least FROM reach GROUP BY x) r ON r.x = doc_id""",
)
def op9(spark, sf_dir):
    return jaccard_join.components(table(spark, sf_dir, "documents"), width=3, percent=90)


@query(
    "op12_quality_rules",
    r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    w AS (
        SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
               list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
    win AS (
        SELECT doc_id, p, array_to_string(ws[p:p + 7], ' ') AS key
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS p FROM w)),
    twice AS (SELECT doc_id, key FROM win GROUP BY ALL HAVING count(*) > 1),
    rep AS (
        SELECT doc_id, count(*) AS n
        FROM (SELECT DISTINCT doc_id, unnest(range(p, p + 8)) AS i FROM win JOIN twice USING (doc_id, key)) GROUP BY 1),
    m AS (
        SELECT doc_id, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
               length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
               len(ls) - len(list_distinct(ls)) AS n_dup_lines, len(ls) AS n_lines, coalesce(rep.n, 0) AS n_repeat_words,
               len(list_filter(ws, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS letters,
               len(list_filter(ws, lambda x: list_contains(string_split('the of and to a in is that it for was on with '
                   'as be by are this at from have der die und den von zu das sich mit des auf ist im nicht dem ein eine '
                   'de la le et les en du un une que est pour par dans qui pas sur au el y los las se del por con no una '
                   'su para es al lo', ' '), translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')))) AS stops,
               len(list_filter(ls, lambda l: regexp_matches(l, '^[ \t]*[-*\x{2022}]'))) AS items,
               len(list_filter(ls, lambda l: regexp_matches(l, '(\.\.\.|\x{2026})[ \t\r]*$'))) AS cuts
        FROM w LEFT JOIN rep USING (doc_id)),
    b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT (base_failed OR 100 * word_chars < 300 * n_words OR 100 * word_chars > 1000 * n_words
                OR 100 * n_symbols > 10 * n_words OR 100 * letters < 80 * n_words OR 100 * stops < 2 * n_words
                OR 100 * n_dup_lines > 40 * n_lines OR 100 * items > 90 * n_lines OR 100 * cuts > 30 * n_lines) AS kept
    FROM b""",
)
def op12(spark, sf_dir):
    judged = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base_failed = F.arrays_overlap("failed", F.array(*[F.lit(rule.name) for rule in quality_rules.BASE]))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select(F.col("row.doc_id").alias("doc_id"), *counts, base_failed.alias("base_failed"), "kept")


def _codes_sql(rounds: int = 4) -> str:
    """Every part against every entry, round after round."""
    near = """SELECT v.vec_id, v.p, arg_min(b.i, b.i + 1024 * d.d) AS i, min(d.d) AS d FROM v JOIN {book} b USING (p),
        LATERAL (SELECT CAST(list_sum(list_transform(range(1, 17), lambda j: (v.x[j] - b.x[j]) * (v.x[j] - b.x[j]))) AS BIGINT) AS d) d
        GROUP BY 1, 2"""
    steps = ""
    for r in range(rounds):
        steps += f"""
    near{r} AS MATERIALIZED ({near.format(book=f"book{r}")}),
    mean{r} AS (
        SELECT p, i, j, CAST(sum(v.x[j]) AS BIGINT) AS s, count(*) AS c
        FROM near{r} JOIN v USING (vec_id, p), (SELECT unnest(range(1, 17)) AS j) GROUP BY 1, 2, 3),
    moved{r} AS (
        SELECT p, i, array_agg((s - ((s % c) + c) % c) // c ORDER BY j) AS x FROM mean{r} GROUP BY 1, 2),
    book{r + 1} AS MATERIALIZED (SELECT b.p, b.i, coalesce(m.x, b.x) AS x FROM book{r} b LEFT JOIN moved{r} m USING (p, i)),"""
    return f"""
    WITH e AS (
        SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
        FROM embeddings
        WHERE embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
    v AS MATERIALIZED (SELECT vec_id, p, x[16 * p + 1:16 * p + 16] AS x FROM e, (SELECT unnest(range(4)) AS p)),
    book0 AS (
        SELECT p, i, x FROM v JOIN (
            SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS i FROM e ORDER BY vec_id LIMIT 256) USING (vec_id)),
    {steps}
    last AS ({near.format(book=f"book{rounds}")}),
    coded AS (
        SELECT vec_id, string_agg(printf('%02x', i), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
        FROM last GROUP BY 1),
    sha AS (
        SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, i)) AS codebooks_sha256 FROM book{rounds}),
    labelled AS (SELECT vec_id, code, error, label FROM coded JOIN e USING (vec_id))
    SELECT vec_id, code, error, label, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
           codebooks_sha256 FROM labelled, sha"""


@query("op11_vector_codes", _codes_sql())
def op11(spark, sf_dir):
    return vector_codes.compress(
        table(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4, scale=1024, label="label"
    )


@query(
    "op13_ranked_search",
    r"""
    WITH d AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
    size AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(ws)) AS BIGINT) AS n_words FROM d WHERE len(ws) > 0),
    q AS (
        SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
    tf AS (
        SELECT doc_id, n, term, CAST(count(*) AS BIGINT) AS tf
        FROM (SELECT doc_id, len(ws) AS n, unnest(ws) AS term FROM d) SEMI JOIN q USING (term) GROUP BY ALL),
    w AS (
        SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
        FROM tf, size GROUP BY term),
    s AS (
        SELECT item_id, doc_id,
               CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_words)))) AS BIGINT) AS score
        FROM q JOIN tf USING (term) JOIN w USING (term), size GROUP BY ALL)
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank,
           doc_id, score
    FROM s WHERE score > 0 QUALIFY rank <= 10""",
)
def op13(spark, sf_dir):
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)
