"""The pipeline, stage by stage, against plain Python on each stage's own input."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from fleetvault.llm.queries import QUERIES
from tests.llm import test_decontaminate, test_jaccard_join, test_packing, test_pii


@pytest.fixture(scope="module")
def small(spark, sf_dir, tmp_path_factory):
    """Some documents of every kind, in a folder like those of the given tables."""
    folder = str(tmp_path_factory.mktemp("tables"))
    for name in ("documents", "labels", "benchmark"):
        table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        if name == "documents":
            short = table.filter("length(text) < 3000").orderBy("doc_id").limit(60)
            table = short.union(short.limit(5).withColumn("doc_id", short["doc_id"] + 1_000_000))
        table.coalesce(2).write.parquet(f"{folder}/{name}.parquet")
    return folder


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    before = docs.collect()
    good = {r.doc_id for r in QUERIES["op2_quality"](spark, small).collect() if r.predicted}
    wanted = {
        "quality classifier": lambda rows: [r for r in rows if r.doc_id in good],
        "n-gram Jaccard join": lambda rows: [r for r in rows if r.doc_id in firsts(rows)],
        "benchmark decontamination": lambda rows: [r for r in rows if r.doc_id not in hit(spark, small, rows)],
    }
    for name, stage in corpus_pipeline.STAGES[:4]:
        after = stage(spark, spark.createDataFrame(before, docs.schema), small)
        assert after.columns == docs.columns
        rows = after.collect()
        if name in wanted:
            assert sorted(rows) == sorted(wanted[name](before))
        else:
            redacted(before, rows)
        assert 0 < len(rows) <= len(before)
        before = rows
    pieces = corpus_pipeline.run(spark, small).collect()
    test_packing.checked(pieces, [(r.doc_id, r.text) for r in before])


def firsts(rows):
    pairs = [(r.doc_id, r.text) for r in rows]
    return {i for i, _, part in test_jaccard_join.brute(pairs, 5, 80) if i == part}


def hit(spark, sf_dir, rows):
    tests = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    return {i for i, _, n, _ in test_decontaminate.brute([(r.doc_id, r.text) for r in rows], tests, 10) if n}


def redacted(before, rows):
    after = {r.doc_id: r for r in rows}
    assert set(after) == {r.doc_id for r in before}
    for r in before:
        own = after[r.doc_id]
        assert not [s for s in test_pii.brute(own.text) if s]
        if not test_pii.brute(r.text):
            assert own.text == r.text
        assert own.n_chars == len(own.text) and (own.lang, own.source) == (r.lang, r.source)


def test_near_copies_share_five_word_shingles(spark, sf_dir):
    """One changed word in 55: 46 of 56 five-word shingles are shared (0.82), 50 of 56 of three (0.89)."""
    words = [f"w{i}" for i in range(55)]
    edited = [*words[:27], "other", *words[28:]]
    far = [*words[:18], "this", *words[19:36], "that", *words[37:]]
    rows = [(1, " ".join(words)), (2, " ".join(edited)), (3, " ".join(far))]
    kept = corpus_pipeline.without_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf_dir)
    ids = {r.doc_id for r in kept.collect()}
    assert ids == {i for i, _, part in test_jaccard_join.brute(rows, 5, 80) if i == part} == {1, 3}


def test_held_out_by_id():
    assert np.mean([zlib.crc32(str(i).encode()) % 3 == 1 for i in range(3000)]) < 0.4


def test_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).collect() == []


def test_odd_rows(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, key string, score double, spans string, class string"
    rows = [
        (None, None, None, None, None, None, None, None, None, None),
        (1, "", "en", "s", 0, "r", "k", 1.0, "s", "c"),
        (2, "Plain words are here, and more of them follow.", None, "s", 3, "r", "k", None, "s", "c"),
        (2, "Plain words are here, and more of them follow.", None, "s", 3, "r", "k", None, "s", "c"),
        (3, "Word and word. " * 30_000, "en", None, None, None, None, 0.5, None, None),
    ]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.count() <= len(rows)
    assert corpus_pipeline.STAGES[4][1](spark, docs, sf_dir).count() >= 3
