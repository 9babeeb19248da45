"""Suffix arrays and searches against plain comparison of every window."""

import random
import re

import numpy as np
import pytest

from fleetvault.llm import decontaminate
from fleetvault.llm.queries import ORACLES, QUERIES
from tests.oracle import difference


def words_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, tests, window):
    out = []
    for doc_id, text, *_ in docs:
        words, hit, items = words_of(text), set(), set()
        for item_id, test, *_ in tests:
            item = words_of(test)
            width = min(window, len(item))
            wanted = {tuple(item[p : p + width]) for p in range(len(item) - width + 1)} if width else set()
            for p in range(len(words) - width + 1) if wanted else ():
                if tuple(words[p : p + width]) in wanted:
                    hit.update(range(p, p + width))
                    items.add(item_id)
        out.append((doc_id, len(words), len(hit), sorted(i for i in items if i is not None)))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "é", "x1", "w", "Q", "z"]
    tests = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 25)))) for i in range(25)]
    docs = []
    for i in range(120):
        parts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 40)))]
        if rng.random() < 0.5:
            parts.append(rng.choice(tests)[1].upper())
        docs.append((i, "-, ".join(parts)))
    return docs, tests


@pytest.mark.parametrize(
    "seed, options", [(1, {}), (2, {"window": 4, "shard_bytes": 200}), (3, {"window": 3, "block_bytes": 150}), (4, {"window": 1})]
)
def test_against_brute_force(spark, tmp_path, seed, options):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    docs, tests = corpus(seed)
    found = decontaminate.find(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(2),
        spark.createDataFrame(tests, "item_id long, text string"),
        **options,
    ).collect()
    got = [(r.row.doc_id, r.n_words, r.n_hit, sorted(set(r["items"]))) for r in found]
    assert sorted(got, key=str) == brute(docs, tests, options.get("window", 10))
    own = {i: words_of(t) for i, t in docs}
    items = {i: words_of(t) for i, t in tests}
    for r in found:
        assert sum(s.end - s.start for s in r.spans) == r.n_hit
        for m in r.matches:
            at, of = own[r.row.doc_id][m.start :], items[m.item_id][m.item_start :]
            assert at[: m.length] == of[: m.length]
            assert at[m.length : m.length + 1] != of[m.length : m.length + 1] or len(at) == m.length


def test_longest_match_is_found(spark):
    text = " ".join(f"t{i}" for i in range(40))
    docs = spark.createDataFrame([(1, f"x y {text} z"), (2, "t5 t6 t7")], "doc_id long, text string")
    tests = spark.createDataFrame([(7, f"before {text}")], "item_id long, text string")
    rows = {r.row.doc_id: r for r in decontaminate.find(docs, tests).collect()}
    assert [tuple(m) for m in rows[1].matches] == [(2, 40, 7, 1)] and rows[2].matches == []


def test_odd_rows(spark):
    docs = [(1, None, 1, "r"), (2, "", 1, "r"), (3, "One  two-THREE", 1, "r"), (3, "One  two-THREE", 1, "r"), (None, "four", 2, None)]
    docs += [(5, "one two three " * 20_000, 0, "r"), (6, "é\x00é", 0, None)]
    tests = [(1, None), (2, ""), (3, "one two three"), (3, "FOUR"), (None, "four"), (4, "..."), (5, "É")]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_hit long, row string")
    items = spark.createDataFrame(tests, "item_id long, text string")
    found = decontaminate.find(df, items).collect()
    got = [(r.row.doc_id, r.n_words, r.n_hit, sorted(set(r["items"]))) for r in found]
    assert sorted(got, key=str) == brute(docs, tests, 10)
    kept = decontaminate.clean(df, items)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {1, 2, 6}
    none = items.limit(0)
    assert decontaminate.clean(df, none).count() == len(docs)
    assert decontaminate.find(df.limit(0), items).collect() == []


def test_suffix_order():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 3, 300).astype(np.uint64)
    first = np.array([0, 100, 100, 101, 300])
    ends = decontaminate.ends_of(first)
    order = decontaminate.suffix_array(words, ends, 300)
    assert sorted(range(300), key=lambda i: words[i : ends[i]].tolist()) == order.tolist() or all(
        words[a : ends[a]].tolist() <= words[b : ends[b]].tolist() for a, b in zip(order, order[1:])
    )


def test_query(spark, sf_dir, con):
    name = "op7_benchmark_decontamination"
    assert difference(QUERIES[name](spark, sf_dir), con, ORACLES[name]) is None
