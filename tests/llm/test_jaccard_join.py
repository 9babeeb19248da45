"""Components against every pair compared, on texts made to chain, repeat and share."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from fleetvault.llm import jaccard_join as join
from fleetvault.llm.queries import ORACLES, QUERIES
from tests.oracle import difference


def shingles(text, width):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    if 0 < len(words) < width:
        return {tuple(words)}
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(rows, width, percent):
    own = [shingles(t, width) for _, t, *_ in rows]
    part = list(range(len(rows)))

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(own[i] & own[j])
            linked = both and 100 * both >= percent * (len(own[i]) + len(own[j]) - both)
            if linked and rows[i][0] is not None and rows[j][0] is not None:
                part[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return sorted(
        ((r[0], len(s), least.get(root(i)) if r[0] is not None else None) for i, (r, s) in enumerate(zip(rows, own))), key=str
    )


def corpus(seed, n=150):
    """Bases, copies with edits of different size, chains of edits, and a passage shared by many."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    shared = rng.choices(words, k=30)
    texts = []
    while len(texts) < n:
        base = rng.choices(words, k=rng.randint(1, 120))
        if rng.random() < 0.5:
            base += shared
        texts.append(base)
        for _ in range(rng.randint(0, 6)):
            base = list(base)
            for _ in range(rng.randint(0, 2)):
                base[rng.randrange(len(base))] = rng.choice(words)
            if rng.random() < 0.3:
                base.append(rng.choice(words))
            texts.append(base)
    return [(i * 7 % 10_007, " ".join(t) if rng.random() < 0.7 else " ".join(t).upper()) for i, t in enumerate(texts)]


SCHEMA = "doc_id long, text string"


def check(spark, rows, schema=SCHEMA, **options):
    found = join.components(spark.createDataFrame(rows, schema).repartition(3), **options).collect()
    want = brute(rows, options.get("width", 3), options.get("percent", 90))
    assert sorted(map(tuple, found), key=str) == want


@pytest.mark.parametrize("options", [{}, {"width": 2, "percent": 70}, {"percent": 100, "sketch_bits": 6}])
def test_against_every_pair(spark, options):
    check(spark, corpus(len(options)), **options)


def test_long_texts_that_share_passages(spark):
    """600 to 3,000 words, most of them sharing long passages, some of them near copies: five words, 80 %."""
    rng = random.Random(9)
    passages = [[f"p{k}x{i}" for i in range(rng.choice([80, 200]))] for k in range(4)]
    texts = []
    for n in range(40):
        words = [f"d{n}x{rng.randrange(5000)}" for _ in range(rng.randint(500, 2600))]
        for passage in rng.sample(passages, rng.randint(1, 3)):
            at = rng.randrange(len(words))
            words[at:at] = passage
        texts.append(words)
        for _ in range(rng.choice([0, 0, 1, 2])):
            words = list(words)
            for _ in range(rng.choice([2, len(words) // 60, len(words) // 40])):
                words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
            texts.append(words)
    rows = [(i * 13 % 997, " ".join(t)) for i, t in enumerate(texts)]
    check(spark, rows, width=5, percent=80)


def test_equal_lists_are_kept_once(spark):
    """Two texts share 200 prefix shingles; what was looked up before pairs are made shrinks to one list."""
    words = [f"w{i}" for i in range(600)]
    rows = [(1, " ".join([*words, *(f"a{i}" for i in range(300))])), (2, " ".join([*words, *(f"b{i}" for i in range(300))]))]
    check(spark, rows, width=5, percent=50)
    check(spark, [*rows, (3, " ".join(words[:300]))], width=5, percent=30)


def test_keep_first_tells_texts_of_one_id_apart(spark):
    rows = [(1, "a b c d e f"), (1, "u v w x y z"), (2, "u v w x y z"), (1, "A b c d  e f"), (3, None), (3, ""), (3, "")]
    kept = sorted(map(tuple, join.keep_first(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert [r[0] for r in kept] == [1, 1, 3, 3]
    assert {(r[1] or "").lower().split()[0] for r in kept if r[0] == 1} == {"a", "u"}
    assert sorted(str(r[1]) for r in kept if r[0] == 3) == ["", "None"]


def test_odd_rows(spark):
    rows = [(1, None, "c"), (2, "", "c"), (3, " \t\n", None), (4, "one", "x"), (5, "ONE", "x"), (6, "one two", "x")]
    rows += [(None, "one", "n"), (None, None, "n"), (7, "one two one", "x"), (9, "a b c " * 3000, "y"), (8, "a b c " * 2000, "y")]
    rows += [(10, "a b c d e", None), (10, "a b c d e", None), (11, "é\xa0x É", None), (12, "é\xa0x É", None), (13, "É\xa0x É", None)]
    check(spark, rows, "doc_id long, text string, class string")


def test_empty_table(spark):
    assert join.components(spark.createDataFrame([], SCHEMA)).collect() == []


def test_keep_first(spark):
    rows = [(3, "a b c d", "x"), (1, "a b c d", "y"), (1, "a b c d", "y"), (2, "e f g h", None), (None, "a b c d", "z")]
    kept = join.keep_first(spark.createDataFrame(rows, "doc_id long, text string, class string"))
    assert sorted(map(tuple, kept.collect()), key=str) == [(1, "a b c d", "y"), (2, "e f g h", None), (None, "a b c d", "z")]


def test_prefixes_are_rare_when_every_slot_is_full(spark):
    """Shingles of rare words come first, though chance fills each slot of the shingles with some 35."""
    rng = random.Random(3)
    rows = []
    for i in range(150):
        words = rng.choices([f"w{k}" for k in range(12)], k=60)
        words[5::20] = [f"rare{i}x{k}" for k in range(3)]
        rows.append((i, i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, key long, text string").repartition(2)
    levels = spark.sparkContext.broadcast(join.sketch(docs, 3, 8))
    prefixes = [set(r.prefix) for r in join.describe(docs, 3, 90, levels).collect()]
    found = [t for p in prefixes for t in p]
    assert sum(found.count(t) > 1 for t in found) < 0.1 * len(found)


def test_signatures_bound_the_difference():
    rng = np.random.default_rng(2)
    for _ in range(50):
        n = int(rng.integers(1, 300))
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < 0.9], rng.integers(0, 2**63, n // 9 + 1).astype(np.uint64)]))
        first = np.cumsum([0, len(x), len(y)])
        a, b = join._signatures(np.concatenate([x, y]), first).to_pylist()
        a, b = ([v & (2**64 - 1) for v in s] for s in (a, b))
        while len(a) != len(b):
            long = a if len(a) > len(b) else b
            half = len(long) // 2
            long[:] = [u ^ v for u, v in zip(long[:half], long[half:])]
        differ = sum((u ^ v).bit_count() for u, v in zip(a, b))
        assert differ <= len(np.setxor1d(x, y))


def test_sets_of_short_texts():
    value, first = join.sets(pa.array(["a b", "A B", None, "a b c d", ""]), 3)
    assert list(np.diff(first)) == [1, 1, 0, 2, 0] and value[0] == value[1]


def test_query(spark, sf_dir, con):
    assert difference(QUERIES["op9_jaccard_join"](spark, sf_dir), con, ORACLES["op9_jaccard_join"]) is None
