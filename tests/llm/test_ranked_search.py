"""Ranked search against scoring every document, and what blocks may leave out."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from fleetvault.llm import ranked_search
from fleetvault.llm.ranked_search import Best, Items, Plan, Shard, search_shard

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k=10):
    counted = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n_docs, n_words = sum(n > 0 for *_, n in counted), sum(n for *_, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c, n in counted:
            score = 0
            for t in set(terms(text)) & set(c):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                m = 10 + (90 * n * n_docs) // n_words
                score += w * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        found.sort()
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(found[:k], 1)]
    return sorted(out, key=repr)


def corpus(rng, count):
    common, rare = ["the", "of", "And", "stone", "Straße"], [f"w{i}" for i in range(150)]
    docs = []
    for i in range(count):
        topic = rng.sample(rare, 12)
        size = rng.choice([1, 3, 20, 60])
        words = [rng.choice(topic) if rng.random() < 0.4 else rng.choice(common) for _ in range(size)]
        docs.append((i, rng.choice([" ", ", ", "-", "\n"]).join(words)))
    docs += [(count + i, docs[3][1]) for i in range(40)]  # copies: ties by id
    docs += [docs[5], docs[5], (None, docs[3][1]), (9000, None), (9001, ""), (9002, "--- ["), (9003, "the W1 " * 4000)]
    items = [(j, " ".join(rng.sample(rare, 6) + rng.choices(common, k=4))) for j in range(25)]
    items += [(25, docs[3][1]), (26, None), (27, "..."), (28, "unseen words"), (29, "the the THE of"), (3, items[3][1])]
    return docs, items


def found(spark, docs, items, **how):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame(items, "item_id int, text string")
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in ranked_search.search(d, q, **how).collect()), key=repr)


@pytest.mark.parametrize("how", [{}, {"block_docs": 4, "shard_docs": 50}, {"block_docs": 1, "group_bytes": 300, "k": 3}])
def test_against_every_document(spark, how):
    docs, items = corpus(random.Random(1), 400)
    random.Random(2).shuffle(docs)
    assert found(spark, docs, items, **how) == plain(docs, items, how.get("k", 10))


def test_empty_tables_and_other_columns(spark):
    docs, items = [(1, "a b"), (2, "b")], [(7, "b")]
    assert found(spark, [], items) == [] and found(spark, docs, []) == [] and found(spark, [(1, None)], items) == []
    d = spark.createDataFrame([(1, "a b", 3, "x")], "doc_id int, text string, score int, item_id string")
    q = spark.createDataFrame([("i", "b", 9)], "item_id string, text string, rank int")
    (got,) = ranked_search.search(d, q).collect()
    assert (got.item_id, got["rank"], got.doc_id) == ("i", 1, 1)


def shard_of(docs, items, block_docs):
    group = Items([i for i, _ in items], pa.array([t for _, t in items]))
    lengths, text_of, own, counts = ranked_search._entries(pa.array([t for _, t in docs]), group.vocabulary)
    sizes = np.bincount(text_of, minlength=len(docs))
    row = {
        "ids": np.array([i for i, _ in docs]), "known": np.ones(len(docs), bool), "lengths": lengths,
        "first": np.concatenate([[0], np.cumsum(sizes)]), "terms": own.astype(np.int32), "counts": counts,
    }
    df = np.bincount(own, minlength=len(group.vocabulary))
    plan = Plan(group, int((lengths > 0).sum()), int(lengths.sum()), df, 10, block_docs)
    return Shard({n: a.tobytes() for n, a in row.items()}, plan), plan


def test_blocks_cover_a_list_and_summaries_bound_it():
    rng = random.Random(3)
    docs, items = corpus(rng, 300)
    docs = [(i, t) for i, t in docs if i is not None and t]
    shard, plan = shard_of(docs, items, 8)
    for term, begin, end in zip(shard.present.tolist(), shard.begins.tolist(), shard.ends.tolist()):
        listed = shard.doc_of[shard.by_term[begin:end]]
        blocks = shard.clustered(listed)
        assert sorted(np.concatenate(blocks)) == sorted(listed) and all(len(b) <= 8 for b in blocks)
        later = plan.later(term)
        most = shard.summaries(blocks, later)
        for block, summary in zip(blocks, most):
            for t, value in zip(later, summary):
                entries, _ = shard.entries_of(block)
                assert value == max((shard.impacts[e] for e in entries if shard.terms[e] == t), default=0)


def test_blocks_are_skipped():
    """Half of the documents with x lack y: similar documents share blocks, and theirs are left out."""
    rng = random.Random(4)
    topics = [[f"t{n}w{i}" for i in range(20)] for n in range(40)]
    docs = []
    for i in range(4000):
        n = i % 40
        words = rng.choices(topics[n], k=30) + ["x"] * (n < 20) + ["y"] * (10 <= n < 30)
        docs.append((i, " ".join(rng.sample(words, len(words)))))
    items = [(0, "x y"), *((n + 1, " ".join(topics[n])) for n in range(40))]
    shard, plan = shard_of(docs, items, 16)
    best, scored = [Best(10) for _ in plan.ids], []
    search_shard(shard, best, scored)
    got = [(i, r, int(d), int(s)) for i, b in zip(plan.ids, best) for r, (d, s) in enumerate(zip(b.ids, b.scores), 1)]
    assert sorted(got, key=repr) == plain(docs, items)
    # Items have 2 + 40 * 20 lists in all; most are left out by the summary of the shard.
    assert len(scored) < 400
    assert [done < 100 for blocks, done in scored if blocks > 100] == [True]
