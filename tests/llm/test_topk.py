"""The bit-sliced search against scores computed one by one."""

import math

import numpy as np
import pytest

from fleetvault.llm import topk
from fleetvault.llm.queries import ORACLES, QUERIES
from tests.oracle import difference

SCHEMA = "vec_id long, embedding array<float>, score long"


def brute(rows, k, scale=1024):
    good = []
    for vec_id, vector, _ in rows:
        if vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            good.append((vec_id, [math.floor(scale * float(np.float32(x))) for x in vector]))
    out = []
    for query_id, q in good:
        if query_id is None or query_id % 100:
            continue
        found = [
            (-sum(a * b for a, b in zip(q, v)), math.inf if i is None else i)
            for i, v in good
            if i != query_id and len(v) == len(q)
        ]
        out += [(query_id, r + 1, None if i == math.inf else i, -s) for r, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def rows_of(seed, n, dim=5, values=None):
    rng = np.random.default_rng(seed)
    draw = (lambda: rng.choice(values, dim)) if values is not None else (lambda: rng.normal(size=dim))
    return [(int(i), [float(np.float32(x)) for x in draw()], 0) for i in rng.permutation(n)]


ODD = [
    *rows_of(1, 40),
    (100, None, 1),
    (200, [None, 1.0, 1.0, 1.0, 1.0], 1),
    (300, [math.nan, 1.0, 1.0, 1.0, 1.0], 1),
    (400, [math.inf, 1.0, 1.0, 1.0, 1.0], 1),
    (500, [1.0, 2.0], 1),
    (501, [0.5, -2.0], 1),
    (600, [], 1),
    (700, [0.1] * 5, None),
    (700, [0.1] * 5, None),
    (None, [0.1] * 5, None),
    (None, [9.0] * 5, None),
]


@pytest.mark.parametrize(
    "rows, options",
    [
        (ODD, {}),
        (rows_of(2, 700), {"block_rows": 64}),
        (rows_of(3, 700), {"block_rows": 100, "group_bytes": 400, "drop_bits": 0}),
        (rows_of(4, 400, 3, [0.0, 0.5, -0.5]), {"block_rows": 128, "drop_bits": 5}),
        (rows_of(5, 300, 8, [0.25]), {}),
        ([], {}),
    ],
)
def test_against_brute_force(spark, tmp_path, rows, options):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    df = spark.createDataFrame(rows, SCHEMA).repartition(2)
    found = topk.search(df, df.filter("vec_id % 100 = 0"), k=10, **options)
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows, 10)


LARGE = [
    (100, [200000.0, 1.0, 0.0], 1),
    (200, [1.0, -0.5, 0.0], 1),
    (300, [0.0, 3.0e38, -1.0], 1),
    (400, [2.0**45, -(2.0**45), 2.0**44], 1),
    (7, [200000.0, 1.0, 0.0], 1),
    (8, [0.0, 0.0, 2.0**60], 1),
    (9, [0.0, -3.0e38, 3.0e38], 1),
    (10, [0.0, 3.0e38, 2.0**30], 1),
    (11, [2.0**26, 2.0**30, -(2.0**35)], 1),
]


@pytest.mark.parametrize("options", [{}, {"block_rows": 2}, {"group_bytes": 100}])
def test_large_components(spark, tmp_path, options):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rows = [*LARGE, *((i + 1000, v, n) for i, v, n in rows_of(6, 60, 3))]
    df = spark.createDataFrame(rows, SCHEMA)
    found = topk.search(df, df.filter("vec_id % 100 = 0"), k=5, **options)
    within = lambda s: min(max(s, -(2**63)), 2**63 - 1)
    whole = {}
    for query_id, _, vec_id, score in brute(rows, len(rows)):
        whole.setdefault(query_id, []).append((-within(score), vec_id))
    wanted = [(q, r + 1, i, -s) for q, all_ in whole.items() for r, (s, i) in enumerate(sorted(all_)[:5])]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(wanted, key=str)
    assert 7 in {i for q, _, i, _ in wanted if q == 100}


def test_a_component_too_large_for_the_scale_takes_no_part(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    df = spark.createDataFrame([(100, [1.0]), (1, [1.7e308]), (2, [2.0])], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in topk.search(df, df.filter("vec_id = 100")).collect()] == [2]


def test_slices_add_up():
    rng = np.random.default_rng(0)
    numbers = rng.integers(0, 2, size=(23, 130)).astype(bool)
    weights = rng.integers(0, 5, size=23)
    planes = [[topk._bitmap(numbers[weights == w])] for w in range(5)]
    sums = topk.add_slices([p for p in planes] + [[]])
    total = sum(
        np.unpackbits(s.view(np.uint8), bitorder="little")[:130].astype(int) << p for p, s in enumerate(sums) if s is not None
    )
    assert (total == (numbers * (1 << weights)[:, None]).sum(axis=0)).all()
    alive = topk._bitmap(np.ones(130, bool))
    for k in (1, 7, 130):
        assert topk.kth_sum(sums, alive, k) == np.sort(total)[-k]
    assert topk.count(topk.at_least(sums, alive, 40)) == (total >= 40).sum()


def test_query(spark, sf_dir, con):
    assert difference(QUERIES["op1_topk_search"](spark, sf_dir), con, ORACLES["op1_topk_search"]) is None
