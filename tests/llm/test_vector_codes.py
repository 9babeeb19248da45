"""Vector codes against Lloyd rounds in plain Python, node by node and table by table."""

import hashlib
import math
import random

import numpy as np
import pytest

from fleetvault.llm import vector_codes
from fleetvault.llm.vector_codes import Block, Tree, assign, descend, edges


def plain(rows, parts=4, entries=256, rounds=4, scale=1024):
    """Every part against every entry; rows are (vec_id, vector, label)."""
    good = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    whole = lambda x: int(x) * scale if math.isinf(x * scale) else math.floor(x * scale)
    out = []
    for dim in {len(v) for _, v, _ in good}:
        own = [(i, [whole(x) for x in v], label) for i, v, label in good if len(v) == dim]
        own.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        cuts = edges(dim, parts)
        books, codes, errors = [], [[] for _ in own], [0] * len(own)
        for p in range(parts):
            points = [v[cuts[p] : cuts[p + 1]] for _, v, _ in own]
            book = points[:entries]

            def nearest(x, book):
                return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))

            for _ in range(rounds):
                groups = {}
                for x in points:
                    groups.setdefault(nearest(x, book)[1], []).append(x)
                book = [[sum(c) // len(groups[i]) for c in zip(*groups[i])] if i in groups else e for i, e in enumerate(book)]
            for r, x in enumerate(points):
                d, i = nearest(x, book)
                codes[r].append(f"{i:02x}")
                errors[r] += d
            books += [str(c) for e in book for c in e]
        sha = hashlib.sha256(",".join(books).encode()).hexdigest()
        out += [(i, "".join(c), e, label, sha) for (i, _, label), c, e in zip(own, codes, errors)]
    sums = {}
    for _, _, e, label, _ in out:
        sums[label] = sums.get(label, 0) + e
    big = [label for label in sums if any(r[2] >= 2**63 for r in out if r[3] == label) or sums[label] >= 2**63]
    return sorted(
        ((i, c, e if e < 2**63 else None, label, None if label in big else sums[label], s) for i, c, e, label, s in out), key=repr
    )


def run(spark, rows, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = vector_codes.compress(df, label="label", **how)
    return sorted(((r.vec_id, r.code, r.error, r.label, r.label_error, r.codebooks_sha256) for r in got.collect()), key=repr)


def cloud(rng, count, dim, spread=1.0):
    centres = [[rng.gauss(0, spread) for _ in range(dim)] for _ in range(7)]
    return [[x + rng.gauss(0, spread / 5) for x in rng.choice(centres)] for _ in range(count)]


def test_against_plain_python(spark):
    rng = random.Random(1)
    rows = [(i * 3, v, rng.choice([None, 1, 2])) for i, v in enumerate(cloud(rng, 300, 8))]
    rows += [(1000 + i, rows[5][1], 1) for i in range(60)] + [rows[7], rows[7]]
    rows += [(2000, None, 1), (2001, [1.0, None] + [0.0] * 6, 1), (2002, [float("nan")] * 8, 1), (-1, [float("inf")] * 8, 2)]
    rows += [(None, rows[9][1], 2), (5000, [], 1), (5001, [0.5], None), (5002, [0.25, -0.25, 3.0, 1.0, 2.0], 1), (5003, [0.0] * 5, 1)]
    rng.shuffle(rows)
    assert run(spark, rows, entries=20, block_rows=64, leaf=8) == plain(rows, entries=20)


def test_ties_go_to_the_lower_index(spark):
    rows = [(i, [float(i % 2) / 1024] * 4, 0) for i in range(40)]
    got = run(spark, rows, entries=4, leaf=4)
    assert got == plain(rows, entries=4)
    assert {r[1] for r in got} == {"00000000", "01010101"}


@pytest.mark.parametrize("size", [3e5, 1e12, 1e25, 1e308])
def test_large_components(spark, size):
    rng = random.Random(2)
    rows = [(i, v, i % 3) for i, v in enumerate(cloud(rng, 60, 4))]
    rows += [(100 + i, [x * size for x in v], 3) for i, v in enumerate(cloud(rng, 20, 4))] + [(-1, [size, 1.0, -size, 0.0], 4)]
    assert run(spark, rows, entries=9, block_rows=32, leaf=4) == plain(rows, entries=9)


def test_empty_table_and_other_columns(spark):
    assert run(spark, []) == []
    df = spark.createDataFrame([(1, [1.0, 2.0], "x", 5)], "vec_id long, embedding array<float>, code string, error int")
    (got,) = vector_codes.compress(df).collect()
    assert (got.vec_id, got.code, got.error) == (1, "00000000", 0)
    assert got.codebooks_sha256 == hashlib.sha256(b"1024,2048").hexdigest()


def test_whole_nodes_and_leaves_cover_every_row_once():
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.integers(-900, 900, (700, 5)), np.repeat(rng.integers(-900, 900, (1, 5)), 300, axis=0)])
    entries = rng.integers(-900, 900, (77, 5))
    data = Tree.grown(points, 16).summed(points)
    whole, leaves = descend(data.stacked(), Tree.grown(entries, 1).summed(entries).stacked())
    seen = np.zeros(len(points), int)
    for level, nodes, _ in whole:
        for node in nodes:
            seen[data.order[data.cuts(level)[node] : data.cuts(level)[node + 1]]] += 1
    for level, node, _ in leaves:
        seen[data.order[data.cuts(level)[node] : data.cuts(level)[node + 1]]] += 1
    assert (seen == 1).all() and whole
    sums, counts, owner = assign(points, data, entries)
    distances = ((points[:, None] - entries) ** 2).sum(axis=2)
    assert (owner == distances.argmin(axis=1)).all()
    assert (counts == np.bincount(owner, minlength=77)).all()
    assert all((sums[e] == points[owner == e].sum(axis=0)).all() for e in range(77))


def test_bounds_spare_most_distances_where_rows_cluster():
    """Far clusters: most rows are assigned without a distance of their own."""
    rng = np.random.default_rng(4)
    centres = rng.integers(-(10**6), 10**6, (64, 4))
    points = np.repeat(centres, 64, axis=0) + rng.integers(-3, 4, (4096, 4))
    data = Tree.grown(points, 16).summed(points)
    whole, leaves = descend(data.stacked(), Tree.grown(centres, 1).summed(centres).stacked())
    sizes = [n for level, nodes, _ in whole for n in np.diff(data.cuts(level))[nodes]]
    assert sum(sizes) > 0.9 * len(points)


def test_block_round_trip():
    numbers = np.array([[2**70, -1, 3], [0, 5, -(2**65)]], dtype=object)
    block = Block(Block.made(numbers, 2, 1), 2)
    assert (block.numbers == numbers).all() and block.trees[0].sums.dtype == object
