"""Exact top-k search on a bit-sliced index.

``build`` turns vectors into blocks. In a block every component is an integer, floor(scale * x),
less its smallest value in the block. The index holds one bitmap per component and bit, without
the ``drop_bits`` lowest bits; these quantised slices are what a query adds up.

``search`` scores a block for one query with bitmap arithmetic: the bitmap of bit b of a component
counts once for each set bit j of the query's weight, in result slice b + j. A negative weight
takes the complement. Slices are added with carry-save adders, many bitmaps at a time. Then,
from the most significant result slice downward, the k-th largest sum is found. Sums fall short of
scores by a known margin at most, so all rows within it of the k-th sum are boundary rows; their
scores are computed exactly from the integers.

Queries are sent to the tasks in groups of ``group_bytes``, each task answers with k rows per query,
and a ranking per query merges them. Vectors never move.

Components may be of any size. Where a score might leave the 64-bit range, a block's rows are scored
one by one with whole numbers of any length; a score beyond the range counts as the nearest long. Rows
with a component of ``MOST`` or more lie in blocks of their own, which are always scored so.

Nulls and edge cases: a vector that is null, or holds a null or a component that is not finite, or
not finite once multiplied by the scale, takes no part. Vectors are compared with those of their own length only. A null
vec_id asks nothing and is found last among ties. A query row asks once for each time it occurs,
and never finds rows of its own vec_id. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetvault.llm.state import checkpointed

BLOCK_ROWS = 8192
MOST = 1 << 62
LONG = 1 << 63
LAST_ID = np.iinfo(np.int64).max
INDEX = "dim int, rows int, ids binary, numbers binary, least binary, bits int, slices binary"
FOUND = "query long, vec_id long, score long"


def integers(vectors: pa.Array, ids: pa.Array, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row ids and integer matrices of the vectors that take part, by their length.

    A matrix is of int64, or of Python's integers for vectors with a component of ``MOST`` or more.
    """
    vectors = vectors.cast(pa.list_(pa.float64()))
    sizes = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    flat = vectors.flatten()
    values = flat.fill_null(np.nan).to_numpy(zero_copy_only=False)
    begins = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
    names = ids.fill_null(LAST_ID).to_numpy(zero_copy_only=False).astype(np.int64)
    for dim in np.unique(sizes[sizes >= 0]).tolist():
        rows = np.flatnonzero(sizes == dim)
        matrix = values[begins[rows][:, None] + np.arange(dim)] if dim else np.zeros((len(rows), 0))
        with np.errstate(over="ignore", invalid="ignore"):
            matrix = np.floor(matrix * scale)
        good = (np.abs(matrix) < MOST).all(axis=1)
        yield names[rows[good]], matrix[good].astype(np.int64)
        large = np.isfinite(matrix).all(axis=1) & ~good
        if large.any():
            yield names[rows[large]], np.array([[int(x) for x in row] for row in matrix[large]], object)


def _bitmap(flags: np.ndarray) -> np.ndarray:
    """Flags along the last axis as 64-bit words."""
    padded = np.zeros((*flags.shape[:-1], -(-flags.shape[-1] // 64) * 64), bool)
    padded[..., : flags.shape[-1]] = flags
    return np.packbits(padded, axis=-1, bitorder="little").view(np.uint64)


def _block(ids: np.ndarray, numbers: np.ndarray, drop_bits: int) -> tuple:
    if numbers.dtype == object:  # floors of doubles, and so doubles; there are no slices
        exact = numbers.astype(np.float64).tobytes()
        return (numbers.shape[1], len(ids), ids.tobytes(), exact, b"", 0, b"")
    least = numbers.min(axis=0, initial=MOST)
    above = (numbers - least).T >> drop_bits
    bits = max(int(above.max(initial=0)).bit_length(), 1)
    slices = np.stack([_bitmap((above >> b) & 1 == 1) for b in range(bits)], axis=1)
    return (numbers.shape[1], len(ids), *(x.tobytes() for x in (ids, numbers, least)), bits, slices.tobytes())


def build(vectors: DataFrame, scale: int = 1024, drop_bits: int = 2, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The index of ``vectors`` (vec_id, embedding): every row that takes part, in blocks."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[tuple, list] = {}
        for batch in batches:
            for ids, numbers in integers(batch["embedding"], batch["vec_id"], scale):
                held = waiting.setdefault((numbers.shape[1], numbers.dtype), [])
                held.append((ids, numbers))
                if sum(len(i) for i, _ in held) >= block_rows:
                    yield from cut(held, last=False)
        for held in waiting.values():
            if held:
                yield from cut(held, last=True)

    def cut(held: list, last: bool) -> Iterator[pa.RecordBatch]:
        ids, numbers = np.concatenate([i for i, _ in held]), np.concatenate([n for _, n in held])
        end = len(ids) if last else len(ids) // block_rows * block_rows
        for at in range(0, end, block_rows):
            stop = min(at + block_rows, end)
            row = _block(ids[at:stop], numbers[at:stop], drop_bits)
            kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]
            names = [c.split()[0] for c in INDEX.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)
        held[:] = [(ids[end:], numbers[end:])] if end < len(ids) else []

    columns = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return columns.mapInArrow(blocks, INDEX)


def add_slices(planes: list[list[np.ndarray]]) -> list[np.ndarray]:
    """The sum of weighted bitmaps as slices: planes[p] holds bitmaps that count 2**p each."""
    total, p = [], 0
    while p < len(planes):
        here = np.concatenate(planes[p]) if planes[p] else np.zeros((0, 0), np.uint64)
        if p + 1 == len(planes) and len(here) > 1:
            planes.append([])
        while len(here) > 1:
            third = max(len(here) // 3, 1)
            a, b = here[:third], here[third : 2 * third]
            c = here[2 * third : 3 * third] if len(here) > 2 else np.uint64(0)
            odd = a ^ b
            planes[p + 1].append((a & b) | (odd & c))
            here = np.concatenate([odd ^ c, here[3 * third :]])
        total.append(here[0] if len(here) else None)
        p += 1
    return total


def count(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


def kth_sum(slices: list[np.ndarray], alive: np.ndarray, k: int) -> int:
    """The k-th largest sum among rows that are alive, from the most significant slice downward."""
    sure, level, value = 0, alive, 0
    for p in range(len(slices) - 1, -1, -1):
        value <<= 1
        if slices[p] is None:
            continue
        with_bit = level & slices[p]
        found = count(with_bit)
        if sure + found >= k:
            level, value = with_bit, value + 1
        else:
            sure, level = sure + found, level & ~slices[p]
    return value


def at_least(slices: list[np.ndarray], alive: np.ndarray, bound: int) -> np.ndarray:
    """Rows that are alive and whose sum is ``bound`` or more."""
    if bound <= 0:
        return alive
    if bound >> len(slices):
        return np.zeros_like(alive)
    above, level = np.zeros_like(alive), alive
    for p in range(len(slices) - 1, -1, -1):
        own = slices[p] if slices[p] is not None else np.zeros_like(alive)
        if bound >> p & 1:
            level = level & own
        else:
            above, level = above | (level & own), level & ~own
    return above | level


class Block:
    """A block of the index, and what a query does with it."""

    def __init__(self, row: dict, drop_bits: int):
        self.drop = drop_bits
        rows, dim, bits = row["rows"], row["dim"], row["bits"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        if not bits:
            floors = np.frombuffer(row["numbers"], np.float64).reshape(rows, dim)
            self.numbers = np.array([[int(x) for x in floor] for floor in floors], object)
            self.largest = LONG
            return
        self.numbers = np.frombuffer(row["numbers"], np.int64).reshape(rows, dim)
        self.largest = int(np.abs(self.numbers).max(initial=0))
        self.slices = np.frombuffer(row["slices"], np.uint64).reshape(dim, bits, -(-rows // 64))
        self.flipped = ~self.slices
        self.all = _bitmap(np.ones(rows, bool))

    def within(self, weights: np.ndarray) -> bool:
        """Whether no score, nor a part of it, can leave the 64-bit range."""
        total = float(np.abs(weights.astype(np.float64)).sum())
        return max(self.largest, 1) * total < LONG / 2

    def one_by_one(self, own_id: int, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of all rows; scores beyond the range of a long are its nearest."""
        other = self.ids != own_id
        exact = self.numbers[other].astype(object) @ weights.astype(object)
        return self.ids[other], np.array([min(max(int(x), -LONG), LONG - 1) for x in exact], np.int64)

    def top(self, own_id: int, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of rows that may be among the k best; all the k best are in it."""
        if not self.within(weights):
            return self.one_by_one(own_id, weights)
        alive = self.all & ~_bitmap(self.ids == own_id)
        k = min(k, count(alive))
        if not k:
            return self.ids[:0], self.ids[:0]
        size, bits = np.abs(weights), self.slices.shape[1]
        source = np.where((weights < 0)[:, None, None], self.flipped, self.slices) if len(weights) else self.slices
        planes: list[list[np.ndarray]] = [[] for _ in range(bits + int(size.max(initial=0)).bit_length() + 1)]
        for j in range(int(size.max(initial=0)).bit_length()):
            chosen = source[(size >> j) & 1 == 1]
            for b in range(bits):
                planes[b + j].append(chosen[:, b])
        sums = add_slices(planes)
        # A dropped part is below 2**drop, so sums are short by less than this, in sums' units.
        margin = int(size.sum())
        near = at_least(sums, alive, kth_sum(sums, alive, k) - margin)
        rows = np.flatnonzero(np.unpackbits(near.view(np.uint8), bitorder="little"))
        return self.ids[rows], self.numbers[rows] @ weights


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, ~scores))[:k]  # ~ turns the order round and holds for every long


def _answers(group, k: int, drop_bits: int):
    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = group.value
        held: dict[int, tuple] = {}
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row, drop_bits)
                for number, own_id, weights in queries.get(row["dim"], ()):
                    ids, scores = block.top(own_id, weights, k)
                    if number in held:
                        ids, scores = np.concatenate([held[number][0], ids]), np.concatenate([held[number][1], scores])
                    order = best(ids, scores, k)
                    held[number] = ids[order], scores[order]
        for number, (ids, scores) in held.items():
            names = pa.array([None if i == LAST_ID else i for i in ids.tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), number)), names, pa.array(scores)], ["query", "vec_id", "score"]
            )

    return answer


def search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    scale: int = 1024,
    drop_bits: int = 2,
    block_rows: int = BLOCK_ROWS,
    group_bytes: int = 8 << 20,
) -> DataFrame:
    """The k best rows of ``vectors`` for each row of ``queries`` (both vec_id, embedding)."""
    spark = vectors.sparkSession
    index = build(vectors, scale, drop_bits, block_rows)
    asked = queries.filter("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    # A group is bounded: rows are dealt by a hash, and as many groups are made as their size asks for.
    size = asked.agg(F.sum(F.coalesce(F.size("embedding"), F.lit(0)) * 8 + 64)).first()[0] or 0
    groups, result, number = size // group_bytes + 1, None, 0
    if groups > 1:
        index = checkpointed(index)
    for at in range(groups):
        own = asked.filter(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(groups)) == at).toArrow()
        by_dim: dict[int, list] = {}
        names: list[tuple] = []
        if own.num_rows:
            for ids, matrix in integers(own["embedding"].combine_chunks(), own["vec_id"].combine_chunks(), scale):
                for own_id, weights in zip(ids.tolist(), matrix):
                    by_dim.setdefault(len(weights), []).append((number, own_id, weights))
                    names.append((number, own_id))
                    number += 1
        found = index.mapInArrow(_answers(spark.sparkContext.broadcast(by_dim), k, drop_bits), FOUND)
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
        ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        # The ids of a group's queries are as bounded as the group.
        known = F.broadcast(spark.createDataFrame(names, "query long, query_id long"))
        named = ranked.join(known, "query").select("query_id", "rank", "vec_id", "score")
        result = named if result is None else result.unionByName(named)
    return result
