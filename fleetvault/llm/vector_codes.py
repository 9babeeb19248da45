"""Vector code compression: product codes learned by dual-tree Lloyd rounds, in whole numbers.

``build`` turns vectors into blocks of integers, floor(scale * x), and grows one balanced tree per
block and part: rows are halved along the widest axis, and every leaf keeps its box and the sum of
its rows. Blocks are written once to the shared folder; all rounds read them.

``codebooks`` runs the rounds. A round sends the entries (``entries`` per part, so its size is known)
to the tasks, which grow a tree over the entries of each part and descend both trees together. For
a pair of nodes, the boxes bound the distances from below and above; an entry node whose
lower bound exceeds the least upper bound of the data node can hold no nearest entry and goes. A data
node left with one entry is assigned whole, by its cached sum. A leaf that stays uncertain (or a
node for which the bounds exclude next to nothing) compares its rows with its remaining entries. A task answers with one sum per entry and component, Spark adds
them up, and each entry becomes floor(sum / count); an entry without parts stays.

``compress`` assigns all parts once more and writes codes and errors. Boxes, sums and distances are
whole numbers: in doubles where all of them stay below 2**53, else in 64-bit integers, else in
Python integers. Nothing is rounded and equal distances go to the lower index.

Nulls and edge cases: a vector that is null, or holds a null or non-finite component, is dropped.
Vectors of different lengths have codebooks of their own; if a length is no multiple of the parts,
part p holds components p * length // parts up to (p + 1) * length // parts, and a part without
components has code 0. With fewer vectors than ``entries`` the codebook is smaller. Rows with one
vec_id are ordered by their components and coded each for itself; a null vec_id comes last. An error
beyond a long is null, and so is the sum of its label. An empty table gives an empty result. Other
columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetvault.llm.state import checkpointed

BLOCK_ROWS = 8192
BLOCK_NUMBERS = 1 << 22
LEAF_ROWS = 64
LIMB = 40
SUMS = "dim int, part int, entry int, at int, limb int, value long"
LONG = np.iinfo(np.int64).max


def edges(dim: int, parts: int) -> list[int]:
    return [p * dim // parts for p in range(parts + 1)]


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of finite doubles, as int64 where that holds them and else as Python integers."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values * scale)
    if not len(scaled.ravel()) or np.abs(scaled).max() < 2.0**62:
        return scaled.astype(np.int64)
    # A double whose product leaves the doubles is itself a whole number.
    exact = [int(v) * scale if np.isinf(s) else int(s) for v, s in zip(values.ravel().tolist(), scaled.ravel())]
    return np.array(exact, dtype=object).reshape(values.shape)


def stored(numbers: np.ndarray) -> tuple[str, bytes]:
    if numbers.dtype == object:
        return "text", ",".join(map(str, numbers.ravel())).encode()
    kind = "i4" if not numbers.size or int(np.abs(numbers).max()) < 1 << 31 else "i8"
    return kind, numbers.astype(kind).tobytes()


def loaded(kind: str, blob: bytes, shape: tuple) -> np.ndarray:
    if kind == "text":
        return np.array([int(x) for x in blob.decode().split(",")], dtype=object).reshape(shape)
    return np.frombuffer(blob, kind).astype(np.int64).reshape(shape)


def exact_kind(width: int, *numbers: np.ndarray):
    """The fastest number type in which squared distances between these are exact."""
    most = 2 * max((int(np.abs(n).max()) for n in numbers if n.size), default=0)
    far = 2 * width * most * most
    return np.float64 if far < 1 << 53 else np.int64 if far < 1 << 63 else object


class Tree:
    """A balanced tree over rows: node i of level l holds rows order[i * n >> l : (i + 1) * n >> l]."""

    def __init__(self, rows: int, levels: int):
        self.rows, self.levels = rows, levels

    def cuts(self, level: int) -> np.ndarray:
        return np.arange((1 << level) + 1) * self.rows >> level

    @staticmethod
    def height(rows: int, leaf: int) -> int:
        return max(-(-rows // leaf) - 1, 0).bit_length()

    @classmethod
    def grown(cls, points: np.ndarray, leaf: int) -> Tree:
        tree = cls(len(points), cls.height(len(points), leaf))
        order = np.arange(len(points))
        for level in range(tree.levels):
            cuts = tree.cuts(level)
            for begin, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if end - begin < 2:
                    continue
                own = order[begin:end]
                near = points[own]
                axis = int(np.argmax(near.max(axis=0) - near.min(axis=0)))
                half = int((begin + end) // 2 - begin)
                middle = np.argsort if points.dtype == object else np.argpartition
                order[begin:end] = own[middle(near[:, axis], *([half] if middle is np.argpartition else []))]
        # Halves are cut where the next level cuts them.
        tree.order = order
        return tree

    def summed(self, points: np.ndarray) -> Tree:
        """Boxes and sums of the leaves."""
        cuts = self.cuts(self.levels)
        some = np.flatnonzero(np.diff(cuts))
        placed = points[self.order]
        self.low, self.high, self.sums = (np.zeros((len(cuts) - 1, points.shape[1]), points.dtype) for _ in range(3))
        for into, how in ((self.low, np.minimum), (self.high, np.maximum), (self.sums, np.add)):
            into[some] = how.reduceat(placed, cuts[some], axis=0)
        return self

    def stacked(self) -> Tree:
        """Boxes and sums of all levels, from the leaves up; empty nodes take their sibling's box."""
        self.lows, self.highs, self.totals = [self.low], [self.high], [self.sums]
        for level in range(self.levels, 0, -1):
            full = (np.diff(self.cuts(level)) > 0).reshape(-1, 2)
            low, high = (x[0].reshape(-1, 2, x[0].shape[1]) for x in (self.lows, self.highs))
            # At least one child of a node that has rows has rows.
            either = np.where(full[:, :1], low[:, 0], low[:, 1]), np.where(full[:, :1], high[:, 0], high[:, 1])
            other = np.where(full[:, 1:], low[:, 1], either[0]), np.where(full[:, 1:], high[:, 1], either[1])
            self.lows.insert(0, np.minimum(either[0], other[0]))
            self.highs.insert(0, np.maximum(either[1], other[1]))
            total = self.totals[0].reshape(-1, 2, low.shape[2])
            self.totals.insert(0, total[:, 0] + total[:, 1])
        return self


def _squares(gaps: np.ndarray) -> np.ndarray:
    return (gaps * gaps).sum(axis=1)


def descend(data: Tree, entries: Tree) -> tuple[list, list]:
    """Whole nodes as (level, nodes, entries) arrays, and uncertain ones as (level, node, entries in order).

    A node of the lowest quarter of the tree that still keeps most of the entries when these are nearly
    single is left uncertain as it is: smaller boxes would be bounded again for little.
    """
    whole, unsure, all_of_them = [], [], np.arange(entries.rows)
    at, met, level, depth = np.zeros(1, np.int64), np.zeros(1, np.int64), 0, 0
    while len(at):
        low, high = data.lows[level][at], data.highs[level][at]
        below, above = entries.lows[depth][met], entries.highs[depth][met]
        near = _squares(np.maximum(np.maximum(low - above, below - high), 0))
        far = _squares(np.maximum(high - below, above - low))
        first = np.flatnonzero(np.diff(at, prepend=-1))
        sizes = np.diff(first, append=len(at))
        keep = near <= np.repeat(np.minimum.reduceat(far, first), sizes)
        at, met = at[keep], met[keep]
        if 3 * data.levels // 4 <= level < data.levels and depth >= entries.levels - 2:
            first = np.flatnonzero(np.diff(at, prepend=-1))
            held = np.add.reduceat(np.diff(entries.cuts(depth))[met], first)
            wide = 2 * held > entries.rows
            unsure += [(level, node, all_of_them) for node in at[first[wide]].tolist()]
            stay = np.repeat(~wide, np.diff(first, append=len(at)))
            at, met = at[stay], met[stay]
            if not len(at):
                break
        if depth == entries.levels:
            first = np.flatnonzero(np.diff(at, prepend=-1))
            sizes = np.diff(first, append=len(at))
            alone = np.repeat(sizes == 1, sizes)
            found = entries.order[entries.cuts(depth)[met[alone]]]
            whole.append((level, at[alone], found))
            at, met = at[~alone], met[~alone]
            if level == data.levels:
                found = entries.order[entries.cuts(depth)[met]]
                first = np.flatnonzero(np.diff(at, prepend=-1))
                groups = np.split(found, first[1:]) if len(at) else []
                unsure += [(level, int(at[i]), np.sort(group)) for i, group in zip(first, groups)]
                break
        else:
            at, met, depth = np.repeat(at, 2), (2 * met[:, None] + np.arange(2)).ravel(), depth + 1
            some = np.diff(entries.cuts(depth))[met] > 0
            at, met = at[some], met[some]
        if level < data.levels:
            both = (2 * at[:, None] + np.arange(2)).ravel()
            order = np.argsort(both, kind="stable")
            at, met, level = both[order], np.repeat(met, 2)[order], level + 1
    return whole, unsure


def assign(points: np.ndarray, data: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums and counts per entry, and each row's entry, of one part of a block."""
    sums, counts = np.zeros(entries.shape, points.dtype), np.zeros(len(entries), np.int64)
    owner = np.zeros(len(points), np.int64)
    if not entries.shape[1]:
        counts[0] = len(points)
        return sums, counts, owner
    kind = exact_kind(entries.shape[1], points, entries)
    exact, near = points.astype(kind), entries.astype(kind)
    data.low, data.high = data.low.astype(kind), data.high.astype(kind)
    whole, unsure = descend(data.stacked(), Tree.grown(near, 1).summed(near).stacked())
    for level, nodes, found in whole:
        cuts = data.cuts(level)
        np.add.at(sums, found, data.totals[level][nodes])
        np.add.at(counts, found, cuts[nodes + 1] - cuts[nodes])
        for node, entry in zip(nodes.tolist(), found.tolist()):
            owner[data.order[cuts[node] : cuts[node + 1]]] = entry
    norms, rows = _squares(near), []
    for level, node, possible in unsure:
        cuts = data.cuts(level)
        own = data.order[cuts[node] : cuts[node + 1]]
        # The square of the row itself is the same for all entries.
        costs = norms[possible] - 2 * (exact[own] @ near[possible].T)
        owner[own] = possible[np.argmin(costs, axis=1)]
        rows.append(own)
    if rows:
        rows = np.concatenate(rows)
        rows = rows[np.argsort(owner[rows], kind="stable")]
        first = np.flatnonzero(np.diff(owner[rows], prepend=-1))
        sums[owner[rows[first]]] += np.add.reduceat(points[rows], first, axis=0)
        counts += np.bincount(owner[rows], minlength=len(entries))
    return sums, counts, owner


class Block:
    """A block of the built table: its integers, and a tree per part."""

    def __init__(self, row: dict, parts: int):
        self.dim, self.rows = row["dim"], row["rows"]
        self.numbers = loaded(row["kind"], row["numbers"], (self.rows, self.dim))
        self.cuts = edges(self.dim, parts)
        orders = np.frombuffer(row["orders"], np.uint16).reshape(parts, self.rows)
        levels = Tree.height(self.rows, row["leaf"])
        stats = loaded(row["stats_kind"], row["stats"], (3, 1 << levels, self.dim))
        self.trees = []
        for p in range(parts):
            tree = Tree(self.rows, levels)
            tree.order = orders[p].astype(np.int64)
            tree.low, tree.high, tree.sums = stats[:, :, self.cuts[p] : self.cuts[p + 1]]
            self.trees.append(tree)

    def part(self, p: int) -> np.ndarray:
        return self.numbers[:, self.cuts[p] : self.cuts[p + 1]]

    @staticmethod
    def made(numbers: np.ndarray, parts: int, leaf: int) -> dict:
        rows, dim = numbers.shape
        cuts = edges(dim, parts)
        levels = Tree.height(rows, leaf)
        orders, stats = [], np.zeros((3, 1 << levels, dim), numbers.dtype)
        for p in range(parts):
            own = slice(cuts[p], cuts[p + 1])
            if cuts[p] == cuts[p + 1]:
                orders.append(np.arange(rows))
                continue
            tree = Tree.grown(numbers[:, own], leaf).summed(numbers[:, own])
            orders.append(tree.order)
            stats[0, :, own], stats[1, :, own], stats[2, :, own] = tree.low, tree.high, tree.sums
        (kind, blob), (stats_kind, stats_blob) = stored(numbers), stored(stats)
        return {
            "dim": dim, "rows": rows, "leaf": leaf, "kind": kind, "numbers": blob,
            "orders": np.stack(orders).astype(np.uint16).tobytes(), "stats_kind": stats_kind, "stats": stats_blob,
        }


def kept(vectors: DataFrame) -> DataFrame:
    """Rows whose vector takes part."""
    inf = float("inf")
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))
    return vectors.filter(F.col("embedding").isNotNull() & good)


def build(
    vectors: DataFrame, parts: int, scale: int, label: str | None, block_rows: int = BLOCK_ROWS, leaf: int = LEAF_ROWS
) -> DataFrame:
    """Blocks of the vectors (vec_id, embedding, the label column if named) that take part."""
    if not 0 < block_rows <= 1 << 16:
        raise ValueError("block_rows must be from 1 to 65536")
    columns = [F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")]
    rows = kept(vectors).select(*columns, (F.col(label) if label else F.lit(None).cast("int")).alias("label"))
    plain = "dim int, rows int, leaf int, kind string, numbers binary, orders binary, stats_kind string, stats binary"
    schema = T.StructType.fromDDL(plain).add("ids", T.ArrayType(T.LongType())).add("labels", T.ArrayType(rows.schema["label"].dataType))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {}
        for batch in batches:
            sizes = batch["embedding"].value_lengths().to_numpy(zero_copy_only=False)
            values = batch["embedding"].flatten().to_numpy(zero_copy_only=False)
            begins = np.cumsum(sizes) - sizes
            for dim in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == dim)
                matrix = values[begins[own][:, None] + np.arange(dim)] if dim else np.zeros((len(own), 0))
                names = batch.select(["vec_id", "label"]).take(pa.array(own))
                held = waiting.setdefault(dim, [])
                held.append((integers(matrix, scale), names["vec_id"], names["label"]))
                size = min(block_rows, max(BLOCK_NUMBERS // max(dim, 1), 1))
                if sum(len(n) for n, _, _ in held) >= size:
                    yield from cut(held, size, last=False)
        for dim, held in waiting.items():
            yield from cut(held, min(block_rows, max(BLOCK_NUMBERS // max(dim, 1), 1)), last=True)

    def cut(held: list, size: int, last: bool) -> Iterator[pa.RecordBatch]:
        numbers = np.concatenate([n for n, _, _ in held])
        ids, labels = (pa.concat_arrays([h[i] for h in held]) for i in (1, 2))
        end = len(numbers) if last else len(numbers) // size * size
        for at in range(0, end, size):
            own = slice(at, min(at + size, end))
            row = Block.made(numbers[own], parts, leaf)
            row |= {"ids": ids[own].to_pylist(), "labels": labels[own].to_pylist()}
            kinds = [pa.int32()] * 3 + [pa.string(), pa.binary(), pa.binary(), pa.string(), pa.binary()]
            kinds += [pa.list_(pa.int64()), pa.list_(labels.type)]
            yield pa.RecordBatch.from_arrays([pa.array([row[n]], k) for n, k in zip(schema.names, kinds)], schema.names)
        held[:] = [(numbers[end:], ids[end:], labels[end:])] if end < len(numbers) else []

    return rows.mapInArrow(blocks, schema)


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    """``value`` as digits of LIMB bits whose sums over many tasks still fit a long."""
    limb = 0
    while not -(1 << LIMB) <= value < 1 << LIMB:
        yield limb, value & ((1 << LIMB) - 1)
        value, limb = value >> LIMB, limb + 1
    yield limb, value


def _counted(shared, parts: int):
    """Sums and counts per part, entry and component of all blocks of a task; counts stand at -1."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, total = shared.value, {}
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row, parts)
                for p in range(parts):
                    sums, counts, _ = assign(block.part(p), block.trees[p], books[block.dim][p])
                    was = total.get((block.dim, p))
                    total[block.dim, p] = (sums, counts) if was is None else (was[0] + sums, was[1] + counts)
        rows = [
            (dim, p, entry, at, limb, digit)
            for (dim, p), (sums, counts) in total.items()
            for entry in np.flatnonzero(counts).tolist()
            for at, value in [(-1, int(counts[entry])), *enumerate(sums[entry].tolist())]
            for limb, digit in _limbs(value)
        ]
        if rows:
            names = [c.split()[0] for c in SUMS.split(", ")]
            kinds = [pa.int32()] * 5 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return count


def _first(vectors: DataFrame, parts: int, entries: int, scale: int) -> dict[int, list[np.ndarray]]:
    """Codebooks to begin with: parts of the vectors with the smallest ids, per length."""
    order = Window.partitionBy("dim").orderBy(F.asc_nulls_last("vec_id"), "embedding")
    rows = kept(vectors).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.withColumn("dim", F.size("embedding")).withColumn("place", F.row_number().over(order))
    by_dim: dict[int, list] = {}
    for row in rows.filter(F.col("place") <= entries).orderBy("dim", "place").select("dim", "embedding").collect():
        by_dim.setdefault(row.dim, []).append(row.embedding)
    books = {}
    for dim, found in by_dim.items():
        numbers = integers(np.array(found, dtype=np.float64).reshape(len(found), dim), scale)
        cuts = edges(dim, parts)
        books[dim] = [numbers[:, cuts[p] : cuts[p + 1]] for p in range(parts)]
    return books


def _moved(books: dict, sums: list) -> dict:
    """Codebooks after a round: floor(sum / count), entries without parts as they were."""
    values: dict[tuple, int] = {}
    for row in sums:
        key = (row.dim, row.part, row.entry, row.at)
        values[key] = values.get(key, 0) + (row.value << (LIMB * row.limb))
    after = {}
    for dim, parts in books.items():
        after[dim] = []
        for p, entries in enumerate(parts):
            new = entries.astype(object)
            for entry in range(len(entries)):
                count = values.get((dim, p, entry, -1))
                for at in range(entries.shape[1]) if count else ():
                    new[entry, at] = values[dim, p, entry, at] // count
            small = not new.size or max(abs(int(x)) for x in new.ravel()) < 1 << 62
            after[dim].append(new.astype(np.int64) if small else new)
    return after


def codebooks(blocks: DataFrame, first: dict, parts: int, rounds: int) -> dict[int, list[np.ndarray]]:
    """Codebooks per vector length after all rounds: one array (entry, component) per part."""
    spark, books = blocks.sparkSession, first
    for _ in range(rounds):
        sums = blocks.drop("ids", "labels").mapInArrow(_counted(spark.sparkContext.broadcast(books), parts), SUMS)
        added = sums.groupBy("dim", "part", "entry", "at", "limb").agg(F.sum("value").alias("value"))
        books = _moved(books, added.collect())  # a few numbers per component of the codebooks
    return books


def digest(parts: list[np.ndarray]) -> str:
    text = ",".join(str(int(x)) for entries in parts for x in entries.ravel())
    return hashlib.sha256(text.encode()).hexdigest()


def _coded(shared, parts: int, names: list[str]):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, digests = shared.value
        for batch in batches:
            for i, row in enumerate(batch.drop_columns(["ids", "labels"]).to_pylist()):
                block = Block(row, parts)
                owners, errors = [], np.zeros(block.rows, object)
                for p in range(parts):
                    points, entries = block.part(p), books[block.dim][p]
                    owner = assign(points, block.trees[p], entries)[2]
                    kind = exact_kind(points.shape[1], points, entries)
                    kind = np.int64 if kind is np.float64 else kind
                    errors = errors + _squares(points.astype(kind) - entries.astype(kind)[owner]).astype(object)
                    owners.append(owner)
                width = max(2, *[len(f"{len(b) - 1:x}") for b in books[block.dim]])
                codes = ["".join(f"{o:0{width}x}" for o in own) for own in np.stack(owners, axis=1).tolist()]
                fits = [e if e <= LONG else None for e in errors.tolist()]
                columns = [
                    batch["ids"][i].values,
                    batch["labels"][i].values,
                    pa.array(codes, pa.string()),
                    pa.array(fits, pa.int64()),
                    pa.array([digests[block.dim]] * block.rows, pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    return code


def compress(
    vectors: DataFrame,
    parts: int = 4,
    entries: int = 256,
    rounds: int = 4,
    scale: int = 1024,
    label: str | None = None,
    block_rows: int = BLOCK_ROWS,
    leaf: int = LEAF_ROWS,
) -> DataFrame:
    """Code and error per kept row of ``vectors`` (vec_id, embedding, a label column if named).

    Returns vec_id, code (indexes in part order, two hex digits each or more for larger codebooks),
    error, codebooks_sha256, and label, label_error where a label column is named.
    """
    spark = vectors.sparkSession
    blocks = checkpointed(build(vectors, parts, scale, label, block_rows, leaf))
    books = codebooks(blocks, _first(vectors, parts, entries, scale), parts, rounds)
    shared = spark.sparkContext.broadcast((books, {dim: digest(found) for dim, found in books.items()}))
    schema = T.StructType.fromDDL("vec_id bigint").add("label", blocks.schema["labels"].dataType.elementType)
    schema = schema.add("code", "string").add("error", "long").add("codebooks_sha256", "string")
    coded = blocks.mapInArrow(_coded(shared, parts, schema.names), schema)
    if label is None:
        return coded.drop("label")
    coded = checkpointed(coded)
    total = F.when(F.count("error") == F.count("*"), F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long"))
    per_label = coded.groupBy(F.col("label").alias("of")).agg(total.alias("label_error"))
    return coded.join(per_label, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label", "label_error", "codebooks_sha256"
    )
