"""Ranked lexical search with geometric blocks per term, exact.

``term_vectors`` turns documents into shards: rows of a few thousand documents that hold, for every
document, its length and how often each asked term occurs in it. Shards are written once; the totals
of the collection and the documents per term are counted over them by Spark.

A task then takes its shards one after the other. For a term it has a posting list, and cuts it into
blocks of similar documents: documents are sketched by signed random sums of their term weights, and
the list is halved along the widest axis of its own sketches until a block holds ``block_docs``. A
block's summary holds, per term, the largest weight in any of its documents. The terms of an item are
taken in one order, rarest first. The sum of a summary over this term and those after it bounds the
score of every document of the block that no earlier list has shown (what an earlier list has shown
is scored or excluded already), so a block is skipped only if this bound is below the k-th score
found so far; all other documents are scored exactly, from all their terms. The whole shard is the
coarsest block of each list: where its summary already excludes the list, no blocks are made. Blocks
of a list serve all items that ask for it. Sums, bounds and scores are 64-bit integers.

A task answers with k rows per item, and a ranking per item merges them. Texts never move. Items are
sent to the tasks in groups of ``group_bytes`` of text, so that what is broadcast has a bound.

Nulls and edge cases: a null or empty text, of a document or an item, has no terms: such a document is
not counted, such an item gets no rows. A term counts once per item, however often it occurs. A null
doc_id is found last among ties. Repeated documents are each ranked; an item asks once for each row it
has. Long texts are read whole. With empty tables nothing is found. Other columns are not looked at.
A word is known by 64 bits of its hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetvault.llm import tokens
from fleetvault.llm.state import checkpointed

SHARD_DOCS = 4096
SHARD_ENTRIES = 1 << 20
BLOCK_DOCS = 64
SKETCH = 16
SLICE_BYTES = 4 << 20
SHARD = "docs long, words long, ids binary, known binary, lengths binary, first binary, terms binary, counts binary"


def term_hashes(texts: pa.Array) -> tuple[tokens.Words, np.ndarray]:
    words = tokens.cut(texts, tokens.NOT_ALNUM, lower=True)
    return words, tokens.hashes(words)


class Items:
    """Items of a group: their ids, and their distinct terms as indexes of the sorted vocabulary."""

    def __init__(self, ids: list, texts: pa.Array):
        words, found = term_hashes(texts)
        self.vocabulary = np.unique(found)
        index = np.searchsorted(self.vocabulary, found)
        self.ids, self.terms = [], []
        for i, item_id in enumerate(ids):
            own = np.unique(index[words.first[i] : words.first[i + 1]])
            if len(own):
                self.ids.append(item_id)
                self.terms.append(own)


def _entries(texts: pa.Array, vocabulary: np.ndarray) -> tuple[np.ndarray, ...]:
    """Terms per text, and the (text, asked term, occurrences) entries in order."""
    words, found = term_hashes(texts)
    at = np.minimum(np.searchsorted(vocabulary, found), len(vocabulary) - 1)
    asked = vocabulary[at] == found
    keys, counts = np.unique(words.text_of[asked] * len(vocabulary) + at[asked], return_counts=True)
    return words.counts, keys // len(vocabulary), keys % len(vocabulary), counts


def term_vectors(docs: DataFrame, vocabulary, shard_docs: int = SHARD_DOCS, shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """Shards of ``docs`` (doc_id, text); ``vocabulary`` is a broadcast of sorted term hashes, not empty."""
    names = [c.split()[0] for c in SHARD.split(", ")]

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, entries = [], 0, 0
        for batch in batches:
            for part in tokens.slices(batch, "text", SLICE_BYTES):
                lengths, text_of, terms, counts = _entries(part["text"], vocabulary.value)
                asked = np.unique(text_of)
                ids = part["doc_id"].fill_null(0).to_numpy(zero_copy_only=False)[asked]
                known = part["doc_id"].is_valid().to_numpy(zero_copy_only=False)[asked]
                own = np.bincount(np.searchsorted(asked, text_of), minlength=len(asked))
                held.append((int((lengths > 0).sum()), int(lengths.sum()), ids, known, lengths[asked], own, terms, counts))
                size, entries = size + len(asked), entries + len(terms)
                if size >= shard_docs or entries >= shard_entries:
                    yield joined(held)
                    held, size, entries = [], 0, 0
        if held:
            yield joined(held)

    def joined(held: list) -> pa.RecordBatch:
        docs, words, *arrays = zip(*held)
        ids, known, lengths, own, terms, counts = (np.concatenate(a) for a in arrays)
        first = np.concatenate([[0], np.cumsum(own)])
        kinds = [np.int64, np.bool_, np.int64, np.int64, np.int32, np.int64]
        blobs = [a.astype(k).tobytes() for a, k in zip((ids, known, lengths, first, terms, counts), kinds)]
        row = [pa.array([sum(docs)], pa.int64()), pa.array([sum(words)], pa.int64())]
        return pa.RecordBatch.from_arrays([*row, *(pa.array([b], pa.binary()) for b in blobs)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(shards, SHARD)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per term over all shards of a task."""
    total = np.zeros(0, np.int64)
    for batch in batches:
        for blob in batch["terms"].to_pylist():
            counts = np.bincount(np.frombuffer(blob, np.int32), minlength=len(total))
            counts[: len(total)] += total
            total = counts
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["term", "docs"])


class Plan:
    """What a task needs to know: collection totals, term weights and items, terms numbered rarest first."""

    def __init__(self, items: Items, docs: int, words: int, frequencies: np.ndarray, k: int, block_docs: int):
        self.docs, self.words, self.k, self.block_docs = docs, words, k, block_docs
        weights = [math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1))) for df in frequencies.tolist()]
        order = np.argsort(-np.array(weights, np.int64), kind="stable")
        self.place = np.argsort(order, kind="stable").astype(np.int32)
        self.weights = np.array(weights, np.int64)[order]
        self.ids = items.ids
        self.terms = [np.sort(self.place[own]) for own in items.terms]
        # Which items ask for a term, and at which place of theirs.
        self.asks: dict[int, list[tuple[int, int]]] = {}
        for item, own in enumerate(self.terms):
            for at, term in enumerate(own.tolist()):
                self.asks.setdefault(term, []).append((item, at))

    def later(self, term: int) -> np.ndarray:
        """Terms from this one on that an item with this term asks for."""
        return np.unique(np.concatenate([self.terms[item][at:] for item, at in self.asks[term]]))

    def saturation(self, lengths: np.ndarray) -> np.ndarray:
        if len(lengths) and 90 * int(lengths.max()) * self.docs >= 1 << 63:
            return np.array([10 + 90 * n * self.docs // self.words for n in lengths.tolist()], np.int64)
        return 10 + 90 * lengths * self.docs // self.words


class Shard:
    """Documents of a shard, by document and by term."""

    def __init__(self, row: dict, plan: Plan):
        self.plan = plan
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.known = np.frombuffer(row["known"], np.bool_)
        self.first = np.frombuffer(row["first"], np.int64)
        self.terms = plan.place[np.frombuffer(row["terms"], np.int32)]
        counts = np.frombuffer(row["counts"], np.int64)
        self.doc_of = np.repeat(np.arange(len(self.ids)), np.diff(self.first))
        m = plan.saturation(np.frombuffer(row["lengths"], np.int64))[self.doc_of]
        self.impacts = 1_000_000_000 * counts // (1000 * counts + 8 * m)
        self.by_term = np.argsort(self.terms, kind="stable")
        listed = self.terms[self.by_term]
        self.begins = np.flatnonzero(np.diff(listed, prepend=-1))
        self.present = listed[self.begins]
        self.ends = np.append(self.begins[1:], len(listed))
        # The summary of the shard as a whole.
        self.most = np.zeros(len(plan.weights), np.int64)
        if len(listed):
            self.most[self.present] = np.maximum.reduceat(self.impacts[self.by_term], self.begins)
        self._sketches = None

    def entries_of(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries of ``docs`` one after the other, and how many each has."""
        sizes = self.first[docs + 1] - self.first[docs]
        begins = np.repeat(self.first[docs] - (np.cumsum(sizes) - sizes), sizes)
        return begins + np.arange(int(sizes.sum())), sizes

    @property
    def sketches(self) -> np.ndarray:
        """Unit vectors whose nearness follows that of the documents' weighted terms."""
        if self._sketches is None:
            signs = np.random.default_rng(13).choice(np.array([-1.0, 1.0]), (len(self.plan.weights), SKETCH))
            size = (self.plan.weights[self.terms] * self.impacts).astype(np.float64)
            count = len(self.ids)
            axes = [np.bincount(self.doc_of, size * signs[self.terms, j], minlength=count) for j in range(SKETCH)]
            made = np.stack(axes, axis=1)
            self._sketches = made / np.maximum(np.linalg.norm(made, axis=1, keepdims=True), 1e-9)
        return self._sketches

    def clustered(self, docs: np.ndarray) -> list[np.ndarray]:
        """A posting list as blocks of similar documents."""
        done, waiting = [], [docs]
        while waiting:
            own = waiting.pop()
            if len(own) <= self.plan.block_docs:
                done.append(own)
                continue
            near = self.sketches[own]
            axis = int(np.argmax(near.var(axis=0)))
            half = np.argpartition(near[:, axis], len(own) // 2)
            waiting += [own[half[: len(own) // 2]], own[half[len(own) // 2 :]]]
        return done

    def summaries(self, blocks: list[np.ndarray], terms: np.ndarray) -> np.ndarray:
        """Per block and term, the largest impact in any document of the block."""
        column = np.full(len(self.plan.weights), -1, np.int64)
        column[terms] = np.arange(len(terms))
        entries, sizes = self.entries_of(np.concatenate(blocks))
        block_of = np.repeat(np.repeat(np.arange(len(blocks)), [len(b) for b in blocks]), sizes)
        at = column[self.terms[entries]]
        asked = at >= 0
        most = np.zeros(len(blocks) * len(terms), np.int64)
        np.maximum.at(most, block_of[asked] * len(terms) + at[asked], self.impacts[entries[asked]])
        return most.reshape(len(blocks), len(terms))

    def scores(self, docs: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """Exact scores; every document holds a term of the shard's vocabulary."""
        weights = np.zeros(len(self.plan.weights), np.int64)
        weights[terms] = self.plan.weights[terms]
        entries, sizes = self.entries_of(docs)
        return np.add.reduceat(weights[self.terms[entries]] * self.impacts[entries], np.cumsum(sizes) - sizes)


class Best:
    """The k best documents found for an item: score down, then doc_id up, nulls last."""

    def __init__(self, k: int):
        self.k = k
        self.scores, self.ids, self.known = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def needed(self) -> int:
        """A document below this score is not among the best."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        good = scores >= self.needed
        if not good.any():
            return
        scores, ids, known = (
            np.concatenate(pair) for pair in ((self.scores, scores[good]), (self.ids, ids[good]), (self.known, known[good]))
        )
        order = np.lexsort((ids, ~known, -scores))[: self.k]
        self.scores, self.ids, self.known = scores[order], ids[order], known[order]


def search_shard(shard: Shard, best: list[Best], blocks_scored: list | None = None) -> None:
    """Bring ``best`` (one per item) up to date with all documents of a shard.

    ``blocks_scored`` collects, per list that an item opened, its blocks and how many were scored.
    """
    plan = shard.plan
    # Bounds of the shard as a whole, for every item from each of its terms on.
    tails = [np.cumsum((plan.weights[own] * shard.most[own])[::-1])[::-1].tolist() for own in plan.terms]
    shown: dict[int, np.ndarray] = {}
    for term, begin, end in zip(shard.present.tolist(), shard.begins.tolist(), shard.ends.tolist()):
        open_items = [(item, at) for item, at in plan.asks.get(term, ()) if tails[item][at] >= best[item].needed]
        if not open_items:
            continue
        docs = shard.doc_of[shard.by_term[begin:end]]
        blocks = shard.clustered(docs)
        if len(blocks) > 1:
            terms = plan.later(term)
            most = shard.summaries(blocks, terms)
        for item, at in open_items:
            own = plan.terms[item][at:]
            if len(blocks) > 1:
                bounds = most[:, np.searchsorted(terms, own)] @ plan.weights[own]
            else:
                bounds = np.array([tails[item][at]])
            order, done, step, scored = np.argsort(-bounds, kind="stable"), 0, 1, 0
            marks = shown.setdefault(item, np.zeros(len(shard.ids), bool))
            while done < len(order) and bounds[order[done]] >= best[item].needed:
                # The most promising blocks first; they raise what the others need.
                chosen = order[done : done + step]
                chosen = chosen[bounds[chosen] >= best[item].needed]
                new = np.concatenate([blocks[b] for b in chosen])
                new = new[~marks[new]]
                if len(new):
                    marks[new] = True
                    best[item].add(shard.scores(new, plan.terms[item]), shard.ids[new], shard.known[new])
                done, step, scored = done + step, step * 2, scored + len(chosen)
            if blocks_scored is not None:
                blocks_scored.append((len(order), scored))


def _answers(shared, names: list[str], item_type):
    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        best = [Best(plan.k) for _ in plan.ids]
        for batch in batches:
            for row in batch.to_pylist():
                search_shard(Shard(row, plan), best)
        for number, (item_id, found) in enumerate(zip(plan.ids, best)):
            size = len(found.ids)
            if size:
                columns = [
                    pa.array([number] * size, pa.int64()),
                    pa.array([item_id] * size, item_type),
                    pa.array(found.ids, mask=~found.known),
                    pa.array(found.scores),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    return answer


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    block_docs: int = BLOCK_DOCS,
    group_bytes: int = 1 << 20,
    shard_docs: int = SHARD_DOCS,
) -> DataFrame:
    """The k best documents (doc_id, text) for each item (item_id, text): item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    asked = items.select("item_id", F.col("text").cast("string").alias("text"))
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups, result = size // group_bytes + 1, None
    kind = items.schema["item_id"].dataType
    schema = T.StructType.fromDDL("query bigint").add("item_id", kind).add("doc_id", "long").add("score", "long")
    for at in range(groups):
        own = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == at).toArrow().combine_chunks()
        texts = own["text"].chunk(0) if own.num_rows else pa.array([], pa.string())
        group = Items(own["item_id"].to_pylist(), texts)
        if not len(group.vocabulary):
            continue
        shards = checkpointed(term_vectors(docs, spark.sparkContext.broadcast(group.vocabulary), shard_docs))
        total = shards.agg(F.sum("docs").alias("docs"), F.sum("words").alias("words")).first()
        if not total.docs:
            continue
        frequencies = np.zeros(len(group.vocabulary), np.int64)
        counted = shards.select("terms").mapInArrow(_frequencies, "term long, docs long").groupBy("term").agg(F.sum("docs"))
        for term, found in counted.collect():  # one row per asked term
            frequencies[term] = found
        plan = Plan(group, total.docs, total.words, frequencies, k, block_docs)
        shared = spark.sparkContext.broadcast(plan)
        found = shards.mapInArrow(_answers(shared, schema.names, own.schema.field("item_id").type), schema)
        result = found if result is None else result.unionByName(found.withColumn("query", F.col("query") + (at << 40)))
    if result is None:
        result = spark.createDataFrame([], schema)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = result.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
