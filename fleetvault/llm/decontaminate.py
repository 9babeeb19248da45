"""Benchmark decontamination with suffix arrays of the training text.

Every task sorts the suffixes of its documents, a shard of about ``shard_bytes`` at a time, into
a suffix array of words (prefix doubling, to the depth of a window). Each suffix of the test set
is searched in the array by bisection. The range that opens with ``window`` words (with the
whole item, where that is shorter) names all occurrences. Each occurrence is then followed to the
longest verbatim match, by bisection in the suffix array of the test set.

Documents never move: a shard is read, searched and forgotten. The test set is sent to the tasks
in blocks of ``block_bytes``; a set of several blocks takes several passes, and the state between
passes (document and hits so far) is checkpointed, so that no more than a block is ever
broadcast. Words are compared as 64-bit hashes.

Nulls and edge cases: a null or empty text has no words and is clean; an item without words has
no window. An item without id hits words but is not listed. Rows of one item_id count as one
item. Repeated documents are judged alone. Other columns, whatever their names, pass untouched
in ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetvault.llm import tokens
from fleetvault.llm.state import checkpointed

STATE = (
    "n_words long, n_hit long, spans array<struct<start:long,end:long>>, items array<long>, "
    "matches array<struct<start:long,length:long,item_id:long,item_start:long>>"
)


def ends_of(first: np.ndarray) -> np.ndarray:
    """For each word the index just after the last word of its text."""
    return np.repeat(first[1:], np.diff(first))


def suffix_array(words: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` words at least; a text's end sorts first."""
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64) + 1
    here, reach = np.arange(len(words)), 1
    while reach < depth:
        after = here + reach
        follow = np.where(after < ends, rank[np.minimum(after, len(words) - 1)], 0)
        key = rank * (len(words) + 2) + follow
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64) + 1
        if rank.max(initial=0) == len(words):
            break
        reach *= 2
    return np.argsort(rank, kind="stable")


def common(left, left_at, left_end, right, right_at, right_end):
    """Length of the common opening of suffixes, and whether the left one sorts first."""
    length = np.zeros(len(left_at), np.int64)
    less = np.zeros(len(left_at), bool)
    open_ = np.arange(len(left_at))
    step = 0
    while len(open_):
        a, b = left_at[open_] + step, right_at[open_] + step
        a_out, b_out = a >= left_end[open_], b >= right_end[open_]
        x = left[np.minimum(a, len(left) - 1)]
        y = right[np.minimum(b, len(right) - 1)]
        same = ~a_out & ~b_out & (x == y)
        less[open_] = ~same & ~b_out & (a_out | (x < y))
        length[open_[same]] += 1
        open_ = open_[same]
        step += 1
    return length, less


class Tests:
    """A block of the test set: its words, windows and suffix array."""

    def __init__(self, items: pa.Table, window: int):
        words = tokens.cut(items["text"], tokens.NOT_ALNUM, lower=True)
        self.words, self.first = tokens.hashes(words), words.first
        self.ends = ends_of(words.first)
        self.item_of = words.text_of
        self.ids = items["item_id"].to_pylist()
        counts = words.counts
        starts = tokens.window_starts(words.first, window)
        short = np.flatnonzero((counts > 0) & (counts < window))
        self.starts = np.concatenate([starts, words.first[short]])
        self.widths = np.concatenate([np.full(len(starts), window), counts[short]])
        self.order = suffix_array(self.words, self.ends, max([1, *counts]))
        # Windows of the same words are searched once: each stands for its whole range.
        places = np.empty(len(self.order), np.int64)
        places[self.order] = np.arange(len(self.order))
        by_text = np.lexsort((places[self.starts], self.widths)) if len(self.starts) else self.starts
        self.starts, self.widths = self.starts[by_text], self.widths[by_text]
        new = np.ones(len(self.starts), bool)
        if len(new) > 1:
            a, b = self.starts[:-1], self.starts[1:]
            shared, _ = common(self.words, a, a + self.widths[:-1], self.words, b, b + self.widths[1:])
            new[1:] = (self.widths[1:] != self.widths[:-1]) | (shared < self.widths[1:])
        self.group = np.cumsum(new) - 1
        self.heads = np.flatnonzero(new)

    def items_of(self, groups: np.ndarray, docs: np.ndarray):
        """Distinct (document, item) of distinct windows seen in documents."""
        begin = np.searchsorted(self.group, groups, "left")
        count = np.searchsorted(self.group, groups, "right") - begin
        at = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())
        pairs = np.unique(np.stack([np.repeat(docs, count), self.item_of[self.starts[at]]]), axis=1)
        return pairs[0], pairs[1]


def bisect(words, ends, order, tests: Tests, starts, widths, after: bool):
    """For each window the first place in ``order`` whose suffix sorts after (not before) it."""
    low, high = np.zeros(len(starts), np.int64), np.full(len(starts), len(order))
    while (low < high).any():
        middle = (low + high) // 2
        at = order[np.minimum(middle, len(order) - 1)]
        shared, less = common(words, at, np.minimum(ends[at], at + widths), tests.words, starts, starts + widths)
        up = (low < high) & (less | ((shared == widths) if after else False))
        low, high = np.where(up, middle + 1, low), np.where(up | (low >= high), high, middle)
    return low


def occurrences(words, ends, order, tests: Tests):
    """Places of all windows of the test set in a shard, as (window group, word index)."""
    seen = np.isin(tests.words, words)
    missing = np.concatenate([[0], np.cumsum(~seen)])
    starts, widths = tests.starts[tests.heads], tests.widths[tests.heads]
    likely = np.flatnonzero(missing[starts + widths] == missing[starts])
    starts, widths = starts[likely], widths[likely]
    low = bisect(words, ends, order, tests, starts, widths, after=False)
    high = bisect(words, ends, order, tests, starts, widths, after=True)
    count = high - low
    at = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
    return np.repeat(likely, count), np.repeat(widths, count), order[at]


def longest(words, ends, places, tests: Tests):
    """For each place of a shard the longest match with a suffix of the test set, and where."""
    stop = ends[places]
    low, high = np.zeros(len(places), np.int64), np.full(len(places), len(tests.order))
    while (low < high).any():
        middle = (low + high) // 2
        at = tests.order[np.minimum(middle, len(tests.order) - 1)]
        _, less = common(tests.words, at, tests.ends[at], words, places, stop)
        up = (low < high) & less
        low, high = np.where(up, middle + 1, low), np.where(up | (low >= high), high, middle)
    best, where = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
    for near in (low - 1, low):
        at = tests.order[np.clip(near, 0, len(tests.order) - 1)]
        length, _ = common(tests.words, at, tests.ends[at], words, places, stop)
        better = length > best
        best, where = np.where(better, length, best), np.where(better, at, where)
    return best, where


def _lists(parts: list[np.ndarray], owner: np.ndarray, count: int, names: list[str] | None) -> pa.Array:
    """One list per text of rows sorted by ``owner``."""
    edges = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=count))]), pa.int32())
    arrays = [pa.array(p, pa.int64()) for p in parts]
    return pa.ListArray.from_arrays(edges, pa.StructArray.from_arrays(arrays, names) if names else arrays[0])


def _search(tests: Tests, texts: pa.Array, before: pa.RecordBatch | None, window: int) -> pa.Table:
    cut = tokens.cut(texts, tokens.NOT_ALNUM, lower=True)
    words, first, count = tokens.hashes(cut), cut.first, len(cut.first) - 1
    text_of, ends = cut.text_of, ends_of(cut.first)
    change = np.zeros(len(words) + 1, np.int64)
    group = place = np.zeros(0, np.int64)
    width = place
    if len(words) and len(tests.words):
        group, width, place = occurrences(words, ends, suffix_array(words, ends, window), tests)
        np.add.at(change, place, 1)
        np.add.at(change, place + width, -1)
    doc, item = tests.items_of(*np.unique(np.stack([group, text_of[place]]), axis=1)) if len(place) else (place, place)
    ids = [tests.ids[i] for i in item]
    named = np.array([i is not None for i in ids], bool)
    doc, item_ids = doc[named], np.array([i for i in ids if i is not None], np.int64)
    # A match is told where it begins, not again for each window inside it.
    where = np.unique(place)
    length, source = longest(words, ends, where, tests) if len(where) else (where, where)
    inside = np.zeros(len(where), bool)
    inside[1:] = (np.diff(where) == 1) & (text_of[where[1:]] == text_of[where[:-1]]) & (length[:-1] == length[1:] + 1)
    where, length, source = where[~inside], length[~inside], source[~inside]
    known = np.array([tests.ids[i] is not None for i in tests.item_of[source]], bool)
    match_ids = pa.array([tests.ids[i] for i in tests.item_of[source]], pa.int64())
    match = [where - first[text_of[where]], length, match_ids, source - tests.first[tests.item_of[source]]]
    match_of = text_of[where]
    if before is not None:
        spans = before["spans"].flatten()
        span_of = before["spans"].value_parent_indices().to_numpy()
        np.add.at(change, spans.field("start").to_numpy() + first[span_of], 1)
        np.add.at(change, spans.field("end").to_numpy() + first[span_of], -1)
        doc, (item_ids,) = _after(before["items"], doc, [item_ids], None)
        match_of, match = _after(before["matches"], match_of, match, ["start", "length", "item_id", "item_start"])
    hit = np.cumsum(change[:-1]) > 0
    begins, stops = hit.copy(), hit.copy()
    begins[1:] &= ~hit[:-1] | (text_of[1:] != text_of[:-1])
    stops[:-1] &= ~hit[1:] | (text_of[1:] != text_of[:-1])
    begin, stop = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    base = first[:-1][text_of[begin]]
    return pa.table(
        {
            "n_words": pa.array(cut.counts, pa.int64()),
            "n_hit": pa.array(np.bincount(text_of[hit], minlength=count), pa.int64()),
            "spans": _lists([begin - base, stop - base], text_of[begin], count, ["start", "end"]),
            "items": _lists([item_ids], doc, count, None),
            "matches": _lists(match, match_of, count, ["start", "length", "item_id", "item_start"]),
        }
    )


def _after(column: pa.ListArray, owner, parts, names):
    """What earlier passes found, with the new rows behind it, sorted by text."""
    old, old_of = column.flatten(), column.value_parent_indices().to_numpy()
    olds = [old.field(n) for n in names] if names else [old]
    order = np.argsort(np.concatenate([old_of, owner]), kind="stable")
    joined = [pa.concat_arrays([a, pa.array(b, pa.int64())]).take(pa.array(order)) for a, b in zip(olds, parts)]
    return np.concatenate([old_of, owner])[order], joined


def _pass(block, window: int, shard_bytes: int, started: bool):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = block.value
        for batch in batches:
            texts = batch["row"].field("text")
            for part in tokens.slices(pa.table({"t": texts, "i": np.arange(batch.num_rows)}), "t", shard_bytes):
                begin = part["i"][0].as_py()
                own = batch.slice(begin, part.num_rows)
                found = _search(tests, part["t"], own if started else None, window)
                yield from found.add_column(0, "row", own["row"]).combine_chunks().to_batches()

    return search


def find(
    docs: DataFrame, tests: DataFrame, window: int = 10, shard_bytes: int = 2 << 20, block_bytes: int = 8 << 20
) -> DataFrame:
    """Per row of ``docs`` (text, anything else): the whole ``row``, n_words, n_hit (words in an
    occurrence), their spans, the items that occur, and the longest matches with their places."""
    if window < 1:
        raise ValueError("window must be positive")
    spark = docs.sparkSession
    tests = tests.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = size // block_bytes + 1
    current = docs.select(F.struct("*").alias("row"))
    schema = T.StructType([current.schema["row"], *T.StructType.fromDDL(STATE)])
    for number in range(blocks):
        own = tests.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == number)
        block = spark.sparkContext.broadcast(Tests(own.toArrow(), window))
        current = current.mapInArrow(_pass(block, window, shard_bytes, number > 0), schema)
        if number + 1 < blocks:
            current = checkpointed(current)
            block.unpersist()
    return current


def clean(docs: DataFrame, tests: DataFrame, window: int = 10, **sizes) -> DataFrame:
    """The rows of ``docs`` in which no window of the test set occurs."""
    return find(docs, tests, window, **sizes).filter("n_hit = 0").select("row.*")
