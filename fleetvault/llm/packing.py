"""Packing: an order-preserving dynamic programme chooses where sequences are cut.

The tokens of a task's documents, in stored order, form one stream. Possible cuts are the ends
of documents, the ends of sentences, and every ``WORD_STEP`` tokens of a sentence that is long.
A sequence from cut i to cut j costs its padding, plus a penalty by the kind of cut j::

    cost[j] = penalty[j] + length - at[j] + min(cost[i] + at[i] : at[j] - at[i] <= length)

The minimum over the sliding window comes from a monotone queue, one push and pop per cut. A
sequence of a power of two needs no padding; its few possible beginnings are tried as well where
the stream ends. The stream is solved in stretches of about ``STRETCH`` tokens. The last, open sequences of a
stretch go on into the next, so that only a task's end can be short.

Tokens never leave the task, and documents never move: the scan's splits are packed where they
are read, and a retried task gives the same pieces. ``sequence_id`` is the task's number times
2**33 plus a count.

Nulls and edge cases: a null or empty text is the end token alone. An empty table gives no piece.
Documents longer than a sequence span several. Repeated rows are packed once each. Other columns
are not looked at; a null id is carried as null.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import deque
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetvault.llm.tokens import slices

END_TOKEN = 1
SENTENCE_PENALTY = 8
WORD_PENALTY = 24
WORD_STEP = 64
STRETCH = 1 << 20
MOST_WORDS = 1 << 20
KEPT_WORDS = 1 << 18
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "padding long"
)
# How the vocabulary's tokenizer parts a text, for characters below U+0250 in lower case.
LETTER = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
DIGIT = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
SPACE = r"\t-\r \x85\xa0"
PART = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{DIGIT}]|[^{SPACE}{LETTER}{DIGIT}]+")
# What needs the tokenizer itself: other characters, signs that only ``str.split`` takes for white space,
# and names of special tokens. U+0130 becomes two characters in lower case.
OTHER = re.compile("[\x1c-\x1f\u0130\u0250-\U0010ffff]|<[|]")
OTHER_ASCII = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")
TOGETHER = 1024  # parts that are encoded as one text
SLICE_BYTES = 4 << 20


class Encoder:
    """Ids of whole texts.

    A text of Latin letters, digits and signs is split at white space. Each distinct word is parted as
    the vocabulary's tokenizer parts it, each distinct part is encoded once, and both are looked up
    afterwards; at most ``MOST_WORDS`` of each are remembered, and ``KEPT_WORDS`` from task to task. Any
    other text goes to the tokenizer as it is.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.missed = 0
        self.stops = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, number in self.tokenizer.get_vocab().items():
            self.stops[number] = token.removesuffix("</w>").endswith((".", "!", "?"))
            self.ends[number] = token.endswith("</w>")

    def _encoded(self, parts: list[str]) -> dict[str, bytes]:
        """Many parts are encoded as one text; a part has one token that ends a word, its last."""
        texts = [" ".join(parts[i : i + TOGETHER]) for i in range(0, len(parts), TOGETHER)]
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ids = np.array([i for code in found for i in code.ids], "<u4")
        edges = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
        if len(edges) != len(parts) or edges[-1] != 4 * len(ids):
            found = self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)
            return {p: np.array(code.ids, "<u4").tobytes() for p, code in zip(parts, found)}
        data = ids.tobytes()
        return {p: data[begin:end] for p, begin, end in zip(parts, [0, *edges], edges)}

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        parted = {w: PART.findall(w) for w in words}
        new = list(set().union(*parted.values()).difference(self.parts))
        if len(self.parts) + len(new) > MOST_WORDS:
            self.parts, new = {}, list(set().union(*parted.values()))
        if new:
            self.parts |= self._encoded(new)
        known = self.parts.__getitem__
        return {w: known(parts[0]) if len(parts) == 1 else b"".join(map(known, parts)) for w, parts in parted.items()}

    def _known(self, words: set[str]) -> dict[str, bytes]:
        """A dictionary that has all these words."""
        new = words.difference(self.words)
        if len(self.words) + len(new) > MOST_WORDS:
            self.missed += len(new)
            if self.missed <= MOST_WORDS:
                rare = self._learn(new)
                return {w: rare[w] if w in rare else self.words[w] for w in words}
            self.words, self.missed, new = {}, 0, words
        if new:
            self.words |= self._learn(new)
        return self.words

    def trim(self) -> None:
        """Keeps the words learned first, which are mostly the common ones."""
        self.words = dict(islice(self.words.items(), KEPT_WORDS))
        self.parts = dict(islice(self.parts.items(), KEPT_WORDS))
        self.missed = 0

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and the places after which a sentence ends."""
        return self.batch([text])[0]

    def batch(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The same of many texts, whose unknown words are encoded together."""
        parted = [None if _other(text) else text.lower().split() for text in texts]
        known = self._known(set().union(*filter(None, parted))).__getitem__
        coded = []
        for text, words in zip(texts, parted):
            if words is None:
                ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
            else:
                ids = np.frombuffer(b"".join(map(known, words)), "<u4")
            coded.append((ids, np.flatnonzero(self.stops[ids]) + 1))
        return coded


def _other(text: str) -> bool:
    return any(sign in text for sign in OTHER_ASCII) if text.isascii() else OTHER.search(text) is not None


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder; it outlives a task, and so does what ``trim`` leaves of what it has learned."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


PENALTIES = np.array([0, WORD_PENALTY, SENTENCE_PENALTY, 0])


def cuts_of(tokens: int, sentences: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Possible cuts within and at the end of one document, and their penalties."""
    kind = np.zeros(tokens + 1, np.int8)
    kind[WORD_STEP:tokens:WORD_STEP] = 1
    kind[sentences[sentences < tokens - 1]] = 2
    kind[tokens] = 3
    at = np.flatnonzero(kind)
    return at, PENALTIES[kind[at]]


def best_cuts(at: np.ndarray, penalty: np.ndarray, length: int, ends: bool = True) -> np.ndarray:
    """Indices of the chosen cuts of a stream that begins at 0; the last is the stream's end.

    Neighbouring cuts are at most ``length`` apart. Where the stream ends, within its last
    ``length`` tokens, a sequence may also be of a power of two, which has no padding.
    """
    place = [0, *at.tolist()]
    extra = [0, *penalty.tolist()]
    cost, back = [0] * len(place), [0] * len(place)
    close = place[-1] - length if ends else place[-1]
    powers = [1 << k for k in range(length.bit_length()) if 1 << k < length]
    index: dict[int, int] = {}
    queue, keys = deque([0]), deque([0])  # cuts that may still open a sequence, and cost + place
    for j in range(1, len(place)):
        here = place[j]
        while place[queue[0]] < here - length:
            queue.popleft()
            keys.popleft()
        least, best = keys[0] + length - here, queue[0]
        if here > close:
            if not index:
                index = {p: i for i, p in enumerate(place) if p > close - length}
            for power in powers:
                i = index.get(here - power)
                if i is not None and cost[i] < least:
                    least, best = cost[i], i
        cost[j], back[j] = least + extra[j], best
        value = cost[j] + here
        while keys and keys[-1] >= value:
            keys.pop()
            queue.pop()
        keys.append(value)
        queue.append(j)
    chosen, j = [], len(place) - 1
    while j:
        chosen.append(j)
        j = back[j]
    return np.array(chosen[::-1]) - 1


class Stretch:
    """Documents whose tokens are not all in a closed sequence yet."""

    def __init__(self, length: int, sequence: int):
        self.length, self.sequence = length, sequence
        self.docs: list[tuple] = []  # id, ids, cuts, penalties, tokens already cut off
        self.size = 0

    def add(self, doc_id, ids: np.ndarray, sentences: np.ndarray) -> None:
        self.docs.append((doc_id, ids, *cuts_of(len(ids), sentences), 0))
        self.size += len(ids)

    def close(self, last: bool) -> list[tuple]:
        """Pieces of the sequences that are settled; the others stay for the next stretch."""
        if not self.docs:
            return []
        base = np.cumsum([0, *(len(d[1]) - d[4] for d in self.docs)])
        at = np.concatenate([d[2][d[2] > d[4]] - d[4] + b for d, b in zip(self.docs, base)])
        penalty = np.concatenate([d[3][d[2] > d[4]] for d in self.docs])
        edges = at[best_cuts(at, penalty, self.length, last)]
        if not last:
            edges = edges[: max(len(edges) - 4, 0)]
        pieces, begin, number = [], 0, 0
        for end in edges.tolist():
            opened, size = begin, end - begin
            padding = 0 if size & (size - 1) == 0 else self.length - size
            while begin < end:
                doc_id, ids, _, _, done = self.docs[number]
                stop = min(end, int(base[number + 1]))
                start = done + begin - int(base[number])
                piece = ids[start : start + stop - begin]
                crc = zlib.crc32(piece.tobytes())
                pieces.append((doc_id, start, len(piece), crc, len(ids), self.sequence, begin - opened, padding))
                begin = stop
                number += begin == base[number + 1]
            self.sequence += 1
        settled = int(edges[-1]) if len(edges) else 0
        self.docs = self.docs[number:]
        if self.docs and settled > base[number]:
            doc_id, ids, cuts, penalties, done = self.docs[0]
            self.docs[0] = (doc_id, ids, cuts, penalties, done + settled - int(base[number]))
        self.size -= settled
        return pieces


def _packer(vocabulary: str, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        stretch = Stretch(length, TaskContext.get().partitionId() << 33)
        end = np.array([END_TOKEN], "<u4")
        try:
            for batch in batches:
                for part in slices(batch, "text", SLICE_BYTES):
                    texts = [text or "" for text in part["text"].to_pylist()]
                    for doc_id, (ids, sentences) in zip(part["doc_id"].to_pylist(), encode.batch(texts)):
                        stretch.add(doc_id, np.concatenate([ids, end]), sentences)
                        if stretch.size >= STRETCH:
                            yield from _rows(stretch.close(last=False))
            yield from _rows(stretch.close(last=True))
        finally:
            # The worker goes on to other queries' tasks, beside an executor that may need the memory.
            encode.trim()

    return run


def _rows(pieces: list[tuple]) -> Iterator[pa.RecordBatch]:
    if pieces:
        names = [c.split()[0] for c in PIECES.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pieces)], names)


def pack(docs: DataFrame, vocabulary: str, length: int = 2048) -> DataFrame:
    """Pieces of all ``docs`` (doc_id, text) in sequences of at most ``length`` tokens."""
    if length < WORD_STEP:
        raise ValueError(f"length must be {WORD_STEP} or more")
    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return columns.mapInArrow(_packer(vocabulary, length), PIECES)
