"""Substring dedup: windows of words that repeat in an earlier document are cut out.

Rabin-Karp hashes of every window of ``window`` words are counted in Spark, and the repeated
windows of a document merge into maximal intervals of words to remove.

1. Documents are dealt into chunks of about ``chunk_bytes`` by a hash of id and text. A chunk is
   a bounded group; copies of one text are no group at all.
2. Each chunk sends its distinct window hashes, with the smallest document id that has each, as
   one packed row per range of hashes. A window that a third of the documents share is one
   entry per chunk.
3. Each range answers with one bit per entry: some other chunk has the window in a smaller
   document.
4. Chunks meet their answers, mark covered words and give back what is left.

The text moves once, and the hashes once, at about ten bytes a window. A window is known by 64 +
``8 * check_bytes`` bits; with the default 80 bits, 10**13 windows are expected to confuse a
hundred. Raise ``check_bytes`` (to 8 at most) for more.

Nulls and edge cases: a null or empty text has no words; a document of fewer words than a window
loses nothing. A null id counts as larger than any id, and rows of one id are one document as to
"smaller": they never remove words of each other. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetvault.llm import tokens

LAST_ID = np.iinfo(np.int64).max
CHECK_BASE = np.uint64(0xD6E8FEB86659FD93)
ENTRIES = "chunk long, range int, hashes binary, checks binary, docs binary"
ANSWERS = "chunk long, range int, bits binary"
RESULT = "doc_id long, n_words long, n_removed long, intervals array<struct<start:long,end:long>>, kept string"


def _windows(table: pa.Table, width: int):
    """Words of the chunk, its windows, and the distinct windows with their smallest document."""
    words = tokens.cut(table["text"])
    ids = table["doc_id"].fill_null(LAST_ID).to_numpy().astype(np.int64)
    hashed = tokens.hashes(words)
    starts = tokens.window_starts(words.first, width)
    first, second = tokens.rolling(hashed, width), tokens.rolling(hashed, width, CHECK_BASE)
    keys, checks = (first[starts], second[starts]) if len(starts) else (first[:0], second[:0])
    owner = np.repeat(ids, np.maximum(words.counts - width + 1, 0))
    order = np.lexsort((owner, checks, keys)) if len(keys) else np.zeros(0, np.int64)
    keys, checks = keys[order], checks[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (checks[1:] != checks[:-1])
    entry = np.empty(len(order), np.int64)
    entry[order] = np.cumsum(new) - 1
    return words, starts, owner, entry, keys[new], checks[new], owner[order][new]


def _entries(width: int, range_bits: int, check_bytes: int):
    def send(table: pa.Table) -> pa.Table:
        chunk = table["chunk"][0].as_py()
        *_, keys, checks, least = _windows(table, width)
        ranges = keys >> np.uint64(64 - range_bits) if range_bits else np.zeros(len(keys), np.uint64)
        found, at = np.unique(ranges, return_index=True)
        rows = []
        for number, begin, end in zip(found, at, [*at[1:], len(keys)]):
            steps = np.diff(keys[begin:end], prepend=np.uint64(0))
            shown = np.ascontiguousarray(checks[begin:end].view(np.uint8).reshape(-1, 8)[:, :check_bytes].T)
            rows.append((chunk, int(number), tokens.pack(steps), shown.tobytes(), tokens.pack(least[begin:end])))
        names = ["chunk", "range", "hashes", "checks", "docs"]
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds))})

    return send


def _answers(check_bytes: int):
    def answer(table: pa.Table) -> pa.Table:
        keys, checks, docs = [], [], []
        for packed, shown, least in zip(*(table[c].to_pylist() for c in ("hashes", "checks", "docs"))):
            keys.append(np.cumsum(tokens.unpack(packed, np.uint64), dtype=np.uint64))
            wide = np.zeros((len(keys[-1]), 8), np.uint8)
            wide[:, :check_bytes] = np.frombuffer(shown, np.uint8).reshape(check_bytes, len(keys[-1])).T
            checks.append(wide.reshape(-1).view(np.uint64))
            docs.append(tokens.unpack(least, np.int64))
        at = np.cumsum([0, *map(len, keys)])
        key, check, doc = map(np.concatenate, (keys, checks, docs))
        order = np.lexsort((doc, check, key))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(key[order]) != 0) | (np.diff(check[order]) != 0)
        smallest = doc[order][new][np.cumsum(new) - 1]
        earlier = np.empty(len(order), bool)
        earlier[order] = smallest < doc[order]
        rows = [
            (chunk, number, np.packbits(earlier[begin:end]).tobytes())
            for chunk, number, begin, end in zip(table["chunk"].to_pylist(), table["range"].to_pylist(), at, at[1:])
            if earlier[begin:end].any()
        ]
        return pa.table(
            {
                "chunk": pa.array([r[0] for r in rows], pa.int64()),
                "range": pa.array([r[1] for r in rows], pa.int32()),
                "bits": pa.array([r[2] for r in rows], pa.binary()),
            }
        )

    return answer


def _removal(width: int, range_bits: int):
    def remove(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _result([], [], [], [], np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64))
        words, starts, owner, entry, keys, _, least = _windows(docs, width)
        earlier = np.zeros(len(keys), bool)
        edges = (np.arange(1, 1 << range_bits, dtype=np.uint64) << np.uint64(64 - range_bits)) if range_bits else keys[:0]
        at = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
        for number, bits in zip(answers["range"].to_pylist(), answers["bits"].to_pylist()):
            begin, end = at[number], at[number + 1]
            earlier[begin:end] = np.unpackbits(np.frombuffer(bits, np.uint8), count=end - begin).astype(bool)
        hit = starts[earlier[entry] | (least[entry] < owner)]
        change = np.zeros(len(words.starts) + 1, np.int32)
        change[hit] += 1
        change[hit + width] -= 1
        gone = np.cumsum(change[:-1]) > 0
        return _cut_out(docs, words, gone)

    return remove


def _cut_out(docs: pa.Table, words: tokens.Words, gone: np.ndarray) -> pa.Table:
    kept, text_of = ~gone, words.text_of
    data = words.data.copy()
    data[words.ends[kept]] = 0x20
    change = np.zeros(len(data) + 1, np.int8)
    change[words.starts[kept]] += 1
    change[words.ends[kept] + 1] -= 1
    left = data[np.cumsum(change[:-1], dtype=np.int8) > 0].tobytes()
    sizes = np.bincount(text_of[kept], (words.ends - words.starts)[kept] + 1, len(words.counts)).astype(np.int64)
    at = np.cumsum(sizes)
    texts = [left[end - size : max(end - 1, 0)] if size else b"" for end, size in zip(at.tolist(), sizes.tolist())]
    removed = np.bincount(text_of[gone], minlength=len(words.counts))
    # An interval is a run of removed words within one text.
    begins = gone.copy()
    begins[1:] &= ~gone[:-1] | (text_of[1:] != text_of[:-1])
    stops = gone.copy()
    stops[:-1] &= ~gone[1:] | (text_of[1:] != text_of[:-1])
    begin, stop = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    runs = np.concatenate([[0], np.cumsum(np.bincount(text_of[begin], minlength=len(words.counts)))])
    base = words.first[:-1][text_of[begin]]
    return _result(docs["doc_id"], words.counts, removed, texts, begin - base, stop - base, runs)


def _result(ids, counts, removed, texts, begin, stop, runs) -> pa.Table:
    pair = pa.StructArray.from_arrays([pa.array(begin, pa.int64()), pa.array(stop, pa.int64())], ["start", "end"])
    return pa.table(
        {
            "doc_id": ids if isinstance(ids, pa.ChunkedArray) else pa.array(ids, pa.int64()),
            "n_words": pa.array(counts, pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "intervals": pa.ListArray.from_arrays(pa.array(runs, pa.int32()), pair),
            "kept": pa.array(texts, pa.binary()).cast(pa.string()),
        }
    )


def dedup(
    docs: DataFrame,
    window: int = 13,
    chunk_bytes: int = 2 << 20,
    range_bytes: int = 8 << 20,
    check_bytes: int = 2,
) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_words, n_removed, removed intervals of words, kept text."""
    if window < 1 or not 0 <= check_bytes <= 8:
        raise ValueError("window must be positive, check_bytes from 0 to 8")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = size // chunk_bytes + 1
    range_bits = int(size // range_bytes).bit_length()
    text, doc = F.col("text").cast("string"), F.col("doc_id").cast("long")
    dealt = docs.select(
        doc.alias("doc_id"), text.alias("text"), F.pmod(F.xxhash64(doc, text), F.lit(chunks)).alias("chunk")
    ).repartition("chunk")
    entries = dealt.groupBy("chunk").applyInArrow(_entries(window, range_bits, check_bytes), ENTRIES)
    answers = entries.groupBy("range").applyInArrow(_answers(check_bytes), ANSWERS)
    removal = _removal(window, range_bits)
    return (
        dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(removal, RESULT)
    )
