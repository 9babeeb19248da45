"""Quality classifier: attention-based multiple-instance learning on passages.

A document is a bag of passages of ``PASSAGE_WORDS`` words; its label says nothing about which
passage earned it. Every passage x is encoded, h = tanh(W x). Gated attention weighs it,
a = softmax over the document of w . (tanh(V h) * sigmoid(U h)), and the document is scored on the
weighted passage representation, sigmoid(c . sum(a h) + b). Attention and encoder are learned
together from the documents' labels, in numpy, with a fixed seed.

A passage is described by its shares of kinds of bytes, by word lengths, by how many of its words
are new in the document, and by hashed words. All are computed on whole Arrow batches without a
loop over words.

Training takes at most ``MOST_TRAINING`` labelled documents (those with the smallest hash of their
id) and of each at most ``MOST_PASSAGES`` evenly spread passages, so what reaches the driver is
bounded. Scoring takes every passage of every document, and moves nothing.

Nulls and edge cases: a null or empty text is one passage without words, and is scored. A null label
teaches nothing; of several labels of one id the largest counts. A null id is never held out.
Without any usable label, or with one class only, the score is the share of label 1 (0.5 if there
is none). Other columns, whatever their names, pass untouched in ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetvault.llm import tokens

PASSAGE_WORDS = 64
HASHED = 96
KINDS = 16
WIDTH = KINDS + 6 + HASHED
HIDDEN = 24
GATES = 16
MOST_TRAINING = 4000
MOST_PASSAGES = 16
SLICE_BYTES = 1 << 20
ROUNDS = 60
SEED = 20


def _kinds() -> np.ndarray:
    own = {c: i for i, c in enumerate("!|*%$#&@")}
    kind = np.full(256, 15, np.int64)
    for b in range(256):
        c = chr(b)
        if c in own:
            kind[b] = own[c]
        elif "A" <= c <= "Z":
            kind[b] = 8
        elif "a" <= c <= "z":
            kind[b] = 9
        elif "0" <= c <= "9":
            kind[b] = 10
        elif c in ".,;:?'\"()-":
            kind[b] = 11
        elif c == "\n":
            kind[b] = 12
        elif tokens.WHITE[b]:
            kind[b] = 13
        elif b >= 128:
            kind[b] = 14
    return kind


KIND = _kinds()


def describe(texts) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of a text column, and the index of the first passage of each text."""
    words = tokens.cut(texts)
    hashed = tokens.hashes(words)
    counts = words.counts
    passages = np.maximum(-(-counts // PASSAGE_WORDS), 1)
    first = np.concatenate([[0], np.cumsum(passages)])
    total = int(first[-1])
    text_of = words.text_of
    passage = first[:-1][text_of] + (np.arange(len(hashed)) - words.first[:-1][text_of]) // PASSAGE_WORDS
    size = np.bincount(passage, minlength=total).astype(np.float64)
    out = np.zeros((total, WIDTH), np.float32)
    if not len(hashed):
        return out, first
    # A byte belongs to the passage of the word at or before it.
    heads = np.flatnonzero(np.diff(passage, prepend=-1))
    edges = np.append(words.starts[heads], len(words.data))
    byte_passage = np.repeat(passage[heads], np.diff(edges))
    kinds = np.bincount(byte_passage * KINDS + KIND[words.data[edges[0] :]], minlength=total * KINDS)
    kinds = kinds.reshape(total, KINDS)
    out[:, :KINDS] = kinds / np.maximum(kinds.sum(axis=1, keepdims=True), 1)
    lengths = (words.ends - words.starts).astype(np.float64)
    has = np.maximum(size, 1)
    mean = np.bincount(passage, lengths, total) / has
    own = hashed ^ tokens.mix(text_of.astype(np.uint64) + np.uint64(1))
    new = np.zeros(len(own), bool)
    new[np.unique(own, return_index=True)[1]] = True
    ends = words.data[words.ends - 1]
    marked = np.bincount(passage, KIND[ends] < 8, total) / has
    closed = np.bincount(passage, (ends == 46) | (ends == 33) | (ends == 63), total) / has
    squares = np.bincount(passage, lengths * lengths, total) / has - mean * mean
    extra = [np.log1p(size) / 4, mean / 10, np.sqrt(np.maximum(squares, 0)) / 10]
    extra += [np.bincount(passage, new, total) / has, marked, closed]
    out[:, KINDS : KINDS + 6] = np.stack(extra, axis=1)
    slot = (hashed % np.uint64(HASHED)).astype(np.int64)
    bag = np.bincount(passage * HASHED + slot, minlength=total * HASHED).reshape(total, HASHED)
    out[:, KINDS + 6 :] = bag / has[:, None]
    return out, first


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    parts: dict[str, np.ndarray]
    share: float

    def score(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        if not self.parts:
            return np.full(len(first) - 1, self.share)
        return _sigmoid(_forward(self.parts, (features - self.mean) * self.scale, first)["logit"].astype(np.float64))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _forward(p, x, first):
    heads, sizes = first[:-1], np.diff(first)
    h = np.tanh(x @ p["W"] + p["d"])
    t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
    g = t * s
    e = g @ p["w"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, heads), sizes))
    a = e / np.repeat(np.add.reduceat(e, heads), sizes)
    z = np.add.reduceat(a[:, None] * h, heads)
    return {"x": x, "h": h, "t": t, "s": s, "g": g, "a": a, "z": z, "logit": z @ p["c"] + p["b"]}


def _gradients(p, f, first, labels):
    sizes = np.diff(first)
    error = (_sigmoid(f["logit"]) - labels) / len(labels)
    out = {"c": f["z"].T @ error, "b": error.sum(keepdims=True)}
    along = np.repeat(error, sizes)[:, None] * p["c"]
    da = (along * f["h"]).sum(axis=1)
    mean = np.repeat(np.add.reduceat(f["a"] * da, first[:-1]), sizes)
    de = f["a"] * (da - mean)
    out["w"] = f["g"].T @ de
    dg = de[:, None] * p["w"]
    dt, ds = dg * f["s"] * (1 - f["t"] ** 2), dg * f["t"] * f["s"] * (1 - f["s"])
    out["V"], out["U"] = f["h"].T @ dt, f["h"].T @ ds
    dh = f["a"][:, None] * along + dt @ p["V"].T + ds @ p["U"].T
    dx = dh * (1 - f["h"] ** 2)
    out["W"], out["d"] = f["x"].T @ dx, dx.sum(axis=0)
    return out


def fit(bags: list[np.ndarray], labels: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Learn from bags of passages and their labels; Adam with a fixed order of batches."""
    share = float(labels.mean()) if len(labels) else 0.5
    if share in (0.0, 1.0) or not len(labels):
        return Model(np.zeros(WIDTH), np.ones(WIDTH), {}, share)
    every = np.concatenate(bags).astype(np.float64)
    mean, scale = every.mean(axis=0), 1 / (every.std(axis=0) + 1e-3)
    rng = np.random.default_rng(SEED)

    def draw(*shape):
        return rng.normal(size=shape) / np.sqrt(shape[0])

    p = {"W": draw(WIDTH, HIDDEN), "d": np.zeros(HIDDEN), "V": draw(HIDDEN, GATES), "U": draw(HIDDEN, GATES)}
    p |= {"w": draw(GATES), "c": draw(HIDDEN), "b": np.zeros(1)}
    memory = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    step = 0
    for turn in range(rounds):
        rate = 0.01 * (1 - turn / rounds) + 0.0005
        order = rng.permutation(len(bags))
        for at in range(0, len(order), 64):
            own = order[at : at + 64]
            first = np.concatenate([[0], np.cumsum([len(bags[i]) for i in own])])
            x = (np.concatenate([bags[i] for i in own]) - mean) * scale
            found = _gradients(p, _forward(p, x, first), first, labels[own])
            step += 1
            for k, g in found.items():
                g = g + 1e-4 * p[k]
                m, v = memory[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p[k] = p[k] - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, p, share)


def held_out(doc_id="doc_id"):
    """Documents that never teach: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_TRAINING) -> Model:
    """Fit on at most ``most`` documents (doc_id, text) with a label (doc_id, quality) that may teach."""
    usable = labels.filter("doc_id is not null and quality in (0, 1)").filter(~held_out())
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    taught = own.join(F.broadcast(chosen), "doc_id")  # at most ``most`` rows of two numbers

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.slices(batch, "text", SLICE_BYTES):
                features, first = describe(part["text"])
                bags = []
                for begin, end in zip(first, first[1:]):
                    spread = np.unique(np.linspace(begin, end - 1, min(end - begin, MOST_PASSAGES)).round().astype(int))
                    bags.append(features[spread].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array(bags, pa.binary()), part["quality"]], ["doc_id", "bag", "quality"]
                )

    # Copies of one id (rows may repeat) are taken once, so that the bound on the rows holds.
    found = taught.mapInArrow(passages, "doc_id long, bag binary, quality int")
    rows = found.groupBy("doc_id").agg(F.min(F.struct("bag", "quality")).alias("taken")).select("doc_id", "taken.*")
    rows = rows.toArrow().sort_by("doc_id").to_pylist()
    bags = [np.frombuffer(r["bag"], np.float32).reshape(-1, WIDTH) for r in rows]
    return fit(bags, np.array([r["quality"] for r in rows], np.float64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The whole ``row`` and its score, for every row of ``docs`` (text, anything else)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    packed = docs.select(F.struct("*").alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["row"].field("text").cast(pa.string())
            scores = [
                shared.value.score(*describe(part["text"]))
                for part in tokens.slices(pa.table({"text": texts}), "text", SLICE_BYTES)
            ]
            joined = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(joined, pa.float64())], ["row", "score"])

    schema = T.StructType([packed.schema["row"], T.StructField("score", T.DoubleType())])
    return packed.mapInArrow(run, schema)


def keep(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that a classifier learned from ``labels`` scores ``least`` or more."""
    return score(docs, train(docs, labels)).filter(F.col("score") >= least).select("row.*")
