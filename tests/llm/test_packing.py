"""Packing against the tokenizer itself, and the dynamic programme against trying every cut."""

import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from fleetvault.llm import packing
from fleetvault.llm.queries import QUERIES, vocabulary

ODD = [
    (1, None, "a"),
    (2, "", "a"),
    (3, "One. Two! <|endoftext|>x y\x1cź it's  \n", None),
    (3, "One. Two!", "a"),
    (None, "no id", "a"),
    (4, "word " * 30_000 + "Été ́combining ﬁ İ ΣΣ.", "a"),
    (5, "x" * 5000, "a"),
    (6, "D'été l'œuvre \u0130x ²³½ a_b\xa0c\x85d\x0be\x1cf «Ça» ĳ ŉ ǆ ª.º µ ÿ Ÿ … — <|ENDOFTEXT|> don't I'LL 'SO", "a"),
    (7, "D'ÉTÉ l'œuvre ²³½ a_b\xa0c\x85d\x0be\x1cf «Ça» ĳ ŉ ǆ ª.º µ ÿ Ÿ don't I'LL 'SO we've? x'd!", "a"),
]


def whole_ids(text):
    return [*Tokenizer.from_file(vocabulary()).encode(text or "", add_special_tokens=False).ids, 1]


def checked(pieces, docs):
    """Every id in exactly one piece, sequences gapless and not too long. Returns the padding."""
    sequences, seen = {}, {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append(p)
        seen.setdefault((p.doc_id, p.doc_tokens), []).append(p)
    padding = tokens = 0
    for parts in sequences.values():
        parts.sort(key=lambda p: p.offset)
        size = 0
        for p in parts:
            assert p.offset == size
            size += p.length
        assert 0 < size <= 2048
        tokens += size
        padding += 0 if size & (size - 1) == 0 else 2048 - size
    whole = {}
    for doc_id, text in docs:
        ids = whole_ids(text)
        whole.setdefault((doc_id, len(ids)), []).append(ids)
    assert set(whole) == set(seen)
    for key, copies in whole.items():
        want = sorted((s, n, zlib.crc32(np.array(i[s : s + n], "<u4").tobytes())) for i in copies for s, n in cover(seen[key], len(copies)))
        assert sorted((p.start, p.length, p.ids_crc32) for p in seen[key]) == want or len(copies) > 1
        assert sum(p.length for p in seen[key]) == key[1] * len(copies)
    return padding, tokens


def cover(parts, copies):
    if copies > 1:
        return []
    at, out = 0, []
    for p in sorted(parts, key=lambda p: p.start):
        assert p.start == at
        out.append((p.start, p.length))
        at += p.length
    return out


def test_odd_rows(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string, sequence_id string")
    checked(packing.pack(df, vocabulary()).collect(), [(i, t) for i, t, _ in ODD])


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(df, vocabulary()).collect() == []


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    padding, tokens = checked(QUERIES["op6_packing"](spark, sf_dir).collect(), docs)
    assert padding < 0.02 * tokens + 2048


def test_short_stretches_settle_the_same_ids(spark, sf_dir, monkeypatch):
    texts = [(i, " ".join(f"word{i} number{j}." for j in range(i * 7 % 900))) for i in range(120)]
    encode, out = packing.Encoder(vocabulary()), []
    stretch = packing.Stretch(2048, 0)
    for doc_id, text in texts:
        ids, ends = encode(text)
        stretch.add(doc_id, np.concatenate([ids, np.array([1], "<u4")]), ends)
        if stretch.size > 20_000:
            out += stretch.close(last=False)
    out += stretch.close(last=True)
    names = [c.split()[0] for c in packing.PIECES.split(", ")]
    from collections import namedtuple

    piece = namedtuple("piece", names)
    padding, tokens = checked([piece(*p) for p in out], texts)
    assert padding < 0.02 * tokens + 2048


@pytest.mark.parametrize("most", [packing.MOST_WORDS, 8, 3])
def test_words_and_parts_are_those_of_the_tokenizer(monkeypatch, most):
    monkeypatch.setattr(packing, "MOST_WORDS", most)
    monkeypatch.setattr(packing, "TOGETHER", 3)
    texts = [
        "Don't stop. We'VE it's'll'd''s ' 's", "", " \t ", "a\x1cb c", "x\x85y\xa0z\x0bq", "\u0130stanbul",
        "<|endoftext|> a", "na\u00efve caf\u00e9 \u00bd \u00b2" + "3 \u00aa", "\x00 a\x7f b\x01c", "\u20ac \u4e2d a",
        "(see 3.14, or a/b-c_d@e.fr)!?", " ".join(f"w{i}x, y{i}." for i in range(40)),
    ]
    encode = packing.Encoder(vocabulary())
    for _ in range(2):
        for text, (ids, _) in zip(texts, encode.batch(texts), strict=True):
            assert ids.tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_a_task_leaves_few_words_in_its_worker(monkeypatch):
    monkeypatch.setattr(packing, "KEPT_WORDS", 50)
    monkeypatch.setattr(packing.TaskContext, "get", classmethod(lambda cls: type("Task", (), {"partitionId": lambda self: 0})()))
    monkeypatch.setattr(packing, "_encoders", {})
    texts = [" ".join(f"w{i}x{j} the" for j in range(40)) for i in range(20)]
    run = packing._packer(vocabulary(), 2048)
    rows = [list(run(iter([pa.RecordBatch.from_pydict({"doc_id": range(20), "text": texts})]))) for _ in range(2)]
    encode = packing.encoder(vocabulary())
    assert 0 < len(encode.words) <= 50 and 0 < len(encode.parts) <= 50
    assert rows[0] == rows[1]
    assert encode(texts[7])[0].tolist() == encode.tokenizer.encode(texts[7], add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(30))
def test_cuts_are_the_cheapest(seed):
    rng = np.random.default_rng(seed)
    at = np.cumsum(rng.integers(1, 9, size=10))
    penalty = rng.integers(0, 6, size=10)
    penalty[-1] = 0

    def cost(cuts):
        total, begin = 0, 0
        for c in cuts:
            size = int(at[c]) - begin
            if size > 12:
                return float("inf")
            free = size & (size - 1) == 0 and int(at[c]) > at[-1] - 12
            total += (0 if free else 12 - size) + int(penalty[c])
            begin = int(at[c])
        return total

    every = [(*c, 9) for n in range(10) for c in combinations(range(9), n)]
    assert cost(packing.best_cuts(at, penalty, 12)) == min(map(cost, every))
