"""Spans against Python's expressions read literally, learned patterns, redaction, odd rows."""

import hashlib
import math
import random
import re

from fleetvault.llm import pii
from fleetvault.llm.queries import QUERIES
from fleetvault.llm.state import checkpointed

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def good(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def brute(text):
    spans = [
        (m.start(), list(PATTERNS).index(k), f"{k}:{m.start()}:{m.end()}")
        for k, p in PATTERNS.items()
        for m in re.finditer(p, text or "")
        if good(k, m[0])
    ]
    return [s for _, _, s in sorted(spans)]


TRICKY = [
    "a@b.c_d@e.f g@h@i.jk x@y .@-.- a@b..c a@b.c.@d.e",
    "1.2.3.4.5.6.7.8 256.1.1.1 0001.002.3.4 1.2.3 99999999999999999999.1.1.1 1.2.3.4.",
    "4111 1111 1111 1111 4111-1111-1111-1111x4111111111111111 4111  1111 41111111111111112 " + "4" * 500,
    "+1 (213) 555-6467 +1+12345678901 +44 20 7946 0958. +123 + +1( +12345678901234567 +1.2.3.4.5.6.7.8.9.0",
    "é𝒳 é@a.b 𝒳 1.2.3.4 +1 213 555 6467𝒳 4111111111111111",
    "user+1 (213) 555-6467@x.y +14111111111111111@1.2.3.4",
]


def sha(spans):
    return hashlib.sha256(",".join(spans).encode()).hexdigest()


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, seeds long")
    found = pii.find(df).select("doc_id", pii.listed(pii.F.col("base")).alias("base")).collect()
    want = sorted((str(i), ",".join(brute(t))) for i, t, *_ in rows)
    assert sorted((str(r.doc_id), r.base) for r in found) == want


def test_tricky_texts(spark):
    check(spark, [(i, t, None, None) for i, t in enumerate(TRICKY)])


def test_random_texts(spark):
    rng = random.Random(5)
    parts = ["1", "23", "456", "4111111111111111", ".", "-", " ", "@", "a", "+", "(", ")", "b.c", "%", "é", "x\n", "255"]
    check(spark, [(i, "".join(rng.choices(parts, k=rng.randint(0, 60))), None, None) for i in range(1500)])


def test_odd_rows(spark):
    many = " ".join(f"10.0.{i % 256}.{i % 200}" for i in range(3000))
    rows = [(1, None, "k", 1), (2, "", "k", 1), (None, "a@b.cd", None, None), (3, "a@b.cd", "x", 1), (3, "a@b.cd", "x", 1)]
    check(spark, [*rows, (4, many, None, None), (5, "word " * 100_000 + "a@b.cd", None, None), (6, "9" * 20_000, "", 0)])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find(empty).collect() == [] and pii.redact(empty).collect() == []


def taught(n=6):
    rows = [(i, f"Some words, then write to me{i}@mail.example about it.", 1) for i in range(n)]
    rows += [(100 + i, f"plain number {i}{i}{i}4567 here and token nr abc{i}45678", 1) for i in range(3)]
    return [*rows, (50, "Now write to bob(at)mail.example@, please. Also write to nobody.", 1)]


def test_patterns_find_unseen_identifiers(spark):
    df = spark.createDataFrame(taught(), "doc_id long, text string, row long")
    found = {r.doc_id: r for r in pii.find(df).collect()}
    assert [(s.kind, s.start, s.end) for s in found[50].added] == [("email", 13, 33)]
    assert all(not r.added for i, r in found.items() if i != 50)
    few = pii.find(df.filter("doc_id not in (0, 1, 2, 3)")).collect()
    assert not any(r.added for r in few)


def bootstrapped(texts, rounds, least_score=0.8, least_seeds=3, least_digits=6):
    """Patterns with scores, and added spans, of texts of plain words and e-mail addresses or numbers."""
    mail = re.compile(PATTERNS["email"])
    edges, sure, places = set(), {}, []
    for doc, text in enumerate(texts):
        words = [(m.start(), m[0]) for m in re.finditer(r"\S+", text)]
        for i, (at, word) in enumerate(words):
            seed = mail.fullmatch(word)
            if not (seed or "@" in word or len(re.sub("[^0-9]", "", word)) >= least_digits):
                continue
            context = f"{words[i - 2][1]} {words[i - 1][1]}".lower() if i > 1 else ""
            if seed:
                sure[word.lower()] = (1.0, True)
            elif context:
                places.append((doc, at, at + len(word), context))
            if context:
                edges.add((context, word.lower()))
    # Only seeds with a context take part.
    sure = {v: s for v, s in sure.items() if any(e[1] == v for e in edges)}
    fixed = dict(sure)
    of = {}
    for context, value in edges:
        of.setdefault(context, set()).add(value)
    for _ in range(rounds):
        scores = {}
        for context, values in of.items():
            if sum(sure.get(v, (0, False))[1] for v in values) >= least_seeds:
                scores[context] = min(sum(sure.get(v, (0, False))[0] for v in values) / len(values), 1.0)
        guessed = {}
        for context, score in scores.items():
            for value in of[context]:
                guessed.setdefault(value, []).append(score)
        sure = {v: (1 - math.prod(1.000001 - x for x in found), max(found) >= least_score) for v, found in guessed.items()}
        sure |= fixed
    trusted = {c: x for c, x in scores.items() if x >= least_score}
    return trusted, {(d, b, e) for d, b, e, c in places if c in trusted}


def generations():
    """Addresses after "write to"; numbers found there also follow "ping mister", and one more does."""
    texts = [f"please write to user{i}@mail.example now" for i in range(9)]
    texts += [f"please write to 77000{i}11 now" for i in range(4)]
    texts += [f"then ping mister 77000{i}11 today" for i in range(4)]
    return [*texts, "then ping mister 99123456 today", "order number 55512345 shipped", "order number 55512346 shipped"]


def matches_brute_force(scanned, texts, rounds):
    """Patterns and scores, and the candidates behind trusted patterns, are those of plain Python."""
    found = {r.context: r for r in pii.patterns(scanned, rounds, 0.8, 3).collect()}
    trusted, spans = bootstrapped(texts, rounds)
    assert set(found) == set(trusted)
    assert all(r.kind == "email" and abs(r.score - trusted[c]) < 1e-9 for c, r in found.items())
    rows = scanned.select("doc_id", "candidates").collect()
    assert {(r.doc_id, c.start, c.end) for r in rows for c in r.candidates if c.context in found} == spans
    return trusted, spans


def scan_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return df, checkpointed(pii._scan(df))


def test_discovered_instances_induce_patterns(spark):
    texts = generations()
    last = len(texts) - 3
    df, scanned = scan_of(spark, texts)
    early, few = matches_brute_force(scanned, texts, 2)
    assert "ping mister" not in early and all(d != last for d, _, _ in few)
    late, more = matches_brute_force(scanned, texts, 6)
    assert {"write to", "ping mister"} == set(late) and any(d == last for d, _, _ in more)
    assert all(d < last + 1 for d, _, _ in more)
    assert {(r.doc_id, s.start, s.end) for r in pii.find(df).collect() for s in r.added} == more


def test_patterns_of_random_graphs(spark):
    draw = random.Random(5)
    contexts = [f"{a} {b}" for a in ("mail", "ring", "see") for b in ("me", "him", "box")]
    values = [f"u{i}@x.example" for i in range(12)] + [f"{i}00200{i}" for i in range(10)] + ["ab@cd", "q@r"]
    texts = [f"so {draw.choice(contexts[: 3 + i % 7])} {draw.choice(values[: 14 + i % 10])} ok" for i in range(160)]
    _, scanned = scan_of(spark, texts)
    for rounds in (1, 4):
        matches_brute_force(scanned, texts, rounds)


def test_how_many_digits_a_candidate_needs(spark):
    rows = [(i, f"my badge is u{i}@x.example") for i in range(9)] + [(20, "so badge is 4711 ok")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    added = lambda n: [r.doc_id for r in pii.find(df, least_digits=n).collect() if r.added]
    assert added(4) == [20] and added(5) == []


def spaced():
    """Seeds of phones, cards and e-mails after fixed words, then identifiers that only those words tell."""
    rows = [(i, f"Please call me +1 (213) 555-640{i} today.") for i in range(9)]
    rows += [(20 + i, f"paid with card {c} today") for i, c in enumerate(("4111 1111 1111 1111", "5500 0000 0000 0004", "6011 0000 0000 0004"))]
    rows += [(26 + i, f"card {c}") for i, c in enumerate(("4012 8888 8888 1881", "4222 2222 2222 2220"))]
    long = "x" * 300
    rows += [(30 + i, f"{long} mail mail{i}@mail.example") for i in range(5)]
    return rows


def test_spaced_identifiers_are_found(spark):
    texts = [
        ("please call me (213) 555-6467 now", "(213) 555-6467", "phone"),
        ("please call me 213 555 6467.", "213 555 6467", "phone"),
        ("please call me 213.555.6467, 12 people", "213.555.6467", "phone"),
        ("please call me (213 555 6467)", "213 555 6467", "phone"),
        ("a@b.cd call me 213 - 555 - 6467", "213 - 555 - 6467", "phone"),
        ("id 77 call me 2135556467", "2135556467", "phone"),
        ("call me 213 555 6467  10.0.0.1 x", "213 555 6467", "phone"),
        ("paid with card 4111 1111 1111 1112 then", "4111 1111 1111 1112", "card"),
        (f"see {'x' * 300} mail bob(at)mail.example@", "bob(at)mail.example@", "email"),
    ]
    df = spark.createDataFrame([*spaced(), *[(100 + i, t) for i, (t, *_) in enumerate(texts)]], "doc_id long, text string")
    found = {r.doc_id: r.added for r in pii.find(df).collect()}
    for i, (text, value, kind) in enumerate(texts):
        assert [(s.kind, text[s.start : s.end]) for s in found[100 + i]] == [(kind, value)], text
    assert not any(found[i] for i, _ in spaced())


def test_pieces_between_seeds(spark):
    rows = [*spaced(), (100, "10.0.0.1 call me 213 555 6467  10.0.0.1  213 555 6468 call me 5 people")]
    found = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = rows[-1][1]
    assert [text[s.start : s.end] for s in found[100].added] == ["213 555 6467"]
    assert len(found[100].base) == 2


def test_redaction(spark):
    rows = [*taught(), (60, "é a@b.cd, 4111 1111 1111 1111 and +1 (213) 555-6467@x.y!", 2), (61, None, 3), (61, None, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row long")
    out = pii.redact(df)
    assert out.columns == df.columns
    texts = sorted((r.doc_id, r.text, r.row) for r in out.filter("doc_id in (50, 60) or doc_id = 101").collect())
    assert texts == [
        (50, "Now write to [EMAIL], please. Also write to nobody.", 1),
        (60, "é [EMAIL], [CARD] and [PHONE]!", 2),
        (101, taught()[7][1], 1),
    ]
    assert out.count() == len(rows) and out.filter("text is null").count() == 2


def test_whole_table(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op10_pii"](spark, sf_dir).collect()
    assert sorted(docs) == sorted(r.doc_id for r in rows)
    for r in rows:
        spans = brute(docs[r.doc_id])
        assert r.base_sha256 == sha(spans)
        assert set(spans) <= set(r.spans.split(",")) | {""}
        assert [getattr(r, f"n_{k}") for k in PATTERNS] == [sum(s.startswith(k) for s in spans) for k in PATTERNS]


def test_no_python_in_the_plan(spark, sf_dir):
    plan = QUERIES["op10_pii"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
