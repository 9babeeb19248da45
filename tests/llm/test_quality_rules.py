"""Quality rules against plain Python on every text, and edge tables."""

import random
import re
from collections import Counter

import pytest

from fleetvault.llm import quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    inside = {i + j for i, w in enumerate(windows) if seen[w] > 1 for j in range(8)}
    n = {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_letter_words": sum(bool(re.search(r"[A-Za-z]|[^\x00-\x7F]", w)) for w in words),
        "n_stop_words": sum(w.lower() in quality_rules.STOP_WORDS for w in words),
        "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_list_lines": sum(bool(re.match(r"[ \t]*[-*•]", line)) for line in lines),
        "n_cut_lines": sum(bool(re.search(r"(\.\.\.|…)[ \t\r]*\Z", line)) for line in lines),
        "n_repeat_words": len(inside),
    }
    base = n["n_words"] < 20 or 100 * n["n_repeat_words"] > 30 * n["n_words"]
    kept = not base and (
        300 * n["n_words"] <= 100 * n["word_chars"] <= 1000 * n["n_words"]
        and 100 * n["n_symbols"] <= 10 * n["n_words"]
        and 100 * n["n_letter_words"] >= 80 * n["n_words"]
        and 100 * n["n_stop_words"] >= 2 * n["n_words"]
        and 100 * n["n_dup_lines"] <= 40 * n["n_lines"]
        and 100 * n["n_list_lines"] <= 90 * n["n_lines"]
        and 100 * n["n_cut_lines"] <= 30 * n["n_lines"]
    )
    return {**n, "base": base, "kept": kept}


def texts():
    rng = random.Random(5)
    vocabulary = ["the", "of", "and", "House", "river", "Straße", "12", "--", "a#b", "stone...", "été", "x" * 40]
    made = [None, "", " \t\n\x0b\x0c\r ", "one", "the of\n" * 3, "a b c d e f g h " * 2, "a b c d e f g h a b c d e f g", "x " * 50]
    for _ in range(120):
        size = rng.choice([5, 19, 20, 21, 60, 200])
        words = rng.choices(vocabulary, weights=[6, 6, 4, 8, 8, 3, 1, 1, 1, 1, 2, 1], k=size)
        if rng.random() < 0.4:
            words = words[: size // 2] + words[: size // 3] + words[size // 2 :]
        made.append("".join(w + rng.choice([" ", " ", " ", "\n", "\t", "\n- ", "  "]) for w in words))
    made.append(" ".join(f"w{i % 9000}" for i in range(30000)))
    made.append("\n".join(["The house of the river and the stone stands there."] * 12))
    return made


def test_against_plain_python(spark):
    rows = list(enumerate(texts())) * 2  # every row twice: rows are judged each for itself
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = quality_rules.judge(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        want = plain(r.row.text)
        names = [c for c in want if c not in ("base", "kept")]
        assert {c: r[c] for c in names} == {c: want[c] for c in names}, r.row.text
        assert r.kept == want["kept"] == (not r.failed)
        assert bool({"words", "repeated_words"} & set(r.failed)) == want["base"]


def test_other_columns_keep_their_names(spark):
    docs = spark.createDataFrame([(1, "the house of stone " * 2, 7, 8, True)], "doc_id long, text string, row int, n_words int, kept boolean")
    (got,) = quality_rules.judge(docs).collect()
    assert (got.n_words, got.row.n_words, got.row.row, got.row.kept) == (8, 8, 7, True)
    assert quality_rules.keep(docs).columns == docs.columns


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert quality_rules.judge(docs).collect() == []


def test_a_table_of_own_rules(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, ""), (3, "# #")], "doc_id long, text string")
    rule = quality_rules.Rule("marks", "n_symbols", "n_words", most=50)
    got = {r.row.doc_id: r.kept for r in quality_rules.judge(docs, rules=[rule]).collect()}
    assert got == {1: True, 2: True, 3: False}
    assert {r.kept for r in quality_rules.judge(docs, rules=[]).collect()} == {True}


@pytest.mark.parametrize("size", [7, 8, 9, 16])
def test_windows_at_the_border(spark, size):
    text = " ".join(["w"] * size)
    (got,) = quality_rules.measure(spark.createDataFrame([(text,)], "text string")).collect()
    assert got.n_repeat_words == (size if size > 8 else 0)


def test_plan_moves_nothing_and_runs_no_python(spark, sf_dir):
    from fleetvault.llm.queries import QUERIES

    plan = QUERIES["op12_quality_rules"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Exchange", "Python", "Arrow", "Pandas", "Join"))
