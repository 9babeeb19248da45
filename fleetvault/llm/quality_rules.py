"""Quality rules: a table of thresholds compiled into one projection, in Spark functions only.

``measure`` counts, per text: words and the code points in them, symbols, words with a letter, stop
words, lines with a word, lines that repeat an earlier one, lines that begin like a list item, lines
that end in dots, and words inside 8-word windows that occur twice or more. A rule of ``RULES``
bounds the ratio of two counts, in percent and whole numbers, so that no rounding decides.
``judge`` turns the whole table into one expression per rule; a text is kept if none fails. Nothing
is shuffled or joined, and no row meets another.

Windows are found in two steps: 64-bit hashes of the windows of a text are counted, which settles
every text without repeats; in the others, the windows whose hash repeats are compared word by word.
Every step looks at one window and its neighbour in sorted order, so a long text costs what its
words cost.

Nulls and edge cases: a null text has no words, like an empty one, and fails ``words``. A ratio over
nothing (no words, no lines) fails no rule. Repeated rows are judged each for itself, long texts as
a whole. Other columns are kept inside ``row``, whatever their names. An empty table gives an empty
result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetvault.llm.state import let

# White space, symbols and the words of a window.
WHITE = r"[\x20\x09-\x0D]+"
WORDY = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
# ASCII characters that are neither letters nor white space: a word of these alone has no letter.
NOT_LETTERS = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalpha())
# Frequent words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to a in is that it for was on with as be by are this at from have "
    "der die und den von zu das sich mit des auf ist im nicht dem ein eine "
    "de la le et les en du un une que est pour par dans qui pas sur au "
    "el y los las se del por con no una su para es al lo"
).split()


@dataclass(frozen=True)
class Rule:
    """Fails a text if part is below ``least`` percent or above ``most`` percent of whole.

    ``whole`` None compares the count itself, not a ratio.
    """

    name: str
    part: str
    whole: str | None = None
    least: int | None = None
    most: int | None = None


#: The two rules that decide first.
BASE = (
    Rule("words", "n_words", least=20),
    Rule("repeated_words", "n_repeat_words", "n_words", most=30),
)
RULES = (
    *BASE,
    Rule("word_length", "word_chars", "n_words", least=300, most=1000),
    Rule("symbols", "n_symbols", "n_words", most=10),
    Rule("letters", "n_letter_words", "n_words", least=80),
    Rule("stop_words", "n_stop_words", "n_words", least=2),
    Rule("repeated_lines", "n_dup_lines", "n_lines", most=40),
    Rule("list_lines", "n_list_lines", "n_lines", most=90),
    Rule("cut_lines", "n_cut_lines", "n_lines", most=30),
)


def repeats(words: Column, width: int = WINDOW) -> Column:
    """How many of ``words`` lie in windows of ``width`` words that occur twice or more."""

    def neighbours(rows: Column) -> Column:
        """Of sorted (key, at), those whose key is also the one before or after."""

        def shared(row: Column, i: Column) -> Column:
            return F.get(rows, i - 1).key.eqNullSafe(row.key) | F.get(rows, i + 1).key.eqNullSafe(row.key)

        return F.filter(rows, shared)

    def covered(places: Column) -> Column:
        gaps = F.transform(places, lambda p, i: F.least(F.coalesce(F.get(places, i + 1) - p, F.lit(width)), F.lit(width)))
        return F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap)

    def exact(hashed: Column) -> Column:
        likely = let(F.sort_array(F.transform(hashed, lambda h, i: F.struct(h.alias("key"), i.alias("at")))), neighbours)
        spelled = F.transform(
            likely,
            lambda r: F.struct(
                F.concat_ws(" ", *[F.get(words, r.at + step) for step in range(width)]).alias("key"), r.at.alias("at")
            ),
        )
        sure = let(F.sort_array(spelled), neighbours)
        return let(F.sort_array(F.transform(sure, lambda r: r.at)), covered)

    def counted(hashed: Column) -> Column:
        alone = F.size(F.array_distinct(hashed)) == F.size(hashed)
        return F.when(alone, F.lit(0)).otherwise(exact(hashed))

    def windows(hashes: Column) -> Column:
        begins = F.slice(hashes, 1, F.size(hashes) - width + 1)
        return F.transform(
            begins, lambda h, i: F.xxhash64(h, *[F.get(hashes, i + step) for step in range(1, width)])
        )

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) <= width, F.lit(0)).otherwise(let(let(hashes, windows), counted))


def measure(docs: DataFrame, stop_words=STOP_WORDS) -> DataFrame:
    """Per row of ``docs`` (text, anything else): the whole ``row`` and its counts."""
    # Texts are read once for words and once for lines; every count starts from these.
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    parts = docs.select(F.struct("*").alias("row")).select(
        "row",
        F.filter(F.split(text, WHITE, -1), lambda w: w != "").alias("_words"),
        F.filter(F.split(text, "\n", -1), lambda line: F.rlike(line, F.lit(WORDY))).alias("_lines"),
    )
    words, lines = F.col("_words"), F.col("_lines")
    # Lower case touches other letters than A-Z too; none of them turns a word into a stop word.
    stops = F.filter(words, lambda w: F.lower(w).isin(list(stop_words)))
    counts = {
        "n_words": F.size(words),
        "word_chars": F.length(F.array_join(words, "")),
        "n_symbols": F.length(text) - F.length(F.translate(text, SYMBOLS, "")),
        "n_letter_words": F.size(F.filter(words, lambda w: F.translate(w, NOT_LETTERS, "") != "")),
        "n_stop_words": F.size(stops) if stop_words else F.lit(0),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_list_lines": F.size(F.filter(lines, lambda line: F.rlike(line, F.lit(r"^[ \t]*[-*•]")))),
        "n_cut_lines": F.size(F.filter(lines, lambda line: F.rlike(line, F.lit(r"(\.\.\.|…)[ \t\r]*$")))),
        "n_repeat_words": repeats(words),
    }
    return parts.select("row", *[value.cast("long").alias(name) for name, value in counts.items()])


def failing(rule: Rule) -> Column:
    """The condition of one rule; a ratio over nothing fails nothing."""
    scale = 100 if rule.whole else 1
    part, whole = F.col(rule.part) * scale, F.col(rule.whole) if rule.whole else F.lit(1)
    fails = F.lit(False)
    if rule.least is not None:
        fails = fails | (part < rule.least * whole)
    if rule.most is not None:
        fails = fails | (part > rule.most * whole)
    return fails & (whole > 0) if rule.whole else fails


def judge(docs: DataFrame, rules=RULES, stop_words=STOP_WORDS) -> DataFrame:
    """Per row of ``docs``: ``row``, all counts, the names of the rules that ``failed``, and ``kept``."""
    measured = measure(docs, stop_words)
    names = [F.when(failing(rule), F.lit(rule.name)) for rule in rules]
    failed = F.array_compact(F.array(*names)) if names else F.array().cast("array<string>")
    return measured.select("*", failed.alias("failed")).withColumn("kept", F.size("failed") == 0)


def keep(docs: DataFrame, rules=RULES) -> DataFrame:
    """The rows of ``docs`` that no rule fails, with their own columns."""
    return judge(docs, rules).filter("kept").select("row.*")
