"""PII: base expressions, and bootstrapped contextual extraction of identifiers they do not know.

All on DataFrame functions. Each text is scanned once by a project over the documents:

* Matches of an expression are ``regexp_extract_all``, the text between them ``split``; running
  lengths of both give the places, in code points.
* Base matches that pass their kind's test are seeds. Every other token with an at sign or with
  ``least_digits`` digits is a candidate, and so is a whole run of digit groups joined by spaces,
  dots, hyphens or parentheses that has as many; of a run that holds seeds, the pieces between them
  are. The two words of the text before a seed or candidate, whatever they are, are a lexical pattern.

Spark then scores the graph of patterns and instances for ``rounds`` rounds. An instance is known for a
kind if it is a seed, or if a pattern trusted in the round before precedes it. Contexts of at least
``least_seeds`` distinct known instances are patterns, so that what one round discovers induces the
patterns of the next. A pattern's score for a kind is the mean confidence of its distinct
instances; a candidate's confidence is a noisy-or of its patterns' scores; seeds stay at 1. A pattern
is trusted from ``least_score`` on. Those trusted in the last round add the candidates that follow
them. Base spans stay as they are.

What is kept of a document between the steps (spans and candidates, no text) is checkpointed, so
that no step scans texts again. Long texts are no special case: places come from running sums in
blocks of ``BLOCK`` matches.

Nulls and edge cases: a null or empty text has no spans. Rows are told apart by id and text, so
rows that repeat both get the same spans; a null id is an id. An empty table gives an empty
result. Other columns are not looked at by ``find`` and pass untouched through ``redact``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetvault.llm.state import checkpointed, let

KINDS = ("email", "ip", "card", "phone")
# A run of characters is tried from its beginning only, or from the end of the last match; its
# inner characters cannot begin a match when its beginning cannot.
LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "phone": "+"}
# Tokens of digits and joints; the last may have closing marks behind it.
GROUP = r"[0-9][0-9().-]*+(?=[\"'\]}>,;:!?]*+(?!\S))"
RUN = rf"[(+]*+{GROUP}(?:\x20[\x20().-]*+{GROUP})++"
TOKEN = rf"(?<!\S)(?:{RUN}|[^\s0-9@]*+[0-9@]\S*+)"
# An opening parenthesis that closes within the number belongs to it.
BEFORE = r"^(?:[\"'\[{<]|\((?![0-9]+\)[\x20().-]*[0-9]))+"
BEHIND = r"[\"')\]}>.,;:!?]+$"
LEAST_DIGITS = 6  # of a candidate without an at sign, unless find is told otherwise
BLOCK = 256
LABELS = {kind: f"[{kind.upper()}]" for kind in KINDS}
SPAN = "struct<kind:string,start:bigint,end:bigint>"


def _luhn(digits: Column) -> Column:
    """Whether a text of digits has the check digit that its other digits ask for."""
    turned = F.reverse(digits)
    values = F.transform(
        F.sequence(F.lit(1), F.length(digits)),
        lambda i: F.struct(i.alias("i"), F.substring(turned, i, F.lit(1)).cast("int").alias("d")),
    )
    doubled = F.transform(values, lambda v: F.when(v.i % 2 == 1, v.d).when(v.d > 4, v.d * 2 - 9).otherwise(v.d * 2))
    return F.aggregate(doubled, F.lit(0), lambda total, d: total + d) % 10 == 0


def passes(kind: str, match: Column) -> Column:
    """The test of a kind beyond its expression."""
    if kind == "ip":
        part = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(part, lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255))
    if kind == "card":
        digits = F.translate(match, " -", "")
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(F.translate(match, "+ ().-", "")).between(10, 15)
    return F.lit(True)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda total, v: total + v)


def _running(lengths: Column) -> Column:
    """Running sums of a non-empty array, in blocks so that a long array is not squared."""
    blocks = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int"))
    sums = F.transform(blocks, lambda b: _sum(F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK))))
    before = let(sums, lambda s: F.transform(s, lambda _, b: _sum(F.slice(s, F.lit(1), b))))
    return let(
        before,
        lambda s: F.transform(
            lengths,
            lambda _, i: F.get(s, F.floor(i / BLOCK).cast("int"))
            + _sum(F.slice(lengths, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK + 1)),
        ),
    )


def _matches(df: DataFrame, pattern: str, needs: str | None) -> DataFrame:
    """Add ``_m``, the matches of a pattern in ``_text`` with their end and context."""
    text = F.col("_text")
    none = F.array().cast("array<string>")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    df = df.withColumn("_found", F.when(F.contains(text, F.lit(needs)), found).otherwise(none) if needs else found)
    some = F.size("_found") > 0
    df = df.withColumn("_gaps", F.when(some, F.split(text, pattern, -1)).otherwise(none))
    lengths = F.transform("_found", lambda m, i: (F.length(m) + F.length(F.get("_gaps", i))).cast("long"))
    df = df.withColumn("_lengths", lengths)
    df = df.withColumn("_ends", F.when(some, _running(F.col("_lengths"))).otherwise(F.array().cast("array<bigint>")))
    # Matches begin and end with a word's characters, so the spaces up to a match number its word.
    spaces = F.transform("_found", lambda m, i: (_spaces(m) + _spaces(F.get("_gaps", i))).cast("long"))
    df = df.withColumn("_spaces", spaces)
    df = df.withColumn("_at", F.when(some, _running(F.col("_spaces"))).otherwise(F.array().cast("array<bigint>")))
    made = F.transform(
        "_found",
        lambda m, i: F.struct(
            (F.get("_ends", i) - F.length(m)).alias("start"),
            F.get("_ends", i).alias("end"),
            m.alias("value"),
            F.when(
                F.rlike(F.right(F.get("_gaps", i), F.lit(1)), F.lit(r"\s")), (F.get("_at", i) - _spaces(m)).cast("int")
            ).alias("word"),
        ),
    )
    return df.withColumn("_m", made).drop("_found", "_gaps", "_lengths", "_ends", "_spaces", "_at")


def _spaces(text: Column) -> Column:
    """How many runs of white space a text has."""
    return F.size(F.split(text, r"\s+", -1)) - 1


def _context(word: Column) -> Column:
    """The two words of the text before that of this number, or an empty text."""
    first, second = F.get("_words", word - 2), F.get("_words", word - 1)
    return F.when((first != "") & (second != ""), F.lower(F.concat(first, F.lit(" "), second))).otherwise("")


def _between(run: Column) -> Column:
    """Pieces of a run of digit groups between the seeds in it; nothing of another match with a seed."""
    inner = F.filter("seeds", lambda s: (s.start < run.end) & (run.start < s.end))

    def pieces(found: Column) -> Column:
        def piece(i: Column) -> Column:
            begin = F.when(i > 0, F.get(found, i - 1).end).otherwise(run.start)
            end = F.when(i < F.size(found), F.get(found, i).start).otherwise(run.end)
            skipped = (begin - run.start).cast("int")
            part = F.substring(run.value, skipped + 1, F.greatest(end - begin, F.lit(0)).cast("int"))
            front = F.length(F.regexp_extract(part, r"^[\x20).-]+", 0))
            value = F.regexp_replace(F.regexp_replace(part, r"[\x20(.-]+$", ""), r"^[\x20).-]+", "")
            ahead = F.substring(run.value, F.lit(1), skipped + front)
            return F.struct(
                (begin + front).alias("start"),
                (begin + front + F.length(value)).alias("end"),
                value.alias("value"),
                F.when((ahead == "") | F.endswith(ahead, F.lit(" ")), run.word + _spaces(ahead)).alias("word"),
            )

        return F.transform(F.sequence(F.lit(0), F.size(found)), piece)

    cut = let(F.array_sort(inner), pieces)
    none = F.array().cast("array<struct<start:bigint,end:bigint,value:string,word:int>>")
    return F.when(F.size(inner) == 0, F.array(run)).when(F.contains(run.value, F.lit(" ")), cut).otherwise(none)


def _scan(docs: DataFrame, least_digits: int = LEAST_DIGITS) -> DataFrame:
    """Per row: doc_id, key, the seeds of each kind, and candidates that overlap no seed."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key(docs).alias("key"), text.alias("_text"))
    df = df.withColumn("_words", F.split("_text", r"\s+", -1))
    for kind in KINDS:
        df = _matches(df, PATTERNS[kind], NEEDS.get(kind))
        good = F.filter("_m", lambda m: passes(kind, m.value))
        seeds = lambda m: F.struct(
            m.start.alias("start"),
            m.end.alias("end"),
            m.value.alias("value"),
            _context(m.word).alias("context"),
            F.lit(kind).alias("kind"),  # noqa: B023
        )
        df = df.withColumn(kind, F.transform(good, seeds)).drop("_m")
    df = _matches(df, TOKEN, None).withColumn("seeds", F.concat(*KINDS)).drop(*KINDS, "_text")
    front = lambda m: F.length(F.regexp_extract(m.value, BEFORE, 0))
    back = lambda m: F.length(F.regexp_extract(m.value, BEHIND, 0))
    df = df.withColumn("_m", F.flatten(F.transform("_m", _between)))
    trimmed = F.transform(
        "_m",
        lambda m: F.struct(
            (m.start + front(m)).alias("start"),
            (m.end - back(m)).alias("end"),
            F.lower(F.regexp_replace(F.regexp_replace(m.value, BEHIND, ""), BEFORE, "")).alias("value"),
            _context(m.word).alias("context"),
        ),
    )
    wanted = lambda c: (c.context != "") & (
        F.contains(c.value, F.lit("@")) | (F.length(F.regexp_replace(c.value, "[^0-9]+", "")) >= least_digits)
    )
    df = df.withColumn("_c", F.filter(trimmed, wanted))
    apart = F.filter("_c", lambda c: ~F.exists("seeds", lambda s: (s.start < c.end) & (c.start < s.end)))
    return df.select("doc_id", "key", "seeds", apart.alias("candidates"))


def key(docs: DataFrame) -> Column:
    """What tells rows apart: their id and text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return F.struct(F.xxhash64("doc_id", text).alias("a"), F.hash(text, "doc_id").alias("b"))


def patterns(scanned: DataFrame, rounds: int, least_score: float, least_seeds: int) -> DataFrame:
    """Patterns to trust: context, kind, score. The graph of patterns and instances, scored in rounds."""
    seen = scanned.select(F.explode("seeds").alias("s")).filter("s.context <> ''")
    seeds = seen.select("s.context", F.lower("s.value").alias("value"), "s.kind").distinct()
    found = scanned.select(F.explode("candidates").alias("c")).select("c.context", "c.value")
    edges = seeds.select("context", "value").union(found).distinct()
    # A context of fewer instances can never be a pattern.
    sizes = edges.groupBy("context").agg(F.count("*").alias("size")).filter(F.col("size") >= least_seeds)
    edges = checkpointed(edges.join(sizes, "context"))
    fixed = seeds.select("value", "kind").distinct()
    fixed = checkpointed(fixed.withColumns({"sure": F.lit(1.0), "known": F.lit(True)}))
    sure = fixed
    for turn in range(rounds):
        scores = edges.join(sure, "value").groupBy("context", "kind").agg(
            F.least(F.sum("sure") / F.first("size"), F.lit(1.0)).alias("score"), F.count_if("known").alias("support")
        )
        scores = scores.filter(F.col("support") >= least_seeds).select("context", "kind", "score")
        if turn + 1 < rounds:
            doubt = F.exp(F.sum(F.log(F.lit(1.000001) - F.col("score"))))
            known = F.max("score") >= least_score
            guessed = edges.join(scores, "context").groupBy("value", "kind").agg(
                (1 - doubt).alias("sure"), known.alias("known")
            )
            sure = guessed.join(fixed, ["value", "kind"], "left_anti").union(fixed)
    order = F.struct("score", *[(F.col("kind") == k).alias(k) for k in KINDS], "kind")
    best = scores.filter(F.col("score") >= least_score).groupBy("context").agg(F.max(order).alias("best"))
    return best.select("context", "best.kind", "best.score")


def find(
    docs: DataFrame,
    rounds: int = 6,
    least_score: float = 0.8,
    least_seeds: int = 3,
    least_digits: int = LEAST_DIGITS,
) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, key, base and added spans (kind, start, end)."""
    if rounds < 1:
        raise ValueError("rounds must be positive")
    scanned = checkpointed(_scan(docs, least_digits))
    trusted = patterns(scanned, rounds, least_score, least_seeds)
    places = scanned.select("key", F.explode("candidates").alias("c")).select("key", "c.start", "c.end", "c.context")
    added = places.join(trusted, "context").groupBy("key").agg(F.collect_set(F.struct("kind", "start", "end")).alias("added"))
    joined = scanned.join(added, "key", "left")
    base = F.transform("seeds", lambda s: F.struct(s.kind.alias("kind"), s.start.alias("start"), s.end.alias("end")))
    return joined.select(
        "doc_id", "key", base.alias("base"), F.coalesce("added", F.array().cast(f"array<{SPAN}>")).alias("added")
    )


def in_order(spans: Column) -> Column:
    """Spans by start, then by kind as listed."""
    rank = lambda k: F.array_position(F.array(*map(F.lit, KINDS)), k)
    keyed = F.transform(
        spans, lambda s: F.struct(s.start.alias("a"), rank(s.kind).alias("b"), s.end.alias("c"), s.kind.alias("d"))
    )
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s.d.alias("kind"), s.a.alias("start"), s.c.alias("end")))


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(in_order(spans), lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def redact(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by the label of its kind.

    Spans that overlap or touch become one, with the label of the first.
    """
    spans = find(docs, **options).select("key", in_order(F.concat("base", "added")).alias("spans"))
    spans = spans.filter(F.size("spans") > 0).groupBy("key").agg(F.first("spans").alias("spans"))
    packed = docs.select(F.struct("*").alias("row"), key(docs).alias("key"))
    joined = packed.join(spans, "key", "left").withColumn("text", F.col("row.text").cast("string"))
    empty = F.array().cast(f"array<{SPAN}>")
    last = lambda done: F.get(done, F.size(done) - 1)
    merged = F.aggregate(
        "spans",
        empty,
        lambda done, s: F.when(
            (F.size(done) > 0) & (last(done).end >= s.start),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(last(done).withField("end", F.greatest(last(done).end, s.end))),
            ),
        ).otherwise(F.concat(done, F.array(s))),
    )
    joined = joined.withColumn("merged", F.when(F.col("spans").isNotNull(), merged))
    labels = F.create_map(*[F.lit(x) for k in KINDS for x in (k, LABELS[k])])
    begin = lambda i: F.when(i > 0, F.get("merged", i - 1).end).otherwise(0).cast("int")
    pieces = F.transform(
        "merged",
        lambda s, i: F.concat(
            F.substring("text", begin(i) + 1, s.start.cast("int") - begin(i)), F.element_at(labels, s.kind)
        ),
    )
    rest = F.substring("text", F.element_at("merged", -1).end.cast("int") + 1, F.length("text"))
    cleaned = F.when(F.col("merged").isNotNull(), F.concat(F.array_join(pieces, ""), rest)).otherwise(F.col("text"))
    return joined.withColumn("text", cleaned).select(
        *[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]
    )
