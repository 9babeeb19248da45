"""N-gram Jaccard join: documents whose sets of word shingles overlap by ``percent`` or more.

A grouped prefix join, exact at any size:

* **Order.** Sketches of fixed size count shingles and words over all documents. Shingles are ordered by
  the power of two of what a slot counts beyond the usual slot, then by how common their words are, rare
  ones first, then by hash. Any order gives the same links; this one keeps shared passages out of
  prefixes, and words still tell rare shingles when every slot of the shingles is full.
* **Classes.** Documents of equal sets are one class.
* **Groups.** Classes of the same prefix and set size are one group, and only groups are posted
  under their prefix's shingles. Of lists that hold the very same groups one is kept.
* **Stars.** In each shingle's list the groups of similar size are paired with one centre, the one
  whose shingles are best known, not with each other, and the members of a group with its first
  member. Pairs are filtered by size, place in the prefix and a parity signature (bits of the
  signatures that differ are at most the elements that differ), and the rest verified on whole
  sets. The links make components.
* **Rest.** Only where a list or group still spans several components are groups expanded and
  members of different components paired, filtered in the same way while they are joined, and
  verified.

So a group of copies costs about a pair per copy, and no link between components is missed. Links
are joined to components by smallest labels with shortcuts, in slim tables that are checkpointed.
Shingles and classes are told apart by hashes of 64 and 128 bits.

Nulls and edge cases: a null or empty text, or one without words, has no shingles and links with
nothing; its component is itself. With fewer words than a shingle, the whole text is one. A row
without id links with nothing and has no component. Rows that share an id are separate documents.
Other columns are not looked at by ``components`` and pass untouched through ``keep_first``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetvault.llm import tokens
from fleetvault.llm.state import checkpointed

SLICE_BYTES = 2 << 20
SKETCH_BITS = 20
SKETCH_PARTS = 16
WORD_STEPS = 4  # a word's level is its count's logarithm in quarters of a power of two
TOKEN_BITS = 48
MOST_BROADCAST = 1_000_000
LOOK_BACK = 4
DESCRIBED = "doc_id long, key long, n int, class binary, grp long, prefix array<long>, sig array<long>"
MIX_A, MIX_B, MIX_C = (np.uint64(x) for x in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F))


def sets(texts, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all texts, text by text and sorted, and where each text's begin."""
    words = tokens.cut(texts, tokens.WHITE, lower=True)
    hashed = tokens.hashes(words)
    return _shingles(words, hashed, np.zeros(len(hashed), np.int64), width)[:2]


def _shingles(words: tokens.Words, hashed: np.ndarray, levels: np.ndarray, width: int):
    """Of words with these hashes and levels: what ``sets`` returns, and each shingle's sum of levels."""
    counts = words.counts
    total = np.concatenate([[0], np.cumsum(levels, dtype=np.int64)])
    owner, values, sums = [], [], []
    for size in range(1, width + 1):
        # Texts of fewer words than a shingle are one whole sequence.
        of = (counts >= width) if size == width else (counts == size)
        starts = tokens.window_starts(words.first, size)
        text = np.repeat(np.arange(len(counts)), np.maximum(counts - size + 1, 0))
        chosen = of[text]
        if chosen.any():
            begin = starts[chosen]
            owner.append(text[chosen])
            values.append(tokens.rolling(hashed, size)[begin])
            sums.append(total[begin + size] - total[begin])
    if not owner:
        return np.zeros(0, np.uint64), np.zeros(len(counts) + 1, np.int64), np.zeros(0, np.int64)
    text, value, common = np.concatenate(owner), np.concatenate(values), np.concatenate(sums)
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.ones(len(text), bool)
    new[1:] = (np.diff(text) != 0) | (value[1:] != value[:-1])
    text, value, common = text[new], value[new], common[order[new]]
    return value, np.searchsorted(text, np.arange(len(counts) + 1)), common


def prefix_sizes(n: np.ndarray, percent: int) -> np.ndarray:
    return np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of runs; an empty run's is 0."""
    whole = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return whole[first[1:]] - whole[first[:-1]]


def classes_of(value: np.ndarray, first: np.ndarray) -> list[bytes]:
    """A 128-bit name of each set."""
    size = np.diff(first).astype(np.uint64)
    a = tokens.mix(_sums(tokens.mix(value ^ MIX_A), first) + size)
    b = tokens.mix(_sums(tokens.mix(value ^ MIX_B), first) + size)
    both = np.stack([a, b], axis=1).tobytes()
    return [both[i : i + 16] for i in range(0, len(both), 16)]


def _signatures(value: np.ndarray, first: np.ndarray) -> pa.ListArray:
    """Parities of elements by slot: two sets' signatures differ in no more bits than the sets.

    A set of n elements has as many slots as the next power of two, 64 or more, so that a signature is
    a sixty-fourth of its set and sets that are not alike differ in far more bits than links may.
    """
    n = np.diff(first)
    bits = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    edges = np.concatenate([[0], np.cumsum(bits)])
    slot = tokens.mix(value ^ MIX_C) & np.repeat(bits - 1, n).astype(np.uint64)
    odd = np.bincount(np.repeat(edges[:-1], n) + slot.astype(np.int64), minlength=int(edges[-1])) & 1
    packed = np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)
    return pa.ListArray.from_arrays(pa.array(edges // 64, pa.int32()), pa.array(packed))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator:
    for batch in batches:
        yield from tokens.slices(batch, "text", SLICE_BYTES)


def _parts(batches: Iterator[pa.RecordBatch], width: int):
    for part in _slices(batches):
        yield part, *sets(part["text"], width)


def _slots(value: np.ndarray, slots: int) -> np.ndarray:
    return (value % np.uint64(slots)).astype(np.int64)


def sketch(docs: DataFrame, width: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Levels of the 2**bits slots of shingles and of words, counted over all documents.

    A shingle's is the power of two of its slot's count beyond the median, of which chance gives no
    more than three deviations; a word's is the logarithm of its slot's count.
    """
    slots = 1 << bits

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, slots), np.uint64)
        for part in _slices(batches):
            words = tokens.cut(part["text"], tokens.WHITE, lower=True)
            hashed = tokens.hashes(words)
            value = _shingles(words, hashed, np.zeros(len(hashed), np.int64), width)[0]
            for own, seen in zip(counts, (value, hashed)):
                own += np.bincount(_slots(seen, slots), minlength=slots).astype(np.uint64)
        packed = [[tokens.pack(p) for p in own.reshape(SKETCH_PARTS, -1)] for own in counts]
        columns = [pa.array(range(SKETCH_PARTS), pa.int32()), *map(pa.array, packed)]
        yield pa.RecordBatch.from_arrays(columns, ["part", "shingles", "words"])

    def total(table: pa.Table) -> pa.Table:
        shingles, words = (
            sum(tokens.unpack(p, np.uint64) for p in table[c].to_pylist()).astype(np.float64) for c in ("shingles", "words")
        )
        usual = np.median(shingles)
        beyond = np.maximum(shingles - usual - 3 * np.sqrt(usual), 0)
        levels = np.floor(np.log2(beyond + 1)), np.rint(WORD_STEPS * np.log2(words + 1))
        packed = [pa.array([level.astype(np.uint8).tobytes()], pa.binary()) for level in levels]
        return pa.table({"part": table["part"].slice(0, 1), "shingles": packed[0], "words": packed[1]})

    tallied = docs.select("text").mapInArrow(tally, "part int, shingles binary, words binary")
    rows = tallied.groupBy("part").applyInArrow(total, "part int, shingles binary, words binary").toArrow().sort_by("part")
    found = [b"".join(rows[c].to_pylist()) for c in ("shingles", "words")]
    return tuple(np.frombuffer(f, np.uint8) if f else np.zeros(slots, np.uint8) for f in found)


def describe(docs: DataFrame, width: int, percent: int, levels) -> DataFrame:
    """Per row with an id: set size, class, group, prefix in the common order, signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level_of, word_level = levels.value
        for part in _slices(batches):
            words = tokens.cut(part["text"], tokens.WHITE, lower=True)
            hashed = tokens.hashes(words)
            value, first, common = _shingles(words, hashed, word_level[_slots(hashed, len(word_level))], width)
            n = np.diff(first)
            text = np.repeat(np.arange(len(n)), n)
            level = level_of[_slots(value, len(level_of))]
            ordered = value[np.lexsort((value, common, level, text))]
            sizes = prefix_sizes(n, percent)
            edges = np.concatenate([[0], np.cumsum(sizes)])
            at = np.repeat(first[:-1] - edges[:-1], sizes) + np.arange(edges[-1])
            prefix = ordered[at]
            group = tokens.mix(_sums(tokens.mix(prefix ^ MIX_B), edges) + n.astype(np.uint64))
            # Lists are only looked up by prefix elements; shorter ones cost a few more candidates.
            prefix = prefix >> np.uint64(64 - TOKEN_BITS)
            yield pa.RecordBatch.from_arrays(
                [
                    *(part[c] if isinstance(part[c], pa.Array) else part[c].combine_chunks() for c in ("doc_id", "key")),
                    pa.array(n, pa.int32()),
                    pa.array(classes_of(value, first), pa.binary()),
                    pa.array(group.view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(prefix.view(np.int64))),
                    _signatures(value, first),
                ],
                ["doc_id", "key", "n", "class", "grp", "prefix", "sig"],
            )

    return docs.mapInArrow(run, DESCRIBED)


def similar_size(n: Column, m: Column, percent: int) -> Column:
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def most_different(n: Column, m: Column, percent: int) -> Column:
    """Elements in one set only that two linked sets have at most."""
    common = F.ceil(percent * (n + m) / F.lit(100 + percent))
    return n + m - 2 * common


def _in_reach(pos: Column, n: Column, other_pos: Column, m: Column, percent: int) -> Column:
    """Whether sets that share the elements at these places of their order can still be linked."""
    after = F.least(n - pos, m - other_pos)
    skipped = F.least(pos, other_pos)
    return n + m - 2 * (after + skipped) <= most_different(n, m, percent)


def _alike(n: Column, sig: Column, m: Column, other: Column, percent: int) -> Column:
    """Whether sizes and signatures of two sets allow a link."""
    size = F.least(F.size(sig), F.size(other))

    def folded(whole: Column) -> Column:
        """The signature of half as many slots: its halves, one upon the other."""
        halves = F.transform(F.slice(whole, F.lit(1), size), lambda v, i: v.bitwiseXOR(F.get(whole, i + size)))
        return F.when(F.size(whole) > size, halves).otherwise(whole)

    bits = F.zip_with(folded(sig), folded(other), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    differ = F.aggregate(bits, F.lit(0), lambda total, b: total + b)
    return F.when(similar_size(n, m, percent), differ <= most_different(n, m, percent)).otherwise(False)


def _filtered(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes whose sizes and signatures allow a link."""
    a = classes.select(F.col("class").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("s_a"))
    b = classes.select(F.col("class").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("s_b"))
    alike = _alike(F.col("n_a"), F.col("s_a"), F.col("n_b"), F.col("s_b"), percent)
    return pairs.join(a, "a").join(b, "b").filter(alike).select("a", "b")


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs that are links, by the sets of one document of each class."""
    pairs = checkpointed(pairs)
    ends = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
    wanted = checkpointed(classes.join(ends, "class", "left_semi").select(F.col("id").alias("doc_id")).distinct())
    few = wanted.count() <= MOST_BROADCAST  # 8 bytes each
    chosen = docs.join(F.broadcast(wanted) if few else wanted, "doc_id", "left_semi")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, value, first in _parts(batches, width):
            steps = np.diff(value, prepend=np.uint64(0))
            steps[first[:-1][np.diff(first) > 0]] = value[first[:-1][np.diff(first) > 0]]
            items = [tokens.pack(steps[i:j]) for i, j in zip(first, first[1:])]
            names = pa.array(classes_of(value, first), pa.binary())
            yield pa.RecordBatch.from_arrays([names, pa.array(items, pa.binary())], ["class", "items"])

    def unpack(items) -> np.ndarray:
        return np.cumsum(tokens.unpack(items.as_py(), np.uint64), dtype=np.uint64)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for left, right in zip(batch["x"], batch["y"]):
                x, y = unpack(left), unpack(right)
                common = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.filter(pa.array(good, pa.bool_())).select(["a", "b"])

    found = chosen.mapInArrow(pack, "class binary, items binary").join(ends, "class", "left_semi")
    found = found.dropDuplicates(["class"])
    left = found.select(F.col("class").alias("a"), F.col("items").alias("x"))
    right = found.select(F.col("class").alias("b"), F.col("items").alias("y"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(check, "a binary, b binary")


def connected(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Smallest label (id, class) that each linked class (class, id) reaches: class, label.

    Each round takes the smallest label among neighbours and then follows it once, so long
    chains halve. Ends when a round changes nothing.
    """
    both = checkpointed(links.select("a", "b").union(links.select("b", "a")).distinct())
    own = nodes.select(F.col("class"), F.struct("id", "class").alias("label"))
    labels = checkpointed(own.join(both.select(F.col("a").alias("class")).distinct(), "class", "left_semi"))
    while True:
        heard = both.join(labels, both["a"] == labels["class"]).groupBy(F.col("b").alias("class"))
        heard = heard.agg(F.min("label").alias("heard"))
        nearer = labels.join(heard, "class")
        nearer = checkpointed(nearer.select("class", F.col("label").alias("old"), F.least("label", "heard").alias("new")))
        ahead = nearer.select(F.col("class").alias("at"), F.col("new").alias("ahead"))
        moved = nearer.join(ahead, nearer["new"]["class"] == ahead["at"]).select(
            "class", "old", F.least("new", "ahead").alias("label")
        )
        moved = checkpointed(moved)
        labels = moved.select("class", "label")
        if moved.filter("label <> old").isEmpty():
            return labels


def components(docs: DataFrame, width: int = 3, percent: int = 90, sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles and component_id, the smallest id that
    links lead to."""
    described, classes = _judged(docs, width, percent, sketch_bits)
    component = F.when(F.col("n") > 0, F.coalesce("label.id", "id")).otherwise(F.col("doc_id"))
    return described.select("doc_id", "n", "class").join(classes, "class", "left").select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
    )


def _text_key() -> Column:
    """Tells the texts of one id apart."""
    return F.xxhash64(F.col("text").cast("string"), F.col("text").isNull())


def _judged(docs: DataFrame, width: int, percent: int, sketch_bits: int) -> tuple[DataFrame, DataFrame]:
    """Rows as described, and per class its smallest id, the first row with it, and the label if linked."""
    if not 1 <= percent <= 100 or width < 1:
        raise ValueError("percent must be from 1 to 100, width positive")
    text = F.col("text").cast("string").alias("text")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_key().alias("key"), text)
    levels = docs.sparkSession.sparkContext.broadcast(sketch(docs, width, sketch_bits))
    described = checkpointed(describe(docs, width, percent, levels))
    able = described.filter("doc_id is not null and n > 0")
    classes = able.groupBy("class").agg(
        F.min(F.struct("doc_id", "key")).alias("first"), *[F.first(c).alias(c) for c in ("n", "grp", "sig")]
    )
    classes = checkpointed(classes.withColumn("id", F.col("first.doc_id")))
    groups = able.groupBy("grp", "n").agg(F.min("class").alias("head"), F.first("prefix").alias("prefix"))
    heads = checkpointed(able.groupBy("grp", "n").agg(F.min("class").alias("head")))
    posted = groups.select("grp", "n", F.posexplode("prefix").alias("pos", "token"))
    # Only tokens that several groups share matter. A group's number covers its size.
    several = posted.groupBy("token").agg(
        F.min("grp").alias("least"), F.max("grp").alias("most"), F.count("*").alias("others"), F.sum("pos").alias("at"),
        *[F.bit_xor(F.xxhash64("grp", "n", F.lit(salt))).alias(f"groups{salt}") for salt in (1, 2)],
    ).filter("least <> most")
    # A passage gives many lists of the very same groups. One of them says it all: the first in the
    # common order, which is the first in each of its groups.
    several = several.groupBy("others", "groups1", "groups2").agg(
        F.min(F.struct("at", "token")).alias("first"), F.count("*").alias("lists")
    )
    several = several.select("first.token", "others", "lists")
    shared = checkpointed(posted.join(several, "token"))
    # Lists hold groups of similar size. The centre of a list is the group whose elements most other
    # groups have: what copies were made from, or the least changed of them, rather than any.
    band = _band(F.col("n"), percent)
    known = shared.groupBy("grp", "n").agg(F.sum(F.col("others") * F.col("lists")).alias("known"))
    ranked = shared.join(known, ["grp", "n"]).withColumn("band", band)
    centres = ranked.groupBy("token", "band").agg(F.max(F.struct("known", "grp", "n", "pos")).alias("c"))
    listed = shared.withColumn("band", band).join(centres, ["token", "band"]).filter("grp <> c.grp")
    reach = _in_reach(F.col("pos"), F.col("n"), F.col("c.pos"), F.col("c.n"), percent)
    listed = listed.filter(similar_size(F.col("n"), F.col("c.n"), percent) & reach)
    stars = listed.select("grp", "n", F.col("c.grp").alias("c_grp"), F.col("c.n").alias("c_n")).distinct()
    stars = stars.join(heads.withColumnRenamed("head", "b"), ["grp", "n"])
    centre = heads.select(F.col("grp").alias("c_grp"), F.col("n").alias("c_n"), F.col("head").alias("a"))
    stars = stars.join(centre, ["c_grp", "c_n"]).select("a", "b")
    members = classes.select("class", "grp", "n").join(heads, ["grp", "n"])
    inside = members.filter("class <> head").select(F.col("head").alias("a"), F.col("class").alias("b"))
    tried = checkpointed(stars.union(inside).distinct())
    slim = classes.select("class", "id", "n", "sig")
    links = checkpointed(_verified(_filtered(tried, slim, percent), docs, slim, width, percent))
    labels = connected(slim, links)
    rest = _rest(classes, shared, labels, tried, percent)
    more = _verified(rest, docs, slim, width, percent)
    labels = connected(slim, links.union(more))
    return described, classes.select("class", "id", "first").join(labels, "class", "left")


def _rest(classes: DataFrame, shared: DataFrame, labels: DataFrame, tried: DataFrame, percent: int) -> DataFrame:
    """Untried pairs of classes of different components, in lists or groups that span several.

    Sizes, places and signatures are conditions of the join that finds the pairs, so that of a
    large list only pairs that may be links come out.
    """
    own = classes.select("class", "grp", "n", "sig").join(labels, "class", "left")
    member = own.select("class", "grp", "n", "sig", F.coalesce("label.class", "class").alias("part"))
    member = checkpointed(member)
    spans = member.groupBy("grp", "n").agg(
        F.min("part").alias("first"), F.max("part").alias("last"), F.count("*").alias("members")
    )
    wide = spans.filter("first <> last").select("grp", "n")
    within = _across(member.join(wide, ["grp", "n"], "left_semi"), "grp", percent, placed=False)
    lists = shared.join(spans, ["grp", "n"]).groupBy("token").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.max("members").alias("members"),
        F.max("others").alias("others"), F.min("n").alias("least"), F.max("n").alias("most"),
    )
    # Two classes of similar size have been tried with each other as a list and its centre.
    done = (F.col("others") == 2) & (F.col("members") == 1)
    done &= _band(F.col("least"), percent) == _band(F.col("most"), percent)
    open_ = lists.filter((F.col("first") != F.col("last")) & ~done).select("token")
    # Which of these lists come shortly before this one in the same prefix.
    prefix = Window.partitionBy("grp", "n").orderBy("pos")
    earlier = F.array_compact(F.array(*[F.lag("token", k).over(prefix) for k in range(1, LOOK_BACK + 1)]))
    listed = shared.join(open_, "token", "left_semi").select("token", "pos", "grp", "n")
    listed = listed.withColumn("earlier", earlier).join(member, ["grp", "n"])
    across = _across(listed.drop("grp"), "token", percent, placed=True)
    known = tried.union(tried.select("b", "a"))
    return within.union(across).distinct().join(known, ["a", "b"], "left_anti")


def _band(n: Column, percent: int) -> Column:
    """Sets of one band are of similar size."""
    return F.floor(F.log(n) / F.log(F.lit(100 / percent))) if percent < 100 else n.cast("long")


def _across(rows: DataFrame, on: str, percent: int, placed: bool) -> DataFrame:
    """Pairs of classes that share ``on``, belong to different components and may be links.

    A pair meets in every list that both are in. It comes out of the first one, and not of one
    shortly after another one that both are in.
    """
    left, right = rows.alias("l"), rows.alias("r")
    n, m = F.col("l.n"), F.col("r.n")
    wanted = (F.col(f"l.{on}") == F.col(f"r.{on}")) & (F.col("l.part") < F.col("r.part"))
    if placed:
        wanted &= similar_size(n, m, percent) & _in_reach(F.col("l.pos"), n, F.col("r.pos"), m, percent)
        wanted &= ~F.arrays_overlap("l.earlier", "r.earlier")
    wanted &= _alike(n, F.col("l.sig"), m, F.col("r.sig"), percent)
    a, b = F.least("l.class", "r.class"), F.greatest("l.class", "r.class")
    return left.join(right, wanted).select(a.alias("a"), b.alias("b"))


def keep_first(
    docs: DataFrame, width: int = 3, percent: int = 90, sketch_bits: int = SKETCH_BITS
) -> DataFrame:
    """One row of ``docs`` per component: one with the smallest id.

    Rows without id stay, and so do texts without shingles; rows that repeat id and text count once.
    Of rows that share an id, each stays or goes by its own text.
    """
    described, classes = _judged(docs, width, percent, sketch_bits)
    own = classes.filter("label IS NULL OR label.class = class").select("first.doc_id", "first.key")
    bare = described.filter("n = 0 AND doc_id IS NOT NULL").select("doc_id", "key")
    kept = own.unionByName(bare).distinct().toDF("_kept", "_key")
    named = docs.filter("doc_id is not null")
    same = (named["doc_id"].cast("long") == kept["_kept"]) & (_text_key() == kept["_key"])
    found = named.join(kept, same, "left_semi")
    # Rows that repeat both: one of them stays.
    return found.dropDuplicates(["doc_id", "text"]).unionByName(docs.filter("doc_id is null"))
