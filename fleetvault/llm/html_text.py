"""HTML extraction: a recurrent labeller decides for every block whether it is main text.

A page is read as the sequence of its leaf blocks: runs of text that no block-level tag breaks.
Scripts, styles and other content that is no text are left out when blocks are cut; character
references are decoded and white space becomes one space. Each block is a vector of its tag
path (tags, roles, and words of class and id of all open elements; known words have a place of
their own, others are hashed), of its innermost element, of all its words, hashed, and of a few
measures such as its share of link text. A bidirectional LSTM in numpy reads the whole sequence, so
a block is judged in the context of its document, and the blocks judged as main text are joined by
line breaks in page order.

The labeller is trained on at most ``MOST_TRAINING`` pages (those with the smallest hash of their id;
of a long one ``MOST_BLOCKS`` blocks from both ends). Nobody labels blocks, so the tag path teaches: inside an
article and not inside any part that is known not to be text. So that the labeller learns more
than the path of one template, training pages are varied: the article's tag is hidden, the names of
other parts are exchanged, and such parts are put between the article's blocks.

Pages never move. Every block of every page is read.

Nulls and edge cases: a null or empty page has an empty text. Unclosed and crossed tags are closed as
browsers do for the common cases; an unclosed comment or script ends with the page. Rows that
repeat are read each on its own. Other columns are not looked at.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of parts, as tags or as words of role, class and id. Fixed values.
TEXT_PARTS = ["article", "main", "content", "post", "entry", "story", "body"]
OTHER_PARTS = [
    "nav", "menu", "header", "footer", "aside", "sidebar", "ad", "ads", "advert", "advertisement", "sponsored",
    "promo", "banner", "notice", "cookie", "cookies", "consent", "popup", "modal", "newsletter", "subscribe",
    "form", "comment", "comments", "reply", "share", "social", "related", "recommended", "breadcrumb",
    "breadcrumbs", "pagination", "toolbar", "widget", "copyright", "login", "search", "contentinfo", "navigation",
    "complementary", "dialog", "alert", "disclaimer", "tags", "teaser",
]
LEAVES = ["p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "div", "td", "th", "blockquote", "pre", "figcaption", "dt", "dd"]
LEAVES += ["section", "summary", "caption", "label", "button", "a", "span"]
BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section "
    "summary table tbody td tfoot th thead tr ul caption".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe object svg math select button canvas audio video".split())
# An opening tag closes these open elements, up to the nearest of the others.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th")}
CLOSES |= {"th": ("td", "th"), "option": ("option",)}
SCOPES = {"ul", "ol", "dl", "table", "menu", "dir", "article", "section", "div", "body", "main", "select"}

KNOWN = {w: i for i, w in enumerate(dict.fromkeys(TEXT_PARTS + OTHER_PARTS))}
PATH = len(KNOWN) + 24
LEAF = len(LEAVES) + 1
WORDS = 24
MEASURES = 8
WIDTH = PATH + LEAF + WORDS + MEASURES
HIDDEN = 16
MOST_TRAINING = 400
MOST_BLOCKS = 48
ROUNDS = 20
SEED = 5
BATCH_BLOCKS = 20_000
TEXT_BITS = sum(1 << KNOWN[w] for w in TEXT_PARTS)
OTHER_BITS = sum(1 << KNOWN[w] for w in OTHER_PARTS)

TOKEN = re.compile(
    r"<!--(?:.*?--!?>|.*\Z)|<[!?][^>]*+>|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S
)
ATTRIBUTE = re.compile(r"(?:^|\s)(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
NAME = re.compile(r"[a-z]+")


def _bits(tag: str, attributes: str) -> int:
    words = [tag]
    if attributes and not attributes.isspace():
        for found in ATTRIBUTE.findall(attributes):
            words += NAME.findall("".join(found).lower())
    out = 0
    for word in words:
        place = KNOWN.get(word)
        out |= 1 << (len(KNOWN) + zlib.crc32(word.encode()) % (PATH - len(KNOWN)) if place is None else place)
    return out


def blocks_of(page: str) -> list[tuple[str, int, str, int]]:
    """Leaf blocks in page order: text, bits of the tag path, innermost block tag, characters in links."""
    out: list[tuple[str, int, str, int]] = []
    stack: list[tuple[str, int, str]] = [("", 0, "div")]  # tag, bits of the path to it, innermost block tag
    texts: list[str] = []
    state = [0, 0, 0]  # characters in links, open links, bits of inline elements

    def flush() -> None:
        if texts:
            text = " ".join("".join(texts).split())
            if text:
                out.append((text, stack[-1][1] | state[2], stack[-1][2], min(state[0], len(text))))
            texts.clear()
        state[0] = state[2] = 0

    def say(piece: str) -> None:
        if "&" in piece:
            piece = html.unescape(piece)
        texts.append(piece)
        if state[1] and not piece.isspace():
            state[0] += len(piece.strip())
        state[2] |= stack[-1][1]

    def close(depth: int) -> None:
        if any(e[0] in BLOCKS for e in stack[depth:]):
            flush()
        state[1] -= sum(e[0] == "a" for e in stack[depth:])
        del stack[depth:]

    counts: dict[str, int] = {}

    def shut(depth: int) -> None:
        for e in stack[depth:]:
            counts[e[0]] -= 1
        close(depth)

    at, size = 0, len(page)
    while at < size:
        found = TOKEN.search(page, at)
        if found is None:
            say(page[at:])
            break
        if found.start() > at:
            say(page[at : found.start()])
        at = found.end()
        if found[2] is None:
            continue
        tag = found[2].lower()
        if found[1]:
            if counts.get(tag):
                depth = len(stack) - 1
                while stack[depth][0] != tag:
                    depth -= 1
                shut(depth)
            elif tag in BLOCKS:
                flush()
            continue
        if tag in RAW:
            if tag in BLOCKS:
                flush()
            if not found[3].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else size
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            else:
                texts.append(" ")
            continue
        if tag in BLOCKS:
            if counts.get("p") and tag != "span":
                depth = len(stack) - 1
                while depth and stack[depth][0] != "p" and stack[depth][0] not in ("td", "th", "table", "button"):
                    depth -= 1
                if stack[depth][0] == "p":
                    shut(depth)
            for other in CLOSES.get(tag, ()):
                if counts.get(other):
                    depth = len(stack) - 1
                    while depth and stack[depth][0] != other and stack[depth][0] not in SCOPES:
                        depth -= 1
                    if stack[depth][0] == other:
                        shut(depth)
            flush()
        bits = stack[-1][1] | _bits(tag, found[3])
        stack.append((tag, bits, tag if tag in BLOCKS else stack[-1][2]))
        counts[tag] = counts.get(tag, 0) + 1
        state[1] += tag == "a"
    flush()
    return out


def vectors(blocks: list[tuple[str, int, str, int]]) -> np.ndarray:
    """One row per block of one page."""
    out = np.zeros((len(blocks), WIDTH), np.float32)
    paths = b"".join(bits.to_bytes(-(-PATH // 8), "little") for _, bits, _, _ in blocks)
    flags = np.frombuffer(paths, np.uint8).reshape(len(blocks), -1)
    out[:, :PATH] = np.unpackbits(flags, axis=1, bitorder="little")[:, :PATH]
    seen: dict[str, int] = {}
    for i, (text, _, leaf, linked) in enumerate(blocks):
        row = out[i]
        row[PATH + (LEAVES.index(leaf) if leaf in LEAVES else len(LEAVES))] = 1
        words = text.split(" ")
        places = [zlib.crc32(word.lower().encode()) % WORDS for word in words]
        row[PATH + LEAF : PATH + LEAF + WORDS] = np.bincount(places, minlength=WORDS) / len(words)
        size = len(text)
        ends = sum(text.count(c) for c in ".!?")
        row[-MEASURES:] = (
            np.log1p(size) / 6,
            np.log1p(len(words)) / 5,
            linked / size,
            min(ends / len(words), 1),
            text[-1] in ".!?:\"'",
            text[0].isupper(),
            (i + 1) / len(blocks),
            seen.get(text, 0) > 0,
        )
        seen[text] = 1
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _run(p: dict, side: str, x: np.ndarray, alive: np.ndarray) -> dict:
    """One direction over (steps, pages, WIDTH); a page's state stands still after its last block."""
    steps, pages, _ = x.shape
    drive = x @ p["W" + side] + p["b" + side]
    h = c = np.zeros((pages, HIDDEN), x.dtype)
    keep = {"h": [h], "c": [c], "gates": []}
    for t in range(steps):
        z = drive[t] + h @ p["R" + side]
        i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(z[:, 3 * HIDDEN :])
        on = alive[t][:, None]
        new = f * c + i * g
        c = np.where(on, new, c)
        h = np.where(on, o * np.tanh(new), h)
        keep["gates"].append((i, f, o, g))
        keep["h"].append(h)
        keep["c"].append(c)
    return keep


def _back(p: dict, side: str, x: np.ndarray, alive: np.ndarray, keep: dict, dh_out: np.ndarray) -> dict:
    out = {k + side: np.zeros_like(p[k + side]) for k in "WRb"}
    dh, dc = np.zeros_like(keep["h"][0]), np.zeros_like(keep["c"][0])
    for t in range(len(x) - 1, -1, -1):
        i, f, o, g = keep["gates"][t]
        on = alive[t][:, None]
        dh = dh + dh_out[t]
        squashed = np.tanh(keep["c"][t + 1])
        own = np.where(on, dh, 0)
        dcell = np.where(on, dc, 0) + own * o * (1 - squashed**2)
        dz = np.concatenate(
            [dcell * g * i * (1 - i), dcell * keep["c"][t] * f * (1 - f), own * squashed * o * (1 - o), dcell * i * (1 - g**2)],
            axis=1,
        )
        out["W" + side] += x[t].T @ dz
        out["R" + side] += keep["h"][t].T @ dz
        out["b" + side] += dz.sum(axis=0)
        dh = np.where(on, dz @ p["R" + side].T, dh)
        dc = np.where(on, dcell * f, dc)
    return out


def _padded(pages: list[np.ndarray], kind=np.float32):
    """Pages as (steps, pages, WIDTH), the same turned round within each page, and which steps are real."""
    steps = max(map(len, pages))
    x, turned = (np.zeros((steps, len(pages), WIDTH), kind) for _ in range(2))
    alive = np.zeros((steps, len(pages)), bool)
    for j, page in enumerate(pages):
        x[: len(page), j], turned[: len(page), j], alive[: len(page), j] = page, page[::-1], True
    return x, turned, alive


def _unturned(h: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """Outputs of the turned direction, at the blocks that they belong to."""
    sizes = alive.sum(axis=0)
    at = np.clip(sizes[None, :] - 1 - np.arange(len(alive))[:, None], 0, None)
    return h[at, np.arange(alive.shape[1])[None, :]]


def forward(p: dict, pages: list[np.ndarray], kind=np.float32):
    x, turned, alive = _padded(pages, kind)
    ahead, behind = _run(p, "f", x, alive), _run(p, "r", turned, alive)
    hf, hr = np.stack(ahead["h"][1:]), _unturned(np.stack(behind["h"][1:]), alive)
    both = np.concatenate([hf, hr, x], axis=2)
    return x, turned, alive, ahead, behind, both, _sigmoid(both @ p["v"] + p["d"])


def gradients(p: dict, pages: list[np.ndarray], labels: list[np.ndarray], kind=np.float32) -> dict:
    x, turned, alive, ahead, behind, both, scores = forward(p, pages, kind)
    wanted = np.zeros(alive.shape, kind)
    for j, label in enumerate(labels):
        wanted[: len(label), j] = label
    error = np.where(alive, scores - wanted, 0) / alive.sum()
    out = {"v": np.einsum("tpk,tp->k", both, error), "d": error.sum(keepdims=True).reshape(1)}
    dh = error[:, :, None] * p["v"][: 2 * HIDDEN]
    # The turned direction gets its errors in its own order.
    dr = np.where(alive[:, :, None], _unturned(dh[:, :, HIDDEN:], alive), 0)
    return out | _back(p, "f", x, alive, ahead, dh[:, :, :HIDDEN]) | _back(p, "r", turned, alive, behind, dr)


def taught(blocks: list[tuple[str, int, str, int]]) -> np.ndarray:
    """What the tag path says: inside the text and inside no other part."""
    paths = [bits for _, bits, _, _ in blocks]
    inside = TEXT_BITS if any(b & (1 << KNOWN["article"] | 1 << KNOWN["main"]) for b in paths) else 0
    strong = 1 << KNOWN["article"] | 1 << KNOWN["main"]
    return np.array([(not inside or bool(b & strong)) and not b & OTHER_BITS for b in paths], np.float32)


def varied(x: np.ndarray, labels: np.ndarray, rng, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A training page with other names for its parts, perhaps no article tag, and parts in its text."""
    x = x.copy()
    parts = [KNOWN[w] for w in OTHER_PARTS]
    rename = rng.permutation(parts)
    x[:, parts] = x[:, rename]
    if rng.random() < 0.3:
        x[:, [KNOWN["article"], KNOWN["main"]]] = 0
    elif rng.random() < 0.5:
        x[:, KNOWN["main"]], x[:, KNOWN["article"]] = x[:, KNOWN["article"]].copy(), x[:, KNOWN["main"]].copy()
    own = list(KNOWN.values())
    loose = (labels == 0) & (rng.random(len(x)) < 0.5)
    x[loose, PATH : PATH + LEAF] = np.eye(LEAF, dtype=np.float32)[rng.integers(0, LEAF, int(loose.sum()))]
    for _ in range(int(rng.integers(0, 6)) if labels.any() else 0):
        text = np.flatnonzero(labels)
        first, last = int(text[0]), int(text[-1])
        run, place = int(rng.integers(1, 4)), int(rng.integers(0, len(x) + 1))
        if rng.random() < 0.6:
            place = int(rng.integers(first, last + 2))
        like = other[rng.integers(0, len(other), run)] if len(other) and rng.random() < 0.4 else x[rng.choice(text, run)]
        new = like.copy()
        new[:, own] = 0
        if first < place <= last:
            new[:, own] = x[first, own]
        new[:, rng.choice(parts)] = 1
        new[:, PATH : PATH + LEAF] = np.eye(LEAF, dtype=np.float32)[rng.choice([0, int(rng.integers(0, LEAF))])]
        x, labels = np.insert(x, place, new, axis=0), np.insert(labels, place, np.zeros(run))
    x[:, PATH + LEAF + WORDS + 6] = np.arange(1, len(x) + 1) / len(x)
    # Hashed names must not stand for a part that one template happens to use.
    hidden = rng.random(PATH - len(KNOWN)) < 0.5
    x[:, len(KNOWN) : PATH][:, hidden] = 0
    return x, labels.astype(np.float32)


def fit(pages: list[list[tuple[str, int, str, int]]], rounds: int = ROUNDS) -> dict:
    """Weights learned from the blocks of training pages; none without pages."""
    half = MOST_BLOCKS // 2
    pages = [p if len(p) <= MOST_BLOCKS else p[:half] + p[-half:] for p in pages if p]
    if not pages:
        return {}
    xs, labels = [vectors(p) for p in pages], [taught(p) for p in pages]
    pool = [x[y == 0] for x, y in zip(xs, labels)]
    other = np.concatenate(pool)
    rng = np.random.default_rng(SEED)
    draw = lambda *s: (rng.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
    p = {}
    for side in "fr":
        p |= {"W" + side: draw(WIDTH, 4 * HIDDEN), "R" + side: draw(HIDDEN, 4 * HIDDEN)}
        p["b" + side] = np.repeat(np.array([0, 1, 0, 0], np.float32), HIDDEN)
    p |= {"v": draw(2 * HIDDEN + WIDTH), "d": np.zeros(1, np.float32)}
    memory = {k: (np.zeros_like(w), np.zeros_like(w)) for k, w in p.items()}
    step = 0
    for turn in range(rounds):
        rate = 0.01 * (1 - turn / rounds) + 0.0005
        order = rng.permutation(len(xs))
        order = np.concatenate([order] * max(1, -(-200 // len(order))))  # few pages are seen more often
        for at in range(0, len(order), 16):
            made = [varied(xs[i], labels[i], rng, other) for i in order[at : at + 16]]
            found = gradients(p, [m[0] for m in made], [m[1] for m in made])
            step += 1
            norm = np.sqrt(sum(float((g**2).sum()) for g in found.values()))
            for k, g in found.items():
                g = g / max(norm, 1.0) + 1e-5 * p[k]
                m, v = memory[k]
                m += 0.1 * (g - m)
                v += 0.002 * (g * g - v)
                p[k] = p[k] - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.998**step)) + 1e-8)
    return {k: w.astype(np.float32) for k, w in p.items()}


def label(p: dict, pages: list[list[tuple[str, int, str, int]]]) -> list[np.ndarray]:
    """Per page which blocks are main text. Without weights the path decides."""
    if not p:
        return [taught(page) > 0 for page in pages]
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and len(pages[order[end]]) * (end + 1 - at) <= BATCH_BLOCKS:
            end += 1
        group = order[at:end]
        scores = forward(p, [vectors(pages[i]) for i in group])[-1]
        for j, i in enumerate(group):
            out[i] = scores[: len(pages[i]), j] >= 0.5
        at = end
    return out


def train(pages: DataFrame, most: int = MOST_TRAINING) -> dict:
    """Weights learned from at most ``most`` rows of ``pages`` (page_id, html)."""
    usable = pages.filter("page_id is not null and length(html) between 1 and 100000").select("page_id", "html")
    chosen = usable.orderBy(F.xxhash64("page_id"), "page_id", F.xxhash64("html")).limit(most)
    return fit([blocks_of(h) for h in chosen.toArrow()["html"].to_pylist()])


def extract(pages: DataFrame, weights: dict, slice_bytes: int = 4 << 20) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, url, text and its n_chars."""
    from fleetvault.llm import tokens

    shared = pages.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.slices(batch, "html", slice_bytes):
                cut = [blocks_of(page or "") for page in part["html"].to_pylist()]
                texts = [
                    "\n".join(b[0] for b, own in zip(page, chosen) if own)
                    for page, chosen in zip(cut, label(shared.value, cut))
                ]
                yield pa.RecordBatch.from_arrays(
                    [part["page_id"], part["url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    columns = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
    )
    return columns.mapInArrow(run, "page_id long, url string, text string, n_chars long")
