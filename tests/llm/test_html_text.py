"""Cutting of blocks, the network's gradients, and extraction against pages read another way."""

import re
from html import unescape

import numpy as np
import pytest

from fleetvault.llm import html_text
from fleetvault.llm.queries import QUERIES


def texts(page):
    return [b[0] for b in html_text.blocks_of(page)]


@pytest.mark.parametrize(
    "page, want",
    [
        ("", []),
        ("plain &amp; simple", ["plain & simple"]),
        ("<p>a<p>b</p>c", ["a", "b", "c"]),
        ("<p>one <b>two</b><i>three</i><br>four&nbsp;&copy; &#233;</p>", ["one twothree four © é"]),
        ("<div>a<script>if (x<y) '</p>'</script>b</div><style>p{}</style><!-- c > d -->e", ["ab", "e"]),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
        ("<p title='a>b' data=\"<p>\">x</p><a href=x>y</a>", ["x", "y"]),
        ("x < y and <3 </nothing> z", ["x < y and <3 z"]),
        ("a<!-- never closed <p>b", ["a"]),
        ("a<script>never closed <p>b", ["a"]),
        ("<SCRIPT>x</SCRIPT ><P CLASS=q>\n\t Big   space \r\n</P>", ["Big space"]),
        ("<p>&lt;p&gt; &amp;lt;</p>", ["<p> &lt;"]),
        ("a<b", ["a<b"]),
        ("<" * 2000, ["<" * 2000]),
    ],
)
def test_blocks(page, want):
    assert texts(page) == want


def test_deep_and_long_pages():
    assert texts("<div>" * 20_000 + "x" + "</div>" * 20_000) == ["x"]
    assert len(texts("<p>word" * 50_000)) == 50_000


def test_paths_and_links():
    page = "<body><nav><ul><li><a href=1>One</a> two</ul></nav><article class='Post-body'><p>Text"
    (_, path, leaf, linked), (_, other, last, none) = html_text.blocks_of(page)
    assert path >> html_text.KNOWN["nav"] & 1 and not other >> html_text.KNOWN["nav"] & 1
    assert other >> html_text.KNOWN["post"] & 1 and other >> html_text.KNOWN["article"] & 1
    assert (leaf, linked, last, none) == ("li", 3, "p", 0)


def test_every_word_of_a_long_block_counts():
    """Two blocks of 500 words that differ in a single one, wherever it stands, are told apart."""
    first = html_text.PATH + html_text.LEAF
    plain = html_text.vectors([(" ".join(["word"] * 500), 0, "p", 0)])[0, first : first + html_text.WORDS]
    for at in range(500):
        words = ["word"] * 500
        words[at] = "other"
        found = html_text.vectors([(" ".join(words), 0, "p", 0)])[0, first : first + html_text.WORDS]
        assert np.abs(found - plain).sum() == pytest.approx(2 / 500, rel=1e-3)


def test_gradients():
    rng = np.random.default_rng(1)
    pages = [rng.normal(size=(n, html_text.WIDTH)) for n in (3, 1, 5)]
    labels = [rng.integers(0, 2, len(x)).astype(float) for x in pages]
    h, w = html_text.HIDDEN, html_text.WIDTH
    p = {"v": rng.normal(size=2 * h + w) * 0.2, "d": np.zeros(1)}
    for side in "fr":
        p |= {"W" + side: rng.normal(size=(w, 4 * h)) * 0.1, "R" + side: rng.normal(size=(h, 4 * h)) * 0.3}
        p["b" + side] = rng.normal(size=4 * h) * 0.1

    def loss(q):
        scores = html_text.forward(q, pages, np.float64)[-1]
        own = np.concatenate([scores[: len(x), j] for j, x in enumerate(pages)])
        want = np.concatenate(labels)
        return -(want * np.log(own) + (1 - want) * np.log(1 - own)).mean()

    found = html_text.gradients(p, pages, labels, np.float64)
    for name in p:
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in p[name].shape)
            up, down = ({k: v.copy() for k, v in p.items()} for _ in range(2))
            up[name][at] += 1e-5
            down[name][at] -= 1e-5
            assert found[name][at] == pytest.approx((loss(up) - loss(down)) / 2e-5, rel=1e-3, abs=1e-8)


def article(page):
    """The article of the given pages' template, by plain replacement."""
    inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1|h2|ul|li)>", re.sub(r"<br>|</?b>", " ", inside))
    return "\n".join(t for t in (" ".join(unescape(p).split()) for p in parts) if t)


@pytest.fixture(scope="module")
def weights(spark, sf_dir):
    return html_text.train(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def test_whole_table(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.01")
    pages = {r.page_id: r for r in spark.read.parquet(f"{big}/pages.parquet").collect()}
    rows = QUERIES["op5_html_text"](spark, big).collect()
    assert sorted(pages) == sorted(r.page_id for r in rows)
    assert all(r.n_chars == len(r.text) and r.url == pages[r.page_id].url for r in rows)
    right = [r.text == article(pages[r.page_id].html) for r in rows]
    assert np.mean(right) > 0.98


PARAGRAPHS = [
    "The than thhasted attionen thesat ed in oran with the heans of a long sentence, and more of it.",
    "Another ordinary paragraph says several things about the matter, in two sentences. Here is one.",
    "A third paragraph closes what the others began, and it is about as long as any of the others.",
]
NOISE = [
    "<nav><ul><li><a href=1>Home</a></li><li><a href=2>About</a></li></ul></nav>",
    "<aside class='sidebar'><p>Related: read something else entirely today.</p></aside>",
    "<div class=\"cookie-notice\">We use cookies. <button>Fine</button></div>",
    "<form><label>Your mail</label><input name=m></form>",
    "<div class='ad'>Buy now, only today.</div>",
    "<section class='comments'><p>I do not agree with this article at all, said a reader.</p></section>",
    "<footer><p>Copyright of somebody, all rights reserved.</p></footer>",
    "<header><p>The Daily Page</p></header>",
]


@pytest.mark.parametrize("noise", range(len(NOISE)))
@pytest.mark.parametrize("place", ["around", "inside"])
def test_other_templates(weights, noise, place):
    text = [f"<p>{p}</p>" for p in PARAGRAPHS]
    if place == "inside":
        text.insert(2, NOISE[noise])
    body = f"<article><h1>A headline</h1>{''.join(text)}</article>"
    if place == "around":
        body = NOISE[noise] + body + NOISE[-2]
    blocks = html_text.blocks_of(f"<html><body>{body}</body></html>")
    (chosen,) = html_text.label(weights, [blocks])
    assert [b[0] for b, own in zip(blocks, chosen) if own] == ["A headline", *PARAGRAPHS]


def test_odd_rows(spark, weights):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", "<article><p>Hi there, you.</article>", None)]
    rows += [(3, "u", "<p>" + "long text. " * 30_000, "t")] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = html_text.extract(df, weights).collect()
    assert len(out) == 5 and [r.text for r in out if r.page_id in (1, 2)] == ["", ""]
    none = df.limit(0)
    assert html_text.extract(none, html_text.train(none)).collect() == []
    assert html_text.extract(df, {}).count() == 5
