"""Main text of web pages by a maximum-scoring subsequence of words and tags.

A page is read once as a sequence of tags and of blocks of words.  A block's words score
the log-odds of lying in the main content, by a logistic model of where the block stands
(the open elements and the words of their class, id and role attributes) and what it looks
like (length, share of links, sentences); tags score the negative log-odds of lying
outside of it.  Both are learned: from a fixed set of small labelled pages, and from a
bounded sample of the table's pages that mark their own article.  One linear scan finds
the contiguous region of the largest score, which is widened to the element that holds it.
Inside it the scan runs again with the signs
turned: runs of blocks that speak against being content (an advert between two paragraphs,
comments below the last) are cut out, the worst first, until no block that scores below
zero is left; the rest is joined block by block.

Defined cases: a null or empty html, or one without positive words, gives an empty text;
unclosed and unopened tags are tolerated; what is never shown (scripts, styles, titles,
templates, text areas) is no text; of equally good regions the first is taken; a page of
any length is read as a whole.
"""

from __future__ import annotations

import html as entities
import os.path
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import hash_sample

#: At most so many pages of the table that mark their own article teach the weights.
SAMPLE_PAGES = 400  # of twice as many that are looked at
#: A block inside a marked article counts as an insert if the labelled pages alone give it so little.
INSERT_BELOW = -2.0

# fixed values: HTML element names by their part in a page
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre section summary table tbody template tfoot thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noframes noembed xmp".split())
#: Elements that are no blocks but tell what their words are.
TELLING = frozenset("button select label a td th".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|\b(hidden)\b")
#: Small labelled pages: the main text is what stands between [[ and ]].
LABELLED = (
    '<body><header class="top"><h1>site name</h1><p>the motto of this site</p></header><nav class="main-menu"><ul><li><a>home</a></li><li><a>news</a></li><li><a>sports today</a></li></ul></nav><div class="content">[[<h2>a title here</h2><p>First words of the text follow here, and then some more.</p><p>More words of the text stand here.</p><p>Short one.</p>]]</div><aside class="sidebar"><h3>see also</h3><p>Other things to read when you are done with this.</p></aside><footer class="site-footer">all rights reserved</footer></body>',
    '<body><div id="cookie-notice" class="banner consent"><p>We use cookies on this site to make it better.</p><button>accept</button></div><div class="post">[[<h1>the title</h1><p>Many words make up this text and go on for a while.</p><ul><li>one point that is made</li><li>another point of the text</li></ul><p>An end.</p>]]<div class="comments" id="comments"><h3>two comments</h3><p>First reader says this, at some length, and signs.</p><p>Second reader says that.</p></div></div><form action="/s" class="search"><label>search</label><input></form></body>',
    "<body><div>[[<p>A page with no names at all has only words in it, many of them.</p><p>It goes on with a second block of words.</p><p>And a third.</p>]]</div><div class='ad'>Buy this now, it is cheap and good.</div><div class='sidebar widget'><ul><li><a>link one</a></li><li><a>link two</a></li></ul></div></body>",
    "<body><table><tr><td>[[<p>Old pages kept their text in tables and had long words in them.</p><blockquote>They cited others too, at length, and more than once.</blockquote>]]</td></tr></table><script>var x=1;</script><div class='newsletter subscribe'>Subscribe to our letter and never miss a thing.</div><div class='related'><a>more</a><a>like this</a></div></body>",
    '<body><nav><a>start</a><a>shop</a><a>about us</a></nav><main class="main">[[<h1>what happened</h1><p>It was a day like many others, and nobody thought of it.</p>]]<aside class="ad advert"><p>This advert stands between two paragraphs, and wants you to buy.</p></aside>[[<p>Then it came otherwise.</p><p>So it ended, as all things do.</p>]]<div class="share social"><a>share</a><a>tweet</a></div></main><footer><p>Made by us, in our town, with some care.</p><ul><li><a>imprint</a></li><li><a>privacy</a></li></ul></footer></body>',
    '<body><article class="story"><header>[[<h1>a heading in its article</h1>]]<p class="meta byline">by someone on a day</p></header>[[<p>The story has a first paragraph of some length here.</p><figure><figcaption>what the picture shows</figcaption></figure><p>Its second one is shorter.</p>]]<div class="promo sponsored"><p>Sponsored: you may like these things that others sell.</p></div>[[<p>Its last one ends.</p>]]<section id="comments" class="replies"><article class="comment"><p>I read it and I liked it very much, thank you.</p></article><article class="comment"><p>I did not.</p></article></section></article><aside><p>popular now</p><a>one</a><a>two</a></aside></body>',
    '<body><div class="skip"><a>skip to content</a></div><ul class="breadcrumb"><li><a>home</a></li><li><a>archive</a></li></ul><section class="entry-content">[[<h2>notes</h2><p>These notes were written down in a hurry, and late.</p><pre>some lines that keep their form</pre><h3>more notes</h3><p>Read them with care.</p><ol><li>first of all, sleep</li><li>then eat something</li></ol>]]</section><div class="modal popup" role="dialog"><p>Sign up today and get the next one free.</p><form><label>your mail</label><button>sign up</button></form></div><div role="contentinfo">copyright of this page</div></body>',
    '<body><div class="alert notice">This page is old and will go away.</div><div id="header"><a>logo</a><span>a place for words</span></div><div id="main" role="main">[[<p>Words upon words make a page that people read.</p><table><tr><th>name</th><th>worth</th></tr><tr><td>first</td><td>ten</td></tr></table><p>As the table shows, little is left.</p><dl><dt>term</dt><dd>what the term means in this text</dd></dl>]]</div><div id="footer">terms of use</div><div class="hidden" hidden>never seen by anyone</div></body>',
    '<body><nav><a>home</a></nav><article class="story post">[[<h1>a story</h1><p>It begins here with a sentence, and there is another.</p>]]<aside><p>see also what others wrote</p></aside><form><input>go</form><div class="newsletter"><p>Have our letter sent to you each day.</p></div>[[<p>Middle.</p><h2>a part</h2><p>It goes on.</p>]]<div id="comments" class="comments"><p>nice post</p><p>I think so too, and I would add some words.</p></div>[[<p>Its last line.</p>]]</article><div class="sidebar"><p>more of it</p></div><footer>foot</footer></body>',
    '<body><div class="wrap"><div class="story article">[[<h2>the end of it</h2><p>Ends.</p><p>It had been long, and all were tired of it.</p><p>One more.</p>]]</div><div class="ad sponsored promo">Get one, get two.</div><aside class="related"><ul><li><a>a thing</a></li><li>some other thing</li></ul></aside></div></body>',
    "<body><ul><li><a>one page</a></li><li><a>another page</a></li></ul><p>[[the words of this page have no marks between them and no end and they go on like that for a long while as words do when nobody cares to part them into sentences so there are many of them here]]</p><p>[[and there is a second one of the kind which also goes on and on without any sign that it would come to an end some time soon or later or at all]]</p><div class='links'><a>next</a><a>last</a></div></body>",
    '<body><nav><ul><li><a>a</a></li><li><a>b</a></li></ul></nav><div class="ad">Some words that sell a thing to you.</div><article>[[<h1>one title</h1><p>One text, with a <a>link</a> in it, that goes on and on.</p><p>Two.</p><p>Three words here.</p>]]</article><footer>&copy; this site, and some words about it.</footer></body>',
)


def names_of(attributes: str) -> list[str]:
    """The words of an element's class, id and role; ``hidden`` if it is not shown."""
    out = []
    for name, a, b, c, hidden in ATTRIBUTE.findall(attributes):
        value, name = a or b or c, name.lower()
        if hidden or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            out.append("hidden")
        elif name in ("class", "id", "role"):
            out += [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower()) if w]
    return out


@dataclass
class Block:
    """The words between two block tags: what the open elements tell, where these begin, the pieces of text, words in links."""

    where: tuple[str, ...]
    path: tuple[int, ...]
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    def text(self) -> str:
        return " ".join("".join(self.parts).split())


def read(page: str) -> Iterator[str | Block]:
    """The page's block tags (their names) and blocks, in order."""
    at, n, links = 0, len(page), 0
    stack: list[tuple[str, tuple[str, ...], int]] = []  # open elements that count: (tag, what they tell, where they begin)
    block: Block | None = None
    while at < n:
        m = TOKEN.search(page, at)
        stop = m.start() if m else n
        if stop > at:
            text = entities.unescape(page[at:stop]) if "&" in page[at:stop] else page[at:stop]
            if block is None:
                block = Block(tuple(dict.fromkeys(x for _, told, _ in stack for x in told)), tuple(x for tag, _, x in stack if tag in BLOCKS))
            block.parts.append(text)
            if links:
                block.linked += len(text.split())
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag, closes = m[2].lower(), bool(m[1])
        if tag == "a":
            links = max(0, links - 1) if closes else links + 1
        if tag in ("br", "td", "th") and block is not None:
            block.parts.append(" ")
        if tag in BLOCKS:
            if block is not None:
                yield block
                block = None
            yield "/" + tag if closes else tag
        if closes:  # an end tag closes down to its element, if that is open
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            continue
        if tag == "body":
            stack.clear()
        told = names_of(m[3]) if m[3] else []
        if (tag in BLOCKS or tag in TELLING or told) and tag not in VOID and not (m[3] or "").endswith("/"):
            if tag == "p" and stack and stack[-1][0] == "p":
                stack.pop()
            if tag not in ("body", "html", "a"):
                stack.append((tag, ("<" + tag, *told), at))
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            at = end.start() if end else n
    if block is not None:
        yield block


def looks(b: Block) -> list[str]:
    """What the model is told of a block."""
    text = b.text()
    words = len(text.split())
    out = ["bias", *b.where, *(f"words {k}" for k in (2, 4, 8, 16, 32) if words >= k)]
    if b.where:
        out.append("in " + next((x for x in reversed(b.where) if x[0] == "<"), ""))
    if 2 * b.linked > words:
        out.append("links")
    if re.search(r"[.!?:]\W*$", text):
        out.append("sentence")
    return out


@dataclass(frozen=True)
class Weights:
    """``words``: log-odds by feature; ``tags``: what a tag costs."""

    words: dict[str, float]
    tags: dict[str, float]

    def score(self, b: Block) -> float:
        return sum(self.words.get(f, 0.0) for f in looks(b))

    def tag(self, name: str) -> float:
        return self.tags.get(name.lstrip("/"), -0.5)


#: A labelled page: its tags and blocks, each with whether it is content.
Labelled = list[tuple[str | Block, bool]]


def learn(pages: list[Labelled], known: Weights | None = None, penalty: float = 0.0001, steps: int = 1000) -> Weights:
    """A logistic model of blocks, weighted by their number of words, logarithmically; tags by their counts inside and outside.

    Weights are drawn to those that are ``known``, and to zero otherwise.
    """
    inside, outside, rows, y, size = Counter(), Counter(), [], [], []
    for page in pages:
        for item, good in page:
            if isinstance(item, str):
                (inside if good else outside)[item.lstrip("/")] += 1
            elif words := len(item.text().split()):
                rows.append(looks(item))
                y.append(good)
                size.append(1 + np.log(words))
    tags = {t: -float(np.log1p((outside[t] + 0.5) / (inside[t] + 0.5))) for t in inside.keys() | outside.keys()}
    names = sorted({f for r in rows for f in r})
    place = {f: k for k, f in enumerate(names)}
    at = np.array([(i, place[f]) for i, r in enumerate(rows) for f in r], np.int64).reshape(-1, 2)
    y, size, speed = np.array(y, float), np.array(size, float), np.zeros(len(names))
    before = np.array([known.words.get(f, 0.0) if known else 0.0 for f in names])
    w = before.copy()
    # both kinds count alike, whatever their number
    for kind in (0.0, 1.0):
        if (y == kind).any():
            size[y == kind] /= size[y == kind].sum()
    for _ in range(steps):
        z = np.bincount(at[:, 0], w[at[:, 1]], len(rows))
        error = size * (1 / (1 + np.exp(-z)) - y)
        slope = np.bincount(at[:, 1], error[at[:, 0]], len(names)) + penalty * (w - before)
        speed = 0.9 * speed - 2.0 * slope
        w = w + speed
    return Weights((known.words if known else {}) | dict(zip(names, w.tolist(), strict=True)), (known.tags if known else {}) | tags)


def marked(page: str) -> Labelled:
    """A page whose main text stands between [[ and ]]."""
    good, out = False, []
    # the marks stand where a block ends, so each is a block of its own or begins or ends one
    for item in read(page.replace("[[", "<hr>\x02<hr>").replace("]]", "<hr>\x03<hr>")):
        if isinstance(item, Block) and item.text() in ("\x02", "\x03"):
            good = item.text() == "\x02"
        elif item != "hr":
            out.append((item, good))
    return out


def weights(examples: list[str]) -> Weights:
    """From the fixed labelled pages, and pages that hold exactly one article element.

    In an article all is content but what the labelled pages alone teach to be an insert.
    """
    known = [marked(p) for p in LABELLED]
    first = learn(known)
    pages = []
    for p in examples:
        out, depth = [], 0
        for item in read(p):
            depth += (item == "article") - (item == "/article") if isinstance(item, str) else 0
            good = isinstance(item, Block) and "<article" in item.where and first.score(item) > INSERT_BELOW
            out.append((item, good if isinstance(item, Block) else depth > 0))
        pages.append(out)
    # the table's pages refine what the fixed ones taught
    return learn(pages, first, 0.002) if pages else first


def best_region(scores: list[float]) -> tuple[int, int]:
    """[start, end) of the contiguous run of the largest positive sum; the first of equals."""
    best, at, run, start = 0.0, (0, 0), 0.0, 0
    for i, x in enumerate(scores):
        if run <= 0:
            run, start = 0.0, i
        run += x
        if run > best + 1e-12:
            best, at = run, (start, i + 1)
    return at


def _widened(seq: list[str | Block], scores: list[float], start: int, end: int) -> tuple[int, int]:
    """The region up to the ends of the element that holds its blocks, if that is not the page itself.

    An insert that costs more than what follows it ends the best region, but not the article.
    """
    paths = [x.path for x, s in zip(seq[start:end], scores[start:end], strict=True) if isinstance(x, Block) and s > 0]
    if not paths or not (held := os.path.commonprefix(paths)):
        return start, end
    inside = [k for k, x in enumerate(seq) if isinstance(x, Block) and held[-1] in x.path]
    return min(start, inside[0]), max(end, inside[-1] + 1)


def extract(page: str | None, w: Weights) -> str:
    """The main text of one page."""
    if not page:
        return ""
    seq = list(read(page))
    scores = [w.tag(x) if isinstance(x, str) else len(x.text().split()) * w.score(x) for x in seq]
    start, end = _widened(seq, scores, *best_region(scores))
    # tags cost nothing either way inside the region: only blocks speak against being content
    seq, scores = seq[start:end], [0.0 if isinstance(x, str) else s for x, s in zip(seq[start:end], scores[start:end], strict=True)]
    gone = np.zeros(len(seq), bool)
    todo = [(0, len(seq))]
    while todo:
        a, b = todo.pop()
        i, j = best_region([-s for s in scores[a:b]])
        if j > i:
            gone[a + i : a + j] = True
            todo += [(a, a + i), (a + j, b)]
    texts = (x.text() for x, g in zip(seq, gone.tolist(), strict=True) if not g and isinstance(x, Block))
    return "\n".join(t for t in texts if t)


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample_pages: int = SAMPLE_PAGES) -> Weights:
    """Weights from the fixed pages and at most ``sample_pages`` pages that mark their article."""
    page = F.col(f"`{html_col}`")
    some = hash_sample(pages.select(F.col(f"`{id_col}`").cast("string").alias("id"), page.alias("p")), F.col("id"), 2 * sample_pages)
    one = some.where((F.regexp_count("p", F.lit("<article")) == 1) & F.contains("p", F.lit("</article>"))).orderBy("id").limit(sample_pages)
    return weights([r["p"] for r in one.select("p").collect()])


def main_text(pages: DataFrame, w: Weights, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages``."""
    columns = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(p.as_py(), w) for p in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return columns.mapInArrow(run, "page_id long, url string, text string, n_chars long")
