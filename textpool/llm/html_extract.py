"""Main text of web pages: flat text blocks, judged by a decision tree.

A page becomes a list of text blocks with shallow features: words, share of
words in links, the same of two neighbouring blocks on each side, and what
kind of element surrounds them. A small labelled table of blocks, made from
the pages in ``LABELLED`` and ``OUTLINES``, trains the tree (Spark ML); its
rules then run where the pages are. Where a page marks its article the marks
decide; elsewhere words, links and neighbours do.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "words_before_2", "links_before_2",
            "words_after_2", "links_after_2", "in_article", "no_article", "aside")

#: Elements whose content is no text of the page.
_SILENT = ("script", "style", "noscript", "template", "iframe", "object", "textarea", "select", "title", "canvas", "audio", "video")
#: Drawings and sources of formulas: silent up to their close tag; without one, or self-closed, only the tag is.
_DRAWN = {t: re.compile(rf"</{t}\s*+[^>]*+>", re.I) for t in ("svg", "annotation", "annotation-xml")}
#: Elements of formulas, which stand in a block with space around them.
_MATH = frozenset("""
    math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle
    msub msubsup msup mtable mtd mtext mtr munder munderover none semantics
    """.split())
#: Elements that only mark up words within a block.
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_ASIDE_TAGS = frozenset("nav header footer aside form button menu dialog fieldset label input option head".split())
#: Words of a class, id or role that mark something beside the article.
_ASIDE_WORDS = frozenset("""
    ad ads adv advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies
    dialog disclaimer discussion disqus feedback footer form gdpr header login masthead menu modal nav navbar navigation
    newsletter notice notices notification overlay pager pagination popup privacy promo promoted promotion recommended related
    replies respond response responses search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags
    teaser toolbar topbar widget alert complementary contentinfo reactions toc warning
    """.split())
_ARTICLE_WORDS = frozenset(("article", "main"))
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES_ITSELF = frozenset("p li dt dd tr td th option b i em strong u s span font small big".split())

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(?P<silent>" + "|".join(_SILENT) + r")(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+>.*?(?:</(?P=silent)\s*+[^>]*+>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I)
#: Class words that tell what a wrapper has beside it, as in has-sidebar; they are not what it is.
_HAS = re.compile(r"(?<![a-z])(?:has|with|without|no)[-_][a-z0-9_-]*")
_ROLE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_SPACES = re.compile(r"\s+")


def blocks(html: str) -> list[tuple[str, float, bool, bool]]:
    """(text, share of words in links, inside an article, inside something beside it) of the blocks in page order.

    What holds a main element is not beside it, unless hidden. On a page whose
    articles all lie inside something beside them, class words and forms
    around an article do not count.
    """
    out: list[tuple[str, float, bool, bool, bool]] = []
    parts: list[tuple[str, bool]] = []
    # inside an article, something beside it, the same without what wraps an article, something beside by its tag, something hidden
    outside = (False, False, False, False, False)
    stack: list[tuple] = []
    state, in_link = outside, 0
    unclosed: set[str] = set()

    def flush() -> None:
        if parts:
            text = _SPACES.sub(" ", unescape("".join(p for p, _ in parts))).strip()
            if text:
                linked = sum(len(unescape(p).split()) for p, link in parts if link)
                out.append((text, min(1.0, linked / max(1, len(text.split()))), *state[:3]))
            parts.clear()

    def add(piece: str) -> None:
        if piece:
            parts.append((piece, in_link > 0))

    at = 0
    while m := _TOKEN.search(html, at):
        add(html[at:m.start()])
        at = m.end()
        if m["silent"]:
            if m["silent"].lower() not in ("title", "textarea", "select"):
                continue
            flush()
            continue
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag in _DRAWN:
            if not m["close"] and not (m["attrs"] or "").rstrip().endswith("/") and tag not in unclosed:
                if end := _DRAWN[tag].search(html, at):
                    at = end.end()
                else:
                    unclosed.add(tag)
            continue
        if tag == "a":
            in_link = 0 if m["close"] else 1
        if tag in _MATH:
            add(" ")
            continue
        if tag in _INLINE:
            marks = _marks(tag, m["attrs"]) if not m["close"] and tag in ("span", "a", "small", "time") and m["attrs"] else (False, False, False, False)
            if tag == "br":
                add(" ")
            if not marks[1]:
                if m["close"] and stack and any(t == tag for t, *_ in stack[-3:]):
                    flush()
                    while stack.pop()[0] != tag:
                        pass
                    state = stack[-1][1:] if stack else outside
                continue
            flush()
            state = (state[0], True, True, state[3], state[4] or marks[3])
            stack.append((tag, *state))
            continue
        flush()
        in_link = 0
        if m["close"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            state = stack[-1][1:] if stack else outside
        elif tag not in _VOID and not (m["attrs"] or "").rstrip().endswith("/"):
            while stack and (stack[-1][0] == tag and tag in _CLOSES_ITSELF or stack[-1][0] == "p"):
                stack.pop()
            state = stack[-1][1:] if stack else outside
            article, aside, by_tag, hidden = _marks(tag, m["attrs"])
            if tag == "header" and state[0] and not state[1]:  # of the article, not of the page
                aside = by_tag = False
            strict, loose, by_tag, hidden = state[1] or aside, state[2] or aside, state[3] or by_tag, state[4] or hidden
            if tag == "main":
                strict = loose = hidden or by_tag
            elif article and not aside and not any(t == "article" for t, *_ in stack):
                loose = hidden or by_tag
            state = (state[0] or article, strict, loose, by_tag, hidden)
            stack.append((tag, *state))
    add(html[at:])
    flush()
    plain = any(b[2] and not b[3] for b in out)
    return [(*b[:3], b[3] if plain else b[4]) for b in out]


def _marks(tag: str, attrs: str | None) -> tuple[bool, bool, bool, bool]:
    """Whether an element is an article; is beside it; is so by its tag, other than a form; is hidden."""
    words = {w for g in _ROLE.findall(attrs or "") for w in re.split(r"[^a-z]+", _HAS.sub("", re.sub(r"([a-z])([A-Z])", r"\1-\2", "".join(g)).lower()))} if attrs else set()
    article = tag in _ARTICLE_WORDS or not _ARTICLE_WORDS.isdisjoint(words) and _ASIDE_WORDS.isdisjoint(words)
    hidden = bool(attrs and _HIDDEN.search(attrs))
    named = not _ASIDE_WORDS.isdisjoint(words)
    aside = tag in _ASIDE_TAGS or (tag not in ("html", "body", "article", "main") and named) or hidden
    return article, aside, tag in _ASIDE_TAGS and tag != "form", hidden


def features(found: list[tuple[str, float, bool, bool]]) -> np.ndarray:
    """One row of FEATURES per block; beyond the page's ends lie blocks without words."""
    if not found:
        return np.zeros((0, len(FEATURES)))
    n = len(found)
    words = np.array([0, 0, *(len(t.split()) for t, *_ in found), 0, 0], float)
    links = np.array([0, 0, *(b[1] for b in found), 0, 0], float)
    near = [column[at:at + n] for at in (2, 1, 3, 0, 4) for column in (words, links)]  # the block, one before, one after, two before, two after
    inside = np.array([b[2] for b in found], float)
    none = np.full(n, float(not any(b[2] and not b[3] for b in found)))
    aside = np.array([b[3] for b in found], float)
    return np.column_stack([*near, inside, none, aside])


#: Labelled blocks: pages, and of each block in page order whether it belongs to the main text.
LABELLED = (
    ("<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News and more news</a></li></ul></nav><article><h1>A title of some words</h1><p>The first paragraph has quite a few words, as most do.</p><p>Short.</p><p>It goes on here with another dozen words that tell the rest of it.</p></article><footer>Copyright of someone, all rights reserved everywhere.</footer>", "0011110"),
    ("<header><h1>Site name</h1><p>We write about everything in the world every day</p></header><main><h2>Only a heading</h2><p>One.</p><p>A paragraph with a <a href=/x>link within</a> its many words, not made of it.</p></main><aside><h3>Popular now</h3><p>A teaser text with many words that belongs beside the article and not to it.</p></aside>", "0011100"),
    ("<div class=ad>Buy now this thing that is very cheap and very good for you all.</div><article><p>Text of the article starts here and has a number of words.</p><div class=advert>Another offer of many words stands between the two paragraphs here.</div><p>Then it ends.</p></article><div id=cookie-notice>We use cookies to make this page work, please accept all of them now.</div>", "01010"),
    ("<article><p>Words that are read by people who like to read such words.</p><section class=comments><p>First reader: I liked reading this very much, thanks to all of you.</p><p>Nice.</p></section></article><form><p>Your name and your address please write them in here.</p><label>Name</label></form>", "10000"),
    ("<div><a href=/1>One</a> <a href=/2>Two</a> <a href=/3>Three</a></div><div>Here the text has no article around it but many words in a long row, which go on for a while and then some more, until the block ends.</div><div>The next block is long too, with a good many words that follow one another until they all have come to an end.</div><div>Terms</div><div><a href=/4>About us</a></div>", "01100"),
    ("<div>Menu</div><div>A body of words without any article around it, which is long enough to be told apart by nothing but its count of words.</div><p>Small print</p>", "010"),
    ("<article><ul><li>An item</li><li>Another item of the list</li></ul><p><a href=/all>All of this line is a link but it is in the article</a></p><p>End.</p></article>", "1111"),
    ("<div class=sidebar><p>Words beside the text that are long enough to look like a paragraph of it.</p></div><div class=article><p>Some.</p><p>More words of the main part, enough of them to make a line.</p></div><div class=newsletter>Subscribe to our letter and get news every single week for free.</div>", "0110"),
    ("<p><a href=/p>Previous page</a></p><p>A page of plain paragraphs, the first of which has more than twenty words so that one can see that it is text.</p><p>The second one follows with as many words or more, and so it is easily seen that this belongs to the text.</p><p><a href=/n>Next page</a></p>", "0110"),
    ("<div>The daily paper of all the towns around here</div><article><h1>Heading</h1><p>Text of the article in some words.</p><p>End.</p></article><div>Number 12</div>", "01110"),
    ("<div><p>Welcome back, dear reader, to the pages of our paper, which has many things to read.</p></div><main><p>One.</p><p>Some more words of it.</p></main><p>Printed in town</p><div>Back to top</div>", "01100"),
    ("<nav>Skip to the content of this page please</nav><article><header><h1>Heading</h1></header><p>Body.</p><footer>Filed under many things</footer></article><div role=dialog>Sign in now to read all of it without any limits at all.</div>", "01100"),
)


#: Labelled outlines of pages without an article element. Main text: H heading, P paragraph, S short line, Q paragraph with a link.
#: Beside it: l link, b menu of several links, t teaser of words and a link, w single word, c small print, k link list of an index.
OUTLINES = """
bHPPPcl lllHPSPPkk bHSPPQPc wlHPPtHPkc bHPPSPPPllc llHQPQPtttc bHPSSPc wwHPPPc bHSPSPc lHPPPPPPPPl
bkkkkHPPc lllHSPPPwc bHPHPHPc bHQQPkkkc lHPSPtc bbHPPPbb tttHPPPttt wHPPSPPw lllllHPPPlllll cHPPPc
bSPPPc bPPPPb lPSPSPl tPPPt wPPQPPw bHPSHSPc llHPPHPPkkk bHPtc bHSPPSSPPc kkkHPPkkk
P PP HP HPP PPP HPPP SP l c w ll bl lP Pl bP Pc HPS HPSP llHSPPl bHSPSPll llHPSPPPl lHPSPPl
lHPQPSPQl bHPPPPcc bwHPPwc blHPPSlb ttHPSPPtt bHPPQHQPPb lSPPSl bHPPSc kHPPPPk cbHPPPPbc
""".split()


def outline_page(outline: str, turn: int = 0) -> tuple[str, str]:
    """The page of an outline and its labels; ``turn`` varies the numbers of words."""
    parts, labels = [], []
    for i, kind in enumerate(outline):
        v = (7 * i + 3 * turn + len(outline)) % 10
        words = " ".join(["word"] * {"H": 2 + v % 6, "P": 15 + 5 * v, "S": 2 + v % 6, "Q": 16 + 4 * v, "l": 1 + v % 3, "b": 1, "t": 5 + v % 7,
                                     "w": 1 + v % 2, "c": 4 + v % 6, "k": 4 + v % 5}[kind])
        link = f"<a href=/{i}>{words if kind in 'lk' else 'some link'}</a>"
        body = {"l": link, "k": link, "b": " ".join([f"<a href=/{i}>item</a>"] * (3 + v % 5)), "t": f"{words} <a href=/{i}>and then read on here now</a>",
                "Q": f"{words} {link} {words}"}.get(kind, words)
        parts.append(f"<h2>{body}</h2>" if kind == "H" else f"<div>{body}</div>")
        labels.append("1" if kind in "HPSQ" else "0")
    return "".join(parts), "".join(labels)


def labelled_blocks() -> list[tuple[float, list[float]]]:
    out = []
    for html, labels in (*LABELLED, *(outline_page(o, turn) for turn in range(4) for o in OUTLINES)):
        rows = features(blocks(html))
        if len(rows) != len(labels):
            raise ValueError(f"{len(labels)} labels for {len(rows)} blocks: {html[:60]}")
        out += [(float(label), [float(x) for x in row]) for label, row in zip(labels, rows, strict=True)]
    return out


#: A tree as text rules: (feature, threshold, left, right) or a leaf's class.
Tree = tuple


def train(spark: SparkSession) -> Tree:
    """The tree of the labelled table: below its root, pages that mark an article and pages that do not are learned apart."""
    rows = labelled_blocks()
    marked = FEATURES.index("no_article")

    def read(node) -> Tree:
        if node.numDescendants() == 0:
            return (bool(node.prediction() > 0.5),)
        split = node.split()
        return split.featureIndex(), float(split.threshold()), read(node.leftChild()), read(node.rightChild())

    def fit(part: list) -> Tree:
        table = spark.createDataFrame(part, "label double, x array<double>").select("label", array_to_vector("x").alias("features"))
        model = DecisionTreeClassifier(maxDepth=10, minInstancesPerNode=2, maxBins=64, seed=1).fit(table)
        return read(model._call_java("rootNode"))

    return marked, 0.5, fit([r for r in rows if not r[1][marked]]), fit([r for r in rows if r[1][marked]])


def judge(tree: Tree, rows: np.ndarray) -> np.ndarray:
    """Class of each row of features."""
    if len(tree) == 1:
        return np.full(len(rows), tree[0])
    at, threshold, left, right = tree
    goes = rows[:, at] <= threshold
    if goes.all():
        return judge(left, rows)
    if not goes.any():
        return judge(right, rows)
    out = np.empty(len(rows), bool)
    out[goes], out[~goes] = judge(left, rows[goes]), judge(right, rows[~goes])
    return out


def extract(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, n_kept of every row of ``pages(page_id, url, html)``.

    The whole html is read. Character references are decoded, white space
    inside a block is one space, the blocks of the main text are joined by a
    line feed. A null or empty html has an empty text. Unclosed or stray tags,
    comments and quotes are taken as browsers do, roughly. Repeated rows get
    equal results; an empty table gives an empty one.
    """
    tree = train(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_blocks, n_kept = [], [], []
            for html in batch.column(2).to_pylist():
                found = blocks(html or "")
                kept = [b[0] for b, ok in zip(found, judge(tree, features(found)), strict=True) if ok]
                texts.append("\n".join(kept))
                n_blocks.append(len(found))
                n_kept.append(len(kept))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array(n_blocks, pa.int64()), pa.array(n_kept, pa.int64())], ["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"])

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long, n_kept long")
