"""Main text of web pages by boosted trees over DOM nodes.

A page is read into block-level nodes; each node gets numbers about its subtree (text, link and tag density), its
attribute tokens, depth, siblings and ancestors. Boosted trees give every node the log odds of holding main text, and
the decoding keeps the set of nodes with the largest total in which no node is kept below one that is left out, so
that choices for ancestors and descendants never contradict each other. Text directly in kept nodes is the result.

The trees are fitted on a bounded sample of pages (`SAMPLE`, those first by a hash of the id, of at most `SAMPLE_CHARS`
letters) that mark their article themselves (`article`, `main`, role main). Copies of these pages in which tags are
renamed, attributes dropped and sidebars, notices, forms and comments put in teach the other features.

Blocks end at block-level tags; a line break is white space. Results for odd rows: a null or empty page, or one
without main text, gives an empty text; null ids and urls are returned; repeated rows are read one by one; an empty
table gives no rows; other columns are ignored. Without pages that teach, nodes are judged by the sample's own rules.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from livetick.llm.boosting import Trees
from livetick.llm.common import batches, sampled, table

SAMPLE, SAMPLE_CHARS, COPIES = 400, 60_000, 3
BATCH = 64

# Fixed values of HTML: elements without content, with raw text, and those that start and end blocks.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe textarea svg math object select".split())
HEAD = set("head title base meta link".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol p pre search section summary table tbody td "
    "tfoot th thead title tr ul caption button".split()
)
#: A start tag (left) ends open elements (right), up to the nearest of the last column.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}), "tfoot": ({"tr", "td", "th", "thead", "tbody"}, {"table"}),
}
_SCOPE = {"table", "td", "th", "caption", "button", "html"}

#: Words in class, id and role that speak for and against main text.
FOR = set("article content main post entry story body text page".split())
AGAINST = set(
    "ad ads advert adverts advertisement aside banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright "
    "disqus foot footer form gdpr head header legal login masthead menu meta modal nav navbar navigation newsletter notice "
    "pagination popup promo promoted recommended related reply replies search share sharing sidebar signup skip social sponsor "
    "sponsored subscribe tags toolbar topbar widget contentinfo complementary".split()
)
_BAD_TAGS = set("nav header footer aside form menu dialog button fieldset".split())
_GOOD_TAGS = set("article main".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?"
    r"|</([a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|itemprop|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_PART = re.compile(r"[a-z]+|[A-Z][a-z]*")


class Page:
    """Block-level nodes of a page in order, and its text pieces with the node each stands in."""

    def __init__(self, source: str | None) -> None:
        self.tags, self.parents, self.tokens = ["#page"], [-1], [frozenset()]
        #: (node, text, inside a link), and (node, None, False) where a block may end.
        self.pieces: list[tuple[int, str | None, bool]] = []
        self._read(source or "")

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int]] = [("#page", 0)]
        #: Places in the stack of the open elements of each name, and of all block elements.
        places: dict[str, list[int]] = {}
        blocks, seen = [0], {"#page"}
        links, hidden, at, end = 0, 0, 0, len(source)

        def close(depth: int) -> None:
            nonlocal links, hidden
            while len(stack) > depth:
                tag, node = stack.pop()
                places[tag].pop()
                links -= tag == "a"
                hidden -= tag in HEAD
                if tag in BLOCK:
                    blocks.pop()
                    self.pieces.append((stack[-1][1], None, False))

        def last(tags: set[str]) -> int:
            """Place of the innermost open element of these names, 0 if there is none."""
            return max((own[-1] for t in tags if (own := places.get(t))), default=0)

        def ended(tags: set[str], scope: set[str]) -> None:
            """Close open elements of these names, the innermost first, that no element of the scope lies above."""
            while (i := last(tags)) and i >= last(scope):
                close(i)

        while at < end:
            found = _TOKEN.search(source, at)
            stop = found.start() if found else end
            if stop > at and not hidden:
                self.pieces.append((stack[-1][1], html.unescape(source[at:stop]), links > 0))
            if not found:
                break
            at = found.end()
            if found[1]:
                tag = found[1].lower()
                # The end of an inline element that a block has already ended closes nothing.
                if (i := last({tag})) and (tag in BLOCK or i > blocks[-1]):
                    close(i)
                continue
            if not (found[2] or found[4]):
                if found[0].startswith("<![CDATA[") and not hidden:
                    self.pieces.append((stack[-1][1], found[0][9:].removesuffix("]]>"), links > 0))
                continue
            tag, attributes = (found[2] or found[4]).lower(), found[3] or found[5] or ""
            if tag in VOID:
                if tag in ("br", "hr", "wbr") and not hidden and tag != "wbr":
                    self.pieces.append((stack[-1][1], " ", False))
                continue
            if tag in RAW:
                if not attributes.rstrip().endswith("/") or tag not in ("svg", "math"):
                    close_at = re.compile(f"</{tag}[\\s/>]", re.I).search(source, at)
                    at = source.find(">", close_at.start()) + 1 or end if close_at else end
                self.pieces.append((stack[-1][1], " ", False))
                continue
            if tag in BLOCK:
                if tag not in HEAD:  # what belongs to the body ends an open head
                    ended({"head", "title"}, set())
                    ended({"p"}, _SCOPE)
                if tag in ENDS:
                    ended(*ENDS[tag])
                elif tag[0] == "h" and tag[1:].isdigit() and stack[-1][0][0] == "h" and stack[-1][0][1:].isdigit():
                    close(len(stack) - 1)
                if tag in ("html", "body") and tag in seen:
                    continue
                seen.add(tag)
                self.parents.append(stack[-1][1])
                self.tags.append(tag)
                words = _PART.findall(" ".join(m[1].strip("\"'") for m in _ATTRIBUTE.findall(attributes))) if attributes else ()
                self.tokens.append(frozenset(w.lower() for w in words))
                blocks.append(len(stack))
                stack.append((tag, len(self.tags) - 1))
                self.pieces.append((stack[-1][1], None, False))
            else:
                stack.append((tag, stack[-1][1]))
            places.setdefault(tag, []).append(len(stack) - 1)
            links += tag == "a"
            hidden += tag in HEAD
        close(1)

    def text(self, kept: np.ndarray) -> str:
        """The blocks of kept nodes, one a line."""
        blocks, run = [], []
        for node, piece, _ in self.pieces:
            if piece is None:
                if run:
                    blocks.append(" ".join("".join(run).split()))
                    run = []
            elif kept[node]:
                run.append(piece)
        if run:
            blocks.append(" ".join("".join(run).split()))
        return "\n".join(b for b in blocks if b)


# Order of the numbers of a node.
_OWN = "depth letters words links_share stops own_letters tags_per_word children siblings_alike place".split()
_KIND = "bad_tag good_tag heading paragraph item list container table for_tokens against_tokens".split()
_AROUND = "page_share from_start to_end parent_links parent_share bad_above good_above against_above for_above next_words last_words".split()
FEATURES = len(_OWN) + len(_KIND) + len(_AROUND)


def features(page: Page) -> np.ndarray:
    """The numbers of every node, in document order."""
    n = len(page.tags)
    letters, words, link, stops, own = (np.zeros(n) for _ in range(5))
    first = np.full(n, -1.0)
    seen = 0.0
    for node, piece, linked in page.pieces:
        if piece is None or not (size := len(piece)) or piece.isspace():
            continue
        if first[node] < 0:
            first[node] = seen
        seen += size
        letters[node] += size
        own[node] += size
        words[node] += piece.count(" ") + 1
        stops[node] += piece.count(". ") + piece.count(", ") + piece.endswith(".")
        link[node] += size * linked
    tags, parents = page.tags, page.parents
    nodes, children = np.ones(n), np.zeros(n)
    for i in range(n - 1, 0, -1):  # children come after their parents
        p = parents[i]
        letters[p] += letters[i]
        words[p] += words[i]
        stops[p] += stops[i]
        link[p] += link[i]
        nodes[p] += nodes[i]
        children[p] += 1
        if first[i] >= 0 and (first[p] < 0 or first[i] < first[p]):
            first[p] = first[i]
    total = max(letters[0], 1.0)
    alike: dict[tuple[int, str], int] = {}
    by_parent: dict[int, list[int]] = {}
    for i in range(1, n):
        alike[parents[i], tags[i]] = alike.get((parents[i], tags[i]), 0) + 1
        by_parent.setdefault(parents[i], []).append(i)
    around = {i: (kin[k - 1] if k else 0, kin[k + 1] if k + 1 < len(kin) else 0, k / len(kin))
              for kin in by_parent.values() for k, i in enumerate(kin)}
    depth = [0] * n
    above = [(0, 0, 0, 0)] * n
    rows = np.zeros((n, FEATURES))
    for i in range(n):
        p, tag, tokens = parents[i], tags[i], page.tokens[i]
        bad, good, against, kind_for = tag in _BAD_TAGS, tag in _GOOD_TAGS, len(tokens & AGAINST), len(tokens & FOR)
        if p >= 0:
            depth[i] = depth[p] + 1
        up = above[p] if p >= 0 else (0, 0, 0, 0)
        before, after, place = around.get(i, (0, 0, 0.0))
        link_share = link[i] / max(letters[i], 1)
        start = max(first[i], 0) / total
        rows[i] = (
            depth[i], np.log1p(letters[i]), np.log1p(words[i]), link_share, stops[i] / max(words[i], 1), np.log1p(own[i]),
            nodes[i] / (words[i] + 1), children[i], alike.get((p, tag), 1), place,
            bad, good, len(tag) == 2 and tag[0] == "h" and tag[1].isdigit(), tag in ("p", "pre", "blockquote"), tag in ("li", "dd", "dt"),
            tag in ("ul", "ol", "dl"), tag in ("div", "section"), tag in ("table", "tr", "td", "th"), kind_for, against,
            letters[i] / total, start, 1 - start - letters[i] / total,
            link[p] / max(letters[p], 1) if p >= 0 else 0, letters[i] / max(letters[p], 1) if p >= 0 else 1,
            *up, np.log1p(words[after]) if after else 0, np.log1p(words[before]) if before else 0,
        )
        above[i] = (up[0] or bad, up[1] or good, up[2] + against, up[3] + kind_for)
    return rows


def taught(page: Page) -> np.ndarray | None:
    """Whether each node holds main text by the page's own marks; None for a page without such marks."""
    n = len(page.tags)
    inside, out = np.zeros(n, bool), np.zeros(n, bool)
    for i in range(1, n):
        p = page.parents[i]
        mark = page.tags[i] in _GOOD_TAGS or "main" in page.tokens[i]
        inside[i] = inside[p] or mark
        out[i] = out[p] or (page.tags[i] in _BAD_TAGS) or bool(page.tokens[i] & AGAINST and not mark)
    main = np.zeros(n, bool)
    for node, piece, _ in page.pieces:
        if piece and not piece.isspace() and inside[node] and not out[node]:
            main[node] = True
    if not main.any():
        return None
    for i in range(n - 1, 0, -1):
        main[page.parents[i]] |= main[i]
    return main


_EXTRA = [
    '<aside class="sidebar"><h3>{a}</h3><ul><li><a href="#">{b}</a></li><li><a href="#">{a}</a></li></ul></aside>',
    '<div class="sidebar"><p>{a}</p></div>', '<div class="cookie-notice"><p>{a}</p><button>{b}</button></div>',
    '<form action="/s"><p>{a}</p><label>{b}</label><input name="q"></form>', '<div id="comments"><h2>{b}</h2><div class="comment"><p>{a}</p></div></div>',
    '<section class="comments"><article class="comment"><p>{a}</p></article></section>', '<header class="site-header"><h1>{b}</h1><p>{a}</p></header>',
    '<div class="ad">{a}</div>', '<div class="related"><h3>{b}</h3><ul><li><a href="#">{a}</a></li></ul></div>', '<div class="share"><a href="#">{b}</a> {a}</div>',
    '<div role="alert" class="notice">{a}</div>', '<div class="newsletter"><p>{a}</p></div>', '<footer><p>{a}</p></footer>',
    '<nav class="breadcrumb"><a href="#">{b}</a></nav>',
]

#: Parts that belong to an article when they stand in one.
_INSIDE = [
    "<ul><li>{a}</li><li>{b}</li><li>{a}</li></ul>", "<ol><li>{a}</li><li>{a}</li></ol>", "<h2>{b}</h2>", "<h3>{b}</h3><p>{a}</p>",
    "<blockquote><p>{a}</p></blockquote>", '<div class="text"><p>{a}</p></div>', "<div><p>{a}</p><p>{a}</p></div>", "<pre>{a}</pre>",
    "<table><tr><td>{b}</td><td>{a}</td></tr></table>", '<section><p>{a} <a href="#">{b}</a> {a}</p></section>', "<figure><figcaption>{a}</figcaption></figure>",
]


def varied(source: str, rng: random.Random, words: list[str]) -> str:
    """A copy of a page with strange parts put in at ends of its blocks, for teaching."""
    spots = [m.end() for m in re.finditer(r"</p>|</h1>|</div>|</nav>|<body[^>]*>|<article[^>]*>", source)]
    for spot in sorted(rng.sample(spots, min(len(spots), rng.randint(0, 4))), reverse=True):
        text = lambda most: html.escape(" ".join(rng.choices(words, k=rng.randint(1, most))))
        inside = source.rfind("<article", 0, spot) > source.rfind("</article", 0, spot)
        kinds = _INSIDE if inside and rng.random() < 0.6 else _EXTRA
        source = source[:spot] + rng.choice(kinds).format(a=text(60), b=text(4)) + source[spot:]
    return source


def without_marks(page: Page, rng: random.Random) -> None:
    """Rename tags and drop attribute tokens in place, after the page has been labelled."""
    tags, tokens = rng.random() < 0.5, rng.random() < 0.5
    for i, tag in enumerate(page.tags):
        if tags and (tag in _GOOD_TAGS or tag in _BAD_TAGS and rng.random() < 0.5):
            page.tags[i] = "div"
            if rng.random() < 0.7:
                page.tokens[i] = page.tokens[i] | {"content" if tag in _GOOD_TAGS else tag}
        elif tokens and rng.random() < 0.5:
            page.tokens[i] = frozenset()


class Extractor:
    """The fitted trees and the decoding."""

    def __init__(self, trees: Trees | None) -> None:
        self.trees = trees

    def kept(self, page: Page, odds: np.ndarray) -> np.ndarray:
        """The best consistent choice: a node may be kept only if the one above it is."""
        n = len(page.tags)
        gain = odds.copy()
        gain[0] = 0.0
        own = np.zeros(n)
        for i in range(n - 1, 0, -1):
            own[i] += gain[i]
            if own[i] > 0:
                own[page.parents[i]] += own[i]
        kept = np.zeros(n, bool)
        kept[0] = True
        for i in range(1, n):
            kept[i] = kept[page.parents[i]] and own[i] > 0
        return kept

    def texts(self, sources: list[str | None]) -> list[str]:
        pages = [Page(s) for s in sources]
        if self.trees is None:
            return [p.text(taught(p) if taught(p) is not None else self.kept(p, _rule(p))) for p in pages]
        rows = [features(p) for p in pages]
        odds = np.split(self.trees.margin(np.concatenate(rows)), np.cumsum([len(r) for r in rows])[:-1]) if rows else []
        return [p.text(self.kept(p, o)) for p, o in zip(pages, odds, strict=True)]


def _rule(page: Page) -> np.ndarray:
    return np.array([-1.0 if t in _BAD_TAGS or k & AGAINST else 1.0 for t, k in zip(page.tags, page.tokens, strict=True)])


def fit(sources: list[str], copies: int = COPIES) -> Extractor:
    """Trees over the nodes of the pages that teach, and of varied copies of them."""
    rng = random.Random(11)
    words = [w for s in sources for w in re.sub(r"<[^>]*>", " ", s).split()[:200]] or ["a"]
    x, y = [], []
    for source in sources:
        for k in range(copies):
            page = Page(varied(source, rng, words) if k else source)
            main = taught(page)
            if main is None:
                break
            if k:
                without_marks(page, rng)
            rows = features(page)
            some = rows[:, 1] > 0  # nodes without text teach nothing
            x.append(rows[some])
            y.append(main[some])
    if not x:
        return Extractor(None)
    return Extractor(Trees(np.concatenate(x), np.concatenate(y).astype(float)))


def learned(pages: DataFrame) -> Extractor:
    known = pages.where(F.col("html").isNotNull() & (F.length("html") <= SAMPLE_CHARS))
    rows = sampled(known.select("page_id", "html"), SAMPLE, "page_id", "html").collect()
    return fit([r["html"] for r in rows])


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    extractor = learned(pages)

    @F.pandas_udf("string")
    def text(sources: pd.Series) -> pd.Series:
        out: list[str] = []
        for at in range(0, len(sources), BATCH):
            out += extractor.texts(sources.iloc[at : at + BATCH].tolist())
        return pd.Series(out, dtype=object)

    out = pages.select("page_id", "url", text("html").alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op7_html_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every whole page."""
    return extracted(table(spark, sf_dir, "pages"))
