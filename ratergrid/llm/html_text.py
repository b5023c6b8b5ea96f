"""Main text of web pages by a minimum cut between content and boilerplate.

A page becomes a sequence of text blocks. What a fixed linear classifier says about a block, from its place, words and
links, becomes the capacity of its arc to the source (content) or the sink (boilerplate); neighbouring blocks, and
blocks with the same parent, are joined by edges that are the stronger the more of their ancestors they share. The
minimum cut of this graph labels all blocks of a page at once.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Generator, Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ratergrid.llm.common import quoted, whole_text
from ratergrid.llm.mincut import label

#: Where markup may begin, markup, and markup in a page with a quote that never ends, where any > ends a tag.
_OPEN = re.compile(r"<(?=/?[a-zA-Z]|[!?])")
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*+>|<\?[^>]*+>|"
    r"<(/?)([a-zA-Z][^\s/>]*+)([^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+)>", re.S)
_PLAIN_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_ATTRIBUTE = re.compile(r"([\w:-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Elements as the HTML standard names them.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style noscript template iframe svg textarea title select annotation annotation-xml".split())
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp "
              "small span strike strong sub sup time tt u var wbr img "
              "math mi mn mo ms mtext mrow mfrac msup msub msubsup msqrt mroot mover munder munderover mstyle mpadded mphantom "
              "mfenced menclose mtable mtr mtd mspace mmultiscripts semantics".split())
_BOILER_TAGS = set("nav footer aside menu dialog button fieldset".split())
_MAIN_TAGS = {"article", "main"}
#: What a head may hold; anything else ends it.
_HEAD = set("head base link meta title style script noscript template".split())
#: Whole names in class, id, role and itemprop that stand for boilerplate or content.
_BOILER_NAMES = set(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments consent "
    "contentinfo cookie cookies copyright disclaimer disqus footer form gdpr legal login masthead menu menubar modal nav "
    "navbar navigation newsletter notice notices notification overlay pagination pager paywall popup privacy promo "
    "promoted promotion recommended related replies reply respond search share sharing sidebar sidenav signup skip social "
    "sponsor sponsored subscribe subscription tags teaser toolbar topbar tracking widget "
    "ad-banner ad-container ad-slot ad-wrapper banner-ad google-ad breadcrumb-nav comment-form comment-list comments-area "
    "comments-section post-comments consent-banner cookie-banner cookie-bar cookie-consent cookie-notice cookie-popup "
    "footer-menu footer-nav page-footer site-footer site-header page-header-nav header-menu main-menu main-nav main-navigation "
    "nav-bar nav-links nav-menu post-navigation site-navigation top-bar top-nav newsletter-form newsletter-signup "
    "privacy-notice copyright-notice legal-notice related-articles related-content related-links related-posts search-form "
    "side-bar share-bar share-buttons share-links social-icons social-links social-media social-share skip-link sponsored-content "
    "widget-area".split())
_MAIN_NAMES = set("article articlebody content entry main post story article-body article-content article-text content-body "
                  "content-main entry-content main-article main-content page-content post-body post-content story-body "
                  "story-content".split())
#: Names of reader comments, whatever else an element is called.
_COMMENT_NAMES = set("comment comments commentlist comment-list comment-body comments-area comments-section comment-section "
                     "comment-thread comment-form post-comments disqus disqus-thread respond".split())
#: Words of a compound name that only say how an element is laid out: 'ad-box' is an 'ad'.
_LAYOUT_WORDS = set(
    "box container wrapper wrap slot unit area bar block banner section inner outer top bottom left right side center header "
    "footer list item items link links button buttons icon icons panel holder frame group row col column widget module "
    "menu nav site page global primary secondary mobile desktop small large sticky fixed".split())
#: Least words of a block that reads as prose.
PROSE_WORDS = 8
#: Weights of the classifier. The first four are the prior of a block outside any named place.
BASE, PER_WORD, SENTENCE, LINKED = -0.8, 0.08, 0.8, -4.0
IN_MAIN, BESIDE_MAIN, IN_BOILER = 8.0, -4.0, -40.0
#: In place of the main ones for a block in an element whose names stand for boilerplate; neighbours can outweigh it.
IN_NAMED = -4.5
MOST_WORDS = 40
ADJACENT, SAME_PARENT, SHARED = 0.5, 0.3, 0.5


@dataclass
class Block:
    """Text between block boundaries: where it stands and what leads to it."""

    text: str
    links: int
    parent: int
    depth: int
    shared: int
    main: bool
    boiler: bool
    named: bool
    form: int = 0


@dataclass
class _Element:
    """An open element, what it stands in, and the place in the stack of the nearest one that is not inline."""

    tag: str
    number: int
    main: bool
    boiler: bool
    named: bool
    link: bool
    form: int
    block: int


def _is_boiler(name: str) -> bool:
    """Whether a name stands for boilerplate: as a whole, or as a word besides words of layout."""
    if name in _BOILER_NAMES:
        return True
    words = name.split("-")
    telling = [w for w in words if w not in _LAYOUT_WORDS]
    return len(words) > 1 and bool(telling) and all(w in _BOILER_NAMES for w in telling)


def _place(tag: str, attributes: str, main: bool, boiler: bool, named: bool) -> tuple[bool, bool, bool]:
    """Whether an element stands for main content, for boilerplate, or only has its name, given what it stands in.

    Names never tell against article, main, or an element that also has a main name, but for names of comments.
    """
    if tag in _BOILER_TAGS or tag == "header" and not main:
        return main, True, named
    names = set()
    for name, *values in _ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), "".join(values).lower()
        if name in ("class", "id", "role", "itemprop"):
            names.update(n.replace("_", "-").rstrip("0123456789-") for n in value.split())
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            boiler = True
    if tag in ("html", "body"):
        return main, boiler, named
    if tag != "main" and names & _COMMENT_NAMES:
        return main, True, named
    bad = any(map(_is_boiler, names))
    if tag in _MAIN_TAGS:
        return True, boiler, named and bad
    if names & _MAIN_NAMES:
        return True, boiler, named
    return main, boiler, named or bad


def _markup(html: str) -> Generator[tuple[str, re.Match | None], int | None, None]:
    """Pieces of text, each with the markup that ends it (None at the end).

    The caller may send the place to go on from, to skip a raw element. Every place is looked at a fixed
    number of times: markup without an end is text, and a quote without an end turns quotes off for the rest.
    """
    at, token, last = 0, _TOKEN, html.rfind(">")
    while True:
        text_from = at
        found = None
        while (open_ := _OPEN.search(html, at)) and (open_.start() < last or html.startswith("<!--", open_.start())):
            found = token.match(html, open_.start())
            if not found and token is _TOKEN:
                token = _PLAIN_TOKEN
                found = token.match(html, open_.start())
            if found:
                break
            at = open_.end()
        if not found:
            yield html[text_from:], None
            return
        go_on = yield html[text_from:found.start()], found
        at = found.end() if go_on is None else go_on


def blocks(html: str) -> list[Block]:
    """The text blocks of a page in order. Tags may be unclosed or crossed; raw elements and the head are skipped, and
    the head ends at the first text or element that does not belong in it."""
    out: list[Block] = []
    stack = [_Element("", 0, False, False, False, False, 0, 0)]
    opened: Counter[str] = Counter()
    made, lowest = 1, 0
    texts: list[str] = []
    links = 0
    pages_in_forms: set[int] = set()

    def flush() -> None:
        nonlocal links, lowest
        if texts:
            text = " ".join("".join(texts).split())
            if text:
                own, top = stack[-1], stack[stack[-1].block]
                out.append(Block(text, links, top.number, len(stack), lowest, top.main, own.boiler, own.named, own.form))
                lowest = len(stack)
            texts.clear()
        links = 0

    def say(raw: str) -> None:
        nonlocal links
        if opened["head"]:
            if not raw.strip():
                return
            close("head")
        text = unescape(raw)
        texts.append(text)
        if stack[-1].link:
            links += len(text.strip())

    def close(tag: str) -> None:
        nonlocal lowest
        while True:
            name = stack.pop().tag
            opened[name] -= 1
            if name == tag:
                break
        lowest = min(lowest, len(stack))

    pieces, go_on = _markup(html), None
    while True:
        text, found = pieces.send(go_on)
        go_on = None
        if text:
            say(text)
        if not found:
            break
        tag = found.group(2)
        if not tag:
            continue
        tag = tag.lower()
        if tag == "br":
            texts.append(" ")
            continue
        if tag not in _INLINE:
            flush()
        if found.group(1):
            if opened[tag]:
                close(tag)
            continue
        if opened["head"] and tag not in _HEAD:
            close("head")
        if tag in _VOID or found.group(3).endswith("/"):
            continue
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}\b", re.I).search(html, found.end())
            go_on = html.find(">", end.end()) + 1 if end else 0
            go_on = go_on or len(html)
            continue
        if tag not in _INLINE:
            for inner in ("p", "li"):
                if opened[inner] and (tag == inner or inner == "p") and stack[stack[-1].block].tag == inner:
                    close(inner)
        outer = stack[-1]
        main, boiler, named = _place(tag, found.group(3), outer.main, outer.boiler, outer.named)
        form = made if tag == "form" else outer.form
        if main and not outer.main and form:
            pages_in_forms.add(form)
        stack.append(_Element(tag, made, main, boiler, named, outer.link or tag == "a", form,
                              outer.block if tag in _INLINE else len(stack)))
        opened[tag] += 1
        made += 1
    flush()
    _judge_forms(out, pages_in_forms)
    return out


def _judge_forms(found: list[Block], pages: set[int]) -> None:
    """Forms are boilerplate, but for those that the page itself lies in: they open its main part, or hold most of its
    prose (of its words, if it has no prose)."""
    prose: Counter[int] = Counter()
    words: Counter[int] = Counter()
    for b in found:
        if not b.boiler:
            n = b.text.count(" ") + 1
            words[b.form] += n
            if n >= PROSE_WORDS and b.text[-1] in ".!?":
                prose[b.form] += n
    held = prose or words
    total = held.total()
    for b in found:
        if b.form and b.form not in pages and 2 * held[b.form] <= total:
            b.boiler = True


def gains(found: list[Block]) -> list[float]:
    """The classifier's log-odds of content."""
    has_main = any(b.main and not b.boiler and not b.named for b in found)
    out = []
    for b in found:
        gain = BASE + PER_WORD * min(b.text.count(" ") + 1, MOST_WORDS) + LINKED * min(1.0, b.links / len(b.text))
        gain += SENTENCE * (b.text[-1] in ".!?\"'”»:;")
        gain += IN_NAMED if b.named else IN_MAIN * b.main + BESIDE_MAIN * (has_main and not b.main)
        gain += IN_BOILER * b.boiler
        out.append(gain)
    return out


def smoothness(found: list[Block]) -> dict[tuple[int, int], float]:
    """Edges between neighbours, and between blocks and the last one before them with the same parent."""
    edges: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if i:
            depth = max(b.depth, found[i - 1].depth)
            edges[i - 1, i] = ADJACENT + SHARED * min(b.shared, depth) / depth
        if b.parent in last:
            j = last[b.parent]
            edges[j, i] = edges.get((j, i), 0.0) + SAME_PARENT
        last[b.parent] = i
    return edges


def main_text(html: str) -> tuple[str, int, int]:
    """Text of the content blocks, their number and the number of all blocks."""
    found = blocks(html)
    kept = [b.text for b, up in zip(found, label(gains(found), smoothness(found))) if up]
    return " ".join(kept), len(kept), len(found)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, kept, total = [], [], []
        for html in batch.column(batch.num_columns - 1):
            text, k, n = main_text(html.as_py())
            texts.append(text)
            kept.append(k)
            total.append(n)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(kept, pa.int64()), pa.array(total, pa.int64())],
            names=[*batch.schema.names[:-1], "text", "content_blocks", "blocks"])


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars, content_blocks, blocks.

    NULL and empty pages, and pages without text, give the empty text. Repeated rows give one row each; NULL ids and
    urls are kept. A page without any named place is judged by words, sentences and links alone. An empty
    table gives no rows. Columns besides the three named are not read.
    """
    source = pages.select(F.col(quoted(id_col)).alias("page_id"), F.col(quoted(url_col)).alias("url"),
                          whole_text(html_col).alias("_html"))
    kinds = [source.schema[i].dataType.simpleString() for i in (0, 1)]
    return source.mapInArrow(
        functools.partial(_extract), f"page_id {kinds[0]}, url {kinds[1]}, text string, content_blocks long, blocks long"
    ).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "content_blocks", "blocks")
