"""HTML main text by two passes of block rules.

A page is cut into blocks at block-level tags.  The first pass decides blocks by where
they stand (menus, forms, notices and the like are boilerplate), by link density,
and by length and stop-word density; short blocks and blocks between the limits stay
ambiguous.  In the second pass an ambiguous block takes the label of its nearest decided
neighbours, first of those in the same article or main element.  Such an element is a prior, no verdict: it sets the rest of
the page aside only if it holds at least half of the running text, and inside it blocks without evidence stay ambiguous.

Spark deals out the pages; each page is read in one go by whichever task holds it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_text, freed, small_batches

#: Element names of the HTML standard.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead "
    "title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose end tag may be left out: a new one ends an open one, up to the container named.
SELF_ENDING = {"p": "p", "li": "li", "dt": "dt", "dd": "dd", "tr": "tr", "td": "td", "th": "th"}
#: Elements whose content is no running text; the first kind reaches to the page's end when it is not closed.
RAW_TAGS = "script|style|noscript|template|iframe|textarea|title"
SILENT_TAGS = "select|button|svg|canvas|object|math"
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog head fieldset legend button select".split())
MAIN_TAGS = frozenset("article main".split())
#: Function words of English, French, German and Spanish, the languages that the rules know.
STOP_WORDS = frozenset(
    "a an and are as at be by for from has he in is it its of on or that the this to was were will with not have his her they you "
    "au aux avec ce ces dans de des du elle en est et il ils je la le les leur lui mais ne nous ou par pas pour qu que qui sa se ses "
    "son sur un une vous als auf aus bei das dem den der die ein eine einer für im ist mit nach nicht sich sie sind um und von werden "
    "wie zu zum al como con del el ella ellos los las lo más no para pero por sin sobre su sus también una y así si".split()
)
_SIDE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|adslot|sponsor(?:ed)?|promo(?:tion)?s?|banners?|side-?bars?|menus?|nav(?:bar|igation)?|"
    r"footers?|site-?header|page-?header|masthead|top-?bar|comments?|comment-?list|respond|replies|reply|disqus|cookies?|consent|gdpr|"
    r"notices?|alerts?|warnings?|pop-?ups?|modals?|overlays?|newsletters?|subscri(?:be|ption)s?|sign-?up|login|share|sharing|social|"
    r"related|recommend(?:ed|ations?)?|more-?links|breadcrumbs?|widgets?|pagination|pager|tags?-?(?:list|cloud)|tool-?bar|search(?:-?form|-?box)?|"
    r"copyright|legal|disclaimer|skip-?link|hidden|visually-?hidden|sr-only)(?:$|[\s_-])",
    re.IGNORECASE,
)
_MAIN = re.compile(
    r"(?:^|[\s_-])(?:article(?:-?body|-?content|-?text)?|post(?:-?body|-?content)?|entry(?:-?content)?|story(?:-?body)?|main(?:-?content|-?text)?|"
    r"content|body-?text)(?:$|[\s_-])",
    re.IGNORECASE,
)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<(?P<raw>{RAW_TAGS})\b(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    rf"|<(?P<silent>{SILENT_TAGS})\b(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>.*?</(?P=silent)\s*>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)>",
    re.IGNORECASE | re.DOTALL,
)
#: Names of articles that are not the page's own.
_OTHER_ARTICLE = frozenset("comment comments reply replies ad ads advert advertisement teaser related promo sponsored widget".split())
_ATTR = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

#: First-pass limits: characters, shares of words, share of characters in links.
SHORT, LONG, STOP_LOW, STOP_HIGH, MAX_LINKS = 70, 200, 0.15, 0.25, 0.4


@dataclass
class Block:
    text: str
    tag: str
    links: float
    side: bool
    scope: int
    rank: int = 0
    label: str = ""


def _attrs(source: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(source)}


def _is_side(tag: str, attrs: dict[str, str], in_main: bool) -> bool:
    if tag in BOILERPLATE_TAGS or (tag == "header" and not in_main):
        return True
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attrs.get("style", "")):
        return True
    if attrs.get("role", "").lower() in {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu"}:
        return True
    names = f"{attrs.get('class', '')} {attrs.get('id', '')}"
    if tag in MAIN_TAGS and not in_main:
        return not _OTHER_ARTICLE.isdisjoint(names.lower().split())
    return tag not in {"body", "html"} and bool(_SIDE.search(names))


def _main_rank(tag: str, attrs: dict[str, str]) -> int:
    """2 for an article, 1 for another main part of a page, 0 for anything else."""
    if tag == "article" or attrs.get("role", "").lower() == "article" or attrs.get("itemprop", "").lower() == "articlebody":
        return 2
    if tag == "main" or attrs.get("role", "").lower() == "main":
        return 1
    return int(tag in {"div", "section", "td"} and bool(_MAIN.search(f"{attrs.get('class', '')} {attrs.get('id', '')}")))


def cut(html: str) -> list[Block]:
    """The page's blocks in order, without labels."""
    blocks: list[Block] = []
    stack: list[tuple[str, bool, int, bool]] = []  # tag, boilerplate, scope, link
    open_tags: Counter[str] = Counter()
    parts: list[str] = []
    ranks = [0]  # of each scope; a scope is one article or main part
    in_links, last = 0, 0

    def flush() -> None:
        nonlocal in_links
        text = " ".join(unescape("".join(parts)).split())
        if text:
            tag, side, scope, _ = stack[-1] if stack else ("", False, 0, False)
            block_tag = next((t for t, *_ in reversed(stack) if t in BLOCK_TAGS), tag)
            blocks.append(Block(text, block_tag, min(1.0, in_links / len(text)), side, scope, ranks[scope]))
        parts.clear()
        in_links = 0

    def add(text: str) -> None:
        nonlocal in_links
        parts.append(text)
        if stack and stack[-1][3]:
            in_links += len(unescape(text).strip())

    def pop(tag: str) -> None:
        while stack:
            gone = stack.pop()[0]
            open_tags[gone] -= 1
            if gone == tag:
                return

    for m in _TOKEN.finditer(html):
        if m.start() > last:
            add(html[last : m.start()])
        last = m.end()
        if m[0].startswith("<![CDATA["):
            continue
        if m["raw"] or m["silent"]:
            continue
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCK_TAGS:
            flush()
        if m["end"] or m["end2"]:
            if open_tags[tag] > 0:
                pop(tag)
            continue
        if tag in VOID_TAGS:
            continue
        if tag in SELF_ENDING and open_tags[tag] > 0:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    pop(tag)
                    break
                if stack[i][0] in {"ul", "ol", "dl", "table", "div", "section", "article", "main", "body", "blockquote"}:
                    break
        if tag == "body" and open_tags["head"] > 0:
            pop("head")
        attrs = _attrs(m["attrs"] or m["attrs2"] or "")
        _, side, scope, link = stack[-1] if stack else ("", False, 0, False)
        side = side or _is_side(tag, attrs, ranks[scope] == 2)
        if not side and (rank := _main_rank(tag, attrs)) > ranks[scope]:
            ranks.append(rank)
            scope = len(ranks) - 1
        stack.append((tag, side, scope, link or tag == "a"))
        open_tags[tag] += 1
    if last < len(html):
        add(html[last:])
    flush()
    return blocks


def _stop_share(text: str) -> float:
    words = [w.strip("'’") for w in re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)*", text.lower())]
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def first_pass(block: Block) -> str:
    """good, bad, or an empty label for ambiguous; in a main part density alone makes no block bad."""
    if block.side:
        return "bad"
    if block.links > MAX_LINKS:
        return "" if block.scope else "bad"
    if len(block.text) < SHORT:
        return ""
    share = _stop_share(block.text)
    if share >= STOP_HIGH or (share >= STOP_LOW and len(block.text) >= LONG):
        return "good"
    return "bad" if share < STOP_LOW and len(block.text) >= LONG and not block.scope else ""


def _choose_parts(blocks: list[Block]) -> None:
    """Set aside what lies outside the page's articles, or else its main parts, if these hold at least half of the running text.

    Running text is what the first pass calls good, and in main parts all blocks that are neither short nor mostly links
    (they may be in a language that the stop words do not know).  Other parts are left to the block rules.
    """
    held = [0.0, 0.0, 0.0]
    for b in blocks:
        if not b.side and len(b.text) >= SHORT and b.links <= MAX_LINKS and (b.rank or first_pass(b) == "good"):
            held[b.rank] += len(b.text) * (1 - b.links)
    found = {b.rank for b in blocks if not b.side}
    best = next((r for r in (2, 1) if r in found and 2 * sum(held[r:]) >= sum(held)), 0)
    for b in blocks:
        if b.rank > best:
            b.scope = 0
        b.side = b.side or b.rank < best


def second_pass(blocks: list[Block]) -> None:
    """Ambiguous blocks take the label of the nearest decided neighbours.

    In an article, neighbours of the same article count and boilerplate in between does not; an article whose
    blocks are all ambiguous is good.  Elsewhere neighbours that disagree leave a block to the nearer one; at the same
    distance a heading takes that of what follows, and any other block is bad.
    """
    before: list[tuple[int, str] | None] = [None] * len(blocks)
    after: list[tuple[int, str] | None] = [None] * len(blocks)
    for order, found, step in ((range(len(blocks)), before, 1), (range(len(blocks) - 1, -1, -1), after, -1)):
        last: dict[int, tuple[int, str]] = {}
        for i in order:
            found[i] = last.get(blocks[i].scope)
            if blocks[i].label and not (blocks[i].scope and blocks[i].side):
                last[blocks[i].scope] = (i, blocks[i].label)
    for i, b in enumerate(blocks):
        if b.label:
            continue
        if b.scope:
            near = {x[1] for x in (before[i], after[i]) if x}
            b.label = "~good" if "good" in near or not near else "~bad"
            continue
        left, right = before[i], after[i]
        if left is None or right is None or left[1] == right[1]:
            b.label = "~" + (left or right or (0, "bad"))[1]
        elif i - left[0] != right[0] - i:
            b.label = "~" + (left if i - left[0] < right[0] - i else right)[1]
        else:
            b.label = "~" + (right[1] if re.fullmatch(r"h[1-6]", b.tag) else "bad")


def label(html: str) -> list[Block]:
    """The page's blocks with labels good or bad; labels that were inherited begin with ``~``."""
    blocks = cut(html)
    _choose_parts(blocks)
    for b in blocks:
        b.label = first_pass(b)
    second_pass(blocks)
    return blocks


def extract(html: str) -> str:
    """The main text: the good blocks in page order, one on each line."""
    return "\n".join(b.text for b in label(html) if b.label.endswith("good"))


def apply(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars, n_blocks.

    A null page counts as empty and has an empty text.  Ids and urls may be null or repeat; each page is read by itself.
    Other columns are not read.  An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [label(h) for h in arrow_text(batch.column("html")).to_pylist()]
            texts = ["\n".join(b.text for b in bs if b.label.endswith("good")) for bs in found]
            columns = [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(map(len, found), pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), *columns], [id_col, url_col, "text", "n_chars", "n_blocks"])

    kind = pages.schema[id_col].dataType.simpleString()
    rows = small_batches(pages).select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(freed(run), f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars long, n_blocks int")
