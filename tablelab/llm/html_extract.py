"""Main text of web pages by two-pass block rules.

A page is read as a stream of tags and texts and cut into *blocks* at block
level tags (two line breaks in a row also end a block).  Each block knows its
length, its share of characters inside links, its share of stop words, and the
containers around it (elements such as article, nav or aside, and words in
their class, id and role).

Pass 1 decides blocks on their own: bad in boilerplate containers or, outside
articles, when mostly links; good when long with enough stop words, or of some
length inside an article, whatever their links (linked sentences and lists of
references are text of it); everything else is ambiguous.  Inside an article
only strong names (adverts, reader comments, sharing, newsletters, cookies,
hidden parts) make a container boilerplate; other boilerplate words are
evidence: blocks below them need stop words to be good and are bad with links.
The stop words know four languages.  On a page whose long blocks hold almost
none of them no language fits, so sentences decide there: a block of
``MIN_LENGTH`` that ends with a sentence mark, or a long one that holds one or
is written without spaces between words, is good, other blocks are ambiguous.  Pass 2 gives each ambiguous block
the label of its nearest decided neighbours in the same container: good
between two good ones, next to one good one if it is a heading above it or
closer than the bad one, bad otherwise; ambiguous blocks of a container
without any decided block get the container's own label (an article is good,
the rest of a page is bad).  In an article's containers with such a word, ambiguous
blocks are bad if only bad ones are decided there.

Text: character references are decoded, white space inside a block becomes one
space, blocks are trimmed and joined in page order by two line feeds.  Scripts,
styles, templates, comments and form controls have no text.

Defined results: null and empty html give an empty text; unclosed scripts and
comments run to the page's end; repeated rows each get their row; whole pages
are read whatever their length, in time that grows with it (also with unclosed
tags, quotes and elements); extra columns are ignored.
"""

from __future__ import annotations

import html as _html
import re
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelab.llm.common import map_arrow

GOOD, BAD, AMBIGUOUS = "good", "bad", "ambiguous"

MIN_LENGTH = 70        # shorter blocks outside articles are ambiguous
LONG_LENGTH = 200
MIN_STOPWORDS = 0.15
MANY_STOPWORDS = 0.3
MAX_LINKS = 0.5
FEW_LINKS = 0.25       # in an article, below a boilerplate word
ARTICLE_LENGTH = 25    # from this length on a block in an article is good

STOP_WORDS = frozenset("""
the of and to in a is that it for on was as with be by this are at from or an not have has he she they we you but his
her their which will would can all one been were there if more when who what so no out up into about than its
der die das und ist nicht von zu den dem des ein eine mit auf für im sich auch es an als bei nach aus wie war dass
oder aber werden wird sind hat ich sie wir nur noch über um durch einer einem
le la les de du des et est un une que qui dans en pour pas sur au aux avec par ce cette il elle nous vous ils mais ou
se sont plus son sa ses leur être été
el los las del y que en un una es por con no para su al lo como más pero sus ha o este si porque esta entre cuando muy
sin sobre ser son
""".split())

SKIPPED = frozenset("script style template noscript svg annotation annotation-xml canvas iframe object select textarea button title".split())
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre
section summary table tbody td tfoot th thead tr ul""".split())
CLOSED_BY_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 dt dd li".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog head".split())
ARTICLE_TAGS = frozenset("article main".split())
ARTICLE_WORDS = frozenset("articlebody".split())
#: Words in class, id or role that name boilerplate; the first set also counts above an article.
READER_WORDS = frozenset("comment comments commentlist disqus reply replies respond discussion".split())
BOILERPLATE_WORDS = READER_WORDS | frozenset("""
ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted banner
nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar footer bottombar sidebar sidenav aside
cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup
login search searchbox share sharing social related recommended recommendations teaser teasers widget widgets toolbar
pagination pager copyright legal disclaimer complementary contentinfo hidden byline tags trending outbrain taboola
""".split())
#: The ones that decide alone inside an article.
STRONG_WORDS = READER_WORDS - {"discussion", "respond", "reply"} | frozenset("""
ad ads adv advert adverts advertisement advertising adsense sponsor sponsored outbrain taboola
share sharing newsletter cookie cookies hidden
""".split())

_TOKEN = re.compile(
    r"""<!--|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/<>]*)([^>]*)>|<[!?/][^>]*>""")
_NAMES = re.compile(r"""\b(?:class|id|role|itemprop|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"""\bhidden\b(?!\s*=\s*["']?until)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_WORD = re.compile(r"[A-Za-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_COMMENT_END = re.compile(r"--!?>")
_SENTENCE_END = re.compile(r"[.!?…。！？।؟]")
UNSPACED_WORD = 15     # mean length of a block's words from which it is written without spaces


@dataclass
class Block:
    text: str
    link_chars: int
    tag: str
    container: int       # number of the nearest article or boilerplate container
    article: bool
    boilerplate: bool
    weak: bool = False   # in an article, below a boilerplate word that doesn't decide alone
    label: str = AMBIGUOUS


@dataclass
class _Open:
    tag: str
    container: int
    article: bool
    boilerplate: bool
    reader: bool
    weak: bool = False


def _hints(tag: str, attrs: str) -> tuple[set[str], bool]:
    if not attrs or attrs.isspace():
        return set(), False
    words = {w.lower() for v in _NAMES.findall(attrs) for w in _WORD.findall(_CAMEL.sub(" ", v))}
    words |= {w.lower() for v in _NAMES.findall(attrs) for w in re.split(r"[\s\"']+", v)}
    return words, bool(_HIDDEN.search(attrs))


def blocks_of(page: str) -> list[Block]:
    """Blocks of a page in order, not yet labelled."""
    stack = [_Open("", 0, False, False, False)]
    places: dict[str, list[int]] = defaultdict(list)   # tag -> its places in the stack
    out: list[Block] = []
    buffer: list[str] = []
    tag, links, in_link, breaks, containers, at, n = "", 0, 0, 0, 0, 0, len(page)
    lowered: str | None = None
    last_end = page.rfind(">")   # no tag ends after it

    def flush() -> None:
        nonlocal links, breaks
        text = " ".join("".join(buffer).split())
        if text:
            top = stack[-1]
            out.append(Block(text, min(links, len(text)), tag, top.container, top.article, top.boilerplate, top.weak))
        buffer.clear()
        links = breaks = 0

    def add(raw: str) -> None:
        nonlocal links, breaks
        if raw:
            text = _html.unescape(raw) if "&" in raw else raw
            buffer.append(text)
            if not text.isspace():
                breaks = 0
                if in_link:
                    links += len(" ".join(text.split()))

    def push(opened: _Open) -> None:
        places[opened.tag].append(len(stack))
        stack.append(opened)

    def close_down_to(k: int) -> None:
        while len(stack) > k:
            places[stack.pop().tag].pop()

    while at < n:
        m = _TOKEN.search(page, at) if at <= last_end else None
        if m is None:
            comment = page.find("<!--", at)
            add(page[at:] if comment < 0 else page[at:comment])
            break
        add(page[at:m.start()])
        at = m.end()
        if m[0] == "<!--":
            end = _COMMENT_END.search(page, m.start() + 2)
            at = end.end() if end else n
            continue
        close, name, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if close:
            if name == "a":
                in_link = 0
            if name in BLOCKS:
                flush()
                tag = ""
            if places[name]:
                k = places[name][-1]
                if name not in CLOSED_BY_BLOCKS or all(not places[a] or places[a][-1] < k for a in ARTICLE_TAGS):
                    close_down_to(k)
            continue
        if name in SKIPPED:
            if not attrs.rstrip().endswith("/"):
                lowered = page.lower() if lowered is None else lowered
                end = lowered.find("</" + name, at) if len(lowered) == n else _raw_end(page, name, at)
                end = n if end < 0 else end
                at = page.find(">", end) + 1 or n
            continue
        if name == "a":
            in_link = 1
        elif name == "br":
            buffer.append(" ")
            breaks += 1
            if breaks > 1:
                flush()
        if name in VOID and name != "hr":
            continue
        if name in BLOCKS:
            flush()
            if name != "hr":
                while name in BLOCKS and stack[-1].tag in CLOSED_BY_BLOCKS and (
                        stack[-1].tag == name or stack[-1].tag[0] in "ph"):
                    close_down_to(len(stack) - 1)
                tag = name
                up = stack[-1]
                words, hidden = _hints(name, attrs)
                starts = name in ARTICLE_TAGS or bool(words & ARTICLE_WORDS)
                inside = up.article and not up.boilerplate
                reader = up.reader or bool(words & (READER_WORDS & STRONG_WORDS if inside else READER_WORDS))
                listed = name not in ("html", "body") and bool(words & BOILERPLATE_WORDS) and not starts
                named = name not in ("html", "body") and hidden or listed and (not inside or bool(words & STRONG_WORDS))
                bad = reader or name in BOILERPLATE_TAGS or named or name == "header" and not up.article
                if starts and not reader and not hidden:
                    strong = any(places[b] for b in BOILERPLATE_TAGS)
                    containers += 1
                    push(_Open(name, containers, not strong, strong, False))
                elif bad and not up.boilerplate:
                    containers += 1
                    push(_Open(name, containers, up.article, True, reader))
                elif inside and listed:
                    containers += 1
                    push(_Open(name, containers, True, False, reader, True))
                else:
                    push(_Open(name, up.container, up.article, up.boilerplate or bad, reader, up.weak))
    flush()
    return out


def _raw_end(page: str, name: str, at: int) -> int:
    m = re.compile("</" + name, re.I).search(page, at)
    return m.start() if m else -1


def stop_density(text: str) -> float:
    words = [w.strip(".,;:!?()\"'").lower() for w in text.split()]
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def reads_as_text(text: str) -> bool:
    """Whether a block of a language without known stop words is running text."""
    if _SENTENCE_END.search(text, len(text) - 3):   # a quote or bracket may follow the mark
        return True
    words = text.split()
    return len(text) >= LONG_LENGTH and (bool(_SENTENCE_END.search(text)) or len(text) >= UNSPACED_WORD * len(words))


def language_fits(blocks: list[Block]) -> bool:
    """Whether the longer blocks outside boilerplate hold known stop words (true without such blocks)."""
    long = [b.text for b in blocks if not b.boilerplate and len(b.text) >= MIN_LENGTH and b.link_chars <= MAX_LINKS * len(b.text)]
    return not long or stop_density(" ".join(long)) >= MIN_STOPWORDS / 3


def classify(blocks: list[Block]) -> list[Block]:
    """Label all blocks in place (two passes)."""
    known = language_fits(blocks)
    for b in blocks:
        size, density = len(b.text), b.link_chars / len(b.text)
        if b.boilerplate:
            b.label = BAD
        elif b.article and not b.weak:
            b.label = GOOD if size >= ARTICLE_LENGTH else AMBIGUOUS
        elif density > (FEW_LINKS if b.weak else MAX_LINKS) and not b.tag.startswith("h"):
            b.label = BAD
        elif b.weak:
            fits = stop_density(b.text) >= MIN_STOPWORDS if known else reads_as_text(b.text)
            b.label = GOOD if size >= ARTICLE_LENGTH and fits else AMBIGUOUS
        elif not known:
            b.label = GOOD if size >= MIN_LENGTH and reads_as_text(b.text) else AMBIGUOUS
        elif size >= MIN_LENGTH:
            stops = stop_density(b.text)
            if stops >= MANY_STOPWORDS or size >= LONG_LENGTH and stops >= MIN_STOPWORDS:
                b.label = GOOD
            elif size >= LONG_LENGTH and stops < MIN_STOPWORDS / 3:
                b.label = BAD
    decided = [b.label for b in blocks]
    before = _nearest(blocks, decided, range(len(blocks)))
    after = _nearest(blocks, decided, range(len(blocks) - 1, -1, -1))
    for i, b in enumerate(blocks):
        if b.label == AMBIGUOUS:
            (left, a), (right, c) = before[i], after[i]
            if left is None and right is None:
                b.label = GOOD if b.article else BAD
            elif b.weak:
                b.label = GOOD if GOOD in (left, right) else BAD
            elif b.article:
                b.label = BAD if left == right == BAD else GOOD
            elif left == right or left is None or right is None:
                b.label = left or right
            elif b.tag.startswith("h") and right == GOOD:
                b.label = GOOD
            else:
                b.label = left if a < c else right if c < a else BAD
    return blocks


def _nearest(blocks: list[Block], decided: list[str], order: range) -> list[tuple[str | None, int]]:
    """Label and distance of the last decided block of the same container, in ``order``."""
    last: dict[int, tuple[str, int]] = {}
    out: list[tuple[str | None, int]] = [(None, 0)] * len(blocks)
    for i in order:
        c = blocks[i].container
        if decided[i] != AMBIGUOUS:
            last[c] = (decided[i], i)
        elif c in last:
            out[i] = (last[c][0], abs(i - last[c][1]))
    return out


def main_text(page: str | None) -> tuple[str, int, int]:
    """(text, good blocks, all blocks) of a page."""
    blocks = classify(blocks_of(page)) if page else []
    good = [b.text for b in blocks if b.label == GOOD]
    return "\n\n".join(good), len(good), len(blocks)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_good, n_blocks of every page."""
    df = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))

    def run(cols: dict) -> dict:
        got = [main_text(p) for p in cols["html"]]
        return {"page_id": cols["page_id"], "url": cols["url"], "text": [g[0] for g in got],
                "n_chars": [len(g[0]) for g in got], "n_good": [g[1] for g in got], "n_blocks": [g[2] for g in got]}

    types = {f.name: f.dataType.simpleString() for f in df.schema}
    return map_arrow(df, run, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long, "
                              "n_good long, n_blocks long")
