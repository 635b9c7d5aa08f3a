"""HTML extraction by equivalence-class template deduction.

Pages of a host share a template. Each page is read as a sequence of tags, each
together with the path of its open ancestors, and the texts between them. Tags
that occur equally often on every page of the group (the same occurrence
vector) form an equivalence class. A class is valid if its tokens come in the same order on
every page and each of its instances lies within one gap of the classes around
it. Valid classes, nested, are the template; what stands between its tokens is a
slot, named by the path of gaps down to it.

A slot is boilerplate if the page itself says so: it lies inside a menu, header,
footer, sidebar, form, advert, cookie notice or comments, by its tag, its role or
a whole name of its class or id (``has-sidebar`` is no sidebar); or its text
is the same on a share of ``SUPPORT`` of the group's pages, two at least. Text inside an article or main element
is never dropped for being the same everywhere. Pages with the same text outside
menus and so on are copies and count as one page, whatever their markup. If a
page without article and main would lose half of its text or more, that text is
its content and all of it stays. The other slots hold the main text, cut into
blocks at block-level tags.

A main element is main text wherever it stands. An article is too, unless it is
inside an element beside the main text that is closed by its own end tag (a
teaser in a sidebar) and the text outside of such elements is longer. A form that
holds the page's structure (article, main, h1, header, footer, nav, aside) is no
form but the page. Headers inside article and main are theirs, not the page's.

Pages of a host are dealt into groups of about ``GROUP_PAGES`` by a hash of the
page, so a host of any size is many small groups and no page is left out. A
page whose group gives no template (a host with a single page) is read by the
tags alone: its slots are its text nodes. A single page, or copies of one, can't
show which text of unnamed elements is the host's, so all of it stays.

Defined results: null or empty html gives the empty text. A page without url
belongs to the group of pages without a host. Malformed html is read as far as
it goes: an unclosed tag is closed by its parent, a cut page ends its slots.
Repeated rows give repeated results.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.storage import materialise

GROUP_PAGES = 64
#: A token, or text outside article and main, must occur on this share of the group's pages to be part of the template.
SUPPORT = 0.6
#: Hosts of more than one group whose list may be broadcast (a name and a number each).
BROADCAST_HOSTS = 100_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg xmp noembed annotation annotation-xml".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr"
    " math mi mn mo ms mtext mspace mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd mstyle merror mpadded mphantom menclose semantics maction".split()
)
#: Tags whose content is never main text.
OUTSIDE = frozenset(
    "head title script style noscript template iframe svg annotation annotation-xml nav header footer aside form button select option textarea input menu dialog object embed canvas audio video map datalist".split()
)
#: Tags and roles of the elements that hold the main text.
MAIN = frozenset(["article", "main"])
#: Roles of elements beside the main text.
BESIDE_ROLES = frozenset("banner complementary contentinfo dialog alertdialog form menu menubar navigation search".split())
#: Whole names of a class or id (lower case, words joined by "-") that mark content beside the main text.
BESIDE = frozenset(
    "nav navbar navigation menu menubar main-menu main-nav nav-menu site-nav top-nav breadcrumb breadcrumbs pagination pager header masthead site-header page-header topbar"
    " footer colophon site-footer page-footer sidebar side-bar left-sidebar right-sidebar sidebar-left sidebar-right aside ad ads advert adverts advertisement advertisements adsense ad-banner banner-ad"
    " cookie cookies cookie-notice cookie-banner cookie-bar cookie-consent cookie-popup consent gdpr gdpr-notice comment comments comment-list comments-list comments-area disqus disqus-thread"
    " login login-form search-form signup signup-form subscribe-form newsletter newsletter-form contact-form".split()
)
#: Names and tags that mean the page's own only outside article and main.
_OF_PAGE = frozenset("header masthead site-header page-header".split())
#: What a form holds only if it is wrapped around the page.
_STRUCTURE = frozenset("article main h1 header footer nav aside".split())
#: A quote opens a value only after "=".
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)(>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s/>=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_ASKED = frozenset(["role", "class", "id", "hidden", "aria-hidden"])
_WORDS = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")
#: An open element of the key is closed when one of the value begins.
_CLOSES = {"p": frozenset("p div ul ol dl table h1 h2 h3 h4 h5 h6 pre blockquote section article aside header footer nav main form fieldset figure hr address li dt dd tr td th".split()),
           "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}


def _attributes(text: str) -> dict[str, str]:
    """The attributes that matter here; of repeated ones the first."""
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(text) if text.strip() else ():
        if name.lower() in _ASKED:
            out.setdefault(name.lower(), value[1:-1] if value[:1] in ("'", '"') and value[-1:] == value[:1] and len(value) > 1 else value)
    return out


def _beside(tag: str, attributes: dict[str, str], main: bool) -> str:
    """Why an element is beside the main text: its tag, role or name; "" if it isn't."""
    if tag in OUTSIDE and not (main and tag in _OF_PAGE):
        return tag
    if tag in ("html", "body", "main", "article"):
        return ""
    for name, value in attributes.items():
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return "hidden"
        for x in value.split() if name != "aria-hidden" else ():
            x = x.lower() if name == "role" else "-".join(w for w in _WORDS.split(x) if w).lower()
            if x in (BESIDE_ROLES if name == "role" else BESIDE) and not (main and x in _OF_PAGE):
                return x
    return ""


def _main(tag: str, attributes: dict[str, str]) -> bool:
    return tag in MAIN or attributes.get("role", "").strip().lower() in MAIN


class _Element:
    """An open or closed element: what it says of its text."""

    __slots__ = ("tag", "path", "parent", "why", "main", "starts", "ended", "page", "hides", "inside")

    def __init__(self, tag: str, path: str, parent: _Element | None, why: str, starts: bool):
        self.tag, self.path, self.parent, self.why, self.starts = tag, path, parent, why, starts
        self.main = starts or bool(parent and parent.main)
        self.ended = self.page = False


def _settle(elements: list[_Element], texts: list[tuple[str, _Element | None]]) -> None:
    """Set ``hides`` (text is beside the main text) of each element, parents first."""

    def settle(free: bool) -> None:
        for e in elements:
            up = e.parent
            # Elements beside the main text that their own end tag closes.
            closed = bool(up and up.inside) or bool(e.why) and e.ended and not (e.why == "form" and e.page)
            hides = bool(up and up.hides) or bool(e.why) and not (e.why == "form" and e.page)
            if e.starts and not e.why and (e.tag == "main" or free or not closed):
                closed = hides = False
            e.inside, e.hides = closed, hides

    settle(False)
    if any(e.starts and e.hides and not e.why for e in elements):
        kept = sum(len(t.strip()) for t, e in texts if not (e and e.hides))
        before = {e for e in elements if e.hides}
        settle(True)
        if sum(len(t.strip()) for t, e in texts if e in before and not e.hides) <= kept:
            settle(False)


def parse(html: str) -> list[tuple[str, str, bool, bool, bool]]:
    """Tokens of a page in order: (key, text, outside, block, main).

    A tag's key is its path; its text is empty. A text node's key is "". ``outside``: within an
    element that never holds main text. ``block``: a tag that begins or ends a block. ``main``:
    within an article or main element.
    """
    out: list[tuple[str, str, bool, _Element | None]] = []  # key, text, block, element
    stack: list[_Element] = []
    elements: list[_Element] = []
    forms: list[_Element] = []  # open
    at = 0

    def add_text(text: str) -> None:
        if text:
            out.append(("", unescape(text), False, stack[-1] if stack else None))

    def close(n: int) -> None:
        while len(stack) > n:
            e = stack.pop()
            if forms and forms[-1] is e:
                forms.pop()
            out.append((f"/{e.path}", "", e.tag not in INLINE, e))

    while (m := _TOKEN.search(html, at)) is not None:
        add_text(html[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                add_text(m[0][9:-3].replace("&", "&amp;"))
            continue
        if m[1]:
            for n in range(len(stack) - 1, -1, -1):
                if stack[n].tag == tag:
                    # An inline end tag doesn't close blocks opened after it.
                    if tag not in INLINE or all(x.tag in INLINE for x in stack[n:]):
                        stack[n].ended = True
                        close(n)
                    break
            else:
                if tag == "br" or tag == "p":
                    out.append(("br", "", tag == "p", stack[-1] if stack else None))
            continue
        for n in range(len(stack) - 1, -1, -1):
            if tag in _CLOSES.get(stack[n].tag, ()):
                close(n)
                break
            if stack[n].tag not in INLINE and stack[n].tag not in _CLOSES:
                break
        parent = stack[-1] if stack else None
        attributes = _attributes(m[3])
        names = attributes.get("class", "")
        path = (parent.path if parent else "") + f">{tag}" + (f".{names}" if names and tag not in INLINE else "")
        element = _Element(tag, path, parent, _beside(tag, attributes, bool(parent and parent.main)), _main(tag, attributes))
        elements.append(element)
        if forms and (tag in _STRUCTURE or element.starts):
            for form in forms:
                form.page = True
        out.append((path, "", tag not in INLINE and tag != "br", element))
        if tag in VOID or m[3].endswith("/"):
            if tag == "br":
                out.append(("", " ", False, element))
            continue
        stack.append(element)
        if element.why == "form" and not element.main:
            forms.append(element)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            element.ended = True
            close(len(stack) - 1)
    rest = html[at:]
    cut = rest.rfind("<")  # a tag that the end of the page cut
    add_text(rest[:cut] if cut >= 0 and re.match(r"<[/!A-Za-z]", rest[cut:] + "a") else rest)
    close(0)
    _settle(elements, [(text, e) for key, text, _, e in out if not key])
    return [(key, text, bool(e and e.hides), block, bool(e and e.main)) for key, text, block, e in out]


Page = list[tuple[str, str, bool, bool, bool]]


def nested(pages: list[Page], support: float = SUPPORT) -> tuple[list[tuple[str, ...]], list[dict[int, tuple]]]:
    """The valid equivalence classes of tags over the pages, outermost first, and the names of each page's template tokens by their places.

    Tokens with the same occurrence vector form a class. A class is valid if its
    tokens lie in slots of one kind of the classes before it (else it is split by
    these kinds), keep one order on every page, and if every instance lies within
    one slot. The slots of an instance are the gaps between its tokens. A token's name is the path of slots
    down to it: (class, number of the instance within its slot, token) of each.
    """
    where: list[dict[str, list[int]]] = []
    for page in pages:
        places: dict[str, list[int]] = {}
        for i, (key, *_) in enumerate(page):
            if key:
                places.setdefault(key, []).append(i)
        where.append(places)
    vectors: dict[tuple[int, ...], list[str]] = {}
    for key in dict.fromkeys(k for places in where for k in places):
        vector = tuple(len(places.get(key, ())) for places in where)
        if sum(v > 0 for v in vector) >= max(2, support * len(pages)):
            vectors.setdefault(vector, []).append(key)
    slot = [np.zeros(len(page), np.int64) for page in pages]  # the innermost slot of each place; 0 is the page
    kinds: list[tuple[int, int]] = [(-1, 0)]  # (class, gap) of each slot
    paths: list[tuple] = [()]
    named: list[dict[int, tuple]] = [{} for _ in pages]
    classes: list[tuple[str, ...]] = []
    # Large classes that occur once a page come first: they are the outermost.
    queue = sorted(vectors.items(), key=lambda x: (max(x[0]), -len(x[1]), x[1][0]))
    while queue:
        vector, together = queue.pop(0)
        # Of tokens that occur equally often, those in slots of one kind belong together.
        by_kind: dict[tuple[int, int], list[str]] = {}
        for k in together:
            of = {kinds[s] for p, places in enumerate(where) if k in places for s in slot[p][places[k]].tolist()}
            if len(of) == 1:
                by_kind.setdefault(of.pop(), []).append(k)
        if len(by_kind) > 1:
            queue[:0] = [(vector, keys) for keys in by_kind.values()]
            continue
        keys = next(iter(by_kind.values()), [])
        if len(keys) < 2:
            continue
        found = [sorted(i for k in keys for i in places.get(k, ())) for places in where]
        order = next([pages[p][i][0] for i in at[: len(keys)]] for p, at in enumerate(found) if at)
        fits = all([page[i][0] for i in at] == order * times for page, at, times in zip(pages, found, vector))
        inside = [slot[p][at].reshape(-1, len(keys)) for p, at in enumerate(found) if at] if fits else []
        if not fits or not all((x == x[:, :1]).all() for x in inside):
            continue
        c = len(classes)
        classes.append(tuple(order))
        for p, at in enumerate(found):
            nth: Counter = Counter()
            for begin in range(0, len(at), len(keys)):
                places = at[begin : begin + len(keys)]
                above = int(slot[p][places[0]])
                for gap, i in enumerate(places):
                    named[p][i] = (*paths[above], (c, nth[above], gap))
                    if gap + 1 < len(places):
                        part = slot[p][i + 1 : places[gap + 1]]
                        part[part == above] = len(kinds)
                        kinds.append((c, gap))
                        paths.append(named[p][i])
                nth[above] += 1
    return classes, named


def deduce(pages: list[Page], support: float = SUPPORT) -> list[frozenset[str]]:
    """The tags of each valid class, outermost first."""
    return [frozenset(c) for c in nested(pages, support)[0]]


def extract(htmls: list[str]) -> list[str]:
    """The main text of each page of a group."""
    pages = [parse(h) for h in htmls]
    distinct = {h: p for h, p in zip(htmls, pages) if h}
    tokens = dict(zip(distinct, nested(list(distinct.values()))[1])) if len(distinct) > 1 else {}

    def slots(page, named):
        """(name, outside, main, blocks) of every slot in order; a slot's name is that of the template token before it."""
        name, blocks, text, out = (), [], [], []
        place = None

        def flush():
            joined = _SPACE.sub(" ", "".join(text)).strip()
            if joined:
                blocks.append(joined)
            text.clear()

        def end():
            flush()
            if blocks:
                out.append((name, *place, tuple(blocks)))
            blocks.clear()

        for i, (key, words, outside, block, main) in enumerate(page):
            if block and i in named:
                end()
                name, place = named[i], None
                continue
            if key and block:
                flush()
            if not key:
                if place is not None and place != (outside, main):
                    end()
                place = (outside, main)
                text.append(words)
        end()
        return out

    cut = [slots(page, tokens.get(html, {})) for html, page in zip(htmls, pages)]
    # Pages of the same text are copies, whatever their markup: they count once.
    bodies = {tuple(b for _, outside, _, b in page if not outside): page for page in cut}
    bodies.pop((), None)
    same: dict[tuple[tuple, tuple[str, ...]], int] = Counter()
    for page in bodies.values():
        same.update({(n, b) for n, outside, main, b in page if not outside and not main})
    constant = {x for x, n in same.items() if n >= max(2, SUPPORT * len(bodies))}
    texts = []
    for page in cut:
        own = [(main, (name, b) in constant and not main, b) for name, outside, main, b in page if not outside]
        dropped, rest = (sum(len(x) for _, drop, b in own if drop == side for x in b) for side in (True, False))
        # Without article or main, text that is the larger part of the page is its content.
        drops = any(main for main, _, _ in own) or dropped < rest
        texts.append("\n".join(x for _, drop, b in own if not (drop and drops) for x in b))
    return texts


def _group(table: pa.Table) -> pa.Table:
    texts = extract([h or "" for h in table.column("html").to_pylist()])
    return pa.table(
        {"page_id": table.column("page_id"), "url": table.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}
    )


def main_texts(pages: DataFrame, group_pages: int = GROUP_PAGES) -> DataFrame:
    """A row for each page: page_id, url, text, n_chars."""
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html")
    rows = rows.withColumn("host", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)))
    sizes = rows.groupBy("host").agg(F.ceil(F.count("*") / group_pages).alias("groups")).where("groups > 1")
    sizes = materialise(sizes)
    if sizes.count() <= BROADCAST_HOSTS:  # else an ordinary join
        sizes = F.broadcast(sizes)
    groups = F.coalesce("groups", F.lit(1).cast("bigint"))
    dealt = rows.join(sizes, "host", "left").withColumn("group", F.pmod(F.xxhash64("page_id", "url", F.length("html")), groups)).drop("groups")

    def group(table: pa.Table) -> pa.Table:
        return _group(table)

    return dealt.groupBy("host", "group").applyInArrow(group, "page_id bigint, url string, text string, n_chars bigint")
