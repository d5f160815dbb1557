"""HTML extraction by minimum-cut labelling.

A page's text falls into blocks, each with a classifier's cost of calling it content and of
calling it boilerplate; these are the capacities to the two terminals.  Neighbours in page order
and neighbours in the tree (one parent element) are joined by smoothness edges.  The minimum cut
of that graph is the cheapest labelling, found by augmenting paths; blocks on the source's side
are the article.

The classifier is a sum of weighted cues: the names, classes, ids and roles of the elements
around a block, the share of its characters in links, its length, marks and stop characters.
A terminal's capacity is at most MOST, little above what all edges of a block amount to, so
neighbours overrule a block whose cues are not all against them.  A name that stands for a state
or a subject of an article (comments-open, category-popular) is no cue; one beside an article's
name is a weak one; and one of an element that holds most of the page's paragraphs is none.

Tags are read as browsers read them: a quote inside an unquoted value or a name is a character.
A quote that is never closed ends its tag at the next `>`; a tag without `>` is markup to the end.
Elements that never hold readable text (scripts, styles, forms' controls, templates, head) make no
block.  Formulas in MathML but their annotations, and what stands for media that cannot be shown,
are text as any other.  Inside a block white space becomes one space; character references are
decoded; NUL is no character of a page.

Null or empty html, or html without text, gives the empty string; repeated pages are done each;
other columns are dropped; deep or broken markup costs time in proportion to its length only.
"""

from __future__ import annotations

import html
import re
from bisect import bisect
from collections import defaultdict, deque

import pyarrow as pa
from pyspark.sql import DataFrame

from waymark.llm.common import clash_free

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)", re.A)
_COMMENT_END = re.compile("--!?>")
#: The tag's end, or an attribute and its value; never goes back, so a tag takes one pass.
_ATTRIBUTE = re.compile(r"[\s/]*+(?:(>)|([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"'][^\s>]*+)|))?+)", re.A)
_WORD = re.compile(r"[a-z]+|[0-9]+")
_HUMP = re.compile(r"([a-z])([A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")

#: Element names of the HTML standard by what they mean for a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template noscript head title svg annotation annotation-xml iframe select textarea option datalist".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
#: Lower case can be longer than the page ('İ'), so ends are looked for in the page itself.
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I | re.A) for name in RAW}
BLOCK = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split())
ENDS_P = BLOCK - {"button", "caption", "html", "body", "legend", "summary"}
#: An element closes an open one of these, up to the nearest of the second set.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Words of classes, ids and roles, and elements, that tell page furniture or an article.
FURNITURE = frozenset("""nav navbar navigation menu menubar submenu breadcrumb breadcrumbs footer foot header masthead topbar toolbar sidebar
    side aside rail widget widgets banner contentinfo complementary ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted
    cookie cookies consent gdpr notice alert warning popup modal overlay dialog newsletter subscribe subscription signup login register
    comment comments commentlist reply replies respond disqus discussion share sharing social follow related recommended recommendations
    trending popular teaser notices notification announcement pagination pager paging tags tagcloud copyright legal disclaimer search form skip byline meta hidden""".split())
#: Those of them that hold for the article's elements too.
ASIDE = frozenset("ad ads advert advertisement sponsored promo comment comments reply related teaser".split())
#: First words of names that tell an article's subject or what is about it, but where these are last.
SUBJECT = frozenset("tag tags category cat topic has no with without is format type status".split())
LISTS = frozenset("cloud list links menu nav bar box section area".split())
#: Last words of names that tell a state.
STATE = frozenset("open opened closed enabled disabled allowed on off free visible active".split())
ARTICLE = frozenset("article main content post entry story body text prose".split())
FURNITURE_ELEMENT = {"nav": 9.0, "footer": 8.0, "aside": 8.0, "form": 9.0, "menu": 8.0, "dialog": 9.0, "button": 9.0, "fieldset": 8.0, "header": 5.0, "address": 1.0, "legend": 4.0}
ARTICLE_ELEMENT = {"article": 5.0, "main": 4.0}
CONTENT_BLOCK = {"p": 1.0, "h1": 1.5, "h2": 1.0, "h3": 0.8, "h4": 0.8, "h5": 0.5, "h6": 0.5, "blockquote": 1.0, "pre": 1.0, "td": 0.2, "li": 0.2, "figcaption": 0.5}
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd td figcaption".split())
ADJACENT, SIBLING, MOST = 0.6, 0.9, 4.0
#: What is furniture for certain, a name beside an article's, and an element that holds most paragraphs.
CERTAIN, BESIDE, SHARE, SEVERAL = 5.0, 1.0, 0.6, 3


def _names(value: str) -> tuple[set[str], bool]:
    """Furniture's words in an element's names, and whether another of its names tells an article."""
    odd, article = set(), False
    for token in value.split():
        words = _WORD.findall(_HUMP.sub(r"\1 \2", token).lower())
        if len(words) > 1 and (words[0] in SUBJECT and words[-1] not in LISTS or words[-1] in STATE):
            continue
        own = FURNITURE.intersection(words)
        odd |= own
        article |= own <= {"header", "meta"} and not ARTICLE.isdisjoint(words)
    return odd, article


class _Element:
    __slots__ = ("name", "own", "doubtful", "own_lift", "parent", "silent", "inside", "block", "certain", "chars", "paragraphs", "cue", "lift", "form")

    def __init__(self, name: str, attributes: list[tuple[str, str]], parent: "_Element | None"):
        self.name, self.parent = name, parent
        odd, named, hidden = set(), False, False
        for key, value in attributes:
            if key in ("class", "id", "role", "itemprop", "aria-label", "data-role"):
                words, article = _names(value)
                odd |= words
                named |= article
            hidden |= key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and _HIDDEN.search(value.lower()) is not None
        article = name in ARTICLE_ELEMENT or named
        self.inside = article or bool(parent and parent.inside)
        if name in ("html", "body"):
            odd = set()
        elif name in ARTICLE_ELEMENT:
            odd &= ASIDE
        elif odd <= {"header", "meta"} and self.inside:
            odd = set()
        beside = named and not odd & ASIDE
        own = -(BESIDE if beside else 9.0) * bool(odd)
        if name in FURNITURE_ELEMENT:
            # An article's own header holds its headline.
            own -= 0.5 if name == "header" and self.inside and not odd else FURNITURE_ELEMENT[name]
        self.own = own - 20.0 * hidden
        self.doubtful = not hidden and not odd & ASIDE and (name not in FURNITURE_ELEMENT or name in ("form", "fieldset", "header"))
        self.certain = self.own <= -CERTAIN and not self.doubtful or bool(parent and parent.certain)
        self.own_lift = ARTICLE_ELEMENT.get(name, 2.5 if article and not odd else 0.0)
        self.silent = name in SILENT or bool(parent and parent.silent)
        # The nearest block, itself included.
        self.block = parent.block if parent and name not in BLOCK else self
        self.chars = self.paragraphs = 0
        self.cue = self.lift = self.form = 0.0


class Block:
    __slots__ = ("text", "linked", "element", "name")

    def __init__(self, text: str, linked: int, element: _Element, name: str):
        self.text, self.linked, self.element, self.name = text, linked, element, name

    def evidence(self) -> float:
        """Log-odds that the block is content, as far as the terminals go."""
        n = len(self.text)
        share = min(1.0, self.linked / n)
        e = -0.5 + self.element.cue + self.element.lift + CONTENT_BLOCK.get(self.name, -0.3)
        e += -3.0 * share + (1.2 if n > 80 else 0.5 if n > 30 else 0.0)
        e += 0.4 * (self.text[-1] in ".!?:;»”\"") - 4.0 * (self.text[:1] == "©" or self.text[:9].lower() == "copyright")
        return max(-MOST, min(MOST, e))


def _weighed(elements: list[_Element], found: list[Block]) -> None:
    """Sums the cues of the elements around each element (parents stand before their children)."""
    for b in found:
        if b.name in PARAGRAPH and not b.element.certain:
            b.element.chars += max(0, len(b.text) - b.linked)
            b.element.paragraphs += 1
    for e in reversed(elements[1:]):
        e.parent.chars += e.chars
        e.parent.paragraphs += e.paragraphs
    for e in elements[1:]:
        up, own = e.parent, e.own
        if own < 0 and e.doubtful and e.paragraphs >= SEVERAL and e.chars > SHARE * elements[0].chars:
            own = 0.0
        # A form around the whole page says nothing of the article in it.
        e.form = 0.0 if e.name in ARTICLE_ELEMENT else up.form + own * (e.name == "form")
        e.cue = up.cue + own - (up.form if e.name in ARTICLE_ELEMENT else 0.0)
        # Being in an article lifts a block only so far, and nothing in the furniture inside it.
        e.lift = e.own_lift if own <= -CERTAIN else min(5.0, e.own_lift + up.lift)


def _attributes(page: str, at: int) -> tuple[list[tuple[str, str]], int, bool]:
    """A tag's attributes, the place behind it (-1: the page ends in it), and whether it closes itself."""
    out = []
    while m := _ATTRIBUTE.match(page, at):
        at = m.end()
        if m[1]:
            return out, at, m[0].endswith("/>")
        out.append((m[2].lower(), html.unescape(m[3] or m[4] or m[5] or "")))
    return out, -1, False


def blocks(page: str) -> list[Block]:
    root = _Element("", [], None)
    elements, stack, out, text, linked, links, blank = [root], [root], [], [], 0, 0, True
    holder, at, page = root, 0, page.replace("\x00", "")
    # Where in the stack each name's elements and the blocks are, so that closing needs no search.
    places, block_places = defaultdict(list), []

    def flush() -> None:
        nonlocal text, linked, blank
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            if whole:
                near = holder.block
                out.append(Block(whole, linked, near, near.name))
            text = []
        linked, blank = 0, True

    def say(raw: str) -> None:
        nonlocal linked, holder, blank
        if raw and not stack[-1].silent:
            if blank:
                holder = stack[-1]
                blank = not raw.strip()
            text.append(raw)
            if links:
                linked += len(raw.strip())

    def close(k: int) -> None:
        nonlocal links
        for e in stack[k:]:
            places[e.name].pop()
            links -= e.name == "a"
            if e.name in BLOCK:
                block_places.pop()
        del stack[k:]

    while at < len(page):
        start = page.find("<", at)
        while start >= 0 and not page[start + 1 : start + 2].isalpha() and page[start + 1 : start + 2] not in ("/", "!", "?"):
            start = page.find("<", start + 1)
        say(page[at:start] if start >= 0 else page[at:])
        if start < 0:
            break
        m = _NAME.match(page, start)
        if not m:
            if page.startswith("<!--", start):
                end = _COMMENT_END.search(page, start + 2)
                at = end.end() if end else len(page)
            elif page[start + 1] in "/!?":
                at = page.find(">", start) + 1 or len(page)
            else:  # a letter that begins no name
                say("<")
                at = start + 1
            continue
        attributes, at, alone = _attributes(page, m.end())
        if at < 0:
            break
        name = m[2].lower()
        if m[1]:
            if name in BLOCK:
                flush()
            if places[name] and (name in BLOCK or not block_places or places[name][-1] > block_places[-1]):
                close(places[name][-1])
            continue
        if name == "br":
            say(" ")
        if name in BLOCK:
            flush()
        if name in ENDS_P and block_places and stack[block_places[-1]].name == "p":
            close(block_places[-1])
        if name in IMPLIED:
            closed, stop = IMPLIED[name]
            last = max((places[n][-1] for n in stop if places[n]), default=0)
            inner = [places[n][k] for n in closed if (k := bisect(places[n], last)) < len(places[n])]
            if inner:
                close(min(inner))
        if name in VOID or alone and name in ("svg", "math"):
            continue
        places[name].append(len(stack))
        if name in BLOCK:
            block_places.append(len(stack))
        stack.append(_Element(name, attributes, stack[-1]))
        elements.append(stack[-1])
        links += name == "a"
        if name in RAW:
            end = RAW_END[name].search(page, at)
            at = end.start() if end else len(page)
    flush()
    _weighed(elements, out)
    return out


class Cut:
    """Minimum cut between two terminals; edges between nodes have one capacity both ways."""

    def __init__(self, n: int):
        self.n, self.to, self.cap, self.of = n, [], [], [[] for _ in range(n + 2)]

    def edge(self, a: int, b: int, forth: float, back: float) -> None:
        for x, y, c in ((a, b, forth), (b, a, back)):
            self.of[x].append(len(self.to))
            self.to.append(y)
            self.cap.append(c)

    def source_side(self) -> list[bool]:
        s, t, to, cap, of = self.n, self.n + 1, self.to, self.cap, self.of
        while True:
            level = [-1] * (self.n + 2)
            level[s], queue = 0, deque([s])
            while queue:
                x = queue.popleft()
                for e in of[x]:
                    if cap[e] > 1e-9 and level[to[e]] < 0:
                        level[to[e]] = level[x] + 1
                        queue.append(to[e])
            if level[t] < 0:
                return [v >= 0 for v in level[: self.n]]
            nexts, path, x = [0] * (self.n + 2), [], s
            while True:
                if x == t:
                    least = min(cap[e] for e in path)
                    for e in path:
                        cap[e] -= least
                        cap[e ^ 1] += least
                    k = next(i for i, e in enumerate(path) if cap[e] <= 1e-9)
                    x = to[path[k] ^ 1]
                    del path[k:]
                while nexts[x] < len(of[x]):
                    e = of[x][nexts[x]]
                    if cap[e] > 1e-9 and level[to[e]] == level[x] + 1:
                        path.append(e)
                        x = to[e]
                        break
                    nexts[x] += 1
                else:
                    if not path:
                        break
                    level[x] = -1
                    x = to[path.pop() ^ 1]


def labels(parts: list[Block]) -> list[bool]:
    """Of each block, whether the minimum cut leaves it on the side of content."""
    cut, seen = Cut(len(parts)), {}
    for i, b in enumerate(parts):
        e = b.evidence()
        cut.edge(cut.n, i, max(e, 0.0), 0.0)
        cut.edge(i, cut.n + 1, max(-e, 0.0), 0.0)
        if i:
            cut.edge(i - 1, i, ADJACENT, ADJACENT)
        parent = id(b.element.parent)
        if parent in seen:
            cut.edge(seen[parent], i, SIBLING, SIBLING)
        seen[parent] = i
    return cut.source_side()


def extract(page: str | None) -> str:
    """The page's article, blocks joined by an empty line."""
    parts = blocks(page or "")
    return "\n\n".join(b.text for b, inside in zip(parts, labels(parts)) if inside)


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every row of pages(page_id, url, html)."""
    pages = clash_free(pages, "page_id", "url", "html")

    def run(batches):
        for x in batches:
            texts = [extract(h) for h in x["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([x["page_id"], x["url"], pa.array(texts, pa.string())], ["page_id", "url", "text"])

    kinds = pages.schema
    return pages.mapInArrow(run, f"page_id {kinds['page_id'].dataType.simpleString()}, url {kinds['url'].dataType.simpleString()}, text string")
