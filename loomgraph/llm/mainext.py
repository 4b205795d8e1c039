"""Main text of web pages by the maximum-scoring contiguous run of words and tags.

A page is read as a sequence of tags and words. Words score more than zero and tags less; one linear scan finds the run of
the highest sum, which is the content. Weights come from labelled pages, which are those that mark their content themselves
by one ``article`` or ``main`` element. From them are counted, within the marked content and outside it,
- words and tags: the logarithms of the ratios of their rates are the base weights of a word and of a tag;
- each tag name: the logarithm of its ratio, if it speaks against content, is the tag's weight;
- words by the class words, id and role of elements. Of an element outside only the outermost counts, so that lists and
  links within a menu are not blamed for it. The share within content scales the weight of the words in such an element.
Without labelled pages the weights are those of the prior. Elements that never are content (see the fixed values) have words of
weight zero. The run is widened to the ``article`` or ``main`` element around it, if there is one, and to whole blocks;
what lies in it but in an element that isn't content (menus, forms, adverts, comments) is left out.

Markup is read as browsers do where it matters here: optional end tags, elements left open, stray ends, raw text, comments,
attributes in any quotes, and cut pages. Elements within 512 others aren't told from the innermost of these. Of white space of any kind within a block one space stays. Blocks are separated by two
line feeds. Nothing else is left out or cut.

Null and empty pages have an empty text, as have pages without a word that may be content. Repeated rows are extracted
each, ids may be null, other columns don't matter, and of equal sums the first run, and of these the longest, is taken.
Weights are fitted on some ``most`` rows at most, drawn by a hash of id and place, which is the only sample; every row is extracted.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FITTED_ON = 4000  # labelled rows that weights are fitted on, at most

# --- fixed values: what HTML says of its elements, and words that name parts of pages -------------------------------

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
# elements whose text is never content, wherever they stand
NEVER = frozenset("head script style template noscript noembed noframes iframe object applet canvas svg math map audio video nav aside footer dialog search menu button select datalist textarea title xmp".split())
# elements that aren't content unless they hold it
UNLESS = frozenset("form header".split())
CONTENT = frozenset("article main".split())
RUNNING = frozenset("p br h1 h2 h3 h4 h5 h6 b i em strong u s small sub sup code pre blockquote q cite mark abbr time figure figcaption table tbody thead tr td th".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
# words of class and id attributes
NOISE = frozenset("""ad ads adv advert adverts advertisement advertisements advertising adsense adslot adbox banner banners sponsor sponsored sponsors promo promos
    promoted promotion sidebar sidebars sidenav sidemenu nav navbar navigation menu menus submenu breadcrumb breadcrumbs toolbar topbar masthead footer cookie cookies
    consent gdpr notice notices popup popups modal overlay lightbox newsletter subscribe subscription signup login signin searchbox searchform share
    sharing sharebar social follow comment comments commentlist commentform respond replies disqus discussion related recommended recommendations trending
    popular pager pagination paging skiplink copyright""".split())
HEADER_CLASS = frozenset("header site-header page-header global-header main-header top-header".split())
# a start tag ends these open elements, which need no end tag
ENDS = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "thead": "tbody tfoot tr td th", "tbody": "thead tbody tr td th", "tfoot": "thead tbody tr td th", "option": "option", "optgroup": "option optgroup"}
ENDS = {k: frozenset(v.split()) for k, v in ENDS.items()}
STOPS = {"li": frozenset("ul ol menu dir".split()), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "option": frozenset(["select", "datalist"]), "optgroup": frozenset(["select"])}
TABLE = frozenset("table td th caption".split())
ACROSS = TABLE | frozenset("html body tr tbody thead tfoot".split())  # ends of these end cells that are open
ENDS_P = BLOCK - frozenset("html body head caption tbody td tfoot th thead tr option optgroup".split())
DEEPEST = 512  # open elements; those within so many are not nested further, as in browsers
PRIOR_WORD, PRIOR_TAG = 1.0, -3.25  # weights of words and tags in the absence of labelled pages

# --- reading -----------------------------------------------------------------------------------------------------

_name = re.compile(r"[A-Za-z][^\s/>]*")
_attribute = re.compile(r"""[\s/]*(?:(>)|([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?)""")
_state = re.compile(r"^(?:has|with|without|no|is|not)[-_]|[-_](?:enabled|disabled|open|closed|on|off)$", re.I)  # says what a page has, not what an element is
_pieces = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])")


def markup(page: str) -> Iterator[tuple[str, str, dict[str, str] | None]]:
    """("text", text, None), ("start", name, attributes) and ("end", name, None), in page order."""
    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0 or lt == n - 1:
            yield "text", html.unescape(page[at:]), None
            return
        c = page[lt + 1]
        ends = c == "/"
        m = _name.match(page, lt + 1 + ends)
        if not m and c not in "!?/":
            yield "text", html.unescape(page[at : lt + 1]), None
            at = lt + 1
            continue
        if lt > at:
            yield "text", html.unescape(page[at:lt]), None
        if not m:  # a comment, a declaration, or what is read as one
            if page.startswith("<!--", lt):
                if short := re.compile(r"<!--(?:-?>)").match(page, lt):
                    at = short.end()
                    continue
                end = re.compile(r"--!?>").search(page, lt + 4)
                at = end.end() if end else n
            elif page.startswith("<![CDATA[", lt):
                end = page.find("]]>", lt)
                at = end + 3 if end >= 0 else n
            else:
                end = page.find(">", lt)
                at = end + 1 if end >= 0 else n
            continue
        name, at, attributes, closed = m.group().lower(), m.end(), {}, False
        while a := _attribute.match(page, at):
            at = a.end()
            if a[1]:
                closed = True
                break
            attributes.setdefault(a[2].lower(), a[3] or a[4] or a[5] or "")
        if not closed:  # the page ends within a tag
            return
        if ends:
            yield "end", name, None
            continue
        yield "start", name, attributes
        if name in RAW:  # its text is no markup
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            at = end.start() if end else n


@dataclass(slots=True)
class Element:
    name: str
    start: int  # place of its start tag in the tokens
    parent: Element | None
    keys: tuple[str, ...] = ()
    never: bool = False
    unless: bool = False  # isn't content, unless it holds a content element or a first heading
    holds: bool = False
    end: int = -1
    words: int = 0

    @property
    def content(self) -> bool:
        return self.name in CONTENT and not self.never and (self.holds or not self.unless)


def described(name: str, attributes: dict[str, str]) -> tuple[tuple[str, ...], bool, bool]:
    """Words of an element's class, id and role, whether it is never content, and whether only if it holds content."""
    never, unless = name in NEVER or "hidden" in attributes, name in UNLESS
    keys: list[str] = []
    if name in ("html", "body"):
        return (), False, False
    if "style" in attributes and re.search(r"display\s*:\s*none", attributes["style"], re.I):
        never = True
    role = attributes.get("role", "").strip().lower()
    if role in ROLES:
        keys.append(f"role={role}")
        unless = True
    for attribute in ("class", "id"):
        value = attributes.get(attribute)
        if value:
            values = html.unescape(value).split()
            keys += sorted({w.lower() for v in values for w in _pieces.findall(v)})
            parts = {w.lower() for v in values if not _state.search(v) for w in _pieces.findall(v)}
            unless = unless or bool(parts & NOISE) or any(v.lower() in HEADER_CLASS for v in values)
    return tuple(dict.fromkeys(keys)), never, unless


@dataclass
class Page:
    """Tokens (kind, name or text, words, element) and elements of a page."""

    tokens: list[tuple[str, str, int, Element]] = field(default_factory=list)
    elements: list[Element] = field(default_factory=list)


def count_words(text: str) -> int:
    """Words between white space, or one for each eight characters, where a script doesn't separate words."""
    return max(len(text.split()), len(text.strip()) // 8)


def read(page: str) -> Page:
    """The tokens of a page, each with the innermost element that it is in."""
    out = Page()
    root = Element("", -1, None)
    stack = [root]

    def close(to: int) -> None:
        while len(stack) > to:
            stack.pop().end = len(out.tokens)

    def last(names: frozenset[str], stops: frozenset[str]) -> int:
        """The place of the innermost open element of these names, above any of stops; 0: none."""
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in names:
                return i
            if stack[i].name in stops:
                return 0
        return 0

    for kind, value, attributes in markup(page):
        if kind == "text":
            if not value.isspace():
                words = count_words(value)
                out.tokens.append(("text", value, words, stack[-1]))
                stack[-1].words += words
            elif value:
                out.tokens.append(("text", " ", 0, stack[-1]))
        elif kind == "start":
            if value in ENDS_P and (i := last(frozenset(["p"]), TABLE | {"button"})):
                close(i)
            if value in ENDS:
                stops = STOPS.get(value, frozenset(["table"]))
                while i := last(ENDS[value], stops):
                    close(i)
            if value == "body" and (i := last(frozenset(["head"]), frozenset())):
                close(i)
            elif len(stack) > 1 and stack[-1].name == "head" and value in BLOCK:
                close(len(stack) - 1)
            keys, never, unless = described(value, attributes)
            if value in ("main", "article") and not (unless or never):
                # a menu, header or footer that was left open ends here
                while i := last(frozenset(["nav", "header", "footer"]), frozenset(["aside"])):
                    close(i)
            e = Element(value, len(out.tokens), stack[-1], keys, never, unless)
            out.tokens.append(("start", value, 0, e))
            if value in VOID or len(stack) > DEEPEST:
                e.end = len(out.tokens)
            else:
                out.elements.append(e)
                stack.append(e)
            if (value in CONTENT or value == "h1") and not (unless or never):
                up = e.parent
                while up is not None:
                    # a first heading speaks for what is around it, but not for the header of a page
                    up.holds = up.holds or value != "h1" or up.name != "header"
                    if value == "h1" and up.name == "header":
                        break
                    up = up.parent
        else:
            i = next((j for j in range(len(stack) - 1, 0, -1) if stack[j].name == value), 0)
            if i and value not in BLOCK and any(e.name in BLOCK for e in stack[i + 1 :]):
                stack[i].end = len(out.tokens)  # formatting ends, the blocks in it go on
                del stack[i]
            elif i and (value in ACROSS or not any(e.name in TABLE for e in stack[i + 1 :])):
                out.tokens.append(("end", value, 0, stack[i]))
                close(i)
            elif value in BLOCK:
                out.tokens.append(("end", value, 0, stack[-1]))
    close(0)
    return out


def excluded(e: Element, in_content: bool) -> bool:
    """Whether the element itself keeps its text from being content."""
    if e.name == "header":  # that of an article belongs to it
        return not in_content and not e.holds
    return e.never or (e.unless and not e.holds)


# --- weights -------------------------------------------------------------------------------------------------------


@dataclass
class Weights:
    word: float = PRIOR_WORD
    tag: float = PRIOR_TAG
    tags: dict[str, float] = field(default_factory=dict)
    shares: dict[str, float] = field(default_factory=dict)  # of a class word's words, those within content

    def of_tag(self, name: str) -> float:
        """A tag name that no labelled page has counts next to nothing if it belongs to running text, else like any tag."""
        return min(self.tags.get(name, 0.0 if name in RUNNING else self.tag), -0.01)


def marks(page: Page) -> Element | None:
    """The one element that a page marks as its content: its main element, or else its only article."""
    for name in ("article", "main"):
        found = [e for e in page.elements if e.name == name and e.content]
        found = [e for e in found if not any(o is not e and o.start < e.start < o.end for o in found)]
        if len(found) == 1:
            return found[0]
    return None


def evidence(page: Page) -> Counter:
    """(kind, key, within): counts of a labelled page; none of a page that doesn't mark its content."""
    out: Counter = Counter()
    marked = marks(page)
    if marked is None:
        return out
    around = set()
    up: Element | None = marked.parent
    while up is not None:
        around.add(id(up))
        up = up.parent
    for kind, value, words, e in page.tokens:
        within = marked.start < e.start < marked.end or (e is marked and kind == "text")
        if kind == "text":
            path, keep = [], e
            while keep is not None and keep.start >= 0 and keep is not marked and id(keep) not in around:
                path.append(keep)
                keep = keep.parent
            if any(x.name in RAW or x.name == "head" for x in path):
                continue
            out["words", "", within] += words
            for x in path if within else path[-1:]:
                for k in x.keys:
                    out["key", k, within] += words
        elif value not in ("html", "head", "body", "meta", "link", "title", "script", "style"):
            out["tags", "", within] += 1
            out["tag", value, within] += 1
    out["pages", "", True] = 1
    return out


def weighed(counts: dict[tuple[str, str, bool], int]) -> Weights:
    """Weights by the counts of labelled pages."""
    n = lambda kind, key, within: counts.get((kind, key, within), 0)
    if not n("pages", "", True):
        return Weights()
    total = {w: n("words", "", w) + n("tags", "", w) + 2 for w in (True, False)}
    rate = lambda kind, key, w: (n(kind, key, w) + 0.5) / total[w]
    base = lambda kind: math.log(rate(kind, "", True) / rate(kind, "", False))
    out = Weights(max(base("words"), 0.05), min(base("tags"), -0.1))
    out.tags = {k: math.log(rate("tag", k, True) / rate("tag", k, False)) for kind, k, _ in counts if kind == "tag"}
    # a class word needs some pages' worth of words before it overrules that any element may be content
    out.shares = {k: (n("key", k, True) + 20) / (n("key", k, True) + n("key", k, False) + 20) for kind, k, _ in counts if kind == "key"}
    return out


# --- the scan --------------------------------------------------------------------------------------------------------


def best_run(scores: list[float]) -> tuple[int, int]:
    """(start, end) of the contiguous run of the highest sum: the first of equal ones, and the longest; empty if none is above 0."""
    best, at, start, total = 0.0, (0, 0), 0, 0.0
    for i, x in enumerate(scores):
        if total < 0:
            start, total = i, 0.0
        total += x
        if total > best or (total == best and start == at[0] and at[1] > at[0]):
            best, at = total, (start, i + 1)
    return at


def main_text(page: str | None, weights: Weights = Weights()) -> str:
    """The blocks of a page's main text, joined by two line feeds."""
    if not page:
        return ""
    p = read(page)
    total = sum(t[2] for t in p.tokens)
    inside: dict[int, int] = {}  # words in an element and below it
    for e in reversed(p.elements):
        inside[id(e)] = inside.get(id(e), 0) + e.words
        if e.parent is not None:
            inside[id(e.parent)] = inside.get(id(e.parent), 0) + inside[id(e)]
    kept: dict[int, tuple[bool, float, bool]] = {}  # whether an element's text may be content, its share, and whether it is in a content element

    def state(e: Element | None) -> tuple[bool, float, bool]:
        if e is None or e.start < 0:
            return True, 1.0, False
        todo = []
        while e is not None and e.start >= 0 and id(e) not in kept:
            todo.append(e)
            e = e.parent
        may, share, content = kept[id(e)] if e is not None and e.start >= 0 else (True, 1.0, False)
        for x in reversed(todo):
            may = may and not excluded(x, content)
            if x.name not in CONTENT and not x.holds and inside.get(id(x), 0) <= total / 2:
                share = min([share, *(weights.shares.get(k, 1.0) for k in x.keys)])
            content = content or x.content
            kept[id(x)] = may, share, content
        return may, share, content

    def score(kind: str, value: str, words: int, e: Element) -> float:
        if kind != "text":
            return weights.of_tag(value)
        may, share, _ = state(e)
        return words * weights.word * share if may and share >= 0.5 else 0.0

    start, end = best_run([score(*t) for t in p.tokens])
    if start == end:
        return ""
    # the content element around the whole run, the outermost
    around = [e for e in p.elements if e.content and e.start <= start and end <= e.end]
    if around:
        start, end = around[0].start, around[0].end
    else:  # whole blocks
        while start > 0 and not (p.tokens[start][0] != "text" and p.tokens[start][1] in BLOCK):
            start -= 1
        while end < len(p.tokens) and not (p.tokens[end][0] != "text" and p.tokens[end][1] in BLOCK):
            end += 1
    blocks: list[list[str]] = [[]]
    for kind, value, _, e in p.tokens[start:end]:
        if kind != "text":
            if value in BLOCK:
                blocks.append([])
            elif value == "br":
                blocks[-1].append(" ")
            continue
        may, share, _ = state(e)
        if may and share >= 0.5:
            blocks[-1].append(value)
    texts = (" ".join("".join(b).split()) for b in blocks if b)
    return "\n\n".join(t for t in texts if t)


# --- tables ----------------------------------------------------------------------------------------------------------


def fitted(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", most: int = FITTED_ON, seed: int = 5) -> Weights:
    """Weights by the labelled pages of some ``most`` rows at most. What comes to the driver are counts by tag name and class word of these."""
    n = pages.count()
    width = 1 << 20
    drawn = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), F.monotonically_increasing_id()), F.lit(width)) < min(width, width * most // max(n, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for x in batch.column(0):
                found.update(evidence(read(x.as_py())))
        keys = list(found)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.bool_()), pa.array([found[k] for k in keys], pa.int64())], names=["kind", "key", "within", "n"])

    counts = pages.where(drawn & (F.col(html_col) != "")).select(html_col).mapInArrow(run, "kind string, key string, within boolean, n long").groupBy("kind", "key", "within").agg(F.sum("n").alias("n"))
    return weighed({(r["kind"], r["key"], r["within"]): r["n"] for r in counts.collect()})


def extracted(pages: DataFrame, weights: Weights, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every row, without an exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), weights) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    kind = lambda c: pages.schema[c].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, f"id {kind(id_col)}, url {kind(url_col)}, text string, n_chars long").toDF(id_col, url_col, "text", "n_chars")
