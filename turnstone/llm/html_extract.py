"""HTML extraction with a site style tree.

The pages of a host are merged into one tree of presentation nodes: an element with its
tag, class and place under its parent. Its content nodes are the blocks of text below it.

* A content on df of the host's m different pages has importance 1 - log_m(df).
* A presentation node's importance is the text of important contents that it brings to a
  page that has it, relative to its largest sibling, times (1 + H) / 2, where H is the
  entropy of its pages' child sequences to base m: templates repeat, articles vary.

From the root down, children of low importance are cut off with all below them; the
descent ends where text stands directly in a node rather than in one of its children. What
a tag, role or class says is a prior: marked boilerplate counts a quarter, an article twice.
Where the tree has no say (below the last branching, on rare elements, on hosts of too
few pages) the marks decide. Within what is left, contents that the site shares go: outside
articles all of low importance, inside only those on most pages.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import Staging, read, sliced
from .url_filter import url_host

#: Different pages that a host needs for a tree, and an element to be judged.
MIN_PAGES = 5
#: Content importance below which a content doesn't count; mean of it and its style's entropy below which it goes.
CONTENT_IMPORTANCE, IMPORTANCE = 0.35, 0.5
#: Importance of a presentation node below which its branch goes, and what marks multiply it by.
BRANCH_IMPORTANCE, MARKED, MAIN = 0.1, 0.25, 2.0
#: Share of a host's different pages from which a content of low importance goes inside articles too.
SHARED = 0.5
#: Share of a host's pages on which a block is frequent, and of a page's text that is too little to identify it.
FREQUENT, OWN = 0.5, 0.1
#: Length, against an article's, up to which unmarked blocks beside it are a stray line on a host without a tree.
STRAY = 0.1
#: Entries of all hosts' lists up to which their table is broadcast; larger ones are joined by a shuffle.
BROADCAST_BRANCHES = 500_000

#: Fixed values of HTML: elements without content, of raw text, that break lines, and that an open p or li ends at.
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes script style svg template textarea".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
#: Blocks that hold text; the others are the presentation nodes.
TEXT = frozenset("address blockquote br caption dd dt figcaption h1 h2 h3 h4 h5 h6 hr legend li option optgroup p pre summary tbody td tfoot th thead tr".split())
IN_P = frozenset("br option optgroup body head html tr td th tbody thead tfoot caption".split())
CLOSES = {"li": ("li", "ul", "ol", "menu"), "dt": ("dt", "dl"), "dd": ("dt", "dl"), "tr": ("tr", "table"), "td": ("td", "tr"), "th": ("td", "tr"), "option": ("option", "select")}
ALIKE = {"dt": ("dt", "dd"), "td": ("td", "th")}
P_STOPS = ("td", "th", "table", "button", "article", "main", "section")

#: Tags, roles and words of a class or id that mark boilerplate, words that do so outside articles only, and words beside them that change nothing.
NOISE_TAGS = frozenset("aside button dialog dir fieldset footer form frameset header input menu nav option search select".split())
NOISE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation note search status tablist toolbar".split())
NOISE_WORDS = frozenset(
    "ad ads adsense advert advertisement advertising adverts alert banner breadcrumb breadcrumbs captcha comment commentlist comments consent cookie cookies dialog discussion disqus feedback footer form gdpr header infobar "
    "login masthead menu menus modal nav navbar navigation newsletter notice notices notification outbrain "
    "pager pagination paywall popup promo promoted promotion promotions recommended related replies reply respond responses share sharing "
    "sidebar signup social sponsor sponsored sponsors subscribe subscription taboola toolbar topbar trending widget widgets".split()
)
HINT_WORDS = frozenset("author-box byline copyright disclaimer legal links privacy register search skip toc warning".split())
GLUE_WORDS = frozenset(
    "a area bar block bottom box col column container desktop div end fixed float global group hidden in inner item items left list main mobile module of one outer page pane panel post "
    "primary right row secondary section side site slot sticky text the top two unit view visible wrap wrapper zone".split()
)
MAIN_TAGS = frozenset(("article", "main"))
#: Elements around whole pages as often as around fields: one with over half of the page's text is no boilerplate.
WRAPPERS = frozenset(("dialog", "fieldset", "form"))

_MARK = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'<]|"[^"<>]*"|'[^'<>]*')*)>""")
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_UNQUOTED = re.compile(r"[^\s>]*")
_ATTRIBUTE_NAME = re.compile(r"[\s/]*([^\s/>=]*)\s*(=?)\s*")
_ATTRIBUTE = re.compile(r"""([a-zA-Z:_-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORDS = re.compile(r"[a-z0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
ROOT = 0


def _hash(*parts: object) -> int:
    return xxhash.xxh64_intdigest("\0".join(map(str, parts))) >> 1


def _noisy(tag: str, attributes: dict[str, str], main: bool) -> bool:
    if tag in NOISE_TAGS and not (tag == "header" and main):
        return True
    if not attributes:
        return False
    if attributes.get("role", "").lower() in NOISE_ROLES or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return True
    if _HIDDEN.search(attributes.get("style", "")):
        return True
    if tag in ("html", "body", "h1") or tag in MAIN_TAGS and not main:
        return False
    tokens = [frozenset(_WORDS.findall(t)) for t in (attributes.get("class", "") + " " + attributes.get("id", "")).lower().split()]
    names = frozenset().union(*tokens)
    if names & {"content", "body", "main"} and not names & {"ad", "ads", "comment", "comments", "sidebar"}:
        return False
    marked = NOISE_WORDS if main else NOISE_WORDS | HINT_WORDS
    # A name means what all its words say: comments-list is a list of comments, comments-on-law is not.
    return any(t & marked and all(w in marked or w in GLUE_WORDS or w.isdigit() or w == "content" for w in t) for t in tokens)


@dataclass
class Page:
    """Presentation nodes by index, parents first (0 is the page), and blocks of text in order."""

    paths: list[int] = field(default_factory=lambda: [ROOT])
    ups: list[int] = field(default_factory=lambda: [-1])
    noise: list[bool] = field(default_factory=lambda: [False])
    main: list[bool] = field(default_factory=lambda: [False])
    tags: list[str] = field(default_factory=lambda: [""])
    shapes: list[list[str]] = field(default_factory=lambda: [[]])
    #: The style of loose text: text that stands in the page or its body without an element of its own.
    loose: set[int] = field(default_factory=lambda: {0})
    #: (node, style, text, inside an article)
    blocks: list[tuple[int, int, str, bool]] = field(default_factory=list)


@dataclass(slots=True)
class _Open:
    tag: str
    node: int
    style: int
    main: bool
    skip: bool


_hashes: dict[tuple, int] = {}


def _child(up: int, name: str, place: int) -> int:
    """The path of a child; a bounded memory, as pages of a site share most of their paths."""
    key = (up, name, place)
    found = _hashes.get(key)
    if found is None:
        if len(_hashes) > 100_000:
            _hashes.clear()
        found = _hashes[key] = _hash(up, name, place) or 1
    return found


def _slow_tag(html: str, at: int, last: dict[str, int]) -> tuple[str, str, dict[str, str], int] | None:
    """(/, name, attributes, end) of a tag with odd quotes, each character read once; a quote that nothing closes is a character."""
    m = _NAME.match(html, at + 1)
    if not m or at > last[">"]:
        return None
    attributes: dict[str, str] = {}
    at = m.end()
    while at < len(html) and html[at] != ">":
        a = _ATTRIBUTE_NAME.match(html, at)
        at = a.end()
        value = ""
        if a[2] and at < len(html):
            quote = html[at]
            if quote in "\"'" and at < last[quote]:
                end = html.index(quote, at + 1)
                value, at = html[at + 1 : end], end + 1
            else:
                v = _UNQUOTED.match(html, at)
                value, at = v.group(), v.end()
        elif a.end() == a.start() and at < len(html) and html[at] != ">":
            at += 1
        if a[1]:
            attributes.setdefault(a[1].lower(), value)
    return m[1], m[2], attributes, at + 1


def parse(html: str, marks: bool = True) -> Page:
    """The presentation nodes and blocks of a page. With ``marks``, nodes know theirs, and marked text elements and inline ones are left out.

    Follows what browsers do with unclosed and misnested elements as far as text and
    containment go: a block ends an open p, an li ends an li, stray end tags are ignored.
    Time and memory are linear in the page, however quotes and elements are nested.
    """
    page = Page()
    stack = [_Open("", 0, 0, False, False)]
    places: dict[str, list[int]] = {}
    blocks_at = [0]
    ordinals: list[dict[str, int]] = [{}]
    held: list[str] = []

    def flush() -> None:
        if held:
            text = " ".join(unescape("".join(held)).split())
            held.clear()
            if text:
                at = stack[blocks_at[-1]]
                page.blocks.append((at.node, at.style, text, at.main))

    def cut(i: int) -> None:
        while len(stack) > i:
            places[stack.pop().tag].pop()
            if blocks_at[-1] >= len(stack):
                blocks_at.pop()

    def where(tags: Iterable[str]) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def close(tag: str, stops: Iterable[str]) -> None:
        i = where(ALIKE.get(tag, (tag,)))
        if i > where(stops):
            flush()
            cut(i)

    at, n = 0, len(html)
    low = ""
    last = {c: html.rfind(c) for c in "\"'>"}
    while at < n:
        mark = html.find("<", at)
        if mark < 0:
            mark = n
        if mark > at and not stack[-1].skip:
            held.append(html[at:mark])
        if mark == n:
            break
        m = _MARK.match(html, mark)
        if m:
            slash, tag, raw, at = m[1], m[2].lower(), m[3], m.end()
            attributes = None
        elif html.startswith("<!--", mark):
            at = html.find("-->", mark + 4)
            at = n if at < 0 else at + 3
            continue
        elif html[mark + 1 : mark + 2] in ("!", "?", "/") and not html[mark + 2 : mark + 3].isalpha() or html[mark + 1 : mark + 2] in ("!", "?"):
            end = html.find(">", mark) if mark < last[">"] else -1
            at = n if end < 0 else end + 1
            if end < 0:
                held.append(html[mark:])
            continue
        else:
            found = _slow_tag(html, mark, last)
            if not found:
                held.append("<")
                at = mark + 1
                continue
            slash, tag, attributes, at = found
            tag, raw = tag.lower(), ""
        if slash:
            i = where((tag,))
            if tag in BLOCK:
                if i:
                    flush()
                    cut(i)
            elif i > blocks_at[-1]:
                cut(i)
            continue
        if tag in RAW or tag == "title" and all(x.tag in ("", "html", "head") for x in stack[:4]) and len(stack) < 4:
            low = low or html.lower()
            end = low.find(f"</{tag}", at) if len(low) == n else -1
            if end < 0 and len(low) != n:
                odd = re.compile(f"</{tag}", re.I).search(html, at)
                end = odd.start() if odd else -1
            at = n if end < 0 else end
            continue
        if tag in BLOCK:
            flush()
            if tag in CLOSES:
                own, *stops = CLOSES[tag]
                close(own, stops)
            if tag not in IN_P:
                close("p", P_STOPS)
            page.shapes[stack[blocks_at[-1]].node].append(tag)
        if tag in VOID:
            continue
        if attributes is None:
            attributes = {a.lower(): b or c or d for a, b, c, d in _ATTRIBUTE.findall(raw)} if raw and not raw.isspace() else {}
        up = stack[-1]
        main = up.main or tag in MAIN_TAGS or attributes.get("role", "").lower() == "main" or attributes.get("itemprop", "").lower() == "articlebody"
        noise = marks and _noisy(tag, attributes, up.main)
        if tag in BLOCK:
            name = f"{tag}.{'.'.join(attributes.get('class', '').split())}"
            style = _child(up.style, name, -1)
            if tag in ("html", "body"):
                page.loose.add(style)
            if tag in TEXT:
                new = _Open(tag, up.node, style, main, up.skip or noise)
            else:
                here = ordinals[up.node]
                place = here[name] = here.get(name, 0) + 1
                page.paths.append(_child(page.paths[up.node], name, place))
                page.ups.append(up.node)
                page.noise.append(noise)
                page.main.append(main and not up.main)
                page.tags.append(tag)
                page.shapes.append([])
                ordinals.append({})
                new = _Open(tag, len(page.paths) - 1, style, main, up.skip)
            blocks_at.append(len(stack))
        else:
            new = _Open(tag, up.node, up.style, main, up.skip or noise)
        places.setdefault(tag, []).append(len(stack))
        stack.append(new)
    flush()
    if any(page.noise):
        words = subtree(page, [words_in(text) for _, _, text, _ in page.blocks])
        page.noise = [x and not (t in WRAPPERS and 2 * w > words[0]) for x, t, w in zip(page.noise, page.tags, words, strict=True)]
    return page


def words_in(text: str) -> int:
    return text.count(" ") + 1


def subtree(page: Page, weights: list[int]) -> list[int]:
    """Sums of the blocks' weights in and below each node."""
    total = [0] * len(page.paths)
    for (node, *_), w in zip(page.blocks, weights, strict=True):
        total[node] += w
    for i in range(len(total) - 1, 0, -1):
        total[page.ups[i]] += total[i]
    return total


def branch(style: int, text: str) -> int:
    """A content node of the site's tree, as 63 bits of its style path and content."""
    return _hash(style, text)


@dataclass(frozen=True)
class Site:
    """What a host's tree says: branches cut off, marked ones that stay, contents that go outside articles, and inside."""

    cut: frozenset[int] = frozenset()
    spared: frozenset[int] = frozenset()
    removed: frozenset[int] = frozenset()
    shared: frozenset[int] = frozenset()


def main_text(html: str | None, site: Site | None = None, marks: bool = True) -> str:
    """The page's blocks without the site's unimportant branches and contents, in order.

    Without a tree the marks decide. Unmarked blocks beside an article stay, unless all of
    them are a stray line next to it; loose text goes if it is no longer than the article.
    """
    page = parse(html or "", marks)
    gone = [False]
    for i in range(1, len(page.paths)):
        path = page.paths[i]
        own = path in site.cut or page.noise[i] and path not in site.spared if site else page.noise[i]
        gone.append(gone[page.ups[i]] or own)
    blocks = [(style, text, main) for node, style, text, main in page.blocks if not gone[node]]
    if not site:
        inside = sum(len(text) for _, text, main in blocks if main)
        beside = {loose: sum(len(text) for style, text, main in blocks if not main and (style in page.loose) == loose) for loose in (True, False)}
        gone_kinds = {loose for loose in beside if inside and beside[loose] <= inside * (1.0 if loose else STRAY)}
        return " ".join(text for style, text, main in blocks if main or (style in page.loose) not in gone_kinds)
    lists = (site.removed, site.shared)
    return " ".join(text for style, text, main in blocks if not lists[main] or branch(style, text) not in lists[main])


BLOCKS = "array<struct<style: long, branch: long, size: long, words: int, node: int>>"
NODES = "array<struct<path: long, up: int, shape: long, mark: int>>"
_BLOCKS = pa.list_(pa.struct([("style", pa.int64()), ("branch", pa.int64()), ("size", pa.int64()), ("words", pa.int32()), ("node", pa.int32())]))
_NODES = pa.list_(pa.struct([("path", pa.int64()), ("up", pa.int32()), ("shape", pa.int64()), ("mark", pa.int32())]))


def _parsed(batches: Iterator[pa.RecordBatch], marks: bool) -> Iterator[pa.RecordBatch]:
    """(host, hash of the page's blocks, its distinct blocks, its nodes), once a page."""
    for batch in sliced(batches):
        hosts, pages, found, trees = [], [], [], []
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            page = parse(html or "", marks) if host else Page()
            if not page.blocks:
                continue
            blocks = {branch(s, t): {"style": s, "branch": branch(s, t), "size": len(t), "words": words_in(t), "node": n} for n, s, t, _ in page.blocks}
            hosts.append(host)
            pages.append(_digest(blocks))
            found.append(list(blocks.values()))
            marked = [-1 if x else 1 if y else 0 for x, y in zip(page.noise, page.main, strict=True)]
            trees.append([{"path": p, "up": u, "shape": _hash(*s), "mark": m} for p, u, s, m in zip(page.paths, page.ups, page.shapes, marked, strict=True)])
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(pages, pa.int64()), pa.array(found, _BLOCKS), pa.array(trees, _NODES)], names=["host", "page", "blocks", "nodes"])


def _digest(branches: Iterable[int]) -> int:
    return xxhash.xxh64_intdigest(np.array(sorted(branches), np.int64).tobytes()) >> 1


def identity(sizes: dict[int, int], frequent: frozenset[int] = frozenset()) -> int:
    """What makes a page different from others of its host, given its branches and their lengths.

    The longest blocks that are not frequent, up to most of such text, so that a date or a
    counter makes no new page. Where next to nothing is left beside frequent blocks, the
    page is a copy of them, and they identify it.
    """
    own = {b: n for b, n in sizes.items() if b not in frequent}
    if sum(own.values()) < OWN * sum(sizes.values()):
        own = sizes
    want, got = (1 - OWN) * sum(own.values()), 0
    chosen: list[int] = []
    for b in sorted(own, key=lambda b: (-own[b], b)):
        if got >= want:
            break
        chosen.append(b)
        got += own[b]
    return _digest(chosen)


def _branches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, style, branch, the page's identity) of pages with their blocks and the host's frequent branches."""
    for batch in sliced(batches):
        out: list[tuple[str, int, int, int]] = []
        known: dict[str, frozenset[int]] = {}
        for host, blocks, frequent in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if host not in known:
                known[host] = frozenset(frequent.as_py() or ())
            page = identity({x["branch"]: x["size"] for x in blocks}, known[host])
            out += [(host, x["style"], x["branch"], page) for x in blocks]
        columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(list(columns[0]), pa.string()), *(pa.array(list(c), pa.int64()) for c in columns[1:])], names=["host", "style", "branch", "page"])


def _small(lists: DataFrame, column: str) -> DataFrame:
    """A host's list, broadcast where the lists of all hosts, a row counting as one entry more, are short."""
    entries = lists.agg(F.coalesce(F.sum(F.size(column) + 1), F.lit(0)).alias("n")).first().n
    return F.broadcast(lists) if entries <= BROADCAST_BRANCHES else lists


#: A host's nodes, by child sequence.
MASSES = "host string, path long, up long, shape long, mark int, pages long, words double, own double"


def _masses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each presentation node and child sequence in a slice: pages, words of important contents in and below it, and those in it directly."""
    for batch in sliced(batches):
        sums: dict[tuple, list[float]] = {}
        known: dict[str, frozenset[int]] = {}
        for host, blocks, nodes, removed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
            if host not in known:
                known[host] = frozenset(removed.as_py() or ())
            own = [0] * len(nodes)
            for x in blocks:
                own[x["node"]] += x["words"] if x["branch"] not in known[host] else 0
            total = list(own)
            for i in range(len(nodes) - 1, 0, -1):
                total[nodes[i]["up"]] += total[i]
            for i, x in enumerate(nodes):
                up = nodes[x["up"]]["path"] if i else -1
                cell = sums.setdefault((host, x["path"], up, x["shape"], x["mark"]), [0, 0.0, 0.0])
                cell[0] += 1
                cell[1] += total[i]
                cell[2] += own[i]
        rows = [(*k, *v) for k, v in sums.items()]
        types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(types), types, strict=True)], names=[f.split()[0] for f in MASSES.split(", ")])


def judge(nodes: Iterable[tuple[int, int, float, float, float, int]]) -> tuple[list[int], list[int]]:
    """(branches to cut off, marked branches that stay) of a host's nodes: path, parent's path, words and own words a page, entropy, mark.

    From the root down: where a child brings more text than stands in the node itself, the
    children are measured by the one that brings most, else the node is text and stays whole.
    """
    own: dict[int, float] = {}
    children: dict[int, list[tuple[int, float, float, int]]] = {}
    for path, up, words, direct, entropy, mark in nodes:
        own[path] = direct
        children.setdefault(up, []).append((path, words, entropy, mark))
    cut: list[int] = []
    spared: list[int] = []
    left = [ROOT]
    while left:
        at = left.pop()
        below = children.get(at, [])
        most = max((words for _, words, _, _ in below), default=0.0)
        if most <= own.get(at, 0.0):
            continue
        for path, words, entropy, mark in below:
            prior = MARKED if mark < 0 else MAIN if mark > 0 else 1.0
            if prior * words / most * (1 + entropy) / 2 < BRANCH_IMPORTANCE:
                cut.append(path)
            else:
                spared += [path] * (mark < 0)
                left.append(path)
    return sorted(cut), sorted(spared)


def site_trees(pages: DataFrame, scope: Staging, marks: bool = True) -> DataFrame:
    """What the tree of each host with enough different pages says: host, cut, spared, removed, shared (see ``Site``).

    Both df and m count identities, so copies of a page don't make its text look common. A
    content that goes, and a node that is judged, is on at least m ** (1 - CONTENT_IMPORTANCE)
    of the pages, which bounds a host's lists.
    """
    hosts = pages.select(url_host(F.col("url")).alias("host"), "html")
    # Pages with the same blocks are one row from here on.
    parsed = hosts.mapInArrow(lambda b: _parsed(b, marks), f"host string, page long, blocks {BLOCKS}, nodes {NODES}")
    parsed = scope.write(parsed.groupBy("host", "page").agg(F.min(F.struct("blocks", "nodes")).alias("p")).select("host", "page", "p.*"), "parsed", slim=True)
    df = F.col("df")
    count = parsed.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_PAGES)
    shares = parsed.select("host", F.explode("blocks.branch").alias("branch")).groupBy("host", "branch").agg(F.count("*").alias("df")).where(df >= MIN_PAGES / 2)
    frequent = shares.join(count, "host").where(df > FREQUENT * F.col("n")).groupBy("host").agg(F.collect_list("branch").alias("frequent"))
    known = scope.write(frequent, "frequent", slim=True)
    seen = parsed.join(_small(known, "frequent"), "host", "left").select("host", "blocks", "frequent").mapInArrow(_branches, "host string, style long, branch long, page long")
    # Counts of different pages: equal rows meet first, so a hot branch is a small number a task.
    seen = scope.write(seen.distinct(), "seen", slim=True)
    contents = scope.write(seen.groupBy("host", "style", "branch").agg(F.count("*").alias("df")), "contents", slim=True)
    sizes = scope.write(seen_pages(seen), "sizes", slim=True).where(F.col("m") >= MIN_PAGES)
    styles = contents.groupBy("host", "style").agg(F.sum("df").alias("s"), F.sum(df * F.ln(df)).alias("l"))
    common = contents.where(df >= MIN_PAGES).join(sizes, "host").join(styles, ["host", "style"])
    content = F.lit(1.0) - F.ln(df) / F.ln("m")
    entropy = (F.ln("s") - F.col("l") / F.col("s")) / F.ln("m")
    low = common.where((content < CONTENT_IMPORTANCE) & ((content + F.least(entropy, F.lit(1.0))) / 2 < IMPORTANCE))
    most = F.when(df >= SHARED * F.col("m"), F.col("branch"))
    lists = low.groupBy("host").agg(F.collect_list("branch").alias("removed"), F.collect_list(most).alias("shared"))
    empty = F.lit([]).cast("array<long>")
    judged = scope.write(sizes.join(lists, "host", "left").select("host", "m", *[F.coalesce(c, empty).alias(c) for c in ("removed", "shared")]), "lists", slim=True)

    # Presentation nodes: mean words over the pages that have the node, and the entropy of their child sequences.
    masses = parsed.join(_small(judged, "removed"), "host").select("host", "blocks", "nodes", "removed").mapInArrow(_masses, MASSES)
    n = F.col("pages")
    shapes = masses.groupBy("host", "path", "up", "shape").agg(F.sum("pages").alias("pages"), F.sum("words").alias("words"), F.sum("own").alias("own"), F.min("mark").alias("low"), F.max("mark").alias("high"))
    nodes = shapes.groupBy("host", "path", "up").agg(F.sum("pages").alias("n"), F.sum("words").alias("words"), F.sum("own").alias("own"), F.sum(n * F.ln(n)).alias("l"), F.min("low").alias("low"), F.max("high").alias("high"))
    known_m = judged.select("host", "m")
    nodes = nodes.join(known_m, "host").where((F.col("n") >= MIN_PAGES) & (F.col("n") >= F.pow("m", F.lit(1 - CONTENT_IMPORTANCE))) | (F.col("path") == ROOT))
    spread = F.least((F.ln("n") - F.col("l") / F.col("n")) / F.ln("m"), F.lit(1.0))
    mark = F.when(F.col("low") < 0, -1).otherwise(F.col("high"))
    judge_in = nodes.select("host", F.struct("path", "up", (F.col("words") / F.col("n")).alias("words"), (F.col("own") / F.col("n")).alias("own"), spread.alias("entropy"), mark.alias("mark")).alias("node"))
    verdicts = judge_in.groupBy("host").agg(F.array_sort(F.collect_list("node")).alias("nodes")).mapInPandas(_judged, "host string, cut array<long>, spared array<long>")
    return judged.join(verdicts, "host", "left").select("host", *[F.coalesce(c, empty).alias(c) for c in ("cut", "spared", "removed", "shared")])


def _judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for hosts in batches:
        found = [judge([(x["path"], x["up"], x["words"], x["own"], x["entropy"], x["mark"]) for x in nodes]) for nodes in hosts["nodes"]]
        yield pd.DataFrame({"host": hosts["host"], "cut": [c for c, _ in found], "spared": [s for _, s in found]})


def seen_pages(seen: DataFrame) -> DataFrame:
    """Different pages of each host, by the identity that df counts."""
    return seen.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("m"))


def extract(pages: DataFrame, marks: bool = True) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    Null html is an empty page. A page keeps every block of a branch that its site's tree
    keeps; on hosts of too few pages see ``main_text``. Without ``marks``, tags, roles and
    class names count for nothing. Null urls belong to no site. Repeated rows stay repeated;
    an empty table gives an empty result. Other columns are ignored.
    """
    scope = Staging(pages.sparkSession, "site-tree")
    src = pages.select(pages["page_id"].cast("long").alias("page_id"), "url", "html")
    sites = scope.write(site_trees(src, scope, marks), "sites", slim=True).withColumnRenamed("host", "_host")
    joined = src.join(_small(sites, "removed"), url_host(F.col("url")) == F.col("_host"), "left").select("page_id", "url", "html", "cut", "spared", "removed", "shared")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            known: dict[tuple, Site] = {}
            texts = []
            for html, *lists in zip(*batch.columns[2:], strict=True):
                site = None
                if lists[0].is_valid:
                    key = tuple(tuple(x.as_py()) for x in lists)
                    if key not in known:
                        known[key] = Site(*map(frozenset, key))
                    site = known[key]
                texts.append(main_text(html.as_py(), site, marks))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))


ORACLE: dict[str, str] = {}
QUERIES = {"op2_html_extraction": op2_html_extraction}
