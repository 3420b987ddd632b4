"""Main text of web pages by the consensus of a host's pages.

Each page's containers are scored by the clean text they hold; the best one's path of tags
and classes, numbers generalised, is the page's vote. Votes are counted per host and path,
so a host's pages are never brought together, and every page is then extracted again at the
path that won on its host, and what is clean elsewhere goes. Where a page has no container there, or one that
holds less than DECIDING_SHARE both of the clean text usual on the host and of that in its own best, its own best is taken.

The best container is widened to the ancestor that holds the clean text of its siblings; blocks
beside it that are mostly links stay out. An element hides if a word of its class, id or role
names what stands around an article. A compound hides by its head, the last part (cookie-notice),
or by any part if its head is a mere holder (share-bar), unless it holds most of the page's text;
share-price or related-work don't hide. Words that can also tell what a text is about hide
containers only, not paragraphs. Where nothing is left, only what is hidden by attributes stays out.

Defined cases: null or empty html has no text; markup that is cut off ends with the page; a
null url, or one without a host, votes with all pages of that kind; pages that repeat vote
each; of paths with equal votes the first in order wins; any depth of nesting and any length of
page are read whole, in time that grows with the length; further columns pass through whatever
their names, and those named like a result are replaced.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlode.llm.columns import Held
from gridlode.llm.skew import join_hot
from gridlode.llm.storage import written
from gridlode.llm.textcols import column_of, pieces
from gridlode.llm.url_filters import host_and_path

#: Tags whose content is never text, and tags of what stands around an article.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "object", "svg", "math", "canvas", "audio", "video"}
AROUND = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "fieldset"}
CONTAINERS = {"html", "body", "main", "article", "section", "div", "td", "center"}
INLINE = {"img", "input", "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Words of classes, ids and roles that mark what stands around an article.
NAMES = set(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup paywall "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar topbar header masthead footer bottombar colophon copyright sidebar side aside complementary widget widgets related recommended recommendations "
    "comment comments commentlist disqus respond replies share sharing social login search searchform form hidden navbox toc contentinfo".split()
)
#: Heads of compounds that say nothing of what they hold, names that may as well be the matter of a text, and elements of running text.
HOLDERS = set("box boxes bar bars block blocks wrap wrapper container area panel section links link list button buttons item items unit slot row column col left right top bottom inner outer primary secondary post posts article articles story stories content text group holder region zone frame image img icon icons head title label count main".split())
MATTERS = {"social", "share", "sharing", "related", "side", "form", "search", "login", "menu", "alert", "header", "complementary", "recommended", "promotion"}
RUNS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "figure", "figcaption", "span", "em", "strong", "b", "i", "td", "th", "dd", "dt"}
HINTS = {"content", "article", "post", "entry", "main", "story", "body", "text"}
#: Elements that classes don't hide, but for readers' comments.
WHOLE, REMARKS = {"html", "body", "main", "article"}, {"comment", "comments", "reply", "disqus"}
#: Factors of a container's score, and of one level of depth.
FAVOUR = {"article": 3.0, "main": 2.0, "body": 0.7, "html": 0.5}
ROOT_FAVOUR, HINT_FAVOUR, DEPTH_FAVOUR = 0.1, 1.5, 1.2
#: Parts of words that tell the state of a container, not what it is.
STATES = {"no", "has", "with", "without", "closed", "enabled", "disabled"}
#: A container widens for a clean block of so many characters, or for this share of its own clean text.
RUNNING, ADDED_SHARE = 60, 0.1
#: The winning path decides where it holds this share of what is usual there, or of the page's own best.
DECIDING_SHARE = 0.5
#: How much hides: words only, parts of words too, and attributes only.
BY_WORDS, BY_PARTS, BY_ATTRIBUTES = range(3)
#: As many winning paths of hosts are broadcast; more are joined by a shuffle.
MAX_BROADCAST_HOSTS = 100_000

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


class Container:
    """An open element that can hold an article: the hash of its path, depth, factor, clean text and links so far."""

    __slots__ = ("path", "depth", "favour", "first", "last", "size", "linked", "parent")

    def __init__(self, step: str, favour: float, first: int, parent: Container | None) -> None:
        self.favour, self.first, self.last, self.parent = favour, first, first, parent
        self.path, self.depth = (path_hash(parent.path, step), parent.depth + 1) if parent else ("", 0)
        self.size = self.linked = 0


def path_hash(above: str, step: str) -> str:
    """The path of an element by that of its parent: of one length at any depth."""
    return hashlib.blake2b(f"{above}/{step}".encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()


def path_of(path: str) -> str:
    """Hash of a written path of tags and classes, such as /body/div.post."""
    return reduce(path_hash, path.strip("/").split("/"), "")


def _named(attributes: str) -> tuple[list[str], bool]:
    """Words of class, id and role, and whether the element is hidden."""
    words, hidden = [], False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            hidden = True
        elif name in ("class", "id", "role"):
            words += value.split()
    return words, hidden


def read_page(html: str) -> tuple[list[str], list[int], list[Container]]:
    """Blocks of clean text in page order, their characters in links, and the containers that hold them."""
    blocks, links, found, total, partly = _read(html, BY_WORDS)
    spared = frozenset(at for at, size in partly.items() if 2 * size > total)
    if any(size and at not in spared for at, size in partly.items()):
        blocks, links, found, _, _ = _read(html, BY_PARTS, spared)
    if not blocks:
        blocks, links, found, _, _ = _read(html, BY_ATTRIBUTES)
    return blocks, links, found


def _read(html: str, hide: int, spared: frozenset[int] = frozenset()) -> tuple[list[str], list[int], list[Container], int, dict[int, int]]:
    """As read_page, with the characters read and those within each element that parts of words name, by its place."""
    blocks: list[str] = []
    links: list[int] = []
    parts: list[str] = []
    root = Container("", ROOT_FAVOUR, 0, None)
    found, now = [root], root
    stack: list[tuple[str, Container | None, bool, int]] = []  # tag, the container it opened, whether it hides what it holds, its place if parts of words name it
    partly: dict[int, int] = {}
    hiding = anchors = linked = at = total = watched = 0
    open_tags: Counter[str] = Counter()

    def close_block() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(parts)).split()) if parts else ""
        parts.clear()
        if text:
            blocks.append(text)
            links.append(min(len(text), linked))
            now.size += len(text)
            now.linked += links[-1]
        linked = 0

    def close(n: int) -> None:
        nonlocal now, hiding, anchors, watched
        while len(stack) > n:
            tag, own, hides, place = stack.pop()
            open_tags[tag] -= 1
            hiding -= hides
            if place >= 0:
                partly[place] += total
                watched -= tag in INLINE
            if own is not None:
                own.last, now, anchors = len(blocks), own.parent, 0

    def open_one(tag: str, own: Container | None, hides: bool, place: int) -> None:
        stack.append((tag, own, hides, place))
        open_tags[tag] += 1

    def end_of(tag: str) -> None:
        for k in range(len(stack) - 1, -1, -1) if open_tags[tag] else ():
            if stack[k][0] == tag:
                close(k)
                return

    def judged(tag: str, words: list[str], hidden: bool) -> tuple[bool, int]:
        """Whether the element hides, and its place if parts of words name it and don't hide it yet."""
        if hidden or hide == BY_ATTRIBUTES:
            return hidden, -1
        if tag in WHOLE:
            return any(re.split("[-_]+", w)[0] in REMARKS and STATES.isdisjoint(re.split("[-_]+", w)) for w in words), -1
        if tag in AROUND or any(w in NAMES and not (tag in RUNS and w in MATTERS) for w in words):
            return True, -1
        if not _partly_named(tag, words):
            return False, -1
        return (False, m.start()) if hide == BY_WORDS else (m.start() not in spared, -1)

    while m := _TAG.search(html, at):
        if not hiding and m.start() > at:
            parts.append(html[at : m.start()])
            linked += anchors * (m.start() - at)
            total += len(parts[-1].strip())
        at = m.end()
        if not m[2]:
            continue
        tag, ends = m[2].lower(), bool(m[1])
        if tag in RAW:
            if not ends and not m[3].endswith("/"):
                end = re.compile(f"</{tag}[^>]*>", re.I).search(html, at)
                at = end.end() if end else len(html)
            continue
        if tag == "a":
            anchors = int(not ends)
        if tag in INLINE:
            if ends:
                if hiding or watched:
                    end_of(tag)
            elif m[3] and tag not in VOID:
                hides, place = judged(tag, *_named(m[3]))
                if hides or hiding or watched or place >= 0:
                    open_one(tag, None, hides, place)
                    hiding += hides
                if place >= 0:
                    partly[place] = -total
                    watched += 1
            elif (hiding or watched) and tag not in VOID:
                open_one(tag, None, False, -1)
            continue
        close_block()
        if ends:
            end_of(tag)
            continue
        if tag in VOID:
            continue
        if stack and stack[-1][0] in ("p", "li", "dt", "dd", "tr") and (stack[-1][0] in ("p", tag)):
            close(len(stack) - 1)  # its end tag was left out
        words, hidden = _named(m[3]) if m[3] else ([], False)
        hides, place = judged(tag, words, hidden)
        if tag in WHOLE and hiding and not hides and all(t in ("form", "header", "nav") for t, _, h, _ in stack if h):
            close(next(k for k, x in enumerate(stack) if x[2]))  # a menu left open, or a form around the page
        own = None
        if tag in CONTAINERS and not hides and not hiding:
            classes = "".join(f".{w}" for w in sorted({re.sub(r"\d+", "#", w) for w in words}))
            hinted = any(p in HINTS for w in words for p in re.split("[-_]+", w))
            own = Container(f"{tag}{classes}", FAVOUR.get(tag, HINT_FAVOUR if hinted else 1.0), len(blocks), now)
            found.append(own)
            now = own
        open_one(tag, own, hides, place)
        if place >= 0:
            partly[place] = -total
        hiding += hides
    if not hiding:
        parts.append(html[at:])
        total += len(parts[-1].strip())
    close_block()
    close(0)
    root.last = len(blocks)
    return blocks, links, found, total, partly


def _partly_named(tag: str, words: list[str]) -> bool:
    """Whether a compound is named by its head, or by a part before a head that says nothing; words of a container's state don't count."""

    def named(parts: list[str]) -> bool:
        head = parts[-1]
        if head in NAMES or not REMARKS.isdisjoint(parts):
            return True
        return (head in HOLDERS or head.isdigit()) and not NAMES.isdisjoint(parts)

    split = [[p for p in re.split("[-_]+", w) if p] for w in words]
    return any(len(ps) > 1 and named(ps) and (tag not in CONTAINERS or STATES.isdisjoint(ps)) for ps in split)


def scored(containers: list[Container]) -> Container | None:
    """The container with the best score, the earliest of equals; sizes then include what containers within hold."""
    for c in reversed(containers):
        if c.parent is not None:
            c.parent.size += c.size
            c.parent.linked += c.linked
    best, most = None, float("-inf")
    for c in containers:
        if c.size > c.linked:
            score = log((c.size - c.linked) * c.favour) + c.depth * log(DEPTH_FAVOUR)
            if score > most:
                best, most = c, score
    return best


def _clean(blocks: list[str], links: list[int], i: int) -> bool:
    return 2 * links[i] < len(blocks[i])


def widened(best: Container, blocks: list[str], links: list[int]) -> Container:
    """The outermost ancestor that adds running clean text, or a good share of clean text; else best."""
    chosen, c, added, running = best, best, 0, False
    while c.parent is not None:
        for i in (*range(c.parent.first, c.first), *range(c.last, c.parent.last)):
            if _clean(blocks, links, i):
                added += len(blocks[i]) - links[i]
                running = running or len(blocks[i]) >= RUNNING
        c = c.parent
        if running or added and added >= ADDED_SHARE * (best.size - best.linked):
            chosen, added, running = c, 0, False
    return chosen


def extract(html: str | None, path: str | None, usual: float | None = None) -> str:
    """The text at the path (a hash, or written out), or at the page's own best container.

    usual is the clean text that the host's pages hold at the path. Where it is known, the path decides on pages that
    hold half of it there, or half of what their own best container holds; blocks elsewhere go, however clean. Where
    it is not known, the path may add blocks but none of the page's own clean blocks go.
    """
    path = path_of(path) if path and path.startswith("/") else path
    blocks, links, containers = read_page(html or "")
    best = scored(containers)
    if best is None:
        return " ".join(blocks)
    wide = widened(best, blocks, links)
    own = {i for i in range(wide.first, wide.last) if best.first <= i < best.last or _clean(blocks, links, i)}
    chosen = {i for c in containers if c.path == path for i in range(c.first, c.last) if best.first <= i < best.last or _clean(blocks, links, i)}
    if usual is None:
        keeps = not any(_clean(blocks, links, i) and i not in chosen for i in own)
    else:
        there = _clean_size(blocks, links, chosen)
        keeps = there > 0 and there >= DECIDING_SHARE * min(usual, _clean_size(blocks, links, own))
    return " ".join(blocks[i] for i in sorted(chosen if keeps else own))


def _clean_size(blocks: list[str], links: list[int], of: set[int]) -> int:
    return sum(len(blocks[i]) for i in of if _clean(blocks, links, i))


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[tuple[str, str], list[int]] = {}
        for host, html in zip(column_of(batch, "host").to_pylist(), column_of(batch, "html").to_pylist(), strict=True):
            blocks, links, containers = read_page(html or "")
            best = scored(containers)
            if best is not None:
                wide = widened(best, blocks, links)
                vote = counts.setdefault((host, wide.path), [0, 0])
                vote[0] += 1
                vote[1] += _clean_size(blocks, links, set(range(wide.first, wide.last)))
        rows = [(*k, *v) for k, v in counts.items()]
        kinds = [("host", pa.string()), ("path", pa.string()), ("votes", pa.int64()), ("chars", pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(kinds)], names=[n for n, _ in kinds])


def winning_paths(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """host, path and usual: the path with most votes on the host, the first of equals, and the mean clean text of those who voted for it."""
    seen = pages.select(host_and_path(F.col(url_col))[0].alias("host"), F.col(html_col).alias("html"))
    votes = seen.mapInArrow(_votes, "host string, path string, votes long, chars long").groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("chars").alias("chars"))
    most = F.min_by(F.struct("path", (F.col("chars") / F.col("votes")).alias("usual")), F.struct(-F.col("votes"), "path"))
    return written(votes.groupBy("host").agg(most.alias("won")).select("host", "won.path", "won.usual"), "paths")


def main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The rows of pages with text and n_chars."""
    held = Held(pages, url=url_col, html=html_col)
    paths = winning_paths(held.rows, held["url"], held["html"]).select("host", F.col("path").alias("winner"), "usual")
    rows = held.rows.select("*", host_and_path(F.col(held["url"]))[0].alias("host"))
    if paths.count() <= MAX_BROADCAST_HOSTS:
        rows = rows.join(F.broadcast(paths), "host", "left")
    else:
        rows = join_hot(rows, paths, ["host"], F.col(held["url"]), "left")

    columns, html = held.columns, held["html"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, html):
                texts = [extract(h, p, u) for h, p, u in zip(*(column_of(piece, c).to_pylist() for c in (html, "winner", "usual")), strict=True)]
                yield pa.RecordBatch.from_arrays([*(column_of(piece, c) for c in columns), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*columns, "text", "n_chars"])

    schema = held.fields(T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()))
    return held.given(rows.select(*columns, "winner", "usual").mapInArrow(run, schema), "text", "n_chars")


def op1_html_extract(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return main_text(pages).select("page_id", "url", "text", "n_chars")
