"""Main text of web pages: containers are scored page by page, hosts agree on their paths, and pages are extracted along these."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lexmill.functions.staging import BROADCAST_BYTES, byte_size
from lexmill.llm.common import cut, join_counted

#: A comment or declaration; an element whose content is no markup; a tag, in which quoted values may hold any sign;
#: a tag whose quotes do not close, up to the next bracket; a tag that the page's end cuts off.
_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)"
    r"|<(script|style|textarea|title|xmp|iframe|noembed|noframes)(?=[\s/>])[^>]*(?:>.*?(?:</\1(?=[\s/>])[^>]*(?:>|\Z)|\Z)|\Z)"
    r"|<(/?)([a-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-z][^\s/>]*)([^>]*)>"
    r"|</?[a-z][^>]*\Z",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_SPACE = " \t\n\r\f/"
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_DIGITS = re.compile(r"\d+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that stand within a line; all others part blocks.
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements that are never main text.
_NEVER = frozenset("head nav footer aside noscript template svg math canvas object audio video select option optgroup datalist button menu dialog".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar toolbar alert".split())
#: Elements that end an open paragraph.
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
#: Elements that are parts of an article at most, never its container.
_PARTS = frozenset("p li ul ol dl dt dd pre blockquote h1 h2 h3 h4 h5 h6 thead tfoot th".split())
#: What an opening tag ends if it is still open.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
_SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}

#: Words in class, id or role names that mark what is not the article; pairs are words in a row.
_WORDS = frozenset(
    "ad ads adsense advert adverts advertisement advertisements advertising sponsor sponsored promo promos promotion banner menu menus nav navbar navigation breadcrumb breadcrumbs "
    "sidebar aside footer masthead cookie cookies consent gdpr notice notices popup modal overlay subscribe subscription newsletter signup social share sharing "
    "related recommended comment comments disqus reply replies respond widget widgets toolbar pagination pager paginator login search hidden".split()
)
_PAIRS = frozenset((("site", "header"), ("page", "header"), ("main", "header"), ("top", "bar"), ("skip", "link"), ("sign", "up"), ("see", "also"), ("read", "more"), ("sr", "only"), ("visually", "hidden")))
#: Before such a word a mark says how a page looks, not what the element is.
_ABOUT = frozenset("has with without no is not category tag topic type".split())
#: Where nothing is left of a page, first forms and then elements named as boilerplate are let in.
KEPT = (0, 1, 2)
#: Share of a page's prose that a container has to hold, and of a host's votes that make a path one of its winners.
ENOUGH, WINNING = 0.9, 0.1


@dataclass(slots=True)
class Element:
    tag: str
    parent: int
    label: str
    path: int
    article: bool
    out: int  # 0: may be main text; kept out 1: as a form, 2: by its names, 3: by its tag or role


@dataclass(slots=True)
class Block:
    element: int
    heading: bool
    text: str
    links: int


@dataclass
class Page:
    """Elements in page order (a parent before its children) and the blocks of text in them."""

    elements: list[Element] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), value.strip("\"'"))
    return out


def _boilerplate(name: str, tag: str, in_article: bool) -> bool:
    """Whether a class or id says that an element is not the article."""
    words = [w.lower() for w in _WORD.findall(name)]
    if not words or words[0] in _ABOUT:
        return False
    if tag == "article":
        return words[0] in _WORDS
    if words == ["header"] and not in_article:
        return True
    return any(w in _WORDS for w in words) or any(p in _PAIRS for p in zip(words, words[1:]))


def _out(tag: str, a: dict[str, str], in_article: bool) -> int:
    """How an element is kept out of the main text by itself."""
    if tag in _NEVER or (tag == "header" and not in_article):
        return 3
    if tag in ("html", "body", "main"):
        return 0
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or a.get("role", "").lower() in _ROLES or "display:none" in a.get("style", "").replace(" ", "").lower():
        return 3
    if any(_boilerplate(x, tag, in_article) for x in (*a.get("class", "").split(), a.get("id", "")) if x):
        return 2
    return int(tag == "form")


@lru_cache(maxsize=4096)
def _kind(tag: str, attributes: str, in_article: bool) -> tuple[str, bool, int]:
    """Label (tag and classes, digits made alike), whether an article begins here or above, and how it is kept out."""
    a = _attributes(attributes)
    article = in_article or tag in ("article", "main") or a.get("role", "").lower() in ("main", "article")
    return ".".join([tag, *sorted({_DIGITS.sub("#", c) for c in a.get("class", "").split()})]), article, _out(tag, a, article)


def parse(source: str) -> Page:
    """Elements and blocks of a page, however badly nested; one pass, without recursion."""
    page, stack = Page(), [0]
    pieces: list[str] = []
    links = at = 0
    elements, blocks = page.elements, page.blocks

    def add(tag: str, attributes: str) -> int:
        up = elements[stack[-1]]
        if tag in _INLINE:  # no part of a path; its text belongs to the block around it
            elements.append(Element(tag, stack[-1], tag, up.path, up.article, up.out))
        else:
            label, article, out = _kind(tag, attributes, up.article)
            path = up.path if tag in ("html", "body") else xxhash.xxh64_intdigest(label, up.path)
            elements.append(Element(tag, stack[-1], label, path, article, max(out, up.out)))
        return len(elements) - 1

    elements.append(Element("html", -1, "html", 0, False, 0))  # html and body, written or not, are no part of a path
    open_at: dict[str, list[int]] = {"html": [0]}  # places on the stack
    outer = [0]  # of elements that are not inline

    def text_of(piece: str) -> None:
        nonlocal links
        if piece:
            piece = html.unescape(piece) if "&" in piece else piece
            pieces.append(piece)
            if open_at.get("a"):
                links += len(piece)

    def close_block() -> None:
        nonlocal links
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                i = stack[-1]
                while elements[i].tag in _INLINE and elements[i].parent >= 0:
                    i = elements[i].parent
                blocks.append(Block(i, elements[i].tag == "h1", text, links))
            pieces.clear()
        links = 0

    def pop() -> None:
        tag = elements[stack.pop()].tag
        open_at[tag].pop()
        if tag not in _INLINE:
            outer.pop()

    for token in _TOKEN.finditer(source):
        text_of(source[at : token.start()])
        at = token.end()
        end, tag, attributes = token.group(2, 3, 4) if token[3] else token.group(5, 6, 7)
        if tag is None:
            continue
        tag = tag.lower()
        if end:
            if tag == "p" and not open_at.get("p") or tag == "br":
                close_block() if tag == "p" else pieces.append(" ")
                continue
            if not open_at.get(tag) or tag == "html":
                if tag not in _INLINE:
                    close_block()
                continue
            if tag not in _INLINE:
                close_block()
            elif open_at[tag][-1] < outer[-1]:
                continue  # an inline end tag does not end the blocks in between
            while elements[stack[-1]].tag != tag:
                pop()
            pop()
            continue
        if tag in _VOID:
            if tag == "br":
                pieces.append(" ")
            elif tag == "hr":
                close_block()
            continue
        if tag not in _INLINE:
            close_block()
            if tag in _ENDS_P and open_at.get("p"):  # a block ends an open paragraph, and what is inline in it
                while elements[stack[-1]].tag in _INLINE or elements[stack[-1]].tag == "p":
                    ended = elements[stack[-1]].tag == "p"
                    pop()
                    if ended:
                        break
            if tag in _ENDS:
                reach = None
                for place in reversed(outer):  # what a new part of a table or list ends, as far as the nearest one
                    t = elements[stack[place]].tag
                    if t in _ENDS[tag]:
                        reach = place
                    elif t in _SCOPES[tag] or t not in ("p", "tr", "tbody", "thead", "tfoot"):
                        break
                while reach is not None and len(stack) > reach:
                    pop()
        if tag == "a" and open_at.get("a"):
            while open_at.get("a") and elements[stack[-1]].tag in _INLINE:
                pop()
        stack.append(add(tag, attributes.strip(_SPACE)))
        open_at.setdefault(tag, []).append(len(stack) - 1)
        if tag not in _INLINE:
            outer.append(len(stack) - 1)
    text_of(source[at:])
    close_block()
    return page


def container(page: Page, keep: int = 0) -> tuple[int, float]:
    """The element that holds the page's article, and its share of the page's prose; -1 if the page has none.

    Prose is text outside links of elements that are not kept out.  The deepest
    element with ENOUGH of it is taken, then its ancestors as long as they add a
    heading or are an article of their own.
    """
    elements = page.elements
    own, heads = [0.0] * len(elements), [0] * len(elements)
    for b in page.blocks:
        if elements[b.element].out <= keep:
            own[b.element] += max(0, len(b.text) - 2 * b.links)
            heads[b.element] += b.heading
    whole, total_heads = own[:], heads[:]
    for i in range(len(elements) - 1, 0, -1):
        whole[elements[i].parent] += whole[i]
        total_heads[elements[i].parent] += total_heads[i]
    if not whole or whole[0] <= 0:
        return -1, 0.0
    best = 0
    for i in range(1, len(elements)):  # children come after their parents, so the last to hold enough is the deepest
        if elements[i].parent == best and whole[i] >= ENOUGH * whole[0] and elements[i].tag not in _PARTS:
            best = i
    while (up := elements[best].parent) >= 0 and elements[up].tag not in ("html", "body") and (total_heads[up] and not total_heads[best] or elements[up].tag == "article" or elements[best].tag in _INLINE):
        best = up
    return best, whole[best] / whole[0]


def text_in(page: Page, inside: set[int], keep: int = 0) -> str:
    """Blocks in page order of the given elements, without what is kept out below them, joined by one space."""
    elements = page.elements
    member = [False] * len(elements)
    for i, e in enumerate(elements):
        member[i] = i in inside or (e.parent >= 0 and member[e.parent])
    return " ".join(b.text for b in page.blocks if member[b.element] and elements[b.element].out <= keep)


def readable(page: Page, element: int) -> str:
    """The generalised path of an element, from the body on."""
    out: list[str] = []
    while element >= 0:
        if page.elements[element].tag not in ("html", "body"):
            out.append(page.elements[element].label)
        element = page.elements[element].parent
    return ">".join(reversed(out)) or "body"


def vote(source: str) -> tuple[int, float] | None:
    """A page's vote: the path of its best container, and the share of prose it holds; None if the page has no text."""
    page = parse(source)
    for keep in KEPT:
        best, share = container(page, keep)
        if best >= 0:
            return _signed(page.elements[best].path), share
    return None


def extract(source: str, winners: dict[int, float]) -> tuple[str, str | None]:
    """The text along the winning path that does best on this page, and that path.

    A path counts by its votes and the share of the page's prose it holds, ENOUGH
    being as good as all; of equals the page's own choice comes first, then the
    longer path.  A page that no winning path fits is extracted along its own.
    """
    page = parse(source)
    for keep in KEPT:
        best, _ = container(page, keep)
        if best < 0:
            continue
        places: dict[int, set[int]] = {}
        for i, e in enumerate(page.elements):
            if (path := _signed(e.path)) in winners and e.tag not in ("html", "body"):
                places.setdefault(path, set()).add(i)
        if (body := _signed(page.elements[0].path)) in winners:
            places[body] = {0}
        whole, mine = len(text_in(page, {0}, keep)), _signed(page.elements[best].path)
        marks = []
        for path, inside in places.items():
            share = len(text_in(page, inside, keep)) / whole
            marks.append((winners[path] * (1 if share >= ENOUGH else share), path == mine, max(inside), path))
        top = max(marks, default=(0,))
        inside = places[top[3]] if top[0] > 0 else {best}
        return text_in(page, inside, keep), readable(page, min(inside))
    return "", None


def _signed(path: int) -> int:
    return path - (1 << 64) if path >= 1 << 63 else path


#: The host in a URL, without user and port.
HOST = r"^\s*[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def winning_paths(pages: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """(host, n, winners): for each host its pages, and the paths with at least a tenth of its votes, so ten at most, with their shares.

    Every page votes for the path of its best container, by the share of its prose
    in it.  A page without host stands for itself: such pages win nothing.
    """

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [vote(x.as_py() or "") or (None, 0.0) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v[0] for v in found], pa.int64()), pa.array([v[1] for v in found], pa.float64())], ["host", "path", "share"])

    cast = pages.select(_host(url).alias("host"), F.col(source).alias("html")).mapInArrow(votes, "host string, path long, share double")
    by_path = cut(cast.groupBy("host", "path").agg(F.sum("share").alias("votes"), F.count(F.lit(1)).alias("pages")))
    hosts = cut(by_path.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("votes").alias("all"), F.sum("pages").alias("pages")))
    total = hosts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shares = join_counted(by_path.drop("pages"), hosts, "host", total).withColumn("votes", F.col("votes") / F.col("all"))
    won = shares.where((F.col("host") != "") & F.col("path").isNotNull() & (F.col("votes") >= WINNING)).groupBy("host").agg(F.collect_list(F.struct("path", "votes")).alias("winners"))
    return cut(hosts.select("host", F.col("pages").alias("n")).join(won, "host", "left"))


def _host(url: str) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(F.col(url)), HOST, 1), F.lit(""))


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """The main text of every page, along the paths that its host's pages agree on.

    Pages are read twice: first each votes for the generalised path (tags and
    classes from the body on, digits made alike) of the container with its prose,
    then each is extracted along its host's winning paths.  Null and empty pages
    give an empty text; very long ones are read whole, in one pass without
    recursion; repeated rows are extracted alike, each on its own; pages without
    a host follow their own best container; an empty table gives no rows; other
    columns are not read.

    Votes are counted before they are shuffled.  Winners go to the pages by
    broadcast if they are few; beyond, those of hosts with many pages still do (at
    most ten paths for each of fewer than a thousand hosts), and only pages of the
    other hosts are shuffled.

    Returns page_id, url, text, n_chars (code points) and main_path.
    """
    winners = winning_paths(pages, url, source)
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(source).alias("html"), _host(url).alias("host"))
    if byte_size(winners, F.octet_length("host") + 24 * F.coalesce(F.size("winners"), F.lit(0)) + 64) <= BROADCAST_BYTES:
        told = rows.join(F.broadcast(winners.drop("n")), "host")
    else:
        total = winners.agg(F.sum("n")).first()[0]
        told = join_counted(rows, winners, "host", total)
    schema = StructType([StructField("page_id", pages.schema[page_id].dataType), StructField("url", pages.schema[url].dataType), StructField("text", StringType()), *StructType.fromDDL("n_chars long, main_path string")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [extract(x.as_py() or "", {w["path"]: w["votes"] for w in own.as_py() or ()}) for x, own in zip(batch.column(2), batch.column(3))]
            columns = [pa.array([t for t, _ in found], pa.string()), pa.array([len(t) for t, _ in found], pa.int64()), pa.array([p for _, p in found], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], schema.names)

    return told.select("page_id", "url", "html", "winners").mapInArrow(run, schema)
