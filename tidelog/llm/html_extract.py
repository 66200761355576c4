"""HTML extraction by markup and nearest-URL page differencing.

Each page is cut into blocks of text. Markup settles what it can: scripts, styles, menus, headers, footers, sidebars,
forms, notices, adverts and comments are left out by element, role or class; blocks in an explicit main element
(article, main, role=main, articleBody) are the article, and of its own header the headings are. What markup leaves open (all other blocks of a page without a main
element) is settled by differencing: pages of one host are sorted by URL path, each is paired with the neighbour whose path
shares the longer prefix, the two pages' lines are aligned by longest common subsequence, and open lines that both have are
deleted as the site's own. Lines of a main element vote but aren't deleted: copies of an article on one host share
them all. Where over half of a page's open text is shared, the pair may be copies, or the site's text outweighs a short
article; then the neighbour on the other side (of a host's first and last page, the next but one) decides: of the shared lines, those
that it has too are the site's own. On a host of two pages all shared lines go. Where no line would be left, the page is a copy
of both and nothing is deleted.

The alignment is a true longest common subsequence, repeated lines included, over the lines that both pages have; it takes one
addition of a number as wide as one page for each line of the other, and bounded memory. All pages are cut into ranges of host and path, so that a large host is split
and order is kept; the two pages on either side of a cut are sent to both ranges, so a page meets its true neighbours wherever
the cuts are. A sample only places the cuts. There are at most about CELLS of them, and the driver has their keys. Pages are parsed
before the shuffle: only their text is shuffled.

Defined results: null html has the empty text; a null URL or one without :// has an empty host and its pages are paired
among themselves; rows that repeat a page_id are pages of their own; a page without neighbours keeps its open lines; an
empty table gives an empty result; columns besides page_id, url and html are ignored.
"""

from __future__ import annotations

import html as _html
import os.path
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict, deque

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.llm.common import table
from tidelog.llm.url_filter import host_of, path_of

#: A range has about so many pages, or one in CELLS of all pages if that is more.
CELL, CELLS = 64, 10_000
COPY = 0.5
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>|<[!?][^>]*+>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes"}
_SKIP = {"head", "nav", "header", "footer", "aside", "form", "button", "select", "option", "datalist", "svg", "math", "canvas", "object", "audio", "video", "dialog", "menu", "map"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = set("address article blockquote body center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html legend li main ol p pre section summary table tbody tfoot thead caption tr ul".split())
#: Elements whose end tag may be missing: the next of these ends them.
_IMPLIED = {"p": _BLOCK, "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "tbody", "tfoot"}, "option": {"option"}}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_MAIN = {"article", "main"}
_MAIN_ROLES = {"main", "article"}
_SKIP_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}
#: Words of a class or id that mark what isn't the article, wherever they stand.
_SKIP_WORDS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr newsletter subscribe subscription popup "
    "modal sidebar nav navbar navigation breadcrumb breadcrumbs footer comments disqus pagination".split()
)
#: Words that do so only in a name of which all other words are such, or these general ones: search-box, but not search-engines.
_WEAK_WORDS = set(
    "promo promotion banner notice alert overlay side widget menu header masthead topbar toolbar comment respond replies share sharing social related "
    "recommended recommendations pager login signin signup search form skip".split()
)
_GENERAL = set(
    "area article articles bar block body bottom box button buttons col column container content fixed global group icon icons inner item items label "
    "left link links list main msg outer page panel post posts primary right row secondary section site slot small sticky title to top wrap wrapper".split()
)
_KEEP_WORDS = {"articlebody"}
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): _html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)}


def _named(names: str) -> bool:
    """Whether one of the names of a class or id marks what isn't the article."""
    for name in names.split():
        words = {w.lower() for w in _WORD.findall(name) if not w.isdigit()}
        if words & _SKIP_WORDS or words & _WEAK_WORDS and words <= _WEAK_WORDS | _GENERAL:
            return True
    return False


def _kind(name: str, attributes: str, within: bool) -> str:
    """main, skip, or nothing, by element, role, hidden state, class and id. A main element that isn't within another is the
    article whatever its names are."""
    if not attributes.strip():
        return "main" if name in _MAIN else "skip" if name in _SKIP else ""
    a = _attributes(attributes)
    role, style = a.get("role", "").lower(), a.get("style", "").replace(" ", "")
    hidden = a.get("aria-hidden") == "true" or re.search(r"(?:^|\s)hidden(?:\s|$)", attributes) or "display:none" in style
    marked = name in _SKIP or role in _SKIP_ROLES or not (name in _MAIN and not within) and _named(f"{a.get('class', '')} {a.get('id', '')}")
    if name not in ("body", "html") and (hidden or marked):
        return "skip"
    return "main" if name in _MAIN or role in _MAIN_ROLES or a.get("itemprop", "").lower() in _KEEP_WORDS else ""


def blocks(page: str) -> list[tuple[str, bool]]:
    """A page's blocks of text in order, without what markup excludes, and whether each is in a main element."""
    out: list[tuple[str, bool]] = []
    held: list[str] = []
    skip, depth, main = "", 0, 0
    quiet, heading = 0, 0  # headers of the article that are open, and headings within them: only these are kept
    opened: list[tuple[str, bool]] = []  # main elements, and others of their names, that are open
    at, end = 0, len(page)

    def flush():
        if held:
            text = " ".join(_html.unescape("".join(held)).split())
            held.clear()
            if text and (not quiet or heading):
                out.append((text, main > 0))

    while at < end:
        m = _TOKEN.search(page, at)
        if not m:
            if not skip:
                held.append(page[at:])
            break
        if not skip and m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            if not skip and m[0].startswith("<![CDATA["):
                held.append(_html.escape(m[0][9:].removesuffix("]]>")))
            continue
        name, closing = m[2].lower(), bool(m[1])
        if not closing and name in _RAW:
            found = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = found.end() if found else end
            continue
        if skip:
            if skip == name and not (not closing and name in _IMPLIED):
                depth += -1 if closing else 0 if m[3].endswith("/") else 1
                if depth <= 0:
                    skip = ""
                continue
            ended = skip in _IMPLIED and (not closing and name in _IMPLIED[skip] or closing and name in ("ul", "ol", "dl", "table", "div", "section", "article", "main", "body"))
            if not ended and not (closing and (name == "body" or name in _MAIN and any(x[0] == name for x in opened)) or not closing and (name in ("body", "main") or name == "article" and not main)):
                continue
            skip = ""
        if name in _BLOCK:
            flush()
        elif name in ("br", "td", "th"):
            held.append(" ")
        if quiet and name in _HEADINGS:
            heading += -1 if closing and heading else 0 if closing else 1
        if quiet and name == "header":
            quiet, heading = quiet + (-1 if closing else 1), 0
            continue
        if closing:
            if any(x[0] == name for x in opened):
                while opened:
                    last, was_main = opened.pop()
                    main -= was_main
                    quiet = quiet if main else 0
                    if last == name:
                        break
            continue
        kind = _kind(name, m[3], main > 0)
        if name in _VOID or m[3].endswith("/") and name not in _BLOCK:
            continue
        if kind == "skip" and name == "header" and main:
            flush()
            quiet, heading = 1, 0
        elif kind == "skip":
            flush()
            skip, depth = name, 1
        elif kind == "main" or any(x[0] == name for x in opened):
            opened.append((name, kind == "main"))
            main += kind == "main"
    flush()
    return out


#: Bytes of states that an alignment keeps; beyond it, only some are kept and those between are made again.
_STATES = 64 << 20


def _aligned(a: list, b: list, states: int) -> list[tuple[int, int]]:
    """Pairs of places of a longest common subsequence, by bit vectors as wide as b: one addition for each line of a."""
    width, places = len(b), {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << width) - 1

    def step(state, x):
        hit = state & places.get(x, 0)
        return (state + hit | state - hit) & full

    every = max(1, -(-len(a) * (width // 8 + 32) // max(1, states)))
    every = max(every, int(len(a) ** 0.5)) if every > 1 else 1
    kept, state = [full], full
    for i, x in enumerate(a, 1):
        state = step(state, x)
        if i % every == 0:
            kept.append(state)
    out, i, j, block, base = [], len(a), width, [], -1

    def at(row):
        """The state after `row` lines: a clear bit is a place of b where the subsequence grows."""
        nonlocal block, base
        if row // every != base:
            base = row // every
            block = [kept[base]]
            for x in a[base * every : min(len(a), base * every + every - 1)]:
                block.append(step(block[-1], x))
        return block[row - base * every]

    while i and j:
        if at(i) >> j - 1 & 1:
            j -= 1
            continue
        i -= 1
        if i and not at(i) >> j - 1 & 1:
            continue
        j -= 1
        out.append((i, j))
    return out


def shared_lines(a: list[str], b: list[str], states: int = _STATES) -> set[int]:
    """Places in a of a longest common subsequence with b. Lines that the other page hasn't take no part."""
    both = set(a) & set(b)
    left = [i for i, x in enumerate(a) if x in both]
    right = [x for x in b if x in both]
    own, start = [a[i] for i in left], 0
    while start < min(len(own), len(right)) and own[start] == right[start]:
        start += 1
    end = 0
    while end < min(len(own), len(right)) - start and own[-1 - end] == right[-1 - end]:
        end += 1
    middle = _aligned(own[start : len(own) - end], right[start : len(right) - end], states)
    return {left[k] for k in [*range(start), *(start + i for i, _ in middle), *range(len(own) - end, len(own))]}


def settled(lines: list[str], is_main: list[bool], other: list[str] | None, copy: float = COPY, further: list[str] | None = None) -> str:
    """A page's text, given its blocks, its neighbour's, and those of a further neighbour."""
    if any(is_main):
        return "\n".join(x for x, m in zip(lines, is_main, strict=True) if m)
    if other:
        shared = shared_lines(lines, other)
        if further and sum(len(lines[i]) for i in shared) > copy * sum(map(len, lines)):
            shared &= shared_lines(lines, further)
        if len(shared) < len(lines):
            lines = [x for i, x in enumerate(lines) if i not in shared]
    return "\n".join(lines)


def _key(row) -> tuple:
    """The order of pages: as Spark sorts _KEYS, with nulls first."""
    host, path, page_id, url, tag = row
    return host, path, page_id is not None, page_id or 0, url or "", tag


_KEYS = ["host", "path", "page_id", "url", "tag"]


def _ranges(cuts):
    """Keys with their range."""

    def run(batches):
        for batch in batches:
            keys = zip(*(batch.column(n).to_pylist() for n in _KEYS), strict=True)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in _KEYS), pa.array([bisect_right(cuts.value, _key(k)) for k in keys], pa.int64())], names=[*_KEYS, "cell"])

    return run


def _parsed(cuts, also):
    """Pages with lines, in their range and, as own = false, in those of which they are neighbours."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [blocks(x) if x else [] for x in part.column("html").to_pylist()]
                keys = [_key(k) for k in zip(*(part.column(n).to_pylist() for n in _KEYS), strict=True)]
                places = [(i, cell, n == 0) for i, k in enumerate(keys) for n, cell in enumerate((bisect_right(cuts.value, k), *also.value.get(k, ())))]
                rows = pa.RecordBatch.from_arrays(
                    [*(part.column(n) for n in _KEYS), pa.array([[x for x, _ in f] for f in found], pa.list_(pa.string())), pa.array([[m for _, m in f] for f in found], pa.list_(pa.bool_()))],
                    names=[*_KEYS, "lines", "is_main"],
                ).take(pa.array([i for i, _, _ in places], pa.int64()))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([c for _, c, _ in places], pa.int64()), pa.array([o for _, _, o in places], pa.bool_())], names=[*_KEYS, "lines", "is_main", "cell", "own"])

    return run


def _paired(copy: float):
    def row(page, around):
        """around: the two pages before and the two after it, None where the host has none."""
        common = lambda x: len(os.path.commonprefix([x["path"], page["path"]])) if x else -1
        second, before, after, next_but_one = around
        # The neighbour with the longer common prefix of the path, the one before in a tie.
        other, further = (before, after or second) if common(before) >= common(after) else (after, before or next_but_one)
        text = settled(page["lines"], page["is_main"], other and other["lines"], copy, further and further["lines"])
        return page["page_id"], page["url"], text, len(text)

    def pages(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                yield from batch.slice(at, 256).to_pylist()
        yield from (None, None)

    def run(batches):
        rows, size, held = [], 0, deque([None] * 5, 5)

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string(), pa.int64()))], names=["page_id", "url", "text", "n_chars"])

        for x in pages(batches):
            held.append(x)
            page = held[2]
            if page is not None and page["own"]:
                same = [x if x is not None and (x["cell"], x["host"]) == (page["cell"], page["host"]) else None for x in held]
                rows.append(row(page, (*same[:2], *same[3:])))
                size += rows[-1][3]
                if size > 4 << 20:
                    yield batch_of(rows)
                    rows, size = [], 0
        yield batch_of(rows)

    return run


def _neighbours(keys: DataFrame, cuts) -> dict[tuple, list[int]]:
    """Keys of the two pages on either side of each cut -> the ranges that they are neighbours of, besides their own."""
    order = [F.col("host"), F.col("path"), F.col("page_id"), F.coalesce("url", F.lit("")), F.col("tag")]
    dealt = keys.mapInArrow(_ranges(cuts), "host string, path string, page_id long, url string, tag long, cell long")
    numbered = dealt.withColumns({"first": F.row_number().over(Window.partitionBy("cell").orderBy(*order)), "n": F.count(F.lit(1)).over(Window.partitionBy("cell"))})
    edges = sorted((_key(r[:5]), r["cell"]) for r in numbered.filter("first <= 2 OR first > n - 2").collect())
    at = [k for k, _ in edges]
    out = defaultdict(set)
    for i, cut in enumerate(cuts.value):
        j = bisect_left(at, cut)  # range i ends before the cut, range i + 1 starts with it
        for k, cell in edges[max(0, j - 2) : j]:
            out[k] |= {i + 1} - {cell}
        for k, cell in edges[j : j + 2]:
            out[k] |= {i} - {cell}
    return {k: sorted(v) for k, v in out.items() if v}


def extract(pages: DataFrame, cell: int = CELL, copy: float = COPY, html: str = "html", url: str = "url", page_id: str = "page_id") -> DataFrame:
    """Per row of pages: page_id, url, text, n_chars."""
    spark = pages.sparkSession
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.col(html).cast("string").alias("html"), F.xxhash64(html).alias("tag"))
    keys, total = rows.select(*_KEYS), pages.count()
    n = max(1, min(CELLS, total // max(1, cell)))
    found = sorted({_key(r) for r in (keys.sample(min(1.0, 16 * n / total), 1) if 16 * n < total else keys).collect()}) if n > 1 else []
    cuts = spark.sparkContext.broadcast(sorted({found[len(found) * i // n] for i in range(1, n)}) if found else [])
    also = spark.sparkContext.broadcast(_neighbours(keys, cuts) if cuts.value else {})
    lines = rows.select(*_KEYS, "html").mapInArrow(_parsed(cuts, also), "host string, path string, page_id long, url string, tag long, lines array<string>, is_main array<boolean>, cell long, own boolean")
    return lines.repartition("cell").sortWithinPartitions("cell", "host", "path", "page_id", F.coalesce("url", F.lit("")), "tag").mapInArrow(_paired(copy), "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
