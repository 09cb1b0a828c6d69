"""Main text of web pages by nearest-URL page differencing.

Pages of a host are put in the order of their URL paths and each is paired with the neighbour whose path has more leading
segments in common. The text lines of both are aligned by their longest common subsequence, and the lines they share, the
template's, are deleted. Markup that says what it holds goes first: a line inside a menu, footer, advert, form, comment list or
the like never stays and is not compared, one inside <article> or <main> is compared but never deleted; differencing decides on
the rest of every page.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prognos.llm.common import prepare, slices, stored
from prognos.llm.urlfilter import host_and_path

LOOSE, CONTENT, CHROME = 0, 1, 2
#: Inside blocks(): chrome by a class or id word only, which an <article> or <main> in it overrules.
NAMED = 3
#: HTML's elements by what they mean for text blocks, and words in class or id names of template parts.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "ruby", "rt", "rp", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
RAW = {"script", "style", "noscript", "template", "svg", "iframe", "textarea", "object", "canvas", "math", "audio", "video", "select", "button", "title"}
UNNESTED = {"p", "li", "dt", "dd", "tr", "td", "th", "option", "thead", "tbody", "tfoot"}
TEXT_TAGS = UNNESTED | INLINE | {"h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "figcaption"}
CHROME_TAGS = {"nav", "footer", "aside", "form", "dialog", "menu", "header", "head"}
CHROME_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pager", "pagination", "popup", "promo", "related", "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"}
#: Of these words, those whose elements hold readers' comments, which may be <article>s themselves; and words before a part that a name says the page has or lacks.
COMMENT_WORDS = {"comment", "comments", "disqus", "replies", "reply", "respond"}
#: Of these words, those that also stand in names of ordinary text (ad-hoc, share price), and parts of names that make them a template's.
AMBIGUOUS = {"ad", "notice", "notices", "promo", "related", "reply", "search", "share", "skip", "social"}
HOLDERS = {"area", "banner", "bar", "block", "box", "button", "buttons", "container", "form", "frame", "inner", "item", "items", "label", "link", "links", "list", "outer", "panel", "section", "slot", "space", "unit", "widget", "wrap", "wrapper"}
MODIFIERS = {"no", "not", "non", "has", "have", "with", "without", "hide", "show"}
CHROME_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form", "menu", "menubar"}

_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_PLAIN = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)>")
_NAMED = re.compile(r"\b(class|id|role|style|aria-hidden|hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)


def _named(names: str) -> tuple[set[str], bool]:
    """(template words in class or id names, whether every name holds one).

    What follows a modifier in a name (no-sidebar, has-nav) is a property of the page; an ambiguous word counts at the end of a
    name or before the word for a holder (ad-slot, but not ad-hoc). Capital letters inside a name begin a word.
    """
    out, every = set(), True
    for name in names.split():
        parts = [w for w in re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "-", name).lower()) if w]
        hit = False
        for i, word in enumerate(parts):
            if word in MODIFIERS:
                break
            if word in CHROME_WORDS and (word not in AMBIGUOUS or i == len(parts) - 1 or parts[i + 1] in HOLDERS or parts[i + 1].isdigit()):
                out.add(word)
                hit = True
        every &= hit
    return out, every


def _chrome(tag: str, attributes: str, inside: bool) -> int:
    """CHROME, NAMED or, for what is no template part, LOOSE; inside: in the main content."""
    if tag in CHROME_TAGS and not (tag == "header" and inside):
        return CHROME
    if tag in {"article", "main", "body", "html"} or not attributes or "=" not in attributes and "hidden" not in attributes:
        return LOOSE
    found = LOOSE
    for name, value in _NAMED.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            hit, every = _named(value)
            if hit & COMMENT_WORDS - AMBIGUOUS or hit & COMMENT_WORDS and every:
                return CHROME
            # a paragraph of the content that has an ambiguous word among other names stays
            if hit - AMBIGUOUS or hit and (every or not (inside and tag in TEXT_TAGS)):
                found = NAMED
        value = value.lower()
        if name == "role" and value in CHROME_ROLES or name == "style" and re.search(r"display\s*:\s*none", value) or name == "hidden" or name == "aria-hidden" and value == "true":
            return CHROME
    return found


def blocks(page: str) -> list[tuple[str, int]]:
    """(text, LOOSE, CONTENT or CHROME) of every non-empty text block of a page, in page order; bad markup is read as far as it goes."""
    out: list[tuple[str, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = []
    zone, flagged, quoted = LOOSE, False, True
    endless: set[str] = set()  # RAW elements of which no further end tag comes

    def flush() -> None:
        nonlocal flagged
        if parts:
            if text := " ".join("".join(parts).split()):
                out.append((text, CHROME if flagged or zone == NAMED else zone))
            parts.clear()
        flagged = False

    at, end = 0, len(page)
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            lt = end
        if lt > at:
            parts.append(markup.unescape(page[at:lt]))
        if lt == end:
            break
        if page.startswith("<!--", lt):
            close = page.find("-->", lt + 4)
            at = end if close < 0 else close + 3
            continue
        if page[lt + 1 : lt + 2] in ("!", "?"):
            close = page.find(">", lt)
            at = end if close < 0 else close + 1
            continue
        m = _TAG.match(page, lt) if quoted else _PLAIN.match(page, lt)
        if m is None and quoted and page[lt + 1 : lt + 2].strip("/").isalpha():
            quoted = False  # a quote that never closes; from here on it is no quote
            m = _PLAIN.match(page, lt)
        if m is None:
            parts.append("<")
            at = lt + 1
            continue
        at, closing, tag, attributes = m.end(), m[1], m[2].lower(), m[3]
        if tag in RAW and not closing:
            if not attributes.endswith("/") and tag not in endless:
                close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                if close is not None:
                    at = close.end()
                elif tag in ("script", "style"):
                    at = end
                else:
                    endless.add(tag)  # only the start tag is skipped
            parts.append(" ")
            continue
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            if not (not closing and tag != "br" and attributes and _chrome(tag, attributes, zone == CONTENT) or closing and any(t == tag for t, _ in stack[-8:])):
                continue
        flush()
        if tag in VOID:
            continue
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    zone = stack[i][1]
                    del stack[i:]
                    break
        elif not attributes.endswith("/"):
            chrome = LOOSE if zone == CHROME else _chrome(tag, attributes, zone == CONTENT)
            if tag in UNNESTED:
                flagged = chrome != LOOSE
            elif tag == "body":
                stack.clear()
                zone = LOOSE
            else:
                stack.append((tag, zone))
                if chrome:
                    zone = chrome
                elif tag in ("article", "main") and zone != CHROME:
                    zone = CONTENT
    flush()
    return out


def common_lines(a: list[int], b: list[int]) -> set[int]:
    """Positions in a of a longest common subsequence with b (bit-parallel: a row of bits for each line of b)."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v, rows = full, [full]
    for x in b:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    found, i, j = set(), len(a) - 1, len(b)
    while i >= 0 and j > 0:
        if rows[j] >> i & 1:
            i -= 1  # the length does not grow at this line of a
        elif not rows[j - 1] >> i & 1:
            j -= 1
        else:
            found.add(i)
            i, j = i - 1, j - 1
    return found


def _line(text: str) -> int:
    """63 bits of a line, for comparing."""
    raw = text.encode()
    return (crc32(raw) & 0x7FFFFFFF) << 32 | crc32(raw[::-1])


def neighbours(pages: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, near): the page next to each one in its host by path, of the two the one with more leading segments in common.

    The order is dealt out by ranges, so that a large host is many tasks' work; a range's first page finds its
    predecessor among the ends of the other ranges, of which there is one row each. At a tie the page before it is taken.
    """
    host, path = host_and_path(F.col(url))
    at = F.struct("host", "path", F.col(key).alias("id"))
    slim = pages.where(F.col(key).isNotNull()).select(F.col(key).alias(key), host.alias("host"), path.alias("path")).dropDuplicates([key]).withColumn("at", at)
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(slim.repartitionByRange(n, "at").withColumn("part", F.spark_partition_id()), "url-order")
    ends = dealt.groupBy("part").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    order = Window.orderBy("part")  # one row for each range
    ends = ends.select("part", F.lag("hi").over(order).alias("before"), F.lead("lo").over(order).alias("after"))
    inside = Window.partitionBy("part").orderBy("at")
    near = dealt.select("part", "at", key, F.lag("at").over(inside).alias("p"), F.lead("at").over(inside).alias("q")).join(F.broadcast(ends), "part", "left")
    p, q = (F.when(x.getField("host") == F.col("at.host"), x) for x in (F.coalesce("p", "before"), F.coalesce("q", "after")))

    def leading(x: Column) -> Column:
        """Leading segments in common; a path's end counts as a segment."""
        alike = F.zip_with(F.split("at.path", "/"), F.split(x.getField("path"), "/"), lambda a, b: F.coalesce(a == b, F.lit(False)))
        differs = F.array_position(alike, F.lit(False))
        return F.coalesce(F.when(differs == 0, F.lit(1 << 30)).otherwise(differs), F.lit(-1))

    return near.select(key, F.when(leading(q) > leading(p), q.getField("id")).otherwise(p.getField("id")).alias("near")).where("near is not null")


def _keep(mine: list[tuple[str, int]], theirs: list[int], markup: bool = True) -> list[str]:
    """The lines of a page that stay: of those that the markup leaves open, the ones that its neighbour doesn't share."""
    if markup:
        mine = [(t, zone) for t, zone in mine if zone != CHROME]
    gone = common_lines([_line(t) for t, _ in mine], theirs) if theirs else set()
    return [t for i, (t, zone) in enumerate(mine) if markup and zone == CONTENT or i not in gone]


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", use_markup: bool = True) -> DataFrame:
    """(key, url, text, n_chars): the main text of every page, its blocks joined by an empty line.

    Null or empty pages give an empty text and 0. A page that is alone on its host, or whose key is null, keeps all lines
    that its markup does not rule out. Pages without a host are paired with one another. Repeated rows are each answered;
    for pairing, a key counts once. Keys of any type come back as they are. Without `use_markup` differencing alone decides, on all lines.
    """
    prepare(pages.sparkSession)
    rows = pages.select(F.col(key).alias(key), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    kind = rows.schema[key].dataType.simpleString()

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                own = [[_line(t) for t, z in blocks(h) if z != CHROME or not use_markup] for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(own, pa.list_(pa.int64()))], ["other", "lines"])

    hashes = rows.select(key, "html").mapInArrow(lines, f"other {kind}, lines array<bigint>").where("size(lines) > 0").dropDuplicates(["other"])
    near = neighbours(pages, key, url)
    beside = near.hint("merge").join(hashes.hint("merge"), near.near == hashes.other).select(F.col(key).alias("_key"), "lines")
    paired = rows.hint("merge").join(beside.hint("merge"), F.col(key) == F.col("_key"), "left").select(F.col(key).alias("k"), "url", "html", "lines")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                text = ["\n\n".join(_keep(blocks(h), n or [], use_markup)) for h, n in zip(part.column("html").to_pylist(), part.column("lines").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("k"), part.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["k", "url", "text", "n_chars"])

    return paired.mapInArrow(texts, f"k {kind}, url string, text string, n_chars bigint").withColumnRenamed("k", key)
