"""Main-text extraction by nearest-URL page differencing.

A page becomes a list of text lines (blocks), each marked by the markup around
it: article text, open text (a page without an article element), loose text
(inside an article but in no paragraph, heading, list, quote or cell) or
furniture (menus, headers, footers, sidebars, notices, adverts, forms, reader
comments), which always goes.  Pages are sorted by host and URL path and each is
aligned with its nearest neighbours before and after by the longest common
subsequence of lines; open and loose lines shared with a neighbour are deleted.
Paragraphs of an article stay even where a neighbour quotes them, since they are
the article; so on pages that mark their article and their furniture the markup
decides and differencing deletes nothing.  An article element with less than a
fifth of the page's open text is a teaser, and the open text stays.  A neighbour with exactly the same lines is a copy and tells
nothing; a page whose every open line is shared keeps them.

Pages are parsed before they are range-partitioned by (host, path, page_id), so
only the lines a text can hold and hashes of the others are shuffled, compressed
for each page, and a host with a third of
all pages spreads over many tasks; the pairs across two partitions are made in a
second step from each partition's first and last page.

Null html gives an empty text; pages without a URL form one host; ties of URL
are ordered by page_id; repeated rows keep a row each; broken and very long markup is read
once, from start to end; other columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, small_batches

# HTML element kinds and words of class, id and role attributes that mark page furniture.
RAW = {"script", "style", "title", "textarea", "noscript", "template", "svg", "iframe", "select", "button", "head", "object", "math"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
CONTAINER = {"article", "aside", "details", "dialog", "div", "dl", "fieldset", "figure", "footer", "form", "header", "hgroup", "main", "menu", "nav", "ol", "section", "span", "table", "ul"}
PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "td", "th", "dd", "dt", "figcaption", "caption", "summary"}
FURNITURE = {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset"}
WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "alert", "aside", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "consent", "contentinfo", "cookie", "cookies", "dialog", "disqus", "footer", "form", "gdpr", "login", "masthead", "menu", "menubar", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pager", "pagination", "popup", "promo", "promotion", "related", "replies", "reply", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "widget"}

# Words that qualify a furniture word in a compound name.
QUALIFIERS = {"area", "bar", "block", "bottom", "box", "container", "content", "fixed", "footer", "global", "header", "inner", "item", "items", "left", "link", "links", "list", "main", "page", "panel", "primary", "right", "secondary", "section", "site", "text", "title", "top", "wrap", "wrapper"}

ARTICLE, OPEN, LOOSE, DROP = range(4)
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
STOP = re.compile(r"""[>"']""")
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)


def _named_furniture(tag: str, attributes: str) -> bool:
    """Whether a class, id or role names furniture: a furniture word, alone or with qualifiers only; ids of headings and paragraphs name their topic."""
    if "=" not in attributes:
        return False
    for name, *found in ATTRIBUTE.findall(attributes):
        if name.lower() == "id" and (tag in PROSE or tag == "section"):
            continue
        for token in "".join(found).split():
            words = {w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", token).lower()) if w}
            if words & WORDS and words <= WORDS | QUALIFIERS:
                return True
    return False


def tags(page: str):
    """(text before, name, closing, attributes) of each tag, the rest of the text last with an empty name; reads the page once.

    A quote counts only after an equals sign; a quote or tag without an end is text.
    """
    at, start, no_quote, no_end = 0, 0, set(), set()
    last = page.rfind(">")
    while 0 <= (lt := page.find("<", at)) < last:
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            yield page[start:lt], "", False, ""
            at = start = len(page) if end < 0 else end + 3
            continue
        if page[lt + 1 : lt + 2] in ("!", "?"):
            yield page[start:lt], "", False, ""
            at = start = page.find(">", lt) + 1
            continue
        closing = page.startswith("/", lt + 1)
        name = NAME.match(page, lt + 1 + closing)
        if not name:
            at = lt + 1
            continue
        pos = name.end()
        while (stop := STOP.search(page, pos)) and stop[0] != ">":
            pos = stop.end()
            if stop[0] not in no_quote and page[name.end() : stop.start()][-20:].rstrip().endswith("="):
                quote = page.find(stop[0], pos)
                if quote < 0:
                    no_quote.add(stop[0])
                else:
                    pos = quote + 1
        end = stop.start() if stop else page.find(">", lt)
        tag, attributes = name[0].lower(), page[name.end() : end]
        at = end + 1
        if tag in RAW and not closing and not attributes.rstrip().endswith("/") and tag not in no_end:
            found = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            if found:
                at = found.end()
            else:
                no_end.add(tag)
                at = at if tag == "head" else len(page)
        yield page[start:lt], tag, closing, attributes
        start = at
    yield page[start:], "", False, ""


def lines_of(page: str) -> list[tuple[str, int]]:
    """(text, mark) of each non-empty block in page order."""
    out: list[tuple[str, int]] = []
    text: list[str] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # tag, furniture, in article, in a header
    prose, prose_drop, has_article, at = "", False, False, 0

    def flush():
        nonlocal prose, prose_drop
        if text:
            line = " ".join(html_lib.unescape("".join(text)).split())
            text.clear()
            if line:
                _, drop, article, header = stack[-1] if stack else ("", False, False, False)
                if drop or prose_drop or (header and not prose.startswith("h")):
                    mark = DROP
                elif article:
                    mark = ARTICLE if prose else LOOSE
                else:
                    mark = DROP if header else OPEN
                out.append((line, mark))
        prose, prose_drop = "", False

    for piece, tag, closing, attributes in tags(page):
        if piece:
            text.append(piece)
        if not tag:
            continue
        if closing:
            if tag in BLOCK:
                flush()
            if tag in CONTAINER:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        if tag == "span" and text:
                            break
                        del stack[k:]
                        break
            continue
        if tag in RAW:
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag not in BLOCK and not (tag == "span" and _named_furniture(tag, attributes)):
            continue
        flush()
        _, drop, article, header = stack[-1] if stack else ("", False, False, False)
        named = tag not in ("html", "body", "main") and _named_furniture(tag, attributes)
        if tag in CONTAINER:
            if tag in ("article", "main") and not drop and not named:
                article = has_article = True
            stack.append((tag, drop or named or tag in FURNITURE, article, header or tag == "header"))
        if tag in PROSE:
            prose, prose_drop = tag, named
    flush()
    inside = sum(len(t) for t, mark in out if mark == ARTICLE)
    outside = sum(len(t) for t, mark in out if mark == OPEN)
    teaser = has_article and outside > 4 * inside
    return [(t, DROP if mark == OPEN and has_article and not teaser else mark) for t, mark in out]


def shared_lines(own: list[int], other: list[int]) -> set[int]:
    """Positions in ``own`` on a longest common subsequence with ``other`` (bit-parallel rows, read back)."""
    where: dict[int, int] = {}
    for i, x in enumerate(own):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(own)) - 1
    row, rows = full, []
    for x in other:
        u = row & where.get(x, 0)
        row = ((row + u) | (row - u)) & full
        rows.append(row)
    out, i, j = set(), len(own) - 1, len(other) - 1
    while i >= 0 and j >= 0:
        if rows[j] >> i & 1:
            i -= 1
        elif j and not rows[j - 1] >> i & 1:
            j -= 1
        else:
            out.add(i)
            i, j = i - 1, j - 1
    return out


def _hashes(lines) -> list[int]:
    return [(zlib.crc32(t.encode()) << 31) ^ zlib.adler32(t.encode()) for t, _ in lines]


def _deleted(own, marks, others) -> set[int]:
    out = set()
    for other in others:
        if other is not None and other != own:
            out |= {i for i in shared_lines(own, other) if marks[i] in (OPEN, LOOSE)}
    return out


def _text(texts, marks, deleted) -> str:
    kept = [t for i, (t, mark) in enumerate(zip(texts, marks, strict=True)) if mark != DROP and i not in deleted]
    return " ".join(kept or [t for t, mark in zip(texts, marks, strict=True) if mark == OPEN])


def _pack(page: str | None) -> bytes:
    """The lines of a page, compressed: mark and text each; of furniture only the hash, which the alignment needs."""
    lines = lines_of(page or "")
    return zlib.compress("\n".join(f"{mark}{h if mark == DROP else t}" for (t, mark), h in zip(lines, _hashes(lines), strict=True)).encode())


def _unpack(packed: bytes) -> tuple[list[str], list[int], list[int]]:
    """texts (empty for furniture), marks and hashes of the lines."""
    lines = [(x[1:], int(x[0])) for x in zlib.decompress(packed).decode().split("\n") if x]
    hashes = [int(t) if mark == DROP else h for (t, mark), h in zip(lines, _hashes(lines), strict=True)]
    return ["" if mark == DROP else t for t, mark in lines], [mark for _, mark in lines], hashes


def _parse(batches):
    import pyarrow as pa

    for batch in batches:
        packed = pa.array([_pack(x) for x in batch.column("html").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "url", "host", "path")), packed], names=["page_id", "url", "host", "path", "packed"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    small_batches(pages.sparkSession)
    kind = pages.schema["page_id"].dataType.simpleString()
    keyed = pages.select(
        "page_id", "url", "html",
        F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit("")).alias("host"),
        F.coalesce(F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1), F.lit("")).alias("path"),
    )
    order = ["host", "path", "page_id"]
    parsed = keyed.mapInArrow(_parse, f"page_id {kind}, url string, host string, path string, packed binary")
    schema = f"page_id {kind}, url string, host string, path string, packed binary, text string, first boolean, last boolean, gone array<int>"

    def align(batches):
        import pyarrow as pa

        def rows():
            for batch in batches:
                for r in batch.to_pylist():
                    yield r, *_unpack(r["packed"])

        def made():
            source = rows()
            before, current, first = None, next(source, None), True
            while current is not None:
                following = next(source, None)
                r, texts, marks, own = current
                others = [x[3] for x in (before, following) if x is not None and x[0]["host"] == r["host"]]
                gone = _deleted(own, marks, others)
                if first or following is None:
                    yield {**r, "text": None, "first": first, "last": following is None, "gone": sorted(gone)}
                else:
                    yield {**r, "packed": None, "text": _text(texts, marks, gone), "first": False, "last": False, "gone": None}
                before, current, first = current, following, False

        id_type = {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())
        full = pa.schema([("page_id", id_type), ("url", pa.string()), ("host", pa.string()), ("path", pa.string()), ("packed", pa.binary()), ("text", pa.string()), ("first", pa.bool_()), ("last", pa.bool_()), ("gone", pa.list_(pa.int32()))])
        held = []
        for row in made():
            held.append(row)
            if len(held) >= 2000:
                yield pa.RecordBatch.from_pylist(held, full)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, full)

    ranged = parsed.repartitionByRange(*order).sortWithinPartitions(*order)
    done = materialise(ranged.mapInArrow(align, schema), "pages")
    edges = done.filter("packed is not null")
    by_host = Window.partitionBy("host").orderBy("path", "page_id", "first", "last")
    edges = edges.withColumn("before", F.when(F.col("first"), F.lag("packed").over(by_host))).withColumn("after", F.when(F.col("last"), F.lead("packed").over(by_host)))

    @F.pandas_udf("string")
    def finish(packed, gone, before, after):
        import pandas as pd

        out = []
        for p, g, b, a in zip(packed, gone, before, after, strict=True):
            texts, marks, own = _unpack(p)
            more = _deleted(own, marks, [None if x is None else _unpack(x)[2] for x in (b, a)])
            out.append(_text(texts, marks, more | {int(i) for i in g}))
        return pd.Series(out, dtype=object)

    fixed = edges.withColumn("text", finish("packed", "gone", "before", "after"))
    columns = ["page_id", "url", "text"]
    whole = done.filter("packed is null").select(*columns).unionByName(fixed.select(*columns))
    return whole.withColumn("n_chars", F.char_length("text").cast("long"))
