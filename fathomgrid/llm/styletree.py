"""Main text of web pages by a site style tree.

The block elements of all pages of a host are merged by their style: the chain of
tags and class names above them.  For each style node, over the m different pages
that have it,

- content importance of a text is 1 - log(k) / log(m), k of the m pages having that
  text there: the entropy of the feature's spread over the pages, 0 when all have it;
  a node's is the mean over its texts;
- presentation importance is the entropy, to base m, of how often the node occurs
  in a page.

A node's importance mixes both (``MIX``), and blocks of nodes, or with texts, of low
importance are removed, whatever they are called.  Pages are different if the longest
blocks of their own are, so that copies of one article don't make it look like
boilerplate.  A block outside noise is a page's own if, but for digits, it is in fewer
than ``LEAST`` of the host's sets of such blocks; where a page has none, its longest block
counts.  What the tree can't tell, priors do: with fewer than ``LEAST`` pages entropies say
nothing, and menus of random entries or readers' comments look as important as text.
Elements and class names of menus, headers, footers, sidebars, notices, adverts, forms and
comments are noise, ``article`` and ``main`` hold the text if there are any, and elsewhere
blocks that are mostly links are menus.  ``n_tree`` and ``n_priors`` count the blocks that
the tree removes and those that only a prior does; the priors can be turned off.

Character references are decoded; white space in a block becomes one space; blocks
are joined by two newlines.  Null and empty pages have empty text; a null url is a
host of its own.  Markup may be cut off or unclosed anywhere;
the time to parse a page is in proportion to its length.  Rows are answered one
by one, repeated ones alike.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomgrid.llm.base import settled, stored
from fathomgrid.llm.textkernel import released

LEAST, MIX, LOW_NODE, LOW_NODE_INSIDE, LOW_TEXT, SALTS = 5, 0.1, 0.35, 0.15, 0.25, 32

START = re.compile(r"<(?=[a-zA-Z/!?])")
NAME = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*)")
#: A tag without angle brackets in its values, which is nearly every one.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/<>]*)([^<>"']*(?:"[^"<>]*"[^<>"']*|'[^'<>]*'[^<>"']*)*)>""")
BOGUS = re.compile(r"<[!?/][^<>]*>")
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
CUT_OFF = re.compile(r"<[a-zA-Z/!?][^<>]*\Z")
RAW = {"script", "style", "title", "textarea", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
NOISE = set("nav footer aside form button select menu dialog noscript template svg math iframe object canvas video audio head search".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"ul", "ol", "dl", "table", "select", "menu"}
#: Parts of class names, ids and roles that mark noise.
NOISE_NAMES = set(
    "ad ads adv advert advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies disqus dropdown "
    "feedback footer footnav gdpr header login masthead menu menubar modal nav navbar navigation navigationbar newsletter notice notification pager pagination paging paywall popup popular "
    "promo promoted promotion recommended related reply respond search share sharing shares sidebar sidenav signup skip social sponsor sponsored subscribe tags teaser toolbar topbar trending widget widgets".split()
)
LAYOUT = set("has with no without layout wrapper container page".split())
MAIN_NAMES = set("articlebody main".split())


def attributes(text: str) -> tuple[str, set[str], bool]:
    """(style name, parts of the names, hidden) from the attributes of a tag."""
    names, hidden = [], False
    for key, value in ATTRIBUTE.findall(text):
        value = value.strip("\"'").lower()
        if key.lower() in ("hidden", "aria-hidden"):
            hidden |= key.lower() == "hidden" or value == "true"
        elif value:
            names.append(value)
    name = " ".join(names)
    return re.sub(r"\d+", "#", name), set(re.split(r"[^a-z]+", name)), hidden


class Markup:
    """The tags of a page, each found once."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.marks: list[int] | None = None  # places of > and quotes
        self.dead: set[int] = set()  # quotes that open no value before a tag's end
        self.last = {q: page.rfind(q) for q in ">\"'"}

    def end_of(self, at: int) -> int:
        """The > that ends the tag whose attributes start at ``at``, quoted ones passed over; else the next one, or -1."""
        page, opened = self.page, []
        if self.last[">"] < at:
            return -1
        if self.marks is None:
            self.marks = [m.start() for m in re.finditer("[>\"']", page)]
        i = bisect_left(self.marks, at)
        while i < len(self.marks):
            mark = self.marks[i]
            if page[mark] == ">":
                return mark
            opened.append(mark)
            if mark in self.dead or self.last[page[mark]] == mark:
                break
            i = bisect_left(self.marks, page.index(page[mark], mark + 1)) + 1
        self.dead.update(opened)
        return page.find(">", at)

    def __iter__(self) -> Iterator[tuple[str, str, bool, str]]:
        """(text before, tag, closing, attributes); without a tag at the end and at comments.  Raw content is passed over."""
        page, at, begin = self.page, 0, 0
        while m := START.search(page, at):
            start = m.start()
            if page.startswith("<!--", start):
                stop = page.find("-->", start + 4)
                yield page[begin:start], "", False, ""
                at = begin = stop + 3 if stop >= 0 else len(page)
                continue
            if t := TAG.match(page, start):
                end, attrs = t.end(), t[3]
            elif (t := NAME.match(page, start)) and (stop := self.end_of(t.end())) >= 0:
                end, attrs = stop + 1, page[t.end() : stop]
            elif not t and (bogus := BOGUS.match(page, start)):
                yield page[begin:start], "", False, ""
                at = begin = bogus.end()
                continue
            else:  # no tag but text
                at = start + 1
                continue
            tag = t[2].lower()
            yield page[begin:start], tag, bool(t[1]), attrs
            at = begin = end
            if tag in RAW and not t[1]:
                stop = re.compile(rf"</{re.escape(tag)}\b", re.I).search(page, at)
                at = begin = stop.start() if stop else len(page)
        yield page[begin:], "", False, ""


def blocks(page: str, paths: dict) -> list[tuple[int, str, bool, bool, float]]:
    """(style, text, noise, inside, share of links) of each block with text, in page order."""
    out: list[tuple[int, str, bool, bool, float]] = []
    # Open elements: (tag, style, noise, inside, noise by name only, style of the block).
    stack: list[tuple[str, int, bool, bool, bool, int]] = [("", 0, False, False, False, 0)]
    count: dict[str, int] = {}
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                _, style, noise, inside, _, block = stack[-1]
                out.append((block or style, text, noise, inside, min(1.0, linked / len(text))))
            parts.clear()
        linked = 0

    def close(tag: str) -> None:
        i = len(stack) - 1
        while stack[i][0] != tag:
            i -= 1
        for x in stack[i:]:
            count[x[0]] -= 1
        del stack[i:]

    for text, tag, closing, attrs in Markup(CUT_OFF.sub("", page)):
        if text:
            if not stack[-1][2] or text.strip():
                parts.append(text)
            if count.get("a"):
                linked += len(text)
        if not tag:
            continue
        if closing:
            if tag in BLOCK or tag in NOISE:
                flush()
            if count.get(tag):
                close(tag)
            continue
        if tag in RAW:
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCK or tag in NOISE:
            flush()
            if count.get("p") and tag in BLOCK:
                close("p")
            for i in range(len(stack) - 1, 0, -1) if tag in CLOSES else ():
                if stack[i][0] in CLOSES[tag]:
                    close(stack[i][0])
                    break
                if stack[i][0] in SCOPE:
                    break
        name, names, hidden = attributes(attrs) if "=" in attrs or "hidden" in attrs else ("", set(), False)
        if tag in VOID or not (tag in BLOCK or tag in NOISE or name or tag == "a") or attrs.endswith("/"):
            continue
        _, style, noise, inside, named, block = stack[-1]
        main = tag in ("article", "main") or bool(names & MAIN_NAMES)
        bad = bool(names & NOISE_NAMES) and not names & LAYOUT and tag not in ("html", "body", "article", "main") or hidden
        if main and named and not any(x[2] and not x[4] for x in stack):
            noise = named = False  # a class name above was not about the text
        if inside and tag == "header":
            bad = False
        hard = tag in NOISE or (tag == "header" and not inside)
        key = (style, tag, name)
        if key not in paths:
            paths[key] = xxhash.xxh3_64_intdigest(f"{style}/{tag}.{name}") >> 1
        block = paths[key] if tag in BLOCK else block
        stack.append((tag, paths[key], noise or hard or bad, inside or (main and not (noise or hard or bad)), not hard and (named or (bad and not noise)), block))
        count[tag] = count.get(tag, 0) + 1
    flush()
    return out


def host_of(url: str | None) -> int:
    """A hash of the host of a url; null and odd urls share one."""
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", url or "")
    return xxhash.xxh3_64_intdigest(m[1].lower() if m else "") >> 1


def each_page(batches: Iterator[pa.RecordBatch], priors: bool = True) -> Iterator[tuple[pa.RecordBatch, list[int], list[list[tuple[int, int, str, bool, bool, bool]]]]]:
    """(slice, hosts, blocks) of some pages at a time; a block is (style, hash, text, noise, inside, use): ``use`` is what the priors keep."""
    paths: dict = {}
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            b = batch.slice(at, 64)
            pages = []
            if len(paths) > 200_000:
                paths.clear()
            for page in b.column("html").to_pylist():
                found = blocks(page or "", paths)
                main = any(i and not n for _, _, n, i, _ in found)
                rows = [(s, xxhash.xxh3_64_intdigest(t) >> 1, t, n, i, not n and (i if main else k <= 0.5)) for s, t, n, i, k in found]
                pages.append(rows if priors else [(s, h, t, False, False, True) for s, h, t, *_ in rows])
            yield b, [host_of(u) for u in b.column("url").to_pylist()], pages
    released()


def styled(priors: bool):  # noqa: ANN201
    """A mapInArrow function: pages to one row for each block, without its text.

    ``page`` is a hash of the set of blocks outside noise, ``letters`` one of the text
    but for digits, ``size`` the text's length, 0 in noise; ``pk`` is the page's own.
    """
    names = ["pk", "host", "page", "style", "h", "letters", "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, hosts, pages in each_page(batches, priors):
            rows = []
            for pk, host, page in zip(b.column("pk").to_pylist(), hosts, pages, strict=True):
                own = sorted({x[1] for x in page if not x[3]})
                key = xxhash.xxh3_64_intdigest(",".join(map(str, own))) >> 1
                rows += [(pk, host, key, x[0], x[1], xxhash.xxh3_64_intdigest(re.sub(r"\d+", "#", x[2])) >> 1, 0 if x[3] else len(x[2])) for x in page]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    return run


def printed(each: DataFrame) -> DataFrame:
    """(host, print, style, h, n): blocks with what identifies their page, and how often they occur; copies are one row."""
    own = stored(each.filter("size > 0").groupBy("host", "page", "letters").agg(F.max(F.struct("size", "h")).alias("b")))
    rare = own.groupBy("host", "letters").agg(F.count("*").alias("pages")).filter(F.col("pages") < LEAST).select("host", "letters", F.lit(1).alias("rare"))
    first = F.max(F.struct(F.coalesce("rare", F.lit(0)).alias("rare"), "b.size", "b.h"))
    prints = own.join(rare, ["host", "letters"], "left").groupBy("host", "page").agg(first.alias("b")).select("host", "page", F.col("b.h").alias("print"))
    once = each.groupBy("host", "page", "style", "h").agg(F.count("*").alias("n"))
    return once.join(settled(prints), ["host", "page"], "left").select("host", F.coalesce("print", F.lit(0)).alias("print"), "style", "h", "n")


def kept_text(low: dict[tuple[int, int, int], bool] | None, priors: bool):  # noqa: ANN201
    """A mapInArrow function: pages to their text without blocks in ``low``, or in each page's own column ``low``.

    Inside the main part only blocks that are surely of low importance go.
    """
    names = ["page_id", "url", "text", "n_tree", "n_priors"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, hosts, pages in each_page(batches, priors):
            rows = []
            own = b.column("low").to_pylist() if low is None else [None] * b.num_rows
            for host, page, lows in zip(hosts, pages, own, strict=True):
                known = low if low is not None else {(host, x["style"], x["h"]): x["sure"] for x in lows or ()}
                left, by_tree, by_priors = [], 0, 0
                for style, h, t, _, inside, use in page:
                    sure = known.get((host, style, h))
                    if sure or (sure is not None and not inside):
                        by_tree += 1
                    elif not use:
                        by_priors += 1
                    else:
                        left.append(t)
                rows.append(("\n\n".join(left), by_tree, by_priors))
            text, tree, prior = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array(tree, pa.int64()), pa.array(prior, pa.int64())], names=names)

    return run


def importance(each: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(host, style, h, k, content) of texts, and (host, style, m, importance) of the nodes of the tree."""
    texts = each.select("host", "style", "h", "print").distinct().groupBy("host", "style", "h").agg(F.count("*").alias("k"))
    times = each.groupBy("host", "style", "print").agg(F.sum("n").alias("times"))
    variants = times.groupBy("host", "style", "times").agg(F.count("*").alias("c"))
    shape = variants.groupBy("host", "style").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.log("c")).alias("clogc"))
    shape = settled(shape.withColumn("presentation", F.when(F.col("m") > 1, (F.log("m") - F.col("clogc") / F.col("m")) / F.log("m")).otherwise(1.0)))
    content = F.when(F.col("m") > 1, 1 - F.log("k") / F.log("m")).otherwise(1.0)
    texts = stored(texts.join(shape.select("host", "style", "m"), ["host", "style"]).withColumn("content", content))
    mean = texts.groupBy("host", "style").agg((F.sum(F.col("content") * F.col("k")) / F.sum("k")).alias("content"))
    nodes = mean.join(shape, ["host", "style"]).select("host", "style", "m", (F.col("content") * (1 - MIX) + F.col("presentation") * MIX).alias("importance"))
    return texts, settled(nodes)


def unimportant(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(host, style, h, sure) of the texts that the tree removes, on nodes of LEAST pages or more."""
    both = texts.select("host", "style", "h", "content").join(nodes.filter(F.col("m") >= LEAST), ["host", "style"])
    low = both.filter((F.col("importance") < LOW_NODE) | (F.col("content") < LOW_TEXT))
    return low.select("host", "style", "h", (F.col("importance") < LOW_NODE_INSIDE).alias("sure"))


def main_text(pages: DataFrame, priors: bool = True, most: int = 200_000) -> DataFrame:
    """(page_id, url, text, n_tree, n_priors) of every row of ``pages`` (page_id, url, html).

    Pages are parsed twice, once for the tree and once to cut.  The texts of low
    importance travel with the tasks if they are ``most`` rows at most; more of them are
    joined to the blocks of the pages, and each page gets its own.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.xxhash64("url", "html").alias("pk"))
    each = stored(pages.select("url", "html", "pk").mapInArrow(styled(priors), "pk long, host long, page long, style long, h long, letters long, size long"))
    low = stored(unimportant(*importance(stored(printed(each)))))
    schema = "page_id long, url string, text string, n_tree long, n_priors long"
    if low.count() <= most:
        known = {(r.host, r.style, r.h): r.sure for r in low.collect()}
        return pages.mapInArrow(kept_text(known, priors), schema)
    # One text may be on all pages of a host: its rows are dealt by page.
    salt = F.pmod("pk", F.lit(SALTS)).alias("salt")
    copies = low.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    mine = each.select("pk", "host", "style", "h", salt).distinct().join(copies, ["host", "style", "h", "salt"])
    mine = stored(mine.groupBy("pk").agg(F.collect_list(F.struct("style", "h", "sure")).alias("low")))
    return pages.join(mine.hint("merge"), "pk", "left").select("page_id", "url", "html", "low").mapInArrow(kept_text(None, priors), schema)
