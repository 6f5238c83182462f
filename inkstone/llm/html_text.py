"""Main text of web pages, by their structure and by a suffix array of each host.

Pages are parsed into blocks. What lies in menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles and comments by its element, role or
class is boilerplate; what lies in an article is text. For everything else the
host decides: the token streams of its pages are concatenated and their
suffixes sorted; runs of at least RUN tokens that begin suffixes of LEAST_PAGES
or more pages, and of at least SHARE of the host's, are boilerplate, and what they
cover is removed. Pages of equal text count once, so that neither copies nor
passages that a few pages quote are lost.

The suffix array alone can't give the right text: articles that quote each
other would lose the passage, and a menu on one page of a host would stay. So it
decides only what the structure leaves open.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm.scratch import Scratch
from inkstone.llm.wordhash import NOT_SPACE, column_bytes, mix, words

RUN = 8  # tokens
LEAST_PAGES, SHARE = 3, 0.2  # of a host, by text, on which boilerplate stands
SHARD_TOKENS = 400_000

_MARK = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_OPEN_TAG = re.compile(r"</?[a-zA-Z]")
_SPECIAL = re.compile(r"""[>"']""")
_ATTR = re.compile(r"""(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?(?=[\s/]|\Z|["'])""", re.I)
_STYLE = re.compile(r"display\s*:\s*none", re.I)
_RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "object", "svg", "math", "canvas", "head", "xmp", "noembed", "noframes"}
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in _RAW}
_BODY = re.compile(r"<body[\s>]", re.I)
_DROP = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "fieldset", "datalist"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
#: Classes and ids, whole or up to the first hyphen or the like, and roles, that name boilerplate.
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbygoogle sponsor sponsored sponsors promo promotion banner "
    "nav navbar navigation menu submenu breadcrumb breadcrumbs toolbar pagination pager skip "
    "footer sidebar aside widget widgets related recommended recommendations trending popular "
    "cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay disclaimer paywall "
    "newsletter subscribe subscription signup login search form share sharing social "
    "comment comments disqus respond replies".split()
)
_OUTER_NAMES = frozenset("header masthead topbar top-bar branding".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
_HEAD = re.compile(r"[a-z]+")
_PART = {"p": {"p"}, "li": {"li"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
_ENDS_P = {"p", "div", "ul", "ol", "dl", "table", "section", "article", "main", "header", "footer", "nav", "aside", "form", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "hr", "figure", "address", "fieldset"}


class _Markup:
    """Tags of a page, found in time linear in its length, however it is broken.

    A tag ends at the first ``>`` outside of quotes. What a quote or a bracket
    leads to is known from the page's end backwards, so nothing is tried twice.
    """

    def __init__(self, page: str):
        self.page = page
        self.last = page.rfind(">")
        self.special = [m.start() for m in _SPECIAL.finditer(page, 0, self.last + 1)]
        self.ends = [-1] * len(self.special)
        following = {'"': -1, "'": -1}
        for k in range(len(self.special) - 1, -1, -1):
            c = page[self.special[k]]
            if c == ">":
                self.ends[k] = self.special[k]
                continue
            close = following[c]
            if 0 <= close < len(self.special) - 1:
                self.ends[k] = self.ends[close + 1]
            following[c] = k
        self.missing: set[str] = set()

    def search(self, at: int) -> tuple[int, int, str | None, bool, str] | None:
        """From ``at``: where the next tag starts and ends, its name (None of a comment or
        declaration), whether it closes, and its attributes."""
        page = self.page
        for m in _MARK.finditer(page, at):
            if m[2] is None:
                if m[0] == "<!--":
                    end = page.find("-->", m.end())
                    return m.start(), len(page) if end < 0 else end + 3, None, False, ""
                end = page.find(">", m.end()) if m.end() <= self.last else -1
                return m.start(), len(page) if end < 0 else end + 1, None, False, ""
            if m.end() > self.last:
                return None
            k = bisect_left(self.special, m.end())
            end = self.ends[k] if k < len(self.ends) else -1
            if end >= 0:
                return m.start(), end + 1, m[2], bool(m[1]), page[m.end() : end]
        return None

    def rest(self, at: int) -> str:
        """The text from ``at`` on, without a tag that the page ends within."""
        m = _OPEN_TAG.search(self.page, max(at, self.last + 1))
        return self.page[at : m.start()] if m else self.page[at:]

    def after(self, tag: str, at: int) -> int:
        """Behind the end tag of an element whose content isn't markup; -1 without one."""
        if tag not in self.missing:
            m = _RAW_END[tag].search(self.page, at)
            if m and m.end() <= self.last:
                return self.page.find(">", m.end()) + 1
            self.missing.add(tag)
        return -1

    def body(self, at: int) -> int:
        if "<body" not in self.missing:
            m = _BODY.search(self.page, at)
            if m:
                return m.start()
            self.missing.add("<body")
        return -1


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or "").strip("\"'").lower() for m in _ATTR.finditer(text)} if text else {}


def _is_boilerplate(tag: str, attrs: dict[str, str], in_article: bool) -> bool:
    if tag in _DROP or (tag == "header" and not in_article):
        return True
    if not attrs:
        return False
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role") in _ROLES:
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    for name in (attrs.get("class", "") + " " + attrs.get("id", "")).split():
        head = _HEAD.match(name)
        parts = {name, head[0]} if head else {name}
        if parts & _NAMES or (not in_article and parts & _OUTER_NAMES):
            return True
    return False


def parse(page: str) -> list[tuple[str, str]]:
    """Blocks in page order: kind (``article``, ``open`` or ``boilerplate``) and
    text, its white space turned into single spaces. Empty blocks are left out.

    If all articles are within boilerplate and hold more than what is open (it is
    the page's wrapper then, and not its comments), nothing around them is dropped."""
    blocks, within = _blocks(page, True)
    if within and not any(k == "article" for k, _ in blocks):
        whole, _ = _blocks(page, False)
        size = sum(len(t) for k, t in whole if k == "article")
        if size > sum(len(t) for k, t in blocks if k == "open"):
            return whole
    return blocks


def _blocks(page: str, drop_outside: bool) -> tuple[list[tuple[str, str]], bool]:
    """Blocks, and whether an article was dropped. Elements outside of articles
    are dropped only if ``drop_outside``."""
    within = False
    blocks: list[tuple[str, str]] = []
    buffer: list[str] = []
    article: list[str] = []  # open article and main elements
    opened: Counter[str] = Counter()  # how many of each
    drop, depth = "", 0
    at, n = 0, len(page)

    def flush(kind):
        if buffer:
            text = " ".join(entities.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                blocks.append((kind, text))

    def kind():
        return "boilerplate" if drop else "article" if article else "open"

    markup = _Markup(page)
    while at < n:
        found = markup.search(at)
        if not found:
            buffer.append(markup.rest(at))
            break
        start, end, tag, closing, inside = found
        if start > at:
            buffer.append(page[at:start])
        at = end
        if tag is None:
            continue
        tag = tag.lower()
        if tag not in _INLINE:
            flush(kind())
        if tag in _RAW and not closing:
            if not inside.endswith("/"):
                end = markup.after(tag, at)
                if end < 0 and tag == "head":  # it wasn't closed
                    end = max(at, markup.body(at))
                at = n if end < 0 else end
            continue
        if tag in _VOID:
            continue
        if drop:
            within |= not closing and tag in ("article", "main") and depth_is_inner(drop)
            if not closing and tag in ("article", "main") and not depth_is_inner(drop):
                drop, depth = "", 0  # the boilerplate before it wasn't closed
            elif tag == drop:
                depth += -1 if closing else 0 if tag in _PART else 1
                if depth <= 0:
                    flush("boilerplate")
                    drop, depth = "", 0
                    continue
                if not closing and tag not in _PART:
                    continue
                if closing:
                    continue
                flush("boilerplate")
                drop, depth = "", 0  # a following item of the same kind ends this one
            elif not closing and ((drop == "p" and tag in _ENDS_P) or (drop in _PART and tag in _PART[drop])):
                flush("boilerplate")
                drop, depth = "", 0
            else:
                continue
        attrs = _attributes(inside) if not closing and inside else {}
        if not closing and (article or drop_outside) and (_is_boilerplate(tag, attrs, bool(article)) or (inside and _STYLE.search(inside))):
            flush(kind())
            if not inside.endswith("/"):
                drop, depth = tag, 1
        elif tag in ("article", "main") or attrs.get("role") == "main" or "articlebody" in attrs.get("itemprop", ""):
            if not closing:
                article.append(tag)
                opened[tag] += 1
            elif opened[tag]:
                last = None
                while last != tag:
                    last = article.pop()
                    opened[last] -= 1
        elif closing and opened[tag]:
            article.remove(tag)
            opened[tag] -= 1
    flush(kind())
    return blocks, within


def depth_is_inner(drop: str) -> bool:
    """Whether an article within this element belongs to it (a comment, say)."""
    return drop in ("form", "dialog", "aside", "div", "section", "ul", "ol", "li")


def settle(blocks: list[tuple[str, str]]) -> tuple[str | None, list[str], str]:
    """The article's text or None; else the open blocks; and what the host's
    suffix array is to hold: the page's tokens outside of articles."""
    if any(k == "article" for k, _ in blocks):
        text = " ".join(t for k, t in blocks if k == "article")
        return text, [], " ".join(t for k, t in blocks if k != "article")
    return None, [t for k, t in blocks if k == "open"], " ".join(t for _, t in blocks)


def repeated_runs(streams: list[str], run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``run`` tokens, each once, and whether suffixes of two
    or more distinct streams begin with it, from the streams' suffix array."""
    h, pages = run_pages(streams, np.arange(len(streams)), run)
    return h, pages > 1


def run_pages(streams: list[str], texts: np.ndarray, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``run`` tokens, each once, and of how many distinct
    ``texts`` (a number by stream) suffixes begin with it."""
    data, offs = column_bytes(pa.array(streams, pa.large_string()))
    h, _, _, first = words(data, offs, NOT_SPACE)
    n = len(h)
    if n < run:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    page = np.repeat(np.arange(len(streams)), np.diff(first))
    left = first[1:][page] - np.arange(n)  # tokens up to the page's end
    _, rank = np.unique(h, return_inverse=True)
    done = 1
    while done < run:  # ranks of prefixes of twice the length, up to run
        step = min(done, run - done)
        after = np.full(n, -1, dtype=np.int64)
        after[: n - step] = rank[step:]
        after[left <= step] = -1
        _, rank = np.unique(rank.astype(np.int64) * (n + 1) + after + 1, return_inverse=True)
        done += step
    whole = np.flatnonzero(left >= run)
    text = np.asarray(texts)[page]
    array = whole[np.lexsort((text[whole], rank[whole]))]  # suffixes in order
    r, p = rank[array], text[array]
    start = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1]))) if len(r) else np.zeros(0, dtype=np.int64)
    new = np.concatenate(([1], (r[1:] != r[:-1]) | (p[1:] != p[:-1]))).astype(np.int64)
    return run_hashes(h, run)[array[start]], np.add.reduceat(new, start) if len(r) else np.zeros(0, dtype=np.int64)


def run_hashes(h: np.ndarray, run: int = RUN) -> np.ndarray:
    out = np.zeros(max(0, len(h) - run + 1), dtype=np.uint64)
    for k in range(run):
        out = mix(out + h[k : k + len(out)])
    return out


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", run: int = RUN) -> DataFrame:
    """``id_col``, ``url_col``, ``text``, ``n_chars`` for each row.

    A null or empty html has an empty text. Blocks are joined by one space;
    character references are decoded. Pages without an article keep what of
    their open blocks isn't covered by runs that stand on LEAST_PAGES or more pages
    and on at least SHARE of the pages of their host; a null url's host is
    empty. Ids may be null or repeated; pages of a host with equal texts
    (articles, or open blocks) count once. Other columns aren't read.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "html", "snappy")
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]

    def read(batches):
        from pyspark import TaskContext

        n = TaskContext.get().partitionId() << 33
        for b in batches:
            text, blocks, stream = [], [], []
            for page in b.column(2).to_pylist():
                t, o, s = settle(parse(page)) if page else ("", [], "")
                text.append(t)
                blocks.append(o)
                stream.append(s)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(n, n + b.num_rows)), *b.columns[:2], b.column(3), pa.array(text, pa.string()), pa.array(blocks, pa.list_(pa.string())), pa.array(stream, pa.string())],
                names=["row", "id", "url", "host", "text", "blocks", "stream"],
            )
            n += b.num_rows

    url = F.coalesce(F.col(url_col), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[^:/?#]*://([^/?#]*)", 1))
    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))
    rows = scratch.keep(source.mapInArrow(read, f"row long, id {kinds[0]}, url {kinds[1]}, host string, text string, blocks array<string>, stream string"))

    # Suffix arrays, by host; a host of many tokens is dealt into several, whose runs are united.
    own = F.xxhash64(F.coalesce("text", F.array_join("blocks", " "))).alias("own")
    streams = rows.select("host", own, "stream")
    size = streams.groupBy("host").agg(F.greatest(F.lit(1), F.ceil(F.sum(F.length("stream")) / (5 * SHARD_TOKENS))).cast("int").alias("shards"), F.countDistinct("own").alias("texts"))
    size = size.select("host", "shards", F.greatest(F.lit(LEAST_PAGES), F.ceil(F.col("texts") * SHARE)).cast("long").alias("least"))
    # Equal texts meet in one shard, where they count once.
    streams = streams.filter("stream <> ''").dropDuplicates().join(size, "host").withColumn("k", F.expr("cast(pmod(own, shards) as int)"))

    def sort_host(key, table):
        h, pages = run_pages(table.column("stream").to_pylist(), table.column("own").to_numpy(), run)
        if table.column("shards")[0].as_py() == 1:
            often = pages >= table.column("least")[0].as_py()
            h, pages = h[often], pages[often]
        return pa.table({"host": pa.array([key[0].as_py()] * len(h), pa.string()), "run": pa.array(h.view(np.int64)), "pages": pa.array(pages, pa.int64())})

    runs = streams.groupBy("host", "k").applyInArrow(sort_host, "host string, run long, pages long")
    boiler = runs.groupBy("host", "run").agg(F.sum("pages").alias("pages")).join(size, "host").filter("pages >= least").select("host", "run")

    # Open pages: which of their runs are repeated, then what is left.
    undecided = rows.filter("text is null").select("row", "host", "blocks")

    def own_runs(batches):
        for b in batches:
            out = [[], [], []]
            for r, host, blocks in zip(*(c.to_pylist() for c in b.columns)):
                h = run_hashes(words(*column_bytes(pa.array([" ".join(blocks)], pa.large_string())), NOT_SPACE)[0], run)
                out[0] += [r] * len(h)
                out[1] += [host] * len(h)
                out[2].append(h.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(np.concatenate(out[2]) if out[2] else [], pa.int64())], names=["row", "host", "run"])

    found = undecided.mapInArrow(own_runs, "row long, host string, run long").join(boiler, ["host", "run"], "left_semi")
    found = found.groupBy("row").agg(F.collect_set("run").alias("runs"))

    def strip(batches):
        for b in batches:
            text = [strip_runs(blocks, runs or [], run) for blocks, runs in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], names=["row", "text"])

    left = undecided.join(found, "row", "left").select("row", "blocks", "runs").mapInArrow(strip, "row long, text string")
    settled = rows.filter("text is not null").select("id", "url", "text")
    opened = rows.filter("text is null").select("row", "id", "url").join(left, "row").select("id", "url", "text")
    out = settled.unionByName(opened)
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))


def strip_runs(blocks: list[str], runs: list[int], run: int = RUN) -> str:
    """The blocks' tokens that no repeated run covers, joined by spaces."""
    tokens = [t for b in blocks for t in b.split(" ") if t]
    if not runs:
        return " ".join(tokens)
    h = run_hashes(words(*column_bytes(pa.array([" ".join(blocks)], pa.large_string())), NOT_SPACE)[0], run)
    bad = np.isin(h.view(np.int64), np.array(runs, dtype=np.int64))
    cover = np.zeros(len(tokens) + 1, dtype=np.int64)
    at = np.flatnonzero(bad)
    cover[at] += 1
    np.add.at(cover, at + run, -1)
    keep = np.cumsum(cover)[:-1] == 0
    return " ".join(t for t, k in zip(tokens, keep) if k)
