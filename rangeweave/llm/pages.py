"""Main text of web pages, with site templates removed.

A page is parsed into elements. Every block element, paragraphs and headings of the article among
them, is hashed with all it holds; Spark counts on how many pages of a host, of different main
text, each hash occurs, and subtrees that recur on a SHARE of them are deleted as site template: on
FEW pages at least where the page does not mark its article, on MANY inside an article. What has
the article's first heading's place is its title and stays.

Menus, headers, footers, sidebars, notices, adverts, forms and reader comments that differ from page
to page cannot be found by counting; they go by their tag, role, or class and id words, but never an
element that holds the main text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from rangeweave.llm.common import stage, tune

#: Share of a host's pages, of different main text, from which on a subtree is template, and least numbers of pages: outside articles, inside.
SHARE, FEW, MANY = 0.3, 3, 10

#: Levels above the main element that are remembered.
DEEP = 400

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>", re.S)
_ATTRIBUTE = re.compile(r"(?<![^\s\"'])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Elements without an end tag.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup.
_RAW = frozenset("script style textarea title xmp".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Never part of the text.
_GONE = frozenset("head script style noscript template nav footer aside iframe object svg canvas button select textarea input dialog menu audio video map title".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
_CONTROLS = frozenset("input select textarea button".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of a class or id that tell what an element is, and words that may stand beside them.
_NAMES = frozenset(
    "nav navbar navigation menu menubar masthead header footer sidebar aside ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login comment comments commentlist disqus respond replies share sharing social breadcrumb breadcrumbs related recommended pagination pager search skip toolbar widget".split()
)
_BESIDE = frozenset("site page main top bottom left right primary secondary global box block bar list area container wrapper wrap section links link item items inner outer form side reader user post posts entry buttons button icons menu text thread".split())
#: Elements that a start tag of the key closes, within the nearest of the third kind.
_CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table tbody thead tfoot"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "tbody": ("tbody thead tfoot tr td th", "table"), "thead": ("tbody thead tfoot", "table"), "tfoot": ("tbody thead tfoot tr td th", "table"), "option": ("option", "select")}
_CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in _CLOSES.items()}


def told(names: str) -> bool:
    """Whether a class or id is made of words for what is not main text. `no-sidebar` or `search-algorithms` say something else."""
    for name in names.lower().split():
        parts = [x for x in re.split(r"[-_]+|\d+", name) if x]
        if any(x in _NAMES for x in parts) and all(x in _NAMES or x in _BESIDE for x in parts):
            return True
    return False


class Element:
    __slots__ = ("tag", "names", "role", "items", "hash", "size", "controls", "named")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.items, self.hash, self.size, self.controls = tag, [], 0, 0, tag in _CONTROLS
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if attributes else {}
        self.names, self.role = f"{found.get('class', '')} {found.get('id', '')}".strip(), found.get("role", "").lower()
        self.named = bool(self.names) and tag not in ("html", "body", "main") and told(self.names)


def parse(html: str) -> Element:
    """The tree of a page; texts are items of type str, with references decoded. Never fails."""
    root = Element("#root")
    stack, at, n = [root], 0, len(html)
    while at < n:
        m = _TAG.search(html, at)
        text = html[at : m.start() if m else n]
        if text:
            stack[-1].items.append(unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in _BLOCK and tag not in _BLOCK:
                    break  # the end of an inline element does not close a block
            continue
        if tag in _BLOCK and tag not in ("html", "body"):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in _BLOCK:
                    break
        if tag in _CLOSES:
            own, bound = _CLOSES[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in bound:
                    break
                if stack[k].tag in own:
                    del stack[k:]
                    if tag in ("li", "dt", "dd", "option"):
                        break
        element = Element(tag, m[3])
        stack[-1].items.append(element)
        if tag in _VOID or m[3].endswith("/") and tag not in _BLOCK:
            continue
        if tag in _RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(html, at)
            close = html.find(">", end.start()) if end else -1
            at = n if close < 0 else close + 1
            continue
        stack.append(element)
    return root


def measure(root: Element) -> None:
    """Set hash, characters of text and presence of controls of every element; children first."""
    order, todo = [], [root]
    while todo:
        e = todo.pop()
        order.append(e)
        todo += [x for x in e.items if not isinstance(x, str)]
    for e in reversed(order):
        content = []
        for x in e.items:
            if isinstance(x, str):
                content.append(" ".join(x.split()))
                e.size += len(content[-1])
            else:
                content.append(f"\x1e{x.hash:x}")
                e.size += x.size
                e.controls |= x.controls
        content = "\x1f".join(content)
        e.hash = xxh64_intdigest(f"{e.tag}\x1d{e.names}\x1d{content}")


def holders(root: Element) -> set[int]:
    """Identities of the main element and all that hold it: the main element, else the longest article."""
    best, todo = None, [(root, (), False)]
    while todo:
        e, above, off = todo.pop()
        off = off or e.named or e.tag in _GONE or e.role in _ROLES
        if e.tag in ("main", "article") or e.role == "main":
            rank = (not off, e.tag == "main" or e.role == "main", e.size)
            if best is None or rank > best[0]:
                best = rank, (*above, id(e))
        above = (*above, id(e)) if len(above) < DEEP else above
        todo += [(x, above, off) for x in e.items if not isinstance(x, str)]
    # What is told to be something else, or is inside such an element, is no main element.
    return set(best[1]) if best and best[0][0] else set()


class Kinds:
    """Tells the elements of a page that go by their kind."""

    def __init__(self, root: Element):
        self.total, self.holders = root.size, holders(root)

    def gone(self, e: Element, inside: bool) -> bool:
        """An article's own header holds its title and stays, and so does what holds the main text."""
        if id(e) in self.holders:
            return False
        if e.tag in _GONE or e.role in _ROLES or (e.tag == "header" and not inside):
            return True
        if e.tag == "form":
            return e.controls and (bool(self.holders) or 2 * e.size <= self.total)
        return e.named and (bool(self.holders) or 2 * e.size <= self.total)


def mains(root: Element, kinds: Kinds) -> list[Element]:
    """The elements that hold the main text: articles, else the main element, else the whole page."""
    for wanted in (lambda e: e.tag == "article", lambda e: e.tag == "main" or e.role == "main"):
        found, todo = [], [root]
        while todo:
            e = todo.pop()
            if wanted(e):
                found.append(e)
            else:
                todo += [x for x in reversed(e.items) if not isinstance(x, str) and not kinds.gone(x, False)]
        if found:
            return found
    return [root]


def blocks(html: str | None) -> tuple[list[str], list[list[int]], list[int]]:
    """(texts, chains, all): the main text's blocks, for each the hashes of the block elements that
    hold it, and all such hashes of the page. Hashes inside a marked article are odd, others even."""
    if not html:
        return [], [], []
    root = parse(html)
    measure(root)
    kinds = Kinds(root)
    kept = mains(root, kinds)
    main, bare = set(map(id, kept)), kept == [root]
    texts, chains, every = [], [], []
    words: list[str] = []
    chain: tuple[int, ...] = ()
    titled = False

    def flush() -> None:
        if line := " ".join("".join(words).split()):
            texts.append(line)
            chains.append(list(chain))
        words.clear()

    # (item, inside a main element, hashes so far) in page order; None ends a block
    todo: list = [(root, bare, ())]
    while todo:
        item, inside, own = todo.pop()
        if item is None:
            flush()
            continue
        if isinstance(item, str):
            if inside:
                if own != chain:
                    flush()
                    chain = own
                words.append(item)
            continue
        if id(item) not in main and kinds.gone(item, inside and not bare):
            continue
        inside = inside or id(item) in main
        block = item.tag in _BLOCK
        if item.tag in ("br", "wbr"):
            words.append(" " if inside and item.tag == "br" else "")
            continue
        if block and inside and not titled and item.tag in _HEADINGS:
            titled = True
        elif block and inside and id(item) not in main and item.tag not in ("html", "body", "main", "article"):
            h = item.hash - (1 << 64) if item.hash >> 63 else item.hash
            own = (*own, (h | 1) if not bare else (h & ~1))
            every.append(own[-1])
        if block and inside:
            flush()
            todo.append((None, inside, own))
        todo += [(x, inside, own) for x in reversed(item.items)]
    flush()
    return texts, chains, sorted(set(every))


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", share: float = SHARE, few: int = FEW, many: int = MANY) -> DataFrame:
    """One row per page: id_col, url_col, text, n_chars.

    text: the blocks of the main text in page order, joined by newlines; within a block, references
    are decoded and white space is one space. Null and empty pages have the empty text. The host is
    what stands between :// and the next /, ? or #, in lower case (a null url is a host of its
    own). Copies of a page count once on a host. Broken markup is read as far as it makes sense;
    repeated rows and null ids each give a row; other columns are not looked at, and an empty table
    gives an empty result.
    """
    tune(pages.sparkSession)
    host = F.lower(F.coalesce(F.regexp_extract(url_col, r"^[^:/?#]+://([^/?#]*)", 1), F.lit("")))
    rows = pages.select(F.col(id_col), F.col(url_col), host.alias("host"), F.col(html_col).cast("string").alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [blocks(x) for x in b.column(3).to_pylist()]
            sign = [xxh64_intdigest("\n".join(t).encode("utf-8", "replace")) >> 1 for t, _, _ in got]
            cols = [pa.array([x[0] for x in got], pa.list_(pa.string())), pa.array([x[1] for x in got], pa.list_(pa.list_(pa.int64()))), pa.array([x[2] for x in got], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(sign, pa.int64()), *cols], names=["i", "u", "host", "sign", "texts", "chains", "every"])

    schema = f"i {kinds[id_col]}, u {kinds[url_col]}, host string, sign long, texts array<string>, chains array<array<long>>, every array<long>"
    found = stage(rows.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()))
    each = found.select("host", "sign", F.explode("every").alias("h")).distinct()
    pages_of = found.select("host", "sign").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    least = F.greatest(F.when(F.pmod("h", F.lit(2)) == 1, many).otherwise(few).cast("double"), F.col("pages") * F.lit(share))
    often = each.groupBy("host", "h").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= few)
    template = stage(often.join(pages_of, "host").where(F.col("c") >= least).select("host", "h"))
    touched = F.size(F.array_distinct(F.flatten("chains"))) > 0
    hit = found.where(touched).select("row", "host", F.explode(F.array_distinct(F.flatten("chains"))).alias("h"))
    gone = hit.join(template, ["host", "h"]).groupBy("row").agg(F.collect_set("h").alias("gone"))
    clean = found.where(~touched).withColumn("left", F.col("texts"))
    cut = found.where(touched).join(stage(gone), "row", "left")
    left = F.expr("transform(filter(arrays_zip(texts, chains), x -> gone is null or not arrays_overlap(x.chains, gone)), x -> x.texts)")
    both = clean.select("i", "u", "left").unionByName(cut.withColumn("left", left).select("i", "u", "left"))
    text = F.array_join("left", "\n")
    return both.select(F.col("i").alias(id_col), F.col("u").alias(url_col), text.alias("text"), F.length(text).cast("long").alias("n_chars"))
