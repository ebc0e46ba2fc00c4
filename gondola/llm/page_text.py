"""Main text of web pages by removal of what a site's pages share.

1. One pass over every page: its elements are read into a tree as browsers do it
   (implied end tags, raw text elements, comments, broken or cut markup), and the
   subtree of every element is hashed: name, class, id, text and child subtrees.
2. Spark counts in how many different pages of its host each subtree recurs, partial
   counts first, so a host may hold any share of the pages. Pages with one longest
   block are copies or near copies of one article and count once.
3. Subtrees that recur in many pages of their host are its template and go with all
   they contain. What a page has of its own is left.

Some parts of a page differ from page to page and still are not its article: elements
that say what they are by name, role, class or id (menus, headers outside the article,
footers, sidebars, notices, adverts, forms, reader comments, scripts, styles) go by
that. Conversely a text that many articles of a host quote is not a template: inside
``article`` and ``main`` only boxes (div, section, lists, tables ...) are candidates,
not the paragraphs themselves; an element with half of a page's text or more is none
either; and paragraphs outside must recur in half of the host's pages.
If a page has ``article`` elements left, its text is what they hold, else what ``main``
holds, else all that is left.

A block is the text between the borders of block elements. Its white space becomes
single blanks (a line break element counts as one), character references are decoded.

Defined results: null html is empty; a null or relative url has the empty host; repeated
rows give repeated rows; an empty table gives no rows; an element below 512 levels closes the
one before it, which bounds the work of a page; markup that ends in the middle of
a tag loses that tag only. Columns to keep come back as fields of ``page``.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gondola.llm.staging import kept_columns, slices, staged, text_or_empty

#: A box recurs in many pages: in this share of the host's pages, and in so many at least.
SHARE, PAGES = 0.1, 4
#: Deepest nesting; an element below closes the one before it, as in browsers.
DEPTH = 512
#: The same share for paragraphs outside of the article.
PROSE_SHARE = 0.5

# Element names of HTML by their role.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp noscript iframe noembed noframes template".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section "
    "summary table tbody td tfoot th thead tr ul".split()
)
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt blockquote pre td th tr tbody thead figcaption caption hgroup".split())
_REMOVED = frozenset(
    "head svg math canvas object audio video nav footer aside form fieldset button select optgroup option datalist dialog menu search".split()
)
#: A start tag of the first ends an open element of the second, up to the border of the third.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "body": ({"head"}, {"html"}),
}
_ENDS_P = _BLOCK - frozenset("body head html td th tr tbody thead tfoot caption legend summary dd dt li".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
#: Words of class names and ids that say what an element is.
_WORDS = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertisements advertising adslot banner breadcrumb breadcrumbs "
    "alert alerts comment comments commentlist consent cookie cookies disqus footer gdpr login masthead menu modal nav "
    "navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted promotion "
    "recommendations recommended related replies respond share sharing sidebar signup skiplink social sponsor sponsored "
    "subscribe subscription topbar widget widgets".split()
)
#: Beginnings of such words.
_STEMS = ("advert", "breadcrumb", "cookie", "navig", "newsletter", "sidebar", "subscri")
#: A class of these words alone names the head of the site.
_HEAD = frozenset("header site page main top global wrapper container inner".split())
#: Containers that keep such words harmless, and words that only say what else a page has.
_WHOLE = frozenset("html body main article".split())
_HAS = frozenset("has with no without".split())

_MARK = re.compile(
    r"<(?:!--(?P<comment>.*?)(?:-->|--!>|\Z)|(?P<end>/)?(?P<name>[a-zA-Z][^\s/>]*)"
    r"(?P<attrs>(?:[^>\"']+|\"[^\"]*\"|'[^']*'|[\"'](?=[^\"'>]*>))*+)(?P<close>>|\Z)|[!?/][^>]*(?:>|\Z))",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in _RAW}


class _Element:
    __slots__ = ("name", "parent", "label", "parts", "removed", "within", "chars", "hash", "closed", "holds", "saved", "depth", "lost", "inside")

    def __init__(self, name: str, parent: _Element | None, label: str, removed: bool):
        self.name, self.parent, self.label, self.removed = name, parent, label, removed
        self.parts: list[bytes] = []
        self.within = "article" if name == "article" else "main" if name == "main" else ""
        self.chars, self.hash, self.closed, self.holds = 0, 0, False, False
        self.depth = parent.depth + 1 if parent else 0
        self.lost, self.inside = False, ""  # removed with or inside of this; article or main that it lies in
        self.saved: list[str] | None = None  # text of the block that goes on behind it


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in reversed(list(_ATTRIBUTE.finditer(text)))}


def _says_removed(name: str, given: dict[str, str]) -> bool:
    """Does the element itself say that it is no part of an article?"""
    if name in _REMOVED or given.get("role", "").lower() in _ROLES:
        return True
    if "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", ""):
        return name not in _WHOLE
    words = {w.lower() for w in _PIECES.findall(f"{given.get('class', '')} {given.get('id', '')}")}
    if name == "article":
        return bool(words & {"comment", "comments", "ad", "related", "teaser", "promo", "sponsored"})
    if name in _WHOLE or words & _HAS:
        return False
    return bool(words & _WORDS) or any(w.startswith(_STEMS) for w in words)


def _is_site_head(name: str, given: dict[str, str]) -> bool:
    words = {w.lower() for w in _PIECES.findall(f"{given.get('class', '')} {given.get('id', '')}")}
    return name == "header" or ("header" in words and words <= _HEAD and name not in _WHOLE)


class Page:
    """``blocks``: (text, innermost element) in page order; ``elements``: all of them, innermost first."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, _Element]] = []
        self.elements: list[_Element] = []
        self._root = _Element("", None, "", False)
        self._open = self._root
        self._names: dict[str, int] = {}
        self._text: list[str] = []
        self._read(source)
        while self._open is not self._root:
            self._close()

    def _flush(self) -> None:
        text = " ".join("".join(self._text).split())
        self._text.clear()
        if text:
            self.blocks.append((text, self._open))
            self._open.chars += len(text)

    def _close(self, closed: bool = False) -> None:
        e = self._open
        if e.name in _BLOCK or e.removed:
            self._flush()
        if e.saved is not None:
            self._text = e.saved
        e.closed = closed
        e.hash = xxhash.xxh3_64_intdigest(b"\0".join([e.name.encode(), e.label.encode("utf-8", "surrogatepass"), *e.parts]))
        e.parts = []
        e.parent.parts.append(e.hash.to_bytes(8, "little"))
        e.parent.chars += e.chars
        e.parent.holds |= e.holds or (e.name in ("article", "main") and not e.removed)
        self._names[e.name] -= 1
        self.elements.append(e)
        self._open = e.parent

    def _close_to(self, names, border=()) -> None:
        """Close up to the innermost open element of ``names``, if none of ``border`` lies in between."""
        e = self._open
        while e is not self._root and e.name not in names:
            if e.name in border:
                return
            e = e.parent
        if e is not self._root:
            while self._open is not e:
                self._close()
            self._close()

    def _start(self, name: str, attrs: str) -> None:
        if name in _ENDS_P and self._names.get("p"):
            self._close_to({"p"}, {"button", "td", "th", "caption", "table", "object"})
        if name in _ENDS and any(self._names.get(x) for x in _ENDS[name][0]):
            names, border = _ENDS[name]
            for _ in range(2 if name == "tr" else 1):
                self._close_to(names, border)
        given = _attributes(attrs) if attrs and not attrs.isspace() else {}
        if name == "br":
            self._text.append(" ")
        if name in _BLOCK:
            self._flush()
        if name in _VOID or name in _RAW:
            return
        inside = self._names.get("article") or self._names.get("main")
        removed = _says_removed(name, given) or (not inside and _is_site_head(name, given))
        if self._open.depth == DEPTH:
            self._close()
        label = f"{given.get('class', '')}\0{given.get('id', '')}" if given else ""
        self._open = _Element(name, self._open, label, removed)
        if removed and name not in _BLOCK:
            self._open.saved, self._text = self._text, []
        self._names[name] = self._names.get(name, 0) + 1
        if given.get("role") == "main" and not removed:
            self._open.within = "main"

    def _read(self, source: str) -> None:
        at, end = 0, len(source)
        while at < end:
            mark = source.find("<", at)
            if mark < 0:
                mark = end
            if mark > at:
                self._say(source[at:mark])
            if mark == end:
                break
            m = _MARK.match(source, mark)
            if m is None:
                self._say("<")
                at = mark + 1
                continue
            at = m.end()
            if m["name"] is None:
                continue
            if m["close"] != ">":
                break
            name = m["name"].lower()
            if m["end"]:
                if name == "p" and not self._names.get("p"):
                    self._flush()
                elif self._names.get(name):
                    e = self._open
                    while e.name != name:
                        e = e.parent
                    while self._open is not e:
                        self._close()
                    self._close(closed=True)
                continue
            self._start(name, m["attrs"])
            if name in _RAW:
                stop = _RAW_END[name].search(source, at)
                at = stop.end() if stop else end
        self._flush()

    def _say(self, text: str) -> None:
        if "&" in text:
            text = html.unescape(text)
        self._text.append(text)
        if not text.isspace():
            self._open.parts.append(" ".join(text.split()).encode("utf-8", "surrogatepass"))

    def _gone(self, e: _Element) -> bool:
        """Removed by what it says; an element that was never closed gives back an article inside."""
        return e.removed and (e.closed or not e.holds)

    def own(self) -> tuple[list[int], list[int], list[dict]]:
        """(box hashes, prose hashes, blocks): candidates for the template, and what is left of the page.

        A block names the hashes of the elements around it that are candidates.
        """
        for e in reversed(self.elements):
            e.lost = e.parent.lost or self._gone(e)
            e.inside = "article" if "article" in (e.within, e.parent.inside) else e.within or e.parent.inside
        kept = [(text, e) for text, e in self.blocks if not e.lost]
        whole = sum(len(text) for text, _ in kept)
        boxes, prose, kind = set(), set(), {}
        for e in self.elements:
            if e.within or e.name in _WHOLE or (2 * e.chars >= whole and not e.removed) or e.name not in _BLOCK:
                continue
            if e.name not in _PROSE:
                boxes.add(e.hash)
            elif not e.parent.inside:
                prose.add(e.hash)
            else:
                continue
            kind[id(e)] = _signed(e.hash)
        left = []
        for text, e in kept:
            around, within = [], e.inside
            while e.name and not e.within:
                if id(e) in kind:
                    around.append(kind[id(e)])
                e = e.parent
            left.append({"text": text, "within": within, "around": around})
        return [_signed(x) for x in boxes], [_signed(x) for x in prose], left


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


_BLOCKS = pa.list_(pa.struct([("text", pa.string()), ("within", pa.string()), ("around", pa.list_(pa.int64()))]))


def _kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        boxes, prose, blocks, articles = [], [], [], []
        for source in batch.column("html").to_pylist():
            a, b, c = Page(source).own()
            longest = max((x["text"] for x in c), key=len, default="")
            articles.append(_signed(xxhash.xxh3_64_intdigest(longest.encode("utf-8", "surrogatepass"))))
            boxes.append(a)
            prose.append(b)
            blocks.append(c)
        yield pa.RecordBatch.from_arrays(
            [
                *[batch.column(c) for c in ("page", "row", "host")],
                pa.array(articles, pa.int64()),
                pa.array(boxes, pa.list_(pa.int64())),
                pa.array(prose, pa.list_(pa.int64())),
                pa.array(blocks, _BLOCKS),
            ],
            ["page", "row", "host", "article", "boxes", "prose", "blocks"],
        )


def host(url: Column) -> Column:
    """The host of an absolute url in lower case, without port; empty for others."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def read_pages(pages: DataFrame, keep: list[str]) -> DataFrame:
    """(page, row, host, article, boxes, prose, blocks): every page once read; article is the hash of its longest block."""
    rows = pages.select(
        kept_columns(keep).alias("page"),
        F.monotonically_increasing_id().alias("row"),
        host(F.col("url").cast("string")).alias("host"),
        text_or_empty("html").alias("html"),
    )
    made = T.StructType([rows.schema["page"]])
    for name, kind in (
        ("row", "long"), ("host", "string"), ("article", "long"), ("boxes", "array<long>"), ("prose", "array<long>"),
        ("blocks", "array<struct<text:string,within:string,around:array<long>>>"),
    ):
        made.add(name, T.DataType.fromDDL(kind))
    return rows.mapInArrow(_kernel, made)


def templates(read: DataFrame, share: float = SHARE, pages: int = PAGES, prose_share: float = PROSE_SHARE) -> DataFrame:
    """(host, hash): subtrees that recur in many different pages of their host."""
    different = read.groupBy("host", "article").agg(F.min_by(F.struct("boxes", "prose"), "row").alias("x")).select("host", "x.*")
    sizes = different.groupBy("host").agg(F.count(F.lit(1)).alias("_pages"))
    marked = F.array(
        F.struct(F.col("boxes").alias("hashes"), F.lit(False).alias("_prose")),
        F.struct(F.col("prose").alias("hashes"), F.lit(True).alias("_prose")),
    )
    counts = (
        different.select("host", F.inline(marked))
        .select("host", "_prose", F.explode("hashes").alias("hash"))
        .groupBy("host", "hash")
        .agg(F.count(F.lit(1)).alias("_n"), F.max("_prose").alias("_prose"))
        .where(F.col("_n") >= pages)
    )
    least = F.col("_pages") * F.when(F.col("_prose"), prose_share).otherwise(share)
    return counts.join(sizes, "host").where(F.col("_n") >= least).select("host", "hash")


def main_text(pages: DataFrame, keep: list[str], share: float = SHARE, least_pages: int = PAGES) -> DataFrame:
    """(page, text, n_template): main text of every row of ``pages`` (url, html) and its blocks removed as template."""
    read = staged(read_pages(pages, keep), "pages")
    # Both are written, so that their size decides whether pages are shuffled to meet them.
    shared = staged(templates(read, share, least_pages), "templates")
    around = read.select("row", "host", F.explode(F.array_distinct(F.flatten("blocks.around"))).alias("hash"))
    met = staged(around.join(shared, ["host", "hash"]).groupBy("row").agg(F.collect_set("hash").alias("template")), "met")
    none = F.array().cast("array<long>")
    joined = read.select("page", "row", "blocks").join(met, "row", "left").withColumn("template", F.coalesce("template", none))
    left = joined.select(
        "page",
        F.size("blocks").alias("n"),
        F.filter("blocks", lambda b: ~F.arrays_overlap(b["around"], F.col("template"))).alias("left"),
    )
    texts = lambda within: F.filter("left", lambda b: b["within"] == within)["text"]
    main = lambda: F.filter("left", lambda b: b["within"] != "")["text"]
    has = lambda within: F.exists("left", lambda b: b["within"] == within)
    chosen = F.when(has("article"), texts("article")).when(has("main"), main()).otherwise(F.col("left")["text"])
    return left.select("page", F.array_join(chosen, "\n").alias("text"), (F.col("n") - F.size("left")).cast("long").alias("n_template"))
