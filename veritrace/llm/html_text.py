"""HTML extraction (op7): template deduction by equivalence classes of tokens over the pages of one host.

1. A parser turns a page into blocks of text, each in a container path (element and class names, digits masked). Tokens are
   the container paths, and each block's text within its path. A token's count in a page is its entry in the token's
   occurrence vector over the host's pages.
2. Vectors are summed as commutative hashes by (host, token), with map-side combine: no host is gathered anywhere. Tokens of
   equal vectors form a class. A class is valid from two tokens and two pages on; a path token's class nests in that of the
   path around it, which stands wherever it stands.
3. The template of a host holds its path tokens, each with the prose (text outside links) and link text that a page has there on
   average and whether it stands once a page; and its text tokens: texts of a valid class that stand on ``least_pages`` pages
   and in ``most_share`` of those with their container. A token of less than a hundredth of the host's pages is no
   template token, so a template is bounded by the size of a page; such a path is judged by its own page.
4. Slots of a page are containers of prose, not of links, that stand once a page with a tenth or more of the prose of
   the richest one, and what is nested in such slots. Where there are articles or mains, slots are there alone. Parts of other
   roles by name (menus, adverts, comments ...) are no slots.
5. The text of a page is the text in its slots without the template's text tokens. (If those were a third of a container's
   prose or more, they are copies of an article and stay.)

Pages are parsed twice, so that no text is written or moved for the template but tokens' hashes.

Defined cases: null html is empty and gives an empty text; a null url is a host of its own; repeated page ids are rows of
their own; a page alone on its host is its own template; ties between slots keep both; broken markup is read as far as it
goes, and nesting of any depth and very long pages take time in proportion; empty tables give no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import written

#: Elements whose text is no text of the page, and elements and class words of other roles (fixed values).
SILENT = {"script", "style", "noscript", "template", "head", "title", "svg", "iframe", "object", "select", "textarea", "button"}
OTHER = {"nav", "header", "footer", "aside", "form", "menu", "dialog"}
OTHER_WORDS = {"ad", "ads", "advert", "advertisement", "banner", "sponsor", "sponsored", "promo", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "header", "footer", "sidebar", "cookie", "cookies", "consent", "gdpr", "notice", "popup", "modal", "newsletter", "subscribe", "signup", "login", "paywall", "share", "social", "related", "recommended", "popular", "trending", "pagination", "pager", "comment", "comments", "reply", "replies", "widget"}
#: A compound class name ("with-sidebar") with one of the first words marks no container that holds the page's first article
#: or main; nor does any other compound name, but for those of the second words.
LAYOUT_WORDS, ASIDE_WORDS = {"with", "without", "no", "has"}, {"comment", "comments", "reply", "replies", "related"}
#: What may stand in head; anything else ends it.
HEAD = {"head", "base", "link", "meta", "title", "style", "script", "noscript", "template"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CONTAINERS = {"body", "article", "main", "section", "div", "td", "table", *OTHER}
#: A start of one of these ends an open one of its kind, unless one of the second set stands between.
CLOSERS = {"p", "li", "dt", "dd", "tr", "option"}
SCOPES = {"ul", "ol", "dl", "tbody", "blockquote", "select", *CONTAINERS}
NEAR = 64  # how far up an end is implied
DIGITS = re.compile(r"\d+")
ROOT = 0x5EED


def words_of_names(named: dict) -> list[list[str]]:
    names = f"{named.get('class') or ''} {named.get('id') or ''} {named.get('role') or ''}".lower().split()
    return [x.replace("-", " ").replace("_", " ").split() for x in names]


def layout(parts: list[list[str]]) -> bool:
    """Whether the names with words of other roles may be of a layout, not of the part itself."""
    marked = [x for x in parts if not OTHER_WORDS.isdisjoint(x)]
    return all(len(x) > 1 and (ASIDE_WORDS.isdisjoint(x) or not LAYOUT_WORDS.isdisjoint(x)) for x in marked)


class Path:
    """A container path of a page: how often it is opened, and the prose and link text of its blocks."""

    __slots__ = ("links", "main", "n", "parent", "prose")

    def __init__(self, parent: int, main: bool):
        self.parent, self.main, self.n, self.prose, self.links = parent, main, 0, 0, 0


class Blocks(HTMLParser):
    """Blocks (path, text, prose) in page order, and the paths. A stack entry holds what its whole branch amounts to, so a tag
    costs the same at any depth."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, bool, bool | str]] = [("", ROOT, False, False)]  # element, path, silent, other role
        self.counts: Counter = Counter()
        self.text: list[str] = []
        self.linked = 0
        self.blocks: list[tuple[int, str, int]] = []
        self.paths: dict[int, Path] = {ROOT: Path(0, False)}
        self.at = (ROOT, False)  # path and role of the block that is read
        self.found = False  # an article or main

    def parse_marked_section(self, i, report=1):  # "<![...": the base class knows few kinds and fails on others
        return self.parse_bogus_comment(i)

    def _cut(self) -> None:
        text = " ".join("".join(self.text).split())
        path, other = self.at
        if text and not other:
            prose = max(0, len(text) - self.linked)
            self.blocks.append((path, text, prose))
            self.paths[path].prose += prose
            self.paths[path].links += len(text) - prose
        self.text, self.linked = [], 0
        self.at = self.open[-1][1], bool(self.open[-1][3])

    def _push(self, tag: str, path: int, silent: bool, other: bool | str) -> None:
        _, _, s, o = self.open[-1]
        self.open.append((tag, path, s or silent, o if o is True else other or o))
        self.counts[tag] += 1

    def _pop(self, k: int) -> None:
        for tag, *_ in self.open[k:]:
            self.counts[tag] -= 1
        del self.open[k:]

    def _holds_main(self) -> None:
        """The open containers of layout names hold the content: they are of no other role."""
        self.found = True
        self.open = [(t, n, s, o is True) for t, n, s, o in self.open]

    def handle_starttag(self, tag, attrs):
        if self.counts["head"] and (tag == "body" or self.open[-1][0] == "head" and tag not in HEAD):
            self.handle_endtag("head")
        if tag in VOID or tag in INLINE:
            if tag in ("br", "hr"):
                self.text.append(" ")
            elif tag not in VOID:
                marked = bool(attrs) and not OTHER_WORDS.isdisjoint(w for x in words_of_names(dict(attrs)) for w in x)
                if tag == "a" or marked:
                    self._push(tag, self.open[-1][1], False, marked)
            return
        if tag in CLOSERS:
            self._imply(tag)
        parts = words_of_names(dict(attrs)) if attrs else []
        words = {w for x in parts for w in x}
        marked = not OTHER_WORDS.isdisjoint(words)
        above = self.open[-1][1]
        if tag in ("article", "main") and not self.found and not marked:
            self._holds_main()
        # Names of the main content are not taken for another role, nor is the header of an article.
        other: bool | str = tag in OTHER and not (tag == "header" and self.paths[above].main) or marked and tag not in ("body", "article", "main", "html")
        if other and tag not in OTHER and layout(parts):
            other = "layout"
        path = above
        if tag in CONTAINERS:
            name = ".".join([tag, *sorted({DIGITS.sub("#", w) for w in words})])
            path = xxh64_intdigest(name.encode("utf-8", "replace"), above)
            if path not in self.paths:
                self.paths[path] = Path(above, self.paths[above].main or tag in ("article", "main"))
            self.paths[path].n += 1
        self._push(tag, path, tag in SILENT, other)
        self._cut()

    def _imply(self, tag: str) -> None:
        if self.counts[tag]:
            for k in range(len(self.open) - 1, max(0, len(self.open) - NEAR), -1):
                if self.open[k][0] == tag:
                    self._pop(k)
                    return
                if self.open[k][0] in SCOPES:
                    return

    def handle_endtag(self, tag):
        if tag in VOID or not self.counts[tag]:
            return
        if tag in INLINE:  # an inline element is ended where it stands, not through blocks
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k][0] == tag:
                    self._pop(k)
                    return
                if self.open[k][0] not in INLINE:
                    return
        k = len(self.open) - 1
        while self.open[k][0] != tag:
            k -= 1
        self._pop(k)
        self._cut()

    def handle_data(self, data):
        if self.open[-1][0] == "head" and data.strip():
            self.handle_endtag("head")
        tag, _, silent, other = self.open[-1]
        if not silent and not (other and tag in INLINE):
            self.text.append(data)
            if tag == "a":
                self.linked += len(data)

    def done(self, html: str) -> Blocks:
        self.feed(html)
        self.close()
        self._cut()
        return self


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def text_token(path: int, text: str) -> int:
    return xxh64_intdigest(text.encode("utf-8", "replace"), path ^ 1)


TOKENS = "host long, page long, token long, within long, is_path boolean, n long, prose long, links long"


def tokens_of(pages: DataFrame) -> DataFrame:
    """A row for each token of each page, and one for the page itself (token 0)."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch, out = whole.slice(k, 256), [[] for _ in kinds]
                for host, page, html in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    p = Blocks().done(html or "")
                    rows = [(0, 0, False, 1, 0, 0)]
                    rows += [(signed(x), signed(d.parent), True, max(d.n, 1), d.prose, d.links) for x, d in p.paths.items()]
                    texts = Counter((path, text_token(path, text)) for path, text, _ in p.blocks)
                    rows += [(signed(t), signed(path), False, n, 0, 0) for (path, t), n in texts.items()]
                    for r in rows:
                        for column, x in zip(out, (host, page, *r)):
                            column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names=[x.split()[0] for x in TOKENS.split(", ")])

    return hosted(pages).select("host", F.xxhash64("page_id", "url", "html").alias("page"), "html").mapInArrow(walk, TOKENS)


def hosted(pages: DataFrame) -> DataFrame:
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.xxhash64(host).alias("host"), "html")


def templates(tokens: DataFrame, *, least_pages: int, most_share: float) -> DataFrame:
    """(host, pages, paths, texts): the template of each host."""
    vectors = tokens.groupBy("host", "token", "within", "is_path").agg(
        F.bit_xor(F.xxhash64("page", "n")).alias("vector"), F.count("*").alias("pages"), F.sum((F.col("n") == 1).cast("long")).alias("once"),
        F.sum("prose").alias("prose"), F.sum("links").alias("links"),
    )
    vectors = written(vectors, "html-vectors")
    hosts = vectors.where((F.col("token") == 0) & ~F.col("is_path")).select("host", F.col("pages").alias("host_pages"))
    often = vectors.where((F.col("token") != 0) | F.col("is_path")).join(hosts, "host").where(100 * F.col("pages") >= F.col("host_pages"))
    path = F.struct("token", (F.col("prose") / F.col("pages")).alias("prose"), (F.col("links") / F.col("pages")).alias("links"), (10 * F.col("once") >= 9 * F.col("pages")).alias("once"))
    paths = often.where("is_path").groupBy("host").agg(F.max("host_pages").alias("pages"), F.collect_list(path).alias("paths"))
    classes = often.where(F.col("pages") >= 2).groupBy("host", "vector", "pages").agg(F.count("*").alias("size")).where(F.col("size") >= 2)
    around = often.where("is_path").select("host", F.col("token").alias("within"), F.col("pages").alias("container_pages"))
    texts = often.where(~F.col("is_path") & (F.col("pages") >= least_pages)).join(around, ["host", "within"])
    # A text of a valid class, or one in nearly every container like its own, is the template's.
    texts = texts.where(F.col("pages") >= most_share * F.col("container_pages")).join(classes, ["host", "vector", "pages"], "left")
    texts = texts.where(F.col("size").isNotNull() | (F.col("pages") >= 0.8 * F.col("container_pages")))
    texts = texts.groupBy("host").agg(F.collect_list("token").alias("texts"))
    return paths.join(texts, "host", "left")


def slots_of(page: Blocks, scores: dict[int, tuple[float, float, bool]], own: bool) -> set[int]:
    """The paths whose blocks are the page's text. scores: prose, links and whether once a page, by path of the template."""
    known: dict[int, tuple[float, float, bool]] = {}
    for path, d in page.paths.items():
        s = scores.get(signed(path))
        if s is None and own:
            s = (d.prose, d.links, d.n <= 1)
        if s is not None:
            known[path] = s
    mains = {p for p in known if page.paths[p].main}
    if not any(known[p][0] for p in mains):
        mains = set(known)
    best = max((known[p][0] for p in mains if known[p][2]), default=0) or max((known[p][0] for p in mains), default=0)
    slots: set[int] = set()
    for path, d in page.paths.items():  # a path comes after the one around it
        if path not in mains:
            continue
        prose, links, once = known[path]
        linky = links > 2 * prose and links > 0
        first = once and prose > 0 and prose >= 0.1 * best or prose >= best > 0
        nested = d.parent in slots or d.parent in mains and page.paths[d.parent].main
        if not linky and (first or nested) or d.main and not page.paths[d.parent].main:
            slots.add(path)
    return slots


def page_text(html: str, template: dict | None) -> str:
    """The text in the slots of a page, without the template's texts."""
    if template is None:
        return ""
    page = Blocks().done(html)
    if not page.blocks:
        return ""
    slots = slots_of(page, template["scores"], template["pages"] > 100)
    texts, repeated = template["texts"], Counter()
    blocks = [(path, text, bool(texts) and signed(text_token(path, text)) in texts) for path, text, _ in page.blocks if path in slots]
    mass: Counter = Counter()
    for path, text, again in blocks:
        mass[path] += len(text)
        repeated[path] += again * len(text)
    return "\n".join(text for path, text, again in blocks if not again or 3 * repeated[path] >= mass[path])


def extract(pages: DataFrame, *, least_pages: int = 5, most_share: float = 0.6) -> DataFrame:
    """(page_id, url, text) of every page."""
    found = written(templates(tokens_of(pages), least_pages=least_pages, most_share=most_share), "html-templates")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int | None, dict | None] = (None, None)
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch, out = whole.slice(k, 256), []
                hosts, htmls = batch.column(2).to_pylist(), batch.column(3).to_pylist()
                for i, (host, html) in enumerate(zip(hosts, htmls)):
                    if held[0] != host:
                        n = batch.column(4)[i].as_py()
                        paths, texts = batch.column(5)[i].as_py() or [], batch.column(6)[i].as_py() or []
                        held = host, None if n is None else {"pages": n, "scores": {x["token"]: (x["prose"], x["links"], x["once"]) for x in paths}, "texts": set(texts)}
                    out.append(page_text(html or "", held[1]))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    # A host is one row there; where it is not broadcast, Spark splits the pages of a hot host.
    rows = hosted(pages).join(found, "host", "left").select("page_id", "url", "host", "html", "pages", "paths", "texts")
    return rows.mapInArrow(walk, "page_id long, url string, text string")


def report(pages: DataFrame, **options) -> DataFrame:
    return extract(pages, **options).withColumn("n_chars", F.length("text").cast("long"))
