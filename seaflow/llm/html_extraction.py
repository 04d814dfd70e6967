"""Main text of web pages by template deduction over the pages of a host.

A page is read as tokens: its start tags with their place in the tree (names, ids and classes of the elements around
them), and, for each block element that occurs once in the page and isn't named as content, its place with a hash of all
text below it (in named content only elements that group others: a paragraph that recurs there is prose). Tokens whose counts agree on every page of a host form an equivalence class. Its occurrence vector is
kept as the number of pages and a sum of hashes of (page, count), which folds before the shuffle, so a host may hold any
share of all pages. A class is valid if it occurs on ``SUPPORT`` of the host's pages and on ``LEAST_PAGES`` at least. The
valid classes, nested by the places of their tokens, are the template; text of the template is what a valid class holds
with its hash: an element outside named content that reads the same on those pages. It goes, whatever its name. What
lies between the tags of the template and varies are its slots.

The text of a page is that of the slots that are most clearly named as content (article, then main, then an id or class
such as content or post), of all of them in page order, an outer one including those within it; of a host without such
slots, of all slots. Within it, what is set aside by element or role (menus, footers, forms, scripts ...), or by an id or
class of one word (such as ad or comments), goes. An id or class of several words (such as comment-list or related-work)
only sets aside what belongs to the template, since an author may name a paragraph so. A host of fewer than three
pages has no template; its pages, and those that lack the slots of their host, are read by names alone, several words
included, in the same order of preference, of several elements the one with the most text; so are pages that hold only
text of the template. Nothing else is left out: a paragraph in named content stays, however many pages share it.

Character references are decoded, white space in a block becomes one space, blocks are joined by a line end. Defined
results: null html is empty and gives an empty text, as does a page without main text; a null url is a host of its own
whose pages have no template; html that ends early is read as far as it goes; rows that repeat a page count once in
the template. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seaflow.llm.storage import written

SUPPORT, LEAST_PAGES = 0.8, 3
PLACE_CHARS = 400

# Elements by their meaning in HTML.
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "title", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl",
    "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header",
    "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "select", "summary",
    "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
PROSE = {"blockquote", "caption", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "p", "pre"}
REPEATED = {"li", "option", "dd", "dt", "tr", "td", "th"}
CLOSES_P = BLOCKS - {"body", "head", "html", "li", "option", "td", "th", "tr", "dd", "dt", "tbody", "thead", "tfoot"}
ASIDE = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "input", "label", "fieldset", "head"}
ASIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form", "menu"}
ASIDE_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment",
    "comments", "commentlist", "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "masthead", "menu", "modal",
    "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pagination", "popup", "promo", "promoted",
    "promotion", "related", "replies", "reply", "respond", "share", "sharing", "sidebar", "signup", "social",
    "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "widget", "widgets",
}
CONTENT_WORDS = {"article", "content", "entry", "main", "post", "story"}

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)""", re.DOTALL
)
_ATTRIBUTE = re.compile(r"""(id|class|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_HIDDEN = re.compile(r"""(?<![\w-])hidden(?![\w-])|display\s*:\s*none""", re.IGNORECASE)
_PARTS = re.compile(r"[a-z0-9]+")


@dataclass
class Element:
    name: str
    token: str  # place in the tree
    aside: bool  # itself or by an element around it
    in_article: bool
    rank: int  # how clearly it is named as content: 0 article, 1 main, 2 by id or class, 3 not at all
    in_content: bool = False  # in an element named as content
    phrased: bool = False  # set aside by a name of several words alone
    content: bytes = b""  # hash of the text below it, as far as it is read


def _hash(*parts: bytes) -> bytes:
    return hashlib.blake2b(b"\0".join(parts), digest_size=8).digest()


def _events(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", "", text), ("open", name, attributes) and ("close", name, "") in page order."""
    at = 0
    while at < len(page):
        found = _TAG.search(page, at)
        if not found:
            yield "text", "", page[at:]
            return
        if found.start() > at:
            yield "text", "", page[at : found.start()]
        at = max(found.end(), found.start() + 1)
        if not found[2]:
            continue
        name = found[2].lower()
        if found[1]:
            yield "close", name, ""
            continue
        yield "open", name, found[3] or ""
        if name in RAW and not (found[3] or "").endswith("/"):
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>|\Z", re.IGNORECASE).search(page, at)
            at = max(end.end(), at)
            yield "close", name, ""


@dataclass(frozen=True)
class Template:
    """What the valid classes of a host say: places of its main slots, of its own text, and of parts that are set aside
    by a name of several words."""

    slots: frozenset[str]
    fixed: frozenset[str]
    phrased: frozenset[str]


def _element(name: str, attributes: str, parent: Element, template: Template | None) -> Element:
    found = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in _ATTRIBUTE.finditer(attributes)}
    # The words of ids and classes, without numbers that tell one element from the next.
    words = {w for key in ("id", "class") for w in _PARTS.findall(found.get(key, ""))}
    names = "".join(f".{w}" for w in sorted(words) if not w.isdigit())
    around = parent.token
    if len(around) > PLACE_CHARS:  # deep places go on from a hash of what is above
        around = "#" + hashlib.blake2b(around.encode(), digest_size=16).hexdigest()
    token = f"{around}/{name}{names}"
    aside = (
        name in ASIDE
        or name in RAW
        or parent.aside
        or (name == "header" and not parent.in_article)
        or found.get("role") in ASIDE_ROLES
        or bool(_HIDDEN.search(attributes))
        or (template is not None and token in template.fixed)
    )
    phrased = False
    if not aside and words & ASIDE_WORDS and name not in ("html", "body", "article", "main"):
        whole = {w for key in ("id", "class") for w in found.get(key, "").split()}
        phrased = not whole & ASIDE_WORDS
        aside = not phrased or template is None or token in template.phrased
    if name == "article":
        rank = 0
    elif name == "main" or found.get("role") == "main":
        rank = 1
    elif words & CONTENT_WORDS and name in BLOCKS:
        rank = 2
    else:
        rank = 3
    in_content = parent.in_content or (parent.name != "" and parent.rank < 3)
    return Element(name, token, aside, parent.in_article or name == "article", rank, in_content, phrased)


class Page:
    """The elements of a page and the text blocks below each; without a template, all names set text aside."""

    def __init__(self, page: str | None, template: Template | None = None):
        self.tokens: Counter[str] = Counter()
        self.ranks: dict[str, int] = {}
        self.contents: dict[str, bytes] = {}  # hash of the text below elements that aren't named as content
        self.phrased: set[str] = set()
        self.blocks: list[tuple[tuple[str, ...], str]] = []  # places of content around a block, and its text
        stack, piece = [Element("", "", False, False, 2)], []
        opened: Counter[str] = Counter()

        def flush() -> None:
            text = " ".join(entities.unescape("".join(piece)).split())
            piece.clear()
            if text:
                stack[-1].content = _hash(stack[-1].content, text.encode("utf-8", "replace"))
                self.blocks.append((tuple(e.token for e in stack if e.rank < 3), text))

        def left(gone: Element) -> None:
            if gone.content and not gone.aside:
                stack[-1].content = _hash(stack[-1].content, gone.content)
                if gone.rank == 3 and not (gone.in_content and gone.name in PROSE):
                    self.contents[gone.token] = gone.content

        def close(name: str) -> None:
            while True:
                gone = stack.pop()
                opened[gone.name] -= 1
                left(gone)
                if gone.name == name:
                    return

        for kind, name, rest in _events(page or ""):
            if kind == "text":
                if not stack[-1].aside:
                    piece.append(rest)
                continue
            if name in BLOCKS:
                flush()
            elif name == "br":
                piece.append(" ")
            if kind == "close":
                if opened[name]:
                    close(name)
                continue
            if name in CLOSES_P and opened["p"]:
                close("p")  # an open paragraph ends where a block begins
            elif name in REPEATED and stack[-1].name == name:
                close(name)
            element = _element(name, rest, stack[-1], template)
            self.tokens[element.token] += 1
            if element.phrased:
                self.phrased.add(element.token)
            if not element.aside:
                self.ranks.setdefault(element.token, element.rank)
            # Elements within a line matter only where they set their text aside.
            if name not in VOID and not rest.endswith("/") and (name in BLOCKS or element.aside):
                stack.append(element)
                opened[name] += 1
        flush()
        while len(stack) > 1:
            left(stack.pop())

    def text_below(self, *wanted: str) -> str:
        return "\n".join(text for places, text in self.blocks if any(place in places for place in wanted))

    def text_of(self, template: Template) -> str:
        """The text of the template's slots, or of the best place of a page that has none of them."""
        present = template.slots & self.ranks.keys() if template.slots != {""} else {""}
        return self.text_below(*(present or [self.best_place()]))

    def varied(self) -> Counter[str]:
        """Characters of text below each element that is named as content."""
        found: Counter[str] = Counter()
        for places, text in self.blocks:
            for place in set(places):
                found[place] += len(text)
        return found

    def best_place(self) -> str:
        """The place of the main text, from this page alone."""
        varied = self.varied()
        named = [(rank, -varied[p], len(p), p) for p, rank in self.ranks.items() if rank < 3 and varied[p]]
        return min(named)[-1] if named else ""


# Ranks of tokens that aren't content: elements set aside by a name of several words, and elements with their text.
PHRASED, FIXED = 7, 8
_TOKENS = "host string, token string, page long, n int, rank int, n_chars long"


def _token_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for host, key, text in zip(*(c.to_pylist() for c in batch.columns)):
            page = Page(text)
            varied = page.varied()
            rows += [
                {"host": host, "token": t, "page": key, "n": n, "rank": PHRASED if t in page.phrased else page.ranks.get(t, 9), "n_chars": varied[t]}
                for t, n in page.tokens.items()
            ]
            rows += [
                {"host": host, "token": f"{t}={content.hex()}", "page": key, "n": 1, "rank": FIXED, "n_chars": 0}
                for t, content in page.contents.items()
                if page.tokens[t] == 1
            ]
        kinds = pa.schema(
            [("host", pa.string()), ("token", pa.string()), ("page", pa.int64()), ("n", pa.int32()), ("rank", pa.int32()), ("n_chars", pa.int64())]
        )
        yield pa.RecordBatch.from_pylist(rows, schema=kinds)


def _hosted(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))
    return pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))


def classes(pages: DataFrame) -> DataFrame:
    """The equivalence classes of each host: host, vector (hash of the occurrence vector), n_pages, host_pages, once
    (one occurrence a page), and tokens (place, rank, n_chars of text below)."""
    hosted = _hosted(pages).filter("host <> ''")
    tokens = hosted.select("host", F.xxhash64("html").alias("page"), "html").mapInArrow(_token_batches, _TOKENS)
    counted = tokens.groupBy("host", "token", "page").agg(
        F.max("n").alias("n"), F.min("rank").alias("rank"), F.max("n_chars").alias("n_chars")
    )
    # Sums of decimals don't overflow, and don't depend on the order of rows.
    hashed = F.xxhash64("page", "n").cast("decimal(20,0)")
    vectors = counted.groupBy("host", "token").agg(
        F.count("*").alias("n_pages"),
        F.sum(hashed).alias("vector"),
        F.max("n").alias("most"),
        F.min("rank").alias("rank"),
        F.sum("n_chars").alias("n_chars"),
    )
    host_pages = hosted.groupBy("host").agg(F.count_distinct(F.xxhash64("html")).alias("host_pages"))
    return (
        vectors.groupBy("host", "vector", "n_pages", (F.col("most") == 1).alias("once"))
        .agg(F.collect_list(F.struct("rank", "n_chars", "token")).alias("tokens"))
        .join(host_pages, "host")
    )


_KINDS = pa.schema([("host", pa.string()), *((k, pa.list_(pa.string())) for k in ("slots", "fixed", "phrased"))])


def _nested(tokens: list[dict]) -> Template:
    """The template that the tokens of a host's valid classes make, nested by their places."""
    fixed = {t["token"].rpartition("=")[0] for t in tokens if t["rank"] == FIXED}
    named = [t for t in tokens if t["rank"] < 3 and t["once"] and t["n_chars"] > 0]
    best = min((t["rank"] for t in named), default=3)
    content = {t["token"] for t in named}
    slots = {t["token"] for t in named if t["rank"] == best} or {""}
    # What holds named content isn't text of the template, though it may read the same on most pages.
    fixed = {f for f in fixed if not any(c.startswith(f + "/") for c in content)}
    return Template(frozenset(slots), frozenset(fixed), frozenset(t["token"] for t in tokens if t["rank"] == PHRASED))


def _nesting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for host, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = _nested(tokens)
            rows.append({"host": host, **{k: sorted(getattr(found, k)) for k in ("slots", "fixed", "phrased")}})
        yield pa.RecordBatch.from_pylist(rows, schema=_KINDS)


def templates(pages: DataFrame) -> DataFrame:
    """host, and places of its main slots, of its own text and of its parts with a name of several words, for hosts that
    have a template. A host's valid tokens are no more than the elements of its pages, so they fit one row."""
    valid = classes(pages).filter(f"n_pages >= {LEAST_PAGES} and n_pages >= {SUPPORT} * host_pages")
    tokens = valid.select("host", F.inline("tokens"), "once")
    # A null isn't collected: a host whose template has no such token keeps an empty list.
    wanted = F.when(F.col("rank") < 9, F.struct("rank", "n_chars", "token", "once"))
    collected = tokens.groupBy("host").agg(F.collect_list(wanted).alias("tokens"))
    return collected.mapInArrow(_nesting, "host string, slots array<string>, fixed array<string>, phrased array<string>")


def _extracting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for text, *places in zip(*(batch.column(n).to_pylist() for n in range(2, 6))):
            if places[0] is None:
                page = Page(text)
                found.append(page.text_below(page.best_place()))
            else:
                template = Template(*map(frozenset, places))
                own = Page(text, template).text_of(template)
                if not own:  # nothing but the text of the template: what is there by names
                    page = Page(text)
                    own = page.text_below(page.best_place())
                found.append(own)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(found, pa.string())], names=["page_id", "url", "text"]
        )


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and the main text of every page."""
    places = written(templates(pages), "templates")
    hosted = _hosted(pages)
    joined = hosted.join(places, "host", "left").select("page_id", "url", "html", "slots", "fixed", "phrased")
    kind = hosted.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(_extracting, f"page_id {kind}, url string, text string")
