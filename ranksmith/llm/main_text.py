"""Main text of web pages by equivalence-class template deduction.

A page is a sequence of tokens: start tags, told apart by the elements they
stand in, and the text runs between tags.  Over the distinct pages of a host
every token has an occurrence vector, its count on each page.  Tokens that
share the vector form a class, kept here as an order-independent digest of the
vector, so that a host of any size is summed up token by token and no page
list is gathered.  A class is large (``MIN_TOKENS``) and frequent
(``MIN_PAGES`` and half of the host's distinct pages) or no evidence.  It is valid if
its tokens come in one order on every page and its spans nest with those of
the other classes; of two that cross, the one on fewer pages goes.  The valid
classes are the host's template; what lies between its tokens are slots.

Extraction drops the template's texts and keeps the slots in page order, but
for those in elements that markup names as navigation, notice, advert, form
and the like (``BOILERPLATE``).  Where a page marks its article (``article``,
else ``main``), the slots in it are the text, and repeated passages in it are
the author's and stay.  Character references are decoded, white space (as
Unicode has it) in a block becomes one space, blocks are joined by a line break.

Hot hosts: pages of a host are merged as (host, token) sums before the
shuffle; equal pages count once.  Templates are joined to the pages by host,
broadcast if they all are under ``BROADCAST_BYTES``, otherwise by a shuffle.

Defined results: null or empty pages, and pages without main text, have the
text ``''``; pages without a host in their url, and of a host with too few
distinct pages, go by their own markup; pages are read whole; unclosed,
crossing and truncated tags follow the nearest open element; repeated rows
each get a result; an empty table gives an empty result.  Other columns are
not read.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ranksmith.session import ship_package

from .common import staged

MIN_PAGES, MIN_TOKENS = 3, 2
BROADCAST_BYTES = 32 << 20
#: Words of an element's name, class, id or role that mark what is not main text.
BOILERPLATE = frozenset("""
 ad ads advert adverts advertisement advertising adsense sponsor sponsored promo banner
 nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toolbar
 footer sidebar aside widget widgets complementary contentinfo
 cookie cookies consent notice alert popup modal dialog overlay newsletter subscribe subscription signup login
 comment comments commentlist reply replies respond disqus share sharing social related recommended
""".split())
#: Words that mark the head of a page, or of an article if they stand in one.
HEADS = frozenset(["header", "masthead"])
#: Words that mark a layout, whatever its other words.
LAYOUT = frozenset("main content article post body page wrapper container layout has no with".split())
#: Elements by kind.
_DROPPED = frozenset("""nav footer aside form button select option textarea input label fieldset dialog menu iframe
 object embed svg canvas audio video map head title noscript template script style""".split())
_RAW = frozenset("script style textarea noscript template iframe xmp title".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("""a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q ruby rp rt s
 samp small span strike strong sub sup time tt u var wbr button input label select textarea script style template noscript""".split())
#: Elements that end an open one of the same group, up to the element around the group.
_ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
         "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr",), ("table",)),
         "option": (("option",), ("select",))}
_WHOLE_LAYOUT = ("html", "body", "main", "article")
_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]++|"[^"<]*"|'[^'<]*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"""
                     r"""|<[!?/][^>]*>|<[a-zA-Z!?/][^>]*\Z""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|style)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=/]|$)", re.I)
_BETWEEN_WORDS = re.compile(r"[^a-z0-9]+")


#: Elements without any of these attributes go by their names.
_TELLING = re.compile(r"class|id|role|style|hidden", re.I)


@lru_cache(1 << 10)
def _plain(tag: str) -> tuple[str, str, bool]:
    return _kind(tag, "")


@lru_cache(1 << 14)
def _kind(tag: str, attributes: str) -> tuple[str, str, bool]:
    """What an element is, the text that tells its token from others, and
    whether it is an article by role: kinds are ``drop``, ``head`` or ``''``."""
    named = {k.lower(): v.strip("\"'").lower() for k, v in _ATTRIBUTE.findall(attributes)}
    mark = f"{tag} {named.get('class', '')} {named.get('id', '')}"
    if tag in _DROPPED or _HIDDEN.search(attributes) or "display:none" in named.get("style", "").replace(" ", ""):
        return "drop", mark, False
    words = {w for k in ("class", "id", "role") for w in _BETWEEN_WORDS.split(named.get(k, ""))}
    if tag not in _WHOLE_LAYOUT or (words & {"comment", "comments"}):
        if words & BOILERPLATE and not words & LAYOUT - {"post", "article", "page"} or words & {"comment", "comments"}:
            return "drop", mark, False
        if tag == "header" or words & HEADS and not words & LAYOUT - {"page"}:
            return "head", mark, False
    return "", mark, named.get("role") in ("main", "article")


def _signed(text: str, path: int) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace"), path & 0x7FFFFFFF) - (1 << 63)


_path_below = lru_cache(1 << 14)(_signed)


def run_token(text: str, path: int) -> int:
    return _signed(" ".join(text.split()), path)


class Page:
    """A page's tokens in order (``tokens``, if asked for), and its text runs:
    ``runs`` holds (block, path, text, dropped, in article, in main)."""

    def __init__(self, source: str, tokens: bool = False):
        self.tokens: list[int] | None = [] if tokens else None
        self.runs: list[tuple] = []
        # name, path, dropped, in article, in main of each open element
        self._open: list[tuple] = [("", 0, False, False, False)]
        self._names: Counter = Counter()
        self._block = 0
        at = 0
        while at is not None:
            at = self._read(source, at)

    def _read(self, source: str, at: int) -> int | None:
        """Read on from ``at``; where an element of raw text starts, the place
        to go on from."""
        for found in _MARKUP.finditer(source, at):
            start = found.start()
            if start > at:
                self._text(source[at:start])
            at = found.end()
            closing, name, attributes, broken_closing, broken, rest = found.groups()
            name = name or broken
            if name is None:
                continue
            name = name.lower()
            if closing or broken_closing:
                self._end(name)
            elif self._start(name, attributes or rest or ""):
                stop = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.I).search(source, at)
                return stop.start() if stop else None
        if at < len(source):
            self._text(source[at:])
        return None

    def _text(self, text: str) -> None:
        around = self._open[-1]
        self.runs.append((self._block, around[1], text, *around[2:]))
        if self.tokens is not None and not text.isspace():
            self.tokens.append(run_token(text, around[1]))

    def _start(self, name: str, attributes: str) -> bool:
        if name not in _INLINE:
            self._block += 1
            if self._names["p"]:
                self._end("p")
            if name in _ENDS:
                group, around = _ENDS[name]
                for own, *_ in reversed(self._open):
                    if own in around:
                        break
                    if own in group:
                        self._end(own)
                        break
        elif name == "br":
            self.runs.append((self._block, 0, " ", False, False, False))
        kind, mark, is_main = _kind(name, attributes) if attributes and _TELLING.search(attributes) else _plain(name)
        _, path, dropped, article, main = self._open[-1]
        path = _path_below(mark, path)
        if self.tokens is not None:
            self.tokens.append(path)
        if name in _VOID or attributes.endswith("/") and name not in _INLINE:
            return False
        article = article or name == "article"
        dropped = dropped or kind == "drop" or kind == "head" and not article
        self._open.append((name, path, dropped, article, main or name == "main" or is_main))
        self._names[name] += 1
        return name in _RAW

    def _end(self, name: str) -> None:
        if name not in _INLINE:
            self._block += 1
        if self._names[name]:
            while True:
                own = self._open.pop()[0]
                self._names[own] -= 1
                if own == name:
                    break

    def text(self, template: frozenset | set = frozenset()) -> str:
        """The main text: slots that are neither dropped nor template."""
        shown = [r for r in self.runs if not r[3]]
        told = [r for r in shown if not r[2].isspace()]
        inside = 4 if any(r[4] for r in told) else 5 if any(r[5] for r in told) else None
        blocks: dict[int, list[str]] = {}
        for r in shown:
            if r[2].isspace():
                blocks.setdefault(r[0], []).append(" ")
            elif r[inside] if inside else not template or run_token(r[2], r[1]) not in template:
                blocks.setdefault(r[0], []).append(r[2])
        joined = (" ".join(html_lib.unescape("".join(parts)).split()) for parts in blocks.values())
        return "\n".join(b for b in joined if b)


def host_of(url: Column) -> Column:
    """The url's host in lower case, null if it has none."""
    host = F.lower(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def _given(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    u = F.col(f"`{url}`").cast("string")
    return pages.select(F.col(f"`{page_id}`").alias("page_id"), u.alias("url"), F.col(f"`{html}`").cast("string").alias("html"),
                        F.xxhash64(host_of(u)).alias("host"), host_of(u).isNotNull().alias("hosted"))


def token_pages(given: DataFrame) -> DataFrame:
    """(host, page, tokens): the distinct token sequences of each host, as
    packed 64-bit numbers, and their digest."""
    def run(batches):
        for batch in batches:
            packed = [np.array(Page(h.as_py() or "", tokens=True).tokens, "<i8").tobytes() for h in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["host", "tokens"])

    packed = given.where("hosted").select("host", "html").mapInArrow(run, "host long, tokens binary")
    return staged(packed.withColumn("page", F.xxhash64("tokens")).dropDuplicates(["host", "page"]), "token-pages")


def classes(sequences: DataFrame) -> DataFrame:
    """(host, token, class, place, size, n_pages): tokens of the large and
    frequent classes, in the order of their first places."""
    def count(batches):
        for batch in batches:
            hosts, pages, tokens, times, first = [], [], [], [], []
            for i, t in enumerate(batch.column(1)):
                token, at, n = np.unique(np.frombuffer(t.as_py(), "<i8"), return_index=True, return_counts=True)
                hosts.append(np.full(len(token), batch.column(0)[i].as_py()))
                pages.append(np.full(len(token), batch.column(2)[i].as_py()))
                tokens.append(token), times.append(n), first.append(at)
            if hosts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in (hosts, pages, tokens, times, first)],
                                                 names=["host", "page", "token", "times", "first"])

    seen = sequences.select("host", "tokens", "page").mapInArrow(count, "host long, page long, token long, times long, first long")
    # The vector's digest: sums that wrap around would fail in ANSI mode, so
    # they are taken over 31 bits of each page's hash, twice.
    part = lambda s: F.sum(F.xxhash64(F.lit(s), "page", "times").bitwiseAND(0x7FFFFFFF)).alias(f"d{s}")
    vectors = seen.groupBy("host", "token").agg(part(1), part(2), F.count(F.lit(1)).alias("n_pages"), F.sum("times").alias("times"),
                                                F.sum("first").alias("first"))
    sizes = sequences.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    frequent = staged(vectors.where(F.col("n_pages") >= MIN_PAGES).join(sizes, "host").where("2 * n_pages >= host_pages"), "vectors")
    own = ["host", "d1", "d2", "n_pages", "times"]
    place = Window.partitionBy(*own).orderBy("first", "token")
    return (frequent.withColumn("place", F.row_number().over(place) - 1)
            .withColumn("size", F.count(F.lit(1)).over(Window.partitionBy(*own))).where(F.col("size") >= MIN_TOKENS)
            .select("host", "token", F.xxhash64(*own).alias("class"), "place", "size", "n_pages"))


def crossing(tokens: np.ndarray, known: dict[int, tuple]) -> set[int]:
    """Classes that this page's tokens show to be out of order, or to cross
    one that is on more pages.  ``known``: token -> (class, place, size, pages)."""
    due: dict[int, int] = {}
    stack: list[tuple] = []
    bad: set[int] = set()
    for token in tokens.tolist():
        hit = known.get(token)
        if hit is None or hit[0] in bad:
            continue
        own, place, size, pages = hit
        if place != due.get(own, 0):
            bad.add(own)
            continue
        due[own] = (place + 1) % size
        if place == 0:
            stack.append((pages, size, own))
        if place == size - 1:
            while stack and stack[-1][2] != own:
                other = stack.pop()
                if other[2] not in bad:
                    if other >= (pages, size, own):
                        bad.add(own)
                        stack.append(other)
                        break
                    bad.add(other[2])
            if stack and stack[-1][2] == own:
                stack.pop()
    return bad | {c for c, at in due.items() if at}


def _packed_by_host(rows: DataFrame, fields: list[str]) -> DataFrame:
    return rows.groupBy("host").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("known"))


def _sized(table: DataFrame, rows_bytes: int) -> DataFrame:
    """``table``, broadcast if its rows of so many bytes are few enough."""
    held = table.agg(F.sum(F.size("known"))).first()[0] or 0
    return F.broadcast(table) if held * rows_bytes <= BROADCAST_BYTES else table


def templates(sequences: DataFrame) -> DataFrame:
    """(host, known): the tokens of each host's valid classes.  A host has no
    more of them than its shortest frequent pages have tokens."""
    found = staged(classes(sequences), "classes")
    by_host = staged(_packed_by_host(found, ["token", "class", "place", "size", "n_pages"]), "host-classes")

    def run(batches):
        bad: set[tuple[int, int]] = set()
        tables: dict[int, dict] = {}
        for batch in batches:
            for host, tokens, known in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if host not in tables:
                    if len(tables) > 64:
                        tables.clear()
                    tables[host] = {k["token"]: (k["class"], k["place"], k["size"], k["n_pages"]) for k in known.as_py()}
                bad.update((host, c) for c in crossing(np.frombuffer(tokens.as_py(), "<i8"), tables[host]))
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in bad], pa.int64()), pa.array([c for _, c in bad], pa.int64())],
                                         names=["host", "class"])

    joined = sequences.select("host", "tokens").join(_sized(by_host, 40), "host")
    bad = joined.select("host", "tokens", "known").mapInArrow(run, "host long, class long").distinct()
    valid = found.join(bad, ["host", "class"], "left_anti").select("host", "token")
    return staged(valid.groupBy("host").agg(F.sort_array(F.collect_list("token")).alias("known")), "templates")


def main_texts(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text and n_chars."""
    ship_package(pages.sparkSession)
    given = _given(pages, page_id, url, html)
    known = templates(token_pages(given))
    joined = given.join(_sized(known, 8), "host", "left").select("page_id", "url", "html", "known")

    def run(batches):
        for batch in batches:
            texts = [Page(h.as_py() or "").text(frozenset(k.as_py() or ())) for h, k in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    kind = joined.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string").withColumn("n_chars", F.char_length("text").cast("long"))
