"""Records from stored HTML and embedded JSON."""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks of pages that ask whether a reader is a robot.
#: The word alone isn't one: ordinary pages name the service in their footer.
CHALLENGES = ('class="g-recaptcha"', "recaptcha/api2", "grecaptcha.render", "data-sitekey", "attention required", "cf-browser-verification", "are you a robot", "checking your browser", "access denied")


def title(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1), F.lit(""))


def link_paths(html: Column) -> Column:
    """Paths of links in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r'<a href="/([^"]+)"'), 1))


def has_next(html: Column) -> Column:
    """A link to the next page, or a next button that isn't disabled."""
    return html.rlike(r'(?i)<link[^>]+rel="next"') | html.rlike(r'(?i)<a[^>]*class="[^"]*next(?![^"]*disabled)[^"]*"')


def is_challenge(html: Column) -> Column:
    return F.exists(F.array(*map(F.lit, CHALLENGES)), lambda mark: F.lower(html).contains(mark))


def card_prices(html: Column, card: str = '<div class="card"') -> Column:
    """A map of id to price of a search page's cards.

    Each card is read by itself, so a price outside of cards goes to none. An id counts only if the card links to it;
    cards without a price in figures have null, and of cards with one id the last counts.
    """
    parts = F.split(html, card)
    cards = F.slice(parts, F.lit(2), F.size(parts))
    read = F.transform(
        cards,
        lambda c: F.struct(
            F.nullif(F.regexp_extract(c, r'data-id="(\d+)"', 1), F.lit("")).try_cast("long").alias("id"),
            F.regexp_replace(F.regexp_extract(c, r'(?s)class="price">([^<]*)<', 1), r"[^0-9]", "").try_cast("long").alias("price"),
            F.regexp_extract_all(c, F.lit(r'href="[^"]*?/(\d+)"'), 1).alias("links"),
        ),
    )
    sound = F.filter(read, lambda x: F.coalesce(F.array_contains(x["links"], x["id"].cast("string")), F.lit(False)))
    last = F.filter(sound, lambda x, i: ~F.exists(F.slice(sound, i + 2, F.size(sound)), lambda y: y["id"] == x["id"]))
    return F.map_from_entries(F.transform(last, lambda x: F.struct(x["id"], x["price"])))


def listing_record(html: Column) -> Column:
    """title, price, area, floor, total_floors, lat and lon of a listing's page; what is missing or malformed is null."""
    found = lambda pattern, i=1: F.nullif(F.regexp_extract(html, pattern, i), F.lit(""))
    floor = r"(?s)<dt>Floor</dt>\s*<dd>\s*(\d+)(?:\s*(?:of|/)\s*(\d+))?"
    return F.struct(
        F.trim(found(r"(?s)<h1[^>]*>(.*?)</h1>")).alias("title"),
        F.regexp_replace(found(r'(?s)class="offer__price"[^>]*>([^<]*)<'), r"[^0-9]", "").try_cast("long").alias("price"),
        F.replace(found(r"(?s)<dt>Area</dt>\s*<dd>\s*([\d.,]+)"), F.lit(","), F.lit(".")).try_cast("double").alias("area"),
        found(floor).try_cast("int").alias("floor"),
        found(floor, 2).try_cast("int").alias("total_floors"),
        found(r'"lat":\s*(-?[\d.]+)').try_cast("double").alias("lat"),
        found(r'"lon":\s*(-?[\d.]+)').try_cast("double").alias("lon"),
    )


def tokens(html: Column) -> Column:
    """An array of tag (small letters, with a slash for an end), attributes (a map, whatever their order and quotes) and the
    text behind it with single blanks, in the order of the page; what scripts, styles and comments hold is left out."""
    seen = F.regexp_replace(html, r"(?is)<!--.*?-->|(<(script|style)\b[^>]*>).*?(</\2\s*>|$)", "$1$3")
    raw = F.regexp_extract_all(seen, F.lit(r"""(?s)(</?[A-Za-z](?:[^>"']|"[^"]*"|'[^']*')*>[^<]*)"""), 1)
    pairs = r"""([^\s"'<>/=]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""

    def token(x: Column) -> Column:
        head = F.regexp_extract(x, r"""(?s)^(<(?:[^>"']|"[^"]*"|'[^']*')*>)""", 1)
        names = F.transform(F.regexp_extract_all(head, F.lit(pairs), 1), F.lower)
        values = F.transform(F.regexp_extract_all(head, F.lit(pairs), 2), lambda v: F.regexp_replace(v, r"""^["']|["']$""", ""))
        both = F.arrays_zip(names.alias("k"), values.alias("v"))
        # Of an attribute that comes twice the first counts.
        first = F.filter(F.transform(both, lambda p, i: F.struct(p["k"].alias("k"), p["v"].alias("v"), i.alias("i"))), lambda p: F.array_position(names, p["k"]) == p["i"] + 1)
        text = F.trim(F.regexp_replace(F.substring(x, F.length(head) + 1, F.length(x)), r"\s+", " "))
        return F.struct(F.lower(F.regexp_extract(head, r"^<(/?[A-Za-z][^\s/>]*)", 1)).alias("tag"), F.map_from_entries(F.transform(first, lambda p: F.struct(p["k"], p["v"]))).alias("attributes"), text.alias("text"))

    return F.transform(raw, token)


def typed(html: Column) -> Column:
    """A page's record: lang, charset, title, heading, paragraphs, links, and the first text of each class; of null null."""
    seen = tokens(html)
    of = lambda tag: F.filter(seen, lambda x: x["tag"] == tag)
    first = lambda found, part: F.get(F.transform(found, part), F.lit(0))
    attribute = lambda name: lambda x: F.element_at(x["attributes"], name)
    named = F.filter(seen, lambda x: F.element_at(x["attributes"], "class").isNotNull() & ~x["tag"].startswith("/"))
    classes = F.transform(named, attribute("class"))
    firsts = F.filter(F.transform(named, lambda x, i: F.struct(F.element_at(x["attributes"], "class").alias("k"), x["text"].alias("v"), i.alias("i"))), lambda p: F.array_position(classes, p["k"]) == p["i"] + 1)
    return F.struct(
        first(of("html"), attribute("lang")).alias("lang"),
        first(F.filter(of("meta"), lambda x: F.element_at(x["attributes"], "charset").isNotNull()), attribute("charset")).alias("charset"),
        first(of("title"), lambda x: x["text"]).alias("title"),
        first(of("h1"), lambda x: x["text"]).alias("heading"),
        F.when(html.isNotNull(), F.size(of("p"))).alias("paragraphs"),
        F.filter(F.transform(of("a"), attribute("href")), lambda h: h.isNotNull()).alias("links"),
        F.map_from_entries(F.transform(firsts, lambda p: F.struct(p["k"], p["v"]))).alias("by_class"),
    )


def page_id(url: Column) -> tuple[Column, Column]:
    """(canonical address without query and fragment, last number of the path)."""
    base = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^https?://(m\.|www\.)?", "")
    return base, F.nullif(F.regexp_extract(base, r"/(\d+)/?$", 1), F.lit("")).try_cast("long")


def sitemap(xml: Column, within: str) -> Column:
    """Addresses of a sitemap that hold a text."""
    return F.filter(F.regexp_extract_all(xml, F.lit(r"<loc>([^<]+)</loc>"), 1), lambda u: u.contains(within))


class _Page(HTMLParser):
    """Text of headings and paragraphs, and texts by ``data-name``; scripts, styles and menus are left out."""

    def __init__(self) -> None:
        super().__init__()
        self.skip = self.paragraphs = 0
        self.heading: list[str] = []
        self.body: list[str] = []
        self.names: dict[str, str] = {}
        self.within: list[str] = []
        self.name: str | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style", "nav"):
            self.skip += 1
        self.paragraphs += tag == "p"
        if tag in ("h1", "p", "title"):
            self.within.append(tag)
        self.name = dict(attrs).get("data-name", self.name)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style", "nav"):
            self.skip = max(0, self.skip - 1)
        if tag in self.within:
            del self.within[len(self.within) - 1 - self.within[::-1].index(tag) :]

    def handle_data(self, data: str) -> None:
        if self.skip:
            return
        if self.name and data.strip():
            self.names.setdefault(self.name, data.strip())
            self.name = None
        if "h1" in self.within:
            self.heading.append(data)
        elif "p" in self.within:
            self.body.append(data)


def window_json(html: str, name: str = "window.data") -> dict | None:
    """The JSON object that a script assigns to a name; it ends where its outer brace closes."""
    at = html.find(name)
    at = html.find("{", at) if at >= 0 else -1
    if at < 0:
        return None
    try:
        value, _ = json.JSONDecoder().raw_decode(html, at)
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def details(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, heading, paragraphs, n_words, params and data (embedded JSON as text) of each page; null html gives nulls."""
    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, html in zip(frame["page_id"], frame["html"], strict=True):
                if html is None:
                    rows.append((key, None, None, None, {}, None))
                    continue
                page = _Page()
                page.feed(html)
                data = window_json(html)
                rows.append((key, " ".join("".join(page.heading).split()), page.paragraphs, len(" ".join(page.body).split()), page.names, json.dumps(data, sort_keys=True) if data is not None else None))
            yield pd.DataFrame(rows, columns=["page_id", "heading", "paragraphs", "n_words", "params", "data"]).astype({"paragraphs": "Int64", "n_words": "Int64"})

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html"))
    return rows.mapInPandas(parse, "page_id long, heading string, paragraphs long, n_words long, params map<string,string>, data string")
