"""Text scalars: grounding, HTML, titles, labels."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# the space characters (Unicode's Zs), which SQL's trim takes off
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
# fixed values: words that mark news of a funding
FUNDING_WORDS = ["raised", "raises", "funding", "seed", "series a", "series b", "series c", "series d", "series e", "valuation", "closes", "led by"]
# fixed values: phrases of domains for sale
LANDER = ["this domain is for sale", "this domain name is for sale", "domain may be for sale", "buy this domain", "purchase this domain", "inquire about this domain", "is parked free", "parked domain", "domain parking"]
# fixed values: what else marks a parked page: phrases, and brands beside an offer; and the pattern of a domain that is for sale
PARKED = [
    "this domain is for sale", "domain is for sale", "domain name is for sale", "domain for sale", "domain may be for sale", "buy this domain", "purchase this domain", "is parked free",
    "parked domain", "domain parking", "domain marketplace", "this site is for sale", "this website is for sale", "available for purchase", "inquire about this domain",
]
BRANDS = ["spaceship.com", "godaddy", "sedo.com", "afternic", "dan.com", "hugedomains", "atom.com", "saw.com", "squadhelp", "namecheap", "porkbun", "reg.ai"]
OFFERS = ["for sale", "buy now", "make an offer", "make offer"]
DOMAIN_FOR_SALE = r"\b[a-z0-9][a-z0-9-]*(?:\.[a-z0-9-]+)*\.[a-z]{2,}\s+is\s+for\s+sale\b"
FRAGMENT = 12


def funding_words(text: Column) -> Column:
    pattern = "|".join(r"[\s\-]+".join(w.split()) for w in FUNDING_WORDS)
    return F.lower(text).rlike(rf"\b(?:{pattern})\b")


def for_sale(text: Column) -> Column:
    low = F.lower(text)
    hit = low.rlike(r"\b[a-z0-9-]+\.(?:com|net|org|io|co|ai) is for sale\b")
    for phrase in LANDER:
        hit = hit | low.contains(phrase)
    return hit


def parked(text: Column) -> Column:
    """A candidate page's text reads as a parked domain's; lenient, as a page that is refused wrongly costs little. Null text is none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    any_of = lambda words: low.rlike("|".join(w.replace(".", r"\.") for w in words))
    return low.rlike(DOMAIN_FOR_SALE) | any_of(PARKED) | (any_of(BRANDS) & any_of(OFFERS))


def parked_page(html) -> Column:
    """``parked`` of a page's title and visible text."""
    return parked(visible_text(html))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def phrase_in(text: Column, phrase: Column) -> Column:
    """The phrase's tokens follow each other in the text."""
    line = lambda c: F.concat(F.lit(" "), F.array_join(tokens(c), " "), F.lit(" "))
    return (F.size(tokens(phrase)) > 0) & line(text).contains(line(phrase))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def truncate_words(text: Column, n: int) -> Column:
    """At most ``n`` characters, cut at the last space among them if there is one."""
    head = F.substring(text, 1, n)
    at_word = F.regexp_replace(head, r"\s+\S*\z", "")
    return F.when(F.length(text) <= n, text).otherwise(F.when(at_word != "", at_word).otherwise(head))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+"))


def paragraph_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\n\s*\n"), lambda p: F.trim(p) != ""))


def quote_grounded(quote: Column, source: Column) -> Column:
    """The quote is verbatim in the source up to case and white space; parts between ellipses in order, each of 12 characters or more."""
    src = F.lower(squeeze(source))
    parts = F.filter(F.transform(F.split(quote, r"\.\.\.|…"), lambda p: F.lower(squeeze(p))), lambda p: p != "")

    def step(at, p):
        # position after p's first place at or after ``at``; -1 once something fails
        found = F.position(p, src, F.greatest(at, F.lit(1)))
        return F.when((at < 0) | (F.length(p) < FRAGMENT) | (found == 0), F.lit(-1)).otherwise(found + F.length(p))

    many = F.aggregate(parts, F.lit(1), step) > 0
    return F.when(quote.isNull() | (F.size(parts) == 0), False).when(F.size(parts) == 1, src.contains(F.element_at(parts, 1))).otherwise(many)


def grounded_share(words: Column, source: Column) -> Column:
    """Share of the words that the source has; 1 of none."""
    n = F.size(words)
    return F.when(n == 0, 1.0).otherwise(F.size(F.filter(words, lambda w: F.lower(source).contains(F.lower(w)))) / F.nullif(n, F.lit(0)))


def capitalised(text: Column) -> Column:
    """Distinct capitalised words of three letters or more that don't begin a sentence."""
    inner = F.flatten(F.transform(F.split(text, r"[.!?\n]+\s*"), lambda s: F.slice(F.filter(F.split(F.trim(s), r"\s+"), lambda w: w != ""), 2, 100000)))
    return F.array_distinct(F.filter(F.transform(inner, lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}]", "")), lambda w: w.rlike(r"^[A-Z].{2,}")))


def xml_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def rfc822(day: Column) -> Column:
    return F.concat(F.date_format(day, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))


def long_date(day: Column) -> Column:
    return F.coalesce(F.date_format(day, "MMMM d, yyyy"), F.lit("—"))


def range_label(low: Column, high: Column) -> Column:
    both = F.when(low == high, low.cast("string")).otherwise(F.concat(low.cast("string"), F.lit("–"), high.cast("string")))
    return F.when(low.isNotNull() & high.isNotNull(), both).when(low.isNotNull(), F.concat(low.cast("string"), F.lit("+"))).when(high.isNotNull(), F.concat(F.lit("≤"), high.cast("string"))).otherwise("—")


def growth_label(recent: Column, growth: Column) -> Column:
    """Percent, halves up; "new" for a first funding."""
    pct = F.floor(growth * 100 + 0.5)
    return F.when(growth.isNull(), F.when(recent > 0, "new").otherwise("—")).when(pct < 0, F.concat(F.lit("−"), F.abs(pct).cast("string"), F.lit("%"))).otherwise(F.concat(F.lit("+"), pct.cast("string"), F.lit("%")))


def relative_time(seconds: Column) -> Column:
    s = F.greatest(seconds.cast("double"), F.lit(0.0))
    minutes = F.floor(s / 60 + 0.5)
    hours = F.floor(minutes / 60 + 0.5)
    days = F.floor(hours / 24 + 0.5)
    unit = lambda n, word: F.concat(n.cast("string"), F.when(n == 1, f" {word} ago").otherwise(f" {word}s ago"))
    return F.when(seconds.isNull(), "—").when(s < 90, "just now").when(minutes < 90, F.concat(minutes.cast("string"), F.lit(" minutes ago"))).when(hours < 36, unit(hours, "hour")).otherwise(unit(days, "day"))


class _Reader(HTMLParser):
    """Visible text, description meta tags and links of a page."""

    HIDDEN = {"script", "style", "noscript", "template", "svg", "head"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.words, self.meta, self.links = [], [], []
        self.title, self.depth, self.in_title, self.open_link = [], 0, False, None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "title":
            self.in_title = True
        elif tag == "meta":
            key = (a.get("name") or a.get("property") or "").lower()
            if key in ("description", "og:description", "og:title") and a.get("content"):
                self.meta.append(" ".join(a["content"].split()))
        elif tag in self.HIDDEN:
            self.depth += 1
        elif tag == "a" and a.get("href"):
            self.open_link = [a["href"].strip(), []]

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        elif tag in self.HIDDEN:
            self.depth = max(0, self.depth - 1)
        elif tag == "a" and self.open_link:
            self.links.append((self.open_link[0], " ".join("".join(self.open_link[1]).split())))
            self.open_link = None

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif not self.depth:
            self.words.append(data)
            if self.open_link:
                self.open_link[1].append(data)


def read_html(html: str | None) -> _Reader:
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    return reader


def visible(html: str | None) -> str:
    """Title and description first, each once, then the visible text."""
    r = read_html(html)
    head = list(dict.fromkeys(x for x in [" ".join("".join(r.title).split()), *r.meta] if x))
    return "\n".join([*head, " ".join(" ".join(r.words).split())]).strip()


def _by_value(f, kind: str, c) -> Column:
    """``f`` over a column of texts of any length, made when used, so that workers can import this module.

    Rows go to Python a hundred at a time, whatever a table's size; an Arrow batch would hold 10,000 texts and all that is found in them.
    """
    return F.udf(f, kind, useArrow=False)(c)


def visible_text(html) -> Column:
    return _by_value(visible, "string", html)


def links(html: str | None) -> list[dict[str, str]]:
    return [{"url": u, "label": t} for u, t in read_html(html).links]


def page_links(html) -> Column:
    return _by_value(links, "array<struct<url:string,label:string>>", html)


def balanced(text: str | None, start: int = 0) -> str | None:
    """The JSON array or object that begins at the first bracket from ``start``, or None."""
    found = re.compile(r"[\[{]").search(text or "", start)
    if not found:
        return None
    depth, quoted, escaped = 0, False, False
    for n in range(found.start(), len(text)):
        c = text[n]
        if quoted:
            quoted, escaped = (c != '"' or escaped), (c == "\\" and not escaped)
        elif c == '"':
            quoted = True
        elif c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
            if not depth:
                part = text[found.start() : n + 1]
                try:
                    json.loads(part)
                except ValueError:
                    return None
                return part
    return None


def json_island(text) -> Column:
    return _by_value(balanced, "string", text)


def _mulberry(seed: int):
    """The 32-bit generator of that name: numbers from 0 to 1."""
    state, full = seed & 0xFFFFFFFF, 0xFFFFFFFF
    while True:
        state = (state + 0x6D2B79F5) & full  # fixed value
        x = ((state ^ (state >> 15)) * (state | 1)) & full
        x ^= (x + ((x ^ (x >> 7)) * (x | 61))) & full
        yield (x ^ (x >> 14)) / 4294967296


def seeded_shuffle(items: Column, seed: int) -> Column:
    """A small array in the order that a seed gives; the same on every run."""

    def run(values: pd.Series) -> pd.Series:
        out = []
        for value in values:
            held, draw = list(value), _mulberry(seed)
            for last in range(len(held) - 1, 0, -1):
                at = int(next(draw) * (last + 1))
                held[last], held[at] = held[at], held[last]
            out.append(held)
        return pd.Series(out)

    return F.pandas_udf(run, "array<long>")(items.cast("array<long>"))
