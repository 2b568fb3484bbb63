"""Landed portfolio pages as a Spark data source: ``spark.read.format("listing")``.

A folder holds listings, a listing pages: ``listing=yc/page=0/…``. Planning reads what says how many pages there are (the
first page of a paged listing, the index of a sitemap); each page is then a partition of its own, with its place in the
listing as state. A listing without a usable entry, a missing page and a page of another shape are structural misses
and fail the read, as an empty portfolio always means that a site has changed. A partition of its own looks through each listing's
pages for the first usable entry, so that nothing is read twice where there is one.

Options: ``path``; ``kind`` (below); ``listing`` to read one listing; ``limit``, entries of a page; ``pages``, most pages of a listing;
``marker``, what stands before a page's JSON; ``css``, the class of cards; ``skip``, stages left out, joined by commas.

=========  =====================================================================================
paged      JSON pages of ``hits`` that tell ``nbPages``
island     a JSON array after ``marker`` in a page's script
sitemap    a sitemap, or an index of sitemaps that are pages here, whose addresses name companies
cards      an HTML element of class ``css`` for each company, on a landing page and its categories
results    links of a page of search results, out of their redirects
=========  =====================================================================================
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from urllib.parse import parse_qs, unquote, urlparse
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from fathomline.functions.names import normalize_name
from fathomline.functions.text import balanced
from fathomline.sources.feeds import cards

MOST_PAGES = 50  # fixed value: no listing is longer, whatever it says
COMPANY_PATH = re.compile(r"/company/([^/?#]+)/?$")  # fixed value: an address that names a company
PLACEHOLDER = re.compile(r"^\s*[\[(<].*[\])>]\s*$")  # a bracketed name stands for none
SCHEMA = "listing string, page string, pos int, name string, website string, description string"


class StructuralMiss(RuntimeError):
    """A landed page is not of the shape that its reader knows."""


@dataclass
class Page(InputPartition):
    """One page of a listing; ``at`` is its place in the listing's order. Without a page, the listing's check."""

    listing: str
    page: str | None
    at: int
    files: tuple[tuple[str, ...], ...]


def _filled(value) -> str | None:
    return value.strip() if isinstance(value, str) and value.strip() else None


def _json(text: str, where: str):
    try:
        return json.loads(text)
    except ValueError as wrong:
        raise StructuralMiss(f"{where}: no JSON ({wrong})") from None


def paged_head(text: str, where: str) -> tuple[list, int | None]:
    """The hits of a page, and how many pages there are if it tells."""
    body = _json(text, where)
    if isinstance(body, dict) and isinstance(body.get("results"), list) and body["results"]:
        body = body["results"][0]
    if not isinstance(body, dict) or not isinstance(body.get("hits", []), list):
        raise StructuralMiss(f"{where}: no page of hits")
    total = body.get("nbPages")
    return body.get("hits", []), total if isinstance(total, int) and not isinstance(total, bool) else None


def read_paged(text: str, where: str, options: dict) -> Iterator[tuple]:
    skip = {s for s in options.get("skip", "").split(",") if s}
    for hit in paged_head(text, where)[0]:
        if isinstance(hit, dict) and hit.get("stage") not in skip and _filled(hit.get("name")):
            yield hit["name"].strip(), _filled(hit.get("website")), _filled(hit.get("one_liner"))


def read_island(text: str, where: str, options: dict) -> Iterator[tuple]:
    marker = options["marker"]
    found = balanced(text, text.find(marker) + len(marker)) if marker in text else None
    if found is None:
        raise StructuralMiss(f"{where}: no array after {marker}")
    for entry in _json(found, where):
        name = _filled(entry.get("title", entry.get("name"))) if isinstance(entry, dict) else None
        if name and not PLACEHOLDER.match(name):
            yield name, _filled(entry.get("web", entry.get("website"))), None


def sitemap_addresses(text: str, where: str) -> tuple[bool, list[str]]:
    """Whether a sitemap is an index, and its addresses."""
    try:
        root = ElementTree.fromstring(text.strip())
    except ElementTree.ParseError as wrong:
        raise StructuralMiss(f"{where}: no XML ({wrong})") from None
    found = [(e.text or "").strip() for e in root.iter() if e.tag.rsplit("}", 1)[-1] == "loc"]
    return root.tag.rsplit("}", 1)[-1] == "sitemapindex", [x for x in found if x]


def read_sitemap(text: str, where: str, options: dict) -> Iterator[tuple]:
    for address in sitemap_addresses(text, where)[1]:
        found = COMPANY_PATH.search(urlparse(address).path)
        if found:
            name = " ".join(w[:1].upper() + w[1:] for w in unquote(found[1]).replace("_", "-").split("-") if w)
            if name:
                yield name, None, None


def read_cards_of(text: str, where: str, options: dict) -> Iterator[tuple]:
    for card in cards(text, options["css"]):
        yield card["name"], _filled(card["url"]), None


class _Results(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.links: list[str] = []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "a" and "result__a" in (a.get("class") or "").split() and a.get("href"):
            self.links.append(a["href"])


def read_results(text: str, where: str, options: dict) -> Iterator[tuple]:
    reader, seen = _Results(), set()
    reader.feed(text)
    for link in reader.links:
        if link.startswith(("/l/", "//duckduckgo.com/l/")):  # fixed values: redirects
            link = parse_qs(urlparse(link).query).get("uddg", [""])[0]
        if link.startswith(("http://", "https://")) and link not in seen:
            seen.add(link)
            yield None, link, None


READERS = {"paged": read_paged, "island": read_island, "sitemap": read_sitemap, "cards": read_cards_of, "results": read_results}


def _order(page: str) -> tuple:
    return (0, int(page), "") if page.isdigit() else (1, 0, page)


class ListingReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)
        self.kind = self.options.get("kind", "paged")
        if self.kind not in READERS:
            raise ValueError(f"no listing of kind {self.kind}")
        self.most = int(self.options.get("pages", MOST_PAGES))

    def _files(self) -> dict[str, dict[str, list[str]]]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.options["path"])
        found: dict[str, dict[str, list[str]]] = {}
        for f in store.get_file_info(fs.FileSelector(root, recursive=True)):
            at = re.search(r"/listing=([^/]+)/page=([^/]+)/[^/._][^/]*$", f.path)
            if f.type == fs.FileType.File and at and self.options.get("listing", unquote(at[1])) == unquote(at[1]):
                found.setdefault(unquote(at[1]), {}).setdefault(unquote(at[2]), []).append(f.path)
        return found

    def _text(self, files: tuple[str, ...]) -> str:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.options["path"])
        parts = []
        for name in sorted(files):
            with store.open_input_stream(name) as f:
                parts.append(f.read().decode("utf-8", "replace"))
        return "".join(parts)

    def partitions(self) -> list[Page]:
        out: list[Page] = []
        for listing, pages in sorted(self._files().items()):
            out += self._plan(listing, {p: tuple(f) for p, f in pages.items()})
        if not out:
            raise StructuralMiss(f"{self.options['path']}: no landed listing")
        return out

    def _plan(self, listing: str, pages: dict[str, tuple[str, ...]]) -> list[Page]:
        names = sorted(pages, key=_order)
        if self.kind == "paged":
            total = paged_head(self._text(pages[names[0]]), f"{listing} page {names[0]}")[1]
            names = [str(n) for n in range(min(self.most, max(1, total or 1)))]
        elif self.kind == "sitemap" and "index" in pages:
            _, parts = sitemap_addresses(self._text(pages["index"]), f"{listing} index")
            names = list(dict.fromkeys(a.rsplit("/", 1)[-1] for a in parts))[: self.most]
        absent = [n for n in names if n not in pages]
        if absent:
            raise StructuralMiss(f"{listing}: page {absent[0]} has not landed")
        planned = [Page(listing, n, at, (pages[n],)) for at, n in enumerate(names)]
        return [*planned, Page(listing, None, -1, tuple(pages[n] for n in names))]

    def read(self, partition: Page) -> Iterator[tuple]:
        read = READERS[self.kind]
        if partition.page is None:
            for files in partition.files:
                if next(iter(read(self._text(files), partition.listing, self.options)), None):
                    return
            raise StructuralMiss(f"{partition.listing}: no usable entry")
        limit = int(self.options.get("limit", 0))
        for pos, entry in enumerate(read(self._text(partition.files[0]), f"{partition.listing} page {partition.page}", self.options)):
            if limit and pos == limit:
                return
            yield partition.listing, partition.page, partition.at * 1_000_000 + pos, *entry


class ListingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ListingReader:
        return ListingReader(self.options)


def read_listing_pages(spark: SparkSession, place: str, kind: str, **options) -> DataFrame:
    """The entries of landed listings: ``(listing, page, pos, name, website, description)``; ``pos`` orders a listing's entries."""
    spark.dataSource.register(ListingSource)
    return spark.read.format("listing").options(kind=kind, **{k: str(v) for k, v in options.items()}).load(place)


#: How each firm's pages are read.
FIRMS = {
    "yc": {"kind": "paged", "skip": "Pre-Seed"},
    "a16z": {"kind": "island", "marker": "a16z_portfolio_companies = "},
    "kleiner_perkins": {"kind": "sitemap"},
    "khosla": {"kind": "cards", "css": "company-slide"},
    "greylock": {"kind": "cards", "css": "portfolio-card"},
    "lightspeed": {"kind": "cards", "css": "company"},
}


def portfolio(entries: DataFrame) -> DataFrame:
    """``(listing, name, website, description)``: the first entry of each name of a listing."""
    first = Window.partitionBy("listing", "name").orderBy("pos")
    return entries.withColumn("n", F.row_number().over(first)).where("n = 1").select("listing", "name", "website", "description")


def read_firm(spark: SparkSession, place: str, firm: str) -> DataFrame:
    """A firm's portfolio from its landed pages."""
    return portfolio(read_listing_pages(spark, place, listing=firm, **FIRMS[firm]))


# fixed values: sources of a company's size, the most trusted first
HEADCOUNT_SOURCES = ["theorg", "growjo", "careers_page", "github", "wellfound"]


def headcounts(found: DataFrame) -> DataFrame:
    """``(company_id, low, high, source)`` of ``found(company_id, source, low, high)``: the most trusted source that has a range; of its rows the least range."""
    rank = F.array_position(F.array(*map(F.lit, HEADCOUNT_SOURCES)), F.col("source"))
    ranked = found.where(F.col("low").isNotNull() & F.col("high").isNotNull()).withColumn("rank", rank).where("rank > 0")
    best = ranked.groupBy("company_id").agg(F.min(F.struct("rank", "low", "high", "source")).alias("b"))
    return best.select("company_id", "b.low", "b.high", "b.source")


def refreshed(entries: DataFrame, known: DataFrame, floors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a sweep over portfolios found: an outcome a listing, and the companies to add.

    ``entries`` is what ``portfolio`` gives, ``known`` has ``name``, ``floors`` has ``listing`` and ``floor`` (the least entries that a sound listing has). A
    listing of ``floors`` without entries is ``absent``, one under its floor ``low``; neither adds companies. Names are
    compared as normalised; a company on several listings is added once, for the first listing by name.
    """
    named = entries.withColumn("key", normalize_name(F.col("name"))).where("key <> ''")
    old = known.select(normalize_name(F.col("name")).alias("key")).where("key <> ''").distinct()
    fresh = named.join(old, "key", "left_anti")
    counts = entries.groupBy("listing").agg(F.count("*").alias("found")).join(fresh.groupBy("listing").agg(F.count("*").alias("fresh")), "listing", "left").join(floors, "listing", "full")
    outcome = F.when(F.col("found").isNull(), "absent").when(F.col("found") < F.col("floor"), "low").otherwise("ok")
    outcomes = counts.select("listing", F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("fresh", F.lit(0)).alias("fresh"), outcome.alias("outcome"))
    sound = fresh.join(outcomes.where("outcome = 'ok'").select("listing"), "listing", "left_semi")
    first = Window.partitionBy("key").orderBy("listing", "name")
    added = sound.withColumn("n", F.row_number().over(first)).where("n = 1").select("listing", "name", "website", "description")
    return outcomes, added
